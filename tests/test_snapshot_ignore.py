import hashlib
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from lodestack.functions.canonical import decode_path, encode_path, json_string
from lodestack.functions.text import required, classify_content, decode_bytes, detect_language
from lodestack.operators import ignore, snapshot
from lodestack.schemas import ScanError, ScanRaceError
from lodestack.sources import tree


def write(root, files):
    for name, body in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(body if isinstance(body, bytes) else body.encode())


def entries(spark, root):
    return {r["path"]: r for r in snapshot.entries(tree.scan(spark, str(root))).collect()}


def test_scan_order_hidden_empty_and_excluded(spark, tmp_path):
    write(tmp_path, {"z.txt": "z", "a.py": "x", "nested/m.md": "# m", ".hidden": "h", "__init__.py": "", "node_modules/x.js": "1", "b.bin": b"\x00\x01\x02"})
    found = entries(spark, tmp_path)
    assert sorted(found) == [".hidden", "__init__.py", "a.py", "b.bin", "nested/m.md", "z.txt"]
    assert [found[p]["content_kind"] for p in ("__init__.py", "b.bin", "z.txt")] == ["empty", "binary", "text"]
    assert found["nested/m.md"]["language"] == "Markdown" and found["a.py"]["sha256"] == hashlib.sha256(b"x").hexdigest()


def test_links_are_not_followed(spark, tmp_path):
    outside = tmp_path / "outside"
    root = tmp_path / "root"
    write(outside, {"secret.txt": "s"})
    write(root, {"a.txt": "a"})
    os.symlink(outside / "secret.txt", root / "link")
    os.symlink(outside, root / "dir")
    found = entries(spark, root)
    assert found["link"]["kind"] == found["dir"]["kind"] == "symlink"
    assert found["link"]["sha256"] == hashlib.sha256(os.fsencode(os.readlink(root / "link"))).hexdigest()
    assert found["link"]["content_kind"] == "not_applicable"


def test_ignore_rules_of_a_tree(spark, tmp_path):
    write(
        tmp_path,
        {".gitignore": "*.log\n!keep.log\ngenerated/\n/rootonly.txt\ndocs/*.tmp\n**/secret.txt\n.gitignore\n", "a.log": "", "keep.log": "", "generated/x.py": "", "rootonly.txt": "", "sub/rootonly.txt": "", "docs/a.tmp": "", "docs/deeper/a.tmp": "", "x/y/secret.txt": "", "keep.py": ""},
    )
    assert sorted(entries(spark, tmp_path)) == [".gitignore", "docs/deeper/a.tmp", "keep.log", "keep.py", "sub/rootonly.txt"]


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("*.py", "a/b.py", True), ("/a", "b/a", False), ("a/**/b", "a/x/y/b", True), ("a/**/b", "a/b", True), ("[!x]y", "ay", True), ("[!x]y", "xy", False), ("[^a]", "b", False), ("[^a]", "^", True), ("a[", "a[", True), ("\\#x", "#x", True), ("a\\ ", "a ", True), ("a  ", "a", True), ("?", "/", False)],
)
def test_patterns(spark, pattern, path, hit):
    rules = ignore.compile_rules({".gitignore": pattern})
    got = spark.createDataFrame([(path,)], "path string").select(ignore.is_ignored(rules, F.col("path"))).first()[0]
    assert got == hit
    assert bool(re.fullmatch(rules[0].pattern, path.rpartition("/")[2] if rules[0].name_only else path)) == hit


def test_child_rule_cannot_bring_back_an_ignored_parent(spark):
    files = spark.createDataFrame([("out/a.txt",), ("out/.gitignore",), ("b.txt",)], "path string")
    kept = ignore.select_paths(files, {".gitignore": "out/\n", "out/.gitignore": "!a.txt\n"})
    assert [r[0] for r in kept.collect()] == ["b.txt"]


def test_fingerprint_is_that_of_the_canonical_list(spark, tmp_path):
    write(tmp_path, {"é.py": "1", 'q"uote.txt': "2", "b/c.md": "3"})
    e = snapshot.entries(tree.scan(spark, str(tmp_path)))
    rows = sorted((r.asDict() for r in e.collect()), key=lambda r: r["path"])
    expected = hashlib.sha256(json.dumps(rows, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert snapshot.fingerprints(e.withColumn("r", F.lit("x")), ["r"]).first()["fingerprint"] == expected


def test_compare(spark):
    cols = "path string, kind string, size_bytes long, sha256 string, executable boolean, content_kind string, language string"
    row = lambda p, sha="0", ex=False: (p, "file", 1, sha, ex, "text", None)
    a = spark.createDataFrame([row("old"), row("run"), row("mod"), row("same")], cols)
    b = spark.createDataFrame([row("new"), row("run", ex=True), row("mod", "1"), row("same")], cols)
    assert {r["path"]: r["change"] for r in snapshot.compare(a, b).collect()} == {"old": "removed", "new": "added", "run": "metadata_only", "mod": "modified"}


def test_names_that_are_not_utf8(spark, tmp_path):
    with open(os.path.join(os.fsencode(tmp_path), b"bad-\xff.py"), "w") as f:
        f.write("x")
    (path,) = entries(spark, tmp_path)
    assert decode_path(path) == "bad-\udcff.py" and encode_path("\x1fx") == "\x1fu\x1fx" and decode_path(encode_path("\x1fx")) == "\x1fx"


def test_race_root_and_limits(spark, tmp_path, monkeypatch):
    write(tmp_path, {"r/a.txt": "a"})
    with pytest.raises(ScanError):
        tree.checked_root("relative")
    os.symlink(tmp_path / "r", tmp_path / "l")
    with pytest.raises(ScanError):
        tree.checked_root(str(tmp_path / "l"))
    plain = tree.Walk.signature
    seen = iter([0, 1])
    monkeypatch.setattr(tree.Walk, "signature", lambda self: [*plain(self), next(seen)])
    with pytest.raises(ScanRaceError):
        tree.checked_scan(spark, str(tmp_path / "r"), str(tmp_path / "out"))


def test_json_strings(spark):
    texts = ["plain", 'q"\\', "\n\t\x01\x1f\x7f", "é漢😀", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", json_string(F.col("t")).alias("j"))
    assert all(r["j"] == json.dumps(r["t"]) for r in df.collect())


def test_languages_and_classes(spark):
    names = {"x.py.bak": "Python", "Dockerfile.dev": "Dockerfile", "Makefile": "Makefile", ".py": None, "a.unknown": None, "a/b.C": "C", "x.tar.md": "Markdown", "y.": None, "a.py.": None}
    got = {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in names], "p string").select("p", detect_language(F.col("p"))).collect()}
    assert got == names
    bodies = {b"": "empty", b"hello": "text", b"\xff\xfeh\x00": "text", b"a\x00": "binary", b"\x01" * 2 + b"a" * 18: "binary", b"\x01" + b"a" * 19: "text", b"\x00\x00\xfe\xff\x00": "text"}
    df = spark.createDataFrame([(bytearray(b),) for b in bodies], "b binary")
    assert {bytes(r[0]): r[1] for r in df.select("b", classify_content(F.octet_length("b"), F.substring("b", 1, 8192))).collect()} == bodies
    assert decode_bytes(b"caf\xe9") == ("caf�", True) and decode_bytes("é".encode("utf-16")) == ("é", False) and decode_bytes(b"\xef\xbb\xbfx") == ("x", False)


def test_bound_reads_and_map(spark, tmp_path):
    write(tmp_path, {"a.py": "x = 1\n", "b.md": "text"})
    raw = tree.scan(spark, str(tmp_path)).cache()
    e = snapshot.entries(raw).cache()
    assert {r["path"]: bytes(r["content"]) for r in snapshot.bound_reads(e, raw, 100).collect()} == {"a.py": b"x = 1\n", "b.md": b"text"}
    with pytest.raises(Exception, match="differs from its snapshot"):
        snapshot.bound_reads(e, raw.withColumn("content", F.encode(F.lit("other"), "UTF-8")), 100).collect()
    with pytest.raises(Exception, match="exceeds the read limit"):
        snapshot.bound_reads(e, raw, 5).collect()
    head = snapshot.map_header("r", e).splitlines()
    assert head[0] == 'repository: "r"' and head[2:] == ["entries: 2", "bytes: 10", "languages: Markdown=1, Python=1", "paths:"]
    line = {r["path"]: r["line"] for r in snapshot.map_lines(e).collect()}["a.py"]
    assert line == '"a.py"\tfile\ttext\tPython\t6\t-\t' + hashlib.sha256(b"x = 1\n").hexdigest()[:12]
    assert snapshot.invalid_entries(e).isEmpty() and snapshot.duplicate_paths(e).isEmpty()
    for bad in ("", "/a", "a//b", "a/../b", "./a", "a\0"):
        with pytest.raises(ValueError):
            snapshot.checked_path(bad)


def test_scan_follows_its_policy(spark, tmp_path):
    write(tmp_path, {"r/keep/a": "1", "r/skip/b": "2", "r/.git/c": "3"})
    policy = tree.ScanPolicy(excluded_names=("skip",))
    rows = tree.checked_scan(spark, str(tmp_path / "r"), str(tmp_path / "out"), policy)
    assert {r["path"] for r in rows.collect()} == {"keep/a", ".git/c"}
    assert {r["path"] for r in tree.scan(spark, str(tmp_path / "r")).collect()} == {"keep/a", "skip/b"}


def test_a_link_above_a_file_is_not_followed(spark, tmp_path):
    write(tmp_path, {"r/d/a": "1", "other/a": "2"})
    reader = tree.TreeReader(str(tmp_path / "r"), 1, tree.ScanPolicy())
    (part,) = reader.partitions()
    os.rename(tmp_path / "r/d", tmp_path / "away")
    os.symlink(tmp_path / "away", tmp_path / "r/d")
    with pytest.raises(ScanRaceError):
        list(reader.read(part))


def test_contents_that_change_in_place_are_a_race(spark, tmp_path, monkeypatch):
    write(tmp_path, {"r/a": "first"})
    at, plain, calls = os.stat(tmp_path / "r/a"), tree.scan, []

    def scan(*args, **kw):
        if calls:  # the second read: other bytes of the same size at the same time
            (tmp_path / "r/a").write_text("other")
            os.utime(tmp_path / "r/a", ns=(at.st_atime_ns, at.st_mtime_ns))
        calls.append(1)
        return plain(*args, **kw)

    monkeypatch.setattr(tree, "scan", scan)
    with pytest.raises(ScanRaceError):
        tree.checked_scan(spark, str(tmp_path / "r"), str(tmp_path / "out"))


def test_normal_forms(spark):
    df = spark.createDataFrame([(f"\u00a0 {'AB' * 32}\n",)], "s string")
    assert df.select(snapshot.normal_sha256(F.col("s"))).first()[0] == "ab" * 32
    with pytest.raises(Exception, match="not a SHA-256"):
        df.select(snapshot.normal_sha256(F.lit("xyz"))).collect()
    assert df.select(required(F.lit("\u2003 a b\x1c"), "name")).first()[0] == "a b"
    with pytest.raises(Exception, match="name must not be empty"):
        df.select(required(F.lit(" \u00a0"), "name")).collect()
    e = spark.createDataFrame([("a", "file", 1, "0", False, "text", None)], "path string, kind string, size_bytes long, sha256 string, executable boolean, content_kind string, language string")
    assert snapshot.is_same(e, e) and not snapshot.is_same(e, e.withColumn("executable", F.lit(True)))

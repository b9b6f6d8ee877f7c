"""Ignore rules by a tree of directories, and trees that tasks list and hash."""

import hashlib
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lodestack.functions.canonical import decode_path
from lodestack.operators import ignore, snapshot
from lodestack.schemas import ScanError, ScanPolicy, ScanRaceError
from lodestack.sources import tree


def plainly_ignored(rules, path, is_dir):
    """Every rule for every directory of a path; the last that matches decides."""
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        at, found = "/".join(parts[:n]), False
        for r in rules:
            if r.directories and n == len(parts) and not is_dir:
                continue
            inside = at if not r.base else at[len(r.base) + 1 :] if at.startswith(r.base + "/") else None
            if inside is not None and re.fullmatch(r.pattern, inside.rpartition("/")[2] if r.name_only else inside, re.DOTALL):
                found = not r.negated
        if found:
            return True
    return False


def random_sources(draw, folders):
    names = ["a", "b", "c", "*", "a*", "?", "[ab]", "**/b", "a/**", "a/b", "/c", "*.b", "a.b", "b/", "/a/", "[!a]", "\\*", "x y"]
    return {f"{at}/.gitignore" if at else ".gitignore": "".join(("!" if draw.random() < 0.3 else "") + draw.choice(names) + "\n" for _ in range(draw.randrange(1, 6))) for at in folders}


def test_rule_tree_equals_every_rule_for_every_directory(spark):
    draw = random.Random(7)
    words = ["a", "b", "c", "a.b", "x y", "*", "", "ab"]
    for _ in range(60):
        rules = ignore.compile_rules(random_sources(draw, draw.sample(["", "a", "b", "a/b", "a/b/c", "c", "x y"], 4)))
        rule_tree = ignore.RuleTree(rules)
        for _ in range(80):
            path, is_dir = "/".join(draw.choice(words) for _ in range(draw.randrange(1, 6))), draw.random() < 0.3
            assert rule_tree.ignored(path, is_dir) == plainly_ignored(rules, path, is_dir), (path, is_dir, rules)


def test_both_ways_on_columns(spark, monkeypatch):
    draw = random.Random(3)
    rules = ignore.compile_rules(random_sources(draw, ["", "a", "b", "a/b", "c"]))
    rows = [("/".join(draw.choice(["a", "b", "c", "a.b", "x y", "ab"]) for _ in range(draw.randrange(1, 5))), draw.random() < 0.3) for _ in range(300)] + [(None, False), ("", False), ("/a", False), ("a\nb", True)]
    df = spark.createDataFrame(rows, "path string, is_dir boolean")
    monkeypatch.setattr(ignore, "FEW_RULES", 1000)
    one = ignore.is_ignored(rules, F.col("path"), F.col("is_dir"))
    other = ignore.ignored_by_tree(rules, F.col("path"), F.col("is_dir"))
    assert df.select("path", "is_dir", one.alias("one"), other.alias("other")).where("NOT one <=> other").collect() == []


def test_ten_thousand_rules_cost_a_path_its_own_folders_only():
    sources = {f"d{n}/.gitignore": "".join(f"x{k}\n*.{k}\n" for k in range(5)) for n in range(1000)}
    rule_tree = ignore.RuleTree(ignore.compile_rules(sources))
    began = time.process_time()
    hits = sum(rule_tree.ignored(f"d{n % 1000}/s/f{n}.{n % 10}", False) for n in range(100_000))
    assert hits == 50_000 and time.process_time() - began < 20


def test_select_paths_of_many_ignore_files(spark):
    sources = {".gitignore": "out/\n", **{f"d{n}/.gitignore": "*.log\n!keep.log\n" for n in range(20)}, "out/.gitignore": "!a\n"}
    files = spark.createDataFrame([(p,) for p in ["out/a", "d3/x.log", "d3/keep.log", "d3/.gitignore", "e/x.log", "out/.gitignore", ".gitignore"]], "path string")
    assert {r[0] for r in ignore.select_paths(files, sources).collect()} == {"d3/keep.log", "d3/.gitignore", "e/x.log", ".gitignore"}


def build(root):
    files = {
        ".gitignore": b"*.log\nbuild/\n!keep.log\n", "a.py": b"x = 1\n", "x.log": b"", "keep.log": b"k", "build/out.txt": b"o", "node_modules/m.js": b"1",
        "src/.gitignore": b"!x.log\n/gen/\n", "src/x.log": b"1", "src/gen/g.py": b"g", "src/deep/er/gen/h.py": b"h", "src/deep/x.log": b"d", "empty": b"", "big.bin": bytes(range(256)) * 12_000,
    }
    for name, body in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
        with open(os.path.join(root, name), "wb") as f:
            f.write(body)
    os.symlink("a.py", os.path.join(root, "link"))
    os.symlink("src", os.path.join(root, "dirlink"))
    os.mkfifo(os.path.join(root, "pipe"))
    with open(os.path.join(os.fsencode(root), b"bad-\xff.txt"), "w") as f:
        f.write("n")
    os.mkdir(os.path.join(root, "nothing"))


def test_listed_by_tasks_as_by_the_driver(spark, tmp_path):
    build(tmp_path)
    listed = tree.walk(spark, str(tmp_path))
    plain = tree.Walk(str(tmp_path), ScanPolicy()).run()
    assert sorted((decode_path(r["path"]), r["kind"], r["inode"], r["size"], r["mtime"]) for r in listed.collect()) == sorted((p, k, s.st_ino, s.st_size, s.st_mtime_ns) for p, k, s in plain.rows)
    a = snapshot.entries(tree.scan(spark, str(tmp_path)))
    b = snapshot.entries(tree.hashed(listed, str(tmp_path)))
    assert a.count() == b.count() == 13 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_hashes_move_no_contents_and_filters_open_no_files(spark, tmp_path):
    build(tmp_path)
    listed = tree.walk(spark, str(tmp_path))
    os.unlink(tmp_path / "big.bin")  # listed, but gone when it is opened
    chosen = tree.hashed(listed.where("path = 'a.py'"), str(tmp_path)).collect()
    assert [(r["path"], r["sha256"], bytes(r["head"])) for r in chosen] == [("a.py", hashlib.sha256(b"x = 1\n").hexdigest(), b"x = 1\n")]
    with pytest.raises(Exception, match="cannot be opened"):
        tree.hashed(listed, str(tmp_path)).collect()
    contents = {r["path"]: bytes(r["content"]) for r in tree.with_content(listed.where("path LIKE 'src/%'"), str(tmp_path), 100).collect()}
    assert contents == {"src/.gitignore": b"!x.log\n/gen/\n", "src/x.log": b"1", "src/deep/er/gen/h.py": b"h", "src/deep/x.log": b"d"}
    with pytest.raises(Exception, match="read limit"):
        tree.with_content(listed.where("path = 'src/.gitignore'"), str(tmp_path), 3).collect()


def test_pushed_filters_choose_from_the_listing(spark, tmp_path):
    build(tmp_path)
    scan = tree.scan(spark, str(tmp_path))
    assert {r["path"] for r in scan.where("kind = 'symlink'").collect()} == {"link", "dirlink"}
    assert {r["path"] for r in scan.where("path LIKE 'src/%' AND kind IN ('file', 'special')").collect()} == {"src/.gitignore", "src/x.log", "src/deep/er/gen/h.py", "src/deep/x.log"}
    reader = tree.TreeReader(str(tmp_path), 4, ScanPolicy())
    given = [tree.EqualTo(("kind",), "file"), tree.In(("path",), ("a.py", "link")), tree.EqualTo(("size",), 6)]
    assert list(reader.pushFilters(given)) == given
    assert [r[0] for p in reader.partitions() for r in p.rows] == [b"a.py"]


def test_entry_limit_roots_and_races(spark, tmp_path):
    build(tmp_path)
    names = sum(len(d) + len(f) for d, f in ((d, f) for at, d, f in os.walk(tmp_path) if not re.search(r"/(build|node_modules|src/gen)$", at))) - 1
    assert tree.walk(spark, str(tmp_path), ScanPolicy(max_entries=names)).count() == 13
    for fewer in (names - 1, 3):
        with pytest.raises(Exception, match="entries"):
            tree.walk(spark, str(tmp_path), ScanPolicy(max_entries=fewer))
        with pytest.raises(ScanError):
            tree.Walk(str(tmp_path), ScanPolicy(max_entries=fewer)).run()
    with pytest.raises(ScanError):
        tree.walk(spark, "relative")
    os.mkdir(tmp_path / "nothing/more")
    assert tree.walk(spark, str(tmp_path / "nothing")).collect() == []


def test_hashes_of_a_changing_tree(spark, tmp_path, monkeypatch):
    root = tmp_path / "r"
    os.mkdir(root)
    build(root)
    rows = tree.checked_hashes(spark, str(root), str(tmp_path / "out"))
    assert rows.count() == 13 and "content" not in rows.columns
    plain, calls = tree.walk, []

    def walk(*args, **kw):
        if calls:
            (root / "new").write_text("n")
        calls.append(1)
        return plain(*args, **kw)

    monkeypatch.setattr(tree, "walk", walk)
    with pytest.raises(ScanRaceError):
        tree.checked_hashes(spark, str(root), str(tmp_path / "out"))


def test_large_file_in_bounded_memory(spark, tmp_path):
    """A sparse file of 3 GB: hashed in steps, its peak far below its size."""
    with open(tmp_path / "large", "wb") as f:
        f.truncate(3 << 30)
    row = {"inode": os.stat(tmp_path / "large").st_ino, "size": 3 << 30, "mtime": os.stat(tmp_path / "large").st_mtime_ns, "path": "large"}
    import tracemalloc

    fd = os.open(tmp_path, os.O_RDONLY)
    tracemalloc.start()
    try:
        assert sum(len(s) for s in tree._steps(row, fd, b"large")) == 3 << 30 and tracemalloc.get_traced_memory()[1] < 8 << 20
    finally:
        tracemalloc.stop()
        os.close(fd)

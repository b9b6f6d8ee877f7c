import hashlib
import shutil
import sqlite3
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.functions.text import classify_content, tokens
from lodestack.operators import lexical, snapshot, structure
from lodestack.plans.index_sync import LexicalIndex, StructuralIndex, hashed
from lodestack.plans.store import Store, StoreBusy
from lodestack.schemas import ContractError, EngineError, LexicalError, LexicalNotReady, LexicalPolicy, LexicalQueryError, LexicalStale, StructuralError, StructuralPolicy, StructuralQueryError

SMALL = LexicalPolicy(chunk_lines=4, overlap_lines=1, max_chunk_chars=20, max_chunks=50)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\r", max_size=120))
def test_chunks_cover_every_line(text):
    spans = list(lexical.line_spans(text, LexicalPolicy(chunk_lines=4, overlap_lines=1, max_chunk_chars=20)))
    lines = text.splitlines(keepends=True)
    assert all(len(c) <= 20 and a <= b <= max(1, len(lines)) and b - a < 4 for a, b, c in spans)
    assert {n for a, b, _ in spans for n in range(a, b + 1)} == set(range(1, max(1, len(lines)) + 1))


def test_chunk_limits(spark):
    df = spark.createDataFrame([("p", "s", "x\n" * 500)], "path string, file_sha256 string, text string")
    with pytest.raises(Exception, match="more than 50 chunks"):
        lexical.chunks(df, SMALL).collect()
    assert [r["content"] for r in lexical.chunks(df.withColumn("text", F.lit("needle " * 5)), SMALL).collect()] == ["needle needle needle", " needle needle "]
    with pytest.raises(ContractError):
        LexicalPolicy(chunk_lines=5, overlap_lines=5)


def test_tokens_agree_with_full_text_search(spark):
    texts = ["Señor_x MixedWords", "Straße ﬁ² ế", "x\u0301y a-b 12.5", "ÀÉÎõü Ñandú", "", "emoji 😀 ok", "snake_case2 λόγος Привет"]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(c, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text search here")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    db.executemany("INSERT INTO t(rowid, c) VALUES (?, ?)", enumerate(texts))
    expected = [[r[0] for r in db.execute("SELECT term FROM v WHERE doc = ? ORDER BY offset", (k,))] for k in range(len(texts))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", tokens(F.col("t")).alias("t")).orderBy("k")
    assert [r["t"] for r in df.collect()] == expected


def rows(spark, *found):
    return spark.createDataFrame([(p, 0, c) for p, c in found], "path string, chunk_index int, content string")


def found(spark, query, *texts, **kw):
    return [(r["path"], r["score"]) for r in lexical.search(rows(spark, *texts), query, **kw).collect()]


def test_search_behaviours(spark):
    assert found(spark, 'tide" NEAR (', ("a", "tide low")) == []
    for bad in ("", "   ", "***", "___", "x" * 1001, "\ud800"):
        with pytest.raises(LexicalQueryError):
            lexical.prepare_query(bad)
    assert [p for p, _ in found(spark, "tide", ("tide.txt", "other"), ("notes.txt", "tide"))] == ["tide.txt", "notes.txt"]
    assert [p for p, _ in found(spark, "x", ("b", "x"), ("a", "x"))] == ["a", "b"]
    for q in ("tide_table", "tide table"):
        assert len(found(spark, q, ("a", "the tide_table here"))) == 1
    assert all(s > 0 for _, s in found(spark, "nino", ("1", "Niño"), ("2", "nino again"))) and len(found(spark, "nino", ("1", "niño"), ("2", "nino"))) == 2
    assert len(found(spark, "two one", ("one", "two"))) == 1, "terms may be in different columns"
    assert found(spark, "a_b", ("p", "a x b")) == [], "a phrase stands word after word"
    with pytest.raises(Exception, match="refine"):
        found(spark, "needle", *((f"f{k}", "needle") for k in range(4)), policy=LexicalPolicy(max_candidates=3))
    with pytest.raises(LexicalQueryError):
        found(spark, "a", ("a", "a"), limit=True)
    assert found(spark, "term", ("p", "term " * 30)) == [("p", 10 * 20 + 25)]


def test_postings_match_like_scans(spark):
    df = rows(spark, ("a/x.txt", "the quick brown fox"), ("b/the.txt", "quick red fox"), ("c", "")).withColumn("chunk_id", F.col("path"))
    for q in ("quick_brown", "the fox", "brown quick", "txt", "nothing"):
        query = lexical.prepare_query(q)
        scan = {r["path"] for r in df.where(lexical.matches(query)).collect()}
        assert {r["chunk_id"] for r in lexical.match_postings(lexical.postings(df), query).collect()} == scan


def tree_of(spark, **files):
    raw = spark.createDataFrame([(p.replace("__", "/"), "file", bytearray(b if isinstance(b, bytes) else b.encode()), 0o100644, 0) for p, b in files.items()], "path string, kind string, content binary, mode int, device long")
    e = snapshot.entries(raw).cache()
    return e, snapshot.fingerprints(e.withColumn("r", F.lit(1)), ["r"]).first()["fingerprint"], raw.select("path", "content").cache()


def with_names(spark, files):
    return tree_of(spark, **{k.replace("/", "__"): v for k, v in files.items()})


def test_lexical_sync(spark, tmp_path):
    index = LexicalIndex(Store(spark, str(tmp_path / "s")), LexicalPolicy(max_file_bytes=60), buckets=4)
    with pytest.raises(LexicalNotReady):
        index.search("x", "a")
    first = with_names(spark, {"a.py": "alpha needle", "b.py": "beta", "big.txt": "needle " * 20, "bad.txt": b"ma\xf1ana needle", "blank_notes.ini": ""})
    assert index.sync(*first).rebuilt == 5
    assert index.sync(*first).changed is False
    hits, gaps = index.search(first[1], "needle")
    assert [r["path"] for r in hits.collect()] == ["a.py", "bad.txt"]
    assert {(r["path"], r["reason"]) for r in gaps.collect()} == {("big.txt", "skipped"), ("bad.txt", "lossy")}
    assert [r["path"] for r in index.search(first[1], "blank_notes")[0].collect()] == ["blank_notes.ini"]
    ids = {r["path"]: r["chunk_id"] for r in index.store.table("chunks").collect()}
    second = with_names(spark, {"a.py": "alpha needle", "b.py": "beta needle", "bad.txt": b"ma\xf1ana needle"})
    done = index.sync(*second)
    assert (done.rebuilt, done.removed, done.unchanged) == (1, 2, 2)
    assert {r["path"]: r["chunk_id"] for r in index.store.table("chunks").collect()}["a.py"] == ids["a.py"]
    with pytest.raises(LexicalStale):
        index.search(first[1], "needle")
    whole = LexicalIndex(Store(spark, str(tmp_path / "w")), LexicalPolicy(max_file_bytes=60), buckets=4)
    whole.sync(*second)
    for t in ("files", "chunks", "postings"):
        a, b = index.store.table(t), whole.store.table(t)
        assert a.select(*b.columns).exceptAll(b).isEmpty() and b.exceptAll(a.select(*b.columns)).isEmpty()


def test_failed_sync_leaves_the_old_generation(spark, tmp_path):
    index = LexicalIndex(Store(spark, str(tmp_path)), SMALL, buckets=4)
    first = with_names(spark, {"a.txt": "alpha"})
    index.sync(*first)
    with pytest.raises(Exception, match="more than 50 chunks"):
        index.sync(*with_names(spark, {"a.txt": "x\n" * 900}))
    assert [r["path"] for r in index.search(first[1], "alpha")[0].collect()] == ["a.txt"]


def test_store_lock_and_tampering(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    got = []
    with store.lock():

        def other():
            with pytest.raises(StoreBusy), store.lock(0.1):
                pass
            got.append(True)

        t = threading.Thread(target=other)
        t.start()
        t.join()
    assert got
    with pytest.raises(EngineError, match="audit"):
        store.commit(lambda s: ({"t": spark.range(3)}, {}), lambda t: {"rows": t["t"]})
    assert store.generation() == 0
    cut = lexical.chunk_ids(lexical.chunks(spark.createDataFrame([("p", "s", "text")], "path string, file_sha256 string, text string")))
    assert lexical.corrupt_chunks(cut).isEmpty() and not lexical.corrupt_chunks(cut.withColumn("content", F.lit("other"))).isEmpty()


def parsed(source, policy=StructuralPolicy()):
    payload = source if isinstance(source, bytes) else source.encode()
    return structure.parse_file(payload, "m.py", hashlib.sha256(payload).hexdigest(), policy)


def test_structure_of_a_module():
    p = parsed("import os\nfrom a import b as c\nVALUE = 1\nclass C(Base, metaclass=M):\n    X: int = 1\n    @prop\n    def m(self): pass\ndef mix(low: float, high: float = 1.5, /, step=2, *rest: bytes, unit='kg', **more: str) -> list[float]:\n    local = 1\n")
    assert [s["qualified_name"] for s in p["symbols"]] == ["VALUE", "C", "C.X", "C.m", "mix"]
    assert p["symbols"][4]["signature"] == "mix(low: float, high: float = 1.5, /, step = 2, *rest: bytes, unit = 'kg', **more: str) -> list[float]"
    assert p["symbols"][1]["signature"] == "C(Base, metaclass=M)" and p["symbols"][3]["decorators"] == ["prop"]
    assert [(i["module"], i["name"], i["alias"]) for i in p["imports"]] == [("os", "os", None), ("a", "b", "c")]


def test_structure_scopes_and_targets():
    p = parsed("class A:\n    async def m(self):\n        def inner():\n            import z\n        return inner\nif True:\n    T, [U, *V] = 1, [2]\n    o.attr = 3\n    W: int\ntype Vec[T] = list[T]\ndef g(*, k): \n    type Local = int\nfor q in []: pass\n")
    assert [(s["kind"], s["qualified_name"]) for s in p["symbols"]] == [("class", "A"), ("async_method", "A.m"), ("function", "A.m.inner"), ("variable", "T"), ("variable", "U"), ("variable", "W"), ("type_alias", "Vec"), ("function", "g"), ("type_alias", "g.Local")]
    assert p["imports"][0]["scope_qualified_name"] == "A.m.inner"
    q = parsed("import a.b as c\nfrom . import x\nfrom ..pkg import y\n")["imports"]
    assert [(i["module"], i["name"], i["level"]) for i in q] == [("a.b", "a.b", 0), (None, "x", 1), ("pkg", "y", 2)]


def test_structure_failures():
    assert parsed("return 1")["status"] == "parse_error" and parsed(b"\xff\xfe\x00bad")["status"] == "parse_error"
    with pytest.raises(StructuralError):
        parsed("a = 1\nb = 2\n", StructuralPolicy(max_symbols=1))
    with pytest.raises(StructuralError):
        parsed("import a, b\n", StructuralPolicy(max_imports=1))
    with pytest.raises(StructuralError):
        parsed("a = 1\n", StructuralPolicy(max_nodes=2))


def test_short_modules_are_not_counted(monkeypatch):
    densest = ["a\n" * 500, "-a;" * 300, "a.b\n" * 300, "f'{a}'\n" * 200, "lambda:0\n" * 200, "a<b<c\n" * 200, "def f():0\n" * 100, "a:b\n" * 300, "*a,=b\n" * 200, "[*a]\n" * 200, "(a:=b)\n" * 200, "type A[T]=T\n" * 100, "match a:\n case _:0\n" * 100, "~-+a\n" * 200]
    for text in densest:
        assert sum(1 for _ in structure.ast.walk(structure.ast.parse(text))) < structure.NODES_A_CHARACTER * len(text) / 1.5
    walks = []
    monkeypatch.setattr(structure.ast, "walk", lambda tree: walks.append(tree) or iter([]))
    assert parsed("a = 1\n")["status"] == "indexed" and not walks
    assert parsed("a = 1\n", StructuralPolicy(max_nodes=50))["status"] == "indexed" and walks


def test_modules_are_made_in_many_tasks(spark):
    from lodestack.driver_queries import part_sources

    assert part_sources(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_digests_over_many_batches(spark):
    from lodestack.functions.canonical import ordered_digest

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).select(F.when(F.col("id") < 60, "a").when(F.col("id") < 63, "b").alias("g"), "id", F.when(F.col("id") % 10 != 0, F.col("id").cast("string")).alias("line"))
        found = {r["g"]: r["digest"] for r in ordered_digest(df, ["g"], ["id"], F.col("line"), "[", ",", "]").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    groups = {"a": range(60), "b": range(60, 63), None: range(63, 100)}
    assert found == {g: hashlib.sha256(f"[{','.join(str(n) if n % 10 else '' for n in ids)}]".encode()).hexdigest() for g, ids in groups.items()}


def test_structural_sync(spark, tmp_path):
    index = StructuralIndex(Store(spark, str(tmp_path)), StructuralPolicy(max_file_bytes=100), buckets=4)
    first = with_names(spark, {"a.py": "class C:\n    def m(self): pass\n", "bad.py": "return 1", "n.txt": "x", "big.py": "x = 1\n" * 50})
    index.sync(*first)
    status = {r["path"]: r["status"] for r in index.files(first[1]).collect()}
    assert status == {"a.py": "indexed", "bad.py": "parse_error", "n.txt": "unsupported_language", "big.py": "skipped_size"}
    assert [r["qualified_name"] for r in index.symbols(first[1]).collect()] == ["C", "C.m"]
    assert index.symbols(first[1], kind="method", name="m").count() == 1
    with pytest.raises(Exception, match="more than 1 rows"):
        index.symbols(first[1], limit=1).collect()
    with pytest.raises(StructuralQueryError):
        index.symbols(first[1], limit=0)
    second = with_names(spark, {"a.py": "class C:\n    def m(self): pass\n", "bad.py": "import q\n", "n.txt": "x"})
    done = index.sync(*second)
    assert (done.rebuilt, done.removed, done.unchanged) == (1, 1, 2) and index.imports(second[1], module="q").count() == 1
    with pytest.raises(LexicalError.__mro__[1]):
        index.symbols(first[1])


def copied(index, to):
    """The index in a copy of its store."""
    shutil.copytree(index.store.root, to)
    return type(index)(Store(index.store.spark, str(to)), index.policy, index.recheck)


def rewritten(index, table, change):
    """Tamper with a table of the current generation, behind the index' back: every bucket is written again as it is changed."""
    state = index.store.state()
    for b, part in state["parts"].items():
        if table in part["tables"]:
            held = index.store.bucketed(table, state, [int(b)])
            kept, schema = change(held).collect(), held.schema
            index.store.spark.createDataFrame(kept, schema).write.mode("overwrite").parquet(f"{index.store.root}/{table}/gen={part['tables'][table]}/part={b}")


def without(term, in_path=False):
    """Postings of a term are gone."""
    return lambda t: t.withColumn("entries", F.filter("entries", lambda e: (e["term"] != term) | (e["in_path"] != in_path)))


def moved(term):
    return lambda t: t.withColumn("entries", F.transform("entries", lambda e: e.withField("offset", F.when(e["term"] == term, 7).otherwise(e["offset"]))))


def test_lexical_reads_audit_what_they_read(spark, tmp_path):
    first = with_names(spark, {"a.py": "alpha needle", "b.py": "beta needle", "c.py": "gamma"})
    damage = {
        "a posting is gone": ("postings", without("gamma")),
        "a posting moved": ("postings", moved("gamma")),
        "a posting of no chunk": ("postings", lambda t: t.union(t.limit(1).withColumn("chunk_id", F.lit("x")))),
        "a file is gone": ("files", lambda t: t.where("path <> 'c.py'")),
        "a file twice": ("files", lambda t: t.union(t.where("path = 'c.py'"))),
        "a chunk is gone": ("chunks", lambda t: t.where("path <> 'c.py'")),
        "a count is wrong": ("files", lambda t: t.withColumn("lossy", F.lit(True))),
        "a chunk's text is another": ("chunks", lambda t: t.withColumn("content", F.concat("content", F.lit("!")))),
    }
    index = LexicalIndex(Store(spark, str(tmp_path / "s")), recheck=True, buckets=4)
    done = index.sync(*first)
    assert done.counts["indexed"] == 3 and done.counts["chunks"] == done.counts["chunk_rows"] == 3
    assert index.search(first[1], "needle", snapshot=first[0])[0].count() == 2
    for n, (what, (table, change)) in enumerate(damage.items()):
        other = copied(index, tmp_path / str(n))
        rewritten(other, table, change)
        with pytest.raises(LexicalError):
            other.search(first[1], "needle")
            pytest.fail(what)
        if table == "postings":  # what has nothing to do is audited too
            with pytest.raises(LexicalError):
                other.sync(*first)
    other = with_names(spark, {"a.py": "alpha needle"})
    with pytest.raises(LexicalError, match="fingerprint"):
        index.search(first[1], "needle", snapshot=other[0])
    cut, posted = index.store.table("chunks"), index.each_posting(index.store.table("postings"), "chunk_id")
    assert lexical.retokenised(posted, cut).isEmpty()
    assert lexical.retokenised(posted, cut.withColumn("content", F.lit("alpha"))).count() > 0


def test_structural_reads_audit_what_they_read(spark, tmp_path):
    first = with_names(spark, {"a.py": "import q\nclass C:\n    def m(self):\n        import r\n", "b.py": "x = 1\n", "n.txt": "x"})
    damage = {
        "a signature is another": ("symbols", lambda t: t.withColumn("signature", F.lit("other"))),
        "a symbol is gone": ("symbols", lambda t: t.where("name <> 'x'")),
        "an import is another": ("imports", lambda t: t.withColumn("alias", F.lit("z"))),
        "an import of another file": ("imports", lambda t: t.withColumn("file_sha256", F.lit("0"))),
        "a status is another": ("files", lambda t: t.withColumn("error_message", F.lit("!"))),
        "a file is gone": ("files", lambda t: t.where("path <> 'n.txt'")),
    }
    index = StructuralIndex(Store(spark, str(tmp_path / "s")), recheck=True, buckets=4)
    done = index.sync(*first)
    assert done.counts == {"file_count": 3, "symbol_count": 3, "import_count": 2}
    assert index.symbols(first[1], snapshot=first[0]).count() == 3 and index.imports(first[1]).count() == 2
    reads = (lambda i: i.symbols(first[1]), lambda i: i.files(first[1]), lambda i: i.imports(first[1]), lambda i: i.sync(*first))
    for n, (what, (table, change)) in enumerate(damage.items()):
        other = copied(index, tmp_path / str(n))
        rewritten(other, table, change)
        with pytest.raises(StructuralError):
            reads[n % len(reads)](other)
            pytest.fail(what)


def test_an_index_that_rechecks_not_audits_a_generation_once(spark, tmp_path):
    first = with_names(spark, {"a.py": "alpha"})
    index = LexicalIndex(Store(spark, str(tmp_path)), recheck=False, buckets=4)
    index.sync(*first)
    index.search(first[1], "alpha")
    rewritten(index, "postings", without("py", in_path=True))
    assert index.search(first[1], "alpha")[0].count() == 1
    with pytest.raises(LexicalError):
        LexicalIndex(index.store, recheck=True).search(first[1], "alpha")


def rows_scanned(df):
    """Rows that the plan's file scans gave, once it has run."""
    df.collect()
    plans, total = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        p = plans.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            plans.append(p.finalPhysicalPlan())
        elif "QueryStage" in p.nodeName():
            plans.append(p.plan())
        else:
            if p.nodeName().startswith("Scan parquet"):
                total += p.metrics().apply("numOutputRows").value()
            children = p.children()
            plans += [children.apply(k) for k in range(children.size())]
    return total


def test_reads_hash_what_they_meet(spark, tmp_path):
    """Damage in a slot or bucket that a read does not meet is left to verify(); what it meets is told."""
    first = with_names(spark, {"a.py": "alpha needle", "b.py": "beta needle", "c.py": "gamma"})
    index = LexicalIndex(Store(spark, str(tmp_path / "s")), buckets=8, slots=64)
    index.sync(*first)
    index.verify(snapshot=first[0])
    for n, (change, met) in enumerate(((without("gamma"), "gamma"), (moved("alpha"), "alpha"), (lambda t: t.where("false"), "beta"))):
        other = copied(index, tmp_path / str(n))
        rewritten(other, "postings", change)
        with pytest.raises(LexicalError, match="postings"):
            other.search(first[1], met)
        with pytest.raises(LexicalError, match="not what was stored"):
            other.verify()
        if n < 2:
            assert other.search(first[1], "needle")[0].count() == 2
    other = copied(index, tmp_path / "chunk")
    rewritten(other, "chunks", lambda t: t.where("path <> 'a.py'"))
    assert other.search(first[1], "gamma")[0].count() == 1
    with pytest.raises(LexicalError, match="missing"):
        other.search(first[1], "alpha")
    other = copied(index, tmp_path / "slots")
    rewritten(other, "slots", lambda t: t.where("of <> 'chunks'"))
    with pytest.raises(LexicalError, match="slots"):
        other.search(first[1], "gamma")
    with pytest.raises(EngineError):
        LexicalIndex(index.store, recheck="sometimes")


def test_a_sync_writes_the_buckets_that_changed(spark, tmp_path):
    files = {f"d/f{n}.txt": f"common word{n} text{n % 7}" for n in range(200)}
    index = LexicalIndex(Store(spark, str(tmp_path / "s")), buckets=16, slots=8)
    assert len(index.sync(*with_names(spark, files)).written) == 16
    before = index.store.state()
    second = with_names(spark, files | {"d/f5.txt": "changed needle"})
    done = index.sync(*second)
    assert (done.rebuilt, done.removed, done.unchanged, len(done.written)) == (1, 0, 199, 1)
    after = index.store.state()
    assert [b for b in after["parts"] if after["parts"][b] != before["parts"][b]] == [str(done.written[0])] and after["digest"] != before["digest"]
    assert sorted(p.name for p in (tmp_path / "s" / "postings" / "gen=2").glob("part=*")) == [f"part={done.written[0]}"]
    assert [r["path"] for r in index.search(second[1], "needle")[0].collect()] == ["d/f5.txt"] and index.search(second[1], "word5")[0].count() == 0
    index.verify(snapshot=second[0])
    assert after["counts"]["chunk_rows"] == 200 and index.store.table("postings").count() > 0
    # The buckets that the second generation still names stay when the first one goes.
    assert index.store.expire(1) == [1] and index.search(second[1], "common", 100)[0].count() == 100
    index.verify(snapshot=second[0])
    third = with_names(spark, {k: v for k, v in files.items() if k != "d/f7.txt"})
    done = index.sync(*third)
    assert (done.rebuilt, done.removed, done.unchanged) == (1, 1, 198) and len(done.written) <= 2
    whole = LexicalIndex(Store(spark, str(tmp_path / "w")), buckets=16, slots=8)
    whole.sync(*third)
    assert whole.store.state()["digest"] == index.store.state()["digest"] and whole.store.state()["counts"] == index.store.state()["counts"]


def test_a_search_reads_the_slots_of_its_terms(spark, tmp_path):
    files = {f"f{n}.txt": " ".join(f"w{n}x{k}" for k in range(60)) + (" needle" if n == 3 else "") for n in range(120)}
    index = LexicalIndex(Store(spark, str(tmp_path / "s")), buckets=2, slots=512)
    first = with_names(spark, files)
    index.sync(*first)
    state = index.store.state()
    met = index._met(state, "postings", slots=[hashed(F.lit("needle"), 512)], check=False)
    assert 0 < met.count() < 60 and rows_scanned(met) < index.store.table("postings").count() / 4


def moved_bytes(spark):
    """Bytes that all stages so far shuffled and spilled."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = sc.statusStore().stageList(None, False, False, quantiles, None)
    return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() for s in (stages.apply(k) for k in range(stages.size())))


def test_a_sync_shuffles_texts_and_no_postings(spark, tmp_path):
    files = {f"f{n}.txt": " ".join(hashlib.sha256(f"{n} {k}".encode()).hexdigest()[:5] for k in range(600)) for n in range(300)}
    size = sum(map(len, files.values()))
    first = with_names(spark, files)
    second = with_names(spark, {k: v for k, v in files.items() if k != "f7.txt"} | {f"f{n}.txt": f"needle {n}" for n in range(20)})
    index = LexicalIndex(Store(spark, str(tmp_path / "s")), buckets=4)
    before = moved_bytes(spark)
    index.sync(*first)
    synced = moved_bytes(spark)
    index.sync(*second)
    again = moved_bytes(spark)
    assert index.search(second[1], "needle", 100, second[0])[0].count() == 20
    assert synced - before < 2 * size and again - synced < 3 * size and moved_bytes(spark) - again < size / 2


def test_postings_are_those_of_the_chunks(spark, tmp_path):
    files = {"a b.txt": "b a B \u00e9 a_b 1 \U00010400", "empty.txt": "", "marks.txt": "?! --", "n.txt": "one two one"}
    index = LexicalIndex(Store(spark, str(tmp_path / "s")), buckets=4, slots=3)
    index.sync(*with_names(spark, files))
    stored, chunks = index.store.table("postings"), index.store.table("chunks")
    assert lexical.retokenised(index.each_posting(stored, "chunk_id"), chunks).isEmpty()
    assert stored.where(F.exists("entries", lambda e: hashed(e["term"], 3) != F.col("slot"))).isEmpty()
    assert stored.where(F.col("entries") != F.array_sort("entries")).isEmpty() and stored.groupBy("chunk_id", "slot").count().where("count > 1").isEmpty()
    assert max(sum(1 for _ in p.glob("*.parquet")) for p in (tmp_path / "s" / "chunks" / "gen=1").glob("part=*")) == 1


def test_control_characters_are_counted(spark):
    df = spark.createDataFrame([(bytearray(b"a" * 94 + b"\x01\x7f\x0b\x1b\x02\x03"),), (bytearray(b"a" * 95 + b"\x01\x7f\x0b\x1b\x02"),), (bytearray("\n\t\x85".encode("latin-1")),)], "b binary")
    assert [r[0] for r in df.select(classify_content(F.octet_length("b"), F.col("b"))).collect()] == ["binary", "text", "text"]


def test_lookups_read_a_name_or_a_path(spark, tmp_path):
    first = with_names(spark, {"a.py": "import q\nclass C:\n    pass\n", "b.py": "class D:\n    pass\n", "c.py": "x = 1\n"})
    index = StructuralIndex(Store(spark, str(tmp_path / "s")), buckets=16, slots=64)
    index.sync(*first)
    assert [r["path"] for r in index.symbols(first[1], name="C").collect()] == ["a.py"] and index.symbols(first[1], path="b.py").count() == 1
    assert index.symbols(first[1], name="absent").count() == 0
    rewritten(index, "symbols", lambda t: t.withColumn("signature", F.when(F.col("name") != "D", F.col("signature")).otherwise("other")))
    assert index.symbols(first[1], name="C").count() == 1 and index.symbols(first[1], path="c.py").count() == 1
    for equal in ({"name": "D"}, {"path": "b.py"}, {"kind": "class"}):
        with pytest.raises(StructuralError):
            index.symbols(first[1], **equal)
    with pytest.raises(StructuralError):
        index.verify()


def test_guards_read_their_input_once(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 3)
    got = lexical.within(df.where("v = 1"), 40, "too many", ["id"])
    assert [r["id"] for r in got.collect()] == list(range(1, 100, 3))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    with pytest.raises(Exception, match="too many"):
        lexical.within(df.where("v = 1"), 32, "too many", ["id"]).collect()
    assert lexical.within(df, 1 << 30, "too many", [F.desc("id")]).first()["id"] == 99


def test_store_upkeep(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for n in range(4):
        store.commit(lambda s, n=n: ({"t": spark.range(n)}, {}), seal=lambda t: {"rows": t["t"].count()})
    assert store.state()["rows"] == 3 and store.expire(2) == [1, 2] and store.table("t", 3).count() == 2
    with pytest.raises(Exception):
        store.table("t", 1).count()
    store._create("LOCK", '{"host": "gone", "process": 1, "since": 0, "token": "t"}')
    with pytest.raises(StoreBusy, match="gone"), store.lock(0.1):
        pass
    assert not store.break_lock("other") and store.break_lock(store.lock_holder()["token"]) and store.lock_holder() is None
    store.clear()
    assert store.generation() == 0
    with pytest.raises(EngineError):
        store.table("t")


def test_actions_and_reports(spark):
    plan = spark.createDataFrame([("a", "rebuilt"), ("b", "removed"), ("c", "unchanged"), ("c", "removed"), ("d", "rebuilt")], "path string, action string")
    reports = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    assert {r["path"] for r in lexical.overlapping_actions(plan, reports).collect()} == {"b", "c", "d"}
    files = spark.createDataFrame([("a", "indexed", False), ("b", "indexed", True)], "path string, status string, lossy boolean")
    assert lexical.coverage_complete(files.where("path = 'a'")) and not lexical.coverage_complete(files)


def test_term_counts_agree(spark):
    df = rows(spark, ("a/x.txt", "the quick the brown"), ("b/the.txt", "quick red"), ("c", ""), ("d", None)).withColumn("chunk_id", F.col("path"))
    key = lambda t: sorted(map(tuple, t.select("term", "documents", "occurrences").collect()))
    assert key(lexical.text_term_counts(df)) == key(lexical.term_counts(lexical.postings(df)))


def test_table_functions_give_the_rows_of_parse(spark):
    from lodestack.operators import structure

    sources = spark.createDataFrame([(f"m{n}.py", bytearray(f"import a{n} as b\nclass C{n}:\n    @d\n    def m(self): pass\n".encode()), str(n)) for n in range(5)] + [("bad.py", bytearray(b"return 1"), "x"), ("none.py", None, "y")], "path string, content binary, file_sha256 string")
    structure.register(spark)
    sources.createOrReplaceTempView("modules_of_test")
    parsed = structure.parse(sources)
    for section, rows in (("symbols", structure.symbols(parsed)), ("imports", structure.imports(parsed))):
        got = spark.sql(f"SELECT f.* FROM modules_of_test m, LATERAL parse_{section}(m.path, m.content, m.file_sha256) f")
        assert got.columns == rows.columns and sorted(map(repr, got.collect())) == sorted(map(repr, rows.collect()))


def test_outcomes_as_errors():
    from lodestack import schemas

    assert schemas.demanded("accepted") == "accepted" and schemas.demanded("existing") == "existing"
    for outcome, error in (("exceeded", schemas.BudgetExceeded), ("replay", schemas.CallReplayBlocked), ("uncertain", schemas.CallUncertain), ("invariant", schemas.BudgetInvariant), ("unavailable", schemas.RuntimeUnavailable)):
        with pytest.raises(error):
            schemas.demanded(outcome)
    assert issubclass(schemas.BudgetLocked, schemas.BudgetError)

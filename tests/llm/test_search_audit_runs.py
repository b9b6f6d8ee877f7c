"""Top-k search, the filter audit and runs of repeated words against brute force, and odd inputs."""

import hashlib
import math
import random
import re
import time
import zlib
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import filter_audit, max_score, queries, runs

# -- top-k search ----------------------------------------------------------------------------------------------------


def brute_top(rows, k, scale=64):
    """Rows of (query id, rank, id, score) over (id, vector) rows."""
    known = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (qid, q) in enumerate(known):
        if qid is None or qid % 20:
            continue
        found = [(-sum(a * b for a, b in zip(q, v)), i is None, i or 0) for m, (i, v) in enumerate(known) if m != n]
        out += [(qid, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def search(spark, rows, k=20, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("row", "unit", "query", "rank", "score", "v")})
    return sorted(map(tuple, max_score.search(df, F.pmod("vec_id", F.lit(20)) == 0, k, **options).select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def test_search_equals_brute_force(spark):
    rng = random.Random(5)
    for n, width, spread in ((400, 8, 0.3), (300, 3, 0.02), (7, 5, 1.0)):
        rows = [(i, [rng.gauss(0, spread) for _ in range(width)]) for i in range(n)]
        assert search(spark, rows, 5) == brute_top(rows, 5)
        assert search(spark, rows, 20) == brute_top(rows, 20)


def test_search_ties_copies_and_odd_rows(spark):
    rng = random.Random(6)
    same = [0.5, -0.25, 0.125]
    rows = [(i, list(same)) for i in range(90)] + [(100 + i, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(3)]) for i in range(60)]
    rows += [(20, [0.1, 0.2, 0.3]), (20, [0.1, 0.2, 0.3]), (None, same), (200, None), (220, [0.1, None, 0.2]), (240, [math.nan, 0.0, 1.0]), (260, [math.inf, 0.0, 0.0]), (280, []), (300, [0.5]), (320, [0.1] * 9)]
    rng.shuffle(rows)
    assert search(spark, rows, 20) == brute_top(rows, 20)
    assert search(spark, rows, 1) == brute_top(rows, 1)
    assert search(spark, rows[:0]) == [] and search(spark, [(20, same)]) == []


def test_search_of_large_components_is_exact(spark):
    rows = [(20, [3e7, 1e-2]), (1, [3e7, 1.0]), (2, [3e7 + 1, -1.0]), (40, [1e14, 3.0]), (3, [-1e14, 2.0]), (60, [1e300, 0.0])]
    clamp = lambda x: max(-(2**63), min(2**63 - 1, x))
    whole = [(i, [clamp(math.floor(64 * x)) for x in v]) for i, v in rows]
    expected = []
    for i, q in whole:
        if i % 20 == 0:
            scored = sorted((-max(-(2**63) + 1, clamp(sum(a * b for a, b in zip(q, v)))), j) for j, v in whole if j != i)
            expected += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    assert search(spark, rows) == sorted(expected, key=repr)


def test_traversal_skips_and_probes_without_loss():
    """Small blocks, so that whole blocks are skipped and terms are left to probes."""
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 12, (12, 24))
    values = np.floor(centres[rng.integers(0, 12, 3000)] + rng.normal(0, 2, (3000, 24))).astype(np.int64)
    held, seen = max_score.BLOCK, []
    plain = max_score.traverse
    try:
        max_score.BLOCK = 64

        def counted(q, v, *rest):
            seen.append(len(q) * len(v))
            return plain(q, v, *rest)

        max_score.traverse = counted
        shard = max_score.Shard(values, np.arange(3000), np.zeros(3000, bool), np.arange(3000), 10)
        who, score, place = shard.best(values[:100])
    finally:
        max_score.BLOCK, max_score.traverse = held, plain
    truth = values[:100] @ values.T
    for q in range(100):
        want = sorted((-s, i) for i, s in enumerate(truth[q]))[:11]
        assert [(-s, shard.ids[p]) for s, p in zip(score[who == q], place[who == q])] == want
    assert sum(seen) < 0.5 * truth.size


def test_dealing_bounds_a_shard():
    for rows in (0, 1, 500, 51_282, 10**7, 10**9):
        shards, groups = max_score.dealing(rows, 200)
        assert shards >= 1 and groups >= 1 and rows <= shards * max_score.SHARD


# -- filter audit ------------------------------------------------------------------------------------------------------


def brute_audit(docs, labels):
    """Every order, document by document. docs: (id, text, part)."""
    good = {i for i, q, t in labels if q == 1}
    toxic = {i for i, q, t in labels if t == 1}
    facts = []
    for i, text, part in docs:
        text = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": copy}
        facts.append((part or "", {f for f, x in fails.items() if x}, i is not None and i in good, i is not None and i in toxic))
    out, shares = {}, {}
    for part in {f[0] for f in facts}:
        for order in permutations("ABCDE"):
            left = [f for f in facts if f[0] == part]
            every = left
            for step, name in enumerate(order, 1):
                hit = [f for f in left if name in f[1]]
                left = [f for f in left if name not in f[1]]
                fail = [f for f in every if name in f[1]]
                out[part, "".join(order), step] = (len(left), len(hit), len(fail) - len(hit), sum(f[1] == {name} for f in fail), sum(f[2] for f in hit), sum(f[3] for f in hit))
                shares[part, name] = shares.get((part, name), 0) + len(hit)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("part", "digest", "a", "e", "n", "id", "subset", "salt")})
    out = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1)))
    rows = out.collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_equals_brute_force(spark):
    rng = random.Random(8)
    bodies = [None, "", " \t\n", "word " * 250, " ".join(f"w{i}" for i in range(230)), " ".join(f"W{i}\x0b" for i in range(230)), "a # b " * 120, "É漢😀 ABC | x", " ".join(f"v{i}" for i in range(300)) + " & Z", "x" * 5000]
    docs = [(i if rng.random() < 0.9 else None, rng.choice(bodies), rng.choice([None, "", "en", "de"])) for i in range(120)]
    docs += docs[:15] + [(500, bodies[4], "fr"), (500, bodies[4], "fr"), (501, bodies[4], "fr"), (499, "other", "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (10**6, 1, 1)]
    assert audited(spark, docs, labels) == brute_audit(docs, labels)


def test_audit_of_empty_tables(spark):
    assert audited(spark, [], []) == {}
    assert audited(spark, [(1, "one", "en")], []) == brute_audit([(1, "one", "en")], [])


def test_audit_reads_texts_once_and_shuffles_none(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i % 7} " * 50, "en") for i in range(100)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/d")
    counted = filter_audit.flagged(spark.read.parquet(f"{tmp_path}/d"), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    exchanges = re.findall(r"Exchange hashpartitioning\(([^\n]*)", plan)
    assert exchanges and not any("text" in e for e in exchanges)


# -- runs ----------------------------------------------------------------------------------------------------------------


def brute_runs(ws, length, exponent):
    """(start, length, period) by comparing the words with those a period before, for every period."""
    found = {}
    for q in range(1, len(ws) // exponent + 1):
        i = 0
        while i + q < len(ws):
            a = i
            while i + q < len(ws) and ws[i] == ws[i + q]:
                i += 1
            if i > a and i + q - a >= max(length, exponent * q):
                found.setdefault((a, i + q), q)
            i += 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words_equal_brute_force():
    rng = random.Random(3)
    for _ in range(600):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            ws = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randrange(60))]
            if rng.random() < 0.5 and len(ws) > 4:
                a, p = rng.randrange(len(ws)), rng.randrange(1, len(ws) // 3 + 1)
                ws = [ws[a + (i - a) % p] if i >= a else w for i, w in enumerate(ws)]
            docs.append(ws)
        words, owner = np.array([w for d in docs for w in d], np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        for length, exponent in ((6, 4), (1, 2), (6, 3)):
            want, base = [], 0
            for d in docs:
                want += [(a + base, a + base + n, q) for a, n, q in brute_runs(d, length, exponent)]
                base += len(d)
            assert runs.maximal_runs(words, owner, length, exponent) == want


def test_runs_of_hard_sequences_end():
    began = time.time()
    fib, last = [0, 1], [0]
    while len(fib) < 30_000:
        fib, last = fib + last, fib
    for ws in ([0] * 100_000, fib, [i % 100 for i in range(50_000)], list(range(50_000))):
        runs.maximal_runs(np.array(ws), np.zeros(len(ws), np.int64), 6, 4)
    assert runs.maximal_runs(np.array([0] * 100_000), np.zeros(100_000, np.int64), 6, 4) == [(0, 100_000, 1)]
    assert time.time() - began < 60


def expected_row(doc_id, text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(ws)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            ws = [ws[a + (i - a) % p] if i >= a else ws[i] for i in range(n)]
    found = brute_runs(ws, 6, 4)
    gone = {i for a, m, q in found for i in range(a + q, a + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{a},{m},{q}\n" for a, m, q in found)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))


def test_runs_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    texts = [None, "", " \n\t", "É漢😀 ß " * 7, "a\x0ba\x0ca\ra\na\ta b", "one two " * 3 + "one", "x " * 3000, "a b a b a b a b c c c c c c " * 5, "w\x1cw w w w w w", "\x85 \x85 \x85 \x85 \x85 \x85"]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(200))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(7, texts[7]), (None, texts[5]), (None, texts[6])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("runs", "Collapsed", "w", "n", "a", "p", "g")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op13_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((expected_row(i, t) for i, t in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 10
    whole = runs.find_runs(df).where("doc_id = 7").collect()
    assert len(whole) == 2 and whole[0] == whole[1] and whole[0]["n"] == "x" and whole[0]["collapsed"] == "a b c"
    assert runs.find_runs(df.where("false")).count() == 0


def test_long_documents_are_batches_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(runs, "WORDS", 50)
    import pyarrow as pa

    texts = ["a b " * 20, "c " * 300, None, "d e f", "g h " * 100]
    found = []
    for text in texts:
        batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
        out = runs._searched(batch, [(text or "").encode().split()], 6, 4)
        found.append(out.column(1).to_pylist()[0])
    assert [[(r["start"], r["length"], r["period"]) for r in f] for f in found] == [brute_runs((t or "").split(), 6, 4) for t in texts]


def test_limits_of_find_runs(spark):
    with pytest.raises(ValueError):
        runs.find_runs(spark.createDataFrame([("a",)], "text string"), exponent=1)

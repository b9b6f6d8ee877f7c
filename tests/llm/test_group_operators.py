"""Fingerprints, near-duplicates and shards against brute force, and odd inputs."""

import hashlib
import random
from collections import Counter
from math import comb

import numpy as np
from brute import brute_fingerprint, brute_roots
from pyspark.sql import functions as F

from lodestack.llm import fingerprints, shards, simhash

ODD_TEXTS = [None, "", " \n\t", "É漢😀 ß x", "one", "two words", "same text here", "same text here", "w " * 3000]


def frame(spark, texts):
    rows = list(enumerate(texts)) + [(2, texts[2]), (None, "no id"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("fp", "component_id", "shard", "slot", "part", "rank", "kind", "row", "edited", "id"):
        df = df.withColumn(name, F.lit("x"))
    return df, rows


# -- consistent weighted sampling -----------------------------------------------------------------------------------


def test_edits_and_native_plan(spark):
    df, rows = frame(spark, ODD_TEXTS)
    out = fingerprints.fingerprint_edits(df, samples=8)
    got = out.collect()
    assert len(got) == len(rows)
    texts = [t or "" for t in ODD_TEXTS]
    for r in got:
        if r["doc_id"] is None:
            assert r["near_next"] is None and r["near_edited"] == 1.0
            continue
        t, nxt = texts[r["doc_id"]], texts[(r["doc_id"] + 1) % len(texts)]
        n = len(t) // 4
        edited = t[: len(t) - n] + nxt[:n]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[6]["fingerprint"] == by_id[7]["fingerprint"] and by_id[6]["near_next"] == 1.0
    assert by_id[0]["fingerprint"] == by_id[1]["fingerprint"] != by_id[4]["fingerprint"]
    plan = out._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
    assert fingerprints.fingerprint_edits(df.where("false"), samples=8).count() == 0


def test_law_holds_for_texts_of_many_words():
    """Draws as the operator's tables make them, 50,000 words that weigh 1 in one text and 1 or 3 in the other: similarity 0.5."""
    of_r, of_c = map(np.array, fingerprints.quantile_tables())
    levels, rng, n, tries, equal = fingerprints.LEVELS, np.random.default_rng(11), 50_000, 1200, 0
    assert len(of_r) == len(of_c) == 2 * levels and (np.diff(of_r[:levels]) > 0).all() and of_r[levels:].min() > of_r[levels - 2] and of_c[levels:].max() < of_c[1]
    weights = (np.ones(n), np.where(np.arange(n) % 2, 3, 1))
    for _ in range(tries):
        at_r, at_c, b = rng.integers(0, levels, n), rng.integers(0, levels, n), rng.random(n)
        r = of_r[np.where(at_r == levels - 1, levels + rng.integers(0, levels, n), at_r)]
        log_c = of_c[np.where(at_c == 0, levels + rng.integers(0, levels, n), at_c)]
        met = []
        for w in weights:
            t = np.floor(np.log(w) / r + b)
            k = (log_c - r * (t - b + 1)).argmin()
            met.append((k, t[k]))
        equal += met[0] == met[1]
    assert abs(equal / tries - 0.5) < 3 * (0.25 / tries) ** 0.5


def test_collision_rate_is_the_generalised_jaccard_similarity(spark):
    rng = random.Random(1)
    pairs = []
    for k in range(60):
        a = Counter({f"w{rng.randrange(30)}": rng.randrange(1, 6) for _ in range(20)})
        b = Counter({w: max(0, c + rng.choice([-1, 0, 0, 1, 3])) for w, c in a.items() if rng.random() < 0.5 + k / 120})
        pairs.append((a, b))
    rows = [(2 * k + s, 0, " ".join(w for w, c in x.items() for _ in range(c))) for k, p in enumerate(pairs) for s, x in enumerate(p)]
    sig = {r["id"]: r["signature"] for r in fingerprints.signatures(spark.createDataFrame(rows, "id long, kind int, t string"), ["id", "kind"], "t", 64).collect()}
    truth, seen = [], []
    for k, (a, b) in enumerate(pairs):
        if +b:
            truth.append(sum((a & b).values()) / sum((a | b).values()))
            seen.append(float(np.mean(np.array(sig[2 * k]) == np.array(sig[2 * k + 1]))))
    error = np.array(seen) - np.array(truth)
    assert abs(error.mean()) < 0.02 and error.std() < 0.08


def test_next_ids(spark):
    ids = random.Random(2).sample(range(-1000, 1000), 137)
    df = spark.createDataFrame([(i, i % 7) for i in ids] + [(None, 3), (ids[0], 100)], "id long, size int")
    got = {r["id"]: r for r in fingerprints.next_ids(df, "id", "size").collect()}
    order = sorted(ids)
    sizes = {i: i % 7 for i in ids} | {ids[0]: 100}
    for k, i in enumerate(order):
        assert got[i]["next_id"] == order[(k + 1) % len(order)] and got[i]["previous_id"] == order[k - 1] and got[i]["previous_size"] == sizes[order[k - 1]]
    assert len(got) == len(ids)


# -- SimHash ----------------------------------------------------------------------------------------------------------


def test_fingerprints_and_components(spark):
    df, rows = frame(spark, ODD_TEXTS)
    for r in simhash.near_duplicates(df).collect():
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{brute_fingerprint(ODD_TEXTS[r['doc_id']]):016x}"
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[7] == 6 and got[None] is None
    assert simhash.near_duplicates(df.where("false")).count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_find_every_pair_within_three_bits(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in list(fps):
        for n in (1, 2, 3, 3, 4, 5):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), n)))
    chain = rng.getrandbits(64)
    for _ in range(20):  # a long chain of links
        chain ^= sum(1 << b for b in rng.sample(range(64), 3))
        fps.append(chain)
    centre = rng.getrandbits(64)  # a dense group
    fps += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(200)]
    fps = sorted(set(fps))
    roots = brute_roots(fps)
    edges = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"))
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    mine = [got.get(signed(f), signed(f)) for f in fps]
    assert len(set(zip(mine, roots, strict=True))) == len(set(mine)) == len(set(roots))


def test_golay_decoding():
    near, wide = simhash.golay()
    d = simhash.Decoder.get()
    x = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    one, six = d.indices(x)
    code = x ^ near[d.syndrome(x)]
    assert (d.syndrome(code) == 0).all() and (np.bitwise_count(x ^ code) <= 3).all()
    for bit in range(23):
        _, other = d.indices(x ^ (1 << bit))
        assert (other == one[:, None]).any(axis=1).all()
    assert len(six[0]) == 6


def test_components_of_stars_and_paths(spark):
    rng = random.Random(4)
    edges = [(min(a, b), max(a, b)) for a, b in [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] if a != b]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {n: n for e in edges for n in e}
    for _ in range(len(parent)):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


def test_keep_first(spark):
    df, rows = frame(spark, ODD_TEXTS)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, -1, 0, 3, 4, 5, 6, 8]


# -- shards -----------------------------------------------------------------------------------------------------------


def test_matrix_sums():
    counts = [0, 5, 1, 100, 17, 0, 3]
    m = shards.draw_matrix(counts, 8, 1)
    assert (m.sum(axis=1) == counts).all() and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1 and (m >= 0).all()
    big = shards.draw_matrix([3 * 10**9, 5, 10**9], 4, 2)
    assert (big.sum(axis=1) == [3 * 10**9, 5, 10**9]).all() and big.sum(axis=0).max() - big.sum(axis=0).min() <= 1 and (big >= 0).all()


def test_shards_are_exact_and_gapless(spark):
    df, rows = frame(spark, [*ODD_TEXTS, *(f"text {k % 40}" for k in range(300))])
    out = shards.deal(df, 8).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(rows)
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 8
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    assert shards.deal(df.where("false"), 8).count() == 0 and shards.deal(df.limit(3), 8).count() == 3


def test_a_shuffle_is_about_uniform(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"))
    cells = Counter()
    for seed in range(6):
        for r in shards.deal(df, 4, seed=seed).collect():
            cells[r["doc_id"] // 100, r["shard"]] += 1
    assert all(abs(n - 150) < 45 for n in cells.values())


def test_draws_follow_the_hypergeometric_law():
    rng = np.random.default_rng(5)
    for good, bad, drawn in ((30, 20, 17), (3, 40, 10), (5, 5, 9)):
        n = 20_000
        seen = np.bincount([shards.hypergeometric(rng, good, bad, drawn) for _ in range(n)], minlength=drawn + 1)
        law = np.array([comb(good, k) * comb(bad, drawn - k) / comb(good + bad, drawn) if drawn - k <= bad else 0.0 for k in range(drawn + 1)])
        assert (seen[law == 0] == 0).all()
        met = law * n > 5
        assert ((seen - law * n)[met] ** 2 / (law * n)[met]).sum() < 3 * met.sum() + 10
    # Beyond the range of numpy's generator: mean and deviation of the exact law.
    good, bad, drawn = 3 * 10**9, 9 * 10**9, 10**8
    x = np.array([shards.hypergeometric(rng, good, bad, drawn) for _ in range(200)], float)
    sd = (drawn * 0.25 * 0.75 * (1 - drawn / (good + bad))) ** 0.5
    assert abs(x.mean() - drawn / 4) < 5 * sd / 200**0.5 and 0.75 < x.std() / sd < 1.3
    assert shards.hypergeometric(rng, 0, 10, 5) == 0 and shards.hypergeometric(rng, 10, 0, 5) == 5 and shards.hypergeometric(rng, 3, 3, 6) == 3


def test_a_matrix_entry_follows_its_law():
    counts, first = [6, 9, 5], Counter(int(shards.draw_matrix([6, 9, 5], 4, seed)[0, 0]) for seed in range(4000))
    law = {k: comb(5, k) * comb(15, 6 - k) / comb(20, 6) for k in range(6)}
    assert sum(counts) == 20 and all(abs(first[k] - 4000 * p) < 5 * (4000 * p) ** 0.5 + 5 for k, p in law.items())


def test_equal_rows_are_shuffled_like_others(spark):
    rows = [(1, "same")] * 80 + [(k, f"t{k}") for k in range(2000)]
    out = shards.deal(spark.createDataFrame(rows, "doc_id long, text string"), 8, seed=3).where("text = 'same'").collect()
    per_shard = Counter(r["shard"] for r in out)
    assert len(out) == 80 and len(per_shard) == 8 and max(per_shard.values()) <= 24
    places = sorted((r["shard"], r["slot"]) for r in out)
    assert sum((b[0], b[1] - 1) == a for a, b in zip(places, places[1:], strict=False)) < 15, "equal rows stand apart"


def test_a_value_in_nine_of_ten_rows_is_split(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("doc_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so small a table ends in one task
    try:
        sizes = [len(p) for p in shards.deal(df, 8).rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 0.6 * sum(sizes) and Counter(r["shard"] for r in shards.deal(df, 8).collect()) == {k: 500 for k in range(8)}


def test_long_runs_of_a_key_lose_no_link(spark):
    rng = random.Random(13)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(24, 64), rng.randrange(9))) for _ in range(300)}  # one segment is the same in all
    fps |= {f ^ sum(1 << b for b in rng.sample(range(64), 3)) for f in list(fps)[:60]}
    fps = sorted(fps)
    roots = brute_roots(fps)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for most in (40, 5):
        got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, long_run=most)).collect()}
        mine = [got.get(signed(f), signed(f)) for f in fps]
        assert len(set(zip(mine, roots, strict=True))) == len(set(mine)) == len(set(roots))


def test_very_long_texts_and_ties(spark):
    long = " ".join(f"w{k % 5000}" for k in range(60_000))
    df = spark.createDataFrame([(1, long), (2, long + " x"), (3, "a b"), (3, "a b"), (3, "b a")], "doc_id long, Text string")
    by_id = {r["doc_id"]: r for r in simhash.near_duplicates(df, text_col="text").collect()}
    assert by_id[1]["fingerprint"] == f"{brute_fingerprint(long):016x}" and by_id[2]["component_id"] == 1
    assert sorted(r["doc_id"] for r in simhash.keep_first(df, text_col="text").collect()) == [1, 3]
    prints = fingerprints.fingerprint_edits(df, text_col="text", samples=4).where("doc_id = 1").first()
    assert prints["n_chars"] == len(long) and shards.deal(df, 2).count() == 5

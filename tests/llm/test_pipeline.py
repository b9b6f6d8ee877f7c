"""The pipeline on a small fixture, stage by stage against brute force."""

import math
import os
import random

import corpus_pipeline
import public_tokenizers
import sentencepiece
from brute import brute_contamination, brute_fingerprint, brute_roots
from pyspark.sql import functions as F

from lodestack.llm import common, quality, simhash, toxicity


def test_pipeline(spark, tmp_path):
    rng = random.Random(7)
    words = [a + b for a in ("ta", "mi", "ro", "len", "sor", "pra") for b in ("ka", "dor", "ment", "is", "ula", "ne")]
    docs, labels = [], []
    for k in range(400):
        toxic, poor = k % 6 == 0, k % 7 == 0
        ws = [rng.choice(words) for _ in range(80)]
        if toxic:
            ws[3] = ws[40] = rng.choice(["vorgat", "snilfer"])
        docs.append((k, " ".join(w + "###" if poor else w for w in ws), "en", f"src{k % 3}", 0))
        labels.append((k, int(not poor), int(toxic)))
    item = " ".join(rng.choice(words) for _ in range(30))
    clean = [k for k in range(400) if k % 6 and k % 7]
    docs += [(1000, docs[clean[5]][1], "en", "src0", 0), (1001, item, "en", "src0", 0), (1002, None, None, None, None), (1003, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r["doc_id"] for r in out.collect()}
    assert 1000 not in kept and 1001 not in kept and 1002 in kept and 1003 not in kept
    assert len(kept & set(clean)) >= 0.97 * len(clean) and len(kept - set(clean) - {1002}) <= 3
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, before.where("false"), str(tmp_path)).columns == before.columns
        assert stage(spark, before.where("false"), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, before.where(F.lit(False)), str(tmp_path)).count() == 0


def test_last_stage_decodes(spark, tmp_path):
    texts = ["two words", "é漢😀  x\n", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path))
    assert {r["doc_id"]: r["decoded"] for r in out.collect()} == {k: t or "" for k, t in enumerate(texts)}


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage's rows, from its own input, by plain Python."""
    rng = random.Random(21)
    words = [a + b for a in ("ta", "mi", "ro", "len", "sor") for b in ("ka", "dor", "ment", "is", "ula", "ne")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(20, 60))) for _ in range(150)]
    texts = [t + " vorgat" if k % 6 == 0 else t for k, t in enumerate(texts)]
    texts += [texts[3] + "  ", texts[3].upper(), texts[7], "", None, " ", " ".join(texts[9].split()[:30]) + " zz"]
    items = [(1, " ".join(texts[11].split()[2:17])), (2, "zz"), (3, None)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(k, int(k % 4 > 0), int("vorgat" in (t or ""))) for k, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())

    fps = [brute_fingerprint(t) for t in texts]
    roots = brute_roots(fps)
    assert ids(stages["simhash_near_dedup"](spark, docs, str(tmp_path))) == sorted({min(k for k, r in enumerate(roots) if r == root) for root in roots})

    stay = []
    for k, t in enumerate(texts):
        n, hit, _ = brute_contamination(t, items)
        if not (hit and 20 * hit >= n):
            stay.append(k)
    assert ids(stages["benchmark_decontamination"](spark, docs, str(tmp_path))) == stay and 11 not in stay

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in stages["sentencepiece"](spark, docs, str(tmp_path)).collect():
        assert r["token_ids"] == lib.encode(texts[r["doc_id"]] or "") and r["decoded"] == (texts[r["doc_id"]] or "")

    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    clean = [k for k, t in enumerate(texts) if model.score(sum(model.token_weight(w) for w in set((t or "").lower().split()))) < 0.5]
    assert ids(stages["toxicity"](spark, docs, str(tmp_path))) == clean == [k for k, t in enumerate(texts) if "vorgat" not in (t or "")]

    good = quality.fit_quality(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    margins = {k: good.margin(*good.weight((t or "").encode())) for k, t in enumerate(texts)}
    kept = ids(stages["quality_classifier"](spark, docs, str(tmp_path)))
    assert len(kept) == sum(m >= 0 for m in margins.values())
    noise = {r["doc_id"]: -math.log(-math.log(r["u"])) for r in docs.select("doc_id", ((F.shiftrightunsigned(F.xxhash64(F.lit(0), F.col("text")), 11).cast("double") + 0.5) / float(1 << 53)).alias("u")).collect()}
    order = sorted((-(margins[k] + noise[k]), k) for k in margins)
    border = order[len(kept) - 1][0]
    assert {k for x, k in order if x < border - 1e-6} <= set(kept) <= {k for x, k in order if x <= border + 1e-6}


def test_stages_stand_clashing_names_and_leave_no_tables(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, None), (2, "")], "doc_id long, text string")
    for name in ("margin", "gumbel_key", "selected", "row", "id", "kept_id", "copy_number", "fp", "score", "n_words"):
        docs = docs.withColumn(name, F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert [c for c in out.columns] == docs.columns and out.where("margin = 'x' AND selected = 'x'").count() == out.count() > 0
    shared = common.shared_dir(spark)
    before = set(os.listdir(shared))
    kept = common.written_once(lambda: simhash.keep_first(docs))
    assert len(set(os.listdir(shared)) - before) == 1 and kept.count() == 3
    common.drop_table(kept)
    assert set(os.listdir(shared)) == before

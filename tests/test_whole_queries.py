"""Queries over all rows of a small fixture, against brute force."""

import hashlib
import json
import re

import pytest

from pyspark.sql import functions as F

from lodestack import driver_queries
from lodestack.operators import lexical


def test_json_escapes_of_all_texts(spark, tmp_path):
    texts = ["plain", 'q"\\', "line\nbreak\r\t", "\x00\x01\x1f\x7f\x85", "é漢😀 Ω", " ﻿", "", None]
    spark.createDataFrame([(k, 0, "user", t) for k, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: (r["chars"], r["reads_back"]) for r in driver_queries.queries()["q71_json_escapes_whole"](spark, str(tmp_path)).collect()}
    assert got == {k: (None, None) if t is None else (len(t), True) for k, t in enumerate(texts)}


def test_postings_digest_of_all_terms(spark, tmp_path):
    texts = ["plain words", "Straße œuvre æon", "λόγος Привет 漢字 x", "𝔘𝔫𝔦 ok", "", None]
    plain = {1: "straße œuvre æon", 2: "λόγοσ привет 漢字 x"}
    spark.createDataFrame([(k, t, "xx", f"s{k % 2}") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = {"s0": [], "s1": []}
    for k, t in enumerate(texts):
        for col, text in (("content", plain.get(k, t) or ""), ("path", f"s{k % 2}/xx/{k}.txt")):
            lines[f"s{k % 2}"] += [(str(k), col, n, w) for n, w in enumerate(re.findall(r"[^\W_]+", text))]
    expected = {s: hashlib.sha256("".join(json.dumps(x, separators=(",", ":")) + "\n" for x in sorted(found)).encode()).hexdigest() for s, found in lines.items()}
    got = {r["source"]: r["digest"] for r in driver_queries.queries()["q23_postings_digest_whole"](spark, str(tmp_path)).collect()}
    assert got == expected


def test_guard_keeps_rows_in_their_tasks(spark):
    df = spark.range(0, 1000, 1, 8)
    kept = lexical.within(df, 1000, "too many")
    assert kept.rdd.getNumPartitions() == 8 and kept.count() == 1000
    assert sum(1 for n in kept.rdd.glom().map(len).collect() if n) == 8
    assert lexical.within(df.where("id < 0"), 0, "too many").count() == 0
    with pytest.raises(Exception, match="too many"):
        lexical.within(df, 999, "too many").collect()


def test_chunks_of_long_texts_in_short_batches(spark):
    """A worker's batch is bounded by bytes, and chunks are handed on in pieces that lose and repeat none."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    texts = [(f"p{k}", "".join(f"{k} {n}\n" for n in range(size))) for k, size in enumerate((0, 3, 150_000, 1, 200_000, 0))]
    df = spark.createDataFrame(texts, "path string, text string").coalesce(1)
    policy = lexical.LexicalPolicy(chunk_lines=100, overlap_lines=0, max_chunks=1 << 20)
    got = lexical.chunks(df, policy, ("path",)).collect()
    assert int(spark.conf.get(name)) <= 4 << 20
    want = [(p, n, *span) for p, text in texts for n, span in enumerate(lexical.line_spans(text, policy))]
    assert [tuple(r) for r in got] == want


def test_digests_of_texts_are_those_of_their_postings_without_shuffling_them(spark):
    """Also for keys of several rows, keys that are null and texts without terms; what is dealt to tasks are texts or digests."""
    rows = [("s", "a", "Straße 漢字 ok", "p/1"), ("s", "a", "two one", "p/2"), ("s", None, "x", ""), (None, "b", None, "only"), ("t", "b", "y y", None), ("u", "c", "", None), ("t", "a", "\U0001d518 z", "p")]
    df = spark.createDataFrame(rows, "source string, chunk_id string, content string, path string")
    found = lexical.postings(df.withColumn("k", F.struct("source", "chunk_id")), "k").select("k.*", "col", "offset", "term")
    for ours, plain in ((lexical.text_postings_digest, lexical.postings_digest), (lexical.text_index_digest, lexical.index_digest)):
        assert sorted(map(tuple, ours(df, ["source"]).collect()), key=str) == sorted(map(tuple, plain(found, ["source"]).collect()), key=str)
    for name in ("q19_postings_digest", "q23_postings_digest_whole"):
        plan = driver_queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate posexplode" not in plan

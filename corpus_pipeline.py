"""Training-data pipeline over documents: toxicity, quality, near-duplicates, benchmark contamination, tokens.

Each stage works on all that its predecessor kept. What holds for all of them: a null text is empty; very long texts are read whole;
repeated rows are rows of their own; an empty table gives an empty one; all columns of documents, and any others whatever their names,
stay as they are, and a stage's own working columns take names that are free.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestack.llm import decontaminate, pieces, quality, simhash, toxicity
from lodestack.llm.common import drop_table, written_once

#: SQL has no character lattices, fitted curves, fuzzy hashes or piece models; tests compare the stages with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half. Null and empty texts have no toxic words, so they stay; copies of a text stay or go together;
    a row with a null id takes no part in learning, as it has no label, and is judged like others."""
    return toxicity.reject_toxic(docs, toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws: as many as are likelier good than not, by a Gumbel top-k on the log importance weight.
    Null and empty texts have the weight of a few n-grams of an average good text; of rows whose keys tie at the border, which are copies
    of one text, the first in reading order are taken; a null id is no hindrance."""
    return quality.reject_poor(docs, quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates. Texts without words (null, empty, blank) are one group, with
    all whose fingerprints are near zero; of rows that share the smallest id, the one of the least text hash stays; rows without an id
    cannot be told apart and all stay."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is inside test items. Texts without words stay; copies stay or go together;
    null ids are no hindrance; an empty benchmark, or null items in it, hit nothing."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token_ids, their pieces, and decoded, the text that these stand for. Null and empty texts have no pieces and decode to
    an empty text; columns of these two names are replaced."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode(docs, path, decoded_to="decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_poor),
    ("simhash_near_dedup", drop_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again, and its predecessor's is removed."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = written_once(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if before is not None:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

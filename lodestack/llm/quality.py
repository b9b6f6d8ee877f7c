"""Quality by importance resampling with hashed n-gram models.

Two generative models count hashed byte n-grams (as many buckets for any corpus): the target from labelled good rows, the
raw one from all documents. A text's log importance weight is the sum of log p_target - log p_raw over its n-grams. A
logistic curve on the weight per n-gram, fitted on labelled rows, says how likely a text is good. Gumbel top-k on the log importance
weights (a text's sum, its noise from its id and text) draws a sample without replacement. To reject poor texts, the weights are taken
against a raw model that is scaled so that the curve's middle is at zero, and as many rows are drawn as lie above it.

Labels are learned from a bounded sample: SAMPLE labelled rows of the smallest hash, outside the held-out fold.
Defined results: null and empty texts have no n-grams, weight 0, and the score of an average good text; very long texts are weighed
whole; repeated rows are scored one by one, and get the same noise; of rows whose keys tie at the border of a draw, as many are taken as
make the draw exact, in reading order; without labelled rows all rows are kept; an empty table gives an empty result; other columns,
whatever their names, are ignored (score) or kept as they are (reject).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop_table, map_batches, parts_of, place_of, quantile_bounds, range_number, spare_name, utf8, write_table
from .toxicity import SAMPLE, fit_curve, fold, labelled_sample

#: Bytes of an n-gram, and buckets (a power of two) of its hash.
GRAM, BUCKETS = 4, 1 << 16
#: Added to every bucket; n-grams of an average good text that every text is taken to have besides its own.
SMOOTHING, PRIOR_GRAMS = 1.0, 20.0


def buckets(text: bytes) -> np.ndarray:
    """Bucket of each n-gram of a text, by multiplicative hashing of its bytes."""
    a = np.frombuffer(text, np.uint8)
    if len(a) < GRAM:
        return np.zeros(0, np.int64)
    h = np.zeros(len(a) - GRAM + 1, np.uint32)
    for k in range(GRAM):
        h = (h << np.uint32(8)) | a[k : len(a) - GRAM + 1 + k]
    return ((h * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def gram_counts(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """n-grams of all documents by bucket. Each partition sums its own, so what is gathered is BUCKETS numbers."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t in utf8(batch.column(0)):
                b = buckets(t)
                if len(b):
                    total += np.bincount(b, minlength=BUCKETS) if len(b) > BUCKETS // 8 else 0
                    if len(b) <= BUCKETS // 8:
                        np.add.at(total, b, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    slim = df.select(F.col(text_col).cast("string").alias("text"))
    bound_batches(df.sparkSession)
    found = slim.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    p, q = target + SMOOTHING, raw + SMOOTHING
    return (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float32)


@dataclass
class QualityModel:
    ratio: np.ndarray
    mean: float = 0.0
    offset: float = 20.0
    slope: float = 0.0

    def weight(self, text: bytes) -> tuple[int, float]:
        b = buckets(text)
        return len(b), float(self.ratio[b].sum(dtype=np.float64))

    def per_gram(self, n: int, weight: float) -> float:
        return (weight + PRIOR_GRAMS * self.mean) / (n + PRIOR_GRAMS)

    def margin(self, n: int, weight: float) -> float:
        """Log importance weight against a raw model that is scaled by as much an n-gram as puts the curve's middle at zero; the n-grams
        that every text is taken to have are counted in. Without labels it is 1."""
        if not self.slope:
            return 1.0
        return (n + PRIOR_GRAMS) * (self.per_gram(n, weight) + self.offset / self.slope) * (1 if self.slope > 0 else -1)

    def score(self, n: int, weight: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.offset + self.slope * self.per_gram(n, weight)))))


def fit_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", most: int = SAMPLE) -> QualityModel:
    """The raw model over all of df; target model and curve from the labelled sample."""
    sample = labelled_sample(df, labels, label, id_col, text_col, most)
    model = QualityModel(log_ratio(gram_counts(sample.where("label = 1")), gram_counts(df, text_col)))
    held = df.sparkSession.sparkContext.broadcast(model)

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [held.value.weight(t) for t in utf8(batch.column(2))]
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([w for _, w in found], pa.float64())], ["label", "n", "w"])

    seen = map_batches(sample, weigh, "label int, n long, w double").toArrow()  # three numbers a row of the sample
    n, w, y = (seen.column(c).to_numpy() for c in ("n", "w", "label"))
    if len(y):
        good = y == 1
        model.mean = float(w[good].sum() / max(1, n[good].sum()))  # a short text counts as good until it shows otherwise
        x = (w + PRIOR_GRAMS * model.mean) / (n + PRIOR_GRAMS)
        sd = float(x.std()) or 1.0
        offset, slope = fit_curve((x - x.mean()) / sd, (y == 1).astype(float))
        model.offset, model.slope = offset - slope * float(x.mean()) / sd, slope / sd
    drop_table(sample)
    return model


def score_quality(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """One row per input row: the id, n_grams, log_weight, score (0 to 1), keep (score of a half or more) and gumbel_key (log_weight plus noise)."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, found = held.value, [held.value.weight(t) for t in utf8(batch.column(1))]
        scores = [m.score(n, w) for n, w in found]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([w for _, w in found], pa.float64()), pa.array(scores, pa.float64()), pa.array([s >= 0.5 for s in scores], pa.bool_()), batch.column(2)],
            ["id", "n_grams", "log_weight", "score", "keep", "noise"],
        )

    # Uniform in (0, 1) from the id and the text, so that a repeated run draws alike.
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col).cast("string")), 11).cast("double") + 0.5) / float(1 << 53)
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), (-F.log(-F.log(uniform))).alias("noise"))
    scored = map_batches(slim, run, "id long, n_grams long, log_weight double, score double, keep boolean, noise double")
    return scored.withColumn("gumbel_key", F.col("log_weight") + F.col("noise")).drop("noise").withColumnRenamed("id", id_col)


def kth_largest(values: DataFrame, column: str, k: int, held: int = 20_000) -> tuple[object, int]:
    """The k-th largest value of a column without nulls, and how many rows of just that value the k largest take in.

    Rows are counted in quantile ranges, which are narrowed until `held` rows at most are left to order; values is read a few times.
    """
    left, rank = values.select(F.col(column).alias("x")), k
    while (n := left.count()) > held:
        bounds = quantile_bounds(left, "x", parts_of(values.sparkSession))
        parts = left.groupBy(range_number(F.col("x"), bounds, "double").alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        for r in sorted(parts.collect(), key=lambda r: -r["part"]):  # one row a range
            if r["n"] >= rank:
                break
            rank -= r["n"]
        if r["n"] == n or r["low"] == r["high"]:  # no border within: the range's largest value is told from the others
            top = left.where(F.col("x") == F.lit(r["high"])).count()
            if top >= rank:
                return r["high"], rank
            rank, left = rank - top, left.where(F.col("x") < F.lit(r["high"]))
        else:
            left = left.where(F.col("x").between(r["low"], r["high"]))
    border = left.orderBy(F.desc("x")).limit(rank).agg(F.min("x")).first()[0]
    return border, rank - left.where(F.col("x") > F.lit(border)).count()


def gumbel_top_k(scored: DataFrame, k: int, key: str = "gumbel_key", held: int = 20_000, to: str = "selected") -> DataFrame:
    """scored with a column `to`: whether a row is one of the k of the largest keys; one of this name in any letter case is replaced.

    Of rows that tie at the border, as many are taken as make exactly k, in the order in which the table is read. scored should be a
    table: it is read a few times.
    """
    scored = scored.drop(to)
    total = scored.count()
    if k <= 0 or not total:
        return scored.withColumn(to, F.lit(False))
    if k >= total:
        return scored.withColumn(to, F.lit(True))
    border, taken = kth_largest(scored, key, k, held)
    tied = scored.where(F.col(key) == F.lit(border)).count()
    if tied == taken:
        return scored.withColumn(to, F.col(key) >= F.lit(border))
    row = spare_name(scored, "row")
    numbered = write_table(scored.withColumn(row, -F.monotonically_increasing_id()))
    last, _ = kth_largest(numbered.where(F.col(key) == F.lit(border)), row, taken, held)
    return numbered.withColumn(to, (F.col(key) > F.lit(border)) | ((F.col(key) == F.lit(border)) & (F.col(row) >= F.lit(last)))).drop(row)


def resample(df: DataFrame, model: QualityModel, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score_quality() with `selected`: a Gumbel top-k draw of floor(share * rows) rows."""
    scored = write_table(score_quality(df, model, id_col, text_col))
    return gumbel_top_k(scored, int(share * scored.count()))


def with_margin(df: DataFrame, model: QualityModel, margin: str, text_col: str = "text") -> DataFrame:
    """df with a column: the log importance weight of each text, its raw model scaled so that the curve's middle is zero."""
    held = df.sparkSession.sparkContext.broadcast(model)
    at = place_of(df, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = held.value
        found = [m.margin(*m.weight(t)) for t in utf8(batch.column(at))]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, margin])

    return map_batches(df, run, df.limit(0).withColumn(margin, F.lit(None).cast("double")).schema)


def reject_poor(df: DataFrame, model: QualityModel, text_col: str = "text", seed: int = 0) -> DataFrame:
    """df without the rows that importance resampling leaves out; all columns stay as they are.

    As many rows are drawn as are likelier good than not. Each row's key is its log importance weight (``with_margin``), of which a
    clearly good text has many times the noise's spread, plus Gumbel noise from its own text; the k largest keys stay.
    """
    margin, key, drawn = (spare_name(df, n) for n in ("margin", "gumbel_key", "drawn"))
    weighed = with_margin(df, model, margin, text_col)
    noise = -F.log(-F.log((F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{text_col}`").cast("string")), 11).cast("double") + 0.5) / float(1 << 53)))
    weighed = write_table(weighed.withColumn(key, F.col(margin) + noise))
    kept = gumbel_top_k(weighed, weighed.where(F.col(margin) >= 0).count(), key, to=drawn)
    return kept.where(F.col(drawn)).select(*(F.col(f"`{c}`") for c in df.columns))


__all__ = ["QualityModel", "fit_quality", "fold", "gumbel_top_k", "reject_poor", "resample", "score_quality"]

"""Document fingerprints by consistent weighted sampling, with built-in functions only.

A text's terms are its lower-cased words, weighted by how often they occur. For each sample, every term draws
r ~ Gamma(2, 1), c ~ Gamma(2, 1) and b ~ Uniform(0, 1) from hashes of the term; with weight S it takes
t = floor(ln S / r + b) and a = c * exp(-r * (t - b + 1)), and the term of the smallest a, with its t, is the
sample. Two texts agree in a sample with a probability equal to the generalised Jaccard similarity of their
weights, so the share of equal samples estimates it.

Defined results: a null text is empty; very long texts are read whole; of terms whose bids are equal the one of the least hash is the
sample; a text without words has a fingerprint of its own, equal to that of other
such texts and unlike any other; an empty table gives an empty result; repeated rows are all returned; a row without an id has no next document, so its
edited text is its own text and near_next is null; of rows with the same id, the next document's text is the smallest
(by its needed part) and its fingerprint the smallest. Other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts_of, quantile_bounds, range_number, write_table

SAMPLES = 32
#: Quantiles that stand for the gamma law: 13 bits of a hash choose one; the outermost level has as many within it, so that shares of 2**-26 are told apart.
LEVELS = 1 << 13
_LOW31, _LOW32 = (1 << 31) - 1, (1 << 32) - 1


def term_weights(text: Column) -> Column:
    """array<struct<term: hash of a word, weight: its occurrences>> of a text, in order of the hashes."""
    words = F.split(F.translate(F.lower(text), "\t\n\r", "   "), " ", -1)
    hashes = F.sort_array(F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w)))
    # Nested one-element arrays bind an intermediate value to a name, so that it is evaluated once.
    return _let(hashes, lambda h: _let(_run_starts(h), lambda s: F.transform(s, lambda at, n: F.struct(F.get(h, at).alias("term"), (F.coalesce(F.get(s, n + 1), F.size(h)) - at).alias("weight")))))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _run_starts(hashes: Column) -> Column:
    """Places in a sorted array where a new value begins."""
    places = F.when(F.size(hashes) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(hashes) - 1))
    return F.filter(places, lambda i: (i == 0) | (F.get(hashes, i) != F.get(hashes, i - 1)))


def gamma_quantiles(shares: list[float]) -> list[float]:
    """Quantiles of the Gamma(2, 1) law at rising shares, by Newton steps on 1 - (1 + x) e**-x."""
    out, x = [], 0.0
    for u in shares:
        x = max(x, math.sqrt(2 * u) * 0.9)
        for _ in range(60):
            step = (1 - (1 + x) * math.exp(-x) - u) / (x * math.exp(-x))
            x = max(x / 2, x - step)
            if abs(step) < 1e-13 * x:
                break
        out.append(x)
    return out


def quantile_tables() -> tuple[list[float], list[float]]:
    """(r, ln c): LEVELS quantiles each, and behind them LEVELS quantiles within the level of the largest r and of the smallest c."""
    even = [(k + 0.5) / LEVELS for k in range(LEVELS)]
    plain = gamma_quantiles(even)
    small, large = gamma_quantiles([u / LEVELS for u in even]), gamma_quantiles([1 - (1 - u) / LEVELS for u in even])
    return plain + large, [math.log(x) for x in plain + small]


def sample(term: Column, log_weight: Column, number: int) -> Column:
    """One term's bid for one sample: ln a in the upper 32 bits, 31 bits of a hash of (term, t) below. One hash gives r, c and b."""
    x = F.xxhash64(term, F.lit(number))
    at_r, at_c = x.bitwiseAND(F.lit(LEVELS - 1)).cast("int"), F.shiftrightunsigned(x, 13).bitwiseAND(F.lit(LEVELS - 1)).cast("int")
    # Long texts are decided in the tails, large r and small c: there 13 bits of a further hash choose a quantile within the level.
    more = F.xxhash64(term, F.lit(number), F.lit(1))
    within = lambda bits: F.shiftrightunsigned(more, bits).bitwiseAND(F.lit(LEVELS - 1)).cast("int") + LEVELS
    r = F.get("_gamma", F.when(at_r == LEVELS - 1, within(0)).otherwise(at_r))
    log_c = F.get("_log_gamma", F.when(at_c == 0, within(13)).otherwise(at_c))
    b = (F.shiftrightunsigned(x, 26).cast("double") + 0.5) / float(1 << 38)
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b + 1.0)
    return F.floor((log_a + 128.0) * float(1 << 24)) * F.lit(1 << 31) + term.bitwiseXOR(t * F.lit(2654435761)).bitwiseAND(F.lit(_LOW31))


def signatures(df: DataFrame, keys: list[str], text_col: str, samples: int = SAMPLES, carried: list[str] | None = None) -> DataFrame:
    """One row for each value of keys: the keys, signature (array of `samples` numbers of 31 bits; -1 where the text has no words)
    and the largest value of each carried numeric column. Needs no shuffle of terms where df is dealt by some of its keys; the last key
    must be 0 or 1. The gamma law comes as a table of quantiles, a broadcast of two rows whatever the data."""
    of_r, of_c = quantile_tables()
    last, carried = keys[-1], carried or []
    law = df.sparkSession.createDataFrame([(k, of_r, of_c) for k in (0, 1)], T.StructType([T.StructField("_k", T.IntegerType(), False), *(T.StructField(c, T.ArrayType(T.DoubleType(), False), False) for c in ("_gamma", "_log_gamma"))]))
    rows = df.select(*keys, *carried, F.explode_outer(term_weights(F.col(text_col))).alias("_e"))
    rows = rows.select(*keys, *carried, F.col("_e.term").alias("_term"), F.log(F.col("_e.weight").cast("double")).alias("_log_weight"))
    rows = rows.join(F.broadcast(law), F.col(last) == F.col("_k"))  # after the explosion: its rows would carry copies of the table
    bids = [F.min(sample(F.col("_term"), F.col("_log_weight"), k)).alias(f"_s{k}") for k in range(samples)]
    found = rows.groupBy(*keys).agg(*bids, *(F.max(c).alias(c) for c in carried))
    return found.select(*keys, F.array(*(F.coalesce(F.col(f"_s{k}").bitwiseAND(F.lit(_LOW31)), F.lit(-1)) for k in range(samples))).alias("signature"), *carried)


def as_text(signature: Column) -> Column:
    """8 lowercase hex digits for each sample."""
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(_LOW32))), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a).cast("double")


def next_ids(df: DataFrame, id_col: str, size_col: str) -> DataFrame:
    """id, next_id, previous_id, previous_size of each distinct id in ascending order, the first after the last. Ranges of ids are ordered apart
    and met at their ends; what is gathered is a row for each range."""
    ids = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(size_col).alias("size"))
    bounds = quantile_bounds(df, id_col, parts_of(df.sparkSession))
    ids = ids.withColumn("part", range_number(F.col("id"), bounds, "long"))
    ends = ids.groupBy("part").agg(F.min("id").alias("lowest"), F.max("id").alias("highest"), F.max_by("size", "id").alias("last_size"))
    line = Window.partitionBy(F.lit(0)).orderBy("part")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lead("lowest").over(line), F.first("lowest").over(whole)).alias("after"),
        F.coalesce(F.lag("highest").over(line), F.last("highest").over(whole)).alias("before"),
        F.coalesce(F.lag("last_size").over(line), F.last("last_size").over(whole)).alias("before_size"),
    )
    own = Window.partitionBy("part").orderBy("id")
    near = ids.select("id", "part", F.lead("id").over(own).alias("n"), F.lag("id").over(own).alias("p"), F.lag("size").over(own).alias("ps"))
    return near.join(F.broadcast(ends), "part").select(
        "id", F.coalesce("n", "after").alias("next_id"), F.coalesce("p", "before").alias("previous_id"), F.when(F.col("p").isNull(), F.col("before_size")).otherwise(F.col("ps")).alias("previous_size")
    )


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter of characters is replaced by the first as many of the next document.

    Returns the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. Whole texts are shuffled once, by their id.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # A row's number follows the order in which the table is read, and is carried: rows that are equal keep apart on every retry.
    every = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), text.alias("text"))
    docs = every.where(F.col("id").isNotNull())
    order = write_table(next_ids(docs.select("id", F.length("text").alias("size")), "id", "size"))
    # Both uses of `placed` shuffle the same columns of the same rows by id, so Spark does it once.
    placed = docs.join(order, "id")
    heads = placed.select(F.col("previous_id").alias("id"), F.struct(F.expr("substring(text, 1, CAST(previous_size div 4 AS int))").alias("head"), "row").alias("first")).groupBy("id").agg(F.min("first")["head"].alias("head"))
    both = placed.select("id", "row", "text", "next_id").join(heads, "id").withColumn("n_chars", F.length("text").cast("long"))
    edited = F.expr("concat(substring(text, 1, CAST(n_chars - n_chars div 4 AS int)), substring(head, 1, CAST(n_chars div 4 AS int)))")
    both = both.select("id", "row", "text", "next_id", "n_chars", edited.alias("edited"))
    alone = every.where(F.col("id").isNull()).select("id", "row", "text", F.lit(None).cast("long").alias("next_id"), F.length("text").cast("long").alias("n_chars"), F.col("text").alias("edited"))
    both = both.union(alone)
    sha = F.sha2(F.col("edited"), 256)
    quarters = [F.conv(F.substring(sha, 1 + 16 * k, 16), 16, -10).cast("long").alias(f"sha{k}") for k in range(4)]
    # All that goes along is put in the exploded values: an expression beside them would be evaluated for every term.
    plain = ["id", "row", "n_chars", "next_id"]
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(t).alias("t"), *plain, *quarters) for k, t in enumerate(("text", "edited"))]
    two = both.select(F.explode(F.array(*kinds)).alias("e")).select("e.*")
    signed = signatures(two, ["id", "row", "kind"], "t", samples, ["n_chars", "next_id", *(f"sha{k}" for k in range(4))])
    pair = signed.groupBy("id", "row").agg(
        F.max("n_chars").alias("n_chars"), F.max("next_id").alias("next_id"), *(F.max(f"sha{k}").alias(f"sha{k}") for k in range(4)), F.max(F.when(F.col("kind") == 0, F.col("signature"))).alias("own"), F.max(F.when(F.col("kind") == 1, F.col("signature"))).alias("other")
    )
    pair = write_table(pair.drop("row"))
    following = pair.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("following_id")).agg(F.min("own").alias("following"))
    out = pair.join(following, pair["next_id"] == following["following_id"], "left")
    return out.select(
        F.col("id").alias(id_col), "n_chars", F.lower(F.concat(*(F.lpad(F.hex(f"sha{k}"), 16, "0") for k in range(4)))).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )

"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Every row gets a number, kept in a written table, and is dealt to a logical partition by a hash of that number: equal rows have
different numbers, so they spread like any others. How many rows each partition sends to each shard is drawn from the
multivariate hypergeometric law, so that all row counts and all shard sizes hold exactly and every assignment is equally
likely. Rows are permuted within their partition, cut by the matrix' row, exchanged, and permuted again within their shard; a
row's place there is its slot, gapless from 0.

Law ``rows``: shard sizes are at most one row apart, the first shards get the odd rows. Moving to another
number of shards deals all rows anew. The draw hangs on the seed and on the rows' numbers, which follow the order in which the
input is read.

Defined results: rows with null values, empty and very long texts are dealt like others (values are carried, never looked at);
rows that are equal get shards and slots of their own, and of them it is not told which got which; an empty table gives an
empty result; columns named ``shard`` or ``slot`` in any letter case are replaced, all others are kept as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spare_name, write_table

#: Standard deviations to each side of a draw's mean beyond which nothing can be drawn (odds below 10**-40).
REACH = 14


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` rows, taken without replacement from good + bad, are good ones.

    Inversion: the odds of neighbouring counts have an exact ratio, (good - k)(drawn - k) / ((k + 1)(bad - drawn + k + 1)), so the
    law over all counts that can be met follows by products from its mode, whatever the numbers' size.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low >= high:
        return low
    total = good + bad
    p = good / total
    sd = (drawn * p * (1 - p) * (total - drawn) / max(1, total - 1)) ** 0.5
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    reach = int(REACH * sd) + 200
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    ratio = (good - k) * (drawn - k) / ((k + 1) * (bad - drawn + k + 1))
    weights = np.ones(last - first + 1)
    at = mode - first
    weights[at + 1 :] = np.cumprod(ratio[at:])
    weights[:at] = np.cumprod(1 / ratio[:at][::-1])[::-1]
    upto = np.cumsum(weights)
    return first + int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))


def draw_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """(partitions, shards) row counts: row sums are `counts`, column sums are at most one apart. Each row of the matrix is a
    multivariate hypergeometric draw from what the shards still lack, one shard after the other."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    lacks = [total // shards + (k < total % shards) for k in range(shards)]
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for i, n in enumerate(counts):
        pool = sum(lacks)
        for k in range(shards):
            pool -= lacks[k]
            got = hypergeometric(rng, lacks[k], pool, n)
            out[i, k] = got
            lacks[k] -= got
            n -= got
    return out


def deal(df: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (gapless from 0 in each shard)."""
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    row, part, rank, share, again = (spare_name(df, n) for n in ("row", "part", "rank", "share", "again"))
    parts = 4 * max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered = write_table(df.withColumn(row, F.monotonically_increasing_id()))
    mixed = numbered.withColumn(part, F.pmod(F.xxhash64(F.lit(seed), row), F.lit(parts)).cast("int"))
    counts = {r[0]: r[1] for r in mixed.groupBy(part).count().collect()}  # one row for each of `parts` logical partitions
    sizes = [counts.get(i, 0) for i in range(parts)]
    ends = draw_matrix(sizes, shards, seed).cumsum(axis=1)

    # Permute locally, and cut by the partition's row of the matrix.
    plan = spark.createDataFrame([(i, [int(x) for x in ends[i]]) for i in range(parts)], f"{part} int, {share} array<long>")
    local = mixed.withColumn(rank, F.row_number().over(Window.partitionBy(part).orderBy(F.xxhash64(F.lit(seed + 1), row), row)) - 1)
    sent = local.join(F.broadcast(plan), part).withColumn("shard", F.size(F.filter(share, lambda e: e <= F.col(rank))).cast("int")).drop(part, rank, share)
    sent = write_table(sent.withColumn(again, F.xxhash64(F.lit(seed + 2), row)))

    # Permute again: ranges of the second random number are ranked apart, and start where the ones before end.
    cells = max(1, parts // shards)
    cell, before = spare_name(sent, "cell"), spare_name(sent, "before")
    sent = sent.withColumn(cell, F.floor((F.shiftrightunsigned(again, 33).cast("double") / float(1 << 31)) * cells).cast("int"))
    held = {(r[0], r[1]): r[2] for r in sent.groupBy("shard", cell).count().collect()}
    starts = []
    for s in range(shards):
        at = 0
        for c in range(cells):
            starts.append((s, c, at))
            at += held.get((s, c), 0)
    first = spark.createDataFrame(starts, f"shard int, {cell} int, {before} long")
    placed = sent.withColumn(rank, F.row_number().over(Window.partitionBy("shard", cell).orderBy(again, row)) - 1)
    return placed.join(F.broadcast(first), ["shard", cell]).select(*(F.col(f"`{c}`") for c in df.columns), "shard", (F.col(before) + F.col(rank)).alias("slot"))

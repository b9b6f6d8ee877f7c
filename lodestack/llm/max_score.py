"""Exact top-k inner-product search over integer vectors by MaxScore.

A vector is a document whose terms are its dimensions; a term's postings are the column of its values. For a query q the most that
term d can add within a block of vectors is max(q[d] * least, q[d] * largest value there), its score bound. Terms are split by these
bounds: those of the least influence whose bounds sum up to a fraction of the score that a vector must reach are non-essential, and
the postings of the essential ones are traversed. A vector stays a candidate while what it has plus the bounds of what is left reaches
the score of the query's k-th best vector so far; for candidates the non-essential terms are probed one after the other, the most
influential first. A block whose bounds sum up to less than that score is not traversed at all. Nothing is approximate: sums are made
in a floating type only where every sum is an integer which that type holds, and in Python's integers where none does.

Rows are dealt to shards of at most SHARD rows by their number; queries are dealt to groups, and meet each shard in blocks: a row goes to
as many tasks as there are groups, a query to as many as there are shards. A task holds one shard, streams its queries, and gives the best
k of each; the shards' lists are merged by query. Equal vectors in a shard are one vector with its k + 1 smallest ids, as no query takes
more of them (its own row is the one more), and equal queries are searched once, so a vector that a third of all rows share costs as
much as one row.

Defined results: vectors that are null or hold null or non-finite components take no part, neither as query nor as candidate; vectors of
unequal length are filled up with zeros, an empty one scores 0; equal scores rank by smaller id, null ids last; a null id is no query;
repeated rows are rows of their own, each a query and a candidate for the other; an empty table, and a table of one row, give no rows. An
integer component beyond 64 bits is clamped to them, and so is a score. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Rows of a shard at most, rows of a block that shares its score bounds, queries that are searched together.
SHARD, BLOCK, TOGETHER = 1 << 17, 2048, 256
#: Rows of a shard at least, where the table has them.
LEAST_SHARD = 2048
#: The part of the score to reach that non-essential terms may add. MaxScore allows all of it; a column of postings costs far less
#: than as many probes, so fewer terms are left to probes.
SLACK = 0.25
LONGEST = (1 << 63) - 1


def whole_numbers(vector: Column, scale: float) -> Column:
    """floor(scale * component) as long; null for vectors that take no part."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(odd, F.lit(True)), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query with all rows but its own."""
    spark = vectors.sparkSession
    asks = F.coalesce(is_query, F.lit(False)) & F.col(key).isNotNull()
    # The row's number is a function of the table's files and order, so a task that runs again gives the same.
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), asks.alias("asks"), whole_numbers(F.col(vector), scale).alias("v")).where("v IS NOT NULL")
    shards, groups = dealing(vectors.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # By a hash of the row's number, so that equal rows spread like others.
    shard, group = F.pmod(F.xxhash64("row"), F.lit(shards)), F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(groups))
    every = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    as_row = F.transform(every(groups), lambda g: F.struct((shard * groups + g).cast("int").alias("unit"), F.lit(False).alias("query")))
    as_query = F.transform(every(shards), lambda s: F.struct((s * groups + group).cast("int").alias("unit"), F.lit(True).alias("query")))
    sent = rows.withColumn("to", F.explode(F.concat(as_row, F.when(F.col("asks"), as_query).otherwise(F.array().cast("array<struct<unit:int,query:boolean>>")))))
    met = sent.select("to.unit", "to.query", "row", "id", "v").repartitionById(shards * groups, F.col("unit")).sortWithinPartitions("unit", "query")
    bound_batches(spark)
    found = met.mapInArrow(lambda batches: _search_units(batches, k), "query_row long, query_id long, hits array<struct<less: long, unnamed: boolean, id: long>>")
    best = found.groupBy("query_row", "query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits"))
    each = best.select("query_id", F.posexplode("hits").alias("at", "hit"))
    return each.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.less")).alias("score"))


def dealing(rows: int, partitions: int) -> tuple[int, int]:
    """(shards, query groups). Sent are groups copies of each row, and for each query and shard its vector and its k hits, which weigh about
    five times a row; a twentieth of the rows being queries, both sides weigh the same at five shards a group."""
    tasks = 2 * max(2, partitions)
    groups = max(1, round((tasks / 5) ** 0.5))
    shards = max(1, -(-rows // SHARD), min(-(-tasks // groups), -(-rows // LEAST_SHARD)))
    return shards, groups


def _matrix(vectors: list[pa.Array]) -> np.ndarray:
    """Rows of list arrays as one int64 matrix, short ones filled up with zeros."""
    width = max((int(np.diff(a.offsets.to_numpy()).max(initial=1)) for a in vectors), default=1)
    out = np.zeros((sum(map(len, vectors)), width), dtype=np.int64)
    at = 0
    for a in vectors:
        ends = a.offsets.to_numpy()
        sizes = np.diff(ends)
        flat = a.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
        if len(a) and width and (sizes == width).all():
            out[at : at + len(a)] = flat.reshape(len(a), width)
        else:
            row = np.repeat(np.arange(len(a)), sizes)
            out[at + row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
        at += len(a)
    return out


def _distinct(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, number of its distinct row for each row)."""
    keys = np.ascontiguousarray(m).view(np.dtype((np.void, m.shape[1] * m.itemsize))).ravel()
    _, first, of = np.unique(keys, return_index=True, return_inverse=True)
    return m[first], of.ravel()


class Shard:
    """The postings of a shard's distinct vectors, by blocks of similar ones, each with its terms' least and largest values."""

    def __init__(self, matrix: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, rows: np.ndarray, k: int):
        self.k = k
        distinct, of = _distinct(matrix)
        # Similar vectors into one block, so that its bounds are tight: by the sides of the medians, the most varied terms first.
        varied = np.argsort(-distinct.std(axis=0, dtype=np.float64), kind="stable")[:16]
        order = np.lexsort((distinct[:, varied] > np.median(distinct[:, varied], axis=0)).T[::-1])
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        distinct, of = distinct[order], place[of]
        self.values = distinct
        self.starts = np.arange(0, len(distinct), BLOCK)
        self.least = np.array([distinct[a : a + BLOCK].min(axis=0) for a in self.starts])
        self.largest = np.array([distinct[a : a + BLOCK].max(axis=0) for a in self.starts])
        self.most = np.maximum(np.abs(self.least.astype(np.float64)), np.abs(self.largest.astype(np.float64))).max(axis=0)
        # Of equal vectors the k + 1 smallest ids.
        by = np.lexsort((rows, ids, unnamed, of))
        begin = np.searchsorted(of[by], np.arange(len(distinct) + 1))
        rank = np.arange(len(by)) - begin[of[by]]
        by = by[rank <= k]
        self.ids, self.unnamed, self.rows = ids[by], unnamed[by], rows[by]
        self.begin = np.searchsorted(of[by], np.arange(len(distinct) + 1))
        self._typed: dict[str, tuple] = {}

    def typed(self, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if kind not in self._typed:
            self._typed = {kind: tuple(m.astype(kind) for m in (self.values, self.least, self.largest))}
        return self._typed[kind]

    def best(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, place in ids) of the k + 1 best rows of each query, sorted by query, score and id."""
        wide = max(queries.shape[1], self.values.shape[1])
        if self.values.shape[1] < wide:  # terms that no vector of the shard has
            queries = queries[:, : self.values.shape[1]]
        elif queries.shape[1] < wide:
            queries = np.pad(queries, ((0, 0), (0, wide - queries.shape[1])))
        reach = float((np.abs(queries.astype(np.float64)) @ self.most).max(initial=0))
        if reach >= 2**52:
            return self._by_integers(queries)
        values, least, largest = self.typed("float32" if reach < 2**23 else "float64")
        q = queries.astype(values.dtype)
        bounds = np.maximum(q, 0) @ largest.T + np.minimum(q, 0) @ least.T
        goal = np.full(len(q), -np.inf)
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        for b in np.argsort(-bounds.max(axis=0), kind="stable"):
            live = np.flatnonzero(bounds[:, b] >= goal)
            if len(live):
                a = self.starts[b]
                who, what, score = traverse(q[live], values[a : a + BLOCK], least[b], largest[b], goal[live], self.k + 1)
                held, goal = self._merge(held, live[who], what + a, score.astype(np.int64), len(q))
        return held

    def _merge(self, held: tuple, who: np.ndarray, what: np.ndarray, score: np.ndarray, queries: int) -> tuple[tuple, np.ndarray]:
        """The k + 1 best of what is held and the rows of more vectors, and the score that others have to reach."""
        n = self.begin[what + 1] - self.begin[what]
        place = np.repeat(self.begin[what], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        who, score, place = np.r_[held[0], np.repeat(who, n)], np.r_[held[1], np.repeat(score, n)], np.r_[held[2], place]
        by = np.lexsort((self.rows[place], self.ids[place], self.unnamed[place], -score, who))
        rank = np.arange(len(by)) - np.searchsorted(who[by], who[by])
        full = by[rank == self.k]
        goal = np.full(queries, -np.inf)
        goal[who[full]] = score[full]
        by = by[rank <= self.k]
        return (who[by], score[by], place[by]), goal

    def _by_integers(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Components so large that no floating type holds all sums: Python's integers, every vector of every block, scores clamped."""
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        for a in self.starts:
            scores = queries.astype(object) @ self.values[a : a + BLOCK].astype(object).T
            scores = np.clip(scores, -LONGEST, LONGEST).astype(np.int64) if scores.size else scores.astype(np.int64)
            who, what = np.indices(scores.shape).reshape(2, -1)
            held, _ = self._merge(held, who, what + a, scores.ravel(), len(queries))
        return held


def traverse(q: np.ndarray, values: np.ndarray, least: np.ndarray, largest: np.ndarray, goal: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of all vectors of a block that reach their query's goal; where a query has no goal yet, of those that reach the
    k-th score of the block."""
    most, low = np.maximum(q * largest, q * least), np.minimum(q * largest, q * least)
    order = np.argsort(most - low, axis=1, kind="stable")  # the least influential term first
    upto = np.cumsum(np.take_along_axis(most, order, axis=1), axis=1)
    spare = np.where(np.isfinite(goal), SLACK * np.abs(goal), -np.inf)
    fits = upto <= spare[:, None]
    probes = np.where(fits.any(axis=1), fits.shape[1] - np.argmax(fits[:, ::-1], axis=1), 0)  # non-essential terms of each query
    left = np.where(probes > 0, np.take_along_axis(upto, np.maximum(probes - 1, 0)[:, None], axis=1)[:, 0], 0).astype(q.dtype)
    essential = np.empty(q.shape, dtype=bool)
    np.put_along_axis(essential, order, np.arange(q.shape[1]) >= probes[:, None], axis=1)
    read = np.flatnonzero(essential.any(axis=0))  # postings that any of the queries traverses
    got = np.where(essential, q, 0)[:, read] @ values[:, read].T
    goal = np.array(goal)
    first = np.flatnonzero(~np.isfinite(goal))
    if len(first) and values.shape[0] >= k:
        goal[first] = np.partition(got[first], values.shape[0] - k, axis=1)[:, values.shape[0] - k]
    who, what = np.nonzero(got + left[:, None] >= goal[:, None])
    score, rest = got[who, what], left[who]
    for step in range(int(probes.max(initial=0))):
        at = probes[who] - 1 - step
        probing = at >= 0
        term = order[who, np.maximum(at, 0)]
        score = score + np.where(probing, q[who, term] * values[what, term], 0)
        rest = rest - np.where(probing, most[who, term], 0)
        keep = score + rest >= goal[who]
        who, what, score, rest = who[keep], what[keep], score[keep], rest[keep]
    return who, what, score


def _search_units(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A unit's rows come first, then its queries."""
    held: list[pa.RecordBatch] = []
    unit, shard = None, None
    for batch in batches:
        units, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        cuts = np.flatnonzero((np.diff(units) != 0) | (np.diff(asks) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(units)], strict=True):
            if a == b:
                continue
            if units[a] != unit:
                unit, shard, held = units[a], None, []
            part = batch.slice(a, b - a)
            if not asks[a]:
                held.append(part)
                continue
            if shard is None:
                if not held:  # no row at all was dealt to this shard
                    continue
                ids = [p.column(3) for p in held]
                shard = Shard(
                    _matrix([p.column(4) for p in held]),
                    np.concatenate([i.fill_null(0).to_numpy() for i in ids]),
                    np.concatenate([i.is_null().to_numpy(zero_copy_only=False) for i in ids]),
                    np.concatenate([p.column(2).to_numpy() for p in held]),
                    k,
                )
                held = []
            for at in range(0, len(part), TOGETHER):
                yield _answer(shard, part.slice(at, TOGETHER), k)


def _answer(shard: Shard, part: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """The k best rows of a shard for each query; its own row is left out of the k + 1 best."""
    distinct, of = _distinct(_matrix([part.column(4)]))
    who, score, place = shard.best(distinct)
    ends = np.searchsorted(who, np.arange(len(distinct) + 1))
    n = (ends[1:] - ends[:-1])[of]
    at = np.repeat(ends[:-1][of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    asked = np.repeat(np.arange(len(part)), n)
    other = shard.rows[place[at]] != part.column(2).to_numpy()[asked]
    at, asked = at[other], asked[other]
    rank = np.arange(len(at)) - np.searchsorted(asked, asked)
    at, asked = at[rank < k], asked[rank < k]
    offsets = np.searchsorted(asked, np.arange(len(part) + 1)).astype(np.int32)
    unnamed = shard.unnamed[place[at]]
    hits = pa.StructArray.from_arrays([pa.array(-score[at]), pa.array(unnamed), pa.array(shard.ids[place[at]], mask=unnamed)], names=["less", "unnamed", "id"])
    return pa.RecordBatch.from_arrays([part.column(2), part.column(3), pa.ListArray.from_arrays(pa.array(offsets), hits)], ["query_row", "query_id", "hits"])

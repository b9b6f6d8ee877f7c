"""URL rules by a sort-merge range join over reversed-host keys.

A host's labels are reversed and each gets a dot: ``blog.example.com`` is ``com.example.blog.``. All hosts below
a rule's host then lie in one interval of keys, and intervals of two rules are nested or apart. Rules and URLs are
dealt to ranges of keys (a rule to every range that its interval meets), sorted, and swept once: a stack holds the
hosts whose interval is open. Paths are intervals in the same way: a host's rules come in order of their paths, each one knows
the next shorter path that it is nested in, and a URL finds its place among them by bisection, then goes outwards to the first
that its own path starts with. So a URL costs the logarithm of a host's rules, however many there are.

Defined results: a null URL, or one without "://", has an empty host and path and fits no rule; very long URLs are judged whole; equal
URLs are judged one by one; empty tables give empty results; of rules with the same host and path the smallest verdict holds, of
equally long ones that fit a URL the greatest in order; rules without a host are left out; URLs that fit no rule get the default
verdict. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts_of

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sampled keys for each range; they decide on balance only.
SAMPLED = 40


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first "://" up to "/", "?", "#" or the end, A-Z lowered) and path (then up to "?", "#" or the end)."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, ASCII_UPPER, ASCII_LOWER), path


def host_key(host: Column) -> Column:
    """The host's labels reversed, each followed by a dot; empty for an empty host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


class HostRules:
    """Rules of one host in order of their paths; nested: the place of the longest other path that a path starts with, or -1."""

    __slots__ = ("host", "key", "nested", "paths", "verdicts")

    def __init__(self, key: str, host: str):
        self.key, self.host = key, host
        self.paths: list[str] = []
        self.verdicts: list[str] = []
        self.nested: list[int] = []

    def add(self, path: str, verdict: str) -> None:
        at = len(self.paths) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.nested[at]
        self.paths.append(path)
        self.verdicts.append(verdict)
        self.nested.append(at)

    def best(self, path: str) -> tuple[int, str, str] | None:
        """(length, rule, verdict) of the longest rule whose path the given one starts with."""
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.nested[at]
        return None if at < 0 else (len(self.host) + len(self.paths[at]), self.host + self.paths[at], self.verdicts[at])


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per URL: the id, host, path, rule (host and path of the longest that fits, else null) and verdict.

    rules: columns host, path, verdict.
    """
    spark = urls.sparkSession
    host, path = url_parts(F.col(url_col).cast("string"))
    pages = urls.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    # A last character that no label starts with ends a host's own key; path and a hash of the id break up hot hosts.
    pages = pages.withColumn("key", F.concat(host_key(F.col("host")), F.lit("\x01"), "path", F.lit("\x01"), F.hex(F.xxhash64("id", "host"))))
    known = rules.groupBy(F.translate(F.col("host"), ASCII_UPPER, ASCII_LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")).agg(F.min("verdict").alias("verdict")).where("host IS NOT NULL")
    known = known.withColumn("key", host_key(F.col("host")))

    ranges = 2 * parts_of(spark)
    sample = sorted(r[0] for r in pages.select("key").orderBy(F.xxhash64("key"), "key").limit(SAMPLED * ranges).collect())
    bounds = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []

    def ranged(batch: pa.RecordBatch) -> pa.RecordBatch:
        """number of the range of each URL, in keys' order"""
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([bisect_right(bounds, k) for k in batch.column(3).to_pylist()], pa.int32())], [*batch.schema.names, "part"])

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        """a rule for each range that its interval meets"""
        rows = batch.to_pylist()
        out = [(r, p) for r in rows for p in range(bisect_right(bounds, r["key"]), bisect_right(bounds, r["key"] + "\U0010ffff") + 1)]
        cols = {k: pa.array([r[k] for r, _ in out], pa.string()) for k in ("host", "path", "verdict", "key")}
        return pa.RecordBatch.from_pydict(cols | {"part": pa.array([p for _, p in out], pa.int32())})

    def each(func):
        return lambda batches: (func(b) for b in batches)

    points = pages.mapInArrow(each(ranged), "id long, host string, path string, key string, part int")
    spans = known.select("host", "path", "verdict", "key").mapInArrow(each(spread), "host string, path string, verdict string, key string, part int")
    both = spans.selectExpr("part", "key", "0 AS kind", "CAST(NULL AS long) AS id", "host", "path", "verdict").union(points.selectExpr("part", "key", "1", "id", "host", "path", "NULL"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sweep(batches):
        part, stack = None, []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["part"] != part:
                    part, stack = r["part"], []
                while stack and not r["key"].startswith(stack[-1].key):
                    stack.pop()
                if r["kind"] == 0:
                    if not stack or stack[-1].key != r["key"]:
                        stack.append(HostRules(r["key"], r["host"]))
                    stack[-1].add(r["path"], r["verdict"])
                    continue
                # An empty key holds no rule but those for every host; the longest rule wins, then the later in order.
                fit = [b for rules in stack if (b := rules.best(r["path"]))] if r["host"] else []
                best = max(fit) if fit else None
                out.append((r["id"], r["host"], r["path"], best[1] if best else None, best[2] if best else default))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*out, strict=True)), (pa.int64(), *[pa.string()] * 4), strict=True)], ["id", "host", "path", "rule", "verdict"])

    swept = both.repartition(n, "part").sortWithinPartitions("part", "key", "kind", "path").mapInArrow(sweep, "id long, host string, path string, rule string, verdict string")
    return swept.withColumnRenamed("id", id_col)

"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded to a word of the perfect binary
Golay code [23, 12, 7]. Every 23-bit word is within 3 bits of exactly one codeword; a word that is one bit away
from it is then within 4 bits of that codeword. So if two fingerprints differ in at most one bit of a segment,
the nearest codeword of one (*near*) is among the codewords within 4 bits of the other (*wide*: 1 or 6).

Three errors over three segments leave two cases: one segment without error and another with one at most
(key: the exact segment and a codeword), or one error at most in each (key: three codewords). In each case one
side gives its near codewords where the other gives its wide ones, so a linked pair always shares a key:
7 near-side and 60-odd wide-side keys a fingerprint at most, each of 33 or 36 bits. Fingerprints of a key are
verified by their distance, and a spanning forest of the verified links is kept (no pair list), so that
groups of any size stay linear. Components come from alternating large-star and small-star steps.

Defined results: a null text is empty; a text of no words has fingerprint zero, linked like any other; very long texts are read
whole; a bit that is set in just half of the hashes is 0; repeated rows are all returned; a null id takes part in links but is never
the smallest id (a component of null ids only has a null component); an empty table gives an empty result. Other columns, whatever
their names, are ignored (near_duplicates) or kept as they are (keep_first, where of rows that share the smallest id and the least
text hash one stays, and which of them is not told).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, map_batches, spare_name, utf8, write_table

#: Distinct fingerprints of one key that a task searches at once, and how often a longer run is split anew.
LONG_RUN, SPLITS = 1 << 14, 3
#: Generator polynomial of the Golay code, bits of the three segments, largest distance of a link.
GENERATOR, SEGMENTS, DISTANCE = 0b101011100011, (22, 21, 21), 3
SEED, SHINGLE = 42, 3


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """Bits that are set in over half of the shingles' hashes."""
    words = text.lower().split()  # bytes: A-Z alone are lowered, and only 0x20 and 0x09 to 0x0D separate
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n)))) if len(words) >= n else [b" ".join(words)]  # noqa: B905
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(h), 1 << 16):  # a very long text's bit matrix stays small
        ones += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def golay() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error pattern to the nearest codeword, and the patterns of weight 4 at most (6, padded by the first)."""

    def syndrome(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(22, 10, -1):
            x = np.where(x >> bit & 1, x ^ (GENERATOR << (bit - 11)), x)
        return x

    one = [1 << i for i in range(23)]
    by_weight = [[0], one]
    for _ in range(3):
        by_weight.append(sorted({a | b for a in by_weight[-1] for b in one if not a & b}))
    near, wide = np.zeros(2048, np.int64), np.zeros((2048, 6), np.int64)
    count = np.zeros(2048, np.int64)
    for weight, patterns in enumerate(by_weight):
        for e, s in zip(patterns, syndrome(np.array(patterns, np.int64)), strict=True):
            if weight <= 3:
                near[s] = e
            wide[s, count[s]] = e
            count[s] += 1
    for k in range(1, 6):
        wide[:, k] = np.where(count > k, wide[:, k], wide[:, 0])
    return near, wide


class Decoder:
    """Vectorised decoding of segments to codeword indices; built once per Python worker."""

    built: Decoder | None = None

    def __init__(self):
        self.near, self.wide = golay()

    @classmethod
    def get(cls) -> Decoder:
        cls.built = cls.built or cls()
        return cls.built

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        for bit in range(22, 10, -1):
            x = x ^ ((x >> bit & 1) * (GENERATOR << (bit - 11)))
        return x

    def indices(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n,) index of the nearest codeword, (n, 6) indices of those within 4 bits, repeats included."""
        s = self.syndrome(x)
        return (x ^ self.near[s]) >> 11, (x[:, None] ^ self.wide[s]) >> 11


def segment_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, fingerprint) pairs; key: the case in the top bits, then the exact segment and codeword indices."""
    parts, at = [], 0
    for width in SEGMENTS:
        parts.append((fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    decoded = [Decoder.get().indices(p) for p in parts]
    keys = []
    for case, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        head = (np.int64(case) << 40) | (parts[i] << 12)
        keys.append(head[:, None] | np.concatenate([decoded[j][0][:, None], decoded[j][1]], axis=1))
    (na, wa), (nb, wb), (nc, wc) = decoded
    head = np.int64(6) << 40
    keys.append((head | (na << 24) | nc)[:, None] | (wb << 12))
    keys.append((head | (wa[:, :, None] << 24) | wc[:, None, :] | (nb << 12)[:, None, None]).reshape(len(fps), 36))
    every = np.sort(np.concatenate(keys, axis=1), axis=1)
    new = np.concatenate([np.ones((len(fps), 1), bool), every[:, 1:] != every[:, :-1]], axis=1)
    return every[new], np.repeat(fps, new.sum(axis=1))


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect exactly the fingerprints which chains of links within this array connect."""
    left, edges = np.unique(fps), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= DISTANCE
            if near.any():
                found = left[near]
                edges.extend((int(x), int(y)) for y in found)
                todo.extend(found)
                left = left[~near]
    return edges


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the 64 bits as a signed long) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in utf8(batch.column(1))], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, fp long")


def split_keys(keys: np.ndarray, fps: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Four (key, fingerprint) pairs for each one: the key mixed with one of the four 16-bit segments. Of three errors, no more than three
    segments have one, so any linked pair shares a new key. Segments begin elsewhere at each level."""
    turned = (fps << np.uint64(5 * level)) | (fps >> np.uint64(64 - 5 * level)) if level else fps
    out = []
    for k in range(4):
        part = (turned >> np.uint64(16 * k) & np.uint64(0xFFFF)) | np.uint64(k << 16)
        mixed = (keys.view(np.uint64) ^ (part * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        out.append(mixed ^ (mixed >> np.uint64(32)))
    return np.concatenate(out).view(np.int64), np.tile(fps, 4)


def _run_links(limit: int | None):
    """For sorted partitions of (key, fp): links (a, b) within each run of equal keys, and, of runs longer than the limit, their rows as they
    are (open: true, a: key, b: fp). A run may go over many batches; held are 8 bytes a fingerprint of a run within the limit."""

    def packed(a: np.ndarray, b: np.ndarray, is_open: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), is_open)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["open", "a", "b"])

    def run(batches):
        key, held, n, is_open = None, [], 0, False

        def close(out: list[tuple[int, int]]) -> None:
            if n > 1 and not is_open:
                out.extend(forest(np.concatenate(held)))

        for batch in batches:
            out: list[tuple[int, int]] = []
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
            ends = np.concatenate([starts[1:], [len(keys)]])
            inner = [(a, b) for a, b in zip(starts, ends, strict=True) if b - a > 1 or a == 0 or b == len(keys)]
            for a, b in inner:
                if keys[a] != key:
                    close(out)
                    key, held, n, is_open = keys[a], [], 0, False
                held.append(fps[a:b].copy())
                n += b - a
                if limit is not None and (is_open or n > limit):
                    every = np.concatenate(held).view(np.int64)
                    yield packed(np.full(len(every), key, np.int64), every, True)
                    held, is_open = [], True
            if out:
                e = np.unique(np.sort(np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64), axis=1), axis=0)
                yield packed(e[:, 0].copy(), e[:, 1].copy(), False)
        out = []
        close(out)
        if out:
            e = np.unique(np.sort(np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64), axis=1), axis=0)
            yield packed(e[:, 0].copy(), e[:, 1].copy(), False)

    return run


def links(distinct: DataFrame, long_run: int = LONG_RUN) -> DataFrame:
    """Spanning links (a, b), a < b, of the distinct fingerprints in column fp.

    A run of more than `long_run` fingerprints under one key is split by segments into four times as many rows with finer keys, three
    times at most; what is as long even then has fingerprints that are close together, and is searched whole.
    """

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        keys, of = segment_keys(fps) if len(fps) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(of.view(np.int64), pa.int64())], ["key", "fp"])

    def finer(level: int):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, fps = split_keys(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), level)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fps.view(np.int64), pa.int64())], ["key", "fp"])

        return run

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs, out = map_batches(distinct.select("fp"), keyed, "key long, fp long"), None
    for level in range(SPLITS + 1):
        limit = long_run if level < SPLITS else None
        found = write_table(pairs.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_run_links(limit), "open boolean, a long, b long"))
        edges = found.where("NOT open").select("a", "b")
        out = edges if out is None else out.union(edges)
        left = found.where("open").select(F.col("a").alias("key"), F.col("b").alias("fp"))
        if left.isEmpty():
            break
        pairs = map_batches(left, finer(level), "key long, fp long")
    return out.distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that links reach, for every node of edges (a, b). Large-star and small-star steps until nothing changes.

    Each step's least neighbours are written before they are joined, so that Spark can split the edges of a node that has very many.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        if small:
            both = both.where("v <= u")
        least = write_table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")))
        met = both.join(least, "u")
        if small:  # u's smaller neighbours, and u itself, go to the smallest
            moved = met.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select("m", "u"))
        else:  # u's larger neighbours go to the smallest
            moved = met.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        moved = write_table(moved.where("a <> b").distinct())
        drop_table(least)
        return moved

    now, state = write_table(edges), None
    for _ in range(most_rounds):
        for small in (False, True):
            new = star(now, small)
            drop_table(now)
            now = new
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == state or seen[0] == 0:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a").distinct())
        state = seen
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, fingerprint (16 lowercase hex digits) and component_id, the smallest id that links reach."""
    docs = write_table(fingerprints(df, id_col, text_col))
    distinct = write_table(docs.groupBy("fp").agg(F.min("id").alias("first")))
    groups = components(links(distinct))
    members = groups.join(distinct, groups["node"] == distinct["fp"]).select("root", "fp", "first")
    least = write_table(members.groupBy("root").agg(F.min("first").alias("least")))
    named = write_table(members.join(least, "root").select("fp", "least"))
    lookup = write_table(distinct.join(named, "fp", "left").select("fp", F.when(F.col("least").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id")))
    return docs.join(lookup, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each component, that of the smallest id. Of rows that share this id, the one of the smallest text hash stays;
    rows without an id cannot be told apart and all stay."""
    found = near_duplicates(df, id_col, text_col).where(F.col(id_col) == F.col("component_id"))
    kept_id, rank = spare_name(df, "kept_id"), spare_name(df, "copy_number")
    found = found.select(F.col("component_id").alias(kept_id)).distinct()
    named = df.where(F.col(id_col).isNotNull()).join(found, F.col(id_col) == F.col(kept_id), "left_semi")
    named = named.withColumn(rank, F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col)))).where(F.col(rank) == 1).drop(rank)
    return named.union(df.where(F.col(id_col).isNull()))

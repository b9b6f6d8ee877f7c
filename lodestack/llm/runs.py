"""Maximal runs of repeated words, by the branching tandem repeats of a suffix tree.

A tandem repeat is a stretch of words that stands twice in a row; it is branching if the word after it breaks the period. Stoye and Gusfield
find all of them from the suffix tree: where a node stands for a stretch of length q, leaf j below it starts one exactly if leaf j + q is below
the same node in another child. Only the leaves outside a node's largest child are looked at, each with both neighbours j + q and j - q, so a
leaf is looked at log n times at most. Every maximal run ends in one branching repeat of its period, and all of its other repeats are rotations of
that one to the left: so a repeat is rotated to the left as far as the words agree, and repeats of one stretch are merged into its run of
the smallest period.

A batch of documents is one sequence of numbers, in which every document (and every piece of one, below) has numbers of its own, so no repeat
leaves it. The tree is held as a suffix array by prefix doubling, with the lengths of common prefixes and the intervals that they make,
all in whole-array steps. Two things are left out since no wanted run has them: a word that stands fewer than `exponent` times in a
document splits it into pieces, and a node with fewer leaves than that is not refined.

Work is by document, in tasks that read them: nothing is shuffled, and a lost task is read again. Memory is about 200 bytes a word of a batch, and
a batch ends at WORDS words or with a document that is longer.

Defined results: a null or blank text has no words, no runs and an empty collapsed text; words are bytes, so letter case and
normal forms count; texts of any length are searched whole; repeated rows give equal rows; ties have no part in it, as all runs are returned; an
empty table gives an empty one; columns named `runs` or `collapsed` in any letter case are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_batches, place_of, utf8

#: Words of a batch that is searched at once; a longer document is a batch of its own.
WORDS = 1 << 18
RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])


def pieces_of(words: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, piece of each): stretches of neighbouring words of one document that each stand at least `least` times in their stretch; shorter
    stretches are left out, as no run is in them. words: numbers that tell words apart."""
    places, piece = np.arange(len(words)), owner.astype(np.int64)
    while len(places):
        _, of, n = np.unique(piece * (int(words.max()) + 1) + words[places], return_inverse=True, return_counts=True)
        kept = n[of] >= least
        if kept.all():
            break
        places, piece = places[kept], piece[kept]
        starts = np.r_[True, (np.diff(places) > 1) | (np.diff(piece) != 0)][: len(places)]
        piece = np.cumsum(starts) - 1
    return places, piece


def suffix_order(first: np.ndarray, least: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks by the first 1, 2, 4, ... numbers): equal ranks mean equal beginnings. Groups of fewer than `least` suffixes are not
    put in order. first: the rank of each number, as the number of smaller ones in the sequence."""
    n = len(first)
    ranks, order = [first], np.argsort(first, kind="stable")
    live = order[_group_sizes(first[order]) >= least] if n else order
    width = 1
    while len(live):
        rank = ranks[-1]
        after = np.where(live + width < n, rank[np.minimum(live + width, n - 1)], -1)
        by = np.argsort(rank[live].astype(np.int64) * (n + 1) + after + 1, kind="stable")
        live, after = live[by], after[by]
        group = rank[live]
        fresh = np.r_[True, np.diff(group) != 0]
        begin = np.flatnonzero(fresh)
        slot = group + np.arange(len(live)) - begin[np.cumsum(fresh) - 1]
        order[slot] = live
        split = fresh | np.r_[True, np.diff(after) != 0]
        rank = rank.copy()
        rank[live] = slot[np.flatnonzero(split)][np.cumsum(split) - 1]
        ranks.append(rank)
        width *= 2
        live = live[_group_sizes(rank[live]) >= least]
    return order, ranks


def _group_sizes(sorted_ranks: np.ndarray) -> np.ndarray:
    """For each element of sorted ranks, how many are equal to it."""
    begin = np.flatnonzero(np.r_[True, np.diff(sorted_ranks) != 0][: len(sorted_ranks)])
    sizes = np.diff(np.r_[begin, len(sorted_ranks)])
    return np.repeat(sizes, sizes)


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Length of the common beginning of each suffix and the one before it in order; 0 for the first. Within groups that were not
    refined it is what the group has in common at least."""
    n = len(order)
    found = np.zeros(n, dtype=np.int64)
    if n < 2:
        return found
    at = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    a, b, length = order[at - 1].copy(), order[at].copy(), np.zeros(len(at), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside.copy()
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        a[same] += 1 << k
        b[same] += 1 << k
        length[same] += 1 << k
    found[at] = length
    return found


def _previous(values: np.ndarray, stop) -> np.ndarray:
    """For each place the nearest earlier one whose value passes stop(value there, own value); place 0 must be passed by all others."""
    before = np.arange(len(values)) - 1
    todo = np.arange(1, len(values))
    while len(todo):
        at = before[todo]
        todo = todo[(at > 0) & ~stop(values[at], values[todo])]
        before[todo] = before[before[todo]]
    return before


def branching_repeats(first: np.ndarray, exponent: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the branching tandem repeats that can end a run of that exponent. lengths: of the piece of each place."""
    order, ranks = suffix_order(first, exponent)
    lcp = common_prefixes(order, ranks)
    n = len(order)
    inside = np.empty(n, dtype=np.int64)
    inside[order] = np.arange(n)
    # Borders between leaves; equal ones with nothing smaller between split one node. A border of length 0 is at both ends.
    line = np.r_[0, lcp[1:], 0] if n else np.zeros(1, dtype=np.int64)
    back = line[::-1]
    smaller, smaller_or_same = _previous(line, np.less), _previous(line, np.less_equal)
    larger = n - _previous(back, np.less)[::-1]
    larger_or_same = n - _previous(back, np.less_equal)[::-1]
    split = np.flatnonzero(line[:n])
    # A node's interval is from its nearest smaller border to the next one; each border has a child on its right, a node's first border also one on
    # its left.
    lo, hi, q = smaller[split], larger[split], line[split]
    kept = (hi - lo >= exponent) & (exponent * q <= lengths[order[split]])
    split, lo, hi, q = split[kept], lo[kept], hi[kept], q[kept]
    leading = smaller[split] == smaller_or_same[split]
    child_lo = np.r_[split, lo[leading]]
    child_hi = np.r_[larger_or_same[split], split[leading]]
    lo, hi, q = (np.r_[x, x[leading]] for x in (lo, hi, q))
    if not len(q):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # All children but the largest of each node.
    by = np.lexsort((child_lo - child_hi, hi, lo))
    largest = np.r_[True, (np.diff(lo[by]) != 0) | (np.diff(hi[by]) != 0)]
    small = by[~largest]
    size = (child_hi - child_lo)[small]
    of = np.repeat(small, size)
    leaf = order[np.repeat(child_lo[small], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    starts, periods = [], []
    for step in (1, -1):
        other = leaf + step * q[of]
        there = (other >= 0) & (other < n)
        at = inside[np.where(there, other, 0)]
        there &= (at >= lo[of]) & (at < hi[of]) & ~((at >= child_lo[of]) & (at < child_hi[of]))
        starts.append(np.minimum(leaf, other)[there])
        periods.append(q[of][there])
    return np.concatenate(starts), np.concatenate(periods)


def maximal_runs(words: np.ndarray, owner: np.ndarray, length: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs in a sequence of word numbers, by start and period; no run leaves a stretch of one owner."""
    places, piece = pieces_of(words, owner, exponent)
    if len(places) < length:
        return []
    # Numbers of a word in a piece; a piece's border breaks every repeat, since no number stands in two pieces.
    _, seq, count = np.unique(piece * (int(words.max()) + 1) + words[places], return_inverse=True, return_counts=True)
    seq = seq.ravel()
    lengths = np.bincount(piece)[piece]
    start, q = branching_repeats((np.cumsum(count) - count)[seq], exponent, lengths)
    end = start + 2 * q
    # The last words of a run of this exponent agree with those one period before, and so on.
    far = end - exponent * q
    may = far >= 0
    for k in range(1, exponent):
        may[may] &= seq[end[may] - 1 - k * q[may]] == seq[end[may] - 1]
    may[may] &= seq[far[may]] == seq[far[may] + q[may]]
    start, q, end = start[may], q[may], end[may]
    known: dict[int, list[tuple[int, int]]] = {}
    found = set()
    for k in np.lexsort((q, end)):  # by period for each end, so that a multiple of a run's period meets that run
        stop, period = int(end[k]), int(q[k])
        held = known.setdefault(stop, [])
        if any(period % p == 0 and stop - begin >= 2 * period for begin, p in held):
            continue
        begin = rotate(seq, int(start[k]), period)
        held.append((begin, period))
        if stop - begin >= max(length, exponent * period):
            found.add((int(places[begin]), int(places[begin]) + stop - begin, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def rotate(seq: np.ndarray, start: int, period: int) -> int:
    """How far to the left a tandem repeat goes on with its period; looked at in steps that double."""
    step = 64
    while start > 0:
        low = max(0, start - step)
        unlike = np.flatnonzero(seq[low:start] != seq[low + period : start + period])
        if len(unlike):
            return low + int(unlike[-1]) + 1
        start, step = low, step * 2
    return 0


def find_runs(df: DataFrame, text_col: str = "text", length: int = 6, exponent: int = 4) -> DataFrame:
    """df with runs (start, length and period in words, by start and period) of at least `length` words and `exponent` periods, and collapsed: the
    words, joined by blanks, without those that a run has after its first period."""
    if exponent < 2 or length < 1:
        raise ValueError("runs have two periods and one word at least")
    gone = [c for c in df.columns if c.lower() in ("runs", "collapsed") and c.lower() != text_col.lower()]
    df = df.drop(*gone)
    schema = T.StructType([*df.schema.fields, T.StructField("runs", T.ArrayType(RUN, False), False), T.StructField("collapsed", T.StringType(), False)])
    at = place_of(df, text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        from_row, held, total = 0, [], 0
        column = utf8(batch.column(at))
        for k, text in enumerate(column):
            ws = text.split()  # at blanks and the control characters 9 to 13
            if held and total + len(ws) > WORDS:
                yield _searched(batch.slice(from_row, len(held)), held, length, exponent)
                from_row, held, total = k, [], 0
            held.append(ws)
            total += len(ws)
        yield _searched(batch.slice(from_row), held, length, exponent)

    return map_batches(df, run, schema)


def _searched(batch: pa.RecordBatch, docs: list[list[bytes]], length: int, exponent: int) -> pa.RecordBatch:
    sizes = np.array([len(ws) for ws in docs], dtype=np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(docs)), sizes)
    words = pa.array([w for ws in docs for w in ws], pa.binary()).dictionary_encode().indices.to_numpy() if len(owner) else np.empty(0, np.int64)
    runs: list[list[dict]] = [[] for _ in docs]
    dropped: dict[int, list[tuple[int, int]]] = {}
    for start, end, period in maximal_runs(words.astype(np.int64), owner, length, exponent):
        of = int(owner[start])
        base = int(ends[of] - sizes[of])
        runs[of].append({"start": start - base, "length": end - start, "period": period})
        dropped.setdefault(of, []).append((start - base + period, end - base))
    texts = []
    for k, ws in enumerate(docs):
        if k in dropped:
            left, upto = [], 0
            for a, b in sorted(dropped[k]):
                left += ws[upto : max(a, upto)]
                upto = max(upto, b)
            ws = left + ws[upto:]
        texts.append(b" ".join(ws))
    kind = pa.list_(pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")]))
    made = [pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "runs", "collapsed"])

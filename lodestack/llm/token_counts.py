"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast table of the corpus' frequent pre-tokens with their token counts, of bounded size.
Tier two is a cache in each Python worker: pre-tokens that miss both are encoded by the library in batches.
No pre-token is shuffled: the table comes from a sample of whole texts, SAMPLED rows by the hash of their text, whose tasks each report
their heaviest pre-tokens to the driver. It decides on speed only; every count is made from all of a row's text.

A text is cut by the library's own splitting pattern, written out with the letters and numbers on which Unicode versions agree
since 3.2. Where a text holds another character (a younger script, a control character) or a special token's string, it is first cut
at blanks between other characters, which are borders of pre-tokens in any case, and the words with such characters are units that
the library encodes itself; so counts are the library's in every case, and all texts go through both tiers.

Defined results: null counts as empty (0 tokens, 0 bytes); repeated rows are counted one by one; very long texts are counted whole, and
pre-tokens of more than LONG characters are encoded without a place in the cache; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import drop_table, map_batches, utf8, write_table

#: Entries of the broadcast table, rows of the sample that it is counted in, pre-tokens that its tasks report in all, entries of a worker's cache.
FREQUENT, SAMPLED, REPORTED, CACHED = 32_768, 20_000, 1 << 17, 400_000
#: Characters of a pre-token beyond which it is not kept in a table.
LONG = 256

_TOKENIZERS: dict[str, tuple[Tokenizer, tuple[str, ...]]] = {}
_CACHES: dict[str, dict[str, int]] = {}


def _ranges(found: list[int]) -> str:
    """A character class' inside for sorted code points."""
    out, lo = [], None
    for k, c in enumerate(found):
        lo = c if lo is None else lo
        if k + 1 == len(found) or found[k + 1] != c + 1:
            out.append(f"\\U{lo:08x}-\\U{c:08x}" if c > lo else f"\\U{c:08x}")
            lo = None
    return "".join(out)


@cache
def patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """The splitting pattern, one unclear character, and the blanks that part words without regard to unclear characters.

    A character is clear if it was a letter (a number, a blank, neither) in Unicode 3.2 and still is, or if it was unassigned then and is
    no letter, number, blank or control now. A letter or number that came later, or is to come, may be unknown to the library. Letters
    and numbers beyond the basic plane count as unclear (``astral``), so that classes hold the basic plane alone, which is fast.
    """
    kinds: dict[str, list[int]] = {"L": [], "N": [], "?": []}
    for c in range(0x10000):
        kind = _kind(chr(c))
        if kind in kinds:
            kinds[kind].append(c)
    letters, numbers, unclear = (_ranges(kinds[k]) for k in "LN?")
    pattern = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+")
    return pattern, re.compile(f"[{unclear}]"), re.compile(rf"(?<=[^\s{unclear}])(?= [^\s{unclear}])")


def _kind(ch: str) -> str:
    """L, N, Z or O (none of these) for a clear character, else a question mark."""
    now, then = unicodedata.category(ch), unicodedata.ucd_3_2_0.category(ch)
    kind, old = ((c[0] if c[0] in "LNZ" else "O") for c in (now, then))
    if now in ("Cn", "Cs") or (kind != old and not (then == "Cn" and kind == "O")) or "\x1c" <= ch <= "\x1f":
        return "?"
    return kind


ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@cache
def astral(ch: str) -> bool:
    """Whether a character beyond the basic plane is unclear; emoji, the common ones, are not."""
    return _kind(ch) != "O"


def is_unclear(text: str) -> bool:
    return not text.isascii() and any(map(astral, set(ASTRAL.findall(text)))) or bool(patterns()[1].search(text))


def tokenizer(path: str) -> tuple[Tokenizer, tuple[str, ...]]:
    if path not in _TOKENIZERS:
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        added = t.get_added_tokens_decoder().values()
        if t.normalizer is not None or any(a.lstrip or a.rstrip or a.single_word or " " in a.content for a in added):
            raise ValueError(f"the tokenizer alters texts before it splits them, or has added tokens that take blanks along: {path}")
        _TOKENIZERS[path] = t, tuple(a.content for a in added)
    return _TOKENIZERS[path]


def worker_cache(path: str) -> dict[str, int]:
    """Pre-tokens that this worker has encoded so far; it outlives tasks."""
    return _CACHES.setdefault(path, {})


def cut(text: str, special: tuple[str, ...]) -> list[str]:
    """Pre-tokens of a text; words that hold an unclear character or a special token's string stay whole."""
    split, _, blanks = patterns()
    if not is_unclear(text) and not any(s in text for s in special):
        return split.findall(text)
    out: list[str] = []
    for word in blanks.split(text):
        if is_unclear(word) or any(s in word for s in special):
            out.append(word)
        else:
            out.extend(split.findall(word))
    return out


def frequent_lengths(df: DataFrame, path: str, text_col: str = "text", most: int = FREQUENT, sampled: int = SAMPLED) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of a sample of about `sampled` rows, chosen by a hash of their number, so that copies of a text
    are no more likely than others; equal texts of a batch count once. It affects speed, never counts."""
    rows = df.select(F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    part = max(1, df.count() // max(1, sampled))
    sample = write_table(rows.where((F.pmod(F.xxhash64("row"), F.lit(part)) == 0) & F.col("text").isNotNull()).select("text"))
    reported = max(64, REPORTED // max(1, len(sample.inputFiles())))

    def run(batches):
        _, special = tokenizer(path)
        seen: Counter[str] = Counter()
        for batch in batches:
            for x in set(batch.column(0).to_pylist()):
                seen.update(t for t in cut(x, special) if len(t) <= LONG)
            if len(seen) > 20 * reported:  # lossy counting: light ones go, memory stays bounded
                seen = Counter(dict(seen.most_common(5 * reported)))
        top = seen.most_common(reported)
        yield pa.RecordBatch.from_pydict({"t": pa.array([t for t, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    seen: Counter[str] = Counter()
    for part in sample.mapInArrow(run, "t string, n long").toArrow().to_batches():  # REPORTED rows in all
        for word, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            seen[word] += n
    drop_table(sample)
    words = sorted(seen, key=lambda w: (-seen[w], w))[:most]
    return dict(zip(words, encoded_lengths(tokenizer(path)[0], words), strict=True))


def encoded_lengths(t: Tokenizer, words: list[str], at_once: int = 4096) -> list[int]:
    """Token counts by the library; its results are far larger than the words, so not many are held at once."""
    return [len(e.ids) for lo in range(0, len(words), at_once) for e in t.encode_batch(words[lo : lo + at_once], add_special_tokens=False)]


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", frequent: dict[str, int] | None = None) -> DataFrame:
    """One row per input row: the id, n_bytes (UTF-8) and n_tokens. path: a byte-level BPE file of the tokenizers library, at the same place on every executor."""
    table = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, path, text_col) if frequent is None else frequent)

    def lookup(batch: pa.RecordBatch) -> pa.RecordBatch:
        t, special = tokenizer(path)
        first, own = table.value, worker_cache(path)
        texts = [x or "" for x in batch.column(1).to_pylist()]
        counts: list[int] = []
        for lo in range(0, len(texts), 100):
            pieces = [cut(x, special) for x in texts[lo : lo + 100]]
            if len(own) > CACHED:
                own.clear()
            missed = list(set().union(*pieces).difference(first).difference(own))
            once = dict(zip(missed, encoded_lengths(t, missed), strict=True))
            long = {w: once.pop(w) for w in missed if len(w) > LONG}
            own.update(once)
            both = Tiers(first, own, long)
            counts.extend(sum(map(both.of, p)) for p in pieces)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in utf8(batch.column(1))], pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(slim, lookup, "id long, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


class Tiers:
    """The broadcast table first, the worker's cache after it, then this batch's long pre-tokens."""

    __slots__ = ("first", "long", "own")

    def __init__(self, first: dict[str, int], own: dict[str, int], long: dict[str, int]):
        self.first, self.own, self.long = first, own, long

    def of(self, word: str) -> int:
        n = self.first.get(word)
        if n is None:
            n = self.own.get(word)
        return self.long[word] if n is None else n

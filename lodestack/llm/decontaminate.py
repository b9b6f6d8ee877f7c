"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

An item's text is lower-cased (A-Z) and cut to words; every 13 consecutive words are a window, and an item of fewer words (but
not none) is one window. A document's text is normalised alike and scanned once; word places are mapped back to byte and
character offsets of the original.

The automaton runs over word numbers and holds blocks of 7 words, cut from each item without overlap: every window of 13 words has
one whole block in it, so an occurrence of any window is met at a block, and the match is then followed to both sides, word by word,
in the item. That takes three nodes a word of an item, where windows would take 85 over characters.
A benchmark of more words than MOST_WORDS is dealt to parts by the hash of its slices (of SLICE words, which overlap by 12, so that no
window is lost); documents are scanned once for each part, and the parts' spans are united. So no size is refused, and what a worker
holds is bounded.

Defined results: a null text has no words, and neither has an empty one; very long texts are scanned whole; an empty benchmark hits
nothing, and items whose id or text is null are left out; equal items are all reported (items that share an id are one); repeated rows
are judged one by one; an empty table gives an empty result; other columns, whatever their names, are ignored (find) or kept as they
are (remove).
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, place_of, spare_name, utf8, write_table

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 13
#: Words of a slice of an item, and of the slices that one automaton holds (about 200 bytes each in a worker); three digits number them.
SLICE, MOST_WORDS = 1 << 15, 1 << 20

Slice = tuple[str, str]
_BUILT: dict[str, Index] = {}


def cut_items(items: DataFrame, item_col: str, text_col: str, window: int, most: int) -> tuple[DataFrame, int]:
    """Slices (item, words joined by blanks, part) of the benchmark as a written table, and the number of parts."""
    step = max(1, SLICE - window + 1)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            words = WORD.findall(text.lower())
            for at in range(0, max(1, len(words) - window + 1), step) if words else ():
                part = words[at : at + step + window - 1]
                rows.append((item, b" ".join(part).decode(), len(part)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 3, (pa.string(), pa.string(), pa.int64()), strict=True)], ["item", "words", "n"])

    slim = items.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    slices = write_table(map_batches(slim, run, "item string, words string, n long"))
    parts = max(1, -(-(slices.agg(F.sum("n")).first()[0] or 0) // most))
    return slices.withColumn("part", F.pmod(F.xxhash64("item", "words"), F.lit(parts)).cast("int")), parts


class Index:
    """The automaton over one part's slices. Values: (slice, place of the block in it), packed in one number.

    A word is three characters, the digits of its number; each place has characters of its own, so matches begin and end with words, and
    no node has more than 128 edges. A document's word that no item has is three characters without an edge.
    """

    def __init__(self, slices: list[Slice], window: int):
        self.window, self.block = window, (window + 1) // 2
        self.codes: dict[bytes, str] = {}
        self.names = [i for i, _ in slices]
        self.items: list[str] = []
        owners: dict[str, list[int]] = defaultdict(list)
        for k, (_, text) in enumerate(slices):
            words = text.encode().split(b" ")
            for w in words:
                if w not in self.codes:
                    self.codes[w] = self.code(len(self.codes))
            line = "".join(map(self.codes.__getitem__, words))
            self.items.append(line)
            if len(words) < window:
                owners[line[: 3 * self.block]].append(k << 32)
            else:
                for at in range(0, len(words) - self.block + 1, self.block):
                    owners[line[3 * at : 3 * (at + self.block)]].append(k << 32 | at)
        self.auto = ahocorasick.Automaton()
        for block, found in owners.items():
            self.auto.add_word(block, (len(block) // 3, found))
        self.auto.make_automaton()

    @staticmethod
    def code(n: int) -> str:
        return chr(1 + (n >> 14)) + chr(0x401 + (n >> 7 & 127)) + chr(0x481 + (n & 127))

    @staticmethod
    def get(key: str, slices: list[Slice], window: int) -> Index:
        """Built once per Python worker, which holds one index at a time."""
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Index(slices, window)
        return _BUILT[key]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [first, end) word ranges that are inside occurrences of windows, and the items they belong to."""
        if not words or not len(self.auto):
            return [], set()
        code, none = self.codes.get, "\x00\x00\x00"
        text = "".join([code(w, none) for w in words])
        spans, ids, followed = [], set(), {}
        for end, (n, found) in self.auto.iter(text):
            end //= 3
            for packed in found:
                k, at = packed >> 32, packed & 0xFFFFFFFF
                shift = end - n + 1 - at  # where the slice's first word would be
                if followed.get((k, shift), -1) >= end:
                    continue
                item = self.items[k]
                lo, hi, many = at, at + n, len(item) // 3
                while lo and shift + lo > 0 and item[3 * lo - 3 : 3 * lo] == text[3 * (shift + lo) - 3 : 3 * (shift + lo)]:
                    lo -= 1
                while hi < many and item[3 * hi : 3 * hi + 3] == text[3 * (shift + hi) : 3 * (shift + hi) + 3]:
                    hi += 1
                followed[k, shift] = shift + hi - 1
                if hi - lo >= min(self.window, many):
                    spans.append((shift + lo, shift + hi))
                    ids.add(self.names[k])
        return merged(spans), ids


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def offsets(text: bytes, low: bytes, spans: list[tuple[int, int]]) -> Iterator[dict]:
    """Spans of words with their places in characters of the original; code points are counted once over."""
    at, byte, char = [m.span() for m in WORD.finditer(low)], 0, 0
    for a, b in spans:
        places = []
        for to in (at[a][0], at[b - 1][1]):
            char, byte = char + len(text[byte:to].decode("utf-8", "replace")), to
            places.append(char)
        yield {"first_word": a, "end_word": b, "start": places[0], "end": places[1]}


_SPANS = "array<struct<first_word:long,end_word:long,start:long,end:long>>"


def _judged(slim: DataFrame, slices: DataFrame, part: int, window: int, all_rows: bool) -> DataFrame:
    """id, n_words, spans, item_ids against one part of the benchmark."""
    held = slim.sparkSession.sparkContext.broadcast([(r["item"], r["words"]) for r in slices.where(F.col("part") == part).select("item", "words").collect()])
    key = f"{uuid.uuid4().hex}-{window}"

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, out, of = Index.get(key, held.value, window), [], []
        for k, text in enumerate(utf8(batch.column(1))):
            low = text.lower()
            words = WORD.findall(low)
            found, ids = index.hits(words)
            if found or all_rows:
                out.append((len(words), list(offsets(text, low, found)) if found else [], sorted(ids)))
                of.append(k)
        kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("first_word", "end_word", "start", "end")]))
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), kind, pa.list_(pa.string())), strict=True))], ["id", "n_words", "spans", "item_ids"])

    return map_batches(slim, judge, f"id long, n_words long, spans {_SPANS}, item_ids array<string>")


def _united(found: DataFrame) -> DataFrame:
    """Rows with a list of each part's spans as one list without overlaps."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for spans in batch.column(2).to_pylist():
            line: list[dict] = []
            for s in sorted(spans, key=lambda s: s["first_word"]):
                if line and s["first_word"] <= line[-1]["end_word"]:
                    line[-1]["end_word"], line[-1]["end"] = max(line[-1]["end_word"], s["end_word"]), max(line[-1]["end"], s["end"])
                else:
                    line.append(dict(s))
            out.append(line)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, batch.schema.field(2).type), batch.column(3)], batch.schema.names)

    return map_batches(found, run, found.schema)


def find_contamination(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """One row per input row: the id, n_words, n_hit, spans (first_word, end_word, start, end: characters of the original), item_ids sorted as strings."""
    slices, parts = cut_items(items, item_col, item_text_col, window, most_words)
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if parts == 1:
        found = _judged(slim, slices, 0, window, True)
    else:
        rows = write_table(slim.withColumn("row", F.monotonically_increasing_id()))
        texts = rows.select(F.col("row").alias("id"), "text")
        every = [write_table(_judged(texts, slices, p, window, p == 0)) for p in range(parts)]
        united = every[0]
        for one in every[1:]:
            united = united.union(one)
        united = united.groupBy("id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
        found = _united(united).withColumnRenamed("id", "row").join(rows.select("row", "id"), "row").select("id", "n_words", "spans", "item_ids")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])
    return found.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "spans", "item_ids")


def remove_contaminated(df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """df without the contaminated rows (hit words are a twentieth of all words at least); all columns stay as they are."""
    slices, parts = cut_items(items, item_col, item_text_col, window, most_words)
    if parts > 1:
        row = spare_name(df, "row")
        numbered = write_table(df.withColumn(row, F.monotonically_increasing_id()))
        found = find_contamination(numbered, items, row, text_col, item_col, item_text_col, window, most_words)
        bad = found.where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select(row)
        return numbered.join(bad, row, "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))
    held = df.sparkSession.sparkContext.broadcast([(r["item"], r["words"]) for r in slices.select("item", "words").collect()])
    key, at = f"{uuid.uuid4().hex}-{window}", place_of(df, text_col)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, stay = Index.get(key, held.value, window), []
        for text in utf8(batch.column(at)):
            words = WORD.findall(text.lower())
            n = sum(b - a for a, b in index.hits(words)[0])
            stay.append(not (n > 0 and 20 * n >= len(words)))
        return batch.filter(pa.array(stay, pa.bool_()))

    return map_batches(df, keep, df.schema)

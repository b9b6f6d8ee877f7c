"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

The model merges pairs of pieces by score (byte-pair encoding with byte fallback). A sequence of pieces is the encoding of a
text exactly if each two neighbours are *compatible*: encoding their joined text gives back these two. So the encoding is the
only path through a lattice whose nodes are pieces at places and whose edges are compatible neighbours.

Ordinary documents are cut into units that no piece of the vocabulary crosses (a run of word marks with what follows, a line
feed); each distinct unit is encoded once by the library, and a worker's cache gives it from then on.

A giant document is cut into chunks of any place. A chunk's boundary states are the pieces that lie across or end at its
borders; its transfer matrix holds the largest score of a path from each state at its start to each at its end (minus infinity
without one). Inside, from the first border of units to the last, the path is known and adds one number; only the pieces of
cut units are searched. Matrices combine by max-plus products, neighbour with neighbour in rounds, up a tree to one matrix a document;
the states at the borders come down the same tree, and each chunk is traced back apart from all others. Scores are summed in whole
numbers, so any order is exact.

Defined results: a null text is empty; an empty text has no pieces; very long texts are encoded whole, by chunks; the word mark itself
(U+2581) in a text reads as a blank, and texts that the model's normaliser alters do not decode to themselves; the path is the only one,
so there are no ties; repeated rows are encoded one by one; an empty table gives an empty result; other columns are kept as they are,
whatever their names, but one named like the result in any letter case is replaced. encode() is equal to the library's encoding of the
whole text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, map_batches, place_of, spare_name, write_table

MARK = "▁"
#: Characters above which a document is giant, characters of a chunk, entries of a worker's cache.
GIANT, CHUNK, CACHED = 50_000, 16_384, 150_000
#: Neighbouring matrices that one task multiplies in a round of the scan.
FAN = 16
NONE = float("-inf")

#: Letters, digits, signs and blanks of Latin scripts.
COMMON = re.compile(r"[\n\x20-\x7e\xa1-\xac\xae-ɏ]*")
#: Units of a text with a blank put before it.
RAW_UNITS = re.compile(r"\n| +[^ \n]*|[^ \n]+")

_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """A model's vocabulary, and what the lattice needs of it."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.byte_ids = {p: i for i, p in enumerate(self.pieces) if lib.is_byte(i)}
        self.id_of = {p: i for i, p in enumerate(self.pieces) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))}
        self.score = {p: int(lib.get_score(i)) for p, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of))
        if any(re.search(rf"[^{MARK}]{MARK}", p) or "\n" in p[:-1] or "\n" in p[1:] for p in self.id_of):
            raise ValueError("a piece of this vocabulary crosses the units that texts are cut into")
        self.units = re.compile(rf"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
        self.cache: dict[str, tuple[int, ...]] = {}
        self.raw: dict[str, bytes] = {}
        self.bytes_of = {i: p.encode() for p, i in self.id_of.items()} | {i: bytes([int(p[3:5], 16)]) for p, i in self.byte_ids.items()}
        #: The model leaves common characters as they are: then a text of these needs no look at its normal form.
        common = "".join(c for c in map(chr, range(1, 0x250)) if COMMON.fullmatch(c))
        probe = f"  {common}  {common}\n \n{common} "
        self.leaves_common = self.library.normalize(probe) == self.marked(probe)
        self.pairs: dict[tuple[str, str], bool] = {}

    @staticmethod
    def get(path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        return _ENCODERS[path]

    @staticmethod
    def marked(text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def plain(self, text: str) -> bool:
        """Whether the model's normaliser leaves the text as it is, so that units can be encoded apart."""
        return bool(self.leaves_common and COMMON.fullmatch(text)) or self.library.normalize(text) == self.marked(text)

    def unit_ids(self, units: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each unit. The library puts a mark before a text: a unit's own mark is left to it, or a line feed is put between."""
        if len(self.cache) > CACHED:
            self.cache.clear()
        missed = [u for u in dict.fromkeys(units) if u not in self.cache]
        if missed:
            given = [u[1:].replace(MARK, " ") if u[0] == MARK else "\n" + u for u in missed]
            for u, ids in zip(missed, self.library.encode(given, num_threads=1), strict=True):
                # A lone mark is an empty text to the library.
                self.cache[u] = (self.id_of[MARK],) if u == MARK else tuple(ids if u[0] == MARK else ids[2:])
        return self.cache

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], np.int32).tolist()

    def keys(self, text: str) -> list[str] | None:
        """Units of a text as keys of the cache: a word stands for itself behind a blank, a line feed goes with what follows it, and
        other units (more blanks, no blank) come after a NUL. None for a text that the normaliser may alter."""
        if not text or not self.plain(text):
            return None
        if "  " not in text and text[0] != " ":
            return text.replace("\n", " \n").split(" ")
        return [u if u == "\n" else u[1:] if u[0] == " " != u[1:2] else "\0" + u for u in RAW_UNITS.findall(" " + text)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian 32-bit numbers. Units that the cache lacks are encoded many at a time."""
        cut, raw = [self.keys(t) for t in texts], self.raw
        if len(raw) > CACHED:
            raw.clear()
        held = [list(map(raw.get, c)) if c else None for c in cut]  # one look at the cache for each unit
        missed = list({u for c, h in zip(cut, held, strict=True) if h and None in h for u, x in zip(c, h, strict=True) if x is None})
        line = self.byte_ids["<0x0A>"]
        feed = array("i", [line]).tobytes()
        for lo in range(0, len(missed), 256):
            # A line feed before each unit keeps it apart; the mark that the library puts first stands before all of them.
            part = missed[lo : lo + 256]
            given = (u[1:] if u[:1] in ("\n", "\0") else " " + u for u in part)
            ids = np.array(self.library.encode("\n" + "\n".join(given), num_threads=1), np.int32)
            at = [*np.flatnonzero(ids == line).tolist(), len(ids)]
            for u, x, y in zip(part, at[:-1], at[1:], strict=True):
                raw[u] = (feed if u[:1] == "\n" else b"") + ids[x + 1 : y].tobytes()
        out = []
        for t, c, h in zip(texts, cut, held, strict=True):
            if h is None:
                out.append(array("i", self.library.encode(t, num_threads=1) if t else []).tobytes())
            else:
                out.append(b"".join([raw[u] if x is None else x for u, x in zip(c, h, strict=True)] if None in h else h))
        return out

    def decode_all(self, ids: list[list[int]]) -> list[str]:
        """Texts of ids: the pieces' bytes joined, marks as blanks, the first blank left out; broken UTF-8 and rare ids are left to the library."""
        out, of = [], self.bytes_of.__getitem__
        for x in ids:
            try:
                text = b"".join(map(of, x)).decode().replace(MARK, " ")
                out.append(text[1:] if text[:1] == " " else text)
            except (UnicodeDecodeError, KeyError):
                out.append(self.library.decode(x))
        return out

    # -- the lattice of a cut unit --

    def text_of(self, piece: str) -> list[int]:
        """Ids of a lattice piece; a character that is no piece falls back to its bytes."""
        return [self.id_of[piece]] if piece in self.id_of else [self.byte_ids[f"<0x{b:02X}>"] for b in piece.encode()]

    def weight(self, piece: str) -> int:
        return self.score.get(piece, -(10**7))

    def merge(self, text: str) -> list[str]:
        """Pair merges of a short text: the best score first, then the leftmost."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def compatible(self, a: str, b: str) -> bool:
        key = (a, b)
        if key not in self.pairs:
            if len(self.pairs) > CACHED:
                self.pairs.clear()
            self.pairs[key] = self.merge(a + b) == [a, b]
        return self.pairs[key]

    def starting(self, text: str, at: int) -> Iterator[str]:
        """Lattice pieces that start at a place: single characters, and pieces that merge to themselves."""
        yield text[at]
        for n in range(2, min(self.longest, len(text) - at) + 1):
            p = text[at : at + n]
            if p in self.score and self.whole(p):
                yield p

    def whole(self, piece: str) -> bool:
        key = (piece, "")
        if key not in self.pairs:
            self.pairs[key] = self.merge(piece) == [piece]
        return self.pairs[key]


#: A state at a border of chunks: a piece that ends there or lies across, and its start relative to the border.
#: Where a unit begins (and at the text's ends) no piece lies across and any may follow, so there is one state, BREAK.
State = tuple[int, str]
Matrix = dict[State, dict[State, float]]
BREAK: State = (0, "")


def is_break(text: str, k: int) -> bool:
    return k in (0, len(text)) or text[k] == "\n" or text[k - 1] == "\n" or (text[k] == MARK and text[k - 1] != MARK)


def border_states(enc: Encoder, text: str, border: int) -> list[State]:
    if is_break(text, border):
        return [BREAK]
    return [(s - border, p) for s in range(max(0, border - enc.longest), border) for p in enc.starting(text, s) if s + len(p) >= border]


def paths(enc: Encoder, text: str, start: int, entry: State, end: int) -> tuple[dict[State, float], dict]:
    """Best sums from a state at `start` to all states at `end`, and each node's predecessor; nodes are (place, piece)."""
    first = (start + entry[0], entry[1])
    best: dict[tuple[int, str], float] = {first: 0.0}
    back: dict[tuple[int, str], tuple[int, str]] = {}
    ready: dict[int, list[tuple[int, str]]] = {first[0] + len(first[1]): [first]}
    closed, out = is_break(text, end), {}
    for place in range(first[0] + len(first[1]), end):
        if place not in ready:
            continue
        free = is_break(text, place)
        before = ready.pop(place)
        for p in enc.starting(text, place):
            fit = [b for b in before if free or not b[1] or enc.compatible(b[1], p)]
            if not fit:
                continue
            node, found = (place, p), max(fit, key=best.__getitem__)
            best[node], back[node] = best[found] + enc.weight(p), found
            ready.setdefault(place + len(p), []).append(node)
            if not closed and place + len(p) >= end:
                out[(place - end, p)] = best[node]
    if closed and end in ready:
        last = max(ready[end], key=best.__getitem__)
        out[BREAK], back[(end, "")] = best[last], last
    return out, back


def inner_breaks(text: str, start: int, end: int) -> tuple[int, int] | None:
    """First and last place within [start, end] where a unit begins."""
    lo = next((k for k in range(start, end + 1) if is_break(text, k)), None)
    return None if lo is None else (lo, next(k for k in range(end, start - 1, -1) if is_break(text, k)))


def transfer(enc: Encoder, text: str, start: int, end: int) -> Matrix:
    """A chunk's matrix. From the chunk's first break to its last the path is the units' own encoding, one number."""
    entries, inner = border_states(enc, text, start), inner_breaks(text, start, end)
    if inner is None:
        return {e: row for e in entries if (row := paths(enc, text, start, e, end)[0])}
    lo, hi = inner
    units = enc.units.findall(text[lo:hi])
    found = enc.unit_ids(units)
    middle = float(sum(enc.weight(enc.pieces[i]) for u in units for i in found[u]))
    tails = {BREAK: 0.0} if hi == end else paths(enc, text, hi, BREAK, end)[0]
    heads = {e: {BREAK: 0.0} if lo == start else paths(enc, text, start, e, lo)[0] for e in entries}
    return {e: {s: h[BREAK] + middle + w for s, w in tails.items()} for e, h in heads.items() if h}


def traced(back: dict, node: tuple[int, str], first: tuple[int, str]) -> list[str]:
    out = []
    while node != first:
        if node[1]:
            out.append(node[1])
        node = back[node]
    return out[::-1]


def backtrace(enc: Encoder, text: str, start: int, end: int, entry: State, leave: State) -> list[int]:
    """Ids of the chunk's pieces, from behind the entry state to the leaving one."""

    def ids(a: int, e: State, b: int, s: State) -> list[int]:
        _, back = paths(enc, text, a, e, b)
        return [i for p in traced(back, (b + s[0], s[1]), (a + e[0], e[1])) for i in enc.text_of(p)]

    inner = inner_breaks(text, start, end)
    if inner is None:
        return ids(start, entry, end, leave)
    lo, hi = inner
    units = enc.units.findall(text[lo:hi])
    found = enc.unit_ids(units)
    head = [] if lo == start else ids(start, entry, lo, BREAK)
    tail = [] if hi == end else ids(hi, BREAK, end, leave)
    return head + [i for u in units for i in found[u]] + tail


def combine(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product."""
    out: Matrix = {}
    for e, row in a.items():
        into: dict[State, float] = {}
        for m, w in row.items():
            for s, v in b.get(m, {}).items():
                into[s] = max(into.get(s, NONE), w + v)
        if into:
            out[e] = into
    return out


def product(matrices: list[Matrix]) -> Matrix:
    """Max-plus product of neighbours, pair by pair; any bracketing gives the same."""
    while len(matrices) > 1:
        pairs = [combine(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)]
        matrices = pairs + ([matrices[-1]] if len(matrices) % 2 else [])
    return matrices[0]


def states_between(matrices: list[Matrix], entry: State, leave: State) -> list[State]:
    """The states at all borders of neighbouring matrices on the best path from entry to leave."""
    behind: dict[State, float] = {leave: 0.0}
    later = [behind]
    for m in matrices[:0:-1]:
        behind = {e: max(w + behind[s] for s, w in row.items() if s in behind) for e, row in m.items() if any(s in behind for s in row)}
        later.append(behind)
    out = [entry]
    for m, ahead in zip(matrices, later[::-1], strict=True):
        row = m[out[-1]]
        out.append(max((s for s in row if s in ahead), key=lambda s: (row[s] + ahead[s], s)))
    return out


def encode(df: DataFrame, path: str, text_col: str = "text", giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN, decoded_to: str | None = None) -> DataFrame:
    """df with `token_ids` (array of int), equal to the library's encoding of each whole text; columns of this name are replaced.

    decoded_to: also a column of this name with the text that the ids stand for, as decode() gives it, from the same pass over the rows.
    """
    df = df.drop("token_ids", *([decoded_to] if decoded_to else []))
    at = place_of(df, text_col)

    def small(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = Encoder.get(path)
        ids = enc.encode_all([t or "" for t in batch.column(at).to_pylist()])
        places = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(places), pa.array(np.frombuffer(b"".join(ids), np.int32)))
        out, names = [*batch.columns, lists], [*batch.schema.names, "token_ids"]
        if decoded_to:
            out.append(pa.array(enc.decode_all([np.frombuffer(x, np.int32).tolist() for x in ids]), pa.string()))
            names.append(decoded_to)
        return pa.RecordBatch.from_arrays(out, names)

    shape = df.limit(0).withColumn("token_ids", F.lit(None).cast("array<int>"))
    schema = (shape.withColumn(decoded_to, F.lit(None).cast("string")) if decoded_to else shape).schema
    length = F.length(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    ordinary = map_batches(df.where(length <= giant), small, schema)
    giants = encode_giants(df.where(length > giant), path, text_col, chunk, fan)
    return ordinary.union(decode(giants, path, to_col=decoded_to) if decoded_to else giants)


def encode_giants(df: DataFrame, path: str, text_col: str, chunk: int, fan: int = FAN) -> DataFrame:
    """Giant documents by chunks: matrices apart, a parallel scan over each document's matrices, traces apart, joined in order.

    The scan is a tree: a task multiplies `fan` neighbouring matrices at most, over rounds that grow with the logarithm of a document's
    chunks, and then hands the states at the borders down the same tree. A text is brought to the model's normal form before it is cut.
    """
    tag = spare_name(df, "giant_row")
    giants = write_table(df.withColumn(tag, F.monotonically_increasing_id()))
    at, tag_at = place_of(giants, text_col), place_of(giants, tag)

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Windows of marked text in normal form: the chunk and `longest` characters on both sides."""
        enc = Encoder.get(path)
        step, margin = max(chunk, 2 * enc.longest), 2 * enc.longest
        for tag_value, text in zip(batch.column(tag_at).to_pylist(), batch.column(at).to_pylist(), strict=True):
            marked = enc.marked(text) if enc.plain(text) else enc.library.normalize(text)
            cuts = [*range(0, len(marked), step), len(marked)] if marked else []
            rows = [(tag_value, k, marked[max(0, a - margin) : b + margin], min(a, margin), min(a, margin) + b - a) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()), strict=True)], ["tag", "part", "window", "start", "end"])

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = write_table(map_batches(giants, cut, "tag long, part int, window string, start int, end int").repartition(n, "tag", "part"))

    def matrix(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, out = Encoder.get(path), []
        for r in batch.to_pylist():
            m = transfer(enc, r["window"], r["start"], r["end"])
            out.extend((r["tag"], r["part"], e[0], e[1], s[0], s[1], w) for e, row in m.items() for s, w in row.items())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 7, _KINDS, strict=True)], _NAMES)

    levels = [write_table(map_batches(parts, matrix, _MATRIX))]
    chunks = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while chunks > 1:  # up: each round multiplies neighbours, so a document of n chunks takes log n rounds
        chunks = -(-chunks // fan)
        levels.append(write_table(_grouped(levels[-1], fan).groupBy("tag", "above").applyInPandas(_multiply, _MATRIX)))
    # Down: the ends of a document are known, and each round gives the states between the neighbours of a level.
    ends = levels[-1].select("tag", "part", "from_at", "from_piece", "to_at", "to_piece")
    for below in reversed(levels[:-1]):
        known = ends.select("tag", F.col("part").alias("above"), *(F.col(c).alias(f"end_{c}") for c in _NAMES[2:6]))
        ends = write_table(_grouped(below, fan).join(known, ["tag", "above"]).groupBy("tag", "above").applyInPandas(_split, _ENDS))
    if len(levels) > 1:
        for t in levels:
            drop_table(t)
    borders = ends
    known = parts.join(borders, ["tag", "part"])

    def trace(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, rows = Encoder.get(path), batch.to_pylist()
        ids = [backtrace(enc, r["window"], r["start"], r["end"], (r["from_at"], r["from_piece"]), (r["to_at"], r["to_piece"])) for r in rows]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["tag", "part", "ids"])

    names = [F.col(c) for c in ("tag", "part", "window", "start", "end", "from_at", "from_piece", "to_at", "to_piece")]
    traced_parts = map_batches(known.select(*names), trace, "tag long, part int, ids array<int>")
    joined = traced_parts.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("p")).select(F.col("tag").alias("_joined_tag"), F.flatten(F.transform("p", lambda x: x["ids"])).alias("token_ids"))
    found = giants.join(joined, giants[tag] == joined["_joined_tag"], "left")
    return found.select(*(giants[f"`{c}`"] for c in df.columns), F.coalesce("token_ids", F.array().cast("array<int>")).alias("token_ids"))


_NAMES = ["tag", "part", "from_at", "from_piece", "to_at", "to_piece", "weight"]
_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.float64())
_ENDS = "tag long, part int, from_at int, from_piece string, to_at int, to_piece string"
_MATRIX = f"{_ENDS}, weight double"


def _grouped(level: DataFrame, fan: int) -> DataFrame:
    return level.withColumn("above", F.expr(f"part div {fan}").cast("int"))


def _matrices(pdf) -> tuple[list[int], list[Matrix]]:
    """Places and matrices of a group's rows, in order."""
    found: dict[int, Matrix] = {}
    for r in pdf.itertuples(index=False):
        found.setdefault(r.part, {}).setdefault((r.from_at, r.from_piece), {})[(r.to_at, r.to_piece)] = r.weight
    return sorted(found), [found[k] for k in sorted(found)]


def _multiply(key, pdf):
    import pandas as pd

    m = product(_matrices(pdf)[1])
    return pd.DataFrame([(key[0], key[1], *e, *s, w) for e, row in m.items() for s, w in row.items()], columns=_NAMES)


def _split(key, pdf):
    import pandas as pd

    places, matrices = _matrices(pdf)
    first = pdf.iloc[0]
    on = states_between(matrices, (int(first["end_from_at"]), first["end_from_piece"]), (int(first["end_to_at"]), first["end_to_piece"]))
    return pd.DataFrame([(key[0], k, *a, *b) for k, a, b in zip(places, on, on[1:], strict=False)], columns=_NAMES[:6])


def decode(df: DataFrame, path: str, ids_col: str = "token_ids", to_col: str = "decoded") -> DataFrame:
    """df with the text that its ids stand for; null ids are empty; a column of this name is replaced."""
    df = df.drop(to_col)
    at = place_of(df, ids_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = Encoder.get(path).decode_all([i or [] for i in batch.column(at).to_pylist()])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, to_col])

    return map_batches(df, run, df.limit(0).withColumn(to_col, F.lit(None).cast("string")).schema)

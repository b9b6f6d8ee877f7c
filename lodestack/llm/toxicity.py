"""Toxicity by noisy-channel deobfuscation.

1. A character 4-gram model counts the letters of all documents (accents folded, 27 symbols, so its table is bounded).
2. Suspicious tokens (letters mixed with leetspeak, separators inside a word, a letter three times running, spelled-out
   words) are restored: a Viterbi search over the lattice of what each character may stand for, under the character
   model and the channel's costs. A token without any of these has one path through its lattice, itself. Leetspeak at a
   token's end may be punctuation or a number, so such a token is read both ways, and the larger weight counts.
3. Words and word beginnings of the restored text carry weights learned from labelled rows: the log-odds of the Wilson
   lower bound of their share of toxic documents. A logistic curve turns a document's sum into a score.

The work is linear in a token's length. Before it is decoded, a token is brought to the channel's normal form: a mark repeated
more than four times counts as four, since each further one adds the cost of leaving it out to every path alike (separators twice and
more are also read as a line between words, and the larger weight counts), and a letter or digit repeated more than three times as three. Characters that stand for no letter end words, so what is between them is
decoded apart, and a piece of more than LONG characters in windows of LONG that overlap by half; the last one is read with its tail like any
piece. Any number of stars may be masked letters. A piece is decoded only if it can weigh anything: all readings of a character fall in
one class (``skeleton``), a star may be in any, and one Aho-Corasick automaton (with stars, a bit-parallel one) tells whether the classes of
any weighted feature stand in the piece; where they do not, no path through its lattice has a weight.

Labels are learned from a bounded sample: SAMPLE labelled rows of the smallest hash (near copies count once); features are all
that are met in enough toxic rows of it.
Defined results: null and empty texts get the score of a text without any toxic word; repeated rows are scored one by
one; of paths of equal cost that of the lesser text is taken; very long texts and tokens are read whole; without labelled rows
every score is 0; an empty table gives an empty result; other columns, whatever their names, are ignored (score) or kept as
they are (reject).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop_table, map_batches, place_of, write_table

#: Labelled rows that are learned from, and tokens that a worker's cache holds.
SAMPLE, CACHED = 20_000, 150_000
#: Characters of a piece that is decoded at once; a longer one is decoded in windows of as many.
LONG = 128
#: Toxic documents that a feature needs, the least lower bound of its share, and the lengths of word beginnings.
LEAST_DOCS, LEAST_SHARE, PREFIXES = 5, 0.5, (4, 5, 6, 7)

#: What leet characters may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Accented Latin-1 letters by their base letter.
FOLDS = {"a": "àáâãäåæ", "c": "ç", "d": "ð", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõöø", "s": "ß", "t": "þ", "u": "ùúûü", "y": "ýÿ"}
SEPARATORS = " .-_*~"
#: Costs in nats: reading a leet character as a letter, leaving out a separator or a repeated letter, a word's end, a masked letter.
COST_LEET, COST_SEPARATOR, COST_REPEAT, COST_END, COST_MASK = 1.2, 0.4, 0.9, 1.0, 3.0

SYMBOL = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")} | {x: ord(base) - 96 for base, xs in FOLDS.items() for x in xs}
WORD = re.compile(r"[^\W\d_]+")
#: Leet or a letter three times, and a separator before a letter; the latter is odd behind an earlier letter.
ODD_LEET, ODD_SEPARATOR, LETTER = re.compile(r"[\d@$!|+(€][^\W\d_]|([^\W\d_])\1\1"), re.compile(r"[*._~-][^\W\d_]"), re.compile(r"[^\W\d_]")
#: Leet after a letter at the end of a token, and what may follow or precede it.
TAIL = re.compile(r"[^\W\d_]([\d@$!|+(€._~*-]*[\d@$!|+(€])\Z")
PLAIN, MARKS = ".,;:?%&#*~-_=/\\\"'()[]{}<>", "!|+"
DOUBLED = re.compile(r"([^\W\d_])\1")
SPELLED = re.compile(r"(?<![\w@$!])[\w@$!](?:[ .\-_*][\w@$!]){3,}(?![\w@$!])")
#: A separator twice and more.
LINE = re.compile(r"(?:\.\.+|--+|__+|~~+|\*\*+)")
#: Marks repeated more than four times, letters and digits more than three times.
RULED, RUN = re.compile(r"([^\w\s]|_)\1{4,}"), re.compile(r"([^\W_])\1{3,}")


# -- the character model ---------------------------------------------------------------------------------------


def _symbol_table() -> np.ndarray:
    table = np.zeros(256, np.int32)
    for c, s in SYMBOL.items():
        if ord(c) < 256:
            table[ord(c)] = s
    return table


def character_counts(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each letter follows its three predecessors in the words of all documents; 27**4 counts whatever the corpus."""
    table = _symbol_table()

    def run(batches):
        total = np.zeros(27**4, np.int64)
        for batch in batches:
            for part in np.array_split(np.array(batch.column(0).to_pylist(), dtype=object), 1 + batch.num_rows // 200):
                a = table[np.frombuffer("\n\n\n".join(["", *(t.lower() for t in part if t), ""]).encode("latin-1", "replace"), np.uint8)]
                c, p1 = a[3:], a[2:-1]
                p2 = a[1:-2] * (p1 > 0)
                p3 = a[:-3] * (p2 > 0)
                met = (c > 0) | (p1 > 0)
                total += np.bincount((((p3 * 27 + p2) * 27 + p1) * 27 + c)[met], minlength=27**4)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["gram", "n"])

    slim = df.select(F.col(text_col).cast("string").alias("text"))
    bound_batches(df.sparkSession)
    found = slim.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(27**4)
    out[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return out


def character_costs(counts: np.ndarray, strength: float = 5.0) -> np.ndarray:
    """-log P(letter | three before), interpolated down to single letters."""
    lower = np.full((1, 27), 1 / 27)
    for order in range(4):  # contexts of 0, 1, 2 and 3 letters; the last letter is the lowest digit
        c = counts.reshape(27 ** (3 - order), 27**order, 27).sum(axis=0)
        p = np.tile(lower, (27**order // len(lower), 1))
        lower = (c + strength * p) / (c.sum(axis=1, keepdims=True) + strength)
    return -np.log(lower).astype(np.float32)


def is_odd(token: str) -> bool:
    """Whether a lower-cased token has to be decoded."""
    if ODD_LEET.search(token):
        return True
    first = LETTER.search(token)
    return bool(first and ODD_SEPARATOR.search(token, first.end()))


def arcs_of(token: str, k: int, letters_from: int | None = None) -> list[tuple[int, str, float]]:
    """What the k-th character may stand for: (symbol, what is written, cost); symbol 0 ends a word, -1 is left out."""
    ch, before, inner = token[k], token[k - 1] if k else "", 0 < k < len(token) - 1
    arcs: list[tuple[int, str, float]] = []
    if ch in SYMBOL:
        arcs.append((SYMBOL[ch], ch, 0.0))
        if ch == before:
            arcs.append((-1, "", COST_REPEAT))
    elif ch in SEPARATORS:
        arcs.append((0, " ", COST_END))
        if inner:
            arcs.append((-1, "", COST_SEPARATOR))
            if ch == "*":
                arcs.extend((x, chr(96 + x), COST_MASK) for x in range(1, 27))
    elif letters_from is not None and k >= letters_from and ch in LEET:
        arcs.extend((SYMBOL[x], x, COST_LEET) for x in LEET[ch])
    else:
        arcs.append((0, ch, COST_END))
        arcs.extend((SYMBOL[x], x, COST_LEET) for x in LEET.get(ch, ""))
        if ch == before:
            arcs.append((-1, "", COST_REPEAT))
    return arcs


#: A path: (the path before, what it writes), None at its start.
Path = tuple | None


def written_by(path: Path) -> str:
    out = []
    while path is not None:
        path, written = path
        out.append(written)
    return "".join(reversed(out))


def restore(token: str, costs: np.ndarray, letters_from: int | None = None) -> str:
    """The likeliest text behind a token: Viterbi over the lattice; states are the last three letters. From letters_from on, leet stands for letters."""
    states: dict[int, tuple[float, Path]] = {0: (0.0, None)}
    for k in range(len(token)):
        arcs = arcs_of(token, k, letters_from)
        if len(arcs) > 26 and len(states) > 20:
            states = _masked(states, arcs, costs)
            continue
        best: dict[int, tuple[float, Path]] = {}
        for context, (cost, path) in states.items():
            for symbol, written, own in arcs:
                if symbol < 0:
                    to, c = context, cost + own
                elif symbol == 0:
                    to, c = 0, cost + own + (float(costs[context, 0]) if context else 0.0)
                else:
                    to, c = context % 729 * 27 + symbol, cost + own + float(costs[context, symbol])
                _keep(best, to, c, path, written)
        states = best
    ends = [(cost + (float(costs[s, 0]) if s else 0.0), path) for s, (cost, path) in states.items()]
    least = min(c for c, _ in ends)
    return min(written_by(path) for c, path in ends if c == least)


def _keep(best: dict[int, tuple[float, Path]], to: int, cost: float, path: Path, written: str) -> None:
    """Keep the path if it is the cheapest to its state; of equal ones that of the lesser text."""
    held = best.get(to)
    if held is None or cost < held[0]:
        best[to] = cost, (path, written) if written else path
    elif cost == held[0]:
        new = (path, written) if written else path
        if written_by(new) < written_by(held[1]):
            best[to] = cost, new


def _masked(states: dict[int, tuple[float, Path]], arcs: list[tuple[int, str, float]], costs: np.ndarray) -> dict[int, tuple[float, Path]]:
    """One step over a masked letter from many states: all of its 26 letters at once, the other arcs one by one. Only what the states' last two
    letters tell apart is looked at."""
    at = np.fromiter(states, np.int64, len(states))
    lows, of = np.unique(at % 729, return_inverse=True)
    cost = np.full((27, len(lows)), np.inf)
    cost[at // 729, of] = [c for c, _ in states.values()]
    reached = cost[:, :, None] + costs.reshape(27, 729, 27)[:, lows]
    source = reached.argmin(axis=0)
    least = np.take_along_axis(reached, source[None], axis=0)[0] + COST_MASK
    best: dict[int, tuple[float, Path]] = {}
    finite = np.isfinite(least)
    finite[:, 0] = False
    rows, symbols = np.nonzero(finite)
    came = (source[rows, symbols] * 729 + lows[rows]).tolist()
    for to, c, origin, symbol in zip((lows[rows] * 27 + symbols).tolist(), least[rows, symbols].tolist(), came, symbols.tolist(), strict=True):
        best[to] = c, (states[origin][1], chr(96 + symbol))
    for context, (c0, path) in states.items():
        for symbol, written, own in arcs[:2]:  # the word's end, and nothing
            to, c = (context, c0 + own) if symbol < 0 else (0, c0 + own + (float(costs[context, 0]) if context else 0.0))
            _keep(best, to, c, path, written)
    return best


def normal(token: str) -> str:
    """A token in the channel's normal form: a mark more than four times is there four times, a letter or digit more than three times three times."""
    return RUN.sub(r"\1\1\1", RULED.sub(r"\1\1\1\1", token))


def words_of(piece: str, costs: np.ndarray) -> list[str]:
    """Words of a piece of a token, restored where it is suspicious."""
    core = piece.rstrip(".,;:?!%&#*$|~-_+=/\\\"'()[]{}<>").lstrip(".,;:?%&#*~-_=/\\\"'()[]{}<>") if is_odd(piece) else piece
    return WORD.findall(restore(core, costs) if is_odd(core) else core)


def restored_words(token: str, costs: np.ndarray) -> list[str]:
    """Words of a lower-cased token, restored where it is suspicious."""
    if " " in token:
        return WORD.findall(restore(token, costs))  # spelled out
    return words_of(token, costs)


def tail_readings(token: str, costs: np.ndarray) -> list[str]:
    """A lower-cased token with the leet at its end read as letters: all of it, and all but the marks !, | and + that end it."""
    if " " in token or token.isalpha():
        return []
    core = token.lstrip(PLAIN).rstrip(PLAIN.replace("(", ""))
    found = ((c, TAIL.search(c)) for c in dict.fromkeys((core, core.rstrip(MARKS))))
    return [restore(c, costs, m.start(1)) for c, m in found if m]


def tail_words(token: str, costs: np.ndarray) -> list[str]:
    return [w for t in tail_readings(token, costs) for w in WORD.findall(t)]


# -- what can weigh anything --------------------------------------------------------------------------------------


def _classes() -> dict[int, str | None]:
    """Translation of characters to the class of all letters that they may stand for; separators go."""
    head = {c: c for c in "abcdefghijklmnopqrstuvwxyz"}

    def find(c: str) -> str:
        while head[c] != c:
            c = head[c]
        return c

    for letters in LEET.values():
        for x in letters[1:]:
            head[find(x)] = find(letters[0])
    out: dict[int, str | None] = {ord(c): find(chr(96 + n)) for c, n in SYMBOL.items()}
    out |= {ord(c): find(letters[0]) for c, letters in LEET.items()}
    return out | {ord(c): None for c in SEPARATORS}


CLASSES, AGAIN = _classes(), re.compile(r"(.)\1+", re.DOTALL)
STARRED_CLASSES = {k: v for k, v in CLASSES.items() if k != ord("*")}
#: Characters that are no letter and may stand for none: they end words on every path.
HARD = re.compile("[^\\w" + re.escape(SEPARATORS + "".join(LEET)) + "]+")


def skeleton(text: str) -> str:
    """Classes of a text's characters, without separators, runs of a class once. A word that any path reads from a piece has a skeleton
    that stands in the piece's: a path leaves out separators and repeats only, and stays in a character's class."""
    return AGAIN.sub(r"\1", text.translate(CLASSES))


class _Wildcards:
    """Skeletons, searched for in a piece whose stars may be any letter: one bit for each of their places, all moved on at once."""

    def __init__(self, skeletons: list[str]):
        self.first = self.last = self.inside = 0
        self.of: dict[str, int] = {}
        at = 0
        for s in skeletons:
            self.first |= 1 << at
            for k, c in enumerate(s):
                self.of[c] = self.of.get(c, 0) | 1 << at + k
            at += len(s)
            self.last |= 1 << at - 1
        self.inside = ((1 << at) - 1) & ~self.first

    def stand_in(self, piece: str) -> bool:
        held, letters = 0, False
        for c in piece.translate(STARRED_CLASSES):
            moved = (held << 1 & self.inside) | self.first
            if c == "*":
                held |= moved
            else:
                held = (moved | held) & self.of.get(c, 0)  # on, or a run of the same class
                letters = True
            if held & self.last and letters:
                return True
        return bool(held & self.last) and letters


def text_tokens(text: str) -> set[str]:
    """Distinct lower-cased tokens of a whole text, and its spelled-out words."""
    low = text.lower()
    tokens = set(low.split())
    tokens.update(SPELLED.findall(low))
    return tokens


def windows(piece: str) -> list[tuple[str, bool, bool]]:
    """Windows of LONG characters that overlap by half, and whether each one holds the piece's beginning and its end."""
    half = LONG // 2
    return [(piece[at : at + LONG], at == 0, at + LONG >= len(piece)) for at in range(0, len(piece) - half, half)]


def window_words(window: str, costs: np.ndarray, first: bool, last: bool) -> list[str]:
    """Words that stand wholly in a window; one that a border cuts stands in the next window."""
    text = restore(window, costs)
    words = WORD.findall(text)
    if words and not first and LETTER.match(text):
        words = words[1:]
    if words and not last and LETTER.match(text[-1]):
        words = words[:-1]
    return words


def word_features(word: str) -> list[str]:
    return [f"{word}$", *(word[:n] for n in PREFIXES if len(word) >= n)]


# -- learning ---------------------------------------------------------------------------------------------------


@dataclass
class ToxicityModel:
    """costs: the character model; weights: of words (with a final $) and word beginnings; offset and slope of the curve."""

    costs: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    offset: float = -20.0
    slope: float = 0.0
    #: Skeletons of the weighted features; built where it is used.
    known: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}

    def may_weigh(self, piece: str) -> bool:
        """Whether any reading of a piece can have a weight."""
        if self.known is None:
            built = ahocorasick.Automaton()
            for f in self.weights:
                if s := skeleton(f.rstrip("$")):
                    built.add_word(s, True)
            built.make_automaton()
            self.known = built, _Wildcards(sorted(built.keys()))
        words, wildcards = self.known
        if not len(words):
            return False
        if "*" in piece:
            return wildcards.stand_in(piece)
        return next(words.iter(skeleton(piece)), None) is not None

    def weight_of(self, words: list[str]) -> float:
        weights = self.weights
        return max((weights.get(f, 0.0) for w in words for f in word_features(w)), default=0.0)

    def piece_weight(self, piece: str, tail: bool = True) -> float:
        """The largest weight of a word of a whole piece; tail: leet at its end may be letters."""
        words = restored_words(piece, self.costs)
        more = tail_words(piece, self.costs) if tail else []
        best = self.weight_of(words + more)
        if not best and (more or DOUBLED.search(piece)):  # a letter twice is common, so such a word counts as it is first
            best = self.weight_of([v for w in words + more if DOUBLED.search(w) for v in WORD.findall(restore(w, self.costs))])
        return best

    def token_weight(self, token: str) -> float:
        """The largest weight of a token's words."""
        if token.isalpha() and (best := self.weight_of([token])):
            return best
        if token.isalpha() and not DOUBLED.search(token):
            return 0.0
        short = normal(token)
        best = self.normal_weight(short)
        if " " not in short and LINE.search(short):  # a mark twice and more may be a line between words
            best = max(best, *(self.normal_weight(part) for part in LINE.split(short)))
        return best

    def normal_weight(self, short: str) -> float:
        """The largest weight of the words of a token in normal form."""
        best, spelled = 0.0, " " in short
        if len(short) <= LONG:
            return self.piece_weight(short) if self.may_weigh(short) else 0.0
        for piece in [short] if spelled else HARD.split(short):
            ends = not spelled and short.endswith(piece)
            if len(piece) <= LONG:
                if self.may_weigh(piece):
                    best = max(best, self.piece_weight(piece, ends))
                continue
            if not spelled and not is_odd(piece):
                best = max(best, self.weight_of(WORD.findall(piece)))
            for window, first, last in windows(piece):
                if self.may_weigh(window) and (spelled or last or is_odd(window)):
                    best = max(best, self.window_weight(window, first, last, last and ends))
        return best

    def window_weight(self, window: str, first: bool, last: bool, tail: bool) -> float:
        """piece_weight() of a window: words that one of its borders cuts count in the window that has them whole."""
        words = window_words(window, self.costs, first, last)
        more = tail_words(window, self.costs)[-1:] if tail else []
        best = self.weight_of(words + more)
        if not best:
            best = self.weight_of([v for w in words + more if DOUBLED.search(w) for v in WORD.findall(restore(w, self.costs))])
        return best

    def evidence(self, text: str, cache: dict[str, float]) -> float:
        total = 0.0
        for t in text_tokens(text) if text else ():
            w = cache.get(t)
            if w is None:
                w = cache[t] = self.token_weight(t)
            if w:
                total += w
        return total

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.offset + self.slope * min(evidence, 12.0)))))


def fold(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; rows of fold 0 are held out."""
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(folds))


def labelled_sample(df: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, most: int = SAMPLE) -> DataFrame:
    """id, label, text of at most `most` labelled rows outside fold 0, those of the smallest hash of their id; written to the shared folder."""
    named = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label"))
    named = named.where(fold(F.col("id")) != 0)
    named = named.join(df.select(F.col(id_col).cast("long").alias("id")), "id", "left_semi")
    chosen = named.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return write_table(texts.join(F.broadcast(chosen), "id").select("id", "label", "text"))


def learned_words(token: str, costs: np.ndarray) -> list[str]:
    """Words that a token of a labelled text gives, restored where they are suspicious."""
    short = normal(token)
    if len(short) <= LONG:
        return restored_words(short, costs) + tail_words(short, costs)
    out = []
    for piece in [short] if " " in short else HARD.split(short):
        if len(piece) <= LONG:
            out += words_of(piece, costs) if " " not in short else []
        elif is_odd(piece):
            out += [w for window, first, last in windows(piece) for w in window_words(window, costs, first, last)]
        else:
            out += WORD.findall(piece)
    return out


def near_copy_key(text: str) -> int:
    """Smallest hash of the text's runs of three words: near copies mostly share it, other texts do not."""
    w = text.split()
    return min((xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0) >> 1


def wilson(k: np.ndarray, n: np.ndarray, z: float = 2.0) -> np.ndarray:
    """Lower bound of a share."""
    p = k / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Offset and slope of a logistic curve, by Newton steps with a weak prior."""
    if not len(y):
        return -20.0, 0.0
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(y - p).sum() - 1e-3 * a, ((y - p) * x).sum() - 1e-3 * b])
        w = p * (1 - p) + 1e-9
        h = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", most: int = SAMPLE) -> ToxicityModel:
    """The character model over all of df; word weights and curve from the labelled sample."""
    model = ToxicityModel(character_costs(character_counts(df, text_col)))
    sample = labelled_sample(df, labels, label, id_col, text_col, most)
    spark = df.sparkSession
    shipped = spark.sparkContext.broadcast(model.costs)

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([near_copy_key(t) for t in batch.column(2).to_pylist()], pa.int64())], ["id", "key"])

    one = map_batches(sample, keyed, "id long, key long").groupBy("key").agg(F.min("id").alias("id")).select("id").distinct()
    sample_one = write_table(sample.join(F.broadcast(one), "id", "left_semi"))  # bounded by the sample

    def counted(known: frozenset[str] | None):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            n: Counter[str] = Counter()
            for text in batch.column(2).to_pylist():
                own = {f for t in text_tokens(text) for w in learned_words(t, shipped.value) for f in word_features(w)}
                n.update(own if known is None else known & own)
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["f", "n"])

        return run

    toxic = map_batches(sample_one.where("label = 1"), counted(None), "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS)
    toxic_n = {r[0]: r[1] for r in toxic.orderBy("f").collect()}  # bounded by the sample's words
    clean = map_batches(sample_one.where("label <> 1"), counted(frozenset(toxic_n)), "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
    clean_n = {r[0]: r[1] for r in clean.collect()}
    if toxic_n:
        names = list(toxic_n)
        t, c = np.array([toxic_n[f] for f in names], float), np.array([clean_n.get(f, 0) for f in names], float)
        bound = wilson(t, t + c)
        model.weights = {f: float(math.log(b / (1 - b)) + 1.0) for f, b in zip(names, bound, strict=True) if b >= LEAST_SHARE}
    held = spark.sparkContext.broadcast(model)

    def evidence(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache: dict[str, float] = {}
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array([held.value.evidence(t, cache) for t in batch.column(2).to_pylist()], pa.float64())], ["label", "x"])

    seen = map_batches(sample_one, evidence, "label int, x double").toArrow()  # two numbers a row of the sample
    model.offset, model.slope = fit_curve(np.minimum(seen.column("x").to_numpy(), 12.0), (seen.column("label").to_numpy() == 1).astype(float))
    drop_table(sample)
    drop_table(sample_one)
    return model


# -- scoring ------------------------------------------------------------------------------------------------------

_CACHES: dict[str, dict[str, float]] = {}


def worker_cache(key: str) -> dict[str, float]:
    """Weights of tokens that this worker has met under one model; bounded."""
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = {}
    if len(_CACHES[key]) > CACHED:
        _CACHES[key].clear()
    return _CACHES[key]


def score_toxicity(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, evidence (sum of weights) and score (0 to 1)."""
    held, key = _shipped(df, model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for t in batch.column(1).to_pylist():
            found.append(held.value.evidence(t or "", worker_cache(key)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array([held.value.score(x) for x in found], pa.float64())], ["id", "evidence", "score"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, evidence double, score double").withColumnRenamed("id", id_col)


def reject_toxic(df: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """df without the rows that score the threshold or more; all columns stay as they are."""
    held, key = _shipped(df, model)
    at = place_of(df, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([held.value.score(held.value.evidence(t or "", worker_cache(key))) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_batches(df, run, df.schema)


def restore_texts(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the restored text: suspicious tokens replaced by what they stand for, blanks between tokens."""
    held, _ = _shipped(df, model)

    def read(token: str) -> str:
        model, short = held.value, normal(token)
        plain = restore(short, model.costs) if is_odd(short) else short
        return max([plain, *tail_readings(short, model.costs)], key=lambda t: model.weight_of(WORD.findall(t)))

    def fixed(text: str) -> str:
        low = SPELLED.sub(lambda m: restore(m[0], held.value.costs), text.lower())
        return " ".join(map(read, low.split()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([fixed(t or "") for t in batch.column(1).to_pylist()], pa.string())], ["id", "restored"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, restored string").withColumnRenamed("id", id_col)


def _shipped(df: DataFrame, model: ToxicityModel):
    key = xxhash.xxh64_hexdigest(repr((sorted(model.weights.items()), model.offset, model.slope, float(model.costs.sum()))))
    return df.sparkSession.sparkContext.broadcast(model), key

"""Operators on texts against brute force, the libraries, and odd inputs."""

import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from brute import brute_contamination, lowered
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestack.llm import decontaminate, licences, pieces, queries, quality, token_counts, toxicity, url_filter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD_TEXTS = [None, "", " ", "\n\n", "É漢😀 ß", "CC BY-NC 4.0 cc by, All Rights RESERVED", "a" * 5000, "same", "same", "General public license " * 40]


def documents(spark, texts):
    """Rows with ids, a repeated row, a null id, and columns whose names clash with results."""
    rows = [(k, t) for k, t in enumerate(texts)] + [(1, texts[1] if len(texts) > 1 else None), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("score", "n_words", "shard", "slot", "labels", "matches", "id", "tag", "part", "key", "fp", "kind"):
        df = df.withColumn(name, F.lit("x"))
    return df, rows


def empty(df):
    return df.where("false")


# -- licences -----------------------------------------------------------------------------------------------------


def test_licence_places_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = "cc by CC-BY general public license all rights reserved the mit apache".split()
    texts = ODD_TEXTS + [rng.choice([" ", ", "]).join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(60)]
    df, rows = documents(spark, texts)
    got = licences.scan_licences(df).collect()
    assert len(got) == len(rows)
    expected = []
    for i, t in rows:
        ws = WORD.findall(lowered(t))
        places = [(label, k) for label, phrase in (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")) for k in range(len(ws)) if ws[k : k + len(phrase.split())] == phrase.split()]
        expected.append((i if i is not None else -1, len(ws), sorted(places)))
    found = [(r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], sorted((m["label"], m["first"]) for m in r["matches"] if m["base"])) for r in got]
    assert sorted(found) == sorted(expected)
    assert licences.scan_licences(empty(df)).count() == 0


def test_licence_templates(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License."), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "Licensed under the Apache License, Version 2.0."), (4, "released under the apache moon")], "doc_id long, text string")
    labels = {r["doc_id"]: {m["label"] for m in r["matches"]} for r in licences.scan_licences(df).collect()}
    assert labels[1] == {"mit"} and {"gpl", "gnu-gpl"} <= labels[2] and labels[3] == {"apache-2.0"} and not labels[4]


def test_licences_without_rare_words_against_brute_force(spark):
    rng = random.Random(8)
    texts = ["Here it is, the MIT License", "redistribution of it in source and binary code with or without modification are"]
    for t in licences.TEMPLATES:
        must = {p for a, n in t.key for p in range(a, a + n)}
        for share in (0.5, 0.6, 0.7, 0.9):
            texts.append("q " + " ".join(w.decode() if p in must or rng.random() < share else "x" for p, w in enumerate(t.words)) + " z")
    # Frequencies that make the words beside the mandatory ones the rarest: they must not decide what is found.
    frequency = {t.words[p]: 9 for t in licences.TEMPLATES for a, n in t.key for p in range(a, a + n)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for given in (None, frequency, {}):
        for r in licences.scan_licences(df, frequency=given).collect():
            ws, expected = WORD.findall(lowered(texts[r["doc_id"]])), []
            for t in licences.TEMPLATES:
                tw = [w.decode() for w in t.words]
                for start in range(-len(tw), len(ws)):
                    at = [0 <= start + p < len(ws) and ws[start + p] == w for p, w in enumerate(tw)]
                    if all(at[p] for a, n in t.key for p in range(a, a + n)) and sum(at) >= licences.COVERAGE * len(tw):
                        expected.append((start, t.label, len(tw)))
            assert [(m["first"], m["label"], m["words"]) for m in r["matches"]] == sorted(expected), texts[r["doc_id"]]
    assert "mit" in {m["label"] for m in licences.scan_licences(df.where("doc_id = 0"), frequency={}).first()["matches"]}


# -- decontamination ------------------------------------------------------------------------------------------------


def test_contamination_against_brute_force(spark):
    rng = random.Random(2)
    letters = "a b c".split()
    items = [(k, " ".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 13, 14, 20])))) for k in range(12)] + [(99, None), (100, "É x"), (10, "A, b.")]
    texts = ODD_TEXTS + ["é X É x y", *(" ".join(rng.choice(letters) for _ in range(rng.randrange(50))) + " " + rng.choice(items)[1] if rng.random() < 0.5 else "b" for _ in range(0))]
    texts += [" ".join([rng.choice(letters) for _ in range(rng.randrange(40))] + (items[rng.randrange(12)][1] or "").split()) for _ in range(60)]
    df, rows = documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(df, bench).collect()
    key = lambda i: -1 if i is None else i
    assert sorted((key(r["doc_id"]), r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in got) == sorted((key(i), *(tuple(x) if isinstance(x, list) else x for x in brute_contamination(t, items))) for i, t in rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, t in rows:
        for s in by_id[i]["spans"] if i is not None else ():
            assert len(WORD.findall(lowered(t[s["start"] : s["end"]]))) == s["end_word"] - s["first_word"]
    kept = decontaminate.remove_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not (h and 20 * h >= n) for n, h, _ in (brute_contamination(t, items) for _, t in rows))
    assert decontaminate.find_contamination(df, empty(bench)).where("n_hit > 0").count() == 0 == decontaminate.find_contamination(empty(df), bench).count()
    # A benchmark dealt to many parts gives what one automaton gives.
    for most in (60, 15):
        parts = decontaminate.find_contamination(df, bench, most_words=most)
        assert sorted(map(repr, parts.collect())) == sorted(map(repr, got))
    assert decontaminate.remove_contaminated(df, bench, most_words=20).exceptAll(kept).count() == 0 == kept.exceptAll(decontaminate.remove_contaminated(df, bench, most_words=20)).count()


def test_long_items_are_cut_without_losing_windows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE", 20)
    rng = random.Random(12)
    long = " ".join(rng.choice("a b c d e f g h".split()) for _ in range(150))
    items, ws = [(1, long), (2, "x " + long[:60])], long.split()
    texts = [" ".join(["z", *ws[a : a + n], "z"]) for a, n in [(k, 13) for k in range(0, 137, 5)] + [(3, 12), (20, 60), (0, 150)]]
    df, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (1 << 20, 50):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate.find_contamination(df, bench, most_words=most).collect()}
        assert got == {k: brute_contamination(t, items) for k, t in enumerate(texts)}


# -- tokens and pieces ------------------------------------------------------------------------------------------------

TRICKY = [*ODD_TEXTS, "it's they'll  \n\n x\r\n", "x<|endoftext|>y", "a\x1cb\x85c", "²³ µ ª 12½", "  lead", "tail  ", "a▁b", "𝔘𝔫𝔦", "Привет λόγος", "\ufeffx", "ﬁ" * 3]


def test_token_counts_equal_the_library(spark):
    df, rows = documents(spark, TRICKY)
    lib = Tokenizer.from_file(BPE)
    key = lambda i: -1 if i is None else i
    expected = sorted((key(i), len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert sorted((key(r[0]), r[1], r[2]) for r in token_counts.count_tokens(df, BPE).collect()) == expected
    assert token_counts.count_tokens(empty(df), BPE).count() == 0


def test_pieces_equal_the_library_in_chunks(spark):
    rng = random.Random(4)
    long = ["".join(rng.choice(["ab", " ", "  ", "\n", "thing", "漢", "é", "1.0", "😀"]) for _ in range(400)), "nospace" * 60, " ".join(["word"] * 200), " " * 150, "x"]
    df, rows = documents(spark, TRICKY + long)
    lib = sentencepiece.SentencePieceProcessor(model_file=SP)
    key = lambda i: -1 if i is None else i
    out = pieces.decode(pieces.encode(df, SP, giant=100, chunk=40), SP)
    assert sorted((key(r["doc_id"]), tuple(r["token_ids"])) for r in out.collect()) == sorted((key(i), tuple(lib.encode(t or ""))) for i, t in rows)
    for fan in (2, 3):
        again = pieces.encode(df, SP, giant=100, chunk=40, fan=fan, decoded_to="decoded")
        assert sorted(map(repr, again.collect())) == sorted(map(repr, out.collect()))
    texts = dict(rows)
    for r in out.collect():
        if r["doc_id"] is not None and "▁" not in (texts[r["doc_id"]] or ""):
            assert r["decoded"] == lib.decode(list(r["token_ids"]))
    assert set(df.columns) <= set(out.columns) and pieces.encode(empty(df), SP).count() == 0


def test_max_plus_products_are_associative():
    enc = pieces.Encoder.get(SP)
    text = enc.marked("some words and unbrokenunbrokenunbrokenunbrokenunbrokenunbroken text, then more of it")
    cuts = [0, 33, 66, len(text)]
    a, b, c = (pieces.transfer(enc, text, x, y) for x, y in zip(cuts, cuts[1:], strict=False))
    assert pieces.combine(pieces.combine(a, b), c) == pieces.combine(a, pieces.combine(b, c))


# -- toxicity and quality ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    words = [a + b for a in ("ta", "mi", "ro", "len", "sor") for b in ("ka", "dor", "ment", "is", "ula", "ne")]
    rows, labels = [], []
    for k in range(900):
        toxic, poor = k % 5 == 0, k % 7 == 0
        ws = [rng.choice(words) for _ in range(60)]
        if toxic:
            ws[rng.randrange(60)] = rng.choice(["vorgat", "snilfer"])
        text = " ".join(w + "###" if poor else w for w in ws)
        rows.append((k, text))
        labels.append((k, int(not poor), int(toxic)))
    labels += [(1, None, None), (None, 1, 1), (5000, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_restores_and_holds_out(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit_toxicity(docs, labels)
    for t, w in (("v0rg@t", "vorgat"), ("s.n.i.l.f.e.r", "snilfer"), ("vorrrgat", "vorgat"), ("sn1lf3r", "snilfer"), ("v o r g a t", "vorgat")):
        assert toxicity.restored_words(t, model.costs) == [w]
    assert model.token_weight("voorgat") > 0 == model.token_weight("taakka")
    held = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where(toxicity.fold(F.col("doc_id")) == 0).collect()
    assert len(held) > 100 and sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in held) / len(held) > 0.95
    odd, rows = documents(spark, ODD_TEXTS + ["ta ka v0rgat mi"])
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(odd, model).collect()}
    assert scores[len(ODD_TEXTS)] > 0.5 > max(s for i, s in scores.items() if i != len(ODD_TEXTS)) and scores[0] == scores[1]
    kept = toxicity.reject_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(rows) - 1
    assert toxicity.score_toxicity(empty(odd), model).count() == 0
    nothing = toxicity.fit_toxicity(docs, empty(labels))
    assert toxicity.score_toxicity(docs, nothing).where("score >= 0.5").count() == 0
    assert toxicity.restore_texts(odd.where(f"doc_id = {len(ODD_TEXTS)}"), model).first()["restored"] == "ta ka vorgat mi"


def test_toxicity_reads_leet_at_a_tokens_end(spark):
    words = [a + b for a in ("ta", "mi", "ro", "len", "sor") for b in ("ka", "dor", "ment", "is", "ula", "ne")]
    rng, bad, rows, labels = random.Random(9), ["kill", "ass", "idiot", "dumb", "hate", "scums"], [], []
    for k in range(600):
        toxic = k % 3 == 0
        rows.append((k, " ".join([rng.choice(words) for _ in range(30)] + ([bad[k // 3 % 6]] if toxic else []))))
        labels.append((k, 1, int(toxic)))
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    hidden = ["ki11", "a$$", "as5", "idi07", "dum8", "hat3", "scum5", "ki11.", "a$$!", "(a$$)", "dum8!!", "ki1111", "k1ll", "ass!"]
    assert [t for t in hidden if model.token_weight(t) <= 0] == []
    assert [t for t in ("taka1", "taka!", "mine.", "rone5", "2024", "ta-5", "$5", "!", "x1") if model.token_weight(t) > 0] == []
    df = spark.createDataFrame([(k, f"taka {t} mine") for k, t in enumerate(hidden)] + [(99, "taka! mine2 rone.")], "doc_id long, text string")
    assert [r["doc_id"] for r in toxicity.reject_toxic(df, model).collect()] == [99]
    assert toxicity.restore_texts(df.where("doc_id IN (0, 99)"), model).orderBy("doc_id").toPandas()["restored"].tolist() == ["taka kill mine", "taka! mine2 rone."]


def test_quality_separates_and_draws(spark, labelled):
    docs, labels = labelled
    model = quality.fit_quality(docs, labels)
    scored = quality.resample(docs, model, 0.3)
    rows = scored.join(labels, "doc_id").where(quality.fold(F.col("doc_id")) == 0).collect()
    assert sum(r["keep"] == (r["quality"] == 1) for r in rows) / len(rows) > 0.95
    every = sorted((r["gumbel_key"] for r in scored.collect()), reverse=True)
    assert sorted((r["gumbel_key"] for r in scored.where("selected").collect()), reverse=True) == every[: int(0.3 * 900)]
    for k in (0, 1, 450, 900, 2000):
        assert quality.gumbel_top_k(scored.drop("selected"), k, held=20).where("selected").count() == min(k, 900)
    odd, n = documents(spark, ODD_TEXTS)
    assert quality.score_quality(odd, model).count() == len(n) and quality.reject_poor(odd, model).columns == odd.columns
    assert {r["keep"] for r in quality.score_quality(odd, model).where("doc_id IN (0, 1)").collect()} == {True}
    assert quality.fit_quality(docs, empty(labels)).score(0, 0.0) > 0.5
    assert quality.resample(empty(odd), model).count() == 0


def test_quality_draws_by_the_importance_weight(spark, labelled):
    docs, labels = labelled
    model = quality.fit_quality(docs, labels)
    noise = quality.QualityModel(model.ratio * 0)  # all weights are 0, so its keys are the noise
    plain = {r["doc_id"]: r["gumbel_key"] for r in quality.score_quality(docs, noise).collect()}
    for r in quality.score_quality(docs, model).collect():
        assert r["gumbel_key"] == pytest.approx(r["log_weight"] + plain[r["doc_id"]])


# -- URLs ---------------------------------------------------------------------------------------------------------


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = lowered(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow"


def test_urls_against_brute_force(spark):
    rng = random.Random(6)
    rules = [*queries.URL_RULES, ("a.example.net", "/en/x", "block"), ("c", "/", "block"), ("b.c", "/d/", "allow"), ("b.c", "", "block")]
    hosts = ["example.net", "A.example.net", "x.a.example.net", "notexample.net", "example.com", "q.example.com", "org", "fr.org", "b.c", "c", "a.b.c", "net", "net.", "", "b.c:80"]
    urls = [None, "", "no scheme", "http://", "://net/x", "x://net?/en/"] + [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/x?y', '/de/#t', '/fr/z', '/d/', '?q=://net/'])}" for _ in range(300)]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)] + [(3, "http://", "x"), (None, "http://net/", "x")], "page_id long, url string, host string")
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_filter.judge_urls(df, r).collect()
    assert len(got) == len(urls) + 2
    for row in got:
        assert tuple(row)[1:] == brute_url(urls[row["page_id"]] if row["page_id"] is not None else "http://net/", rules)
    assert url_filter.judge_urls(empty(df), r).count() == 0
    assert url_filter.judge_urls(df, empty(r)).where("rule IS NOT NULL").count() == 0


def test_digest_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r["doc_id"]: r for r in queries.op6_decontamination(spark, str(tmp_path)).collect()}
    assert rows[1]["contaminated"] and rows[1]["items_sha256"] == hashlib.sha256(b"7").hexdigest()
    assert not rows[2]["contaminated"] and rows[2]["items_sha256"] == hashlib.sha256(b"").hexdigest()


# -- toxicity: the decoder ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def letters():
    """A character model of a few words, counted one by one."""
    counts = np.zeros(27**4)
    for w in "the and this number water fuck shit hello never kill idiot hate people nowhere would could".split():
        symbols = [0, 0, 0, *(toxicity.SYMBOL[c] for c in w), 0]
        for k in range(3, len(symbols)):
            a, b, c = symbols[k - 3 : k]
            b *= c > 0
            a *= b > 0
            counts[((a * 27 + b) * 27 + c) * 27 + symbols[k]] += 50
    return toxicity.character_costs(counts)


def all_paths(token, costs, letters_from=None):
    """Texts of the least cost over all paths of a token's lattice."""
    least, texts = math.inf, set()
    for path in itertools.product(*(toxicity.arcs_of(token, k, letters_from) for k in range(len(token)))):
        context, cost = 0, 0.0
        for symbol, _, own in path:
            cost += own
            if symbol == 0:
                cost, context = cost + (float(costs[context, 0]) if context else 0.0), 0
            elif symbol > 0:
                cost, context = cost + float(costs[context, symbol]), context % 729 * 27 + symbol
        cost += float(costs[context, 0]) if context else 0.0
        text = "".join(w for _, w, _ in path)
        if cost < least - 1e-6:
            least, texts = cost, {text}
        elif cost < least + 1e-6:
            texts.add(text)
    return texts


def test_decoder_finds_the_least_of_all_paths(letters):
    rng, tried = random.Random(1), 0
    for _ in range(300):
        token = "".join(rng.choice("abehiklostu0134$!.-_*sse") for _ in range(rng.randrange(1, 9)))
        if token.count("*") <= 2:
            tried += 1
            assert toxicity.restore(token, letters) in all_paths(token, letters), token
            assert toxicity.restore(token, letters, 1) in all_paths(token, letters, 1), token
    assert tried > 200
    # Many masks take the step over all states at once, and must come out like few.
    states = {0: (0.0, "")}
    token = "f***k"
    for k in range(len(token)):
        arcs, best = toxicity.arcs_of(token, k), {}
        for context, (cost, text) in states.items():
            for symbol, written, own in arcs:
                to, c = (context, cost + own) if symbol < 0 else (0, cost + own + (float(letters[context, 0]) if context else 0.0)) if symbol == 0 else (context % 729 * 27 + symbol, cost + own + float(letters[context, symbol]))
                if to not in best or (c, text + written) < best[to]:
                    best[to] = c, text + written
        states = best
    least = min((c + (float(letters[x, 0]) if x else 0.0), t) for x, (c, t) in states.items())
    assert toxicity.restore(token, letters) == least[1]


def test_weights_are_found_by_classes_alone(letters):
    """What the classes rule out has no weight under any reading."""
    model = toxicity.ToxicityModel(letters, {"fuck$": 3.0, "shit$": 2.0, "idio": 2.0, "kill$": 1.0})
    rng = random.Random(2)
    for _ in range(400):
        token = "".join(rng.choice("abcdfhiklotu0137$!.-_s") for _ in range(rng.randrange(1, 12)))
        if not model.may_weigh(toxicity.normal(token).replace(" ", "")):
            assert model.piece_weight(token) == 0.0, token
    for token, w in (("f.u.c.k", 3), ("f*ck", 3), ("sh1t", 2), ("5h!t", 2), ("ki11", 1), ("fuuuuuuck", 3), ("f.....u", 0), ("f.....u.....c.....k", 3), ("f----u----c----k", 3), ("1" * 300 + "fuck", 3), ("a1" * 500 + ",fuck," + "b2" * 400, 3), ("x" * 200 + "-" * 9 + "sh1t", 2), ("number", 0)):
        assert model.token_weight(token) == w, token


def test_counts_in_a_token_change_no_weight(letters):
    """Stars, characters and repeated marks beside a word: one more is no border."""
    model = toxicity.ToxicityModel(letters, {"fuck$": 3.0, "idiot$": 3.0})
    weigh = model.token_weight
    for n in (1, 2, 3, 4, 5, 6, 9):
        assert weigh("/".join(["f*ck"] * n)) == weigh("-".join(["f*ck", *["wa*er"] * (n - 1)])) == 3.0, n
        assert weigh(("." * n).join("fuck")) == weigh(("-" * n).join("idiot")) == 3.0, n
    for mark in "_.~":
        for n in range(110, 150):
            filler = f"8{mark}" * n
            assert weigh(filler[: n - 5] + mark + "fuck"[:2] + "ck") == weigh(filler[:40] + mark + "fuck"), (mark, n)
            assert weigh((filler[: n - 6] + mark + "fucK0").lower()) == weigh((filler[:20] + mark + "fucK0").lower()), (mark, n)
    long = "water" * 40
    assert weigh(long + "/f*ck") == weigh(long + ".f.u.c.k") == weigh("f*ck/" + long) == 3.0
    assert toxicity.learned_words(long + "/f*ck", letters)[-1] == "fuck"


def test_stars_are_any_letter_for_the_classes(letters):
    model = toxicity.ToxicityModel(letters, {"fuck$": 3.0, "shit$": 2.0, "kill$": 1.0})
    rng = random.Random(5)
    for _ in range(300):
        token = "".join(rng.choice("fuckshilt*-.1ae*") for _ in range(rng.randrange(3, 9)))
        if token.count("*") <= 3 and not model.may_weigh(token):
            assert model.piece_weight(token) == 0.0, token
    assert model.may_weigh("f**k") and model.may_weigh("*uc*") and not model.may_weigh("w*ter") and not model.may_weigh("****")


def test_decoding_is_linear_in_a_tokens_length(letters):
    model = toxicity.ToxicityModel(letters, {"fuck$": 3.0, "shit$": 2.0, "idio": 2.0})
    rng = random.Random(3)
    n = 100_000
    cases = {"stars": "*" * n, "starred": "word" + "*" * n + "word", "dashes": "a" + "-" * n + "b", "digits": "1" * n, "counting": "1234567890" * (n // 10), "turns": "a***b***" * (n // 8), "masked": "w*t" * (n // 3), "signs": "f*u-" * (n // 4), "spelled": "a " * (n // 2), "dots": "a." * (n // 2), "letters": "fu" * (n // 2), "commas": "a1,b2;" * (n // 6), "blob": "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=5_000_000))}
    for name, text in cases.items():
        began = time.process_time()
        model.evidence(text, {})
        assert time.process_time() - began < (60 if name == "blob" else 5), name


# -- quality: by plain counts -------------------------------------------------------------------------------------


def test_quality_models_against_plain_counts(spark, labelled):
    docs, labels = labelled
    model = quality.fit_quality(docs, labels)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1").join(docs, "doc_id").where(quality.fold(F.col("doc_id")) != 0).collect()}
    bucket = lambda g: (int.from_bytes(g, "big") * 2654435761 & 0xFFFFFFFF) >> 16
    grams = lambda t: [bucket(t[k : k + 4]) for k in range(len(t) - 3)]
    target, raw = Counter(), Counter()
    for i, t in texts.items():
        raw.update(grams(t))
        if i in good:
            target.update(grams(t))
    size, a, b = quality.BUCKETS, sum(target.values()) + quality.BUCKETS, sum(raw.values()) + quality.BUCKETS
    assert size == len(model.ratio)
    for g in list(raw)[:500]:
        assert model.ratio[g] == pytest.approx(math.log((target[g] + 1) / a) - math.log((raw[g] + 1) / b), abs=1e-4)
    scored = quality.score_quality(docs, model).collect()
    for r in scored[:100]:
        weight = sum(float(model.ratio[g]) for g in grams(texts[r["doc_id"]]))
        assert r["log_weight"] == pytest.approx(weight, abs=1e-3) and r["n_grams"] == len(grams(texts[r["doc_id"]]))
    drawn = quality.gumbel_top_k(quality.score_quality(docs, model), 100, held=30).where("selected").collect()
    assert {r["doc_id"] for r in drawn} == {r["doc_id"] for r in sorted(scored, key=lambda r: -r["gumbel_key"])[:100]}


def test_gumbel_top_k_is_exact_under_ties(spark):
    df = spark.createDataFrame([(k, 1.0) for k in range(2000)] + [(5000, 0.5), (5001, 2.0)], "doc_id long, Gumbel_Key double")
    for k, low in ((10, 1.0), (2001, 1.0), (2002, 0.5), (1, 2.0)):
        picked = quality.gumbel_top_k(df, k, held=20).where("selected").collect()
        assert len(picked) == k and min(r[1] for r in picked) == low
    assert quality.gumbel_top_k(df.where("doc_id < 50"), 20, held=5).where("selected").count() == 20
    same = df.withColumn("Selected", F.lit("x"))
    assert quality.gumbel_top_k(same, 3).columns == ["doc_id", "Gumbel_Key", "selected"]


def test_poor_rows_go_by_the_draw(spark, labelled):
    docs, labels = labelled
    model = quality.fit_quality(docs, labels)
    weighed = quality.with_margin(docs, model, "m").collect()
    kept = {r["doc_id"] for r in quality.reject_poor(docs, model).collect()}
    assert len(kept) == sum(r["m"] >= 0 for r in weighed)
    noise = {r["text"]: r["g"] for r in docs.select("text", (-F.log(-F.log((F.shiftrightunsigned(F.xxhash64(F.lit(0), F.col("text")), 11).cast("double") + 0.5) / float(1 << 53)))).alias("g")).collect()}
    assert kept == {r["doc_id"] for r in sorted(weighed, key=lambda r: -(r["m"] + noise[r["text"]]))[: len(kept)]}
    for r in weighed:
        assert (r["m"] >= 0) == (model.score(*model.weight(r["text"].encode())) >= 0.5)


# -- all of them: names, long texts -------------------------------------------------------------------------------


def test_names_in_another_case_and_very_long_texts(spark, labelled):
    docs, labels = labelled
    long = "released under the mit license " + " ".join(f"w{k % 3000}" for k in range(150_000)) + " v0rgat all rights reserved " + "ｘ" * 50_000
    df = spark.createDataFrame([(1, long), (2, "ta ka")], "doc_id long, Text string").withColumn("TOKEN_IDS", F.lit("x")).withColumn("Margin", F.lit(1))
    bad, good = toxicity.fit_toxicity(docs, labels), quality.fit_quality(docs, labels)
    bench = spark.createDataFrame([(9, " ".join(f"w{k}" for k in range(500, 540)))], "item_id long, Text string")
    assert [r["doc_id"] for r in toxicity.reject_toxic(df, bad).collect()] == [2]
    assert quality.reject_poor(df, good).columns == df.columns
    assert [r["doc_id"] for r in decontaminate.remove_contaminated(df, bench).collect()] == [1, 2]
    hit = decontaminate.find_contamination(df, bench).where("doc_id = 1").first()
    assert hit["n_hit"] == 40 * 50 and len(hit["spans"]) == 50 and long[hit["spans"][49]["start"] :].startswith("w500 ")
    found = {r["doc_id"]: {m["label"] for m in r["matches"]} for r in licences.scan_licences(df).collect()}
    assert found == {1: {"mit", "reserved"}, 2: set()}
    counted = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, BPE).collect()}
    assert counted[1] == len(Tokenizer.from_file(BPE).encode(long, add_special_tokens=False).ids)
    out = pieces.encode(df, SP, decoded_to="Margin")
    ids = {r["doc_id"]: (r["token_ids"], r["Margin"]) for r in out.collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=SP)
    assert out.columns == ["doc_id", "Text", "token_ids", "Margin"] and ids[1] == (lib.encode(long), long)


# -- token counts: all scripts, no exchange -----------------------------------------------------------------------


def test_token_counts_of_all_scripts(spark):
    rng = random.Random(14)
    pool = [*"ab 1'\n\t  ", "'s", "\u00a0", "\x1c", "\x85", "\u3000", "\u180e", "漢", "か", "ا", "ש", "é", "😀", "\u200d", "\ufe0f", "Ⅷ", "१", "𝔘", "𐍈", "\U0001e900", "<|endoftext|>", "—", "’", "\ue000", "\u0378", "\u1c8a", "\x00"]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.85 else chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]
    lib = Tokenizer.from_file(BPE)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, BPE).collect()}
    assert got == {k: len(lib.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
    assert "Exchange" not in token_counts.count_tokens(df, BPE, frequent={})._jdf.queryExecution().toString()
    table = token_counts.frequent_lengths(spark.createDataFrame([(k, f"the word {k}") for k in range(300)], "doc_id long, text string"), BPE, most=2)
    assert set(table) == {"the", " word"} and token_counts.frequent_lengths(df.limit(0), BPE) == {}
    curly = ["“" + "it’s — fine " * 20 + "漢字 😀”"] * 50
    _, special = token_counts.tokenizer(BPE)
    assert max(len(p) for p in token_counts.cut(curly[0], special)) < 10, "characters beyond Latin do not send a text to the library whole"


# -- URLs: many paths of one host ---------------------------------------------------------------------------------


def test_very_many_path_rules_of_one_host(spark):
    rng = random.Random(15)
    rules = [("h.com", "/" + "/".join(rng.choice("abcde") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))), rng.choice(["allow", "block"])) for _ in range(400)] + [("h.com", "", "block"), ("com", "/a", "block")]
    urls = [f"http://{rng.choice(['h.com', 'x.h.com', 'o.com'])}/" + "/".join(rng.choice("abcde") * rng.randrange(1, 4) for _ in range(rng.randrange(6))) for _ in range(400)]
    df, r = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")
    least = {}
    for h, p, v in rules:
        least[h, p] = min(v, least.get((h, p), v))
    for row in url_filter.judge_urls(df, r).collect():
        assert tuple(row)[1:] == brute_url(urls[row["page_id"]], [(h, p, v) for (h, p), v in least.items()])
    many = url_filter.HostRules("com.h.", "h.com")
    for p in sorted(f"/{k}/" for k in range(100_000)):
        many.add(p, "block")
    began = time.process_time()
    assert sum(many.best(f"/{k}/x") is not None for k in range(0, 200_000, 10)) == 10_000
    assert time.process_time() - began < 5

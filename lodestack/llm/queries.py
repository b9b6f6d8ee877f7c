"""The queries of the training-data operators, over whole tables with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, fingerprints, licences, max_score, pieces, quality, runs, shards, simhash, token_counts, toxicity, url_filter

#: Fixed values of the URL rules: host, path, verdict.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["first"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("score"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.resample(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shards.deal(docs, shards=8).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(PIECES)
    both = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded_to="decoded")
    return both.select(
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.xxhash64("token_ids").alias("ids_hash"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op11_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_score.search(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0, k=20, scale=64)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text: in a tenth of the documents, by the crc32 of the id, the words from one of them on go round in a period. A null id plants
    nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(F.regexp_replace("text", r"[\x09-\x0D]", " "), " "), "")
    some = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    some = some.withColumn("a", F.expr("g % greatest(n, 1)").cast("int")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)").cast("int"))
    round_trip = F.expr("concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), CAST((n - a) div p + 1 AS int))), 1, n - a))")
    return some.select("doc_id", F.when(F.col("w").isNotNull() & (F.col("n") > 0), F.array_join(round_trip, " ")).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(planted_periods(table(spark, sf_dir, "documents")), length=6, exponent=4)
    steeper = lambda x, y: y["length"] * x["period"] - x["length"] * y["period"]
    order = lambda x, y: F.when(steeper(x, y) != 0, F.signum(steeper(x, y))).when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"])).cast("int")
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.get(F.array_sort("runs", order), F.lit(0)).alias("b"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def licence_sql() -> str:
    """Every place where a template's first mandatory word stands, verified word by word, in SQL: no index and no votes."""
    ts = licences.TEMPLATES
    words = ",".join(f"({k},{p},'{w.decode()}',{any(a <= p < a + n for a, n in t.key)})" for k, t in enumerate(ts) for p, w in enumerate(t.words))
    names = ",".join(f"({k},'{t.label}',{t.base},{len(t.words)},{min(a for a, _ in t.key)})" for k, t in enumerate(ts))
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
tw(t, p, word, is_key) AS (VALUES {words}),
tn(t, label, base, n, first_key) AS (VALUES {names}),
dw AS (SELECT r, unnest(w) AS word, unnest(generate_series(0, len(w) - 1)) AS p FROM d),
hit AS (SELECT r, tw.t, dw.p - tw.p AS start FROM dw JOIN tw USING (word) JOIN tn ON tn.t = tw.t AND tw.p = first_key),
checked AS (SELECT hit.r, hit.t, start, sum((dw.word = tw.word)::INT) AS same, bool_and(NOT is_key OR coalesce(dw.word = tw.word, false)) AS keyed
  FROM hit JOIN tw USING (t) LEFT JOIN dw ON dw.r = hit.r AND dw.p = hit.start + tw.p GROUP BY ALL),
m AS (SELECT r, label, base, start, same / n::DOUBLE AS c FROM checked JOIN tn USING (t) WHERE keyed AND same >= {licences.COVERAGE} * n),
g AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS score FROM m GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN g USING (r)"""


_DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS s
  FROM b, unnest(generate_series(1, greatest(1, len(w) - 12))) AS g(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM d, lens, unnest(generate_series(1, len(w) - n + 1)) AS g(i) WHERE len(w) >= n),
hit AS (SELECT r, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)"""

_URL_SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '\\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '\\A[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') AS net, (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') AS en,
  (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') AS de, (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') AS fr FROM p)
SELECT page_id, host, path, CASE WHEN en THEN 'example.net/en/' WHEN de THEN 'example.com/de/' WHEN fr THEN 'org/fr/' WHEN net THEN 'net/' END AS rule,
  CASE WHEN en OR fr THEN 'allow' WHEN de OR net THEN 'block' ELSE 'allow' END AS verdict FROM r"""

_MAX_SCORE_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, [floor(64 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20"""

#: Every order is walked through document by document group: no subsets, no CUBE.
_FILTER_SQL = """
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM t),
m AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(w) < 200)::INT AS a, (100 * len(list_distinct(w)) < 50 * len(w))::INT AS b,
  (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text))::INT AS c, regexp_matches(text, '[#$%&*|]')::INT AS d, coalesce(doc_id > least, false)::INT AS e
  FROM w JOIN m USING (text) LEFT JOIN l USING (doc_id)),
x AS (SELECT part, good, toxic, [a, b, c, d, e] AS fails, count(*) AS n FROM f GROUP BY ALL),
i(k) AS (VALUES (1), (2), (3), (4), (5)),
p AS (SELECT [p.k, q.k, r.k, s.k, u.k] AS o FROM i p, i q, i r, i s, i u WHERE len(list_distinct([p.k, q.k, r.k, s.k, u.k])) = 5),
st AS (SELECT array_to_string([substr('ABCDE', y, 1) for y in o], '') AS filter_order, k AS step, o[k] AS own, o[1:k-1] AS earlier FROM p, i),
g AS (SELECT part, filter_order, step, own, sum(n * (own_fails = 0 AND before = 0)::INT) AS kept, sum(n * (own_fails = 1 AND before = 0)::INT) AS removed, sum(n * (own_fails = 1 AND before > 0)::INT) AS redundant,
  sum(n * (own_fails = 1 AND every = 1)::INT) AS unique_fails, sum(n * (good AND own_fails = 1 AND before = 0)::INT) AS good_lost, sum(n * (toxic AND own_fails = 1 AND before = 0)::INT) AS toxic_lost
  FROM (SELECT *, fails[own] AS own_fails, coalesce(list_sum([fails[z] for z in earlier]), 0) AS before, list_sum(fails) AS every FROM x, st) GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM g"""


def queries() -> dict:
    return {
        "op1_licences": op1_licences,
        "op2_fingerprints": op2_fingerprints,
        "op3_toxicity": op3_toxicity,
        "op4_quality": op4_quality,
        "op5_shards": op5_shards,
        "op6_decontamination": op6_decontamination,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_url_rules": op8_url_rules,
        "op9_pieces": op9_pieces,
        "op10_token_counts": op10_token_counts,
        "op11_max_score": op11_max_score,
        "op12_filter_audit": op12_filter_audit,
        "op13_runs": op13_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_licences": licence_sql(), "op6_decontamination": _DECONTAMINATION_SQL, "op8_url_rules": _URL_SQL, "op11_max_score": _MAX_SCORE_SQL, "op12_filter_audit": _FILTER_SQL}

"""One query for each operator over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as text_functions
from .functions.canonical import json_string
from .functions.shared import kept
from .operators import calls, contracts, ignore, ledger, lexical, migrations, models, snapshot, structure
from .schemas import LexicalPolicy

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(func):
        QUERIES[name] = func
        if sql:
            SQL[name] = sql
        return func

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- snapshots ----------------------------------------------------------------------------------------------------

PATH_SQL = "concat(source, '/', lang, '/', doc_id::VARCHAR, '.txt')"
ENTRIES_SQL = f"""SELECT doc_id, source, {PATH_SQL} AS path, 'file' AS kind, octet_length(encode(text))::BIGINT AS size_bytes, sha256(text) AS sha256, doc_id % 10 = 0 AS executable,
  CASE WHEN text = '' THEN 'empty' ELSE 'text' END AS content_kind, lang AS language FROM documents"""


def doc_path() -> Column:
    return F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def doc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries; their language column stands for the detected one."""
    raw = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", doc_path().alias("path"))
    files = raw.select("path", F.lit("file").alias("kind"), F.encode("text", "UTF-8").alias("content"), F.when(F.col("doc_id") % 10 == 0, 0o100755).otherwise(0o100644).alias("mode"), F.lit(0).alias("device"), "doc_id", "source", "lang", "text")
    size = F.octet_length("content").cast("long")
    return files.select("doc_id", "source", "path", "kind", size.alias("size_bytes"), F.sha2("content", 256).alias("sha256"), (F.col("mode").bitwiseAND(0o111) != 0).alias("executable"), text_functions.classify_content(size, F.substring("content", 1, 8192)).alias("content_kind"), F.col("lang").alias("language"), "text")


ENTRY_COLUMNS = ["path", "kind", "size_bytes", "sha256", "executable", "content_kind", "language"]


@query("q01_snapshot_entries", f"SELECT * EXCLUDE (doc_id, source) FROM ({ENTRIES_SQL})")
def q01(spark, sf_dir):
    return doc_entries(spark, sf_dir).select(*ENTRY_COLUMNS)


@query("q02_snapshot_totals", f"SELECT source, count(*) AS entry_count, sum(size_bytes)::BIGINT AS total_bytes, count(*) FILTER (kind = 'file') AS regular_file_count FROM ({ENTRIES_SQL}) GROUP BY source")
def q02(spark, sf_dir):
    return snapshot.totals(doc_entries(spark, sf_dir), ["source"])


@query("q03_language_counts", "SELECT source, lang AS language, count(*) AS files FROM documents WHERE lang IS NOT NULL GROUP BY ALL")
def q03(spark, sf_dir):
    return snapshot.language_counts(doc_entries(spark, sf_dir), ["source"])


_ENTRY_JSON = """'{"content_kind":"' || content_kind || '","executable":' || executable::VARCHAR || ',"kind":"file","language":"' || language || '","path":"' || path || '","sha256":"' || sha256 || '","size_bytes":' || size_bytes::VARCHAR || '}'"""


@query("q04_snapshot_fingerprint", f"SELECT source, sha256('[' || string_agg({_ENTRY_JSON}, ',' ORDER BY path) || ']') AS fingerprint FROM ({ENTRIES_SQL}) GROUP BY source")
def q04(spark, sf_dir):
    return snapshot.fingerprints(doc_entries(spark, sf_dir), ["source"])


@query(
    "q05_snapshot_diff",
    f"""WITH e AS ({ENTRIES_SQL}), a AS (SELECT * FROM e WHERE doc_id % 10 <> 0),
b AS (SELECT e.* REPLACE (CASE WHEN e.doc_id % 5 = 0 THEN sha256(d.text || '!') ELSE sha256 END AS sha256, CASE WHEN e.doc_id % 5 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, e.doc_id % 3 = 0 AS executable)
  FROM e JOIN documents d USING (doc_id) WHERE e.doc_id % 7 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.sha256 <> b.sha256 OR a.size_bytes <> b.size_bytes THEN 'modified' ELSE 'metadata_only' END AS change
FROM a FULL JOIN b USING (path) WHERE a.path IS NULL OR b.path IS NULL OR a.sha256 <> b.sha256 OR a.size_bytes <> b.size_bytes OR a.executable <> b.executable""",
)
def q05(spark, sf_dir):
    """Two snapshots as the query's own inputs: one lacks every tenth document, the other every seventh and has edits."""
    e = doc_entries(spark, sf_dir)
    edited = F.col("doc_id") % 5 == 0
    after = e.where(F.col("doc_id") % 7 != 0).withColumn("sha256", F.when(edited, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("sha256"))).withColumn("size_bytes", F.when(edited, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
    return snapshot.compare(e.where(F.col("doc_id") % 10 != 0), after.withColumn("executable", F.col("doc_id") % 3 == 0))


_SUFFIXES = (".py", ".py.bak", ".TS", ".tar.gz", "", ".yml", ".d.ts", ".rs.", "Dockerfile.x")


@query(
    "q06_detect_language",
    """WITH n AS (SELECT p_partkey, 'src/' || CASE WHEN p_partkey % 9 = 8 THEN 'Dockerfile.x' ELSE 'p' || p_partkey || CASE p_partkey % 9 WHEN 0 THEN '.py' WHEN 1 THEN '.py.bak' WHEN 2 THEN '.TS' WHEN 3 THEN '.tar.gz' WHEN 4 THEN '' WHEN 5 THEN '.yml' WHEN 6 THEN '.d.ts' ELSE '.rs.' END END AS path FROM part)
SELECT path, CASE p_partkey % 9 WHEN 0 THEN 'Python' WHEN 1 THEN 'Python' WHEN 2 THEN 'TypeScript' WHEN 5 THEN 'YAML' WHEN 6 THEN 'TypeScript' WHEN 8 THEN 'Dockerfile' END AS language FROM n""",
)
def q06(spark, sf_dir):
    ends = F.get(F.array(*map(F.lit, _SUFFIXES)), (F.col("p_partkey") % 9).cast("int"))
    name = F.when(F.col("p_partkey") % 9 == 8, ends).otherwise(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), ends))
    return read(spark, sf_dir, "part").select(F.concat(F.lit("src/"), name).alias("path")).select("path", text_functions.detect_language(F.col("path")).alias("language"))


IGNORE_SOURCES = {".gitignore": "src1*/\n!src11/\n*7.txt\n!/src0/*/77.txt\nsrc2/de/\n**/5?.txt\n", "src3/.gitignore": "/fr/\n[!1-8]*\n"}


@query(
    "q07_ignore_filter",
    f"""WITH p AS (SELECT {PATH_SQL} AS path, source, lang, doc_id::VARCHAR || '.txt' AS name FROM documents)
SELECT path, (regexp_matches(source, '^src1.*$') AND source <> 'src11') OR (source = 'src2' AND lang = 'de') OR (source = 'src3' AND lang = 'fr')
  OR (source = 'src3' AND NOT regexp_matches(lang, '^[1-8]'))
  OR (CASE WHEN source = 'src3' AND NOT regexp_matches(name, '^[1-8]') THEN true WHEN regexp_matches(name, '^5.\\.txt$') THEN true WHEN source = 'src0' AND name = '77.txt' THEN false ELSE regexp_matches(name, '7\\.txt$') END) AS ignored FROM p""",
)
def q07(spark, sf_dir):
    rules = ignore.compile_rules(IGNORE_SOURCES)
    return read(spark, sf_dir, "documents").select(doc_path().alias("path")).select("path", ignore.is_ignored(rules, F.col("path")).alias("ignored"))


def many_ignore_sources() -> dict[str, str]:
    """65 ignore files with 10,192 rules: names at the root, and for each of 64 folders one pattern, one exception and one folder."""
    own = {f"src{i}/.gitignore": f"*{i % 10}?.txt\n!1*.txt\n/{'en' if i % 4 == 0 else 'none'}/\n" for i in range(64)}
    return {".gitignore": "".join(f"{n}.txt\n" for n in range(0, 70_000, 7)), **own}


@query(
    "q82_many_ignore_rules",
    f"""WITH p AS (SELECT {PATH_SQL} AS path, lang, doc_id, doc_id::VARCHAR || '.txt' AS name, CASE WHEN regexp_matches(source, '^src([0-9]|[1-5][0-9]|6[0-3])$') THEN substr(source, 4)::INT END AS i FROM documents)
SELECT path, coalesce(i % 4 = 0 AND lang = 'en', false) OR CASE WHEN i IS NOT NULL AND name LIKE '1%.txt' THEN false WHEN i IS NOT NULL AND doc_id > 9 AND doc_id // 10 % 10 = i % 10 THEN true
  ELSE doc_id % 7 = 0 AND doc_id < 70000 END AS ignored FROM p""",
)
def q82(spark, sf_dir):
    """All documents' paths under some 10,000 rules, led through the tree of their folders."""
    rules = ignore.compile_rules(many_ignore_sources())
    return read(spark, sf_dir, "documents").select(doc_path().alias("path")).select("path", ignore.is_ignored(rules, F.col("path")).alias("ignored"))


@query("q08_repo_map_lines", f"""SELECT path, '"' || path || '"' || chr(9) || 'file' || chr(9) || content_kind || chr(9) || language || chr(9) || size_bytes || chr(9) || CASE WHEN executable THEN 'x' ELSE '-' END || chr(9) || substr(sha256, 1, 12) AS line FROM ({ENTRIES_SQL})""")
def q08(spark, sf_dir):
    return snapshot.map_lines(doc_entries(spark, sf_dir))


@query("q09_entry_audits", f"SELECT path, 'twice' AS fault FROM ({ENTRIES_SQL}) WHERE doc_id % 8 = 0 UNION ALL SELECT '/' || path, 'invalid' FROM ({ENTRIES_SQL}) WHERE doc_id % 9 = 0")
def q09(spark, sf_dir):
    """A snapshot with some paths twice, and some that are absolute."""
    e = doc_entries(spark, sf_dir)
    broken = e.where("doc_id % 9 = 0").withColumn("path", F.concat(F.lit("/"), "path"))
    e = e.union(e.where("doc_id % 8 = 0")).union(broken).select(*ENTRY_COLUMNS)
    return snapshot.duplicate_paths(e).select("path", F.lit("twice").alias("fault")).union(snapshot.invalid_entries(e).select("path", F.lit("invalid")))


# -- lexical ------------------------------------------------------------------------------------------------------

SMALL = LexicalPolicy(chunk_lines=10, overlap_lines=2, max_chunk_chars=1500, max_chunks=1_000_000, max_file_bytes=20_000)

CHUNKS_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, {PATH_SQL} AS path, sha256(text) AS file_sha256, text, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, i, CASE WHEN i < len(parts) THEN parts[i] || chr(10) ELSE parts[i] END AS line, len(parts) AS n FROM d, unnest(generate_series(1, len(parts))) AS g(i) WHERE i < len(parts) OR parts[i] <> '' OR len(parts) = 1),
c AS (SELECT *, max(i) OVER (PARTITION BY doc_id) AS lines, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i) AS upto, length(line) AS len FROM l),
e AS (SELECT a.doc_id, a.i, a.lines, a.len, max(CASE WHEN b.upto - (a.upto - a.len) <= 1500 THEN b.i END) AS stop FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 9 GROUP BY ALL),
w AS (SELECT doc_id, i, len, stop, lines FROM e WHERE i = 1
  UNION ALL SELECT e.doc_id, e.i, e.len, e.stop, e.lines FROM w JOIN e ON e.doc_id = w.doc_id AND e.i = CASE WHEN w.len > 1500 THEN w.i + 1 ELSE greatest(w.i + 1, w.stop - 2 + 1) END WHERE w.len > 1500 OR w.stop < w.lines),
s AS (SELECT doc_id, i AS start_line, i AS end_line, k AS slice, substr((SELECT line FROM c WHERE c.doc_id = w.doc_id AND c.i = w.i), k * 1500 + 1, 1500) AS content FROM w, unnest(generate_series(0, (len - 1) // 1500)) AS g(k) WHERE len > 1500
  UNION ALL SELECT w.doc_id, w.i, w.stop, 0, string_agg(c.line, '' ORDER BY c.i) FROM w JOIN c ON c.doc_id = w.doc_id AND c.i BETWEEN w.i AND w.stop WHERE w.len <= 1500 GROUP BY w.doc_id, w.i, w.stop),
chunks AS (SELECT path, file_sha256, (row_number() OVER (PARTITION BY doc_id ORDER BY start_line, slice) - 1)::INT AS chunk_index, start_line::INT AS start_line, end_line::INT AS end_line, content FROM s JOIN d USING (doc_id))"""


def doc_texts(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select(doc_path().alias("path"), F.sha2("text", 256).alias("file_sha256"), "text")


@query("q10_chunks", f"{CHUNKS_SQL} SELECT path, chunk_index, start_line, end_line, length(content)::INT AS chars, sha256(content) AS content_sha256 FROM chunks")
def q10(spark, sf_dir):
    return lexical.chunks(doc_texts(spark, sf_dir), SMALL).select("path", "chunk_index", "start_line", "end_line", F.length("content").alias("chars"), F.sha2("content", 256).alias("content_sha256"))


_CHUNK_JSON = """'{"chunk_index":' || chunk_index || ',"content_sha256":"' || sha256(content) || '","end_line":' || end_line || ',"file_sha256":"' || file_sha256 || '","path":"' || path || '","start_line":' || start_line || '}'"""


@query("q11_chunk_ids", f"{CHUNKS_SQL} SELECT path, chunk_index, sha256({_CHUNK_JSON}) AS chunk_id FROM chunks")
def q11(spark, sf_dir):
    return lexical.chunk_ids(lexical.chunks(doc_texts(spark, sf_dir), SMALL)).select("path", "chunk_index", "chunk_id")


TERMS_SQL = f"SELECT doc_id, col, unnest(t) AS term, (unnest(generate_series(0, len(t) - 1)))::INT AS \"offset\" FROM (SELECT doc_id, 'content' AS col, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents UNION ALL SELECT doc_id, 'path', regexp_extract_all(lower({PATH_SQL}), '[\\p{{L}}\\p{{N}}]+') FROM documents)"


def doc_rows(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "source", doc_path().alias("path"), F.col("text").alias("content"), F.lit(0).alias("chunk_index"))


@query("q12_postings", TERMS_SQL)
def q12(spark, sf_dir):
    return lexical.postings(doc_rows(spark, sf_dir), "doc_id")


@query("q13_term_counts", f"SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM ({TERMS_SQL}) GROUP BY term")
def q13(spark, sf_dir):
    return lexical.text_term_counts(doc_rows(spark, sf_dir))


_CONTENT_LINE = "' ' || array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+'), ' ') || ' '"
_PATH_LINE = f"' ' || array_to_string(regexp_extract_all(lower({PATH_SQL}), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' '"


@query("q14_phrase_match", f"SELECT doc_id FROM documents WHERE (contains({_CONTENT_LINE}, ' of the ') OR contains({_PATH_LINE}, ' of the ')) AND (contains({_CONTENT_LINE}, ' en ') OR contains({_PATH_LINE}, ' en '))")
def q14(spark, sf_dir):
    found = lexical.postings(doc_rows(spark, sf_dir), "doc_id")
    return lexical.match_postings(found, lexical.prepare_query("of_the EN"), "doc_id")


def _score_sql(terms: tuple[str, ...], whole: str) -> str:
    content, path = "replace(strip_accents(lower(text)), 'ß', 'ss')", f"lower({PATH_SQL})"
    count = lambda text, t: f"len(list_filter(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+'), lambda x: x = '{t}'))"
    parts = [f"100 * least({count(path, t)}, 5) + 10 * least({count(content, t)}, 20)" for t in terms]
    return " + ".join([*parts, f"CASE WHEN contains({path}, '{whole}') THEN 250 ELSE 0 END", f"CASE WHEN contains({content}, '{whole}') THEN 25 ELSE 0 END"])


@query("q15_ranked_search", f"SELECT {PATH_SQL} AS path, ({_score_sql(('and', 'src1'), 'and src1')})::INT AS score FROM documents WHERE contains({_CONTENT_LINE}, ' and ') AND contains({_PATH_LINE}, ' src1 ') ORDER BY score DESC, path LIMIT 100")
def q15(spark, sf_dir):
    """The best hundred of all matches; the policy's guard is as wide as the table."""
    return lexical.search(doc_rows(spark, sf_dir), "and src1", 100, LexicalPolicy(max_candidates=1 << 30)).select("path", "score")


FILES_SQL = f"SELECT doc_id, source, {PATH_SQL} AS path, octet_length(encode(text))::BIGINT AS size_bytes, CASE WHEN octet_length(encode(text)) > 20000 THEN 'skipped_size' ELSE 'indexed' END AS status, doc_id % 11 = 0 AND octet_length(encode(text)) <= 20000 AS lossy FROM documents"


def doc_files(spark, sf_dir) -> DataFrame:
    size = F.octet_length("text").cast("long")
    files = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", doc_path().alias("path"), size.alias("size_bytes"))
    status = lexical.file_status(SMALL)
    return files.withColumn("status", status).withColumn("lossy", (F.col("doc_id") % 11 == 0) & (F.col("status") == "indexed"))


@query("q16_coverage", f"SELECT source, path, CASE WHEN status = 'skipped_size' THEN 'skipped' ELSE 'lossy' END AS reason FROM ({FILES_SQL}) WHERE status = 'skipped_size' OR lossy")
def q16(spark, sf_dir):
    return lexical.coverage(doc_files(spark, sf_dir), ["source"])


@query(
    "q17_sync_plan",
    f"""WITH f AS (SELECT f.*, sha256(text) AS h, lang FROM ({FILES_SQL}) f JOIN documents USING (doc_id)), a AS (SELECT * FROM f WHERE doc_id % 10 <> 0), b AS (SELECT * REPLACE (CASE WHEN doc_id % 5 = 0 THEN sha256(h) ELSE h END AS h) FROM f WHERE doc_id % 7 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'removed' WHEN a.path IS NULL OR a.h <> b.h THEN 'rebuilt' ELSE 'unchanged' END AS action FROM a FULL JOIN b USING (path)""",
)
def q17(spark, sf_dir):
    f = doc_files(spark, sf_dir).select("doc_id", "path", F.sha2("text", 256).alias("file_sha256"), "size_bytes", F.col("lang").alias("language"), F.lit("text").alias("content_kind"), "status")
    after = f.where(F.col("doc_id") % 7 != 0).withColumn("file_sha256", F.when(F.col("doc_id") % 5 == 0, F.sha2("file_sha256", 256)).otherwise(F.col("file_sha256")))
    return lexical.sync_plan(f.where(F.col("doc_id") % 10 != 0), after)


@query(
    "q18_index_counts",
    f"""{CHUNKS_SQL}, f AS ({FILES_SQL}), n AS (SELECT path, count(*) AS n FROM chunks GROUP BY path)
SELECT source, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'skipped_size') AS skipped, count(*) FILTER (lossy) AS lossy, coalesce(sum(CASE WHEN status = 'indexed' THEN n END), 0)::BIGINT AS chunks FROM f JOIN n USING (path) GROUP BY source""",
)
def q18(spark, sf_dir):
    files = doc_files(spark, sf_dir)
    cut = lexical.chunks(files.where("status = 'indexed'").select("path", F.lit("").alias("file_sha256"), "text"), SMALL)
    counted = files.join(cut.groupBy("path").agg(F.count("*").alias("chunk_count")), "path", "left")
    return lexical.index_counts(counted, ["source"])


def _escape_sql(text: str) -> str:
    """The inside of an ASCII JSON string in SQL, character by character."""
    short = "WHEN c = '\"' THEN '\\\"' WHEN c = '\\' THEN '\\\\' WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' WHEN c = chr(9) THEN '\\t' WHEN c = chr(8) THEN '\\b' WHEN c = chr(12) THEN '\\f'"
    unit = "'\\u' || lpad(lower(to_hex(unicode(c))), 4, '0')"
    pair = "'\\u' || lower(to_hex(55296 + ((unicode(c) - 65536) >> 10))) || '\\u' || lower(to_hex(56320 + ((unicode(c) - 65536) & 1023)))"
    return f"CASE WHEN regexp_matches({text}, '^[ !#-\\[\\]-~]*$') THEN {text} ELSE array_to_string(list_transform(range(1, length({text}) + 1), lambda i: (list_transform([substr({text}, i, 1)], lambda c: CASE {short} WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) > 65535 THEN {pair} ELSE {unit} END))[1]), '') END"


@query(
    "q19_postings_digest",
    f"""WITH lines AS (SELECT doc_id, col, "offset", term, '["' || col || '",' || "offset" || ',"' || {_escape_sql("term")} || '"]' || chr(10) AS line FROM ({TERMS_SQL})),
own AS (SELECT doc_id::VARCHAR AS doc_id, sha256(string_agg(line, '' ORDER BY col, "offset", term)) AS digest FROM lines GROUP BY doc_id)
SELECT source, sha256(string_agg('["' || doc_id || '","' || digest || '"]' || chr(10), '' ORDER BY doc_id)) AS digest FROM own JOIN (SELECT doc_id::VARCHAR AS doc_id, source FROM documents) USING (doc_id) GROUP BY source""",
)
def q19(spark, sf_dir):
    """Digest of all postings of each source, document by document."""
    rows = doc_rows(spark, sf_dir).withColumn("chunk_id", F.col("doc_id").cast("string"))
    return lexical.text_index_digest(rows, ["source"])


@query(
    "q23_postings_digest_whole",
    f"""SELECT source, sha256(string_agg('["' || doc_id || '","' || col || '",' || "offset" || ',"' || {_escape_sql("term")} || '"]' || chr(10), '' ORDER BY doc_id::VARCHAR, col, "offset", term)) AS digest
FROM ({TERMS_SQL}) JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY source""",
)
def q23(spark, sf_dir):
    """Digest of all postings of each source in one order, which one task a source makes from its texts' terms and hashes as they stream by (q19 has no such task)."""
    rows = doc_rows(spark, sf_dir).withColumn("chunk_id", F.col("doc_id").cast("string"))
    return lexical.text_postings_digest(rows, ["source"])


@query("q22_bound_reads", f"SELECT path, sha256(text) AS content_sha256 FROM (SELECT {PATH_SQL} AS path, text FROM documents)")
def q22(spark, sf_dir):
    """Contents bound to a snapshot: each one's hash and size are checked as it is read."""
    e = doc_entries(spark, sf_dir)
    files = read(spark, sf_dir, "documents").select(doc_path().alias("path"), F.encode("text", "UTF-8").alias("content"))
    return snapshot.bound_reads(e, files, 1 << 30).select("path", F.sha2("content", 256).alias("content_sha256"))


@query("q20_orphan_postings", f"SELECT term, count(*) AS n FROM ({TERMS_SQL}) WHERE doc_id % 13 = 0 GROUP BY term")
def q20(spark, sf_dir):
    """Postings against an index that has lost every thirteenth document."""
    rows = doc_rows(spark, sf_dir)
    return lexical.orphan_postings(lexical.postings(rows, "doc_id"), rows.where("doc_id % 13 <> 0"), "doc_id").groupBy("term").agg(F.count("*").alias("n"))


@query("q21_candidate_cap", f"SELECT term, count(DISTINCT doc_id) AS documents, count(DISTINCT doc_id) > 300 AS too_broad FROM ({TERMS_SQL}) GROUP BY term")
def q21(spark, sf_dir):
    counts = lexical.text_term_counts(doc_rows(spark, sf_dir))
    return counts.select("term", "documents", (F.col("documents") > 300).alias("too_broad"))


# -- structure ----------------------------------------------------------------------------------------------------


def part_sources(spark, sf_dir) -> DataFrame:
    """A Python module for each part."""
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    source = F.concat(F.lit("VALUE = "), size, F.lit("\n\n\nclass Part"), k, F.lit("(Base):\n    size: int = "), size, F.lit("\n\n    def m"), size, F.lit("(self, x: int = "), size, F.lit(") -> int:\n        import sys\n        return x\n\n\ndef f"), k, F.lit("():\n    local = 1\n    return local\n"))
    # Modules are made and hashed in many tasks, as the table's few files would leave them to few.
    parts = structure.spread(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    return parts.select(F.concat(F.lit("parts/"), k, F.lit(".py")).alias("path"), F.encode(source, "UTF-8").alias("content")).withColumn("file_sha256", F.sha2("content", 256))


def supplier_sources(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    source = F.concat(F.lit("import n"), k, F.lit(".sub as s\nfrom .. import x, y as z\n\n\ndef g():\n    from mod import a\n"))
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("suppliers/"), k, F.lit(".py")).alias("path"), F.encode(source, "UTF-8").alias("content")).withColumn("file_sha256", F.sha2("content", 256))


def parsed_once(spark: SparkSession, parsed: DataFrame) -> DataFrame:
    """Parsed modules as a written table, where a query reads them more than once."""
    return kept(parsed)


_PART_SYMBOLS = """SELECT p_partkey, 'parts/' || p_partkey || '.py' AS path, kind, name, qualified_name, parent_qualified_name, start_line::INT AS start_line, start_col::INT AS start_col, end_line::INT AS end_line, end_col::INT AS end_col, signature FROM (
SELECT p_partkey, 'variable' AS kind, 'VALUE' AS name, 'VALUE' AS qualified_name, NULL AS parent_qualified_name, 1 AS start_line, 0 AS start_col, 1 AS end_line, 5 AS end_col, NULL AS signature FROM part
UNION ALL SELECT p_partkey, 'class', 'Part' || p_partkey, 'Part' || p_partkey, NULL, 4, 0, 9, 16, 'Part' || p_partkey || '(Base)' FROM part
UNION ALL SELECT p_partkey, 'variable', 'size', 'Part' || p_partkey || '.size', 'Part' || p_partkey, 5, 4, 5, 8, NULL FROM part
UNION ALL SELECT p_partkey, 'method', 'm' || p_size, 'Part' || p_partkey || '.m' || p_size, 'Part' || p_partkey, 7, 4, 9, 16, 'm' || p_size || '(self, x: int = ' || p_size || ') -> int' FROM part
UNION ALL SELECT p_partkey, 'function', 'f' || p_partkey, 'f' || p_partkey, NULL, 12, 0, 14, 16, 'f' || p_partkey || '()' FROM part)"""
_SYMBOL_COLUMNS = ["path", "kind", "name", "qualified_name", "parent_qualified_name", "start_line", "start_col", "end_line", "end_col", "signature"]


@query("q30_structural_status", f"SELECT path, CASE WHEN language <> 'en' THEN 'unsupported_language' WHEN size_bytes > 5000 THEN 'skipped_size' ELSE 'parse' END AS status FROM ({ENTRIES_SQL})")
def q30(spark, sf_dir):
    from .schemas import StructuralPolicy

    e = doc_entries(spark, sf_dir).withColumn("language", F.when(F.col("language") == "en", "Python").otherwise(F.col("language")))
    return e.select("path", structure.file_status(StructuralPolicy(max_file_bytes=5000)).alias("status"))


@query("q31_symbols", f"SELECT * EXCLUDE (p_partkey) FROM ({_PART_SYMBOLS})")
def q31(spark, sf_dir):
    return structure.symbols(structure.parse(part_sources(spark, sf_dir))).select(*_SYMBOL_COLUMNS)


@query(
    "q32_imports",
    """SELECT 'suppliers/' || s_suppkey || '.py' AS path, i.* REPLACE (CASE WHEN kind = 'import' THEN 'n' || s_suppkey || '.sub' ELSE module END AS module, CASE WHEN kind = 'import' THEN 'n' || s_suppkey || '.sub' ELSE name END AS name) FROM supplier,
(VALUES ('import', '', '', 's', 0, NULL, 1, 0, 1), ('from_import', NULL, 'x', NULL, 2, NULL, 2, 0, 2), ('from_import', NULL, 'y', 'z', 2, NULL, 2, 0, 3), ('from_import', 'mod', 'a', NULL, 0, 'g', 6, 4, 4)) AS i(kind, module, name, alias, level, scope_qualified_name, line, col, ordinal)""",
)
def q32(spark, sf_dir):
    return structure.imports(structure.parse(supplier_sources(spark, sf_dir))).select("path", "kind", "module", "name", "alias", "level", "scope_qualified_name", "line", "col", "ordinal")


@query("q33_symbol_lookup", f"SELECT * EXCLUDE (p_partkey) FROM ({_PART_SYMBOLS}) WHERE kind = 'method' AND name = 'm7'")
def q33(spark, sf_dir):
    from .schemas import StructuralPolicy

    rows = structure.symbols(parsed_once(spark, structure.parse(part_sources(spark, sf_dir))))
    return structure.find_symbols(rows, 1 << 30, StructuralPolicy(max_results=1 << 30), kind="method", name="m7").select(*_SYMBOL_COLUMNS)


@query("q34_parent_coherence", "SELECT 'parts/' || p_partkey || '.py' AS path, k.* FROM part, (VALUES ('size'), ('m')) AS k(part_name) WHERE p_partkey % 3 = 0")
def q34(spark, sf_dir):
    """Symbols of modules that have lost their class row, in every third module."""
    rows = structure.symbols(parsed_once(spark, structure.parse(part_sources(spark, sf_dir))))
    lost = (F.col("kind") == "class") & (F.regexp_extract("path", r"(\d+)", 1).cast("long") % 3 == 0)
    return structure.orphan_parents(rows.where(~lost)).select("path", F.regexp_replace("name", r"\d+", "").alias("part_name"))


@query("q35_import_scope_coherence", "SELECT 'suppliers/' || s_suppkey || '.py' AS path, 'mod' AS module FROM supplier WHERE s_suppkey % 2 = 0")
def q35(spark, sf_dir):
    parsed = structure.parse(supplier_sources(spark, sf_dir))
    rows = structure.symbols(parsed).where(F.regexp_extract("path", r"(\d+)", 1).cast("long") % 2 != 0)
    return structure.orphan_scopes(structure.imports(parsed), rows).select("path", "module")


@query("q36_structural_counts", "SELECT 'parts/' || p_partkey || '.py' AS path, 'indexed' AS status, 5 AS symbol_count, 1 AS import_count, NULL::VARCHAR AS error_message FROM part")
def q36(spark, sf_dir):
    return structure.file_reports(structure.parse(part_sources(spark, sf_dir)))


_SYMBOL_ID_SQL = """sha256('{"end_col":' || end_col || ',"end_line":' || end_line || ',"file_sha256":"' || file_sha256 || '","kind":"' || kind || '","ordinal":' || ordinal || ',"path":"' || path || '","qualified_name":"' || qualified_name || '","start_col":' || start_col || ',"start_line":' || start_line || ',"type":"symbol"}')"""
_SOURCE_SQL = """'VALUE = ' || p_size || chr(10) || chr(10) || chr(10) || 'class Part' || p_partkey || '(Base):' || chr(10) || '    size: int = ' || p_size || chr(10) || chr(10) || '    def m' || p_size || '(self, x: int = ' || p_size || ') -> int:' || chr(10) || '        import sys' || chr(10) || '        return x' || chr(10) || chr(10) || chr(10) || 'def f' || p_partkey || '():' || chr(10) || '    local = 1' || chr(10) || '    return local' || chr(10)"""
_STRUCTURE_SQL = f"""src AS (SELECT p_partkey, 'parts/' || p_partkey || '.py' AS path, sha256({_SOURCE_SQL}) AS file_sha256, octet_length(encode({_SOURCE_SQL})) AS size_bytes, 'm' || p_size AS method FROM part),
s0 AS (SELECT s.*, src.file_sha256, row_number() OVER (PARTITION BY s.p_partkey ORDER BY start_line, start_col) AS ordinal FROM ({_PART_SYMBOLS}) s JOIN src USING (p_partkey)),
s1 AS (SELECT *, {_SYMBOL_ID_SQL} AS symbol_id FROM s0),
s2 AS (SELECT s1.*, c.symbol_id AS parent_symbol_id FROM s1 LEFT JOIN s1 c ON c.p_partkey = s1.p_partkey AND c.kind = 'class' AND s1.parent_qualified_name IS NOT NULL),
i0 AS (SELECT src.path, src.file_sha256, m.symbol_id AS scope_symbol_id, m.qualified_name AS scope FROM src JOIN s1 m ON m.p_partkey = src.p_partkey AND m.kind = 'method'),
i1 AS (SELECT *, sha256('{{"alias":null,"col":8,"file_sha256":"' || file_sha256 || '","kind":"import","level":0,"line":8,"module":"sys","name":"sys","ordinal":1,"path":"' || path || '","scope_qualified_name":"' || scope || '","type":"import"}}') AS import_id FROM i0)"""


@query(
    "q37_structure_digest",
    f"""WITH {_STRUCTURE_SQL},
sd AS (SELECT path, sha256('symbols' || chr(10) || string_agg('["' || path || '","' || symbol_id || '","' || file_sha256 || '","' || kind || '","' || name || '","' || qualified_name || '",' || coalesce('"' || parent_symbol_id || '"', 'null') || ',' || coalesce('"' || parent_qualified_name || '"', 'null') || ',' || start_line || ',' || start_col || ',' || end_line || ',' || end_col || ',' || coalesce('"' || signature || '"', 'null') || ',"[]"]' || chr(10), '' ORDER BY start_line, start_col)) AS d FROM s2 GROUP BY path),
id AS (SELECT path, sha256('imports' || chr(10) || '["' || path || '","' || import_id || '","' || file_sha256 || '","import","sys","sys",null,0,"' || scope_symbol_id || '","' || scope || '",8,8,1]' || chr(10)) AS d FROM i1),
fd AS (SELECT path, sha256('files' || chr(10) || '["' || path || '","' || file_sha256 || '",' || size_bytes || ',"Python","text","indexed",5,1,null]' || chr(10)) AS d FROM src),
up AS (SELECT fd.path, sha256('files' || chr(10) || '["' || path || '","' || fd.d || '"]' || chr(10)) AS files_digest, sha256('imports' || chr(10) || '["' || path || '","' || id.d || '"]' || chr(10)) AS imports_digest, sha256('symbols' || chr(10) || '["' || path || '","' || sd.d || '"]' || chr(10)) AS symbols_digest FROM fd JOIN id USING (path) JOIN sd USING (path))
SELECT *, sha256(files_digest || imports_digest || symbols_digest) AS digest FROM up""",
)
def q37(spark, sf_dir):
    """Digests of the three sections, of each module apart."""
    sources = part_sources(spark, sf_dir)
    parsed = parsed_once(spark, structure.parse(sources))
    files = sources.select("path", "file_sha256", F.octet_length("content").cast("long").alias("size_bytes"), F.lit("Python").alias("language"), F.lit("text").alias("content_kind")).join(structure.file_reports(parsed), "path")
    return structure.structure_digests({"files": files, "symbols": structure.symbols(parsed), "imports": structure.imports(parsed)}, ["path"])


# -- ledger -------------------------------------------------------------------------------------------------------


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,6)")


_AMOUNT = "(ceil(value::DECIMAL(18,6) * 1000000))::BIGINT"
_STATUS_SQL = "CASE event_type WHEN 'purchase' THEN 'settled' WHEN 'click' THEN 'active' WHEN 'view' THEN 'cancelled' ELSE 'breached' END"


def event_reservations(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "settled").when(kind == "click", "active").when(kind == "view", "cancelled").otherwise("breached")
    amount = ledger.micros(F.greatest(_money("value"), F.lit(0).cast("decimal(18,6)")), allow_zero=True)
    return read(spark, sf_dir, "events").select("event_id", "user_id", "ts", ledger.period(F.col("ts")).alias("period"), status.alias("status"), amount.alias("reserved_micros"), amount.alias("actual_micros"))


_EVENT_SQL = f"SELECT event_id, user_id, ts, strftime(ts, '%Y-%m') AS period, {_STATUS_SQL} AS status, greatest({_AMOUNT}, 0) AS reserved_micros, greatest({_AMOUNT}, 0) AS actual_micros FROM events"


@query("q40_budget_totals", f"SELECT period, user_id, sum(CASE WHEN status IN ('settled', 'breached') THEN actual_micros ELSE 0 END)::BIGINT AS spent_micros, sum(CASE WHEN status = 'active' THEN reserved_micros ELSE 0 END)::BIGINT AS active_micros FROM ({_EVENT_SQL}) GROUP BY ALL")
def q40(spark, sf_dir):
    return ledger.totals(event_reservations(spark, sf_dir), ["period", "user_id"])


_ORDER_MICROS = "(o_totalprice::DECIMAL(18,6) * 1000000)::BIGINT"
_ORDERS_SQL = f"SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m') AS period, {_ORDER_MICROS} AS amount, o_orderstatus FROM orders"


def order_requests(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", ledger.period(F.col("o_orderdate")).alias("period"), F.col("o_orderkey").alias("seq"), ledger.micros(_money("o_totalprice")).alias("amount"), "o_orderstatus")


@query(
    "q41_budget_available",
    f"""WITH o AS ({_ORDERS_SQL}), t AS (SELECT period, sum(CASE WHEN o_orderstatus = 'F' THEN amount ELSE 0 END)::BIGINT AS spent, sum(CASE WHEN o_orderstatus = 'O' THEN amount ELSE 0 END)::BIGINT AS active FROM o GROUP BY period)
SELECT period, 5000000000000000::BIGINT AS limit_micros, spent AS spent_micros, active AS active_micros, 5000000000000000::BIGINT - spent - active AS available_micros FROM t""",
)
def q41(spark, sf_dir):
    o = order_requests(spark, sf_dir)
    status = F.when(F.col("o_orderstatus") == "F", "settled").when(F.col("o_orderstatus") == "O", "active").otherwise("cancelled")
    held = o.select("period", status.alias("status"), F.col("amount").alias("reserved_micros"), F.col("amount").alias("actual_micros"))
    return ledger.balances(held, o.select("period").distinct().withColumn("limit_micros", F.lit(5_000_000_000_000_000)))


LIMIT = 5_000_000 * 1_000_000
_FOLD_SQL = f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY o_orderkey) AS k FROM ({_ORDERS_SQL})),
w AS (SELECT period, k, o_orderkey AS seq, amount, amount <= {LIMIT} AS accepted, CASE WHEN amount <= {LIMIT} THEN amount ELSE 0 END AS held FROM o WHERE k = 1
  UNION ALL SELECT o.period, o.k, o.o_orderkey, o.amount, w.held + o.amount <= {LIMIT}, w.held + CASE WHEN w.held + o.amount <= {LIMIT} THEN o.amount ELSE 0 END FROM w JOIN o ON o.period = w.period AND o.k = w.k + 1)"""


@query("q42_admission_fold", f"{_FOLD_SQL} SELECT period, seq, amount, accepted, held FROM w")
def q42(spark, sf_dir):
    return ledger.admit(order_requests(spark, sf_dir), LIMIT)


@query("q43_settle_classification", f"SELECT event_id, reserved_micros, actual, CASE WHEN actual > reserved_micros THEN 'breached' ELSE 'settled' END AS status FROM (SELECT event_id, reserved_micros, CASE WHEN event_id % 7 = 0 THEN reserved_micros + 1 ELSE reserved_micros // 2 END AS actual FROM ({_EVENT_SQL}))")
def q43(spark, sf_dir):
    e = event_reservations(spark, sf_dir).select("event_id", "reserved_micros", F.when(F.col("event_id") % 7 == 0, F.col("reserved_micros") + 1).otherwise(F.expr("reserved_micros div 2")).alias("actual"))
    return e.withColumn("status", ledger.settle_status(F.col("reserved_micros"), F.col("actual")))


@query(
    "q44_breach_lock",
    f"""WITH o AS ({_ORDERS_SQL}), b AS (SELECT period, min(o_orderkey) AS first FROM o WHERE o_orderkey % 97 = 0 GROUP BY period)
SELECT period, o_orderkey AS seq, CASE WHEN o_orderkey > first THEN 'locked' ELSE 'accepted' END AS outcome FROM o LEFT JOIN b USING (period)""",
)
def q44(spark, sf_dir):
    """Each order reserves; one whose key is a multiple of 97 is then settled above what it reserved, which locks its period."""
    o = order_requests(spark, sf_dir)
    reserve = o.select("period", (F.col("seq") * 2).alias("seq"), F.lit("reserve").alias("op"), F.col("o_orderkey").cast("string").alias("key"), "amount")
    breach = o.where("o_orderkey % 97 = 0").select("period", (F.col("seq") * 2 + 1).alias("seq"), F.lit("settle").alias("op"), F.col("o_orderkey").cast("string").alias("key"), (F.col("amount") + 1).alias("amount"))
    out = ledger.replay(reserve.union(breach), 1 << 62)
    return out.where("op = 'reserve'").select("period", F.expr("seq div 2").alias("seq"), "outcome")


@query(
    "q45_idempotency_conflicts",
    f"""WITH e AS (SELECT event_id AS seq, user_id AS key, event_type, period FROM (SELECT *, strftime(ts, '%Y-%m') AS period FROM events)), f AS (SELECT *, row_number() OVER w AS n, first_value(event_type) OVER w AS ft, first_value(period) OVER w AS fp FROM e WINDOW w AS (PARTITION BY key ORDER BY seq))
SELECT key, seq, CASE WHEN event_type = ft AND period = fp THEN 'existing' ELSE 'conflict' END AS outcome FROM f WHERE n > 1""",
)
def q45(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "event_type", ledger.period(F.col("ts")).alias("period"))
    return ledger.key_conflicts(e, ["event_type", "period"])


@query(
    "q46_period_policy",
    f"""WITH o AS (SELECT period, o_orderkey AS seq, (o_orderkey % 3 + 1) * 1000000 AS asked FROM ({_ORDERS_SQL})), f AS (SELECT period, min_by(asked, seq) AS limit_micros FROM o GROUP BY period)
SELECT period, limit_micros, count(*) FILTER (asked <> limit_micros) AS mismatches FROM o JOIN f USING (period) GROUP BY ALL""",
)
def q46(spark, sf_dir):
    return ledger.period_policies(order_requests(spark, sf_dir).select("period", "seq", ((F.col("o_orderkey") % 3 + 1) * 1_000_000).alias("limit_micros")))


@query(
    "q47_terminal_audit",
    f"""WITH h AS (SELECT user_id AS key, event_id AS seq, status, lag(status) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM ({_EVENT_SQL}))
SELECT key, seq, before, status FROM h WHERE before IN ('settled', 'cancelled', 'breached') AND status <> before""",
)
def q47(spark, sf_dir):
    return ledger.terminal_changes(event_reservations(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "status"))


# -- calls, models, migrations --------------------------------------------------------------------------------------

_OUTCOME_SQL = "CASE event_id % 6 WHEN 0 THEN 'response' WHEN 1 THEN 'over_quote' WHEN 2 THEN 'not_sent' WHEN 3 THEN 'error' WHEN 4 THEN 'mismatch' END"


@query(
    "q50_call_lifecycle",
    f"""WITH f AS (SELECT user_id AS key, arg_min_null({_OUTCOME_SQL}, event_id) AS o, count(*) - 1 AS refused FROM events GROUP BY user_id)
SELECT key, CASE WHEN o IN ('response', 'over_quote') THEN 'completed' WHEN o = 'not_sent' THEN 'not_sent' WHEN o IN ('error', 'mismatch') THEN 'uncertain' ELSE 'dispatching' END AS call_status,
  CASE o WHEN 'response' THEN 'settled' WHEN 'over_quote' THEN 'breached' WHEN 'not_sent' THEN 'cancelled' ELSE 'active' END AS reservation_status, refused FROM f""",
)
def q50(spark, sf_dir):
    names = F.array(*map(F.lit, ("response", "over_quote", "not_sent", "error", "mismatch")))
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.get(names, (F.col("event_id") % 6).cast("int")).alias("outcome"))
    return calls.fold(e)


_CALL_STATUS_SQL = "CASE event_id % 5 WHEN 0 THEN 'prepared' WHEN 1 THEN 'dispatching' WHEN 2 THEN 'completed' WHEN 3 THEN 'not_sent' ELSE 'uncertain' END"


def _call_status(c: str) -> Column:
    return F.get(F.array(*map(F.lit, ("prepared", "dispatching", "completed", "not_sent", "uncertain"))), (F.col(c) % 5).cast("int"))


@query(
    "q51_transition_audit",
    f"""WITH h AS (SELECT user_id AS key, event_id AS seq, {_CALL_STATUS_SQL} AS status FROM events), l AS (SELECT *, lag(status) OVER (PARTITION BY key ORDER BY seq) AS before FROM h)
SELECT key, seq, before, status FROM l WHERE NOT ((before IS NULL AND status = 'prepared') OR coalesce(before = 'prepared' AND status = 'dispatching', false) OR coalesce(before = 'dispatching' AND status IN ('completed', 'not_sent', 'uncertain'), false))""",
)
def q51(spark, sf_dir):
    return calls.bad_steps(read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), _call_status("event_id").alias("status")))


@query(
    "q52_call_coherence",
    f"""WITH c AS (SELECT event_id AS call_id, event_id AS reservation_id, {_CALL_STATUS_SQL} AS status, event_id % 2 AS provider FROM events),
r AS (SELECT o_orderkey AS reservation_id, o_orderkey % 3 AS p, CASE o_orderstatus WHEN 'F' THEN 'settled' WHEN 'O' THEN 'active' ELSE 'cancelled' END AS held FROM orders)
SELECT call_id, reservation_id, status, held AS held_status, CASE WHEN held IS NULL THEN 'missing' WHEN provider <> p THEN 'identity' ELSE 'status' END AS reason FROM c LEFT JOIN r USING (reservation_id)
WHERE held IS NULL OR provider <> p OR NOT ((status IN ('prepared', 'dispatching', 'uncertain') AND held = 'active') OR (status = 'completed' AND held IN ('settled', 'breached')) OR (status = 'not_sent' AND held = 'cancelled'))""",
)
def q52(spark, sf_dir):
    c = read(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.col("event_id").alias("reservation_id"), F.col("event_id").alias("key"), (F.col("event_id") % 2).alias("provider"), _call_status("event_id").alias("status"))
    held = F.when(F.col("o_orderstatus") == "F", "settled").when(F.col("o_orderstatus") == "O", "active").otherwise("cancelled")
    r = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reservation_id"), F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 3).alias("provider"), held.alias("status"))
    return calls.incoherent(c, r)


@query("q53_request_fingerprint", """SELECT conv_id, turn, sha256('{"input_text":' || to_json(text)::VARCHAR || ',"model":"m","provider":"' || role || '","task_id":"' || conv_id || '"}') AS fingerprint FROM conversations""")
def q53(spark, sf_dir):
    fields = {"task_id": F.col("conv_id").cast("string"), "provider": F.col("role"), "model": F.lit("m"), "input_text": F.col("text")}
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", calls.request_fingerprint(fields).alias("fingerprint"))


@query(
    "q60_chat_body",
    """SELECT conv_id, '{"model":"m","messages":[' || string_agg('{"role":' || to_json(role)::VARCHAR || ',"content":' || to_json(text)::VARCHAR || '}', ',' ORDER BY turn, role, text) || '],"max_tokens":64,"temperature":0.0,"stream":false}' AS body FROM conversations GROUP BY conv_id""",
)
def q60(spark, sf_dir):
    return models.chat_bodies(read(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "m", 64)


@query(
    "q61_usage_validation",
    """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'absent' WHEN event_id % 8 = 1 THEN 'negative' WHEN event_id % 20 < event_id % 8 + event_id % 5 THEN 'too_small' ELSE 'valid' END AS status FROM events""",
)
def q61(spark, sf_dir):
    n = F.col("event_id")
    text = F.format_string('{"usage":{"prompt_tokens":%d,"completion_tokens":%d,"total_tokens":%d}}', F.when(n % 8 == 1, -1).otherwise(n % 8), n % 5, n % 20)
    e = read(spark, sf_dir, "events").select("event_id", F.when(n % 9 == 0, "{}").otherwise(text).alias("payload")).withColumn("u", models.parse_usage(F.col("payload")))
    return e.select("event_id", models.usage_status(F.col("u.prompt_tokens"), F.col("u.completion_tokens"), F.col("u.total_tokens")).alias("status"))


@query(
    "q62_model_list",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN NULL WHEN c_custkey % 4 = 2 THEN '' ELSE c_name || ',' || 'm' || c_custkey END AS ids, CASE WHEN c_custkey % 4 >= 2 THEN 'degraded' ELSE 'ready' END AS health FROM customer""",
)
def q62(spark, sf_dir):
    k = F.col("c_custkey")
    ids = F.when(k % 4 == 3, F.array(F.col("c_name"), F.col("c_name"))).when(k % 4 == 2, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit(" "), F.col("c_name")), F.concat(F.lit("m"), k.cast("string"))))
    body = F.to_json(F.struct(F.transform(ids, lambda i: F.struct(i.alias("id"))).alias("data")))
    rows = read(spark, sf_dir, "customer").select("c_custkey", models.model_ids(body).alias("found"))
    return rows.select("c_custkey", F.array_join("found", ",").alias("ids"), models.health(F.lit(True), F.col("found")).alias("health"))


@query(
    "q63_migration_reconcile",
    """WITH a AS (SELECT n_nationkey + 1 AS v, lpad((n_nationkey + 1)::VARCHAR, 3, '0') || '_a.sql' AS f, n_name AS t FROM nation WHERE n_nationkey % 4 <> 1 AND n_nationkey < 20),
b AS (SELECT n_nationkey + 1 AS v, lpad((n_nationkey + 1)::VARCHAR, 3, '0') || CASE WHEN n_nationkey % 4 = 2 THEN '_b.sql' ELSE '_a.sql' END AS f, n_name || CASE WHEN n_nationkey % 4 = 3 THEN '!' ELSE '' END AS t FROM nation WHERE n_nationkey <> 4)
SELECT coalesce(a.v, b.v)::INT AS version, CASE WHEN b.v IS NULL THEN 'missing' WHEN a.v IS NULL AND b.v < (SELECT max(v) FROM a) THEN 'backfilled' WHEN a.v IS NULL THEN 'pending' WHEN a.f <> b.f THEN 'renamed' WHEN a.t <> b.t THEN 'changed' ELSE 'applied' END AS state FROM a FULL JOIN b ON a.v = b.v""",
)
def q63(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    number = F.lpad((F.col("n_nationkey") + 1).cast("string"), 3, "0")
    applied = n.where("n_nationkey % 4 <> 1 AND n_nationkey < 20").select(F.concat(number, F.lit("_a.sql")).alias("filename"), F.col("n_name").alias("text"))
    found = n.where("n_nationkey <> 4").select(F.concat(number, F.when(F.col("n_nationkey") % 4 == 2, "_b.sql").otherwise("_a.sql")).alias("filename"), F.concat("n_name", F.when(F.col("n_nationkey") % 4 == 3, "!").otherwise("")).alias("text"))
    return migrations.reconcile(migrations.discover(applied), migrations.discover(found))


@query(
    "q64_reference_audit",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 17 <> 0)",
)
def q64(spark, sf_dir):
    """Lines against orders of which every seventeenth has been lost."""
    orders = read(spark, sf_dir, "orders").where("o_orderkey % 17 <> 0")
    return contracts.missing_references(read(spark, sf_dir, "lineitem"), orders, {"l_orderkey": "o_orderkey"}).select("l_orderkey", "l_linenumber")


@query("q65_unproven_passes", "SELECT event_id FROM events WHERE event_type = 'purchase' AND event_id % 4 = 0")
def q65(spark, sf_dir):
    """Purchases as passed results; every fourth has no evidence."""
    status = F.when(F.col("event_type") == "purchase", "passed").otherwise("failed")
    evidence = F.when(F.col("event_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("props"))
    return contracts.unproven_passes(read(spark, sf_dir, "events").select("event_id", status.alias("status"), evidence.alias("evidence"))).select("event_id")


@query(
    "q66_request_contracts",
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'prompt' WHEN conv_id % 5 = 0 THEN 'max_output_tokens' WHEN conv_id % 7 = 0 THEN 'temperature' END AS reason FROM conversations WHERE turn % 3 = 0 OR conv_id % 5 = 0 OR conv_id % 7 = 0""",
)
def q66(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    r = c.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, " \u00a0\n").otherwise("x").alias("prompt"), F.when(F.col("conv_id") % 5 == 0, 0).otherwise(9).alias("max_output_tokens"), F.when(F.col("conv_id") % 7 == 0, 2.5).otherwise(0.5).alias("temperature"), F.create_map(F.lit("k"), F.lit("v")).alias("metadata"))
    return contracts.invalid_requests(r).select("conv_id", "turn", "reason")


@query("q70_json_escapes", f"""SELECT conv_id, turn, sha256('"' || {_escape_sql("text")} || '"') AS json_sha256 FROM conversations""")
def q70(spark, sf_dir):
    """Canonical JSON strings of all texts."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(json_string(F.col("text")), 256).alias("json_sha256"))


@query("q71_json_escapes_whole", "SELECT conv_id, turn, length(text)::INT AS chars, CASE WHEN text IS NOT NULL THEN true END AS reads_back FROM conversations")
def q71(spark, sf_dir):
    """Whether the canonical JSON strings of all texts read back."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    back = F.from_json(F.concat(F.lit('{"v":'), json_string(F.col("text")), F.lit("}")), "v string")["v"]
    return c.select("conv_id", "turn", F.length("text").alias("chars"), F.when(F.col("text").isNotNull(), back.eqNullSafe(F.col("text"))).alias("reads_back"))


def queries() -> dict:
    from . import contract_queries  # noqa: F401  (registers its own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import contract_queries  # noqa: F401

    return dict(SQL)

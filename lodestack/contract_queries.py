"""Queries of the operators that driver_queries leaves out: decoding, escapes, lookups, audits, ledger and call folds, whole indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .driver_queries import SQL, _EVENT_SQL, _PART_SYMBOLS, _STRUCTURE_SQL, _SYMBOL_COLUMNS, CHUNKS_SQL, ENTRIES_SQL, FILES_SQL, PATH_SQL, SMALL, _CONTENT_LINE, _PATH_LINE, _score_sql
from .driver_queries import doc_entries, doc_files, doc_path, doc_rows, doc_texts, event_reservations, order_requests, part_sources, parsed_once, query, read
from .functions.canonical import escaped_path, unescaped_path
from .functions.shared import scratch
from .functions.text import decoded, required
from .operators import calls, contracts, ledger, lexical, models, snapshot, structure
from .plans.index_sync import LexicalIndex, StructuralIndex
from .plans.store import Store
from .schemas import LexicalPolicy, StructuralPolicy
from .streaming.calls import PROVIDER, paid_stream

# -- texts and paths ----------------------------------------------------------------------------------------------


@query(
    "q24_too_broad_searches",
    f"""WITH t AS (SELECT {_CONTENT_LINE} AS c, {_PATH_LINE} AS p FROM documents)
SELECT q AS query, count(*) FILTER (contains(c, ' ' || q || ' ') OR contains(p, ' ' || q || ' ')) > 60 AS refused FROM t, (VALUES ('and'), ('src1'), ('en'), ('unheardof')) AS v(q) GROUP BY q""",
)
def q24(spark, sf_dir):
    """Searches under a small cap of candidates, and which are refused."""
    rows, policy = doc_rows(spark, sf_dir), LexicalPolicy(max_candidates=60)
    first, *more = (lexical.overflows(rows, q, policy) for q in ("and", "src1", "en", "unheardof"))
    for one in more:
        first = first.union(one)
    return first


@query(
    "q25_decoded_texts",
    """SELECT doc_id, sha256(CASE doc_id % 5 WHEN 4 THEN text || chr(65533) ELSE text END) AS text_sha256, doc_id % 5 = 4 AS lossy FROM documents""",
)
def q25(spark, sf_dir):
    """Texts as bytes with and without byte order marks, every fifth with a byte that is no text."""
    k, text = F.col("doc_id") % 5, F.col("text")
    mark = lambda b, enc: F.concat(F.lit(bytearray(b)), F.encode(text, enc))
    payload = F.when(k == 0, F.encode(text, "UTF-8")).when(k == 1, mark(b"\xef\xbb\xbf", "UTF-8")).when(k == 2, mark(b"\xff\xfe", "UTF-16LE")).when(k == 3, mark(b"\x00\x00\xfe\xff", "UTF-32")).otherwise(F.concat(F.encode(text, "UTF-8"), F.lit(bytearray(b"\xe9"))))
    return read(spark, sf_dir, "documents").select("doc_id", decoded(payload).alias("d")).select("doc_id", F.sha2("d.text", 256).alias("text_sha256"), "d.lossy")


@query("q26_line_ends", "SELECT p_partkey AS doc, len(string_split(p_name, ' '))::INT AS lines, length(p_name)::INT AS chars FROM part")
def q26(spark, sf_dir):
    """Names whose blanks are line ends of one kind or another, cut to chunks of a line."""
    ends = F.get(F.array(*map(F.lit, ("\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "))), (F.col("p_partkey") % 10).cast("int"))
    texts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.lit("").alias("file_sha256"), F.expr("p_name").alias("n"), ends.alias("e")).select("doc", "file_sha256", F.expr("replace(n, ' ', e)").alias("text"))
    cut = lexical.chunks(texts, LexicalPolicy(chunk_lines=1, overlap_lines=0), ("doc", "file_sha256"))
    return cut.groupBy("doc").agg(F.count("*").cast("int").alias("lines"), F.sum(F.length("content")).cast("int").alias("chars"))


@query("q27_escaped_paths", f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN chr(31) || 'u' || chr(31) || p ELSE p END AS stored, true AS reads_back FROM (SELECT doc_id, {PATH_SQL} AS p FROM documents)")
def q27(spark, sf_dir):
    path = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("\x1f"), doc_path())).otherwise(doc_path())
    return read(spark, sf_dir, "documents").select("doc_id", path.alias("p")).select("doc_id", escaped_path(F.col("p")).alias("stored"), (unescaped_path(escaped_path(F.col("p"))) == F.col("p")).alias("reads_back"))


@query("q28_normal_fields", f"SELECT doc_id, source || ' ' || lang AS name, sha256(text) AS sha256, lpad(to_hex(doc_id), 8, '0') || '-0000-0000-0000-000000000000' AS uuid FROM documents".replace("to_hex", "lower(to_hex").replace("(doc_id), 8", "(doc_id)), 8"))
def q28(spark, sf_dir):
    """Fields with blanks and capitals around them, in their normal forms."""
    d = read(spark, sf_dir, "documents")
    name = F.concat(F.lit(" \t"), "source", F.lit(" "), "lang", F.lit(" \n"))
    sha = F.concat(F.lit(" "), F.upper(F.sha2("text", 256)), F.lit("\r\n"))
    uid = F.concat(F.lpad(F.hex("doc_id"), 8, "0"), F.lit("-0000-0000-0000-000000000000"))
    return d.select("doc_id", required(name, "name").alias("name"), snapshot.normal_sha256(sha).alias("sha256"), contracts.checked_uuid(uid).alias("uuid"))


@query("q29_corrupt_chunks", f"{CHUNKS_SQL} SELECT path, chunk_index FROM chunks WHERE regexp_extract(path, '(\\d+)\\.txt$', 1)::BIGINT % 13 = 0")
def q29(spark, sf_dir):
    """Chunks that have been altered in every thirteenth document, found by their hashes and ids."""
    cut = lexical.chunk_ids(lexical.chunks(doc_texts(spark, sf_dir), SMALL))
    number = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long")
    turned = cut.withColumn("content", F.when((number % 13 == 0) & (number % 2 == 0), F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    turned = turned.withColumn("chunk_id", F.when((number % 13 == 0) & (number % 2 == 1), F.sha2("chunk_id", 256)).otherwise(F.col("chunk_id")))
    return lexical.corrupt_chunks(parsed_once(spark, turned))


# -- snapshots and plans ------------------------------------------------------------------------------------------


@query("q72_candidates", f"SELECT path, 'lexical' AS index_name FROM ({ENTRIES_SQL}) WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 UNION ALL SELECT path, 'structural' FROM ({ENTRIES_SQL}) WHERE doc_id % 5 <> 0")
def q72(spark, sf_dir):
    """Entries of which some are links and some binary, and which each index takes."""
    e = doc_entries(spark, sf_dir).withColumn("kind", F.when(F.col("doc_id") % 5 == 0, "symlink").otherwise("file")).withColumn("content_kind", F.when(F.col("doc_id") % 7 == 0, "binary").otherwise(F.col("content_kind")))
    return LexicalIndex(None).wanted(e).select("path", F.lit("lexical").alias("index_name")).union(StructuralIndex(None).wanted(e).select("path", F.lit("structural")))


@query("q73_file_set", f"SELECT path, CASE WHEN doc_id % 9 = 0 THEN 'missing' ELSE 'changed' END AS fault FROM ({ENTRIES_SQL}) WHERE doc_id % 9 = 0 OR doc_id % 9 = 1")
def q73(spark, sf_dir):
    """An index' files against the files that are wanted: ninths are missing or of another size."""
    want = doc_files(spark, sf_dir).withColumns({"file_sha256": F.lit("x"), "language": F.lit("x"), "content_kind": F.lit("text")})
    have = want.where("doc_id % 9 <> 0").withColumn("size_bytes", F.when(F.col("doc_id") % 9 == 1, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
    return lexical.file_differences(have, want)


@query("q74_sync_reports", "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 6 = 1 THEN 'removed' ELSE 'rebuilt' END AS action, doc_id % 6 = 1 AS reported FROM documents WHERE doc_id % 6 IN (1, 2)")
def q74(spark, sf_dir):
    """A sync's actions against its reports: one removed path is reported, one rebuilt path is not."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"))
    action = F.when(F.col("doc_id") % 6 <= 1, "removed").when(F.col("doc_id") % 6 == 2, "rebuilt").otherwise("unchanged")
    return lexical.overlapping_actions(d.select("path", action.alias("action")), d.where("doc_id % 6 NOT IN (0, 2)").select("path"))


# -- structure ----------------------------------------------------------------------------------------------------


@query("q38_import_lookup", "SELECT 'parts/' || p_partkey || '.py' AS path, 'sys' AS name, 'Part' || p_partkey || '.m' || p_size AS scope_qualified_name, 8 AS line, 8 AS col FROM part")
def q38(spark, sf_dir):
    """Imports by module."""
    n = 1 << 30
    rows = structure.imports(parsed_once(spark, structure.parse(part_sources(spark, sf_dir))))
    return structure.find_imports(rows, n, StructuralPolicy(max_results=n), module="sys", kind="import").select("path", "name", "scope_qualified_name", "line", "col")


_LOOKUPS = {"class": {"kind": "class"}, "m7": {"name": "m7"}, "size": {"name": "size", "kind": "variable"}, "one": {"path": "parts/1.py"}, "none": {"qualified_name": "absent"}}


@query(
    "q39_overflowing_lookups",
    f"""SELECT w.asked, count(*) FILTER ((w.asked = 'class' AND kind = 'class') OR (w.asked = 'm7' AND name = 'm7') OR (w.asked = 'size' AND name = 'size') OR (w.asked = 'one' AND path = 'parts/1.py')) > 1000 AS refused
FROM ({_PART_SYMBOLS}), (VALUES ('class'), ('m7'), ('size'), ('one'), ('none')) AS w(asked) GROUP BY w.asked""",
)
def q39(spark, sf_dir):
    """Lookups under a limit of 1000 rows, and which of them the library refuses."""
    rows = structure.symbols(parsed_once(spark, structure.parse(part_sources(spark, sf_dir))))
    told = []
    for asked, equal in _LOOKUPS.items():
        try:
            structure.find_symbols(rows, 1000, **equal).write.format("noop").mode("overwrite").save()
            told.append((asked, False))
        except Exception as e:
            if "more than 1000 rows match" not in str(e):
                raise
            told.append((asked, True))
    return spark.createDataFrame(told, "asked string, refused boolean")


@query(
    "q75_parse_failures",
    "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 3 THEN 'indexed' ELSE 'parse_error' END AS status, CASE WHEN s_suppkey % 4 = 3 THEN 6 ELSE 0 END AS symbol_count, CASE WHEN s_suppkey % 4 = 3 THEN 'T,U,W,Vec,g,g.Local' END AS names, s_suppkey % 4 <> 3 AS told FROM supplier",
)
def q75(spark, sf_dir):
    """Modules that do not compile, decode or parse, and one with targets of all kinds."""
    good = "T, [U, *V] = 1, [2]\no.attr = 3\no[0] = 4\nW: int\nfor q in []: pass\nwith x as y: pass\nz += 1\n(w := 3)\nlambda a: a\ntype Vec[T] = list[T]\ndef g(*, k):\n    type Local = int\n    hidden = 1\n"
    bodies = F.array(*(F.lit(bytearray(b)) for b in (b"return 1\n", b"# coding: nothing\nx = 1\n", b"def f(:\n", good.encode())))
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("path"), F.get(bodies, (F.col("s_suppkey") % 4).cast("int")).alias("content")).withColumn("file_sha256", F.sha2("content", 256))
    parsed = structure.parse(s)
    names = F.when(F.size("symbols") > 0, F.array_join(F.transform("symbols", lambda x: x["qualified_name"]), ","))
    return parsed.select(F.col("path").cast("long").alias("s_suppkey"), "status", F.size("symbols").alias("symbol_count"), names.alias("names"), F.col("error_message").isNotNull().alias("told"))


@query(
    "q76_rows_without_a_file",
    """SELECT 'parts/' || p_partkey || '.py' AS path, count(*) FILTER (k = 's') AS symbols, count(*) FILTER (k = 'i') AS imports FROM part, (SELECT unnest(['s', 's', 's', 's', 's', 'i']) AS k) WHERE p_partkey % 10 IN (0, 1) GROUP BY p_partkey""",
)
def q76(spark, sf_dir):
    """Symbols and imports whose file is not indexed, or with another hash, in two of ten modules."""
    sources = part_sources(spark, sf_dir)
    parsed = parsed_once(spark, structure.parse(sources))
    k = F.regexp_extract("path", r"(\d+)", 1).cast("long") % 10
    files = sources.select("path", F.when(k == 0, F.sha2("file_sha256", 256)).otherwise(F.col("file_sha256")).alias("file_sha256"), F.when(k == 1, "parse_error").otherwise("indexed").alias("status"))
    one = structure.unindexed_rows(structure.symbols(parsed), files).select("path", F.lit("s").alias("k"))
    two = structure.unindexed_rows(structure.imports(parsed), files).select("path", F.lit("i").alias("k"))
    return one.union(two).groupBy("path").agg(F.count_if(F.col("k") == "s").alias("symbols"), F.count_if(F.col("k") == "i").alias("imports"))


@query("q77_state_counts", "SELECT count(*) AS file_count, 5 * count(*) AS symbol_count, count(*) AS import_count FROM part")
def q77(spark, sf_dir):
    parsed = parsed_once(spark, structure.parse(part_sources(spark, sf_dir)))
    return structure.state_counts(parsed, structure.symbols(parsed), structure.imports(parsed))


# -- whole indexes ------------------------------------------------------------------------------------------------

WIDE = LexicalPolicy(chunk_lines=1 << 30, overlap_lines=0, max_chunk_chars=1 << 30, max_candidates=1 << 30, max_file_bytes=1 << 30)


def _snapshot_of(spark, docs: DataFrame) -> tuple[DataFrame, str, DataFrame]:
    """Entries of documents as a table, their fingerprint, and their contents, which are read where they are."""
    entries = parsed_once(spark, docs.select("path", "kind", "size_bytes", "sha256", "executable", "content_kind", "language"))
    fp = snapshot.fingerprints(entries.withColumn("_one", F.lit(1)), ["_one"]).first()
    return entries, fp["fingerprint"] if fp else "", docs.select("path", F.encode("text", "UTF-8").alias("content"))


@query("q80_indexed_search", f"SELECT {PATH_SQL} AS path, ({_score_sql(('and', 'src1'), 'and src1')})::INT AS score FROM documents WHERE doc_id % 7 <> 0 AND contains({_CONTENT_LINE}, ' and ') AND contains({_PATH_LINE}, ' src1 ') ORDER BY score DESC, path LIMIT 100")
def q80(spark, sf_dir):
    """Documents are indexed, a seventh of them is taken away and a fifth edited and edited back, and the written index is searched."""
    e = doc_entries(spark, sf_dir)
    index = LexicalIndex(Store(spark, scratch(spark)), WIDE)
    edited = F.col("doc_id") % 5 == 0
    other = e.withColumn("text", F.when(edited, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).withColumn("sha256", F.sha2("text", 256)).withColumn("size_bytes", F.octet_length("text").cast("long"))
    index.sync(*_snapshot_of(spark, other.where("doc_id % 11 <> 0")))
    entries, fp, contents = _snapshot_of(spark, e.where("doc_id % 7 <> 0"))
    index.sync(entries, fp, contents)
    return index.search(fp, "and src1", 100, entries)[0].select("path", "score")


@query("q81_indexed_symbols", f"SELECT * EXCLUDE (p_partkey) FROM ({_PART_SYMBOLS}) WHERE kind = 'method' AND name = 'm7' AND p_partkey % 7 <> 0")
def q81(spark, sf_dir):
    """Modules are indexed, a seventh of them is taken away, and the written index is asked."""
    s = part_sources(spark, sf_dir).select("path", F.lit("file").alias("kind"), F.octet_length("content").cast("long").alias("size_bytes"), F.col("file_sha256").alias("sha256"), F.lit(False).alias("executable"), F.lit("text").alias("content_kind"), F.lit("Python").alias("language"), F.col("content").cast("string").alias("text"))
    index = StructuralIndex(Store(spark, scratch(spark)), StructuralPolicy(max_results=1 << 30))
    index.sync(*_snapshot_of(spark, s))
    entries, fp, contents = _snapshot_of(spark, s.where(F.regexp_extract("path", r"(\d+)", 1).cast("long") % 7 != 0))
    index.sync(entries, fp, contents)
    return index.symbols(fp, 1 << 30, entries, kind="method", name="m7").select(*_SYMBOL_COLUMNS)


# -- ledger and calls ---------------------------------------------------------------------------------------------


@query(
    "q48_closing_fold",
    """WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, o_orderkey AS k FROM orders)
SELECT period, 4 * k AS seq, 'accepted' AS outcome FROM o
UNION ALL SELECT period, 4 * k + 1, CASE k % 4 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'settled' WHEN 2 THEN 'settled' ELSE 'cancelled' END FROM o
UNION ALL SELECT period, 4 * k + 2, CASE k % 4 WHEN 0 THEN 'existing' WHEN 1 THEN 'existing' WHEN 2 THEN 'conflict' ELSE 'conflict' END FROM o
UNION ALL SELECT period, 4 * k + 3, 'conflict' FROM o""",
)
def q48(spark, sf_dir):
    """Each order reserves, is closed, closed again alike or otherwise, and asks for its key again."""
    o = order_requests(spark, sf_dir).select("period", F.col("o_orderkey").alias("k"), "amount")
    case = F.col("k") % 4
    event = lambda n, op, amount: o.select("period", (4 * F.col("k") + n).alias("seq"), op.alias("op"), F.col("k").cast("string").alias("key"), amount.alias("amount"))
    a = F.col("amount")
    every = event(0, F.lit("reserve"), a).union(event(1, F.when(case.isin(0, 3), "cancel").otherwise("settle"), a)).union(event(2, F.when(case.isin(0, 2), "cancel").otherwise("settle"), a)).union(event(3, F.lit("reserve"), a))
    return ledger.replay(every, 1 << 62, totals=False).select("period", "seq", "outcome")


@query(
    "q49_reservation_shapes",
    f"SELECT event_id, status FROM ({_EVENT_SQL}) WHERE (status = 'active' AND event_id % 3 <> 2) OR (status = 'settled' AND event_id % 3 = 1) OR (status = 'breached' AND event_id % 3 <> 1) OR (status = 'cancelled' AND event_id % 3 <> 2)",
)
def q49(spark, sf_dir):
    """Reservations with columns that fit their status, or do not: an actual above the reserved, one equal to it, or none."""
    e = event_reservations(spark, sf_dir)
    k = F.col("event_id") % 3
    actual = F.when((k == 1) | ((k == 0) & (F.col("status") != "settled")), F.col("reserved_micros") + F.when(k == 1, 1).otherwise(0)).when((k == 0) | (F.col("status") == "settled"), F.col("reserved_micros"))
    return ledger.misshapen(e.withColumn("actual_micros", actual).withColumn("closed_at", F.when(F.col("status") != "active", "t"))).select("event_id", "status")


@query(
    "q54_paid_calls",
    """WITH a AS (SELECT strftime(ts, '%Y-%m') AS period, event_id AS seq, user_id || ':' || event_type || ':' || strftime(ts, '%Y-%m') AS key, event_id % 5 AS o FROM events),
f AS (SELECT *, min(CASE WHEN o <> 0 THEN seq END) OVER (PARTITION BY key) AS first FROM a), g AS (SELECT f.*, d.o AS decided FROM f LEFT JOIN a d ON d.seq = f.first)
SELECT seq, key, CASE WHEN first IS NULL OR seq < first THEN 'prepared' WHEN seq = first THEN 'dispatched' WHEN decided IN (1, 2) THEN 'conflict' ELSE 'replay' END AS decision,
  CASE WHEN first IS NULL OR seq < first THEN 'prepared' ELSE CASE decided WHEN 1 THEN 'completed' WHEN 2 THEN 'not_sent' WHEN 3 THEN 'uncertain' ELSE 'dispatching' END END AS call_status,
  CASE WHEN first IS NULL OR seq < first THEN 'active' ELSE CASE decided WHEN 1 THEN 'settled' WHEN 2 THEN 'cancelled' ELSE 'active' END END AS reservation_status FROM g""",
)
def q54(spark, sf_dir):
    """Attempts at paid calls, several for each key: the first that gets past preparing decides, later ones are refused."""
    return calls.paid(_attempts(read(spark, sf_dir, "events")), 1 << 62, totals=False).select("seq", "key", "decision", "call_status", "reservation_status")


def _attempts(e: DataFrame) -> DataFrame:
    period = ledger.period(F.col("ts"))
    outcome = F.get(F.array(*map(F.lit, ("prepared", "response", "not_sent", "error"))), (F.col("event_id") % 5).cast("int"))
    return e.select(period.alias("period"), F.col("event_id").alias("seq"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type", period).alias("key"), *(F.lit(v).alias(c) for c, v in (("provider", "x"), ("model", "m"), ("task", "t"), ("quoted_provider", "x"), ("quoted_model", "m"))), F.lit(5).cast("long").alias("amount"), F.lit("f").alias("request_fingerprint"), outcome.alias("outcome"), F.lit(4).cast("long").alias("actual"))


@query("q83_paid_call_stream", SQL["q54_paid_calls"])
def q83(spark, sf_dir):
    """The attempts of q54 as a stream, to its end: the same outcomes from keyed state, a period's keys in shards."""
    source, before = read(spark, sf_dir, "events"), spark.conf.get(PROVIDER[0], None)
    folder = scratch(spark)
    # A pattern, as a stream's source may be a folder or a pattern but no file.
    events = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parque[t]")
    spark.conf.set(*PROVIDER)
    try:
        found = paid_stream(_attempts(events), 1 << 62, shards=1024).select("seq", "key", "decision", "call_status", "reservation_status")
        found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)
    return spark.read.schema(found.schema).parquet(f"{folder}/out")


@query(
    "q55_keys_across_periods",
    """WITH e AS (SELECT event_id AS seq, user_id::VARCHAR AS key, event_type, strftime(ts, '%Y-%m') AS period FROM events), f AS (SELECT *, row_number() OVER w AS n, first_value(event_type) OVER w AS t, first_value(period) OVER w AS p FROM e WINDOW w AS (PARTITION BY key ORDER BY seq))
SELECT period, seq, key, CASE WHEN n = 1 THEN 'accepted' WHEN event_type = t AND period = p THEN 'existing' ELSE 'conflict' END AS outcome FROM f""",
)
def q55(spark, sf_dir):
    """Requests whose keys come again, in the same and in other periods, with the same and with other parameters."""
    e = read(spark, sf_dir, "events").select(ledger.period(F.col("ts")).alias("period"), F.col("event_id").alias("seq"), F.lit("reserve").alias("op"), F.col("user_id").cast("string").alias("key"), F.lit(1).cast("long").alias("amount"), "event_type")
    return ledger.replay(e, 1 << 62, ["event_type"], totals=False).select("period", "seq", "key", "outcome")


@query(
    "q56_unbound_calls",
    """SELECT event_id AS call_id FROM events WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = event_id AND o_orderstatus = 'O' AND o_orderkey % 2 = event_id % 3 AND o_orderkey % 5 <> 0)""",
)
def q56(spark, sf_dir):
    """Calls that are inserted without an active reservation of the same key, provider and model."""
    c = read(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.col("event_id").alias("reservation_id"), F.col("event_id").alias("key"), (F.col("event_id") % 3).alias("provider"), F.lit("m").alias("model"))
    k = F.col("o_orderkey")
    r = read(spark, sf_dir, "orders").select(k.alias("reservation_id"), k.alias("key"), (k % 2).alias("provider"), F.when(k % 5 == 0, "n").otherwise("m").alias("model"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("settled").alias("status"))
    return calls.unbound(c, r).select("call_id")


@query(
    "q57_unsent_closings",
    """WITH h AS (SELECT user_id AS r, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'prepared' WHEN 1 THEN 'dispatching' ELSE 'completed' END AS s FROM events WHERE event_id % 4 <> 0),
c AS (SELECT user_id AS r, event_id AS seq, CASE event_id % 8 WHEN 0 THEN 'settled' ELSE 'active' END AS s FROM events WHERE event_id % 4 = 0)
SELECT c.r AS reservation_id, c.seq, c.s AS status, arg_max(h.s, h.seq) AS call_status FROM c JOIN h ON h.r = c.r AND h.seq < c.seq WHERE c.s = 'settled' GROUP BY ALL HAVING arg_max(h.s, h.seq) <> 'dispatching'""",
)
def q57(spark, sf_dir):
    """Reservations that were closed while their call was not dispatching."""
    e, n = read(spark, sf_dir, "events"), F.col("event_id")
    history = e.where("event_id % 4 <> 0").select(F.col("user_id").alias("reservation_id"), n.alias("seq"), F.when(n % 3 == 0, "prepared").when(n % 3 == 1, "dispatching").otherwise("completed").alias("status"))
    closings = e.where("event_id % 4 = 0").select(F.col("user_id").alias("reservation_id"), n.alias("seq"), F.when(n % 8 == 0, "settled").otherwise("active").alias("status"))
    return calls.unsent_closings(closings, history)


@query("q58_utc_forms", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((microsecond(ts) % 1000000)::VARCHAR, 6, '0') END || '+00:00' AS stamp, (event_id / 1000000)::DECIMAL(25,6) AS money FROM (SELECT event_id, ts FROM events)""".replace("(event_id / 1000000)::DECIMAL(25,6)", "(event_id // 1000000)::VARCHAR || '.' || lpad((event_id % 1000000)::VARCHAR, 6, '0')"))
def q58(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", ledger.iso_timestamp(F.col("ts")).alias("stamp"), ledger.from_micros(F.col("event_id")).cast("string").alias("money"))


# -- models -------------------------------------------------------------------------------------------------------


@query(
    "q67_completions",
    """SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 AND text IS NOT NULL THEN CASE WHEN turn % 4 = 0 THEN 'given' ELSE 'asked' END END AS model, CASE WHEN turn % 4 <> 3 AND text IS NOT NULL THEN sha256(text) END AS text_sha256, CASE WHEN turn % 4 <> 3 AND turn % 4 <> 2 AND text IS NOT NULL THEN 'stop' END AS finish_reason FROM conversations""",
)
def q67(spark, sf_dir):
    """Completions of a runtime: with a model of their own or the one asked for, with and without a reason, and without choices."""
    c, n = read(spark, sf_dir, "conversations"), F.col("turn") % 4
    message = F.struct(F.struct(F.col("text").alias("content")).alias("message"), F.when(n != 2, "stop").alias("finish_reason"))
    body = F.to_json(F.struct(F.when(n == 0, "given").alias("model"), F.when(n != 3, F.array(message)).otherwise(F.array().cast("array<struct<message:struct<content:string>,finish_reason:string>>")).alias("choices")))
    found = c.select("conv_id", "turn", models.completion(body, "asked").alias("c"))
    return found.select("conv_id", "turn", "c.model", F.sha2("c.text", 256).alias("text_sha256"), "c.finish_reason")


@query(
    "q68_health_contracts",
    """SELECT event_id FROM events WHERE event_id % 6 IN (1, 2, 4, 5)""",
)
def q68(spark, sf_dir):
    """Health rows: ready without models, unavailable with some, a model twice, a blank one, and two that are sound."""
    k, e = F.col("event_id") % 6, read(spark, sf_dir, "events")
    status = F.when(k.isin(0, 1, 4, 5), "ready").otherwise("unavailable")
    some = F.when(k == 0, F.array(F.lit("m"))).when(k == 2, F.array(F.lit("m"))).when(k == 4, F.array(F.lit("m"), F.lit("m"))).when(k == 5, F.array(F.lit(" "))).otherwise(F.array().cast("array<string>"))
    return contracts.invalid_health(e.select("event_id", status.alias("status"), some.alias("models"))).select("event_id")

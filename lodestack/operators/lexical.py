"""Lexical index: line chunks, positional postings, phrase matching, integer ranking, top k, audits."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import digest, json_array, json_object, json_string, ordered_digest
from ..functions.shared import kept, short_batches
from ..functions.text import plain_form, score_form, score_forms, tokens
from ..schemas import LexicalError, LexicalPolicy, LexicalQueryError, checked_limit


def candidates(snapshot: DataFrame) -> DataFrame:
    return snapshot.where("kind = 'file' AND content_kind IN ('text', 'empty')")


def file_status(policy: LexicalPolicy = LexicalPolicy()) -> Column:
    return F.when(F.col("size_bytes") > policy.max_file_bytes, "skipped_size").otherwise("indexed")


# -- chunks -------------------------------------------------------------------------------------------------------


def line_spans(text: str, policy: LexicalPolicy) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, content) of a text's chunks: as many lines as both budgets hold, overlapping; a line over the budget is cut in slices."""
    lines = text.splitlines(keepends=True)
    if not lines:
        yield 1, 1, ""
    size = policy.max_chunk_chars
    first = 0
    while first < len(lines):
        if len(lines[first]) > size:
            yield from ((first + 1, first + 1, lines[first][at : at + size]) for at in range(0, len(lines[first]), size))
            first += 1
            continue
        stop, held = first, 0
        while stop < len(lines) and stop - first < policy.chunk_lines and held + len(lines[stop]) <= size:
            held += len(lines[stop])
            stop += 1
        yield first + 1, stop, "".join(lines[first:stop])
        if stop == len(lines):
            return
        first = max(first + 1, stop - policy.overlap_lines)


#: Characters of chunks that a task hands on at once.
HANDED = 1 << 20


def chunks(texts: DataFrame, policy: LexicalPolicy = LexicalPolicy(), keys: tuple[str, ...] = ("path", "file_sha256")) -> DataFrame:
    """keys, chunk_index, start_line, end_line and content of each text (column text). Files are cut apart from each other; too many chunks raise.
    A worker holds a short batch, a text of it at a time, and HANDED characters of chunks beside them."""
    short_batches(texts.sparkSession)
    slim = texts.select(*keys, "text")
    schema = texts.select(*keys).schema.add("chunk_index", "integer").add("start_line", "integer").add("end_line", "integer").add("content", "string")

    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of, held = [], [], 0

            def made() -> pa.RecordBatch:
                take = pa.array(of, pa.int64())
                out = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
                return pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(len(keys))), *out], [*keys, "chunk_index", "start_line", "end_line", "content"])

            for k, text in enumerate(batch.column(len(keys))):
                for n, span in enumerate(line_spans(text.as_py() or "", policy)):
                    if n >= policy.max_chunks:
                        raise LexicalError(f"a file has more than {policy.max_chunks} chunks: {batch.column(0)[k]}")
                    rows.append((n, *span))
                    of.append(k)
                    held += len(span[2])
                    if held >= HANDED:
                        yield made()
                        rows, of, held = [], [], 0
            if rows:
                yield made()

    return slim.mapInArrow(cut, schema)


def chunk_ids(cut: DataFrame) -> DataFrame:
    """chunks with content_sha256 and chunk_id; needs path and file_sha256."""
    out = cut.withColumn("content_sha256", F.sha2("content", 256))
    kinds = {"path": "string", "file_sha256": "string", "chunk_index": "number", "start_line": "number", "end_line": "number", "content_sha256": "string"}
    return out.withColumn("chunk_id", digest(json_object({k: (F.col(k), kind) for k, kind in kinds.items()})))


# -- postings -----------------------------------------------------------------------------------------------------


def postings(rows: DataFrame, key: str = "chunk_id", columns: tuple[str, ...] = ("content", "path")) -> DataFrame:
    """key, col, offset (from 0), term of each token of the columns."""
    both = F.array(*(F.struct(F.lit(c).alias("col"), tokens(F.col(c)).alias("terms")) for c in columns))
    each = rows.select(key, F.explode(both).alias("e")).select(key, F.col("e.col").alias("col"), F.col("e.terms").alias("terms"))
    return each.select(key, "col", F.posexplode("terms").alias("offset", "term"))


def term_counts(found: DataFrame, key: str = "chunk_id") -> DataFrame:
    """term, documents, occurrences from postings. Occurrences are summed by term and key before the shuffle by term."""
    each = found.groupBy("term", key).agg(F.count("*").alias("n"))
    return each.groupBy("term").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences"))


def text_term_counts(rows: DataFrame, columns: tuple[str, ...] = ("content", "path")) -> DataFrame:
    """term_counts() of rows that are a document each. A term's first place in its row counts the document, so one shuffle, of counts that are
    summed before it, is all."""
    every = F.array_sort(F.flatten(F.array(*(F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")) for c in columns))))
    terms = rows.select(every.alias("t")).select(F.posexplode(F.transform("t", lambda x, i: F.struct(x.alias("term"), ((i == 0) | (F.get("t", i - 1) != x)).alias("first")))).alias("at", "e"))
    return terms.groupBy(F.col("e.term").alias("term")).agg(F.count_if("e.first").alias("documents"), F.count("*").alias("occurrences"))


def postings_digest(found: DataFrame, by: list[str], key: str = "chunk_id") -> DataFrame:
    """SHA-256 of the postings' JSON lines by key, column, offset and term."""
    line = F.concat(json_array([(F.col(key), "string"), (F.col("col"), "string"), (F.col("offset"), "number"), (F.col("term"), "string")]), F.lit("\n"))
    return ordered_digest(found, by, [key, "col", "offset", "term"], line)


def chunk_digests(found: DataFrame, by: list[str], key: str = "chunk_id") -> DataFrame:
    """SHA-256 of each key's postings as JSON lines by column, offset and term. A chunk's postings are bounded, so this is one shuffle on the
    JVM's side."""
    line = F.concat(json_array([(F.col("e.col"), "string"), (F.col("e.offset"), "number"), (F.col("e.term"), "string")]), F.lit("\n"))
    lines = found.select(*by, key, F.struct("col", "offset", "term").alias("e")).withColumn("line", line)
    own = F.array_sort(F.collect_list(F.struct("e", "line")))
    return lines.groupBy(*by, key).agg(F.sha2(F.array_join(F.transform(own, lambda x: x["line"]), ""), 256).alias("digest"))


def index_digest(found: DataFrame, by: list[str], key: str = "chunk_id") -> DataFrame:
    """Digest of all postings of a group: SHA-256 over the JSON lines of its keys and their chunk_digests(), in key order. Only these lines, one a
    chunk, meet in a group's task."""
    line = F.concat(json_array([(F.col(key), "string"), (F.col("digest"), "string")]), F.lit("\n"))
    return ordered_digest(chunk_digests(found, by, key).withColumnRenamed("digest", "_chunk").select(*by, key, F.col("_chunk").alias("digest")), by, [key], line)


def text_postings_digest(rows: DataFrame, by: list[str], key: str = "chunk_id", columns: tuple[str, ...] = ("content", "path")) -> DataFrame:
    """postings_digest() of the postings of rows. A row's terms go to the group's task as one text, and become lines as they are hashed, so that
    the task reads no more than the texts."""
    short_batches(rows.sparkSession)
    both = F.array(*(F.struct(F.lit(c).alias("_col"), F.array_join(tokens(F.col(c)), " ").alias("_terms")) for c in columns))
    slim = rows.select(*by, F.col(key).cast("string").alias(key), F.explode(both).alias("_e")).select(*by, key, "_e.*").where("_terms <> ''")
    schema, width = rows.select(*by).schema.add("digest", "string"), len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quoted = json.encoder.encode_basestring_ascii
        place, texts, hasher, kinds = None, [], None, None

        def write() -> None:
            *_, of, col = place
            head = f"[{'null' if of is None else quoted(of)},{quoted(col)},"
            # Rows of one key are one list of postings.
            entries = enumerate(texts[0].split(" ")) if len(texts) == 1 else iter(sorted(e for t in texts for e in enumerate(t.split(" "))))
            while lines := "".join(f"{head}{n},{quoted(w)}]\n" for n, w in islice(entries, 1 << 16)):
                hasher.update(lines.encode())

        def told(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*kinds, pa.string()], strict=True)], [*by, "digest"])

        for batch in batches:
            kinds, out = [f.type for f in batch.schema][:width], []
            for *at, terms in zip(*(map(lambda v: v.as_py(), batch.column(k)) for k in range(width + 3)), strict=True):
                if at != place:
                    if place is not None:
                        write()
                    if place is None or at[:width] != place[:width]:
                        if place is not None:
                            out.append((*place[:width], hasher.hexdigest()))
                        hasher = hashlib.sha256()
                    place, texts = at, []
                texts.append(terms)
            if out:
                yield told(out)
        if place is not None:
            write()
            yield told([(*place[:width], hasher.hexdigest())])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return slim.repartition(n, *by).sortWithinPartitions(*by, key, "_col").mapInArrow(run, schema)


def text_index_digest(rows: DataFrame, by: list[str], key: str = "chunk_id", columns: tuple[str, ...] = ("content", "path")) -> DataFrame:
    """index_digest() of the postings of rows. A row's digest is made where the row is, so no posting is shuffled; only keys of several rows have
    their postings brought together."""

    def lines(c: str) -> Column:
        line = lambda term, n: F.concat(F.lit(f'["{c}",'), n.cast("string"), F.lit(","), json_string(term), F.lit("]\n"))
        return F.array_join(F.transform(F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")), line), "")

    own = rows.select(*by, key, F.sha2(F.concat(*map(lines, sorted(columns))), 256).alias("_digest"))
    own = kept(own.where(F.col("_digest") != hashlib.sha256(b"").hexdigest()))
    twice = kept(own.groupBy(*by, key).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    if not twice.isEmpty():
        same = reduce(lambda a, b: a & b, (F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (*by, key)))
        several = rows.alias("r").join(twice.alias("t"), same, "left_semi")
        found = postings(several.withColumn("_k", F.struct(*by, key)), "_k", columns).select("_k.*", "col", "offset", "term")
        own = own.alias("r").join(twice.alias("t"), same, "left_anti").unionByName(chunk_digests(found, by, key).withColumnRenamed("digest", "_digest"))
    line = F.concat(json_array([(F.col(key), "string"), (F.col("digest"), "string")]), F.lit("\n"))
    return ordered_digest(own.withColumnRenamed("_digest", "digest"), by, [key], line)


def retokenised(found: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Audit: postings that the chunks do not give, and those that are missing; both with their side."""
    again = postings(rows, key)
    kept = found.select(*again.columns)
    return kept.exceptAll(again).withColumn("side", F.lit("extra")).unionByName(again.exceptAll(kept).withColumn("side", F.lit("missing")))


def orphan_postings(found: DataFrame, known: DataFrame, key: str = "chunk_id") -> DataFrame:
    return found.join(known.select(key), key, "left_anti")


# -- search -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Query:
    """text: stripped; phrases: index terms of each word; terms: what is scored."""

    text: str
    phrases: tuple[tuple[str, ...], ...]
    terms: tuple[str, ...]


def prepare_query(query: str, policy: LexicalPolicy = LexicalPolicy()) -> Query:
    """Words of a query are literal: quotes and operators separate, and have no meaning."""
    text = query.strip()
    try:
        text.encode()
    except UnicodeEncodeError as e:
        raise LexicalQueryError("the query is not valid Unicode") from e
    if not text:
        raise LexicalQueryError("the query is empty")
    if len(text) > policy.max_query_chars:
        raise LexicalQueryError(f"the query has more than {policy.max_query_chars} characters")
    first: dict[str, str] = {}
    for w in re.findall(r"\w+", text):
        if any(c.isalnum() for c in w):
            first.setdefault(w.casefold(), w)
    words = list(first.values())
    if not words:
        raise LexicalQueryError("the query has no searchable terms")
    if len(words) > policy.max_query_terms:
        raise LexicalQueryError(f"the query has more than {policy.max_query_terms} terms")
    scored = dict.fromkeys(part.casefold() for w in words for part in ([p for p in w.split("_") if p] or [w]))
    return Query(text, tuple(tuple(p for p in re.findall(r"[^\W_]+", score_word(w))) for w in words), tuple(scored))


def score_word(word: str) -> str:
    """A query word as the index has it: lower-cased, without marks on Latin letters."""
    import unicodedata

    from ..functions.text import ACCENTED, BASE

    low = "".join(c for c in word.lower() if unicodedata.category(c) != "Mn")
    return low.translate(str.maketrans(ACCENTED, BASE))


def matches(query: Query, columns: tuple[str, ...] = ("content", "path")) -> Column:
    """Every phrase stands, word after word, in one of the columns. A phrase's first word as a mere part of the text is looked for before
    the text is cut to tokens, which most texts are spared by it; short columns come before long ones (content is the first by default)."""
    out = F.lit(True)
    for phrase in query.phrases:
        wanted, here = f" {' '.join(phrase)} ", F.lit(False)
        for c in reversed(columns):
            line = F.concat(F.lit(" "), F.array_join(tokens(F.col(c)), " "), F.lit(" "))
            here |= plain_form(F.col(c)).contains(phrase[0]) & line.contains(wanted)
        out &= here
    return out


def overflows(rows: DataFrame, text: str, policy: LexicalPolicy = LexicalPolicy()) -> DataFrame:
    """One row: query, and whether a search for it is refused as too broad. No more matches than that takes are counted."""
    found = rows.where(matches(prepare_query(text, policy))).limit(policy.max_candidates + 1)
    return found.agg((F.count("*") > policy.max_candidates).alias("refused")).select(F.lit(text).alias("query"), "refused")


def match_postings(found: DataFrame, query: Query, key: str = "chunk_id") -> DataFrame:
    """Keys of an index' postings that have all phrases. The query's terms alone are read, once, by a filter that reaches the scan; a key's
    places then say by themselves which phrases it has."""
    terms = sorted({t for phrase in query.phrases for t in phrase})
    held = found.where(F.col("term").isin(terms)) if terms else found.where("false")
    starts = F.array(*(F.when(F.col("term") == t, F.struct(F.lit(p).alias("phrase"), F.lit(len(phrase)).alias("n"), F.lit(k).alias("k"), (F.col("offset") - k).alias("start"))) for p, phrase in enumerate(query.phrases) for k, t in enumerate(phrase)))
    # A key's places are brought together once; both aggregates then find theirs in one task.
    each = held.select(key, "col", F.explode(F.filter(starts, lambda x: x.isNotNull())).alias("e")).select(key, "col", "e.*").repartition(key)
    whole = each.groupBy(key, "col", "phrase", "start").agg(F.countDistinct("k").alias("met"), F.first("n").alias("n")).where("met = n")
    return whole.groupBy(key).agg(F.countDistinct("phrase").alias("phrases")).where(F.col("phrases") == len(query.phrases)).select(key)


def _occurrences(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def score(query: Query, path: Column, content: Column) -> Column:
    """100 for each of a term's first 5 places in the path, 10 for its first 20 in the content; 250 and 25 if the whole query is in them. path and content in score form."""
    words = lambda text: F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}\p{M}]+)"), F.lit(1))
    out = F.lit(0)
    for term in dict.fromkeys(map(score_form, query.terms)):
        n = sum(score_form(t) == term for t in query.terms)
        out += n * (100 * F.least(_occurrences(words(path), term), F.lit(5)) + 10 * F.least(_occurrences(words(content), term), F.lit(20)))
    whole = score_form(query.text)
    return out + F.when(path.contains(whole), 250).otherwise(0) + F.when(content.contains(whole), 25).otherwise(0)


TOO_MANY = "too many candidates: refine the query"


def scored(hits: DataFrame, query: Query) -> DataFrame:
    """Matches with their score; only they are put in score form."""
    formed = hits.withColumn("path_form", score_forms("path")).withColumn("content_form", score_forms("content"))
    return formed.withColumn("score", score(query, F.col("path_form"), F.col("content_form"))).drop("path_form", "content_form")


def ranked(rows: DataFrame, query: Query) -> DataFrame:
    """Matching rows with their score; matching is native."""
    return scored(rows.where(matches(query)), query)


def best(hits: DataFrame, query: Query, limit: int | None = None, policy: LexicalPolicy = LexicalPolicy()) -> DataFrame:
    """The best of rows that are known to match, by score, path and chunk."""
    limit = checked_limit(limit, policy.default_limit, policy.max_results, LexicalQueryError)
    return scored(hits, query).orderBy(F.desc("score"), "path", "chunk_index").limit(limit)


def search(rows: DataFrame, text: str, limit: int | None = None, policy: LexicalPolicy = LexicalPolicy()) -> DataFrame:
    """The best matches by score, path and chunk. More candidates than the policy holds raise when the result is computed."""
    limit = checked_limit(limit, policy.default_limit, policy.max_results, LexicalQueryError)
    query = prepare_query(text, policy)
    found = scored(within(rows.where(matches(query)), policy.max_candidates, TOO_MANY, ["path", "chunk_index"] if policy.max_candidates <= GATHERED else None), query)
    return found.orderBy(F.desc("score"), "path", "chunk_index").limit(limit)


#: Up to this limit the rows that an ordered guard looks at are gathered; beyond it they stay in their tasks, and are counted apart.
GATHERED = 1 << 16


def within(found: DataFrame, most: int, message: str, order: list | None = None) -> DataFrame:
    """All rows, in an order where one is given, or an error when there are more than `most`.

    With an order, and up to GATHERED, the first most + 1 rows are taken, which reads the input once, and the one too many raises. Else tasks count
    their own rows and only the counts meet in one, at the price of a second evaluation."""
    if order and most <= GATHERED:
        first = found.orderBy(*order).limit(most + 1).withColumn("_at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
        return first.where(F.when(F.col("_at") <= most, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))).drop("_at").orderBy(*order)
    counted = found.agg(F.count("*").alias("_n"))
    fits = counted.select(F.when(F.col("_n") > most, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)).alias("_fits"))
    kept = found.crossJoin(F.broadcast(fits)).where("_fits").drop("_fits")
    return kept.orderBy(*order) if order else kept


# -- incremental maintenance ----------------------------------------------------------------------------------------


def sync_plan(existing: DataFrame, desired: DataFrame) -> DataFrame:
    """path, action: rebuilt (new or changed), removed or unchanged. Compared: hash, size, language, content kind and status."""
    names = ["file_sha256", "size_bytes", "language", "content_kind", "status"]
    a = existing.select("path", F.struct(*names).alias("old"))
    b = desired.select("path", F.struct(*names).alias("new"))
    action = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull() | ~F.col("old").eqNullSafe(F.col("new")), "rebuilt").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", action.alias("action"))


def file_differences(have: DataFrame, want: DataFrame) -> DataFrame:
    """Audit: paths that are missing, not wanted, there twice, or whose file differs in hash, size, language, content kind or status."""
    names = ["file_sha256", "size_bytes", "language", "content_kind", "status"]
    side = lambda df, name: df.groupBy("path").agg(F.count("*").alias(f"{name}_rows"), F.first(F.struct(*names)).alias(name))
    fault = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when((F.col("have_rows") > 1) | (F.col("want_rows") > 1), "twice").when(~F.col("have").eqNullSafe(F.col("want")), "changed")
    return side(have, "have").join(side(want, "want"), "path", "full_outer").select("path", fault.alias("fault")).where("fault IS NOT NULL")


def index_counts(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    return files.groupBy(*(by or [])).agg(F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status") == "skipped_size").alias("skipped"), F.count_if("lossy").alias("lossy"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))


def coverage_complete(files: DataFrame) -> bool:
    """Whether a search covers every file wholly."""
    return coverage(files).isEmpty()


def coverage(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows for every path that a search does not cover wholly."""
    return files.where("status = 'skipped_size' OR lossy").select(*(by or []), "path", F.when(F.col("status") == "skipped_size", "skipped").otherwise("lossy").alias("reason"))


def count_mismatches(files: DataFrame, detail: DataFrame, declared: str, key: str = "path") -> DataFrame:
    """Audit: files whose declared count differs from their detail rows, and detail rows without a file."""
    seen = detail.groupBy(key).agg(F.count("*").alias("observed"))
    return files.select(key, F.col(declared).cast("long").alias("declared")).join(seen, key, "full_outer").select(key, "declared", F.coalesce("observed", F.lit(0)).alias("observed"), F.col("declared").isNull().alias("orphan")).where("orphan OR declared <> observed")


def corrupt_chunks(rows: DataFrame, also: Column | None = None) -> DataFrame:
    """Audit: chunks whose content or id does not hash to what is stored, and rows for which `also` holds. Both are functions of the row, so each
    row tells for itself."""
    stored = rows.withColumnsRenamed({"content_sha256": "_sha256", "chunk_id": "_id"})
    wrong = F.expr("NOT (content_sha256 <=> _sha256 AND chunk_id <=> _id)")
    return chunk_ids(stored).where(wrong if also is None else wrong | also).select("path", "chunk_index")


def duplicate_files(files: DataFrame, key: str = "path") -> DataFrame:
    """Audit: paths that have more than one file row."""
    return files.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def overlapping_actions(plan: DataFrame, reports: DataFrame) -> DataFrame:
    """Audit of a sync: paths with more than one action, and paths whose report is missing or has no rebuilt or unchanged action."""
    acted = plan.groupBy("path").agg(F.count("*").alias("n"), F.first("action").alias("action"))
    told = reports.select("path", F.lit(True).alias("reported"))
    wrong = (F.coalesce("n", F.lit(0)) > 1) | (F.coalesce(F.col("action").isin("rebuilt", "unchanged"), F.lit(False)) != F.coalesce("reported", F.lit(False)))
    return acted.join(told, "path", "full_outer").where(wrong).select("path", "action", F.coalesce("reported", F.lit(False)).alias("reported"))


def policy_fingerprint(policy: LexicalPolicy, revision: int = 1) -> str:
    import unicodedata
    from dataclasses import asdict

    import pyspark

    held = {"revision": revision, "policy": asdict(policy), "spark": pyspark.__version__, "unicode": unicodedata.unidata_version}
    return hashlib.sha256(json.dumps(held, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

"""Incremental maintenance of the lexical and structural indexes in a Store, and reads that audit what they read.

Tables are laid out in buckets by path, and within a bucket in slots: of a posting's term, of a symbol's or import's name. A sync writes
the buckets that have new, changed or removed files; the others stay in the folders of earlier generations. Every slot of a written bucket is
hashed from what was written, a bucket's leaf is the hash of its slots' lines, and the index' digest that of all leaves: a Merkle tree that
is carried on as it is where nothing changed. The lines are a table, the leaves and counts of each bucket are in the state.

Rows are dealt by path once, for the join that finds them and the write alike: a bucket is that of Spark's own hash, so a task that joins by path
has one bucket to write. Postings are made from the chunks that were written, bucket by bucket, and are not dealt at all.

What a read compares with them is told by `recheck`: ``"met"`` (the default) hashes the slots, of the buckets, that the read meets; True hashes
the whole index each time; False hashes it once for each generation, which suits a store that nothing else writes. A sync that has nothing to
do, and verify(), hash the whole index. A slot's digest is that of the sums of its rows' hashes, word by word, so tasks add up what they read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import kept
from ..functions.text import decoded, tokens
from ..operators import lexical, snapshot as snapshots, structure
from ..schemas import EngineError, LexicalError, LexicalNotReady, LexicalPolicy, LexicalStale, StructuralError, StructuralNotReady, StructuralPolicy, StructuralStale
from .store import Store, first_fault


#: How tables are laid out and hashed; an index of another format is written anew.
FORMAT = 2


@dataclass(frozen=True)
class SyncResult:
    """counts: sums over the whole index after the sync; written: the buckets that it wrote."""

    changed: bool
    rebuilt: int
    removed: int
    unchanged: int
    generation: int
    counts: dict[str, int]
    written: tuple[int, ...] = ()


def hashed(value: Column, n: int) -> Column:
    """A number below n for each value; slots are dealt by it."""
    return F.pmod(F.xxhash64(value), F.lit(n)).cast("int")


def bucket_of(path: Column, n: int) -> Column:
    """The bucket of a path: the partition that dealt() puts it in."""
    return F.pmod(F.hash(path), F.lit(n)).cast("int")


def dealt(df: DataFrame, n: int) -> DataFrame:
    """df in n tasks by path, each of one bucket."""
    return df.repartition(n, "path")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def leaves(lines: DataFrame) -> dict[str, str]:
    """The leaf of each bucket, from the lines of its slots: one row a bucket comes to the driver."""
    line = F.to_json(F.struct("of", "slot", "rows", "items", "digest"))
    return {str(r["bucket"]): r["leaf"] for r in lines.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("leaf")).collect()}


def root_of(parts: dict) -> str:
    return hashlib.sha256("\n".join(f"{b}:{parts[b]['leaf']}" for b in sorted(parts, key=int)).encode()).hexdigest()


def line_differences(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Audit: slots whose rows do not hash to their line, or that have one without the other."""
    a, b = (df.select("bucket", "slot", "of", F.struct("rows", "items", "digest").alias(side)) for df, side in ((found, "found"), (stored, "stored")))
    return a.join(b, ["bucket", "slot", "of"], "full_outer").where("NOT found <=> stored")


class _Index:
    """What both indexes share: one generation with its state, audited before it is read."""

    error: type[EngineError] = EngineError
    not_ready: type[EngineError] = EngineError
    stale: type[EngineError] = EngineError
    #: Names of the tables, with the columns that their buckets are sorted by.
    tables: dict[str, list[str]] = {}
    planned = "status"

    def __init__(self, store: Store, policy, policy_fp: str, recheck: bool | str, buckets: int, slots: int):
        if recheck not in ("met", True, False):
            raise EngineError("recheck is 'met', True or False")
        self.store, self.policy, self.policy_fp, self.recheck = store, policy, f"{policy_fp}:{FORMAT}", recheck
        self.layout = {"buckets": buckets, "slots": slots}
        self._checked: set[int] = set()

    def wanted(self, snapshot: DataFrame) -> DataFrame:
        raise NotImplementedError

    def make(self, todo: DataFrame, contents: DataFrame, layout: dict, put, carried) -> None:
        """Write all tables of a generation: put(name, df, old) writes one and returns what was written, carried(name) is what stays of touched
        buckets. Both are dealt by path."""
        raise NotImplementedError

    def write_audits(self, t: dict[str, DataFrame], todo: DataFrame, layout: dict) -> dict[str, DataFrame]:
        raise NotImplementedError

    def counts(self, t: dict[str, DataFrame], lines: DataFrame) -> DataFrame:
        """bucket and its counts, which are summed for the whole index."""
        raise NotImplementedError

    def row_line(self, name: str, df: DataFrame) -> tuple[Column, Column]:
        """(what is hashed of a row, its number of items)."""
        return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), F.lit(1)

    # -- the Merkle tree --------------------------------------------------------------------------------------------

    def slot_lines(self, t: dict[str, DataFrame]) -> DataFrame:
        """The lines of all slots of some tables, from their rows."""
        out = []
        for name, df in t.items():
            line, items = self.row_line(name, df)
            rows = df.select("bucket", "slot", F.sha2(line, 256).alias("h"), items.cast("long").alias("i"))
            words = {f"w{k}": F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long") for k in range(8)}
            sums = rows.select("bucket", "slot", "i", *(c.alias(w) for w, c in words.items())).groupBy("bucket", "slot").agg(F.count("*").alias("rows"), F.sum("i").alias("items"), *(F.sum(w).alias(w) for w in words))
            out.append(sums.select("bucket", "slot", F.lit(name).alias("of"), "rows", "items", F.sha2(F.concat_ws(",", *(F.col(w).cast("string") for w in words)), 256).alias("digest")))
        return reduce(DataFrame.unionByName, out)

    def _check_leaves(self, state: dict) -> DataFrame:
        """The stored lines, after a comparison with the leaves in the state."""
        lines = self.store.bucketed("slots", state)
        if leaves(lines) != {b: p["leaf"] for b, p in state["parts"].items()} or root_of(state["parts"]) != state["digest"]:
            raise self.error("the index is corrupt: its slots are not those that were stored")
        return lines

    def _fail(self, audits: dict[str, DataFrame]) -> None:
        fault = first_fault(audits)
        if fault:
            raise self.error(f"the index is corrupt: {fault}")

    # -- reads --------------------------------------------------------------------------------------------------------

    def _open(self, fingerprint: str) -> dict:
        """The state of the generation that serves a read; another snapshot or policy is stale."""
        state = self.store.state()
        if not state["generation"]:
            raise self.not_ready("the repository has no index")
        if state.get("fingerprint") != fingerprint or state.get("policy") != self.policy_fp:
            raise self.stale("the index belongs to another snapshot or policy")
        return state

    def _check_snapshot(self, state: dict, snapshot: DataFrame) -> dict[str, DataFrame]:
        """Audits of the file set against a snapshot, whose fingerprint is taken anew."""
        again = snapshots.fingerprints(snapshot.withColumn("_one", F.lit(1)), ["_one"]).first()
        if (again["fingerprint"] if again else None) != state["fingerprint"]:
            raise self.error("the snapshot does not hash to its fingerprint")
        return {"another file set": lexical.file_differences(self.as_wanted(self.store.bucketed("files", state)), self.as_wanted(self.wanted(snapshot)))}

    def verify(self, state: dict | None = None, snapshot: DataFrame | None = None) -> None:
        """Hash the whole index, and compare its file set with a snapshot's entries where they are given."""
        state = state or self.store.state()
        if not state["generation"]:
            raise self.not_ready("the repository has no index")
        audits = self._check_snapshot(state, snapshot) if snapshot is not None else {}
        t = {n: self.store.bucketed(n, state) for n in self.tables}
        self._fail({**audits, "rows are not what was stored": line_differences(self.slot_lines(t), self._check_leaves(state)), **self.content_audits(t)})
        self._checked.add(state["generation"])

    def content_audits(self, t: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return {}

    def _begin(self, state: dict, snapshot: DataFrame | None) -> bool:
        """Audits of a read before it knows what it meets; whether it has to audit that."""
        if self.recheck is True or self.recheck is False and state["generation"] not in self._checked:
            self.verify(state, snapshot)
            return False
        if snapshot is not None:
            self._fail(self._check_snapshot(state, snapshot))
        return self.recheck == "met"

    def _met(self, state: dict, name: str, only: set[int] | None = None, slots: list[Column] | None = None, check: bool = True) -> DataFrame:
        """A table's rows in some buckets and slots (None: all), hashed before they are read."""
        inside = any_of([F.col("slot") == s for s in slots]) if slots else F.lit(True)
        rows = self.store.bucketed(name, state, only).where(inside)
        if check:
            lines = self._check_leaves(state).where(F.col("of") == name).where(inside)
            lines = lines if only is None else lines.where(F.col("bucket").isin(sorted(only)))
            self._fail({f"{name} are not what was stored": line_differences(self.slot_lines({name: rows}), lines)})
        return rows

    @staticmethod
    def as_wanted(files: DataFrame) -> DataFrame:
        return files.select("path", "file_sha256", "size_bytes", "language", "content_kind", "status")

    # -- sync ---------------------------------------------------------------------------------------------------------

    def sync(self, snapshot: DataFrame, fingerprint: str, contents: DataFrame) -> SyncResult:
        """snapshot: entries; contents: path, content. An index of this snapshot already is only audited."""
        now = self.store.state()
        if now["generation"] and now.get("fingerprint") == fingerprint and now.get("policy") == self.policy_fp:
            self.verify(now, snapshot)
            return SyncResult(False, 0, 0, sum(p["files"] for p in now["parts"].values()), now["generation"], now["counts"])
        with self.store.lock():
            state = self.store.state()
            g = state["generation"] + 1
            try:
                return self._write(state, g, snapshot, fingerprint, contents)
            finally:
                self.store.drop_work()

    def _write(self, state: dict, g: int, snapshot: DataFrame, fingerprint: str, contents: DataFrame) -> SyncResult:
        fresh = not state["generation"] or state.get("policy") != self.policy_fp
        layout = self.layout if fresh else state["layout"]
        n = layout["buckets"]
        wanted = self.wanted(snapshot).withColumn("bucket", bucket_of(F.col("path"), n))
        if fresh:
            plan = wanted.select("path", F.lit("rebuilt").alias("action"))
        else:
            # Lines of the file table are hashed before what they say is carried on.
            plan = lexical.sync_plan(self._met(state, "files").withColumn("status", F.col(self.planned)), wanted)
        plan = self.store.work("plan", plan.withColumn("bucket", bucket_of(F.col("path"), n)))
        acts = plan.groupBy("bucket", "action").count().collect()  # three rows a bucket at most
        total = {a: sum(r["count"] for r in acts if r["action"] == a) for a in ("rebuilt", "removed", "unchanged")}
        touched = sorted({r["bucket"] for r in acts if r["action"] != "unchanged"})
        here = F.col("bucket").isin(touched)
        todo = wanted if fresh else dealt(wanted, n).join(dealt(plan.where("action = 'rebuilt'").select("path"), n), "path", "left_semi")
        stay = plan.where(here & (F.col("action") == "unchanged")).select("path")
        schemas, tables = dict(state.get("schemas", {})), {str(b): {} for b in touched}

        def put(name: str, df: DataFrame, old: DataFrame | None = None, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
            written, schema = self.store.write_buckets(name, df if old is None else df.unionByName(old), g, self.tables.get(name, ["of", "slot"]), finish)
            schemas[name] = schema
            for b in written:
                tables[str(b)][name] = g
            return self.store.bucketed(name, {"schemas": schemas, "parts": {b: {"tables": x} for b, x in tables.items()}})

        def carried(name: str) -> DataFrame | None:
            return None if fresh else dealt(self.store.bucketed(name, state, touched), n).join(dealt(stay, n), "path", "left_semi")

        t = self.make(todo, contents, layout, put, carried)
        audits = {
            "another file set": lexical.file_differences(self.as_wanted(t["files"]), self.as_wanted(wanted.where(here))),
            "reports": lexical.overlapping_actions(plan.where(here), t["files"]),
            **self.write_audits(t, todo, layout),
        }
        fault = first_fault(audits)
        if fault:
            raise self.error(f"audit failed, nothing was committed: {fault}")
        lines = put("slots", self.slot_lines(t).repartition(1))
        found, leaf = {str(r["bucket"]): r.asDict() for r in self.counts(t, lines).collect()}, leaves(lines)
        parts = {} if fresh else {b: p for b, p in state["parts"].items() if int(b) not in touched}
        for b in (b for b in tables if tables[b]):
            counts = {k: int(v or 0) for k, v in found[b].items() if k not in ("bucket", "_files")}
            parts[b] = {"tables": tables[b], "leaf": leaf[b], "files": int(found[b]["_files"]), "counts": counts}
        names = self.counts(t, lines).columns[2:]
        counts = {k: sum(p["counts"][k] for p in parts.values()) for k in names}
        self.store.point(g, {"fingerprint": fingerprint, "policy": self.policy_fp, "layout": layout, "schemas": schemas, "parts": parts, "counts": counts, "digest": root_of(parts)})
        return SyncResult(True, total["rebuilt"], total["removed"], total["unchanged"], g, counts, tuple(touched))


class LexicalIndex(_Index):
    """Files, chunks and postings of a snapshot; only new and changed files are read again.

    A row of postings holds what a chunk has in one slot: its entries (term, in_path, offset), sorted."""

    error, not_ready, stale = LexicalError, LexicalNotReady, LexicalStale
    tables = {"files": ["path"], "chunks": ["path", "chunk_index"], "postings": ["slot", "path", "chunk_id"]}

    def __init__(self, store: Store, policy: LexicalPolicy = LexicalPolicy(), recheck: bool | str = "met", buckets: int = 32, slots: int = 32):
        super().__init__(store, policy, lexical.policy_fingerprint(policy), recheck, buckets, slots)

    def wanted(self, snapshot: DataFrame) -> DataFrame:
        return lexical.candidates(snapshot).select("path", F.col("sha256").alias("file_sha256"), "size_bytes", "language", "content_kind", lexical.file_status(self.policy).alias("status"))

    def make(self, todo: DataFrame, contents: DataFrame, layout: dict, put, carried) -> dict[str, DataFrame]:
        n = layout["buckets"]
        bodies = dealt(todo.where("status = 'indexed'"), n).join(dealt(contents, n), "path").withColumn("d", decoded("content"))
        cut = lexical.chunk_ids(lexical.chunks(bodies.select("path", "file_sha256", "bucket", F.col("d.lossy").alias("lossy"), F.col("d.text").alias("text")), self.policy, ("path", "file_sha256", "bucket", "lossy")))
        chunks = put("chunks", cut.withColumn("slot", F.lit(0)), carried("chunks"))
        postings = put("postings", self.posting_rows(chunks, layout["slots"]), finish=self.with_entries)
        counted = dealt(chunks.groupBy("path").agg(F.bool_or("lossy").alias("lossy"), F.count("*").alias("chunk_count")), n)
        files = dealt(todo, n).join(counted, "path", "left").select(*todo.columns, F.lit(0).alias("slot"), F.coalesce("lossy", F.lit(False)).alias("lossy"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
        return {"files": put("files", files, carried("files")), "chunks": chunks, "postings": postings}

    @staticmethod
    def posting_rows(chunks: DataFrame, slots: int) -> DataFrame:
        """What each chunk has in each slot, made within its row: terms, joined, with in_path and offset of each, in the entries' order."""

        def placed(c: str) -> Column:
            return F.transform(tokens(F.col(c)), lambda t, k: F.struct(hashed(t, slots).alias("slot"), t.alias("term"), F.lit(c == "path").alias("in_path"), k.alias("offset")))

        every = chunks.select("bucket", "chunk_id", "path", F.sort_array(F.concat(placed("content"), placed("path"))).alias("e"))
        starts = F.transform("e", lambda x, k: F.when((k == 0) | (F.get("e", k - 1)["slot"] != x["slot"]), k))
        every = every.withColumn("at", F.filter(starts, lambda k: k.isNotNull()))
        own = F.transform("at", lambda k, j: F.slice("e", k + 1, F.coalesce(F.get("at", j + 1), F.size("e")) - k))
        each = every.select("bucket", "chunk_id", "path", F.explode(own).alias("own"))
        return each.select("bucket", F.get("own", F.lit(0))["slot"].alias("slot"), "chunk_id", "path", F.array_join("own.term", ",").alias("terms"), F.col("own.in_path").alias("in_path"), F.col("own.offset").alias("offset"))

    @staticmethod
    def with_entries(rows: DataFrame) -> DataFrame:
        """posting_rows() with their entries as they are stored; joined terms are a fraction of them, so these are what is sorted."""
        entries = F.arrays_zip(F.split("terms", ",").alias("term"), "in_path", "offset").cast("array<struct<term:string,in_path:boolean,offset:int>>")
        return rows.select("bucket", "slot", "chunk_id", "path", entries.alias("entries"))

    @staticmethod
    def each_posting(rows: DataFrame, *keys: str) -> DataFrame:
        """keys, col, offset, term of the rows' entries."""
        return rows.select(*keys, F.explode("entries").alias("e")).select(*keys, F.when(F.col("e.in_path"), "path").otherwise("content").alias("col"), "e.offset", "e.term")

    def row_line(self, name: str, df: DataFrame) -> tuple[Column, Column]:
        if name == "postings":  # terms are letters and digits, so the marks between them are none of theirs
            held = (F.array_join(F.col(f"entries.{c}").cast("array<string>"), ",") for c in ("term", "in_path", "offset"))
            return F.concat_ws("\n", "chunk_id", "path", *held), F.size("entries")
        return super().row_line(name, df.drop("content"))  # a chunk has its content's hash

    def write_audits(self, t: dict[str, DataFrame], todo: DataFrame, layout: dict) -> dict[str, DataFrame]:
        # Of each chunk the number and the exclusive or of its postings' hashes, from its text and from what was stored. A posting stands once.
        posting = F.xxhash64("col", "offset", "term")
        told = lambda df, side: df.groupBy("chunk_id").agg(F.count("*").alias("n"), F.bit_xor(posting).alias("x")).select("chunk_id", F.struct("n", "x").alias(side))
        again, stored = told(lexical.postings(t["chunks"]), "again"), told(self.each_posting(t["postings"], "chunk_id"), "stored")
        return {
            "chunk counts": lexical.count_mismatches(t["files"].where("status = 'indexed'"), t["chunks"], "chunk_count"),
            "orphan postings": lexical.orphan_postings(t["postings"].select("chunk_id").distinct(), t["chunks"]),
            "postings of other texts": again.join(stored, "chunk_id", "full_outer").where("NOT again <=> stored"),
        }

    def content_audits(self, t: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return {"a chunk does not hash to what is stored": lexical.corrupt_chunks(t["chunks"])}

    def counts(self, t: dict[str, DataFrame], lines: DataFrame) -> DataFrame:
        sums = lines.groupBy("bucket").agg(*(F.coalesce(F.sum(F.when(F.col("of") == of, F.col(c))), F.lit(0)).alias(name) for name, of, c in (("_files", "files", "rows"), ("chunk_rows", "chunks", "rows"), ("postings", "postings", "items"))))
        return sums.join(lexical.index_counts(t["files"], ["bucket"]), "bucket", "left")

    def search(self, fingerprint: str, query: str, limit: int | None = None, snapshot: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Hits, and the paths that the search does not cover. One generation serves the whole query, which reads the slots of its terms, the chunks
        that have all of them, and the files of their buckets."""
        prepared = lexical.prepare_query(query, self.policy)
        state = self._open(fingerprint)
        met = self._begin(state, snapshot)
        terms = sorted({t for phrase in prepared.phrases for t in phrase})
        postings = self._met(state, "postings", slots=[hashed(F.lit(t), state["layout"]["slots"]) for t in terms] or [F.lit(-1)], check=met)
        # The keys that match are written: they are counted, their buckets are asked for, and their chunks are read.
        held = self.each_posting(postings.where(F.arrays_overlap("entries.term", F.lit(terms or [""]))).withColumn("chunk", F.struct("bucket", "chunk_id")), "chunk")
        hits = kept(lexical.match_postings(held, prepared, "chunk").select("chunk.bucket", "chunk.chunk_id"))
        per = {r["bucket"]: r["count"] for r in hits.groupBy("bucket").count().collect()}  # one row a bucket
        at, many = set(per), sum(per.values())
        if many > self.policy.max_candidates:
            raise LexicalError(lexical.TOO_MANY)
        few = F.broadcast(hits) if many <= lexical.GATHERED else hits
        rows = self.store.bucketed("chunks", state, at).drop("bucket", "lossy").join(few, "chunk_id")
        if rows.count() != many or not lexical.corrupt_chunks(rows).isEmpty():
            raise LexicalError("a chunk is missing or does not hash to what is stored")
        gaps = {int(b) for b, p in state["parts"].items() if p["counts"]["skipped"] + p["counts"]["lossy"]}
        files = self._met(state, "files", at | gaps, check=met)
        found = lexical.best(rows.drop("bucket", "slot"), prepared, limit, self.policy)
        return found.join(files.select("path", "language", "lossy"), "path").orderBy(F.desc("score"), "path", "chunk_index"), lexical.coverage(files.where(F.col("bucket").isin(sorted(gaps))))


class StructuralIndex(_Index):
    """Files, symbols and imports of a snapshot's Python sources."""

    error, not_ready, stale = StructuralError, StructuralNotReady, StructuralStale
    tables = {"files": ["path"], "symbols": ["slot", "name", "path"], "imports": ["slot", "name", "path"]}
    planned = "planned"

    def __init__(self, store: Store, policy: StructuralPolicy = StructuralPolicy(), recheck: bool | str = "met", buckets: int = 32, slots: int = 32):
        super().__init__(store, policy, structure.policy_fingerprint(policy), recheck, buckets, slots)

    def wanted(self, snapshot: DataFrame) -> DataFrame:
        return snapshot.where("kind = 'file'").select("path", F.col("sha256").alias("file_sha256"), "size_bytes", "language", "content_kind", structure.file_status(self.policy).alias("status"))

    @staticmethod
    def as_wanted(files: DataFrame) -> DataFrame:
        """What a file becomes by parsing is no difference."""
        status = F.col("planned") if "planned" in files.columns else F.col("status")
        return files.select("path", "file_sha256", "size_bytes", "language", "content_kind", status.alias("status"))

    def make(self, todo: DataFrame, contents: DataFrame, layout: dict, put, carried) -> dict[str, DataFrame]:
        n = layout["buckets"]
        parsed = self.store.work("parsed", structure.parse(dealt(todo.where("status = 'parse'"), n).join(dealt(contents, n), "path"), self.policy))
        reports = structure.file_reports(parsed).withColumnRenamed("status", "result")
        files = dealt(todo, n).join(dealt(reports, n), "path", "left").select("path", "bucket", F.lit(0).alias("slot"), "file_sha256", "size_bytes", "language", "content_kind", F.col("status").alias("planned"), F.coalesce("result", "status").alias("status"), F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"), F.coalesce("import_count", F.lit(0)).alias("import_count"), "error_message")
        placed = lambda df: dealt(df, n).withColumn("bucket", bucket_of(F.col("path"), n)).withColumn("slot", hashed(F.col("name"), layout["slots"]))
        out = {"files": put("files", files, carried("files"))}
        for name, rows in (("symbols", structure.symbols(parsed)), ("imports", structure.imports(parsed))):
            out[name] = put(name, placed(rows), carried(name))
        return out

    def write_audits(self, t: dict[str, DataFrame], todo: DataFrame, layout: dict) -> dict[str, DataFrame]:
        return {
            "symbol counts": lexical.count_mismatches(t["files"], t["symbols"], "symbol_count"),
            "import counts": lexical.count_mismatches(t["files"], t["imports"], "import_count"),
            "parents": structure.orphan_parents(t["symbols"]),
            "scopes": structure.orphan_scopes(t["imports"], t["symbols"]),
            "symbols without a file": structure.unindexed_rows(t["symbols"], t["files"]),
            "imports without a file": structure.unindexed_rows(t["imports"], t["files"]),
        }

    def counts(self, t: dict[str, DataFrame], lines: DataFrame) -> DataFrame:
        of = lambda name, alias: F.coalesce(F.sum(F.when(F.col("of") == name, F.col("rows"))), F.lit(0)).alias(alias)
        return lines.groupBy("bucket").agg(of("files", "_files"), of("files", "file_count"), of("symbols", "symbol_count"), of("imports", "import_count"))

    def _rows(self, name: str, fingerprint: str, snapshot: DataFrame | None, equal: dict) -> DataFrame:
        """The slots and buckets that a lookup has to read: those of a name, and of a path."""
        state = self._open(fingerprint)
        met = self._begin(state, snapshot)
        only, slots = None, None
        if equal.get("path") is not None:
            only = {self.store.spark.range(1).select(bucket_of(F.lit(equal["path"]), state["layout"]["buckets"])).first()[0]}
        if equal.get("name") is not None:
            slots = [hashed(F.lit(equal["name"]), state["layout"]["slots"])]
        return self._met(state, name, only, slots, met).drop("bucket", "slot")

    def symbols(self, fingerprint: str, limit: int | None = None, snapshot: DataFrame | None = None, **equal: str | None) -> DataFrame:
        return structure.find_symbols(self._rows("symbols", fingerprint, snapshot, equal), limit, self.policy, **equal)

    def imports(self, fingerprint: str, limit: int | None = None, snapshot: DataFrame | None = None, **equal: str | None) -> DataFrame:
        return structure.find_imports(self._rows("imports", fingerprint, snapshot, equal), limit, self.policy, **equal)

    def files(self, fingerprint: str, snapshot: DataFrame | None = None) -> DataFrame:
        return self._rows("files", fingerprint, snapshot, {}).select("path", "status", "symbol_count", "import_count", "error_message").orderBy("path")

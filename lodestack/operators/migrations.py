"""Reconciling the migrations that were applied with those on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import EngineError


def discover(files: DataFrame) -> DataFrame:
    """version, filename, checksum of NNN_name.sql files (columns filename, text); other names and version 0 raise."""
    version = F.regexp_extract("filename", r"\A(\d{3,})_[a-z0-9_]+\.sql\z", 1)
    ok = F.when((version == "") | (F.when(version != "", version).otherwise("0").cast("int") == 0), F.raise_error(F.concat(F.lit("invalid migration name: "), "filename"))).otherwise(version.cast("int"))
    return files.select(ok.alias("version"), "filename", F.sha2("text", 256).alias("checksum"))


def reconcile(applied: DataFrame, found: DataFrame) -> DataFrame:
    """version, state: applied, missing, renamed, changed, pending, or backfilled (new, but older than one that was applied)."""
    a = applied.select("version", F.struct("filename", "checksum").alias("old"))
    b = found.select("version", F.struct("filename", "checksum").alias("new"))
    last = applied.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    state = (
        F.when(F.col("new").isNull(), "missing")
        .when(F.col("old").isNull() & (F.col("version") < last), "backfilled")
        .when(F.col("old").isNull(), "pending")
        .when(F.col("old.filename") != F.col("new.filename"), "renamed")
        .when(F.col("old.checksum") != F.col("new.checksum"), "changed")
        .otherwise("applied")
    )
    return a.join(b, "version", "full_outer").select("version", state.alias("state"))


def apply_pending(store, found: DataFrame, run) -> list[int]:
    """Apply the pending migrations of found (discover()) in order, and record them, in one commit of a Store; returns their versions.

    run(version, filename) does one; if it raises, nothing is recorded. A recorded migration that is missing, renamed, changed or
    backfilled refuses all. What is recorded is a row a migration: a few at most.
    """
    done: list[int] = []

    def build(state: dict):
        applied = store.table("migrations", state["generation"]) if state["generation"] else found.limit(0)
        states = reconcile(applied, found).collect()
        wrong = sorted((r["version"], r["state"]) for r in states if r["state"] not in ("applied", "pending"))
        if wrong:
            raise EngineError(f"migrations do not agree with what was applied: {wrong}")
        todo = sorted(r["version"] for r in states if r["state"] == "pending")
        names = {r["version"]: r["filename"] for r in found.where(F.col("version").isin(todo)).collect()} if todo else {}
        for v in todo:
            run(v, names[v])
            done.append(v)
        return {"migrations": applied.union(found.where(F.col("version").isin(todo))) if todo else applied}, {"version": max([r["version"] for r in states], default=0)}

    store.commit(build)
    return done

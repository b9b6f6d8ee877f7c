"""Snapshots of file trees as DataFrames keyed by path: entries, totals, fingerprints, differences, maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import json_object, json_string, ordered_digest
from ..functions.text import classify_content, detect_language, stripped
from ..schemas import ContractError, ScanPolicy


def entries(files: DataFrame, policy: ScanPolicy = ScanPolicy()) -> DataFrame:
    """Entry rows from raw ones (path, kind, content, mode, device) or hashed ones (sha256, head and size for content). Links are named by their
    target's bytes, special files by type and device."""
    special = F.encode(F.format_string("special:%d:%d", F.col("mode").bitwiseAND(0o170000), F.col("device")), "UTF-8")
    is_special, is_file = F.col("kind") == "special", F.col("kind") == "file"
    is_hashed = "content" not in files.columns
    length = F.col("size") if is_hashed else F.octet_length("content")
    sha = F.col("sha256") if is_hashed else F.sha2("content", 256)
    size = F.when(is_special, F.lit(0)).otherwise(length).cast("long")
    return files.select(
        "path",
        "kind",
        size.alias("size_bytes"),
        F.when(is_special, F.sha2(special, 256)).otherwise(sha).alias("sha256"),
        (is_file & (F.col("mode").bitwiseAND(0o111) != 0)).alias("executable"),
        F.when(is_file, classify_content(size, F.substring("head" if is_hashed else "content", 1, policy.sample_bytes))).otherwise("not_applicable").alias("content_kind"),
        F.when(is_file, detect_language(F.col("path"))).alias("language"),
    )


def totals(snapshot: DataFrame, by: list[str] | None = None) -> DataFrame:
    return snapshot.groupBy(*(by or [])).agg(F.count("*").alias("entry_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"), F.count_if(F.col("kind") == "file").alias("regular_file_count"))


def language_counts(snapshot: DataFrame, by: list[str] | None = None) -> DataFrame:
    return snapshot.where(F.col("language").isNotNull()).groupBy(*(by or []), "language").agg(F.count("*").alias("files"))


def entry_json() -> Column:
    kinds = {"path": "string", "kind": "string", "size_bytes": "number", "sha256": "string", "executable": "boolean", "content_kind": "string", "language": "string"}
    return json_object({k: (F.col(k), kind) for k, kind in kinds.items()})


def fingerprints(snapshot: DataFrame, by: list[str]) -> DataFrame:
    """SHA-256 of the canonical JSON list of each snapshot's entries, ordered by path."""
    return ordered_digest(snapshot, by, ["path"], entry_json(), "[", ",", "]").withColumnRenamed("digest", "fingerprint")


def duplicate_paths(snapshot: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Audit: must be empty."""
    return snapshot.groupBy(*(by or []), "path").agg(F.count("*").alias("rows")).where("rows > 1")


def invalid_entries(snapshot: DataFrame) -> DataFrame:
    """Audit of the record's contract: must be empty."""
    path = F.col("path")
    bad_path = path.isNull() | (path == "") | path.startswith("/") | path.rlike(r"(\A|/)\.{0,2}(/|\z)") | path.contains("\x00")
    bad_sha = ~F.col("sha256").rlike(r"\A[0-9a-f]{64}\z")
    return snapshot.where(bad_path | bad_sha | ~F.col("kind").isin("file", "symlink", "special") | (F.col("size_bytes") < 0) | (F.trim("language") == "") | ((F.col("kind") == "file") == (F.col("content_kind") == "not_applicable")))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change: added, removed, modified (hash or size) or metadata_only; equal paths give no row."""
    names = ["kind", "size_bytes", "sha256", "executable", "content_kind", "language"]
    a = before.select("path", F.struct(*names).alias("old"))
    b = after.select("path", F.struct(*names).alias("new"))
    moved = (F.col("old.sha256") != F.col("new.sha256")) | (F.col("old.size_bytes") != F.col("new.size_bytes"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(moved, "modified").when(~F.col("old").eqNullSafe(F.col("new")), "metadata_only")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def is_same(before: DataFrame, after: DataFrame) -> bool:
    """Whether two snapshots differ in nothing."""
    return compare(before, after).isEmpty()


def normal_sha256(text: Column) -> Column:
    """A SHA-256 in hex as it is stored, stripped and in lower case; anything else raises when it is computed."""
    low = F.lower(stripped(text))
    return F.when(low.rlike(r"\A[0-9a-f]{64}\z"), low).otherwise(F.raise_error(F.lit("not a SHA-256 in hex")).cast("string"))


def map_line() -> Column:
    language = F.coalesce("language", F.lit("-"))
    return F.concat_ws("\t", json_string(F.col("path")), "kind", "content_kind", language, F.col("size_bytes").cast("string"), F.when(F.col("executable"), "x").otherwise("-"), F.substring("sha256", 1, 12))


def map_lines(snapshot: DataFrame) -> DataFrame:
    return snapshot.select("path", map_line().alias("line"))


def map_header(name: str, snapshot: DataFrame) -> str:
    """Head of a repository map; its numbers are aggregates, its lines are map_lines() in the order of their paths."""
    import json

    t = totals(snapshot).first()
    fp = fingerprints(snapshot.withColumn("one", F.lit(1)), ["one"]).first()
    langs = ", ".join(f"{r['language']}={r['files']}" for r in language_counts(snapshot).orderBy("language").collect())
    return f"repository: {json.dumps(name)}\nfingerprint: {fp['fingerprint'] if fp else ''}\nentries: {t['entry_count']}\nbytes: {t['total_bytes']}\nlanguages: {langs or 'none'}\npaths:\n"


def bound_reads(snapshot: DataFrame, files: DataFrame, max_bytes: int) -> DataFrame:
    """path, content of a snapshot's regular files; a file that is too large or has changed raises."""
    found = snapshot.where("kind = 'file'").join(files.select("path", "content"), "path", "left")
    same = F.coalesce((F.sha2("content", 256) == F.col("sha256")) & (F.octet_length("content") == F.col("size_bytes")), F.lit(False))
    checked = F.when(F.col("size_bytes") > max_bytes, F.raise_error(F.concat(F.lit("file exceeds the read limit: "), "path"))).when(~same, F.raise_error(F.concat(F.lit("file differs from its snapshot: "), "path"))).otherwise(F.col("content"))
    return found.select("path", checked.alias("content"))


def checked_path(path: str) -> str:
    """A relative, normalised POSIX path, or ContractError."""
    parts = path.split("/") if isinstance(path, str) else [""]
    if path.startswith("/") or "\x00" in path or any(p in ("", ".", "..") for p in parts):
        raise ContractError(f"not a normalised relative path: {path!r}")
    return path

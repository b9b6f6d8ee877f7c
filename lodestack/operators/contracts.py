"""Audits of record contracts and references; each must be empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_references(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows of child whose key columns (child name to parent name) have no row in parent; a null key refers to nothing."""
    known = parent.select(*(F.col(p).alias(c) for c, p in keys.items())).distinct()
    there = child.where(" AND ".join(f"`{c}` IS NOT NULL" for c in keys))
    return there.join(known, list(keys), "left_anti")


def unproven_passes(results: DataFrame) -> DataFrame:
    """Verification results (status, evidence) that passed without any evidence."""
    return results.where((F.col("status") == "passed") & (F.coalesce(F.size("evidence"), F.lit(0)) <= 0))


def blank(text: Column) -> Column:
    """Null, empty, or white space of any kind alone."""
    return text.isNull() | text.rlike(r"\A[\s\p{Z}\x1c-\x1f\x85]*\z")


def checked_uuid(text: Column) -> Column:
    """A UUID in its usual form, in lower case; anything else raises when it is computed."""
    low = F.lower(text)
    good = low.rlike(r"\A[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z")
    return F.when(good, low).otherwise(F.raise_error(F.lit("not a UUID")).cast("string"))


def invalid_requests(requests: DataFrame) -> DataFrame:
    """Requests (prompt, max_output_tokens, temperature, metadata) that break their contract, with the reason."""
    keys = F.coalesce(F.exists(F.map_keys("metadata"), blank), F.lit(False))
    why = (
        F.when(blank(F.col("prompt")), "prompt")
        .when(F.col("max_output_tokens").isNull() | (F.col("max_output_tokens") <= 0), "max_output_tokens")
        .when(F.isnan("temperature") | ~F.col("temperature").between(0.0, 2.0), "temperature")
        .when(keys, "metadata")
    )
    return requests.withColumn("reason", why).where("reason IS NOT NULL")


def invalid_health(rows: DataFrame) -> DataFrame:
    """Health rows (status, models): ready needs models, unavailable forbids them, names are unique and not blank."""
    n = F.coalesce(F.size("models"), F.lit(0))
    bad = ((F.col("status") == "ready") & (n <= 0)) | ((F.col("status") == "unavailable") & (n > 0)) | F.exists("models", blank) | (n != F.size(F.array_distinct("models")))
    return rows.where(F.coalesce(bad, F.lit(False)))

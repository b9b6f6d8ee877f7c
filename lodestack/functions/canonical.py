"""Canonical JSON, digests and path escapes as columns, on the JVM side."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short escapes of JSON.
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def json_string(text: Column) -> Column:
    """A JSON string of ASCII characters alone, lowercase hex; null gives null."""

    def escaped(c: Column) -> Column:
        out = F.when((c < " ") | (c > "~"), F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")).otherwise(c)
        for raw, short in _SHORT.items():
            out = F.when(c == raw, F.lit(short)).otherwise(out)
        return out

    inside = F.when(text.rlike(r"\A[ !#-\[\]-~]*\z"), text).otherwise(F.array_join(F.transform(F.split(text, ""), escaped), ""))
    return F.concat(F.lit('"'), inside, F.lit('"'))


def json_value(value: Column, kind: str) -> Column:
    """kind: string, number or boolean; null gives the literal null."""
    shown = json_string(value) if kind == "string" else value.cast("string")
    return F.coalesce(shown, F.lit("null"))


def json_object(fields: dict[str, tuple[Column, str]]) -> Column:
    """Keys in ascending order, no blanks."""
    parts: list[Column] = []
    for k, (v, kind) in sorted(fields.items()):
        parts += [F.lit(("," if parts else "{") + f'"{k}":'), json_value(v, kind)]
    return F.concat(*parts, F.lit("}"))


def json_array(values: list[tuple[Column, str]]) -> Column:
    parts: list[Column] = []
    for v, kind in values:
        parts += [F.lit("," if parts else "["), json_value(v, kind)]
    return F.concat(*parts, F.lit("]"))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def ordered_digest(df: DataFrame, group: list[str], order: list[str], line: Column, before: str = "", between: str = "", after: str = "") -> DataFrame:
    """group columns and digest: SHA-256 of each group's lines in order, joined.

    The hash runs over a sorted partition as it streams by, so a group of any size needs no more memory than a batch.
    """
    # A hidden header row for each group is not needed: a group without rows has no digest.
    slim = df.select(*group, *order, line.alias("_line"))
    n_group, at = len(group), len(group) + len(order)
    schema = df.select(*group).schema.add("digest", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hasher = None, None

        def closed():
            hasher.update(after.encode())
            return (*key, hasher.hexdigest())

        kinds = None
        for batch in batches:
            kinds, out = [f.type for f in batch.schema][:n_group], []
            ends = [tuple(batch.column(k)[at_row].as_py() for k in range(n_group)) for at_row in (0, -1)] if batch.num_rows else [0, 1]
            if hasher is not None and ends == [key, key]:
                # Rows are sorted, so all of this batch belong to the open group.
                hasher.update((between + between.join(v or "" for v in batch.column(at).to_pylist())).encode())
                continue
            for row in zip(*(batch.column(k).to_pylist() for k in (*range(n_group), at)), strict=True):
                if hasher is None or row[:-1] != key:
                    if hasher is not None:
                        out.append(closed())
                    key, hasher = row[:-1], hashlib.sha256(before.encode())
                elif between:
                    hasher.update(between.encode())
                hasher.update((row[-1] or "").encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*kinds, pa.string()], strict=True)], [*group, "digest"])
        if hasher is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(closed(), [*kinds, pa.string()], strict=True)], [*group, "digest"])

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return slim.repartition(n, *group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)


def encode_path(path: str) -> str:
    """Names that Spark's strings would damage, reversibly: U+001F and s with hex of the bytes, or u before a path that starts with U+001F."""
    try:
        path.encode("utf-8")
    except UnicodeEncodeError:
        return "\x1fs" + path.encode("utf-8", "surrogatepass").hex()
    return "\x1fu" + path if path.startswith("\x1f") else path


def decode_path(stored: str) -> str:
    if stored.startswith("\x1fs"):
        return bytes.fromhex(stored[2:]).decode("utf-8", "surrogatepass")
    return stored[2:] if stored.startswith("\x1fu") else stored


def escaped_path(path: Column) -> Column:
    """encode_path() of paths that Spark's strings hold as they are."""
    return F.when(path.startswith("\x1f"), F.concat(F.lit("\x1fu"), path)).otherwise(path)


def unescaped_path(stored: Column) -> Column:
    """The path behind escaped_path(); one with bytes that are no text stays escaped."""
    return F.when(stored.startswith("\x1fu"), F.substring(stored, F.lit(3), F.length(stored))).otherwise(stored)

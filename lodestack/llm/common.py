"""Helpers shared by the training-data operators: batch mapping, shared storage, balanced ranges."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch when the session has no setting of its own; texts can be long, so far fewer than Spark's default.
BATCH_ROWS = 1000
#: Bytes of an Arrow batch, by which Spark ends it early when texts are long.
BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a session in one process (tests)
    gets a temporary folder of its own; on a cluster it has to be set, since no local folder is seen by all executors."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found is None:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-lodestack-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Paths that write_table() wrote, for each scope that is open.
_SCOPES: list[list[str]] = []


def write_table(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and survives the loss of any executor. The table goes when the
    driver ends, or at the end of the innermost scope."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def drop_table(df: DataFrame) -> None:
    """Remove what write_table() wrote, once nothing reads it any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs, at = _file_system(df.sparkSession, name)
        fs.delete(at, True)


def written_once(make: Callable[[], DataFrame]) -> DataFrame:
    """The written result of make(); all other tables that were written on the way are removed."""
    _SCOPES.append([])
    try:
        out = make()
        spark = out.sparkSession
        inner = _SCOPES[-1]
        _SCOPES.append([])
        try:
            kept = write_table(out)
        finally:
            own = _SCOPES.pop()
        for path in inner:
            fs, at = _file_system(spark, path)
            fs.delete(at, True)
    finally:
        _SCOPES.pop()
    if _SCOPES:
        _SCOPES[-1].extend(own)
    return kept


def place_of(df: DataFrame, column: str) -> int:
    """Place of a column as Spark resolves its name: without regard to letter case."""
    names = list(df.columns)
    return names.index(column) if column in names else [c.lower() for c in names].index(column.lower())


def map_batches(df: DataFrame, func: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow over batches that are small enough for long texts. func: one batch to one batch, or to several.

    Batches are bounded by rows and, where Spark knows that bound, by bytes: the session's settings are lowered for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = func(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def bound_batches(spark: SparkSession) -> None:
    """Rows and bytes of the session's Arrow batches, where they are larger than texts allow."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        held = spark.conf.get(key)
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, str(most))


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8, null as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def spare_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quantile_bounds(df: DataFrame, column: str, parts: int) -> list[float]:
    """Boundaries that split a numeric column in about even ranges; they decide on balance only, never on results."""
    if parts < 2:
        return []
    probs = [i / parts for i in range(1, parts)]
    return sorted(set(df.select(column).dropna().approxQuantile(column, probs, 1 / (8 * parts))))


def range_number(column: Column, bounds: list[float], kind: str) -> Column:
    """Number of the range that a value is in, by binary search over a literal array; null is in range 0."""
    if not bounds:
        return F.lit(0)
    # A balanced tree of comparisons: log2(n) deep, native, and the same for equal values.

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column <= F.lit(bounds[mid]).cast(kind), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(column.isNull(), F.lit(0)).otherwise(tree(0, len(bounds)))


def parts_of(spark: SparkSession, most: int = 256) -> int:
    """Ranges for a global order: as many as shuffle partitions, within bounds."""
    return max(2, min(most, int(spark.conf.get("spark.sql.shuffle.partitions"))))

"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, ``spark.checkpoint.dir``, which goes when the driver ends; where that is unset (tests), a session of one
    process has a folder of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="spark-lodestack-")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/queries-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df as a written table: its lineage ends there, and it survives the loss of executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch with texts in it, by which Spark ends it early.
BATCH_BYTES = 4 << 20


def short_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch, since a batch of long texts is held in a worker several times."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = int(spark.conf.get(name).removesuffix("b"))
    if found <= 0 or found > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))

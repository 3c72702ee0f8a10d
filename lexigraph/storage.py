"""Tables written once for several readers, in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import BadRequest

#: Estimated bytes of a table for each file that it is written in. A small table
#: in as many files as there are shuffle partitions costs more in files than in rows.
FILE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where that is unset and all runs on one machine
    (as in tests) a folder made here."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or getattr(spark, "_own_shared_dir", "")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise BadRequest("spark.checkpoint.dir is not set", {"master": master}, "name a folder that all machines share")
        found = spark._own_shared_dir = "file://" + tempfile.mkdtemp(prefix="lexigraph-")
        atexit.register(forget, spark, found)
    return found.rstrip("/")


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder when the program ends, if Spark still runs then."""
    jvm = spark.sparkContext._jvm
    if jvm is not None and spark.sparkContext._jsc is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate: exact for files, an upper bound above joins."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fewer(df: DataFrame, size: int | None = None) -> DataFrame:
    """df in no more partitions than its size (Spark's estimate if none is given)
    has FILE_BYTES; a large table keeps those it has."""
    n = max(1, -(-(estimated_bytes(df) if size is None else size) // FILE_BYTES))
    return df.coalesce(n) if n < 100_000 else df


def materialise(df: DataFrame, name: str, size: int | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again. It cuts
    the lineage, computes df once, and outlives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexigraph-{name}-{uuid.uuid4().hex}"
    fewer(df, size).write.parquet(path)
    atexit.register(forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes what materialise wrote, once nothing reads it any more."""
    forget(df.sparkSession, df._written_at)

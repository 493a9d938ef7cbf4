"""Helpers that the operators share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import shared_dir, ship

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a table in the shared folder: computed once, and safe when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    # Shuffle files of the finished step go once the driver has collected its garbage.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes a durable table that no later step reads."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession) -> int:
    """Deletes all durable tables in the shared folder; for when no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in fs.listStatus(top) if s.getPath().getName().startswith("tidemark-")] if fs.exists(top) else []
    for path in gone:
        fs.delete(path, True)
    return len(gone)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches that stay small with long texts, and this package on every worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    ship(spark)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a whole text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("__t1"), F.xxhash64(F.lit(7), t).alias("__t2")]

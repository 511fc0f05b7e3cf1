"""Working tables: intermediate results written in the folder that all executors share, so that rounds have short lineages and lost executors cost only their tasks."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; below /tmp only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{(base or '/tmp/checkpoints').rstrip('/')}/curvemill-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended
            return


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet and read again."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table that written() made and that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.search(r"/curvemill-[0-9a-f]{32}$", path):
            _delete(df.sparkSession, path)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What is run inside deletes its shuffle files as soon as it ends, so that steps one after the other hold those of one step only."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def running(df: DataFrame, keys: list[str], order: list[str], amount: str, name: str, total: str = "total") -> DataFrame:
    """df, written, with the running sum of amount within keys, up to and with each row, in an order that no two rows of a group share, and the group's whole sum.

    Rows are dealt to ranges of (keys, order), each range is summed up by itself, and what a group has in earlier ranges is added: a group of any size is
    spread over as many tasks as its rows need, and a task takes in one range."""
    dealt = written(written(df).repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    whole = Window.partitionBy(*keys).orderBy("_range")  # a row a range that the group is in
    parts = dealt.groupBy("_range", *keys).agg(F.sum(amount).alias("_sum"))
    earlier = F.sum("_sum").over(whole.rowsBetween(Window.unboundedPreceding, -1))
    everything = F.sum("_sum").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = parts.select(F.col("_range").alias("_r"), *(F.col(k).alias(f"_{k}") for k in keys), F.coalesce(earlier, F.lit(0)).alias("_before"), everything.alias(total))
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = dealt.withColumn("_inside", F.sum(amount).over(inside)).join(parts, same).withColumn(name, F.col("_inside") + F.col("_before"))
    return out.select(*df.columns, name, total)

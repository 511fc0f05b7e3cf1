"""Working tables in the shared folder, size-checked joins and connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import uuid
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Rows up to which a key table is broadcast (16 bytes a row, so a few MB); beyond it the join shuffles.
BROADCAST_ROWS = 200_000

BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

_made: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; below /tmp only where that setting is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{(base or '/tmp/checkpoints').rstrip('/')}/curvemill-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # the session may have ended
            return


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of BATCH_ROWS or BATCH_BYTES at most, so that long texts don't add up in a worker."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if int(spark.conf.get(key).rstrip("b")) not in range(1, most + 1):
            spark.conf.set(key, str(most))


def tidy(mapper):
    """mapper for mapInPandas or mapInArrow that gives freed memory back to the system at a task's end, so that idle workers stay small."""

    @wraps(mapper)
    def run(frames):
        try:
            yield from mapper(frames)
        finally:
            import pyarrow

            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def save(path: str, data: bytes) -> None:
    """data as a file of any file system that pyarrow knows by URI."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    system.create_dir(os.path.dirname(place), recursive=True)
    with system.open_output_stream(place, compression=None) as out:
        out.write(data)


def load(path: str) -> bytes:
    """The bytes of a file that save() wrote."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with system.open_input_stream(place, compression=None) as file:
        return file.read()


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with so many underscores in front that no column of df (in any case) is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def by_position(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with plain names (c0, c1, ...), and what each column is called there: names with dots, blanks or quotes need no care then. toDF(*df.columns) gives the names back."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), names


def table(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, work_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(keys: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """keys (a written table) with a broadcast hint if its counted rows stay below the limit; otherwise as it is, for a sort-merge join."""
    return F.broadcast(keys) if keys.count() <= limit else keys


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (a, b): root is the smallest node reachable. Alternates large-star and small-star steps, each written, until the edges stay the same."""
    e = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        # large star: every larger neighbour is linked with the smallest of the neighbourhood
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = table(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: every smaller neighbour and the node itself are linked with the smallest
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(low, "a")
        e = table(e.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(e.select("a", F.col("m").alias("b"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots).distinct()


def ranked(rows: DataFrame, *order, name: str = "rank") -> DataFrame:
    """rows (a written table) with their place from 1 in an order of all rows. Rows are dealt to ranges of the order, each range is counted and numbered
    by itself; no task holds more than its range, and rows that are equal in the whole order get places of their own."""
    part, before = fresh(rows, "part", "before")
    dealt = table(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    counts = dealt.groupBy(part).agg(F.count("*").alias(before))  # a row a range
    upto = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(part, F.coalesce(F.sum(before).over(upto), F.lit(0)).alias(before))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return dealt.join(F.broadcast(counts), part).withColumn(name, (inside + F.col(before)).cast("long")).drop(part, before)


#: Pieces that the rows of each key are dealt to where a join by key can't be a broadcast.
SALTS = 64


def by_key(rows: DataFrame, keyed: DataFrame, key: str, spread: Column, limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows with the columns of keyed (a written table, a row a key, null being a key too); rows whose key it lacks go. Broadcast within limit rows of keyed;
    beyond it keyed is repeated SALTS times and the rows of a key are dealt by spread (an integer column), so that a hot key is met in many tasks."""
    k, null, salt = fresh(rows, "k", "null", "salt")
    small = keyed.select(F.coalesce(F.col(key), F.lit("")).alias(k), F.col(key).isNull().alias(null), *(c for c in keyed.columns if c != key))
    same = [(F.coalesce(rows[key], F.lit("")) == F.col(k)), rows[key].isNull() == F.col(null)]
    if keyed.count() <= limit:
        return rows.join(F.broadcast(small), reduce(Column.__and__, same)).drop(k, null)
    many = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same.append(F.pmod(spread, F.lit(SALTS)).cast("int") == F.col(salt))
    return rows.join(many, reduce(Column.__and__, same)).drop(k, null, salt)

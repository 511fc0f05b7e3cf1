"""Sources and sinks: typed CSV and JSON scans, listings, manifests, and sinks that never overwrite by accident.

Paths go to Spark's readers and Hadoop's file systems, so any store that Spark reads will do."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from .leases import Lease

IMAGE_SUFFIXES = ("bmp", "heic", "jpeg", "jpg", "png", "tif", "tiff", "webp")


@dataclass(frozen=True)
class Project:
    """Directories and file names of a project; every key has a default."""

    raw_dir: str = "data/raw"
    curated_dir: str = "data/curated"
    reports_dir: str = "reports"
    submissions_dir: str = "submissions"
    artifacts_dir: str = "artifacts"
    files: dict = field(default_factory=lambda: {"train": "train.csv", "test": "test.csv", "sample_submission": "sample_submission.csv", "ppm": "ppm.csv"})

    @classmethod
    def from_yaml(cls, text: str) -> Project:
        """From the text of a configuration file; unknown keys are an error."""
        import yaml

        return cls(**(yaml.safe_load(text) or {}))

    def path(self, key: str, curated: bool = False) -> str:
        return f"{self.curated_dir if curated else self.raw_dir}/{self.files[key]}"


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Header CSV under an explicit schema; without one all columns are strings. NaN cells of number columns are null."""
    if schema is None:
        return spark.read.csv(path, header=True)
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("float", "double") else F.col(c) for c, t in df.dtypes))


def working(spark: SparkSession, project: Project, key: str, schema: str | None = None) -> DataFrame:
    """The curated table where there is one, else the raw one."""
    curated = project.path(key, curated=True)
    return csv(spark, curated if exists(spark, curated) else project.path(key), schema)


def require(spark: SparkSession, paths: list[str]) -> None:
    if missing := [p for p in paths if not exists(spark, p)]:
        raise FileNotFoundError(", ".join(missing))


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One object a line: a bad line, or one that is no object, raises, or is dropped, whichever columns are used later."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*\{"))
    parsed = lines.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("row"))
    return parsed.where("row._bad is null").select("row.*").drop("_bad")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def listing(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """(path, length) of the files below root with one of the suffixes in any case; a missing root is empty. Contents are not read."""
    if not exists(spark, root):
        return spark.createDataFrame([], "path string, length long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*suffixes))


def images(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """(path, content) for decoders in functions.images.feature_table."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*suffixes)).select("path", "content")


def hashes(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) of the files below root, hashed by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def verify(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Records (path, sha256) with state ok, changed or missing."""
    a = actual.select("path", F.col("sha256").alias("_actual")).distinct()
    state = F.when(F.col("_actual").isNull(), "missing").when(F.col("_actual") == F.col("sha256"), "ok").otherwise("changed")
    return recorded.distinct().join(a, "path", "left").select("path", "sha256", state.alias("state"))


def manifest_records(document: str) -> list[tuple[str, str]]:
    """All {path, sha256} and checkpoint records of a manifest's text, at any depth, each once and in order."""
    found: dict[tuple[str, str], None] = {}
    todo = [json.loads(document)]
    while todo:
        node = todo.pop(0)
        if isinstance(node, dict):
            for a, b in (("path", "sha256"), ("checkpoint_path", "checkpoint_sha256")):
                if a in node and b in node:
                    found[node[a], node[b]] = None
            todo += node.values()
        elif isinstance(node, list):
            todo += node
    return [*found]


def write_csv(df: DataFrame, path: str) -> None:
    """One overwritten folder of CSV files with a header."""
    df.write.mode("overwrite").csv(path, header=True)


def write_new(df: DataFrame, path: str) -> None:
    """Parquet at a path that must not exist."""
    df.write.mode("errorifexists").parquet(path)


def canonical_json(value) -> bytes:
    """Sorted keys, two blanks of indent; NaN and infinities raise."""
    return json.dumps(value, sort_keys=True, indent=2, allow_nan=False).encode()


def _read(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _hadoop(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def save_once(spark: SparkSession, path: str, data: bytes) -> bool:
    """True if written, False if the same bytes are there already; other bytes raise."""
    if exists(spark, path):
        if hashlib.sha256(_read(spark, path)).digest() != hashlib.sha256(data).digest():
            raise FileExistsError(f"{path} holds other content")
        return False
    _write(spark, path, data)
    return True


def replace(spark: SparkSession, path: str, data: bytes) -> None:
    """A file replaced as a whole: written beside it under a name of its own, then renamed over it in one step, so that readers see the old or the new one."""
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    _write(spark, part, data)
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_hadoop(spark, path)[1].toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(_hadoop(spark, part)[1], _hadoop(spark, path)[1], over)


class Run:
    """A run's folder: held by one process at a time, with a receipt before and a record after each request, each written once, and a stop mark.

    It is held by a lease (see leases.py): a holder that dies is followed by another one after `seconds`, and what it writes later is refused. Long runs renew() in time."""

    def __init__(self, spark: SparkSession, path: str, seconds: float = 600.0) -> None:
        self.spark, self.path, self.seconds = spark, path, seconds

    def __enter__(self) -> Run:
        self.lease = Lease.take(f"{self.path}/lease", self.seconds)  # raises where another run holds it
        return self

    def __exit__(self, *_) -> None:
        self.lease.release()

    def renew(self) -> None:
        self.lease.renew()

    def receipt(self, name: str, request: dict) -> bool:
        """Before a request is sent; False where the same one was noted already."""
        self.lease.check()
        return save_once(self.spark, f"{self.path}/receipts/{name}.json", canonical_json(request))

    def record(self, name: str, outcome: dict) -> bool:
        """After it ended, complete or failed; a failure is recorded once and never overwritten. Without a receipt it raises."""
        self.lease.check()
        if not exists(self.spark, f"{self.path}/receipts/{name}.json"):
            raise ValueError(f"no receipt of {name}")
        return save_once(self.spark, f"{self.path}/records/{name}.json", canonical_json(outcome))

    def stop(self) -> None:
        self.lease.check()
        save_once(self.spark, f"{self.path}/stop", b"stop")

    @property
    def stopped(self) -> bool:
        return exists(self.spark, f"{self.path}/stop")


def write_arrays(df: DataFrame, path: str, name: str, values: list[str]) -> None:
    """Array columns of a table as Parquet under their names and a row name, at a path that must not exist."""
    write_new(df.select(F.col(name).alias("name"), *(F.col(c).cast("array<double>") for c in values)), path)


def feature_cache(spark: SparkSession, root: str, identity: dict, build) -> DataFrame:
    """The table that build() gives, kept as Parquet under the hash of its identity; another identity is another table."""
    path = f"{root}/{hashlib.sha256(canonical_json(identity)).hexdigest()}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

"""A table of versions with a commit protocol, and files read in pieces, as Python data sources.

`versions` writes a table so that readers see the old version or the new one, whole. Tasks write Parquet files under names of their own below data/ and report each file's size, rows and content hash;
when all tasks have ended well the driver checks that the files are there in their sizes, notes them in versions/<n>.json and switches the pointer CURRENT to n by one rename. If a task fails for good, what was
written is taken away and the pointer stays; sweep() takes what tasks wrote after that. The content hash is a sum over the rows' hashes, so it doesn't depend on how rows were dealt to tasks (columns of maps have no hash and are refused). A table that is `once` takes its content one time: writing the
same content again changes nothing, other content is refused. Writers with a lease (see leases.py) are refused if it has passed on.

`names` lists files below a root: the driver names the folders in it, a task a folder lists what is below. The names are rows, which are dealt to tasks that read and hash
the files PIECE bytes at a time, so files may be larger than a row can be. A missing root is empty.

Paths are any that pyarrow's file systems read by URI; the driver handles names of folders and of written files and numbers only, never rows."""

from __future__ import annotations

import hashlib
import json
import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a file at most, bytes read at once, and tasks a core that files are dealt to.
FILE_ROWS, PIECE, TASKS = 1_000_000, 8 << 20, 4
#: Each half of a content hash is a sum of 64-bit row hashes modulo this.
HALF = 1 << 64


def store(path: str):
    """pyarrow's file system of a path, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def _bytes(system, path: str) -> bytes | None:
    try:
        with system.open_input_stream(path, compression=None) as file:
            return file.read()
    except FileNotFoundError:
        return None


def put(system, path: str, data: bytes) -> None:
    """data at path in one step: written beside it, then moved over it."""
    system.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part, compression=None) as out:
        out.write(data)
    system.move(part, path)


#: Columns that write_version() adds: two hashes of a row, which the writer sums up and leaves out.
HASHES = ("_content_a", "_content_b")


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]
    content: tuple[int, int]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.once, self.lease, self.run = options["path"], options.get("once") == "true", options.get("lease"), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq

        system, root = store(self.path)
        files, content, out, name, rows = [], [0, 0], None, "", 0
        system.create_dir(f"{root}/data/{self.run}", recursive=True)

        def close() -> None:
            out.close()
            files.append({"name": name, "rows": rows, "bytes": system.get_file_info(f"{root}/{name}").size})

        for batch in iterator:
            for i, h in enumerate(HASHES):
                content[i] = (content[i] + int(batch.column(h).to_numpy().view(np.uint64).sum(dtype=np.uint64))) % HALF
            batch = batch.drop_columns(list(HASHES))
            if out is None or rows >= FILE_ROWS:
                if out is not None:
                    close()
                name, rows = f"data/{self.run}/{uuid.uuid4().hex}.parquet", 0
                out = pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=system)
            out.write_table(pa.Table.from_batches([batch]))
            rows += batch.num_rows
        if out is not None:
            close()
        return Written(files, tuple(content))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = store(self.path)
        if any(m is None for m in messages):
            raise ValueError("a task has not said what it wrote")
        files = [f for m in messages for f in m.files]
        for f in files:
            if system.get_file_info(f"{root}/{f['name']}").size != f["bytes"]:
                raise ValueError(f"{f['name']} is not what its task wrote")
        content = "".join(f"{sum(m.content[i] for m in messages) % HALF:016x}" for i in range(2))
        if self.lease:
            from .leases import Lease

            Lease.from_token(self.lease).check()
        old = current(self.path)
        if old and self.once:
            self._drop(system, root)
            if old["content"] != content:
                raise FileExistsError(f"{self.path} holds other content")
            return
        version = (old["version"] if old else 0) + 1
        known = {"version": version, "content": content, "rows": sum(f["rows"] for f in files), "files": sorted(files, key=lambda f: f["name"])}
        put(system, f"{root}/versions/{version}.json", json.dumps(known, sort_keys=True, indent=2).encode())
        put(system, f"{root}/CURRENT", str(version).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._drop(*store(self.path))

    def _drop(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/data/{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/data/{self.run}")


class Versions(DataSource):
    """The sink of write_version(), which adds the columns that it needs."""

    @classmethod
    def name(cls) -> str:
        return "versions"

    def schema(self) -> str:
        raise NotImplementedError("read_version() reads the files of a version with Spark's own reader")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def current(path: str, version: int | None = None) -> dict | None:
    """What is noted of the current version, or of another one; None where there is none."""
    system, root = store(path)
    if version is None:
        at = _bytes(system, f"{root}/CURRENT")
        if at is None:
            return None
        version = int(at)
    noted = _bytes(system, f"{root}/versions/{version}.json")
    return json.loads(noted) if noted else None


def write_version(df: DataFrame, path: str, once: bool = False, lease=None) -> dict:
    """df as the next version of the table at path; once: as its only content. Returns what is noted of the current version."""
    df.sparkSession.dataSource.register(Versions)
    options = {"path": path, "once": str(once).lower()} | ({"lease": lease.token()} if lease else {})
    marks = {name: F.xxhash64(F.lit(i), *(F.col(f"`{c.replace('`', '``')}`") for c in df.columns)) for i, name in enumerate(HASHES)}
    df.withColumns(marks).write.format("versions").mode("append").options(**options).save()
    return current(path)


def read_version(spark: SparkSession, path: str, schema: StructType | str, version: int | None = None) -> DataFrame:
    """The current version of a table, or another one, read by Spark's own reader."""
    noted = current(path, version)
    files = [f"{path}/{f['name']}" for f in noted["files"]] if noted else []
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def sweep(path: str, seconds: float = 86_400.0) -> int:
    """Takes away what no version names and nobody has written to for so long: the files of tasks that outlived a failed write. Returns the number of writes swept."""
    from pyarrow import fs

    system, root = store(path)
    below = lambda name, deep=False: system.get_file_info(fs.FileSelector(f"{root}/{name}", allow_not_found=True, recursive=deep))
    named = {f["name"].split("/")[1] for v in below("versions") if v.base_name.endswith(".json") for f in json.loads(_bytes(system, v.path))["files"]}
    swept = 0
    for folder in below("data"):
        times = [i.mtime.timestamp() for i in [folder, *below(f"data/{folder.base_name}", True)] if i.mtime]
        if folder.base_name not in named and max(times, default=0.0) < time.time() - seconds:
            system.delete_dir(folder.path)
            swept += 1
    return swept


@dataclass
class _Folder(InputPartition):
    name: str
    deep: bool


class _NamesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.suffixes = options["path"], tuple(x for x in options.get("suffixes", "").split(",") if x)

    def partitions(self) -> list[InputPartition]:
        """The root itself, and each folder in it with all below."""
        from pyarrow import fs

        system, root = store(self.path)
        there = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [_Folder("", False), *(_Folder(i.base_name, True) for i in sorted(there, key=lambda i: i.path) if i.type == fs.FileType.Directory)]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        from pyarrow import fs

        system, root = store(self.path)
        for i in system.get_file_info(fs.FileSelector(posixpath.join(root, partition.name), allow_not_found=True, recursive=partition.deep)):
            if i.is_file and (not self.suffixes or i.path.lower().endswith(self.suffixes)):
                yield posixpath.relpath(i.path, root), i.size


class Names(DataSource):
    @classmethod
    def name(cls) -> str:
        return "names"

    def schema(self) -> str:
        return "path string, length bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _NamesReader(dict(self.options))


def listed_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(path below root, length) of the files below root with one of the suffixes (lower case)."""
    spark.dataSource.register(Names)
    return spark.read.format("names").options(path=root, suffixes=",".join(suffixes)).load()


def hashed_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (), piece: int = PIECE) -> DataFrame:
    """(path below root, length, sha256) of the files below root with one of the suffixes (lower case), of any size."""
    import pyarrow as pa

    def read(batches: Iterator) -> Iterator:
        system, place = store(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                sha, size = hashlib.sha256(), 0
                with system.open_input_stream(f"{place}/{path}", compression=None) as file:
                    while data := file.read(piece):
                        sha.update(data)
                        size += len(data)
                yield pa.RecordBatch.from_pydict({"path": [path], "length": pa.array([size], pa.int64()), "sha256": [sha.hexdigest()]})

    names = listed_files(spark, root, suffixes).select("path").repartition(TASKS * spark.sparkContext.defaultParallelism, "path")
    return names.mapInArrow(read, "path string, length bigint, sha256 string")

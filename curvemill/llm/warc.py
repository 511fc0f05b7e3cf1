"""WARC files: a writer with revisit records and a sequential reader.

One gzip member a record. The reader takes the compressed bytes in steps, inflates member after member, frames each record by
its Content-Length, and checks block and payload digests; a record that is cut off, misframed or changed raises WarcError.

Records with equal payloads of at least `least` bytes are revisits of that with the smallest page_id. Null html is an
empty payload, a null url leaves the target out, a null page_id is never referred to while others exist; repeated rows of
the smallest page_id are all responses. A page of any length is one record, held whole by one task while it is written and inflated in steps while it is read; an empty table gives no
archives and no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .shared import save, sized, small_batches, table, work_dir

#: Compressed bytes after which an archive ends with the record at hand.
ARCHIVE = 16_000_000
STEP = 65_536
LEVEL = 4
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAME = "urn:page:"


class WarcError(ValueError):
    pass


class Record(NamedTuple):
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + block + b"\r\n\r\n") + squeeze.flush()


def written(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member: a response, or a revisit of the page refers_to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{_NAME}{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    headers += [("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]"))] if url is not None else []
    headers += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_NAME}{refers_to}>")]
    return _member(headers, block)


def steps(data: bytes) -> Iterator[bytes]:
    for i in range(0, len(data), STEP):
        yield data[i : i + STEP]


def _members(parts: Iterable[bytes]) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one at a time."""
    inflate, held = zlib.decompressobj(31), []
    fresh = True
    for part in parts:
        while part:
            fresh = False
            try:
                held.append(inflate.decompress(part))
            except zlib.error as e:
                raise WarcError(f"broken gzip member: {e}") from e
            part = inflate.unused_data
            if inflate.eof:
                yield b"".join(held)
                inflate, held, fresh = zlib.decompressobj(31), [], True
    if not fresh:
        raise WarcError("the last gzip member is cut off")


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def records(parts: Iterable[bytes]) -> Iterator[Record]:
    """The records of one archive, given as pieces of its compressed bytes."""
    for member in _members(parts):
        head, mark, rest = member.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        if not mark or not lines[0].startswith("WARC/"):
            raise WarcError("a record has no WARC header")
        headers = _fields(lines[1:])
        try:
            size = int(headers["content-length"])
        except (KeyError, ValueError) as e:
            raise WarcError("a record has no Content-Length") from e
        block = rest[:size]
        if len(block) < size or rest[size:] != b"\r\n\r\n":
            raise WarcError(f"a record of {len(rest)} bytes is not framed by its Content-Length {size}")
        if headers.get("warc-block-digest", (want := f"sha1:{digest(block)}")) != want:
            raise WarcError("a block digest differs")
        http, _, payload = block.partition(b"\r\n\r\n")
        if headers.get("warc-type") == "response" and headers.get("warc-payload-digest", (want := f"sha1:{digest(payload)}")) != want:
            raise WarcError("a payload digest differs")
        yield Record(headers, _fields(http.decode("latin-1").split("\r\n")[1:]), payload)


def write_archives(pages: DataFrame, folder: str, least: int = 0, size: int = ARCHIVE) -> DataFrame:
    """Writes pages (page_id, url, html) as archives below folder; returns the written manifest (file, n)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    key = F.sha1(F.col("html").cast("binary"))
    first = pages.where(F.octet_length("html") >= least).groupBy(key.alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = table(first.where("n > 1").select("digest", "first"))
    # a written side lets a digest that very many pages share be split among tasks
    marked = pages.withColumn("digest", key).join(first, "digest", "left").select("page_id", "url", "html", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = [], 0

        def out() -> pd.DataFrame:
            name = f"{uuid.uuid4().hex}.warc.gz"
            save(f"{folder}/{name}", b"".join(held))
            return pd.DataFrame([(name, len(held))], columns=["file", "n"])

        for frame in frames:
            for page_id, url, html, refers_to in zip(*(frame[c] for c in ("page_id", "url", "html", "refers_to")), strict=True):
                held.append(written(*(None if pd.isna(x) else int(x) if not isinstance(x, str) else x for x in (page_id, url)), html.encode(), None if pd.isna(refers_to) else int(refers_to)))
                total += len(held[-1])
                if total >= size:
                    yield out()
                    held, total = [], 0
        if held:
            yield out()

    return table(marked.mapInPandas(write, "file string, n long"))


def _number(name: str | None) -> int | None:
    number = (name or "").strip("<>").removeprefix(_NAME)
    return int(number) if number else None


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of all records in the archives that the manifest names."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame["file"], frame["content"], strict=True):
                rows = []
                for r in records(steps(data)):
                    h = r.headers
                    rows.append((file, _number(h["warc-record-id"]), int(r.http["content-length"]), h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], _number(h.get("warc-refers-to")), h.get("warc-target-uri")))
                out = pd.DataFrame(rows, columns=["file", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    spark = manifest.sparkSession
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInPandas(read, f"file string, {schema}").join(sized(manifest.select("file")), "file", "left_semi").drop("file")


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages written as archives in a new shared folder and read back."""
    small_batches(pages.sparkSession)
    folder = f"{work_dir(pages.sparkSession)}/warc"
    return read_archives(write_archives(pages, folder, least), folder)

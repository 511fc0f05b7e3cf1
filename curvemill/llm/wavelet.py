"""Token ids in wavelet-matrix shards: one compressed file a shard, with access, counting and lookup by rank and select.

A shard holds the ids of consecutive documents in ascending doc_id order as bit planes, from the highest bit down: each
plane lists one bit of every id, stably dealt by the bits above. A file has the planes in blocks of BLOCK bits, each packed with zstandard on
its own, the documents' ids and lengths, and a footer with the place of every block and the rank directory: the ones before each block.
Access, counting and lookup read the footer and then only the blocks that they need.

Tasks write shards through pyarrow's file systems to the shared folder, each under a name of its own attempt; the written
manifest names those that count, so retried or lost tasks leave no trace in the results. Null texts count as empty and
have the end id alone; rows with equal doc_id stand next to each other; a null doc_id comes first. Texts of any length are encoded whole;
an empty table gives no files and no rows; other columns are not looked at.
"""

from __future__ import annotations

import gc
import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import MARKS, Kept, chunks, plain
from .shared import save, sized, small_batches, table, tidy, work_dir

MAGIC = b"WAVM2\n"
#: Bits of a block, a multiple of eight.
BLOCK = 1 << 16
#: Blocks that an open plane keeps.
HELD = 4
#: Ids after which a shard ends with the document at hand.
SHARD = 1_000_000


class Plane:
    """n bits with rank and select. before: the ones before each block, and all of them; block: the packed bits of a block."""

    def __init__(self, n: int, before: np.ndarray, block: Callable[[int], np.ndarray]) -> None:
        self.n, self.before, self.block = n, before, block

    @classmethod
    def of(cls, packed: np.ndarray, n: int) -> Plane:
        size = BLOCK // 8
        parts = [packed[k : k + size] for k in range(0, len(packed), size)]
        return cls(n, np.cumsum([0, *(int(np.bitwise_count(p).sum(dtype=np.int64)) for p in parts)]), parts.__getitem__)

    def bits(self) -> np.ndarray:
        return np.unpackbits(np.concatenate([self.block(k) for k in range(len(self.before) - 1)] or [np.empty(0, np.uint8)]), count=self.n)

    def bit(self, i: int) -> int:
        k, i = divmod(i, BLOCK)
        return int(self.block(k)[i >> 3]) >> (7 - (i & 7)) & 1

    def ones(self, i: int) -> int:
        """Ones before position i."""
        k, i = divmod(i, BLOCK)
        out = int(self.before[k])
        if i:
            block = self.block(k)
            out += int(np.bitwise_count(block[: i >> 3]).sum(dtype=np.int64))
            out += (int(block[i >> 3]) >> (8 - (i & 7))).bit_count() if i & 7 else 0
        return out

    def find(self, bit: int, k: int) -> int:
        """Position of the k-th (from 0) one or zero."""
        count = self.before if bit else np.minimum(np.arange(len(self.before)) * BLOCK, self.n) - self.before
        block = int(np.searchsorted(count, k, "right")) - 1
        bits = np.unpackbits(self.block(block), count=min(BLOCK, self.n - block * BLOCK))
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(count[block])])


class WaveletMatrix:
    def __init__(self, planes: list[Plane], zeros: list[int], n: int) -> None:
        self.planes, self.zeros, self.n = planes, zeros, n

    @classmethod
    def of(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros, x = [], [], ids
        for b in range(bits - 1, -1, -1):
            one = (x & x.dtype.type(1 << b)).astype(bool)
            planes.append(Plane.of(np.packbits(one), len(x)))
            down = x[~one]
            zeros.append(len(down))
            x = np.concatenate([down, x[one]])
        return cls(planes, zeros, len(ids))

    def all(self) -> np.ndarray:
        """Every id, plane by plane from the lowest: each plane says where the values below it came from."""
        x = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            one = plane.bits().view(bool)
            x[zeros:] |= x.dtype.type(1 << k)
            up = np.empty_like(x)
            up[np.flatnonzero(~one)], up[np.flatnonzero(one)] = x[:zeros], x[zeros:]
            x = up
        return x

    def access(self, i: int) -> int:
        out = 0
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            bit, ones = plane.bit(i), plane.ones(i)
            out, i = out << 1 | bit, zeros + ones if bit else i - ones
        return out

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        for k, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            a, b = plane.ones(begin), plane.ones(end)
            begin, end = (zeros + a, zeros + b) if token >> (len(self.planes) - 1 - k) & 1 else (begin - a, end - b)
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """Occurrences of token in [begin, end)."""
        a, b = self._range(token, begin, self.n if end is None else end)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of token."""
        begin, end = self._range(token, 0, self.n)
        if not 0 <= k < end - begin:
            raise IndexError(k)
        i = begin + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            i = self.planes[level].find(bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    """One shard file: blocks of planes, the documents' ids and lengths, and the footer."""
    m = WaveletMatrix.of(ids, bits)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    parts = [[squeeze(p.block(k).tobytes()) for k in range(len(p.before) - 1)] for p in m.planes]
    documents = [squeeze(json.dumps(doc_ids).encode()), squeeze(np.array(lengths, "<i8").tobytes())]
    footer = {"n": m.n, "zeros": m.zeros, "before": [p.before.tolist() for p in m.planes], "sizes": [[len(b) for b in blocks] for blocks in parts], "documents": [len(d) for d in documents]}
    end = squeeze(json.dumps(footer).encode())
    return b"".join([*(b for blocks in parts for b in blocks), *documents, end, struct.pack("<I", len(end)), MAGIC])


class Shard:
    """A shard file that is read in pieces: read(begin, n) gives n of its size bytes."""

    def __init__(self, read: Callable[[int, int], bytes], size: int) -> None:
        self.read = read
        tail = len(MAGIC) + 4
        if size < tail or (end := read(size - tail, tail))[4:] != MAGIC:
            raise ValueError("not a shard file")
        length = struct.unpack("<I", end[:4])[0]
        footer = json.loads(self._part(size - tail - length, length))
        at, planes = 0, []
        for before, sizes in zip(footer["before"], footer["sizes"], strict=True):
            begins = np.cumsum([at, *sizes]).tolist()
            planes.append(Plane(footer["n"], np.array(before), lru_cache(HELD)(partial(self._block, begins))))
            at = begins[-1]
        self.matrix, self._documents = WaveletMatrix(planes, footer["zeros"], footer["n"]), (at, *footer["documents"])

    @classmethod
    def open(cls, path: str) -> Shard:
        """The shard at a path of any file system that pyarrow knows by URI."""
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        file = system.open_input_file(place)
        return cls(lambda begin, n: file.read_at(n, begin), file.size())

    def _part(self, begin: int, n: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.read(begin, n))

    def _block(self, begins: list[int], k: int) -> np.ndarray:
        return np.frombuffer(self._part(begins[k], begins[k + 1] - begins[k]), np.uint8)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """The documents' ids and lengths in order."""
        at, a, b = self._documents
        return json.loads(self._part(at, a)), np.frombuffer(self._part(at + a, b), "<i8")


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """doc_ids, lengths and matrix of a shard file."""
    shard = Shard(lambda begin, n: data[begin : begin + n], len(data))
    return *shard.documents(), shard.matrix


def lowered(text: str) -> str:
    """text in lower case, as the library writes it anyway, where that changes no id: below U+0100 nothing composes, and special tokens begin with <. Other texts stay as they are."""
    if "<" in text:
        return text
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


class _Library:
    """The tokenizers library over chunks, with a bounded table of known ones."""

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(spec)
        self.model.no_truncation()
        self.model.no_padding()
        self.bits = max(1, (max(self.model.get_vocab_size(), 2) - 1).bit_length())
        self.kind = np.dtype("<u2") if self.bits <= 16 else np.dtype("<u4")
        self.tokenize = self.model.model.tokenize
        self.bytes_of = [i.to_bytes(self.kind.itemsize, "little") for i in range(1 << self.bits)]
        self.known, self.marks = Kept(self.encoded), Kept(self.marked)

    def encoded(self, chunk: str) -> bytes:
        """Ids of a chunk; plain words are pre-tokens already and go straight to the library's model."""
        of, head = self.bytes_of, chunk.rstrip(MARKS)
        if head.isascii() and head.isalpha():
            ids = b"".join([of[t.id] for t in self.tokenize(head.lower())])
            return ids if len(head) == len(chunk) else ids + self.marks[chunk[len(head) :]]
        if simple := plain(chunk):
            word, marks = simple
            ids = b"".join([of[t.id] for t in self.tokenize(word)]) if word else b""
            return ids + self.marks[marks] if marks else ids
        return b"".join([of[i] for i in self.model.encode(chunk, add_special_tokens=False).ids])

    def marked(self, marks: str) -> bytes:
        """Ids of a run of marks."""
        return b"".join([self.bytes_of[t.id] for t in self.tokenize(marks)])

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, chunks(lowered(text))))


_libraries: dict[int, _Library] = {}


def library_of(spec: str) -> _Library:
    """The library's model, kept for later tasks of this process."""
    if (key := hash(spec)) not in _libraries:
        _libraries.clear()
        _libraries[key] = _Library(spec)
        gc.freeze()  # what is loaded by now stays: collections need not look at it
    return _libraries[key]


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = 1, shard: int = SHARD) -> DataFrame:
    """Writes docs (doc_id, text) as shards below folder; the manifest (part, number, file, n_docs, n_tokens), itself written, orders them by (part, number)."""
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        library, part, number = library_of(spec.value), TaskContext.get().partitionId(), 0
        end = np.array([end_id], library.kind).tobytes()
        doc_ids, lengths, held, size = [], [], [], 0

        def out() -> pd.DataFrame:
            name = f"{part:06d}-{number:06d}-{uuid.uuid4().hex}.wm"
            save(f"{folder}/{name}", pack(doc_ids, lengths, np.frombuffer(b"".join(held), library.kind), library.bits))
            return pd.DataFrame([(part, number, name, len(doc_ids), sum(lengths))], columns=["part", "number", "file", "n_docs", "n_tokens"])

        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids = library.ids(text or "")
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                held += [ids, end]
                lengths.append(len(ids) // library.kind.itemsize + 1)
                size += lengths[-1]
                if size >= shard:
                    yield out()
                    doc_ids, lengths, held, size, number = [], [], [], 0, number + 1
        if doc_ids:
            yield out()
        library.known.empty()  # idle workers stay small
        library.marks.empty()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return table(rows.mapInPandas(tidy(write), "part int, number int, file string, n_docs long, n_tokens long"))


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents in the shards that the manifest names."""
    # where each shard begins: sums over the parts, then within each
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("part").orderBy("number")
    begins = manifest.join(parts, "part").select("file", (F.col("base") + F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("base"))
    begins = table(begins)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame["file"], frame["content"], strict=True):
                doc_ids, lengths, matrix = unpack(data)
                ids = matrix.all().astype("<u4")
                if len(ids) and matrix.count(int(ids[-1])) != np.count_nonzero(ids == ids[-1]):
                    raise ValueError(f"the rank directory of {file} does not fit its planes")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, lengths, strict=True)]
                yield pd.DataFrame({"file": file, "doc_id": pd.array(doc_ids, "Int64"), "at": ends - lengths, "n_tokens": lengths, "ids_crc32": crc})

    spark = manifest.sparkSession
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    rows = files.mapInPandas(tidy(read), "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(sized(begins), "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str) -> DataFrame:
    """docs written as shards in a new shared folder and read back."""
    small_batches(docs.sparkSession)
    folder = f"{work_dir(docs.sparkSession)}/shards"
    return read_shards(write_shards(docs, path, folder), folder)

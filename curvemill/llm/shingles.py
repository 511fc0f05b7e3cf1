"""Word and shingle hashes of many texts at once, with NumPy, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
#: The white space that ends a word: space and U+0009 to U+000D.
SPACE = b" \t\n\x0b\x0c\r"

_rng = np.random.Generator(np.random.PCG64(20_231))
_odd = lambda n: _rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _odd(256)
_BYTE[[*range(65, 91)]] = _BYTE[[*range(97, 123)]]
_BYTE[[*SPACE]] = 0
_BLANK = np.zeros(256, bool)
_BLANK[[*SPACE]] = True
#: Blanks of the second kind of word: also ASCII punctuation.
_MARKS = _BLANK.copy()
_MARKS[[*b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
_BASE = int(_odd(1)[0])
_PLACE = _odd(WORDS)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse modulo 2 ** 64 for i below n at least."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list[bytes], marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z as a-z) of all texts in order, and where each text's words begin (one entry more than texts). marks: punctuation separates words as blanks do."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    blank = (_MARKS if marks else _BLANK)[buf]
    begin = ~blank
    begin[1:] &= blank[:-1]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    up, down = _power(len(buf))
    value = _BYTE[buf] * up[: len(buf)]
    if marks:
        value[blank] = 0
    hashes = np.add.reduceat(value, starts) * down[starts]
    return mix(hashes), np.searchsorted(starts, at)


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes: windows of five words, or the whole sequence of fewer; empty without words."""
    words, at = word_hashes([t or b"" for t in texts])
    n = len(words)
    full = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(WORDS, n)):
            full[: n - k] += words[k:] * _PLACE[k]
    full = mix(full)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= WORDS:
            s = np.sort(full[a : b - WORDS + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            yield mix((words[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def pieces(texts: list[bytes | None], size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about size bytes each (or one text); the tables of long texts go at the end."""
    begin = total = 0
    for i, t in enumerate(texts):
        total += len(t or b"") + 1
        if total >= size or i == len(texts) - 1:
            yield begin, i + 1
            begin, total = i + 1, 0
    _powers.clear()


def utf8(values) -> list[bytes | None]:
    return [None if t is None else t.encode("utf-8", "surrogatepass") for t in values]


def batches(frames: Iterator, column: str = "text", size: int = 1_000_000) -> Iterator[tuple]:
    """Pieces of pandas frames with at most about size bytes of column each (or one row), and its values as UTF-8."""
    for frame in frames:
        texts = utf8(frame[column])
        for a, b in pieces(texts, size):
            yield frame.iloc[a:b], texts[a:b]


def select_rows(docs, wanted, column: str = "text"):
    """The rows of docs for which wanted(values of column) gives True, all columns as they are: rows are told apart by where they stand, not by any id."""
    import pyarrow as pa

    from .shared import by_position, tidy

    at, (plain, _) = docs.columns.index(column), by_position(docs)

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.filter(pa.array(wanted(part.column(at).to_pylist()), pa.bool_()))

    return plain.mapInArrow(tidy(keep), plain.schema).toDF(*docs.columns)

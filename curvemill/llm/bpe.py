"""BPE encoding and decoding from a public tokenizer file (byte-level BPE with an end-of-word suffix).

The encoder walks a word with an Aho-Corasick automaton over all tokens' bytes: at each place it takes the longest
token that may follow the previous one, and steps back where none may. Two tokens may be neighbours if no merge across
their border comes before the merges that make them; such answers are kept in the pair-compatibility table. A
token sequence whose neighbours are all compatible is the one that the merges give, so the ids are exact; each place is
left once at most. Decoding reads a table of offsets into the joined token strings.

Texts are cut into chunks at spaces and line feeds (no token spans them), and a bounded table of frequent chunks is kept
in each worker. Null and empty texts have no ids; the file's special tokens are recognised inside texts as the
tokenizers library does; lone surrogates cannot occur in UTF-8 columns. Texts of any length are encoded whole; repeated rows are encoded each; an empty table gives no rows; other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from .shared import small_batches, tidy

#: Chunks and words that a task keeps at most (about 150 bytes each).
KEPT = 150_000
NONE = 1 << 30
#: Ids that are turned into text at once.
STEP = 100_000


class Kept(dict):
    """What make(key) gives, kept for the latest keys: at the limit the table becomes the older generation, from which keys that are still used move back."""

    def __init__(self, make, limit: int = KEPT) -> None:
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def empty(self) -> None:
        self.clear()
        self.older = {}

    def __missing__(self, key):
        if (value := self.older.get(key)) is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


#: ASCII marks that may follow a word in a chunk without joining it: all but the apostrophe and the sign that begins special tokens.
MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: itself where visible, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


LETTERS = _byte_letters()
_LATIN = {i: "".join(LETTERS[b] for b in chr(i).encode()) for i in range(128, 0x300)}


def plain(chunk: str) -> tuple[str, str] | None:
    """(letters in lower case and in the letters of bytes, marks) of a chunk of that form, else None.

    Below U+0300 there are no combining marks, so normalization keeps the text, and letters and marks are one pre-token each.
    A few of these letters have a lower case beyond it (U+0130, U+023A, U+023E); they are left to the full path."""
    if chunk.isascii() and chunk.isalpha():
        return chunk.lower(), ""
    head = chunk.rstrip(MARKS)
    if not head:
        return "", chunk
    if not head.isalpha():
        return None
    if head.isascii():
        return head.lower(), chunk[len(head) :]
    lower = head.lower()
    if max(head) >= "\u0300" or max(lower) >= "\u0300":
        return None
    return lower.translate(_LATIN), chunk[len(head) :]


def _assigned(part: str) -> bool:
    """Whether unicodedata knows all characters of part; regex and the library have other versions, and agree on those only."""
    return part.isascii() or all(unicodedata.category(c) != "Cn" for c in part)


class BytePairs:
    """Vocabulary, merges and automaton of one tokenizer file, made once a worker."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        model = data["model"]
        if model["type"] != "BPE" or data.get("decoder") is not None or [n["type"] for n in data["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("a word-level BPE file with NFC, white space and lower case normalizers is needed")
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.pattern = regex.compile(data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # the file without its vocabulary, and the library's tokenizer of it, made where needed
        self.shell = json.dumps(data | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None})
        self.library = None
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.rank = {(self.vocab[a], self.vocab[b]): (i, self.vocab[a + b]) for i, (a, b) in enumerate(model["merges"])}
        self.size = max([*self.vocab.values(), *self.special.values()]) + 1
        text = [""] * self.size
        for t, i in [*self.vocab.items(), *self.special.items()]:
            text[i] = t
        self.text = text
        # the offset tables: where each token's string, and its id in decimals, begins and ends in the joined ones, with a space after each
        self.strings = _offsets([t.encode() for t in text])
        self.decimals = _offsets([b"%d" % i for i in range(self.size)])
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.bytes_of = [i.to_bytes(self.kind.itemsize, "little") for i in range(self.size)]
        self.tree = ahocorasick.Automaton()
        for t, i in self.vocab.items():
            # the last letter with the suffix counts as one symbol; it is written after the word as an end mark
            self.tree.add_word(t.removesuffix(self.suffix) + "\x00" if t.endswith(self.suffix) and t != self.suffix else t, i)
        self.tree.make_automaton()
        # how each token is made: (rank, left, right); its length in the automaton's letters
        self.made: dict[int, tuple[int, int, int]] = {}
        for (a, b), (i, c) in self.rank.items():
            if c not in self.made:
                self.made[c] = (i, a, b)
        self.length = [len(t) - len(self.suffix) + 1 if t.endswith(self.suffix) and t != self.suffix else len(t) for t in text]
        self.pairs: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.words, self.chunks = Kept(self.split), Kept(self.chunk)

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts at a token's left (0) or right (1) end from single symbol to whole token, each with the rank of the merge that takes it up (NONE: none)."""
        if (known := self.edges[side].get(token)) is None:
            known, above = [], NONE
            part = token
            while True:
                known.append((part, above))
                if (made := self.made.get(part)) is None:
                    break
                above, part = made[0], made[1 + side]
            known.reverse()
            self.edges[side][token] = known
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b side by side: no merge across their border comes before those that take up its two sides.

        Of equal ranks (one rule, overlapping) the left one is first."""
        key = a * self.size + b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > KEPT:
                self.pairs.clear()
            left, right, i, j, known = self.edge(a, 1), self.edge(b, 0), 0, 0, True
            while True:
                (x, up_x), (y, up_y) = left[i], right[j]
                rank = self.rank.get((x, y), (NONE, 0))[0]
                if rank < up_x and rank <= up_y and rank != NONE:
                    known = False
                    break
                if up_x == up_y == NONE:
                    break
                if up_x <= up_y:
                    i += 1
                else:
                    j += 1
            self.pairs[key] = known
        return known

    def split(self, word: str) -> bytes:
        """Ids (as kind) of one pre-token, already in the letters of bytes."""
        marked = word + "\x00"
        # most words need no step back: the longest tokens one after the other are all compatible
        fast, at, before = [], 0, -1
        for end, token in self.tree.iter_long(marked):
            if end + 1 - self.length[token] != at or before >= 0 and not self.compatible(before, token):
                break
            fast.append(token)
            at, before = end + 1, token
        if at == len(marked):
            return b"".join([self.bytes_of[t] for t in fast])
        n = len(word)
        # ends[i]: tokens that begin at i, by length; the automaton gives all matches by their ends
        begins: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, token in self.tree.iter(marked):
            t = self.text[token]
            if end == n:  # with the end mark
                begins[n - len(t) + len(self.suffix)].append((n, token))
            elif end < n - 1:  # the last letter is only a symbol with the end mark
                begins[end + 1 - len(t)].append((end + 1, token))
        for found in begins:
            found.sort(reverse=True)
        path: list[tuple[int, int, int]] = []  # begin, which of its matches, token
        dead = bytearray(n + 1)
        at = which = 0
        while at < n:
            found = begins[at]
            before = path[-1][2] if path else -1
            while which < len(found):
                end, token = found[which]
                if not dead[end] and (before < 0 or self.compatible(before, token)):
                    break
                which += 1
            else:
                dead[at] = 1
                if not path:
                    raise ValueError(f"no tokens give {word!r}")
                at, which, _ = path.pop()
                which += 1
                continue
            path.append((at, which, token))
            at, which = end, 0
        return b"".join([self.bytes_of[p[2]] for p in path])

    def pieces(self, part: str) -> list[str]:
        """The words of a text without special tokens, in the letters of bytes."""
        part = regex.sub(r"\s+", " ", unicodedata.normalize("NFC", part))
        part = part.lower() if part.isascii() else "".join(c.lower() for c in part)
        return ["".join([LETTERS[b] for b in w.encode()]) for w in self.pattern.findall(part)]

    def library_pieces(self, part: str) -> list[str]:
        """The same by the library's normalizer and pre-tokenizer, for characters newer than unicodedata's version."""
        if self.library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.shell)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]

    def chunk(self, chunk: str) -> bytes:
        """Ids (as kind) of a text without spaces or line feeds, or of any text."""
        if simple := plain(chunk):
            word, marks = simple
            return self.words[word] + self.words[marks] if word and marks else self.words[word or marks] if word or marks else b""
        out: list[bytes] = []
        for k, part in enumerate(self.cut.split(chunk) if self.cut else [chunk]):
            if k % 2:
                out.append(self.bytes_of[self.special[part]])
                continue
            for w in self.pieces(part) if _assigned(part) else self.library_pieces(part):
                out.append(self.words[w])
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; those of its chunks are kept for as long as the table of chunks has room."""
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, chunks(text))), self.kind)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings joined by one space, in UTF-8, as a file without a decoder gives them; special tokens stay."""
        return _joined(self.strings, ids)


def _offsets(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The parts joined, a space after each, and where each begins (one entry more than parts)."""
    return np.frombuffer(b"".join([p + b" " for p in parts]), np.uint8), np.cumsum([0, *(len(p) + 1 for p in parts)])


def _joined(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> bytes:
    """The table's parts at ids, joined by one space; long texts in steps."""
    (text, offset), out = table, []
    for i in range(0, len(ids), STEP):
        some = ids[i : i + STEP].astype(np.int64)
        begin = offset[some]
        length = offset[some + 1] - begin
        ends = np.cumsum(length)
        out.append(text[np.arange(ends[-1]) + np.repeat(begin - ends + length, length)].tobytes())
    return b"".join(out)[:-1]


def chunks(text: str) -> list[str]:
    """The pieces between white space; joining their ids gives the ids of the text. Python also splits at four controls that are no white space to the library."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return [c for c in text.replace("\n", " ").split(" ") if c]
    return text.split()


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs (doc_id, text). path: the tokenizer file, read by the driver (2 MB) and sent to the workers."""
    small_batches(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = BytePairs(spec.value)  # made anew in a third of a second, so that idle workers hold nothing
        sha = hashlib.sha256
        for frame in frames:
            rows = []
            for text in frame["text"]:
                ids = pairs.encode(text or "")
                rows.append((len(ids), sha(_joined(pairs.decimals, ids)).hexdigest(), sha(pairs.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(doc_id=frame["doc_id"].astype("Int64").to_numpy())[["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(tidy(digests), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

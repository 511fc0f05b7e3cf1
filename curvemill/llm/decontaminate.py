"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, then a check of question and answer.

Documents are cut into passages of 2 * stride words, overlapping by half. An item's stride is the least of STRIDE, 2 * STRIDE, 4 * STRIDE and so on
that is not below its length, so every item lies whole in some passage, and how it is found does not depend on other items' lengths.
Each passage is a query of its distinct words against the items of its stride; weights are BM25's with document frequencies, count and
mean length of all items, divided by the item's own score, so that a score of 1 means all of an item's words. All items
of at least THRESHOLD are retrieved: first a bound is taken over whole batches (the sum over the passage's rare terms plus
all that an item's common terms can add), and passages that the bound leaves are searched with block-max WAND. What is
retrieved is verified: PART of the word sequences of the item's question and of its answer must stand in the passage.

The question of an item ends at its last question mark or line feed, else after two thirds of its words. The statistics are added up in
Spark; the index is made in tasks, in files of at most ITEMS items of one stride in the shared folder. Documents are read once,
whatever the number of files: tasks hold up to HELD files and take more one after the other. How items are dealt to files changes no result.
Null, empty and wordless documents or items match nothing; equal items are all reported; rows of equal doc_id are reported each; texts of any length
are searched whole; of the passages that hold an item the highest score is given. An empty table of documents or of items gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .shared import BATCH_BYTES, load, save, small_batches, table, tidy, work_dir
from .shingles import batches, pieces, select_rows, utf8, word_hashes

#: Items of one index file at most, the least stride in words, and index files that a task holds at once.
ITEMS, STRIDE, HELD = 20_000, 40, 4
#: Least share of an item's own BM25 score, and of the sequences of its question and of its answer.
THRESHOLD, PART, SEQUENCE = 0.6, 0.5, 4
K1, B = 1.2, 0.75
BLOCK = 16


def _sequences(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            out = (out + words[k : len(words) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
    return out


def question_and_answer(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of the question and of the answer of each item."""
    cut = [max(t.rfind("?", 0, len(t.rstrip()) - 1), t.rstrip().rfind("\n")) + 1 for t in texts]
    hashed, at = word_hashes([p.encode("utf-8", "surrogatepass") for t, c in zip(texts, cut, strict=True) for p in (t[:c], t[c:])], marks=True)
    words = [hashed[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    out = []
    for q, a in zip(words[::2], words[1::2], strict=True):
        if not len(q) or not len(a):
            whole = np.concatenate([q, a])
            middle = -(-2 * len(whole) // 3)
            q, a = whole[:middle], whole[middle:]
        out.append((q, a))
    return out


def stride_of(words: int) -> int:
    """The stride of an item of so many words."""
    return STRIDE << max(0, (-(-words // STRIDE) - 1).bit_length())


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


class Index:
    """Postings of the terms of some items of one stride, in blocks with their greatest weights.

    known: term -> document frequency among all n items; mean: their mean length."""

    def __init__(self, item_ids: list[int], parts: list[tuple[np.ndarray, np.ndarray]], known: dict[int, int], n: int, mean: float) -> None:
        self.item_ids, self.parts = item_ids, parts
        sets = [np.unique(np.concatenate(p), return_counts=True) for p in parts]
        lengths = np.array([c.sum() for _, c in sets], float)
        self.stride = stride_of(int(lengths.max(initial=1)))
        count = len(sets)
        all_terms = np.concatenate([t for t, _ in sets] or [np.empty(0, np.uint64)])
        items = np.repeat(np.arange(count), [len(t) for t, _ in sets])
        tf = np.concatenate([c for _, c in sets] or [np.empty(0)]).astype(float)
        self.terms, term, df = np.unique(all_terms, return_inverse=True, return_counts=True)
        rarity = idf(np.array([known[t] for t in self.terms.tolist()], float), n)
        weight = rarity[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[items] / mean))
        weight /= np.bincount(items, weight, count)[items]
        order = np.lexsort((items, term))
        self.items, self.weights = items[order], weight[order]
        self.begin = np.concatenate([[0], np.cumsum(df)])
        # common terms: the most frequent ones, as long as no item gets more than half the threshold from them
        common, add = np.zeros(len(df), bool), np.zeros(count)
        for t in np.argsort(-df, kind="stable"):
            p = slice(self.begin[t], self.begin[t + 1])
            if (add[self.items[p]] + self.weights[p] > THRESHOLD / 2).any():
                break
            add[self.items[p]] += self.weights[p]
            common[t] = True
        self.rare, self.common_share = ~common, add
        self.seen = np.zeros(1 << 18, bool)
        self.seen[self.terms & np.uint64(0x3FFFF)] = True
        self.block_max = [np.maximum.reduceat(self.weights[a:b], np.arange(0, b - a, BLOCK)) for a, b in zip(self.begin[:-1], self.begin[1:], strict=True)]
        self.term_max = np.array([m.max() for m in self.block_max])

    @classmethod
    def alone(cls, item_ids: list[int], texts: list[str]) -> Index:
        """The index of items that are all there are and share a stride."""
        parts = question_and_answer(texts)
        terms, df = np.unique(np.concatenate([np.unique(np.concatenate(p)) for p in parts]), return_counts=True)
        return cls(item_ids, parts, dict(zip(terms.tolist(), df.tolist(), strict=True)), len(parts), float(np.mean([len(q) + len(a) for q, a in parts])))

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that are terms, and which terms."""
        at = np.flatnonzero(self.seen[words & np.uint64(0x3FFFF)])
        if not len(self.terms) or not len(at):
            return at[:0], at[:0]
        t = np.minimum(np.searchsorted(self.terms, words[at]), len(self.terms) - 1)
        hit = self.terms[t] == words[at]
        return at[hit], t[hit]

    def wand(self, terms: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """(item, score) of at least threshold for a query of distinct terms, by block-max WAND."""
        heads = [(int(self.items[self.begin[t]]), int(self.begin[t]), int(t)) for t in terms]
        heads.sort()
        out = []
        while heads:
            # pivot: the first item whose terms' greatest weights reach the threshold
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(heads):
                bound += self.term_max[t]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = heads[pivot][0]
            while pivot + 1 < len(heads) and heads[pivot + 1][0] == item:
                pivot += 1
            # the blocks that hold the pivot item
            bound, end = 0.0, np.iinfo(np.int64).max
            for _, p, t in heads[: pivot + 1]:
                b, e = int(self.begin[t]), int(self.begin[t + 1])
                p += int(np.searchsorted(self.items[p:e], item))
                if p < e:
                    k = (p - b) // BLOCK
                    bound += self.block_max[t][k]
                    last = min(b + (k + 1) * BLOCK, e) - 1
                    end = min(end, int(self.items[last]))
            if bound >= threshold:
                score, to = 0.0, item + 1
                for head, p, t in heads[: pivot + 1]:
                    e = int(self.begin[t + 1])
                    p += int(np.searchsorted(self.items[p:e], item))
                    if p < e and self.items[p] == item:
                        score += self.weights[p]
                if score >= threshold:
                    out.append((item, float(score)))
            else:
                # no item up to the end of these blocks, or before the next list's head, can reach it
                after = heads[pivot + 1][0] if pivot + 1 < len(heads) else np.iinfo(np.int64).max
                to = max(item + 1, min(end + 1, after))
            moved = []
            for head, p, t in heads:
                if head < to:
                    e = int(self.begin[t + 1])
                    p += int(np.searchsorted(self.items[p:e], to))
                    if p >= e:
                        continue
                    head = int(self.items[p])
                moved.append((head, p, t))
            heads = sorted(moved)
        return out

    def overlaps(self, item: int, words: np.ndarray) -> tuple[float, float]:
        """Shares of the sequences of an item's question and answer that stand in words."""
        out = []
        for part in self.parts[item]:
            n = min(SEQUENCE, len(part))
            want = _sequences(part, n) if n else np.empty(0, np.uint64)
            out.append(float(np.isin(want, _sequences(words, n)).mean()) if n and len(words) >= n else float(not n))
        return out[0], out[1]

    def search(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item, score, question, answer) for what is retrieved and verified, each text and item once. words, at: as word_hashes gives them."""
        s = self.stride
        n = np.diff(at)
        passages = np.maximum(1, -(-n // s) - 1)
        base = np.concatenate([[0], np.cumsum(passages)])
        pos, term = self.lookup(words)
        text = np.searchsorted(at, pos, "right") - 1
        k = (pos - at[text]) // s
        last = passages[text] - 1
        later, earlier = np.minimum(k, last), np.minimum(np.maximum(k - 1, 0), last)
        both = earlier != later
        passage = np.concatenate([base[text] + later, (base[text] + earlier)[both]])
        term = np.concatenate([term, term[both]])
        rare = self.rare[term]
        pair = np.unique(passage[rare] * len(self.terms) + term[rare])
        if not len(pair):
            return
        p, t = pair // len(self.terms), pair % len(self.terms)
        count = self.begin[t + 1] - self.begin[t]
        where = np.repeat(self.begin[t] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        key, back = np.unique(np.repeat(p, count) * len(self.item_ids) + self.items[where], return_inverse=True)
        bound = np.bincount(back, self.weights[where]) + self.common_share[key % len(self.item_ids)]
        left = np.unique(key[bound >= THRESHOLD - 1e-9] // len(self.item_ids))
        if not len(left):
            return
        chosen = np.isin(passage, left)
        passage, term = passage[chosen], term[chosen]
        order = np.argsort(passage, kind="stable")
        passage, term = passage[order], term[order]
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for q, a, b in zip(left, np.searchsorted(passage, left), np.searchsorted(passage, left, "right"), strict=True):
            i = int(np.searchsorted(base, q, "right")) - 1
            begin = at[i] + (q - base[i]) * s
            around = words[begin : min(begin + 2 * s, at[i + 1])]
            for item, score in self.wand(np.unique(term[a:b])):
                question, answer = self.overlaps(item, around)
                if question >= PART and answer >= PART:
                    best[i, item] = max(best.get((i, item), (0.0, 0.0, 0.0)), (score, question, answer))
        for (i, item), found in sorted(best.items()):
            yield i, self.item_ids[item], *found


class Files:
    """The index files of a manifest, HELD of them kept."""

    def __init__(self, paths: list[str]) -> None:
        self.paths, self.held = paths, {}

    def search(self, texts: list[bytes | None]) -> Iterator[tuple[int, int, float, float, float]]:
        """What the items of all files give for texts, piece by piece."""
        for path in self.paths:
            index = self.held.get(path) or pickle.loads(load(path))
            if len(self.held) < HELD:
                self.held[path] = index
            for a, b in pieces(texts):
                for i, *found in index.search(*word_hashes([t or b"" for t in texts[a:b]], marks=True)):
                    yield a + i, *found


def index_files(benchmark: DataFrame) -> list[str]:
    """Writes the index of items (item_id, text) below a new shared folder; the paths of its files, sorted."""
    spark = benchmark.sparkSession
    small_batches(spark)
    folder = f"{work_dir(spark)}/index"

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            rows = []
            for item, text, (q, a) in zip(frame["item_id"], frame["text"], question_and_answer(frame["text"].tolist()), strict=True):
                if n := len(q) + len(a):
                    terms = np.unique(np.concatenate([q, a])).view(np.int64)
                    rows.append((item, text, n, stride_of(n), q.tobytes(), a.tobytes(), terms))
            yield pd.DataFrame(rows, columns=["item_id", "text", "n", "stride", "q", "a", "terms"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    items = table(items.mapInPandas(tidy(read), "item_id long, text string, n long, stride long, q binary, a binary, terms array<long>"))
    whole = items.agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
    n, mean, most = whole["n"], whole["mean"], ITEMS
    sizes = items.groupBy("stride").agg(F.count("*").alias("items"))  # a row for each doubling of the length
    files = F.pmod(F.xxhash64("item_id", "text"), F.ceil(F.col("items") / most))
    dealt = items.join(F.broadcast(sizes), "stride").withColumn("file", files)
    terms = dealt.select("stride", "file", F.explode("terms").alias("term"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    needed = table(terms.distinct().join(df, "term"))

    def make(key, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"path": []}, dtype=str)
        rows = rows.sort_values(["item_id", "text"], kind="stable")
        parts = [(np.frombuffer(q, np.uint64), np.frombuffer(a, np.uint64)) for q, a in zip(rows["q"], rows["a"], strict=True)]
        df = dict(zip(known["term"].to_numpy(np.int64).view(np.uint64).tolist(), known["df"].tolist(), strict=True))
        path = f"{folder}/{key[0]:09d}-{key[1]:09d}-{uuid.uuid4().hex}"
        save(path, pickle.dumps(Index(rows["item_id"].tolist(), parts, df, n, mean)))
        return pd.DataFrame({"path": [path]})

    made = dealt.select("stride", "file", "item_id", "text", "q", "a").groupBy("stride", "file").cogroup(needed.groupBy("stride", "file")).applyInPandas(make, "path string")
    return sorted(r["path"] for r in table(made).collect())  # a name for every ITEMS items


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question, answer) for each document (doc_id, text) that holds an item (item_id, text)."""
    small_batches(docs.sparkSession)
    paths = docs.sparkSession.sparkContext.broadcast(index_files(benchmark))

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = Files(paths.value)
        for frame, texts in batches(frames, size=BATCH_BYTES):
            ids = frame["doc_id"].astype("Int64").array
            yield pd.DataFrame([(ids[i], *x) for i, *x in files.search(texts)], columns=["doc_id", "item_id", "score", "question", "answer"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(tidy(find), "doc_id long, item_id long, score double, question double, answer double")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold an item, in one pass; each row is judged by its own text, whatever its doc_id."""
    small_batches(docs.sparkSession)
    paths = docs.sparkSession.sparkContext.broadcast(index_files(benchmark))
    kept: dict[str, Files] = {}

    def clean(values: list[str | None]) -> np.ndarray:
        files = kept.setdefault("files", Files(paths.value))
        out = np.ones(len(values), bool)
        for i, *_ in files.search(utf8(values)):
            out[i] = False
        return out

    return select_rows(docs, clean)

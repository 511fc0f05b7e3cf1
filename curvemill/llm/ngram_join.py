"""N-gram Jaccard join by token-combination prefixes.

Each text is the set of its distinct five-word shingles. Tokens (shingles) that more than FREQUENT
texts hold form the frequent class and come last in the global order; the others come first, by hash. A text
whose prefix (n - ceil(0.8 n) + 1 tokens) is all rare indexes its tokens singly. A text with fewer rare
tokens indexes those singly, extends its prefix by one token, and indexes each pair of frequent tokens in it:
two texts that link share a token in the prefixes and two in the extended ones, so either a rare token or a
pair of frequent ones meets. Pairs grow with the square of a prefix, so sets of more than LONG tokens index the frequent tokens of their
prefix singly; sets near that size, which may link with both kinds, index both ways. Texts with equal sets are one class from the start.
Within an index entry each class is first verified against the entry's smallest class, which links large groups of copies without all their pairs;
then, in entries whose classes are still apart, against one told by chance, and last all pairs in different components. Of entries with more than BLOCK
classes those go first that have too many tokens of their own to link there, and entries around the same component are taken together where that is less work.
Bounds that every link fulfils (sizes, odd sketches inside the join, counts by hash range) come before a pair's sets are
read. All links between components are found, so the components are exact (64-bit hashes stand for words). Entries meet by equi-joins
in the executors; the driver sees the frequent tokens alone, at most CLASS_ROWS of them.

Null, empty and blank texts have an empty set and link with nothing; equal texts link; texts of any length are taken whole. A null doc_id
links like any other but never names a component with a numbered document in it; rows of one doc_id with different texts are different
documents that share a name; repeated rows are returned as often as they come; an empty table gives no rows. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .shared import components, fresh, sized, small_batches, table, tidy
from .shingles import batches, mix, shingle_sets

#: Texts that hold a token of the rare class at most.
FREQUENT = 100
#: Entries of the frequent class that are sent to all tasks (16 bytes each). With more, the limit above doubles until it fits: any split in classes gives the same links.
CLASS_ROWS = 500_000
#: Further rounds of verification against one class of each entry before pairs are taken.
TURNS = 1
#: Longs of an odd sketch: each token flips one bit, so bits that differ between two sets are at most the tokens that do.
SKETCH = 8
#: Classes of one index entry that are compared with each other, or with as many others, at once.
BLOCK = 256
#: Tokens of a set from which on frequent tokens are indexed singly.
LONG = 256
#: Bytes of text, on the whole, whose tokens one group counts.
PIECE = 8_000_000
ODD = [f"o{i}" for i in range(SKETCH)]
_LOW = np.uint64(0xFFFFFFFFFFFF)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def need(n: int) -> int:
    """Least overlap of a set of n with any set it links with: ceil(0.8 n)."""
    return -(-4 * n // 5)


def odd(s: np.ndarray) -> np.ndarray:
    """The odd sketch of a set."""
    flips = np.bincount(((s >> np.uint64(20)) & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def range_counts(s: np.ndarray) -> bytes:
    """Counts of a set's tokens by equal ranges of hashes, about eight tokens a range."""
    bits = max(5, (len(s) // 8).bit_length() - 1)
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype("<u2").tobytes()


def within(x: bytes, y: bytes) -> bool:
    """Whether two sets may link: they have no more in common than the lesser counts of each range; finer ranges are added up to the other's."""
    a, b = (np.frombuffer(c, "<u2").astype(np.int64) for c in (x, y))
    n = min(len(a), len(b))
    a, b = a.reshape(n, -1).sum(1), b.reshape(n, -1).sum(1)
    both = int(np.minimum(a, b).sum())
    return 100 * both >= 80 * (int(a.sum()) + int(b.sum()) - both)


def may_link() -> str:
    """Condition on n and sketches of sides a and b that every link fulfils: sizes alike, and at most a ninth of their sum different."""
    differ = " + ".join(f"bit_count({o}_a ^ {o}_b)" for o in ODD)
    return f"100 * least(n_a, n_b) >= 80 * greatest(n_a, n_b) and 9 * ({differ}) <= n_a + n_b"


def _counted(docs: DataFrame) -> DataFrame:
    """(token, n): 48-bit tokens of more than FREQUENT texts. Tasks count what they hold and send sorted packed keys with their counts; each group adds up one range of them.

    There are so many ranges that one holds the tokens of about PIECE bytes of text, however much there is; a token comes once from each part of a task, so none makes its range large."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PIECE))
    cuts = np.array([(i << 48) // pieces for i in range(1, pieces)], np.uint64)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def out() -> pd.DataFrame:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            n = np.minimum(n, FREQUENT + 1).astype("<u2")
            ends = [0, *np.searchsorted(keys, cuts), len(keys)]
            rows = [(i, (keys[a:b] >> np.uint64(32)).astype("<u2").tobytes(), keys[a:b].astype("<u4").tobytes(), n[a:b].tobytes()) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
            return pd.DataFrame(rows, columns=["piece", "high", "low", "n"])

        for _, texts in batches(frames):
            for s in shingle_sets(texts):
                held.append(s & _LOW)
                size += len(s)
            if size >= 1_000_000:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        high, low, n = (np.frombuffer(b"".join(frame[c]), kind) for c, kind in (("high", "<u2"), ("low", "<u4"), ("n", "<u2")))
        keys = high.astype(np.uint64) << np.uint64(32) | low
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        total = np.add.reduceat(n, first, dtype=np.int64)
        often = total > FREQUENT
        return pd.DataFrame({"token": keys[first][often].astype(np.int64), "n": total[often]})

    sent = docs.select("text").mapInPandas(tidy(send), "piece int, high binary, low binary, n binary")
    return sent.groupBy("piece").applyInPandas(count, "token long, n long")


def entries_of(s: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Index entries of a sorted set; tokens: the frequent ones (48 bits, sorted), counts: the texts that hold them."""
    p = len(s) - need(len(s)) + 1
    if len(s) < 2:
        return s[:0]
    if len(tokens):
        low = s & _LOW
        at = np.minimum(np.searchsorted(tokens, low), len(tokens) - 1)
        often = tokens[at] == low
        rare = s[~often][:p]
    else:
        rare = s[:p]
    if len(rare) >= p:
        return rare
    f = s[often]
    f = f[np.lexsort((f, counts[at[often]]))][: p + 1 - len(rare)]
    out = [rare]
    if 5 * len(s) >= 4 * LONG:
        out.append(f[: p - len(rare)])
    if 4 * len(s) <= 5 * LONG:
        f = np.sort(f)
        i, j = np.triu_indices(len(f), 1)
        out.append(mix(f[i] * _A + f[j] * _B))
    return np.concatenate(out)


def _indexed(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, h, n, class, entries, counts, odd sketch) for each row. class is null for an empty set."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, counts = shared.value
        for frame, texts in batches(frames):
            sets = list(shingle_sets(texts))
            with np.errstate(over="ignore"):
                names = [None if not len(s) else int(mix(np.array([s.sum() * _A + np.bitwise_xor.reduce(s) * _B + np.uint64(len(s))], np.uint64)).view(np.int64)[0]) for s in sets]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "h": frame["h"], "n": [len(s) for s in sets], "class": pd.array(names, "Int64"), "entries": [entries_of(s, tokens, counts).view(np.int64) for s in sets], "counts": [range_counts(s) for s in sets], **dict(zip(ODD, np.array([odd(s) for s in sets]).reshape(-1, SKETCH).T, strict=True))})

    return docs.mapInPandas(tidy(index), "doc_id long, h long, n long, class long, entries array<long>, counts binary, " + ", ".join(f"{o} long" for o in ODD))


def _sets(docs: DataFrame, first: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, tokens) of the classes, made again from one text of each."""
    ids = table(classes.join(first, "class").select("class", F.col("doc_id").alias("of"), F.col("h").alias("text_h")))

    def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, texts in batches(frames):
            yield pd.DataFrame({"class": frame["class"], "tokens": [s.tobytes() for s in shingle_sets(texts)]})

    texts = docs.join(sized(ids), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("text_h"))).select("class", "text")
    return table(texts.mapInPandas(tidy(again), "class long, tokens binary").dropDuplicates(["class"]))


def _own(sets: DataFrame) -> DataFrame:
    """(class, own): the tokens that no other class of sets holds, for classes with any. Tasks send a token once, with a class and whether others hold it too."""

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, names, size = [], [], 0

        def out() -> pd.DataFrame:
            tokens, at, n = np.unique(np.concatenate(held), return_index=True, return_counts=True)
            name = np.repeat(np.array(names, np.int64), [len(s) for s in held])[at]
            return pd.DataFrame({"token": tokens.view(np.int64), "class": name, "n": n})

        for frame in frames:
            for name, tokens in zip(frame["class"], frame["tokens"], strict=True):
                held.append(np.frombuffer(tokens, np.uint64))
                names.append(name)
                size += len(held[-1])
                if size >= 1_000_000:
                    yield out()
                    held, names, size = [], [], 0
        if size:
            yield out()

    tokens = sets.mapInPandas(tidy(send), "token long, class long, n long").groupBy("token").agg(F.min("class").alias("class"), F.sum("n").alias("n"))
    return table(tokens.where("n = 1").groupBy("class").agg(F.count("*").alias("own")))


def _cost() -> Column:
    """Rows that dealing an entry makes with l classes of its largest component and r others."""
    left, right = F.ceil(F.col("l") / BLOCK), F.ceil(F.col("r") / BLOCK)
    return F.col("l") * right + F.col("r") * (left + right)


def _spots(at: DataFrame, docs: DataFrame, first: DataFrame) -> DataFrame:
    """(entry, class, n, root, v, main, l, r): what _possible_pairs deals, of at: (entry, class, n, root, c), a written table.

    v: the tokens that the class can share with others at the entry. Of two sets that link, v_a and v_b are at least 4 / 9 (n_a + n_b), so a class whose v is too small for
    the entry's smallest set has no link there. main tells the classes of the entry's largest component, l of them, which meet the r others only; entries of BLOCK classes at
    most are one block, all of it others. Large entries with the same largest component, which mostly have the same classes, become one where that makes fewer rows."""
    light = at.where(F.col("c") <= BLOCK).select("entry", "class", "n", "root", F.col("n").alias("v"), F.lit(False).alias("main"), F.lit(0).cast("long").alias("l"), F.col("c").alias("r"))
    heavy = table(at.where(F.col("c") > BLOCK).select("entry", "class", "n", "root"))
    if heavy.isEmpty():
        return light
    own = _own(_sets(docs, first, heavy.select("class").distinct()))
    heavy = table(heavy.join(sized(own), "class", "left").select("entry", "class", "n", "root", (F.col("n") - F.coalesce("own", F.lit(0))).alias("v")))
    least = table(heavy.groupBy("entry").agg(F.min("n").alias("least")))
    heavy = table(heavy.join(sized(least), "entry").where("9 * v >= 4 * (n + least)").drop("least"))
    top = heavy.groupBy("entry", "root").agg(F.count("*").alias("k")).groupBy("entry").agg(F.max(F.struct("k", "root")).alias("top"), F.sum("k").alias("c"))
    top = table(top.select("entry", F.col("top.root").alias("spot"), F.col("top.k").alias("l"), (F.col("c") - F.col("top.k")).alias("r")).where("r > 0"))
    merged = table(heavy.join(sized(top.select("entry", "spot")), "entry").drop("entry").distinct())
    both = merged.groupBy("spot").agg(F.count_if(F.col("root") == F.col("spot")).alias("l"), F.count_if(F.col("root") != F.col("spot")).alias("r"))
    apart = top.groupBy("spot").agg(F.sum(_cost()).alias("apart"))
    better = table(both.join(apart, "spot").where(_cost() < F.col("apart")).select("spot", "l", "r"))
    single = table(top.join(sized(better.select("spot")), "spot", "left_anti"))
    marked = lambda rows: rows.select("entry", "class", "n", "root", "v", (F.col("root") == F.col("spot")).alias("main"), "l", "r")
    together = marked(merged.join(sized(better), "spot").withColumn("entry", F.col("spot")))
    return table(light.union(together).union(marked(heavy.join(sized(single), "entry"))))


def _possible_pairs(at: DataFrame) -> DataFrame:
    """Pairs (a, b) in different components that share an entry and that no bound rules out.

    at: (entry, class, n, root, v, main, l, r, counts, sketch) as of _spots. Large entries are cut into blocks of
    classes, and each pair of blocks, but for two of the largest component, is one small group; tasks read their groups one after the other and name a pair once."""
    left, right = (F.ceil(F.col(k) / BLOCK).cast("int") for k in "lr")
    number = F.xxhash64("class")
    at = at.withColumn("block", F.when(F.col("main"), F.pmod(number, left)).otherwise(left + F.pmod(number, right)).cast("int"))
    others = F.sequence(F.when(F.col("main"), left).otherwise(0), left + right - 1)
    meets = F.transform(others, lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    dealt = at.select("*", F.inline(meets)).drop("main", "l", "r").repartition("entry", "i", "j").sortWithinPartitions("entry", "i", "j")

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: set[tuple[int, int]] = set()
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            key = frame[["entry", "i", "j"]].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            last = cut[-1] if len(cut) else 0
            rest = frame.iloc[last:]
            yield found(frame.iloc[:last], cut[:-1], known)
        if rest is not None:
            yield found(rest, [], known)

    def found(frame: pd.DataFrame, cut, known: set[tuple[int, int]]) -> pd.DataFrame:
        name, n, shared, root, block, i, j = (frame[c].to_numpy() for c in ("class", "n", "v", "root", "block", "i", "j"))
        sketch = frame[ODD].to_numpy(np.int64).view(np.uint64)
        counts, out = frame["counts"].to_numpy(), []
        for a, b in zip([0, *cut], [*cut, len(frame)], strict=True):
            if b - a < 2:
                continue
            left, right = np.flatnonzero(block[a:b] == i[a]) + a, np.flatnonzero(block[a:b] == j[a]) + a
            x, y = np.repeat(left, len(right)), np.tile(right, len(left))
            both = n[x] + n[y]
            fits = (root[x] != root[y]) & (9 * np.minimum(shared[x], shared[y]) >= 4 * both)
            if i[a] == j[a]:
                fits &= name[x] < name[y]
            x, y, both = x[fits], y[fits], both[fits]
            fits = 9 * np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64) <= both
            for u, v in zip(x[fits].tolist(), y[fits].tolist(), strict=True):
                pair = (int(name[u]), int(name[v])) if name[u] < name[v] else (int(name[v]), int(name[u]))
                if pair not in known:
                    known.add(pair)
                    if within(counts[u], counts[v]):
                        out.append(pair)
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return table(dealt.mapInPandas(tidy(pairs), "a long, b long").distinct())


def _shared(rows: DataFrame) -> DataFrame:
    """(entry, class, n, low) of the entries that two classes or more hold, each class once; low is the entry's smallest class."""
    entries = rows.where("class is not null").select("class", "n", F.explode("entries").alias("entry"))
    met = table(entries.groupBy("entry").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("entry", "low"))
    return table(entries.join(sized(met), "entry").select("entry", "class", "n", "low").distinct())


def _verified(docs: DataFrame, first: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link. The sets are made again from one text of each class."""
    sets = _sets(docs, first, pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct())

    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for x, y in zip(frame["x"], frame["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                z = np.sort(np.concatenate([x, y]), kind="stable")
                both = int(np.count_nonzero(z[1:] == z[:-1]))
                keep.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield frame.loc[keep, ["a", "b"]]

    left = sets.select(F.col("class").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("tokens").alias("y"))
    return table(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(tidy(links), "a long, b long"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, h): h is a hash of the text, so that (doc_id, h) tells rows of one doc_id with different texts apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text); other columns are not looked at."""
    return clusters(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id (nulls last), then the least hash of its text; of equal rows one.

    Rows that link with nothing stay, as often as they come."""
    found = table(clusters(docs).where("root is not null").groupBy("root", "doc_id", "h").agg(F.count("*").alias("n")))
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")).alias("best"))
    best = table(best.select("best.doc_id", "best.h"))
    d, h = fresh(docs, "d", "h")
    keys = lambda df: df.select(F.col("doc_id").alias(d), F.col("h").alias(h))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(h))
    # doc_id and text tell all but equal rows apart, so those that go and those that come more than once are named by them
    told = found.alias("f").join(sized(best).alias("b"), F.col("f.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("f.h") == F.col("b.h")), "left")
    told = table(told.select("f.doc_id", "f.h", "n", F.col("b.h").isNotNull().alias("stays")))
    gone, twice = keys(told.where("not stays")), table(keys(told.where("stays and n > 1")))
    out = docs.join(sized(gone), same, "left_anti")
    if twice.isEmpty():
        return out
    rest = out.join(sized(twice), same, "left_anti")
    return rest.unionByName(out.join(sized(twice), same, "left_semi").dropDuplicates(["doc_id", "text"]))


def clusters(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_shingles, component_id, root) for each row of docs (doc_id, text); root is null where the row links with no other one."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = _keyed(docs)
    often, limit = table(_counted(docs)), FREQUENT
    while often.where(F.col("n") > limit).count() > CLASS_ROWS:
        limit *= 2
    classes = often.where(F.col("n") > limit).toArrow().sort_by("token")
    rows = table(_indexed(docs, (classes["token"].to_numpy().astype(np.uint64), classes["n"].to_numpy())))

    one = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")).alias("one")
    first = rows.where("class is not null").groupBy("class").agg(one, F.min("n").alias("n"), F.count("*").alias("copies"), F.min("counts").alias("counts"), *(F.min(o).alias(o) for o in ODD))
    first = table(first.select("class", "one.doc_id", "one.h", "n", "copies", "counts", *ODD))
    entries = _shared(rows)
    sides = {k: first.select(*(F.col(c).alias(f"{c}_{k}") for c in ("class", "n", *ODD))) for k in "ab"}

    def possible(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.loc[[within(x, y) for x, y in zip(f["x"], f["y"], strict=True)], ["a", "b"]]

    def alike(pairs: DataFrame) -> DataFrame:
        """Without the pairs (a, b) whose sizes, sketches or counts by range rule a link out."""
        pairs = pairs.join(sized(sides["a"]), F.col("a") == F.col("class_a")).join(sized(sides["b"]), F.col("b") == F.col("class_b"))
        pairs = table(pairs.where(may_link()).select("a", "b"))
        pairs = pairs.join(first.select(F.col("class").alias("a"), F.col("counts").alias("x")), "a").join(first.select(F.col("class").alias("b"), F.col("counts").alias("y")), "b")
        return table(pairs.mapInPandas(tidy(possible), "a long, b long"))

    def joined(root: DataFrame) -> DataFrame:
        """(entry, class, n, root) of the entries whose classes are still apart; of entries with the same classes one is enough."""
        at = table(entries.select("entry", "class", "n").join(sized(root.withColumnsRenamed({"node": "class"})), "class", "left").withColumn("root", F.coalesce("root", "class")))
        apart = at.groupBy("entry").agg(F.min("root").alias("p"), F.max("root").alias("q"), F.count("*").alias("c"), F.bit_xor("class").alias("x"), F.bit_xor(F.xxhash64("class")).alias("y"))
        apart = table(apart.where("p < q").groupBy("c", "x", "y").agg(F.min("entry").alias("entry")).select("entry", "c"))
        return table(at.join(sized(apart), "entry"))

    link = _verified(docs, first, alike(entries.where("class <> low").select(F.col("low").alias("a"), F.col("class").alias("b")).distinct()))
    marks = ["class", "counts", *ODD]
    for turn in range(TURNS + 1):
        at = joined(table(components(link)))
        if turn < TURNS:  # another class of each entry, told by chance, is what the others are held against
            y = at.select("entry", *(F.col(c).alias(f"{c}_b") for c in ("class", "n", "root")))
            x = at.groupBy("entry").agg(F.min_by(F.struct("class", "n", "root"), F.xxhash64("class", "entry", F.lit(turn))).alias("a")).select("entry", *(F.col(f"a.{c}").alias(f"{c}_a") for c in ("class", "n", "root")))
            pairs = table(x).join(y, "entry").where("100 * least(n_a, n_b) >= 80 * greatest(n_a, n_b) and root_a <> root_b")
            pairs = alike(pairs.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct())
        else:
            pairs = _possible_pairs(_spots(at, docs, first).join(first.select(*marks), "class"))
        if not pairs.isEmpty():
            link = table(link.union(_verified(docs, first, pairs)))

    root = components(link).withColumnsRenamed({"node": "class"})
    name = first.join(root, "class", "left").select("class", "doc_id", "copies", F.coalesce("root", "class").alias("root"))
    least = name.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("members"))
    named = table(name.join(least.where("members > 1"), "root").select("class", "component_id", "root"))
    out = rows.select("doc_id", "h", F.col("n").alias("n_shingles"), "class").join(sized(named), "class", "left")
    return out.select("doc_id", "h", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "root")

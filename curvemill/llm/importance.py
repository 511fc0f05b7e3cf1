"""Importance resampling towards a target: documents are drawn by how much more their features occur in the target than in the corpus.

Features are all runs of 1 to `longest` words, words being letters, digits and everything beyond ASCII, with A-Z as a-z. Feature strings are
counted over all documents and over the target, summed up in each task before they are shuffled; each distinct string is hashed once, into one of BUCKETS buckets, and the buckets' counts
give the gains, which go back to the strings. What is broadcast is bounded: the gains (a row a bucket), and the frequent strings, those with at least 1 / HOT of all
occurrences, so HOT of them at most. A document's frequent features are weighed where it is read; its others, each with its count, meet their gains in
a join by string, in which no key is hot, as each has less than 1 / HOT of all occurrences. No document is cut, no string dropped.

weight is the sum of a document's gains, repeats counted. score is weight plus a Gumbel number made of seed and id, so the best scores
are a draw without replacement in proportion to exp(weight / 1000). Of the documents with at least `least` words the share `percent` with the best scores is drawn, ties to the smaller
id (null last).

Null texts and texts without words have no features and weight 0. Rows are scored one by one: rows of one id share its Gumbel number, and equal rows
get ranks of their own. A null id is the empty string in the seed. An empty table gives an empty result, an empty target lets the rarest buckets gain. Texts are read
in pieces, so long ones need no more than their bytes and their own tail of rare features. Column names never clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F, types as T

from .shared import ranked, small_batches, table, tidy

LONGEST, BUCKETS, PERCENT, LEAST, SEED = 1, 10_000, 10, 20, 2024
#: Strings with at least this part of all occurrences are weighed in the tasks that read documents.
HOT = 500_000
#: Strings counted in a task before they are handed on.
HELD = 200_000
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20

#: Bytes of words as they are, A-Z in lower case, all others as a space.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_in(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a list a piece."""
    text, at = text.translate(BYTES), 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            end = text.find(b" ", end)
            end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def count_features(text: bytes, longest: int) -> tuple[int, Counter]:
    """Number of words, and how often each feature occurs."""
    n, found, last = 0, Counter(), []
    for words in words_in(text):
        n += len(words)
        found.update(words)
        if longest > 1:
            joined = last + words
            for k in range(2, longest + 1):
                first = max(0, len(last) - k + 1)  # runs that end before were counted with the piece before
                found.update(b" ".join(joined[i : i + k]) for i in range(first, len(joined) - k + 1))
            last = joined[len(joined) - longest + 1 :] if len(joined) >= longest else joined
    return n, found


def feature_counts(texts: DataFrame, longest: int) -> DataFrame:
    """(feature, n) of a table of one binary column: what tasks counted, not yet added up."""

    @tidy
    def count(batches):
        import pyarrow as pa

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["feature", "n"])

        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    held.update(count_features(text.as_py(), longest)[1])
                if len(held) > HELD:
                    yield out()
                    held = Counter()
        yield out()

    return texts.mapInArrow(count, "feature binary, n bigint")


def dictionary(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """(feature, n, gain) of all distinct features of docs, written, and the number of their occurrences."""
    small_batches(docs.sparkSession)
    source = feature_counts(docs.select(F.col(text).cast("binary").alias("text")), longest).select("feature", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    aim = feature_counts(target.select(F.col(target_text).cast("binary").alias("text")), longest).select("feature", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    strings = source.unionByName(aim).groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    strings = table(strings.withColumn("bucket", (F.crc32("feature") % buckets).cast("int")))
    counts = table(strings.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    s_all, t_all = (x or 0 for x in counts.agg(F.sum("s"), F.sum("t")).first())
    ratio = (F.col("t") + 1).cast("double") * F.lit(float(s_all + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float(t_all + buckets)))
    gains = counts.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))
    return table(strings.where("s > 0").join(F.broadcast(gains), "bucket").select("feature", F.col("s").alias("n"), "gain")), s_all


def weights(docs: DataFrame, known: DataFrame, total: int, doc: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """(row, doc, n_words, n_features, weight) of each row of docs, from the table of dictionary()."""
    spark = docs.sparkSession
    frequent = known.where(F.col("n") * HOT >= total).select("feature", "gain")
    hot = spark.sparkContext.broadcast({bytes(r["feature"]): r["gain"] for r in frequent.toLocalIterator()})  # HOT entries at most
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc).alias("doc"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["doc"].dataType
    long = T.LongType()
    shape = T.StructType([T.StructField("row", long), T.StructField("doc", kind), T.StructField("feature", T.BinaryType()), T.StructField("n_words", long), T.StructField("n", long), T.StructField("weight", long)])

    @tidy
    def weigh(batches):
        import numpy as np
        import pyarrow as pa

        gain = hot.value
        for batch in batches:
            ids, heads, tail, times, many = batch.column(0).to_numpy(), [], [], [], []
            for text in batch.column(2):
                n, found = count_features(text.as_py(), longest) if text.is_valid else (0, Counter())
                rare = [f for f in found if f not in gain]
                tail += rare
                times += [found[f] for f in rare]
                many.append(len(rare))
                heads.append((n, sum(found.values()), sum(gain[f] * c for f, c in found.items() if f in gain)))
            k = len(tail)
            n_words, n, weight = (np.array(x, "int64") for x in zip(*heads, strict=True)) if heads else (np.zeros(0, "int64"),) * 3
            whole = [pa.array(ids), batch.column(1), pa.nulls(len(ids), pa.binary()), pa.array(n_words), pa.array(n), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(whole, [f.name for f in shape])
            rest = [pa.array(np.repeat(ids, many)), pa.nulls(k, batch.column(1).type), pa.array(tail, pa.binary()), pa.nulls(k, pa.int64()), pa.array(times, pa.int64()), pa.nulls(k, pa.int64())]
            yield pa.RecordBatch.from_arrays(rest, [f.name for f in shape])

    parts = table(rows.mapInArrow(weigh, shape))
    heads = parts.where("feature is null").select("row", "doc", "n_words", F.col("n").alias("n_features"), "weight")
    rare = parts.where("feature is not null").select("row", "feature", F.col("n").alias("times"))
    added = rare.join(known.where(F.col("n") * HOT < total).select("feature", "gain"), "feature").groupBy("row").agg(F.sum(F.col("times") * F.col("gain")).alias("more"))
    return heads.join(added, "row", "left").select("row", "doc", "n_words", "n_features", (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight"))


def importance(docs: DataFrame, target: DataFrame, doc: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """A row a document: doc_id, n_features, weight, score and rank (1, 2, 3... of the drawn ones, else null)."""
    known, total = dictionary(docs, target, text, target_text, longest, buckets)
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc").cast("string"), F.lit(""))), 256)
    part = (F.conv(F.substring(mark, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln(part))).cast("long")
    scored = table(weights(docs, known, total, doc, text, longest).withColumn("score", F.col("weight") + noise))
    ready = scored.where(F.col("n_words") >= least)
    drawn = percent * ready.count() // 100
    order = ranked(ready, F.desc("score"), F.asc_nulls_last("doc"), F.asc("row"))
    placed = order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = placed.unionByName(scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("doc").alias("doc_id"), "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, doc: str = "doc_id", **parameters) -> DataFrame:
    """The drawn documents themselves, with all their columns; of rows with one id all come if one is drawn."""
    drawn = importance(docs, target, doc, **parameters).where("rank is not null").select("doc_id").distinct()
    return docs.join(drawn, docs[doc].eqNullSafe(drawn["doc_id"]), "left_semi")

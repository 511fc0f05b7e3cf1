"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Sources, in code point order with null last, get the weights in turn. They share `share` times all words: each source's part of that is in
proportion to its weight, but never more than `epochs` times its own words. A source above that is clamped there and what it leaves is shared
again among the others by weight, until none is above (if all are clamped, less is taken). A round is one aggregation over the
table of sources that sends two sums to the driver; the level that unclamped sources have for each unit of weight only rises.

A source's target is met by whole repetitions of all its documents and by one more repetition of some: its documents are walked in the
order of a seeded hash of id and text, and each is taken once more if it fits into what the target has left, until PASSES documents
didn't fit. So the words taken stay at or under the target, short of it by less than the smallest of those PASSES documents. Whole documents are repeated,
never parts, at most `epochs` times (rounded up). Rows of equal id and text are taken or left together.

The walk holds no source in one task: words are added up by source and hash range (about the root of the source's rows of them), running sums over the ranges
tell where a document first doesn't fit, and only that range is walked by rows. What is decided of a source is a few
numbers (hash intervals with a limit of size), so documents are never shuffled: the decisions are joined to them by broadcast, or by a salted join for more sources than that
can hold.

Null texts and texts without words have size 0 and are taken 0 times more, in whole repetitions as their source is; a source of size 0 has target 0. A null source is one of its own, apart from the empty one. An
empty table gives an empty result. Other columns stay, whatever their names; texts are counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from .lines import count_words
from .shared import by_key, fresh, ranked, table

WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2, 2024
#: Documents of a source that may fail to fit before its fractional repetition ends.
PASSES = 4


def size_of(text: Column) -> Column:
    return F.coalesce(count_words(text), F.lit(0)).cast("long")


def place_of(doc: Column, text: Column, seed: int = SEED) -> Column:
    """A number below 16^15 that orders documents: the beginning of the MD5 of seed, id and text."""
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(mark, 1, 15), 16, 10).cast("long")


def water_fill(sources: DataFrame, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """sources (source_size, weight; a written table) with target."""
    cap = F.lit(float(epochs)) * F.col("source_size")
    total = sources.agg(F.sum("source_size").cast("double"), F.sum("weight").cast("double")).first()
    budget, level, clamped = share * (total[0] or 0.0), share * (total[0] or 0.0) / (total[1] or 1.0), 0
    while True:
        above = F.col("weight") * F.lit(level) > cap
        n, full, free = sources.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)), F.sum(F.when(~above, F.col("weight"))).cast("double")).first()
        if n == clamped or not free:
            return sources.withColumn("target", F.when(above, cap).otherwise(F.col("weight") * F.lit(level)).cast("double"))
        level, clamped = (budget - full) / free, n


def _fits(steps: str, place: Column, size: Column) -> Column:
    return F.exists(steps, lambda s: (place > s["after"]) & (place < s["until"]) & (size <= s["most"]))


#: Above every place.
END = 1 << 60


def plan(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """(source, source_size, target, whole, steps) of sized (source, size, place; a written table): whole repetitions, and the hash intervals
    (after, until) whose documents of size most or less come once more."""
    sources = table(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    order = ranked(sources, F.asc_nulls_last("source"))
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int"))
    filled = water_fill(table(order.withColumn("weight", weight)), share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))
    state = filled.withColumn("whole", whole).withColumn("gap", rest).withColumn("after", F.lit(-1).cast("long")).withColumn("steps", F.expr("cast(array() as array<struct<after: bigint, until: bigint, most: double>>)"))
    state = table(state.drop("rank", "weight"))
    for _ in range(PASSES):
        state = table(_pass(sized, state))
    return state.select("source", "source_size", "target", "whole", "steps")


def _pass(sized: DataFrame, state: DataFrame) -> DataFrame:
    """state after the next document that is not above the gap, but doesn't fit behind those before it."""
    ranges = F.ceil(F.sqrt("rows"))
    at = F.floor(F.col("place") / F.lit(float(END)) * ranges).cast("long")
    open_ = by_key(sized, state.select("source", "rows", "gap", "after"), "source", F.col("place")).where("size > 0 and place > after and size <= gap")
    sums = table(open_.groupBy("source", at.alias("range")).agg(F.sum("size").alias("words"), F.first("gap").alias("gap")))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = sums.withColumn("upto", F.sum("words").over(upto)).withColumn("fits", F.col("upto") <= F.col("gap"))
    over = over.groupBy("source").agg(F.min(F.when(~F.col("fits"), F.col("range"))).alias("range"), F.coalesce(F.sum(F.when(F.col("fits"), F.col("words"))), F.lit(0)).alias("before"))
    over = table(over)
    inside = by_key(open_.select("source", "place", "size", "gap", at.alias("at")), over.where("range is not null").transform(table), "source", F.col("place")).where("at = range")
    inside = inside.groupBy("source", "place").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"), F.first("before").alias("before"))
    upto = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("fits", F.sum("words").over(upto) + F.col("before") <= F.col("gap"))
    cut = inside.groupBy("source").agg(F.min(F.when(~F.col("fits"), F.col("place"))).alias("until"), F.coalesce(F.sum(F.when(F.col("fits"), F.col("words"))), F.lit(0)).alias("inside"))
    found = over.join(cut, over["source"].eqNullSafe(cut["source"]), "left").select(over["source"].alias("s"), "until", (F.col("before") + F.coalesce("inside", F.lit(0))).alias("taken"))
    out = state.join(found, state["source"].eqNullSafe(found["s"]), "left")
    until = F.coalesce("until", F.lit(END))
    step = F.struct(F.col("after"), until.alias("until"), F.col("gap").alias("most"))
    return out.select("source", "source_size", "rows", "target", "whole", (F.col("gap") - F.coalesce("taken", F.lit(0))).alias("gap"), until.alias("after"), F.concat("steps", F.array(step)).alias("steps"))


def with_copies(docs: DataFrame, decided: DataFrame, source: str, size: Column, place: Column, copies: str, target: str, source_size: str) -> DataFrame:
    """docs with the number of times the mix takes each row, its source's target and words."""
    key, n, at, whole, steps = fresh(docs, "source_", "size_", "place_", "whole_", "steps_")
    named = decided.select(F.col("source").alias(key), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("whole").alias(whole), F.col("steps").alias(steps))
    rows = by_key(docs.withColumns({key: F.col(quoted(source)), n: size, at: place}), table(named), key, F.col(at))
    more = _fits(steps, F.col(at), F.col(n)) & (F.col(n) > 0)
    return rows.withColumn(copies, F.col(whole) + F.when(more, 1).otherwise(0)).drop(key, n, at, whole, steps)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def measured(docs: DataFrame, doc: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, place), written."""
    d, s, t = F.col(quoted(doc)), F.col(quoted(source)), F.col(quoted(text))
    return table(docs.select(d.alias("doc_id"), s.cast("string").alias("source"), size_of(t).alias("size"), place_of(d, t, seed).alias("place")))


def mixed(docs: DataFrame, doc: str = "doc_id", source: str = "source", text: str = "text", weights: tuple = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of docs as many times as it is taken, with the number of its copy from 0 in `copy`."""
    decided = plan(measured(docs, doc, source, text, seed), weights, share, epochs)
    copies, target, words, copy = fresh(docs, "copies", "target", "words", "copy")
    rows = with_copies(docs, decided, source, size_of(F.col(quoted(text))), place_of(F.col(quoted(doc)), F.col(quoted(text)), seed), copies, target, words)
    each = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col(copies)), lambda i: i < F.col(copies)))
    return rows.withColumn(copy, each).drop(copies, target, words)


def mixture(docs: DataFrame, **parameters) -> DataFrame:
    """A row a document: doc_id, size, source_size, target (of its source) and taken (words that the mix takes of it)."""
    sized = measured(docs, **{k: v for k, v in parameters.items() if k in ("doc", "source", "text", "seed")})
    decided = plan(sized, **{k: v for k, v in parameters.items() if k in ("weights", "share", "epochs")})
    out = with_copies(sized, decided, "source", F.col("size"), F.col("place"), "copies", "target", "source_size")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))

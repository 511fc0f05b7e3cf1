"""Matching free names (file names, urls) with lists of values, by containment.

Containment has no key to join by, so names are made to have some: a value of n characters is in a name if it is one of the name's substrings of n characters. The lengths
that values have are few; each name is cut into its distinct substrings of just these lengths, which meet the values in an equi-join by hash, and what meets
is verified on the name itself. Values and names may both be any number: neither side is broadcast or collected, only the lengths and the number of values reach the driver. Values first meet each
substring once, in as many tasks as there are values for, so that a task holds about ROWS of them; those that stand in any name then meet the names, by hash and the names' number.
Substrings of more than HOT names (a common prefix) are dealt to more tasks if they are values, and left out if they are none.

The longest value is looked for from the longest lengths down: at each step the names that have none yet are cut into AT_ONCE substrings, about, or those of one length, and the files of a step
are deleted when it ends. What is in a name in lower case is in it normalized, as normalization maps characters of lower case one by one; so only normalized forms are met.

Ties between values of one length go by a position column, or by the values' own order where there is none. Empty values never match; a value whose normalized form is empty
is in every name. Null names match nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import normalize_token
from .working import cleaned, dropped, written

#: Names with one substring that a task holds, about.
HOT = 100_000
#: Characters of a name that are cut into substrings at once.
CHUNK = 512
#: Values of a task, about.
ROWS = 500_000
#: Substrings, and values, that match_longest deals at once, about, if they are of more than one length.
AT_ONCE = 20_000_000


def _tasks(spark: SparkSession, rows: int) -> int:
    """Tasks that so many rows are dealt to."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def _rows(values: DataFrame, value: str, pos: str | None) -> DataFrame:
    """(value, pos) of values that are not empty."""
    text = F.col(value).cast("string")
    return values.select(text.alias("value"), (F.col(pos) if pos else text).alias("pos")).where("value <> ''")


def _listed(values: DataFrame, value: str, pos: str | None) -> DataFrame:
    """(value, pos, times), written: each value that is not empty once, with its first position and how often the list has it."""
    # dealt before they are counted: sums up front would hold all values of a task's input, which may be most of them
    rows = _rows(values, value, pos).repartition(_tasks(values.sparkSession, values.count()), "value")
    with cleaned(values.sparkSession):
        return written(rows.groupBy("value").agg(F.min("pos").alias("pos"), F.count("*").alias("times")))


def _named(names: DataFrame, name: str, key: str) -> DataFrame:
    """(i, k, name, text), written: each key and name once, with a number and the name's normalized form."""
    once = names.select(F.col(key).alias("k"), F.col(name).alias("name")).distinct()
    with cleaned(names.sparkSession):
        return written(once.select(F.monotonically_increasing_id().alias("i"), "k", "name", normalize_token(F.col("name")).alias("text")))


def _substrings(text: Column, lengths: list[int]) -> Column:
    """Hashes of the distinct substrings of these lengths: long texts are cut into overlapping chunks first."""
    step, longest = CHUNK, max(lengths)
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.char_length(text) - 1, F.lit(0)) / step).cast("int")), lambda i: F.substring(text, i * step + 1, F.lit(step + longest - 1)))

    def of(chunk: Column, n: int) -> Column:
        last = F.char_length(chunk) - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.substring(chunk, i, F.lit(n))))).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.flatten(F.transform(chunks, lambda c: F.concat(*(of(c, n) for n in lengths)))))


def _met(named: DataFrame, dealt: DataFrame, lengths: list[int], tasks: int) -> tuple[DataFrame, DataFrame]:
    """(i, value, pos, times) of names and the values that they contain, normalized, and the written table that this reads. dealt: values (value, pos, times, part), once each, whose normalized
    forms have these lengths, dealt to so many tasks by part, which is the hash of that form."""
    letters = named.agg(F.sum(F.char_length("text"))).first()[0] or 0
    cuts = max(tasks, -(-letters * len(lengths) // (4 * ROWS)))
    parts = named.select("i", "text").repartition(cuts, "i").select("i", F.explode(_substrings(F.col("text"), lengths)).alias("part"))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    if tasks > int(named.sparkSession.conf.get("spark.sql.shuffle.partitions")):  # else they lie as the values do
        counts = counts.repartition(tasks, "part")
    with cleaned(named.sparkSession):
        known = written(counts.hint("merge").join(dealt.hint("merge"), "part", "left").where((F.col("n") > HOT) | F.col("value").isNotNull()))
    salts = F.when(F.col("value").isNotNull(), F.floor(F.col("n") / HOT).cast("int") + 1).otherwise(0)
    hot = known.where(F.col("n") > HOT).groupBy("part").agg(F.max(salts).alias("salts"))  # fewer than the substrings by HOT times
    if not hot.isEmpty():
        parts = parts.join(F.broadcast(hot), "part", "left").withColumn("salts", F.coalesce("salts", F.lit(1))).where("salts > 0")
        parts = parts.select("i", "part", F.pmod(F.xxhash64("i"), "salts").cast("int").alias("salt"))
    else:
        parts = parts.withColumn("salt", F.lit(0))
    salted = known.where("value is not null").select("value", "pos", "times", "part", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / HOT).cast("int"))).alias("salt"))
    parts, salted = (df.repartition(cuts, "part", "salt").hint("merge") for df in (parts, salted))
    found = parts.join(salted, ["part", "salt"]).select("i", "value", "pos", "times").join(named.select("i", "text"), "i")
    return found.where(F.col("text").contains(normalize_token(F.col("value")))).select("i", "value", "pos", "times"), known


def match_longest(names: DataFrame, name: str, key: str, values: DataFrame, value: str, pos: str | None = None) -> DataFrame:
    """(key, name, match): the longest value that name contains, as it is in lower case or normalized; ties by list position; empty if none."""
    spark, named, best = names.sparkSession, _named(names, name, key), []
    form = normalize_token(F.col("value"))
    listed = _rows(values, value, pos).withColumn("n", F.char_length("value"))
    sizes = listed.groupBy("n", F.char_length(form).alias("f")).count().collect()  # one row a pair of lengths
    lengths, rest = sorted({r["n"] for r in sizes}), named
    while lengths:
        names_left, letters = rest.agg(F.count("text"), F.sum(F.char_length("text"))).first()
        if not names_left:
            break
        longest = lengths[-1]
        while lengths:
            step = [r for r in sizes if lengths[-1] <= r["n"] <= longest]
            forms, many = sorted({r["f"] for r in step} - {0}), sum(r["count"] for r in step)
            if lengths[-1] < longest and max(letters * len(forms), many) > AT_ONCE:
                break
            least, cut, tasks, blank = lengths.pop(), forms, _tasks(spark, many), any(r["f"] == 0 for r in step)
        # the least of (-length, position) is the longest value, the first of its length
        order = F.struct((-F.char_length("value")).alias("n"), "pos", "value")
        within, met, read = listed.where(F.col("n").between(least, longest)), [], []
        if cut:
            dealt = within.where(form != "").select("value", "pos", F.xxhash64(form).alias("part")).repartition(tasks, "part")
            found, known = _met(rest, dealt.groupBy("part", "value").agg(F.min("pos").alias("pos"), F.lit(1).alias("times")), cut, tasks)
            met, read = [found.select("i", order.alias("best"))], [known]
        if blank:  # in every name: the first is enough
            met.append(rest.where("text is not null").select("i").crossJoin(within.where(form == "").agg(F.min(order).alias("best"))))
        with cleaned(spark):
            best.append(written(reduce(DataFrame.unionByName, met).groupBy("i").agg(F.min("best").alias("best"))))
            was = rest
            if lengths:
                rest = written(rest.join(best[-1], "i", "left_anti"))
        for df in [*read, *([was] if lengths and was is not named else [])]:
            dropped(df)
    if not best:
        return named.select(F.col("k").alias(key), F.col("name").alias(name), F.lit("").alias("match"))
    out = named.join(reduce(DataFrame.unionByName, best), "i", "left")
    return out.select(F.col("k").alias(key), F.col("name").alias(name), F.coalesce("best.value", F.lit("")).alias("match"))


def match_all(names: DataFrame, name: str, key: str, values: DataFrame, value: str, pos: str | None = None) -> DataFrame:
    """(key, name, match, n_matches): the only value whose normalized form name contains; empty if there is none or more than one. A value that the list has twice counts twice."""
    listed, named, met = _listed(values, value, pos), _named(names, name, key), []
    form = normalize_token(F.col("value"))
    sizes = {r["f"]: r["count"] for r in listed.groupBy(F.char_length(form).alias("f")).count().collect()}  # one row a length
    if lengths := sorted(set(sizes) - {0}):
        tasks = _tasks(names.sparkSession, sum(sizes.values()))
        met.append(_met(named, listed.where(form != "").withColumn("part", F.xxhash64(form)).repartition(tasks, "part"), lengths, tasks)[0].select("i", "value", "times"))
    if 0 in sizes:  # in every name: their number and the least are enough
        met.append(named.where("text is not null").select("i").crossJoin(listed.where(form == "").agg(F.min("value").alias("value"), F.sum("times").alias("times"))))
    if not met:
        return named.select(F.col("k").alias(key), F.col("name").alias(name), F.lit("").alias("match"), F.lit(0).cast("bigint").alias("n_matches"))
    found = reduce(DataFrame.unionByName, met).groupBy("i").agg(F.sum("times").alias("n_matches"), F.min("value").alias("match"))
    out = named.join(found, "i", "left").select(F.col("k").alias(key), F.col("name").alias(name), "match", F.coalesce("n_matches", F.lit(0)).alias("n_matches"))
    return out.select(key, name, F.when(F.col("n_matches") == 1, F.col("match")).otherwise("").alias("match"), "n_matches")


def match_unique(names: DataFrame, name: str, key: str, values: DataFrame, value: str, pos: str | None = None) -> DataFrame:
    """As match_all, but a name with more than one match raises when the rows are used."""
    out = match_all(names, name, key, values, value, pos)
    ambiguous = F.raise_error(F.concat(F.col(name), F.lit(" has ambiguous matches"))).cast("string")
    return out.select(key, name, F.when(F.col("n_matches") > 1, ambiguous).otherwise(F.col("match")).alias("match"))


def photo_index(listing: DataFrame, ids: DataFrame, calibration: DataFrame, camera: str = "phone", ppm: str = "ppm", pos: str | None = None) -> DataFrame:
    """(split, path, filename, sample_id, camera, ppm, is_matched, issue) of a listing (split, path), ids (split, sample_id) and a calibration table, whose rows pos orders.

    A camera that the calibration has twice takes its first scale: by pos, else the least."""
    files = written(listing.withColumn("filename", F.element_at(F.split("path", "/"), -1)))  # listed once: files may be many, and each use would list them again
    parts = []
    for split in ("train", "test"):
        part = files.where(F.col("split") == split)
        found = match_unique(part, "filename", "path", ids.where(F.col("split") == split), "sample_id").select("path", F.col("match").alias("sample_id"))
        parts.append(part.join(found, "path"))
    out = written(parts[0].unionByName(parts[1]))
    cams = match_longest(out, "filename", "path", calibration, camera, pos).select("path", F.col("match").alias("camera"))
    scale = calibration.select(F.col(camera).cast("string").alias("camera"), F.col(ppm).cast("string").try_cast("double").alias("ppm"), *([F.col(pos).alias("_pos")] if pos else []))
    scale = scale.withColumn("_n", F.row_number().over(Window.partitionBy("camera").orderBy("_pos" if pos else "ppm"))).where("_n = 1").select("camera", "ppm")
    out = out.join(cams, "path").join(scale, "camera", "left")
    issue = F.when(F.col("sample_id") == "", "unmatched_sample_id").when(F.col("camera") == "", "unknown_camera").otherwise("")
    return written(out.select("split", "path", "filename", "sample_id", "camera", "ppm", (F.col("sample_id") != "").alias("is_matched"), issue.alias("issue")))


def coverage(index: DataFrame, ids: DataFrame) -> DataFrame:
    """One row of counts: photos, matched, unknown cameras by split, and ids that no photo has."""
    counts = index.groupBy("split").agg(F.count("*").alias("photos"), F.count_if("is_matched").alias("matched"), F.count_if(F.col("issue") == "unknown_camera").alias("unknown_camera"))
    gaps = ids.join(index.where("is_matched").select("split", "sample_id"), ["split", "sample_id"], "left_anti")
    gaps = gaps.groupBy("split").agg(F.array_sort(F.collect_set("sample_id")).alias("without_photo"))
    return counts.join(gaps, "split", "left")


def pick_column(df: DataFrame, exact: str, parts: list[list[str]], kind: str) -> str | None:
    """Name of the column called exact, else the first that holds all words of one of parts, else the first of a kind ("string" or "number")."""
    lower = {c: c.lower() for c in df.columns}
    for c, x in lower.items():
        if x == exact:
            return c
    for c, x in lower.items():
        if any(all(w in x for w in words) for words in parts):
            return c
    number = ("int", "bigint", "smallint", "tinyint", "float", "double", "decimal")
    return next((c for c, t in df.dtypes if (t == "string") == (kind == "string") and (kind == "string" or t.startswith(number))), None)

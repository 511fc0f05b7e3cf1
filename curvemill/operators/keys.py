"""Key checks, aligned joins and blends of prediction tables.

Reports are DataFrames, so a check costs one aggregation; require_* run them and raise. Alignments are equi-joins on the
full key: both sides are shuffled by it once, and one group-by serves any number of components.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import curves as C
from .working import written


def keys_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """rows, null_keys, duplicate_keys (distinct keys that come twice or more) in one row."""
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"),
        F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).cast("long").alias("null_keys"),
        F.count(F.when(~null & (F.col("n") > 1), 1)).alias("duplicate_keys"),
    )


def coverage_report(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """missing (in left only) and extra (in right only) distinct keys."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, keys, "full_outer")
    return both.agg(F.count(F.when(F.col("_r").isNull(), 1)).alias("missing"), F.count(F.when(F.col("_l").isNull(), 1)).alias("extra"))


def require_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    r = keys_report(df, keys).first()
    if r["null_keys"] or r["duplicate_keys"]:
        raise ValueError(f"{what}: {r['null_keys']} null and {r['duplicate_keys']} repeated keys in {keys}")
    return df


def require_same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    r = coverage_report(left, right, keys).first()
    if r["missing"] or r["extra"]:
        raise ValueError(f"key sets differ: {r['missing']} missing, {r['extra']} extra")


def require_disjoint(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    if not left.select(*keys).join(right.select(*keys), keys, "left_semi").isEmpty():
        raise ValueError("key sets overlap")


def same_multiset(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row with same: both tables hold the same rows as often."""
    extra = left.exceptAll(right).select(F.lit(1).alias("x")).unionAll(right.exceptAll(left).select(F.lit(1).alias("x")))
    return extra.agg((F.count("*") == 0).alias("same"))


def lookup(probe: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """probe with table's columns; a key that table lacks raises when the rows are used."""
    hit = table.withColumn("_hit", F.lit(True))
    out = probe.join(hit, keys, "left")
    guard = F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit("missing key: "), F.concat_ws(",", *(F.col(k).cast("string") for k in keys)))))
    return out.withColumn("_hit", F.coalesce(guard.cast("boolean"), F.col("_hit"))).where("_hit").drop("_hit")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """Full outer join with both sides' other columns suffixed; keys must be unique on both sides, missing ones show as nulls."""
    left, right = written(left), written(right)  # read by the checks and by the join
    require_unique(left, keys, "left")
    require_unique(right, keys, "right")
    name = lambda df, s: df.select(*keys, *(F.col(c).alias(c + s) for c in df.columns if c not in keys))
    return name(left, suffixes[0]).join(name(right, suffixes[1]), keys, "full_outer")


def differences(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value_left, value_right and value_change = left - right of two tables with equal keys."""
    out = one_to_one(left.select(*keys, value), right.select(*keys, value), keys)
    return out.withColumn(f"{value}_change", F.col(f"{value}_left") - F.col(f"{value}_right"))


def merge(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """Inner join on any number of keys; columns that both sides have besides the keys get suffixes, others keep their names."""
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    name = lambda df, s: df.select(*(F.col(c).alias(c + s if c in shared else c) for c in df.columns))
    return name(left, suffixes[0]).join(name(right, suffixes[1]), keys)


def merge_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """merge() of tables that have each key once at most; a key that either has twice, or a null one, is an error."""
    left, right = written(left), written(right)  # read by the checks and by the join
    require_unique(left, keys, "left")
    require_unique(right, keys, "right")
    return merge(left, right, keys, suffixes)


def positions(df: DataFrame, key: str, index: DataFrame, name: str = "pos") -> DataFrame:
    """df with the position of each row's key in an index (key, pos), -1 for keys that it lacks: a join, whatever the index's size."""
    at = index.select(F.col(key).alias("_k"), F.col("pos").alias("_p"))
    return df.join(at, df[key] == F.col("_k"), "left").withColumn(name, F.coalesce("_p", F.lit(-1))).drop("_k", "_p")


def reindexed(df: DataFrame, key: str, index: DataFrame, missing: str = "null") -> DataFrame:
    """A row for each key of an index (key, pos), with its position; keys that df lacks have nulls, or raise when the rows are used (missing="raise"). Keys of df must be unique."""
    out = index.select(key, "pos").join(require_unique(df, [key]).withColumn("_hit", F.lit(True)), key, "left")
    if missing == "raise":
        guard = F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit("missing key: "), F.col(key).cast("string"))).cast("boolean"))
        out = out.where(F.coalesce(guard, F.lit(True)))
    return out.drop("_hit")


def shifted_features(df: DataFrame, by: int, prefix: str = "feature_") -> DataFrame:
    """df with its numbered features counted from `by` on, so that another table's can stand before them."""
    new = {c: f"{prefix}{int(c[len(prefix):]) + by}" for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()}
    return df.select(*(F.col(c).alias(new.get(c, c)) for c in df.columns))


def complete(joined: DataFrame, what: str = "join") -> DataFrame:
    """joined, or an error if a full outer join left a null anywhere."""
    nulls = joined.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in joined.columns)).first().asDict()
    if bad := {k: v for k, v in nulls.items() if v}:
        raise ValueError(f"{what}: rows without a partner {bad}")
    return joined


def with_parameters(df: DataFrame, **grids: list) -> DataFrame:
    """Each row with every combination of the named parameters: one explode a parameter, no join."""
    for name, values in grids.items():
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return df


def excluding_hashes(df: DataFrame, content: str, excluded: DataFrame) -> DataFrame:
    """df without the rows whose content has one of the excluded SHA-256 digests (column sha256)."""
    digest = excluded.select(F.lower("sha256").alias("_sha256"))
    return df.join(digest, F.sha2(F.col(content).cast("binary"), 256) == F.col("_sha256"), "left_anti")


def numbered_ranges(df: DataFrame, group: list[str], order: list[str], count: str) -> DataFrame:
    """df with first_number and last_number: the running numbers of each row's count items within its group, from 1."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("first_number", (F.coalesce(F.sum(count).over(w), F.lit(0)) + 1).cast("long"))
    return out.withColumn("last_number", (F.col("first_number") + F.col(count) - 1).cast("long"))


def seeded_order(df: DataFrame, group: list[str], key: str, seed: int, name: str = "place") -> DataFrame:
    """df with its place in a permutation of each group's keys: by the MD5 of seed and key, the same on every machine."""
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(mark, key)))


def union_experiments(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables stacked under an experiment column, first."""
    parts = [df.select(F.lit(name).alias("experiment"), *df.columns) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def _pointwise(tables: list[DataFrame], keys: list[str], how: Column, least: int | None = None, cdf: str = "cdf") -> DataFrame:
    long = reduce(DataFrame.unionByName, (t.select(*keys, F.posexplode(cdf).alias("pos", "v")) for t in tables))
    points = long.groupBy(*keys, "pos").agg(how.alias("v"), F.count("*").alias("n"))
    n = len(tables)
    out = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("p"), F.min("n").alias("n_components"))
    out = out.select(*keys, F.transform("p", lambda x: x["v"]).alias(cdf), "n_components")
    return out.where(F.col("n_components") >= (n if least is None else least))


def blend_mean(tables: list[DataFrame], keys: list[str], least: int | None = None) -> DataFrame:
    """Mean curve over tables by key in one group-by; keys in fewer than least tables (all by default) are left out."""
    return _pointwise(tables, keys, F.avg("v"), least)


def blend_median(tables: list[DataFrame], keys: list[str], least: int | None = None) -> DataFrame:
    """Coordinatewise exact median; the last point stays 100. A group is a point of one key: it has a value a table."""
    return _pointwise(tables, keys, F.median("v"), least)


def all_pairs(df: DataFrame, member: str, blocks: int | None = None) -> DataFrame:
    """Pairs of all rows with member_a < member_b and both curves: rows are dealt to blocks, and each pair of blocks is a group of its own."""
    blocks = blocks or max(1, int(df.sparkSession.sparkContext.defaultParallelism ** 0.5))
    block = F.pmod(F.xxhash64(member), F.lit(blocks)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = df.select(block.alias("i"), each.alias("j"), F.col(member).alias("member_a"), F.col("cdf").alias("cdf_a"))
    b = df.select(each.alias("i"), block.alias("j"), F.col(member).alias("member_b"), F.col("cdf").alias("cdf_b"))
    return a.join(b, ["i", "j"]).where("member_a < member_b").drop("i", "j")


def pairs_within(df: DataFrame, group: list[str], member: str) -> DataFrame:
    """Pairs of a group's rows with member_a < member_b and both curves (views of one sample: few a group)."""
    a = df.select(*group, F.col(member).alias("member_a"), F.col("cdf").alias("cdf_a"))
    b = df.select(*group, F.col(member).alias("member_b"), F.col("cdf").alias("cdf_b"))
    return a.join(b, group).where("member_a < member_b")


def view_disagreement(df: DataFrame, sample: str, view: str) -> DataFrame:
    """Mean EMD over pairs of views of one sample (null without pairs) and the number of pairs."""
    pairs = pairs_within(df, [sample], view)
    return pairs.select(C.emd(F.col("cdf_a"), F.col("cdf_b")).alias("e")).agg(F.avg("e").alias("disagreement"), F.count("*").alias("pairs"))


def first_per(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_per(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group with their rank from 1; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

"""Feature and curve aggregation: many observations to one row per entity or view, leave-one-out statistics and screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import curves as C
from .working import running


def feature_columns(df: DataFrame, prefix: str = "feature_") -> list[str]:
    if not (found := [c for c in df.columns if c.startswith(prefix)]):
        raise ValueError(f"no columns begin with {prefix}")
    return found


def mean_by(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Mean of feature columns by keys; views weigh by their number of observations. One partial aggregation before the shuffle."""
    return df.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in columns or feature_columns(df)))


def macro_mean(df: DataFrame, sample: list[str], view: str, columns: list[str] | None = None) -> DataFrame:
    """Mean of the views' means: every view of a sample weighs the same."""
    columns = columns or feature_columns(df)
    return mean_by(mean_by(df, [*sample, view], columns), sample, columns)


def sample_weights(df: DataFrame, sample: list[str], name: str = "weight") -> DataFrame:
    """Each observation with weight 1 / observations of its sample, by a join with the counts (no window holds a hot sample)."""
    n = df.groupBy(*sample).agg((F.lit(1.0) / F.count("*")).alias(name))
    return df.join(n, sample)


def weighted_mean(df: DataFrame, weight: str, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(*((F.sum(F.col(c) * F.col(weight)) / F.sum(weight)).alias(c) for c in columns))


def ranked_values(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, v, c, upto, n): each distinct value of a group that is not null, how often it comes, how many values are not above it, and the group's size.

    Values are counted before anything is sorted, and the counts are summed up over ranges of the sorted values, so a group may be the whole table."""
    counts = df.select(*keys, F.col(value).cast("double").alias("v")).where("v is not null").groupBy(*keys, "v").agg(F.count("*").alias("c"))
    return running(counts, keys, ["v"], "c", "upto", "n")


def order_statistics(df: DataFrame, value: str, ranks, keys: list[str]) -> DataFrame:
    """(keys, rank, v, n): the values at some ranks (from 1) of each group, and its size. ranks(n) is an array column of the group's row count n."""
    rows = ranked_values(df, value, keys)
    here = F.filter(ranks(F.col("n")), lambda r: (r > F.col("upto") - F.col("c")) & (r <= F.col("upto")))
    return rows.select(*keys, F.explode(here).alias("rank"), "v", "n")


def quantiles(df: DataFrame, value: str, shares: list[float], keys: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one column each (q10 for 0.1)."""
    keys = keys or []
    at = lambda n, s: (n - 1) * F.lit(float(s))
    ranks = lambda n: F.array_distinct(F.flatten(F.array(*(F.array((F.floor(at(n, s)) + 1).cast("long"), (F.ceil(at(n, s)) + 1).cast("long")) for s in shares))))
    found = order_statistics(df, value, ranks, keys)
    out = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m"), F.first("n").alias("n"))  # a few a group
    take = lambda r: F.element_at("m", (r + 1).cast("long"))
    between = lambda s: take(F.floor(at(F.col("n"), s))) + (take(F.ceil(at(F.col("n"), s))) - take(F.floor(at(F.col("n"), s)))) * (at(F.col("n"), s) - F.floor(at(F.col("n"), s)))
    return out.select(*keys, *(between(s).alias(f"q{round(100 * s)}") for s in shares))


def medians(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, median) of each group of any size."""
    return quantiles(df, value, [0.5], keys).withColumnRenamed("q50", "median")


def pair_means(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, emd, pairs): the mean EMD over all pairs of a group's curves (null without pairs), without making any pair.

    EMD is a weighted sum of |a - b| over the curve's points, and the sum of |a - b| over all pairs of sorted values is the sum of (2 rank - n - 1) times the value: ranks
    of each point's values are all it takes. Equal values have the mean of their ranks."""
    keys = keys or []
    widths = F.array(*map(F.lit, C.WIDTHS))
    ranks = ranked_values(points(df, keys).where(F.col("pos") < C.POINTS - 1), "value", [*keys, "pos"])
    part = F.get(widths, F.col("pos")) * F.col("v") * F.col("c") * (2 * F.col("upto") - F.col("c") - F.col("n"))
    sums = ranks.groupBy(*keys).agg(F.sum(part).alias("s"), F.max("n").alias("n"))
    pairs = F.coalesce((F.col("n") * (F.col("n") - 1) / 2).cast("long"), F.lit(0).cast("long"))
    return sums.select(*keys, F.when(F.col("n") > 1, F.col("s") / pairs).alias("emd"), pairs.alias("pairs"))


def standardize(df: DataFrame, columns: list[str], flat: float = 0.0) -> DataFrame:
    """(x - mean) / population deviation; a deviation of flat or less counts as 1 (0 for ridge, 1e-12 for neighbours)."""
    stats = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.crossJoin(F.broadcast(stats))  # one row
    scale = lambda c: F.when(F.col(f"s_{c}") <= flat, 1.0).otherwise(F.col(f"s_{c}"))
    return out.select(*(c for c in df.columns if c not in columns), *(((F.col(c) - F.col(f"m_{c}")) / scale(c)).alias(c) for c in columns))


def build_curves(df: DataFrame, value: str, keys: list[str], thresholds: tuple[float, ...], weight: str | None = None) -> DataFrame:
    """The curve of each group: share (0 to 100) of its weight at or below each threshold. One partial aggregation of conditional sums."""
    w = F.col(weight) if weight else F.lit(1.0)
    sums = [F.sum(F.when(F.col(value) <= t, w).otherwise(0.0)).alias(f"_{i}") for i, t in enumerate(thresholds)]
    out = df.groupBy(*keys).agg(F.sum(w).alias("_w"), *sums)
    return out.select(*keys, F.array(*(F.lit(100.0) * F.col(f"_{i}") / F.col("_w") for i in range(len(thresholds)))).alias("cdf"))


def points(df: DataFrame, keys: list[str]) -> DataFrame:
    """Long form: a row a point, pos from 0."""
    return df.select(*keys, F.posexplode("cdf").alias("pos", "value"))


def mean_curve(df: DataFrame) -> DataFrame:
    """One row: the coordinatewise mean, closed with 100."""
    return df.agg(C.close(F.array(*(F.avg(F.element_at("cdf", i + 1)) for i in range(C.POINTS)))).alias("cdf"))


def median_curve(df: DataFrame) -> DataFrame:
    """One row: the coordinatewise exact median, closed with 100."""
    by_point = medians(points(df, []), "value", ["pos"]).agg(F.array_sort(F.collect_list(F.struct("pos", "median"))).alias("p"))  # eleven rows
    return by_point.select(C.close(F.transform("p", lambda x: x["median"])).alias("cdf"))


def loo_mean(df: DataFrame) -> DataFrame:
    """Each curve with the mean of all others (predicted), from one total row: sum minus self."""
    sums = df.agg(F.count("*").alias("_n"), *(F.sum(F.element_at("cdf", i + 1)).alias(f"_{i}") for i in range(C.POINTS)))
    out = df.crossJoin(F.broadcast(sums))  # one row
    others = F.array(*((F.col(f"_{i}") - F.element_at("cdf", i + 1)) / (F.col("_n") - 1) for i in range(C.POINTS)))
    return out.where("_n > 1").select(*df.columns, C.close(others).alias("predicted"))


def loo_median(df: DataFrame, key: str) -> DataFrame:
    """Each curve with the coordinatewise median of all others.

    The median without a row depends only on the middle order statistics of each coordinate and on which side of them the row's value is: what
    is at rank m without it is at rank m + 1 with it where its value is not above that at m, else at m. No row is ranked or meets all others."""
    long = points(df, [key])
    middle = lambda n: F.sequence(F.greatest(F.floor((n - 1) / 2), F.lit(1)), F.least(F.floor(n / 2) + 2, n))
    mids = order_statistics(long, "value", middle, ["pos"]).groupBy("pos").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("mids"))
    n = df.agg(F.count("*").alias("n"))
    out = long.join(F.broadcast(mids), "pos").crossJoin(F.broadcast(n)).where("n > 1")  # eleven rows, one row
    at = lambda m: F.element_at("mids", m.cast("long"))
    take = lambda m: F.when(F.col("value") > at(m), at(m)).otherwise(at(m + 1))
    low, high = F.floor(F.col("n") / 2), F.floor((F.col("n") - 1) / 2) + 1
    curves = out.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", ((take(low) + take(high)) / 2).alias("v")))).alias("p"))
    return df.join(curves, key).select(*df.columns, C.close(F.transform("p", lambda x: x["v"])).alias("predicted"))


def improvement(errors: DataFrame, reference: str = "reference", error: str = "error", keys: list[str] | None = None) -> DataFrame:
    """A row of evidence over paired errors (of each group): mean gain, wins by more than 1e-9, and the gain without the largest one."""
    d = F.col(reference) - F.col(error)
    out = errors.select(*(keys or []), d.alias("d")).groupBy(*(keys or [])).agg(F.avg("d").alias("mean_improvement"), F.count_if(F.col("d") > 1e-9).alias("improved"), F.count("*").alias("samples"), F.sum("d").alias("_s"), F.max("d").alias("_m"))
    return out.withColumn("improvement_without_largest", (F.col("_s") - F.col("_m")) / (F.col("samples") - 1)).drop("_s", "_m")


def wins(errors: DataFrame, reference: str = "reference", error: str = "error", slack: float = 1e-9) -> DataFrame:
    """One row: pairs better at all, better by more than slack as a difference, better than the reference less slack, and pairs."""
    r, e = F.col(reference), F.col(error)
    return errors.agg(F.count_if(r - e > 0).alias("better"), F.count_if(r - e > slack).alias("clearly_better"), F.count_if(e < r - slack).alias("below_reference"), F.count("*").alias("pairs"))


def screened(evidence: DataFrame, disagreement: str, reference_disagreement: str) -> DataFrame:
    """evidence with view_not_worse and eligible: a gain of 1 or more, half the samples better, views not worse, and still better without the largest gain."""
    ok = F.coalesce(F.col(disagreement) <= F.col(reference_disagreement), F.lit(False))
    out = evidence.withColumn("view_not_worse", ok)
    return out.withColumn("eligible", (F.col("mean_improvement") >= 1) & (2 * F.col("improved") >= F.col("samples")) & F.col("view_not_worse") & (F.col("improvement_without_largest") > 0))


def best_by(df: DataFrame, group: list[str], score: str, ties: list, pick: list[str]) -> DataFrame:
    """The row of each group with the least score, ties by the given columns in order (negate one for the larger)."""
    order = F.struct(F.col(score), *(t if not isinstance(t, str) else F.col(t) for t in ties))
    return df.groupBy(*group).agg(F.min_by(F.struct(*pick), order).alias("_b"), F.min(score).alias(score)).select(*group, "_b.*", score) if score not in pick else df.groupBy(*group).agg(F.min_by(F.struct(*pick), order).alias("_b")).select(*group, "_b.*")


def histogram(df: DataFrame, label: str, n: int) -> DataFrame:
    """Counts of the labels 0 .. n-1, empty ones too."""
    labels = df.sparkSession.range(n).select(F.col("id").alias(label))
    counts = df.groupBy(F.col(label).cast("long").alias(label)).agg(F.count("*").alias("n"))
    return labels.join(counts, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))


def regions(pixels: DataFrame, ppm: float, image: list[str] | None = None) -> DataFrame:
    """Region table of label images given as pixels (y, x, label): area, equivalent diameter, whether it touches the border, whether it is a coarse inner one.

    The border is the least and greatest y and x of the image, background (label 0) included."""
    if not ppm > 0 or ppm == float("inf"):
        raise ValueError("ppm must be positive and finite")
    image = image or []
    frame = pixels.groupBy(*image).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    at = pixels.join(frame, image) if image else pixels.crossJoin(F.broadcast(frame))
    edge = (F.col("y") == F.col("y0")) | (F.col("y") == F.col("y1")) | (F.col("x") == F.col("x0")) | (F.col("x") == F.col("x1"))
    out = at.where("label > 0").groupBy(*image, F.col("label").alias("region_id")).agg(F.count("*").alias("area_pixels"), F.max(edge).alias("touches_border"))
    out = out.withColumn("area_mm2", F.col("area_pixels") / F.lit(float(ppm) ** 2))
    out = out.withColumn("diameter_mm", 2 * F.sqrt(F.col("area_mm2") / F.pi()))
    return out.select(*image, "region_id", "area_pixels", "area_mm2", "diameter_mm", "touches_border", ((F.col("diameter_mm") >= 2) & ~F.col("touches_border")).alias("coarse_interior"))

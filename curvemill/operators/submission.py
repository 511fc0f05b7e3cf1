"""Submissions against a template: complete, unique and ordered ids, the template's columns, curve rules; and checks that a table rebuilds a saved one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import curves as C
from .keys import coverage_report, keys_report

TOLERANCE = 1e-10


def ids_of(template: DataFrame, split: str, key: str = "sample_id") -> DataFrame:
    """(split, sample_id): the ids of a template as a source of their own."""
    return template.select(F.lit(split).alias("split"), F.col(key).cast("string").alias("sample_id"))


def submission_report(submission: DataFrame, template: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row: rows, null_keys, duplicate_keys, missing and extra ids, rows of a bad curve, rows whose last point is not 100, and valid. Columns that differ from the template's, in name or order, raise."""
    if submission.columns != template.columns:
        raise ValueError(f"columns must be {template.columns}")
    ends = [c for c in template.columns if c != key]
    cdf = F.array(*(F.col(f"`{c}`").cast("double") for c in ends))
    hole = F.exists(cdf, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 100))
    falls = F.exists(F.zip_with(F.slice(cdf, 1, len(ends) - 1), F.slice(cdf, 2, len(ends) - 1), lambda a, b: b - a), lambda d: d < -C.STEP)
    checked = submission.select(F.coalesce(hole | falls, F.lit(True)).alias("bad"), F.coalesce(F.abs(F.element_at(cdf, -1) - 100) > 1e-9, F.lit(True)).alias("open"))
    rules = checked.agg(F.coalesce(F.count_if("bad"), F.lit(0)).alias("bad_curves"), F.coalesce(F.count_if("open"), F.lit(0)).alias("open_ends"))
    ids = lambda df: df.select(F.col(key).cast("string").alias(key))
    repeated = keys_report(template, [key]).select(F.col("duplicate_keys").alias("template_duplicates"))
    parts = [keys_report(submission, [key]), repeated, coverage_report(ids(template), ids(submission), [key]), rules]  # one row each
    out = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)
    faults = ["null_keys", "duplicate_keys", "template_duplicates", "missing", "extra", "bad_curves", "open_ends"]
    return out.withColumn("valid", reduce(lambda a, b: a & b, (F.col(c) == 0 for c in faults)))


def require_submission(submission: DataFrame, template: DataFrame, key: str = "sample_id") -> DataFrame:
    """submission, or an error that names its faults."""
    r = submission_report(submission, template, key).first().asDict()
    if not r["valid"]:
        raise ValueError(f"submission refused: {({k: v for k, v in r.items() if v and k not in ('rows', 'valid')})}")
    return submission


def from_curve(template: DataFrame, curve: list[float], key: str = "sample_id") -> DataFrame:
    """The template with the same curve for every id; the last point is 100."""
    ends = [c for c in template.columns if c != key]
    if len(curve) != len(ends):
        raise ValueError(f"a curve of {len(ends)} points is needed")
    values = dict(zip(ends, [*map(float, curve[:-1]), 100.0], strict=True))
    return template.select(*(F.lit(values[c]).alias(c) if c in values else F.col(c) for c in template.columns))


def in_order(df: DataFrame, order: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """df's rows in the given order: order (keys, pos) names every row once; keys that it lacks are left out, those that df lacks raise when the rows are used."""
    from .keys import lookup

    return lookup(order.select(*keys, pos), df, keys).orderBy(pos)


def rebuild_report(actual: DataFrame, saved: DataFrame, keys: list[str], values: list[str], tolerance: float = TOLERANCE, by: list[str] | None = None) -> DataFrame:
    """Whether actual gives saved again by keys (any number), in one row, or one for each value of the keys `by`: null and repeated keys of either side, keys of one side alone, the greatest difference, and same.

    Both sides are put on top of each other and grouped by key once: a key's rows of either side are counted, and its values compared where both have them."""
    by = by or []
    side = lambda df, i: df.select(*keys, *(F.when(F.lit(i == s), F.col(c).cast("double")).alias(f"{c}{s}") for c in values for s in (0, 1)), F.lit(1 - i).alias("n0"), F.lit(i).alias("n1"))
    rows = side(actual, 0).unionByName(side(saved, 1))
    met = rows.groupBy(*keys).agg(*(F.max(f"{c}{s}").alias(f"{c}{s}") for c in values for s in (0, 1)), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    gap = F.greatest(*(F.coalesce(F.abs(F.col(f"{c}0") - F.col(f"{c}1")), F.lit(float("inf"))) for c in values), F.lit(0.0))
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    count = lambda test: F.coalesce(F.count_if(test), F.lit(0))
    a, b = F.col("n0"), F.col("n1")
    out = met.groupBy(*by).agg(
        count(~null & (b == 0)).alias("only_actual"), count(~null & (a == 0)).alias("only_saved"), F.coalesce(F.max(F.when(~null & (a > 0) & (b > 0), gap)), F.lit(0.0)).alias("difference"),
        F.coalesce(F.sum(F.when(null, a)), F.lit(0)).alias("null_actual"), count(~null & (a > 1)).alias("repeated_actual"), F.coalesce(F.sum(F.when(null, b)), F.lit(0)).alias("null_saved"), count(~null & (b > 1)).alias("repeated_saved"),
    )
    faults = reduce(lambda a, b: a + b, (F.col(c) for c in ("only_actual", "only_saved", "null_actual", "repeated_actual", "null_saved", "repeated_saved")))
    return out.withColumn("same", (faults == 0) & (F.col("difference") <= tolerance))


def require_rebuild(actual: DataFrame, saved: DataFrame, keys: list[str], values: list[str], tolerance: float = TOLERANCE) -> None:
    r = rebuild_report(actual, saved, keys, values, tolerance).first()
    if not r["same"]:
        raise ValueError(f"the saved table is not rebuilt: {r.asDict()}")

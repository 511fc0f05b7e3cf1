"""Curve algebra as column expressions: cumulative percentages at eleven fixed diameters, held as array<double>.

Everything is a built-in higher-order function over an 11-element array, so it stays in the JVM and shuffles nothing.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Diameters in mm, and the column labels in canonical spelling.
SUPPORT = (0.002, 0.0063, 0.02, 0.063, 0.2, 0.63, 2.0, 6.3, 20.0, 63.0, 200.0)
LABELS = ("0.002", "0.0063", "0.02", "0.063", "0.2", "0.63", "2.0", "6.3", "20.0", "63.0", "200.0")
LOG_SUPPORT = tuple(math.log10(d) for d in SUPPORT)
WIDTHS = tuple(b - a for a, b in zip(LOG_SUPPORT, LOG_SUPPORT[1:]))
POINTS = len(SUPPORT)
#: Midpoint percentiles of the quantile form.
QUANTILES = 1000
#: Slack of a step down, and of the last point (a hundredth of a thousandth of 100, plus the absolute one).
STEP, LAST = 1e-9, 1e-9 + 1e-5 * 100


def numbers(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def emd_contributions(truth: Column, predicted: Column) -> Column:
    """|difference| times the log10 width right of each of the first ten points; the last point does not count."""
    gaps = F.zip_with(F.slice(truth, 1, POINTS - 1), F.slice(predicted, 1, POINTS - 1), lambda a, b: F.abs(a - b))
    return F.zip_with(gaps, numbers(WIDTHS), lambda gap, width: gap * width)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def emd(truth: Column, predicted: Column) -> Column:
    """Log-weighted earth mover's distance of two curves, 0 to 500."""
    return total(emd_contributions(truth, predicted))


def partial_emd(truth: Column, predicted: Column, first: int) -> Column:
    """The share of the first intervals: four for the fine error of transfers, five for that of the distribution search."""
    return total(F.slice(emd_contributions(truth, predicted), 1, first))


def masses(cdf: Column) -> Column:
    """Mass in each bin: the first point, then the steps."""
    return F.zip_with(cdf, F.concat(F.array(F.lit(0.0)), F.slice(cdf, 1, POINTS - 1)), lambda a, b: a - b)


def _scan(values: Column, start: Column, step) -> Column:
    """Running fold of an array: step(last, x) for each x."""
    return F.aggregate(values, F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, step(start, x)).otherwise(step(F.element_at(acc, -1), x)))))


def from_masses(mass: Column) -> Column:
    """Running sum of bin masses."""
    return _scan(mass, F.lit(0.0), lambda last, x: last + x)


def running_max(values: Column) -> Column:
    return _scan(values, F.lit(float("-inf")), lambda last, x: F.greatest(last, x))


def clipped(values: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.transform(values, lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def repair(values: Column) -> Column:
    """Ten raw predictions as a curve: clipped to 0..100, then made monotone by a running maximum, then closed with 100."""
    return F.concat(running_max(clipped(F.slice(values, 1, POINTS - 1))), F.array(F.lit(100.0)))


def close(values: Column) -> Column:
    """The curve with its last point set to 100."""
    return F.concat(F.slice(values, 1, POINTS - 1), F.array(F.lit(100.0)))


def equal_bins(n: int = POINTS) -> Column:
    return numbers([*(100.0 / n * (i + 1) for i in range(n - 1)), 100.0])


def _steps(cdf: Column) -> Column:
    return F.zip_with(F.slice(cdf, 2, POINTS - 1), F.slice(cdf, 1, POINTS - 1), lambda b, a: b - a)


def _bad(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def violations(cdf: Column) -> Column:
    """struct of booleans under the lenient rules: null, out of range, a step down of more than 1e-9, last point not within about 0.001 of 100."""
    null = cdf.isNull() | (F.size(cdf) != POINTS) | F.exists(cdf, _bad)
    return F.struct(
        F.coalesce(null, F.lit(True)).alias("is_null"),
        F.coalesce(F.exists(cdf, lambda x: (x < 0) | (x > 100)), F.lit(False)).alias("out_of_range"),
        F.coalesce(F.exists(_steps(cdf), lambda d: d < -STEP), F.lit(False)).alias("decreasing"),
        F.coalesce(F.abs(F.element_at(cdf, POINTS) - 100) > LAST, F.lit(False)).alias("open_end"),
    )


def is_curve(cdf: Column) -> Column:
    v = violations(cdf)
    return ~(v["is_null"] | v["out_of_range"] | v["decreasing"] | v["open_end"])


def is_strict_curve(cdf: Column) -> Column:
    """No slack anywhere: finite, within 0..100, never down, the last point exactly 100."""
    finite = cdf.isNotNull() & (F.size(cdf) == POINTS) & ~F.exists(cdf, lambda x: _bad(x) | (F.abs(x) == float("inf")))
    return F.coalesce(finite & ~F.exists(cdf, lambda x: (x < 0) | (x > 100)) & ~F.exists(_steps(cdf), lambda d: d < 0) & (F.element_at(cdf, POINTS) == 100), F.lit(False))


def log_quantiles(cdf: Column, n: int = QUANTILES) -> Column:
    """Log10 diameter of the first point whose cumulative share reaches each of n midpoint percentiles."""
    support = numbers(LOG_SUPPORT)

    def one(i: Column) -> Column:
        p = (i.cast("double") + 0.5) / F.lit(n / 100.0)
        below = F.size(F.filter(cdf, lambda x: x < p))
        return F.element_at(support, below + 1)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)


def from_log_quantiles(quantiles: Column, n: int = QUANTILES, slack: float = 1e-12) -> Column:
    """Share of quantiles at or below each diameter; the last point is 100."""
    counts = F.transform(numbers(LOG_SUPPORT), lambda d: F.size(F.filter(quantiles, lambda q: q <= d + F.lit(slack))) * F.lit(100.0 / n))
    return close(counts)


def blend(curves: list[Column], weights: list[float] | None = None) -> Column:
    """Convex combination, equal by default."""
    weights = weights or [1.0 / len(curves)] * len(curves)
    if len(weights) != len(curves) or any(w < 0 for w in weights) or abs(sum(weights) - 1) > 1e-12:
        raise ValueError("weights must be non-negative, one a curve, and sum to 1")

    def times(c: Column, w: float) -> Column:
        return F.transform(c, lambda x: x * F.lit(w))

    scaled = [times(c, w) for c, w in zip(curves, weights, strict=True)]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), scaled)


def weibull(log_scale: Column, log_shape: Column) -> Column:
    """Curve of a Weibull distribution from its log scale and log shape, each kept within the numeric bounds of the fit."""
    scale = F.least(F.greatest(log_scale, F.lit(math.log(1e-5))), F.lit(math.log(1e4)))
    shape = F.exp(F.least(F.greatest(log_shape, F.lit(math.log(0.05))), F.lit(math.log(20.0))))

    def at(log_d: Column) -> Column:
        power = F.least(F.greatest(shape * (log_d - scale), F.lit(-745.0)), F.lit(math.log(745.0)))
        return F.lit(-100.0) * F.expm1(-F.exp(power))

    return close(F.transform(numbers(math.log(d) for d in SUPPORT), at))


def support_columns(names) -> list[str]:
    """The names that stand for the eleven diameters, in order; any spelling of the number counts, a missing one is an error."""
    found: dict[float, str] = {}
    for name in map(str, names):
        try:
            value = float(name)
        except ValueError:
            continue
        for d in SUPPORT:
            if abs(value - d) <= max(1e-12, d * 1e-9):
                found[d] = name
    if missing := [str(d) for d in SUPPORT if d not in found]:
        raise ValueError(f"no columns for diameters {missing}")
    return [found[d] for d in SUPPORT]


def from_wide(df: DataFrame, name: str = "cdf") -> DataFrame:
    """Eleven number columns as one array, in ANSI casts that raise on text."""
    wide = support_columns(df.columns)
    return df.withColumn(name, F.array(*(F.col(f"`{c}`").cast("double") for c in wide))).drop(*wide)


def to_wide(df: DataFrame, labels=LABELS, name: str = "cdf") -> DataFrame:
    """One column a diameter, in the template's spelling."""
    spelled = support_columns(labels)
    return df.select(*(c for c in df.columns if c != name), *(F.element_at(name, i + 1).alias(s) for i, s in enumerate(spelled)))

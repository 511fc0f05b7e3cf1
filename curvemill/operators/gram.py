"""Ridge fitted from sums: tasks add up blocks of the Gram matrix of (1, x, y), so training rows may be any number and columns many hundreds.

Leave-one-out folds are the totals minus the row's own products; only (p + 11) ** 2 numbers reach the driver or a fold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import models as M
from ..functions.curves import POINTS
from .working import written

#: Rows of a task's result that are no sums: least and greatest values of the columns.
LOW, HIGH = -1, -2


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _rows(df: DataFrame, columns: list[str], weight: Column | None = None) -> DataFrame:
    return df.select(F.array(*(F.col(c).cast("double") for c in columns)).alias("x"), F.slice("cdf", 1, POINTS - 1).alias("y"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))


def _folded(parts: DataFrame) -> dict[int, np.ndarray]:
    """Rows (i, v) of all tasks folded by i: sums, or least and greatest values. A group has one row a task."""

    def fold(rows: pa.Table) -> pa.Table:
        i = rows["i"][0].as_py()
        v = _matrix(rows["v"].combine_chunks())
        return pa.table({"i": pa.array([i], pa.int32()), "v": pa.array([v.min(0) if i == LOW else v.max(0) if i == HIGH else v.sum(0)], pa.list_(pa.float64()))})

    out = parts.groupBy("i").applyInArrow(fold, "i int, v array<double>")
    return {r["i"]: np.array(r["v"]) for r in out.collect()}  # p + 13 rows at most


def _batch(rows: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"i": pa.array(list(rows), pa.int32()), "v": pa.array([v.astype(float) for v in rows.values()], pa.list_(pa.float64()))})


def sums(df: DataFrame, columns: list[str], weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The weighted Gram matrix of (1, x, y) and each column's least and greatest value."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, low, high = 0.0, np.inf, -np.inf
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("x"))
                z = np.hstack([np.ones((len(x), 1)), x, _matrix(b.column("y"))])
                total, low, high = total + (z * b.column("w").to_numpy()[:, None]).T @ z, np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        if np.ndim(total):
            yield _batch({**dict(enumerate(total)), LOW: low, HIGH: high})

    found = _folded(_rows(df, columns, weight).mapInArrow(add, "i int, v array<double>"))
    if not found:
        raise ValueError("at least one training row is needed")
    return np.stack([found[i] for i in range(len(found) - 2)]), found[LOW], found[HIGH]


def solve(total: np.ndarray, p: int, alpha: float, constant: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations, weights and intercept of a standardized ridge from the Gram matrix; constant columns get a deviation of 1."""
    n, sx, sy = total[0, 0], total[0, 1 : 1 + p], total[0, 1 + p :]
    mean = sx / n
    cov = total[1 : 1 + p, 1 : 1 + p] - np.outer(sx, sx) / n
    spread = np.where(constant, 1.0, np.sqrt(np.maximum(np.diag(cov) / n, 0)))
    spread[spread == 0] = 1.0
    cov[constant], cov[:, constant] = 0, 0
    cross = total[1 : 1 + p, 1 + p :] - np.outer(sx, sy) / n
    cross[constant] = 0
    beta = np.linalg.solve(cov / np.outer(spread, spread) + alpha * np.eye(p), cross / spread[:, None])
    return mean, spread, beta, sy / n


def ridge(train: DataFrame, queries: DataFrame, columns: list[str], alpha: float = 10.0, weight: Column | None = None) -> DataFrame:
    """queries with cdf predicted by a ridge on all training rows (columns, cdf), optionally weighted; prediction is an expression over one array."""
    from ..functions.curves import repair

    total, low, high = sums(train, columns, weight)
    mean, spread, beta, base = solve(total, len(columns), alpha, low == high)
    slope = beta / spread[:, None]
    numbers = lambda v: F.array(*(F.lit(float(a)) for a in v))
    x = F.array(*(F.col(c).cast("double") for c in columns))
    raw = [F.aggregate(F.zip_with(x, numbers(slope[:, k]), lambda a, b: a * b), F.lit(float(base[k] - mean @ slope[:, k])), lambda a, b: a + b) for k in range(POINTS - 1)]
    return queries.withColumn("cdf", repair(F.array(*raw)))


def loo_ridge(df: DataFrame, key: str, columns: list[str], alpha: float = 10.0) -> DataFrame:
    """(key, cdf, emd) of each row predicted by the ridge on all others, from the sums. Whether a column is constant without a row is told by how many rows hold its least or greatest value."""
    total, low, high = sums(df, columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.zeros((2, len(low)))
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("x"))
                ends += (x == low).sum(0), (x == high).sum(0)
        yield _batch(dict(enumerate(ends)))

    ends = _folded(_rows(df, columns).mapInArrow(count, "i int, v array<double>"))
    p, n, at_low, at_high = len(columns), total[0, 0], ends[0], ends[1]

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got, errors = [], []
            for x, cdf in zip(frame["x"], frame["cdf"], strict=True):
                x, cdf = np.array(x), np.array(cdf)
                z = np.concatenate([[1.0], x, cdf[:-1]])
                # constant without this row: all other rows hold one end value
                constant = ((at_low == n - 1) & (x != low)) | ((at_high == n - 1) & (x != high)) | (low == high)
                mean, spread, beta, base = solve(total - np.outer(z, z), p, alpha, constant)
                c = M.closed((((x - mean) / spread) @ beta + base)[None])[0]
                got.append(c)
                errors.append(float(M.emd(cdf, c)[0]))
            yield pd.DataFrame({"k": frame["k"], "cdf": got, "emd": errors})

    rows = df.select(F.col(key).cast("string").alias("k"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"), "cdf")
    return rows.mapInPandas(predict, "k string, cdf array<double>, emd double").withColumnRenamed("k", key)


# ridge on observations, every entity weighing the same
#: Entities whose sums a task holds before it hands them on.
HELD = 2000


def entity_blocks(observations: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, n, sx, g), written: each entity's number of observations, their sum and their products summed up (a Gram block of p x p numbers).

    Tasks add up what they read of an entity, so one with very many observations is a few rows a task before it is shuffled."""
    p = len(columns)
    rows = observations.select(F.col(key).alias("k"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))
    kind = dict(rows.dtypes)["k"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            keys, sums = list(held), np.array([held[k] for k in held]).reshape(len(held), -1)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, types[0]), pa.array(list(sums), pa.list_(pa.float64()))], ["k", "v"])

        types: list = []
        for b in batches:
            types[:] = [b.schema.field("k").type]
            if not b.num_rows:
                continue
            x, codes = _matrix(b.column("x")), b.column("k").dictionary_encode()
            at = codes.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.diff(at[order], prepend=-1))
            for rows in np.split(order, starts[1:]):
                k, own = codes.dictionary[int(at[rows[0]])].as_py(), x[rows]
                v = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
                held[k] = held[k] + v if k in held else v
            if len(held) > HELD:
                yield out()
        if held:
            yield out()

    def fold(part: pa.Table) -> pa.Table:
        v = _matrix(part["v"].combine_chunks()).sum(0)
        return pa.table({"k": part["k"][:1], "n": pa.array([v[0]]), "sx": pa.array([v[1 : 1 + p]], pa.list_(pa.float64())), "g": pa.array([v[1 + p :]], pa.list_(pa.float64()))})

    whole = rows.where("k is not null").mapInArrow(add, f"k {kind}, v array<double>").groupBy("k").applyInArrow(fold, f"k {kind}, n double, sx array<double>, g array<double>")
    return written(whole.withColumnRenamed("k", key))


def _entity_parts(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, weighted Gram blocks and curve points of entities."""
    n = rows.column("n").to_numpy()[:, None]
    return _matrix(rows.column("sx")) / n, _matrix(rows.column("g")) / n, _matrix(rows.column("y"))


def _entity_totals(blocks: DataFrame, p: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of entities; sums of means, squared means, Gram blocks, means times curves, curves; and how many entities hold the least or greatest mean of each column, with these."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, low, high = 0.0, np.inf, -np.inf
        for b in batches:
            if b.num_rows:
                m, g, y = _entity_parts(b)
                total = total + np.concatenate([[len(m)], m.sum(0), (m * m).sum(0), g.sum(0), (m.T @ y).ravel(), y.sum(0)])
                low, high = np.minimum(low, m.min(0)), np.maximum(high, m.max(0))
        if np.ndim(total):
            yield _batch({0: total, LOW: low, HIGH: high})

    found = _folded(blocks.mapInArrow(add, "i int, v array<double>"))
    if not found:
        raise ValueError("at least one training entity is needed")
    low, high = found[LOW], found[HIGH]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.zeros((2, p))
        for b in batches:
            if b.num_rows:
                m = _entity_parts(b)[0]
                ends += (m == low).sum(0), (m == high).sum(0)
        yield _batch(dict(enumerate(ends)))

    ends = _folded(blocks.mapInArrow(count, "i int, v array<double>"))
    parts = np.split(found[0], np.cumsum([1, p, p, p * p, p * (POINTS - 1)]))
    return parts[0][0], *parts[1:], np.stack([low, high, ends[0], ends[1]])


def _entity_solution(n: float, means: np.ndarray, squares: np.ndarray, gram: np.ndarray, cross: np.ndarray, curves: np.ndarray, constant: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Means and deviations of the entities' means, weights and intercept."""
    p = len(means)
    mean, base = means / n, curves / n
    spread = np.where(constant, 1.0, np.sqrt(np.maximum(squares / n - mean * mean, 0)))
    spread[spread == 0] = 1.0
    inner = (gram.reshape(p, p) - n * np.outer(mean, mean)) / np.outer(spread, spread)
    return mean, spread, np.linalg.solve(inner + alpha * np.eye(p), (cross.reshape(p, -1) - n * np.outer(mean, base)) / spread[:, None]), base


def _with_curves(blocks: DataFrame, curves: DataFrame, key: str) -> DataFrame:
    return written(blocks.join(curves.select(key, "cdf"), key).select(F.col(key).cast("string").alias("k"), "n", "sx", "g", F.slice("cdf", 1, POINTS - 1).alias("y"), "cdf"))


def entity_ridge(observations: DataFrame, curves: DataFrame, queries: DataFrame, key: str, columns: list[str], alpha: float = 10.0) -> DataFrame:
    """queries with cdf predicted by a ridge on observations (key, columns) of entities with curves (key, cdf): every entity weighs one, features are scaled by the entities' means."""
    from ..functions.curves import repair

    n, *sums, ends = _entity_totals(_with_curves(entity_blocks(observations, key, columns), curves, key), len(columns))
    mean, spread, beta, base = _entity_solution(n, *sums, ends[0] == ends[1], alpha)
    slope = beta / spread[:, None]
    x = F.array(*(F.col(c).cast("double") for c in columns))
    numbers = lambda v: F.array(*(F.lit(float(a)) for a in v))
    raw = [F.aggregate(F.zip_with(x, numbers(slope[:, k]), lambda a, b: a * b), F.lit(float(base[k] - mean @ slope[:, k])), lambda a, b: a + b) for k in range(POINTS - 1)]
    return queries.withColumn("cdf", repair(F.array(*raw)))


def loo_entity_ridge(observations: DataFrame, curves: DataFrame, key: str, columns: list[str], alpha: float = 10.0, view: str | None = None) -> DataFrame:
    """(key, cdf, emd) of each entity, its mean features given, predicted by entity_ridge on all other entities: its whole block is taken from the totals.

    With a view column there is also a row for the mean of each of the entity's views (null: the pooled mean)."""
    p = len(columns)
    blocks = _with_curves(entity_blocks(observations, key, columns), curves, key)
    n, means, squares, gram, cross, sums, (low, high, at_low, at_high) = _entity_totals(blocks, p)
    if n < 2:
        raise ValueError("at least two entities are needed")
    asked = blocks.select("*", F.transform("sx", lambda v: v / F.col("n")).alias("q"), F.lit(None).cast("string").alias("view"))
    if view:
        each = observations.where(F.col(view).isNotNull()).groupBy(F.col(key).cast("string").alias("k"), F.col(view).cast("string").alias("view")).agg(F.array(*(F.avg(F.col(c).cast("double")) for c in columns)).alias("q"))
        asked = asked.unionByName(blocks.join(each, "k"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got, (m, g, y) = [], _entity_parts(b)
                for own, block, points, query in zip(m, g, y, _matrix(b.column("q")), strict=True):
                    # constant among the others: all of them hold one end value
                    constant = ((at_low == n - 1) & (own != low)) | ((at_high == n - 1) & (own != high)) | (low == high)
                    mean, spread, beta, base = _entity_solution(n - 1, means - own, squares - own * own, gram - block, cross - np.outer(own, points).ravel(), sums - points, constant, alpha)
                    got.append(M.closed((((query - mean) / spread) @ beta + base)[None])[0])
                emd = M.emd(_matrix(b.column("cdf")), np.array(got))
                yield pa.RecordBatch.from_arrays([b.column("k"), b.column("view"), pa.array(got, pa.list_(pa.float64())), pa.array(np.asarray(emd, float))], ["k", "view", "cdf", "emd"])

    out = asked.mapInArrow(predict, "k string, view string, cdf array<double>, emd double").withColumnRenamed("k", key)
    return out.withColumnRenamed("view", view) if view else out.drop("view")

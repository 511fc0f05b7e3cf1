"""Leave-one-out of linear predictors from sums, for any number of entities.

Every predictor here is linear in standardized features up to the last step: a form turns curves into targets and predicted targets back into curves, and a solver turns the features' cross products
into weights. What a fold needs of its training rows are the sums of (1, x) times (1, x, targets); tasks add them up once over all entities, and a fold is the totals less the entity's own
products. So no fold sees its training rows, and what reaches the driver are (features + 1) times (features + targets + 1) numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import curves as C, models as M
from ..functions.curves import LOG_SUPPORT, POINTS
from .aggregate import feature_columns, mean_by
from .folds import entities_of
from .gram import HIGH, LOW, _batch, _folded, _matrix
from .working import written

#: (products of standardized features, products with centred targets) -> weights.
Solver = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Form:
    """encode: curves to targets, a row each. decode: predicted targets and the training rows' mean targets to curves."""

    encode: Callable[[np.ndarray], np.ndarray]
    decode: Callable[[np.ndarray, np.ndarray], np.ndarray]


def _root_targets(curves: np.ndarray) -> np.ndarray:
    """Square roots of bin masses, and the masses, whose mean stands in for rows without any."""
    mass = np.diff(curves, axis=1, prepend=0) / 100
    return np.hstack([np.sqrt(np.maximum(mass, 0)), mass])


def _from_roots(raw: np.ndarray, base: np.ndarray) -> np.ndarray:
    got = np.maximum(raw[:, :POINTS], 0) ** 2
    got[got.sum(1) == 0] = base[POINTS:]
    out = np.minimum(np.cumsum(got / got.sum(1, keepdims=True), 1) * 100, 100)
    out[:, -1:] = 100.0
    return out


def _quantile_form(n: int) -> Form:
    logs, share = np.array(LOG_SUPPORT), (np.arange(n) + 0.5) / (n / 100)

    def decode(raw: np.ndarray, _) -> np.ndarray:
        fit = np.stack([np.clip(M.isotonic(r), logs[0], logs[-1]) for r in raw])
        out = np.stack([np.searchsorted(r, logs + 1e-12, "right") for r in fit]) * (100 / n)
        out[:, -1:] = 100.0
        return out

    return Form(lambda curves: np.stack([logs[np.searchsorted(c, share)] for c in curves]), decode)


POINT_FORM = Form(lambda curves: curves[:, :-1], lambda raw, _: M.closed(raw))
ROOT_FORM = Form(_root_targets, _from_roots)
QUANTILE_FORM = _quantile_form(1000)
WEIBULL_FORM = Form(lambda curves: np.stack([M.fit_weibull(c) for c in curves]), lambda raw, _: M.weibull_curve(raw))


def ridge(alpha: float = 10.0, components: int | None = None) -> Solver:
    """Ridge, on the leading principal directions if components is given."""

    def solve(xx: np.ndarray, xt: np.ndarray) -> np.ndarray:
        if components is None:
            return np.linalg.solve(xx + alpha * np.eye(len(xx)), xt)
        basis = np.linalg.eigh(xx)[1][:, ::-1][:, :components]
        return basis @ np.linalg.solve(basis.T @ xx @ basis + alpha * np.eye(components), basis.T @ xt)

    return solve


def partial_least_squares(components: int) -> Solver:
    """The leading covariance direction, then deflation, all on cross products."""

    def solve(xx: np.ndarray, xt: np.ndarray) -> np.ndarray:
        beta, xx, xt = np.zeros_like(xt), xx.copy(), xt.copy()
        directions, loads, answers = [], [], []
        for _ in range(components):
            w = np.linalg.svd(xt, full_matrices=False)[0][:, 0]
            size = w @ xx @ w
            if size < 1e-20:
                break
            p, r = xx @ w / size, xt.T @ w / size
            xx, xt = xx - size * np.outer(p, p), xt - size * np.outer(p, r)
            directions.append(w)
            loads.append(p)
            answers.append(r)
        if directions:
            w, p, r = (np.stack(v, 1) for v in (directions, loads, answers))
            beta = w @ np.linalg.solve(p.T @ w, r.T)
        return beta

    return solve


def _fold(total: np.ndarray, p: int, constant: np.ndarray, solver: Solver) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations, weights and mean targets from sums of (1, x) times (1, x, targets)."""
    n, sx, st = total[0, 0], total[0, 1 : 1 + p], total[0, 1 + p :]
    mean = sx / n
    cov = total[1:, 1 : 1 + p] - np.outer(sx, sx) / n
    spread = np.where(constant, 1.0, np.sqrt(np.maximum(np.diag(cov) / n, 0)))
    spread[spread == 0] = 1.0
    cov[constant], cov[:, constant] = 0, 0
    cross = total[1:, 1 + p :] - np.outer(sx, st) / n
    cross[constant] = 0
    return mean, spread, solver(cov / np.outer(spread, spread), cross / spread[:, None]), st / n


@dataclass(frozen=True)
class _Sums:
    """Sums of all entities' products, and each feature's least and greatest value with the number of entities that hold it: what a fold is made of."""

    total: np.ndarray
    low: np.ndarray
    high: np.ndarray
    at_low: np.ndarray
    at_high: np.ndarray
    form: Form

    def products(self, batch) -> tuple[np.ndarray, np.ndarray]:
        return _products(batch, self.form)

    def without(self, left_out: list[tuple[np.ndarray, np.ndarray]], solver: Solver) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The fold without some entities, given as rows (1, x) and (1, x, targets)."""
        total, low, high = self.total, self.at_low, self.at_high
        for one, whole in left_out:
            total, low, high = total - np.outer(one, whole), low - (one[1:] == self.low), high - (one[1:] == self.high)
        n = self.total[0, 0] - len(left_out)
        return _fold(total, len(self.low), (low == n) | (high == n), solver)

    def predict(self, left_out: list[tuple[np.ndarray, np.ndarray]], solver: Solver, query: np.ndarray) -> np.ndarray:
        mean, spread, beta, center = self.without(left_out, solver)
        return self.form.decode((((query - mean) / spread) @ beta + center)[None], center)[0]


def _products(batch, form: Form) -> tuple[np.ndarray, np.ndarray]:
    a, y = _matrix(batch.column("x")), _matrix(batch.column("cdf"))
    one = np.hstack([np.ones((len(a), 1)), a])
    return one, np.hstack([one, form.encode(y)])


def _summed(entities: DataFrame, p: int, form: Form) -> _Sums:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, low, high = 0.0, np.inf, -np.inf
        for b in batches:
            if b.num_rows:
                one, whole = _products(b, form)
                total = total + one.T @ whole
                low, high = np.minimum(low, one[:, 1:].min(0)), np.maximum(high, one[:, 1:].max(0))
        if np.ndim(total):
            yield _batch({**dict(enumerate(total)), LOW: low, HIGH: high})

    found = _folded(entities.mapInArrow(add, "i int, v array<double>"))
    if not found or found[0][0] < 2:
        raise ValueError("at least two entities are needed")
    low, high = found[LOW], found[HIGH]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.zeros((2, p))
        for b in batches:
            if b.num_rows:
                a = _matrix(b.column("x"))
                ends += (a == low).sum(0), (a == high).sum(0)
        yield _batch(dict(enumerate(ends)))

    ends = _folded(entities.mapInArrow(count, "i int, v array<double>"))
    return _Sums(np.stack([found[i] for i in range(p + 1)]), low, high, ends[0], ends[1], form)


def _entities(observations: DataFrame, curves: DataFrame, key: str, columns: list[str]) -> DataFrame:
    x = F.array(*(F.col(c).cast("double") for c in columns))
    return written(entities_of(observations.select(key, *columns), curves, key).select(F.col(key).cast("string").alias("k"), x.alias("x"), "cdf"))


def _asked(observations: DataFrame, entities: DataFrame, key: str, view: str | None, columns: list[str]) -> DataFrame:
    """entities with what each is asked for: its own features (view null) and those of its views."""
    asked = entities.select("*", F.col("x").alias("q"), F.lit(None).cast("string").alias("view"))
    if view:
        x = F.array(*(F.col(c).cast("double") for c in columns))
        views = mean_by(observations, [key, view], columns).select(F.col(key).cast("string").alias("k"), F.col(view).cast("string").alias("view"), x.alias("q"))
        asked = asked.unionByName(entities.join(views, "k"))
    return asked


def _predicted(asked: DataFrame, sums: _Sums, solvers: list[Solver], key: str) -> DataFrame:
    """(key, view, cdf, emd) of rows (k, x, cdf, q, view, and s: which solver), each without its own entity."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                one, whole = sums.products(b)
                got = np.array([sums.predict([(o, w)], solvers[s], q) for o, w, q, s in zip(one, whole, _matrix(b.column("q")), b.column("s").to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([b.column("k"), b.column("view"), b.column("s"), pa.array(list(got), pa.list_(pa.float64())), pa.array(M.emd(_matrix(b.column("cdf")), got))], ["k", "view", "s", "cdf", "emd"])

    return asked.mapInArrow(predict, "k string, view string, s int, cdf array<double>, emd double").withColumnRenamed("k", key)


def leave_one_out(observations: DataFrame, curves: DataFrame, key: str, view: str | None, solver: Solver, form: Form = POINT_FORM, columns: list[str] | None = None, queries: DataFrame | None = None) -> DataFrame:
    """(key, view, cdf, emd): each entity's mean features (view null), and those of each of its views, predicted from all other entities; or the rows of queries (k, view, q: features) instead."""
    columns = columns or feature_columns(observations)
    entities = _entities(observations, curves, key, columns)
    sums = _summed(entities, len(columns), form)
    asked = _asked(observations, entities, key, view, columns) if queries is None else entities.join(queries.select("k", "view", "q"), "k")
    return _predicted(asked.withColumn("s", F.lit(0)), sums, [solver], key).drop("s")


#: Entities of a block of a nested evaluation.
BLOCK = 200


def nested(observations: DataFrame, curves: DataFrame, key: str, view: str | None, settings: list[tuple[str, Solver]], least: int = 2, form: Form = POINT_FORM, columns: list[str] | None = None) -> DataFrame:
    """(key, view, setting, inner_emd, cdf, emd): leave_one_out() with the setting that is best in a leave-one-out inside each fold's training rows; ties to the earlier setting.

    A fold within a fold is the totals less two entities' products, so the inner errors of entity i are made of pairs (i, j): entities are dealt to blocks, each pair of blocks is a task, and errors are
    averaged by i and setting. least: training rows that a setting may be chosen from."""
    columns = columns or feature_columns(observations)
    entities = _entities(observations, curves, key, columns)
    sums = _summed(entities, len(columns), form)
    if (n := int(sums.total[0, 0])) - 1 < max(least, 2):
        raise ValueError(f"{n - 1} training entities in a fold; {max(least, 2)} are needed")
    solvers = [s for _, s in settings]
    blocks = max(1, -(-n // BLOCK))
    dealt = entities.withColumn("own", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    each = lambda name: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(name)
    left, right = dealt.select("k", "x", "cdf", F.col("own").alias("a"), each("b")), dealt.select("k", "x", "cdf", each("a"), F.col("own").alias("b"))

    def pairs(outer: pa.Table, inner: pa.Table) -> pa.Table:
        rows = []
        if len(outer) and len(inner):
            outer, inner = outer.combine_chunks().to_batches()[0], inner.combine_chunks().to_batches()[0]
            (o1, ow), (i1, iw), truth = sums.products(outer), sums.products(inner), _matrix(inner.column("cdf"))
            names, own = outer.column("k").to_pylist(), inner.column("k").to_pylist()
            for i, name in enumerate(names):
                others = [j for j, k in enumerate(own) if k != name]
                for s, solver in enumerate(solvers):
                    errors = [M.emd(truth[j], sums.predict([(o1[i], ow[i]), (i1[j], iw[j])], solver, i1[j, 1:]))[0] for j in others]
                    rows.append((name, s, float(np.sum(errors)), len(errors)))
        k, s, e, m = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({"k": pa.array(k, pa.string()), "s": pa.array(s, pa.int32()), "e": pa.array(e, pa.float64()), "m": pa.array(m, pa.int64())})

    inner = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(pairs, "k string, s int, e double, m long")
    scores = inner.groupBy("k", "s").agg((F.sum("e") / F.sum("m")).alias("inner_emd"))
    chosen = written(scores.groupBy("k").agg(F.min(F.struct("inner_emd", "s")).alias("b")).select("k", "b.s", "b.inner_emd"))
    asked = _asked(observations, entities, key, view, columns).join(chosen.select("k", "s"), "k")
    out = _predicted(asked, sums, solvers, key)
    named = F.get(F.array(*(F.lit(name) for name, _ in settings)), F.col("s"))
    return out.join(chosen.select(F.col("k").alias(key), "inner_emd"), key).select(key, "view", named.alias("setting"), "inner_emd", "cdf", "emd")


def view_transfer(observations: DataFrame, curves: DataFrame, key: str, view: str, views: tuple[str, str], solver: Solver, form: Form = POINT_FORM) -> DataFrame:
    """(key, train_view, query_view, direction, training_entities, query_rows, cdf, emd, fine_emd): trained on one view of all other paired entities, asked for both views of the one held out.

    Entities without both views or without a curve are left out; three paired ones are needed."""
    columns = feature_columns(observations)
    both = observations.where(F.col(view).isin(*views))
    means = both.groupBy(key, F.col(view).cast("string").alias("view")).agg(F.array(*(F.avg(F.col(c).cast("double")) for c in columns)).alias("q"), F.count("*").alias("query_rows"))
    paired = means.groupBy(key).agg(F.count("*").alias("n")).where("n = 2").select(key).join(curves.select(key), key, "left_semi")
    means = written(means.join(paired, key))
    known = written(curves.join(paired, key, "left_semi"))
    n = known.count()
    if n < 3:
        raise ValueError(f"{n} paired entities; 3 are needed")
    asked = means.select(F.col(key).cast("string").alias("k"), "view", "q", "query_rows")
    parts = []
    for v in views:
        of_view = both.where(F.col(view) == v).join(paired, key, "left_semi")
        got = leave_one_out(of_view, known, key, None, solver, form, columns, asked)
        parts.append(got.select(F.col(key).alias("k"), F.lit(v).alias("train_view"), F.col("view").alias("query_view"), "cdf", "emd"))
    truth = known.select(F.col(key).cast("string").alias("k"), F.col("cdf").alias("_t"))
    rows = parts[0].unionByName(parts[1]).join(asked.select("k", F.col("view").alias("query_view"), "query_rows"), ["k", "query_view"]).join(truth, "k")
    return rows.select(F.col("k").alias(key), "train_view", "query_view", F.concat_ws(" -> ", "train_view", "query_view").alias("direction"), F.lit(n - 1).alias("training_entities"), "query_rows", "cdf", "emd", C.partial_emd(F.col("_t"), F.col("cdf"), 4).alias("fine_emd"))


def transfer_pairs(transfer: DataFrame, key: str) -> DataFrame:
    """Each transfer with the control of its training view, and their differences; nulls show missing controls."""
    keys = [key, "train_view"]
    pick = lambda cond, s: transfer.where(cond).select(*keys, *([F.col("direction")] if s == "transfer" else []), F.col("emd").alias(f"{s}_emd"), F.col("fine_emd").alias(f"{s}_fine_emd"))
    out = pick("train_view <> query_view", "transfer").join(pick("train_view = query_view", "control"), keys, "full_outer")
    return out.withColumn("transfer_minus_control_emd", F.col("transfer_emd") - F.col("control_emd")).withColumn("transfer_minus_control_fine_emd", F.col("transfer_fine_emd") - F.col("control_fine_emd"))


def two_groups(observations: DataFrame, curves: DataFrame, key: str, view: str | None, first: int, share: float = 0.5, alpha: float = 10.0) -> DataFrame:
    """leave_one_out() of the blend of a ridge on the first features and one on the others, each with its own curve."""
    columns = feature_columns(observations)
    a, b = (leave_one_out(observations, curves, key, view, ridge(alpha), columns=c) for c in (columns[:first], columns[first:]))
    other = b.select(F.col(key).alias("_k"), F.col("view").alias("_v"), F.col("cdf").alias("_c"))
    both = a.join(other, (a[key] == F.col("_k")) & a["view"].eqNullSafe(F.col("_v")))
    blended = both.select(key, "view", F.zip_with("cdf", "_c", lambda x, y: share * x + (1 - share) * y).alias("cdf"))
    return blended.join(curves.select(F.col(key).cast("string").alias("_k"), F.col("cdf").alias("_t")), F.col(key) == F.col("_k")).select(key, "view", "cdf", C.emd(F.col("_t"), F.col("cdf")).alias("emd"))

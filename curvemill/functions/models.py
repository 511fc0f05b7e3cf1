"""Predictors of one shape: (training features, training curves, query features) -> query curves.

They are small dense solves for one fold, called from grouped tasks (operators.folds); they need NumPy alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .curves import LOG_SUPPORT, POINTS, SUPPORT, WIDTHS

Predictor = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]

# Fixed grids of the selectors.
RIDGE_ALPHAS = (10.0, 100.0, 1000.0)
KERNEL_GRID = tuple((a, s) for a in (0.1, 1.0, 10.0) for s in (0.1, 1.0))
SVR_C = (0.1, 1.0, 10.0)
NEIGHBORS = (1, 3, 5, 7)
PLS_PARTS = (1, 2, 4)


class Fold:
    """Checked and standardized arrays of one fold: population deviations, 1 where a training column is constant."""

    def __init__(self, x, y, q, flat: float = 0.0) -> None:
        x, y, q = (np.asarray(a, float) for a in (x, y, q))
        if x.ndim != 2 or q.ndim != 2 or not x.size or y.shape != (len(x), POINTS) or q.shape[1] != x.shape[1]:
            raise ValueError("need matching non-empty feature tables and one curve of 11 points a training row")
        if not all(np.isfinite(a).all() for a in (x, y, q)):
            raise ValueError("features and curves must be finite")
        mean, spread = x.mean(0), x.std(0)
        spread[spread <= flat] = 1.0
        self.x, self.q, self.y = (x - mean) / spread, (q - mean) / spread, y
        self.target = y[:, :-1]


def closed(raw: np.ndarray) -> np.ndarray:
    """Ten raw values a row as curves: clipped, made monotone, closed with 100."""
    return np.hstack([np.maximum.accumulate(np.clip(raw, 0, 100), axis=1), np.full((len(raw), 1), 100.0)])


def emd(truth: np.ndarray, predicted: np.ndarray) -> np.ndarray:
    """EMD of each row."""
    return np.abs(np.atleast_2d(truth)[:, :-1] - np.atleast_2d(predicted)[:, :-1]) @ np.array(WIDTHS)


def _ridge(x: np.ndarray, t: np.ndarray, q: np.ndarray, alpha: float) -> np.ndarray:
    """Ridge with a free intercept; the smaller of the primal and the dual system is solved."""
    center = t.mean(0)
    n, p = x.shape
    if p > n:
        beta = x.T @ np.linalg.solve(x @ x.T + alpha * np.eye(n), t - center)
    else:
        beta = np.linalg.solve(x.T @ x + alpha * np.eye(p), x.T @ (t - center))
    return q @ beta + center


def mean(x, y, q) -> np.ndarray:
    return np.repeat(closed(np.mean(y, 0, keepdims=True)[:, :-1]), len(q), 0)


def median(x, y, q) -> np.ndarray:
    return np.repeat(closed(np.median(y, 0, keepdims=True)[:, :-1]), len(q), 0)


def knn(x, y, q, k: int = 3) -> np.ndarray:
    """Mean curve of the k nearest rows in deviations of the training rows (constant columns: below 1e-12); ties by row order; fewer rows than k are all taken."""
    if isinstance(k, bool) or not isinstance(k, (int, np.integer)) or k < 1:
        raise ValueError("k must be a positive integer")
    x, y, q = (np.asarray(a, float) for a in (x, y, q))
    spread = x.std(0)
    spread[spread < 1e-12] = 1.0
    d = (((q[:, None] - x[None]) / spread) ** 2).sum(2)
    return y[np.argsort(d, 1, kind="stable")[:, :k]].mean(1)


def ridge(x, y, q, alpha: float = 10.0, components: int | None = None) -> np.ndarray:
    """Ridge on curves, after an unwhitened PCA of the training rows if components is given."""
    f = Fold(x, y, q)
    if not np.isfinite(alpha) or alpha <= 0:
        raise ValueError("alpha must be positive")
    a, b = f.x, f.q
    if components is not None:
        if isinstance(components, bool) or not 1 <= components <= min(a.shape[1], len(a) - 1):
            raise ValueError("components must lie between 1 and min(features, rows - 1)")
        basis = np.linalg.svd(a, full_matrices=False)[2][:components].T
        a, b = a @ basis, b @ basis
    return closed(_ridge(a, f.target, b, alpha))


def two_group_ridge(x, y, q, first: int, share: float = 0.5, alpha: float = 10.0) -> np.ndarray:
    """Blend of ridges on the first columns and on the others."""
    x, q = np.asarray(x, float), np.asarray(q, float)
    return share * ridge(x[:, :first], y, q[:, :first], alpha) + (1 - share) * ridge(x[:, first:], y, q[:, first:], alpha)


def photo_ridge(x, y, q, owner, alpha: float = 10.0) -> np.ndarray:
    """Ridge on observations: x has a row each, owner names its row of y; every entity weighs one and is standardized by entity means."""
    x, y, q, owner = np.asarray(x, float), np.asarray(y, float), np.asarray(q, float), np.asarray(owner)
    n = np.bincount(owner, minlength=len(y)).astype(float)
    if (n == 0).any():
        raise ValueError("every entity needs observations")
    means = np.stack([np.bincount(owner, c, len(y)) / n for c in x.T], 1)
    center, spread = means.mean(0), means.std(0)
    spread[spread == 0] = 1.0
    a, b, w = (x - center) / spread, (q - center) / spread, 1 / n[owner]
    base = y[:, :-1].mean(0)
    beta = np.linalg.solve(a.T @ (a * w[:, None]) + alpha * np.eye(a.shape[1]), a.T @ ((y[owner, :-1] - base) * w[:, None]))
    return closed(b @ beta + base)


def kernel_ridge(x, y, q, alpha: float = 1.0, gamma: float | None = None) -> np.ndarray:
    """Ridge in the space of a centred RBF kernel; gamma is 1 / features by default."""
    f = Fold(x, y, q)
    gamma = 1 / f.x.shape[1] if gamma is None else gamma
    if not (alpha > 0 and gamma > 0):
        raise ValueError("alpha and gamma must be positive")
    k = lambda a: np.exp(-gamma * np.maximum((a**2).sum(1)[:, None] + (f.x**2).sum(1) - 2 * a @ f.x.T, 0))
    train, query = k(f.x), k(f.q)
    column = train.mean(0)
    center = lambda m: m - m.mean(1, keepdims=True) - column + column.mean()
    base = f.target.mean(0)
    return closed(center(query) @ np.linalg.solve(center(train) + alpha * np.eye(len(train)), f.target - base) + base)


def _pair_steps(k: np.ndarray, t: np.ndarray, c: float, epsilon: float, tol: float, passes: int) -> tuple[np.ndarray, float]:
    """Coefficients and offset of the epsilon-insensitive dual: two bounded multipliers a row (above and below its tube), most violating pair first."""
    n = len(t)
    sign = np.repeat([1.0, -1.0], n)
    row = np.tile(np.arange(n), 2)
    a, slope = np.zeros(2 * n), np.concatenate([epsilon - t, epsilon + t])
    for _ in range(passes):
        rise = -sign * slope
        may_rise, may_fall = np.where(sign > 0, a < c, a > 0), np.where(sign > 0, a > 0, a < c)
        i, j = int(np.argmax(np.where(may_rise, rise, -np.inf))), int(np.argmin(np.where(may_fall, rise, np.inf)))
        if rise[i] - rise[j] < tol:
            both = (rise[i] + rise[j]) / 2
            return a[:n] - a[n:], float(both)
        p, q = row[i], row[j]
        step = (rise[i] - rise[j]) / max(k[p, p] + k[q, q] - 2 * k[p, q], 1e-12)
        step = min(step, c - a[i] if sign[i] > 0 else a[i], a[j] if sign[j] > 0 else c - a[j])
        a[i] += sign[i] * step
        a[j] -= sign[j] * step
        slope += sign * step * (k[row, p] - k[row, q])
    raise RuntimeError("no convergence")


def svr(x, y, q, c: float = 1.0, epsilon: float = 1.0, tol: float = 1e-3, passes: int = 1_000_000) -> np.ndarray:
    """Linear epsilon-insensitive regression of each point."""
    f = Fold(x, y, q)
    if not c > 0:
        raise ValueError("c must be positive")
    k = f.x @ f.x.T
    out = []
    for t in f.target.T:
        b, offset = _pair_steps(k, t, c, epsilon, tol, passes)
        out.append(f.q @ (f.x.T @ b) + offset)
    return closed(np.stack(out, 1))


def pls(x, y, q, components: int) -> np.ndarray:
    """Partial least squares on scaled features and raw points: the leading covariance direction, then deflation."""
    f = Fold(x, y, q)
    if isinstance(components, bool) or not 1 <= components <= min(f.x.shape[1], len(f.x) - 1):
        raise ValueError("components must lie between 1 and min(features, rows - 1)")
    base = f.target.mean(0)
    a, t = f.x.copy(), f.target - base
    directions, loads, answers = [], [], []
    for _ in range(components):
        w = np.linalg.svd(a.T @ t, full_matrices=False)[0][:, 0]
        s = a @ w
        if s @ s < 1e-20:
            break
        p, r = a.T @ s / (s @ s), t.T @ s / (s @ s)
        a, t = a - np.outer(s, p), t - np.outer(s, r)
        directions.append(w)
        loads.append(p)
        answers.append(r)
    if not directions:
        return closed(np.repeat(base[None], len(f.q), 0))
    w, p, r = (np.stack(v, 1) for v in (directions, loads, answers))
    return closed(f.q @ (w @ np.linalg.solve(p.T @ w, r.T)) + base)


def isotonic(values: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit by pooling adjacent violators."""
    level: list[list[float]] = []
    for v in values:
        level.append([float(v), 1.0])
        while len(level) > 1 and level[-2][0] > level[-1][0]:
            v2, n2 = level.pop()
            v1, n1 = level.pop()
            level.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, n in level])


def transport_ridge(x, y, q, alpha: float = 10.0, n: int = 1000) -> np.ndarray:
    """Ridge on n log-diameter quantiles, projected to non-decreasing ones within the support."""
    f = Fold(x, y, q)
    if (np.diff(f.y, axis=1) < 0).any() or (f.y[:, -1] != 100).any() or (f.y < 0).any():
        raise ValueError("curves must be strict")
    logs, share = np.array(LOG_SUPPORT), (np.arange(n) + 0.5) / (n / 100)
    quantiles = np.stack([logs[np.searchsorted(c, share)] for c in f.y])
    fit = np.stack([np.clip(isotonic(r), logs[0], logs[-1]) for r in _ridge(f.x, quantiles, f.q, alpha)]) if len(f.q) else np.empty((0, n))
    out = np.stack([np.searchsorted(r, logs + 1e-12, "right") for r in fit]) * (100 / n) if len(fit) else np.empty((0, POINTS))
    out[:, -1:] = 100.0
    return out


def sqrt_mass_ridge(x, y, q, alpha: float = 10.0) -> np.ndarray:
    """Ridge on square roots of bin masses; negative roots count as 0, rows without mass get the mean masses."""
    f = Fold(x, y, q)
    mass = np.diff(f.y, axis=1, prepend=0) / 100
    got = np.maximum(_ridge(f.x, np.sqrt(np.maximum(mass, 0)), f.q, alpha), 0) ** 2
    got[got.sum(1) == 0] = mass.mean(0)
    out = np.minimum(np.cumsum(got / got.sum(1, keepdims=True), 1) * 100, 100)
    out[:, -1:] = 100.0
    return out


def least_deviations(a: np.ndarray, t: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The b that makes sum(w * |t - a b|) least, for a of full column rank: exact descent along edges.

    A vertex is where as many rows as columns have no residual. One of these rows is let go while its multiplier is beyond its
    weight, and the weighted median along that edge takes its place. Targets are moved apart by tiny amounts, so that no vertex is met twice; the last
    vertex is solved for the true targets."""
    m, p = a.shape
    apart = t + 1e-9 * (1 + np.abs(t).max()) * np.random.default_rng(0).permutation(m) / m
    # a well-conditioned start: greedy rows by what is left of them after those before
    left, basis = a.astype(float).copy(), []
    for _ in range(p):
        k = int(np.argmax((left**2).sum(1)))
        basis.append(k)
        u = left[k] / np.linalg.norm(left[k])
        left -= np.outer(left @ u, u)
    basis = np.array(basis)
    inside = np.zeros(m, bool)
    for _ in range(100 * (m + p)):
        inside[:] = False
        inside[basis] = True
        inverse = np.linalg.inv(a[basis])
        r = apart - a @ (inverse @ apart[basis])
        multiplier = np.where(inside, 0.0, w * np.sign(r)) @ a @ inverse
        over = np.abs(multiplier) - w[basis]
        j = int(np.argmax(over))
        if over[j] <= 1e-12:
            return np.linalg.solve(a[basis], t[basis])
        slope = a @ inverse[:, j]  # how residuals of the others fall along the edge
        slope[inside] = 0.0
        slope[basis[j]] = 1.0
        move = np.flatnonzero(np.abs(slope) > 1e-12)
        steps = r[move] / slope[move]
        order = np.argsort(steps, kind="stable")
        weight = np.cumsum((w * np.abs(slope))[move][order])
        basis[j] = move[order[int(np.searchsorted(weight, weight[-1] / 2))]]
    raise RuntimeError("no convergence")


def median_regression(x, y, q, alpha: float = 0.01) -> np.ndarray:
    """Conditional median of each point as a share, with an absolute-value penalty on the weights: least absolute deviations with a row more for each weight."""
    f = Fold(x, y, q)
    n, p = f.x.shape
    a = np.vstack([np.hstack([np.ones((n, 1)), f.x]), np.hstack([np.zeros((p, 1)), np.eye(p)])])
    w = np.concatenate([np.full(n, 0.5 / n), np.full(p, max(alpha, 1e-7))])
    out = []
    for t in f.target.T / 100:
        b = np.r_[t[0], np.zeros(p)] if (t == t[0]).all() else least_deviations(a, np.concatenate([t, np.zeros(p)]), w)
        out.append(b[0] + f.q @ b[1:])
    return closed(np.stack(out, 1) * 100)


_WEIBULL_LOW, _WEIBULL_HIGH = np.log([1e-5, 0.05]), np.log([1e4, 20.0])


def weibull_curve(parameters: np.ndarray) -> np.ndarray:
    """Curves of (log scale, log shape) rows, kept within bounds."""
    p = np.clip(np.asarray(parameters, float), _WEIBULL_LOW, _WEIBULL_HIGH)
    power = np.clip(np.exp(p[..., 1:2]) * (np.log(SUPPORT) - p[..., 0:1]), -745, np.log(745))
    out = -100 * np.expm1(-np.exp(power))
    out[..., -1] = 100.0
    return out


def fit_weibull(curve: np.ndarray) -> np.ndarray:
    """(log scale, log shape) with the least width-weighted squared error, the best of damped Gauss-Newton runs from a grid of starts."""
    curve, w = np.asarray(curve, float), np.sqrt(WIDTHS)
    error = lambda p: w * (weibull_curve(p)[:-1] - curve[:-1])
    best, least = None, np.inf
    for scale in (0.002, 0.02, 0.2, 2.0, 20.0, 200.0):
        for shape in (0.25, 1.0, 4.0):
            p, damp = np.log([scale, shape]), 1e-2
            r = error(p)
            for _ in range(200):
                h = 1e-6
                jac = np.stack([(error(p + h * e) - error(p - h * e)) / (2 * h) for e in np.eye(2)], 1)
                normal = jac.T @ jac
                new = np.clip(p - np.linalg.solve(normal + damp * (np.diag(np.diag(normal)) + 1e-12 * np.eye(2)), jac.T @ r), _WEIBULL_LOW, _WEIBULL_HIGH)
                r_new = error(new)
                if r_new @ r_new < r @ r:
                    done = r @ r - r_new @ r_new < 1e-12 * (1 + r @ r)
                    p, r, damp = new, r_new, damp / 5
                    if done:
                        break
                elif (damp := damp * 4) > 1e12:
                    break
            if (cost := float(r @ r)) < least:
                best, least = p, cost
    return best


def weibull_ridge(x, y, q, alpha: float = 10.0) -> np.ndarray:
    """Ridge on the curves' Weibull parameters, decoded."""
    f = Fold(x, y, q)
    return weibull_curve(_ridge(f.x, np.stack([fit_weibull(c) for c in f.y]), f.q, alpha))


def ensemble_knn(k: int, groups: tuple[int, ...]) -> Predictor:
    """Equal blend of neighbours in consecutive groups of columns (crops), one count for all."""
    cuts = np.cumsum(groups)[:-1]
    return lambda x, y, q: np.mean([knn(a, y, b, k) for a, b in zip(np.split(np.asarray(x, float), cuts, 1), np.split(np.asarray(q, float), cuts, 1), strict=True)], 0)


def loo_error(x: np.ndarray, y: np.ndarray, predictor: Predictor) -> float:
    keep = ~np.eye(len(x), dtype=bool)
    return float(np.mean([emd(y[i], predictor(x[m], y[m], x[i : i + 1]))[0] for i, m in enumerate(keep)]))


#: Selectors: name -> (grid, predictor at a setting, tie key, least training rows).
SELECTORS: dict[str, tuple] = {
    "ridge": (RIDGE_ALPHAS, lambda a: lambda x, y, q: ridge(x, y, q, a), lambda a: -a, 2),
    "kernel": (KERNEL_GRID, lambda s: lambda x, y, q: kernel_ridge(x, y, q, s[0], s[1] / np.shape(x)[1]), lambda s: (-s[0], s[1]), 2),
    "svr": (SVR_C, lambda c: lambda x, y, q: svr(x, y, q, c), lambda c: c, 2),
    "neighbors": (NEIGHBORS, lambda k: lambda x, y, q: knn(x, y, q, k), lambda k: -k, 8),
    "pls": (PLS_PARTS, lambda n: lambda x, y, q: pls(x, y, q, n), lambda n: n, 6),
}


def select(name: str, x: np.ndarray, y: np.ndarray) -> tuple[object, dict]:
    """The setting with the least leave-one-out error inside the training rows, and all errors; ties by the selector's rule."""
    grid, at, tie, least = SELECTORS[name]
    if len(x) < least:
        raise ValueError(f"{name} selection needs {least} training rows")
    scores = {s: loo_error(x, y, at(s)) for s in grid}
    return min(scores, key=lambda s: (scores[s], tie(s))), scores

"""Predictors on known values, invariances and tie rules."""

import numpy as np
import pytest

from curvemill.functions import images, models as M
from curvemill.functions.curves import LOG_SUPPORT


def data(n=14, p=3, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, p))
    y = np.sort(r.uniform(0, 100, (n, 11)), 1)
    y[:, -1] = 100
    return x, y, r.normal(size=(4, p))


def flat(values):
    return np.column_stack([np.repeat(np.array(values, float)[:, None], 10, 1), np.full(len(values), 100.0)])


def test_ridge_shrinks():
    got = M.ridge(np.array([[-1.0], [0], [1]]), flat([20, 50, 80]), np.array([[1.0]]), alpha=10)
    assert got[0, :10] == pytest.approx(56.92307692307692) and got[0, 10] == 100


ALL = {
    "mean": M.mean, "median": M.median, "knn": M.knn, "ridge": M.ridge, "pca": lambda x, y, q: M.ridge(x, y, q, components=2), "kernel": M.kernel_ridge, "svr": M.svr,
    "pls": lambda x, y, q: M.pls(x, y, q, 2), "transport": M.transport_ridge, "mass": M.sqrt_mass_ridge, "quantile": M.median_regression, "weibull": M.weibull_ridge, "two": lambda x, y, q: M.two_group_ridge(x, y, q, 1),
}


@pytest.mark.parametrize("name", ALL)
def test_curves_come_out_and_queries_do_not_mix(name):
    x, y, q = data()
    got = ALL[name](x, y, q)
    assert got.shape == (4, 11) and (np.diff(got, axis=1) >= -1e-9).all() and (got >= 0).all() and (got[:, -1] == 100).all()
    assert ALL[name](x, y, q[2:3])[0] == pytest.approx(got[2], abs=1e-6)
    assert ALL[name](x * 7 + 3, y, q * 7 + 3) == pytest.approx(got, abs=0.05)


def test_dual_and_primal_agree():
    x, y, q = data(6, 9)
    wide = M.ridge(x, y, q)
    s = x.std(0)
    a, b, t = (x - x.mean(0)) / s, (q - x.mean(0)) / s, y[:, :10]
    beta = np.linalg.solve(a.T @ a + 10 * np.eye(9), a.T @ (t - t.mean(0)))
    assert wide == pytest.approx(M.closed(b @ beta + t.mean(0)))


def test_knn_ties_and_short_training():
    y = flat([0, 30, 60])
    assert M.knn(np.array([[1.0], [1], [1]]), y, np.array([[1.0]]), 1)[0, 0] == 0
    assert M.knn(np.array([[0.0], [5]]), y[:2], np.array([[1.0]]), 7)[0, 0] == 15
    with pytest.raises(ValueError):
        M.knn(y, y, y, True)


def test_photo_ridge_weighs_entities():
    x, y, q = data(5, 2)
    owner = np.array([0, 1, 2, 3, 4])
    once = M.photo_ridge(x, y, q, owner)
    assert once == pytest.approx(M.ridge(x, y, q))
    twice = M.photo_ridge(np.vstack([x, x[:1], x[:1]]), y, q, np.append(owner, [0, 0]))
    assert twice == pytest.approx(once)


def test_svr_and_median_regression_meet_their_conditions():
    x, y, _ = data(20, 2, 3)
    f = M.Fold(x, y, x)
    t = f.target[:, 4]
    b, offset = M._pair_steps(f.x @ f.x.T, t, 10.0, 1.0, 1e-6, 10**6)
    assert abs(b.sum()) < 1e-6 and (np.abs(b) <= 10 + 1e-9).all()
    off = t - f.x @ (f.x.T @ b) - offset
    inside = np.abs(off) < 1 - 1e-3
    assert np.abs(b[inside]).max(initial=0) < 1e-6
    line = np.array([[0.0], [1], [2], [3], [4]])
    got = M.median_regression(line, flat([10, 20, 30, 40, 90]), line, alpha=0.0)
    assert got[:4, 0] == pytest.approx([10, 20, 30, 40], abs=1e-3)


def test_least_deviations_is_the_best_vertex():
    import itertools

    for seed in range(40):
        r = np.random.default_rng(seed)
        m, p = int(r.integers(3, 9)), int(r.integers(1, 3))
        a, t, w = r.integers(-3, 4, (m, p)).astype(float), r.integers(-4, 5, m).astype(float), r.integers(1, 4, m).astype(float)
        if np.linalg.matrix_rank(a) < p:
            continue
        cost = lambda b: (w * np.abs(t - a @ b)).sum()  # noqa: E731, B023
        vertices = [np.linalg.solve(a[list(c)], t[list(c)]) for c in itertools.combinations(range(m), p) if abs(np.linalg.det(a[list(c)])) > 1e-9]
        assert cost(M.least_deviations(a, t, w)) == pytest.approx(min(map(cost, vertices)), abs=1e-7), seed


def test_median_regression_known_answers():
    const = np.full((3, 2), 5.0)
    assert M.median_regression(const, flat([10, 20, 90]), np.array([[5.0, 5], [100, -100]])) == pytest.approx(flat([20, 20]))
    assert M.median_regression(np.array([[-2.0], [2]]), flat([20, 80]), np.array([[-1.0], [1]])) == pytest.approx(flat([35, 65]))
    x, y, q = data(60, 6, 5)
    assert np.isfinite(M.median_regression(x, np.round(y), q)).all()


def test_isotonic():
    assert M.isotonic(np.array([1.0, 3, 2, 2, 5, 4])).tolist() == pytest.approx([1, 7 / 3, 7 / 3, 7 / 3, 4.5, 4.5])


def test_selection_ties_and_sizes():
    x, y = np.ones((9, 4)), flat([50] * 9)
    assert M.select("ridge", x, y)[0] == 1000 and M.select("neighbors", x, y)[0] == 7 and M.select("pls", x + np.eye(9, 4), y)[0] == 1
    assert M.select("kernel", x, y)[0] == (10.0, 0.1) and M.select("svr", x, y)[0] == 0.1
    with pytest.raises(ValueError):
        M.select("neighbors", x[:7], y[:7])


def test_bad_input_is_refused():
    x, y, q = data()
    for bad in ((x[:0], y[:0], q), (x, y[:, :10], q), (x, y, q[:, :1]), (np.where(x == x[0, 0], np.nan, x), y, q)):
        with pytest.raises(ValueError):
            M.ridge(*bad)
    with pytest.raises(ValueError):
        M.ridge(x, y, q, alpha=0)
    with pytest.raises(ValueError):
        M.transport_ridge(x, y[:, ::-1], q)
    assert M.emd(y[0], y[0])[0] == 0 and LOG_SUPPORT[0] < LOG_SUPPORT[-1]


def test_image_features():
    r = np.random.default_rng(1)
    image = r.random((64, 64, 3))
    gray = image.mean(2)
    assert images.color_texture(image).shape == (13,) and images.color_texture(image, "gray").shape == (7,)
    assert images.texture(gray) == pytest.approx(images.texture(gray * 0.5 + 0.1))
    assert images.spectrum(gray).sum() == pytest.approx(1) and not images.spectrum(np.full((64, 64), 0.3)).any()
    wave = np.sin(np.arange(64) * 2 * np.pi / 64 * 8)[None].repeat(64, 0)
    assert images.spectrum(wave, bands=((10, 14), (20, 40)))[0] > 0.99
    assert images.granulometry(gray, (3, 5)).reshape(2, 2).sum(1) == pytest.approx([1, 1])
    assert images.local_patterns(gray, (2.0,)).sum() == pytest.approx(1) and images.local_patterns(np.zeros((64, 64)), (2.0,))[8] == 1
    assert images.patch_spread(np.full((256, 256, 3), 0.5)).tolist() == [0] * 6
    # each against its definition
    windows = np.lib.stride_tricks.sliding_window_view
    big = lambda g, s, f: f(windows(g, (s, s)), (2, 3))
    for s in (3, 5):
        padded = np.pad(gray, s - 1, mode="reflect")
        assert images._extreme(images._extreme(padded, s, np.minimum), s, np.maximum) == pytest.approx(big(big(padded, s, np.min), s, np.max))
        assert 1 - images._extreme(images._extreme(1 - padded, s, np.minimum), s, np.maximum) == pytest.approx(big(big(padded, s, np.max), s, np.min))
    assert images._uniform_patterns()[[0, 0b1, 0b111, 0b101, 255, 0b10000001]].tolist() == [0, 1, 3, 9, 8, 2]
    turn = np.arange(8) * np.pi / 4
    counts = np.zeros(10)
    for yy in range(2, 62):
        for xx in range(2, 62):
            up = []
            for dy, dx in zip(1.28 * np.sin(turn), 1.28 * np.cos(turn), strict=True):
                y0, x0 = int(np.floor(yy + dy)), int(np.floor(xx + dx))
                fy, fx = yy + dy - y0, xx + dx - x0
                up.append(gray[y0, x0] * (1 - fy) * (1 - fx) + gray[y0, x0 + 1] * (1 - fy) * fx + gray[y0 + 1, x0] * fy * (1 - fx) + gray[y0 + 1, x0 + 1] * fy * fx >= gray[yy, xx] - 1e-12)
            counts[sum(up) if sum(up[k] != up[k - 1] for k in range(8)) <= 2 else 9] += 1
    assert images.local_patterns(gray, (2.0,)) == pytest.approx(counts / counts.sum(), abs=1e-3)
    k = np.fft.fftfreq(64, 100 / 64)
    taper = np.outer(np.hanning(64), np.hanning(64))
    whole = np.abs(np.fft.fft2((gray - np.average(gray, weights=taper)) * taper)) ** 2
    far = np.hypot(*np.meshgrid(k, k))
    want = [whole[(far * b >= 1 - 1e-12) & (far * a < 1 - 1e-12)].sum() for a, b in images.BANDS_MM]
    assert images.spectrum(gray) == pytest.approx(np.array(want) / sum(want), rel=1e-6)
    assert images.stretched(np.arange(101.0).reshape(1, 101))[0, [0, 5, 50, 95, 100]].tolist() == pytest.approx([0, 0, 0.5, 1, 1])
    assert images.native(r.random((460, 460, 3))).shape == (23,)
    assert images.crop_box(2000, 1000, 100, 4.05, (4000, 2000)) == (899, 399, 202)
    with pytest.raises(ValueError):
        images.crop_box(100, 100, 100, 4, (100, 100))


def photo_ridge(x, own, curves, query, alpha=10.0):
    """Ridge on observations as it is defined: scaled by the entities' means, each entity's observations weighing one together."""
    means = np.stack([x[own == k].mean(0) for k in range(len(curves))])
    scale = means.std(0)
    scale[scale == 0] = 1
    z, w = (x - means.mean(0)) / scale, 1 / np.bincount(own)[own]
    y = curves[own, :10] - curves[:, :10].mean(0)
    beta = np.linalg.solve(z.T @ (w[:, None] * z) + alpha * np.eye(x.shape[1]), z.T @ (w[:, None] * y))
    out = ((query - means.mean(0)) / scale) @ beta + curves[:, :10].mean(0)
    return np.column_stack([np.maximum.accumulate(np.clip(out, 0, 100), 1), np.full(len(out), 100.0)])


def test_ridge_on_observations(spark, monkeypatch):
    from curvemill.operators import gram as G

    monkeypatch.setattr(G, "HELD", 3)
    r = np.random.default_rng(11)
    own = np.concatenate([np.repeat(np.arange(8), r.integers(1, 9, 8)), np.zeros(60, int)])  # one entity holds most rows
    x = np.column_stack([r.normal(size=(len(own), 3)) + own[:, None] / 3, np.full(len(own), 2.0), (own == 5).astype(float)])
    curves = np.column_stack([np.sort(r.random((8, 10)) * 100, 1), np.full(8, 100.0)])
    columns = [f"f{i}" for i in range(5)]
    seen = spark.createDataFrame([(f"e{k}", *map(float, v)) for k, v in zip(own, x)], "k string, " + ", ".join(f"{c} double" for c in columns)).repartition(5)
    known = spark.createDataFrame([(f"e{k}", list(map(float, c))) for k, c in enumerate(curves)], "k string, cdf array<double>")
    queries = r.normal(size=(4, 5))
    got = G.entity_ridge(seen, known, spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(queries)], "id int, " + ", ".join(f"{c} double" for c in columns)), "k", columns)
    assert np.allclose([r["cdf"] for r in got.orderBy("id").collect()], photo_ridge(x, own, curves, queries))
    means = np.stack([x[own == k].mean(0) for k in range(8)])
    for row in G.loo_entity_ridge(seen, known, "k", columns).collect():
        k = int(row["k"][1:])
        rest = own != k
        want = photo_ridge(x[rest], own[rest] - (own[rest] > k), np.delete(curves, k, 0), means[k : k + 1])[0]
        assert np.allclose(row["cdf"], want, atol=1e-7)
    flagged = seen.selectExpr("*", "case when f0 > 1 then 'high' when f0 > -0.5 then 'low' end as view")
    views = {(row["k"], row["view"]): row["cdf"] for row in G.loo_entity_ridge(flagged, known, "k", columns, view="view").collect()}
    flags = np.where(x[:, 0] > 1, "high", np.where(x[:, 0] > -0.5, "low", ""))
    assert len(views) == 8 + len({(k, f) for k, f in zip(own, flags) if f})
    for (k, flag), cdf in views.items():
        k = int(k[1:])
        mine = x[(own == k) & ((flags == flag) if flag else True)].mean(0, keepdims=True)
        rest = own != k
        assert np.allclose(cdf, photo_ridge(x[rest], own[rest] - (own[rest] > k), np.delete(curves, k, 0), mine)[0], atol=1e-7)
    with pytest.raises(ValueError):
        G.loo_entity_ridge(seen.where("k = 'e1'"), known, "k", columns)


@pytest.mark.parametrize("name", ["ridge", "pca", "pls", "quantiles", "roots", "weibull", "groups"])
def test_leave_one_out_from_sums(spark, name):
    """Predictors from sums of products against the same ones fitted on each fold's rows."""
    from curvemill.operators import linear as L

    r = np.random.default_rng(12)
    n, p = 9, 4
    owners = np.concatenate([np.repeat(np.arange(n), 3), [2] * 20])
    x = r.normal(size=(len(owners), p)) * [1, 50, 0.01, 1] + owners[:, None] * [0.3, 4, 0.001, -0.2] + [0, 1000, 0, 5]
    x[:, 3] = np.where(owners == 4, 1.0, 2.0)  # constant without one entity
    curves = np.column_stack([np.sort(r.random((n, 10)) * 100, 1), np.full(n, 100.0)])
    flags = np.where(np.arange(len(owners)) % 2 == 0, "a", "b")
    seen = spark.createDataFrame([(f"e{k}", f, *map(float, v)) for k, f, v in zip(owners, flags, x)], "k string, view string, " + ", ".join(f"feature_{i} double" for i in range(p))).repartition(4)
    known = spark.createDataFrame([(f"e{k}", list(map(float, c))) for k, c in enumerate(curves)], "k string, cdf array<double>")
    forms = {"ridge": (L.ridge(),), "pca": (L.ridge(3.0, 2),), "pls": (L.partial_least_squares(2),), "quantiles": (L.ridge(), L.QUANTILE_FORM), "roots": (L.ridge(), L.ROOT_FORM), "weibull": (L.ridge(), L.WEIBULL_FORM)}
    out = L.two_groups(seen, known, "k", "view", 2) if name == "groups" else L.leave_one_out(seen, known, "k", "view", *forms[name])
    plain = {"ridge": M.ridge, "pca": lambda x, y, q: M.ridge(x, y, q, 3.0, 2), "pls": lambda x, y, q: M.pls(x, y, q, 2), "quantiles": M.transport_ridge, "roots": M.sqrt_mass_ridge, "weibull": M.weibull_ridge, "groups": lambda x, y, q: M.two_group_ridge(x, y, q, 2)}[name]
    means = np.stack([x[owners == k].mean(0) for k in range(n)])
    got = {(row["k"], row["view"]): (row["cdf"], row["emd"]) for row in out.collect()}
    assert len(got) == 3 * n
    for (k, view), (cdf, emd) in got.items():
        k, keep = int(k[1:]), np.arange(n) != int(k[1:])
        query = x[(owners == k) & ((flags == view) if view else True)].mean(0, keepdims=True)
        want = plain(means[keep], curves[keep], query)[0]
        assert np.allclose(cdf, want, atol=1e-6) or name == "quantiles" and np.abs(np.array(cdf) - want).max() <= 0.1 + 1e-9
        assert abs(emd - M.emd(curves[k], np.array(cdf))[0]) < 1e-9
    with pytest.raises(ValueError):
        L.leave_one_out(seen.where("k = 'e1'"), known.where("k = 'e1'"), "k", "view", L.ridge())


def test_view_transfer_from_sums(spark):
    """Against the transfer that fits each fold's rows."""
    from curvemill.operators import folds, linear as L

    r = np.random.default_rng(13)
    rows = [(f"e{k}", v, *map(float, r.normal(size=3) + k / 2)) for k in range(7) for v in ("A", "B", "C") for _ in range(r.integers(1, 4)) if (k, v) != (6, "B")]
    seen = spark.createDataFrame(rows, "k string, view string, feature_0 double, feature_1 double, feature_2 double")
    known = spark.createDataFrame([(f"e{k}", sorted(map(float, r.random(10) * 100)) + [100.0]) for k in range(7)], "k string, cdf array<double>")
    got = L.view_transfer(seen, known, "k", "view", ("A", "B"), L.ridge())
    want = folds.view_transfer(seen, known, "k", "view", ("A", "B"), M.ridge)
    show = lambda df: sorted((x["k"], x["direction"], x["query_rows"], round(x["emd"], 6), round(x["fine_emd"], 6)) for x in df.collect())
    assert show(got) == show(want) and len(show(got)) == 6 * 4 and {x["training_entities"] for x in got.collect()} == {5}
    pairs = lambda df: sorted((x["k"], x["direction"], round(x["transfer_minus_control_emd"], 6)) for x in L.transfer_pairs(df, "k").collect())
    assert pairs(got) == pairs(want)
    with pytest.raises(ValueError):
        L.view_transfer(seen.where("k < 'e2'"), known, "k", "view", ("A", "B"), L.ridge())


@pytest.mark.parametrize("name", ["ridge", "pls"])
def test_nested_selection_from_sums(spark, monkeypatch, name):
    """The setting and prediction of each fold against a selection on the fold's own rows, in several blocks."""
    from curvemill.operators import linear as L

    monkeypatch.setattr(L, "BLOCK", 3)
    r = np.random.default_rng(14)
    n, p = 8, 4
    x = r.normal(size=(n, p)) + np.arange(n)[:, None] / 4
    curves = np.column_stack([np.sort(np.clip(30 + 9 * x[:, :1] + r.normal(0, 12, (n, 10)), 0, 100), 1), np.full(n, 100.0)])
    seen = spark.createDataFrame([(f"e{k}", *map(float, v)) for k, v in enumerate(x)], "k string, " + ", ".join(f"feature_{i} double" for i in range(p)))
    known = spark.createDataFrame([(f"e{k}", list(map(float, c))) for k, c in enumerate(curves)], "k string, cdf array<double>")
    settings = [(repr(a), L.ridge(a)) for a in (1000.0, 100.0, 10.0)] if name == "ridge" else [(str(m), L.partial_least_squares(m)) for m in (1, 2, 4)]
    out = L.nested(seen, known, "k", None, settings, 2 if name == "ridge" else 6).collect()
    assert len(out) == n
    for row in out:
        k = int(row["k"][1:])
        keep = np.arange(n) != k
        best, scores = M.select(name, x[keep], curves[keep])
        assert row["setting"] == (repr(best) if name == "ridge" else str(best)) and abs(row["inner_emd"] - scores[best]) < 1e-8
        assert np.allclose(row["cdf"], M.SELECTORS[name][1](best)(x[keep], curves[keep], x[k : k + 1])[0], atol=1e-7)
    with pytest.raises(ValueError):
        L.nested(seen, known, "k", None, settings, 9)

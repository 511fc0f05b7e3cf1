"""Regions of unlabelled images against plain array code."""

import itertools
import math

import numpy as np
import pytest

from curvemill.operators import particles as P


def frame(spark, images, name="value", kind="double"):
    rows = [(i, y, x, v.item()) for i, a in images.items() for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, f"image string, y int, x int, {name} {kind}")


def arrays(df, name, shapes):
    out = {i: np.zeros(s) for i, s in shapes.items()}
    n = 0
    for r in df.collect():
        out[r["image"]][r["y"], r["x"]] = r[name]
        n += 1
    assert n == sum(a * b for a, b in shapes.values())
    return out


def along(a, weights, axis):
    r = len(weights) // 2
    b = np.moveaxis(a, axis, 0)
    n = len(b)
    mirror = lambda i: min(i % (2 * n), 2 * n - 1 - i % (2 * n))
    return np.moveaxis(np.stack([sum(w * b[mirror(t + k - r)] for k, w in enumerate(weights)) for t in range(n)]), 0, axis)


def slope(a, sigma):
    r = int(4 * sigma + 0.5)
    bell = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    bell /= bell.sum()
    rise = bell * np.arange(-r, r + 1) / sigma**2
    return np.hypot(along(along(a, rise, 0), bell, 1), along(along(a, bell, 0), rise, 1))


@pytest.mark.parametrize("sigma", [0.5, 1.3, 6.0])
def test_gradient(spark, sigma):
    r = np.random.default_rng(1)
    images = {"a": r.random((9, 13)), "b": r.random((5, 4)), "one": r.random((1, 1))}
    got = arrays(P.gradient(frame(spark, images), sigma), "gradient", {k: v.shape for k, v in images.items()})
    for k, v in images.items():
        assert np.allclose(got[k], slope(v, sigma), atol=1e-12)


def opening(a, radius):
    k = range(-math.ceil(radius), math.ceil(radius) + 1)
    disk = [(y, x) for y in k for x in k if y * y + x * x <= radius**2]
    at = lambda b, y, x: 0 <= y < b.shape[0] and 0 <= x < b.shape[1] and b[y, x]
    small = np.array([[all(at(a, y + i, x + j) for i, j in disk) for x in range(a.shape[1])] for y in range(a.shape[0])])
    return np.array([[any(at(small, y + i, x + j) for i, j in disk) for x in range(a.shape[1])] for y in range(a.shape[0])])


@pytest.mark.parametrize("radius", [0.4, 1.0, 1.5, 2.9])
def test_opening(spark, radius):
    r = np.random.default_rng(2)
    images = {"a": r.random((12, 15)) < 0.85, "b": r.random((7, 9)) < 0.97, "full": np.ones((6, 6), bool), "none": np.zeros((3, 3), bool)}
    got = arrays(P.opened(frame(spark, images, "inner", "boolean"), radius), "inner", {k: v.shape for k, v in images.items()})
    for k, v in images.items():
        assert (got[k] == opening(v, radius)).all()


def connected(a):
    out, n = np.zeros(a.shape, int), 0
    for at in np.ndindex(a.shape):
        if a[at] and not out[at]:
            n += 1
            todo = [at]
            while todo:
                y, x = todo.pop()
                if 0 <= y < a.shape[0] and 0 <= x < a.shape[1] and a[y, x] and not out[y, x]:
                    out[y, x] = n
                    todo += itertools.product((y - 1, y, y + 1), (x - 1, x, x + 1))
    return out


def test_seeds(spark):
    r = np.random.default_rng(3)
    images = {"a": r.random((10, 12)) < 0.4, "b": r.random((6, 6)) < 0.3, "none": np.zeros((2, 2), bool), "snake": np.array([[1, 1, 1, 1, 1], [0, 0, 0, 0, 1], [1, 1, 1, 1, 1], [1, 0, 0, 0, 0], [1, 1, 1, 1, 1]], bool)}
    got = arrays(P.seeds(frame(spark, images, "inner", "boolean")), "seed", {k: v.shape for k, v in images.items()})
    for k, v in images.items():
        assert (got[k] == connected(v)).all()


def kruskal(heights, seeds):
    h, w = heights.shape
    arcs = sorted((abs(int(heights[y, x]) - int(heights[y + i, x + j])), (y, x), (y + i, x + j)) for y in range(h) for x in range(w) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1)) if y + i < h and 0 <= x + j < w)
    part = {at: (int(seeds[at]), at) if seeds[at] else (0, at) for at in np.ndindex(h, w)}
    part = {at: (p[0], "seed") if p[0] else p for at, p in part.items()}
    for _, a, b in arcs:
        p, q = part[a], part[b]
        if p != q and not (p[0] and q[0]):
            new = max(p, q, key=lambda v: v[0])
            part = {at: new if v in (p, q) else v for at, v in part.items()}
    return np.array([[part[y, x][0] for x in range(w)] for y in range(h)])


def test_flooding(spark):
    r = np.random.default_rng(4)
    shapes = {"a": (10, 11), "b": (7, 5), "flat": (6, 6), "none": (3, 3), "line": (1, 9)}
    heights = {k: r.integers(0, 4 if k == "b" else 1 if k == "flat" else 1000, s) for k, s in shapes.items()}
    seeds = {k: np.where(r.random(s) < 0.06, r.integers(1, 4, s), 0) for k, s in shapes.items()}
    seeds["none"][:] = 0
    seeds["flat"][0, 0], seeds["flat"][5, 5] = 1, 2
    df = frame(spark, heights, "elevation", "int").join(frame(spark, seeds, "seed", "int"), ["image", "y", "x"])
    got = arrays(P.flooded(df), "label", shapes)
    for k in shapes:
        assert (got[k] == kruskal(heights[k], seeds[k])).all(), k


def test_whole_images(spark):
    y, x = np.mgrid[0:14, 0:16]
    grains = np.where(((y - 4) ** 2 + (x - 4) ** 2 < 10) | ((y - 9) ** 2 + (x - 11) ** 2 < 12), 0.9, 0.2) + np.random.default_rng(5).random((14, 16)) * 0.01
    images = {"grains": grains, "flat": np.full((5, 5), 0.5)}
    got = arrays(P.particle_regions(frame(spark, images), 2.0), "label", {k: v.shape for k, v in images.items()})
    g = slope(grains, 0.5)
    seeds = connected(opening(g <= np.quantile(g, 0.25), 1.0))
    want = kruskal(np.rint(g / g.max() * 65535).astype(int), seeds)
    assert seeds.max() > 0 and (got["grains"] == want).all() and (got["flat"] == 0).all()
    with pytest.raises(ValueError):
        P.particle_regions(frame(spark, images), 0.0)

"""Image features from pixel tables against the same features from arrays."""

import numpy as np
import pytest

from curvemill.functions import images as I
from curvemill.operators import pixels as P


def colour(spark, images):
    rows = [(k, y, x, *map(float, a[y, x])) for k, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image string, y int, x int, r double, g double, b double").repartition(5)


def same(df, images, extract):
    got = {r["image"]: np.array(r["features"]) for r in df.collect()}
    assert got.keys() == images.keys()
    for k, a in images.items():
        assert np.allclose(got[k], extract(a), atol=1e-9), k


@pytest.fixture(scope="module")
def images():
    r = np.random.default_rng(7)
    y, x = np.mgrid[0:24, 0:24]
    waves = np.stack([0.5 + 0.4 * np.sin(x / 2 + y / 5), 0.5 + 0.3 * np.cos(y / 3), (x + y) / 48], 2)
    return {"noise": r.random((32, 32, 3)), "waves": waves, "flat": np.full((20, 20, 3), 0.25), "dots": (r.random((28, 28, 3)) < 0.2).astype(float)}


@pytest.mark.parametrize("mode", ["rgb", "gray", "normalized_gray"])
def test_color_texture(spark, images, mode):
    same(P.color_texture(colour(spark, images), mode), images, lambda a: I.color_texture(a, mode))


def test_sides_that_differ(spark):
    r = np.random.default_rng(8)
    images = {"wide": r.random((18, 30, 3)), "tall": r.random((40, 17, 3))}
    same(P.color_texture(colour(spark, images)), images, lambda a: I.color_texture(a))


def test_spatial(spark, images):
    boxes = [(0, 0, 10, 10), (2, 3, 20, 20), (0, 1, 19, 18)]
    lags = (1, 4)
    import unittest.mock as m

    with m.patch.object(P, "LAGS", lags):
        df = P.spatial(colour(spark, images), boxes)
    same(df, images, lambda a: np.mean([I.color_texture(a[t:b, l:r], "gray", lags) for t, l, b, r in boxes], 0))


def test_texture(spark, images):
    same(P.texture(colour(spark, images), 20.0), images, lambda a: I.texture(a, 20.0))


def test_patch_spread(spark):
    r = np.random.default_rng(9)
    images = {"a": r.random((72, 80, 3)), "b": r.random((68, 68, 3))}
    same(P.patch_spread(colour(spark, images)), images, I.patch_spread)


def test_granulometry(spark, images):
    sizes = (3, 5, 9)
    same(P.granulometry(colour(spark, images), sizes), images, lambda a: I.granulometry(a, sizes))


def test_spectrum(spark, images):
    same(P.spectrum(colour(spark, images), mm=40.0), images, lambda a: I.spectrum(a, mm=40.0))
    odd = {"odd": np.random.default_rng(1).random((21, 21, 3))}
    same(P.spectrum(colour(spark, odd), mm=40.0), odd, lambda a: I.spectrum(a, mm=40.0))


def test_native(spark):
    r = np.random.default_rng(10)
    images = {"a": r.random((192, 192, 3))}
    same(P.native(colour(spark, images)), images, I.native)


def test_local_patterns(spark, images):
    same(P.local_patterns(colour(spark, images), (1.0, 3.5, 12.5), 100.0), images, lambda a: I.local_patterns(a, (1.0, 3.5, 12.5), 100.0))


def test_no_images(spark, images):
    none = colour(spark, images).limit(0)
    assert P.color_texture(none).collect() == [] and P.spectrum(none).collect() == [] and P.local_patterns(none).collect() == []

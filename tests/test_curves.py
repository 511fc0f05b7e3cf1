"""Curve algebra on known cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvemill.functions import curves as C, models as M, text

CURVE = [2.0, 5.0, 11.0, 20.0, 35.0, 50.0, 70.0, 85.0, 95.0, 99.0, 100.0]


def one(spark, value, **columns):
    names = list(columns)
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} array<double>" for n in names)).select(value).first()[0]


def test_emd_ends(spark):
    zero, full = [0.0] * 11, [100.0] * 11
    e = C.emd(F.col("a"), F.col("b"))
    assert one(spark, e, a=CURVE, b=CURVE) == 0
    assert one(spark, e, a=zero, b=full) == pytest.approx(500)
    last = [*CURVE[:10], 50.0]
    assert one(spark, e, a=CURVE, b=last) == 0
    parts = one(spark, C.emd_contributions(F.col("a"), F.col("b")), a=zero, b=CURVE)
    for k in (4, 5):
        assert one(spark, C.partial_emd(F.col("a"), F.col("b"), k), a=zero, b=CURVE) == pytest.approx(sum(parts[:k]))


def test_masses_and_back(spark):
    m = one(spark, C.masses(F.col("a")), a=CURVE)
    assert m[:2] == [2, 3] and sum(m) == pytest.approx(100)
    assert one(spark, C.from_masses(F.col("a")), a=m) == pytest.approx(CURVE)


def test_quantiles_and_back(spark):
    q = one(spark, C.log_quantiles(F.col("a")), a=CURVE)
    logs, p = np.array(C.LOG_SUPPORT), (np.arange(1000) + 0.5) / 10
    assert q == pytest.approx(logs[np.searchsorted(CURVE, p)].tolist())
    assert one(spark, C.from_log_quantiles(F.col("a")), a=q) == pytest.approx(CURVE)


def test_repair_clips_before_the_running_maximum(spark):
    raw = [-5.0, 3.0, 2.0, 120.0, 50.0, 60.0, 70.0, 80.0, 90.0, 95.0]
    assert one(spark, C.repair(F.col("a")), a=raw) == [0, 3, 3, *[100] * 8]
    assert M.closed(np.array([raw]))[0].tolist() == [0, 3, 3, *[100] * 8]


@pytest.mark.parametrize(
    "change, lenient, strict",
    [({}, True, True), ({10: 99.9995}, True, False), ({10: 99.99}, False, False), ({3: 10.9999999999}, True, False), ({3: 10.0}, False, False), ({0: -1e-12}, False, False), ({0: float("nan")}, False, False), ({0: None}, False, False)],
)
def test_validity(spark, change, lenient, strict):
    a = [change.get(i, v) for i, v in enumerate(CURVE)]
    assert one(spark, C.is_curve(F.col("a")), a=a) is lenient
    assert one(spark, C.is_strict_curve(F.col("a")), a=a) is strict


def test_wide_keeps_the_template_spelling(spark):
    labels = ["0.002", "0.0063", "0.02", "0.063", "0.2", "0.63", "2", "6.3", "20", "63", "200"]
    df = spark.createDataFrame([("s", *CURVE)], "sample_id string, " + ", ".join(f"`{x}` double" for x in labels))
    back = C.to_wide(C.from_wide(df), labels)
    assert back.columns == df.columns and tuple(back.first()) == ("s", *CURVE)
    with pytest.raises(ValueError, match="200"):
        C.support_columns(labels[:-1])


def test_blends_and_weibull(spark):
    assert one(spark, C.blend([F.col("a"), F.col("b")], [0.25, 0.75]), a=[0.0] * 11, b=[100.0] * 11) == [75.0] * 11
    with pytest.raises(ValueError):
        C.blend([F.col("a"), F.col("b")], [0.5, 0.6])
    p = [math.log(2.0), math.log(0.7)]
    got = one(spark, C.weibull(F.get("a", 0), F.get("a", 1)), a=p)
    assert got == pytest.approx(M.weibull_curve(np.array(p)).tolist()) and got[-1] == 100
    assert M.fit_weibull(np.array(got)) == pytest.approx(p, abs=1e-4)


@pytest.mark.parametrize(
    "payload, ok",
    [
        (str({"cdf": CURVE}).replace("'", '"'), True),
        ('{"cdf": [1, 2]}', False),
        (str({"cdf": CURVE, "x": 1}).replace("'", '"'), False),
        (str({"cdf": [*CURVE[:10], "100"]}).replace("'", '"'), False),
        (str({"cdf": [True, *CURVE[1:]]}).replace("'", '"').replace("True", "true"), False),
        (str({"cdf": [9.0, *CURVE[1:]]}).replace("'", '"'), False),
        ("no json", False),
        (None, False),
    ],
)
def test_strict_payload(spark, payload, ok):
    got = spark.createDataFrame([(payload,)], "p string").select(text.parse_curve(F.col("p"))).first()[0]
    assert (got is not None) is ok
    if ok:
        assert got == CURVE


def test_normalized_names(spark):
    got = spark.createDataFrame([("iPhone14_HPC_Münster_BS6_9,0-10m (1).JPG",)], "n string").select(text.normalize_token(F.col("n"))).first()[0]
    assert got == "iphone14hpcmuensterbs69010m1jpg"

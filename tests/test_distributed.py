"""Operators that avoid all-pairs work, against plain loops: containment by substrings, pair means by ranks, ordered duplicates by cells, pruned neighbours, running sums over ranges."""

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvemill.functions.curves import WIDTHS
from curvemill.operators import aggregate as A, keys as K, ledger, match, neighbors as N
from curvemill.operators.working import running


def test_running_sums_of_a_group_in_many_ranges(spark):
    r = random.Random(1)
    rows = [("hot" if i % 3 else r.choice(["a", None, "b"]), i * 7 % 400, r.randrange(-5, 9)) for i in range(400)]
    out = running(spark.createDataFrame(rows, "k string, o int, x int"), ["k"], ["o"], "x", "upto", "all").collect()
    assert len(out) == 400
    for k, o, _, upto, everything in out:
        own = [(p, x) for g, p, x in rows if g == k]
        assert upto == sum(x for p, x in own if p <= o) and everything == sum(x for _, x in own)
    whole = running(spark.createDataFrame(rows, "k string, o int, x int"), [], ["o"], "x", "upto").where("o = 399").first()
    assert whole["upto"] == whole["total"] == sum(x for *_, x in rows)


def test_order_statistics_and_medians(spark):
    r = random.Random(2)
    rows = [(r.choice("aaab"), r.choice([1.5, 1.5, r.random(), None, -3.0])) for _ in range(300)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {x["k"]: x["median"] for x in A.medians(df, "v", ["k"]).collect()}
    want = {k: float(np.median([v for g, v in rows if g == k and v is not None])) for k in ("a", "b", "one")}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    assert math.isclose(A.medians(df, "v").first()["median"], float(np.median([v for _, v in rows if v is not None])))
    assert A.medians(df.limit(0), "v", ["k"]).collect() == []


def curve(r):
    return sorted(r.choice([0.0, 5.0, r.random() * 100]) for _ in range(10)) + [100.0]


def emd(a, b):
    return sum(abs(x - y) * w for x, y, w in zip(a, b, WIDTHS))


def test_pair_means(spark):
    r = random.Random(3)
    rows = [(r.choice("xxxy"), curve(r)) for _ in range(60)] + [("single", curve(r))] + [("same", [50.0] * 10 + [100.0])] * 4
    df = spark.createDataFrame(rows, "k string, cdf array<double>")
    got = {x["k"]: (x["emd"], x["pairs"]) for x in A.pair_means(df, ["k"]).collect()}
    for k in ("x", "y", "single", "same"):
        pairs = [emd(a, b) for a, b in itertools.combinations([c for g, c in rows if g == k], 2)]
        assert got[k][1] == len(pairs)
        assert got[k][0] is None if not pairs else math.isclose(got[k][0], sum(pairs) / len(pairs), abs_tol=1e-9)
    assert math.isclose(A.pair_means(df).first()["emd"], np.mean([emd(a, b) for (_, a), (_, b) in itertools.combinations(rows, 2)]))
    assert tuple(A.pair_means(df.limit(0)).first()) == (None, 0) and A.pair_means(df.limit(0), ["k"]).collect() == []
    plan = A.pair_means(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def normal(text):
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        text = text.lower().replace(a, b)
    return "".join(c for c in text if c.isalnum())


def test_containment_against_loops(spark):
    r = random.Random(4)
    piece = lambda n: "".join(r.choices("abC1_-äß ", k=n))
    names = [(i % 150, piece(r.randrange(40)) + "img" * (i % 3 == 0)) for i in range(200)] + [(999, None), (998, ""), (997, "ab" * 900 + "c1a" + "b" * 700)]
    values = [(i, piece(r.randrange(1, 7))) for i in range(120)] + [(500, "IMG"), (501, ""), (502, "img"), (503, "b" * 650), (504, "c1a"), (505, "longer than any name " * 120)]
    n = spark.createDataFrame(names, "id int, name string")
    v = spark.createDataFrame(values, "pos int, v string").repartition(3)
    listed = [(p, x) for p, x in values if x]
    longest = match.match_longest(n, "name", "id", v, "v", "pos").collect()
    assert sorted((x["id"], x["name"] or "", x["match"]) for x in longest) == sorted(
        {(i, s or "", next((x for _, x in sorted(listed, key=lambda y: (-len(y[1]), y[0])) if s is not None and (x.lower() in s.lower() or normal(x) in normal(s))), "")) for i, s in names}
    )
    every = match.match_all(n, "name", "id", v, "v", "pos").collect()
    assert len(every) == len({(i, s) for i, s in names})
    for x in every:
        hits = [y for _, y in listed if x["name"] is not None and normal(y) in normal(x["name"])]
        assert x["n_matches"] == len(hits) and x["match"] == (hits[0] if len(hits) == 1 else "")


def test_values_are_dealt_before_they_are_counted(spark, monkeypatch):
    monkeypatch.setattr(match, "ROWS", 50)
    dealt, was = [], match.written
    monkeypatch.setattr(match, "written", lambda df: dealt.append((df.columns, df.rdd.getNumPartitions())) or was(df))
    v = spark.range(2000).selectExpr("cast(id % 1000 as string) as v").coalesce(1)
    n = spark.createDataFrame([(1, "x7_8"), (2, "x"), (3, "a993b")], "id int, name string")
    assert sorted((r["id"], r["n_matches"]) for r in match.match_all(n, "name", "id", v, "v").collect()) == [(1, 6), (2, 0), (3, 10)]
    assert [k for c, k in dealt if c == ["value", "pos", "times"]] == [40]
    assert [k for c, k in dealt if "part" in c] == [20]


def test_containment_without_values_or_names(spark):
    n, v = spark.createDataFrame([(1, "a")], "id int, name string"), spark.createDataFrame([("x",)], "v string")
    assert [tuple(r) for r in match.match_all(n, "name", "id", v.limit(0), "v").collect()] == [(1, "a", "", 0)]
    assert match.match_longest(n.limit(0), "name", "id", v, "v").collect() == []
    plan = match.match_all(n, "name", "id", v, "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan


def fold(rows, prior, slack=1e-9):
    """Survivors one after the other."""
    seen = [(n, v) for n, v in sorted(prior, key=lambda p: p[0])]
    out = []
    for place, (name, *_, v) in enumerate(sorted(rows, key=lambda x: (x[1], x[2], x[0]))):
        twin = next((n for n, o in seen if len(o) == len(v) and all(abs(a - b) <= slack for a, b in zip(o, v))), None)
        out.append((name, place, twin))
        if twin is None:
            seen.append((name, v))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_ordered_duplicates_against_a_fold(spark, seed):
    r = random.Random(seed)
    base = [[r.choice([0.0, 100.0, 50.0, r.random() * 100, 3.7e-5]) for _ in range(3)] for _ in range(5)]
    near = lambda: [x + r.choice([0, 0, 4e-10, 8e-10, 1.3e-9, -6e-10]) for x in r.choice(base)]
    rows = [(f"e{i:03}", float(r.randrange(3)), float(r.randrange(2)), near()) for i in range(120)] + [("short", 0.0, 0.0, [0.0]), ("empty", 0.0, 0.0, [])]
    prior = [(f"p{i}", near()) for i in range(6)]
    c = spark.createDataFrame(rows, "experiment string, score double, disagreement double, values array<double>")
    p = spark.createDataFrame(prior, "experiment string, values array<double>")
    assert [tuple(x) for x in ledger.queue(c, p).orderBy("place").collect()] == fold(rows, prior)
    if seed:
        assert [tuple(x) for x in ledger.queue(c, p.limit(0)).orderBy("place").collect()] == fold(rows, [])
        assert ledger.queue(c.limit(0), p).collect() == []


def test_a_chain_of_near_curves(spark):
    rows = [(f"e{i:03}", float(i), 0.0, [i * 0.7e-9, 1.0]) for i in range(12)] + [(f"copy{i}", 50.0, 0.0, [5 * 0.7e-9, 1.0]) for i in range(40)]
    c = spark.createDataFrame(rows, "experiment string, score double, disagreement double, values array<double>")
    got = [tuple(x) for x in ledger.queue(c, c.select("experiment", "values").limit(0)).orderBy("place").collect()]
    assert got == fold(rows, [])


def cloud(n, dims, seed):
    r = np.random.default_rng(seed)
    return [(int(i), int(n - i), *map(float, np.round(r.normal(size=dims), 2) + 8 * (i % 4))) for i in r.permutation(n)]


@pytest.mark.parametrize("dims, rows", [(2, 40), (3, 100), (1, 1000)])
def test_pruned_neighbours(spark, monkeypatch, dims, rows):
    monkeypatch.setattr(N, "CELL", 10)
    data = cloud(400, dims, dims) + [(1000 + i, 2000 + i, *[0.25] * dims) for i in range(130)]  # a cell of copies above a block
    columns = [f"f{i}" for i in range(dims)]
    df = spark.createDataFrame(data, ", ".join(["id int", "pos int", *(f"{c} double" for c in columns)]))
    x = np.array([d[2:] for d in data])
    s = x.std(0)
    far = (((x[:, None] - x[None]) / s) ** 2).sum(2)
    np.fill_diagonal(far, np.inf)
    pos = np.array([d[1] for d in data])
    want = {(data[q][0], data[t][0], i + 1) for q in range(len(data)) for i, t in enumerate(np.lexsort((pos, far[q]))[:4])}
    found, share = N.pruned(df, df, columns, 4, "id", exclude_self=True, rows=rows)
    assert {(r["id"], r["neighbor"], r["rank"]) for r in found.collect()} == want
    assert share == 1.0 if rows > len(data) else 0 < share < 0.6


def test_pruning_grows_with_rows(spark):
    shares = []
    for n in (1000, 4000):
        df = spark.createDataFrame(cloud(n, 2, 1), "id int, pos int, a double, b double")
        shares.append(N.pruned(df, df, ["a", "b"], 3, "id", exclude_self=True, rows=250)[1])
    assert shares[1] < 0.6 * shares[0] < 0.6


def test_few_rows_in_a_block(spark, monkeypatch):
    """A block with fewer than k rows gives no bound."""
    monkeypatch.setattr(N, "CELL", 2)
    df = spark.createDataFrame(cloud(30, 2, 5), "id int, pos int, a double, b double")
    found, _ = N.pruned(df.where("id < 5"), df, ["a", "b"], 6, "id", rows=3)
    whole = N.nearest(df.where("id < 5"), df, ["a", "b"], 6, "id")
    assert sorted(map(tuple, found.select("id", "neighbor", "rank").collect())) == sorted(map(tuple, whole.select("id", "neighbor", "rank").collect()))


def test_one_to_one_reads_each_side_once(spark):
    df = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert K.one_to_one(df, df, ["k"]).count() == 5
    with pytest.raises(ValueError, match="right: 0 null and 5 repeated"):
        K.one_to_one(df, df.union(df), ["k"])


def test_exact_rank_sums():
    """The identity behind pair_means, in exact arithmetic."""
    values = sorted(Fraction(random.Random(9).randrange(50)) for _ in range(40))
    n = len(values)
    assert sum(abs(a - b) for a, b in itertools.combinations(values, 2)) == sum((2 * (k + 1) - n - 1) * v for k, v in enumerate(values))


def test_routes_in_slices(monkeypatch):
    r = np.random.default_rng(3)
    cells = N._Cells(r.normal(size=(40, 5)), np.ones(5))
    cells.pack(r.integers(1, 90, 40), r.uniform(0.1, 1, 40), 50)
    x, mark = r.normal(size=(300, 5)), r.integers(0, 1000, 300)
    home = np.concatenate([b for _, b in cells.routes(x, None, None, mark)])
    found = {}
    for most in (100_000, 200):  # a slice of queries holds no more cells than that, whatever the number of queries
        monkeypatch.setattr(N, "CELLS", most)
        parts = list(cells.routes(x, np.full(300, 1.5), home, mark))
        assert len(parts) >= 300 * 40 // most and max(len(q) for q, _ in parts) <= max(most // 40, 1) * cells.blocks
        found[most] = [tuple(np.concatenate(c).tolist()) for c in zip(*parts, strict=True)]
    far = cells.away(x)
    own = far.argmin(1)
    between = np.linalg.norm(cells.pivots[:, None] - cells.pivots[None], axis=2)
    least = np.maximum(far - cells.radius, (far**2 - far.min(1)[:, None] ** 2) / np.maximum(2 * between[own], 1e-12))
    want = {(i, cells.first[c] + j) for i in range(300) for c in range(40) if least[i, c] <= 1.5 for j in range(cells.parts[c])}
    assert found[200] == found[100_000] and set(zip(*found[200], strict=True)) == {(i, b) for i, b in want if b != home[i]}

"""Alignment, aggregation, matching, neighbours, folds, ledgers and sources."""

import json
import uuid
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvemill.functions import models as M, text
from curvemill.operators import submission as S, aggregate as A, folds, gram, keys as K, ledger, linear, match, neighbors as N
from curvemill.sources import files
from curvemill.streaming.curves import windowed_curves


def flat(spark, values, key="sample_id"):
    rows = [(k, [float(v)] * 10 + [100.0]) for k, v in values]
    return spark.createDataFrame(rows, f"{key} string, cdf array<double>")


def first(df, key="sample_id"):
    return {r[key]: r["cdf"][0] for r in df.collect()}


def test_blends_on_shuffled_keys(spark):
    parts = [flat(spark, v) for v in ([("A", 0), ("B", 30)], [("B", 60), ("A", 30)], [("A", 60), ("B", 0)])]
    assert first(K.blend_mean(parts, ["sample_id"])) == {"A": 30, "B": 30}
    parts = [flat(spark, v) for v in ([("a", 10), ("b", 70)], [("b", 90), ("a", 40)], [("a", 20), ("b", 50), ("c", 1)])]
    got = K.blend_median(parts, ["sample_id"])
    assert first(got) == {"a": 20, "b": 70} and {r["cdf"][10] for r in got.collect()} == {100}
    assert set(first(K.blend_mean(parts, ["sample_id"], least=1))) == {"a", "b", "c"}


def test_keys(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "k string")
    assert tuple(K.keys_report(df, ["k"]).first()) == (4, 1, 1)
    with pytest.raises(ValueError):
        K.require_unique(df, ["k"])
    other = spark.createDataFrame([("a",), ("c",)], "k string")
    with pytest.raises(ValueError, match="1 missing, 1 extra"):
        K.require_same_keys(df.where("k is not null"), other, ["k"])
    with pytest.raises(ValueError):
        K.require_disjoint(df, other, ["k"])
    with pytest.raises(Exception, match="missing key: b"):
        K.lookup(df.where("k = 'b'"), other.withColumn("v", F.lit(1)), ["k"]).collect()
    assert K.lookup(other.where("k = 'a'"), df.where("k = 'b'").withColumn("k", F.lit("a")).withColumn("v", F.lit(2)), ["k"]).first()["v"] == 2
    assert K.same_multiset(df, df).first()[0] and not K.same_multiset(df, df.distinct()).first()[0]


def test_macro_mean_and_weights(spark):
    df = spark.createDataFrame([("s", "one", 0.0), ("s", "two", 6.0), ("s", "two", 9.0), ("s", "two", 12.0)], "sample_id string, view string, feature_0 double")
    assert A.macro_mean(df, ["sample_id"], "view").first()["feature_0"] == 4.5
    assert A.mean_by(df, ["sample_id"]).first()["feature_0"] == 6.75
    assert {r["weight"] for r in A.sample_weights(df, ["sample_id"]).collect()} == {0.25}


@pytest.mark.parametrize("n", [2, 3, 4, 7, 8])
def test_leave_one_out_statistics(spark, n):
    y = np.sort(np.random.default_rng(n).uniform(0, 100, (n, 11)), 1).round(1)
    y[:, 3] = y[0, 3]
    df = spark.createDataFrame([(str(i), r.tolist()) for i, r in enumerate(y)], "k string, cdf array<double>")
    for got, f in ((A.loo_mean(df), np.mean), (A.loo_median(df, "k"), np.median)):
        for r in got.collect():
            want = f(np.delete(y, int(r["k"]), 0), axis=0)
            assert r["predicted"] == pytest.approx([*want[:10], 100])
    assert A.loo_mean(df.limit(1)).count() == A.loo_median(df.limit(1), "k").count() == 0


def test_screen_and_ties(spark):
    e = spark.createDataFrame([(10.0, 5.0), (10.0, 9.0), (10.0, 10.0)], "reference double, error double")
    r = A.screened(A.improvement(e).withColumn("d", F.lit(1.0)).withColumn("rd", F.lit(1.0)), "d", "rd").first()
    assert (r["mean_improvement"], r["improved"], r["improvement_without_largest"], r["eligible"]) == (2.0, 2, 0.5, True)
    assert not A.screened(A.improvement(e).withColumn("d", F.lit(None).cast("double")).withColumn("rd", F.lit(1.0)), "d", "rd").first()["eligible"]
    grid = spark.createDataFrame([("f", 10.0, 1.0), ("f", 100.0, 1.0), ("f", 1000.0, 2.0)], "fold string, alpha double, score double")
    assert A.best_by(grid, ["fold"], "score", [-F.col("alpha")], ["alpha"]).first()["alpha"] == 100


def test_regions(spark):
    image = np.zeros((6, 8), int)
    image[0, :4], image[2:4, 2:4], image[4, 6] = 9, 2, 42
    pixels = spark.createDataFrame([(y, x, int(v)) for (y, x), v in np.ndenumerate(image)], "y int, x int, label int")
    got = [tuple(r) for r in A.regions(pixels, 1.0).orderBy("region_id").collect()]
    assert [(g[0], g[1], g[4], g[5]) for g in got] == [(2, 4, False, True), (9, 4, True, False), (42, 1, False, False)]
    with pytest.raises(ValueError):
        A.regions(pixels, 0.0)


def test_names(spark):
    names = spark.createDataFrame([("1", "iPhone14_HPC_Münster_BS6_9,0-10m (1).JPG"), ("2", "sample_alpha_beta.jpg"), ("3", "none.png")], "id string, name string")
    ids = spark.createDataFrame([("HPC_Muenster_BS6_9_0-10m",), ("sample_alpha",), ("alpha_beta",), ("",)], "v string")
    got = {r["id"]: (r["match"], r["n_matches"]) for r in match.match_all(names, "name", "id", ids, "v").collect()}
    assert got == {"1": ("HPC_Muenster_BS6_9_0-10m", 1), "2": ("", 2), "3": ("", 0)}
    with pytest.raises(Exception, match="ambiguous"):
        match.match_unique(names, "name", "id", ids, "v").collect()
    cams = spark.createDataFrame([("iPhone",), ("iphone14",), ("x",)], "v string")
    assert {r["id"]: r["match"] for r in match.match_longest(names, "name", "id", cams, "v").collect()} == {"1": "iphone14", "2": "", "3": ""}
    assert match.pick_column(spark.createDataFrame([("a", 1.0)], "my_camera string, px double"), "phone", [["camera"], ["device"]], "string") == "my_camera"


def test_photo_index(spark):
    listing = spark.createDataFrame([("train", "d/cam1_s1.jpg"), ("train", "d/other.jpg"), ("test", "e/s2.jpg")], "split string, path string")
    ids = spark.createDataFrame([("train", "s1"), ("train", "s9"), ("test", "s2"), ("test", "s8")], "split string, sample_id string")
    index = match.photo_index(listing, ids, spark.createDataFrame([("cam1", "2.5"), ("cam2", "n/a")], "phone string, ppm string"))
    got = {r["filename"]: (r["sample_id"], r["camera"], r["ppm"], r["is_matched"], r["issue"]) for r in index.collect()}
    assert got == {"cam1_s1.jpg": ("s1", "cam1", 2.5, True, ""), "other.jpg": ("", "", None, False, "unmatched_sample_id"), "s2.jpg": ("s2", "", None, True, "unknown_camera")}
    assert {r["split"]: r["without_photo"] for r in match.coverage(index, ids).collect()} == {"train": ["s9"], "test": ["s8"]}


def test_photos_are_listed_once(spark, tmp_path):
    def mark(batches):
        (tmp_path / uuid.uuid4().hex).touch()
        yield from batches

    listing = spark.createDataFrame([("train", "d/cam1_s1.jpg"), ("test", "e/s2.jpg")], "split string, path string").coalesce(1).mapInArrow(mark, "split string, path string")
    ids = spark.createDataFrame([("train", "s1"), ("test", "s2")], "split string, sample_id string")
    index = match.photo_index(listing, ids, spark.createDataFrame([("cam1", "2.5")], "phone string, ppm string"))
    assert index.count() == match.coverage(index, ids).count() == 2 and len(list(tmp_path.iterdir())) == 1


def shuffled(spark):
    """Bytes of shuffle files."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.stat().st_size for d in dirs for f in Path(d.getPath()).rglob("shuffle_*"))


@pytest.mark.parametrize("at_once", [1, match.__dict__.get("AT_ONCE", 0)])
def test_longest_matches_are_settled_from_the_longest_down(spark, monkeypatch, at_once):
    r = np.random.default_rng(5)
    word = lambda n: "".join(r.choice(list("abcd-"), n))
    names = [(i, "img_" + word(30)) for i in range(600)] + [(600, None), (601, ""), (602, "img_"), (603, "--")]
    values = [(i, word(n)) for i, n in enumerate(r.integers(3, 9, 400))] + [(900, "IMG"), (901, "_"), (902, "xyz")]
    norm = lambda x: "".join(c for c in x.lower() if c.isalnum())
    longest = lambda x: next((v for p, v in sorted(values, key=lambda y: (-len(y[1]), y[0])) if x is not None and norm(v) in norm(x)), "")
    n, v = spark.createDataFrame(names, "id int, name string"), spark.createDataFrame(values, "pos int, v string")
    steps, made, met, was = [], [], match.__dict__.get("_met"), match.written
    if met:
        monkeypatch.setattr(match, "AT_ONCE", at_once)
        monkeypatch.setattr(match, "HOT", 50)
        monkeypatch.setattr(match, "_met", lambda named, dealt, lengths, tasks: steps.append((named.count(), max(lengths))) or met(named, dealt, lengths, tasks))
    monkeypatch.setattr(match, "written", lambda df: made.append(was(df)) or made[-1])
    held = shuffled(spark)
    got = sorted((x["id"], x["match"]) for x in match.match_longest(n, "name", "id", v, "v", "pos").collect())
    assert got == [(i, longest(x)) for i, x in names]
    assert shuffled(spark) - held < 40_000  # all substrings at once leave some 3,000,000
    if at_once == 1:
        assert len(steps) > 3 and steps == sorted(steps, reverse=True) and steps[-1][0] < steps[0][0] / 2
        there = [Path(d.inputFiles()[0].removeprefix("file://")).exists() for d in made]
        assert sum(there) <= 2 + len([d for d in made if d.columns == ["i", "best"]])  # the names, those left, and what was found


def entities(n=12, p=2, seed=0):
    r = np.random.default_rng(seed)
    x, y = r.normal(size=(n, p)), np.sort(r.uniform(0, 100, (n, 11)), 1)
    y[:, -1] = 100
    return x, y


def table(spark, x, y):
    rows = [(f"k{i:03d}", i, *map(float, a), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "sample_id string, pos long, " + ", ".join(f"feature_{j} double" for j in range(x.shape[1])) + ", cdf array<double>")


def test_neighbors(spark, monkeypatch):
    x, y = entities()
    x[3] = x[2]
    df = table(spark, x, y)
    cols = A.feature_columns(df)
    want = M.knn(x[4:], y[4:], x[:4])
    for most in (20_000, 3):
        monkeypatch.setattr(N, "TRAIN", most)
        got = {r["sample_id"]: r["cdf"] for r in N.knn_curves(df.where("pos < 4"), df.where("pos >= 4"), cols).collect()}
        assert all(got[f"k{i:03d}"] == pytest.approx(want[i]) for i in range(4))
    monkeypatch.setattr(N, "TRAIN", 20_000)
    scores = {r["k"]: r["emd"] for r in N.loo_scores(df, cols).collect()}
    for k, e in scores.items():
        assert e == pytest.approx(M.loo_error(x, y, lambda a, b, q, k=k: M.knn(a, b, q, k)))


def test_leave_one_out_in_blocks(spark, monkeypatch):
    x, y = entities()
    x[3] = x[2]
    df = table(spark, x, y)
    cols = A.feature_columns(df)
    ranks = lambda: sorted(tuple(r)[:2] + tuple(r)[3:] for r in N.loo_ranks(df, cols, 3).collect())
    whole = ranks()
    monkeypatch.setattr(N, "TRAIN", -(-len(x) // 3))
    assert ranks() == whole and len(whole) == 3 * len(x)


def test_leave_one_out_holds_one_round_on_disk(spark, monkeypatch):
    df = table(spark, *entities(60))
    cols = A.feature_columns(df)
    ranks = lambda: sorted((r["sample_id"], r["rank"], r["neighbor"]) for r in N.loo_ranks(df, cols, 3).collect())
    whole = ranks()
    monkeypatch.setattr(N, "TRAIN", 5)
    made, was = [], N.written
    monkeypatch.setattr(N, "written", lambda d: made.append(was(d)) or made[-1])
    held = shuffled(spark)
    assert ranks() == whole and len(whole) == 180
    assert shuffled(spark) - held < 5_000  # 12 x 12 blocks leave some 50,000
    there = [Path(d.inputFiles()[0].removeprefix("file://")).exists() for d in made]
    assert len(there) == 4 and there == [True, False, False, True]  # the rows, and the best of the last of three rounds
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def brute(x, s, y, order, same, k):
    far = (((x[:, None] - y[None]) / s[:, None]) ** 2).sum(2)
    far[same | ~np.isfinite(far)] = np.inf
    best = [[j for j in np.lexsort((order, row)) if np.isfinite(row[j])][:k] for row in far]
    return [(i, j, far[i, j]) for i, row in enumerate(best) for j in row]


@pytest.mark.parametrize("spread", [0, 1e-4, 0.01, 0.5])
def test_closest_rows_for_scales_alike_and_apart(spread):
    r = np.random.default_rng(6)
    for rows, k in ((5, 7), (7, 7), (90, 3), (700, 3)):
        y = np.round(r.normal(size=(rows, 4)) * 5)
        y[0], y[-1, 2], y[1] = 1e9, np.nan, y[2]
        x = np.vstack([y[1:4], r.normal(size=(6, 4)) * 5])
        s = np.array([1, 0.1, 3, 20]) * (1 + spread * r.uniform(size=x.shape))
        order, same = r.permutation(rows), r.random((len(x), rows)) < 0.02
        got = list(zip(*N._closest(x, s, N._Rows(y, order, s[0]), same, k), strict=True))
        assert got == brute(x, s, y, order, same, k)


def test_leave_one_out_of_one_row(spark):
    df = table(spark, *entities(1))
    assert N.loo_ranks(df, A.feature_columns(df), 3).collect() == []


def test_gram_ridge(spark):
    x, y = entities(15, 3)
    x[:, 2] = 4.0
    x[5, 2] = 7.0  # constant without this row
    df = table(spark, x, y)
    cols = A.feature_columns(df)
    got = {r["sample_id"]: r["cdf"] for r in gram.ridge(df, df.drop("cdf"), cols).collect()}
    want = M.ridge(x, y, x)
    loo = {r["sample_id"]: r["cdf"] for r in gram.loo_ridge(df, "sample_id", cols).collect()}
    for i in range(15):
        keep = np.arange(15) != i
        assert got[f"k{i:03d}"] == pytest.approx(want[i])
        assert loo[f"k{i:03d}"] == pytest.approx(M.ridge(x[keep], y[keep], x[i : i + 1])[0])


def photos(spark, x, y):
    rows = [(f"k{i:03d}", v, *map(float, a + d)) for i, a in enumerate(x) for v, d in (("A", 0.1), ("B", -0.1), ("B", -0.3))]
    obs = spark.createDataFrame(rows, "sample_id string, view string, " + ", ".join(f"feature_{j} double" for j in range(x.shape[1])))
    return obs, spark.createDataFrame([(f"k{i:03d}", c.tolist()) for i, c in enumerate(y)], "sample_id string, cdf array<double>")


def test_folds_and_leakage(spark):
    x, y = entities(9)
    obs, curves = photos(spark, x, y)
    means = x - 0.1
    got = {(r["sample_id"], r["view"]): r for r in folds.leave_one_out(obs, curves, "sample_id", "view", M.ridge).collect()}
    assert len(got) == 27
    for i in range(9):
        keep = np.arange(9) != i
        assert got[f"k{i:03d}", None]["cdf"] == pytest.approx(M.ridge(means[keep], y[keep], means[i : i + 1])[0])
        assert got[f"k{i:03d}", "B"]["cdf"] == pytest.approx(M.ridge(means[keep], y[keep], x[i : i + 1] - 0.2)[0])
    y2 = y.copy()
    y2[4] = 100.0  # the held-out curve cannot change its own prediction
    again = {(r["sample_id"], r["view"]): r["cdf"] for r in folds.leave_one_out(obs, photos(spark, x, y2)[1], "sample_id", "view", M.ridge).collect()}
    assert again["k004", None] == pytest.approx(got["k004", None]["cdf"])
    nested = folds.leave_one_out(obs, curves, "sample_id", "view", None, "ridge").where("view is null").collect()
    for r in nested:
        keep = np.arange(9) != int(r["sample_id"][1:])
        setting, scores = M.select("ridge", means[keep], y[keep])
        assert json.loads(r["setting"]) == setting and [v for _, v in json.loads(r["inner_scores"])] == pytest.approx(list(scores.values()))


def test_transfer(spark):
    x, y = entities(6)
    obs, curves = photos(spark, x, y)
    obs = obs.where("not (sample_id = 'k005' and view = 'A')")
    got = folds.view_transfer(obs, curves, "sample_id", "view", ("A", "B"), M.knn)
    rows = {(r["sample_id"], r["train_view"], r["query_view"]): r for r in got.collect()}
    assert len(rows) == 20 and all(r["training_entities"] == 4 for r in rows.values())
    keep = [0, 1, 3, 4]
    assert rows["k002", "A", "B"]["cdf"] == pytest.approx(M.knn(x[keep] + 0.1, y[keep], x[2:3] - 0.2)[0])
    pairs = linear.transfer_pairs(got, "sample_id").collect()
    assert len(pairs) == 10 and all(r["transfer_minus_control_emd"] == pytest.approx(r["transfer_emd"] - r["control_emd"]) for r in pairs)
    assert {r["entities"] for r in folds.transfer_summary(got, "sample_id").collect()} == {5}
    with pytest.raises(ValueError):
        folds.view_transfer(obs.where("sample_id < 'k002'"), curves, "sample_id", "view", ("A", "B"), M.knn)


def test_ledgers(spark):
    df = spark.createDataFrame([("r", 0, "a", "complete", 60), ("r", 1, "b", "complete", 50), ("r", 2, "c", "requested", None)], "run string, number long, key string, state string, used long")
    df = df.withColumn("tokens", ledger.charged(F.col("used"), F.col("state"), 99))
    got = [(r["spent_before"], r["allowed"]) for r in ledger.budgeted(df, ["run"], ["number"], "tokens", 110).orderBy("number").collect()]
    assert got == [(0, True), (60, True), (110, False)]
    assert ledger.first_breach(df, ["run"], ["number"], "tokens", 110).first()["number"] == 2
    plan = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d")], "number long, key string")
    assert not ledger.resume_report(df, plan).first()["resumable"] and ledger.resume_report(df.where("number < 2"), plan).first()["resumable"]
    assert ledger.resume_report(df.where("number = 1"), plan).first()["gaps"] == 1
    tries = spark.createDataFrame([("a", 1, "failed"), ("b", 1, "failed"), ("b", 2, "failed"), ("c", 1, "complete")], "key string, attempt long, state string")
    assert {r["key"] for r in ledger.attempts(tries, "key").where("may_retry").collect()} == {"a"}


def test_submissions(spark):
    t = spark.createDataFrame([("b", 0.0, 100.0), ("a", 0.0, 100.0)], "sample_id string, `0.002` double, `200` double")
    good = spark.createDataFrame([("a", 10.0, 100.0), ("b", 20.0, 100.0)], t.schema)
    assert S.require_submission(good, t) is good and S.from_curve(t, [7, 9]).collect()[0][1:] == (7.0, 100.0)
    bad = spark.createDataFrame([("a", -1.0, 100.0), ("a", 20.0, 90.0), ("c", None, 100.0)], t.schema)
    r = S.submission_report(bad, t).first()
    assert (r["duplicate_keys"], r["missing"], r["extra"], r["bad_curves"], r["open_ends"], r["valid"]) == (1, 1, 1, 2, 1, False)
    for wrong in (bad, good.limit(1), good.select("sample_id", "`200`", "`0.002`")):
        with pytest.raises(ValueError):
            S.require_submission(wrong, t)
    order = spark.createDataFrame([("b", 0), ("a", 1)], "sample_id string, pos int")
    assert [r["sample_id"] for r in S.in_order(good, order, ["sample_id"], "pos").collect()] == ["b", "a"]
    near = good.withColumn("0.002", F.col("`0.002`") + 1e-11)
    S.require_rebuild(near.withColumnRenamed("0.002", "v"), good.withColumnRenamed("0.002", "v"), ["sample_id"], ["v"])
    with pytest.raises(ValueError):
        S.require_rebuild(near.withColumn("v", F.col("`0.002`") + 1e-9), good.withColumn("v", F.col("`0.002`")), ["sample_id"], ["v"])


def test_text_edits(spark):
    df = spark.createDataFrame([("a 1 b\nc\nd", 1.25)], "t string, v double")
    assert df.select(text.replace_once(F.col("t"), "1", "2")).first()[0] == "a 2 b\nc\nd"
    assert df.select(text.replace_lines(F.col("t"), 1, 2, [F.lit("x"), F.lit("y")])).first()[0] == "a 1 b\nx\ny\nd"
    assert tuple(df.select(text.shown(F.col("v"), 1), text.shown(F.lit(None).cast("double"), 1)).first()) in (("1.3", "n/a"), ("1.2", "n/a"))
    with pytest.raises(Exception):
        df.select(text.replace_once(F.col("t"), "z", "2")).collect()
    kinds = {"retry": r"(\d)/5 WARN retry", "blank": r"\s*"}
    lines = spark.createDataFrame([("3/5 WARN retry",), ("",)], "line string")
    assert [tuple(r[0]) for r in lines.select(text.line_class(F.col("line"), kinds)).collect()] == [("retry", ["3"]), ("blank", [])]
    with pytest.raises(Exception):
        spark.createDataFrame([("3/5 WARN retry now",)], "line string").select(text.line_class(F.col("line"), kinds)).collect()


def test_ordered_duplicates(spark):
    rows = [("a", 1.0, 0.0, [40.0]), ("b", 1.0, 0.0, [40 + 5e-10]), ("c", 1.0, 0.0, [40 + 1e-7]), ("d", 0.5, 0.0, [9.0])]
    got = ledger.queue(spark.createDataFrame(rows, "experiment string, score double, disagreement double, values array<double>"), spark.createDataFrame([("old", [9.0])], "experiment string, values array<double>"))
    assert [(r["experiment"], r["duplicate_of"]) for r in got.orderBy("place").collect()] == [("d", "old"), ("a", None), ("b", "a"), ("c", None)]


def test_files(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.JPG").write_bytes(b"x")
    (tmp_path / "in" / "a.txt").write_bytes(b"y")
    assert [r["path"].rsplit("/")[-1] for r in files.listing(spark, f"{root}/in").collect()] == ["b.JPG"]
    assert files.listing(spark, f"{root}/none").collect() == []
    assert files.save_once(spark, f"{root}/once", b"1") and not files.save_once(spark, f"{root}/once", b"1")
    with pytest.raises(FileExistsError):
        files.save_once(spark, f"{root}/once", b"2")
    files.replace(spark, f"{root}/once", b"2")
    assert (tmp_path / "once").read_bytes() == b"2"
    with pytest.raises(ValueError):
        files.canonical_json({"a": float("nan")})
    (tmp_path / "t.csv").write_text("k,v\na,NaN\nb,2\n")
    assert [tuple(r) for r in files.csv(spark, f"{root}/t.csv", "k string, v double").collect()] == [("a", None), ("b", 2.0)]
    (tmp_path / "l.json").write_text('{"a": 1}\nbad\n')
    (tmp_path / "l2.json").write_text('{"a": 1}\nbad\n[1]\n3\n{"a": "x"\n{"a": 4, "b": 5}\n')
    for name, n in (("l.json", 1), ("l2.json", 2)):
        tolerant = files.json_lines(spark, f"{root}/{name}", "a int", strict=False)
        assert tolerant.count() == len(tolerant.collect()) == n
    with files.Run(spark, f"{root}/run") as run:
        with pytest.raises(Exception):
            files.Run(spark, f"{root}/run").__enter__()
        with pytest.raises(ValueError):
            run.record("q1", {"state": "complete"})
        assert run.receipt("q1", {"k": 1}) and not run.receipt("q1", {"k": 1}) and run.record("q1", {"state": "failed"})
        with pytest.raises(FileExistsError):
            run.record("q1", {"state": "complete"})
        run.stop()
        assert run.stopped
    with files.Run(spark, f"{root}/run") as run:
        assert run.stopped
    with pytest.raises(Exception):
        files.json_lines(spark, f"{root}/l.json", "a int").collect()
    doc = json.dumps({"x": [{"path": "p", "sha256": "h"}, {"path": "p", "sha256": "h"}], "checkpoint_path": "c", "checkpoint_sha256": "d"})
    assert sorted(files.manifest_records(doc)) == [("c", "d"), ("p", "h")]
    recorded = spark.createDataFrame([("p", "h"), ("q", "h"), ("r", "h")], "path string, sha256 string")
    actual = spark.createDataFrame([("p", "h"), ("q", "x")], "path string, sha256 string")
    assert {r["path"]: r["state"] for r in files.verify(recorded, actual).collect()} == {"p": "ok", "q": "changed", "r": "missing"}
    made = []
    build = lambda: made.append(1) or spark.range(3)
    assert files.feature_cache(spark, f"{root}/cache", {"v": 1}, build).count() == files.feature_cache(spark, f"{root}/cache", {"v": 1}, build).count() == 3 and len(made) == 1
    assert files.Project.from_yaml("raw_dir: r").path("train") == "r/train.csv"


def test_stream(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:10:00", "k", float(v)) for h in (1, 2) for v in (5, 50, 500)]
    df = spark.createDataFrame(rows, "t string, key string, v double").select(F.col("t").cast("timestamp").alias("t"), "key", "v")
    df.write.parquet(f"{tmp_path}/in")
    stream = windowed_curves(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "t", "v", "key", (10.0, 100.0, 1000.0))
    q = stream.writeStream.format("memory").queryName("curves_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = windowed_curves(df, "t", "v", "key", (10.0, 100.0, 1000.0))
    assert sorted(map(tuple, spark.table("curves_out").collect())) == sorted(map(tuple, batch.collect()))
    assert batch.first()["cdf"] == pytest.approx([100 / 3, 200 / 3, 100])

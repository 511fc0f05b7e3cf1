"""The registered queries of the curve operators and the SQL that gives the same rows.

The supplied tables stand in for samples and observations: nations or suppliers are samples, order lines are observations,
return flags are views, embeddings are encoder features. Every query reads whole tables; numbers are rounded to
six digits on both sides, arrays are given as points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import curves as C, images, models, text
from ..operators import aggregate as A, folds, gram, keys as K, ledger, linear, match, neighbors as N, particles, pixels, submission
from ..operators.working import folder, written
from ..sources import tables
from ..streaming import ledger as stream_ledger
from ..streaming.curves import windowed_curves

#: Price thresholds of the stand-in curves; the last one is above every price.
PRICES = (1000.0, 2000.0, 5000.0, 10000.0, 15000.0, 20000.0, 30000.0, 45000.0, 60000.0, 90000.0, 200000.0)
FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
#: Dimensions of the supplied embeddings; the SQL names each.
DIMS = 64

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their supplier's nation: the two dimensions are small at every scale relative to the lines, so Spark broadcasts them below its threshold."""
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("sample_id"))
    line = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", *FEATURES, "l_returnflag")
    return line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))


def nation_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.build_curves(lines(spark, sf_dir), "l_extendedprice", ["sample_id"], PRICES)


def view_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.build_curves(lines(spark, sf_dir), "l_extendedprice", ["sample_id", "l_returnflag"], PRICES)


def at_points(df: DataFrame, keys: list[str], name: str = "cdf") -> DataFrame:
    long = df.select(*keys, F.posexplode(name).alias("pos", "value"))
    return long.select(*keys, F.col("pos").cast("int").alias("pos"), r6("value").alias("value"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as observations with features 0 to 3."""
    return lines(spark, sf_dir).select("sample_id", F.col("l_returnflag").alias("view"), *(F.col(c).alias(f"feature_{i}") for i, c in enumerate(FEATURES)))


# SQL pieces: the order lines, and the curves of nations in long form.
LINES = "lines AS (SELECT n_name AS sample_id, l.* FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"
_T = "(VALUES " + ", ".join(f"({i}, {t}::DOUBLE)" for i, t in enumerate(PRICES)) + ") t(pos, threshold)"
_W = "(VALUES " + ", ".join(f"({i}, {w!r}::DOUBLE)" for i, w in enumerate(C.WIDTHS)) + ") w(pos, width)"
CURVES = f"{LINES}, curves AS (SELECT sample_id, pos, 100.0::DOUBLE * count(*) FILTER (l_extendedprice <= threshold) / count(*) AS value FROM lines, {_T} GROUP BY 1, 2)"
VIEWS = f"{LINES}, views AS (SELECT sample_id, l_returnflag, pos, 100.0::DOUBLE * count(*) FILTER (l_extendedprice <= threshold) / count(*) AS value FROM lines, {_T} GROUP BY 1, 2, 3)"


@query(f"WITH {CURVES} SELECT sample_id, pos::INT AS pos, round(value, 6) AS value FROM curves")
def curve_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_points(nation_curves(spark, sf_dir), ["sample_id"])


@query(f"""WITH {CURVES}, loo AS (SELECT sample_id, pos, value, (sum(value) OVER (PARTITION BY pos) - value) / (count(*) OVER (PARTITION BY pos) - 1) AS p FROM curves)
SELECT sample_id, round(sum(abs(value - p) * width), 6) AS emd FROM loo JOIN {_W} USING (pos) GROUP BY 1""")
def curve_loo_emd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: each nation's curve against the mean curve of the others."""
    return A.loo_mean(nation_curves(spark, sf_dir)).select("sample_id", r6(C.emd(F.col("cdf"), F.col("predicted"))).alias("emd"))


@query(f"""WITH {CURVES}, p AS (SELECT a.sample_id, a.pos, any_value(a.value) AS value, median(b.value) AS p FROM curves a JOIN curves b ON a.pos = b.pos AND a.sample_id <> b.sample_id GROUP BY 1, 2)
SELECT sample_id, round(sum(abs(value - p) * width), 6) AS emd FROM p JOIN {_W} USING (pos) GROUP BY 1""")
def emd_loo_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.loo_median(nation_curves(spark, sf_dir), "sample_id").select("sample_id", r6(C.emd(F.col("cdf"), F.col("predicted"))).alias("emd"))


@query(f"WITH {CURVES} SELECT sample_id, round(sum(abs(value - 100.0 / 11 * (pos + 1)) * width), 6) AS emd FROM curves JOIN {_W} USING (pos) GROUP BY 1")
def emd_equal_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_curves(spark, sf_dir).select("sample_id", r6(C.emd(F.col("cdf"), C.equal_bins())).alias("emd"))


@query(f"""WITH {CURVES}, m AS (SELECT pos, avg(value) AS p FROM curves GROUP BY 1), c AS (SELECT sample_id, pos, abs(value - p) * width AS part FROM curves JOIN m USING (pos) JOIN {_W} USING (pos))
SELECT sample_id, round(sum(part), 6) AS emd, round(sum(part) FILTER (pos < 4), 6) AS fine4, round(sum(part) FILTER (pos < 5), 6) AS fine5, round(sum(part) FILTER (pos = 2), 6) AS third FROM c GROUP BY 1""")
def emd_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = nation_curves(spark, sf_dir)
    df = curves.crossJoin(F.broadcast(A.mean_curve(curves).withColumnRenamed("cdf", "p")))  # one row
    a, b = F.col("cdf"), F.col("p")
    return df.select("sample_id", r6(C.emd(a, b)).alias("emd"), r6(C.partial_emd(a, b, 4)).alias("fine4"), r6(C.partial_emd(a, b, 5)).alias("fine5"), r6(F.get(C.emd_contributions(a, b), 2)).alias("third"))


@query(f"WITH {CURVES} SELECT pos::INT AS pos, round(CASE WHEN pos = 10 THEN 100.0 ELSE avg(value) END, 6) AS mean, round(CASE WHEN pos = 10 THEN 100.0 ELSE median(value) END, 6) AS median FROM curves GROUP BY pos")
def curve_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = nation_curves(spark, sf_dir)
    mean = at_points(A.mean_curve(curves), []).withColumnRenamed("value", "mean")
    return mean.join(at_points(A.median_curve(curves), []).withColumnRenamed("value", "median"), "pos")


@query(f"""WITH {CURVES} SELECT a.sample_id AS a, b.sample_id AS b, round(sum(abs(a.value - b.value) * width), 6) AS emd
FROM curves a JOIN curves b ON a.pos = b.pos AND a.sample_id < b.sample_id JOIN {_W} ON w.pos = a.pos GROUP BY 1, 2""")
def emd_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of samples, as the label audit wants them: samples are few (nations), never observations."""
    pairs = K.all_pairs(nation_curves(spark, sf_dir), "sample_id")
    return pairs.select(F.col("member_a").alias("a"), F.col("member_b").alias("b"), r6(C.emd(F.col("cdf_a"), F.col("cdf_b"))).alias("emd"))


@query(f"""WITH {VIEWS}, p AS (SELECT a.sample_id, sum(abs(a.value - b.value) * width) AS e FROM views a JOIN views b ON a.sample_id = b.sample_id AND a.pos = b.pos AND a.l_returnflag < b.l_returnflag JOIN {_W} ON w.pos = a.pos GROUP BY a.sample_id, a.l_returnflag, b.l_returnflag)
SELECT round(avg(e), 6) AS disagreement, count(*) AS pairs FROM p""")
def view_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.view_disagreement(view_curves(spark, sf_dir), "sample_id", "l_returnflag").select(r6("disagreement").alias("disagreement"), "pairs")


@query(f"WITH {CURVES} SELECT sample_id, pos::INT AS pos, round(value - coalesce(lag(value) OVER (PARTITION BY sample_id ORDER BY pos), 0), 6) AS value FROM curves")
def curve_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_points(nation_curves(spark, sf_dir).select("sample_id", C.masses(F.col("cdf")).alias("cdf")), ["sample_id"])


@query(f"""WITH {CURVES}, m AS (SELECT sample_id, pos, sqrt(value - coalesce(lag(value) OVER (PARTITION BY sample_id ORDER BY pos), 0)) AS m FROM curves)
SELECT sample_id, pos::INT AS pos, round(sum(m) OVER (PARTITION BY sample_id ORDER BY pos), 6) AS value FROM m""")
def curve_from_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = F.transform(C.masses(F.col("cdf")), lambda m: F.sqrt(m))
    return at_points(nation_curves(spark, sf_dir).select("sample_id", C.from_masses(roots).alias("cdf")), ["sample_id"])


@query(f"""WITH {CURVES}, q AS (SELECT i, (i + 0.5) / 10.0 AS p FROM range(1000) r(i)), hit AS (SELECT sample_id, i, min(pos) AS pos FROM curves JOIN q ON value >= p GROUP BY 1, 2),
n AS (SELECT sample_id, pos, count(*) AS n FROM hit GROUP BY 1, 2) SELECT sample_id, pos::INT AS pos, n FROM n""")
def curve_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of 1000 quantiles fall on each diameter."""
    q = nation_curves(spark, sf_dir).select("sample_id", F.explode(C.log_quantiles(F.col("cdf"))).alias("q"))
    where = F.array_position(C.numbers(C.LOG_SUPPORT), F.col("q")) - 1
    return q.groupBy("sample_id", where.cast("int").alias("pos")).agg(F.count("*").alias("n"))


@query(f"""WITH {CURVES}, q AS (SELECT i, (i + 0.5) / 10.0 AS p FROM range(1000) r(i)), hit AS (SELECT sample_id, i, min(pos) AS pos FROM curves JOIN q ON value >= p GROUP BY 1, 2)
SELECT c.sample_id, c.pos::INT AS pos, round(CASE WHEN c.pos = 10 THEN 100.0 ELSE (count(h.pos) * 0.1)::DOUBLE END, 6) AS value FROM curves c LEFT JOIN hit h ON c.sample_id = h.sample_id AND h.pos <= c.pos GROUP BY c.sample_id, c.pos""")
def curve_from_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_points(nation_curves(spark, sf_dir).select("sample_id", C.from_log_quantiles(C.log_quantiles(F.col("cdf"))).alias("cdf")), ["sample_id"])


@query(f"""WITH {CURVES}, noisy AS (SELECT sample_id, pos, greatest(0, least(100, value * 1.1 - 5 + CASE WHEN pos % 2 = 0 THEN 8 ELSE -8 END)) AS v FROM curves)
SELECT sample_id, pos::INT AS pos, round(CASE WHEN pos = 10 THEN 100.0 ELSE max(v) OVER (PARTITION BY sample_id ORDER BY pos) END, 6) AS value FROM noisy""")
def curve_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.transform("cdf", lambda v, i: v * 1.1 - 5 + F.when(i % 2 == 0, 8).otherwise(-8))
    return at_points(nation_curves(spark, sf_dir).select("sample_id", C.repair(noisy).alias("cdf")), ["sample_id"])


@query(f"""WITH {CURVES}, bad AS (SELECT sample_id, pos, value + CASE WHEN pos % 2 = 0 THEN 0.5 ELSE -0.5 END AS v FROM curves), s AS (SELECT *, v - lag(v) OVER (PARTITION BY sample_id ORDER BY pos) AS d FROM bad),
x AS (SELECT sample_id, bool_or(v < 0 OR v > 100) AS out_of_range, coalesce(bool_or(d < -1e-9), false) AS decreasing, bool_or(pos = 10 AND abs(v - 100) > 1e-9 + 1e-3) AS open_end FROM s GROUP BY 1)
SELECT count(*) FILTER (out_of_range) AS out_of_range, count(*) FILTER (decreasing) AS decreasing, count(*) FILTER (open_end) AS open_end, count(*) AS curves FROM x""")
def curve_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.transform("cdf", lambda v, i: v + F.when(i % 2 == 0, 0.5).otherwise(-0.5))
    v = nation_curves(spark, sf_dir).select(C.violations(bad).alias("v"))
    return v.agg(*(F.count_if(F.col(f"v.{c}")).alias(c) for c in ("out_of_range", "decreasing", "open_end")), F.count("*").alias("curves"))


_AVGS = ", ".join(f"round(avg({c}), 6) AS f{i}" for i, c in enumerate(FEATURES))


@query(f"WITH {LINES} SELECT sample_id, {_AVGS} FROM lines GROUP BY 1")
def agg_photo_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.mean_by(observations(spark, sf_dir), ["sample_id"])
    return m.select("sample_id", *(r6(f"feature_{i}").alias(f"f{i}") for i in range(4)))


@query(f"WITH {LINES} SELECT sample_id, l_returnflag AS view, {_AVGS} FROM lines GROUP BY 1, 2")
def agg_view_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.mean_by(observations(spark, sf_dir), ["sample_id", "view"])
    return m.select("sample_id", "view", *(r6(f"feature_{i}").alias(f"f{i}") for i in range(4)))


@query(f"WITH {LINES}, v AS (SELECT sample_id, l_returnflag, {', '.join(f'avg({c}) AS {c}' for c in FEATURES)} FROM lines GROUP BY 1, 2) SELECT sample_id, {_AVGS} FROM v GROUP BY 1")
def agg_macro_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.macro_mean(observations(spark, sf_dir), ["sample_id"], "view")
    return m.select("sample_id", *(r6(f"feature_{i}").alias(f"f{i}") for i in range(4)))


@query(f"WITH {LINES}, n AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY sample_id) AS w FROM lines) SELECT l_returnflag AS view, round(sum(l_extendedprice * w) / sum(w), 6) AS feature_1 FROM n GROUP BY 1")
def agg_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = A.sample_weights(observations(spark, sf_dir), ["sample_id"])
    return A.weighted_mean(weighted, "weight", ["feature_1"], ["view"]).select("view", r6("feature_1").alias("feature_1"))


@query(f"WITH {LINES} SELECT sample_id, round(quantile_cont(l_extendedprice, 0.1), 6) AS q10, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.9), 6) AS q90 FROM lines GROUP BY 1")
def agg_exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = A.quantiles(observations(spark, sf_dir), "feature_1", [0.1, 0.5, 0.9], ["sample_id"])
    return q.select("sample_id", *(r6(c).alias(c) for c in ("q10", "q50", "q90")))


@query(f"WITH {LINES} SELECT sample_id, round(stddev_pop(l_extendedprice), 4) AS deviation, round(var_pop(l_discount), 6) AS variance, count(*) AS n FROM lines GROUP BY 1")
def agg_std_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("sample_id").agg(F.round(F.stddev_pop("feature_1"), 4).alias("deviation"), r6(F.var_pop("feature_2")).alias("variance"), F.count("*").alias("n"))


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, count(DISTINCT o_custkey) AS customers, count(*) AS n FROM orders GROUP BY 1")
def agg_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice", "o_custkey")
    out = orders.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.countDistinct("o_custkey").alias("customers"), F.count("*").alias("n"))
    middle = A.medians(orders, "o_totalprice", ["o_orderpriority"]).select("o_orderpriority", F.round("median", 4).alias("median"))
    return out.join(middle, "o_orderpriority").select("o_orderpriority", "mean", "median", "customers", "n")


@query(f"""WITH {LINES}, s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM lines) SELECT sample_id, round(sum((l_quantity - m) / d), 4) AS z, round(max((l_quantity - m) / d), 6) AS top FROM lines, s GROUP BY 1""")
def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = A.standardize(observations(spark, sf_dir).select("sample_id", "feature_0"), ["feature_0"])
    return z.groupBy("sample_id").agg(F.round(F.sum("feature_0"), 4).alias("z"), r6(F.max("feature_0")).alias("top"))


_ERRORS = f"""{CURVES}, mean AS (SELECT sample_id, pos, value, (sum(value) OVER (PARTITION BY pos) - value) / (count(*) OVER (PARTITION BY pos) - 1) AS p FROM curves),
med AS (SELECT a.sample_id, a.pos, any_value(a.value) AS value, median(b.value) AS p FROM curves a JOIN curves b ON a.pos = b.pos AND a.sample_id <> b.sample_id GROUP BY 1, 2),
em AS (SELECT sample_id, sum(abs(value - p) * width) AS e FROM mean JOIN {_W} USING (pos) GROUP BY 1), ed AS (SELECT sample_id, sum(abs(value - p) * width) AS e FROM med JOIN {_W} USING (pos) GROUP BY 1)"""


def _errors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    curves = nation_curves(spark, sf_dir)
    score = lambda df: df.select("sample_id", C.emd(F.col("cdf"), F.col("predicted")).alias("emd"))
    return score(A.loo_mean(curves)), score(A.loo_median(curves, "sample_id"))


@query(f"""WITH {_ERRORS} SELECT round(avg(d), 6) AS mean_improvement, count(*) FILTER (d > 1e-9) AS improved, count(*) AS samples, round((sum(d) - max(d)) / (count(*) - 1), 6) AS improvement_without_largest FROM (SELECT em.e - ed.e AS d FROM em JOIN ed USING (sample_id))""")
def screen_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean, median = _errors(spark, sf_dir)
    both = K.one_to_one(mean, median, ["sample_id"]).select(F.col("emd_left").alias("reference"), F.col("emd_right").alias("error"))
    return A.improvement(both).select(r6("mean_improvement").alias("mean_improvement"), "improved", "samples", r6("improvement_without_largest").alias("improvement_without_largest"))


@query(f"WITH {_ERRORS} SELECT sample_id, round(em.e, 6) AS emd_left, round(ed.e, 6) AS emd_right, round(em.e - ed.e, 6) AS emd_change FROM em FULL JOIN ed USING (sample_id)")
def align_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean, median = _errors(spark, sf_dir)
    return K.differences(mean, median, ["sample_id"], "emd").select("sample_id", *(r6(c).alias(c) for c in ("emd_left", "emd_right", "emd_change")))


@query("SELECT s_nationkey, arg_min(s_suppkey, (round(s_acctbal / 1000), -s_suppkey)) AS s_suppkey FROM supplier GROUP BY 1")
def best_by_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier with the least rounded balance of each nation; the larger key on ties."""
    df = read(spark, sf_dir, "supplier").withColumn("s", F.round(F.col("s_acctbal") / 1000))
    return A.best_by(df, ["s_nationkey"], "s", [-F.col("s_suppkey")], ["s_suppkey"]).select("s_nationkey", "s_suppkey")


@query("SELECT (SELECT count(*) FROM supplier) AS rows, 0::BIGINT AS null_keys, (SELECT count(*) FROM (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys")
def keys_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.keys_report(read(spark, sf_dir, "supplier"), ["s_nationkey"])


@query("SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS missing, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS extra")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.coverage_report(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1")
def align_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers that have both views."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    both = orders.where(F.col("o_orderstatus").isin("F", "O")).groupBy("o_custkey").agg(F.countDistinct("o_orderstatus").alias("v")).where("v = 2")
    return orders.join(both, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def align_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_anti")


def _flag_curves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    views = view_curves(spark, sf_dir)
    return [views.where(F.col("l_returnflag") == f).select("sample_id", "cdf") for f in ("A", "N", "R")]


@query(f"WITH {VIEWS} SELECT sample_id, pos::INT AS pos, round(avg(value), 6) AS value FROM views WHERE l_returnflag IN ('A', 'N') GROUP BY 1, 2 HAVING count(*) = 2")
def blend_mean2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_points(K.blend_mean(_flag_curves(spark, sf_dir)[:2], ["sample_id"]), ["sample_id"])


@query(f"WITH {VIEWS} SELECT sample_id, pos::INT AS pos, round(avg(value), 6) AS value FROM views GROUP BY 1, 2 HAVING count(*) = 3")
def blend_mean3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_points(K.blend_mean(_flag_curves(spark, sf_dir), ["sample_id"]), ["sample_id"])


@query(f"WITH {VIEWS} SELECT sample_id, pos::INT AS pos, round(median(value), 6) AS value FROM views GROUP BY 1, 2 HAVING count(*) = 3")
def blend_median3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_points(K.blend_median(_flag_curves(spark, sf_dir), ["sample_id"]), ["sample_id"])


@query(f"WITH {VIEWS} SELECT sample_id, pos::INT AS pos, round(avg(value), 6) AS value FROM views WHERE NOT (l_returnflag = 'R' AND sample_id < 'NATION_2') GROUP BY 1, 2 HAVING count(*) >= 2")
def blend_min_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _flag_curves(spark, sf_dir)
    parts[2] = parts[2].where("sample_id >= 'NATION_2'")
    return at_points(K.blend_mean(parts, ["sample_id"], least=2), ["sample_id"])


@query(f"WITH {VIEWS}, p AS (SELECT sample_id, pos, 0.25 * max(value) FILTER (l_returnflag = 'A') + 0.75 * max(value) FILTER (l_returnflag = 'R') AS value FROM views GROUP BY 1, 2) SELECT sample_id, pos::INT AS pos, round(value, 6) AS value FROM p WHERE value IS NOT NULL")
def blend_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _, r = _flag_curves(spark, sf_dir)
    both = K.one_to_one(a, r, ["sample_id"]).where("cdf_left is not null and cdf_right is not null")
    return at_points(both.select("sample_id", C.blend([F.col("cdf_left"), F.col("cdf_right")], [0.25, 0.75]).alias("cdf")), ["sample_id"])


@query("""WITH v(value, pos) AS (VALUES ('src1', 0), ('src', 1), ('src12', 2), ('fr', 3), ('99', 4)), h AS (SELECT doc_id, value, pos FROM documents JOIN v ON contains(lower(source || '_' || lang || '_' || doc_id), value))
SELECT d.doc_id, coalesce((SELECT arg_max(value, (length(value), -pos)) FROM h WHERE h.doc_id = d.doc_id), '') AS match FROM documents d""")
def match_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of source, language and id, against a list of values."""
    values = spark.createDataFrame([(v,) for v in ("src1", "src", "src12", "fr", "99")], "value string")
    names = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("_", "source", "lang", F.col("doc_id").cast("string")).alias("name"))
    return match.match_longest(names, "name", "doc_id", values.coalesce(1), "value").select("doc_id", "match")


@query("""WITH v(value) AS (VALUES ('src1'), ('12'), ('fr'), ('77')), n AS (SELECT doc_id, replace(source || lang || doc_id, '_', '') AS name FROM documents)
SELECT doc_id, count(value) AS n_matches, CASE WHEN count(value) = 1 THEN min(value) ELSE '' END AS match FROM n LEFT JOIN v ON contains(name, value) GROUP BY 1""")
def match_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = spark.createDataFrame([("src1",), ("12",), ("fr",), ("77",)], "value string")
    names = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("_", "source", "lang", F.col("doc_id").cast("string")).alias("name"))
    return match.match_all(names, "name", "doc_id", values, "value").select("doc_id", "n_matches", "match")


_NAMES = "n AS (SELECT doc_id, source || '_' || lang || '-' || doc_id || '_' || md5(text) AS name FROM documents), names AS (SELECT doc_id, lower(name) AS low, regexp_replace(lower(name), '[^\\p{L}\\p{N}]', '', 'g') AS norm FROM n)"
_VALUES = """v AS (SELECT p_partkey * 50 + i AS pos, CASE i WHEN 0 THEN 'SRC' || (p_partkey % 30) || '_' WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN '-' || (p_partkey % 97) || '_' ELSE substr(md5(p_partkey || ':' || i), 1, (5 + i % 3)::INT) END AS value FROM part, range(50) r(i)),
vals AS (SELECT pos, value, lower(value) AS low, regexp_replace(lower(value), '[^\\p{L}\\p{N}]', '', 'g') AS norm FROM v)"""


def _names_and_values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A name a document, of source, language, id and the digest of its text; fifty values a part, in the order of their positions."""
    names = read(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("_"), "lang", F.lit("-"), F.col("doc_id").cast("string"), F.lit("_"), F.md5(F.col("text").cast("binary"))).alias("name"))
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")  # a small file, of many values
    part = part.select("p_partkey", "p_name", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("i"))
    key, mark = F.col("p_partkey").cast("string"), F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit(":"), F.col("i").cast("string")).cast("binary"))
    value = F.when(F.col("i") == 0, F.concat(F.lit("SRC"), (F.col("p_partkey") % 30).cast("string"), F.lit("_"))).when(F.col("i") == 1, F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)))
    value = value.when(F.col("i") == 2, F.concat(F.lit("-"), (F.col("p_partkey") % 97).cast("string"), F.lit("_"))).otherwise(F.substring(mark, 1, 5 + F.col("i") % 3))
    return names, part.select((F.col("p_partkey") * 50 + F.col("i")).alias("pos"), value.alias("value"))


@query(f"WITH {_NAMES}, {_VALUES}, h AS (SELECT doc_id, value, pos FROM names JOIN vals ON contains(names.low, vals.low) OR contains(names.norm, vals.norm)) SELECT doc_id, coalesce(arg_max(value, (length(value), -pos)), '') AS match FROM names LEFT JOIN h USING (doc_id) GROUP BY 1")
def match_index_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest of many values in each name, by the substring index."""
    names, values = _names_and_values(spark, sf_dir)
    return match.match_longest(names, "name", "doc_id", values, "value", "pos").select("doc_id", "match")


@query(f"WITH {_NAMES}, {_VALUES}, h AS (SELECT doc_id, value FROM names JOIN vals ON contains(names.norm, vals.norm)) SELECT doc_id, count(value) AS n_matches, CASE WHEN count(value) = 1 THEN min(value) ELSE '' END AS match FROM names LEFT JOIN h USING (doc_id) GROUP BY 1")
def match_index_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, values = _names_and_values(spark, sf_dir)
    return match.match_all(names, "name", "doc_id", values, "value", "pos").select("doc_id", "n_matches", "match")


@query(r"""SELECT page_id, regexp_replace(replace(replace(replace(replace(lower(url), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g') AS token FROM pages""")
def normalize_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.normalize_token(F.col("url")).alias("token"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) = 1")
def first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return K.first_per(orders, ["o_custkey"], ["o_orderpriority", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INT AS rank FROM lineitem) WHERE rank <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return K.top_per(line, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 3).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query(f"WITH {_ERRORS} SELECT 'mean' AS experiment, sample_id, round(e, 6) AS emd FROM em UNION ALL SELECT 'median', sample_id, round(e, 6) FROM ed")
def union_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean, median = _errors(spark, sf_dir)
    return K.union_experiments({"mean": mean, "median": median}).select("experiment", "sample_id", r6("emd").alias("emd"))


@query("SELECT (SELECT count(*) FROM (SELECT n_regionkey FROM nation EXCEPT SELECT r_regionkey FROM region)) = 0 AND (SELECT count(*) FROM (SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation)) = 0 AS same")
def set_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.same_multiset(read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k")).distinct(), read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k")).distinct())


# embeddings as entities: their dimensions are features, the curve is made of the label
def encoded(spark: SparkSession, sf_dir: str, dims: int = DIMS) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    cdf = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.when(i == 10, 100.0).otherwise(F.least(F.lit(100.0), F.col("label") * 4.0 + i * 6.0)))
    return e.select(F.col("vec_id").alias("sample_id"), F.col("vec_id").alias("pos"), *(F.get("embedding", i).cast("double").alias(f"feature_{i}") for i in range(dims)), cdf.alias("cdf"))


_E = "e AS (SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS f{i}" for i in range(DIMS)) + " FROM embeddings)"
_DIST = " + ".join(f"power((q.f{i} - t.f{i}) / s{i}, 2)" for i in range(DIMS))
_SCALE = ", ".join(f"CASE WHEN stddev_pop(f{i}) < 1e-12 THEN 1 ELSE stddev_pop(f{i}) END AS s{i}" for i in range(DIMS))


# each row is a query against all others, whatever the dimensions
def encoded_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = read(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding"))).first()[0] or 0
    return encoded(spark, sf_dir, size)


@query(f"""WITH {_E}, s AS (SELECT {_SCALE} FROM e),
r AS (SELECT q.vec_id AS sample_id, t.vec_id AS neighbor, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, t.vec_id)::INT AS rank FROM e q, e t, s WHERE q.vec_id <> t.vec_id) SELECT * FROM r WHERE rank <= 3""")
def knn_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = encoded_whole(spark, sf_dir)
    return N.nearest(e, e, A.feature_columns(e), 3, exclude_self=True).select("sample_id", "neighbor", "rank")


@query(f"""WITH {_E}, s AS (SELECT {_SCALE} FROM e),
r AS (SELECT q.vec_id AS sample_id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, t.vec_id) AS rank FROM e q, e t, s WHERE q.vec_id <> t.vec_id)
SELECT sample_id, pos::INT AS pos, round(avg(CASE WHEN pos = 10 THEN 100 ELSE least(100, 4.0 * label + 6.0 * pos) END), 6) AS value FROM r, range(11) p(pos) WHERE rank <= 3 GROUP BY 1, 2""")
def knn_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = encoded_whole(spark, sf_dir)
    return at_points(N.mean_of_neighbors(N.nearest(e, e, A.feature_columns(e), 3, exclude_self=True), e), ["sample_id"])


@query(f"""WITH {_E}, tot AS (SELECT count(*) AS n, {', '.join(f'sum(f{i}) AS a{i}, sum(f{i} * f{i}) AS b{i}' for i in range(DIMS))} FROM e),
q AS (SELECT e.*, {', '.join(f'sqrt((b{i} - f{i} * f{i}) / (n - 1) - power((a{i} - f{i}) / (n - 1), 2)) AS s{i}' for i in range(DIMS))} FROM e, tot),
r AS (SELECT q.vec_id AS sample_id, q.label AS mine, t.label AS label, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, t.vec_id) AS rank FROM q, e t WHERE q.vec_id <> t.vec_id),
p AS (SELECT sample_id, k, pos, any_value(least(100, 4.0 * mine + 6.0 * pos)) AS v, avg(least(100, 4.0 * label + 6.0 * pos)) AS p FROM r, (VALUES (1), (3), (5), (7)) g(k), range(10) x(pos) WHERE rank <= k GROUP BY 1, 2, 3),
d AS (SELECT sample_id, k, sum(abs(v - p) * width) AS e FROM p JOIN {_W} USING (pos) GROUP BY 1, 2) SELECT k::INT AS k, round(avg(e), 6) AS emd FROM d GROUP BY 1""")
def knn_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = encoded_whole(spark, sf_dir)
    return N.loo_scores(e, A.feature_columns(e)).select(F.col("k").cast("int").alias("k"), r6("emd").alias("emd"))


_PART = "e AS (SELECT l_partkey, avg(l_quantity) AS f0, avg(l_extendedprice) AS f1, avg(l_discount) AS f2 FROM lineitem GROUP BY 1)"


@query(f"""WITH {_PART}, s AS (SELECT {', '.join(f'CASE WHEN stddev_pop(f{i}) < 1e-12 THEN 1 ELSE stddev_pop(f{i}) END AS s{i}' for i in range(3))} FROM e),
r AS (SELECT q.l_partkey, t.l_partkey AS neighbor, row_number() OVER (PARTITION BY q.l_partkey ORDER BY {' + '.join(f'power((q.f{i} - t.f{i}) / s{i}, 2)' for i in range(3))}, t.l_partkey)::INT AS rank FROM e q, e t, s WHERE q.l_partkey <> t.l_partkey)
SELECT * FROM r WHERE rank <= 3""")
def knn_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest parts by few features, most blocks of them pruned."""
    e = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(*(F.avg(c).alias(f"feature_{i}") for i, c in enumerate(FEATURES[:3]))).withColumn("pos", F.col("l_partkey"))
    return N.nearest(e, e, ["feature_0", "feature_1", "feature_2"], 3, "l_partkey", exclude_self=True, rows=500).select("l_partkey", "neighbor", "rank")


_SUP = "s AS (SELECT l_suppkey, avg(l_quantity) AS x, count(*) FILTER (l_extendedprice <= threshold) * 100.0::DOUBLE / count(*) AS y, pos FROM lineitem, " + _T + " GROUP BY 1, pos)"


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as entities: mean features and price curves."""
    line = read(spark, sf_dir, "lineitem").select("l_suppkey", *FEATURES)
    features = line.groupBy("l_suppkey").agg(*(F.avg(c).alias(f"feature_{i}") for i, c in enumerate(FEATURES)))
    return features.join(A.build_curves(line, "l_extendedprice", ["l_suppkey"], PRICES), "l_suppkey")


@query(f"""WITH {_SUP}, m AS (SELECT pos, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, count(*) AS n, covar_pop(x, y) AS c FROM s GROUP BY 1),
raw AS (SELECT l_suppkey, pos, greatest(0, least(100, my + (x - mx) / sx * (n * c / sx) / (n + 10))) AS v FROM s JOIN m USING (pos) WHERE pos < 10)
SELECT l_suppkey, pos::INT AS pos, round(max(v) OVER (PARTITION BY l_suppkey ORDER BY pos), 4) AS value FROM raw UNION ALL SELECT l_suppkey, 10, 100.0 FROM s WHERE pos = 10""")
def ridge_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = suppliers(spark, sf_dir)
    out = gram.ridge(df, df.select("l_suppkey", "feature_0"), ["feature_0"])
    return out.select("l_suppkey", F.posexplode("cdf").alias("pos", "v")).select("l_suppkey", F.col("pos").cast("int").alias("pos"), F.round("v", 4).alias("value"))


def _determinant(m: list[list[str]]) -> str:
    """SQL of a determinant, by its first row."""
    if len(m) == 1:
        return m[0][0]
    return "(" + " ".join(f"{'-' if j % 2 else '+'} {v} * {_determinant([row[:j] + row[j + 1 :] for row in m[1:]])}" for j, v in enumerate(m[0])) + ")"


_P = range(len(FEATURES))
_MATRIX = [[f"a{min(i, j)}{max(i, j)}" for j in _P] for i in _P]
#: The weights of a ridge of four features by Cramer's rule, from a00 to a33 and c0 to c3.
_SOLVED = ", ".join(f"{_determinant([[f'c{i}' if k == j else v for k, v in enumerate(row)] for i, row in enumerate(_MATRIX)])} / {_determinant(_MATRIX)} AS b{j}" for j in _P)
_NORMAL = ", ".join(f"n * v{i}{j} / (s{i} * s{j}) + {10 if i == j else 0} AS a{i}{j}" for i in _P for j in _P if i <= j) + ", " + ", ".join(f"n * w{i} / s{i} AS c{i}" for i in _P)
_GUESS = "greatest(0, least(100, my + " + " + ".join(f"(x{i} - m{i}) / s{i} * b{i}" for i in _P) + "))"
_POINTS = f"""f AS (SELECT l_suppkey, {', '.join(f'avg({c}) AS x{i}' for i, c in enumerate(FEATURES))} FROM lineitem GROUP BY 1), y AS (SELECT l_suppkey, pos, 100.0::DOUBLE * count(*) FILTER (l_extendedprice <= threshold) / count(*) AS y FROM lineitem, {_T} GROUP BY 1, 2), j AS (SELECT * FROM y JOIN f USING (l_suppkey) WHERE pos < 10)"""


@query(f"""WITH {_POINTS}, m AS (SELECT pos, count(*) AS n, avg(y) AS my, {', '.join(f'avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}, covar_pop(x{i}, y) AS w{i}' for i in _P)}, {', '.join(f'covar_pop(x{i}, x{j}) AS v{i}{j}' for i in _P for j in _P if i <= j)} FROM j GROUP BY 1),
a AS (SELECT *, {_NORMAL} FROM m), b AS (SELECT *, {_SOLVED} FROM a), g AS (SELECT l_suppkey, pos, {_GUESS} AS v FROM j JOIN b USING (pos))
SELECT l_suppkey, pos::INT AS pos, round(max(v) OVER (PARTITION BY l_suppkey ORDER BY pos), 6) AS value FROM g UNION ALL SELECT l_suppkey, 10, 100.0 FROM f""")
def ridge_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = suppliers(spark, sf_dir)
    return at_points(gram.ridge(df, df.drop("cdf"), A.feature_columns(df)).select("l_suppkey", "cdf"), ["l_suppkey"])


_SUMS = ", ".join(f"sum(x{i}) OVER w - x{i} AS t{i}, sum(x{i} * y) OVER w - x{i} * y AS u{i}" for i in _P) + ", " + ", ".join(f"sum(x{i} * x{j}) OVER w - x{i} * x{j} AS q{i}{j}" for i in _P for j in _P if i <= j)


@query(f"""WITH {_POINTS}, c AS (SELECT l_suppkey, pos, y - avg(y) OVER w AS y, avg(y) OVER w AS shift, {', '.join(f'x{i} - avg(x{i}) OVER w AS x{i}' for i in _P)} FROM j WINDOW w AS (PARTITION BY pos)),
t AS (SELECT *, count(*) OVER w - 1 AS n, sum(y) OVER w - y AS ty, {_SUMS} FROM c WINDOW w AS (PARTITION BY pos)),
m AS (SELECT *, ty / n AS my, {', '.join(f't{i} / n AS m{i}, sqrt(q{i}{i} / n - power(t{i} / n, 2)) AS s{i}, u{i} / n - t{i} * ty / n / n AS w{i}' for i in _P)}, {', '.join(f'q{i}{j} / n - t{i} * t{j} / n / n AS v{i}{j}' for i in _P for j in _P if i <= j)} FROM t),
a AS (SELECT *, {_NORMAL} FROM m), b AS (SELECT *, {_SOLVED} FROM a), g AS (SELECT l_suppkey, pos, y + shift AS y, {_GUESS.replace('my +', 'my + shift +')} AS v FROM b),
r AS (SELECT l_suppkey, pos, y, max(v) OVER (PARTITION BY l_suppkey ORDER BY pos) AS v FROM g) SELECT l_suppkey::VARCHAR AS l_suppkey, round(sum(abs(y - v) * width), 6) AS emd FROM r JOIN {_W} USING (pos) GROUP BY 1""")
def ridge_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = suppliers(spark, sf_dir)
    return gram.loo_ridge(df, "l_suppkey", A.feature_columns(df)).select("l_suppkey", r6("emd").alias("emd"))


@query(f"""WITH e AS (SELECT l_suppkey, avg(l_quantity) AS m, avg(l_quantity * l_quantity) AS g FROM lineitem GROUP BY 1), c AS (SELECT l_suppkey, pos, 100.0::DOUBLE * count(*) FILTER (l_extendedprice <= threshold) / count(*) AS y FROM lineitem, {_T} GROUP BY 1, 2),
t AS (SELECT l_suppkey, pos, y, m, count(*) OVER w - 1 AS n, sum(m) OVER w - m AS sm, sum(m * m) OVER w - m * m AS sq, sum(g) OVER w - g AS sg, sum(m * y) OVER w - m * y AS sc, sum(y) OVER w - y AS sy FROM c JOIN e USING (l_suppkey) WHERE pos < 10 WINDOW w AS (PARTITION BY pos)),
d AS (SELECT *, sqrt(sq / n - power(sm / n, 2)) AS s FROM t), q AS (SELECT l_suppkey, '' AS view, avg(l_quantity) AS q FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, l_returnflag, avg(l_quantity) FROM lineitem GROUP BY 1, 2),
p AS (SELECT l_suppkey, view, pos, y, greatest(0, least(100, sy / n + (q - sm / n) / s * ((sc - sm * sy / n) / s) / ((sg - sm * sm / n) / (s * s) + 10))) AS v FROM d JOIN q USING (l_suppkey)),
r AS (SELECT l_suppkey, view, pos, y, max(v) OVER (PARTITION BY l_suppkey, view ORDER BY pos) AS v FROM p) SELECT l_suppkey, view, round(sum(abs(y - v) * width), 4) AS emd FROM r JOIN {_W} USING (pos) GROUP BY 1, 2""")
def ridge_entities_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, and their views by return flag, predicted by a ridge on the order lines of all other suppliers, every supplier weighing one."""
    line = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    out = gram.loo_entity_ridge(line, A.build_curves(line, "l_extendedprice", ["l_suppkey"], PRICES), "l_suppkey", ["l_quantity"], view="l_returnflag")
    return out.select(F.col("l_suppkey").cast("long").alias("l_suppkey"), F.coalesce("l_returnflag", F.lit("")).alias("view"), F.round("emd", 4).alias("emd"))


_TRUTH = f"""t AS (SELECT c.sample_id, pos, value, width FROM curves c JOIN {_W} USING (pos)),
rows AS (SELECT sample_id, '' AS view FROM curves GROUP BY 1 UNION ALL SELECT sample_id, l_returnflag FROM lines GROUP BY 1, 2)"""
_MEANS = ", ".join(f"avg({c}) AS x{i}" for i, c in enumerate(FEATURES))


def _fold_knn(*groups: tuple[int, ...]) -> str:
    """SQL of leave-one-out 3-NN, averaged over groups of features."""
    scale = ", ".join(f"CASE WHEN stddev_pop(b.x{i}) < 1e-12 THEN 1 ELSE stddev_pop(b.x{i}) END AS s{i}" for i in range(4))
    parts = " UNION ALL ".join(f"SELECT q.sample_id, q.view, {g} AS g, f.sample_id AS near, row_number() OVER (PARTITION BY q.sample_id, q.view ORDER BY {' + '.join(f'power((q.x{i} - f.x{i}) / s{i}, 2)' for i in group)}, f.sample_id) AS rank FROM q JOIN s USING (sample_id) JOIN f ON f.sample_id <> q.sample_id" for g, group in enumerate(groups))
    return f"""WITH {CURVES}, {_TRUTH}, f AS (SELECT sample_id, {_MEANS} FROM lines GROUP BY 1), q AS (SELECT sample_id, '' AS view, x0, x1, x2, x3 FROM f UNION ALL SELECT sample_id, l_returnflag, {_MEANS} FROM lines GROUP BY 1, 2),
s AS (SELECT a.sample_id, {scale} FROM f a JOIN f b ON a.sample_id <> b.sample_id GROUP BY 1), r AS ({parts}),
p AS (SELECT r.sample_id, r.view, c.pos, avg(c.value) AS p FROM r JOIN curves c ON c.sample_id = near WHERE rank <= 3 GROUP BY 1, 2, 3)
SELECT sample_id, view, 'null' AS setting, round(sum(abs(value - p) * width), 6) AS emd FROM p JOIN t USING (sample_id, pos) WHERE pos < 10 GROUP BY 1, 2"""


def _fold_center(how: str) -> str:
    """SQL of leave-one-out means or medians; every view of a sample gets the same curve."""
    return f"""WITH {CURVES}, {_TRUTH}, p AS (SELECT a.sample_id, a.pos, {how}(b.value) AS p FROM curves a JOIN curves b ON a.pos = b.pos AND a.sample_id <> b.sample_id GROUP BY 1, 2),
e AS (SELECT sample_id, round(sum(abs(value - p) * width), 6) AS emd FROM p JOIN t USING (sample_id, pos) WHERE pos < 10 GROUP BY 1) SELECT sample_id, view, 'null' AS setting, emd FROM rows JOIN e USING (sample_id)"""


_sql |= {"folds_mean": _fold_center("avg"), "folds_median": _fold_center("median"), "folds_knn": _fold_knn((0, 1, 2, 3)), "folds_crop_ensemble": _fold_knn((0, 1), (2, 3))}


def _centred(name: str, source: str, of: tuple[int, ...]) -> str:
    over = "OVER (PARTITION BY pos)"
    return f"{name}c AS (SELECT sample_id, pos, y - avg(y) {over} AS y, avg(y) {over} AS h, {', '.join(f'x{i} - avg(x{i}) {over} AS x{i}, avg(x{i}) {over} AS h{i}' for i in of)} FROM {source})"


def _layers(name: str, source: str, of: tuple[int, ...], alpha: str = "10") -> str:
    """SQL of ridges of features `of` from sums (n, ty, t, u, q): means m, deviations s and weights b of each row's fold."""
    pairs = [(i, j) for i in of for j in of if i <= j]
    at = {k: i for i, k in enumerate(of)}
    matrix = [[f"a{min(i, j)}{max(i, j)}" for j in of] for i in of]
    weights = ", ".join(f"{_determinant([[f'c{i}' if k == at[j] else v for k, v in enumerate(row)] for i, row in zip(of, matrix)])} / {_determinant(matrix)} AS b{j}" for j in of)
    return f"""{name}m AS (SELECT *, ty / n AS my, {', '.join(f't{i} / n AS m{i}, sqrt(q{i}{i} / n - power(t{i} / n, 2)) AS s{i}, u{i} / n - t{i} * ty / n / n AS w{i}' for i in of)}, {', '.join(f'q{i}{j} / n - t{i} * t{j} / n / n AS v{i}{j}' for i, j in pairs)} FROM {source}),
{name}a AS (SELECT *, {', '.join(f'n * v{i}{j} / (s{i} * s{j}) + {alpha if i == j else 0} AS a{i}{j}' for i, j in pairs)}, {', '.join(f'n * w{i} / s{i} AS c{i}' for i in of)} FROM {name}m),
{name}b AS (SELECT *, {weights} FROM {name}a)"""


def _loo_sums(name: str, of: tuple[int, ...]) -> str:
    over = "OVER (PARTITION BY pos)"
    pairs = [(i, j) for i in of for j in of if i <= j]
    return f"{name}t AS (SELECT *, count(*) {over} - 1 AS n, sum(y) {over} - y AS ty, {', '.join(f'sum(x{i}) {over} - x{i} AS t{i}, sum(x{i} * y) {over} - x{i} * y AS u{i}' for i in of)}, {', '.join(f'sum(x{i} * x{j}) {over} - x{i} * x{j} AS q{i}{j}' for i, j in pairs)} FROM {name}c)"


def _asked_guess(of: tuple[int, ...]) -> str:
    return "my + h + " + " + ".join(f"(z{i} - h{i} - m{i}) / s{i} * b{i}" for i in of)


def _loo_weights(name: str, source: str, of: tuple[int, ...]) -> str:
    """SQL of the leave-one-out ridges of features `of` in a table (sample_id, pos, y, x0 ...), and of what they say to `asked`."""
    return f"{_centred(name, source, of)}, {_loo_sums(name, of)}, {_layers(name, f'{name}t', of)}, {name}g AS (SELECT sample_id, view, pos, {_asked_guess(of)} AS v FROM {name}b JOIN asked USING (sample_id))"


_ASKED = f"""f AS (SELECT sample_id, {_MEANS} FROM lines GROUP BY 1), asked AS (SELECT sample_id, '' AS view, x0 AS z0, x1 AS z1, x2 AS z2, x3 AS z3 FROM f UNION ALL SELECT sample_id, l_returnflag, {', '.join(f'avg({c})' for c in FEATURES)} FROM lines GROUP BY 1, 2),
j AS (SELECT sample_id, pos, value AS y, x0, x1, x2, x3 FROM curves JOIN f USING (sample_id) WHERE pos < 10)"""
_CLOSED = "max(greatest(0, least(100, v))) OVER (PARTITION BY sample_id, view ORDER BY pos)"
_SCORED = f"SELECT sample_id, view, 'null' AS setting, round(sum(abs(value - v) * width), 6) AS emd FROM r JOIN t USING (sample_id, pos) WHERE pos < 10 GROUP BY 1, 2"
_TARGETS = f"t AS (SELECT c.sample_id, pos, value, width FROM curves c JOIN {_W} USING (pos))"
_sql |= {
    "folds_ridge": f"WITH {CURVES}, {_TARGETS}, {_ASKED}, {_loo_weights('k', 'j', (0, 1, 2, 3))}, r AS (SELECT sample_id, view, pos, {_CLOSED} AS v FROM kg) {_SCORED}",
    "folds_two_group": f"WITH {CURVES}, {_TARGETS}, {_ASKED}, {_loo_weights('k', 'j', (0, 1))}, {_loo_weights('l', 'j', (2, 3))}, p AS (SELECT sample_id, view, pos, {_CLOSED} AS v FROM kg UNION ALL SELECT sample_id, view, pos, {_CLOSED} FROM lg), r AS (SELECT sample_id, view, pos, avg(v) AS v FROM p GROUP BY 1, 2, 3) {_SCORED}",
    "folds_sqrt_mass_ridge": f"""WITH {CURVES}, {_TARGETS}, {_ASKED}, roots AS (SELECT sample_id, pos, sqrt(greatest(0, (value - coalesce(lag(value) OVER (PARTITION BY sample_id ORDER BY pos), 0)) / 100)) AS y, x0, x1, x2, x3 FROM curves JOIN f USING (sample_id)),
{_loo_weights('k', 'roots', (0, 1, 2, 3))}, r AS (SELECT sample_id, view, pos, least(100, 100 * sum(power(greatest(v, 0), 2)) OVER (PARTITION BY sample_id, view ORDER BY pos) / sum(power(greatest(v, 0), 2)) OVER (PARTITION BY sample_id, view)) AS v FROM kg) {_SCORED}""",
}


_ALL = (0, 1, 2, 3)
_BOTH = [(i, j) for i in _ALL for j in _ALL if i <= j]
_sql["nested_ridge"] = f"""WITH {CURVES}, {_TARGETS}, {_ASKED}, alphas(alpha) AS (VALUES (10.0::DOUBLE), (100.0), (1000.0)), {_centred('k', 'j', _ALL)}, {_loo_sums('k', _ALL)},
total AS (SELECT pos, count(*) AS n, sum(y) AS ty, {', '.join(f'sum(x{i}) AS t{i}, sum(x{i} * y) AS u{i}' for i in _ALL)}, {', '.join(f'sum(x{i} * x{j}) AS q{i}{j}' for i, j in _BOTH)} FROM kc GROUP BY 1),
two AS (SELECT a.sample_id AS outer_id, b.sample_id, a.pos, alpha, b.y AS truth, b.h, {', '.join(f'b.x{i} AS x{i}' for i in _ALL)}, n - 2 AS n, ty - a.y - b.y AS ty, {', '.join(f't{i} - a.x{i} - b.x{i} AS t{i}, u{i} - a.x{i} * a.y - b.x{i} * b.y AS u{i}' for i in _ALL)}, {', '.join(f'q{i}{j} - a.x{i} * a.x{j} - b.x{i} * b.x{j} AS q{i}{j}' for i, j in _BOTH)}
FROM kc a JOIN kc b ON a.pos = b.pos AND a.sample_id <> b.sample_id JOIN total ON total.pos = a.pos, alphas), {_layers('p', 'two', _ALL, 'alpha')},
inner_v AS (SELECT outer_id, sample_id, alpha, pos, truth + h AS truth, max(greatest(0, least(100, my + h + {' + '.join(f'(x{i} - m{i}) / s{i} * b{i}' for i in _ALL)}))) OVER (PARTITION BY outer_id, sample_id, alpha ORDER BY pos) AS v FROM pb),
inner_e AS (SELECT outer_id, sample_id, alpha, sum(abs(truth - v) * width) AS e FROM inner_v JOIN {_W} USING (pos) GROUP BY 1, 2, 3), chosen AS (SELECT outer_id AS sample_id, arg_min(alpha, (e, -alpha)) AS alpha FROM (SELECT outer_id, alpha, avg(e) AS e FROM inner_e GROUP BY 1, 2) GROUP BY 1),
o AS (SELECT kt.*, alpha FROM kt JOIN chosen USING (sample_id)), {_layers('o', 'o', _ALL, 'alpha')}, g AS (SELECT sample_id, alpha, view, pos, {_asked_guess(_ALL)} AS v FROM ob JOIN asked USING (sample_id)), r AS (SELECT sample_id, alpha, view, pos, {_CLOSED} AS v FROM g)
SELECT sample_id, view, alpha::VARCHAR AS setting, round(sum(abs(value - v) * width), 6) AS emd FROM r JOIN t USING (sample_id, pos) WHERE pos < 10 GROUP BY 1, 2, 3"""


def _linear_query(name: str, predict) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = predict(observations(spark, sf_dir), nation_curves(spark, sf_dir), "sample_id", "view")
        setting = F.col("setting") if "setting" in out.columns else F.lit("null")
        return out.select("sample_id", F.coalesce("view", F.lit("")).alias("view"), setting.alias("setting"), r6("emd").alias("emd"))

    run.__name__ = name
    _queries[name] = run


for _name, _args in {
    "folds_ridge": (linear.ridge(),), "folds_ridge_pca": (linear.ridge(components=2),), "folds_pls": (linear.partial_least_squares(2),), "folds_transport_ridge": (linear.ridge(), linear.QUANTILE_FORM),
    "folds_sqrt_mass_ridge": (linear.ridge(), linear.ROOT_FORM), "folds_weibull_ridge": (linear.ridge(), linear.WEIBULL_FORM),
}.items():
    _linear_query(_name, lambda o, c, k, v, args=_args: linear.leave_one_out(o, c, k, v, *args))
_linear_query("nested_ridge", lambda o, c, k, v: linear.nested(o, c, k, v, [(repr(a), linear.ridge(a)) for a in sorted(models.RIDGE_ALPHAS, reverse=True)]))
_linear_query("nested_pls", lambda o, c, k, v: linear.nested(o, c, k, v, [(str(n), linear.partial_least_squares(n)) for n in sorted(models.PLS_PARTS)], least=6))
_linear_query("folds_two_group", lambda o, c, k, v: linear.two_groups(o, c, k, v, 2))


def _fold_query(name: str, predictor=None, selector: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = folds.leave_one_out(observations(spark, sf_dir), nation_curves(spark, sf_dir), "sample_id", "view", predictor, selector)
        return out.select("sample_id", F.coalesce("view", F.lit("")).alias("view"), "setting", r6("emd").alias("emd"))

    run.__name__ = name
    _queries[name] = run


for _name, _p in {
    "folds_mean": models.mean, "folds_median": models.median, "folds_knn": models.knn,
    "folds_kernel_ridge": models.kernel_ridge, "folds_svr": models.svr, "folds_median_regression": models.median_regression, "folds_crop_ensemble": models.ensemble_knn(3, (2, 2)),
}.items():
    _fold_query(_name, _p)
for _name in ("neighbors", "kernel", "svr"):
    _fold_query(f"nested_{_name}", selector=_name)


def _scales(alias: str) -> str:
    return ", ".join(f"CASE WHEN stddev_pop({alias}.x{i}) < 1e-12 THEN 1 ELSE stddev_pop({alias}.x{i}) END AS s{i}" for i in _ALL)


_NEAR = " + ".join(f"power((q.x{i} - n.x{i}) / s{i}, 2)" for i in _ALL)
_sql["nested_neighbors"] = f"""WITH {CURVES}, {_TARGETS}, f AS (SELECT sample_id, {_MEANS} FROM lines GROUP BY 1), asked AS (SELECT sample_id, '' AS view, x0, x1, x2, x3 FROM f UNION ALL SELECT sample_id, l_returnflag, {_MEANS} FROM lines GROUP BY 1, 2), counts(k) AS (VALUES (1), (3), (5), (7)),
two AS (SELECT a.sample_id AS i, b.sample_id AS j, {_scales('n')} FROM f a JOIN f b ON a.sample_id <> b.sample_id JOIN f n ON n.sample_id <> a.sample_id AND n.sample_id <> b.sample_id GROUP BY 1, 2),
met AS (SELECT i, j, n.sample_id AS near, row_number() OVER (PARTITION BY i, j ORDER BY {_NEAR}, n.sample_id) AS rank FROM two JOIN f q ON q.sample_id = j JOIN f n ON n.sample_id <> i AND n.sample_id <> j),
inner_v AS (SELECT i, j, k, c.pos, avg(c.value) AS v FROM met JOIN counts ON rank <= k JOIN curves c ON c.sample_id = near GROUP BY 1, 2, 3, 4), inner_e AS (SELECT i, j, k, sum(abs(t.value - v) * width) AS e FROM inner_v JOIN t ON t.sample_id = j AND t.pos = inner_v.pos WHERE t.pos < 10 GROUP BY 1, 2, 3),
chosen AS (SELECT i, arg_min(k, (e, -k)) AS k FROM (SELECT i, k, avg(e) AS e FROM inner_e GROUP BY 1, 2) GROUP BY 1), one AS (SELECT a.sample_id AS i, {_scales('n')} FROM f a JOIN f n ON n.sample_id <> a.sample_id GROUP BY 1),
last AS (SELECT i, q.view, n.sample_id AS near, row_number() OVER (PARTITION BY i, q.view ORDER BY {_NEAR}, n.sample_id) AS rank FROM one JOIN asked q ON q.sample_id = i JOIN f n ON n.sample_id <> i),
v AS (SELECT i AS sample_id, view, k, c.pos, avg(c.value) AS v FROM last JOIN chosen USING (i) JOIN curves c ON c.sample_id = near WHERE rank <= k GROUP BY 1, 2, 3, 4)
SELECT sample_id, view, k::VARCHAR AS setting, round(sum(abs(value - v) * width), 6) AS emd FROM v JOIN t USING (sample_id, pos) WHERE pos < 10 GROUP BY 1, 2, 3"""
_TRANSFER = """SELECT a.sample_id, a.train_view || ' -> ' || a.query_view AS direction, round(a.emd, 6) AS transfer_emd, round(b.emd, 6) AS control_emd, round(a.emd - b.emd, 6) AS transfer_minus_control_emd, round(a.fine - b.fine, 6) AS transfer_minus_control_fine_emd
FROM e a JOIN e b ON a.sample_id = b.sample_id AND a.train_view = b.train_view WHERE a.query_view <> a.train_view AND b.query_view = b.train_view"""
_sql["camera_transfer"] = f"""WITH {CURVES}, {_TARGETS}, paired AS (SELECT sample_id FROM lines WHERE l_returnflag IN ('A', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2), f AS (SELECT sample_id, l_returnflag AS view, {_MEANS} FROM lines JOIN paired USING (sample_id) WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2),
one AS (SELECT a.sample_id AS i, n.view AS train_view, {_scales('n')} FROM paired a JOIN f n ON n.sample_id <> a.sample_id GROUP BY 1, 2),
met AS (SELECT i, train_view, q.view AS query_view, n.sample_id AS near, row_number() OVER (PARTITION BY i, train_view, q.view ORDER BY {_NEAR}, n.sample_id) AS rank FROM one JOIN f q ON q.sample_id = i JOIN f n ON n.view = train_view AND n.sample_id <> i),
v AS (SELECT i AS sample_id, train_view, query_view, c.pos, avg(c.value) AS v FROM met JOIN curves c ON c.sample_id = near WHERE rank <= 3 GROUP BY 1, 2, 3, 4),
e AS (SELECT train_view, query_view, sample_id, sum(abs(value - v) * width) AS emd, sum(abs(value - v) * width) FILTER (pos < 4) AS fine FROM v JOIN t USING (sample_id, pos) WHERE pos < 10 GROUP BY 1, 2, 3) {_TRANSFER}"""
_SIDES = ", ".join(f"f{v} AS (SELECT sample_id, {_MEANS} FROM lines JOIN paired USING (sample_id) WHERE l_returnflag = '{v}' GROUP BY 1), j{v} AS (SELECT sample_id, pos, value AS y, x0, x1, x2, x3 FROM curves JOIN f{v} USING (sample_id) WHERE pos < 10)" for v in "AR")


@query(f"""WITH {CURVES}, {_TARGETS}, paired AS (SELECT sample_id FROM lines WHERE l_returnflag IN ('A', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2), {_SIDES},
asked AS (SELECT sample_id, 'A' AS view, x0 AS z0, x1 AS z1, x2 AS z2, x3 AS z3 FROM fA UNION ALL SELECT sample_id, 'R', x0, x1, x2, x3 FROM fR), {_loo_weights('ka', 'jA', (0, 1, 2, 3))}, {_loo_weights('kr', 'jR', (0, 1, 2, 3))},
p AS (SELECT 'A' AS train_view, sample_id, view, pos, {_CLOSED} AS v FROM kag UNION ALL SELECT 'R', sample_id, view, pos, {_CLOSED} FROM krg),
e AS (SELECT train_view, view AS query_view, sample_id, sum(abs(value - v) * width) AS emd, sum(abs(value - v) * width) FILTER (pos < 4) AS fine FROM p JOIN t USING (sample_id, pos) GROUP BY 1, 2, 3) {_TRANSFER}""")
def camera_transfer_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ridge trained on one view of the other samples, asked for both views of the one held out."""
    out = linear.view_transfer(observations(spark, sf_dir), nation_curves(spark, sf_dir), "sample_id", "view", ("A", "R"), linear.ridge())
    return linear.transfer_pairs(out, "sample_id").select("sample_id", "direction", *(r6(c).alias(c) for c in ("transfer_emd", "control_emd", "transfer_minus_control_emd", "transfer_minus_control_fine_emd")))


def camera_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folds.view_transfer(observations(spark, sf_dir), nation_curves(spark, sf_dir), "sample_id", "view", ("A", "R"), models.knn)
    return linear.transfer_pairs(out, "sample_id").select("sample_id", "direction", *(r6(c).alias(c) for c in ("transfer_emd", "control_emd", "transfer_minus_control_emd", "transfer_minus_control_fine_emd")))


_queries["camera_transfer"] = camera_transfer


@query(f"""WITH {LINES}, c AS (SELECT sample_id, l_returnflag, count(*) AS n FROM lines WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2), p AS (SELECT sample_id FROM c GROUP BY 1 HAVING count(*) = 2)
SELECT a.sample_id, a.l_returnflag AS train_view, b.l_returnflag AS query_view, b.n AS query_rows FROM c a JOIN c b USING (sample_id) WHERE sample_id IN (SELECT sample_id FROM p)""")
def camera_transfer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folds.view_transfer(observations(spark, sf_dir), nation_curves(spark, sf_dir), "sample_id", "view", ("A", "R"), models.mean)
    return out.select("sample_id", "train_view", "query_view", "query_rows")


@query("""WITH p AS (SELECT (l_orderkey % 97)::INT AS y, (l_partkey % 89)::INT AS x, min(l_suppkey % 13)::INT AS label FROM lineitem GROUP BY 1, 2), f AS (SELECT min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM p)
SELECT label AS region_id, count(*) AS area_pixels, round(count(*) / 4.0, 6) AS area_mm2, round(2 * sqrt(count(*) / 4.0 / pi()), 6) AS diameter_mm, bool_or(y = y0 OR y = y1 OR x = x0 OR x = x1) AS touches_border FROM p, f WHERE label > 0 GROUP BY 1""")
def region_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    pixels = line.groupBy((F.col("l_orderkey") % 97).cast("int").alias("y"), (F.col("l_partkey") % 89).cast("int").alias("x")).agg(F.min(F.col("l_suppkey") % 13).cast("int").alias("label"))
    return A.regions(pixels, 2.0).select("region_id", "area_pixels", r6("area_mm2").alias("area_mm2"), r6("diameter_mm").alias("diameter_mm"), "touches_border")


#: Sides of the images that order lines are dealt to for flooding, one an order status.
TALL, WIDE = 15, 19
_PIX = f"""cells AS (SELECT o_orderstatus AS image, (l_orderkey % {TALL})::INT AS y, (l_partkey % {WIDE})::INT AS x, (sum(l_extendedprice)::DECIMAL(38, 2) / 100)::BIGINT % 1000 AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
p AS (SELECT image, y, x, coalesce(v, 0) AS v FROM (SELECT DISTINCT image FROM cells) CROSS JOIN (SELECT y::INT AS y FROM range({TALL}) a(y)) CROSS JOIN (SELECT x::INT AS x FROM range({WIDE}) b(x)) LEFT JOIN cells USING (image, y, x)),
lim AS (SELECT image, quantile_cont(v, 0.4) AS lim FROM p GROUP BY 1), inn AS (SELECT p.*, v <= lim AS inner_ FROM p JOIN lim USING (image)),
disk(dy, dx) AS (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)),
ero AS (SELECT a.image, a.y, a.x, count(b.v) = 5 AS stays FROM inn a, disk LEFT JOIN inn b ON b.image = a.image AND b.y = a.y + dy AND b.x = a.x + dx AND b.inner_ GROUP BY 1, 2, 3),
op AS (SELECT a.image, a.y, a.x, count(b.image) > 0 AS inner_ FROM ero a, disk LEFT JOIN ero b ON b.image = a.image AND b.y = a.y + dy AND b.x = a.x + dx AND b.stays GROUP BY 1, 2, 3)"""


def _opened_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, y, x, value, inner): order lines dealt to pixels by status; inner is the opened lower part of the values."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    line = line.join(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("image")), F.col("l_orderkey") == F.col("o_orderkey"))
    at = line.groupBy("image", (F.col("l_orderkey") % TALL).cast("int").alias("y"), (F.col("l_partkey") % WIDE).cast("int").alias("x")).agg((F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(38,2)") / 100).alias("s"))
    cells = written(at.select("image", "y", "x", (F.round("s", 0).cast("long") % 1000).alias("value")))
    sides = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c) for c, n in (("y", TALL), ("x", WIDE))]
    grid = cells.select("image").distinct().select("image", sides[0]).select("image", "y", sides[1])
    pixels = written(grid.join(cells, ["image", "y", "x"], "left").select("image", "y", "x", F.coalesce("value", F.lit(0)).alias("value")))
    calm = particles.calm(pixels.withColumnRenamed("value", "gradient"), 0.4).withColumnRenamed("gradient", "value")
    return written(pixels.join(particles.opened(calm, 1.0), ["image", "y", "x"]))


@query(f"""WITH RECURSIVE {_PIX}, n AS (SELECT image, y * {WIDE} + x AS id, y, x FROM op WHERE inner_),
reach(image, id, root) AS (SELECT image, id, id FROM n UNION SELECT r.image, b.id, r.root FROM reach r JOIN n a ON a.image = r.image AND a.id = r.id JOIN n b ON b.image = a.image AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
roots AS (SELECT image, id, min(root) AS root FROM reach GROUP BY 1, 2)
SELECT op.image, op.y, op.x, coalesce(dense_rank, 0) AS seed FROM op LEFT JOIN (SELECT image, id, dense_rank() OVER (PARTITION BY image ORDER BY root) AS dense_rank FROM roots) s ON s.image = op.image AND s.id = op.y * {WIDE} + op.x""")
def region_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opened calm areas of images, connected and numbered."""
    return particles.seeds(_opened_pixels(spark, sf_dir))


@query(f"""WITH RECURSIVE {_PIX}, n AS (SELECT image, y * {WIDE} + x AS id, y, x FROM op WHERE inner_),
reach(image, id, root) AS (SELECT image, id, id FROM n UNION SELECT r.image, b.id, r.root FROM reach r JOIN n a ON a.image = r.image AND a.id = r.id JOIN n b ON b.image = a.image AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
seeds AS (SELECT image, id, dense_rank() OVER (PARTITION BY image ORDER BY root) AS seed FROM (SELECT image, id, min(root) AS root FROM reach GROUP BY 1, 2)),
arcs AS (SELECT image, a, b, row_number() OVER (PARTITION BY image ORDER BY rise, a, b) AS i FROM (SELECT p.image, p.y * {WIDE} + p.x AS a, q.y * {WIDE} + q.x AS b, abs(p.v - q.v) AS rise FROM p JOIN p q ON q.image = p.image AND (q.y = p.y AND q.x = p.x + 1 OR q.y = p.y + 1 AND abs(q.x - p.x) <= 1))),
first AS (SELECT p.image, list(coalesce(seed, -1 - (p.y * {WIDE} + p.x)) ORDER BY p.y * {WIDE} + p.x) AS part FROM p LEFT JOIN seeds s ON s.image = p.image AND s.id = p.y * {WIDE} + p.x GROUP BY 1),
steps(image, i, part) AS (SELECT image, 0::BIGINT, part FROM first UNION ALL SELECT s.image, arcs.i, CASE WHEN part[a + 1] = part[b + 1] OR (part[a + 1] > 0 AND part[b + 1] > 0) THEN part
ELSE list_transform(part, lambda c: CASE WHEN c = least(part[a + 1], part[b + 1]) THEN greatest(part[a + 1], part[b + 1]) ELSE c END) END FROM steps s JOIN arcs ON arcs.image = s.image AND arcs.i = s.i + 1),
last AS (SELECT image, arg_max(part, i) AS part FROM steps GROUP BY 1), lab AS (SELECT image, unnest(range(len(part))) AS id, greatest(unnest(part), 0) AS label FROM last),
f AS (SELECT image, id // {WIDE} AS y, id % {WIDE} AS x, label FROM lab)
SELECT image, label AS region_id, count(*) AS area_pixels, round(count(*) / 4.0, 6) AS area_mm2, round(2 * sqrt(count(*) / 4.0 / pi()), 6) AS diameter_mm, bool_or(y = 0 OR y = {TALL - 1} OR x = 0 OR x = {WIDE - 1}) AS touches_border FROM f WHERE label > 0 GROUP BY 1, 2""")
def region_flooding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of images without labels: seeds flooded over the least rises, and measured."""
    pixels = _opened_pixels(spark, sf_dir)
    marked = particles.seeds(pixels)
    labels = particles.flooded(pixels.select("image", "y", "x", F.col("value").alias("elevation")).join(marked, ["image", "y", "x"]))
    return A.regions(labels, 2.0, ["image"]).select("image", "region_id", "area_pixels", r6("area_mm2").alias("area_mm2"), r6("diameter_mm").alias("diameter_mm"), "touches_border")


@query("SELECT b.bin, count(e.event_id) AS n FROM range(40) b(bin) LEFT JOIN events e ON floor(e.value / 10)::BIGINT = b.bin GROUP BY 1")
def histogram_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = read(spark, sf_dir, "events").select(F.floor(F.col("value") / 10).alias("bin"))
    return A.histogram(bins, "bin", 40)


@query("""WITH w AS (SELECT conv_id, turn, length(text) AS tokens, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_before FROM conversations)
SELECT conv_id, turn, spent_before, spent_before < 400 AS allowed FROM w""")
def ledger_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").alias("tokens"))
    return ledger.budgeted(turns, ["conv_id"], ["turn"], "tokens", 400).select("conv_id", "turn", "spent_before", "allowed")


@query("""WITH w AS (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_before FROM conversations)
SELECT conv_id, turn, spent_before, spent_before < 400 AS allowed FROM w""")
def ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ledger_budget from a stream that is cut off after its first turns and goes on from its checkpoint, with some turns sent again."""
    work = folder(spark)
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").cast("long").alias("number"), F.lit("").alias("key"), F.char_length("text").alias("tokens"), F.lit("complete").alias("state"))
    for part in ("number < 2", "number between 1 and 3", "number > 3"):
        turns.where(part).write.mode("append").parquet(f"{work}/in")
        requests = spark.readStream.schema(turns.schema).parquet(f"{work}/in")
        stream_ledger.settle(requests, 400, f"{work}/out", f"{work}/checkpoint")
    done = spark.read.parquet(f"{work}/out").where(F.col("outcome") != stream_ledger.REPEATED)
    return done.select(F.col("run").alias("conv_id"), F.col("number").alias("turn"), "spent_before", (F.col("outcome") == stream_ledger.ALLOWED).alias("allowed"))


@query("""WITH w AS (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM conversations)
SELECT conv_id, min(turn) AS turn, arg_min(s, turn) AS spent_before FROM w WHERE s >= 400 GROUP BY 1""")
def ledger_first_breach(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").alias("tokens"))
    return ledger.first_breach(turns, ["conv_id"], ["turn"], "tokens", 400)


@query("SELECT event_type, count(*) AS events, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS input_tokens, count(*) FILTER (event_type NOT IN ('click', 'view')) AS foreign_items FROM events GROUP BY 1")
def events_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_type", F.struct(F.get_json_object("props", "$.k").try_cast("long").alias("input_tokens"), F.lit(0).alias("output_tokens")).alias("usage"), F.struct(F.col("event_type").alias("type")).alias("item"))
    return ledger.events_usage(e, ["event_type"], ("click", "view")).select("event_type", "events", "input_tokens", "foreign_items")


@query(f"WITH {CURVES}, k AS (SELECT sample_id, bool_and(value >= 0 AND value <= 100) AS ok FROM curves GROUP BY 1) SELECT sample_id, ok AS accepted, false AS accepted_text, false AS accepted_extra FROM k")
def json_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves as payloads: accepted as they are; refused with a number as text, or with another key."""
    c = nation_curves(spark, sf_dir)
    good = F.to_json(F.struct("cdf"))
    as_text = F.to_json(F.struct(F.col("cdf").cast("array<string>").alias("cdf")))
    extra = F.to_json(F.struct("cdf", F.lit(1).alias("note")))
    return c.select("sample_id", *(text.parse_curve(p).isNotNull().alias(n) for p, n in ((good, "accepted"), (as_text, "accepted_text"), (extra, "accepted_extra"))))


@query("SELECT doc_id, sha256(text) AS sha256, CASE WHEN doc_id % 7 = 0 THEN 'changed' WHEN doc_id % 11 = 0 THEN 'missing' ELSE 'ok' END AS state FROM documents")
def manifest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded hashes against actual ones, with some texts changed and some gone."""
    from ..sources.files import verify

    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", "doc_id")
    recorded = docs.select("path", F.sha2("text", 256).alias("sha256"))
    actual = docs.where("doc_id % 11 <> 0 or doc_id % 7 = 0").select("path", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return verify(recorded, actual).select(F.col("path").cast("long").alias("doc_id"), "sha256", "state")


@query("""SELECT event_id, sha256('{"id":' || event_id || ',"props":{"k":' || json_extract_string(props, '$.k') || '},"z":[{"a":"' || event_type || '","b":1.5}]}') AS sha256 FROM events""")
def json_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of events as canonical JSON, from texts with other orders of keys and blanks."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "props")
    written_out = F.concat(F.lit('{ "z": [{"b": 1.50, "a": "'), "event_type", F.lit('"}], "props": '), "props", F.lit(', "id": '), F.col("event_id").cast("string"), F.lit("}"))
    return e.select("event_id", F.sha2(text.canonical_json(written_out), 256).alias("sha256"))


@query("""SELECT v AS version, s_nationkey, count(*) AS suppliers, round(sum(s_acctbal * v), 2) AS balance FROM supplier, (VALUES (1), (2)) t(v) WHERE v = 1 OR s_suppkey % 3 > 0 GROUP BY 1, 2
UNION ALL SELECT 3, s_nationkey, count(*), round(sum(s_acctbal * 2), 2) FROM supplier WHERE s_suppkey % 3 > 0 GROUP BY 2""")
def table_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a table of two versions, read by number; a write whose tasks fail leaves the second one current (3 here)."""
    path, suppliers_ = f"{folder(spark)}/suppliers", read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    tables.write_version(suppliers_, path)
    tables.write_version(suppliers_.where("s_suppkey % 3 > 0").withColumn("s_acctbal", F.col("s_acctbal") * 2), path)
    broken = suppliers_.withColumn("s_acctbal", F.when(F.col("s_suppkey") < 0, 0.0).otherwise(F.raise_error(F.lit("refused")).cast("double")))
    try:
        tables.write_version(broken, path)
    except Exception as error:  # the writer's own or Spark's
        if "refused" not in str(error):
            raise
    versions = [tables.read_version(spark, path, suppliers_.schema, v).withColumn("version", F.lit(i)) for i, v in ((1, 1), (2, 2), (3, None))]
    return versions[0].unionByName(versions[1]).unionByName(versions[2]).groupBy("version", "s_nationkey").agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("SELECT page_id, octet_length(encode(html)) AS length, sha256(html) AS sha256 FROM pages")
def files_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files, listed and hashed in pieces."""
    root = f"{folder(spark)}/pages"

    def save(batches):
        system, place = tables.store(root)
        for batch in batches:
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                system.create_dir(f"{place}/{page % 100}", recursive=True)
                with system.open_output_stream(f"{place}/{page % 100}/{page}.html", compression=None) as out:
                    out.write(html.as_py())
            yield batch.select(["page_id"])

    pages = read(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("html"))
    pages.mapInArrow(save, "page_id bigint").write.format("noop").mode("overwrite").save()
    found = tables.hashed_files(spark, root, (".html",), piece=1000)
    return found.select(F.regexp_extract("path", r"(\d+)\.html$", 1).cast("long").alias("page_id"), "length", "sha256")


@query("SELECT count(*) FILTER (l_quantity IS NULL) AS null_quantity, count(*) FILTER (NOT isfinite(l_extendedprice)) AS infinite_price, count(*) FILTER (l_discount < 0 OR l_discount > 1) AS bad_discount, count(*) AS rows FROM lineitem")
def quality_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return line.agg(F.count_if(F.col("l_quantity").isNull()).alias("null_quantity"), F.count_if(F.isnan("l_extendedprice") | (F.abs("l_extendedprice") == float("inf"))).alias("infinite_price"), F.count_if((F.col("l_discount") < 0) | (F.col("l_discount") > 1)).alias("bad_discount"), F.count("*").alias("rows"))


_LIST = f"sup AS (SELECT l_suppkey, list(value ORDER BY pos) AS v FROM (SELECT l_suppkey, pos, 100.0::DOUBLE * count(*) FILTER (l_extendedprice <= threshold) / count(*) AS value FROM lineitem, {_T} GROUP BY 1, 2) GROUP BY 1)"


@query(f"""WITH RECURSIVE {_LIST}, e AS (SELECT l_suppkey, v, round(list_sum(list_transform(range(1, 11), lambda k: abs(v[k] - 100.0 / 11 * k) * ({list(C.WIDTHS)!r})[k])), 4) AS score FROM sup),
c AS (SELECT 'supplier ' || l_suppkey || ' ' || i AS experiment, score, i, list_transform(v, lambda x: x + d) AS v FROM e, (VALUES (0, 0::DOUBLE), (1, 5e-10), (2, 1.4e-9)) t(i, d)),
r AS (SELECT *, row_number() OVER (ORDER BY score, i, experiment) AS place FROM c),
steps(place, experiment, twin, seen) AS (SELECT 0::BIGINT, '', NULL::VARCHAR, (SELECT list({{'name': 'prior ' || l_suppkey, 'v': list_transform(v, lambda x: x - 3e-10)}} ORDER BY 'prior ' || l_suppkey) FROM e WHERE l_suppkey % 10 = 0)
UNION ALL SELECT place, experiment, twin, CASE WHEN twin IS NULL THEN list_append(seen, {{'name': experiment, 'v': v}}) ELSE seen END FROM
(SELECT r.place, r.experiment, r.v, s.seen, list_filter(s.seen, lambda o: list_max(list_transform(range(1, 12), lambda k: abs(o.v[k] - r.v[k]))) <= 1e-9)[1].name AS twin FROM steps s JOIN r ON r.place = s.place + 1))
SELECT experiment, place - 1 AS place, twin AS duplicate_of FROM steps WHERE place > 0""")
def dedupe_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' curves three times, each a little off, ranked by error; later ones within 1e-9 of a survivor or of a prior curve are marked."""
    curves = suppliers(spark, sf_dir).select("l_suppkey", "cdf")
    moved = lambda d: F.transform("cdf", lambda v: v + F.lit(d))
    copies = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), moved(d).alias("values")) for i, d in enumerate((0.0, 5e-10, 1.4e-9)))))
    each = curves.select("l_suppkey", F.round(C.emd(F.col("cdf"), C.equal_bins()), 4).alias("score"), copies.alias("c"))
    scored = each.select(F.concat_ws(" ", F.lit("supplier"), "l_suppkey", "c.i").alias("experiment"), "score", F.col("c.i").cast("double").alias("disagreement"), "c.values")
    prior = curves.where("l_suppkey % 10 = 0").select(F.concat_ws(" ", F.lit("prior"), "l_suppkey").alias("experiment"), moved(-3e-10).alias("values"))
    return ledger.queue(scored, prior)


# pairs without pairs
@query(f"""WITH {_LIST}, p AS (SELECT list_sum(list_transform(range(1, 11), lambda k: abs(a.v[k] - b.v[k]) * ({list(C.WIDTHS)!r})[k])) AS e FROM sup a JOIN sup b ON a.l_suppkey < b.l_suppkey) SELECT round(avg(e), 6) AS emd, count(*) AS pairs FROM p""")
def emd_pair_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean EMD over all pairs of suppliers, from ranks."""
    return A.pair_means(suppliers(spark, sf_dir).select("cdf")).select(r6("emd").alias("emd"), "pairs")


@query(f"""WITH {_LIST}, n AS (SELECT s_nationkey, l_suppkey, v FROM sup JOIN supplier ON s_suppkey = l_suppkey), p AS (SELECT a.s_nationkey, list_sum(list_transform(range(1, 11), lambda k: abs(a.v[k] - b.v[k]) * ({list(C.WIDTHS)!r})[k])) AS e FROM n a JOIN n b ON a.s_nationkey = b.s_nationkey AND a.l_suppkey < b.l_suppkey)
SELECT s_nationkey, round(avg(e), 6) AS emd, count(e) AS pairs FROM (SELECT DISTINCT s_nationkey FROM n) LEFT JOIN p USING (s_nationkey) GROUP BY 1""")
def emd_pair_mean_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within each nation; a nation of one supplier has no pair."""
    nation = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    curves = suppliers(spark, sf_dir).select("l_suppkey", "cdf").join(nation, "l_suppkey")
    return A.pair_means(curves, ["s_nationkey"]).select("s_nationkey", r6("emd").alias("emd"), "pairs")


@query("""SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (value <= 50) / count(*), 6) AS half FROM events GROUP BY 1, 2""")
def windowed_event_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming extension over the events table in batch form."""
    out = windowed_curves(read(spark, sf_dir, "events"), "ts", "value", "event_type", (10.0, 50.0, 100.0), "1 day")
    return out.select("window_start", "event_type", "n", r6(F.get("cdf", 1)).alias("half"))


#: Side of the images that order lines are dealt to; their cells in SQL, and their grid with empty cells as 0.
SIDE = 256
_CELLS = f"{LINES}, cells AS (SELECT sample_id, (l_orderkey % {SIDE})::INT AS y, (l_partkey % {SIDE})::INT AS x, avg(l_extendedprice / 200000) AS v FROM lines GROUP BY 1, 2, 3)"
_GRID = f"""{_CELLS}, grid AS (SELECT sample_id, y, x, coalesce(v, 0) AS v FROM (SELECT DISTINCT sample_id FROM cells) CROSS JOIN (SELECT y::INT AS y FROM range({SIDE}) a(y)) CROSS JOIN (SELECT x::INT AS x FROM range({SIDE}) b(x)) LEFT JOIN cells USING (sample_id, y, x))"""


def _changes(lags: tuple[int, ...], power: int, grid: str = "grid") -> str:
    """SQL of the mean change (to a power) at lags, averaged over both axes, as d0, d1 and so on by sample."""
    over = lambda k, a, b: f"avg(power(abs(v - lag_{a}{k}), {power}))"
    lagged = ", ".join(f"lag(v, {k}) OVER (PARTITION BY sample_id, {b} ORDER BY {a}) AS lag_{a}{k}" for k in lags for a, b in (("y", "x"), ("x", "y")))
    return f"d AS (SELECT sample_id, {', '.join(f'({over(k, chr(121), chr(120))} + {over(k, chr(120), chr(121))}) / 2 AS d{i}' for i, k in enumerate(lags))} FROM (SELECT sample_id, v, {lagged} FROM {grid}) GROUP BY 1)"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, y, x, value): order lines dealt to square images by supplier nation, pixel means of scaled prices; cells without lines are 0."""
    at = lines(spark, sf_dir).select("sample_id", (F.col("l_orderkey") % SIDE).cast("int").alias("y"), (F.col("l_partkey") % SIDE).cast("int").alias("x"), (F.col("l_extendedprice") / 200000).alias("v"))
    cells = written(at.groupBy(F.col("sample_id").alias("image"), "y", "x").agg(F.avg("v").alias("value")))
    side = lambda name: F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias(name)
    grid = cells.select("image").distinct().select("image", side("y")).select("image", "y", side("x"))
    return written(grid.join(cells, ["image", "y", "x"], "left").select("image", "y", "x", F.coalesce("value", F.lit(0.0)).alias("value")))


def _colour(gray: DataFrame) -> DataFrame:
    """A gray image with two channels of its powers, as colour."""
    v = F.col("value")
    return gray.select("image", "y", "x", v.alias("r"), (v * v).alias("g"), F.sqrt(v).alias("b"))


def _image_query(name: str, extract, n: int, sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = extract(_pixels(spark, sf_dir)).withColumnRenamed("image", "sample_id")
        return images.wide(f, ["sample_id"], n).select("sample_id", *(r6(f"feature_{i}").alias(f"feature_{i}") for i in range(n)))

    run.__name__ = name
    _queries[name] = run
    if sql:
        _sql[name] = sql


_GRAY = f"WITH {_GRID}, {_changes(images.LAGS, 1)}, s AS (SELECT sample_id, quantile_cont(v, 0.1) AS q1, quantile_cont(v, 0.5) AS q5, quantile_cont(v, 0.9) AS q9, stddev_pop(v) AS dev FROM grid GROUP BY 1) SELECT sample_id, round(q1, 6) AS feature_0, round(q5, 6) AS feature_1, round(q9, 6) AS feature_2, round(dev, 6) AS feature_3, round(d0, 6) AS feature_4, round(d1, 6) AS feature_5, round(d2, 6) AS feature_6 FROM s JOIN d USING (sample_id)"
_TEXTURE = f"WITH {_GRID}, {_changes(tuple(round(o * SIDE / 100) for o in images.OFFSETS_MM), 2)}, s AS (SELECT sample_id, var_pop(v) AS var FROM grid GROUP BY 1) SELECT sample_id, {', '.join(f'round(d{i} / (2 * var), 6) AS feature_{i}' for i in range(4))} FROM s JOIN d USING (sample_id)"

_RGB = f"{_GRID}, tones AS (SELECT sample_id, y, x, v AS r, v * v AS g, sqrt(v) AS b, (v + v * v + sqrt(v)) / 3 AS v FROM grid)"
_COLOR = f"""WITH {_RGB}, {_changes(images.LAGS, 1, 'tones')}, s AS (SELECT sample_id, {', '.join(f'quantile_cont({c}, {q}) AS {c}{i}' for i, q in enumerate((0.1, 0.5, 0.9)) for c in 'rgb')}, stddev_pop(v) AS dev FROM tones GROUP BY 1)
SELECT sample_id, {', '.join(f'round({c}{i}, 6) AS feature_{3 * i + k}' for i in range(3) for k, c in enumerate('rgb'))}, round(dev, 6) AS feature_9, round(d0, 6) AS feature_10, round(d1, 6) AS feature_11, round(d2, 6) AS feature_12 FROM s JOIN d USING (sample_id)"""
_TILE = SIDE // 4
_PATCHES = f"""WITH {_RGB}, tiles AS (SELECT sample_id || ':' || y // {_TILE} || ':' || x // {_TILE} AS sample_id, y, x, r, g, b, v FROM tones), {_changes(images.LAGS, 1, 'tiles')},
m AS (SELECT sample_id, avg(r) AS p0, avg(g) AS p1, avg(b) AS p2 FROM tiles GROUP BY 1), f AS (SELECT split_part(sample_id, ':', 1) AS sample_id, p0, p1, p2, d0 AS p3, d1 AS p4, d2 AS p5 FROM m JOIN d USING (sample_id))
SELECT sample_id, {', '.join(f'round(quantile_cont(p{i}, 0.75) - quantile_cont(p{i}, 0.25), 6) AS feature_{i}' for i in range(6))} FROM f GROUP BY 1"""
_BOXES = [(0, 0, 128, 128), (0, 128, 128, 256), (128, 0, 256, 128), (128, 128, 256, 256), (64, 64, 192, 192)]
_CROPS = f"""WITH {_GRID}, box(i, t, l, b, r) AS (VALUES {', '.join(f'({i}, {t}, {l}, {b}, {r})' for i, (t, l, b, r) in enumerate(_BOXES))}), crops AS (SELECT sample_id || ':' || i AS sample_id, y, x, v FROM grid JOIN box ON y >= t AND y < b AND x >= l AND x < r), {_changes(images.LAGS, 1, 'crops')},
s AS (SELECT sample_id, quantile_cont(v, 0.1) AS f0, quantile_cont(v, 0.5) AS f1, quantile_cont(v, 0.9) AS f2, stddev_pop(v) AS f3 FROM crops GROUP BY 1)
SELECT split_part(sample_id, ':', 1) AS sample_id, {', '.join(f'round(avg({c}), 6) AS feature_{i}' for i, c in enumerate(('f0', 'f1', 'f2', 'f3', 'd0', 'd1', 'd2')))} FROM s JOIN d USING (sample_id) GROUP BY 1"""

_image_query("features_gray", lambda p: pixels.color_texture(p, "gray"), 7, _GRAY)
_image_query("features_texture", pixels.texture, 4, _TEXTURE)
_image_query("features_color", lambda p: pixels.color_texture(_colour(p)), 13, _COLOR)
_image_query("features_native", lambda p: pixels.native(_colour(p)), 23)
_image_query("features_patch_spread", lambda p: pixels.patch_spread(_colour(p)), 6, _PATCHES)
_image_query("features_spatial", lambda p: pixels.spatial(p, _BOXES), 7, _CROPS)
_image_query("features_spectrum", pixels.spectrum, 6)
_image_query("features_granulometry", pixels.granulometry, 12)
_image_query("features_local_patterns", pixels.local_patterns, 40)


# checks of tables against templates and saved tables, and the smaller key, text and ordering operators
@query(f"""WITH {CURVES}, w AS (SELECT sample_id, max(value) FILTER (pos = 10) AS last FROM curves GROUP BY 1),
sub AS (SELECT sample_id FROM w WHERE sample_id <> 'NATION_3' UNION ALL SELECT sample_id FROM w WHERE sample_id = 'NATION_5' UNION ALL SELECT 'NOWHERE')
SELECT (SELECT count(*) FROM sub) AS rows, (SELECT count(*) FROM (SELECT sample_id FROM sub GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys, (SELECT count(*) FROM (SELECT sample_id FROM w EXCEPT SELECT sample_id FROM sub)) AS missing,
(SELECT count(*) FROM (SELECT sample_id FROM sub EXCEPT SELECT sample_id FROM w)) AS extra, 0::BIGINT AS bad_curves, 1::BIGINT AS open_ends, false AS valid""")
def submission_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations' curves as a submission that lacks one, has one twice, and one with an open end that nobody asked for."""
    wide = nation_curves(spark, sf_dir).select("sample_id", *(F.get("cdf", i).alias(str(t)) for i, t in enumerate(PRICES)))
    strange = wide.limit(1).select(F.lit("NOWHERE").alias("sample_id"), *(F.lit(99.0).alias(str(t)) for t in PRICES))
    sent = wide.where("sample_id <> 'NATION_3'").unionByName(wide.where("sample_id = 'NATION_5'")).unionByName(strange)
    return submission.submission_report(sent, wide).select("rows", "duplicate_keys", "missing", "extra", "bad_curves", "open_ends", "valid")


@query("SELECT n_name, (24 - n_nationkey)::INT AS pos FROM nation")
def submission_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select("n_name", "n_nationkey")
    order = nation.select("n_name", (24 - F.col("n_nationkey")).cast("int").alias("pos"))
    return submission.in_order(nation, order, ["n_name"], "pos").select("n_name", "pos")


_REBUILT = "o_totalprice / 1e6 * (CASE WHEN o_orderkey % {n} = 0 THEN 1 + {e}::DOUBLE ELSE 1 END)"


@query(f"""WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice / 1e6 AS saved, {_REBUILT.format(n=3, e=1e-12)} AS fine, {_REBUILT.format(n=11, e=1e-8)} AS off FROM orders)
SELECT o_orderstatus, (SELECT count(*) FROM orders o WHERE o.o_orderstatus = a.o_orderstatus AND o_orderkey % 101 = 0) AS only_saved, max(abs(fine - saved)) FILTER (o_orderkey % 101 <> 0) <= 1e-10 AS fine_close, round(1e9 * max(abs(off - saved)) FILTER (o_orderkey % 101 <> 0), 4) AS off_by, max(abs(off - saved)) FILTER (o_orderkey % 101 <> 0) <= 1e-10 AS off_close FROM a GROUP BY 1""")
def rebuild_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each status by four keys, some lacking, against the saved ones: once with differences within the tolerance, once with some beyond it."""
    keys = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    saved = read(spark, sf_dir, "orders").select(*keys, (F.col("o_totalprice") / 1e6).alias("price"))
    moved = lambda n, e: saved.where("o_orderkey % 101 <> 0").withColumn("price", F.col("price") * F.when(F.col("o_orderkey") % n == 0, 1 + e).otherwise(1.0))
    fine, off = (submission.rebuild_report(moved(n, e), saved, keys, ["price"], by=["o_orderstatus"]) for n, e in ((3, 1e-12), (11, 1e-8)))
    out = fine.select("o_orderstatus", "only_saved", (F.col("difference") <= submission.TOLERANCE).alias("fine_close"))
    return out.join(off.select("o_orderstatus", F.round(F.col("difference") * 1e9, 4).alias("off_by"), (F.col("difference") <= submission.TOLERANCE).alias("off_close")), "o_orderstatus")


@query("""WITH a AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2), b AS (SELECT o_custkey, o_orderstatus, max(o_totalprice) AS n, min(o_orderkey) AS first FROM orders WHERE o_orderpriority < '3' GROUP BY 1, 2)
SELECT o_custkey, o_orderstatus, a.n AS n_all, round(b.n, 2) AS n_urgent, first FROM a JOIN b USING (o_custkey, o_orderstatus)""")
def merge_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, orders = ["o_custkey", "o_orderstatus"], read(spark, sf_dir, "orders")
    a = orders.groupBy(*keys).agg(F.count("*").alias("n"))
    b = orders.where("o_orderpriority < '3'").groupBy(*keys).agg(F.round(F.max("o_totalprice"), 2).alias("n"), F.min("o_orderkey").alias("first"))
    return K.merge(a, b, keys, ("_all", "_urgent"))


@query(f"WITH {_ERRORS} SELECT count(*) FILTER (em.e - ed.e > 0) AS better, count(*) FILTER (em.e - ed.e > 1e-9) AS clearly_better, count(*) FILTER (ed.e < em.e - 1e-9) AS below_reference, count(*) AS pairs FROM em JOIN ed USING (sample_id)")
def wins_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean, median = _errors(spark, sf_dir)
    return A.wins(K.one_to_one(mean, median, ["sample_id"]).select(F.col("emd_left").alias("reference"), F.col("emd_right").alias("error")))


@query("SELECT s_suppkey, alpha, scale, round(s_acctbal / alpha * scale, 6) AS value FROM supplier, (VALUES (10.0::DOUBLE), (100.0), (1000.0)) a(alpha), (VALUES (1), (2)) b(scale)")
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = K.with_parameters(read(spark, sf_dir, "supplier"), alpha=[10.0, 100.0, 1000.0], scale=[1, 2])
    return grid.select("s_suppkey", "alpha", "scale", r6(F.col("s_acctbal") / F.col("alpha") * F.col("scale")).alias("value"))


@query("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def exclusion_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text is not that of one labelled toxic."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    toxic = docs.join(read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id")
    return K.excluding_hashes(docs, "text", toxic.select(F.sha2("text", 256).alias("sha256"))).select("doc_id")


@query("SELECT conv_id, turn, (coalesce(sum(length(role)) OVER w, 0) + 1)::BIGINT AS first_number, (coalesce(sum(length(role)) OVER w, 0) + length(role))::BIGINT AS last_number FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def running_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("role").alias("n"))
    return K.numbered_ranges(turns, ["conv_id"], ["turn"], "n").select("conv_id", "turn", "first_number", "last_number")


@query("SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY md5('7:' || s_suppkey), s_suppkey)::INT AS place FROM supplier")
def seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.seeded_order(read(spark, sf_dir, "supplier"), ["s_nationkey"], "s_suppkey", 7).select("s_nationkey", "s_suppkey", "place")


@query("""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, sha256(array_to_string(l[1:1] || ['new'] || l[3:], chr(10))) AS edited, base64(encode(source)) AS source64, CASE WHEN n_chars % 3 = 0 THEN 'n/a' ELSE printf('%.2f', n_chars / 4.0) END AS size, nullif(lang, 'en') AS other_lang FROM l JOIN documents USING (doc_id)""")
def text_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    size = text.shown(F.when(F.col("n_chars") % 3 != 0, F.col("n_chars") / 4.0), 2)
    return docs.select("doc_id", F.sha2(text.replace_lines(F.col("text"), 1, 2, [F.lit("new")]), 256).alias("edited"), F.base64(F.col("source").cast("binary")).alias("source64"), size.alias("size"), F.nullif(F.col("lang"), F.lit("en")).alias("other_lang"))


_LOG = {"retry": r"(\d+) (click|view) (\d)/5", "other": r"(\d+) (\w+) (\d)/5"}


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'retry' ELSE 'other' END AS kind, event_type AS word, (event_id % 5)::VARCHAR AS number FROM events")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as log lines, classed by whole-line patterns with captures; any other line raises."""
    line = F.concat_ws(" ", F.col("event_id").cast("string"), "event_type", F.concat((F.col("event_id") % 5).cast("string"), F.lit("/5")))
    seen = read(spark, sf_dir, "events").select("event_id", text.line_class(line, _LOG).alias("c"))
    return seen.select("event_id", "c.kind", F.get("c.captures", 1).alias("word"), F.get("c.captures", 2).alias("number"))


from . import reports  # noqa: E402, F401  (its queries take their pieces from here)

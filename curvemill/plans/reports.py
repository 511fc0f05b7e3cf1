"""Registered queries of plot tables, listings, files, resuming and gates, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import curves as C
from ..operators import aggregate as A, keys as K, ledger, match, plots
from ..operators.working import folder
from ..sources import files, tables
from .queries import _ERRORS, _T, _W, CURVES, FEATURES, VIEWS, nation_curves, query, r6, read, suppliers, view_curves

#: Photos of a folder, about, and folders at least.
PHOTOS, SHARDS = 2_000, 8

_SUPPORT = "(VALUES " + ", ".join(f"({i}, {d!r}::DOUBLE, '{s}')" for i, (d, s) in enumerate(zip(C.SUPPORT, C.LABELS))) + ") d(pos, x, label)"


@query(f"WITH {CURVES} SELECT sample_id AS series, x, round(value, 6) AS y FROM curves JOIN {_SUPPORT} USING (pos)")
def plot_curve_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plots.curve_lines(nation_curves(spark, sf_dir), "sample_id").select("series", "x", r6("y").alias("y"))


@query(f"WITH {CURVES}, m AS (SELECT sample_id, pos, value - coalesce(lag(value) OVER (PARTITION BY sample_id ORDER BY pos), 0) AS share FROM curves) SELECT sample_id AS series, pos::INT AS bin, label, round(share, 6) AS share FROM m JOIN {_SUPPORT} USING (pos)")
def plot_bin_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plots.bin_map(nation_curves(spark, sf_dir), "sample_id").select("series", F.col("bin").cast("int").alias("bin"), "label", r6("share").alias("share"))


# a listing of photos: a file a page, named after a supplier, a camera and the page; some names lack one of them
_LISTING = r"""l AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'train' ELSE 'test' END AS split,
'IMG ' || CASE WHEN page_id % 7 = 0 THEN 'none' ELSE upper(s_name) END || '_' || CASE WHEN page_id % 5 = 0 THEN 'cam' ELSE p_brand END || '-p' || page_id || CASE WHEN page_id % 3 = 0 THEN '.JPG' ELSE '.png' END AS filename
FROM pages JOIN supplier ON s_suppkey = page_id % (SELECT count(*) FROM supplier) JOIN part ON p_partkey = page_id % (SELECT count(*) FROM part)),
n AS (SELECT *, lower(filename) AS low, regexp_replace(lower(filename), '[^\p{L}\p{N}]', '', 'g') AS norm FROM l),
ids AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'train' ELSE 'test' END AS split, s_name, regexp_replace(lower(s_name), '[^\p{L}\p{N}]', '', 'g') AS norm FROM supplier),
cams AS (SELECT p_brand, lower(p_brand) AS low, regexp_replace(lower(p_brand), '[^\p{L}\p{N}]', '', 'g') AS norm, min(p_retailprice) AS ppm FROM part GROUP BY 1),
s AS (SELECT page_id, any_value(s_name) AS sample_id FROM n JOIN ids ON ids.split = n.split AND contains(n.norm, ids.norm) GROUP BY 1),
c AS (SELECT page_id, arg_max(p_brand, (length(p_brand), p_brand)) AS camera, max(length(p_brand)) AS n FROM n JOIN cams ON contains(n.low, cams.low) OR contains(n.norm, cams.norm) GROUP BY 1),
idx AS (SELECT split, filename, coalesce(sample_id, '') AS sample_id, coalesce(camera, '') AS camera, ppm, sample_id IS NOT NULL AS is_matched, CASE WHEN sample_id IS NULL THEN 'unmatched_sample_id' WHEN camera IS NULL THEN 'unknown_camera' ELSE '' END AS issue
FROM n LEFT JOIN s USING (page_id) LEFT JOIN c USING (page_id) LEFT JOIN cams ON camera = p_brand)"""


def _photo_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str]:
    """The index of photos that are listed from folders, the ids, and the folders' root."""
    root = f"{folder(spark)}/photos"
    supplier, part = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    pages, page = read(spark, sf_dir, "pages").select("page_id"), F.col("page_id")
    n_supplier, n_part, shards = supplier.count(), part.count(), max(SHARDS, -(-pages.count() // PHOTOS))
    named = pages.join(supplier, F.col("s_suppkey") == page % n_supplier).join(part, F.col("p_partkey") == page % n_part)
    name = F.concat(F.lit("IMG "), F.when(page % 7 == 0, "none").otherwise(F.upper("s_name")), F.lit("_"), F.when(page % 5 == 0, "cam").otherwise(F.col("p_brand")), F.lit("-p"), page.cast("string"), F.when(page % 3 == 0, ".JPG").otherwise(".png"))
    split = lambda key: F.when(key % 2 == 0, "train").otherwise("test")

    def touch(batches):
        (system, place), made = tables.store(root), set()
        for batch in batches:
            for where, filename in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                if where not in made:
                    system.create_dir(f"{place}/{where}", recursive=True)
                    made.add(where)
                with system.open_output_stream(f"{place}/{where}/{filename}", compression=None) as out:
                    out.write(b"x")
            yield batch

    # folders of about PHOTOS photos, each written and listed by a task
    photos = named.select(F.pmod(F.xxhash64(page), F.lit(shards)).alias("shard"), split(page).alias("split"), name.alias("filename")).repartition(shards, "shard")
    photos.select(F.concat_ws("/", F.col("shard").cast("string"), "split").alias("folder"), "filename").mapInArrow(touch, "folder string, filename string").write.format("noop").mode("overwrite").save()
    below = F.substring_index("path", "/", -2)
    listing = tables.listed_files(spark, root, tuple(f".{s}" for s in files.IMAGE_SUFFIXES)).select(F.split_part(below, F.lit("/"), F.lit(1)).alias("split"), below.alias("path"))
    ids = supplier.select(split(F.col("s_suppkey")).alias("split"), F.col("s_name").alias("sample_id"))
    calibration = part.groupBy("p_brand").agg(F.min("p_retailprice").cast("string").alias("ppm")).withColumn("pos", F.lit(0))
    return match.photo_index(listing, ids, calibration, "p_brand"), ids, root


@query(f"WITH {_LISTING} SELECT split, filename, sample_id, camera, round(ppm, 6) AS ppm, is_matched, issue FROM idx")
def photo_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _, _ = _photo_index(spark, sf_dir)
    return index.select("split", "filename", "sample_id", "camera", r6("ppm").alias("ppm"), "is_matched", "issue")


@query(f"""WITH {_LISTING}, gaps AS (SELECT split, list(s_name ORDER BY s_name) AS g FROM ids ANTI JOIN idx ON idx.is_matched AND idx.split = ids.split AND idx.sample_id = s_name GROUP BY 1)
SELECT split, count(*) AS photos, count(*) FILTER (is_matched) AS matched, count(*) FILTER (issue = 'unknown_camera') AS unknown_camera, coalesce(any_value(array_to_string(g, ' ')), '') AS without_photo FROM idx LEFT JOIN gaps USING (split) GROUP BY 1""")
def photo_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, ids, _ = _photo_index(spark, sf_dir)
    return match.coverage(index, ids).select("split", "photos", "matched", "unknown_camera", F.coalesce(F.array_join("without_photo", " "), F.lit("")).alias("without_photo"))


@query(f"""WITH {_LISTING}, f AS (SELECT *, split || '/' || filename AS path FROM idx WHERE is_matched QUALIFY row_number() OVER (PARTITION BY split, sample_id ORDER BY split || '/' || filename) = 1),
t AS (SELECT *, (row_number() OVER (ORDER BY split, path) - 1)::INT AS tile FROM f QUALIFY tile < 24)
SELECT tile, path, substr(trim(sample_id || '  ' || camera), 1, 30) AS label, tile % 4 * 220 + 20 AS picture_x, tile // 4 * 185 + 10 AS picture_y, tile % 4 * 220 + 20 AS label_x, tile // 4 * 185 + 155 AS label_y FROM t""")
def plot_contact_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _, _ = _photo_index(spark, sf_dir)
    return plots.contact_sheet(index)


@query(f"""WITH RECURSIVE {_LISTING}, {_ERRORS}, pairs AS (SELECT sum(abs(a.value - b.value) * width) AS e FROM curves a JOIN curves b ON a.pos = b.pos AND a.sample_id < b.sample_id JOIN {_W} ON w.pos = a.pos GROUP BY a.sample_id, b.sample_id),
eq AS (SELECT sum(abs(value - 100.0 / 11 * (pos + 1)) * width) AS e FROM curves JOIN {_W} USING (pos) GROUP BY sample_id)
SELECT (SELECT count(DISTINCT sample_id) FROM curves) AS samples, (SELECT count(*) FROM idx WHERE split = 'train') AS train_photos, (SELECT count(*) FROM idx WHERE split = 'test') AS test_photos, (SELECT count(*) FROM idx WHERE NOT is_matched) AS unmatched_photos,
(SELECT count(DISTINCT nullif(camera, '')) FROM idx) AS cameras, (SELECT round(avg(e), 6) FROM eq) AS equal_bins, (SELECT round(avg(e), 6) FROM em) AS loo_mean, (SELECT round(avg(e), 6) FROM ed) AS loo_median, (SELECT round(avg(e), 6) FROM pairs) AS pairwise""")
def survey_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _, _ = _photo_index(spark, sf_dir)
    out = plots.summary(nation_curves(spark, sf_dir), index, "sample_id")
    return out.select("samples", "train_photos", "test_photos", "unmatched_photos", "cameras", *(r6(c).alias(c) for c in ("equal_bins", "loo_mean", "loo_median", "pairwise")))


# keys
@query("""WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice AS v FROM orders WHERE o_orderkey % 5 > 0), b AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, sum(l_extendedprice) AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 7 > 0 GROUP BY 1, 2, 3, 4)
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, round(a.v, 2) AS v_order, round(b.v, 2) AS v_lines FROM a JOIN b USING (o_orderkey, o_custkey, o_orderstatus, o_orderpriority)""")
def merge_four_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against their lines' sums, one to one on four keys."""
    keys, orders = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], read(spark, sf_dir, "orders")
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    sums = orders.where("o_orderkey % 7 > 0").join(line, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(*keys).agg(F.sum("l_extendedprice").alias("v"))
    out = K.merge_one_to_one(orders.where("o_orderkey % 5 > 0").select(*keys, F.col("o_totalprice").alias("v")), sums, keys, ("_order", "_lines"))
    return out.select(*keys, F.round("v_order", 2).alias("v_order"), F.round("v_lines", 2).alias("v_lines"))


@query("SELECT k AS p_partkey, pos, p_name, round(p_retailprice, 2) AS price FROM (SELECT p_partkey * 2 AS k, p_size * 100000 + p_partkey AS pos FROM part) i LEFT JOIN part ON p_partkey = k")
def reindexed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the order of an index, half of whose keys they lack."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    index = part.select((F.col("p_partkey") * 2).alias("p_partkey"), (F.col("p_size") * 100000 + F.col("p_partkey")).alias("pos"))
    return K.reindexed(part.drop("p_size"), "p_partkey", index).select("p_partkey", "pos", "p_name", F.round("p_retailprice", 2).alias("price"))


@query("SELECT l_orderkey, l_linenumber, coalesce(pos, -1)::BIGINT AS pos FROM lineitem LEFT JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_name DESC) - 1 AS pos FROM supplier WHERE s_suppkey % 4 > 0) ON s_suppkey = l_suppkey")
def key_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of each line's supplier in a list that lacks some."""
    from ..operators.working import running

    named = read(spark, sf_dir, "supplier").where("s_suppkey % 4 > 0").select(F.col("s_suppkey").alias("l_suppkey"), (F.lit(0) - F.col("s_suppkey")).alias("o"), F.lit(1).alias("one"))
    index = running(named, [], ["o"], "one", "at").select("l_suppkey", (F.col("at") - 1).alias("pos"))  # names are in the order of keys
    return K.positions(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_suppkey", index).select("l_orderkey", "l_linenumber", F.col("pos").cast("long").alias("pos"))


_MEAN = ", ".join(f"round(avg({c}), 6) AS feature_{i}" for i, c in enumerate(FEATURES))


@query(f"""WITH a AS (SELECT l_suppkey, {_MEAN} FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, {', '.join(f'round(avg({c}), 6) AS feature_{i + 4}' for i, c in enumerate(FEATURES))} FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT * FROM a JOIN b USING (l_suppkey)""")
def shifted_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of features side by side, the second one's numbered on."""
    line = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", *(F.col(c).alias(f"feature_{i}") for i, c in enumerate(FEATURES)))
    means = lambda df: A.mean_by(df, ["l_suppkey"]).select("l_suppkey", *(r6(f"feature_{i}").alias(f"feature_{i}") for i in range(4)))
    return K.merge(means(line), K.shifted_features(means(line.where("l_returnflag = 'R'")), 4), ["l_suppkey"])


# files
@query("SELECT s_nationkey, count(*) AS n, count(CASE WHEN s_suppkey % 9 > 0 THEN 1 END) AS known, round(sum(CASE WHEN s_suppkey % 9 > 0 THEN s_acctbal END), 2) AS balance, min(s_name) AS first FROM supplier GROUP BY 1")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as CSV, some balances as NaN, and read under pinned types."""
    path = f"{folder(spark)}/csv"
    out = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.when(F.col("s_suppkey") % 9 > 0, F.col("s_acctbal")).otherwise(float("nan")).alias("s_acctbal"))
    files.write_csv(out, path)
    back = files.csv(spark, path, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")
    return back.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.count("s_acctbal").alias("known"), F.round(F.sum("s_acctbal"), 2).alias("balance"), F.min("s_name").alias("first"))


@query("SELECT event_type, count(*) FILTER (event_id % 10 > 1) AS n, sum(CASE WHEN event_id % 10 > 1 THEN event_id END)::BIGINT AS ids FROM events GROUP BY 1")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of JSON, one in ten cut off and one in ten no object, read tolerantly."""
    path = f"{folder(spark)}/lines"
    e = read(spark, sf_dir, "events").select("event_id", "event_type")
    line = F.to_json(F.struct("event_id", "event_type"))
    cut = F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 12)).when(F.col("event_id") % 10 == 1, F.concat(F.lit("["), line, F.lit("]"))).otherwise(line)
    e.select(cut.alias("value")).write.text(path)
    return files.json_lines(spark, path, "event_id bigint, event_type string", strict=False).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


# ledgers and gates
@query("""WITH l AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS number FROM events), d AS (SELECT * FROM l WHERE event_id % 50 > 0)
SELECT count(*) AS done, count(*) FILTER (event_type = 'click') AS unfinished, count(*) FILTER (event_id % 30 = 7) AS misplaced, (max(number) + 1 - count(DISTINCT number))::BIGINT AS gaps, count(*) FILTER (event_type = 'click') = 0 AND count(*) FILTER (event_id % 30 = 7) = 0 AND max(number) + 1 = count(DISTINCT number) AS resumable FROM d""")
def resume_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All users' events as one ledger with entries of other keys and unfinished ones, against the plan."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type").withColumn("one", F.lit(1))
    numbered = K.numbered_ranges(e, ["user_id"], ["event_id"], "one").select((F.col("first_number") - 1).alias("number"), "user_id", "event_id", "event_type")
    # a number stands for each user once: the plan's keys are per number and user
    key = F.concat_ws(":", F.col("user_id").cast("string"), F.col("number").cast("string"))
    plan = numbered.select(F.struct("number", "user_id").alias("at"), key.alias("key"))
    done = numbered.where("event_id % 50 > 0").select(F.struct("number", "user_id").alias("at"), "number", F.when(F.col("event_id") % 30 == 7, "other").otherwise(key).alias("key"), F.when(F.col("event_type") == "click", "failed").otherwise("complete").alias("state"))
    both = done.join(plan.withColumnRenamed("key", "planned"), "at")
    return ledger.resume_counts(both, "number", "key", "planned", "state")


@query("""SELECT conv_id, max(turn)::BIGINT AS last_attempt, count(*) AS attempts, bool_or(role = 'system') AS complete, NOT bool_or(role = 'system') AND count(*) < 4 AS may_retry FROM conversations GROUP BY 1""")
def request_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("attempt"), F.when(F.col("role") == "system", "complete").otherwise("failed").alias("state"))
    return ledger.attempts(turns, "conv_id", most=4)


@query(f"""WITH {_ERRORS}, v AS (SELECT a.sample_id, sum(abs(a.value - b.value) * width) AS e FROM ({VIEWS.replace('lines AS', 'WITH lines AS', 1)} SELECT * FROM views) a JOIN curves b USING (sample_id, pos) JOIN {_W} USING (pos) WHERE a.l_returnflag = 'R' GROUP BY 1),
e AS (SELECT substr(sample_id, 1, 8) AS family, em.e - v.e AS d FROM em JOIN v USING (sample_id)), s AS (SELECT family, avg(d) AS mean_improvement, count(*) FILTER (d > 1e-9) AS improved, count(*) AS samples, (sum(d) - max(d)) / (count(*) - 1) AS rest FROM e GROUP BY 1 HAVING count(*) > 1)
SELECT family, round(mean_improvement, 6) AS mean_improvement, improved, samples, improved % 2 = 0 AS view_not_worse, mean_improvement >= 1 AND 2 * improved >= samples AND improved % 2 = 0 AND rest > 0 AS eligible FROM s""")
def screen_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of nations judged by the gate: their returned lines' curves against the others' mean."""
    curves = nation_curves(spark, sf_dir)
    mean = A.loo_mean(curves).select("sample_id", C.emd(F.col("cdf"), F.col("predicted")).alias("reference"))
    own = view_curves(spark, sf_dir).where("l_returnflag = 'R'").select("sample_id", F.col("cdf").alias("view")).join(curves, "sample_id").select("sample_id", C.emd(F.col("cdf"), F.col("view")).alias("error"))
    each = mean.join(own, "sample_id").select(F.substring("sample_id", 1, 8).alias("family"), "reference", "error")
    judged = A.screened(A.improvement(each, keys=["family"]).where("samples > 1").withColumns({"worse": F.col("improved") % 2, "limit": F.lit(0)}), "worse", "limit")
    return judged.select("family", r6("mean_improvement").alias("mean_improvement"), "improved", "samples", "view_not_worse", "eligible")


@query(f"""WITH c AS (SELECT l_suppkey, pos, 100.0::DOUBLE * count(*) FILTER (l_extendedprice <= threshold) / count(*) AS y FROM lineitem, {_T} GROUP BY 1, 2), s AS (SELECT l_suppkey, l_suppkey % 17 = 3 AS bent, pos, CASE WHEN l_suppkey % 17 = 3 AND pos = 4 THEN y + 50 WHEN l_suppkey % 17 = 5 AND pos = 10 THEN 99.5 WHEN l_suppkey % 17 = 6 AND pos = 2 THEN NULL ELSE y END AS v FROM c WHERE l_suppkey % 17 <> 1),
d AS (SELECT *, v - lag(v) OVER (PARTITION BY l_suppkey ORDER BY pos) AS step FROM s), k AS (SELECT l_suppkey, bool_or(v IS NULL OR v < 0 OR v > 100 OR coalesce(step < -1e-9, false)) AS bad, bool_or(pos = 10 AND abs(v - 100) > 1e-9) AS open, CASE WHEN l_suppkey % 17 = 2 THEN 2 ELSE 1 END AS times FROM d GROUP BY 1)
SELECT sum(times)::BIGINT AS rows, count(*) FILTER (times = 2) AS duplicate_keys, (SELECT count(DISTINCT l_suppkey) FROM c WHERE l_suppkey % 17 = 1) AS missing, 0::BIGINT AS extra, coalesce(sum(times) FILTER (bad), 0)::BIGINT AS bad_curves, coalesce(sum(times) FILTER (open), 0)::BIGINT AS open_ends FROM k""")
def submission_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' curves as a submission in which some are bent, some open, some have a hole, some are lacking and some come twice."""
    from ..operators import submission

    curves = suppliers(spark, sf_dir).select("l_suppkey", "cdf")
    k, at = F.col("l_suppkey") % 17, lambda i: F.get("cdf", i)
    value = lambda i: F.when((k == 3) & (i == 4), at(i) + 50).when((k == 5) & (i == 10), 99.5).when((k == 6) & (i == 2), F.lit(None).cast("double")).otherwise(at(i))
    template = C.to_wide(curves)
    sent = curves.select("l_suppkey", *(value(i).alias(label) for i, label in enumerate(C.LABELS))).where(k != 1)
    report = submission.submission_report(sent.unionByName(sent.where(k == 2)), template, "l_suppkey")
    return report.select("rows", "duplicate_keys", "missing", "extra", "bad_curves", "open_ends")

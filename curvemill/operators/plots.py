"""The tables behind a survey's plots: curves, a heat map of bin masses, a contact sheet, and the summary page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import curves as C
from . import aggregate as A
from .keys import first_per

#: Fixed layout of the contact sheet: tiles a row, their size, the picture's and the label's offset, longest label, and most tiles.
COLUMNS, TILE, PICTURE, LABEL, LETTERS, TILES = 4, (220, 185), (20, 10), (20, 155), 30, 24


def curve_lines(curves: DataFrame, key: str) -> DataFrame:
    """(series, x, y): a row a point of each curve, x being the diameter in mm."""
    support = C.numbers(C.SUPPORT)
    return A.points(curves, [key]).select(F.col(key).cast("string").alias("series"), F.get(support, F.col("pos")).alias("x"), F.col("value").alias("y"))


def bin_map(curves: DataFrame, key: str) -> DataFrame:
    """(series, bin, label, share): the mass in each bin."""
    labels = F.array(*map(F.lit, C.LABELS))
    masses = A.points(curves.select(key, C.masses(F.col("cdf")).alias("cdf")), [key])
    return masses.select(F.col(key).cast("string").alias("series"), F.col("pos").alias("bin"), F.get(labels, F.col("pos")).alias("label"), F.col("value").alias("share"))


def contact_sheet(index: DataFrame, tiles: int = TILES) -> DataFrame:
    """(tile, path, label, picture_x, picture_y, label_x, label_y): the first photo of each matched sample, by split and path, at its place; `tiles` of them, as many as the sheet holds."""
    firsts = first_per(index.where("is_matched"), ["split", "sample_id"], ["path"])
    shown = firsts.orderBy("split", "path").limit(tiles)
    at = shown.withColumn("tile", F.row_number().over(Window.orderBy("split", "path")) - 1)  # a sheet's tiles
    left, top = (F.col("tile") % COLUMNS) * TILE[0], F.floor(F.col("tile") / COLUMNS).cast("int") * TILE[1]
    label = F.substring(F.trim(F.concat_ws("  ", "sample_id", F.coalesce("camera", F.lit("")))), 1, LETTERS)
    return at.select("tile", "path", label.alias("label"), *((v + d).cast("int").alias(n) for n, v, d in (("picture_x", left, PICTURE[0]), ("picture_y", top, PICTURE[1]), ("label_x", left, LABEL[0]), ("label_y", top, LABEL[1]))))


def summary(curves: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """One row: samples, photos, unmatched ones and cameras; the errors of equal bins and of the others' mean and median; the mean error between samples."""
    score = lambda df: df.agg(F.avg(C.emd(F.col("cdf"), F.col("p"))))
    parts = [
        curves.agg(F.count("*").alias("samples")),
        index.agg(F.count_if(F.col("split") == "train").alias("train_photos"), F.count_if(F.col("split") == "test").alias("test_photos"), F.count_if(~F.col("is_matched")).alias("unmatched_photos"), F.countDistinct(F.nullif("camera", F.lit(""))).alias("cameras")),
        score(curves.withColumn("p", C.equal_bins())).toDF("equal_bins"),
        score(A.loo_mean(curves).withColumnRenamed("predicted", "p")).toDF("loo_mean"),
        score(A.loo_median(curves, key).withColumnRenamed("predicted", "p")).toDF("loo_median"),
        A.pair_means(curves.select("cdf")).select(F.col("emd").alias("pairwise")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out

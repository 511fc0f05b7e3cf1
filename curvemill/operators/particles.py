"""Regions of unlabelled images, as tables of pixels (image, y, x, value): gradient, calm inner areas, seeds, flooding.

An image is a full grid with y and x from 0. Images may be any number: all steps are expressions over an image's lines (arrays as long as a side), windows within a line, or rounds of joins
over all images' pixels at once, so neither an image nor a region is gathered in one task.

Flooding lets each pixel belong to the seed that it reaches over the least rise: the arc between two neighbours rises by the difference of their elevations, and pixels are joined along
the least arcs first, never two seeds. Arcs of one rise are taken in the order of their pixels, so the result is defined to the pixel. It is built in rounds: every unlabelled part
chooses its least arc, chosen arcs are followed to their end by pointer jumping, parts are contracted and keep the least arc to each neighbour. Rounds are about the logarithm
of a part's pixels; each is a written table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .aggregate import quantiles
from .working import running, written

#: Fixed values of the method: gradient scale and disk radius in mm, least sigma in pixels, share of calm pixels, steps of elevation, Gaussian cut-off.
SIGMA_MM, RADIUS_MM, LEAST_SIGMA, CALM, LEVELS, CUT = 0.25, 0.5, 0.5, 0.25, 65535, 4.0
FLAT = 1e-12
#: The room that a pixel outside the image has.
OUTSIDE = -1


def _lined(pixels: DataFrame, along: str, across: str, columns: list[str]) -> DataFrame:
    """(image, across, line): each line of pixels as an array of structs in the order of `along`."""
    return pixels.groupBy("image", across).agg(F.array_sort(F.collect_list(F.struct(along, *columns))).alias("line"))


def _unlined(lines: DataFrame, along: str, across: str, columns: dict[str, Column]) -> DataFrame:
    """Pixels of lines, with arrays given as columns."""
    each = F.posexplode(F.arrays_zip(*(c.alias(n) for n, c in columns.items())))
    return lines.select("image", across, each.alias(along, "_p")).select("image", "y", "x", *(F.col(f"_p.{n}").alias(n) for n in columns))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: as a lambda's argument it is not put in wherever it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def _correlated(line: Column, weights: list[float]) -> Column:
    """An array's correlation with weights around their middle, the array mirrored at its ends."""
    return _let(line, lambda values: _taps(values, weights))


def _taps(line: Column, weights: list[float]) -> Column:
    n, r = F.size(line), len(weights) // 2
    taps = F.array(*(F.struct(F.lit(i - r).alias("k"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)))

    def at(t: Column) -> Column:
        def add(total: Column, tap: Column) -> Column:
            m = F.pmod(t + tap["k"], 2 * n)
            return total + tap["w"] * F.get(line, F.when(m < n, m).otherwise(2 * n - 1 - m))

        return F.aggregate(taps, F.lit(0.0), add)

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def gradient(pixels: DataFrame, sigma: float) -> DataFrame:
    """(image, y, x, gradient): the magnitude of the Gaussian gradient."""
    r = int(CUT * sigma + 0.5)
    bell = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    smooth = [b / sum(bell) for b in bell]
    slope = [k / sigma**2 * w for k, w in zip(range(-r, r + 1), smooth, strict=True)]
    values = F.transform("line", lambda p: p["value"])
    rows = _unlined(_lined(pixels, "x", "y", ["value"]), "x", "y", {"smooth": _correlated(values, smooth), "slope": _correlated(values, slope)})
    columns = _lined(rows, "y", "x", ["smooth", "slope"])
    dy = _correlated(F.transform("line", lambda p: p["smooth"]), slope)
    dx = _correlated(F.transform("line", lambda p: p["slope"]), smooth)
    return _unlined(columns, "y", "x", {"gradient": F.zip_with(dx, dy, lambda a, b: F.hypot(a, b))})


def calm(gradients: DataFrame, share: float = CALM) -> DataFrame:
    """(image, y, x, gradient, inner): whether a pixel's gradient is at most that quantile of its image."""
    q = quantiles(gradients, "gradient", [share], ["image"]).withColumnRenamed(f"q{round(100 * share)}", "limit")
    return gradients.join(q, "image").select("image", "y", "x", "gradient", (F.col("gradient") <= F.col("limit")).alias("inner"))


def opened(pixels: DataFrame, radius: float) -> DataFrame:
    """(image, y, x, inner) after an opening of inner by a disk; what is outside the image is not inner.

    Along lines a window gives the distance to the next pixel of the other kind, so the disk is met line by line: a pixel stays if each line of the disk fits
    between the borders of that line, and comes back if a line of the disk reaches a pixel that stayed."""
    disk = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(math.isqrt(int(radius * radius - k * k))).alias("w")) for k in range(-int(radius), int(radius) + 1)))
    row = Window.partitionBy("image", "y").orderBy("x")
    before, after = row.rowsBetween(Window.unboundedPreceding, 0), row.rowsBetween(0, Window.unboundedFollowing)
    outer = F.when(~F.col("inner"), F.col("x"))
    end = F.max("x").over(row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) + 1
    room = F.least(F.col("x") - F.coalesce(F.max(outer).over(before), F.lit(-1)), F.coalesce(F.min(outer).over(after), end) - F.col("x")) - 1
    lines = _lined(pixels.select("image", "y", "x", room.alias("room")), "y", "x", ["room"])
    each = lambda v, test: F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda t: test(disk, lambda d: F.coalesce(F.get(v, t + d["k"]), F.lit(OUTSIDE)) >= d["w"]))
    whole = _let(F.transform("line", lambda p: p["room"]), lambda v: each(v, F.forall))
    stays = _unlined(lines, "y", "x", {"stays": whole})
    seed = F.when(F.col("stays"), F.col("x"))
    away = F.least(F.col("x") - F.max(seed).over(before), F.min(seed).over(after) - F.col("x"))
    lines = _lined(stays.select("image", "y", "x", away.alias("away")), "y", "x", ["away"])
    reach = lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda t: F.exists(disk, lambda d: F.coalesce(F.get(v, t + d["k"]) <= d["w"], F.lit(False))))
    back = _let(F.transform("line", lambda p: p["away"]), reach)
    return _unlined(lines, "y", "x", {"inner": back})


def _arcs(pixels: DataFrame, value: str) -> DataFrame:
    """(a, b, rise) between each pixel and its neighbours after it, of eight."""
    steps = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    here = pixels.select("image", "y", "x", F.col(value).alias("va"), steps.alias("s"))
    here = here.select(F.struct("image", "y", "x").alias("a"), "va", F.struct("image", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).alias("b"))
    there = pixels.select(F.struct("image", "y", "x").alias("b"), F.col(value).alias("vb"))
    return here.join(there, "b").select("a", "b", F.abs(F.col("va") - F.col("vb")).alias("rise"))


def merged(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node, root, label) of nodes (node, label or null) joined along arcs (a, b, rise), the least first, as long as not both sides have a label; label is the part's."""
    order = F.struct("rise", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))
    both = arcs.where("a <> b").select("a", "b", order.alias("o"))
    both = both.select(F.col("a").alias("c"), F.col("b").alias("d"), "o").union(both.select("b", "a", "o")).groupBy("c", "d").agg(F.min("o").alias("o"))
    labels = written(nodes.select(F.col("node").alias("c"), "label"))
    both = written(_open(both, labels))
    parts = written(nodes.select("node", F.col("node").alias("root")))
    while True:
        best = both.join(labels.where("label is null").select("c"), "c", "left_semi").groupBy("c").agg(F.min_by("d", "o").alias("d"))
        to = written(labels.join(best, "c", "left").select("c", F.coalesce("d", "c").alias("to")))
        if to.where("to <> c").isEmpty():
            break
        # of two parts that chose each other the smaller one is the root
        back = to.select(F.col("c").alias("to"), F.col("to").alias("then"))
        to = written(to.join(back, "to").select("c", F.when((F.col("then") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to")))
        while True:
            jump = to.join(to.select(F.col("c").alias("to"), F.col("to").alias("then")), "to")
            jump = written(jump.select("c", F.col("then").alias("to"), (F.col("then") != F.col("to")).alias("moved")))
            to = jump.select("c", "to")
            if jump.where("moved").isEmpty():
                break
        parts = written(parts.join(to.withColumnRenamed("c", "root"), "root").select("node", F.col("to").alias("root")))
        labels = written(labels.join(to.where("c = to").select("c"), "c", "left_semi"))
        moved = both.join(to, "c").select(F.col("to").alias("c"), "d", "o")
        moved = moved.join(to.select(F.col("c").alias("d"), F.col("to").alias("e")), "d").select("c", F.col("e").alias("d"), "o").where("c <> d")
        both = written(_open(moved.groupBy("c", "d").agg(F.min("o").alias("o")), labels))
    return parts.join(labels.withColumnRenamed("c", "root"), "root").select("node", "root", "label")


def _open(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """arcs (c, d, o) whose ends don't both have a label."""
    free = labels.select("c", F.col("label").isNull().alias("free_c"))
    out = arcs.join(free, "c").join(free.select(F.col("c").alias("d"), F.col("free_c").alias("free_d")), "d")
    return out.where("free_c or free_d").select("c", "d", "o")


def seeds(pixels: DataFrame) -> DataFrame:
    """(image, y, x, seed) of pixels (image, y, x, inner): connected inner areas, eight neighbours being connected, numbered from 1 in each image by their first pixel; 0 elsewhere."""
    inner = written(pixels.where("inner").select("image", "y", "x", F.lit(0).alias("v")))
    nodes = inner.select(F.struct("image", "y", "x").alias("node"), F.lit(None).cast("long").alias("label"))
    parts = written(merged(nodes, _arcs(inner, "v")))
    firsts = parts.groupBy("root").agg(F.min("node").alias("first")).select("root", F.col("first.image").alias("image"), "first", F.lit(1).alias("one"))
    numbers = running(firsts, ["image"], ["first"], "one", "seed").select("root", "seed")
    known = parts.join(numbers, "root").select("node.*", "seed")
    return pixels.select("image", "y", "x").join(known, ["image", "y", "x"], "left").withColumn("seed", F.coalesce("seed", F.lit(0)).cast("long"))


def flooded(pixels: DataFrame) -> DataFrame:
    """(image, y, x, label) of pixels (image, y, x, elevation, seed): every pixel gets the label of a seed; 0 in images without seeds."""
    pixels = written(pixels)
    nodes = pixels.select(F.struct("image", "y", "x").alias("node"), F.when(F.col("seed") > 0, F.col("seed")).alias("label"))
    # the pixels of a seed are one part from the start
    parts = merged(nodes, _arcs(pixels, "elevation"))
    return parts.select("node.*", F.coalesce("label", F.lit(0)).cast("long").alias("label"))


def elevations(gradients: DataFrame) -> DataFrame:
    """gradients with elevation: whole steps of the image's greatest gradient; images that are flat get none above 0 and lose their inner pixels."""
    top = gradients.groupBy("image").agg(F.max("gradient").alias("top"))
    flat = F.col("top") <= FLAT
    return gradients.join(top, "image").select("image", "y", "x", F.when(flat, 0).otherwise(F.rint(F.col("gradient") / F.col("top") * LEVELS)).cast("int").alias("elevation"), (F.col("inner") & ~flat).alias("inner"))


def particle_regions(pixels: DataFrame, ppm: float) -> DataFrame:
    """(image, y, x, label, seed) of gray images (image, y, x, value) at ppm pixels a mm: seeds are calm areas that hold a disk, and all pixels are flooded from them."""
    if not ppm > 0 or ppm == float("inf"):
        raise ValueError("ppm must be positive and finite")
    inner = written(elevations(calm(written(gradient(pixels, max(LEAST_SIGMA, SIGMA_MM * ppm))))))
    marked = written(seeds(opened(inner, RADIUS_MM * ppm)))
    both = written(inner.select("image", "y", "x", "elevation").join(marked, ["image", "y", "x"]))
    return flooded(both).join(marked, ["image", "y", "x"])

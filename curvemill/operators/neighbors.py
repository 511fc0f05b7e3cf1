"""k nearest neighbours of curves, with features scaled by the training rows.

Training rows are put into cells, each around one of PIVOTS rows at most, and neighbouring cells are packed into blocks. A query first meets the block of its own cell, which bounds the
distance of its k-th neighbour; then it meets those blocks only that the triangle inequality can't rule out: a cell whose radius falls short of
the query by more than the bound, or which lies beyond the bound past the plane between the two pivots, holds no neighbour. With few features most blocks are never met; with many
features that are all alike far, all are, as every exact method must. Each pair of blocks of queries and training rows is a task of its own that keeps the best k of every query; the bests of
all blocks are merged by rank. Pivots and a few numbers a cell reach the driver, no other row does or is broadcast, and a task holds one block of either side. Queries with scales of their own
(leave-one-out) meet all rows, in rounds: in each, every block of queries meets the same SPAN * TRAIN rows, and what it finds is merged with what was found before. Shuffle files and tables of
a round are deleted when it ends, so that, whatever the number of pairs, the disk holds a few times the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import curves as C
from .working import cleaned, dropped, written

#: Rows of a block of training rows or of queries at most, and distances that a task holds at once.
TRAIN, CELLS = 10_000, 1_000_000
#: Times TRAIN rows that all queries meet in a round.
SPAN = 4
#: Parts of a block, a neighbour, whose minima bound the k-th least distance.
PARTS = 32
#: Cells at most, and training rows of a cell if there are not too many cells then.
PIVOTS, CELL = 512, 500
#: Neighbour counts to choose from.
COUNTS = (1, 3, 5, 7)


def scales(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row of population deviations; those under 1e-12 are 1."""
    s = lambda c: F.stddev_pop(c)
    return train.agg(*(F.when(s(c) < 1e-12, 1.0).otherwise(s(c)).alias(c) for c in columns))


def _array(columns: list[str]) -> Column:
    return F.array(*(F.col(c).cast("double") for c in columns))


def nearest(queries: DataFrame, train: DataFrame, columns: list[str], k: int, key: str = "sample_id", pos: str = "pos", exclude_self: bool = False, rows: int = TRAIN) -> DataFrame:
    """(query key, train key as neighbor, distance, rank): k nearest training rows of each query; ties by the training rows' pos. rows: training rows of a block."""
    return pruned(queries, train, columns, k, key, pos, exclude_self, rows)[0]


def pruned(queries: DataFrame, train: DataFrame, columns: list[str], k: int, key: str = "sample_id", pos: str = "pos", exclude_self: bool = False, rows: int = TRAIN) -> tuple[DataFrame, float]:
    """nearest(), and the share of all pairs of a query and a training row whose blocks met."""
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be a positive integer")
    s = scales(train, columns).first()
    if s is None or s[0] is None:
        raise ValueError("at least one training row is needed")
    scale = np.array([float(s[c]) for c in columns])
    q = queries.select(F.col(key).alias("q"), _array(columns).alias("x"))
    t = train.select(F.col(key).alias("neighbor"), F.col(pos).alias("pos"), _array(columns).alias("y"))
    if t.count() <= rows:
        return _best(q, t, k, exclude_self, lambda x: np.broadcast_to(scale, x.shape)).withColumnRenamed("q", key), 1.0
    cells, dealt = _celled(t, scale, rows)
    near, first = _meet(q, dealt, cells, k, exclude_self, None)
    heads = near.where("x is not null").select("q", "x", "bound", "home")
    rest, second = _meet(heads, dealt, cells, k, exclude_self, "bound")
    found = near.where("neighbor is not null").select("q", "neighbor", "pos", "distance").unionByName(rest.where("neighbor is not null").select("q", "neighbor", "pos", "distance"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "pos"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "neighbor", "distance", "rank")
    return found.withColumnRenamed("q", key), (first + second) / max(1, q.count() * int(cells.size.sum()))


class _Cells:
    """Of each cell its pivot, radius and first block, of each block its rows: what tasks are given. A cell above `rows` is cut into several blocks."""

    def __init__(self, pivots: np.ndarray, scale: np.ndarray):
        self.pivots, self.scale = pivots / scale, scale

    def pack(self, size: np.ndarray, radius: np.ndarray, rows: int) -> None:
        """Cells are packed along the direction in which pivots differ most."""
        self.size, self.radius = size, radius
        axis = np.linalg.svd(self.pivots - self.pivots.mean(0), full_matrices=False)[2][0]
        self.first, self.parts, block, held = np.zeros(len(size), np.int64), np.ones(len(size), np.int64), -1, rows + 1
        for c in np.argsort(self.pivots @ axis, kind="stable"):
            if held + size[c] > rows:
                block, held = block + 1, 0
            self.first[c], self.parts[c] = block, -(-max(1, size[c]) // rows)
            block, held = block + self.parts[c] - 1, held + size[c] if self.parts[c] == 1 else rows + 1
        self.blocks = block + 1

    def away(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows from all pivots."""
        x, p = x / self.scale, self.pivots
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1), 0))

    def slices(self, n: int) -> Iterator[slice]:
        """n rows in slices that meet CELLS cells or blocks at most."""
        step = max(1, CELLS // max(len(self.pivots), self.blocks))
        return (slice(i, i + step) for i in range(0, n, step))

    def routes(self, x: np.ndarray, bound: np.ndarray | None, home: np.ndarray | None, mark: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, block), a slice of queries at a time: without a bound each query's own block, else all others that may hold a row nearer than the bound."""
        if bound is not None:
            between = np.stack([np.linalg.norm(self.pivots - p, axis=1) for p in self.pivots])
            cells = np.repeat(np.arange(len(self.parts)), self.parts)  # of each block its cells
            blocks = self.first[cells] + np.arange(len(cells)) - np.repeat(np.cumsum(self.parts) - self.parts, self.parts)
            order = np.argsort(blocks, kind="stable")
            cells, begins = cells[order], np.searchsorted(blocks[order], np.arange(self.blocks))
        for at in self.slices(len(x)):
            far = self.away(x[at])
            own = far.argmin(1)
            if bound is None:
                yield np.arange(at.start, at.start + len(far)), self.first[own] + mark[at] % self.parts[own]
                continue
            mine = far[np.arange(len(far)), own]
            plane = (far * far - (mine * mine)[:, None]) / np.maximum(2 * between[own], 1e-12)
            least = np.maximum(far - self.radius, plane) * (1 - 1e-7) - 1e-7  # a little less, for rounding
            near = (least <= bound[at, None]) & (self.size > 0)
            hit = np.logical_or.reduceat(near[:, cells], begins, axis=1)
            hit[np.arange(len(far)), home[at]] = False
            query, block = np.nonzero(hit)
            yield query + at.start, block


def _celled(t: DataFrame, scale: np.ndarray, rows: int) -> tuple[_Cells, DataFrame]:
    """The cells of training rows (neighbor, pos, y), and the rows (written) with their block b."""
    n = t.count()
    pivots = t.orderBy(F.xxhash64("neighbor"), "neighbor").limit(min(PIVOTS, max(1, -(-n // CELL)))).collect()
    cells, kinds = _Cells(np.array([r["y"] for r in pivots]), scale), dict(t.dtypes)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                y, cell, least = _matrix(batch.column("y")), np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
                step = max(1, CELLS // len(pivots))
                for i in range(0, len(y), step):
                    far = cells.away(y[i : i + step])
                    cell[i : i + step], least[i : i + step] = far.argmin(1), far.min(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(least)], [*batch.schema.names, "cell", "far"])

    placed = written(t.mapInArrow(place, f"neighbor {kinds['neighbor']}, pos {kinds['pos']}, y array<double>, cell int, far double"))
    size, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row a cell
        size[r["cell"]], radius[r["cell"]] = r["n"], r["far"]
    cells.pack(size, radius, rows)
    at = lambda values: F.get(F.array(*(F.lit(int(v)) for v in values)), F.col("cell"))
    dealt = placed.select("neighbor", "pos", "y", (at(cells.first) + F.pmod(F.xxhash64("neighbor"), at(cells.parts))).cast("int").alias("b"))
    cells.block_rows = np.zeros(cells.blocks, np.int64)
    for r in dealt.groupBy("b").count().collect():  # a row a block
        cells.block_rows[r["b"]] = r["count"]
    return cells, dealt


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _meet(q: DataFrame, dealt: DataFrame, cells: _Cells, k: int, exclude_self: bool, bound: str | None) -> tuple[DataFrame, int]:
    """The k nearest rows in the blocks that queries are sent to, written, and the number of pairs that met. Each query of the first round also gets a row with its x, its
    k-th distance there (infinite if there are fewer) and its block."""
    kind, kinds = dict(q.dtypes)["q"], dict(dealt.dtypes)
    marked = q.withColumn("mark", F.pmod(F.xxhash64("q"), F.lit(1 << 30)))

    def routed(batch, m):
        given = (batch.column(bound).to_numpy(), batch.column("home").to_numpy()) if bound else (None, None)
        return cells.routes(_matrix(batch.column("x")), *given, m)

    def count(batches):
        n = np.zeros(cells.blocks, np.int64)
        for batch in batches:
            if batch.num_rows:
                for _, block in routed(batch, batch.column("mark").to_numpy()):
                    n += np.bincount(block, minlength=cells.blocks)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells.blocks)), pa.array(n)], ["b", "n"])

    many = np.zeros(cells.blocks, np.int64)
    for r in marked.mapInArrow(count, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n")).collect():  # a row a block
        many[r["b"]] = r["n"]
    groups = np.maximum(1, -(-many // TRAIN))

    def send(batches):
        for batch in batches:
            if batch.num_rows:
                m = batch.column("mark").to_numpy()
                for query, block, i in ((q, b, i) for q, b in routed(batch, m) for i in range(0, len(q), 20_000)):
                    at, b = pa.array(query[i : i + 20_000]), block[i : i + 20_000]
                    a = m[query[i : i + 20_000]] % groups[b]
                    yield pa.RecordBatch.from_arrays([batch.column("q").take(at), batch.column("x").take(at), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["q", "x", "a", "b"])

    sent = marked.mapInArrow(send, f"q {kind}, x array<double>, a int, b int")
    copies = F.get(F.array(*(F.lit(int(g if n else 0)) for g, n in zip(groups, many, strict=True))), F.col("b"))
    met = dealt.where(copies > 0).withColumn("a", F.explode(F.sequence(F.lit(0), copies - 1)))
    scale, first = cells.scale, bound is None

    def pair(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = {n: [] for n in ("q", "neighbor", "pos", "distance", "x", "bound", "home")}
        if len(queries):
            x = _matrix(queries["x"].combine_chunks())
            own, b = queries["q"], queries["b"][0].as_py()
            reach = np.full(len(x), np.inf)
            if len(rows):
                y, t, pos = _matrix(rows["y"].combine_chunks()), rows["neighbor"].to_numpy(), rows["pos"].to_numpy()
                order = np.empty(len(pos), np.int64)
                order[np.argsort(pos, kind="stable")] = np.arange(len(pos))
                s, block = np.broadcast_to(scale, x.shape), _Rows(y, order, scale)
                for i in range(0, len(x), step := max(1, CELLS // len(y))):
                    part = slice(i, i + step)
                    a, c, far = _closest(x[part], s[part], block, own.to_numpy()[part, None] == t[None] if exclude_self else None, k)
                    n = np.bincount(a, minlength=len(x[part]))
                    full = np.flatnonzero(n == k)
                    reach[i + full] = np.sqrt(far[np.searchsorted(a, full) + k - 1])
                    out["q"].append(own.take(pa.array(a + i)))
                    out["neighbor"].append(rows["neighbor"].take(pa.array(c)))
                    out["pos"].append(rows["pos"].take(pa.array(c)))
                    out["distance"].append(pa.array(far))
        found = pa.table({n: pa.chunked_array([p for c in out[n] for p in (c.chunks if isinstance(c, pa.ChunkedArray) else [c])], types[n]) for n in ("q", "neighbor", "pos", "distance")})
        found = pa.table({**{n: found[n] for n in found.column_names}, **{n: pa.nulls(len(found), types[n]) for n in ("x", "bound", "home")}})
        if not first or not len(queries):
            return found
        heads = pa.table({"q": own, "neighbor": pa.nulls(len(x), types["neighbor"]), "pos": pa.nulls(len(x), types["pos"]), "distance": pa.nulls(len(x), types["distance"]), "x": queries["x"], "bound": pa.array(reach), "home": pa.array(np.full(len(x), b, np.int32))})
        return pa.concat_tables([found, heads.cast(found.schema)])

    arrow = {f.name: f.type for f in to_arrow_schema(q.select("q", "x").schema)} | {f.name: f.type for f in to_arrow_schema(dealt.select("neighbor", "pos").schema)}
    types = {n: arrow[n] for n in ("q", "neighbor", "pos")} | {"distance": pa.float64(), "x": pa.list_(pa.float64()), "bound": pa.float64(), "home": pa.int32()}
    out = sent.groupBy("a", "b").cogroup(met.groupBy("a", "b")).applyInArrow(pair, f"q {kind}, neighbor {kinds['neighbor']}, pos {kinds['pos']}, distance double, x array<double>, bound double, home int")
    return written(out), int((many * cells.block_rows).sum())


class _Rows:
    """Training rows of a task (y, and their order in ties), and their scaled form by which queries of scales near r are sent through one matrix product."""

    def __init__(self, y: np.ndarray, order: np.ndarray, r: np.ndarray):
        self.y, self.order, self.r = np.asfortranarray(y), order, r
        fine = np.isfinite(y).all(1)
        z = np.where(fine[:, None], y / r, 0.0)
        size = np.where(fine, (z * z).sum(1), np.inf)
        self.low, self.slack = np.vstack([z.T, size * (1 - 1e-9)]), 2e-9 * size  # slack for rounding


def _closest(x: np.ndarray, s: np.ndarray, rows: _Rows, same: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, training row, distance) of the k least sums of ((x - y) / s) ** 2 of each query, ties by order. same: pairs that don't count.

    Matrix products give the distances but for rounding; what may be among the k best is computed again as it is defined. Scales of a query that differ from r by factors between a and b
    change squares by factors between their squares, so one product with scales r serves all queries whose factors lie close together."""
    with np.errstate(all="ignore"):
        factor = rows.r / s
        wide = (factor.max(1) / factor.min(1)) ** 2
        if (factor > 0).all() and (wide <= 1.1).all():
            z = x / rows.r
            size = (z * z).sum(1)[:, None]
            low = np.hstack([-2 * z, np.ones((len(z), 1))]) @ rows.low  # squares, less those of the queries and slack
            least, slack, wide = size * (1 - 1e-9), rows.slack, wide[:, None] * (1 + 1e-12)
            size = size * (1 + 1e-9)
        else:
            w = 1 / (s * s)
            size, square = (x * x * w).sum(1)[:, None], w @ (rows.y * rows.y).T
            slack = 1e-9 * (square + size + 1e-300)
            low = (x * (-2 * w)) @ rows.y.T + square + size - slack
            low[:, ~np.isfinite(rows.y).all(1)] = np.inf
            least, slack, wide, size = 0.0, 2 * slack, 1.0, np.where(np.isfinite(size), 0.0, np.nan)
        if same is not None:
            low[same] = np.inf
        near = _near(low, slack, size, least, wide, k)
    a, b = np.nonzero(near)
    far = (((x[a] - rows.y[b]) / s[a]) ** 2).sum(1)
    return _least(a, b, far, rows.order, k)


def _near(low: np.ndarray, slack: np.ndarray, size: np.ndarray, least: np.ndarray | float, wide: np.ndarray | float, k: int) -> np.ndarray:
    """Pairs that may be among the k nearest of each query: a square is no less than low + least, and no more than low + slack + size; wide: the factor by which the queries' own squares may differ."""
    if low.shape[1] <= k:
        return np.isfinite(low) & np.isfinite(size)
    step = PARTS * k
    if low.shape[1] >= 2 * step:  # the k-th least of minima of some columns each is no less than the k-th least of all
        most = low[:, :step] + slack[..., :step]
        for i in range(step, low.shape[1] - step + 1, step):
            np.minimum(most, low[:, i : i + step] + slack[..., i : i + step], out=most)
    else:
        most = low + slack
    limit = (np.partition(most, k - 1, axis=1)[:, k - 1 : k] + size) * wide - least
    near = low <= limit
    if not np.isfinite(limit).all():
        near &= np.isfinite(low)
    return near


def _least(a: np.ndarray, b: np.ndarray, far: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (query, training row, distance) the k least of each query, ties by the training rows' order."""
    sort = np.lexsort((order[b], far, a))
    a, b, far = a[sort], b[sort], far[sort]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    return a[rank < k], b[rank < k], far[rank < k]


def _marks(spark: SparkSession, n: int) -> list[int]:
    """n numbers that a repartition by their hash deals to a task each."""
    found = spark.range(32 * n).select(F.col("id").cast("int").alias("mark")).groupBy(F.pmod(F.hash("mark"), F.lit(n)).alias("task")).agg(F.min("mark").alias("mark")).collect()
    marks = [r["mark"] for r in found]
    return marks + list(range(-1, len(marks) - n - 1, -1))  # a task that none of them meets is not likely


def _best(q: DataFrame, t: DataFrame, k: int, exclude_self: bool, scale: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(q, neighbor, distance, rank): the k nearest rows of t (neighbor, pos, y) for each row of q (q, x), with the scales that `scale` gives for a matrix of queries."""
    tasks = q.sparkSession.sparkContext.defaultParallelism
    n_q, n_t = q.count(), t.count()
    q_blocks, rounds = max(1, -(-n_q // TRAIN)), max(1, -(-n_t // (SPAN * TRAIN)))
    q_blocks = max(q_blocks, min(-(-q_blocks // tasks) * tasks, n_q // 100))  # as many for each core
    deal = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    marks = _marks(q.sparkSession, q_blocks)
    left = q.withColumn("a", F.get(F.array(*map(F.lit, marks)), deal("q", q_blocks))).repartition(q_blocks, "a")
    kinds = dict(t.dtypes)

    def pair(queries: pa.Table, rows: pa.Table) -> pa.Table:
        matrix = lambda column: column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(queries) and len(rows):
            x, y = matrix(queries["x"]), matrix(rows["y"])
            s = scale(x)
            q, t, pos = (c.to_numpy() for c in (queries["q"], rows["neighbor"], rows["pos"]))
            order = np.empty(len(pos), np.int64)
            order[np.argsort(pos, kind="stable")] = np.arange(len(pos))
            fine = np.flatnonzero(np.isfinite(s).all(1))
            r = s[fine[len(fine) // 2]] if len(fine) else np.ones(s.shape[1])
            blocks = [(slice(j, j + TRAIN), _Rows(y[j : j + TRAIN], order[j : j + TRAIN], r)) for j in range(0, len(y), TRAIN)]
            for i in range(0, len(q), step := max(1, CELLS // min(TRAIN, len(t)))):
                own, found = slice(i, i + step), []
                for at, block in blocks:
                    a, b, far = _closest(x[own], s[own], block, q[own, None] == t[None, at] if exclude_self else None, k)
                    found.append((a, b + at.start, far))
                a, b, far = _least(*(np.concatenate(p) for p in zip(*found, strict=True)), order, k)
                parts.append((a + i, b, far))
        a, b, far = (np.concatenate(p) for p in zip(*parts, strict=True))
        return pa.table({"q": queries["q"].take(pa.array(a)), "neighbor": rows["neighbor"].take(pa.array(b)), "pos": rows["pos"].take(pa.array(b)), "distance": pa.array(far)})

    best, rank = None, F.row_number().over(Window.partitionBy("q").orderBy("distance", "pos"))
    with cleaned(q.sparkSession) if rounds > 1 else nullcontext():
        for r in range(rounds):
            right = t.where(deal("neighbor", rounds) == r).withColumn("a", F.explode(F.array(*map(F.lit, marks)))).repartition(q_blocks, "a")
            found = left.groupBy("a").cogroup(right.groupBy("a")).applyInArrow(pair, f"q {dict(q.dtypes)['q']}, neighbor {kinds['neighbor']}, pos {kinds['pos']}, distance double")
            both = found if best is None else best.drop("rank").unionByName(found)
            both, was = both.withColumn("rank", rank).where(F.col("rank") <= k), best
            best = both if rounds == 1 else written(both)
            if was is not None:
                dropped(was)
    return best.select("q", "neighbor", "distance", "rank")


def mean_of_neighbors(found: DataFrame, curves: DataFrame, key: str = "sample_id") -> DataFrame:
    """Mean curve of each query's neighbours."""
    at = found.join(curves.select(F.col(key).alias("neighbor"), "cdf"), "neighbor")
    return at.groupBy(key).agg(F.array(*(F.avg(F.element_at("cdf", i + 1)) for i in range(C.POINTS))).alias("cdf"))


def knn_curves(queries: DataFrame, train: DataFrame, columns: list[str], k: int = 3, key: str = "sample_id", pos: str = "pos") -> DataFrame:
    """Predicted curves of queries from train (key, pos, columns, cdf)."""
    return mean_of_neighbors(nearest(queries, train, columns, k, key, pos), train, key)


def loo_ranks(df: DataFrame, columns: list[str], k: int, key: str = "sample_id", pos: str = "pos") -> DataFrame:
    """Neighbours of each row among the others, with features scaled by the others alone (variance from sums minus self)."""
    sums = df.agg(F.count("*").alias("n"), F.array(*(F.sum(c).cast("double") for c in columns)).alias("sum"), F.array(*(F.sum(F.col(c) * F.col(c)).cast("double") for c in columns)).alias("square")).first()
    m, total, square = sums["n"] - 1, np.array(sums["sum"], float), np.array(sums["square"], float)

    def others(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = (total - x) / m
            spread = np.sqrt(np.maximum((square - x * x) / m - mean * mean, 0))
        return np.where(spread < 1e-12, 1.0, spread)

    rows = written(df.select(F.col(key).alias("q"), F.col(pos).alias("pos"), _array(columns).alias("x")))  # each round reads them
    t = rows.select(F.col("q").alias("neighbor"), "pos", F.col("x").alias("y"))
    return _best(rows.select("q", "x"), t, k, True, others).withColumnRenamed("q", key)


def loo_scores(df: DataFrame, columns: list[str], counts: tuple[int, ...] = COUNTS, key: str = "sample_id", pos: str = "pos") -> DataFrame:
    """(k, emd): leave-one-out error of each neighbour count, from one ranking."""
    ranks = loo_ranks(df, columns, max(counts), key, pos)
    at = ranks.join(df.select(F.col(key).alias("neighbor"), F.col("cdf").alias("near")), "neighbor")
    grid = at.withColumn("k", F.explode(F.array(*map(F.lit, counts)))).where("rank <= k")
    means = grid.groupBy(key, "k").agg(F.array(*(F.avg(F.element_at("near", i + 1)) for i in range(C.POINTS))).alias("predicted"))
    return means.join(df.select(key, "cdf"), key).groupBy("k").agg(F.avg(C.emd(F.col("cdf"), F.col("predicted"))).alias("emd"))


def best_count(scores: DataFrame) -> DataFrame:
    """The neighbour count with the least error; the larger on ties."""
    return scores.orderBy("emd", F.desc("k")).limit(1)

"""Quality classifier by co-training two views of a document that share no feature.

View one is the text's content (shares of symbols, digits, capitals, repeated words and lines, word lengths and the like, all free of the text's
size), view two its metadata (language, host, declared size, and the layout that it gives with the number and length of lines), which reads no word. Each view has a logistic regression of its own. Both
start from the labelled rows; in each of ROUNDS rounds each view labels the unlabelled documents that it is surest
of, by log-odds calibrated on held-back labelled rows, so that a view that knows little hands over little, and gives them to the other, which is fitted again. A round is taken only if both views' log loss on
the held-back rows falls; the first one that doesn't help ends the exchange. Last, each view is calibrated on held-back labelled rows, and the
score of every document is the logistic of the sum of both views' calibrated log-odds less the prior's, as evidence adds up, with factors
fitted on the held-back rows and shrunk to one: a weak view moves the score by the little that it knows, a strong one by more.

Features are DataFrame expressions over whole texts and metadata, written once as some sixty numbers a row; words and lines are split once. Fitting takes at most
LABELLED labelled rows (chosen by a hash of doc_id) to the driver; all other rows are the unlabelled ones, whichever their number: in each
round all of them are scored, the surest are marked by thresholds over all rows, and Newton's sums over the marked rows
are added up in Spark, so that only counts by margin and the sums come to the driver. Scoring is an expression. Repeated rows count
once each as unlabelled ones. Null texts count as empty; null or unseen languages and hosts and unknown sizes are classes of their own; a quality
label of null is none; contradicting labels of a doc_id count as bad; without labels of both kinds all scores are 0.5; texts of any length are
taken whole; an empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import table

#: Labelled rows that are fitted on at most.
LABELLED = 8_000
#: Rounds of exchange, and the share of the unlabelled rows that a view hands over of each class and round (by the class's share).
ROUNDS, HANDED = 4, 0.05
#: Calibrated log-odds from which on a view is sure.
SURE = 3.0
#: Width of the steps in which margins are counted, and the margin that counts as the greatest.
STEP, MOST = 0.01, 40.0
#: Every how manieth labelled row is kept back for calibration.
BACK = 4
HOST_BUCKETS = 16
LANGS = ("en", "de", "fr", "es")
#: Limits of the metadata view's classes of size, of mean line and of longest line.
SIZES = (60, 100, 200, 400, 700, 1000, 2000, 8000)
#: Strength of the shrinkage of a calibration's slope to none, in rows.
CALIBRATION = 1.0
#: Strength of the shrinkage of the joint score's factors to one, in rows.
JOINT = 4.0


def content(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """The text view. Every feature is a share or a mean, near 0 to 1; words, lines: the text split at white space and at line feeds."""
    n = F.char_length(text) + 1
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    twice = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: a == b)  # the last one has no next word
    return {
        "symbols": F.least(F.lit(1.0), 8 * count(r"[#*$%&|<>]")),
        "digits": F.least(F.lit(1.0), 8 * count(r"[0-9]")),
        "capitals": F.least(F.lit(1.0), 8 * count(r"\p{Lu}")),
        "ends": F.least(F.lit(1.0), 20 * count(r"[.!?]")),
        "word_length": F.least(F.lit(2.0), n / F.size(words) / 10),
        "distinct": F.size(F.array_distinct(words)) / F.size(words),
        "repeats": F.least(F.lit(1.0), F.size(F.filter(twice, lambda x: x)) / F.size(words) * 4),
        "line_distinct": F.size(F.array_distinct(lines)) / F.size(lines),
        "pipes": (F.regexp_count(text, F.lit(r" \| ")) / F.size(words)).cast("double"),
    }


def metadata(lang: Column, host: Column, declared: Column, lines: Column) -> dict[str, Column]:
    """The metadata view; hosts by HOST_BUCKETS hash buckets, sizes as declared, lines by their number and lengths."""
    size = F.coalesce(declared, F.lit(0)).cast("double")
    out = {f"lang_{x}": F.coalesce((lang == x).cast("double"), F.lit(0.0)) for x in LANGS}
    bucket = F.pmod(F.xxhash64(F.coalesce(host, F.lit(""))), F.lit(HOST_BUCKETS))
    out |= {f"host_{i}": (bucket == i).cast("double") for i in range(HOST_BUCKETS)}
    mean, longest = size / F.size(lines), F.array_max(F.transform(lines, lambda x: F.char_length(x)))
    out |= {f"{name}_under_{most}": (x < most).cast("double") for name, x in (("size", size), ("line", mean), ("longest", longest)) for most in SIZES}
    return out | {"log_size": F.log1p(size) / 10, "log_lines": F.log1p(F.size(lines)) / 10, "log_line": F.log1p(mean) / 10, "log_longest": F.log1p(longest) / 10, "unknown": declared.isNull().cast("double")}


@dataclass(frozen=True)
class View:
    names: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log-odds."""
        return x @ np.array(self.weights) + self.bias


@dataclass(frozen=True)
class Classifier:
    """The calibrated views, the joint score's offset and factors, and what co-training saw: log losses of the prior, the views and both on the held-back rows, rows that each view handed over in the rounds that were taken, and their number."""

    text: View
    page: View
    joint: tuple[float, float, float]
    losses: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    handed: tuple[int, int] = (0, 0)
    taken: int = 0

    def margin(self, t, p):
        """Joint log-odds of the views' margins (arrays or columns)."""
        return self.joint[0] + self.joint[1] * t + self.joint[2] * p


def _sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and negative Hessian of the rows' weighted log-likelihood at w (weights and bias)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (weight * (y - p)), (x * (weight * p * (1 - p))[:, None]).T @ x


def _newton(starts: list[np.ndarray], sums, ridge: float = 1.0) -> list[np.ndarray]:
    """Weights and bias (last) of ridge-penalised logistic regressions, by Newton steps; sums(weights of all) gives (gradient, negative Hessian) of each."""
    ws = [w.copy() for w in starts]
    for _ in range(30):
        most = 0.0
        for w, (grad, hess) in zip(ws, sums(ws), strict=True):
            penalty = np.full(len(w), ridge)
            penalty[-1] = 1e-3
            step = np.linalg.solve(hess + np.diag(penalty), grad - penalty * w)
            w += step
            most = max(most, np.abs(step).max())
        if most < 1e-6:
            break
    return ws


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    return _newton([np.zeros(x.shape[1] + 1)], lambda ws: [_sums(x, y, weight, ws[0])], ridge)[0]


@dataclass(frozen=True)
class Round:
    """What the views were in a round, and for each the last step of margins (low, high) that it hands over, with the share of that step's rows."""

    weights: tuple[np.ndarray, np.ndarray]
    low: tuple[tuple[int, float], ...]
    high: tuple[tuple[int, float], ...]


def _steps(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins of rows and the steps they are in."""
    m = x @ w[:-1] + w[-1]
    return m, np.floor(np.clip(m, -MOST, MOST) / STEP).astype(np.int64)


def _given(views: tuple[np.ndarray, np.ndarray], u: np.ndarray, history: list[Round]) -> list[np.ndarray]:
    """The labels that each view got from the other in the rounds so far (-1: none). u: numbers in [0, 1) that order rows of one step."""
    given = [np.full(len(u), -1.0) for _ in views]
    for past in history:
        for v in (0, 1):
            m, at = _steps(views[v], past.weights[v])
            to = given[1 - v]
            free = to < 0
            (low, low_share), (high, high_share) = past.low[v], past.high[v]
            to[free & (m < -SURE) & ((at < low) | (at == low) & (u < low_share))] = 0.0
            to[free & (m > SURE) & ((at > high) | (at == high) & (u < high_share))] = 1.0
    return given


def _counted(views: tuple[np.ndarray, np.ndarray], u: np.ndarray, history: list[Round], weights: list[np.ndarray]) -> dict[tuple[int, int], int]:
    """(view, step) -> rows that the view is sure of and the other has no label for."""
    given, out = _given(views, u, history), {}
    for v in (0, 1):
        m, at = _steps(views[v], weights[v])
        found, n = np.unique(at[(given[1 - v] < 0) & (np.abs(m) > SURE)], return_counts=True)
        out |= {(v, int(k)): int(c) for k, c in zip(found, n, strict=True)}
    return out


def _cut(counts: dict[int, int], wanted: int, sign: int) -> tuple[int, float]:
    """The last step, from the surest on, that belongs to the wanted rows, and the share of its rows; sign: 1 for low margins, -1 for high ones."""
    for k in sorted(counts, key=lambda k: sign * k):
        if counts[k] > wanted:
            return k, wanted / counts[k]
        wanted -= counts[k]
    return 0, 0.0  # all that are sure


class Rows:
    """Unlabelled rows in arrays."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray]) -> None:
        self.views, self.n = views, len(views[0])
        self.u = np.arange(self.n) / max(self.n, 1)

    def counted(self, history: list[Round], weights: list[np.ndarray]) -> dict[tuple[int, int], int]:
        return _counted(self.views, self.u, history, weights)

    def mark(self, history: list[Round]) -> None:
        self.given = _given(self.views, self.u, history)

    def sums(self, weights: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [_handed_sums(self.views[v], self.given[v], weights[v]) for v in (0, 1)]


def _handed_sums(x: np.ndarray, given: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    got = given >= 0
    return _sums(x[got], given[got], np.full(got.sum(), 0.5), w)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("a", "b"))


class Table:
    """Unlabelled rows of a written table (a, b: features of the views, u), of any number."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows, self.n = rows.select("a", "b", "u"), rows.count()

    def counted(self, history: list[Round], weights: list[np.ndarray]) -> dict[tuple[int, int], int]:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], int] = {}
            for batch in batches:
                if batch.num_rows:
                    for key, n in _counted(_arrays(batch), batch.column("u").to_numpy(), history, weights).items():
                        total[key] = total.get(key, 0) + n
            yield pa.RecordBatch.from_pydict({"v": pa.array([v for v, _ in total], pa.int32()), "at": pa.array([k for _, k in total], pa.int64()), "n": pa.array(total.values(), pa.int64())})

        found = self.rows.mapInArrow(count, "v int, at long, n long").groupBy("v", "at").agg(F.sum("n").alias("n"))
        return {(r["v"], r["at"]): r["n"] for r in found.collect()}  # at most 2 * 2 * MOST / STEP rows

    def mark(self, history: list[Round]) -> None:
        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    given = _given(_arrays(batch), batch.column("u").to_numpy(), history)
                    some = pa.array((given[0] >= 0) | (given[1] >= 0))
                    out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(given[0]), pa.array(given[1])], ["a", "b", "g0", "g1"])
                    yield out.filter(some)

        self.marked = table(self.rows.mapInArrow(marked, "a array<double>, b array<double>, g0 double, g1 double"))

    def sums(self, weights: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    parts = [_handed_sums(x, batch.column(f"g{v}").to_numpy(), weights[v]) for v, x in enumerate(_arrays(batch))]
                    flat = np.concatenate([part.ravel() for pair in parts for part in pair])
                    total = flat if total is None else total + flat
            if total is not None:
                yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(total))), "x": pa.array(total)})

        size = [len(w) for w in weights]
        flat = np.zeros(sum(d + d * d for d in size))
        for r in self.marked.mapInArrow(add, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
            flat[r["at"]] = r["x"]
        out, at = [], 0
        for d in size:
            out.append((flat[at : at + d], flat[at + d : at + d + d * d].reshape(d, d)))
            at += d + d * d
        return out


def _loss(margin: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(y > 0, -margin, margin))))


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray] | Rows | Table, back: np.ndarray, names: tuple[tuple[str, ...], tuple[str, ...]], rounds: int = ROUNDS) -> Classifier:
    """views: features of the labelled rows; y: their labels; pool: the unlabelled rows, or their features; back: which labelled rows are kept for calibration."""
    fit = ~back
    good = y[fit].mean()
    if isinstance(pool, tuple):
        pool = Rows(pool)

    def own(ws: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [_sums(views[v][fit], y[fit], np.ones(fit.sum()), ws[v]) for v in (0, 1)]

    def both(ws: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(g + h, m + n) for (g, m), (h, n) in zip(own(ws), pool.sums(ws), strict=True)]

    mixed = back.any() and 0 < y[back].sum() < back.sum()

    def missed(ws: list[np.ndarray]) -> float:
        """Log loss of both views on the rows kept back."""
        return sum(_loss(views[v][back] @ (w := _calibrated(views[v][back], y[back], ws[v]))[:-1] + w[-1], y[back]) for v in (0, 1)) if mixed else np.inf

    weights = _newton([np.zeros(x.shape[1] + 1) for x in views], own)
    history: list[Round] = []
    handed, taken, least = [0, 0], 0, missed(weights)
    wanted = int(HANDED * pool.n * (1 - good)), int(HANDED * pool.n * good)
    for _ in range(rounds if pool.n else 0):
        sure = [_calibrated(views[v][back], y[back], weights[v]) for v in (0, 1)]
        counts = pool.counted(history, sure)
        side = lambda v, sign: {k: n for (w, k), n in counts.items() if w == v and (k < 0) == (sign > 0)}
        history.append(Round((sure[0], sure[1]), tuple(_cut(side(v, 1), wanted[0], 1) for v in (0, 1)), tuple(_cut(side(v, -1), wanted[1], -1) for v in (0, 1))))
        offered = [sum(min(most, sum(side(v, sign).values())) for most, sign in zip(wanted, (1, -1), strict=True)) for v in (0, 1)]
        pool.mark(history)
        tried = _newton(weights, both)
        if mixed and (loss := missed(tried)) >= least:
            break
        weights, taken, least = tried, taken + 1, loss if mixed else least
        handed = [a + b for a, b in zip(handed, offered, strict=True)]
    made, margins = [], []
    for v in (0, 1):
        w = _calibrated(views[v][back], y[back], weights[v])
        made.append(View(names[v], tuple(w[:-1].tolist()), float(w[-1])))
        margins.append(made[v].margin(views[v][back]))
    truth = y[back] if mixed else y
    prior = float(np.log((truth.sum() + 1) / ((1 - truth).sum() + 1)))
    joint = _joint(np.stack(margins, 1), y[back], prior) if mixed else (-prior, 1.0, 1.0)
    model = Classifier(made[0], made[1], joint)
    losses = [_loss(m, y[back]) for m in (np.full(back.sum(), prior), *margins, model.margin(*margins))] if back.any() else [0.0] * 4
    return replace(model, losses=tuple(losses), handed=tuple(handed), taken=taken)


def _calibrated(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """w scaled and shifted so that margins are log-odds on the rows; as it is where they are of one label."""
    if not 0 < y.sum() < len(y):
        return w
    slope, shift = _fit((x @ w[:-1] + w[-1])[:, None], y, np.ones(len(y)), CALIBRATION)
    out = max(slope, 0.0) * w
    out[-1] += shift
    return out


def _joint(m: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float, float]:
    """Offset and factors of the views' margins, none below zero: a logistic regression shrunk to the plain sum less the prior."""
    x = np.hstack([np.ones((len(m), 1)), m])
    start = np.array([-prior, 1.0, 1.0])
    at = start.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + JOINT * np.eye(3), x.T @ (y - p) - JOINT * (at - start))
        at = at + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(max(at[1], 0.0)), float(max(at[2], 0.0))


def _viewed() -> tuple[dict[str, Column], dict[str, Column]]:
    return content(F.col("text"), F.col("words"), F.col("lines")), metadata(F.col("lang"), F.col("source"), F.col("n_chars"), F.col("lines"))


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, u, a, b) for each row of docs: the features of both views, and a number in [0, 1) by hash."""
    a, b = (F.array(*(F.coalesce(c.cast("double"), F.lit(0.0)) for c in view.values())) for view in _viewed())
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    text = F.coalesce("text", F.lit(""))
    # inline() keeps the optimizer from writing an expression out once more for each use
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), u.alias("u"), "lang", "source", "n_chars", text.alias("text"), F.inline(F.array(F.struct(F.split(text, r"\s+").alias("words"), F.split(text, "\n").alias("lines")))))
    return split.select("doc_id", "u", F.inline(F.array(F.struct(a.alias("a"), b.alias("b")))))


def train(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    return train_on(table(featured(docs)), labels)


def train_on(rows: DataFrame, labels: DataFrame) -> Classifier | None:
    """The classifier of written features."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("y"))
    some = table(known.orderBy(F.xxhash64("doc_id")).limit(LABELLED))
    found = rows.select("doc_id", "a", "b").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min(F.struct("a", "b")).alias("x"))
    labelled = found.orderBy("doc_id").collect()
    y = np.array([r["y"] for r in labelled], float)
    if not 0 < y.sum() < len(y):
        return None
    pool = Table(table(rows.join(F.broadcast(some), "doc_id", "left_anti").select("a", "b", "u")))
    back = np.arange(len(y)) % BACK == 0
    a, b = (tuple(view) for view in _viewed())
    return co_train(tuple(np.array([r["x"][c] for r in labelled], float) for c in ("a", "b")), y, pool, back, (a, b))


def quality(docs: DataFrame, model: Classifier | None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text_score, page_score, score, kept) for each row of docs (doc_id, text, lang, source, n_chars)."""
    return scored(featured(docs) if model else docs, model, threshold)


def scored(rows: DataFrame, model: Classifier | None, threshold: float = 0.5) -> DataFrame:
    """quality() of rows (doc_id, a, b)."""
    if model is None:
        half = F.lit(0.5)
        return rows.select(F.col("doc_id").cast("long").alias("doc_id"), half.alias("text_score"), half.alias("page_score"), half.alias("score"), F.lit(True).alias("kept"))

    def margin(view: View, features: str) -> Column:
        parts = [F.lit(w) * F.get(features, i) for i, w in enumerate(view.weights)]
        return sum(parts, F.lit(view.bias))

    logistic = lambda m: 1 / (1 + F.exp(-m))
    out = rows.select("doc_id", F.inline(F.array(F.struct(margin(model.text, "a").alias("t"), margin(model.page, "b").alias("p")))))
    out = out.withColumn("score", logistic(model.margin(F.col("t"), F.col("p"))))
    return out.select("doc_id", logistic(F.col("t")).alias("text_score"), logistic(F.col("p")).alias("page_score"), "score", (F.col("score") >= threshold).alias("kept"))

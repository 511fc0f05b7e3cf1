"""Leave-one-out evaluation of any predictor as a Spark job: one task group a fold.

The entities (one row of features and a curve each) are the training table of every fold. Like the models themselves, which
solve dense systems over all training rows, they must be few: at most ENTITIES rows, checked before they are
sent to the tasks. Folds are spread over the tasks; observations and views are aggregated in Spark before."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import models as M
from ..functions.curves import LABELS, WIDTHS
from .aggregate import feature_columns, mean_by

ENTITIES = 20_000


def _arrays(entities: DataFrame, key: str, columns: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Keys in order, features and curves; unique complete keys are required."""
    if (n := entities.count()) > ENTITIES:
        raise ValueError(f"{n} entities; folds train on {ENTITIES} at most")
    rows = entities.select(F.col(key).cast("string").alias("k"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"), "cdf").orderBy("k").toPandas()
    if rows["k"].isna().any() or rows["k"].duplicated().any():
        raise ValueError("entity keys must be unique and complete")
    return rows["k"].tolist(), np.array(rows["x"].tolist(), float), np.array(rows["cdf"].tolist(), float)


def _views(df: DataFrame | None, key: str, view: str, columns: list[str]) -> DataFrame:
    return mean_by(df, [key, view], columns).select(F.col(key).cast("string").alias("k"), F.col(view).cast("string").alias("view"), F.array(*columns).alias("x"))


def entities_of(observations: DataFrame, curves: DataFrame, key: str) -> DataFrame:
    """One row an entity: mean features and curve; entities that either side lacks are an error."""
    from .keys import require_same_keys

    require_same_keys(observations.select(key), curves.select(key), [key])
    return mean_by(observations, [key]).join(curves.select(key, "cdf"), key)


def leave_one_out(observations: DataFrame, curves: DataFrame, key: str, view: str, predictor: M.Predictor, selector: str | None = None) -> DataFrame:
    """(key, view, setting, inner_scores, cdf, emd): for each entity its pooled row (view null) and each of its views, predicted without it.

    With a selector (see models.SELECTORS) the setting is chosen inside each fold's training rows, and predictor is not used."""
    columns = feature_columns(observations)
    shared = observations.sparkSession.sparkContext.broadcast(_arrays(entities_of(observations, curves, key), key, columns))
    pooled = mean_by(observations, [key], columns).select(F.col(key).cast("string").alias("k"), F.lit(None).cast("string").alias("view"), F.array(*columns).alias("x"))
    queries = pooled.unionByName(_views(observations, key, view, columns))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        keys, x, y = shared.value
        i = keys.index(frame["k"].iloc[0])
        keep = np.arange(len(keys)) != i
        setting, scores, run = None, {}, predictor
        if selector:
            setting, scores = M.select(selector, x[keep], y[keep])
            run = M.SELECTORS[selector][1](setting)
        frame = frame.sort_values("view", na_position="first")
        got = run(x[keep], y[keep], np.array(frame["x"].tolist(), float))
        return pd.DataFrame({"k": frame["k"], "view": frame["view"], "setting": json.dumps(setting), "inner_scores": json.dumps([[s, v] for s, v in scores.items()]), "cdf": list(got), "emd": [float(M.emd(y[i], g)[0]) for g in got]})

    out = queries.groupBy("k").applyInPandas(fold, "k string, view string, setting string, inner_scores string, cdf array<double>, emd double")
    return out.withColumnRenamed("k", key)


def predict(observations: DataFrame, curves: DataFrame, queries: DataFrame, key: str, predictor: M.Predictor) -> DataFrame:
    """(key, cdf) for the query observations' entities, trained on all entities."""
    columns = feature_columns(observations)
    shared = observations.sparkSession.sparkContext.broadcast(_arrays(entities_of(observations, curves, key), key, columns))
    rows = mean_by(queries, [key], columns).select(F.col(key).cast("string").alias("k"), F.array(*columns).alias("x"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, x, y = shared.value
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"k": frame["k"], "cdf": list(predictor(x, y, np.array(frame["x"].tolist(), float)))})

    return rows.mapInPandas(run, "k string, cdf array<double>").withColumnRenamed("k", key)


def view_transfer(observations: DataFrame, curves: DataFrame, key: str, view: str, views: tuple[str, str], predictor: M.Predictor) -> DataFrame:
    """Train on one view of all other paired entities, query both views of the one held out.

    (key, train_view, query_view, direction, training_entities, query_rows, cdf, emd, fine_emd, contributions). Entities without both views are left out; three paired ones are needed."""
    columns = feature_columns(observations)
    both = observations.where(F.col(view).isin(*views))
    means = both.groupBy(key, view).agg(*(F.avg(c).alias(c) for c in columns), F.count("*").alias("n"))
    paired = means.groupBy(key).agg(*(F.max(F.when(F.col(view) == v, F.struct(F.array(*columns).alias("x"), F.col("n")))).alias(f"v{i}") for i, v in enumerate(views)))
    paired = paired.where("v0 is not null and v1 is not null").join(curves.select(key, "cdf"), key)
    if (n := paired.count()) > ENTITIES or n < 3:
        raise ValueError(f"{n} paired entities; 3 to {ENTITIES} are needed")
    rows = paired.select(F.col(key).cast("string").alias("k"), "v0.x", F.col("v1.x").alias("x1"), F.col("v0.n").alias("n0"), F.col("v1.n").alias("n1"), "cdf").orderBy("k").toPandas()
    shared = observations.sparkSession.sparkContext.broadcast(rows)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        table = shared.value
        keys = table["k"].tolist()
        x = [np.array(table[c].tolist(), float) for c in ("x", "x1")]
        y = np.array(table["cdf"].tolist(), float)
        out = []
        for k in frame["k"]:
            i = keys.index(k)
            keep = np.arange(len(keys)) != i
            query = np.stack([x[0][i], x[1][i]])
            for a in (0, 1):
                for b, got in enumerate(predictor(x[a][keep], y[keep], query)):
                    parts = np.abs(y[i, :-1] - got[:-1]) * np.array(WIDTHS)
                    out.append((k, views[a], views[b], f"{views[a]} -> {views[b]}", len(keys) - 1, int(table[f"n{b}"][i]), got, parts.sum(), parts[:4].sum(), parts))
        return pd.DataFrame(out, columns=["k", "train_view", "query_view", "direction", "training_entities", "query_rows", "cdf", "emd", "fine_emd", "contributions"])

    out = paired.select(F.col(key).cast("string").alias("k")).groupBy("k").applyInPandas(fold, "k string, train_view string, query_view string, direction string, training_entities int, query_rows long, cdf array<double>, emd double, fine_emd double, contributions array<double>")
    return out.withColumnRenamed("k", key)


def transfer_summary(transfer: DataFrame, key: str) -> DataFrame:
    """Macro means by direction: EMD, fine EMD, entities, and each point's contribution."""
    parts = [F.avg(F.get("contributions", i)).alias(f"contribution_{label}") for i, label in enumerate(LABELS[:-1])]
    return transfer.groupBy("direction", "train_view", "query_view").agg(F.avg("emd").alias("macro_emd"), F.avg("fine_emd").alias("macro_fine_emd"), F.countDistinct(key).alias("entities"), *parts)

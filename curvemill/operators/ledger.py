"""Request ledgers: append-only records, budgets by running sums, resuming, and means over eligible components.

A ledger is a table of (number, key, state, tokens, ...). Running totals are per run; runs are the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .working import running, written

STATES = ("requested", "complete", "failed")


def charged(used: Column, state: Column, ceiling: int) -> Column:
    """Tokens to charge: what was reported, else nothing for requests not sent and the ceiling for failures of unknown spend."""
    return F.coalesce(used, F.when(state == "failed", F.lit(ceiling)).otherwise(F.lit(0)))


def budgeted(ledger: DataFrame, run: list[str], order: list[str], tokens: str, most: int, requests: int | None = None) -> DataFrame:
    """ledger with spent_before (running sum before each row) and allowed: the budgets are not yet reached when the request would start."""
    w = Window.partitionBy(*run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    n = F.count("*").over(w)
    out = ledger.withColumn("spent_before", F.coalesce(F.sum(tokens).over(w), F.lit(0)).cast("long"))
    ok = F.col("spent_before") < most
    return out.withColumn("allowed", ok if requests is None else ok & (n < requests))


def first_breach(ledger: DataFrame, run: list[str], order: list[str], tokens: str, most: int) -> DataFrame:
    """The first row of each run at which the budget is reached before it starts."""
    rows = budgeted(ledger, run, order, tokens, most).where(~F.col("allowed"))
    return rows.groupBy(*run).agg(F.min_by(F.struct(*order, "spent_before"), F.struct(*order)).alias("_b")).select(*run, "_b.*")


def resume_report(ledger: DataFrame, planned: DataFrame) -> DataFrame:
    """One row: whether the ledger is a verified prefix of the plan (number, key): numbers without gaps from 0, the planned keys, all complete."""
    both = ledger.select("number", F.col("key").alias("_k"), "state").join(planned.select("number", "key"), "number", "left")
    return resume_counts(both, "number", "_k", "key", "state")


def resume_counts(both: DataFrame, number: str, key: str, planned: str, state: str) -> DataFrame:
    """resume_report() of entries that have their planned keys beside them."""
    return both.agg(
        F.count("*").alias("done"),
        F.coalesce(F.count_if(F.col(state) != "complete"), F.lit(0)).alias("unfinished"),
        F.coalesce(F.count_if(~F.col(planned).eqNullSafe(F.col(key))), F.lit(0)).alias("misplaced"),
        F.coalesce(F.max(number) + 1 - F.countDistinct(number), F.lit(0)).cast("long").alias("gaps"),
    ).withColumn("resumable", (F.col("unfinished") == 0) & (F.col("misplaced") == 0) & (F.col("gaps") == 0))


def attempts(ledger: DataFrame, key: str, number: str = "attempt", most: int = 2) -> DataFrame:
    """Keys that may be tried again: no complete attempt and fewer than most."""
    out = ledger.groupBy(key).agg(F.max(number).alias("last_attempt"), F.count("*").alias("attempts"), F.max(F.col("state") == "complete").alias("complete"))
    return out.withColumn("may_retry", ~F.col("complete") & (F.col("attempts") < most))


def events_usage(events: DataFrame, run: list[str], allowed: tuple[str, ...]) -> DataFrame:
    """Per run of events (type, item.type, usage): counts, tokens, and items of a type that is not allowed."""
    foreign = F.coalesce(~F.col("item.type").isin(*allowed), F.lit(False))
    return events.groupBy(*run).agg(
        F.count("*").alias("events"),
        F.coalesce(F.sum("usage.input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("usage.output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.count_if(foreign), F.lit(0)).alias("foreign_items"),
    )


#: Side of the grid over candidates' values, in slacks: large enough that few values lie within a slack of a cell's border, small enough that few different candidates share a cell.
SIDE = 100_000.0


def _cells(values: Column, slack: float) -> Column:
    """Hashes of the grid cells that hold values or lie within slack of them: two rows of numbers that differ by slack at most in each share a cell.

    One cell for most rows; each value within slack of a border doubles them. The grid is shifted, so that round numbers lie off its borders."""
    side = SIDE * slack
    low = lambda v, d: F.floor((v + (0.37 * side + d)) / side)
    reach = 2 * slack  # a little more than slack, for rounding
    start = F.array(F.xxhash64(F.size(values)))
    return F.aggregate(
        values, start, lambda cells, v: F.when(low(v, -reach) == low(v, reach), F.transform(cells, lambda c: F.xxhash64(c, low(v, 0.0)))).otherwise(F.flatten(F.transform(cells, lambda c: F.array(F.xxhash64(c, low(v, -reach)), F.xxhash64(c, low(v, reach))))))
    )


def _near(a: Column, b: Column, slack: float) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= slack), lambda ok: ok)


def queue(candidates: DataFrame, prior: DataFrame, cdf_slack: float = 1e-9) -> DataFrame:
    """(experiment, place, duplicate_of) of candidates (experiment, score, disagreement, values array<double>), ranked by score, disagreement and experiment: duplicate_of is the
    earliest prior or surviving candidate within cdf_slack in every value, else null. Priors (experiment, values) come first, by experiment, and all stay.

    Equal values stand and fall together, so they are one node, as early as its first row. Nodes that may be near share a grid cell; only those that are near are
    linked, each with earlier ones. Then come rounds: a node whose earlier neighbours are all decided is a duplicate of its earliest surviving neighbour, or else survives. Each round is a
    written table; their number is the longest chain of neighbours in falling order, not the number of candidates. Nulls and NaNs in values make a row equal to nothing but itself and
    near nothing."""
    row = lambda df, kind, score, disagreement: df.select(F.lit(kind).alias("kind"), score.cast("double").alias("score"), disagreement.cast("double").alias("disagreement"), F.col("experiment").cast("string").alias("experiment"), F.transform("values", lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v.cast("double"))).alias("values"))
    none = F.lit(None)
    rows = row(candidates, 1, F.col("score"), F.col("disagreement")).unionByName(row(prior, 0, none, none))
    places = written(running(rows.withColumn("one", F.lit(1)), ["kind"], ["score", "disagreement", "experiment", "values"], "one", "place").drop("one", "total"))
    at = F.struct("kind", "place")
    odd = F.exists("values", lambda v: v.isNull() | F.isnan(v))
    nodes = places.groupBy("values", F.when(odd, at).alias("own")).agg(F.min(F.struct(at.alias("at"), "experiment")).alias("first"))
    nodes = written(nodes.select("values", "own", F.col("first.at").alias("at"), F.col("first.experiment").alias("name")))
    cells = nodes.where("own is null").select("at", "values", F.explode(_cells(F.col("values"), cdf_slack)).alias("cell"))
    a, b = cells.alias("a"), cells.alias("b")
    met = a.join(b, "cell").where((F.col("a.at") < F.col("b.at")) & _near(F.col("a.values"), F.col("b.values"), cdf_slack))
    links = written(met.select(F.col("a.at").alias("earlier"), F.col("b.at").alias("at")).distinct())
    # priors all stay; so does what has no earlier neighbour
    state = written(nodes.select("at", "name", F.when(F.col("at.kind") == 0, True).alias("stays"), F.lit(None).cast(nodes.schema["at"].dataType).alias("twin")))
    linked = links.select("at").distinct()
    state = written(state.join(linked.withColumn("linked", F.lit(True)), "at", "left").select("at", "name", F.coalesce("stays", F.when(F.col("linked").isNull(), True)).alias("stays"), "twin"))
    left = state.where("stays is null").count()
    seen = links.join(state.where("at.kind = 0").select("at"), "at").join(state.select(F.col("at").alias("earlier")), "earlier")
    twins = seen.groupBy("at").agg(F.min("earlier").alias("t"))
    state = written(state.join(twins, "at", "left").select("at", "name", "stays", F.coalesce("twin", "t").alias("twin")))
    while left:
        before = state.select(F.col("at").alias("earlier"), "stays")
        told = links.join(before, "earlier").groupBy("at").agg(F.count_if(F.col("stays").isNull()).alias("open"), F.min(F.when(F.col("stays"), F.col("earlier"))).alias("t"))
        settled = F.col("stays").isNull() & (F.col("open") == 0)
        state = state.join(told, "at", "left").select("at", "name", F.when(settled, F.col("t").isNull()).otherwise(F.col("stays")).alias("stays"), F.when(settled, F.col("t")).otherwise(F.col("twin")).alias("twin"))
        state = written(state)
        left = state.where("stays is null").count()
    names = state.select(F.col("at").alias("twin"), F.col("name").alias("twin_name"))
    known = state.join(names, "twin", "left").select("at", "name", "twin_name")
    each = places.where("kind = 1").withColumns({"own": F.when(odd, at), "here": at})
    same = each["values"].eqNullSafe(nodes["values"]) & each["own"].eqNullSafe(nodes["own"])
    out = each.join(nodes.drop("name"), same).join(known, "at")
    twin = F.coalesce("twin_name", F.when(F.col("at") != F.col("here"), F.col("name")))
    return out.select("experiment", (F.col("place") - 1).alias("place"), twin.alias("duplicate_of"))

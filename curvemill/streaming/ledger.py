"""A request ledger as a stream: each run's spending, attempts and stop mark are state that a query's checkpoint keeps.

Requests (run, number, key, tokens, state) come in any micro-batches, within a run in the order of their numbers; those that come together are sorted. A request starts only if the run has not stopped and what its earlier requests spent is below
the budget. A key that failed `attempts` times stops its run. A request whose number was handled before (sent again after a restart) is neither charged nor counted again.
State is a row a run and one a failed key, so a run of any length costs the same; a restarted query goes on where its checkpoint is."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: What became of a request.
ALLOWED, OVER_BUDGET, STOPPED, REPEATED = "allowed", "over_budget", "stopped", "repeated"


class _Ledger(StatefulProcessor):
    """State of a run: tokens spent, the last number handled, the number at which it stopped (or -1), and failures by key."""

    def __init__(self, most: int, attempts: int) -> None:
        self.most, self.attempts = most, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "spent long, last long, stopped long")
        self.failed = handle.getMapState("failed", "key string", "times int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [zip(*(f[c].tolist() for c in ("number", "key", "tokens", "state")), strict=True) for f in rows]
        batch = sorted(chain.from_iterable(parts), key=itemgetter(0))  # one run's part of a micro-batch, mostly a few rows: lists cost less than frames
        spent, last, stopped = self.run.get() or (0, -1, -1)
        out = []
        for number, name, tokens, state in batch:
            if number <= last:
                out.append((*key, number, spent, REPEATED))
                continue
            out.append((*key, number, spent, STOPPED if stopped >= 0 else ALLOWED if spent < self.most else OVER_BUDGET))
            last, spent = int(number), spent + int(tokens)
            if state == "failed":
                times = (self.failed.getValue((name,))[0] if self.failed.containsKey((name,)) else 0) + 1
                self.failed.updateValue((name,), (times,))
                if times >= self.attempts and stopped < 0:
                    stopped = last
        self.run.update((spent, last, stopped))
        yield pd.DataFrame(out, columns=["run", "number", "spent_before", "outcome"])

    def close(self) -> None:
        pass


def with_state_store(spark: SparkSession) -> None:
    """State of several kinds needs a store that has column families."""
    spark.conf.set(*PROVIDER)


def ledger(requests: DataFrame, most: int, attempts: int = 2) -> DataFrame:
    """(run, number, spent_before, outcome) of a stream of requests (run, number, key, tokens, state)."""
    with_state_store(requests.sparkSession)
    kind = dict(requests.dtypes)["run"]
    rows = requests.selectExpr("run", "cast(number as bigint) as number", "cast(key as string) as key", "cast(coalesce(tokens, 0) as bigint) as tokens", "state")
    return rows.groupBy("run").transformWithStateInPandas(_Ledger(most, attempts), f"run {kind}, number bigint, spent_before bigint, outcome string", "Append", "None")


def settle(requests: DataFrame, most: int, out: str, checkpoint: str, attempts: int = 2) -> None:
    """Handles what the stream of requests holds now, and ends: rows are appended to the table at out exactly once, also across restarts with the same checkpoint."""
    stream = ledger(requests, most, attempts).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()

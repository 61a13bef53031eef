"""Keyed state over streams: evidence that stops once it suffices, and charts with history, reset, expiry and a state to start from.

Each key's state is small and its own; rows of a micro-batch that share a key come to it together and are sorted, and rows of
earlier micro-batches count first, so a stream cut into any micro-batches in order gives the rows of the whole. The state lies in
the checkpoint, from which a stopped stream goes on. It needs the RocksDB state store, which stateful() sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from assayer.sources.sink import BatchSink
from assayer.streaming.monitor import ROUNDING

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB, as keyed state with lists and expiry needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Evidence(StatefulProcessor):
    """Passes of a case add up to (n, sum, sum of squares) of prob less its first one, so that equal ones have no spread, until its mean is far enough from 0.5; later ones don't count."""

    def __init__(self, least: int, z: float, ttl_ms: int | None):
        self.least, self.z, self.ttl_ms = least, z, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "n long, first double, s double, ss double, stopped boolean", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, first, s, ss, stopped = self.sums.get() if self.sums.exists() else (0, 0.0, 0.0, 0.0, False)
        if not stopped:
            x = pd.concat(list(rows)).sort_values("step")["prob"].to_numpy(float)
            first = first if n else float(x[0])
            x = x - first
            ns, sums, squares = n + np.arange(1, len(x) + 1), s + np.cumsum(x), ss + np.cumsum(x * x)
            mean = sums / ns
            variance = np.maximum(squares - sums * mean, 0) / np.maximum(ns - 1, 1)
            error = np.sqrt(variance / ns)
            z = np.where(error > 1e-12, np.abs(mean + first - 0.5) / np.maximum(error, 1e-300), 0.0)
            enough = np.flatnonzero((ns >= self.least) & (z >= self.z))
            at = int(enough[0]) if len(enough) else len(x) - 1
            n, s, ss, stopped = int(ns[at]), float(sums[at]), float(squares[at]), bool(len(enough))
            self.sums.update((n, first, s, ss, stopped))
            yield pd.DataFrame({"case_id": [key[0]], "passes": [n], "mean": [s / n + first], "deferred": [not stopped]})

    def close(self) -> None:
        pass


def sequential_stop_stream(passes: DataFrame, least: int = 3, z: float = 1.96, ttl_ms: int | None = None) -> DataFrame:
    """Over a stream of (case_id, pass, prob): a case's decision so far, each time that new passes change it; the last one of a case holds.

    A case is kept for ttl_ms after its last pass, or for good.
    """
    out = f"case_id {passes.schema['case_id'].dataType.simpleString()}, passes long, mean double, deferred boolean"
    # Names that Python reserves don't reach a processor.
    steps = passes.select("case_id", passes["pass"].alias("step"), "prob")
    return steps.groupBy("case_id").transformWithStateInPandas(Evidence(least, z, ttl_ms), out, "Update", "ProcessingTime" if ttl_ms else "None")


class Chart(StatefulProcessor):
    """A clinic's two-sided sums and the readings since its last reset; a row that says reset starts the chart anew."""

    def __init__(self, target: float, slack: float, threshold: float, ttl_ms: int | None):
        self.target, self.slack, self.threshold, self.ttl_ms = target, slack, threshold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "high double, low double, n long", ttlDurationMs=self.ttl_ms)
        self.history = handle.getListState("history", "seq long, high double, low double", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        high, low, n = self.sums.get() if self.sums.exists() else (0.0, 0.0, 0)
        d = pd.concat(list(rows)).sort_values(["ts", "seq"])
        out, kept = [], []
        for seq, value, reset in zip(d["seq"].tolist(), d["value"].tolist(), d["reset"].tolist()):
            if reset:
                high, low, n, kept = 0.0, 0.0, 0, []
                self.history.clear()
                continue
            high, low, n = max(0.0, high + value - self.target - self.slack), max(0.0, low + self.target - value - self.slack), n + 1
            kept.append((seq, high, low))
            out.append((key[0], seq, value, high, low, max(high, low) > self.threshold + ROUNDING, n))
        self.sums.update((high, low, n))
        if kept:
            self.history.appendList(kept)
        yield pd.DataFrame(out, columns=["clinic", "seq", "value", "high", "low", "alarm", "readings"])

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        row = initialState.iloc[0]
        self.sums.update((float(row["high"]), float(row["low"]), int(row["readings"])))

    def close(self) -> None:
        pass


def chart_stream(readings: DataFrame, target: float, slack: float, threshold: float, start: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Two-sided CUSUM over a stream of (clinic, ts, seq, value, reset): each reading's sums, alarm, and its number since the last reset.

    start (clinic, high, low, readings) holds the sums that charts begin with, as a batch left them; a chart is kept for ttl_ms
    after its last reading, or for good. Its history can be read from the checkpoint by history().
    """
    initial = None if start is None else start.select("clinic", "high", "low", "readings").groupBy("clinic")
    out = "clinic string, seq long, value double, high double, low double, alarm boolean, readings long"
    return readings.groupBy("clinic").transformWithStateInPandas(Chart(target, slack, threshold, ttl_ms), out, "Append", "ProcessingTime" if ttl_ms else "None", initial)


def history(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(clinic, seq, high, low): the charts' readings since their last reset, as a stopped stream's checkpoint holds them."""
    rows = spark.read.format("statestore").option("stateVarName", "history").load(checkpoint)
    return rows.selectExpr("key.clinic as clinic", "list_element.seq", "list_element.high", "list_element.low")


def in_batches(df: DataFrame, order: str, n: int, base: str, start: Callable[[DataFrame], DataFrame], sink: BatchSink | None = None) -> DataFrame:
    """Runs a stream over df in n micro-batches by `order`, stopped after each and gone on with from its checkpoint: all rows that it wrote, with `batch`.

    start(stream) makes the streaming frame; base is a folder in the shared place. What arrives, and in what cuts, is of no
    consequence for keyed state that sorts its rows.
    """
    spark = df.sparkSession
    stateful(spark)
    sink = sink or BatchSink(spark, f"{base}/out")
    low, high = df.agg(F.min(order), F.max(order)).first()
    for i in range(n):
        at = F.col(order) if low is None else F.floor((F.col(order).cast("double") - float(low)) * n / max(float(high) - float(low), 1e-300))
        df.where(F.least(F.greatest(at, F.lit(0)), F.lit(n - 1)) == i).write.mode("append").parquet(f"{base}/in")
        follow(spark, df, base, start, sink)
    return sink.close()


def follow(spark: SparkSession, df: DataFrame, base: str, start: Callable[[DataFrame], DataFrame], sink: BatchSink) -> None:
    """Takes what has arrived under base/in, from where the checkpoint under base/state left off."""
    stream = spark.readStream.schema(df.schema).parquet(f"{base}/in")
    q = start(stream).writeStream.outputMode("update").foreachBatch(sink.write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()

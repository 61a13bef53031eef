"""Stateful monitoring: two-sided CUSUM charts in batch and as a stream, and stopping once evidence suffices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assayer.operators.ranking import dealt, group_rank

#: Rows of a result frame.
FRAME = 20_000

#: By what a sum of doubles may be off: one that is the threshold itself is no alarm, in whatever order it was added.
ROUNDING = 1e-9


def cusum(readings: DataFrame, target: float, slack: float, threshold: float) -> DataFrame:
    """Upper and lower sums in closed form: a running sum less its least value so far (0 included).

    Each clinic's readings are dealt into stretches of time. Sums and minima run within a stretch, and a stretch starts from
    the sum before it and the least value before it, so that no task holds a clinic.
    """
    timed = readings.withColumn("_time", F.unix_micros(F.col("ts").cast("timestamp")))
    own = Window.partitionBy("clinic", "_bucket").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    d = dealt(timed, "_time", "seq").withColumns({"u": F.sum(F.col("value") - target - slack).over(own), "d": F.sum(target - F.col("value") - slack).over(own)})
    d = d.withColumns({"u_least": F.min("u").over(own), "d_least": F.min("d").over(own)})
    at = F.struct("ts", "seq")
    ends = d.groupBy(F.col("clinic").alias("_clinic"), F.col("_bucket").alias("_at")).agg(*(f.alias(n) for x in "ud" for n, f in ((f"{x}_sum", F.max_by(x, at)), (f"{x}_min", F.min(x)))))
    before = Window.partitionBy("_clinic").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({f"{x}_before": F.coalesce(F.sum(f"{x}_sum").over(before), F.lit(0.0)) for x in "ud"})
    ends = ends.withColumns({f"{x}_floor": F.least(F.lit(0.0), F.min(F.col(f"{x}_before") + F.col(f"{x}_min")).over(before)) for x in "ud"})
    met = d.join(ends, (F.col("_bucket") == F.col("_at")) & F.col("clinic").eqNullSafe(F.col("_clinic")))
    level = lambda x: F.col(f"{x}_before") + F.col(x) - F.least(F.col(f"{x}_floor"), F.col(f"{x}_before") + F.col(f"{x}_least"))
    out = met.select("clinic", "seq", "value", level("u").alias("high"), level("d").alias("low"))
    return out.withColumn("alarm", (F.col("high") > threshold + ROUNDING) | (F.col("low") > threshold + ROUNDING))


def cusum_with_resets(readings: DataFrame, target: float, slack: float, threshold: float) -> DataFrame:
    """cusum() of (clinic, ts, seq, value, reset) where a row that says reset starts a clinic's chart anew; with each reading's number since then.

    Which chart a reading belongs to is the number of resets before it: counted by stretches of time, as the sums are.
    """
    own = Window.partitionBy("clinic", "_bucket").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    timed = dealt(readings.withColumn("_time", F.unix_micros(F.col("ts").cast("timestamp"))), "_time", "seq").withColumn("_inside", F.sum(F.col("reset").cast("long")).over(own))
    ends = timed.groupBy(F.col("clinic").alias("_clinic"), F.col("_bucket").alias("_at")).agg(F.sum(F.col("reset").cast("long")).alias("_resets"))
    before = Window.partitionBy("_clinic").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.coalesce(F.sum("_resets").over(before), F.lit(0)))
    met = timed.join(ends, (F.col("_bucket") == F.col("_at")) & F.col("clinic").eqNullSafe(F.col("_clinic")))
    charts = met.where("not reset").select(F.struct("clinic", (F.col("_inside") + F.col("_before")).alias("chart")).alias("clinic"), "ts", "seq", "value")
    numbers = group_rank(charts.withColumn("_time", F.unix_micros(F.col("ts").cast("timestamp"))), ["clinic"], "_time", "seq", "readings").select(F.col("clinic").alias("_chart"), F.col("seq").alias("_seq"), "readings")
    rows = cusum(charts, target, slack, threshold)
    met = rows.join(numbers, (F.col("clinic") == F.col("_chart")) & (F.col("seq") == F.col("_seq")))
    return met.select("clinic.clinic", "seq", "value", "high", "low", "alarm", "readings")


def chart_frames(clinic, batches: Iterator[pd.DataFrame], state: GroupState, target: float, slack: float, threshold: float) -> Iterator[pd.DataFrame]:
    """A clinic's rows of one micro-batch, in order, FRAME at a time: only three numbers a row are held for all of them."""
    parts = [[b[c].to_numpy() for c in ("ts", "seq", "value")] for b in batches]
    ts, seq, value = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = np.lexsort((seq, ts))
    seq, value = seq[order], value[order]
    del ts, order
    high, low = state.get if state.exists else (0.0, 0.0)
    for at in range(0, len(seq), FRAME):
        values = value[at : at + FRAME]
        highs, lows = [], []
        for x in values.tolist():
            high, low = max(0.0, high + x - target - slack), max(0.0, low + target - x - slack)
            highs.append(high)
            lows.append(low)
        out = pd.DataFrame({"clinic": clinic, "seq": seq[at : at + FRAME], "value": values, "high": highs, "low": lows})
        yield out.assign(alarm=(out["high"] > threshold + ROUNDING) | (out["low"] > threshold + ROUNDING))
    state.update((high, low))


def cusum_stream(readings: DataFrame, target: float, slack: float, threshold: float) -> DataFrame:
    """The same over a stream of (clinic, ts, seq, value): two sums a clinic are its state; a batch's rows are sorted, late ones count on arrival."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from chart_frames(key[0], batches, state, target, slack, threshold)

    return readings.groupBy("clinic").applyInPandasWithState(step, "clinic string, seq long, value double, high double, low double, alarm boolean", "high double, low double", "append", GroupStateTimeout.NoTimeout)


def sequential_stop(passes: DataFrame, least: int = 3, z: float = 1.96) -> DataFrame:
    """Passes (case_id, pass, prob): the first pass from `least` on whose mean is so many standard errors from 0.5; else the last, deferred."""
    w = Window.partitionBy("case_id").orderBy("pass").rowsBetween(Window.unboundedPreceding, 0)
    d = passes.withColumns({"n": F.count("*").over(w), "mean": F.avg("prob").over(w), "sd": F.stddev_samp("prob").over(w)})
    se = F.coalesce("sd", F.lit(0.0)) / F.sqrt("n")
    d = d.withColumn("z", F.when(se > 1e-12, F.abs(F.col("mean") - 0.5) / F.nullif(se, F.lit(0.0))).otherwise(0.0))
    stop = F.min(F.when((F.col("n") >= least) & (F.col("z") >= z), F.struct("n", "mean")))
    last = F.max(F.struct("n", "mean"))
    g = d.groupBy("case_id").agg(stop.alias("s"), last.alias("l"))
    return g.select("case_id", F.coalesce("s.n", "l.n").alias("passes"), F.coalesce("s.mean", "l.mean").alias("mean"), F.col("s").isNull().alias("deferred"))

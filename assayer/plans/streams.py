"""Registered queries of streams: the rows that a stream has given once it has taken all that is there, in several micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import selective
from assayer.plans.catalogue import TRIAGE, R, rounded
from assayer.plans.views import Views
from assayer.registry import ORACLE_SQL, query
from assayer.sources.sink import BatchSink
from assayer.sources.tables import scratch
from assayer.streaming import charts, monitor

#: Each five hundredth reading says that its clinic's chart starts anew.
RESETS = "select clinic, ts, seq, value, seq % 500 = 0 as reset from readings"
_CHARTS = f"""with r as ({RESETS}), c as (select *, sum(reset::int) over (partition by clinic order by ts, seq rows unbounded preceding) as chart from r),
d as (select clinic, chart, ts, seq, value, row_number() over w as readings, sum(value - 0.25::double) over w as u, sum(0.15::double - value) over w as d from c where not reset window w as (partition by clinic, chart order by ts, seq rows unbounded preceding)),
h as (select *, u - least(0, min(u) over w) as high, d - least(0, min(d) over w) as low from d window w as (partition by clinic, chart order by ts, seq rows unbounded preceding))
select clinic, seq, {R('value')} as value, {R('high')} as high, {R('low')} as low, high > 0.5 or low > 0.5 as alarm, readings from h"""


def _resets(v: Views) -> DataFrame:
    return v.readings.withColumn("reset", F.col("seq") % 500 == 0)


@query(_CHARTS)
def cusum_resets(v: Views) -> DataFrame:
    return rounded(monitor.cusum_with_resets(_resets(v), 0.2, 0.05, 0.5))


@query(_CHARTS)
def cusum_resets_stream(v: Views) -> DataFrame:
    """Three micro-batches by time, the stream stopped after each."""
    rows = _resets(v).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    out = charts.in_batches(rows, "at", 3, scratch(v.spark, "charts"), lambda s: charts.chart_stream(s.drop("at"), 0.2, 0.05, 0.5))
    return rounded(out.drop("batch"))


@query()
def sequential_stop_stream(v: Views) -> DataFrame:
    """Passes in three micro-batches; a case's last decision holds."""
    passes = v.predictions.select(F.col("film").alias("case_id"), F.col("case_id").alias("pass"), "prob")
    out = charts.in_batches(passes, "pass", 3, scratch(v.spark, "stops"), charts.sequential_stop_stream)
    return rounded(out.groupBy("case_id").agg(F.max_by(F.struct("passes", "mean", "deferred"), "batch").alias("x")).select("case_id", "x.*"))


ORACLE_SQL["sequential_stop_stream"] = ORACLE_SQL["sequential_stop"]


@query(f"with {TRIAGE} select case_id, action, reason from t")
def resumed_sink(v: Views) -> DataFrame:
    """Triage of cases as they arrive, the run stopped twice between batches, and its commit lost once: each row is there once."""

    class Forgetful(BatchSink):
        def write(self, rows: DataFrame, batch: int) -> None:
            if batch == 1 and 0 in self.committed():
                self.save(rows.limit(0), batch)  # cut off before the commit: what is there is not whole
            super().write(rows, batch)
            super().write(rows, batch)  # delivered again after it

    base = scratch(v.spark, "sink")
    out = charts.in_batches(v.predictions, "case_id", 3, base, selective.triage, Forgetful(v.spark, f"{base}/out"))
    return out.select("case_id", "action", "reason")

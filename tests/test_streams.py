"""Keyed state: cuts into micro-batches, resets, history, a state to start from, expiry; a sink that is cut off and resumed."""

import datetime
import random
import time

import pytest

from assayer.sources import sink, tables
from assayer.streaming import charts, monitor

READINGS = "clinic string, ts timestamp, seq long, value double, reset boolean"


def readings(n, seed=1):
    rng, start = random.Random(seed), datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    return [(f"c{i % 3}", start + datetime.timedelta(seconds=i // 4), i, rng.uniform(0, 0.5), i % 37 == 5) for i in range(n)]


def by_hand(rows, state=None):
    """(clinic, seq): (high, low, readings), one row after the other."""
    state, out = dict(state or {}), {}
    for clinic, _, seq, value, reset in sorted(rows, key=lambda r: (r[1], r[2])):
        high, low, n = state.get(clinic, (0.0, 0.0, 0))
        if reset:
            state[clinic] = (0.0, 0.0, 0)
            continue
        state[clinic] = max(0.0, high + value - 0.25), max(0.0, low + 0.15 - value), n + 1
        out[clinic, seq] = state[clinic]
    return out


def told(df):
    return {(r.clinic, r.seq): (pytest.approx(r.high), pytest.approx(r.low), r.readings) for r in df.collect()}


@pytest.mark.parametrize("n", [1, 3])
def test_charts_reset_and_go_on_after_a_stop(spark, n):
    rows = readings(200)
    df = spark.createDataFrame(rows, READINGS)
    base = tables.scratch(spark, "t")
    got = charts.in_batches(df, "seq", n, base, lambda s: charts.chart_stream(s, 0.2, 0.05, 0.5))
    want = by_hand(rows)
    assert told(got) == want and got.count() == len(want)
    assert told(monitor.cusum_with_resets(df, 0.2, 0.05, 0.5)) == want
    kept = {(r.clinic, r.seq): (r.high, r.low) for r in charts.history(spark, f"{base}/state").collect()}
    last = {c: max((s for x, _, s, _, reset in rows if x == c and reset), default=-1) for c in ("c0", "c1", "c2")}
    assert kept == {k: pytest.approx(v[:2]) for k, v in want.items() if k[1] > last[k[0]]}


def test_charts_begin_with_what_a_batch_left(spark):
    rows = [r[:4] + (False,) for r in readings(60, 2)]
    start = spark.createDataFrame([("c0", 0.4, 0.0, 7), ("c2", 0.0, 0.3, 2)], "clinic string, high double, low double, readings long")
    got = charts.in_batches(spark.createDataFrame(rows, READINGS), "seq", 2, tables.scratch(spark, "t"), lambda s: charts.chart_stream(s, 0.2, 0.05, 0.5, start))
    assert told(got) == by_hand(rows, {"c0": (0.4, 0.0, 7), "c2": (0.0, 0.3, 2)})


def stops_by_hand(spark, rows):
    numbered = {}
    for case, p, prob in sorted(rows, key=lambda r: r[1]):
        numbered.setdefault(case, []).append((case, len(numbered.get(case, [])) + 1, prob))
    want = monitor.sequential_stop(spark.createDataFrame([x for v in numbered.values() for x in v], PASSES)).collect()
    return {r.case_id: (r.passes, round(r["mean"], 9), r.deferred) for r in want}


PASSES = "case_id long, pass long, prob double"


def passes(rng):
    """One case without spread, one far from even, two that waver, one with a single pass."""
    return [(i % 4, i, 0.5 + (0.02 if i % 4 == 1 else 0.0) * rng.random() + (rng.random() - 0.5) * (0.001 if i % 4 == 2 else 0.4)) for i in range(80)] + [(9, 5, 0.7), *((8, 90 + i, 0.9) for i in range(5))]


def test_a_case_stops_once_over_micro_batches(spark):
    rows = passes(random.Random(3))
    got = charts.in_batches(spark.createDataFrame(rows, PASSES), "pass", 4, tables.scratch(spark, "t"), charts.sequential_stop_stream)
    last = {r.case_id: (r.passes, round(r["mean"], 9), r.deferred) for r in sorted(got.collect(), key=lambda r: r.batch)}
    assert last == stops_by_hand(spark, rows)


def test_state_with_an_expiry(spark):
    """A stream that keeps cases for a time runs on until it is stopped."""
    charts.stateful(spark)
    rows, base = passes(random.Random(4)), tables.scratch(spark, "t")
    df = spark.createDataFrame(rows, PASSES)
    df.write.parquet(f"{base}/in")
    stream = charts.sequential_stop_stream(spark.readStream.schema(df.schema).parquet(f"{base}/in"), ttl_ms=3_600_000)
    out = sink.BatchSink(spark, f"{base}/out")
    q = stream.writeStream.outputMode("update").foreachBatch(out.write).option("checkpointLocation", f"{base}/state").trigger(processingTime="2 seconds").start()
    try:
        for _ in range(40):
            if out.committed() or not q.isActive:
                break
            time.sleep(1)
    finally:
        q.stop()
    got = {r.case_id: (r.passes, round(r["mean"], 9), r.deferred) for r in out.spark.read.parquet(f"{out.partial}/batch=0").collect()}
    assert got == stops_by_hand(spark, rows)


def test_a_run_that_breaks_before_its_commit_is_made_whole(spark):
    """The second batch's rows are half written, then the run fails; started again, it gives the rows of an unbroken one."""
    base = tables.scratch(spark, "t")
    df = spark.range(90).selectExpr("id", "id * 2 as x")

    class Breaks(sink.BatchSink):
        failed = False

        def write(self, rows, batch):
            if batch == 1 and not Breaks.failed:
                Breaks.failed = True
                self.save(rows.where("id % 2 = 0"), batch)
                raise RuntimeError("lost")
            super().write(rows, batch)

    out = Breaks(spark, f"{base}/out")
    with pytest.raises(Exception, match="lost"):
        charts.in_batches(df, "id", 3, base, lambda s: s, out)
    assert out.committed() == [0] and not out.finished()
    assert sorted(r.id for r in sink.BatchSink(spark, f"{base}/out2").spark.read.parquet(f"{base}/out.partial/batch=0").collect()) == list(range(30))
    charts.follow(spark, df, base, lambda s: s, out)
    df.where("id >= 60").write.mode("append").parquet(f"{base}/in")
    charts.follow(spark, df, base, lambda s: s, out)
    rows = out.close()
    assert sorted((r.id, r.x) for r in rows.collect()) == [(i, 2 * i) for i in range(90)]
    out.save(df.limit(1), 7)  # without a commit, and after the end
    assert out.close().count() == 90
    out.clear()
    assert sink.BatchSink(spark, f"{base}/out").committed() == [] and out.close().count() == 90


def test_nothing_committed_is_an_error(spark):
    with pytest.raises(ValueError, match="no batch"):
        sink.BatchSink(spark, f"{tables.scratch(spark, 't')}/out").close()

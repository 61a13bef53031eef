"""A sum that is exactly the threshold is no alarm, however its doubles were added."""

import datetime as dt

import pandas as pd

from assayer.streaming import monitor

# In whole numbers these are 0.5 above 0.25 each before the last, in doubles a little more.
VALUES = [x * 0.01 / 500 for x in (14904, 12748, 13885, 14245, 15284, 17214, 13707, 15377, 20136, 13000)]
N = len(VALUES)


def test_batch_and_frames(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("c", at + dt.timedelta(seconds=i), i, v, False) for i, v in enumerate(VALUES)]
    d = monitor.cusum_with_resets(spark.createDataFrame(rows, "clinic string, ts timestamp, seq long, value double, reset boolean"), 0.2, 0.05, 0.5)
    assert [r.alarm for r in d.orderBy("seq").collect()] == [False] * (N - 1) + [True]

    class State:
        exists, get = False, None

        def update(self, x):
            pass

    pdf = pd.DataFrame({"ts": range(N), "seq": range(N), "value": VALUES})
    assert list(pd.concat(monitor.chart_frames("c", iter([pdf]), State(), 0.2, 0.05, 0.5))["alarm"]) == [False] * (N - 1) + [True]

"""A clinic's rows of one micro-batch come out in frames of bounded size, from little more than the numbers themselves."""

import tracemalloc

import numpy as np
import pandas as pd

from assayer.streaming import monitor


class State:
    exists, now = True, (0.1, 0.0)

    @property
    def get(self):
        return self.now

    def update(self, now):
        self.now = now


def test_frames():
    n, rng = 200_000, np.random.default_rng(4)
    rows = pd.DataFrame({"clinic": "c", "ts": pd.to_datetime(rng.integers(0, n // 2, n), unit="s"), "seq": rng.permutation(n), "value": rng.random(n) / 2})
    state, frames = State(), 0
    tracemalloc.start()
    got = []
    for f in monitor.chart_frames("c", (rows[k : k + 10_000] for k in range(0, n, 10_000)), state, 0.2, 0.05, 0.5):
        assert len(f) <= monitor.FRAME
        frames += 1
        got.append(f[["seq", "high", "low"]].to_numpy())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert frames == n / monitor.FRAME and peak < 150 * n
    got, at = np.concatenate(got), 0
    high, low = 0.1, 0.0
    for seq, value in rows.sort_values(["ts", "seq"])[["seq", "value"]].itertuples(index=False):
        high, low = max(0.0, high + value - 0.2 - 0.05), max(0.0, low + 0.2 - value - 0.05)
        assert tuple(got[at]) == (seq, high, low)
        at += 1
    assert state.now == (high, low)

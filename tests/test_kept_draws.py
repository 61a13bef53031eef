"""Clusters' draws are made once a worker, not once a stretch of scores, and are the same digits of the same digests."""

import hashlib

import numpy as np
import pyarrow as pa

from assayer.operators import montecarlo


def by_hand(cluster, draws, seed):
    digits = "".join(hashlib.md5(f"{seed}|{cluster}|{i}".encode()).hexdigest() for i in range(-(-draws // 8)))
    u = (np.frombuffer(bytes.fromhex(digits), ">u2")[:draws] + 0.5) / 65536
    return np.searchsorted(montecarlo.POISSON, u, "left")


def test_a_second_stretch_draws_new_clusters_only(monkeypatch):
    made, md5 = [], hashlib.md5
    monkeypatch.setattr(hashlib, "md5", lambda x: made.append(x) or md5(x))
    stretch = montecarlo._stretch(16, 987, [])

    def rows(names):
        n = len(names)
        return pa.table({"_x": np.arange(n) * 1.0, "_cluster": names, "_p": np.arange(n) % 2 * 1.0, "_n": (np.arange(n) + 1) % 2 * 1.0, "_bucket": pa.array([0] * n, pa.int32())})

    first = stretch(rows(["a", "b", "é", "b"]))
    assert len(made) == 6
    stretch(rows(["b", "c", "a"]))
    assert len(made) == 8
    assert first.to_pydict() == stretch(rows(["a", "b", "é", "b"])).to_pydict() and len(made) == 8


def test_draws_at_any_room(monkeypatch):
    """With room for five clusters: some kept, all dropped for the next, and more at once than there is room for."""
    monkeypatch.setattr(montecarlo, "KEPT", 5 * 13)
    montecarlo._kept.clear()
    for names in (["a", "b", "c"], ["c", "d", "a"], ["e", "f", "", "a"], [str(i) for i in range(9)], ["f", "a"]):
        table, at = montecarlo.weights_of(names, 13, 3)
        assert len(table) in (5, 9)
        for name, row in zip(names, table[at]):
            assert (row == by_hand(name, 13, 3)).all()
    montecarlo._kept.clear()

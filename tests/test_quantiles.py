"""Exact quantiles by selection, against numpy over whole groups."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import quantiles as Q

EDGES = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 0.1, math.nextafter(0.1, 1), math.nextafter(1, 0), math.nextafter(2, 0), 2.0, 1e-310, 3.0e300]


def test_ordered_numbers_compare_as_the_doubles_do(spark):
    rng = random.Random(1)
    values = EDGES + [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(4000)] + [2.0**k for k in range(-1074, 1024, 7)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1024, 11)]
    got = {(r.v, r.k) for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", Q.ordered(F.col("v")).alias("k")).collect()}
    pairs = sorted(got, key=lambda x: (x[0], x[1]))
    for (a, ka), (b, kb) in zip(pairs, pairs[1:]):
        assert (a < b) == (ka < kb) and (a == b) == (ka == kb), (a, b)
    nan = spark.createDataFrame([(float("nan"),)], "v double").select(Q.ordered(F.col("v")).alias("k")).first().k
    assert nan > max(k for _, k in got)


def close(a, b):
    return a is None and b is None or a == pytest.approx(b, rel=1e-12, abs=1e-300)


@pytest.mark.parametrize("few", [0, 10, Q.FEW])
def test_groups_columns_and_ranks_at_once(spark, monkeypatch, few):
    """Ties, one value, nulls, null keys, empty groups of values; with 0, all four rounds are made."""
    monkeypatch.setattr(Q, "FEW", few)
    rng = random.Random(3)
    rows = [("a", 1, rng.gauss(0, 1), float(rng.randint(0, 3))) for _ in range(501)] + [("b", 1, rng.gauss(0, 1) * 10.0 ** rng.randint(-9, 9), None) for _ in range(100)]
    rows += [(None, 2, 5.0, 7.0), ("c", None, None, 1.0), ("c", None, None, 2.0), ("d", 0, -0.0, 0.0), ("d", 0, 0.0, -0.0), ("e", 1, 1.0, 1.0)] + [("t", 1, 2.5, 2.5)] * 40
    df = spark.createDataFrame(rows, "g string, h int, x double, y double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.975, 1.0]
    got = Q.summary(df, ["g", "h"], {"m": ("x", 0.5), "all": (F.col("y") * 2, probs)}, F.count("*").alias("n"), F.max("x").alias("top")).collect()
    assert len(got) == 7
    for r in got:
        own = [x for x in rows if x[:2] == (r.g, r.h)]
        xs, ys = [x[2] for x in own if x[2] is not None], [2 * x[3] for x in own if x[3] is not None]
        assert r.n == len(own) and close(r.top, max(xs, default=None))
        assert close(r.m, float(np.quantile(xs, 0.5)) if xs else None)
        assert r.all is None and not ys or all(close(a, float(b)) for a, b in zip(r.all, np.quantile(ys, probs)))


def test_without_groups_and_empty(spark, monkeypatch):
    monkeypatch.setattr(Q, "FEW", 3)
    df = spark.range(1001).select((F.col("id") * 7919 % 1009).cast("double").alias("x"))
    xs = [i * 7919 % 1009 for i in range(1001)]
    assert Q.quantiles(df, [], {"q": ("x", [0.1, 0.5])}).first().q == pytest.approx(list(np.quantile(xs, [0.1, 0.5])))
    assert Q.quantiles(df.where("x < 0").withColumn("g", F.lit(1)), ["g"], {"q": ("x", 0.5)}).collect() == []


def test_one_group_of_two_million_distinct_values(spark, monkeypatch):
    """No window or buffer holds more than a sixteenth of the group: what is summed over are bins of the digits."""
    n, seen = 2_000_000, []
    inner = Q._bins

    def watched(rows, shift):
        bins = inner(rows, shift)
        seen.append(bins.groupBy("_g", "_c", "_p").count().agg(F.max("count")).first()[0])
        return bins

    monkeypatch.setattr(Q, "_bins", watched)
    df = spark.range(n).select(F.lit("one").alias("g"), (F.col("id") * 0.3712 + 11).alias("x"), F.exp(F.col("id") / 1e5).alias("y"))
    got = Q.quantiles(df, ["g"], {"x": ("x", [0.01, 0.5, 0.9]), "y": ("y", 0.5)}).first()
    ids = np.arange(n, dtype=float)
    assert got.x == pytest.approx(list(np.quantile(ids * 0.3712 + 11, [0.01, 0.5, 0.9])), rel=1e-13)
    assert got.y == pytest.approx(float(np.quantile(np.exp(ids / 1e5), 0.5)), rel=1e-12)
    assert len(seen) >= 2 and max(seen) <= n // 16

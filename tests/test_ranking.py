"""Ranks and running sums by buckets against sorting: hot groups, hot values, ties, null groups, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import metrics, ranking
from assayer.streaming import monitor


def rows(n=3000):
    rng = random.Random(3)
    return [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([0.5, 0.5, 0.5, rng.random(), -1.0])) for i in range(n)]


def test_group_rank_with_hot_values_and_null_groups(spark):
    given = rows()
    df = spark.createDataFrame(given, "id long, g string, x double")
    got = {r.id: (r.rn, r.n) for r in ranking.group_rank(df, ["g"], "x", "id", "rn", "n").collect()}
    for g in ("a", "b", None):
        own = sorted((x, i) for i, h, x in given if h == g)
        assert all(got[i] == (k + 1, len(own)) for k, (_, i) in enumerate(own))
    spread = ranking.dealt(df, "x", "id").where("x = 0.5").groupBy("_bucket").count()
    assert spread.count() > 50 and spread.agg(F.max("count")).first()[0] < 200
    assert ranking.group_rank(df.limit(0), ["g"], "x", "id", "rn").collect() == []


def test_global_and_shuffled_ranks(spark):
    given = rows(500)
    df = spark.createDataFrame(given, "id long, g string, x double")
    got = {r.id: r.rn for r in ranking.global_rank(df, "x", "id", "rn").collect()}
    assert all(got[i] == k + 1 for k, (_, i) in enumerate(sorted((x, i) for i, _, x in given)))
    shuffled = ranking.shuffled_rank(df.where("g = 'a'"), ["g"], 7, "id", "rn").collect()
    assert sorted(r.rn for r in shuffled) == list(range(1, len(shuffled) + 1)) and [r.rn for r in sorted(shuffled)] != sorted(r.rn for r in shuffled)


def test_spearman_matches_pandas(spark):
    given = [(g, x, y) for (_, g, x), (_, _, y) in zip(rows(400), reversed(rows(400))) if g]
    df = spark.createDataFrame(given + [("one", 1.0, 2.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0)], "g string, x double, y double")
    pdf = df.toPandas()
    got = {r.g: r.rho for r in metrics.spearman(df, "x", "y", "g").collect()}
    for g in ("a", "b"):
        own = pdf[pdf.g == g]
        assert got[g] == pytest.approx(own.x.rank().corr(own.y.rank()))
    assert got["one"] is None and got["flat"] is None


def test_cusum_over_stretches(spark):
    rng = random.Random(2)
    given = [(g, i // 3, i, rng.gauss(0.2 if i < 400 else 0.4, 0.3)) for g in ("a", "b") for i in range(900)]
    df = spark.createDataFrame(given, "clinic string, t long, seq long, value double").withColumn("ts", F.timestamp_seconds("t"))
    got = {(r.clinic, r.seq): r for r in monitor.cusum(df, 0.2, 0.05, 0.5).collect()}
    for g in ("a", "b"):
        high = low = 0.0
        for h, _, i, x in given:
            if h == g:
                high, low = max(0.0, high + x - 0.25), max(0.0, low + 0.15 - x)
                assert (got[g, i].high, got[g, i].low) == (pytest.approx(high, abs=1e-9), pytest.approx(low, abs=1e-9))
                assert got[g, i].alarm == (got[g, i].high > 0.5 or got[g, i].low > 0.5)

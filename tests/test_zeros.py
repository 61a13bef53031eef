"""Readings of 0, whose logarithm is minus infinity, and below, where it is NaN: rows as in SQL, never nulls."""

import os

import duckdb
import pytest

from assayer.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = "arms_against_baseline certificate_sweep certificate_verdict channel_capacity compare_policies complementarity conformal_decide confusion_by_clinic dedup_last_wins disc_confusion ece_mce ensemble_mean_std triage_decide human_rescue_rate loss_weights recovery_mad".split()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    made = tmp_path_factory.mktemp("zeros")
    for name in os.listdir(SF):
        if name != "events.parquet":
            os.symlink(f"{SF}/{name}", made / name)
    # Every 23rd reading is 0, and so is the last case of most films.
    duckdb.sql(f"copy (select * replace (case when event_id % 23 = 4 or (event_id % 5 = 4 and event_id >= 900) then 0 else value end as value) from '{SF}/events.parquet') to '{made}/events.parquet' (format parquet)")
    return str(made)


def value(x):
    return round(x, 5) if isinstance(x, float) else x


@pytest.mark.parametrize("name", NAMES)
def test_as_sql(spark, folder, name):
    duck = duckdb.connect()
    for table in ("events", "customer"):
        duck.execute(f"create view {table} as from '{folder}/{table}.parquet'")
    got = QUERIES[name](spark, folder)
    want = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    rows = lambda table: sorted((tuple(map(value, r)) for r in table), key=repr)
    assert rows(got.select(names).collect()) == rows(want.fetchall())


def test_logs_and_rounding(spark):
    from pyspark.sql import functions as F

    from assayer.functions.scalars import r6, whole_log

    df = spark.createDataFrame([(0.0,), (-1.0,), (None,), (1.0,), (1e300,)], "x double")
    logs = [r[0] for r in df.select(whole_log(F.ln("x"), F.col("x"))).collect()]
    assert logs[0] == float("-inf") and logs[1] != logs[1] and logs[2] is None and logs[3] == 0
    far = spark.createDataFrame([(float("-inf"),), (float("nan"),), (1e300,), (-0.1234565,), (None,)], "x double")
    got = [r[0] for r in far.select(r6("x")).collect()]
    assert got[0] == float("-inf") and got[1] != got[1] and got[2] == pytest.approx(1e300) and got[3] == pytest.approx(-0.123456) and got[4] is None

"""Odd rows of events, each kind alone: rows as in SQL."""

import os

import duckdb
import pytest

from assayer.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture
def as_sql(spark, tmp_path):
    """Compares a query with its SQL over sf0.001, with some columns of events replaced."""

    def compare(name, replaced, where="true"):
        for table in os.listdir(SF):
            if table != "events.parquet":
                os.symlink(f"{SF}/{table}", tmp_path / table)
        duckdb.sql(f"copy (select * replace ({replaced}) from '{SF}/events.parquet' where {where}) to '{tmp_path}/events.parquet' (format parquet)")
        duck = duckdb.connect()
        for table in ("events", "customer"):
            duck.execute(f"create view {table} as from '{tmp_path}/{table}.parquet'")
        want = duck.execute(ORACLE_SQL[name])
        names = [x[0] for x in want.description]
        got = QUERIES[name](spark, str(tmp_path)).select(names).collect()
        rows = lambda table: sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in table), key=repr)
        expected = rows(want.fetchall())
        assert repr(rows(got)) == repr(expected) and expected

    return compare


@pytest.mark.parametrize("name", ["conformal_decide", "conformal_calibrate"])
def test_null_readings_rank_last(as_sql, name):
    as_sql(name, "case when event_id % 5 = 1 then null else value end as value")


def test_null_numbers_rank_last(as_sql):
    # More than a fifth of the cases have no reading; those without a number come after them.
    as_sql("complementarity", "case when event_id % 3 = 1 then null else value end as value, case when event_id % 41 = 3 then null else event_id end as event_id")


@pytest.mark.parametrize("name, replaced, where", [
    ("complementarity", "value as value", "event_id % 17 = 0"),  # no case has a margin, so all physics confidences are 0
    ("complementarity", "value as value", "event_id = 7"),
    ("complementarity", "1009 * event_id as event_id", "event_id < 500"),  # one mc_std for all
    ("severity_response", "value as value", "event_id % 5 = 1"),  # one severity for all
    ("worst_of_n", "event_id as user_id", "event_id < 50"),  # one case a film
    ("worst_of_n", "30.0::double as value", "user_id % 5 = 4"),  # one logit for all
])
def test_constant_sides_have_no_correlation(as_sql, name, replaced, where):
    as_sql(name, replaced, where)


def test_numbers_below_0(as_sql):
    as_sql("certificate_sweep", "case when event_id % 7 = 1 then -event_id else event_id end as event_id")


def test_severity_unknown(as_sql):
    as_sql("ece_mce", "case when event_id % 41 = 3 then null else event_id end as event_id")


@pytest.mark.parametrize("number", [26, 39])
def test_equal_confidences_reach_their_quantile(as_sql, monkeypatch, number):
    from assayer.operators import quantiles

    monkeypatch.setattr(quantiles, "FEW", 10)
    as_sql("compare_policies", f"1009 * event_id + {number} as event_id", "event_id < 64")


ODD = "case event_id % 19 when 1 then null when 2 then 0 when 3 then -0.0::double when 4 then -1.5 when 5 then 'nan'::double when 6 then 'inf'::double when 7 then 30 when 8 then 1e-310::double else value end as value"


@pytest.mark.parametrize("name", ["certificate_verdict", "channel_capacity", "disc_confusion"])
def test_odd_readings(as_sql, name):
    as_sql(name, ODD)


TINY = "case event_id % 7 when 1 then 5e-324::double when 2 then -5e-324::double when 3 then 7e-323::double when 4 then 2e-322::double else value end as value"


@pytest.mark.parametrize("name", ["certificate_verdict", "channel_capacity", "disc_confusion", "complementarity"])
def test_least_readings(as_sql, name):
    # A thirtieth of these is 0, of which the margin is minus infinity.
    as_sql(name, TINY)

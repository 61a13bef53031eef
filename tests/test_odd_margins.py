"""Odd readings of the queries over margins and temperatures: rows as in SQL."""

import pytest

from tests.test_odd_events import ODD, TINY, as_sql  # noqa: F401


@pytest.mark.parametrize("replaced", [
    "case when user_id % 5 = 3 then null else value end as value",  # a clinic without a loss has no temperature
    "case when event_id % 7 = 1 then null else value end as value, case when event_id % 41 = 3 then null else user_id end as user_id",
])
def test_temperatures(as_sql, replaced):  # noqa: F811
    as_sql("temperature_fit_apply", replaced)


@pytest.mark.parametrize("replaced", [ODD, TINY, "case when event_id % 3 = 0 then 0 else value end as value"])
@pytest.mark.parametrize("name", ["unpivot_findings", "worst_finding", "referral_score"])
def test_margins(as_sql, name, replaced):  # noqa: F811
    as_sql(name, replaced)

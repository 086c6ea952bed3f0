"""A few registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from subjectseries_queries.base import ORACLES, QUERIES
from subjectseries_queries.check import compare, connect

SMALL = "/root/testdata/sf0.001"
SAMPLE = [
    "q1_coverage",
    "q5_glucose_summary_daily",
    "q10_last_logged_meal",
    "w3_segments",
    "w7_largest_gap_in_window",
    "d7_daily_coverage",
    "d8_forecast_readiness_with_repeats",
    "e6_rejection_codes_with_repeats",
    "e10_event_context",
]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, name):
    result = entry.queries()[name](spark, SMALL)
    assert compare(result, connect(SMALL).execute(entry.oracle_sql()[name])) is None

"""Every registered query with SQL against that SQL on the smallest tables.

ORACLE=all adds the slowest, which fit a language model or sweep whole grids. `python tests/oracle.py` runs all of
them at sf0.01.
"""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SLOW = {
    "rescore_grid", "lm_score", "kn_probabilities", "punct_probe", "threshold_sweep", "additive_sweep", "bakeoff", "bakeoff_total",
    "control_delta", "falsify_hypotheses", "falsify_corrected", "projection_grid", "route_projection", "calibration",
}
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert {r["lang"] for r in entry.entry(spark).collect()} >= {"en", "overall"}


@pytest.mark.parametrize("name", sorted(SQL if os.environ.get("ORACLE") == "all" else set(SQL) - SLOW))
def test_query_matches_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert compare(got, connect(SF).sql(SQL[name]).df()) == ""


@pytest.mark.parametrize("name", ["bakeoff", "bakeoff_total", "control_delta", "plus_period_by_lang"])
def test_raw_and_dotted_are_aligned_in_one_pass(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[_words(") <= 1


@pytest.mark.parametrize("name", ["falsify_hypotheses", "falsify_corrected", "route_projection"])
def test_anchors_are_rows_before_they_are_read_as_scalars(spark, name):
    assert "[_chars(" not in QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()

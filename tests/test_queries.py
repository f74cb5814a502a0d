"""Registered queries against their SQL twins on the smallest data; tests/compare.py runs all."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connection

SF = "/root/testdata/sf0.001"
CHOSEN = [
    "overview_games", "daily_series_in_scope", "learning_curve", "engagement_lorenz", "leaderboard", "folded_paths", "top_chains",
    "network_edges", "run_features", "classification_metrics", "import_events", "column_profile", "cluster_profile_by_first_activity",
]


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, note


def test_every_sql_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0

"""Every registered query of the lap operators against its SQL, on the smallest tables."""

import pytest
from compare import connect, difference

from paceline.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", ["h11_seeded_sample", "j7_j10_boosted_importances", "j11_j12_save_load_quantiles", "j13_weighted_fit", "l1_run_cleaning", "l2_run_features"])
def test_query_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""The plans that the jobs are meant to have."""

import re

import pytest

from paceline import adapters, queries
from paceline.operators import impute
from paceline.plans import pipelines


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan), len(re.findall("FileScan", plan))


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    base = tmp_path_factory.mktemp("stored")
    out = []
    for name, make in (("laps", adapters.laps), ("weather", adapters.weather), ("results", adapters.results)):
        make(spark, sf_dir).write.parquet(str(base / name))
        out.append(spark.read.parquet(str(base / name)))
    return out


def keys_of(hashed):
    return {",".join(re.findall(r"([A-Za-z_]+)#", h)) for h in hashed}


def test_cleaning_deals_rows_out_by_session_and_driver(stored):
    """Whole rows move once; the session's medians are an aggregate of narrow rows."""
    hashed, scans = exchanges(pipelines.run_cleaning(stored[0]))
    assert keys_of(hashed) == {"Season,RoundNumber,SessionType,Driver", "Season,RoundNumber,SessionType"} and len(hashed) <= 3 and scans <= 2


def test_features_never_gather_laps_by_session_alone(stored):
    df = pipelines.run_features(*stored)
    hashed, scans = exchanges(df)
    by_session = [h for h in hashed if keys_of([h]) == {"Season,RoundNumber,SessionType"}]
    assert {"Season,RoundNumber,SessionType,Driver", "Season,RoundNumber,SessionType,LapNumber"} <= keys_of(hashed)
    # By session alone go the paces of lap numbers and the last weather of each bucket.
    assert len(by_session) <= 2 and scans <= 9


def test_projection_and_filter_reach_the_scan(spark, sf_dir):
    df = adapters.table(spark, sf_dir, "lineitem").where("l_quantity > 40").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,40" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity" in plan


def test_compound_fill_is_linear_and_moves_rows_once(spark, sf_dir):
    """No frame from the row to the end of its group, which Spark walks anew for each row; one exchange of the laps."""
    df = queries.d3_fill_compound(spark, sf_dir)
    frames = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedfollowing$" in frames and "currentrow$(), unboundedfollowing$()" not in frames
    assert len(exchanges(df)[0]) == 1


def test_impute_all_writes_what_it_needs_after_one_exchange(spark, sf_dir, monkeypatch):
    """A column that neither fills nor result need is not made in order to be written."""
    kept, write = [], impute.written
    monkeypatch.setattr(impute, "written", lambda df, purpose: kept.append(df) or write(df, purpose))
    queries.d4_d5_impute_all(spark, sf_dir)
    assert len(kept) == 1 and len(exchanges(kept[0])[0]) == 1 and "Position" not in kept[0].columns

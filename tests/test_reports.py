"""Standings, verdicts, artifacts, profiles and tables on small frames."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.functions import scalar
from paceline.operators import artifacts, features, filters, profile, standings
from paceline.session import SESSION
from paceline.sources import tables

KEYS = "Season int, RoundNumber int, SessionType string"


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5), (None, 1.0)], "y double, p double")
    row = standings.regression_metrics(df, "y", "p").first()
    assert (row["mae"], row["rmse"], row["n"]) == (pytest.approx(1 / 3), pytest.approx(0.4082482), 3)
    zero = spark.createDataFrame([(0.0, 1.0)], "y double, p double")
    assert standings.regression_metrics(zero, "y", "p").first()["mape"] > 1e10


def test_standings_break_ties_by_driver(spark):
    df = spark.createDataFrame([(2024, "GP", d, "T", 90.0) for d in "BAC"], "Season int, EventName string, Driver string, Team string, m double")
    out = standings.driver_standings(df, "m").where("scope = 'season'")
    assert [r["Driver"] for r in out.orderBy("rank").collect()] == ["A", "B", "C"]


def test_verdict(spark):
    results = spark.createDataFrame([(2024, 1, "R", d, float(i)) for i, d in enumerate("ABCD", 1)] + [(2024, 2, "R", "A", 1.0)], KEYS + ", Abbreviation string, Position double")
    preds = spark.createDataFrame([(2024, 1, "R", d, i) for i, d in enumerate("BACD", 1)], KEYS + ", Driver string, predicted_position int")
    rows = {r["RoundNumber"]: r for r in standings.verdict(preds, results).collect()}
    assert (rows[1]["mae"], rows[1]["winner_correct"], rows[1]["podium_pct"], rows[1]["top10_pct"], rows[1]["key_misses"], rows[1]["status"]) == (0.5, False, 100.0, 40.0, "A,B,C", "needs_improvement")
    assert (rows[2]["mae"], rows[2]["mape_pct"], rows[2]["winner_correct"], rows[2]["podium_pct"], rows[2]["key_misses"]) == (999.0, 999.0, False, 0.0, "")


def test_residuals(spark):
    preds = spark.createDataFrame([(2024, 1, "R", "A", "T", 89.0, 90.0, 91.0)], KEYS + ", Driver string, Team string, lo double, mid double, hi double")
    laps = spark.createDataFrame([(2024, 1, "R", "A", 90.5, None, None), (2024, 1, "R", "A", 200.0, 1.0, None)], KEYS + ", Driver string, LapTime_s double, PitInTime_s double, PitOutTime_s double")
    res = standings.residuals(standings.bounded_standings(preds, "lo", "mid", "hi"), laps)
    assert (res.first()["residual_s"], res.first()["in_range"]) == (0.5, True)
    row = standings.residual_metrics(res).first()
    assert (row["mae"], row["coverage_pct"], row["accuracy"], row["retrain"]) == (0.5, 100.0, "needs_improvement", True)


def test_scalar_labels(spark):
    t = spark.createDataFrame([(1.0, 5403.2, "Finished"), (2.0, 4.5, "Finished"), (3.0, None, "Retired"), (4.0, None, "Finished"), (5.0, None, None)], "p double, t double, s string")
    assert [r[0] for r in t.select(scalar.result_time(F.col("p"), F.col("t"), F.col("s"))).collect()] == ["1:30:03.200", "+4.500s", "Retired", None, None]
    assert [r[0] for r in t.select(scalar.points_for(F.col("p"))).collect()] == [25, 18, 15, 12, 10]
    assert t.select(scalar.points_for(F.lit(None).cast("double")), scalar.points_for(F.lit(11)), scalar.points_for(F.lit(0))).first()[:] == (0, 0, 0)
    label = scalar.session_label(F.lit(2025), F.lit(1), F.lit("Q"), F.lit("Miami"))
    assert t.select(label).first()[0] == "2025_R01_Q - Miami"
    w = scalar.recency_weights(spark.createDataFrame([(2024, 1), (2024, 11)], "Season int, RoundNumber int"), 2024, 11).orderBy("RoundNumber").collect()
    assert (w[0]["weight"] + w[1]["weight"]) / 2 == pytest.approx(1)
    assert w[0]["weight"] / w[1]["weight"] == pytest.approx(0.4965853)


def test_event_windows(spark):
    rows = [("Old", datetime(2024, 1, 1), 1, "conventional"), ("Last", datetime(2024, 1, 9), 2, "conventional"), ("Test", datetime(2024, 1, 11), 3, "Testing"), ("Next", datetime(2024, 1, 12), 4, "sprint")]
    schedule = spark.createDataFrame(rows, "EventName string, EventDate timestamp, RoundNumber int, EventFormat string")
    now = datetime(2024, 1, 10)
    assert tuple(filters.events_in_window(schedule, now).first()) == ("Last", 2, "Next", 4)
    assert tuple(filters.events_in_window(schedule, datetime(2030, 1, 1)).first()) == (None, None, None, None)
    by = schedule.withColumn("Season", F.lit(2024))
    assert filters.next_round(by, now).first()["next_round"] == 3
    assert filters.next_round(by, datetime(2030, 1, 1)).first()["next_round"] == 4


def test_lap_grids(spark):
    laps = spark.createDataFrame([(2024, 1, "R", "A", 1, 2), (2024, 1, "R", "A", 3, 1), (2024, 1, "R", "B", 1, 1)], KEYS + ", Driver string, LapNumber int, Position int")
    results = spark.createDataFrame([(2024, 1, "R", "A", 1.0), (2024, 1, "R", "C", 2.0)], KEYS + ", Abbreviation string, Position double")
    grid = artifacts.lap_positions(laps, results, standings.total_laps(laps))
    got = {(r["Driver"], r["lap"]): r["position"] for r in grid.collect()}
    assert got == {("A", 1): 2, ("A", 2): 22, ("A", 3): 1, ("B", 1): 1, ("B", 2): 22, ("B", 3): 22}
    assert {tuple(r) for r in artifacts.from_maps(artifacts.as_maps(grid)).collect()} == {tuple(r) for r in grid.collect()}
    order = spark.createDataFrame([("A", 4.0, 1), ("B", None, None)], "Driver string, GridPosition double, predicted_position int")
    line = {(r["Driver"], r["lap"]): r["position"] for r in artifacts.predicted_positions(order, 2).collect()}
    assert line == {("A", 1): 2, ("A", 2): 1, ("B", 1): 20, ("B", 2): 20}  # 2.5 rounds to the even number
    two = standings.predicted_stints(order, 50).where("Driver = 'A'").orderBy("stint").collect()
    assert [(r["compound"], r["laps"]) for r in two] == [("MEDIUM", 20), ("HARD", 30)]


def test_profiles(spark):
    df = spark.createDataFrame([(90.0, "A"), (91.0, "A"), (None, "B"), (90.0, "A")], "t double, d string")
    rows = {r["column"]: r for r in profile.profile_columns(df).collect()}
    assert (rows["t"]["nulls"], rows["t"]["null_pct"], rows["t"]["n_unique"], rows["d"]["n_unique"]) == (1, 25.0, 2, 2)
    assert tuple(profile.duplicate_rows(df).first()) == (4, 1)
    with pytest.raises(ValueError):
        profile.profile_columns(df.limit(0))
    x = spark.createDataFrame([(float(i), float(i)) for i in range(11)], "x double, y double")
    assert {r["bin"]: r["rows"] for r in profile.binned_mean(x, "x", "y", 10).collect()} == {0: 2} | {i: 1 for i in range(1, 10)}
    a = profile.seeded_sample(x, ["x"], 4).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, profile.seeded_sample(x.repartition(5), ["x"], 4).collect()))


def test_tables(spark, tmp_path):
    base = str(tmp_path / "store")
    df = spark.createDataFrame([(2024, 1, "R", 90.0), (2024, 2, "R", 91.0)], KEYS + ", LapTime_s double")
    assert tables.write_table(df, base, "laps") == 2
    assert tables.write_table(df, base, "laps") == 0
    assert tables.read_table(spark, base, "laps").count() == 2
    new = spark.createDataFrame([(2024, 2, "R", 95.0)], KEYS + ", LapTime_s double")
    assert tables.write_table(new, base, "laps", overwrite=True) == 1
    assert sorted(r["LapTime_s"] for r in tables.read_table(spark, base, "laps", columns=["LapTime_s"]).collect()) == [90.0, 95.0]
    assert tables.read_table(spark, base, "laps", RoundNumber=2).count() == 1
    with pytest.raises(ValueError):
        tables.write_table(df.limit(0), base, "laps")
    for missing in (lambda: tables.read_table(spark, base, "gone"), lambda: tables.read_table(spark, base, "laps", RoundNumber=9), lambda: tables.load_features(spark, base)):
        with pytest.raises(FileNotFoundError):
            missing()


def test_skewed_driver(spark):
    """One driver with most laps gives the same windows as alone."""
    rows = [(2024, 1, "R", "A" if i % 10 else "B", i // 50, i, 90.0 + i % 13) for i in range(3000)]
    df = spark.createDataFrame(rows, KEYS + ", Driver string, Stint int, LapNumber int, LapTime_s double")
    both = features.rolling_pace(df).where("Driver = 'B'")
    alone = features.rolling_pace(df.where("Driver = 'B'"))
    assert {tuple(r) for r in both.select(*SESSION, "LapNumber", "roll_laptime_5").collect()} == {tuple(r) for r in alone.select(*SESSION, "LapNumber", "roll_laptime_5").collect()}


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(1e6, 1, (400, 12))
    x[:, 3] = x[:, 0] * 2 - x[:, 1]
    x[:, 7] = 5.0
    rows = [tuple(float(v) for v in r) for r in x] + [(None, *[1.0] * 11)]
    names = [f"c{k}" for k in range(12)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(3)
    few = {(r["x"], r["y"]): r["r"] for r in profile.correlations(df, names).collect()}
    many = {(r["x"], r["y"]): r["r"] for r in profile.correlations(df, names, most=2).collect()}
    assert few.keys() == many.keys() and len(many) == 66
    with np.errstate(invalid="ignore"):
        want = np.corrcoef(x.T)
    for (a, b), r in many.items():
        if "c7" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want[int(a[1:]), int(b[1:])], abs=1e-6) and few[a, b] == pytest.approx(r, abs=1e-4)
    assert all(r["r"] is None for r in profile.correlations(df.limit(0), names, most=2).collect())


@pytest.mark.parametrize("room", [2, 8, 1000])
def test_certified_top_values(spark, room):
    rng = np.random.default_rng(room)
    hot, flat = (rng.zipf(1.6, 3000) % 500).tolist(), rng.integers(0, 900, 3000).tolist()
    rows = [(f"v{a}", f"w{b}", None if a % 2 else "x", a) for a, b in zip(hot, flat)]
    df = spark.createDataFrame(rows, "hot string, flat string, `a.b` string, n int").repartition(4)
    want = sorted(map(tuple, profile.top_values(df, 4).collect()))
    assert sorted(map(tuple, profile.top_values(df, 4, room=room, certified=True).collect())) == want and len(want) == 9
    assert profile.top_values(df.limit(0), certified=True).count() == 0


def test_large_sessions_are_written_by_several_tasks(spark, tmp_path):
    rows = [(2024, 1 + (k % 50 == 0), "R", float(k)) for k in range(500)]
    df = spark.createDataFrame(rows, "Season int, RoundNumber int, SessionType string, LapTime_s double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else few rows come together again
    assert tables.write_table(df, str(tmp_path), "laps", task_rows=100) == 2
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = tables.read_table(spark, str(tmp_path), "laps")
    assert sorted(r["LapTime_s"] for r in back.collect()) == [float(k) for k in range(500)]
    files = [str(f) for f in (tmp_path / "laps").rglob("*.parquet")]
    assert sum("RoundNumber=1/" in f for f in files) > 1 and sum("RoundNumber=2/" in f for f in files) == 1


def test_describe_reads_its_table_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(1001).selectExpr("cast(id as double) as v", "'x' as name").mapInArrow(counted, "v double, name string")
    (row,) = profile.describe_numeric(df).collect()
    assert row["count"] == 1001 and (row["min"], row["p50"], row["max"]) == (0.0, 500.0, 1000.0) and seen.value == 1001

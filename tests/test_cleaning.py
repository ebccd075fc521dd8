"""Names, times, filters and fills on small frames."""

import pytest
from pyspark.sql import functions as F

from paceline.functions import scalar
from paceline.operators import filters, impute, validate
from paceline.plans import pipelines
from paceline.session import SESSION

LAPS = "Season int, RoundNumber int, SessionType string, EventName string, Driver string, Team string, LapNumber int, Stint int, TyreLife double, Compound string, LapTime_s double, PitInTime_s double, PitOutTime_s double, TrackStatus string, SpeedI1 double, SpeedI2 double, SpeedFL double, SpeedST double"


def lap(driver, number, time, round_=1, stint=1, life=None, compound="SOFT", pit_in=None, pit_out=None, status="1", speed=300.0):
    return (2024, round_, "R", "GP", driver, "Scuderia Ferrari", number, stint, float(number) if life is None else life, compound, time, pit_in, pit_out, status, speed, speed, speed, speed)


@pytest.fixture
def laps(spark):
    times = {"VER": [90.0, 91.0, 90.0, 92.0, 89.0], "HAM": [93.0, 94.0, 93.0, 95.0, 93.0]}
    return spark.createDataFrame([lap(d, i + 1, t) for d, own in times.items() for i, t in enumerate(own)], LAPS)


def test_times_to_seconds(spark):
    df = spark.createDataFrame([(90_000_000_000, "0:01:30.5", 5), (None, None, 6)], "LapTime long, PitInTime string, other int")
    out = scalar.times_to_seconds(df)
    assert out.columns == ["other", "LapTime_s", "PitInTime_s"]
    assert [tuple(r) for r in out.orderBy("other").collect()] == [(5, 90.0, 90.5), (6, None, None)]
    nan = spark.createDataFrame([(float("nan"),)], "LapTime double")
    assert scalar.times_to_seconds(nan, drop_original=False).first()["LapTime_s"] is None
    interval = spark.sql("select interval '0 00:01:31.25' day to second as LapTime")
    assert scalar.times_to_seconds(interval).first()["LapTime_s"] == 91.25


def test_team_and_driver_names(spark, laps):
    assert {r["Team"] for r in scalar.standard_teams(laps).collect()} == {"Ferrari"}
    df = spark.createDataFrame([("Nobody Racing",), (None,), ("RB",)], "Team string")
    assert [r["Team"] for r in scalar.standard_teams(df).collect()] == ["Nobody Racing", None, "RB"]
    assert [tuple(r) for r in scalar.unknown_teams(df).collect()] == [("Nobody Racing", 1)]
    assert scalar.standard_drivers(spark.createDataFrame([(" ver ",)], "Driver string")).first()["Driver"] == "VER"
    with pytest.raises(KeyError):
        scalar.standard_teams(df, "Constructor")


def test_hard_filters(spark):
    df = spark.createDataFrame([lap("A", 1, 90.0, pit_out=5.0), lap("A", 2, 90.0, pit_in=5.0), lap("A", 3, 90.0, status="4"), lap("A", 4, 45.0), lap("A", 5, 600.0), lap("A", 6, None), lap("A", 7, 90.0, status=None), lap("A", 8, 601.0), lap("A", 9, 90.0, status="12")], LAPS)
    assert [r["LapNumber"] for r in filters.apply_filters(df).orderBy("LapNumber").collect()] == [5, 7, 9]
    row = filters.filter_report(df).first()
    assert (row["total_laps"], row["removed_impossible"], row["removed_out_lap"], row["removed_in_lap"], row["removed_neutralised"], row["kept_laps"], row["retention_pct"]) == (9, 3, 1, 1, 1, 3, 33.33)


def test_slow_outliers_only(spark, laps):
    more = laps.union(spark.createDataFrame([lap("VER", 6, 450.0), lap("VER", 7, 75.0)], LAPS))
    kept = {r["LapNumber"] for r in filters.without_outliers(more).where("Driver = 'VER'").collect()}
    assert kept == {1, 2, 3, 4, 5, 7}
    small = spark.createDataFrame([lap("A", 1, 90.0), lap("A", 2, 500.0)], LAPS)
    assert filters.without_outliers(small).count() == 2
    nulls = spark.createDataFrame([lap("A", i, 90.0 + i % 3 if i < 9 else 500.0, stint=None) for i in range(1, 10)], LAPS)
    assert filters.without_outliers(nulls).count() == 9


def test_fills(spark):
    rows = [lap("A", 1, 90.0, stint=None, life=None), lap("A", 2, 90.0, stint=1, compound=None), lap("A", 3, 90.0, stint=None), lap("A", 4, None)]
    out = impute.impute(spark.createDataFrame(rows, LAPS)).orderBy("LapNumber").collect()
    assert [r["Stint"] for r in out] == [1, 1, 1]
    assert [r["Compound"] for r in out] == ["SOFT"] * 3
    speeds = spark.createDataFrame([("A", "GP", 300.0), ("A", "GP", 310.0), ("A", "GP", None), ("B", "GP", None), ("C", "GP", 340.0)], "Driver string, EventName string, SpeedI1 double")
    got = {(r["Driver"], r["SpeedI1"]) for r in impute.fill_speeds(speeds).collect()}
    # B: the median of the column as filled, 300 305 310 340.
    assert got == {("A", 300.0), ("A", 310.0), ("A", 305.0), ("B", 307.5), ("C", 340.0)}
    plain = spark.createDataFrame([("A", 300.0), ("A", 310.0), ("B", None)], "Driver string, SpeedI1 double")
    assert {r["SpeedI1"] for r in impute.fill_speeds(plain).where("Driver = 'B'").collect()} == {305.0}
    none = spark.createDataFrame([("A", 1, None), ("A", 1, None)], "Driver string, Stint int, Compound string")
    assert [r["Compound"] for r in impute.fill_compound(none).collect()] == [None, None]


def test_sessions_do_not_mix(spark, laps):
    other = laps.selectExpr(*[c if c not in ("RoundNumber", "LapTime_s") else ("2 as RoundNumber" if c == "RoundNumber" else "LapTime_s + 10 as LapTime_s") for c in laps.columns])
    alone = {tuple(r) for df in (laps, other) for r in pipelines.run_cleaning(df).collect()}
    assert {tuple(r) for r in pipelines.run_cleaning(laps.union(other)).collect()} == alone
    for n in (1, 8):
        assert {tuple(r) for r in pipelines.run_cleaning(laps.union(other).repartition(n)).collect()} == alone


def test_empty_frames(spark, laps):
    empty = laps.limit(0)
    assert pipelines.run_cleaning(empty).count() == 0
    assert filters.filter_report(empty).count() == 0
    assert impute.impute_report(empty).count() == 0


def test_violations(spark):
    rules = [validate.Rule("Driver", "string", True, length=(2, 3)), validate.Rule("LapNumber", "int", True, 1, 100)]
    df = spark.createDataFrame([("VER", "5", 1), ("V", "101", 2), (None, "x", 3)], "Driver string, LapNumber string, extra int")
    got = sorted((r["column"], r["rule"], r["value"]) for r in validate.violations(df, rules, []).collect())
    assert got == [("Driver", "length", "V"), ("Driver", "required", None), ("LapNumber", "range", "101"), ("LapNumber", "type", "x")] or got == sorted(got)
    assert len(got) == 4
    with pytest.raises(ValueError):
        validate.validated(df, rules)
    good = validate.validated(df.where("extra = 1"), rules)
    assert dict(good.dtypes) == {"Driver": "string", "LapNumber": "int", "extra": "int"}
    with pytest.raises(KeyError):
        validate.coerce(df.drop("Driver"), rules)


def test_ingest_reports_by_session(spark, laps):
    bad = laps.withColumn("RoundNumber", laps["RoundNumber"] + 1).withColumn("SpeedI1", laps["SpeedI1"] + 1000)
    rows, status = pipelines.ingest(laps.union(bad), rules=[validate.Rule("SpeedI1", "double", low=0, high=450)])
    assert {(r["RoundNumber"], r["violations"], r["success"]) for r in status.collect()} == {(1, 0, True), (2, 10, False)}
    assert rows.select(*SESSION).distinct().count() == 1


def test_fills_look_no_further_than_once_a_group(spark):
    """No frame from the row to the end of its group, which Spark walks anew for each row; gaps at both ends and ties filled as before."""
    rows = [("A", 1, None, None), ("A", 2, None, 4.0), ("A", 3, 7, None), ("A", 4, None, 6.0), ("A", 5, 8, None), ("B", 1, None, None), (None, 1, None, None), (None, 2, 3, None)]
    df = spark.createDataFrame(rows, "Driver string, LapNumber int, Stint int, TyreLife double")
    out = impute.fill_tyre_life(impute.fill_stint(df))
    got = {(r["Driver"], r["LapNumber"]): (r["Stint"], r["TyreLife"]) for r in out.collect()}
    assert got == {("A", 1): (7, 4.0), ("A", 2): (7, 4.0), ("A", 3): (7, 4.0), ("A", 4): (7, 6.0), ("A", 5): (8, None), ("B", 1): (None, None), (None, 1): (None, None), (None, 2): (3, None)}
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedfollowing$" in plan and "currentrow$(), unboundedfollowing$()" not in plan


def test_report_fills_once(spark):
    """The laps are made once for the speeds' medians and once for the rest."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(120).selectExpr(
        "2024 as Season", "case when id < 100 then 1 end as RoundNumber", "'R' as SessionType", "'GP' as EventName", "concat('D', id % 2) as Driver", "cast(id div 2 as int) as LapNumber", "case when id % 3 > 0 then 1 end as Stint",
        "case when id % 5 > 0 then 2.0D end as TyreLife", "case when id % 7 > 0 then 'SOFT' end as Compound", "case when id % 10 > 0 then 80.0D end as LapTime_s", *(f"case when id % {n} > 0 then 300.0D end as {c}" for n, c in zip((2, 4, 9, 200), impute.SPEEDS)))
    got = impute.impute_report(rows.mapInArrow(counted, rows.schema)).collect()
    assert [tuple(r) for r in got] == [(2024, 1, "R", 90, 30, 10, 13, 40, 20, 10, 0)]
    assert seen.value == 240


def test_speeds_are_read_once(spark, laps):
    """The session's medians and the rows read what is written, not each anew what the rows are made from."""
    n, seen = laps.count(), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    out = impute.fill_speeds(laps.mapInArrow(counted, laps.schema).withColumn("untyped", F.lit(None)), store=True)
    assert out.count() == n == seen.value and dict(out.dtypes)["untyped"] == "void"

"""Features, joins, encoding and models on small frames."""

import pytest

from paceline.functions import scalar
from paceline.operators import encode, features, joins, ml


def column(df, name, order="LapNumber"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_rolling_pace(spark):
    df = spark.createDataFrame([("A", 1, n, t) for n, t in ((3, 92.0), (1, 90.0), (2, 91.0), (4, 93.0))] + [("A", 2, 5, 100.0), ("A", None, 6, 99.0)], "Driver string, Stint int, LapNumber int, LapTime_s double")
    out = features.rolling_pace(df)
    assert column(out, "roll_laptime_3") == [90, 90.5, 91, 92, 100, None]
    assert column(out, "roll_std_3")[:2] == [None, pytest.approx(0.7071067)]
    assert column(out, "delta_roll_pace")[3] == pytest.approx(0.5)
    assert column(features.rolling_pace(df, exclude_current=True), "roll_laptime_3")[:3] == [None, 90, 90.5]
    assert features.rolling_pace(df.limit(0)).count() == 0


def test_gap_and_tyres(spark):
    df = spark.createDataFrame([("A", "GP", 1, i, float(x), 0.5 * x + 90) for i, x in enumerate((10, 15, 20))] + [("A", "GP", 2, 3, 5.0, 95.0), ("B", "GP", 1, 4, 7.0, 91.0), ("B", "GP", 1, 5, 7.0, 92.0)], "Driver string, EventName string, Stint int, LapNumber int, TyreLife double, LapTime_s double")
    assert column(features.gap_to_fastest(df), "delta_to_fastest_s") == [0, 2.5, 5, 0, 0, 1]
    assert column(features.degradation_slope(df), "tyre_deg_slope") == [pytest.approx(0.5)] * 3 + [None] * 3
    assert column(features.normalised_tyre_life(df), "tyre_life_norm") == [0, 0.5, 1, 0, 0, 0]


def test_track_evolution_and_wear(spark):
    df = spark.createDataFrame([(n, 100.0 - n) for n in range(1, 7)], "LapNumber int, LapTime_s double")
    assert column(features.track_evolution(df, window=2), "track_evolution_factor") == [0, 0, -2, -2, -2, -2]
    wear = spark.createDataFrame([("A", 1, 20.0), ("A", 2, 20.5), ("A", 3, 20.2), ("B", 1, 21.0), ("B", 2, 21.5)], "Driver string, LapNumber int, Sector3Time_s double")
    assert [r[0] for r in features.brake_wear(wear, 2).orderBy("Driver", "LapNumber").select("brake_wear_proxy").collect()] == [0, pytest.approx(0.125), pytest.approx(0.045), 0, pytest.approx(0.125)]
    assert column(features.brake_wear(df), "brake_wear_proxy") == [0] * 6
    heat = spark.createDataFrame([(1, 20.0), (10, 30.0), (20, 40.0), (5, None), (10, 90.0)], "LapNumber int, TrackTemp double")
    assert sorted(r["pu_strain_index"] for r in scalar.strain_index(heat).collect()) == [0, pytest.approx(2 / 3), 10, 20, pytest.approx(80 / 3)]


def test_era_and_grid(spark):
    era = spark.createDataFrame([(2024, 80.0, 5), (2026, 80.0, 5), (2024, 80.0, None)], "Season int, LapTime_s double, DownforceLevel_val int")
    assert [r["LapTime_s"] for r in scalar.era_penalty(era).collect()] == [82.5, 80.0, pytest.approx(82.1)]
    grid = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (11.0,), (None,)], "GridPosition double")
    assert [tuple(r)[1:] for r in scalar.grid_flags(grid).collect()] == [(1, 1, 0), (1, 1, 1), (0, 1, 9), (0, 0, 10), (None, None, None)]


@pytest.mark.parametrize("bucket", [None, 1, 60])
def test_weather_as_of(spark, bucket):
    laps = spark.sql("select * from values (1, timestamp_seconds(90)), (2, timestamp_seconds(92)), (3, timestamp_seconds(94)), (4, timestamp_seconds(59)), (5, cast(null as timestamp)), (6, timestamp_seconds(91)) t(LapNumber, Time)")
    weather = spark.sql("select timestamp_seconds(t) as Time, a as AirTemp, a as TrackTemp, a as Humidity, true as Rainfall, a as WindSpeed from values (60, 28.5D), (91, 29.0D), (93, 30.0D), (93, 29.9D) w(t, a)")
    assert column(joins.add_weather(laps, weather, bucket_seconds=bucket), "AirTemp") == [28.5, 29.0, 30.0, None, None, 29.0]
    assert column(joins.add_weather(laps, weather.limit(0), bucket_seconds=bucket), "AirTemp") == [None] * 6
    with pytest.raises(KeyError):
        joins.add_weather(laps, weather.drop("Humidity"))


def test_points(spark):
    laps = spark.createDataFrame([(2024, 3, "VER", "Red Bull"), (2024, 3, "NOB", "Nobody"), (2024, 1, "VER", "Red Bull"), (2025, 1, "VER", "Red Bull"), (2024, 3, None, None)], "Season int, RoundNumber int, Driver string, Team string")
    results = spark.createDataFrame([(2024, 1, "VER", "Red Bull", 25.0), (2024, 1, "PER", "Red Bull", 18.0), (2024, 2, "VER", "Red Bull", 10.0), (2024, 3, "VER", "Red Bull", 25.0)], "Season int, RoundNumber int, Abbreviation string, TeamName string, Points double")
    out = joins.add_points(laps, results)
    got = {(r["Season"], r["RoundNumber"], r["Driver"]): (r["DriverPointsPreRace"], r["TeamPointsPreRace"]) for r in out.collect()}
    assert got == {(2024, 3, "VER"): (35, 53), (2024, 3, "NOB"): (0, 0), (2024, 1, "VER"): (0, 0), (2025, 1, "VER"): (0, 0), (2024, 3, None): (0, 0)}
    assert dict(out.dtypes)["DriverPointsPreRace"] == "float"
    assert joins.add_points(laps.drop("Team"), results).first()["TeamPointsPreRace"] == 0


def test_one_hot(spark):
    df = spark.createDataFrame([("SOFT", 1), ("HARD", 2), (None, 3)], "Compound string, n int")
    hot = encode.OneHot(("Compound",))
    with pytest.raises(RuntimeError):
        hot.transform(df)
    hot.fit(df)
    assert hot.names() == ["Compound_HARD", "Compound_None", "Compound_SOFT"]
    new = spark.createDataFrame([("WET", 1)], "Compound string, n int")
    assert tuple(hot.transform(new).first()) == ("WET", 1, 0, 0, 0)
    with pytest.raises(KeyError):
        hot.transform(df.drop("Compound"))


def test_one_hot_of_many_categories(spark):
    df = spark.createDataFrame([(f"t{i:03d}", "SOFT" if i % 2 else None, i) for i in range(40)] + [(None, "HARD", 99)], "Team string, Compound string, n int")
    hot = encode.OneHot(("Compound", "Team"), wide=10).fit(df)
    assert hot.names() == ["Compound_HARD", "Compound_None", "Compound_SOFT", "Team_vector"]
    out = hot.transform(df.union(spark.createDataFrame([("new", "SOFT", 100)], df.schema)))
    rows = {r["n"]: r for r in out.collect()}
    assert out.columns == [*df.columns, *hot.names()] and len(rows) == 42
    # Alphabetical: "None" for null comes before the teams.
    assert all(rows[i]["Team_vector"].toArray().tolist() == [float(k == i + 1) for k in range(41)] for i in range(40))
    assert rows[99]["Team_vector"].toArray()[0] == 1 and rows[99]["Team"] is None and rows[100]["Team_vector"].toArray().sum() == 0


def test_matrix_and_split(spark):
    df = spark.createDataFrame([(2023, 1, "A", 90.0, 1.0), (2024, 1, "A", None, 2.0), (2024, 2, "B", 91.0, 3.0)], "Season int, LapNumber int, Driver string, LapTime_s double, TyreLife double")
    assert encode.feature_matrix(df).columns == ["Season", "LapNumber", "TyreLife", "LapTime_s"]
    assert encode.feature_matrix(df).count() == 2
    assert encode.feature_matrix(df, target=None).count() == 3
    train, test, missing = encode.chronological_split(df, [2022, 2023], 2024)
    assert (train.count(), test.count(), missing) == (1, 2, [2022])
    for seasons, season in (([2024], 2024), ([2020], 2024), ([2023], 2030)):
        with pytest.raises(ValueError):
            encode.chronological_split(df, seasons, season)
    assert encode.aligned_columns(df, df.drop("TyreLife")) == ["Season", "LapNumber"]
    assert encode.reindexed(df, ["TyreLife", "gone"]).columns == ["TyreLife", "gone"]


def test_models(spark):
    rows = [(i, float(i % 7), float(i % 5), 90 + 0.5 * (i % 7) + 0.1 * (i % 5)) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, a double, b double, LapTime_s double")
    x, names = ml.dense(df, ["a", "b"])
    out = ml.scored(ml.linear(names).fit(x), x, "p")
    assert max(abs(r["p"] - r["LapTime_s"]) for r in out.collect()) < 1e-6
    trees = ml.boosted(names, rounds=10, depth=3).fit(x)
    assert [r["feature"] for r in ml.importances(trees, names, spark).collect()] == ["a", "b"]
    assert {r["fold"] for r in ml.folds(df, ["i"], 4).collect()} == {0, 1, 2, 3}
    band = ml.quantile_band(out.withColumn("g", out["a"]), out.withColumn("g", out["a"]), "p", "g")
    assert band.where("p_p05 <= p_p50 and p_p50 <= p_p95").count() == 80


def test_points_by_a_join_of_rounds(spark):
    """Rounds without results, null rounds, names and points; no array is walked for each lap."""
    results = spark.createDataFrame([(2024, 1, "A", 25.0), (2024, 3, "A", 18.0), (2024, 4, "A", None), (2024, None, "A", 9.0), (2024, 3, "B", 1.0), (2024, 3, "B", 2.0), (2023, 1, "A", 7.0), (2024, 1, None, 5.0)], "Season int, RoundNumber int, Abbreviation string, Points double")
    laps = spark.createDataFrame([(2024, r, d) for r in (1, 2, 3, 4, 9, None) for d in ("A", "B", None)] * 2, "Season int, RoundNumber int, Driver string")
    out = joins.add_points(laps, results)
    got = {(r["RoundNumber"], r["Driver"]): r["DriverPointsPreRace"] for r in out.collect()}
    want = {2: (25.0, 0.0), 3: (25.0, 0.0), 4: (43.0, 3.0), 9: (43.0, 3.0)}
    assert out.count() == 36 and got == {(r, d): want.get(r, (0.0, 0.0))["AB".index(d)] if d else 0.0 for r, d in got}
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()

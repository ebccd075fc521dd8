"""Models: folds, stack, search, early stopping and bounds against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.operators import ml
from paceline.plans import pipelines


@pytest.fixture(scope="module")
def smooth(spark):
    """A target with a curve, a step and noise, in two parts: to fit, and to judge."""
    rng = np.random.default_rng(7)
    n = 3000
    a, b = rng.uniform(-3, 3, n), rng.uniform(0, 1, n)
    y = 80 + 4 * np.sin(a) + 3 * (b > 0.6) + rng.normal(0, 0.1, n)
    rows = spark.createDataFrame([(k, float(p), float(q), float(r)) for k, (p, q, r) in enumerate(zip(a, b, y))], "event_id long, a double, b double, LapTime_s double").repartition(4).cache()
    return rows.where("event_id < 2000"), rows.where("event_id >= 2000"), np.stack([a, b, y], 1)


def test_boosting_stops_by_itself(smooth):
    train, rest, data = smooth
    model = ml.fit_boosted(train, ["a", "b"], depth=4, step=0.2, tol=0.01)
    assert 5 < ml.chosen_rounds(model) < 100
    # A constant is 2.9 off on average and the best line more than 1; the noise alone is 0.08.
    assert ml.mean_error(ml.scored(model, rest, "p"), "p") < 0.25 < np.abs(data[2000:, 2] - data[:2000, 2].mean()).mean()
    assert ml.boosted(["a"]).getStages()[-1].getMaxIter() == 500


def test_few_rows_still_fit(spark):
    df = spark.createDataFrame([(float(k), 2.0 * k) for k in range(12)], "a double, LapTime_s double")
    assert ml.chosen_rounds(ml.fit_boosted(df, ["a"], rounds=3)) == 3


def test_rows_are_numbered_in_order(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 50, 997).tolist()  # many ties
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, v int").repartition(7)
    got = sorted((r["number"], r["v"]) for r in ml.numbered(df, ["v"]).collect())
    assert [n for n, _ in got] == list(range(997)) and [v for _, v in got] == sorted(values)
    for k in (2, 5, 7):
        rows = ml.folds(df, ["v"], k).collect()
        sizes = [sum(r["fold"] == f for r in rows) for f in range(k)]
        assert sum(sizes) == 997 and max(sizes) - min(sizes) <= 1
        edges = [(min(r["v"] for r in rows if r["fold"] == f), max(r["v"] for r in rows if r["fold"] == f)) for f in range(k)]
        assert all(a[1] <= b[0] for a, b in zip(edges, edges[1:]))
    assert ml.folds(df.limit(0), ["v"]).count() == 0


def test_no_row_is_predicted_by_a_model_that_saw_it(smooth):
    rows = ml.folds(smooth[0].where("event_id < 200"), ["event_id"], 4)
    seen = []

    def fit(df):
        seen.append({r[0] for r in df.select("event_id").collect()})
        return ml.linear(["a", "b"]).fit(df)

    out = ml.out_of_fold(rows, {"base": fit}).select("event_id", "fold").collect()
    assert len(out) == 200 and len(seen) == 4
    assert all(r["event_id"] not in seen[r["fold"]] for r in out) and all(len(s) == 150 for s in seen)


def lines(x, y):
    return np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)[0]


def at(line, x):
    return np.c_[x, np.ones(len(x))] @ line


def test_stack_is_the_plain_one(smooth):
    train, rest, data = smooth
    bases = {"one": lambda df: ml.linear(["a"]).fit(df), "two": lambda df: ml.linear(["a", "b"]).fit(df)}
    models = ml.stacked(train, ["a", "b"], ["event_id"], k=3, ridge=0.0, bases=bases)
    got = {r["event_id"]: r["p"] for r in ml.predict_stacked(models, rest, "p").collect()}
    x, y = data[:2000, :2], data[:2000, 2]
    fold = np.arange(2000) * 3 // 2000
    sides = [x[:, :1], x]
    oof = np.zeros((2000, 2))
    for f in range(3):
        for k, s in enumerate(sides):
            oof[fold == f, k] = at(lines(s[fold != f], y[fold != f]), s[fold == f])
    meta = lines(oof, y)
    z = data[2000:, :2]
    want = at(meta, np.stack([at(lines(x[:, :1], y), z[:, :1]), at(lines(x, y), z)], 1))
    assert [got[k] for k in range(2000, 3000)] == pytest.approx(want.tolist(), abs=1e-6)


def test_boosted_stack_beats_its_line(smooth):
    train, rest, _ = smooth
    models = ml.stacked(train, ["a", "b"], ["event_id"], k=2, rounds=12, depth=4, step=0.3, ridge=0.01)
    error = ml.mean_error(ml.predict_stacked(models, rest, "p"), "p")
    assert error < 0.4 * ml.mean_error(ml.scored(models[0]["base_linear"], rest, "p"), "p")


def test_search_finds_the_winner_of_the_whole_grid_with_fewer_rows(smooth):
    train = smooth[0].where("event_id < 900")
    grid = [{"depth": 1, "step": 0.05}, {"depth": 4, "step": 0.3}, {"depth": 2, "step": 0.01}, {"depth": 1, "step": 0.3}]
    best, table = ml.searched(train, ["a", "b"], ["event_id"], grid, k=2, rungs=2, rounds=6)
    told = table.collect()
    whole = ml.searched(train, ["a", "b"], ["event_id"], grid, k=2, rungs=1, rounds=6)
    assert best == whole[0] == grid[1]
    assert [sum(r["rung"] == k for r in told) for k in (0, 1)] == [8, 4] and {r["share"] for r in told} == {0.5, 1.0}
    assert {r["candidate"] for r in told if r["rung"] == 1} == {r["candidate"] for r in told if r["rung"] == 0 and r["kept"]}
    assert sum(r["share"] for r in told) == whole[1].count()  # as many rows as the grid once, and half of these in half-size fits
    errors = {}
    for r in whole[1].collect():
        errors.setdefault(r["candidate"], []).append(r["mae"])
    assert min(errors, key=lambda c: sum(errors[c])) == 1


def test_fits_of_a_search_at_once_give_what_they_give_in_turn(smooth, monkeypatch):
    """The rows with folds and flags are written once for all fits."""
    calls, own = [], ml.written
    monkeypatch.setattr(ml, "written", lambda df, purpose: calls.append(purpose) or own(df, purpose))
    train, grid = smooth[0].where("event_id < 300"), [{"depth": 1, "step": 0.05}, {"depth": 2, "step": 0.3}]
    one, many = (ml.searched(train, ["a", "b"], ["event_id"], grid, k=2, rungs=1, rounds=3, parallelism=n) for n in (1, 4))
    assert one[0] == many[0] and one[1].collect() == many[1].collect()
    assert calls == ["numbered", "search"] * 2
    assert not ml.boosted(["a", "b"]).getStages()[-1].getCacheNodeIds()


def test_quantile_line_of_two_groups(spark):
    # With one 0/1 feature the line takes the quantile of either group.
    rng = np.random.default_rng(5)
    sides = rng.normal(10, 1, 1501), rng.exponential(3, 1501)
    df = spark.createDataFrame([(float(g), float(v)) for g, s in enumerate(sides) for v in s], "g double, LapTime_s double")
    for share in (0.1, 0.5, 0.9):
        model = ml.quantile_line(df, ["g"], share, rounds=25)
        got = [r["p"] for r in ml.scored(model, spark.createDataFrame([(0.0,), (1.0,)], "g double"), "p").collect()]
        below = [float((s < q).mean()) for s, q in zip(sides, got)]
        assert below == pytest.approx([share, share], abs=0.03)


def test_calibrated_bounds_hold_for_other_rows(spark):
    rng = np.random.default_rng(11)
    n = 6000
    x = rng.uniform(1, 5, n)
    y = 60 + 5 * x + rng.standard_t(3, n) * x  # spread grows, tails are heavy
    order = rng.permutation(n)
    rows = spark.createDataFrame([(int(k), float(a), float(b)) for k, a, b in zip(order, x, y)], "event_id long, x double, LapTime_s double")
    out = ml.calibrated_band(rows.where("event_id < 4000"), rows.where("event_id >= 4000"), ["x"], ["event_id"])
    inside = out.agg(F.avg(F.col("LapTime_s").between(F.col("predicted_p05"), F.col("predicted_p95")).cast("double"))).first()[0]
    assert inside == pytest.approx(0.9, abs=0.02)
    width = out.groupBy((F.col("x") > 3).alias("far")).agg(F.avg(F.col("predicted_p95") - F.col("predicted_p05")).alias("w")).collect()
    width = {r["far"]: r["w"] for r in width}
    assert width[True] > 1.3 * width[False]


def test_season_predictions(spark):
    rng = np.random.default_rng(3)
    rows = []
    for season in (2023, 2024, 2025):
        for k in range(400):
            a, b = rng.uniform(0, 10), rng.uniform(0, 5)
            rows.append((season, 1 + k % 4, "R", f"GP {k % 4}", f"D{k % 5}", f"T{k % 5}", k // 20 + 1, float(a), float(b) if k % 17 else None, float(70 + a + 0.5 * b)))
    gold = spark.createDataFrame(rows, "Season int, RoundNumber int, SessionType string, EventName string, Driver string, Team string, LapNumber int, TyreLife double, SpeedI1 double, LapTime_s double")
    out = pipelines.predict_season(gold, [2023, 2024], 2025, ridge=0.0, depth=5, step=0.3, tol=0.01)
    assert out.count() == 400 and {r[0] for r in out.select("Season").distinct().collect()} == {2025}
    # Least squares by hand, with 0 for null and all numeric columns but the target.
    x = np.array([[r[0], r[1], r[6], r[7], r[8] or 0.0] for r in rows])
    y = np.array([r[9] for r in rows])
    train = x[:, 0] < 2025
    mean, dev = x[train].mean(0), x[train].std(0)
    line = lines((x[train] - mean) / dev, y[train])
    want = at(line, (x[~train] - mean) / dev)
    got = sorted((r["LapNumber"], r["Driver"], r["RoundNumber"], r["predicted_laptime_linear_s"]) for r in out.collect())
    expected = sorted((r[6], r[4], r[1], w) for r, w in zip(rows[800:], want))
    assert [g[3] for g in got] == pytest.approx([e[3] for e in expected], abs=1e-6)
    actual = gold.where("Season = 2025").select("LapNumber", "Driver", "RoundNumber", "LapTime_s")
    both = out.join(actual, ["LapNumber", "Driver", "RoundNumber"])
    assert ml.mean_error(both, "predicted_laptime_boosted_s") < 1.0 and ml.mean_error(both, "predicted_laptime_ensemble_s") < 1.0
    assert math.isclose(both.agg(F.max(F.abs(F.col("predicted_laptime_ensemble_s") - (F.col("predicted_laptime_linear_s") + F.col("predicted_laptime_boosted_s")) / 2))).first()[0], 0, abs_tol=1e-9)

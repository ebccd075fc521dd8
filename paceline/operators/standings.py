"""Standings, residual audit, verdicts, stints and qualifying."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.scalar import accuracy_class, needs_retraining, ordered_bounds
from paceline.operators.filters import clean_laps
from paceline.operators.quantiles import group_quantiles, joined_by
from paceline.session import session_keys

EPSILON = 2.220446049250313e-16  # of doubles: the least divisor of relative errors


def driver_standings(preds: DataFrame, model: str, approx: bool = False) -> DataFrame:
    """Drivers by median predicted time, over the season (event null) and by event.

    Means and deviations come from one pass over grouping sets; the medians are exact whatever the size of a driver's season (``group_quantiles``),
    or approximate ones of the same pass.
    """
    rows = preds.where(F.col(model).isNotNull() & F.col("Driver").isNotNull())
    keys = ["Season", "EventName", "Driver", "Team"]
    told = [F.avg(model).alias("mean_predicted_s"), F.count(model).alias("lap_count"), F.stddev_samp(model).alias("std_predicted_s")]
    if approx:
        told.append(F.percentile_approx(model, 0.5).alias("median_predicted_s"))
    stats = rows.groupingSets([["Season", "Driver", "Team"], keys], *keys).agg(F.grouping("EventName").cast("int").alias("whole"), *told)
    if not approx:
        scopes = [(1, rows.withColumn("EventName", F.lit(None).cast("string"))), (0, rows)]
        medians = reduce(DataFrame.unionByName, (group_quantiles(r, keys, [model], [0.5]).withColumn("whole", F.lit(w)) for w, r in scopes))
        stats = joined_by(stats, medians, ["whole", *keys]).withColumn("median_predicted_s", F.col(f"{model}__q")[0]).drop(f"{model}__q")
    rank = F.row_number().over(Window.partitionBy("Season", "whole", "EventName").orderBy("median_predicted_s", "Driver", "Team"))
    return stats.withColumn("scope", F.when(F.col("whole") == 1, "season").otherwise("event")).withColumn("rank", rank).drop("whole")


def bounded_standings(preds: DataFrame, lower: str, middle: str, upper: str) -> DataFrame:
    """Drivers by the median of the middle quantile, with medians of the others as bounds that hold it."""
    keys = session_keys(preds)
    stats = preds.groupBy(*keys, "Driver", "Team").agg(F.median(lower).alias("lower_bound_s"), F.median(middle).alias("median_predicted_s"), F.median(upper).alias("upper_bound_s")).where("median_predicted_s is not null")
    stats = ordered_bounds(stats, "lower_bound_s", "median_predicted_s", "upper_bound_s")
    return stats.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("median_predicted_s", "Driver")))


def actual_pace(laps: DataFrame) -> DataFrame:
    """Median time of clean laps by driver."""
    return clean_laps(laps).groupBy(*session_keys(laps), "Driver").agg(F.median("LapTime_s").alias("actual_median_s"))


def residuals(standings: DataFrame, laps: DataFrame) -> DataFrame:
    """Predicted against actual pace: residual, absolute error, whether the bounds hold it."""
    both = standings.join(actual_pace(laps), [*session_keys(standings), "Driver"])
    residual = F.col("actual_median_s") - F.col("median_predicted_s")
    return both.withColumns({"residual_s": residual, "abs_error_s": F.abs(residual), "in_range": F.col("actual_median_s").between(F.col("lower_bound_s"), F.col("upper_bound_s"))})


def residual_metrics(res: DataFrame) -> DataFrame:
    out = res.groupBy(*session_keys(res)).agg(F.avg("abs_error_s").alias("mae"), F.sqrt(F.avg(F.col("residual_s") ** 2)).alias("rmse"), (100 * F.avg(F.col("in_range").cast("double"))).alias("coverage_pct"))
    return out.withColumns({"accuracy": accuracy_class(F.col("mae")), "retrain": needs_retraining(F.col("mae"))})


def residual_spread(res: DataFrame) -> DataFrame:
    """Bias and population deviation of residuals by session."""
    return res.groupBy(*session_keys(res)).agg(F.avg("residual_s").alias("bias_s"), F.stddev_pop("residual_s").alias("std_s"))


def verdict(preds: DataFrame, results: DataFrame) -> DataFrame:
    """Predicted against official order by session: errors in places, winner, shares of podium and top ten, greatest misses.

    Sessions without a common driver get 999, 999, false and 0.  The shares are of 3 and 10, however few drivers there are.
    """
    keys = session_keys(results)
    official = results.select(*keys, F.col("Abbreviation").alias("Driver"), F.col("Position").alias("actual"))
    both = preds.select(*keys, "Driver", F.col("predicted_position").alias("predicted")).join(official, [*keys, "Driver"]).where("actual is not null")
    # Places among the common drivers decide what is a podium.
    place = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(c, "Driver"))
    both = both.withColumns({"p": place("predicted"), "a": place("actual"), "error": F.abs(F.col("predicted") - F.col("actual")).cast("double")})
    miss = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("error"), "Driver"))
    both = both.withColumn("m", miss)
    found = both.groupBy(*keys).agg(
        F.avg("error").alias("mae"), (100 * F.avg(F.col("error") / F.greatest(F.abs("actual").cast("double"), F.lit(EPSILON)))).alias("mape_pct"),
        F.coalesce(F.bool_or((F.col("p") == 1) & (F.col("a") == 1)), F.lit(False)).alias("winner_correct"),
        (F.count_if((F.col("p") <= 3) & (F.col("a") <= 3)) * 100 / 3).alias("podium_pct"), (F.count_if((F.col("p") <= 10) & (F.col("a") <= 10)) * 100 / 10).alias("top10_pct"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("m") <= 3, F.struct("m", "Driver")))), lambda x: x["Driver"]), ",").alias("key_misses"),
    )
    out = results.select(*keys).distinct().join(found, keys, "left")
    filled = {"mae": F.lit(999.0), "mape_pct": F.lit(999.0), "winner_correct": F.lit(False), "podium_pct": F.lit(0.0), "top10_pct": F.lit(0.0), "key_misses": F.lit("")}
    out = out.withColumns({c: F.coalesce(c, v) for c, v in filled.items()})
    return out.withColumns({"mae": F.round("mae", 4), "mape_pct": F.round("mape_pct", 2), "podium_pct": F.round("podium_pct", 1), "top10_pct": F.round("top10_pct", 1)}).withColumn("status", accuracy_class(F.col("mae")))


def regression_metrics(df: DataFrame, actual: str, predicted: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """MAE, RMSE and MAPE (a fraction) over rows with both values."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    return df.where(y.isNotNull() & F.col(predicted).isNotNull()).groupBy(*groups).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(EPSILON))).alias("mape"), F.count("*").alias("n")
    )


def event_metrics(df: DataFrame, actual: str, predicted: str, event: str | None = None) -> DataFrame:
    """Metrics by season and event, or of one event (an error if it has no rows)."""
    rows = df if event is None else df.where(F.col("EventName") == event)
    if event is not None and rows.isEmpty():
        raise ValueError(f"no rows for {event}")
    return regression_metrics(rows, actual, predicted, ("Season", "EventName"))


# Columns of which a driver's form takes the median.
FORM = ["SpeedI1", "SpeedI2", "SpeedFL", "SpeedST", "Sector1Time_s", "Sector2Time_s", "Sector3Time_s", "LapTime_s", "roll_std_3", "delta_roll_pace", "tyre_deg_slope", "tyre_life_norm"]


def driver_form(laps: DataFrame) -> DataFrame:
    """By driver: medians of the form columns that there are, most points, team of the first lap."""
    columns = [c for c in FORM if c in laps.columns]
    points = [F.max(c).alias(c) for c in ("DriverPointsPreRace", "TeamPointsPreRace") if c in laps.columns]
    rows = laps.where("Driver is not null")
    rest = rows.groupBy("Driver").agg(*points, F.min_by("Team", F.struct("Season", "RoundNumber", "LapNumber", "Team")).alias("Team"))
    medians = group_quantiles(rows, ["Driver"], columns, [0.5])
    return medians.join(rest, "Driver").select("Driver", *(F.col(f"{c}__q")[0].alias(c) for c in columns), *rest.columns[1:])


def scenario(form: DataFrame, season: int, round_: int, event: str, lap: int = 15) -> DataFrame:
    """One supposed lap for each driver of ``form``: medium tyres of age 10 in the first stint, own pace as rolling pace."""
    fixed = {"Season": season, "RoundNumber": round_, "EventName": event, "LapNumber": lap, "Stint": 1, "TyreLife": 10.0, "Compound": "MEDIUM", "Position": 5, "PitInTime_s": 0.0, "PitOutTime_s": 0.0}
    return form.withColumns({k: F.lit(v) for k, v in fixed.items()} | {"roll_laptime_3": F.col("LapTime_s"), "roll_laptime_5": F.col("LapTime_s"), "LapTime_s": F.lit(0.0)})


def stints(laps: DataFrame) -> DataFrame:
    """Laps of each driver by stint and compound (upper-case), numbered in the order first seen."""
    keys = [*session_keys(laps), "Driver"]
    own = laps.where("Stint is not null and Compound is not null").groupBy(*keys, "Stint", F.upper("Compound").alias("compound")).agg(F.count("*").alias("laps"), F.min("LapNumber").alias("first_lap"))
    order = Window.partitionBy(*keys).orderBy("first_lap", "Stint", "compound")
    return own.withColumn("stint_no", F.row_number().over(order)).select(*keys, "stint_no", "Stint", "compound", "laps", "first_lap")


def predicted_stints(order: DataFrame, total_laps: int) -> DataFrame:
    """Two supposed stints for each driver: two fifths on medium tyres, the rest on hard; drivers without a place rank 99."""
    first = F.rint(F.lit(0.4 * total_laps)).cast("int")
    two = F.array(F.struct(F.lit(1).alias("stint"), F.lit("MEDIUM").alias("compound"), first.alias("laps")), F.struct(F.lit(2).alias("stint"), F.lit("HARD").alias("compound"), (F.lit(total_laps) - first).alias("laps")))
    return order.select(*session_keys(order), "Driver", F.coalesce("predicted_position", F.lit(99)).alias("place"), F.inline(two))


def stint_shares(laps: DataFrame, first: int = 5) -> DataFrame:
    """Each stint's share of the race, and the strategy text of the session's first drivers."""
    keys = session_keys(laps)
    own = stints(laps).join(total_laps(laps), keys)
    text = own.groupBy(*keys, "Driver").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("stint_no", "compound"))), lambda x: F.substring(x["compound"], 1, 1)), "-").alias("s"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("Driver"))
    top = text.withColumn("n", n).where(F.col("n") <= first).select(*keys, "Driver", F.concat("Driver", F.lit(" ("), "s", F.lit(")")).alias("strategy"))
    return own.withColumn("share_pct", F.round(100 * F.col("laps") / F.col("total_laps"), 4)).join(top, [*keys, "Driver"], "left")


def total_laps(laps: DataFrame, default: int = 50) -> DataFrame:
    return laps.groupBy(*session_keys(laps)).agg(F.coalesce(F.max("LapNumber"), F.lit(default)).alias("total_laps"))


def qualifying(results: DataFrame, laps: DataFrame) -> DataFrame:
    """Best of Q3, Q2, Q1 and its gap to the fastest lap of the session."""
    keys = session_keys(results)
    pole = laps.groupBy(*keys).agg(F.min("LapTime_s").alias("pole_s"))
    best = F.coalesce("Q3", "Q2", "Q1")
    return results.join(pole, keys, "left").select(*keys, F.col("Abbreviation").alias("Driver"), best.alias("best_quali_s"), (best - F.col("pole_s")).alias("gap_to_pole_s"), "GridPosition")


def season_summary(preds: DataFrame, models: list[str], k: int = 5) -> DataFrame:
    """By season and model: laps scored, and the ``k`` best drivers by median time."""
    long = preds.select("Season", "Driver", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("t")) for m in models))).alias("x")).select("Season", "Driver", "x.*")
    medians = group_quantiles(long, ["Season", "model", "Driver"], ["t"], [0.5]).withColumn("m", F.col("t__q")[0]).drop("t__q")
    stats = joined_by(long.groupBy("Season", "model", "Driver").agg(F.count("*").alias("n")), medians, ["Season", "model", "Driver"])
    total = stats.groupBy("Season", "model").agg(F.sum("n").alias("total_laps"))
    rank = F.row_number().over(Window.partitionBy("Season", "model").orderBy("m", "Driver"))
    top = stats.where("m is not null").withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(total, ["Season", "model"]).select("Season", "model", "total_laps", "rank", "Driver", F.col("m").alias("median_predicted_s"))


def top_two(order: DataFrame, position: str) -> DataFrame:
    """Winner and runner-up by session."""
    n = F.row_number().over(Window.partitionBy(*session_keys(order)).orderBy(position, "Driver"))
    return order.where(F.col(position).isNotNull()).withColumn("n", n).where("n <= 2").groupBy(*session_keys(order)).agg(F.max(F.when(F.col("n") == 1, F.col("Driver"))).alias("winner"), F.max(F.when(F.col("n") == 2, F.col("Driver"))).alias("runner_up"))


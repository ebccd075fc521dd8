"""Per-lap features: pace, tyres, track, wear."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.session import grouped, keys_present, over_keys, session_keys


def rolling_pace(df: DataFrame, short: int = 3, long: int = 5, exclude_current: bool = False) -> DataFrame:
    """Rolling mean lap times over the stint, their sample deviation, and the short mean's lead over the long."""
    keys, end = grouped(df, ["Driver", "Stint"]), -1 if exclude_current else 0
    roll = lambda f, n: over_keys(f("LapTime_s"), keys, ["LapNumber"], (end - n + 1, end))
    out = df.withColumns({f"roll_laptime_{short}": roll(F.avg, short), f"roll_laptime_{long}": roll(F.avg, long), f"roll_std_{short}": roll(F.stddev_samp, short)})
    return out.withColumn("delta_roll_pace", F.col(f"roll_laptime_{short}") - F.col(f"roll_laptime_{long}"))


def gap_to_fastest(df: DataFrame, groups: tuple[str, ...] = ("Driver", "EventName")) -> DataFrame:
    return df.withColumn("delta_to_fastest_s", F.col("LapTime_s") - over_keys(F.min("LapTime_s"), grouped(df, list(groups))))


def degradation_slope(df: DataFrame, intercept: bool = False) -> DataFrame:
    """Least-squares slope of lap time on tyre life over the stint; null under two pairs or on constant life."""
    keys = grouped(df, ["Driver", "Stint"])
    out = {"tyre_deg_slope": over_keys(F.regr_slope("LapTime_s", "TyreLife"), keys)}
    if intercept:
        out["tyre_deg_intercept"] = over_keys(F.regr_intercept("LapTime_s", "TyreLife"), keys)
    return df.withColumns(out)


def normalised_tyre_life(df: DataFrame) -> DataFrame:
    """Tyre life scaled to 0..1 within the stint; 0 where it does not vary."""
    keys = grouped(df, ["Driver", "Stint"])
    low, high = over_keys(F.min("TyreLife"), keys), over_keys(F.max("TyreLife"), keys)
    return df.withColumn("tyre_life_norm", F.when(high == low, 0.0).when(high > low, (F.col("TyreLife") - low) / (high - low)))


def track_evolution(df: DataFrame, window: int = 5, fastest: int = 3) -> DataFrame:
    """Change of the field's pace (median of the fastest times of a lap) against ``window`` laps before; 0 at first.

    The pace of each lap number is a small table of its own, joined back; nothing is sorted by session but that table.
    """
    keys = session_keys(df)
    by_lap = [*keys, "LapNumber"]
    known = df.where(keys_present(by_lap)).select(*by_lap, "LapTime_s")
    best = Window.partitionBy(*by_lap).orderBy(F.col("LapTime_s").asc_nulls_last())
    pace = known.withColumn("__rank", F.row_number().over(best)).where(F.col("__rank") <= fastest).groupBy(*by_lap).agg(F.median("LapTime_s").alias("__pace"))
    before = F.lag("__pace", window).over(Window.partitionBy(*keys).orderBy("LapNumber"))
    factor = pace.select(*by_lap, F.coalesce(F.col("__pace") - before, F.lit(0.0)).alias("track_evolution_factor"))
    return df.join(factor, by_lap, "left").select(*df.columns, F.coalesce("track_evolution_factor", F.lit(0.0)).alias("track_evolution_factor"))


def brake_wear(df: DataFrame, window: int = 3) -> DataFrame:
    """Rolling sample variance of the last sector's time of the driver, across stints; 0 where unknown."""
    if "Sector3Time_s" not in df.columns:
        return df.withColumn("brake_wear_proxy", F.lit(0.0))
    value = over_keys(F.var_samp("Sector3Time_s"), grouped(df, ["Driver"]), ["LapNumber"], (1 - window, 0))
    return df.withColumn("brake_wear_proxy", F.coalesce(value, F.lit(0.0)))


def teammate_index(df: DataFrame, order: str = "Position") -> DataFrame:
    """Place of a driver among the team's cars of the session, and the line style that follows."""
    keys = session_keys(df)
    n = F.row_number().over(Window.partitionBy(*keys, "Team").orderBy(order, "Driver"))
    return df.withColumn("teammate_index", n).withColumn("line_style", F.when(F.col("teammate_index") == 1, "solid").otherwise("dashed"))


def predicted_order(df: DataFrame, *models: str) -> DataFrame:
    """Finishing places by the first model column with a value; rows without one are left out."""
    keys = session_keys(df)
    out = df.withColumn("predicted_s", F.coalesce(*models)).where("predicted_s is not null")
    return out.withColumn("predicted_position", F.row_number().over(Window.partitionBy(*keys).orderBy("predicted_s", "Driver")))


"""Filters of unrepresentative laps, and row predicates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.session import grouped, over_keys, require, session_keys

# Track status codes of neutralised laps, and the scale of the median absolute deviation for a normal distribution.
NEUTRALISED = ("2", "4", "5", "6", "7")
SCALE = 1.4826


def without_out_laps(df: DataFrame) -> DataFrame:
    return df.where(F.col("PitOutTime_s").isNull())


def without_in_laps(df: DataFrame) -> DataFrame:
    return df.where(F.col("PitInTime_s").isNull())


def _neutralised(statuses) -> Column:
    return F.coalesce(F.col("TrackStatus").isin(list(statuses)), F.lit(False))


def without_neutralised(df: DataFrame, statuses=NEUTRALISED) -> DataFrame:
    """Laps whose whole status string is not one of ``statuses``; null stays."""
    return df.where(~_neutralised(statuses))


def within_times(df: DataFrame, low: float = 50.0, high: float = 600.0) -> DataFrame:
    return df.where(F.col("LapTime_s").between(low, high))


def slow_outlier(df: DataFrame, z: float = 2.5, min_laps: int = 4, groups: tuple[str, ...] = ("Driver", "Stint")) -> DataFrame:
    """``df`` with a boolean ``__slow``: more than ``z`` scaled deviations above the median of its group.

    Two window passes over one partitioning.  Groups of fewer than ``min_laps`` times or without deviation,
    and rows with a null key, have no outliers.
    """
    require(df, ["LapTime_s", *groups])
    keys = grouped(df, list(groups))
    t = F.col("LapTime_s")
    staged = df.withColumns({"__median": over_keys(F.median(t), keys), "__n": over_keys(F.count(t), keys)})
    staged = staged.withColumn("__mad", over_keys(F.median(F.abs(t - F.col("__median"))), keys))
    slow = (F.col("__n") >= min_laps) & (F.col("__mad") > 0) & (t - F.col("__median") > z * SCALE * F.col("__mad"))
    return staged.withColumn("__slow", F.coalesce(slow, F.lit(False))).drop("__median", "__n", "__mad")


def without_outliers(df: DataFrame, z: float = 2.5, min_laps: int = 4, groups: tuple[str, ...] = ("Driver", "Stint")) -> DataFrame:
    return slow_outlier(df, z, min_laps, groups).where(~F.col("__slow")).drop("__slow")


def tagged(df: DataFrame, z: float = 2.5, min_laps: int = 4, low: float = 50.0, high: float = 600.0, statuses=NEUTRALISED) -> DataFrame:
    """``df`` with ``rule``: the first filter that drops the row (impossible, out, in, neutralised, outlier), or ``kept``."""
    hard = (
        F.when(~F.coalesce(F.col("LapTime_s").between(low, high), F.lit(False)), "impossible")
        .when(F.col("PitOutTime_s").isNotNull(), "out_lap").when(F.col("PitInTime_s").isNotNull(), "in_lap")
        .when(_neutralised(statuses), "neutralised")
    )
    # Only survivors count for the outliers: others have no time in that step.
    staged = df.withColumn("__rule", hard).withColumn("__time", F.col("LapTime_s")).withColumn("LapTime_s", F.when(F.col("__rule").isNull(), F.col("LapTime_s")))
    staged = slow_outlier(staged, z, min_laps).withColumn("LapTime_s", F.col("__time"))
    return staged.withColumn("rule", F.coalesce("__rule", F.when(F.col("__slow"), "outlier"), F.lit("kept"))).drop("__rule", "__time", "__slow")


def apply_filters(df: DataFrame, **how) -> DataFrame:
    return tagged(df, **how).where("rule = 'kept'").drop("rule")


def filter_report(df: DataFrame, **how) -> DataFrame:
    """Rows by session: total, removed by each step, kept and retention in per cent."""
    rules = ["impossible", "out_lap", "in_lap", "neutralised", "outlier"]
    keys = session_keys(df)
    counts = tagged(df, **how).groupBy(*keys).agg(
        F.count("*").alias("total_laps"), *(F.count_if(F.col("rule") == r).alias(f"removed_{r}") for r in rules), F.count_if(F.col("rule") == "kept").alias("kept_laps")
    )
    return counts.withColumn("retention_pct", F.when(F.col("total_laps") > 0, F.round(100 * F.col("kept_laps") / F.col("total_laps"), 2)).otherwise(0.0))


def with_lap_times(df: DataFrame) -> DataFrame:
    return df.where(F.col("LapTime_s").isNotNull())


def lap_time_report(df: DataFrame) -> DataFrame:
    """Rows without a lap time, by session."""
    return df.groupBy(*session_keys(df)).agg(F.count("*").alias("laps"), F.count_if(F.col("LapTime_s").isNull()).alias("dropped"))


def clean_laps(df: DataFrame) -> DataFrame:
    """Laps of the audit: neither in nor out lap, with a time."""
    return df.where("PitInTime_s is null and PitOutTime_s is null and LapTime_s is not null")


def events_in_window(schedule: DataFrame, now: datetime, back_days: int = 2, ahead_days: int = 3) -> DataFrame:
    """One row: the last race of the past ``back_days`` and the next of the coming ``ahead_days``, tests left out; null if none."""
    race = schedule.where(~F.lower(F.coalesce("EventFormat", F.lit(""))).contains("testing")).withColumn("__at", F.col("EventDate").cast("timestamp_ntz"))
    t = F.lit(now).cast("timestamp_ntz")
    what = F.struct("EventName", "RoundNumber")
    past = (F.col("__at") <= t) & (F.col("__at") >= t - F.expr(f"interval {back_days} days"))
    soon = (F.col("__at") >= t) & (F.col("__at") <= t + F.expr(f"interval {ahead_days} days"))
    got = race.agg(F.max_by(F.when(past, what), F.when(past, F.struct("__at", "RoundNumber"))).alias("a"), F.min_by(F.when(soon, what), F.when(soon, F.struct("__at", "RoundNumber"))).alias("b"))
    return got.select(F.col("a.EventName").alias("last_event"), F.col("a.RoundNumber").alias("last_round"), F.col("b.EventName").alias("next_event"), F.col("b.RoundNumber").alias("next_round"))


def next_round(schedule: DataFrame, now: datetime) -> DataFrame:
    """By season: the round of the next race, or the last of the season if none is left."""
    t = F.lit(now).cast("timestamp_ntz")
    at = F.col("EventDate").cast("timestamp_ntz")
    return schedule.groupBy("Season").agg(F.coalesce(F.min_by("RoundNumber", F.when(at >= t, F.struct(at, F.col("RoundNumber")))), F.max("RoundNumber")).alias("next_round"))


def entry_list(rounds: DataFrame, results: DataFrame) -> DataFrame:
    """Drivers of each of ``rounds`` (Season, RoundNumber): by its own results, else by those of the round before."""
    own = results.select("Season", F.col("RoundNumber").alias("__r"), "Driver", "Team").distinct()
    there = own.select("Season", "__r").distinct()
    wanted = rounds.select("Season", "RoundNumber").distinct()
    from_ = wanted.join(there, (wanted["Season"] == there["Season"]) & (wanted["RoundNumber"] == there["__r"]), "left").select(
        wanted["Season"], wanted["RoundNumber"], F.coalesce("__r", F.col("RoundNumber") - 1).alias("__from")
    )
    return from_.join(own, (from_["Season"] == own["Season"]) & (F.col("__from") == F.col("__r"))).select(from_["Season"], "RoundNumber", F.col("__from").alias("source_round"), "Driver", "Team")


def first_of(df: DataFrame, groups: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group in ``order``; Spark keeps no more than ``k`` rows of a group in each task before it deals rows out."""
    n = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("__n", n).where(F.col("__n") <= k).drop("__n")

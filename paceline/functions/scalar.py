"""Row-wise functions: times, names, flags, weights and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.session import require

TIME_COLUMNS = ["LapTime", "Sector1Time", "Sector2Time", "Sector3Time", "PitInTime", "PitOutTime"]

# Spellings of team names and the canonical name of each.
TEAM_NAMES = {
    "Red Bull Racing": "Red Bull",
    "Oracle Red Bull Racing": "Red Bull",
    "Red Bull Racing Honda": "Red Bull",
    "Mercedes": "Mercedes",
    "Mercedes-AMG Petronas F1 Team": "Mercedes",
    "Mercedes-AMG Petronas": "Mercedes",
    "Ferrari": "Ferrari",
    "Scuderia Ferrari": "Ferrari",
    "Scuderia Ferrari HP": "Ferrari",
    "McLaren": "McLaren",
    "McLaren F1 Team": "McLaren",
    "McLaren Mercedes": "McLaren",
    "Aston Martin": "Aston Martin",
    "Aston Martin Aramco": "Aston Martin",
    "Aston Martin F1 Team": "Aston Martin",
    "Alpine": "Alpine",
    "Alpine F1 Team": "Alpine",
    "Renault": "Alpine",
    "BWT Alpine F1 Team": "Alpine",
    "Williams": "Williams",
    "Williams Racing": "Williams",
    "AlphaTauri": "RB",
    "Scuderia AlphaTauri": "RB",
    "Scuderia AlphaTauri Honda": "RB",
    "RB": "RB",
    "Visa Cash App RB": "RB",
    "Toro Rosso": "RB",
    "Alfa Romeo": "Sauber",
    "Alfa Romeo Racing": "Sauber",
    "Sauber": "Sauber",
    "Kick Sauber": "Sauber",
    "Stake F1 Team Kick Sauber": "Sauber",
    "Haas F1 Team": "Haas",
    "Haas": "Haas",
    "MoneyGram Haas F1 Team": "Haas",
}
# Points of the first ten places; ordinal codes of tracks.
POINTS = [25, 18, 15, 12, 10, 8, 6, 4, 2, 1]
TRACK_TYPES = {"Street": 1, "Permanent": 2, "Hybrid": 3}
DOWNFORCE_LEVELS = {"Ultra-Low": 1, "Low": 2, "Medium": 3, "High": 4, "Ultra-High": 5}


def lookup(table: dict, key: Column) -> Column:
    """The table's value for ``key``, null where it has none."""
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def seconds(df: DataFrame, name: str) -> Column:
    """A duration column as double seconds: nanoseconds (bigint), intervals, ``h:mm:ss`` strings or numbers; NaN is null."""
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.LongType):
        return col / F.lit(1e9)
    if isinstance(kind, T.DayTimeIntervalType):
        part = lambda unit: F.expr(f"extract({unit} from `{name}`)").cast("double")
        return part("day") * 86400 + part("hour") * 3600 + part("minute") * 60 + part("second")
    if isinstance(kind, T.StringType):
        m = lambda i: F.try_to_number(F.regexp_extract(col, r"^(?:\d+ days? )?(\d+):(\d+):(\d+(?:\.\d+)?)$", i), F.lit("999999.999999999")).cast("double")
        return m(1) * 3600 + m(2) * 60 + m(3)
    value = col.cast("double")
    return F.when(~F.isnan(value), value)


def times_to_seconds(df: DataFrame, columns: list[str] = TIME_COLUMNS, drop_original: bool = True) -> DataFrame:
    """``<column>_s`` in seconds for each of ``columns`` that ``df`` has."""
    there = [c for c in columns if c in df.columns]
    out = df.withColumns({f"{c}_s": seconds(df, c) for c in there}) if there else df
    return out.drop(*there) if drop_original else out


def standard_teams(df: DataFrame, column: str = "Team", names: dict[str, str] = TEAM_NAMES) -> DataFrame:
    """Team names by their canonical spelling; unknown names stay."""
    require(df, [column])
    return df.withColumn(column, F.coalesce(lookup(names, F.col(column)), F.col(column)))


def unknown_teams(df: DataFrame, column: str = "Team", names: dict[str, str] = TEAM_NAMES) -> DataFrame:
    """``(team, laps)`` of names that neither are canonical nor stand for such."""
    known = sorted({*names, *names.values()})
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(known)).groupBy(F.col(column).alias("team")).agg(F.count("*").alias("laps"))


def standard_drivers(df: DataFrame, column: str = "Driver") -> DataFrame:
    return df.withColumn(column, F.upper(F.trim(column)))


def grid_flags(df: DataFrame, column: str = "GridPosition") -> DataFrame:
    """Front row, top ten and gap to pole of a grid place; nulls stay null."""
    require(df, [column])
    p = F.col(column)
    return df.withColumns({
        "is_front_row": (p <= 2).cast("byte"), "is_top10_start": (p <= 10).cast("byte"), "grid_gap_to_pole": p - 1,
    })


def era_penalty(df: DataFrame, column: str = "LapTime_s", from_season: int = 2026) -> DataFrame:
    """Lap times of seasons before ``from_season`` carry 1.5 s and 0.2 s for each level of downforce (3 if unknown)."""
    level = F.coalesce(F.col("DownforceLevel_val").cast("double"), F.lit(3.0)) if "DownforceLevel_val" in df.columns else F.lit(3.0)
    return df.withColumn(column, F.when(F.col("Season") < from_season, F.col(column) + 1.5 + 0.2 * level).otherwise(F.col(column)))


def strain_index(df: DataFrame) -> DataFrame:
    """``pu_strain_index``: laps run, weighted by track temperature over 30 within 0.5 and 2; unknown temperature counts 0."""
    if "TrackTemp" not in df.columns:
        return df.withColumn("pu_strain_index", F.col("LapNumber").cast("double"))
    heat = F.when(F.col("TrackTemp").isNotNull(), F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.col("TrackTemp") / 30)))
    return df.withColumn("pu_strain_index", F.coalesce(F.col("LapNumber") * heat, F.lit(0.0)))


def recency_weights(df: DataFrame, target_season: int, target_round: int, decay: float = 0.07, rounds: int = 24) -> DataFrame:
    """``weight`` falling exponentially with the rounds since, with a mean of 1 (the mean is one row, broadcast)."""
    raw = F.exp(-decay * ((target_season - F.col("Season")) * rounds + (target_round - F.col("RoundNumber"))))
    mean = df.agg(F.avg(raw).alias("__mean"))
    return df.withColumn("__raw", raw).join(F.broadcast(mean)).withColumn("weight", F.col("__raw") / F.col("__mean")).drop("__raw", "__mean")


def points_for(position: Column) -> Column:
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, POINTS)), F.when(position >= 1, position.cast("int"))), F.lit(0))


def result_time(position: Column, time_s: Column, status: Column) -> Column:
    """The winner's time as h:mm:ss.mmm, others' gap as +s.mmms; without a time the status, unless finished."""
    whole = F.floor(time_s)
    clock = F.format_string("%d:%02d:%02d.%03d", F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60)), F.floor(F.round((time_s - whole) * 1000, 3)))
    named = F.when(~F.coalesce(status, F.lit("")).isin("", "Finished"), status)
    return F.when(time_s.isNull(), named).when(position == 1, clock).otherwise(F.format_string("+%.3fs", time_s))


def ordered_bounds(df: DataFrame, lower: str, middle: str, upper: str) -> DataFrame:
    """Bounds moved so that they hold the middle."""
    return df.withColumns({lower: F.least(lower, middle), upper: F.greatest(upper, middle)})


def accuracy_class(mae: Column) -> Column:
    return F.when(mae < 0.2, "excellent").when(mae < 0.35, "good").otherwise("needs_improvement")


def needs_retraining(mae: Column, limit: float = 0.3) -> Column:
    return F.coalesce(mae > limit, F.lit(False))


def session_label(season: Column, round_: Column, session: Column, event: Column) -> Column:
    stem = F.format_string("%d_R%02d_%s", season, round_, session)
    return F.when(F.coalesce(event, F.lit("")) != "", F.concat(stem, F.lit(" - "), event)).otherwise(stem)


def text_match(query: str, *columns: str) -> Column:
    """Whether any of the columns holds ``query``, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(query.lower()), F.lit(False))
    return hit


def ensemble(df: DataFrame, columns: list[str], name: str = "predicted_laptime_ensemble_s") -> DataFrame:
    """The mean of model columns, null if one is null."""
    return df.withColumn(name, sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns))

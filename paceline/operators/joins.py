"""As-of joins, dimension lookups and championship points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.scalar import DOWNFORCE_LEVELS, TRACK_TYPES, lookup
from paceline.session import require, session_keys

WEATHER = ["AirTemp", "TrackTemp", "Humidity", "Rainfall", "WindSpeed"]
TRACK = ["TrackType_val", "DownforceLevel_val", "Abrasiveness", "FullThrottlePct", "AvgSpeed_kph", "MaxSpeed_kph", "CornerCount"]


def as_of(left: DataFrame, right: DataFrame, columns: list[str], on: str = "Time", keys: list[str] | None = None, bucket_seconds: int | None = None) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` at or before it, within ``keys``; null before the first.

    Both sides are put together and a window carries the last sample forward: one exchange, no range join.
    Of samples at one time, the greatest by its values counts.  With ``bucket_seconds`` the
    window runs within time buckets, so that one long series spreads over many tasks; the last
    sample of each bucket is carried over the small table of buckets.
    """
    keys = session_keys(left) if keys is None else keys
    require(right, [on, *keys, *columns])
    sample = F.struct(*(F.col(c) for c in columns))
    # Keys stay columns of their own, so that what follows knows how the rows lie.
    others = [c for c in left.columns if c not in keys] or [on]
    tag = {c: f"__l_{c}" for c in others}
    rows = left.select(*keys, F.col(on).alias("__t"), F.lit(1).alias("__side"), F.struct(*(F.col(c).alias(t) for c, t in tag.items())).alias("__row"), F.lit(None).cast(right.select(sample.alias("s")).schema["s"].dataType).alias("__s"))
    samples = right.where(F.col(on).isNotNull()).select(*keys, F.col(on).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), sample.alias("__s"))
    both = rows.union(samples)
    part = list(keys)
    if bucket_seconds:
        both = both.withColumn("__b", F.floor(F.unix_micros(F.col("__t").cast("timestamp")) / (bucket_seconds * 1_000_000)))
        part = [*keys, "__b"]
    w = Window.partitionBy(*part).orderBy("__t", "__side", "__s").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__hit", F.last("__s", ignorenulls=True).over(w))
    if bucket_seconds:
        lasts = both.where("__side = 0").groupBy(*part).agg(F.max(F.struct("__t", "__s")).alias("m"))
        cells = both.select(*part).distinct().join(lasts, part, "left")
        back = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carried = cells.select(*part, F.last("m", ignorenulls=True).over(back)["__s"].alias("__carried"))
        found = found.where("__side = 1").join(carried, part, "left").withColumn("__hit", F.coalesce("__hit", "__carried"))
    kept = found.where("__side = 1").withColumn("__hit", F.when(F.col("__t").isNotNull(), F.col("__hit")))
    return kept.select(*(F.col(c) if c in keys else F.col("__row")[tag[c]].alias(c) for c in left.columns), *(F.col("__hit")[c].alias(c) for c in columns))


def add_weather(laps: DataFrame, weather: DataFrame, on: str = "Time", bucket_seconds: int | None = None) -> DataFrame:
    """Weather at the time of each lap; nulls where there is none before it."""
    return as_of(laps, weather, WEATHER, on, bucket_seconds=bucket_seconds)


def add_track(df: DataFrame, tracks: DataFrame) -> DataFrame:
    """Track data by event, with ordinal codes; 0 where the track or a value is unknown."""
    own = tracks.select(
        "EventName", lookup(TRACK_TYPES, F.col("TrackType")).alias("TrackType_val"), lookup(DOWNFORCE_LEVELS, F.col("DownforceLevel")).alias("DownforceLevel_val"),
        *(F.col(c) for c in TRACK[2:]),
    )
    # A calendar holds some dozens of tracks; Spark broadcasts the side if its size allows.
    joined = df.join(own, "EventName", "left")
    return joined.select(*df.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in TRACK))


def add_points(laps: DataFrame, results: DataFrame) -> DataFrame:
    """Championship points of the driver and the team before the round: sums over earlier rounds of the season.

    Results become one row for each season, name and round, with the points so far and the next round (a season has some dozens of
    rounds), so that each lap meets at most one row of a small table and the laps are read once.
    """
    name = lambda df, *options: next((c for c in options if c in df.columns), None)
    out = laps
    points = results.where("SessionType = 'R'") if "SessionType" in results.columns else results
    for kind, lap_names, result_names in (("Driver", ("Driver", "Abbreviation"), ("Abbreviation", "Driver")), ("Team", ("Team", "TeamName"), ("TeamName", "Team"))):
        target, own, theirs = f"{kind}PointsPreRace", name(laps, *lap_names), name(results, *result_names)
        if own is None or theirs is None or "Points" not in results.columns:
            out = out.withColumn(target, F.lit(0.0).cast("float"))
            continue
        by_round = points.where(F.col(theirs).isNotNull()).groupBy(F.col("Season").alias("__season"), F.col(theirs).alias("__key"), F.col("RoundNumber").alias("round")).agg(F.sum("Points").alias("p"))
        seasons = Window.partitionBy("__season", "__key").orderBy("round")
        earned = by_round.where("__season is not null and round is not null").select("__season", "__key", F.col("round").alias("__from"), F.lead("round").over(seasons).alias("__to"), F.sum("p").over(seasons).alias("__earned"))
        meets = (out["Season"] == F.col("__season")) & (out[own] == F.col("__key")) & (out["RoundNumber"] > F.col("__from")) & (F.col("__to").isNull() | (out["RoundNumber"] <= F.col("__to")))
        out = out.join(earned, meets, "left").withColumn(target, F.coalesce("__earned", F.lit(0.0)).cast("float")).drop("__season", "__key", "__from", "__to", "__earned")
    return out


def add_grid(laps: DataFrame, results: DataFrame) -> DataFrame:
    """Grid place of the lap's driver in its session."""
    keys = session_keys(laps)
    grid = results.groupBy(*keys, F.col("Abbreviation").alias("Driver")).agg(F.max("GridPosition").alias("GridPosition"))
    return laps.join(grid, [*keys, "Driver"], "left")


def add_event_names(df: DataFrame, schedule: DataFrame) -> DataFrame:
    """Event name of the round, ``Round N`` if the schedule has none, and its folder name."""
    names = schedule.groupBy("Season", "RoundNumber").agg(F.min("EventName").alias("__name"))
    out = df.join(names, ["Season", "RoundNumber"], "left").withColumn("event_title", F.coalesce("__name", F.concat(F.lit("Round "), F.col("RoundNumber").cast("string")))).drop("__name")
    return out.withColumn("event_dir", F.regexp_replace("event_title", " ", "_"))


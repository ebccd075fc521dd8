"""Race artifacts: lap-position grids, pivots, result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions.scalar import result_time
from paceline.session import session_keys

OUT = 22  # the place of a driver who is off the grid


def lap_positions(laps: DataFrame, results: DataFrame, totals: DataFrame) -> DataFrame:
    """One row for each driver with laps and each lap up to the session's total: the place, ``OUT`` if unknown.

    The last lap has the official place.
    """
    keys = session_keys(laps)
    drivers = laps.select(*keys, "Driver").distinct().join(totals, keys)
    dense = drivers.select(*keys, "Driver", "total_laps", F.explode(F.sequence(F.lit(1), F.col("total_laps"))).alias("lap"))
    own = laps.groupBy(*keys, "Driver", F.col("LapNumber").alias("lap")).agg(F.min("Position").alias("p"))
    official = results.groupBy(*keys, F.col("Abbreviation").alias("Driver")).agg(F.min("Position").alias("official"))
    joined = dense.join(own, [*keys, "Driver", "lap"], "left").join(official, [*keys, "Driver"], "left")
    place = F.when(F.col("lap") == F.col("total_laps"), F.coalesce("official", F.lit(OUT))).otherwise(F.coalesce("p", F.lit(OUT)))
    return joined.select(*keys, "Driver", "lap", place.cast("int").alias("position"))


def predicted_positions(order: DataFrame, total_laps: int, unknown: int = 20) -> DataFrame:
    """Places on a straight line from grid to predicted place, rounded half to even."""
    start = F.when(F.col("GridPosition") > 0, F.col("GridPosition")).otherwise(F.lit(float(unknown)))
    end = F.coalesce(F.col("predicted_position").cast("double"), F.lit(float(unknown)))
    dense = order.select(*session_keys(order), "Driver", start.alias("s"), end.alias("e"), F.explode(F.sequence(F.lit(1), F.lit(total_laps))).alias("lap"))
    return dense.select(*session_keys(order), "Driver", "lap", F.rint(F.col("s") + (F.col("e") - F.col("s")) * F.col("lap") / total_laps).cast("int").alias("position"))


def as_maps(grid: DataFrame) -> DataFrame:
    """One row per driver: a map from lap to place."""
    keys = session_keys(grid)
    return grid.groupBy(*keys, "Driver").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("lap").cast("string"), "position")))).alias("positions"))


def from_maps(maps: DataFrame) -> DataFrame:
    """The rows of ``as_maps`` again."""
    return maps.select(*session_keys(maps), "Driver", F.explode("positions").alias("lap", "position")).withColumn("lap", F.col("lap").cast("int"))


def pivot_laps(grid: DataFrame, drivers: list[str]) -> DataFrame:
    """One row per lap, one column for each of ``drivers``."""
    return grid.groupBy(*session_keys(grid), "lap").pivot("Driver", drivers).agg(F.first("position"))


def official_results(results: DataFrame) -> DataFrame:
    """One row per session: the results in order, as an array of records."""
    keys = session_keys(results)
    record = F.struct(F.col("Position").cast("int").alias("position"), F.col("Abbreviation").alias("driver"), F.col("TeamName").alias("team"), result_time(F.col("Position"), F.col("Time"), F.col("Status")).alias("time"), F.col("Points").cast("double").alias("points"))
    return results.groupBy(*keys).agg(F.sort_array(F.collect_list(record)).alias("results"))

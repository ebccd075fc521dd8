"""Fills of missing tyre data and speeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.operators.filters import with_lap_times
from paceline.operators.quantiles import group_quantiles
from paceline.session import grouped, keys_present, over_keys, session_keys
from paceline.sources.scratch import written

SPEEDS = ["SpeedI1", "SpeedI2", "SpeedFL", "SpeedST"]


def _filled(column: str, keys: list[str], order: str) -> Column:
    """The last value before, else the first after, within ``keys``; a row with a null key keeps its own.

    Where there is none before, the first after is the first of all.  That is looked up once a group; a frame that ends with the group
    but starts at the row is walked anew for each row.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.coalesce(F.col(column), F.when(keys_present(keys), F.coalesce(before, after)))


def fill_stint(df: DataFrame, order: str = "LapNumber") -> DataFrame:
    return df.withColumn("Stint", _filled("Stint", grouped(df, ["Driver"]), order))


def fill_tyre_life(df: DataFrame, order: str = "LapNumber") -> DataFrame:
    return df.withColumn("TyreLife", _filled("TyreLife", grouped(df, ["Driver", "Stint"]), order))


def fill_compound(df: DataFrame) -> DataFrame:
    """The most frequent compound of the stint, the smallest of ties; none where all are null."""
    mode = over_keys(F.mode("Compound", deterministic=True), grouped(df, ["Driver", "Stint"]))
    return df.withColumn("Compound", F.coalesce("Compound", mode))


def fill_speeds(df: DataFrame, columns: list[str] = SPEEDS, groups: tuple[str, ...] = ("Driver", "EventName"), approx: bool = False, store: bool = False) -> DataFrame:
    """Group medians, then the session's median of the column so filled.  Without the group columns the second step is the only one.

    The first is a window, which needs no exchange where rows lie by session and driver; the second is an aggregate
    joined back, so no task has to hold a session.  With ``store`` the rows are written once between them, so that
    what they are made from is not run for the aggregate and once more for the rows.
    """
    columns = [c for c in columns if c in df.columns]
    median = (lambda c: F.percentile_approx(c, 0.5)) if approx else F.median
    if all(g in df.columns for g in groups):
        keys = grouped(df, list(groups))
        df = df.withColumns({c: F.coalesce(c, over_keys(median(c), keys)) for c in columns})
    outer_keys = session_keys(df)
    if approx:
        outer = df.groupBy(*outer_keys).agg(*(median(c).alias(f"__s_{c}") for c in columns))
    else:
        df = written(df, "filled-by-group") if store else df
        outer = group_quantiles(df, outer_keys, columns, [0.5], stored=store).select(*outer_keys, *(F.col(f"{c}__q")[0].alias(f"__s_{c}") for c in columns))
    joined = df.join(outer, outer_keys, "left") if outer_keys else df.join(F.broadcast(outer))
    return joined.withColumns({c: F.coalesce(c, f"__s_{c}") for c in columns}).select(*df.columns)


def impute(df: DataFrame, store: bool = False) -> DataFrame:
    """Rows with a lap time, filled: stint, tyre life, compound, speeds; ``store`` as in ``fill_speeds``."""
    return fill_speeds(fill_compound(fill_tyre_life(fill_stint(with_lap_times(df)))), store=store)


def impute_report(df: DataFrame) -> DataFrame:
    """Values filled, by session and column."""
    columns = ["Stint", "TyreLife", "Compound", *SPEEDS]
    keys = session_keys(df)
    # What was null is told by flags that go along, so that the laps are made and filled once.
    filled = impute(with_lap_times(df).withColumns({f"__null_{c}": F.col(c).isNull() for c in columns})).where(keys_present(keys))
    return filled.groupBy(*keys).agg(F.count("*").alias("laps"), *((F.count_if(f"__null_{c}") - F.count_if(F.col(c).isNull())).alias(f"filled_{c}") for c in columns))

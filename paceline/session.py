"""Keys of a session and windows within it.

Every job handles all sessions at once, so group keys start with the session's keys.  Rows
with a null group key belong to no group: they never share a window's value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESSION = ["Season", "RoundNumber", "SessionType"]
Keys = list[str]


def keys_present(keys: Keys) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys), F.lit(True))


def over_keys(value: Column, keys: Keys, order: Keys | None = None, rows: tuple[int, int] | None = None) -> Column:
    """``value`` over the rows that share ``keys``; null where a key is null."""
    w = Window.partitionBy(*keys)
    if order:
        w = w.orderBy(*order)
    if rows:
        w = w.rowsBetween(*rows)
    return F.when(keys_present(keys), value.over(w))


def session_keys(df: DataFrame) -> Keys:
    """The session keys that ``df`` has, so that operators also work on one session without them."""
    return [k for k in SESSION if k in df.columns]


def grouped(df: DataFrame, groups: Keys) -> Keys:
    own = session_keys(df)
    return own + [g for g in groups if g not in own]


def require(df: DataFrame, columns: Keys) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"missing columns: {', '.join(missing)}")

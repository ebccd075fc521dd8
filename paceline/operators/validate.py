"""Declared schemas: coercion, and checks that list every violation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.session import require, session_keys


@dataclass(frozen=True)
class Rule:
    column: str
    kind: str
    required: bool = False
    low: float | None = None
    high: float | None = None
    length: tuple[int, int] | None = None


# Types and bounds of the declared columns.
LAPS = [
    Rule("Driver", "string", True, length=(2, 3)), Rule("LapNumber", "int", True, 1, 100), Rule("Stint", "int", low=1),
    Rule("LapTime_s", "double"), Rule("TyreLife", "double"), Rule("SpeedI1", "double", low=0, high=450), Rule("SpeedI2", "double", low=0, high=450),
    Rule("SpeedFL", "double", low=0, high=450), Rule("SpeedST", "double", low=0, high=450), Rule("Compound", "string"), Rule("TrackStatus", "string"),
]
RESULTS = [
    Rule("Abbreviation", "string", True, length=(2, 3)), Rule("GridPosition", "double", low=0, high=25), Rule("Position", "double", low=1, high=25), Rule("Points", "double", low=0, high=30),
]


def coerce(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Declared columns cast to their types (null where that fails); further columns stay; a missing one is an error."""
    require(df, [r.column for r in rules])
    kinds = {r.column: r.kind for r in rules}
    return df.select(*(F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns))


def _checks(rule: Rule) -> list[tuple[str, Column]]:
    c, out = F.col(rule.column), []
    value = c.try_cast(rule.kind)
    if rule.kind != "string":
        out.append(("type", c.isNotNull() & value.isNull()))
    if rule.required:
        out.append(("required", c.isNull()))
    if rule.low is not None or rule.high is not None:
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (value < rule.low)
        if rule.high is not None:
            bad = bad | (value > rule.high)
        out.append(("range", F.coalesce(bad, F.lit(False))))
    if rule.length:
        out.append(("length", F.coalesce(~F.length(c).between(*rule.length), F.lit(False))))
    return out


def violations(df: DataFrame, rules: list[Rule], keys: list[str] | None = None) -> DataFrame:
    """``(keys, column, rule, value)`` for every failed check of every row, in one pass."""
    require(df, [r.column for r in rules])
    keys = session_keys(df) if keys is None else keys
    checks = [F.when(bad, F.struct(F.lit(r.column).alias("column"), F.lit(name).alias("rule"), F.col(r.column).cast("string").alias("value"))) for r in rules for name, bad in _checks(r)]
    found = df.select(*keys, F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("v"))
    return found.select(*keys, "v.column", "v.rule", "v.value")


def validated(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``df`` coerced; an error that names failed checks if there are any."""
    bad = violations(df, rules, []).groupBy("column", "rule").count().orderBy("column", "rule").collect()  # a row for each rule at most
    if bad:
        raise ValueError("; ".join(f"{r['column']} {r['rule']}: {r['count']} rows" for r in bad))
    return coerce(df, rules)

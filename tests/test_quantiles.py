"""Exact quantiles of groups against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.operators import quantiles
from paceline.operators.quantiles import group_quantiles, joined_by

SHARES = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]


def plain(rows, shares):
    out = {}
    for g in {r[:2] for r in rows}:
        cells = []
        for k in (2, 3):
            v = [r[k] for r in rows if r[:2] == g and r[k] is not None and not math.isnan(r[k])]
            cells.append([float(x) for x in np.quantile(v, shares)] if v else None)
        out[g] = cells
    return out


def check(df, rows, shares=SHARES, **limits):
    got = {(r["g"], r["h"]): [r["v__q"], r["w__q"]] for r in group_quantiles(df, ["g", "h"], ["v", "w"], shares, **limits).collect()}
    want = plain(rows, shares)
    assert got.keys() == want.keys()
    for g, cells in want.items():
        for a, b in zip(got[g], cells):
            if b is None:
                assert a is None or all(x is None for x in a)
            else:
                assert a == pytest.approx(b, rel=1e-12, abs=1e-12)


def made(seed, n):
    rng = random.Random(seed)
    kinds = [lambda: rng.gauss(80, 3), lambda: float(rng.randint(0, 3)), lambda: rng.choice([0.0, 1.0, rng.random()]), lambda: 10 ** rng.uniform(-300, 300), lambda: rng.choice([None, float("nan"), -1.5, float("inf")])]
    rows = []
    for _ in range(n):
        g = min(int(rng.expovariate(0.8)), 6)
        rows.append((g if g < 6 else None, "x" if g % 2 else None, kinds[g % 5](), kinds[(g + 1) % 4]()))
    return rows + [(9, "alone", 3.5, None), (9, "none", None, None)]


SCHEMA = "g int, h string, v double, w double"


def test_small_groups(spark):
    rows = [r for r in made(1, 900) if r[2] != float("inf")]
    check(spark.createDataFrame(rows, SCHEMA), rows)


@pytest.mark.parametrize("seed,kept", [(2, 3), (3, 200)])
def test_large_groups_in_passes(spark, seed, kept):
    rows = [r for r in made(seed, 1500) if r[2] != float("inf")]
    check(spark.createDataFrame(rows, SCHEMA).repartition(4), rows, most=10, kept=kept)


def test_sorted_and_repeated_values(spark):
    rows = [(1, "a", float(k), float(k // 1500)) for k in range(6000)] + [(2, "a", 7.0, -0.0 if k % 2 else 0.0) for k in range(500)]
    check(spark.createDataFrame(rows, SCHEMA), rows, [0.0, 0.5, 0.95], most=10, kept=64)


def test_whole_column_and_no_rows(spark):
    df = spark.range(10_001).select(F.lit(1).alias("g"), (F.col("id") * 2).alias("v"))
    assert group_quantiles(df, [], ["v"], [0.5, 0.25], most=5, kept=10).first()[0] == [10000.0, 5000.0]
    assert group_quantiles(df.limit(0), ["g"], ["v"], [0.5]).count() == 0
    assert group_quantiles(df.limit(0), [], ["v"], [0.5]).count() <= 1


def test_one_group_of_five_million_rows(spark):
    # Without passes one buffer would have to hold all values; here no buffer holds more than ``kept`` and the sketches.
    df = spark.range(5_000_000).select(F.lit("VER").alias("g"), (F.pmod(F.col("id") * 2654435761, F.lit(5_000_011)) / 1000).alias("v"))
    q = group_quantiles(df, ["g"], ["v"], [0.05, 0.5, 0.95])
    got = q.first()["v__q"]
    values = np.sort((np.arange(5_000_000, dtype=np.int64) * 2654435761 % 5_000_011) / 1000)
    assert got == pytest.approx(np.quantile(values, [0.05, 0.5, 0.95]).tolist(), rel=1e-12)
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan


def test_null_keys_meet(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2), ("y", 3)], "k string, n int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, m int")
    assert sorted(map(tuple, joined_by(a, b, ["k"]).collect()), key=str) == sorted([(None, 1, 10), ("x", 2, 20), ("y", 3, None)], key=str)


@pytest.mark.parametrize("most", [1 << 22, 10])
def test_the_table_is_made_once(spark, most):
    """However many passes there are, only the first reads the table and what it is made from."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(3000).selectExpr("id % 2 as g", "cast(id as double) as v").mapInArrow(counted, "g long, v double")
    got = {r["g"]: r["v__q"] for r in group_quantiles(df, ["g"], ["v"], [0.0, 0.5], most=most, kept=20).collect()}
    assert got == {0: [0.0, 1499.0], 1: [1.0, 1500.0]} and seen.value == 3000


def test_passes_do_not_grow_with_the_group(spark, monkeypatch):
    """Rows, sketches, brackets, counts, result: each written once, however few values a group may keep."""
    calls, own = [], quantiles.written
    monkeypatch.setattr(quantiles, "written", lambda df, purpose: calls.append(purpose) or own(df, purpose))
    df = spark.range(200_000).select(F.lit(1).alias("g"), F.pmod(F.col("id") * 7919, F.lit(200_003)).cast("double").alias("v"))
    got = group_quantiles(df, ["g"], ["v"], [0.05, 0.5], most=10, kept=20).first()["v__q"]
    values = np.arange(200_000) * 7919 % 200_003
    assert got == pytest.approx(np.quantile(values, [0.05, 0.5]).tolist(), rel=1e-12) and len(calls) == 5


def test_brackets_that_miss_are_drawn_again(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "ERRORS", (0.0, 0.0, 1.0))
    monkeypatch.setattr(quantiles, "WIDTH", 8)
    rows = [r for r in made(4, 1500) if r[2] != float("inf")]
    check(spark.createDataFrame(rows, SCHEMA).repartition(4), rows, most=10, kept=3)

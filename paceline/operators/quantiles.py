"""Exact quantiles of groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.sources.scratch import written

MOST = 1 << 22  # values that the buffers of one aggregate may hold in a task
KEPT = 1 << 14  # values of a group up to which all are kept, without a sketch's help
WIDTH = 4096  # of the sketches, whose ranks are off by 0.13 % or less in 99 of 100 cases
ERRORS = (0.004, 0.03, 1.0)  # by which ranks in a sketch may be off: with room, for what that missed, and all there can be


def group_quantiles(df: DataFrame, groups: list[str], values: list[str], shares: list[float], most: int = MOST, kept: int = KEPT, stored: bool = False) -> DataFrame:
    """A row for each group: its columns and for each of ``values`` an array ``<value>__q`` of exact quantiles, by linear interpolation.

    Null and NaN values do not count; without any the quantiles are null.  Null keys are a group like any other.  Keys and values are written once,
    unless ``df`` is ``stored`` already.  Groups are counted first: where the
    buffers of the aggregate ``percentile`` surely stay below ``most`` values, it is taken.  Else no task holds a group: KLL sketches tell between
    which two values each share lies, and one more pass counts each value between them, and all others by the gap that they lie in.  Sums of these counts
    are exact ranks.  A bracket holds about a 125th of the group; one that a sketch placed wrongly shows, as the rank falls into a gap,
    and is drawn again with more room.
    """
    own = [F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double")).alias(f"__v{i}") for i, v in enumerate(values)]
    # Keys become one struct, in which nulls equal each other.  The passes read what is written, not ``df`` and all that it is made from.
    rows = df.select(F.struct(*(F.col(g) for g in groups)).alias("__g") if groups else F.lit(0).alias("__g"), *own)
    rows = rows if stored else written(rows, "quantile-rows")
    size = rows.groupBy("__g").count().agg(F.max("count").alias("n"), F.count("*").alias("groups")).first()
    if not groups and not size["groups"]:
        return rows.agg(*(F.percentile(f"__v{i}", F.array(*map(F.lit, shares))).alias(f"{v}__q") for i, v in enumerate(values)))
    if (size["n"] or 0) * len(values) * min(size["groups"], 128) <= most:
        # Here the keys are columns under their own names again.
        flat = rows.select(*(F.col("__g").getField(g).alias(g) for g in groups), *(f"__v{i}" for i in range(len(values))))
        return flat.groupBy(*groups).agg(*(F.percentile(f"__v{i}", F.array(*map(F.lit, shares))).alias(f"{v}__q") for i, v in enumerate(values)))
    few = size["groups"] * len(values) * len(shares) <= 1 << 18
    found = _refined(rows, len(values), shares, kept, few).select("__g", *(F.col(f"q{i}").alias(f"{v}__q") for i, v in enumerate(values)))
    return found.select(*(F.col("__g").getField(g).alias(g) for g in groups), *(f"{v}__q" for v in values))


def _refined(rows: DataFrame, n_values: int, shares: list[float], kept: int, few: bool) -> DataFrame:
    """``__g`` and an array ``q<i>`` for each value; ``few`` groups have their brackets broadcast."""
    sketches = written(rows.groupBy("__g").agg(*(x for i in range(n_values) for x in (F.count(f"__v{i}").alias(f"n{i}"), F.kll_sketch_agg_double(f"__v{i}", WIDTH).alias(f"s{i}")))), "sketches")
    left, found = sketches, None
    for error in ERRORS:
        told = written(_looked_up(rows, left, n_values, shares, kept, error, few), "quantiles")
        sure = told.where(~F.col("missed")).drop("missed")
        found = sure if found is None else found.unionByName(sure)
        missed = told.where("missed").select("__g")
        if missed.isEmpty():
            break
        left = sketches.join(missed, "__g", "left_semi")
    return found


def _looked_up(rows: DataFrame, sketches: DataFrame, n_values: int, shares: list[float], kept: int, error: float, few: bool) -> DataFrame:
    """A row for each group of ``sketches``: its quantiles, and whether one was ``missed`` by brackets of ``error`` about the shares."""
    n_shares = range(len(shares))

    def end(i: int, rank: float, outside: float):
        if not 0 <= rank <= 1:
            return F.lit(outside)
        return F.when(F.col(f"n{i}") <= kept, F.lit(outside)).otherwise(F.kll_sketch_get_quantile_double(f"s{i}", F.lit(rank)))

    ends = [F.when(F.col(f"n{i}") > 0, F.array(*(end(i, s + e, far) for s in sorted(shares)))).alias(f"{name}{i}") for i in range(n_values) for name, e, far in (("low", -error, float("-inf")), ("high", error, float("inf")))]
    brackets = written(sketches.select("__g", *ends), "brackets")

    def cells(i: int) -> DataFrame:
        # ``gap``: how many brackets lie below the value.  It is in one if it is in the next; values in none come before all in one of the same gap.
        own, v = brackets.select("__g", F.col(f"low{i}").alias("low"), F.col(f"high{i}").alias("high")), F.col("v")
        near = rows.select("__g", F.col(f"__v{i}").alias("v")).where("v is not null").join(F.broadcast(own) if few else own, "__g")
        near = near.withColumn("gap", reduce(lambda a, b: a + b, ((F.col("high")[k] < v).cast("int") for k in n_shares)))
        return near.select("__g", F.lit(i).alias("i"), "gap", F.when(v >= F.get("low", "gap"), v).alias("v"))

    # A branch for each value reads that column alone; one branch for all makes code that the JVM does not compile.
    every = reduce(DataFrame.unionByName, map(cells, range(n_values)))
    counts = written(every.groupBy("__g", "i", "gap", "v").agg(F.count("*").alias("n")), "quantile-counts")
    gaps = Window.partitionBy("__g", "i")
    before = F.coalesce(F.sum("n").over(gaps.orderBy("gap").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.groupBy("__g", "i", "gap").agg(F.sum("n").alias("n")).select("__g", "i", "gap", before.alias("before"), F.sum("n").over(gaps).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("__g", "i", "gap").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select("*", upto.alias("upto")).join(starts, ["__g", "i", "gap"]).where("v is not null")
    spot = lambda s: F.lit(s) * (F.col("total") - 1)
    after = F.col("before") + F.col("upto")
    at = lambda rank: F.max(F.when((after - F.col("n") <= rank) & (rank < after), F.col("v")))
    hits = placed.groupBy("__g", "i").agg(F.max("total").alias("total"), *(at(f(spot(s))).alias(f"{name}{k}") for k, s in enumerate(shares) for name, f in (("a", F.floor), ("b", F.ceil))))
    a, b = (lambda k: F.col(f"a{k}")), (lambda k: F.col(f"b{k}"))
    between = [a(k) + F.when(b(k) > a(k), (b(k) - a(k)) * (spot(s) - F.floor(spot(s)))).otherwise(0.0) for k, s in enumerate(shares)]
    whole = reduce(lambda x, y: x & y, (a(k).isNotNull() & b(k).isNotNull() for k in n_shares))
    wide = hits.where(whole).groupBy("__g").agg(*(F.max(F.when(F.col("i") == i, F.array(*between))).alias(f"q{i}") for i in range(n_values)))
    missed = reduce(lambda x, y: x | y, ((F.col(f"n{i}") > 0) & F.col(f"q{i}").isNull() for i in range(n_values)))
    return sketches.join(wide, "__g", "left").select("__g", *(f"q{i}" for i in range(n_values)), missed.alias("missed"))


def joined_by(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which null keys equal each other; the keys of ``left`` stay."""
    other = right.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in right.columns if c not in keys))
    same = reduce(lambda a, b: a & b, (left[k].eqNullSafe(other[f"__{k}"]) for k in keys))
    return left.join(other, same, "left").drop(*(f"__{k}" for k in keys))

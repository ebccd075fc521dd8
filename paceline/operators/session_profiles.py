"""Profiles kept by session: sketches that merge, so a table that grows is profiled by its new sessions alone.

A profile has a row for each session and column, and one with a null ``column`` for whole rows: counts, extremes, mean and squared
deviations (exact when merged), a theta sketch of the different values and, for numbers, a KLL sketch of quantiles.  It is a session
table of its own with a commit log; each row names the write that it was made from, so sessions that were replaced are profiled anew.
A session's sketches take at most about 64 kB a column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.operators.quantiles import joined_by
from paceline.session import SESSION, require
from paceline.sources import commits
from paceline.sources.scratch import written

LG = 12  # log2 of the different values that a theta sketch holds before it estimates (standard error 1 / sqrt(2 ** LG), 1.6 %)
KLL = 200  # rank error of quantiles at most 1.7 % in 99 of 100 cases
SOURCE = "source"


def _quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _key(name: str, kind: T.DataType) -> Column:
    """64 bits for a value, the same for equal numbers of any width; null for null."""
    c = _quoted(name)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        key = F.xxhash64(F.to_json(c))
    elif isinstance(kind, T.IntegralType):
        key = F.xxhash64(c.cast("long"))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        wide = c.cast("double")
        whole = wide.try_cast("long")
        key = F.when(whole.cast("double") == wide, F.xxhash64(whole)).otherwise(F.xxhash64(wide))
    elif isinstance(kind, T.BinaryType):
        key = F.xxhash64(c)
    else:
        key = F.xxhash64(c.cast("string"))
    return F.when(c.isNotNull(), key)


def profile_sessions(df: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    """One row for each session and column that is no key, and one for the session's whole rows, in one aggregate.

    Null keys are values like others.  NaN is a value, but left out of extremes, mean and quantiles.  Equal rows are those
    whose columns are equal or null in both, so a column that other sessions lack changes nothing where it is null.
    """
    require(df, keys)
    fields = [f for f in df.schema.fields if f.name not in keys]
    numeric = [isinstance(f.dataType, T.NumericType) for f in fields]
    own = []
    for i, f in enumerate(fields):
        own.append(_key(f.name, f.dataType).alias(f"k{i}"))
        if numeric[i]:
            x = _quoted(f.name).cast("double")
            own.append(F.when(~F.isnan(x), x).alias(f"x{i}"))
    # Each value's hash is mixed with its column's name; absent and null values add nothing.
    row = reduce(lambda a, b: a.bitwiseXOR(b), (F.when(F.col(f"k{i}").isNotNull(), F.xxhash64(F.lit(f.name), F.col(f"k{i}"))).otherwise(0) for i, f in enumerate(fields)), F.lit(0).cast("long"))
    rows = df.select(*(_quoted(k).alias(k) for k in keys), *own).withColumn("__row", row)
    wide = rows.groupBy(*(_quoted(k) for k in keys)).agg(
        F.count("*").alias("rows"), F.theta_sketch_agg("__row", LG).alias("t"),
        *(a for i in range(len(fields)) for a in (F.count(f"k{i}").alias(f"c{i}"), F.theta_sketch_agg(f"k{i}", LG).alias(f"t{i}"))),
        *(a for i in range(len(fields)) if numeric[i] for a in (
            F.count(f"x{i}").alias(f"n{i}"), F.min(f"x{i}").alias(f"min{i}"), F.max(f"x{i}").alias(f"max{i}"), F.avg(f"x{i}").alias(f"avg{i}"),
            (F.var_pop(f"x{i}") * F.count(f"x{i}")).alias(f"m2{i}"), F.kll_sketch_agg_double(f"x{i}", KLL).alias(f"q{i}"))),
    )
    none = {"dtype": "string", "n": "long", "least": "double", "greatest": "double", "mean": "double", "m2": "double", "quantiles": "binary"}

    def line(name: str | None, values: dict[str, Column]) -> Column:
        told = {"column": F.lit(name).cast("string"), **{k: F.lit(None).cast(t) for k, t in none.items()}, **values}
        return F.struct(*(told[k].alias(k) for k in ("column", "dtype", "rows", "present", "distinct", *list(none)[1:])))

    lines = [line(None, {"rows": F.col("rows"), "present": F.col("rows"), "distinct": F.col("t")})]
    for i, f in enumerate(fields):
        values = {"dtype": F.lit(f.dataType.simpleString()), "rows": F.col("rows"), "present": F.col(f"c{i}"), "distinct": F.col(f"t{i}")}
        if numeric[i]:
            values |= {"n": F.col(f"n{i}"), "least": F.col(f"min{i}"), "greatest": F.col(f"max{i}"), "mean": F.col(f"avg{i}"), "m2": F.col(f"m2{i}"), "quantiles": F.col(f"q{i}")}
        lines.append(line(f.name, values))
    return wide.select(*(_quoted(k) for k in keys), F.inline(F.array(*lines)))


def refresh(spark: SparkSession, base: str, kind: str, columns: list[str] | None = None) -> int:
    """Bring the profile table ``<kind>_profile`` up to the last commit of ``kind``; returns how many sessions were read for it.

    Only folders of sessions that have no profile, or whose profile names another write, are scanned.  The driver holds one entry for each session,
    as the log does.  Two refreshes at once leave whole profiles; where the older one ends last, the next refresh mends it.
    ``columns`` (all by default) should stay the same from one call to the next: sessions keep the columns they were profiled with.
    """
    log = commits.read_log(spark, base, kind)
    if not log.sessions:
        raise FileNotFoundError(f"{base}/{kind}: no sessions")
    have: dict[tuple, str] = {}
    if commits.read_log(spark, base, f"{kind}_profile").sessions:
        rows = profiles(spark, base, kind).where("column is null").select(*(F.col(k).cast("string") for k in SESSION), SOURCE)
        have = {tuple(r)[:-1]: r[SOURCE] for r in rows.collect()}
    stale = [s for s, (write, _) in log.sessions.items() if have.get(tuple(commits.session_keys_of(s))) != write]
    if not stale:
        return 0
    df = commits.scan(spark, base, kind, log, stale)
    if columns is not None:
        df = df.select(*SESSION, commits.WRITE, *(_quoted(c) for c in columns if c not in SESSION))
    made = written(profile_sessions(df, [*SESSION, commits.WRITE]).withColumnRenamed(commits.WRITE, SOURCE), "profiles")
    return commits.write_sessions(made, base, f"{kind}_profile", overwrite=True)


def profiles(spark: SparkSession, base: str, kind: str) -> DataFrame:
    """The profile table of ``kind``."""
    return commits.read_sessions(spark, base, f"{kind}_profile")


def _whole(kept: DataFrame, by: list[str]) -> DataFrame:
    return kept.where("column is null").groupBy(*by).agg(F.sum("rows").alias("rows"), F.count("*").alias("sessions"), F.theta_union_agg("distinct", LG).alias("distinct"))


def merged_columns(kept: DataFrame, by: list[str] | None = None, shares: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """One row for each column (and each group of ``by``, some of the session keys): counts and moments exact, different values and quantiles from sketches.

    ``unique_exact`` tells that ``n_unique`` is no estimate.  A session without the column counts as nulls.  ``quantiles`` are at
    ``shares``; a column that is not numeric, or has no values, has none.  Extremes, moments and quantiles leave NaN out.
    """
    by = by or []
    own = kept.where("column is not null")
    sums = own.groupBy(*by, "column").agg(
        F.array_join(F.array_sort(F.collect_set("dtype")), "|").alias("dtype"), F.sum("present").alias("present"), F.theta_union_agg("distinct", LG).alias("distinct"), F.sum("n").alias("n"),
        F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum(F.col("n") * F.col("mean")).alias("total"), F.sum("m2").alias("m2"), F.kll_merge_agg_double("quantiles", KLL).alias("sketch"),
    ).withColumn("mean", F.col("total") / F.when(F.col("n") > 0, F.col("n")))

    def same(keys: list[str]) -> Column:
        return reduce(lambda a, b: a & b, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys), F.lit(True))

    # Squares about the merged mean, from the narrow columns alone: sums of squares less the square of the sum would lose digits.
    keys = [*by, "column"]
    about = own.select(*keys, "n", F.col("mean").alias("own")).alias("a").join(sums.select(*keys, "mean").alias("b"), same(keys))
    between = about.groupBy(*(F.col(f"a.{k}").alias(k) for k in keys)).agg(F.sum(F.col("n") * (F.col("own") - F.col("mean")) ** 2).alias("between"))
    told = sums.alias("a").join(between.alias("b"), same(keys)).select("a.*", "b.between")
    whole = _whole(kept, by).drop("distinct", "sessions")
    told = told.alias("a").join((whole if by else F.broadcast(whole)).alias("b"), same(by)).select("a.*", "b.rows")
    estimate = F.theta_sketch_estimate("distinct")
    return told.select(
        *by, "column", "dtype", "rows", (F.col("rows") - F.col("present")).alias("nulls"), F.round(100 * (F.col("rows") - F.col("present")) / F.col("rows"), 4).alias("null_pct"),
        estimate.alias("n_unique"), (estimate < 2**LG).alias("unique_exact"), "least", "greatest", "mean", F.sqrt((F.col("m2") + F.col("between")) / F.when(F.col("n") > 1, F.col("n") - 1)).alias("std"),
        F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, shares)))).alias("quantiles"),
    )


def merged_rows(kept: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, sessions, different rows and duplicates (rows after the first of their kind; keys of the session are no part of a row) of all sessions or each group of ``by``."""
    estimate = F.theta_sketch_estimate("distinct")
    return _whole(kept, by or []).select(*(by or []), "sessions", "rows", estimate.alias("n_unique"), (estimate < 2**LG).alias("unique_exact"), F.greatest(F.col("rows") - estimate, F.lit(0)).alias("duplicates"))


def exact_rows(spark: SparkSession, base: str, kind: str, by: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """``merged_rows`` with exact numbers for groups of any size; ``unique_exact`` is left out.

    Groups whose sketch holds all their different rows are answered from it.  Only the others' ``columns`` (all by default; as in ``refresh``, which
    comes first) are read again, one aggregate by row and one by group.
    """
    by = by or []
    told = written(merged_rows(profiles(spark, base, kind), by), "profile-rows")
    sure, open_ = told.where("unique_exact").drop("unique_exact"), told.where("not unique_exact")
    if open_.isEmpty():
        return sure
    rows = commits.read_sessions(spark, base, kind)
    fields = [f for f in rows.schema.fields if f.name not in SESSION and (columns is None or f.name in columns)]
    # Maps can't be grouped by.
    value = lambda f: F.to_json(_quoted(f.name)) if isinstance(f.dataType, T.MapType) else _quoted(f.name)
    rows = rows.select(*by, *(value(f).alias(f"__c{i}") for i, f in enumerate(fields)))
    if by:
        wanted = joined_by(rows, open_.select(*by, F.lit(True).alias("__open")), by)
        rows = wanted.where("__open").drop("__open")
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n")).groupBy(*by).agg(F.sum("__n").alias("rows"), F.count("*").alias("n_unique"))
    sessions = open_.select(*by, "sessions")
    counted = joined_by(counted, sessions, by) if by else counted.crossJoin(F.broadcast(sessions))
    return sure.unionByName(counted.withColumn("duplicates", F.col("rows") - F.col("n_unique")))

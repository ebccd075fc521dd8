"""Profiles: columns, distributions, correlations, samples."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.operators.quantiles import group_quantiles
from paceline.sources.scratch import written


def _long(df: DataFrame, columns: dict[str, list]) -> DataFrame:
    """One wide row of aggregates as one row per column."""
    rows = [F.struct(F.lit(name).alias("column"), *(a if not isinstance(a, tuple) else a for a in values)) for name, values in columns.items()]
    return df.select(F.inline(F.array(*rows)))


def profile_columns(df: DataFrame, approx: bool = False) -> DataFrame:
    """Type, nulls, share of nulls and different values of each column, in one aggregate; an error if there are no rows."""
    if df.isEmpty():
        raise ValueError("no rows to profile")
    distinct = F.approx_count_distinct if approx else F.count_distinct
    wide = df.agg(F.count("*").alias("n"), *(F.count(c).alias(f"c_{c}") for c in df.columns), *(distinct(F.col(c)).alias(f"d_{c}") for c in df.columns))
    return _long(wide, {
        c: [F.lit(t).alias("dtype"), (F.col("n") - F.col(f"c_{c}")).alias("nulls"), F.round(100 * (F.col("n") - F.col(f"c_{c}")) / F.col("n"), 4).alias("null_pct"), F.col(f"d_{c}").alias("n_unique")]
        for c, t in df.dtypes
    })


def missing_share(df: DataFrame) -> DataFrame:
    """Columns with nulls, by their share."""
    return profile_columns(df, approx=True).where("nulls > 0").select("column", "null_pct").orderBy(F.desc("null_pct"), "column")


def describe_numeric(df: DataFrame) -> DataFrame:
    """Count, mean, deviation, least, five exact quantiles and greatest of each numeric column; a column of nulls has count 0."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    shares = [0.05, 0.25, 0.5, 0.75, 0.95]
    df = written(df.select(*names), "numbers")  # the sums and the passes of the quantiles read these
    wide = df.agg(*(x for c in names for x in (
        F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"avg_{c}"), F.stddev_samp(c).alias(f"std_{c}"), F.min(F.col(c).cast("double")).alias(f"min_{c}"), F.max(F.col(c).cast("double")).alias(f"max_{c}"),
    )))
    told = _long(wide, {
        c: [F.col(f"n_{c}").alias("count"), F.col(f"avg_{c}").alias("mean"), F.col(f"std_{c}").alias("std"), F.col(f"min_{c}").alias("min"), F.col(f"max_{c}").alias("max")]
        for c in names
    })
    found = group_quantiles(df, [], names, shares, stored=True).select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}__q").alias("q")) for c in names))))
    told = told.join(F.broadcast(found), "column", "left")
    return told.select("column", "count", "mean", "std", "min", *(F.col("q")[i].alias(f"p{round(100 * s):02d}") for i, s in enumerate(shares)), "max")


def _summaries(batches: Iterator[pa.RecordBatch], names: list[str], room: int) -> Iterator[pa.RecordBatch]:
    """Misra-Gries summaries of a task: values with lower bounds of their counts, and by null the count that a value may lack."""
    held: list[Counter] = [Counter() for _ in names]
    lack = [0] * len(names)
    for batch in batches:
        for k in range(len(names)):
            own = pc.value_counts(batch.column(k)).to_pylist()
            held[k].update({x["values"]: x["counts"] for x in own if x["values"] is not None})
            if len(held[k]) > room:
                cut = sorted(held[k].values(), reverse=True)[room]
                lack[k] += cut
                held[k] = Counter({v: n - cut for v, n in held[k].items() if n > cut})
    rows = [(names[k], v, n) for k in range(len(names)) for v, n in [*held[k].items(), (None, lack[k])]]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["column", "value", "n"])


def top_values(df: DataFrame, k: int = 5, room: int = 1024, certified: bool = False) -> DataFrame:
    """The ``k`` most frequent values of each string column (ties: the smallest), exact.

    All columns are counted in one pass.  ``certified=True`` is for columns of very many different values: each task keeps ``room`` candidates
    a column, which alone are shuffled and counted anew; that no other value can be among the first is checked against
    what the candidates' counts may lack, and columns where that does not hold are counted whole.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    exact = lambda cols: _each_value(df, cols).groupBy("column", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    first = lambda counts: counts.withColumn("rank", rank).where(F.col("rank") <= k)
    if not certified or not names:
        return first(exact(names))
    rows = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    bounds = written(rows.mapInArrow(lambda batches: _summaries(batches, names, room), "column string, value string, n long").groupBy("column", "value").agg(F.sum("n").alias("n")), "top-values")
    lack = {r["column"]: r["n"] for r in bounds.where("value is null").collect()}  # a row for each column
    known = bounds.where("value is not null")
    least = known.withColumn("rank", rank).where(F.col("rank") == k).select("column", F.col("n").alias("kth"))
    lacking = F.coalesce(*(F.when(F.col("column") == c, F.lit(n)) for c, n in lack.items()), F.lit(0)) if lack else F.lit(0)
    asked = known.join(F.broadcast(least), "column", "left").where(F.col("n") + lacking >= F.coalesce("kth", F.lit(0))).select("column", "value")
    counted = written(_each_value(df, names).join(asked, ["column", "value"], "left_semi").groupBy("column", "value").agg(F.count("*").alias("n")), "top-values")
    kth = {r["column"]: r["n"] for r in first(counted).where(F.col("rank") == k).collect()}
    # A value that no task kept has at most what is lacking; it may tie with, or beat, the k-th.
    open_ = [c for c in names if lack.get(c, 0) and kth.get(c, 0) <= lack[c]]
    sure = first(counted.where(~F.col("column").isin(open_)) if open_ else counted)
    return sure.unionByName(first(exact(open_))) if open_ else sure


def _each_value(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in names))).alias("x")).select("x.*").where("value is not null")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows after the first of their kind: one row ``(rows, duplicates)``."""
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def _bins(df: DataFrame, x: str, n: int) -> DataFrame:
    """``bin`` of n right-closed bins of equal width from the least to the greatest value; the least is in bin 0."""
    ends = df.agg(F.min(x).cast("double").alias("__low"), F.max(x).cast("double").alias("__high"))
    at = F.ceil((F.col(x) - F.col("__low")) / ((F.col("__high") - F.col("__low")) / n)) - 1
    return df.where(F.col(x).isNotNull()).join(F.broadcast(ends)).withColumn("bin", F.when(F.col("__high") > F.col("__low"), F.least(F.greatest(at, F.lit(0)), F.lit(n - 1))).otherwise(0).cast("int"))


def binned_mean(df: DataFrame, x: str, y: str, n: int = 10) -> DataFrame:
    return _bins(df, x, n).groupBy("bin").agg(F.avg(y).alias("mean_y"), F.count("*").alias("rows"))


def histogram(df: DataFrame, x: str, n: int = 60) -> DataFrame:
    return _bins(df, x, n).groupBy("bin").agg(F.count("*").alias("rows"))


def correlations(df: DataFrame, columns: list[str], most: int = 24) -> DataFrame:
    """Pearson correlation of each pair of columns over complete rows; null where a column is constant.

    Up to ``most`` columns the pairs are one aggregate.  More take one pass that adds up each task's matrix of products (Spark ML), which grows
    with the square of the columns but not with the rows; values are centred first, so that large means cost no digits.
    """
    pairs = list(combinations(columns, 2))
    rows = df.dropna(subset=columns)
    if len(columns) <= most:
        # Not F.corr, which is an error for a constant column.
        wide = rows.agg(*(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
        told = wide.select(F.inline(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))))
    else:
        means = rows.agg(F.count("*").alias("__n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns))).first()
        found = None
        if means["__n"] > 1:
            centred = rows.select(*((F.col(c).cast("double") - F.lit(means[f"m{i}"])).alias(f"c{i}") for i, c in enumerate(columns)))
            vectors = VectorAssembler(inputCols=centred.columns, outputCol="v").transform(centred).select("v")
            found = Correlation.corr(vectors, "v").first()[0].toArray()
        place = {c: i for i, c in enumerate(columns)}
        told = df.sparkSession.createDataFrame([(a, b, float(found[place[a], place[b]]) if found is not None else None) for a, b in pairs], "x string, y string, r double")
    return told.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def group_boxes(df: DataFrame, group: str, target: str, k: int = 5) -> DataFrame:
    """Five numbers of ``target`` in each of the ``k`` largest groups."""
    rows = df.where(F.col(group).isNotNull())
    top = rows.groupBy(group).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), group).limit(k)
    stats = group_quantiles(rows.join(F.broadcast(top.select(group)), group, "left_semi"), [group], [target], [0.0, 0.25, 0.5, 0.75, 1.0])
    return top.join(stats, group).select(F.col(group).alias("group"), "rows", *(F.col(f"{target}__q")[i].alias(c) for i, c in enumerate(["min", "q1", "median", "q3", "max"])))


def seeded_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, the same for the same seed however the rows are spread."""
    return df.orderBy(F.md5(F.concat_ws(":", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), F.lit(str(seed)))), *keys).limit(n)

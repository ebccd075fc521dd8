"""Lap-time models on Spark ML."""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from paceline.functions.scalar import ordered_bounds
from paceline.operators.quantiles import group_quantiles
from paceline.sources.scratch import written

TARGET = "LapTime_s"


def dense(df: DataFrame, names: list[str], indicators: bool = False) -> tuple[DataFrame, list[str]]:
    """Features as doubles with 0 for null, and if asked a 0/1 column that tells so (trees here do not route nulls)."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names} | ({f"{c}__null": F.col(c).isNull().cast("double") for c in names} if indicators else {}))
    return filled, names + [f"{c}__null" for c in names] * indicators


def linear(names: list[str], ridge: float = 0.0, weight: str | None = None, target: str = TARGET) -> Pipeline:
    """Standardised least squares."""
    model = LinearRegression(featuresCol="scaled", labelCol=target, regParam=ridge, predictionCol="prediction", solver="normal" if len(names) < 4000 else "l-bfgs")
    if weight:
        model = model.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), StandardScaler(inputCol="features", outputCol="scaled", withMean=True), model])


HELD_OUT = "__held_out"


def boosted(names: list[str], rounds: int = 500, depth: int = 6, step: float = 0.05, sample: float = 0.8, weight: str | None = None, target: str = TARGET, seed: int = 42, tol: float = 0.001, bins: int = 256, leaf: int = 20, stops: bool = False) -> Pipeline:
    """Gradient-boosted trees of ``rounds``; with ``stops`` fewer, until a round lowers the error on rows flagged by ``HELD_OUT`` by less than ``tol`` of it.

    Lineage is cut every ten rounds where the session has a checkpoint folder, so late rounds cost as much as early ones.  Trees are so flat that
    a row's node is found anew sooner than it is kept: node ids are a cached table more for each level.  ``fit_boosted`` flags the rows.
    """
    model = GBTRegressor(featuresCol="features", labelCol=target, maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=sample, seed=seed, maxBins=bins, minInstancesPerNode=leaf, checkpointInterval=10, validationTol=tol)
    if stops:
        model = model.setValidationIndicatorCol(HELD_OUT)
    if weight:
        model = model.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), model])


def held_out(df: DataFrame, names: list[str], parts: int = 10, target: str = TARGET) -> DataFrame:
    """``HELD_OUT``: about one row in ``parts``, by a hash of its features and target, so that it is the same rows however they are spread."""
    return df.withColumn(HELD_OUT, F.pmod(F.xxhash64(*names, target), F.lit(parts)) == 0)


def fit_boosted(df: DataFrame, names: list[str], target: str = TARGET, **options) -> PipelineModel:
    """``boosted`` fitted on ``df``, a tenth of it held out to tell when to stop (all rows train and none is held out below 50 rows)."""
    flagged = held_out(df, names, target=target)
    if flagged.limit(50).count() < 50 or not flagged.where(HELD_OUT).limit(1).count():
        pipe = boosted(names, target=target, **options)
        tree = pipe.getStages()[-1]
        tree.setMaxIter(min(tree.getMaxIter(), 20))  # nothing tells when to stop
        return pipe.fit(df)
    return boosted(names, target=target, stops=True, **options).fit(flagged)


def chosen_rounds(model: PipelineModel) -> int:
    """Trees that the fit kept."""
    return len(model.stages[-1].treeWeights)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df``, written once, with ``number`` 0, 1, ... in ``order``, ties by the hash of the row.

    Rows are dealt out by ranges and sorted inside these; a row's number is its place in its range and the number of rows in the ranges before, so
    no task sees more than one range.
    """
    keys = [*order, "__tie"]
    rows = df.withColumn("__tie", F.xxhash64(*(c for c, t in df.dtypes if not t.startswith(("map", "variant")))))
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = rows.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    rows = written(rows.drop("__tie"), "numbered")
    sizes = rows.groupBy("__part").agg(F.count("*").alias("n"))  # a row for each range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    return rows.join(F.broadcast(starts), "__part").withColumn("number", F.col("__start") + F.col("__at")).drop("__part", "__start", "__at")


def folds(df: DataFrame, order: list[str], k: int = 5) -> DataFrame:
    """``fold`` 0..k-1: contiguous parts in ``order`` whose sizes differ by one row at most; the table is written once for all fits that read it."""
    rows = numbered(df, order)
    n = rows.count()
    return rows.withColumn("fold", F.floor(F.col("number") * k / F.lit(max(n, 1))).cast("int")).drop("number")


def scored(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    return model.transform(df).withColumnRenamed("prediction", name).drop("features", "scaled")


def _bases(names: list[str], target: str, options: dict) -> dict:
    return {"base_linear": lambda df: linear(names, target=target).fit(df), "base_boosted": lambda df: fit_boosted(df, names, target, **options)}


def out_of_fold(numbered_rows: DataFrame, bases: dict) -> DataFrame:
    """Rows with ``fold`` and the predictions of base models that have seen no row of that fold."""
    out = None
    for (i,) in sorted(tuple(r) for r in numbered_rows.select("fold").distinct().collect()):  # k rows
        train, rest = numbered_rows.where(F.col("fold") != i), numbered_rows.where(F.col("fold") == i)
        for name, fit in bases.items():
            rest = scored(fit(train), rest, name)
        out = rest if out is None else out.unionByName(rest)
    return out


def stacked(df: DataFrame, names: list[str], order: list[str], k: int = 5, target: str = TARGET, ridge: float = 1.0, bases: dict | None = None, **options) -> tuple[dict[str, PipelineModel], PipelineModel]:
    """Base models on all rows, and a ridge model on their predictions of rows that they had not seen, by ``k`` exact contiguous folds.

    ``options`` go to the boosted base; other bases may be given as functions from rows to a fitted model.
    """
    bases = bases or _bases(names, target, options)
    rows = folds(df, order, k)
    meta = linear(list(bases), ridge=ridge, target=target).fit(written(out_of_fold(rows, bases).select(*bases, target), "out-of-fold"))
    return {name: fit(rows) for name, fit in bases.items()}, meta


def predict_stacked(models: tuple[dict[str, PipelineModel], PipelineModel], df: DataFrame, name: str) -> DataFrame:
    for base, m in models[0].items():
        df = scored(m, df, base)
    return scored(models[1], df, name).drop(*models[0])


def mean_error(df: DataFrame, prediction: str, target: str = TARGET) -> float:
    return df.agg(F.avg(F.abs(F.col(target) - F.col(prediction)))).first()[0]


def searched(df: DataFrame, names: list[str], order: list[str], candidates: list[dict] | None = None, k: int = 3, rungs: int = 3, keep: float = 0.5, target: str = TARGET, parallelism: int = 3, **options) -> tuple[dict, DataFrame]:
    """Successive halving over settings of ``boosted``: (the winner, a table ``rung, share, candidate, setting, fold, rounds, mae, kept``).

    All candidates are fitted on a part of the training rows of each of ``k`` unshuffled folds, written once; the better share ``keep`` goes on to
    twice as many rows, and the last rung takes all.  Errors are of the fold left out, whole at every rung; ties go to the candidate named first.
    ``parallelism`` fits run at once, each with its own cached rows.
    """
    candidates = candidates or [{"depth": d, "step": s, "sample": x} for d in (3, 5) for s in (0.05, 0.1) for x in (0.8, 1.0)]
    rows = folds(df, order, k).withColumn("__deal", F.pmod(F.xxhash64(*names, target, *order), F.lit(1 << 20)))
    # Every fit reads the rows some times; folds and flags are written, not made anew for each.
    rows = written(held_out(rows, names, target=target), "search")

    def fitted(part: DataFrame, c: int, fold: int) -> tuple[int, float]:
        model = fit_boosted(part.where(F.col("fold") != fold), names, target, **{**options, **candidates[c]})
        return chosen_rounds(model), mean_error(scored(model, rows.where(F.col("fold") == fold), "__p"), "__p", target)

    live, told = list(range(len(candidates))), []
    for rung in range(rungs):
        share = 0.5 ** (rungs - 1 - rung) if len(live) > 1 else 1.0
        part = rows.where(F.col("__deal") < F.lit(int(share * (1 << 20))))
        error: dict[int, list[float]] = {}
        fits = [(c, fold) for c in live for fold in range(k)]
        # As in Spark's CrossValidator: the many short jobs of a fit leave cores idle that others use.
        with ThreadPool(parallelism) as pool:
            results = pool.map(inheritable_thread_target(df.sparkSession)(lambda fit, part=part: fitted(part, *fit)), fits, chunksize=1)
        for (c, fold), (rounds, mae) in zip(fits, results):
            error.setdefault(c, []).append(mae)
            told.append([rung, share, c, str(candidates[c]), fold, rounds, mae])
        live = sorted(live, key=lambda c: (sum(error[c]), c))[: max(1, math.ceil(len(live) * keep)) if rung < rungs - 1 else 1]
        told = [[*t, t[2] in live] if len(t) == 7 else t for t in told]
        if share == 1.0:
            break
    table = df.sparkSession.createDataFrame(told, "rung int, share double, candidate int, setting string, fold int, rounds int, mae double, kept boolean")
    return candidates[live[0]], table


def importances(model: PipelineModel, names: list[str], spark, k: int = 20) -> DataFrame:
    """The ``k`` features that matter most to a tree model."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, values)), "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(k)


def quantile_band(scored_rows: DataFrame, reference: DataFrame, prediction: str, group: str, target: str = TARGET) -> DataFrame:
    """5, 50 and 95 % bounds: the prediction and quantiles of reference residuals of its group, exact for groups of any size."""
    shares = [0.05, 0.5, 0.95]
    known = reference.where(F.col(target).isNotNull() & F.col(group).isNotNull()).select(group, (F.col(target) - F.col(prediction)).alias("__r"))
    q = group_quantiles(known, [group], ["__r"], shares)
    names = [f"{prediction}_p05", f"{prediction}_p50", f"{prediction}_p95"]
    out = scored_rows.join(q, group, "left").withColumns({n: F.col(prediction) + F.coalesce(F.col("__r__q")[i], F.lit(0.0)) for i, n in enumerate(names)}).drop("__r__q")
    return ordered_bounds(out, *names)


def quantile_line(df: DataFrame, names: list[str], share: float, rounds: int = 12, target: str = TARGET) -> PipelineModel:
    """Linear quantile regression by least squares fitted anew with weights from the pinball loss: |share - [r < 0]| / |r| for a residual r.

    Residuals count as 10^-4 of their mean size at least.  Each round is one fit on sums of products, however many rows there are.
    """
    rows = df.withColumn("__w", F.lit(1.0))
    model = linear(names, target=target).fit(rows)
    for _ in range(rounds):
        now = scored(model, df, "__p").withColumn("__r", F.col(target) - F.col("__p"))
        size = now.agg(F.avg(F.abs("__r"))).first()[0] or 0.0
        if size < 1e-9:  # the line holds every point
            break
        pull = F.abs(F.lit(share) - (F.col("__r") < 0).cast("double")) / F.greatest(F.abs("__r"), F.lit(1e-4 * size)) * size
        model = linear(names, weight="__w", target=target).fit(now.withColumn("__w", pull).drop("__p", "__r"))
    return model


def calibrated_band(train: DataFrame, rows: DataFrame, names: list[str], order: list[str], name: str = "predicted", low: float = 0.05, high: float = 0.95, k: int = 5, target: str = TARGET) -> DataFrame:
    """``rows`` with bounds ``<name>_p05, <name>_p50, <name>_p95`` that hold for rows other than those that they were fitted on.

    Quantile lines for ``low``, 1/2 and ``high`` are fitted on all but the last of ``k`` folds; on that one the score of a row is how
    far it lies outside its bounds (below 0: inside), and the bounds are moved by the score's quantile of (high - low)(1 + 1/n), by
    which at least that share of exchangeable rows lies inside.  Names follow the defaults whatever the shares.
    """
    parts = folds(train, order, k)
    fit, check = parts.where(F.col("fold") < k - 1), parts.where(F.col("fold") == k - 1)
    bounds = [f"{name}_p05", f"{name}_p50", f"{name}_p95"]
    models = [quantile_line(fit, names, s, target=target) for s in (low, 0.5, high)]

    def scored_by_all(df: DataFrame) -> DataFrame:
        for m, n in zip(models, bounds):
            df = scored(m, df, n)
        return ordered_bounds(df, *bounds)

    off = scored_by_all(check).select(F.greatest(F.col(bounds[0]) - F.col(target), F.col(target) - F.col(bounds[2])).alias("__off"))
    n = off.count()
    share = min(1.0, (high - low) * (1 + 1 / max(n, 1)))
    moved = group_quantiles(off, [], ["__off"], [share]).first()
    by = float(moved[0][0]) if moved and moved[0] and moved[0][0] is not None else 0.0
    out = scored_by_all(rows).withColumns({bounds[0]: F.col(bounds[0]) - by, bounds[2]: F.col(bounds[2]) + by})
    return ordered_bounds(out, *bounds)

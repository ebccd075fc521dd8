"""Feature matrices: one-hot columns, column choice, splits."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.session import require

# Identifiers and targets that are no features.
DROP = [
    "Driver", "Team", "EventName", "SessionType", "Time", "LapTime", "LapTime_s", "delta_to_fastest_s", "PitOutTime", "PitInTime", "Sector1Time", "Sector2Time", "Sector3Time", "Compound",
]
NULL_NAME = "None"
WIDE = 500  # categories above which there is one vector column instead of a column for each


def _named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NULL_NAME))


class OneHot:
    """One 0/1 float column for each category seen; originals stay, unseen categories are all 0, null is a category.

    A column of more than ``wide`` categories becomes one sparse vector column ``<column>_vector`` with a place for each category
    (in alphabetical order), by Spark ML's indexer and encoder, which keep the vocabulary out of the plan.
    """

    def __init__(self, columns: tuple[str, ...] = ("Compound", "EventName", "Team"), wide: int = WIDE):
        self.columns, self.wide = columns, wide
        self.values: dict[str, list[str]] | None = None
        self.vectors: dict[str, PipelineModel] = {}

    def fit(self, df: DataFrame) -> OneHot:
        require(df, list(self.columns))
        # Different values are counted before any of them comes to the driver, and no more than ``wide`` come.
        named = df.select(*(_named(c).alias(c) for c in self.columns))
        counts = named.agg(*(F.count_distinct(c).alias(c) for c in self.columns)).first()
        self.vectors = {c: self._vector(c).fit(named.where(F.lit(counts[c] > self.wide))) for c in self.columns if counts[c] > self.wide}
        self.values = {c: [r[0] for r in named.select(c).distinct().orderBy(c).collect()] for c in self.columns if c not in self.vectors}
        return self

    def _vector(self, column: str) -> Pipeline:
        # Unseen categories have the last index, which the encoder drops.
        index = StringIndexer(inputCol=column, outputCol="__index", stringOrderType="alphabetAsc", handleInvalid="keep")
        return Pipeline(stages=[index, OneHotEncoder(inputCol="__index", outputCol="__hot", dropLast=True)])

    def names(self) -> list[str]:
        if self.values is None:
            raise RuntimeError("fit the encoder first")
        return [n for c in self.columns for n in ([f"{c}_vector"] if c in self.vectors else [f"{c}_{v}" for v in self.values[c]])]

    def transform(self, df: DataFrame) -> DataFrame:
        if self.values is None:
            raise RuntimeError("fit the encoder first")
        require(df, list(self.columns))
        hot = [F.when(_named(c) == v, 1.0).otherwise(0.0).cast("float").alias(f"{c}_{v}") for c in self.columns if c in self.values for v in self.values[c]]
        out = df.select("*", *hot)
        for c, model in self.vectors.items():
            own = out.withColumnRenamed(c, "__own").withColumn(c, _named("__own"))
            out = model.transform(own).drop(c, "__index").withColumnsRenamed({"__own": c, "__hot": f"{c}_vector"})
        return out.select(*df.columns, *self.names())


def feature_columns(df: DataFrame, drop: list[str] = DROP) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in drop and isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def feature_matrix(df: DataFrame, target: str | None = "LapTime_s", drop: list[str] = DROP) -> DataFrame:
    """Numeric features, and the target where it is not null; without a target (inference) all rows."""
    names = feature_columns(df, drop)
    if target is None:
        return df.select(*names)
    require(df, [target])
    out = df.where(F.col(target).isNotNull()).select(*names, target)
    if out.isEmpty():
        raise ValueError(f"no row has a {target}")
    return out


def chronological_split(df: DataFrame, train_seasons: list[int], test_season: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """(training rows, test rows, training seasons without rows); errors if a side is empty or the test season is trained on."""
    if test_season in train_seasons:
        raise ValueError(f"season {test_season} is both trained on and tested")
    there = {r[0] for r in df.where(F.col("Season").isin([*train_seasons, test_season])).select("Season").distinct().collect()}
    if not there & set(train_seasons):
        raise ValueError("no training season has rows")
    if test_season not in there:
        raise ValueError(f"season {test_season} has no rows")
    return df.where(F.col("Season").isin(train_seasons)), df.where(F.col("Season") == test_season), sorted(set(train_seasons) - there)


def aligned_columns(train: DataFrame, test: DataFrame, drop: list[str] = DROP) -> list[str]:
    """Features of both, in training order."""
    other = set(feature_columns(test, drop))
    shared = [c for c in feature_columns(train, drop) if c in other]
    if not shared:
        raise ValueError("no shared features")
    return shared


def reindexed(df: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The features ``names`` in order: missing ones null, others dropped."""
    return df.select(*keep, *(F.col(c).cast("double").alias(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in names))

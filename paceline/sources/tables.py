"""Reading and writing session tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paceline.session import SESSION


def add_session(df: DataFrame, season: int, round_: int, session: str, event: str) -> DataFrame:
    """Session columns in front of ``df``."""
    return df.select(F.lit(season).alias("Season"), F.lit(round_).alias("RoundNumber"), F.lit(session).alias("SessionType"), F.lit(event).alias("EventName"), "*")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def deal_out(df: DataFrame, task_rows: int) -> tuple[int, DataFrame]:
    """How many sessions ``df`` has, and its rows dealt out so that a task holds whole sessions, or parts of those of more than ``task_rows`` rows."""
    sizes = df.groupBy(*SESSION).agg(F.count("*").alias("__rows"))
    told = sizes.agg(F.count("*").alias("n"), F.max("__rows").alias("most")).first()
    n = told["n"]
    if not n or told["most"] <= task_rows:
        return n, df.repartition(*SESSION)
    part = F.pmod(F.xxhash64(*(c for c, t in df.dtypes if not t.startswith(("map", "variant")))), F.ceil(F.coalesce("__rows", F.lit(1)) / task_rows))
    dealt = df.join(F.broadcast(sizes) if n < 100_000 else sizes, SESSION, "left").withColumn("__part", part)
    return n, dealt.repartition(*SESSION, "__part").drop("__rows", "__part")


def write_table(df: DataFrame, base: str, kind: str, overwrite: bool = False, task_rows: int = 4_000_000) -> int:
    """Add the sessions of ``df`` to the partitioned table ``base/kind``; returns how many were written.

    A session is written by one task, or by several where it has more than ``task_rows`` rows.  Sessions that the table has are left alone, or with ``overwrite`` replaced; others are never touched.  No rows are an error.
    """
    spark, path = df.sparkSession, f"{base}/{kind}"
    if df.isEmpty():
        raise ValueError(f"no rows for {kind}")
    new = df
    if not overwrite and exists(spark, path):
        # Partition values alone: no data file is read.
        old = spark.read.parquet(path).select(*SESSION).distinct()
        new = df.join(F.broadcast(old) if old.count() < 100_000 else old, SESSION, "left_anti")
    n, dealt = deal_out(new, task_rows)
    if n:
        dealt.write.mode("overwrite" if overwrite else "append").option("partitionOverwriteMode", "dynamic").option("compression", "snappy").partitionBy(*SESSION).parquet(path)
    return n


def read_table(spark: SparkSession, base: str, kind: str, schema: StructType | None = None, columns: list[str] | None = None, **keys) -> DataFrame:
    """The table, pruned to the sessions ``keys`` (Season=..., RoundNumber=...) and to ``columns``; an error if it or they are missing."""
    path = f"{base}/{kind}"
    if not exists(spark, path):
        raise FileNotFoundError(path)
    df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    for k, v in keys.items():
        df = df.where(F.col(k) == v)
    if keys and df.isEmpty():
        raise FileNotFoundError(f"{path}: {keys}")
    return df.select(*columns) if columns else df


def load_features(spark: SparkSession, base: str, season: int | None = None, kind: str = "gold") -> DataFrame:
    """All feature files as one frame, though their columns differ; an error if there are none."""
    path = f"{base}/{kind}"
    if not exists(spark, path):
        raise FileNotFoundError(path)
    df = spark.read.option("mergeSchema", True).parquet(path)
    if season is not None:
        df = df.where(F.col("Season") == season)
    if df.isEmpty():
        raise FileNotFoundError(f"{path}: season {season}")
    return df


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_event_csv(df: DataFrame, path: str) -> None:
    """One folder for each season and event, blanks in names as underscores."""
    df.withColumns({"season_dir": F.col("Season"), "event_dir": F.regexp_replace("EventName", " ", "_")}).write.mode("overwrite").partitionBy("season_dir", "event_dir").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def available_rounds(spark: SparkSession, path: str, pattern: str = r"round_(\d+)") -> DataFrame:
    """Round numbers in the names of files under ``path``, ascending."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return names.select(F.regexp_extract("path", pattern, 1).alias("r")).where("r <> ''").select(F.col("r").cast("int").alias("round")).distinct().orderBy("round")

"""Tables that several steps read: written once to a folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: str | None = None


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; only on a local master without that setting a temporary folder."""
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if _own is None:
            _own = tempfile.mkdtemp(prefix="spark-checkpoint-")
            atexit.register(shutil.rmtree, _own, ignore_errors=True)
        base = f"file://{_own}"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once and read back: it outlives any executor and cuts the plan."""
    path = scratch_path(df.sparkSession, purpose)
    untyped = [c for c, t in df.dtypes if t == "void"]  # Parquet has no such column
    df.withColumns({c: F.lit(None).cast("string") for c in untyped}).write.parquet(path)
    back = df.sparkSession.read.schema(T.StructType([T.StructField(f.name, T.StringType()) if f.name in untyped else f for f in df.schema])).parquet(path)
    return back.withColumns({c: F.lit(None) for c in untyped})

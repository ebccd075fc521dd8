"""Small Spark helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_own_dir: str | None = None


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is unset (local tests) a temporary folder of this machine is
    taken instead.
    """
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="spark-checkpoint-")
            atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
        base = f"file://{_own_dir}"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Cut lineage: write ``df`` once to the shared folder and read it back.

    The written table outlives any executor, and what reads it sees one fixed set of rows
    even where tasks are run again.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` (string or binary) of one slice stays near ``max_bytes``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column(batch.schema.get_field_index(column)).nbytes
        step = max(1, int(batch.num_rows * max_bytes / max(size, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def mapper(columns: list[str], make: Callable[[], Callable], schema: pa.Schema, text: str) -> Callable:
    """A ``mapInArrow`` function that calls ``make()(*columns as Python lists)`` for each slice.

    ``make`` runs once for each task; the function it returns gives a list of columns for ``schema``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in slices(batches, text):
            out = work(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns))
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)

    return run


def quoted(name: str) -> str:
    """A column's name as ``F.col`` takes it, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted different values; sorting is many times faster here than the hash table of ``numpy.unique``."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all executors reach, by its URI (file://, hdfs://, s3://, ...)."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def written_blocks(df: DataFrame, purpose: str, most_rows: int) -> list[list[str]]:
    """Write ``df`` to the shared folder and name its files in blocks of at most ``most_rows`` rows each.

    Tasks read the blocks one after the other (``read_block``), so that a table of any size meets each slice of another
    one in bounded memory, without a broadcast and without passing through the driver, which sees file names and row counts only.
    """
    root = shared_dir(df.sparkSession, purpose)
    df.write.option("maxRecordsPerFile", most_rows).parquet(root)
    files, path = file_system(root)
    blocks: list[list[str]] = []
    room = 0
    for info in sorted(files.get_file_info(fs.FileSelector(path)), key=lambda x: x.path):
        if not info.path.endswith(".parquet"):
            continue
        with files.open_input_file(info.path) as f:
            n = pq.ParquetFile(f).metadata.num_rows
        if n > room:
            blocks.append([])
            room = most_rows
        if n:
            blocks[-1].append(info.path)
            room -= n
    return [[root, *b] for b in blocks]


def read_block(block: list[str]) -> pa.Table:
    """The rows of a block that ``written_blocks`` named."""
    files, _ = file_system(block[0])
    return pa.concat_tables(pq.read_table(p, filesystem=files) for p in block[1:])


def extended(docs: DataFrame, text_col: str, make: Callable[[], Callable], extra: list[tuple[str, T.DataType]], max_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with columns ``extra`` computed from a text column, and without the rows that are not wanted.

    ``make()`` runs once for each task; what it returns takes the texts of a slice and gives (the new columns, a mask of
    rows or None).  Columns are known by their place on the way, so their names and types, nested fields included, may be anything; new columns whose
    name is taken replace those that have it.
    """
    docs = docs.drop(*(n for n, _ in extra))
    names, n = docs.columns, len(docs.columns)
    at = names.index(text_col)
    plain = docs.toDF(*(f"c{k}" for k in range(n)))
    schema = T.StructType([*plain.schema.fields, *(T.StructField(f"c{n + k}", kind) for k, (_, kind) in enumerate(extra))])
    kinds = [to_arrow_type(kind) for _, kind in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in slices(batches, f"c{at}", max_bytes):
            new, mask = work(part.column(at))
            out = pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, kind) for x, kind in zip(new, kinds))], names=[f"c{k}" for k in range(n + len(kinds))])
            yield out if mask is None else out.filter(pa.array(mask, pa.bool_()))

    return plain.mapInArrow(run, schema).toDF(*names, *(n for n, _ in extra))

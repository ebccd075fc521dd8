"""Document fingerprints by winnowing."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm._spark import mapper, slices

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes (polynomial modulo 2^64, then mixed) of all ``k``-grams of code points; of all of a shorter text."""
    if not len(codes):
        return np.zeros(0, np.uint64)
    k = min(k, len(codes))
    # Grams of a doubled length come from two neighbours; the bits of k put the parts together.
    step, power, width = codes.astype(np.uint64) + np.uint64(1), _BASE, 1
    total, size = None, 0
    n = len(codes) - k + 1
    while True:
        if k & width:
            part = step[size : size + n]
            total = part.copy() if total is None else total * np.uint64(power) + part
            size += width
        if 2 * width > k:
            return _mix(total)
        step = step[: len(step) - width] * np.uint64(power) + step[width:]
        power, width = power * power & _MASK, 2 * width


def winnow(text: str, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) chosen: the least hash of every window of ``w`` neighbouring ``k``-grams, the rightmost of ties.

    Any passage of ``k + w - 1`` code points that two texts share gives both a common hash, at positions
    that lie within the passage.  Fewer grams than ``w`` are one window; an empty text has none.
    """
    h = gram_hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), k)
    if not len(h):
        return h, np.zeros(0, np.int64)
    best, at, width, w = h, np.arange(len(h)), 1, min(w, len(h))
    while width < w:
        step = min(width, w - width)
        a, b = best[:-step], best[step:]
        right = b <= a
        best, at = np.where(right, b, a), np.where(right, at[step:], at[:-step])
        width += step
    new = np.append(True, at[1:] != at[:-1])
    return best[new], at[new]


def fingerprint(hashes: np.ndarray, positions: np.ndarray) -> bytes:
    """All chosen hashes, their upper 32 bits each, in the order of the text, then the steps from position to position in as many bytes each as the first byte tells."""
    steps = np.diff(positions, prepend=0)
    width = 1 if not len(steps) or steps.max() < 256 else 4
    return bytes([width]) + (hashes >> np.uint64(32)).astype("<u4").tobytes() + steps.astype(f"<u{width}").tobytes()


def chosen(print_: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) that a fingerprint holds."""
    width = print_[0]
    n = (len(print_) - 1) // (4 + width)
    return np.frombuffer(print_, "<u4", n, 1), np.cumsum(np.frombuffer(print_, f"<u{width}", n, 1 + 4 * n), dtype=np.int64)


def _counted(print_: bytes) -> np.ndarray:
    """The hashes of a fingerprint, sorted, each with its number among equal ones below it, so that repeats count as in a multiset."""
    h = np.sort(chosen(print_)[0]).astype(np.uint64)
    at = np.arange(len(h), dtype=np.uint64)
    turn = at - np.maximum.accumulate(np.where(np.append(True, h[1:] != h[:-1])[: len(h)], at, 0))
    return h << np.uint64(32) | turn


def _likeness(a: np.ndarray, b: np.ndarray) -> float:
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared) if len(both) else 1.0


def fingerprint_likeness(a: str, b: str) -> float:
    """Jaccard index of the multisets of hashes of two fingerprints as ``edit_fingerprints`` returns them; two empty ones are alike."""
    return _likeness(*(_counted(bytes.fromhex(x)) for x in (a, b)))


def winnow_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 8, w: int = 8) -> DataFrame:
    """``(doc_id, n_chars, hashes array<long>, positions array<int>)`` for every row; a null text is empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("hashes", pa.list_(pa.int64())), ("positions", pa.list_(pa.int32()))])

    def make():
        def work(ids, texts):
            own = [winnow(t or "", k, w) for t in texts]
            return [ids, [len(t or "") for t in texts], [h.view(np.int64) for h, _ in own], [p.astype(np.int32) for _, p in own]]

        return work

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(mapper(["doc_id", "text"], make, schema, "text"), "doc_id long, n_chars long, hashes array<long>, positions array<int>")


def with_next(docs: DataFrame, visit: Callable[[], Callable], schema: pa.Schema, ddl: str, range_bytes: int = 32 << 20) -> DataFrame:
    """``visit()(row, next row)`` for every row of ``docs`` (doc_id, text) and the next by doc_id, the first after the last.

    Rows are dealt out by ranges of (doc_id, hash of the text), so repeated and null ids spread like any others (rows that repeat both id and
    text lie in one range); there are as many ranges as make ``range_bytes`` of text each, or as fill the cores.  The ranges are fitted on ids and hashes alone, of which the
    driver sees the first of each range.  That first row also goes, as a copy, to the end of the range before, so texts are shuffled once and
    each task walks its sorted range with two rows at hand; nothing is written.  Null ids come first; rows of one id follow each other by the hash of their text.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    # Ranges of about range_bytes, but while these are few, as many as tasks that run at once, of 1 MB or more.
    ranges = max(-(-total // range_bytes), min(spark.sparkContext.defaultParallelism, total >> 20), 1)
    order = ["doc_id", "tie"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    parts = rows.select(*order).repartitionByRange(ranges, *order).groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*order)).alias("first"))
    place = lambda i, tie: (i is not None, i or 0, tie)
    firsts = sorted((tuple(r["first"]) for r in parts.select("first").collect()), key=lambda r: place(*r))
    if not firsts:
        return spark.createDataFrame([], ddl)
    bounds = [place(*r) for r in firsts[1:]]
    ids = np.array([r[1] for r in bounds], np.int64)

    @F.pandas_udf("int")
    def part_of(i: pd.Series, there: pd.Series, tie: pd.Series) -> pd.Series:
        own = i.to_numpy(np.int64)
        # By the id alone, but where it is null or that of a border.
        nulls = sum(not r[0] for r in bounds)
        part = nulls + np.searchsorted(ids[nulls:], own, "right")
        for at in np.flatnonzero(~there.to_numpy(bool) | np.isin(own, ids)):
            part[at] = bisect.bisect_right(bounds, (bool(there[at]), int(own[at]), int(tie[at])))
        return pd.Series(part.astype(np.int32))

    head = spark.createDataFrame([((n - 1) % len(firsts), *r) for n, r in enumerate(firsts)], "part int, __id long, __tie long")
    borders = rows.join(F.broadcast(head), rows["doc_id"].eqNullSafe(head["__id"]) & (rows["tie"] == head["__tie"])).dropDuplicates(["part"])
    own = rows.withColumn("part", part_of(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNotNull(), "tie"))
    both = own.select("part", F.lit(0).alias("side"), *order, "text").union(borders.select("part", F.lit(1), *order, "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, last = visit(), None
        for part in slices(batches, "text"):
            out = []
            for row in zip(*(c.to_pylist() for c in part.columns)):
                if last is not None:
                    out.append(work(last, row))
                last = row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    dealt = both.repartitionById(len(firsts), "part").sortWithinPartitions("side", *order).select("doc_id", "text")
    return dealt.mapInArrow(run, ddl)


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 8, w: int = 8, range_bytes: int = 32 << 20) -> DataFrame:
    """Each document's fingerprint beside that of its edited text, whose last quarter comes from the next document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_selected, guarantee``.  Null texts are empty;
    repeated ids are taken in order of the hash of their texts; a null id comes first; a single row is its own next; an empty table gives no rows;
    other columns are left out.  A fingerprint is hex of all chosen hashes with their positions (``chosen``), and near_* are the likeness of these
    hashes, so ``fingerprint_likeness`` gives them, and that of any other two documents, from the strings.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary())]
        + [("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_selected", pa.int64()), ("guarantee", pa.int64())]
    )

    def visit():
        kept: dict = {"row": None}

        def prints(text):
            hashes, positions = winnow(text, k, w)
            own = fingerprint(hashes, positions)
            return own, len(hashes), _counted(own)

        def work(row, after):
            own = kept["own"] if kept["row"] is row else prints(row[1])
            text, n = row[1], len(row[1])
            edited = text[: n - n // 4] + after[1][: n // 4]
            changed = own if edited == text else prints(edited)
            kept["own"] = following = own if after[1] == text else prints(after[1])
            kept["row"] = after
            near = [_likeness(own[2], other[2]) for other in (changed, following)]
            return (row[0], n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own[0], changed[0], *near, own[1], k + w - 1)

        return work

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, n_selected long, guarantee long"
    out = with_next(rows, visit, schema, ddl, range_bytes)
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})

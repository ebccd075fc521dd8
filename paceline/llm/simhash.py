"""SimHash near-duplicates: exact tiled comparison of fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.llm._spark import extended, materialise, quoted
from paceline.llm.components import connected_components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 16


def fingerprint(text: str | None, n: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the ``n``-word shingles of ``text``, repeats included, as an unsigned int.

    Words are runs without ASCII white space, A-Z lower-cased.  Fewer than ``n`` words make one
    shingle of them all; no words (or null) give 0.  A bit is set if more than half the
    shingle hashes (XXH64) have it.
    """
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= n:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start, stop = (end - size)[: len(words) - n + 1].tolist(), end[n - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, len(start)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, _CHUNK):
        h = np.array([digest(line[i:j], seed) for i, j in zip(start[at : at + _CHUNK], stop[at : at + _CHUNK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", n: int = 4, name: str = "fp") -> DataFrame:
    """``docs`` and their fingerprints in column ``name``, the bits as a signed long; a column of that name gives way.

    Null and empty texts have fingerprint 0; texts of any length are taken whole; repeated rows and null ids stay; an empty table gives no rows.
    """
    make = lambda: lambda texts: ([np.array([fingerprint(t, n) for t in texts.to_pylist()], np.uint64).view(np.int64)], None)
    return extended(docs, text_col, make, [(name, T.LongType())])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4) -> DataFrame:
    """``(doc_id, fp)`` for every row, as ``with_fingerprint`` gives it; other columns are left out."""
    return with_fingerprint(docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text")), "text", n).select("doc_id", "fp")


def _merge_links(mine: np.ndarray, other: np.ndarray, offset: int, label: np.ndarray, radius: int, strip: int = 256) -> None:
    """Union, in ``label``, of rows of two sorted tiles within ``radius`` bits of each other."""
    for at in range(0, len(mine), strip):
        part = mine[at : at + strip]
        hits = np.bitwise_count(part[:, None] ^ other[None, :]) <= radius
        for i in np.flatnonzero(hits.any(1)).tolist():
            found = label[offset + np.flatnonzero(hits[i])]
            low = min(int(found.min()), int(label[at + i]))
            if label[at + i] != low or (found != low).any():
                label[np.isin(label, np.append(found, label[at + i]))] = low


def compare_tiles(fps: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within one tile pair, as (fingerprint, smallest fingerprint of its local group) of grouped rows.

    side 2: both tiles are the same one; else 0 and 1 tell the tiles apart.  Only a spanning star
    of each group leaves the task, never all its pairs.
    """
    a, b = fps[side != 1], fps[side == 1]
    rows = np.concatenate([a, b])
    label = np.arange(len(rows))
    if len(b):
        _merge_links(a, b, len(a), label, radius)
    else:
        _merge_links(a, a, 0, label, radius)
    keep = label != np.arange(len(rows))
    return rows[keep].view(np.int64), rows[label[keep]].view(np.int64)


def similar_fingerprints(distinct: DataFrame, radius: int = 4, tile: int = 4096) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` that differ in ``radius`` bits or fewer.

    Every link's ends come out connected, though not each pair.  Two fingerprints
    within the radius agree on one of ``radius + 1`` blocks of bits at least, so only rows that
    share (a prefix of) a block meet: nothing is lost.  The prefix grows with the table so that a
    bucket holds about a tile.  Larger buckets are cut into tiles by population count, and tile
    pairs whose counts differ by more than the radius are never formed.
    """
    count = distinct.count()
    depth = max(0, math.ceil(math.log2(max(1, count / tile))))
    n_blocks = radius + 1 if depth else 1
    cuts = [64 * i // n_blocks for i in range(n_blocks + 1)]
    keys = []
    for i in range(n_blocks):
        bits = min(depth, cuts[i + 1] - cuts[i])
        key = F.shiftrightunsigned("fp", cuts[i]).bitwiseAND(F.lit((1 << bits) - 1))
        keys.append(F.struct(F.lit(i).alias("block"), key.cast("long").alias("key")))
    rows = distinct.select("fp", F.bit_count("fp").cast("int").alias("pc"), F.explode(F.array(*keys)).alias("k")).select("fp", "pc", "k.*")
    cells = rows.groupBy("block", "key", "pc").count()
    cells = cells.select("block", "key", F.struct("pc", F.ceil(F.col("count") / tile).cast("int").alias("m")).alias("cell"), "count")
    # At most 65 population counts, so at most 65 cells in a bucket.
    buckets = cells.groupBy("block", "key").agg(F.sum("count").alias("n"), F.collect_list("cell").alias("cells"))
    placed = rows.join(buckets, ["block", "key"]).where("n > 1")
    small = placed.where(F.col("n") <= tile).select("block", "key", F.lit(-1).alias("t1"), F.lit(-1).alias("t2"), F.lit(2).alias("side"), "fp")
    # A tile's number is 2^20 * population count + slice.
    mine = F.expr("pc * 1048576 + cast(pmod(xxhash64(fp), filter(cells, c -> c.pc = pc)[0].m) as int)")
    near = F.expr(
        f"flatten(transform(filter(cells, c -> abs(c.pc - pc) <= {radius}), c -> transform(sequence(0, c.m - 1), s -> c.pc * 1048576 + s)))"
    )
    large = (
        placed.where(F.col("n") > tile)
        .select("block", "key", "fp", mine.alias("me"), near.alias("near"))
        .select("block", "key", "fp", "me", F.explode("near").alias("it"))
        .select("block", "key", F.least("me", "it").alias("t1"), F.greatest("me", "it").alias("t2"), F.expr("case when me = it then 2 when me < it then 0 else 1 end").alias("side"), "fp")
    )
    order = ["block", "key", "t1", "t2"]
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            fps, side = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in compare_tiles(fps, side, radius)], schema=out)

        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in order], 1)
            fps = batch.column(batch.schema.get_field_index("fp")).to_numpy(zero_copy_only=False).view(np.uint64)
            side = batch.column(batch.schema.get_field_index("side")).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(key)]):
                if held and (key[i] != last).any():
                    yield flush()
                    held = []
                held.append((fps[i:j].copy(), side[i:j].copy()))
                last = key[i].copy()
        if held:
            yield flush()

    tasks = small.union(large).repartition(*order).sortWithinPartitions(*order)
    return tasks.mapInArrow(compare, "a long, b long")


def fingerprint_groups(prints: DataFrame, radius: int = 4, tile: int = 4096) -> DataFrame:
    """``(fp, head)`` for each different ``fp`` of ``prints``: fingerprints reachable over links have the same head."""
    distinct = materialise(prints.select("fp").distinct(), "simhash-classes")
    links = materialise(similar_fingerprints(distinct, radius, tile).distinct(), "simhash-links")
    found = connected_components(links)
    return distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("head"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, radius: int = 4, tile: int = 4096) -> DataFrame:
    """``(doc_id, fp, fingerprint, component_id)`` for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of ``radius`` bits or fewer.
    Equal fingerprints meet once, however many copies there are.  Null and empty texts have fingerprint 0 and link like
    any other; repeated rows stay repeated; a null id is never the smallest (a group of null ids alone has a null component_id);
    an empty table gives no rows; other columns are left out.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, n), "simhash")
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(fingerprint_groups(prints, radius, tile), "fp")
    least = groups.groupBy("head").agg(F.min("least").alias("component_id"))
    named = groups.select("fp", "head").join(least, "head").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup_simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, radius: int = 4, tile: int = 4096) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id, null ids last.

    Of repeated rows one stays.  All columns stay as they are.
    """
    names = docs.columns
    row = F.struct(*(F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(names)))  # by place, whatever the names
    rows = docs.select(row.alias("row"), F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    prints = materialise(with_fingerprint(rows.select("id", "text", "row"), "text", n).select("row", "id", "fp").withColumn("uid", F.monotonically_increasing_id()), "simhash-rows")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("uid"))
    groups = prints.groupBy("fp").agg(F.min(order).alias("least")).join(fingerprint_groups(prints, radius, tile), "fp")
    kept = groups.groupBy("head").agg(F.min("least").alias("least")).select(F.col("least.uid").alias("uid"))
    return prints.join(kept, "uid", "left_semi").select("row.*").toDF(*names)

"""Near-duplicate vectors by PCA-ordered tiled comparison."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm._spark import materialise
from paceline.llm.components import connected_components

_SLACK = 1e-9


LEADS = 4  # leading principal coordinates by which tiles are formed and told apart


def _unpack(column: pa.Array, kind: str) -> np.ndarray:
    """A binary column of vectors of one length as a matrix of doubles."""
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def packed_vectors(vectors: DataFrame, kind: str) -> DataFrame:
    """``(vec_id, label, key, vector)`` of rows ``(vec_id, label, vector)``: the vector as bytes and a 128-bit hash of them, or null where it can't link.

    Doubles are scaled by their largest part where this lies outside 1e-100 to 1e100: cosines stay, squares keep
    within the range of doubles.
    """
    label = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            own = column.flatten()
            parts = np.asarray(own.fill_null(np.nan), kind)  # a null part is as bad as one that is no number
            size = np.nan_to_num(np.asarray(pa.compute.list_value_length(column).fill_null(0), np.float64)).astype(np.int64)
            ends = np.cumsum(size)
            finite = np.append(0, np.cumsum(np.isfinite(parts)))
            some = np.append(0, np.cumsum(np.nan_to_num(parts) != 0))
            fit = (size > 0) & (finite[ends] - finite[ends - size] == size) & (some[ends] - some[ends - size] > 0)
            fit &= np.asarray(batch.column(1).is_valid())
            keys, blobs = [], []
            for ok, i, j in zip(fit.tolist(), (ends - size).tolist(), ends.tolist()):
                x = parts[i:j]
                if ok and kind == "<f8" and not 1e-100 <= (top := float(np.abs(x).max())) <= 1e100:
                    x = x / top
                blobs.append((x + 0).tobytes() if ok else None)  # -0 becomes 0
                keys.append(hashlib.blake2b(blobs[-1], digest_size=16).digest() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], names=["vec_id", "label", "key", "vector"])

    return vectors.mapInArrow(run, f"vec_id long, label {label}, key binary, vector binary")


def moments(classes: DataFrame, kind: str) -> tuple[int, np.ndarray]:
    """(rows, second moments of the unit vectors) over all rows: one d x d sum for each task, added up in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = None, 0
        for batch in batches:
            if batch.num_rows:
                x = _unpack(batch.column(0), kind)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                total = x.T @ x if total is None else total + x.T @ x
                count += len(x)
        if count:
            flat = total.ravel()
            at = pa.array(range(-1, len(flat)), pa.int32())
            yield pa.RecordBatch.from_arrays([at, pa.array([float(count), *flat.tolist()])], names=["at", "value"])

    rows = classes.select("vector").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    flat = [r["value"] for r in sorted(rows, key=lambda r: r["at"])]
    d = round(max(0, len(flat) - 1) ** 0.5)
    return (int(flat[0]) if flat else 0), np.array(flat[1:]).reshape(d, d)


def principal_axes(second: np.ndarray) -> np.ndarray:
    """Columns: directions of the data in order of falling variance (of the second moments, as cosines need)."""
    values, axes = np.linalg.eigh(second)
    return axes[:, np.argsort(-values)]


def _suffix_norms(x: np.ndarray, cuts: list[int]) -> np.ndarray:
    return np.stack([np.sqrt((x[:, c:] ** 2).sum(1)) for c in cuts], 1)


def tile_links(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool, step: int = 16, strip: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of two tiles with a cosine of ``threshold`` or more, in pieces.

    Products of the leading principal dimensions are summed up first.  What the other dimensions can add is bounded by
    the product of the suffix norms, and work on a strip stops, or goes on with the few pairs left, when no cosine
    (or few) can reach the threshold.  The pairs left at the end are decided on the vectors themselves in double precision.
    """
    norm_a, norm_b = np.sqrt(np.einsum("ij,ij->i", a, a)), np.sqrt(np.einsum("ij,ij->i", b, b))
    u, v = (a / norm_a[:, None]) @ axes, (b / norm_b[:, None]) @ axes
    d = u.shape[1]
    cuts = list(range(step, d, step)) + [d]
    tail_u, tail_v = _suffix_norms(u, cuts), _suffix_norms(v, cuts)
    for at in range(0, len(a), strip):
        own = slice(at, min(at + strip, len(a)))
        done, start, pair = np.zeros((own.stop - at, len(b))), 0, None
        for k, stop in enumerate(cuts):
            if pair is None:
                done += u[own, start:stop] @ v[:, start:stop].T
                open_ = done + tail_u[own, k, None] * tail_v[None, :, k] >= threshold - _SLACK
                if same:
                    open_ &= np.arange(len(b))[None, :] > np.arange(at, own.stop)[:, None]
                left = int(open_.sum())
                if left * 16 < open_.size or k == len(cuts) - 1:
                    i, j = np.nonzero(open_)
                    pair, dot = (i + at, j), done[i, j]
            else:
                i, j = pair
                dot = dot + np.einsum("ij,ij->i", u[i, start:stop], v[j, start:stop])
                keep = dot + tail_u[i, k] * tail_v[j, k] >= threshold - _SLACK
                pair, dot = (i[keep], j[keep]), dot[keep]
            if pair is not None and not len(pair[0]):
                break
            start = stop
        i, j = pair
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            cosine = np.einsum("ij,ij->i", a[p], b[q]) / (norm_a[p] * norm_b[q])
            yield p[cosine >= threshold], q[cosine >= threshold]


def _union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Lower ``label`` until linked rows have the same: minimum over links, then pointer jumping."""
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        while (label[label] != label).any():
            label[:] = label[label]
        if (label == before).all():
            return


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, tile: int | None = None) -> DataFrame:
    """One row ``(vec_id, n_links, component_id, kept)`` for each row: links to other vectors of an equal label.

    A link is a cosine of ``threshold`` or more in double precision.  Rows whose label is null or whose vector is null, empty, zero or
    has null or non-finite parts link with nothing, nor do vectors of different lengths; repeated rows are rows of their own; a null id is a
    row whose own id is never the smallest of a group; an empty table gives no rows; other columns are left out.

    Equal vectors meet once, as a class with a count.  Classes are sorted by label and leading principal coordinates into
    tiles (``tile`` rows, by default what makes 8 MB, 8192 at most); tile pairs of a label are compared unless their leading
    coordinates lie further apart than the threshold allows.  From each tile pair come link counts and a spanning star of
    each group, not its pairs.
    """
    floats = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if floats else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<float>" if floats else "array<double>").alias("vector"))
    packed = materialise(packed_vectors(rows, kind), "vectors")
    fit = packed.where("key is not null")
    # A copy's bytes stay in its task: of each class one vector goes on.
    classes = fit.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("vector").alias("vector"))
    classes = materialise(classes.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    lone = packed.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    sizes = [r["n"] for r in classes.select(F.octet_length("vector").alias("n")).distinct().collect()]
    found = None
    for n in sizes:
        links = _class_links(classes.where(F.octet_length("vector") == n), kind, threshold, tile or max(256, min(8192, (1 << 20) // (n // np.dtype(kind).itemsize))))
        found = links if found is None else found.union(links)
    if found is None:
        return lone.withColumn("kept", F.lit(True))
    found = materialise(found, "vector-links")
    counts = found.groupBy("class").agg(F.sum("n").alias("n"))
    heads = connected_components(found.where("other is not null"), "class", "other")
    reps = classes.select("class", "label", "key", "rep", "size").join(counts, "class", "left").join(heads, F.col("class") == F.col("node"), "left")
    reps = reps.select("label", "key", "rep", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "class").alias("head"))
    least = reps.groupBy("head").agg(F.min("rep").alias("component_id"))
    told = reps.join(least, "head").select("label", "key", "n_links", "component_id")
    out = fit.select("vec_id", "label", "key").join(told, ["label", "key"]).select("vec_id", "n_links", "component_id").union(lone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _tiles(classes: DataFrame, kind: str, axes: np.ndarray, reach: float, tile: int, count: int) -> DataFrame:
    """Rows ``(tile, label, low, high, classes, sizes, vectors)``: up to ``tile`` classes of one label that lie near each other in the leading coordinates."""
    label = dict(classes.dtypes)["label"]
    leads = np.pad(axes[:, :LEADS], ((0, 0), (0, max(0, LEADS - axes.shape[1]))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unpack(batch.column(3), kind)
                lead = (x @ leads) / np.linalg.norm(x, axis=1, keepdims=True)
                cell = np.zeros(len(x), np.int64)  # boxes as wide as the reach of a link
                for k in range(lead.shape[1]):
                    cell = cell << 12 | np.floor((lead[:, k] + 1) / max(reach, 1e-3)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.FixedSizeListArray.from_arrays(pa.array(lead.ravel()), lead.shape[1]).cast(pa.list_(pa.float64()))], names=["class", "label", "size", "vector", "cell", "lead"])

    rows = classes.select("class", "label", "size", "vector").mapInArrow(place, f"class long, label {label}, size long, vector binary, cell long, lead array<double>")
    # Ranges of about a tile and as many tasks; the class number parts what lies in one box.
    rows = rows.repartitionByRange(max(1, -(-count // tile)), "label", "cell", "class").sortWithinPartitions("label", "cell", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, held = TaskContext.get().partitionId() << 32, 0, []

        def flush():
            nonlocal made
            t = pa.Table.from_batches(held)
            lead = np.asarray(t["lead"].combine_chunks().flatten()).reshape(t.num_rows, -1)
            blob = lambda x: pa.array([x], pa.binary())
            box = lambda x: pa.array([x.tolist()], pa.list_(pa.float64()))
            row = [pa.array([base + made]), t["label"].slice(0, 1).combine_chunks(), box(lead.min(0)), box(lead.max(0)), blob(t["class"].to_numpy().tobytes()), blob(t["size"].to_numpy().tobytes()), blob(b"".join(t["vector"].to_pylist()))]
            made += 1
            held.clear()
            return pa.RecordBatch.from_arrays(row, names=["tile", "label", "low", "high", "classes", "sizes", "vectors"])

        for batch in batches:
            if not batch.num_rows:
                continue
            labels = batch.column(1).to_pylist()
            edge = [i for i in range(1, len(labels)) if labels[i] != labels[i - 1]]
            for i, j in zip([0, *edge], [*edge, len(labels)]):
                while i < j:
                    if held and (held[0].column(1)[0].as_py() != labels[i] or sum(x.num_rows for x in held) >= tile):
                        yield flush()
                    held.append(batch.slice(i, min(tile - sum(x.num_rows for x in held), j - i)))
                    i += held[-1].num_rows
        if held:
            yield flush()

    return rows.mapInArrow(run, f"tile long, label {label}, low array<double>, high array<double>, classes binary, sizes binary, vectors binary")


def _tile_pairs(tiles: DataFrame, reach: float) -> DataFrame:
    """``(tile, tile2)`` of a label, each pair once, unless the boxes lie further apart than ``reach``.

    Tiles are numbered by label; each asks for those of its own number and above, so a label with very many tiles
    is dealt out like many labels.
    """
    by = Window.partitionBy("label")
    meta = tiles.select("tile", "label", "low", "high").withColumns({"k": F.row_number().over(by.orderBy("tile")), "most": F.count("*").over(by)})
    asks = meta.select("tile", "label", "low", "high", F.explode(F.sequence("k", F.col("most").cast("int"))).alias("k"))
    other = meta.select(F.col("tile").alias("tile2"), "label", F.col("low").alias("low2"), F.col("high").alias("high2"), "k")
    gaps = [F.greatest(F.col("low")[i] - F.col("high2")[i], F.col("low2")[i] - F.col("high")[i], F.lit(0.0)) for i in range(LEADS)]
    apart = sum((g * g for g in gaps), F.lit(0.0))
    return asks.join(other, ["label", "k"]).where(apart <= reach * reach).select("tile", "tile2")


def _class_links(classes: DataFrame, kind: str, threshold: float, tile: int) -> DataFrame:
    """``(class, n, other)``: rows linked from a class to other classes, and a smaller class of its local group or null."""
    count, second = moments(classes, kind)
    axes = principal_axes(second)
    # Unit vectors with a cosine of t lie within sqrt(2 - 2t) of each other, so do their leading coordinates.
    reach = (max(0.0, 2 - 2 * threshold)) ** 0.5 + 1e-6
    tiles = materialise(_tiles(classes, kind, axes, reach, tile, count), "vector-tiles")
    pairs = materialise(_tile_pairs(tiles, reach), "tile-pairs")
    # Each pair is a place where its two tiles meet: a tile is sent once to each of its pairs.
    ends = pairs.select(F.col("tile").alias("one"), F.col("tile2").alias("two"), F.explode(F.when(F.col("tile") == F.col("tile2"), F.array("tile")).otherwise(F.array("tile", "tile2"))).alias("tile"))
    work = tiles.select("tile", "classes", "sizes", "vectors").join(ends, "tile").repartition("one", "two").sortWithinPartitions("one", "two", "tile")
    out = pa.schema([("class", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])
    held_axes = classes.sparkSession.sparkContext.broadcast(axes)

    def meet(tiles: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        (c, s, a), *rest = tiles
        b, offset = a, 0
        if rest:
            ((c2, s2, b),), offset = rest, len(c)
            c, s = np.concatenate([c, c2]), np.concatenate([s, s2])
        number, label = np.zeros(len(c), np.int64), np.arange(len(c))
        for i, j in tile_links(a, b, held_axes.value, threshold, not rest):
            j = j + offset
            np.add.at(number, i, s[j])
            np.add.at(number, j, s[i])
            _union(label, i, j)
        hit = np.flatnonzero(number)
        if len(hit):
            star = np.where(label[hit] == hit, -1, label[hit])
            other = pa.array(np.where(star < 0, 0, c[star]), mask=star < 0)
            yield pa.RecordBatch.from_arrays([pa.array(c[hit]), pa.array(number[hit]), other], schema=out)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in ("one", "two", "classes", "sizes", "vectors")}
            for k in range(batch.num_rows):
                pair = columns["one"][k].as_py(), columns["two"][k].as_py()
                if held and pair != last:
                    yield from meet(held)
                    held = []
                own = np.frombuffer(columns["classes"][k].as_py(), np.int64)
                vectors = np.frombuffer(columns["vectors"][k].as_py(), kind).astype(np.float64).reshape(len(own), -1)
                held, last = [*held, (own, np.frombuffer(columns["sizes"][k].as_py(), np.int64), vectors)], pair
        if held:
            yield from meet(held)

    return work.mapInArrow(compare, "class long, n long, other long")

"""Spelling variants: words one edit apart, by k-d trees over letter counts."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm._spark import materialise, slices

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
_DEPTH = [4] * 26 + [1] * 64  # counts up to which a letter's count is told in bits
_BITS = 192
LONG = 64  # characters from which words of all lengths stand in one tree
SAMPLE = 1 << 16  # words that the trees' upper splits are fitted on
_ROUNDS = 6  # doublings: each form is at least ``times`` as frequent, so no chain is longer


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """``(word, n)``: words of at least ``least_length`` letters that occur ``least_count`` times in all rows of ``docs``.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased.  Let h be the crc32 of ``<id>:<run>``: where ``every`` divides it
    (0: never), the run loses its letter h % length.  Null texts have no words, a null id counts as the empty string; repeated rows count each.
    Tasks count before they shuffle.
    """
    runs = re.compile(f"[a-z\xc0-\xff]{{{least_length},}}").findall
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], schema=schema)
        for part in slices(batches, "text"):
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                if not text:
                    continue
                own = Counter(runs(text.translate(_LOWER).decode()))
                if every:
                    start = zlib.crc32(f"{doc or ''}:".encode())
                    for word in [w for w in own if zlib.crc32(w.encode(), start) % every == 0]:
                        at, n = zlib.crc32(word.encode(), start) % len(word), own.pop(word)
                        found[word[:at] + word[at + 1 :]] += n
                found.update(own)
            if len(found) > 300_000:
                yield give()
                found.clear()
        if found:
            yield give()

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= least_count) & (F.length("word") >= least_length))


def letters_of(words: list[str]) -> np.ndarray:
    """The words' letters, one row each, filled up with zeros."""
    raw = [w.encode("latin-1") for w in words]
    width = max(map(len, raw), default=1)
    return np.array(raw, f"S{width}").view(np.uint8).reshape(len(raw), width)


def count_codes(words: list[str]) -> np.ndarray:
    """Letter-count vectors as bits: bit (letter, t) is set if the letter stands at least t times in the word.

    Bits by which two codes differ are the L1 distance of their counts, or less where a letter is more frequent than bits tell.
    """
    bits = np.zeros((len(words), _BITS), bool)
    by_width: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_width.setdefault(len(w).bit_length(), []).append(k)
    for rows in by_width.values():
        own = letters_of([words[k] for k in rows])
        bit = 0
        for letter, depth in zip(_LETTERS, _DEPTH):
            n = (own == letter).sum(1)
            for t in range(1, depth + 1):
                bits[rows, bit] = n >= t
                bit += 1
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def _unpacked(codes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(codes).view(np.uint8).reshape(len(codes), _BITS // 8), axis=1, bitorder="little")


_FIRST = np.cumsum([0, *_DEPTH])  # the first bit of each letter, and the end
_LETTER = np.repeat(np.arange(len(_DEPTH)), _DEPTH)


@dataclass
class Node:
    """A box of letter counts: at least ``low``, at most ``high``; inside a tree it is parted by one letter's count."""

    low: np.ndarray
    high: np.ndarray
    bit: int = -1
    below: Node | None = None
    above: Node | None = None
    leaf: int = -1
    points: np.ndarray | None = None


def build(codes: np.ndarray, size: int, tight: bool) -> tuple[Node, int]:
    """A k-d tree with leaves of at most ``size`` points where counts tell them apart, and how many leaves it has.

    Each node is parted at the letter and count that come nearest to halves.  ``tight`` boxes hold the given points only, others
    everything that comes by the splits.
    """
    leaves = 0
    bits = _unpacked(codes)

    def packed(x: np.ndarray) -> np.ndarray:
        return np.packbits(x, bitorder="little").view("<u8")

    def node(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> Node:
        nonlocal leaves
        own = bits[rows]
        n = own.sum(0, dtype=np.int64)
        if tight:
            low, high = n == len(rows), n > 0
        out = Node(packed(low), packed(high))
        lesser = np.minimum(n, len(rows) - n)
        if len(rows) <= size or not lesser.max():
            out.leaf, out.points = leaves, rows
            leaves += 1
            return out
        out.bit = bit = int(lesser.argmax())
        has = own[:, bit] > 0
        # Fewer than t of a letter: none of its bits from t on; t or more: all its bits up to t.
        less, more = high.copy(), low.copy()
        less[bit : _FIRST[_LETTER[bit] + 1]] = False
        more[_FIRST[_LETTER[bit]] : bit + 1] = True
        out.below, out.above = node(rows[~has], low, less), node(rows[has], more, high)
        return out

    every = np.ones(_BITS, bool)
    return node(np.arange(len(codes)), ~every, every), leaves


def reached(root: Node, codes: np.ndarray, more: int, fewer: int) -> Iterator[tuple[Node, np.ndarray]]:
    """Leaves with the rows of ``codes`` that some point of their box may equal by at most ``more`` letters more and ``fewer`` less."""
    stack = [(root, np.arange(len(codes)))]
    while stack:
        node, rows = stack.pop()
        own = codes[rows]
        out = np.bitwise_count(own & ~node.high).sum(1, dtype=np.uint8)
        into = np.bitwise_count(node.low & ~own).sum(1, dtype=np.uint8)
        rows = rows[(out <= fewer) & (into <= more)]
        if not len(rows):
            continue
        if node.bit < 0:
            yield node, rows
        else:
            stack += [(node.below, rows), (node.above, rows)]


def homes(root: Node, codes: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    out = np.zeros(len(codes), np.int64)
    stack = [(root, np.arange(len(codes)))]
    while stack:
        node, rows = stack.pop()
        if node.bit < 0:
            out[rows] = node.leaf
        elif len(rows):
            has = codes[rows, node.bit // 64] >> np.uint64(node.bit % 64) & np.uint64(1) > 0
            stack += [(node.below, rows[~has]), (node.above, rows[has])]
    return out


def one_edit(a: np.ndarray, b: np.ndarray, n: int, longer: int) -> np.ndarray:
    """Whether row by row the letters ``b`` are ``a`` (of ``n`` letters) with one replaced, or with one put in where ``longer`` is 1."""
    if not longer:
        return (a != b).sum(1) == 1
    front = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(1)
    back = np.logical_and.accumulate((a == b[:, 1 : n + 1])[:, ::-1], axis=1).sum(1)
    return front + back >= n


class Words:
    """Some words of one search, in order of rank: the most frequent first, equal ones by code points."""

    def __init__(self, words: list[str], n: np.ndarray):
        order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
        self.words = [words[k] for k in order]
        self.n = n[order]
        self.codes = count_codes(self.words)
        self.size = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.letters = letters_of(self.words) if self.size.max(initial=0) <= LONG else None
        self.near, self.best = np.zeros(len(words), np.int64), np.full(len(words), len(words) + 1 << 40)

    def take(self, mine: np.ndarray, rank: np.ndarray) -> None:
        self.near += np.bincount(mine, minlength=len(self.words))
        np.minimum.at(self.best, mine, rank)


def search(points: Words, queries: Words, longer: int, both: bool, leaf: int = 32, batch: int = 1 << 18) -> None:
    """Find all points that are a query with one letter replaced (``longer`` 0) or one more (1); each query takes what is near it, each point too if ``both``."""
    if not len(points.words) or not len(queries.words):
        return
    root, _ = build(points.codes, leaf, tight=True)
    for node, rows in reached(root, queries.codes, 1, 1 - longer):
        step = max(1, batch // len(node.points))
        for at in range(0, len(rows), step):
            q = rows[at : at + step]
            apart = np.bitwise_count(queries.codes[q][:, None, :] ^ points.codes[node.points][None, :, :]).sum(2, dtype=np.uint8)
            i, j = np.nonzero(apart <= 2 - longer)
            i, j = q[i], node.points[j]
            fits = points.size[j] == queries.size[i] + longer
            i, j = i[fits], j[fits]
            if not len(i):
                continue
            if points.letters is not None and queries.letters is not None:
                sizes = np.unique(queries.size[i])
                ok = np.zeros(len(i), bool)
                for n in sizes.tolist():
                    own = np.flatnonzero(queries.size[i] == n)
                    ok[own] = one_edit(queries.letters[i[own], :n], points.letters[j[own], : n + longer], n, longer)
            else:
                pairs = ((letters_of([queries.words[x]]), letters_of([points.words[y]])) for x, y in zip(i.tolist(), j.tolist()))
                ok = np.fromiter((bool(one_edit(a, b, a.shape[1], longer)[0]) for a, b in pairs), bool, len(i))
            i, j = i[ok], j[ok]
            queries.take(i, j)
            if both:
                points.take(j, i)


def near_words(words: DataFrame, cell: int = 1 << 16) -> DataFrame:
    """``(word, n_near, best_n, best)``: for each of the different ``(word, n)`` that has some, its near words, how many, and the one of largest n (ties: the smallest).

    Two words are near if one inserted, deleted or replaced letter tells them apart.  That moves letter counts by one or two, so
    for each length there is a k-d tree over counts, searched by the words of that length and of one letter less.  The upper splits, fitted on a bounded
    sample, deal all words out: each to its own box, and to those that its edits may reach; a box with more than ``cell`` words or as many searches is
    cut by hash into a grid of parts.  Each part builds the lower tree of its words and prunes its boxes; survivors are held against each other letter by letter.
    """
    words = words.withColumn("class", F.least(F.length("word"), F.lit(LONG)))
    total = {r["class"]: r["count"] for r in words.groupBy("class").count().collect()}  # LONG rows at most
    # About SAMPLE words by their hash, whatever the number of words and tasks.
    some = math.ceil((1 << 30) * min(1.0, SAMPLE / max(1, sum(total.values()))))
    drawn = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < some).select("word", "class").collect()
    trees: dict[int, Node] = {}
    for kind, n in total.items():
        own = [r["word"] for r in drawn if r["class"] == kind]
        # As many leaves as make cells of the wanted size, and some words of the sample in each.
        trees[kind] = build(count_codes(own), max(16, math.ceil(len(own) * cell / n)), tight=False)[0]
        _strip(trees[kind])
    placed_schema = pa.schema([("class", pa.int32()), ("leaf", pa.int32()), ("role", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n = batch.column(0).to_pylist(), batch.column(1)
            codes, size = count_codes(own), np.fromiter(map(len, own), np.int64, len(own))
            for kind in np.unique(np.minimum(size, LONG)).tolist():
                rows = np.flatnonzero(np.minimum(size, LONG) == kind)
                out = [(0, kind, homes(trees[kind], codes[rows]), rows)]
                # Role 1 looks for replaced letters, 2 for one letter more.
                searches = [(1, kind, 1, 1)] + [(2, k, 1, 0) for k in [min(kind + 1, LONG)] if k in trees]
                for role, k, more, fewer in searches:
                    out += [(role, k, np.full(len(hit), node.leaf), rows[hit]) for node, hit in reached(trees[k], codes[rows], more, fewer)]
                for role, k, leaf, at in out:
                    at = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(np.full(len(at), role, np.int32)), batch.column(0).take(at), n.take(at)], schema=placed_schema)

    placed = materialise(words.select("word", "n").mapInArrow(place, "class int, leaf int, role int, word string, n long"), "variants-placed")
    box = ["class", "leaf"]
    sizes = placed.groupBy(*box).agg(F.ceil(F.count_if(F.col("role") == 0) / cell).cast("int").alias("p"), F.ceil(F.count_if(F.col("role") > 0) / (4 * cell)).cast("int").alias("q")).where("p > 0 and q > 0")
    part = F.pmod(F.xxhash64("word"), F.when(F.col("role") == 0, F.col("p")).otherwise(F.col("q")).cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("role") == 0, F.col("q")).otherwise(F.col("p")) - 1))
    grid = placed.join(sizes, box).withColumn("own", part).withColumn("other", other)
    grid = grid.select(*box, F.when(F.col("role") == 0, F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("own")).alias("j"), "role", "word", "n")
    near_schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def compare(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        own = []
        for k in range(3):
            rows = table.filter(pa.array(role == k))
            own.append(Words(rows.column("word").to_pylist(), rows.column("n").to_numpy()))
        points, same, shorter = own
        search(points, same, 0, both=False)
        told = [_told(same, points)]
        search(points, shorter, 1, both=True)
        told += [_told(shorter, points), _told(points, shorter)]
        return pa.Table.from_arrays([pa.array([x for t in told for x in t[k]], f.type) for k, f in enumerate(near_schema)], schema=near_schema)

    found = grid.groupBy(*box, "i", "j").applyInArrow(compare, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def _strip(node: Node) -> None:
    """Without the sample's rows, as the tree goes to every task."""
    node.points = None
    for x in (node.below, node.above):
        if x:
            _strip(x)


def _told(words: Words, near: Words) -> list[list]:
    has = np.flatnonzero(words.near).tolist()
    best = words.best[has].tolist()
    return [[words.words[k] for k in has], words.near[has].tolist(), near.n[best].tolist(), [near.words[k] for k in best]]


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, every: int = 199, times: int = 5, cell: int = 1 << 16) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``word_counts``.

    form is the near word of largest n if that is at least ``times`` (2 or more) the word's own, else null; root is reached by following forms
    to the last, by doubling.  Empty tables and texts without words give no rows; other columns of ``docs`` are left out.
    """
    if times < 2:
        raise ValueError("forms must be more frequent than their variants")
    words = materialise(word_counts(docs, id_col, text_col, least_length, least_count, every), "variants-words")
    form = F.when(F.col("best_n") >= times * F.col("n"), F.col("best"))
    rows = words.join(near_words(words, cell), "word", "left").select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n"))
    rows = materialise(rows, "variants-forms")
    # No more words than a word has near ones share a form.
    step = rows.where("form is not null").select("word", F.col("form").alias("to"))
    for _ in range(_ROUNDS if times >= 5 else 2 * _ROUNDS):
        then = step.select(F.col("word").alias("to"), F.col("to").alias("after"))
        moved = materialise(step.join(then, "to", "left").select("word", F.coalesce("after", "to").alias("to"), F.col("after").isNotNull().alias("on")), "variants-roots")
        step = moved.select("word", "to")
        if not moved.where("on").limit(1).count():
            break
    return rows.join(step, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")

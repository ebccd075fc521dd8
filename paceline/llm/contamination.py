"""Benchmark decontamination by suffix arrays of the training texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm._spark import distinct, extended, read_block, slices, written_blocks

_CODES = np.arange(256)
_LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
_IS_WORD = ((_CODES >= 48) & (_CODES <= 57)) | ((_LOWER >= 97) & (_LOWER <= 122)) | (_CODES >= 128)
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII, in UTF-8."""
    return _WORDS((text or "").encode().translate(_LOWER.tobytes()))


class Vocabulary:
    """Exact numbers, from 1, of some words; very many words are looked up at once by their bytes, eight at a time."""

    def __init__(self, known: list[bytes]):
        states: list[int] = [0]  # the number of the word that ends in a state, or 0
        levels: list[dict[tuple[int, int], int]] = []
        for number, word in enumerate(known, 1):
            state = 0
            for depth, at in enumerate(range(0, len(word), 8)):
                if depth == len(levels):
                    levels.append({})
                key = (state, int.from_bytes(word[at : at + 8], "little"))
                if key not in levels[depth]:
                    levels[depth][key] = len(states)
                    states.append(0)
                state = levels[depth][key]
            states[state] = number
        self.number = np.array(states)
        self.levels = []
        for level in levels:
            chunks = np.array([c for _, c in level], np.uint64)
            values, at = np.unique(chunks, return_inverse=True)
            keys = np.fromiter((s for s, _ in level), np.int64, len(level)) * len(values) + at
            order = np.argsort(keys)
            self.levels.append((values, keys[order], np.fromiter(level.values(), np.int64, len(level))[order]))

    def numbers(self, letters: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number, or 0, of each word of ``size`` bytes at ``start``; at least eight bytes stand behind the last word."""
        eight = np.ndarray(len(letters) - 7, "<u8", letters, strides=(1,))
        out = np.zeros(len(start), np.int32)
        live, state = np.arange(len(start)), np.zeros(len(start), np.int64)
        for depth, (values, keys, then) in enumerate(self.levels):
            chunk = eight[start[live] + 8 * depth] & _KEEP[np.minimum(size[live] - 8 * depth, 8)]
            at = np.minimum(np.searchsorted(values, chunk), len(values) - 1)
            hit = values[at] == chunk
            live, state = live[hit], state[hit] * len(values) + at[hit]
            at = np.minimum(np.searchsorted(keys, state), len(keys) - 1)
            hit = keys[at] == state
            live, state = live[hit], then[at[hit]]
            end = size[live] <= 8 * (depth + 1)
            out[live[end]] = self.number[state[end]]
            live, state = live[~end], state[~end]
        return out


class Benchmark:
    """Words of test items, one item after the other, and the window that starts at each."""

    def __init__(self, names: list[str | None], texts: list[str | None], window: int):
        own = [(n or "", w) for n, t in zip(names, texts) if (w := words(t))]
        self.names = [n for n, _ in own]
        known = sorted({w for _, ws in own for w in ws})
        number = {w: k for k, w in enumerate(known, 1)}
        self.vocabulary = Vocabulary(known)
        size = np.array([len(ws) for _, ws in own], np.int64)
        self.ids = np.array([number[w] for _, ws in own for w in ws], np.int64)
        self.item = np.repeat(np.arange(len(own)), size)
        self.at = np.arange(len(self.ids)) - np.repeat(np.cumsum(size) - size, size)
        self.left = size[self.item] - self.at  # words to the item's end
        self.window = np.minimum(size, window)[self.item]
        self.least, self.longest = int(self.window.min(initial=window)), int(size.max(initial=0))


class Shard:
    """The words of some texts that stand one after the other."""

    def __init__(self, texts: pa.StringArray):
        texts = texts.fill_null("") if texts.null_count else texts
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        edge = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]]
        edge -= edge[0]
        self.letters = np.zeros(len(raw) + 8, np.uint8)
        np.take(_LOWER, raw, out=self.letters[: len(raw)])
        fits = np.zeros(len(raw) + 1, bool)
        np.take(_IS_WORD, raw, out=fits[:-1])
        first = fits[:-1].copy()
        first[1:] &= ~fits[:-2]
        last = fits[:-1] & ~fits[1:]
        border = edge[(edge > 0) & (edge < len(raw))]  # words end where a text does
        first[border], last[border - 1] = fits[border], fits[border - 1]
        self.start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.size = end - self.start
        self.text_start = np.searchsorted(self.start, edge)  # the first word of each text


class SuffixArray:
    """The sorted suffixes of the shard's words that may hold a window of ``tests``, and what the test suffixes find there.

    A word that no item holds ends every match, so only runs of the items' words as long as the shortest window are kept.
    Ranks by 1, 2, 4, ... words (of shard and tests together) sort the suffixes and, read backwards, give the words that any two have in common.
    """

    def __init__(self, shard: Shard, tests: Benchmark):
        self.tests = tests
        ids = tests.vocabulary.numbers(shard.letters, shard.start, shard.size)
        known = ids > 0
        opens = known.copy()
        opens[1:] &= ~known[:-1]
        opens[shard.text_start[:-1][shard.text_start[:-1] < len(ids)]] = True
        run_start = np.flatnonzero(opens & known)
        closes = np.append(np.flatnonzero(~known | opens), len(ids))
        run_end = closes[np.searchsorted(closes, run_start, "right")]
        long = run_end - run_start >= tests.least
        run_start, size = run_start[long], (run_end - run_start)[long]
        self.n = n = int(size.sum())
        first = np.repeat(np.cumsum(size) - size, size)
        self.word = np.arange(n) - first + np.repeat(run_start, size)  # the shard's word of each position
        self.left = np.concatenate([np.repeat(size, size) - (np.arange(n) - first), tests.left])
        rank = np.unique(np.concatenate([ids[self.word].astype(np.int64), tests.ids]), return_inverse=True)[1] + 1
        self.ranks = [rank]
        while 1 << len(self.ranks) <= tests.longest and n:
            step = 1 << len(self.ranks) - 1
            behind = np.where(self.left > step, np.append(rank[step:], np.zeros(min(step, len(rank)), np.int64)), 0)
            rank = np.unique(rank * (len(rank) + 2) + behind, return_inverse=True)[1] + 1
            self.ranks.append(rank)
        # The last ranks cover as many words as a longest item has, so no match is longer than what they sort by.
        step = 1 << len(self.ranks) - 1
        behind = np.where(self.left > step, np.append(rank[step:], np.zeros(min(step, len(rank)), np.int64)), 0)
        order = rank * (len(rank) + 2) + behind
        self.order = np.argsort(order[:n], kind="stable")
        self.shared = np.append(0, self.common(self.order[:-1], self.order[1:])) if n else np.zeros(0, np.int64)
        place = np.searchsorted(order[self.order], order[n:])  # binary search of every test suffix
        test = np.arange(n, n + len(tests.ids))
        below, above = np.maximum(place - 1, 0), np.minimum(place, n - 1)
        if n:
            low, high = (self.common(test, self.order[x]) for x in (below, above))
            self.near, self.length = np.where(high >= low, above, below), np.maximum(low, high)
        else:
            self.near = self.length = np.zeros(len(test), np.int64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at two positions have in common."""
        out = np.zeros(len(a), np.int64)
        top = len(self.left) - 1
        for k in range(len(self.ranks) - 1, -1, -1):
            step = 1 << k
            fits = (self.left[a] - out >= step) & (self.left[b] - out >= step)
            out += step * (fits & (self.ranks[k][np.minimum(a + out, top)] == self.ranks[k][np.minimum(b + out, top)]))
        return out

    def windows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length of window ``(length, words at which windows occur, their group, groups of tests, tests' items)``.

        Suffixes that share a window stand together in the array; each such group has the items whose windows it equals.
        """
        for w in np.unique(self.tests.window).tolist():
            test = np.flatnonzero((self.tests.window == w) & (self.tests.left >= w) & (self.length >= w))
            if not len(test):
                continue
            group = np.cumsum(self.shared < w)
            mine = group[self.near[test]]
            hit = np.flatnonzero(np.isin(group, mine))
            yield w, self.word[self.order[hit]], group[hit], mine, self.tests.item[test]


def _benchmarks(blocks: list[list[str]], window: int) -> Iterator[Benchmark]:
    """The test items, a few MB of text at a time."""
    for block in blocks:
        for part in slices(iter(read_block(block).combine_chunks().to_batches()), "text", 8 << 20):
            yield Benchmark(part.column(0).to_pylist(), part.column(1).to_pylist(), window)


_held: dict[str, Benchmark] = {}


def _each_benchmark(blocks: list[list[str]], window: int) -> Iterator[Benchmark]:
    """The same; where there is but one part, each Python worker keeps it."""
    name = f"{blocks} {window}"
    if name in _held:
        yield _held[name]
        return
    found, n = None, 0
    for n, found in enumerate(_benchmarks(blocks, window), 1):
        yield found
    if n == 1:
        _held.clear()
        _held[name] = found


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> list[list[str]]:
    rows = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").alias("text"))
    return written_blocks(rows, "benchmark", 1 << 14)


def _found(texts: pa.Array, blocks: list[list[str]], window: int) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """For each text its words, the stretches of them (start, end) that windows of items cover, and these items' ids."""
    shard = Shard(texts)
    hit = np.zeros(len(shard.start), bool)
    items: list[set[str]] = [set() for _ in range(len(texts))]
    for tests in _each_benchmark(blocks, window):
        if not len(tests.ids):
            continue
        for w, at, group, of_group, item in SuffixArray(shard, tests).windows():
            for k in range(w):
                hit[at + k] = True
            text = np.searchsorted(shard.text_start, at, "right") - 1
            # (text, group) once each, then the group's items.
            size = int(max(group.max(), of_group.max())) + 1
            text, group = np.divmod(distinct(text * size + group), size)
            pair = distinct(of_group * len(tests.names) + item)
            of_group, item = np.divmod(pair, len(tests.names))
            low, high = np.searchsorted(of_group, group), np.searchsorted(of_group, group, "right")
            for t, i, j in zip(text.tolist(), low.tolist(), high.tolist()):
                items[t].update(tests.names[x] for x in item[i:j].tolist())
    first = hit.copy()
    first[1:] &= ~hit[:-1]
    last = hit.copy()
    last[:-1] &= ~hit[1:]
    inner = shard.text_start[(shard.text_start > 0) & (shard.text_start < len(hit))]
    first[inner], last[inner - 1] = hit[inner], hit[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    low, high = np.searchsorted(start, shard.text_start[:-1]), np.searchsorted(start, shard.text_start[1:])
    spans = [list(zip((start[i:j] - t).tolist(), (end[i:j] - t).tolist())) if i < j else [] for i, j, t in zip(low.tolist(), high.tolist(), shard.text_start.tolist())]
    return np.diff(shard.text_start), spans, [sorted(x) for x in items]


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shard_bytes: int = 8 << 20) -> DataFrame:
    """``(doc_id, n_words, spans array<struct<start, end>>, items array<string>)`` for every row of ``docs``.

    A window is ``window`` consecutive words of an item, or a whole shorter item; spans are the stretches of a text's words
    (end exclusive) that any occurrence of a window covers, items the sorted ids of items with an occurring window.  Each task
    makes suffix arrays of shards of about ``shard_bytes`` of text, and every test suffix is searched in each of them by binary search, so documents are not
    shuffled; the benchmark comes from the shared folder in blocks, whatever its size.  Null texts have no words; repeated
    rows and null ids stay; repeated item ids count once, a null one is the empty string; items without words and empty tables match nothing; other columns are left out.
    """
    blocks = _items(benchmark, item_col, item_text_col)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", shard_bytes):
            n, spans, items = _found(part.column(1), blocks, window)
            spans = pa.array([[{"start": i, "end": j} for i, j in x] for x in spans], schema.field(2).type)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), spans, pa.array(items, schema.field(3).type)], schema=schema)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, spans array<struct<start: long, end: long>>, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shard_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` in whose text no window of an item occurs, with all their columns; see ``find_contamination``."""
    blocks = _items(benchmark, item_col, item_text_col)
    return extended(docs, text_col, lambda: lambda texts: ([], [not x for x in _found(texts, blocks, window)[1]]), [], shard_bytes)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shard_bytes: int = 8 << 20) -> DataFrame:
    """``(item_id, length, item_start, doc_id, doc_start)``: each item's longest verbatim match in all of ``docs``, in words, and a place where it stands.

    Matches shorter than the shortest window of the items are not looked for; items without a match have no row.  Of equally long matches that at
    the least item_start counts, and of the places found in the shards that with the least doc_id (null last) and doc_start.
    """
    blocks = _items(benchmark, item_col, item_text_col)
    schema = pa.schema([("item_id", pa.string())] + [(n, pa.int64()) for n in ("length", "item_start", "doc_id", "doc_start")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", shard_bytes):
            shard, ids = Shard(part.column(1)), part.column(0)
            for tests in _each_benchmark(blocks, window):
                if not len(tests.ids):
                    continue
                found = SuffixArray(shard, tests)
                # The first test suffix of the greatest length for each item.
                order = np.lexsort((tests.at, -found.length, tests.item))
                best = order[np.append(True, tests.item[order][1:] != tests.item[order][:-1])]
                best = best[found.length[best] >= tests.least]
                if not found.n or not len(best):
                    continue
                word = found.word[found.order[found.near[best]]]
                text = np.searchsorted(shard.text_start, word, "right") - 1
                out = [[tests.names[i] for i in tests.item[best].tolist()], found.length[best], tests.at[best], ids.take(pa.array(text)), word - shard.text_start[text]]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    each = rows.mapInArrow(run, "item_id string, length long, item_start long, doc_id long, doc_start long")
    order = F.struct(-F.col("length"), "item_start", F.col("doc_id").isNull(), "doc_id", "doc_start")
    return each.groupBy("item_id").agg(F.min_by(F.struct("length", "item_start", "doc_id", "doc_start"), order).alias("m")).select("item_id", "m.*")


def contamination_summary(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``find_contamination`` as numbers: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    found = find_contamination(docs, benchmark, **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))

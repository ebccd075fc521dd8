"""Best-fit packing of documents into token sequences."""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paceline.llm._spark import slices
from paceline.llm.vocab import END_OF_WORD, read_ranks, split_added

_MARK = END_OF_WORD.decode()
# Characters that Python's split() takes for white space but the tokenizer does not.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class WordIds(dict):
    """Little-endian uint32 ids of white-space-free words, remembered by word.

    Lower-case word BPE: a word falls into letter runs, single digits and symbol runs, and each
    of these ends in an end-of-word mark, which is a byte of its own here, so that a plain byte
    BPE gives the same ids.
    """

    def __init__(self, path: str, most: int = 300_000):
        super().__init__()
        self.most = most
        ranks, self.added = read_ranks(path)
        self.bpe = tiktoken.Encoding("words", pat_str=f"[^{_MARK}]*{_MARK}", mergeable_ranks=ranks, special_tokens={})
        self.plain = Tokenizer.from_file(path)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if _MARK in word:
            ids = self.plain.encode(word, add_special_tokens=False).ids
        else:
            low = (word if word.isascii() else unicodedata.normalize("NFC", word).replace("Σ", "σ")).lower()
            if low.isalpha():
                low += _MARK
            elif low[-1] in ".," and low[:-1].isalpha():
                low = f"{low[:-1]}{_MARK}{low[-1]}{_MARK}"
            else:
                low = "".join(p + _MARK for p in _PIECES.findall(low))
            ids = self.bpe.encode_ordinary(low)
        self[word] = out = array("I", ids).tobytes()
        return out

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as the library gives them without special tokens, as little-endian uint32."""
        if any(c in text for c in _NOT_SPACE):
            return array("I", self.plain.encode(text, add_special_tokens=False).ids).tobytes()
        if "<|" not in text:
            return b"".join([self[w] for w in text.split()])
        parts = split_added(text, self.added)
        return b"".join(b"".join([self[w] for w in t.split()]) + (array("I", [k]).tobytes() if k is not None else b"") for t, k in parts)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for each Python worker and vocabulary."""
    return WordIds(path)


class BestFit:
    """Bounded-space online best fit: at most ``most_open`` bins, found by a bitset of their free space."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.bits, self.bins, self.open, self.made = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _take(self, free: int) -> int:
        own = self.bins[free]
        found = own.pop()
        if not own:
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for an item: in the open bin that it leaves the least space in, else in a new bin."""
        fit = self.bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            found = self._take(free)
        else:
            if self.open >= self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            found, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            self.bins[left].append(found)
            self.bits |= 1 << left
            self.open += 1
        return found, self.capacity - free


def token_pieces(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, keep_ids: bool = False, open_bins: int | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each document's ids and a final 0, cut only where longer than ``limit``.

    A null or empty text is the single id 0; repeated rows and null ids stay; an empty table gives no rows; other columns are left out.
    With ``open_bins`` each task also packs the pieces that it makes, in an order fixed by the rows' hashes, which adds ``sequence_id, offset``.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * keep_ids)
    spots = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64())] if open_bins else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(vocab_path)
        place = placing(limit, open_bins) if open_bins else None
        for part in slices(batches, "text", 4 << 20):
            out: list[list] = [[] for _ in range(5)]
            kept: list[bytes] = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = words.encode(text or "") + b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                    own = ids[at : at + 4 * limit]
                    for column, x in zip(out, (doc, piece, at // 4, len(own) // 4, zlib.crc32(own))):
                        column.append(x)
                    if keep_ids:
                        kept.append(own)
            arrays = [pa.array(x, f.type) for x, f in zip(out, schema)]
            if keep_ids:
                ends = np.cumsum([0, *out[3]]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(kept), "<i4"))))
            yield pa.RecordBatch.from_arrays(arrays + (place(out[3]) if place else []), names=[*schema.names, *spots.names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if open_bins:
        rows = rows.sortWithinPartitions(F.xxhash64("doc_id", "text"), "doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long" * bool(open_bins))


def placing(limit: int, open_bins: int) -> Callable[[list[int]], list[pa.Array]]:
    """Within a task: sequences and offsets for one list of lengths after the other.  A sequence belongs to its task."""
    base, bins = TaskContext.get().partitionId() << 40, BestFit(limit, open_bins)

    def place(lengths: list[int]) -> list[pa.Array]:
        found = [bins.place(n) for n in lengths]
        return [pa.array([base + b for b, _ in found], pa.int64()), pa.array([o for _, o in found], pa.int64())]

    return place


def pack(pieces: DataFrame, limit: int = 2048, open_bins: int = 1024) -> DataFrame:
    """``pieces`` (rows with ``length`` from 1 to ``limit``) with ``sequence_id`` and ``offset``.

    The rows, which carry lengths and no text (and ids only if they have them), are dealt out by hash and packed in hash order,
    a fixed random order, so that a task that runs again packs alike.  A sequence
    belongs to one task: its id is the task's number times 2^40 plus a count.  Memory is
    ``open_bins`` bins, whatever the input.
    """
    keys = [F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    kept = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset")]
    out_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = placing(limit, open_bins)
        for batch in batches:
            spots = place(batch.column(batch.schema.get_field_index("length")).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *spots], names=[*batch.schema.names, "sequence_id", "offset"])

    rows = pieces.select(*(F.col(f"`{f.name}`") for f in kept)).repartition(keys[0]).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, out_ddl)


def pack_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, open_bins: int = 1024, keep_ids: bool = False, in_place: bool = False) -> DataFrame:
    """Documents as token sequences of at most ``limit`` ids: one row per piece.

    ``doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset``.  A null or empty text is the single
    id 0; repeated rows and null ids are packed like any others; an empty table gives no rows;
    other columns are left out.  With ``in_place`` each task packs the documents that it reads, so that kept ids are not
    shuffled: its last open bins are then filled less well, which costs less the more text a task reads.
    """
    if in_place:
        return token_pieces(docs, vocab_path, id_col, text_col, limit, keep_ids, open_bins)
    return pack(token_pieces(docs, vocab_path, id_col, text_col, limit, keep_ids), limit, open_bins)

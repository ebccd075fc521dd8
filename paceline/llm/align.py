"""Alignment of two tokenizers over the same texts."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from paceline.llm._spark import distinct, materialise, read_block, slices, written_blocks
from paceline.llm.tokencount import _PIECES
from paceline.llm.vocab import read_ranks

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Fixed value: the characters with the White_Space property, at which the byte-level pattern parts words.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
SPACE = "▁"
_JOIN = 1 << 16  # characters of new units that are encoded at once


def terminal_tokens(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B the A token at which its component ends, from the tokens' byte ends in one text.

    Every token points to its farthest-right overlapping token of the other side (an A token that ends with its B
    token to itself); doubling all pointers at once until they stay the same leads each to its component's last A token.
    """
    n = len(end_a)
    last_b, last_a = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)
    to = np.concatenate([np.where(end_b[last_b] > end_a, n + last_b, np.arange(n)), last_a])
    while True:
        further = to[to]
        if (further == to).all():
            return to[:n], to[n:]
        to = further


def linked_tokens(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (A token, B token) of all pairs whose byte ranges overlap, in order."""
    first = np.searchsorted(end_b, np.append(0, end_a[:-1]), "right")
    size = np.searchsorted(end_b, end_a) - first + 1
    a = np.repeat(np.arange(len(end_a)), size)
    return a, np.arange(len(a)) + np.repeat(first - np.cumsum(size) + size, size)


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0..most with room for one more character, and how many characters that is."""
    names = [str(k) for k in range(most + 1)]
    size = np.fromiter(map(len, names), np.int64, len(names)) + 1
    return np.frombuffer("".join(x.ljust(size.max()) for x in names).encode(), np.uint8).reshape(len(names), -1), size


class Numbers(dict):
    """Running numbers of units; those asked for the first time also stand in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


def _byte_level(path: str, ranks: dict[bytes, int]) -> Callable[[str], list[int]]:
    """The encoding of a ``tokenizers`` file, strings of special tokens as plain text; by the faster library if ids follow the order of merges."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    order = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
    if spec["pre_tokenizer"].get("type") == "ByteLevel" and spec["normalizer"] is None and order == sorted(order):
        return tiktoken.Encoding(path, pat_str=_PIECES.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


class Aligner:
    """Tokens, links and groups of units of text, each unit aligned once.

    A unit is a run of white space with what follows up to the next one.  Neither tokenizer has a token that reaches over a
    unit's border: the byte-level pattern parts there, and no piece holds white space behind other characters (where the
    model has such pieces, as with carriage returns, the runs with these characters do not part units).  So a text's alignment is a row of its
    units' alignments.  ``table`` holds a row for each unit: tokens of A, of B, groups, links, and whether the unit can be aligned.
    """

    def __init__(self, path_a: str, path_b: str):
        ranks, added = read_ranks(path_a)
        self.a = _byte_level(path_a, ranks)
        raw_a = [b""] * (max([*ranks.values(), *added.values()]) + 1)
        for token, k in ranks.items():
            raw_a[k] = token
        self.b = sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        raw_b = [bytes([int(x[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        self.raw = raw_a, raw_b
        self.size = tuple(np.fromiter(map(len, r), np.int64, len(r)) for r in self.raw)
        self.digits = _digits(max(len(raw_a), len(raw_b)))
        odd = {" "} if any(SPACE in x.lstrip(SPACE) for x in names) else set()
        odd |= {c for x in names if len(x) > 1 for c in x if c in WHITE}
        some, rest = re.escape("".join(sorted(odd))), re.escape("".join(c for c in WHITE if c not in odd))
        tail = f"(?:[{rest}]*[{some}][{WHITE}]*[^{WHITE}]*)*" if odd else ""
        self.units = re.compile(f"[{WHITE}]*[^{WHITE}]+{tail}|[{WHITE}]+").findall
        self.plain = re.compile(f"[{rest}]+[^{WHITE}{SPACE}]+").fullmatch
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbers()
        self.table = np.zeros((0, 5), np.int64)
        self.pairs, self.pair_start = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.text: list[bytes] = []

    def _one(self, unit: str) -> tuple[list[int], list[int]] | None:
        """Token ids of one unit, or None if their bytes are not the unit's."""
        a = self.a(unit)
        if unit[0] == " ":
            b = self.b.encode(unit[1:]) if len(unit) > 1 else self.b.encode("x ")[-1:]
        else:  # the model sets a space before a text; a letter before the unit parts them
            b = self.b.encode("x" + unit)[len(self.b.encode("x")) :]
        whole = unit.encode()
        return (a, b) if b"".join(self.raw[0][k] for k in a) == whole == b"".join(self.raw[1][k] for k in b) else None

    def _joined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Token ids of plain units, encoded as one text; None if bytes differ."""
        text = " x" + "".join(units)
        both = []
        for ids, raw, size in ((self.a(text), self.raw[0], self.size[0]), (self.b.encode(text[1:]), self.raw[1], self.size[1])):
            if b"".join(map(raw.__getitem__, ids)) != text.encode():
                return None
            ids = np.array(ids, np.int64)
            both.append(ids[np.cumsum(size[ids]) > 2])
        return both[0], both[1]

    def _parts(self, units: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, bool]]:
        """New units in groups with their token ids, and whether they can be aligned."""
        held, room = [], _JOIN
        for u in units:
            if self.plain(u):
                held.append(u)
                room -= len(u)
            else:
                if held:
                    yield from self._flush(held)
                    held, room = [], _JOIN
                yield from self._flush([u])
            if room <= 0:
                yield from self._flush(held)
                held, room = [], _JOIN
        if held:
            yield from self._flush(held)

    def _flush(self, units: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, bool]]:
        if len(units) > 1 and (both := self._joined(units)):
            yield units, *both, True
            return
        for u in units:
            found = self._one(u)
            yield [u], *(np.array(x, np.int64) for x in found or ([], [])), found is not None

    def learn(self) -> None:
        """Align the units that were numbered since the last call."""
        new, self.numbers.new = self.numbers.new, []
        if not new:
            return
        parts = list(self._parts(new))
        ida, idb = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        ok = np.repeat([p[3] for p in parts], [len(p[0]) for p in parts])
        width = np.fromiter((len(u.encode()) for u in new), np.int64, len(new)) * ok
        unit_end = np.cumsum(width)
        end_a, end_b = np.cumsum(self.size[0][ida]), np.cumsum(self.size[1][idb])
        of_a, of_b = np.searchsorted(unit_end, end_a), np.searchsorted(unit_end, end_b)
        if len(ida):
            last_a, last_b = terminal_tokens(end_a, end_b)
            at_a, at_b = linked_tokens(end_a, end_b)
        else:
            last_a = last_b = at_a = at_b = np.zeros(0, np.int64)
        ends = np.flatnonzero(last_a == np.arange(len(ida)))  # the terminal tokens, one for each group
        count = lambda x: np.bincount(x, minlength=len(new))
        links = count(of_a[at_a])
        self.table = np.concatenate([self.table, np.stack([count(of_a), count(of_b), count(of_a[ends]), links, ok], 1)])
        self.pairs = np.concatenate([self.pairs, ida[at_a] << 32 | idb[at_b]])
        self.pair_start = np.concatenate([self.pair_start, self.pair_start[-1] + np.cumsum(links)])
        # The groups' text: numbers by group, A before B, each followed by its sign.
        ids, group, side = np.concatenate([ida, idb]), np.concatenate([last_a, last_b]), np.repeat([0, 1], [len(ida), len(idb)])
        order = np.argsort(group << 1 | side, kind="stable")
        ids, group, side = ids[order], group[order], side[order]
        after = np.append(group[1:] << 1 | side[1:], -1)
        sign = np.where(after == (group << 1 | side), ord(","), np.where(side == 0, ord("|"), ord(";")))
        letters, size = self.digits[0][ids], self.digits[1][ids]
        letters[np.arange(len(ids)), size - 1] = sign
        flat = letters[np.arange(letters.shape[1]) < size[:, None]].tobytes()
        unit_of = np.concatenate([of_a, of_b])[order]
        cut = np.cumsum(np.bincount(unit_of, weights=size, minlength=len(new)).astype(np.int64)).tolist()
        self.text.extend(flat[i:j] for i, j in zip([0, *cut[:-1]], cut))

    def slice_of(self, texts: list[str | None], most_units: int = 400_000, most_pairs: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(units of all texts one after the other, where each text's begin and the last ends, whether a text can be aligned)."""
        if len(self.numbers) > most_units or len(self.pairs) > most_pairs:
            self.clear()
        own = [list(map(self.numbers.__getitem__, self.units(" " + t))) if t else [] for t in texts]
        self.learn()
        start = np.append(0, np.cumsum(np.fromiter(map(len, own), np.int64, len(own))))
        units = np.fromiter(chain.from_iterable(own), np.int64, start[-1])
        bad = np.append(0, np.cumsum(self.table[units, 4] == 0))
        return units, start, (bad[start[1:]] == bad[start[:-1]]) & (start[1:] > start[:-1])

    def pairs_of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pairs linked in ``units``, one unit after the other, how many in each)."""
        size = self.table[units, 3]
        first = self.pair_start[units]
        at = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
        return self.pairs[at], size


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each Python worker."""
    return Aligner(path_a, path_b)


def _sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values))
    return total[start[1:]] - total[start[:-1]]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def link_counts(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """``(a, b, n_docs, best)``: in how many rows of ``docs`` token ids a and b are linked, and whether no pair of a has a greater count.

    Pairs are counted within each slice of texts before they are shuffled.  Null and empty texts and those whose
    tokens do not spell a space and the text have no links; repeated rows count each; no links give no rows.
    """
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for part in slices(batches, "text"):
            units, start, fine = own.slice_of(part.column(0).to_pylist())
            doc = np.repeat(np.arange(len(fine)), np.diff(start))
            doc, units = doc[fine[doc]], units[fine[doc]]
            if not len(units):
                continue
            # Units once for each text, then pairs once for each text.
            each = distinct(doc * len(own.table) + units)
            doc, units = np.divmod(each, len(own.table))
            pairs, size = own.pairs_of(units)
            named, code = np.unique(pairs, return_inverse=True)
            once = distinct(np.repeat(doc, size) * len(named) + code)
            yield pa.RecordBatch.from_arrays([pa.array(named), pa.array(np.bincount(once % len(named), minlength=len(named)))], schema=schema)

    found = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n_docs"))
    # At most one row for each token of B in a window.
    found = materialise(found.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n_docs"), "link-counts")
    return found.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))


class Counts:
    """Link counts as sorted arrays, read from the shared folder a block at a time; the last block stays in memory."""

    def __init__(self, blocks: list[list[str]]):
        self.blocks, self.held = blocks, (-1, None)

    def _block(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.held[0] != k:
            self.held = (-1, None)
            rows = read_block(self.blocks[k])
            a, b, n, best = (rows.column(c).to_numpy() for c in ("a", "b", "n_docs", "best"))
            key = a << 32 | b
            order = np.argsort(key)
            self.held = k, (key[order], n[order], best[order])
        return self.held[1]

    def of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether it is its A id's highest) of sorted ``pairs``."""
        n, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        for k in sorted(range(len(self.blocks)), key=lambda k: k != self.held[0]):
            key, count, top = self._block(k)
            at = np.minimum(np.searchsorted(key, pairs), len(key) - 1)
            hit = key[at] == pairs
            n[hit], best[hit] = count[at[hit]], top[at[hit]]
        return n, best


_counts: dict[str, Counts] = {}


def _counts_of(blocks: list[list[str]]) -> Counts:
    """One table for each Python worker."""
    name = str(blocks[:1])
    if name not in _counts:
        _counts.clear()
        _counts[name] = Counts(blocks)
    return _counts[name]


def _mapped(rows: DataFrame, path_a: str, path_b: str, schema: pa.Schema, ddl: str, make: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, work = aligner(path_a, path_b), make()
        for part in slices(batches, "text"):
            units, start, fine = own.slice_of(part.column(1).to_pylist())
            told = [np.where(fine, _sums(own.table[units, k], start), 0) for k in range(4)]
            text = [b"".join(map(own.text.__getitem__, units[i:j].tolist()))[:-1] if ok else b"" for i, j, ok in zip(start[:-1].tolist(), start[1:].tolist(), fine.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([part.column(0), *told, *work(own, units, start, fine, text)], schema)], schema=schema)

    return rows.mapInArrow(run, ddl)


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups array<struct<a array<int>, b array<int>>>)``: every row's token groups in order.

    A is a byte-level ``tokenizers`` file and encodes a space and the text, B a SentencePiece model that sets that space itself.
    Null and empty texts, and texts whose tokens' bytes do not spell a space and the text (as U+2581 does to B), have zeros and no groups;
    repeated rows and null ids stay; an empty table gives no rows; other columns are left out; texts are taken whole.
    """
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [("told", pa.string())])
    out = _mapped(_rows(docs, id_col, text_col), path_a, path_b, schema, "doc_id long, n_a long, n_b long, n_groups long, n_links long, told string", lambda: lambda own, units, start, fine, text: [[t.decode() for t in text]])
    ids = T.ArrayType(T.IntegerType())
    both = lambda g: F.struct(F.split(F.split_part(g, F.lit("|"), F.lit(1)), ",").cast(ids).alias("a"), F.split(F.split_part(g, F.lit("|"), F.lit(2)), ",").cast(ids).alias("b"))
    empty = F.array().cast(T.ArrayType(T.StringType()))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.transform(F.when(F.col("told") == "", empty).otherwise(F.split("told", ";")), both).alias("groups"))


def alignment_summary(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = 2_000_000) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row.

    A first pass counts linked id pairs over all rows (``link_counts``); the second aligns again, which is cheaper than writing tokens, and
    looks up each slice's pairs in blocks of at most ``most_pairs`` counts.  n_best are the links whose count is their A id's highest, ties
    included, count_sum the sum of the links' counts; groups_sha256 names the groups as ``a1,a2|b1;a3|b2,b3``.  Rows without tokens (see
    ``align_documents``) have zeros and the empty string; repeated rows and null ids stay; an empty table gives no rows; other columns are left out.
    """
    found = link_counts(docs, path_a, path_b, text_col)
    n = max(1, -(-found.count() // most_pairs))
    blocks = written_blocks(found.repartitionByRange(n, "a", "b"), "link-blocks", most_pairs)
    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string())])

    def make() -> Callable:
        counts = _counts_of(blocks)

        def work(own: Aligner, units: np.ndarray, start: np.ndarray, fine: np.ndarray, text: list[bytes]) -> list:
            each, at = np.unique(units, return_inverse=True)
            pairs, size = own.pairs_of(each)
            named, code = np.unique(pairs, return_inverse=True)
            ends = np.append(0, np.cumsum(size))
            own_sum, own_best = (_sums(x[code], ends)[at] for x in counts.of(named))
            return [np.where(fine, _sums(x, start), 0) for x in (own_best, own_sum)] + [[hashlib.sha256(t).hexdigest() if t else "" for t in text]]

        return work

    return _mapped(_rows(docs, id_col, text_col), path_a, path_b, schema, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string", make)

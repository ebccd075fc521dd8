"""Exact token counts at every prefix of a text."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm._spark import mapper
from paceline.llm.vocab import read_ranks, split_added

# Fixed value: the split pattern of the byte-level BPE files.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
_UNITS = re.compile(r"\s*+\S+|\s+")
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_UNITS_STRICT = re.compile(f"[{_SPACE}]*+[^{_SPACE}]+|[{_SPACE}]+")
_NOT_SPACE = "\x1c\x1d\x1e\x1f"


class Totals(dict):
    """The last entry of each unit's table."""

    def __init__(self, tables: PrefixCounts):
        super().__init__()
        self.tables = tables

    def __missing__(self, unit: str) -> int:
        if len(self) >= self.tables.most:
            self.clear()
        self[unit] = last = int.from_bytes(self.tables[unit][-4:], "little")
        return last


class PrefixCounts(dict):
    """Token counts at each byte of a unit (white space, then a run without it), remembered by unit.

    Byte-pair encoding has one last token for each prefix of a piece: the token ``t`` ending there
    that may follow the last token of the prefix before it.  So one pass gives
    ``count[i] = count[i - len(t)] + 1`` for every ``i``, without encoding any prefix anew.
    """

    def __init__(self, path: str, most: int = 500_000):
        super().__init__()
        self.most = most
        self.rank, self.added = read_ranks(path)
        # Finds the tokens that end at each byte, longest first.
        self.ending = ahocorasick.Automaton()
        for token, k in self.rank.items():
            self.ending.add_word(token.decode("latin-1"), (len(token), k))
        self.ending.make_automaton()
        self.follows: dict[int, bool] = {}
        self.pieces: dict[bytes, list[int]] = {}
        self.totals = Totals(self)
        # How the merges build each token: ids in order of rank, the two parts being the last pair left.
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for token, k in sorted(self.rank.items(), key=lambda x: x[1]):
            if len(token) > 1 and (two := self._merge(token, k)):
                self.parts[k], self.joined[two] = two, k

    def _merge(self, token: bytes, below: int) -> tuple[int, int] | None:
        """The two tokens that remain of ``token`` by merges of a rank lower than its own."""
        own = [self.rank[token[i : i + 1]] for i in range(len(token))]
        while len(own) > 2:
            best = min(((self.joined.get((a, b), below), i) for i, (a, b) in enumerate(zip(own, own[1:]))), default=(below, 0))
            if best[0] >= below:
                return None
            own[best[1] : best[1] + 2] = [best[0]]
        return own[0], own[1]

    def may_follow(self, first: int, second: int) -> bool:
        """Whether the text of the two tokens encodes to just these two.

        No merge across their border may come before the merges that made them: undo the later-made side
        step by step and look up each pair that met at the border.
        """
        key = first << 20 | second
        known = self.follows.get(key)
        if known is not None:
            return known
        a, b, bound, ok = first, second, 1 << 40, True
        while True:
            made = self.joined.get((a, b))
            if made is not None and made < bound:
                ok = False
                break
            left, right = self.parts.get(a), self.parts.get(b)
            if left is None and right is None:
                break
            if right is None or (left is not None and a > b):
                bound, a = a, left[1]
            else:
                bound, b = b + 1, right[0]
        if len(self.follows) > 4 * self.most:
            self.follows.clear()
        self.follows[key] = ok
        return ok

    def of_piece(self, piece: bytes) -> list[int]:
        found = self.pieces.get(piece)
        if found is not None:
            return found
        known, n = self.follows.get, len(piece)
        last, count, done = [0] * (n + 1), [0] * (n + 1), -1
        for at, (size, t) in self.ending.iter(piece.decode("latin-1")):
            if at == done:
                continue
            start = at + 1 - size
            if start:
                before = last[start]
                ok = known(before << 20 | t)
                if not (self.may_follow(before, t) if ok is None else ok):
                    continue
            last[at + 1], count[at + 1], done = t, count[start] + 1, at
        if len(self.pieces) >= self.most:
            self.pieces.clear()
        self.pieces[piece] = out = count[1:]
        return out

    def _fine(self, text: str) -> list[int]:
        """Counts of a unit with no more than one leading space."""
        body = text[1:] if text[0] == " " else text
        if body.isalpha():
            return self.of_piece(text.encode())
        pieces = [text[:-1], text[-1]] if body[-1] in ".," and body[:-1].isalpha() else _PIECES.findall(text)
        out: list[int] = []
        for p in pieces:
            own, base = self.of_piece(p.encode()), out[-1] if out else 0
            if p in _LONG_CONTRACTIONS:
                own = [1, 2, own[2]]  # cut short, it is a symbol and a letter
            out += [base + x for x in own] if base else own
        return out

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        body = unit.lstrip(_SPACE_CHARS)
        white = unit[: len(unit) - len(body)]
        if not body:
            out = self.of_piece(white.encode())
        elif len(white) < 2 and white in ("", " "):
            out = self._fine(unit)
        else:
            # Up to its end the white space is one piece; a word then takes its last character away.
            run, rest = self.of_piece(white.encode()), white[:-1].encode()
            base = self.of_piece(rest)[-1] if rest else 0
            tail = self._fine(" " + body)[1:] if white[-1] == " " else [x + self.of_piece(white[-1].encode())[-1] for x in self._fine(body)]
            out = run + [base + x for x in tail]
        self[unit] = got = array("I", out).tobytes()
        return got

    def units(self, text: str) -> list[str]:
        return (_UNITS_STRICT if any(c in text for c in _NOT_SPACE) else _UNITS).findall(text)

    def within(self, text: str, budget: int) -> tuple[int, int]:
        """(tokens of ``text``, bytes of its longest prefix, ending where a character ends, of at most ``budget`` tokens).

        Read from the units' tables: totals add up, and only the unit in which the budget ends is looked up byte by byte.
        Each entry of a unit is 1 at least, so no later unit can hold that end.
        """
        if any(s in text for s in self.added):
            prefix = self.prefixes(text)
            return int(prefix[-1]), bytes_within(text.encode(), prefix, budget)
        units = self.units(text)
        own = list(map(self.totals.__getitem__, units))
        total = sum(own)
        if total <= budget:
            return total, len(text.encode())
        if budget < 1:
            return total, 0
        ends = list(accumulate(own))
        k = bisect_left(ends, budget)  # the first unit to reach the budget starts below it
        base = ends[k] - own[k]
        local = np.frombuffer(self[units[k]], "<u4").astype(np.int64) + base
        return total, len("".join(units[:k]).encode()) + bytes_within(units[k].encode(), local, budget)

    def ordinary(self, text: str) -> np.ndarray:
        """Counts at each byte of a text without added tokens."""
        units = self.units(text)
        if not units:
            return np.zeros(0, np.int64)
        own = [self[u] for u in units]
        size = np.fromiter(map(len, own), np.int64, len(own)) >> 2
        local = np.frombuffer(b"".join(own), "<u4").astype(np.int64)
        before = np.zeros(len(own), np.int64)
        np.cumsum(local[np.cumsum(size)[:-1] - 1], out=before[1:])
        return local + np.repeat(before, size)

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of the first 1, 2, ... bytes of ``text`` (exact where a character ends)."""
        if not any(s in text for s in self.added):
            return self.ordinary(text)
        out, base = [], 0
        names = {k: s for s, k in self.added.items()}
        for part, k in split_added(text, self.added):
            if k is None:
                out.append(base + self.ordinary(part))
                break
            own = self.ordinary(part + names[k])  # until the added token is whole, it is ordinary text
            end = self.ordinary(part)
            own[-1] = (int(end[-1]) if len(end) else 0) + 1
            out.append(base + own)
            base += int(own[-1])
        return np.concatenate(out)


_SPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{_SPACE}]", c))


@lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounts:
    """One for each Python worker and vocabulary."""
    return PrefixCounts(path)


def bytes_within(text: bytes, prefix: np.ndarray, budget: int) -> int:
    """Bytes of the longest prefix, ending where a character ends, of at most ``budget`` tokens."""
    fits = np.flatnonzero(prefix <= budget) + 1
    for end in fits[::-1].tolist():
        if end == len(text) or text[end] & 0xC0 != 0x80:
            return end
    return 0


def token_prefixes(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, prefix_tokens)``: the whole table of counts as an array, one entry for each byte.

    Null and empty texts have an empty array; repeated rows and null ids stay; an empty table gives no rows; other columns are left out.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("prefix_tokens", pa.list_(pa.int32()))])
    return _map(docs, vocab_path, id_col, text_col, schema, "doc_id long, n_bytes long, prefix_tokens array<int>", lambda counter, text: (len(text.encode()), counter.prefixes(text).astype(np.int32)))


def token_counts(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", budget: int = 1024) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, budget_bytes)`` from the prefix table of each whole text.

    budget_bytes is where to cut the text to keep within ``budget`` tokens.  Null and empty texts
    have 0 bytes and tokens; repeated rows stay; an empty table gives no rows; other
    columns are left out.  Strings of added tokens in a text count as one token, as is the library's default.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("budget_bytes", pa.int64())])

    def answer(counter: PrefixCounts, text: str) -> tuple:
        n, cut = counter.within(text, budget)
        return len(text.encode()), n, n > budget, cut

    return _map(docs, vocab_path, id_col, text_col, schema, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, budget_bytes long", answer)


def _map(docs: DataFrame, vocab_path: str, id_col: str, text_col: str, schema: pa.Schema, ddl: str, answer: Callable) -> DataFrame:
    def make():
        counter = prefix_counter(vocab_path)

        def work(ids, texts):
            rows = [answer(counter, t or "") for t in texts]
            return [ids, *([list(c) for c in zip(*rows)] or [[] for _ in schema[1:]])]

        return work

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(mapper(["doc_id", "text"], make, schema, "text"), ddl)

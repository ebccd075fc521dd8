"""Language identification by mixture inference over character n-grams."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.llm._spark import extended, quoted, slices

BITS = 16
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _hashed(first: np.ndarray, middle: np.ndarray, last: np.ndarray) -> np.ndarray:
    a = np.uint64(0x9E3779B97F4A7C15)
    h = (((first * a) ^ middle) * a ^ last) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code point, count) of the lower-cased letters of all texts, with the number of words as that of the space."""
    codes = np.frombuffer(("\n".join((t or "").lower() for t in texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    count = np.bincount(codes[letter], minlength=33)
    count[32] = np.count_nonzero(letter[:-1] & ~letter[1:])
    at = np.flatnonzero(count)
    return at, count[at]


def background(codes: np.ndarray, count: np.ndarray, smoothing: float = 0.5, most: int = 128) -> np.ndarray:
    """Probabilities of hashed trigrams in no language: letters drawn one by one, by their counts over all languages.

    The ``most`` most common letters are counted up; those beyond, and a share of ``smoothing``, go to all buckets alike.
    """
    space = codes == 32
    codes, count, words = codes[~space].astype(np.uint64), count[~space].astype(float), float(count[space].sum())
    order = np.lexsort((codes, -count))[:most]
    middle = count[order] / count.sum()
    outer, ends = np.append(count[order], words) / (count.sum() + words), np.append(codes[order], np.uint64(32))
    out = np.zeros(1 << BITS)
    for c, weight in zip(codes[order], middle):
        gram = _hashed(ends[:, None], np.full((1, 1), c, np.uint64), ends[None, :])
        out += np.bincount(gram.ravel(), (weight * outer[:, None] * outer[None, :]).ravel(), 1 << BITS)
    return (1 - smoothing) * (out + (1 - out.sum()) / (1 << BITS)) + smoothing / (1 << BITS)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hashed letter trigram, count) of each different trigram of each text, in order.

    Letters are lower-cased; anything else parts words; a word's first and last letter also stand in
    trigrams with its border.
    """
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    doc = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    doc = np.append(doc, len(low) - 1) if len(low) else np.zeros(len(codes), np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one border after each word
    keep[0] = True
    c = np.where(letter, codes, 32)[keep].astype(np.uint64)
    mid = np.flatnonzero(letter[keep][1:-1]) + 1
    gram = _hashed(c[mid - 1], c[mid], c[mid + 1])
    # The border in front counts for the text before it, letters for their own.
    key = np.sort((doc[keep][mid] << BITS) | gram)
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[new] >> BITS, key[new] & ((1 << BITS) - 1), np.diff(np.append(new, len(key)))


@dataclass(frozen=True)
class LanguageModel:
    """Trigram probabilities: one row for each language, in the order of ``names``; ``seen`` are those without smoothing."""

    names: tuple[str, ...]
    p: np.ndarray
    seen: np.ndarray | None = None
    background: np.ndarray | None = None

    def known(self, texts: list[str | None]) -> np.ndarray:
        """The share of each text's trigrams that the languages together explain, and not the background: 0 without a letter.

        Expectation-maximisation starts from one half for the background.  Trigrams seen in no language are the background's.
        """
        out = np.zeros(len(texts))
        if not self.names:
            return out
        doc, gram, count = trigrams(texts)
        if not len(doc):
            return out
        start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        who, doc = doc[start], np.repeat(np.arange(len(start)), np.diff(np.append(start, len(doc))))
        count, n = count.astype(float), len(self.names)
        share = np.full((n + 1, len(start)), 0.5 / n)
        share[n] = 0.5
        share, _ = _em([*self.seen[:, gram], self.background[gram]], count, doc, start, np.add.reduceat(count, start), share)
        out[who] = 1 - share[n]
        return out

    def mixtures(self, texts: list[str | None], penalty: float = 3.0) -> list[tuple[str, float, str]]:
        """(language, score, languages with shares) of each text.

        Expectation-maximisation finds the share of each language in the text's trigrams.  The set of languages starts from the best
        single one and takes in, one by one, the language that raises the log-likelihood most, as long as it grows by more than
        ``penalty`` times the logarithm of the trigram count (neighbouring trigrams overlap, so more than the half of it
        for independent draws).  The language with the largest share wins; the score is its share, and for a set of one its
        posterior among all languages.
        """
        out = [(UNKNOWN, 0.0, "")] * len(texts)
        if not self.names:
            return out
        doc, gram, count = trigrams(texts)
        if not len(doc):
            return out
        start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        who, doc = doc[start], np.repeat(np.arange(len(start)), np.diff(np.append(start, len(doc))))
        p, count, n = self.p[:, gram], count.astype(float), len(self.names)
        total = np.add.reduceat(count, start)
        single = np.stack([np.add.reduceat(count * np.log(row), start) for row in p])
        _, best = _em(p, count, doc, start, total, np.full((n, len(start)), 1 / n))
        cost = penalty * np.log(total + 1)
        first = single.argmax(0)
        post = np.exp(single - single.max(0))
        post = post.max(0) / post.sum(0)
        chosen = np.zeros((n, len(start)))
        chosen[first, np.arange(len(start))] = 1.0
        # No set beats the mixture of all, so most texts are settled by that bound.
        open_, value = np.flatnonzero(best - single.max(0) > cost), single.max(0)
        while len(open_):
            number = np.full(len(start), -1)
            number[open_] = np.arange(len(open_))
            part = number[doc] >= 0
            sub = p[:, part], count[part], number[doc[part]]
            sub_start = np.flatnonzero(np.append(True, sub[2][1:] != sub[2][:-1]))
            mine, every = chosen[:, open_], np.arange(len(open_))
            out_of_set = np.argsort(mine > 0, axis=0, kind="stable")  # languages not in the set come first
            most, share = np.full(len(open_), -np.inf), mine
            for k in range(n - int((mine > 0).sum(0).min())):
                extra = out_of_set[k]
                begin = mine * 0.7
                begin[extra, every] += 0.3
                got, ll = _em(*sub, sub_start, total[open_], begin)
                better = (ll > most) & (mine[extra, every] == 0)
                most, share = np.where(better, ll, most), np.where(better, got, share)
            grown = most - value[open_] > cost[open_]
            chosen[:, open_[grown]], value[open_[grown]] = share[:, grown], most[grown]
            open_ = open_[grown & ((share > 0).sum(0) < n)]
        top = chosen.argmax(0)
        for i, d in enumerate(who.tolist()):
            own = chosen[:, i]
            score = float(own[top[i]]) * (float(post[i]) if own[top[i]] == 1.0 else 1.0)
            order = sorted(np.flatnonzero(own > 0.005).tolist(), key=lambda k: (-own[k], self.names[k]))
            out[d] = (self.names[top[i]], min(1.0, score), ",".join(f"{self.names[k]}:{own[k]:.2f}" for k in order))
        return out


def _em(p, count, doc, start, total, share, most: int = 1000, tolerance: float = 1e-4):
    """Shares by expectation-maximisation from ``share``, and the log-likelihood there, for all texts at once.

    A text is settled when a round moves none of its shares by more than ``tolerance``, and then left out; ``most`` rounds bound the rest.
    """
    share, open_ = share.copy(), np.arange(len(start))
    live = p, count, doc, start, total
    for turn in range(most):
        rows, n, own, at, whole = live
        mine = share[:, open_]
        ratio = n / np.maximum(sum(s[own] * row for s, row in zip(mine, rows)), 1e-300)
        new = np.stack([s * np.add.reduceat(row * ratio, at) / whole for s, row in zip(mine, rows)])
        share[:, open_] = new
        if turn % 6 == 5:
            on = np.abs(new - mine).max(0) > tolerance
            if not on.any():
                break
            if on.sum() < 0.8 * len(on):
                keep = on[own]
                number = np.cumsum(on) - 1
                own = number[own[keep]]
                live = [row[keep] for row in rows], n[keep], own, np.flatnonzero(np.append(True, own[1:] != own[:-1])), whole[on]
                open_ = open_[on]
    mix = sum(s[doc] * row for s, row in zip(share, p))
    return share, np.add.reduceat(count * np.log(np.maximum(mix, 1e-300)), start)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5, with_background: bool = False) -> LanguageModel:
    """Trigram probabilities by language, from all rows of ``docs`` with a text and a language.

    Each task sums up counts by language and hashed trigram; Spark adds these, and what reaches the driver
    is 2^16 counts for each language (0.5 MB), whatever the corpus; ``with_background`` adds one for each of its letters.  Rows with a null text or
    language and texts without letters teach nothing, repeated rows count each, and an empty table gives a model of no language.
    """
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, Counter] = defaultdict(Counter)
        for part in slices(batches, "text", 1 << 20):
            langs, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            doc, gram, count = trigrams(texts)
            names = {x: i for i, x in enumerate(dict.fromkeys(langs))}
            own = np.array([names[x] for x in langs])[doc]
            for x, i in names.items():
                at = own == i
                sums[x] = sums.get(x, 0) + np.bincount(gram[at], count[at], 1 << BITS)
            if with_background and len(doc):  # letters stand after the trigrams, at whichever language of these texts
                code, n = letters(texts)
                seen[langs[doc[0]]].update(dict(zip(code.tolist(), n.tolist())))
        for x, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at].astype(np.int64))], schema=schema)
        for x, c in seen.items():
            at = np.array(sorted(c))
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at + (1 << BITS), pa.int32()), pa.array([c[k] for k in at.tolist()], pa.int64())], schema=schema)

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = tuple(sorted(set(counts["lang"].to_pylist())))
    row = {x: i for i, x in enumerate(names)}
    p = np.full((len(names), 1 << BITS), smoothing)
    own, gram, n = np.array([row[x] for x in counts["lang"].to_pylist()], int), counts["gram"].to_numpy(), counts["n"].to_numpy()
    at = gram < 1 << BITS
    np.add.at(p, (own[at], gram[at]), n[at])
    found = LanguageModel(names, p / p.sum(1, keepdims=True))
    if with_background and names:
        code, where = np.unique(gram[~at] - (1 << BITS), return_inverse=True)
        raw = p - smoothing
        found = replace(found, seen=raw / raw.sum(1, keepdims=True), background=background(code, np.bincount(where, n[~at])))
    return found


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` with ``lang_pred, score, languages``.

    ``lang_pred`` is a learned language, or ``und`` with score 0 where the text is null, has no letter or nothing
    was learned.  Only the text is looked at, all of it.  Repeated rows are alike; an empty table gives no rows.  Columns of ``docs``
    may have any names; those in ``keep`` that have a new column's name give way to it.
    """
    keep = tuple(c for c in keep if c not in ("lang_pred", "score", "languages"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*(F.col(quoted(c)) for c in keep), F.col(quoted(text_col)))
    rows = rows.toDF(*(f"c{k}" for k in range(len(keep) + 1)))  # by place, whatever the names
    new = ("lang_pred", "score", "languages")
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(n, t) for n, t in zip(new, (T.StringType(), T.DoubleType(), T.StringType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part in slices(batches, f"c{len(keep)}", 1 << 20):
            found = model.mixtures(part.column(part.num_columns - 1).to_pylist())
            told = [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *told], names=[*part.schema.names[:-1], *new])

    return rows.mapInArrow(run, schema).toDF(*keep, *new)


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, languages)`` for every row, learned from the rows not held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    return identify(rows, train(rows.where("not held_out")), keep=("doc_id", "held_out"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows in no learned language: no letter at all, or languages that together explain less than ``least``
    of the trigrams, the rest being better explained by letters drawn one by one.

    A text in several learned languages stays.  One in a language close to a learned one may stay too.  Null and empty texts go, repeated
    rows are alike, null ids are learned from like others, extra columns of any name stay as they are; an empty table gives no rows.
    """
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"), F.col(quoted(lang_col)).alias("lang"))
    held = docs.sparkSession.sparkContext.broadcast(train(rows.where(~held_out(F.col("id"))), "text", "lang", with_background=True))

    def make() -> Callable:
        model = held.value

        def work(texts: pa.Array) -> tuple:
            known = model.known(texts.to_pylist())
            return [], (known > 0) & (known >= least)

        return work

    return extended(docs, text_col, make, [], 1 << 20)

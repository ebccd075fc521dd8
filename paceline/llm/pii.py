"""Personal data by patterns and a skip-chain conditional random field."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm._spark import mapper, quoted, slices

# The kinds in the order in which spans are listed, and their base patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

O = len(KINDS)  # the label of tokens that are no personal data
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, one candidate for each ``@``: the whole run of local-part characters before it."""
    floor = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > floor and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        at += 1
        if m:
            yield start, m.end()
            floor = at = m.end()


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the base patterns: leftmost and non-overlapping for each kind, failing matches dropped."""
    if not _ANY.search(text):
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split("."))):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


# Looser forms that a token may take: digits with any usual separators, and names at hosts spelt out.
_DIGITS = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20()./_:\xa0-]{0,3}[0-9]){6,18}(?![0-9A-Za-z])")
_SPELT = re.compile(
    r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9][A-Za-z0-9._%+-]*)(?:\x20?[\[(]at[\])]\x20?|\x20at\x20|@)([A-Za-z0-9-]+(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]+)*)", re.I
)


_RUN = re.compile(r"(?<![a-z0-9._%+@-])[a-z0-9._%+-]+")


class Taken:
    """Stretches of a text that are spoken for."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        i = bisect_right(self.ends, a)  # the first stretch that ends after a
        return i == len(self.starts) or self.starts[i] >= b


def _names(low: str, names: set[str]) -> Iterator[tuple[int, int]]:
    """Where one of ``names`` stands by itself in a lower-cased text: the longest at each place, full stops after it aside."""
    for m in _RUN.finditer(low):
        run, after = m[0], low[m.end() : m.end() + 1]
        stops = [i for i, c in enumerate(run) if c == "." and not run[i + 1 : i + 2].isalnum() and i] if "." in run else []
        for end in ([len(run)] if after != "@" else []) + stops[::-1]:
            if run[:end] in names:
                yield m.start(), m.start() + end
                break


@dataclass(frozen=True)
class Token:
    start: int
    end: int
    keys: tuple[str, ...]
    shape: str
    label: int  # of the base span at this place, or O


def _digit_keys(digits: str, numbers: list[str]) -> tuple[str, ...]:
    keys = [f"n{digits}"]
    if len(digits) >= 10:
        keys.append(f"t{digits[-10:]}")  # with and without the country's prefix
    if len(numbers) == 4 and all(len(x) <= 3 for x in numbers):
        keys.append("q" + ".".join(numbers))
    return tuple(keys)


def _shape(text: str) -> str:
    """Local evidence: digits, separators, a letter in front, and the checks that card numbers and addresses pass."""
    digits = _NOT_DIGIT.sub("", text)
    numbers = _NOT_DIGIT.sub(" ", text).split()
    marks = "".join(c for c in "@+(. -/_:" if c in text)
    sound = "luhn" if 13 <= len(digits) <= 19 and luhn(digits) else "octets" if len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers) else ""
    return f"{min(len(digits), 20)}|{marks}|{int(text[:1].isalpha())}|{sound}"


def tokens(text: str, spans: list[Span]) -> list[Token]:
    """The nodes of a document's field: base spans, loose forms outside them, and repeats of the names in its email addresses."""
    out, free = [], Taken((a, b) for _, a, b in spans).free
    names = set()
    for kind, a, b in spans:
        piece = text[a:b]
        if kind == 0:
            local, _, host = piece.lower().partition("@")
            keys = (f"e{local}@{host}", f"l{local}")
            if len(local) >= 6 and re.search(r"[0-9._%+-]", local.strip("._%+-")):
                names.add(local)
        else:
            keys = _digit_keys(_NOT_DIGIT.sub("", piece), _NOT_DIGIT.sub(" ", piece).split())
        out.append(Token(a, b, keys, _shape(piece), kind))
    new: list[Token] = []
    for m in _DIGITS.finditer(text):
        if free(*m.span()):
            new.append(Token(*m.span(), _digit_keys(_NOT_DIGIT.sub("", m[0]), _NOT_DIGIT.sub(" ", m[0]).split()), _shape(m[0]), O))
    if any(k == 0 for k, _, _ in spans):
        for m in _SPELT.finditer(text):
            if free(*m.span()):
                local, host = m[1].lower(), re.sub(r"\s*[\[(]?dot[\])]?\s*", ".", m[2].lower()) if "." not in m[2] else m[2].lower()
                new.append(Token(*m.span(), (f"e{local}@{host}", f"l{local}"), _shape(m[0]), O))
        low = text.lower() if len(text.lower()) == len(text) else text
        if names:
            free = Taken([(a, b) for _, a, b in spans] + [(t.start, t.end) for t in new]).free
            new += [Token(a, b, (f"l{low[a:b]}",), _shape(text[a:b]), O) for a, b in _names(low, names) if free(a, b)]
    return sorted(out + new, key=lambda t: (t.start, t.end, t.label))


def edges(nodes: list[Token]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(chain, skip): neighbours in the text, and distant nodes that share a key.

    Of each key's nodes, neighbours are tied in a row and each to the first known one, so the links
    grow with the nodes and not with their square.
    """
    chain = [(i, i + 1) for i in range(len(nodes) - 1)]
    by_key: dict[str, list[int]] = {}
    for i, t in enumerate(nodes):
        for k in t.keys:
            by_key.setdefault(k, []).append(i)
    skip = set()
    for own in by_key.values():
        anchor = next((i for i in own if nodes[i].label != O), own[0])
        for i, j in zip(own, own[1:]):
            skip.add((i, j))
        for i in own:
            if i != anchor:
                skip.add((min(i, anchor), max(i, anchor)))
    return chain, sorted(skip)


@dataclass(frozen=True)
class Field:
    """Log potentials: by shape (what local evidence says of a label), between neighbours, and between alike tokens."""

    local: dict[str, np.ndarray]
    unseen: np.ndarray
    chain: np.ndarray
    skip: float = 6.0
    sure: float = 12.0

    def label(self, nodes: list[Token], rounds: int = 25, damping: float = 0.3) -> np.ndarray:
        """Marginals of every node by loopy sum-product message passing; base spans are held."""
        n, labels = len(nodes), O + 1
        phi = np.stack([self.local.get(t.shape, self.unseen) for t in nodes])
        for i, t in enumerate(nodes):
            if t.label != O:
                phi[i] = 0.0
                phi[i, t.label] = self.sure
        chain, skip = edges(nodes)
        pairs = np.array(chain + skip, int).reshape(-1, 2)
        alike = np.zeros((labels, labels))
        np.fill_diagonal(alike, self.skip)
        psi = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(alike[None], len(skip), 0)])
        src, dst = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        psi = np.concatenate([psi, psi.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        message = np.zeros((len(src), labels))
        by_node = np.argsort(dst, kind="stable")  # messages to one node, one after the other
        first = np.flatnonzero(np.diff(dst[by_node], prepend=-1))
        asked = dst[by_node][first]

        def beliefs(message: np.ndarray) -> np.ndarray:
            belief = phi.copy()
            if len(message):
                belief[asked] += np.add.reduceat(message[by_node], first)
            return belief

        for _ in range(rounds):
            belief = beliefs(message)
            out = (belief[src] - message[back])[:, :, None] + psi
            top = out.max(1, keepdims=True)
            new = top[:, 0] + np.log(np.exp(out - top).sum(1))
            new -= new.max(1, keepdims=True)
            new = damping * message + (1 - damping) * new
            moved = float(np.abs(new - message).max()) if len(new) else 0.0
            message = new
            if moved < 1e-4:
                break
        belief = beliefs(message)
        belief = np.exp(belief - belief.max(1, keepdims=True))
        return belief / belief.sum(1, keepdims=True)

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """``base`` and the tokens that the field gives a kind with a probability over one half."""
        nodes = tokens(text, base) if _ANY.search(text) else []
        if all(t.label != O for t in nodes):
            return base
        marginal = self.label(nodes)
        added = [(int(m.argmax()), t.start, t.end) for t, m in zip(nodes, marginal) if t.label == O and m.argmax() != O and m.max() > 0.5]
        return base + added


def train(docs: DataFrame, text_col: str = "text", smoothing: float = 1.0, floor: float = 0.02, agree: float = 400.0) -> Field:
    """Piecewise training on all texts, the base spans being the labels.

    Counts of (shape, label) give the local potentials and counts of neighbouring labels the chain potentials; both are smoothed,
    and a label is never held below ``floor`` by shape alone, as the patterns miss what the field is to find.  The weight
    of agreement is the log odds that alike tokens have the same kind, over pairs that the patterns both give one (where they give
    none the label is the very thing in doubt); ``agree`` pairs that do and one that doesn't are taken as seen before.
    Tasks sum up first; shapes are few.  Null texts and empty tables add nothing.
    """
    schema = pa.schema([("a", pa.string()), ("b", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for part in slices(batches, "text"):
            for text in part.column(0).to_pylist():
                if text and _ANY.search(text):
                    nodes = tokens(text, base_spans(text))
                    seen.update((t.shape, t.label) for t in nodes)
                    seen.update((f"#{s.label}", t.label) for s, t in zip(nodes, nodes[1:]))
                    if sum(t.label != O for t in nodes) > 1:
                        seen.update(("=", int(nodes[i].label == nodes[j].label)) for i, j in edges(nodes)[1] if O not in (nodes[i].label, nodes[j].label))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], schema=schema)

    found = docs.select(F.col(text_col).alias("text")).where("text is not null").mapInArrow(run, "a string, b int, n long")
    rows = found.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    labels = O + 1
    local: dict[str, np.ndarray] = {}
    chain = np.full((labels, labels), smoothing)
    alike = np.array([1.0, agree])
    for r in rows:
        if r["a"] == "=":
            alike[r["b"]] += r["n"]
        elif r["a"][0] == "#":
            chain[int(r["a"][1:]), r["b"]] += r["n"]
        else:
            local.setdefault(r["a"], np.full(labels, smoothing))[r["b"]] += r["n"]
    chain /= chain.sum()
    pmi = np.log(chain) - np.log(chain.sum(1))[:, None] - np.log(chain.sum(0))[None, :]
    even = np.full(labels, floor)
    even[O] = 1.0
    return Field({k: np.log(np.maximum(v / v.sum(), floor)) for k, v in local.items()}, np.log(even / even.sum()), np.clip(pmi, -1.0, 1.0), skip=float(np.log(alike[1] / alike[0])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)`` for every row, over the whole text.

    Counts and hash are of the base spans; ``spans`` lists these and those that the field adds, as kind:start:end in code points.
    Null and empty texts have none; repeated rows stay; an empty table gives no rows; other columns are left out.
    """
    field = field or train(docs, text_col)
    held = docs.sparkSession.sparkContext.broadcast(field)
    schema = pa.schema([("doc_id", pa.int64())] + [(f"n_{k}", pa.int64()) for k in KINDS] + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def make():
        field = held.value

        def work(ids, texts):
            out = [[] for _ in schema]
            for doc, text in zip(ids, texts):
                base = base_spans(text or "")
                spans = field.spans(text or "", base)
                kinds = [k for k, _, _ in base]
                row = [doc, *(kinds.count(k) for k in range(O)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(spans) - len(base)]
                for column, x in zip(out, row):
                    column.append(x)
            return out

        return work

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return rows.mapInArrow(mapper(["doc_id", "text"], make, schema, "text"), ddl)


def mask(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first stands for all."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", field: Field | None = None) -> DataFrame:
    """``docs`` with personal data replaced in the text; ``length_col``, where the table has it, becomes the new text's length.

    Null texts stay null and keep their length, empty ones stay empty; repeated rows, null ids and all other columns stay as they are; an
    empty table gives no rows.
    """
    field = field or train(docs.select(F.col(quoted(text_col)).alias("text")), "text")
    held = docs.sparkSession.sparkContext.broadcast(field)
    names = docs.columns
    at, k = names.index(text_col), names.index(length_col) if length_col in names else -1
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))  # by place, whatever the names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = held.value
        for part in slices(batches, f"c{at}"):
            texts = part.column(at).to_pylist()
            new = [t if not t or not _ANY.search(t) else mask(t, field.spans(t, base_spans(t))) for t in texts]
            columns = list(part.columns)
            columns[at] = pa.array(new, pa.string())
            if k >= 0:
                columns[k] = pa.array([x if t is None else len(t) for t, x in zip(new, part.column(k).to_pylist())], part.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return plain.mapInArrow(run, plain.schema).toDF(*names)

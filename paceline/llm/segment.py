"""SentencePiece encoding, decoding, and distinct sampled segmentations by Gumbel top-k."""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm._spark import mapper, slices

SPACE = "▁"
_UNITS = re.compile(r" *+[^\W\d_²]++|\n| *+(?:[\d_²]+|[^\w \n]+)++| +")
_UNITS_BY_SPACE = re.compile(r" *+[^ \n]++|\n| +")
_LONGEST = 48  # characters of a unit that is built with others at once
_LEAST = -1e-300  # of an edge that is not the only one


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Column:
    """A numpy array that grows at its end."""

    def __init__(self, dtype: str, room: int = 1 << 12):
        self.data, self.size = np.empty(room, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.data):
            grown = np.empty(max(end, len(self.data) * 3 // 2), self.data.dtype)
            grown[: self.size] = self.data[: self.size]
            self.data = grown
        self.data[self.size : end] = values
        self.size = end


class Numbers(dict):
    """Running numbers of strings; those asked for the first time also stand in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Pieces:
    """The vocabulary of a model file, and the lattices and library ids of units of text met so far, kept as tables.

    A unit is a stretch of text that no piece reaches over: a run of letters or of other characters with the spaces
    before it, or a line feed.  So the lattice of a text is a row of units' lattices.  Units are known by their own characters.
    A node's edges stand together, longest piece first; ``cum`` cumulates their probabilities (backward sums included),
    so the edge for a number u is the first whose ``cum`` is above u; ``to`` is the next node, -1 at the unit's end.

    Segmentations are drawn from a unigram model over the pieces.  A BPE file has no piece probabilities,
    only the order of its merges, so a piece's weight falls with its rank, as 1 / (rank + ``offset``) to the power
    ``alpha``.  Characters outside the vocabulary are spelt by byte pieces.
    """

    def __init__(self, path: str, alpha: float = 1.0, offset: float = 10.0, most_edges: int = 5_000_000):
        self.most_edges = most_edges
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        order = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        score = -alpha * np.log(np.arange(len(order)) + offset)
        score -= np.log(np.exp(score).sum())
        self.weight = np.zeros(n)
        self.weight[order] = np.exp(score)
        self.byte_weight = float(np.exp(score.min()))
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.raw = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.id_to_piece(i).encode() for i in range(n)]
        self.raw_size = np.fromiter(map(len, self.raw), np.int32, n)
        self.raw_start = (np.cumsum(self.raw_size) - self.raw_size).astype(np.int32)
        self.raw_flat = np.frombuffer(b"".join(self.raw), np.uint8)
        names = [sp.id_to_piece(i) for i in plain]
        self._make_trie(dict(zip(names, plain)))
        # Where some piece holds letters and others, or a space within, only spaces and line feeds part units.
        whole = all(len(_UNITS.findall(x.replace(SPACE, " "))) == 1 for x in names)
        self.split = (_UNITS if whole else _UNITS_BY_SPACE).findall
        self.feed = sp.encode("\n")[-1]
        if any("\n" in x or SPACE in x.lstrip(SPACE) for x in names):
            raise ValueError("pieces that reach over a line feed or a word's end are not supported")
        self.numbers = Numbers()
        self.unit_node, self.best_start, self.best_size, self.best_ids = (Column("<i4") for _ in range(4))
        self.node_edge = Column("<i4")
        self.cum, self.logq, self.ids, self.to = Column("<f8"), Column("<f8"), Column("<i4"), Column("<i4")

    def _clear(self) -> None:
        self.numbers.clear()
        for c in (self.unit_node, self.best_start, self.best_size, self.best_ids, self.node_edge, self.cum, self.logq, self.ids, self.to):
            c.size = 0

    def _make_trie(self, names: dict[str, int]) -> None:
        """The pieces' trie as a hash table from (state, character) to the state that follows, and each state's piece or -1."""
        states: dict[str, int] = {"": 0}
        for name in names:
            for k in range(1, len(name) + 1):
                states.setdefault(name[:k], len(states))
        self.trie_piece = np.full(len(states), -1)
        self.trie_piece[[states[x] for x in names]] = list(names.values())
        self.trie_first = np.full(0x110000, -1, np.int32)
        self.trie_first[[ord(x) for x in states if len(x) == 1]] = [n for x, n in states.items() if len(x) == 1]
        deep = [(states[x[:-1]] << 21 | ord(x[-1]), n) for x, n in states.items() if len(x) > 1]
        self.trie_bits = max(4, (4 * len(deep)).bit_length())
        self.trie_keys, self.trie_next = np.full(1 << self.trie_bits, -1), np.zeros(1 << self.trie_bits, np.int64)
        key, then = (np.array(x, np.int64) for x in zip(*deep)) if deep else (np.zeros(0, np.int64),) * 2
        slot = self._slot(key)
        while len(key):  # linear probing, all keys at once: of those that ask for one free slot the last gets it
            free = self.trie_keys[slot] < 0
            self.trie_keys[slot[free]], self.trie_next[slot[free]] = key[free], then[free]
            lost = self.trie_keys[slot] != key
            key, then, slot = key[lost], then[lost], slot[lost] + 1 & (1 << self.trie_bits) - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.trie_bits)).astype(np.int64)

    def _follow(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The trie's state after ``code``, or -1."""
        key = state << 21 | code
        slot, mask = self._slot(key), (1 << self.trie_bits) - 1
        found = self.trie_keys[slot]
        out = np.where(found == key, self.trie_next[slot], -1)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            slot[open_] = slot[open_] + 1 & mask
            found = self.trie_keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.trie_next[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def matches(self, text: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """(starts, pieces) of all pieces of 1, 2, ... characters in ``text``, which must end in a line feed; all starts go down the trie together."""
        codes = _codes(text).astype(np.int64)
        state = self.trie_first[codes].astype(np.int64)
        at, out = np.flatnonzero(state >= 0), []
        state = state[at]
        while len(at):
            piece = self.trie_piece[state]
            hit = piece >= 0
            out.append((at[hit], piece[hit]))
            state = self._follow(state, codes[at + len(out)])
            on = state >= 0
            at, state = at[on], state[on]
        return out

    def _add(self, units: list[str]) -> None:
        """Put new units into the tables."""
        # The library's ids, each unit between two line feeds: no merge reaches over these.
        plain = [u if u != "\n" else " " for u in units]
        asked = ["\n" + "\n".join(plain[at : at + 32]) for at in range(0, len(plain), 32)] + ["\n"]
        ids = np.fromiter(chain.from_iterable(self.sp.encode(asked, num_threads=1)), np.int32)
        start = np.flatnonzero(ids == self.feed) + 1
        if len(start) != len(plain) + 1:
            raise ValueError("a unit's ids hold those of a line feed")
        # The dummy space of the next string stands at the end of each string's last unit.
        size = np.diff(start) - 1
        size[31::32] -= 1
        size[-1:] -= len(plain) % 32 > 0
        odd = [i for i, u in enumerate(units) if len(u) > _LONGEST or u == "\n"]
        for i in odd:
            if units[i] == "\n":
                ids[start[i]], size[i] = self.feed, 1
        self.best_start.extend(start[:-1] + self.best_ids.size)
        self.best_size.extend(size)
        self.best_ids.extend(ids)
        first = np.empty(len(units), np.int64)
        short = np.setdiff1d(np.arange(len(units)), odd).tolist()
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            first[part], bad = self._lattices([units[i] for i in part])
            odd += [part[k] for k in bad]
        for i in odd:
            first[i] = self._single(units[i])
        self.unit_node.extend(first)

    def _put(self, degree: np.ndarray, cum: np.ndarray, logq: np.ndarray, ids: np.ndarray, to: np.ndarray) -> int:
        """Append nodes with ``degree`` edges each; ``to`` counts from the first of them, whose number is returned."""
        base, edge = self.node_edge.size, self.cum.size
        self.node_edge.extend(edge + np.cumsum(degree) - degree)
        self.cum.extend(cum)
        self.logq.extend(logq)
        self.ids.extend(ids)
        self.to.extend(np.where(to < 0, -1, to + base))
        return base

    def _lattices(self, units: list[str]) -> tuple[np.ndarray, list[int]]:
        """(first node of each unit, units with characters outside the vocabulary, which get none of use), built all at once from their ends."""
        text = "\n".join(units).replace(" ", SPACE) + "\n"
        length = np.fromiter(map(len, units), np.int64, len(units))
        base = np.cumsum(length + 1) - length - 1
        found = self.matches(text)
        n = len(text)
        degree = np.zeros(n, np.int64)
        for at, _ in found:
            degree[at] += 1
        spelt = np.zeros(n, bool)
        if found:
            spelt[found[0][0]] = True
        spelt[base + length] = True
        odd = ~np.logical_and.reduceat(spelt, base)
        first = np.cumsum(degree) - degree
        total = int(degree.sum())
        piece, end = np.empty(total, np.int64), np.empty(total, np.int64)
        cursor = first.copy()
        for size in range(len(found), 0, -1):  # longest first
            at, ids = found[size - 1]
            slot = cursor[at]
            piece[slot], end[slot] = ids, at + size
            cursor[at] += 1
        far = np.repeat(base + length, length + 1) - np.arange(n)  # characters to the unit's end
        by_far = np.argsort(far.astype(np.int16), kind="stable")
        level = np.searchsorted(far[by_far], np.arange(_LONGEST + 2))
        z, mass = np.zeros(n), np.empty(total)
        z[base + length] = 1.0
        weight = self.weight[piece]
        for i, j in zip(level[1:-1].tolist(), level[2:].tolist()):
            at, k, sums = by_far[i:j], 0, 0.0
            at = at[degree[at] > 0]
            while len(at):
                e = first[at] + k
                mass[e] = own = weight[e] * z[end[e]]
                z[at] += own
                k += 1
                at = at[degree[at] > k]
        cum, at, k = np.empty(total), np.flatnonzero((degree > 0) & (z > 0)), 0
        run = np.zeros(n)
        q = mass / np.repeat(np.where(z > 0, z, 1.0), degree)
        while len(at):
            e = first[at] + k
            run[at] += q[e]
            last = degree[at] == k + 1
            cum[e] = np.where(last, 1.0, np.minimum(run[at], 1.0))
            k += 1
            at = at[~last]
        logq = np.where(np.repeat(degree == 1, degree), 0.0, np.minimum(np.log(np.maximum(q, 1e-300)), _LEAST))
        to = np.where(np.repeat(np.repeat(base + length, length + 1), degree) == end, -1, end)
        return base + self._put(degree, cum, logq, piece, to), np.flatnonzero(odd).tolist()

    def _single(self, unit: str) -> int:
        """Put one unit of any length and characters into the tables; gives its first node."""
        unit, n = unit.replace(" ", SPACE), len(unit)
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(n)]
        for size, (starts, ids) in enumerate(self.matches(unit + "\n"), 1):
            for a, i in zip(starts.tolist(), ids.tolist()):
                out[a].append((a + size, i, math.log(self.weight[i])))
        # Nodes: one for each character, and one more for each further byte of an unknown one.
        spelt = [[] if any(e == a + 1 for e, _, _ in out[a]) else list(unit[a].encode("utf-8", "replace")) for a in range(n)]
        node, at = [0] * (n + 1), 0
        for a in range(n):
            node[a] = at
            at += max(1, len(spelt[a]))
        node[n] = nodes = at
        beta = [0.0] * (n + 1)
        groups: list[list[tuple[float, float, int, int]]] = []
        for a in range(n - 1, -1, -1):
            own = [(e, node[e], i, s) for e, i, s in reversed(out[a])]
            if spelt[a]:
                own.append((a + 1, node[a] + 1, self.byte[spelt[a][0]], math.log(self.byte_weight) * len(spelt[a])))
            value = [s + beta[e] for e, _, _, s in own]
            top = max(value)
            beta[a] = top + math.log(sum(math.exp(v - top) for v in value))
            cum, part = 0.0, []
            for k, ((_, to, i, _), v) in enumerate(zip(own, value)):
                q = math.exp(v - beta[a])
                cum = 1.0 if k == len(own) - 1 else min(1.0, cum + q)
                part.append((cum, 0.0 if len(own) == 1 else min(v - beta[a], _LEAST), i, to if to < nodes else -1))
            tail = [[(1.0, 0.0, self.byte[b], node[a] + k + 1 if node[a] + k + 1 < nodes else -1)] for k, b in enumerate(spelt[a][1:], 1)]
            groups += [*tail[::-1], part]
        groups.reverse()
        cum, logq, ids, to = (np.array(x) for x in zip(*(r for part in groups for r in part)))
        return self._put(np.fromiter(map(len, groups), np.int64, nodes), cum, logq, ids, to)

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the unit at each place of all texts, places of each text); units not yet known are built together."""
        if self.cum.size > self.most_edges:
            self._clear()
        cut = [self.split(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        found = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(cut)), np.int32, int(sizes.sum()))
        if self.numbers.new:
            self._add(self.numbers.new)
            self.numbers.new = []
        return found, sizes

    def best(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the library's ids of all units, one after the other, how many each unit has)."""
        size = self.best_size.data[units]
        return _gather(self.best_ids.data, self.best_start.data[units], size), size

    def encode(self, text: str) -> np.ndarray:
        """The library's ids of ``text``, put together from its units."""
        return self.best(self.units([text])[0])[0]

    def surface(self, ids: np.ndarray) -> bytes:
        """The bytes that ``ids`` spell."""
        return _gather(self.raw_flat, self.raw_start[ids], self.raw_size[ids]).tobytes()

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: bytes put together, the dummy space taken away."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces of ``flat`` from each start on, one after the other."""
    end = np.cumsum(size, dtype=np.int32)
    return flat[np.arange(int(end[-1]) if len(end) else 0, dtype=np.int32) + np.repeat(start - end + size, size)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_places(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hashes of a row's seed and a place in the row, from which ``uniform`` draws."""
    with np.errstate(over="ignore"):
        return _mix(seed + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def uniform(key: np.ndarray, purpose: str, turn: int, step: int = 0) -> np.ndarray:
    """Numbers in (0, 1) that depend on ``row_places``, a purpose, a turn and a step, and not on what else is in the batch."""
    salt = np.uint64(xxhash.xxh64_intdigest(f"{purpose} {turn} {step}"))
    with np.errstate(over="ignore"):
        x = _mix(key + salt)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


def gumbel(key: np.ndarray, purpose: str, turn: int) -> np.ndarray:
    return -np.log(-np.log(uniform(key, purpose, turn)))


_HIGHEST = 36.8  # no Gumbel number from 52 bits is above
_FAR = 44.0  # how much less likely than the whole a path set must be to be looked at only if need be


class Search:
    """Perturbed A* search over the lattices of a batch of texts; all texts take each step together.

    A search state is a set of paths through a text: a common beginning, and edges that may not follow it.  Its priority is
    the exact maximum of its paths' Gumbel-perturbed log-probabilities; backward sums make that a Gumbel variable
    at the log of the set's mass, truncated at its parent's.  The best state gives its greatest path, a random
    one of the set, and falls apart into a state for each place where another path may leave that one.
    So a text's paths come out in order, each once: a sample without replacement.
    """

    def __init__(self, own: Pieces, units: np.ndarray, sizes: np.ndarray, seeds: np.ndarray):
        self.first_edge = own.node_edge.data[: own.node_edge.size]
        self.cum, self.logq, self.ids, self.to = (c.data[: c.size] for c in (own.cum, own.logq, own.ids, own.to))
        self.start = own.unit_node.data[units].astype(np.int64)  # first node of each place of the batch
        self.first = np.cumsum(sizes) - sizes  # first place of each text
        self.sizes, self.seeds = sizes, seeds
        self.key = row_places(np.repeat(seeds, sizes), np.arange(len(units)) - np.repeat(self.first, sizes))

    def _edges(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Each node's first edge with ``cum`` above its ``u``."""
        edge = self.first_edge[nodes].astype(np.int64)
        open_ = np.flatnonzero(self.cum[edge] <= u)
        while len(open_):
            edge[open_] += 1
            open_ = open_[self.cum[edge[open_]] <= u[open_]]
        return edge

    def _walk(self, places: np.ndarray, nodes: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """(edges of random paths from ``nodes`` to the ends of their units, one place after the other; how many each place has)."""
        key, who, taken, step = self.key[places], np.arange(len(places)), [], 0
        count = np.zeros(len(places), np.int64)
        while len(who):
            edge = self._edges(nodes, uniform(key, "walk", turn, step))
            taken.append((who, edge))
            count[who] += 1
            to = self.to[edge]
            more = np.flatnonzero(to >= 0)
            who, nodes, key, step = who[more], to[more], key[more], step + 1
        offset = np.cumsum(count) - count
        edges = np.empty(int(count.sum()), np.int64)
        for step, (own, edge) in enumerate(taken):
            edges[offset[own] + step] = edge
        return edges, count

    def top(self, k: int) -> list[tuple[list[tuple[np.ndarray, float, float]], float]]:
        """For each text its ``k`` paths (edges, log-probability, perturbed log-probability) of the greatest perturbed ones, and the next perturbed value."""
        n = len(self.sizes)
        found: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in range(n)]
        heaps: list[list] = [[] for _ in range(n)]
        count = 0
        roots = gumbel(row_places(self.seeds, np.zeros(n, np.int64)), "root", 0).tolist()
        ends = (self.first + self.sizes).tolist()
        # What each live text goes on with: its bound, the edges and places up to a depth, barred edges there, and the log of the mass left.
        none = np.zeros(0, np.int64)
        state = {t: (roots[t], none, none, (), 0.0) for t in range(n) if self.sizes[t]}
        for turn in range(k):
            if turn:
                own = {t: heapq.heappop(heaps[t]) for t in range(n) if heaps[t]}
                draws = uniform(row_places(self.seeds[list(own)], np.array([s[4] for s in own.values()], np.int64)), "branch", turn).tolist()
                state = {t: (-minus, *self._branch(*rest, u)) for (t, (minus, _, *rest)), u in zip(own.items(), draws)}
            if not state:
                break
            starts: list[np.ndarray] = []
            nodes: list[np.ndarray] = []
            for t, (_, path, places, _, _) in state.items():
                at = self.first[t]
                if len(path):  # the rest of the unit that the last edge stands in, then the units after it
                    at, to = int(places[-1]) + 1, self.to[path[-1:]]
                    if to[0] >= 0:
                        starts.append(places[-1:])
                        nodes.append(to)
                starts.append(np.arange(at, ends[t]))
                nodes.append(self.start[at : ends[t]])
            walked = np.concatenate(starts)
            taken, size = self._walk(walked, np.concatenate(nodes), turn)
            at_place = np.repeat(walked, size)
            cut = np.searchsorted(at_place, self.first[list(state)]).tolist(), np.searchsorted(at_place, [ends[t] for t in state]).tolist()
            want = k - turn
            paths = [np.concatenate([state[t][1], taken[i:j]]) if len(state[t][1]) else taken[i:j] for t, i, j in zip(state, *cut)]
            logq = self.logq[np.concatenate(paths)]
            # Where another path may leave is ever less likely along the path: the first stretch is enough if it holds better places than any later can be.
            stops, at = [], 0
            for t, path in zip(state, paths):
                run = np.cumsum(logq[at : at + len(path)])
                found[t].append((path, float(run[-1]), state[t][0]))
                stops.append(min(len(path), max(len(state[t][1]), int(np.searchsorted(-run, _FAR)) + 1)))
                at += len(path)
            noise = self._leave(state, paths, stops, turn)
            for t, i, path, stop, own in zip(state, cut[0], paths, stops, noise):
                bound, begun, places, barred, _ = state[t]
                depth = len(begun) - 1
                if stop < len(path) and (len(own) <= want or np.partition(own, -want)[-want] < _HIGHEST - _FAR):
                    stop = len(path)
                    (own,) = self._leave({t: state[t]}, [path], [stop], turn)
                reach = np.concatenate([places, at_place[i : i + max(0, stop - depth - 1)]])
                # Truncation at the bound keeps the order, so only the best need it.
                for d in (np.argpartition(own, -want)[-want:] if len(own) > want else np.arange(len(own))).tolist():
                    if own[d] > -np.inf:
                        count += 1
                        heapq.heappush(heaps[t], (float(np.logaddexp(-bound, -own[d])), count, path, reach, d, barred if d == depth else (int(path[d]),)))
        return [(own, -heap[0][0] if heap else -math.inf) for own, heap in zip(found, heaps)]

    def _leave(self, state: dict, paths: list[np.ndarray], stops: list[int], turn: int) -> list[np.ndarray]:
        """For each text the perturbed log-masses of the path sets that leave its path at its first ``stop`` edges."""
        logq = self.logq[np.concatenate([path[:stop] for path, stop in zip(paths, stops)])]
        with np.errstate(divide="ignore"):
            mass = np.log(-np.expm1(logq))
        for i in np.flatnonzero((logq > -1e-9) & (logq < 0)).tolist():  # what is left is lost in rounding
            text = int(np.searchsorted(np.cumsum(stops), i, side="right"))
            edge = int(paths[text][i - sum(stops[:text])])
            mass[i] = math.log(max(float(np.exp(self.logq[self._others([edge])]).sum()), 1e-300))
        at = 0
        for (_, begun, _, _, left), stop in zip(state.values(), stops):
            run, depth = np.cumsum(logq[at : at + stop]), len(begun) - 1
            mass[at + 1 : at + stop] += run[:-1]
            if depth >= 0:
                mass[at : at + depth] = -np.inf
                mass[at + depth] = (run[depth - 1] if depth else 0.0) + left
            at += stop
        size = np.array(stops)
        places = np.arange(at) - np.repeat(np.cumsum(size) - size, size)
        return np.split(mass + gumbel(row_places(np.repeat(self.seeds[list(state)], size), places), "leave", turn), np.cumsum(size)[:-1])

    def _others(self, barred: tuple[int, ...] | list[int]) -> list[int]:
        """The edges of one node without those given."""
        node = int(np.searchsorted(self.first_edge, np.int32(barred[0]), side="right")) - 1
        stop = int(self.first_edge[node + 1]) if node + 1 < len(self.first_edge) else len(self.cum)
        return [e for e in range(int(self.first_edge[node]), stop) if e not in barred]

    def _branch(self, path: np.ndarray, places: np.ndarray, depth: int, barred: tuple[int, ...], u: float):
        """The state that leaves ``path`` at ``depth`` by an edge that is not barred, ``u`` picking it: (edges, places, edges barred from now on, log of the mass left)."""
        own = self._others(barred)
        weight = [math.exp(x) for x in self.logq[own].tolist()]
        total = sum(weight)
        pick, run = 0, weight[0]
        while run <= u * total and pick < len(own) - 1:
            pick += 1
            run += weight[pick]
        rest = sum(weight[:pick]) + sum(weight[pick + 1 :])
        return np.append(path[:depth], own[pick]), places[: depth + 1], (*barred, own[pick]), math.log(rest) if rest > 1e-300 else -math.inf


def log_inclusion(log_p: float, threshold: float) -> float:
    """Log of the probability that a path's perturbed value exceeds ``threshold``: 1 - exp(-exp(log_p - threshold))."""
    x = log_p - threshold
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0))))


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One for each Python worker and model file."""
    return Pieces(path)


def row_seeds(keys: list, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(repr(key), seed) for key in keys], np.uint64)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` as the library encodes each whole text, however long; null and empty texts have no ids.

    Repeated rows and null ids stay; an empty table gives no rows; other columns are left out.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def make():
        own = pieces(model_path)
        return lambda ids, texts: [ids, [own.encode(t or "") for t in texts]]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(mapper(["doc_id", "text"], make, schema, "text"), "doc_id long, ids array<int>")


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` of arrays of ids; null and empty arrays give the empty text, null ids within are left out.

    Repeated rows and null doc_ids stay; an empty table gives no rows; other columns are left out.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def make():
        own = pieces(model_path)
        return lambda keys, arrays: [keys, [own.decode([i for i in a or [] if i is not None]) for a in arrays]]

    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(mapper(["doc_id", "ids"], make, schema, "ids"), "doc_id long, text string")


def sample_segmentations(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42, keep_ids: bool = True) -> DataFrame:
    """The library's encoding (sample 0) and up to ``k`` distinct sampled segmentations of each whole text.

    ``doc_id, sample, n_pieces, ids_crc32, log_prob, perturbed, log_inclusion, round_trip[, ids]``: samples come in order of their
    perturbed log-probability; log_inclusion is the log of the chance to be among them, given the next perturbed value; round_trip tells
    that the ids spell the text.  Draws depend on the id and ``seed`` alone, so repeated rows are alike, and a null id is
    a key of its own.  A null or empty text has one row without pieces; short texts may have fewer than ``k``
    segmentations, which then are all given (log_inclusion 0).  An empty table gives no rows; other columns are left out.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("sample", pa.int32()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("log_prob", pa.float64())]
        + [("perturbed", pa.float64()), ("log_inclusion", pa.float64()), ("round_trip", pa.bool_())] + [("ids", pa.list_(pa.int32()))] * keep_ids
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model_path)
        for part in slices(batches, "text", 1 << 20):
            keys, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
            units, sizes = own.units(texts)
            search = Search(own, units, sizes, row_seeds(keys, seed))
            all_best, size = own.best(units)
            ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(sizes))].tolist()
            arrays: list[np.ndarray] = []
            rows: list[tuple] = []
            same: list[bool] = []
            for doc, text, i, j, (found, after) in zip(keys, texts, ends, ends[1:], search.top(k)):
                spelt = (SPACE + text.replace(" ", SPACE)).encode("utf-8", "replace") if text else b""
                arrays.append(all_best[i:j])
                rows.append((doc, 0, None, None, None))
                for n, (path, log_p, value) in enumerate(found, 1):
                    arrays.append(search.ids[path])
                    rows.append((doc, n, log_p, value, log_inclusion(log_p, after)))
                same += [own.surface(a) == spelt for a in arrays[-1 - len(found) :]]
            size = np.fromiter(map(len, arrays), np.int64, len(arrays))
            key, number, *values = zip(*rows)
            columns = [key, number, size, [zlib.crc32(a) for a in arrays], *values, same]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(np.concatenate(arrays), pa.int32())))
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ddl = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, round_trip boolean" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(run, ddl)

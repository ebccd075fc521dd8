"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from paceline.llm import variants as v


def edits(a, b):
    """Whether one letter put in, left out or replaced tells two words apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_words(docs, every=199):
    n = Counter()
    for doc, text in docs:
        for w in re.findall("[A-Za-z\xc0-\xff]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def plain_groups(n):
    out = {}
    for w in n:
        near = [x for x in n if edits(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best and n[best] >= 5 * n[w] else None, len(near))
    for w, (form, near) in list(out.items()):
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] = (form, root, n[w], near, n[form] if form else None)
    return out


def made_words(seed, many):
    rng = random.Random(seed)
    out = set()
    while len(out) < many:
        w = "".join(rng.choice("aabeeé×stn") for _ in range(rng.randint(6, 9)))
        out.add(w)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("xéb") + w[at:], w[:at] + rng.choice("xya") + w[at + 1 :], "".join(rng.sample(w, len(w)))])
            if len(w) >= 6:
                out.add(w)
    return sorted(out)


@pytest.mark.parametrize("seed,cell", [(1, 1 << 16), (2, 40), (3, 7)])
def test_near_words(spark, seed, cell):
    words = made_words(seed, 700) + ["a" * 70, "a" * 71, "a" * 69 + "b", "ab" * 40, "ab" * 40 + "a", "ab" * 39 + "ba", "z" * 64, "z" * 63, "z" * 62]
    n = {w: 5 * 3 ** (len(w) % 5) for w in words}
    got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in v.near_words(spark.createDataFrame(list(n.items()), "word string, n long").repartition(3), cell).collect()}
    want = {}
    for w in words:
        if near := [x for x in words if edits(w, x)]:
            best = min(near, key=lambda x: (-n[x], x))
            want[w] = (len(near), n[best], best)
    assert len(want) > 300 and got == want


def test_groups(spark):
    rng = random.Random(4)
    words = made_words(5, 60)
    docs = [(k if k % 7 else None, " ".join(rng.choice(words).title() if rng.random() < 0.2 else words[int(len(words) * rng.random() ** 4)] for _ in range(60)) + ", ÉCOLES naïvely-naïvely") for k in range(300)]
    docs += [(1, None), (2, ""), (3, "12 34"), (4, docs[4][1]), (4, docs[4][1])]
    df = spark.createDataFrame([(k, t, "q") for k, t in docs], "doc_id long, text string, word string")
    got = {r["word"]: tuple(r)[1:] for r in v.spelling_groups(df).collect()}
    want = plain_groups(plain_words(docs))
    assert got == want and any(w[0] for w in want.values())


def test_no_words(spark):
    for rows in ([], [(1, None), (None, "short words only")]):
        assert v.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_chain_of_forms(spark):
    counts = {"abcdefg": 5, "abcdefgh": 25, "abcdefghi": 125, "abcdefghij": 625, "abcdefghijk": 3125}
    df = spark.createDataFrame([(1, " ".join(w for w, n in counts.items() for _ in range(n)))], "doc_id long, text string")
    rows = {r["word"]: r for r in v.spelling_groups(df, every=0).collect()}
    assert {r["root"] for r in rows.values()} == {"abcdefghijk"} and rows["abcdefg"]["form"] == "abcdefgh" and rows["abcdefghijk"]["form"] is None


def test_codes_bound_the_distance_and_boxes_hold_their_points():
    words = made_words(6, 300)
    codes = v.count_codes(words)
    count = [Counter(w) for w in words]
    for a in range(0, 300, 7):
        for b in range(0, 300, 11):
            exact = sum(abs(count[a][c] - count[b][c]) for c in set(words[a] + words[b]))
            assert int(np.bitwise_count(codes[a] ^ codes[b]).sum()) <= exact
    root, leaves = v.build(codes, 8, tight=False)
    home = v.homes(root, codes)
    assert set(home.tolist()) == set(range(leaves))
    for more, fewer in ((0, 0), (1, 0), (1, 1)):
        found = [set() for _ in words]
        for node, rows in v.reached(root, codes, more, fewer):
            for k in rows.tolist():
                found[k].add(node.leaf)
        for a in range(300):
            for b in range(300):
                up, down = (count[b] - count[a]).total(), (count[a] - count[b]).total()
                if up <= more and down <= fewer:
                    assert int(home[b]) in found[a]


def test_lengths_that_the_sample_lacks(spark, monkeypatch):
    monkeypatch.setattr(v, "SAMPLE", 3)
    words = made_words(8, 200)
    got = {r["word"]: r["n_near"] for r in v.near_words(spark.createDataFrame([(w, 5) for w in words], "word string, n long"), 50).collect()}
    assert got == {w: k for w in words if (k := sum(edits(w, x) for x in words))}

"""Suffix arrays and contamination against plain versions."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from paceline.llm import contamination as c

SPLIT = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return SPLIT.findall("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))


def plain(texts, items, window=10):
    """By brute force: (words, spans, items) of each text."""
    out = []
    own = [(str(n) if n is not None else "", split(t)) for n, t in items]
    for text in texts:
        ws, hit, names = split(text), set(), set()
        for name, item in own:
            w = min(window, len(item))
            grams = {tuple(item[i : i + w]) for i in range(len(item) - w + 1)} if w else set()
            for i in range(len(ws) - w + 1):
                if tuple(ws[i : i + w]) in grams:
                    hit.update(range(i, i + w))
                    names.add(name)
        spans = [[i, next(j for j in range(i, len(ws) + 1) if j not in hit)] for i in sorted(hit) if i - 1 not in hit]
        out.append((len(ws), spans, sorted(names)))
    return out


def corpus(seed, n_texts=120, n_items=12, n_words=5):
    rng = random.Random(seed)
    names = ["a", "Ab", "é", "longerword", "longerworda", "longerwordab", "exactly8", "exactly8exactly8", "exactly8x", "9", "日本語"][:n_words]
    text = lambda n: "".join(rng.choice(names + ["zz"] * (rng.random() < 0.3)) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(rng.randint(0, n)))
    texts = [text(40) for _ in range(n_texts)]
    items = [(rng.choice([k, str(k), "x"]), text(rng.choice([2, 12, 30]))) for k in range(n_items)]
    return texts + [None, "", " ", "zz", texts[0], items[-1][1], items[-1][1] + " end"], items + [("none", None), (None, "exactly8 9 zz"), ("twice", items[0][1])]


def rows(spark, texts, items):
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, item_id int").repartition(3)
    return docs, spark.createDataFrame([(None if n is None else str(n), t) for n, t in items], "item_id string, text string")


@pytest.mark.parametrize("seed,n_words,window,shard", [(1, 3, 10, 1 << 20), (2, 11, 10, 200), (3, 2, 4, 700), (4, 5, 10, 50), (5, 1, 10, 900)])
def test_contamination(spark, seed, n_words, window, shard):
    texts, items = corpus(seed, n_words=n_words)
    docs, benchmark = rows(spark, texts, items)
    got = {r["doc_id"]: r for r in c.find_contamination(docs, benchmark, window=window, shard_bytes=shard).collect()}
    want = plain(texts, items, window)
    assert [(got[k]["n_words"], [list(s) for s in got[k]["spans"]], got[k]["items"]) for k in range(len(texts))] == want
    told = {r["doc_id"]: r for r in c.contamination_summary(docs, benchmark, window=window, shard_bytes=shard).collect()}
    for k, (n, spans, names) in enumerate(want):
        assert tuple(told[k])[1:] == (n, sum(j - i for i, j in spans), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(spans))


def test_blocks_of_the_benchmark(spark, monkeypatch):
    texts, items = corpus(6, n_words=3)
    docs, benchmark = rows(spark, texts, items)
    whole = c.written_blocks
    monkeypatch.setattr(c, "written_blocks", lambda df, purpose, n: whole(df, purpose, 3))
    got = {r["doc_id"]: r for r in c.find_contamination(docs, benchmark).collect()}
    assert [(got[k]["n_words"], [list(s) for s in got[k]["spans"]], got[k]["items"]) for k in range(len(texts))] == plain(texts, items)


@pytest.mark.parametrize("seed", [7, 8])
def test_longest_matches(spark, seed):
    texts, items = corpus(seed, n_words=4)
    items = [(f"i{k}", t) for k, (_, t) in enumerate(items)]
    docs, benchmark = rows(spark, texts, items)
    least = min(min(10, n) for n in (len(split(t)) for _, t in items) if n)
    got = {r["item_id"]: r for r in c.longest_matches(docs, benchmark, shard_bytes=300).collect()}
    own = [split(t) for t in texts]
    for name, text in items:
        item, most = split(text), (0, 0)
        for k in range(len(item)):
            for ws in own:
                for i in range(len(ws)):
                    n = 0
                    while i + n < len(ws) and k + n < len(item) and ws[i + n] == item[k + n]:
                        n += 1
                    most = max(most, (n, -k))
        if most[0] < least:
            assert name not in got
            continue
        r = got[name]
        assert (r["length"], r["item_start"]) == (most[0], -most[1])
        assert own[r["doc_id"]][r["doc_start"] : r["doc_start"] + r["length"]] == item[r["item_start"] : r["item_start"] + r["length"]]


def test_suffix_array_is_sorted():
    texts, items = corpus(9, n_words=2)
    tests = c.Benchmark([str(n) for n, _ in items], [t for _, t in items], 10)
    shard = c.Shard(pa.array(texts))
    found = c.SuffixArray(shard, tests)
    ids = tests.vocabulary.numbers(shard.letters, shard.start, shard.size)
    suffix = [ids[w : w + min(n, tests.longest)].tolist() for w, n in zip(found.word[found.order].tolist(), found.left[found.order].tolist())]
    assert len(suffix) > 500 and suffix == sorted(suffix)
    assert np.minimum(found.shared[1:], tests.longest).tolist() == [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(suffix, suffix[1:])]


def test_words_are_numbered_by_all_their_bytes():
    known = [b"a", b"abcdefgh", b"abcdefghi", b"abcdefghabcdefgh", b"abcdefghabcdefghz", b"zzzzzzzzabcdefgh"]
    other = [b"b", b"abcdefg", b"abcdefghj", b"abcdefghabcdefg", b"zzzzzzzz", b"abcdefghzzzzzzzz", b"zzzzzzzzabcdefghz", b"aaaaaaaaabcdefgh"]
    both = known + other
    letters = np.frombuffer(b" ".join(both) + bytes(8), np.uint8).copy()
    size = np.array([len(w) for w in both])
    got = c.Vocabulary(known).numbers(letters, np.cumsum(size + 1) - size - 1, size)
    assert got.tolist() == [*range(1, len(known) + 1), *[0] * len(other)]


def test_decontaminate_keeps_rows_and_columns_as_they_are(spark):
    names = ["doc_id", "my col", "a-b", "a.b", "__text", "row", "text", "c0"]
    clean, dirty = "nothing to see here", "one two three four five six seven eight nine ten eleven"
    nested = "struct<`x y`: int, `a.b`: array<string>>"
    df = spark.createDataFrame([(k, k, "x", "y", "z", (k, ["q"]), t, 1.5) for k, t in enumerate([clean, dirty, None, "", clean])], f"doc_id long, `my col` int, `a-b` string, `a.b` string, __text string, row {nested}, text string, c0 double")
    items = spark.createDataFrame([(7, dirty.upper())], "item_id int, text string")
    out = c.decontaminate(df, items)
    assert out.columns == names and out.schema["row"].dataType == df.schema["row"].dataType
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in df.collect() if r["text"] != dirty)
    assert c.decontaminate(df.limit(0), items).count() == 0 and c.decontaminate(df, items.limit(0)).count() == 5
    assert c.contamination_summary(df, items.limit(0)).where("n_hit > 0 or contaminated").count() == 0

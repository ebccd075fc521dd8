"""Packing and token counts against the tokenizers library and plain algorithms."""

import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from paceline.llm import packing, tokencount

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", "a  b\n\n c", "Don't they'll we've I'm'll x'", "<|endoftext|>hi<|endoftext|> <|endo <|startoftext|>", "ΣΑΣ ÀÉ İstanbul ﬁ été", "\x1ca\x1db \x01 x\x01y",
    "你好 世界🙂👍🏽 1234567 12.5€", " a b　c\u0085d", "foo\t\tbar \n", "   lead", "trail   \n\n", "a \nb", "a\n b", "!!!'re 're", "x" * 3000, "é café",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    alphabet = list("aé'sl rtve\n\t .,1 ５中<|>endoftext🙂ßΣ")
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(400)]


def test_ids_are_the_library_s(texts):
    own, library = packing.word_ids(WORDS), Tokenizer.from_file(WORDS)
    for t in texts:
        assert array("I", own.encode(t)).tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_counts_at_every_prefix(texts):
    own, library = tokencount.prefix_counter(BYTES), Tokenizer.from_file(BYTES)
    for t in texts:
        prefix = own.prefixes(t)
        assert len(prefix) == len(t.encode())
        for k in range(1, min(len(t), 60) + 1):
            assert prefix[len(t[:k].encode()) - 1] == len(library.encode(t[:k], add_special_tokens=False).ids), t[:k]


def test_budget_cut():
    own = tokencount.prefix_counter(BYTES)
    text = "héllo wörld, this is a longer text 🙂 of tokens".encode()
    prefix = own.prefixes(text.decode())
    for budget in range(int(prefix[-1]) + 1):
        cut = tokencount.bytes_within(text, prefix, budget)
        assert cut == 0 or prefix[cut - 1] <= budget
        text[:cut].decode()


def test_totals_of_units_are_the_prefix_table(texts):
    own = tokencount.prefix_counter(BYTES)
    for t in texts:
        raw, prefix = t.encode(), own.prefixes(t)
        total = int(prefix[-1]) if len(prefix) else 0
        for budget in {0, 1, 2, 3, 7, 20, max(total - 1, 0), total, total + 1}:
            assert own.within(t, budget) == (total, tokencount.bytes_within(raw, prefix, budget)), (t, budget)


def best_fit(lengths, capacity, most_open):
    """The same rule without a bitset: search all open bins."""
    bins, made, out = [], 0, []
    for n in lengths:
        fit = [b for b in bins if b[1] >= n]
        if fit:
            b = min(fit, key=lambda b: b[1])
            least = [x for x in bins if x[1] == b[1]]
            b = least[-1]
            bins.remove(b)
        else:
            if len(bins) >= most_open:
                low = min(x[1] for x in bins)
                bins.remove([x for x in bins if x[1] == low][-1])
            b = [made, capacity]
            made += 1
        out.append((b[0], capacity - b[1]))
        b[1] -= n
        if b[1]:
            bins.append(b)
    return out


@pytest.mark.parametrize("most_open", [1, 3, 50])
def test_best_fit(most_open):
    rng = random.Random(most_open)
    lengths = [rng.randint(1, 64) for _ in range(500)]
    own = packing.BestFit(64, most_open)
    assert [own.place(n) for n in lengths] == best_fit(lengths, 64, most_open)


def test_pack_documents(spark):
    library = Tokenizer.from_file(WORDS)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma,", "delta."]) for _ in range(rng.choice([1, 20, 300, 3000])))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "null id"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as sequence_id", "3 as length")
    got = packing.pack_documents(docs, WORDS, keep_ids=True).collect()
    per = defaultdict(list)
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(array("I", r["ids"]).tobytes()) and len(r["ids"]) == r["length"] <= 2048
        per[r["doc_id"]].append(r)
    for i, text in rows:
        want = library.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(per[i], key=lambda r: r["piece"])
        if i == 7:
            continue
        assert [x for r in own for x in r["ids"]] == want
        assert [r["start"] for r in own] == [2048 * k for k in range(len(own))]
        assert all(r["length"] == 2048 for r in own[:-1])
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(bins) <= total / 2048 * 1.1 + 4
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0
    assert sorted(map(str, packing.pack_documents(docs, WORDS).collect())) == sorted(map(str, packing.pack_documents(docs, WORDS).collect()))


def test_pack_in_place(spark):
    rng = random.Random(4)
    texts = [" ".join(["alpha"] * rng.choice([1, 30, 700, 5000])) for _ in range(80)] + [None, "", "twice", "twice"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    plain, own = (packing.pack_documents(docs, WORDS, keep_ids=True, in_place=k) for k in (False, True))
    plans = [df._jdf.queryExecution().toString().split("== Physical Plan ==")[1] for df in (plain, own)]
    assert [p.count("Exchange hashpartitioning") for p in plans] == [2, 1]  # docs' own, and that of the pieces
    pieces = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
    assert sorted(map(str, own.select(*pieces).collect())) == sorted(map(str, plain.select(*pieces).collect()))
    bins = defaultdict(list)
    for r in own.collect():
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spots in bins.values():
        spots.sort()
        assert [o for o, _ in spots] == [sum(n for _, n in spots[:k]) for k in range(len(spots))]
        assert sum(n for _, n in spots) <= 2048
    total = sum(n for spots in bins.values() for _, n in spots)
    assert len(bins) <= total / 2048 * 1.1 + 3
    assert packing.pack_documents(docs.limit(0), WORDS, in_place=True).count() == 0


def test_token_counts(spark):
    library = Tokenizer.from_file(BYTES)
    rows = [(1, None), (2, ""), (None, "héllo"), (4, "word " * 1500), (4, "word " * 1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as n_tokens")
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencount.token_counts(docs, BYTES).collect())
    want = sorted((str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows)
    assert got == want
    full = tokencount.token_prefixes(docs, BYTES).where("doc_id = 4").first()
    assert len(full["prefix_tokens"]) == full["n_bytes"] == 7500
    assert tokencount.token_counts(docs.limit(0), BYTES).count() == 0

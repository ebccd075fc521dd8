"""Cross-tokenizer alignment against a plain version with the libraries themselves."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from paceline.llm import align
from paceline.llm.vocab import read_ranks

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    raw = {k: t for t, k in read_ranks(A)[0].items()}
    piece = lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()
    return a, b, raw, piece


def tokens(libraries, text):
    """((start, end, id) of A, of B), or None."""
    a, b, raw, piece = libraries
    if not text:
        return None
    out = []
    for ids, spell in ((a.encode(" " + text, add_special_tokens=False).ids, raw.get), (b.encode(text), piece)):
        if b"".join(map(spell, ids)) != (" " + text).encode():
            return None
        at, own = 0, []
        for k in ids:
            own.append((at, at + len(spell(k)), k))
            at = own[-1][1]
        out.append(own)
    return out


def plain(libraries, texts):
    own = [tokens(libraries, t) for t in texts]
    by_byte = lambda side: [k for k, (low, high, _) in enumerate(side) for _ in range(low, high)]
    # Tokens overlap where they hold a common byte.
    links = [[(t[0][x][2], t[1][y][2]) for x, y in dict.fromkeys(zip(by_byte(t[0]), by_byte(t[1])))] if t else [] for t in own]
    count = Counter(p for one in links for p in set(one))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for t, one in zip(own, links):
        if not t:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({x[1] for x in t[0]} & {x[1] for x in t[1]})
        groups = [([], []) for _ in cuts]
        for k, side in enumerate(t):
            for _, end, token in side:
                groups[bisect_left(cuts, end)][k].append(token)
        told = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((len(t[0]), len(t[1]), len(groups), len(one), sum(count[p] == top[p[0]] for p in one), sum(count[p] for p in one), hashlib.sha256(told.encode()).hexdigest()))
    return out


def fuzz(n):
    rng = random.Random(13)
    bits = ["the", "Token", "ization", " ", "  ", "\n", "\r\n", "\t", "é", "ñandú", "日本", "123", "4,567.89", "<|endoftext|>", "<s>", "</s>", "don't", "we'll", "'", "▁", "\x00", "\x1c", "\x85", "\xa0", " ", "　", ");\r", "}", "🙂", "ſ", "Ω", "—", "...", "ﬁ", "a" * 30]
    return ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_summary_is_the_plain_one(spark, libraries):
    texts = [None, "", " ", "\n", "  ", "x ", "\r", "same words here", "same words here", "same other words", "long " * 20_000, *fuzz(1500)]
    df = spark.createDataFrame([(k, t, "extra") for k, t in enumerate(texts)], "doc_id long, text string, `a.b` string").repartition(3)
    got = dict((r[0], r[1:]) for r in rows_of(align.alignment_summary(df, A, B)))
    want = plain(libraries, texts)
    assert sum(w[0] > 0 for w in want) > 1000 and sum(w[0] == 0 for w in want) > 50
    assert [got[k] for k in range(len(texts))] == want
    # Counts in small blocks give the same.
    few = df.where("doc_id < 60")
    want = plain(libraries, texts[:60])
    got = dict((r[0], r[1:]) for r in rows_of(align.alignment_summary(few, A, B, most_pairs=7)))
    assert [got[k] for k in range(60)] == want


def test_query_is_the_plain_one(spark, sf_dir, libraries):
    from paceline.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = dict((r[0], r[1:]) for r in rows_of(QUERIES["op13_token_alignment"](spark, sf_dir)))
    assert [got[r["doc_id"]] for r in docs] == plain(libraries, [r["text"] for r in docs])


def test_groups_are_given_whole(spark, libraries):
    df = spark.createDataFrame([(1, "Tokenization of words"), (None, "naïve"), (3, None), (4, "a▁b")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in align.align_documents(df, A, B).collect()}
    t = tokens(libraries, "Tokenization of words")
    assert [k for g in got[1]["groups"] for k in g["a"]] == [x[2] for x in t[0]]
    assert [k for g in got[1]["groups"] for k in g["b"]] == [x[2] for x in t[1]]
    assert got[1]["n_groups"] == len(got[1]["groups"]) and got[None]["n_a"] > 0
    assert [(got[k]["n_a"], got[k]["groups"]) for k in (3, 4)] == [(0, []), (0, [])]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert align.alignment_summary(df, A, B).count() == 0 == align.align_documents(df, A, B).count()
    assert align.alignment_summary(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B).collect()[0]["n_links"] == 0


def test_repeated_rows_count_each(spark):
    df = spark.createDataFrame([(1, "apple"), (1, "apple")], "doc_id long, text string")
    assert {r["n_docs"] for r in align.link_counts(df, A, B).collect()} == {2}


def test_pointers_lead_to_the_last_token():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 60)
        ends = [sorted({n, *rng.sample(range(1, n + 1), rng.randint(0, n))}) for _ in range(2)]
        a, b = align.terminal_tokens(*(np.array(e) for e in ends))
        cuts = sorted(set(ends[0]) & set(ends[1]))
        last = [next(ends[0].index(c) for c in cuts if c >= e) for e in ends[0]], [next(ends[0].index(c) for c in cuts if c >= e) for e in ends[1]]
        assert (a.tolist(), b.tolist()) == last

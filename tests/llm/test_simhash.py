"""SimHash, components and winnowing against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from paceline.llm import components, simhash, winnow


def plain_fingerprint(text, n=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "A B c d", "à b É d e f g h", "x " * 50, "the quick brown fox jumps over the lazy dog again and again"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_is_spark_s_hash(spark):
    row = spark.sql("select xxhash64('a b c') as h").first()
    assert simhash.fingerprint("a b c") == row["h"] % 2**64


@pytest.mark.parametrize("tile", [8, 64, 4096])
def test_similar_fingerprints(spark, tile):
    rng = random.Random(7)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(8)} | {0, 1, 2**64 - 1}
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = groups(signed, [tuple(r) for r in simhash.similar_fingerprints(df, 4, tile).collect()])
    want = groups(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4])
    assert got == want


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(70)] + [(5, 5), (7, 6), (7, 6)]
    df = spark.createDataFrame(links + [(None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    assert got == groups({x for p in links for x in p}, links)
    assert components.connected_components(df.limit(0)).count() == 0


def test_simhash_components(spark):
    base = "the members of the board met on monday to talk about the new plan for the old harbour and its many small boats"
    words = base.split()
    rows = [(5, base), (3, base), (9, base.upper()), (4, " ".join([*words, "end"])), (20, "entirely other words stand here in a row of no import at all"), (30, None), (31, ""), (32, "\n"), (20, "entirely other words stand here in a row of no import at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as fp", "1 as component_id")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs).collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows}
    want = groups(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    kept = sorted(r["doc_id"] for r in simhash.dedup_simhash(docs).collect())
    assert kept == sorted(set(want.values()))
    assert simhash.dedup_simhash(docs).columns == docs.columns
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def plain_winnow(text, k, w):
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not len(codes):
        return []
    grams = [codes[i : i + k] for i in range(max(1, len(codes) - k + 1))]
    h = [int(winnow.gram_hashes(g, len(g))[0]) for g in grams]
    out = []
    for i in range(max(1, len(h) - w + 1)):
        part = h[i : i + w]
        j = i + max(j for j, x in enumerate(part) if x == min(part))
        if not out or out[-1][1] != j:
            out.append((h[j], j))
    return out


@pytest.mark.parametrize(("k", "w"), [(8, 8), (5, 3), (1, 1), (7, 12)])
def test_winnow(k, w):
    rng = random.Random(k)
    for n in (0, 1, 3, k, k + w, 200):
        text = "".join(rng.choice("abé🙂 ") for _ in range(n))
        h, p = winnow.winnow(text, k, w)
        assert list(zip(h.tolist(), p.tolist())) == plain_winnow(text, k, w)


def test_match_guarantee():
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(50):
        shared = text(8 + 8 - 1)
        a, b = text(100) + shared + text(80), text(37) + shared + text(11)
        assert set(winnow.winnow(a, 8, 8)[0].tolist()) & set(winnow.winnow(b, 8, 8)[0].tolist())


def plain_likeness(a, b):
    x, y = (Counter(h for h, _ in plain_winnow(t, 8, 8)) for t in (a, b))
    return (x & y).total() / (x | y).total() if x or y else 1.0


@pytest.mark.parametrize("range_bytes", [10_000_000, 500, 60])
def test_edit_fingerprints(spark, range_bytes):
    """All columns by brute force, with null and repeated ids, repeated rows and more ranges than rows."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abc é🙂") for _ in range(rng.randint(0, n)))
    rows = [(i * 3, text(90)) for i in range(40)] + [(200, None), (201, ""), (None, text(50)), (None, text(50)), (None, None), (15, "twice"), (15, "twice"), (15, text(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as fingerprint", "1 as part").repartition(5)
    ties = {r["t"]: r["h"] for r in docs.selectExpr("coalesce(text, '') as t", "xxhash64(coalesce(text, '')) as h").collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1]]))
    want = []
    for (i, own), (_, after) in zip(order, order[1:] + order[:1]):
        edited = own[: len(own) - len(own) // 4] + after[: len(own) // 4]
        prints = [winnow.fingerprint(*winnow.winnow(t, 8, 8)).hex() for t in (own, edited)]
        want.append((i, len(own), hashlib.sha256(edited.encode()).hexdigest(), *prints, round(plain_likeness(own, edited), 9), round(plain_likeness(own, after), 9)))
    got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in winnow.edit_fingerprints(docs, range_bytes=range_bytes).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_likeness_from_the_returned_strings(spark):
    """near_* follow from the fingerprints alone, and come near the multisets' Jaccard index for texts of more hashes than a sketch holds."""
    rng = random.Random(6)
    word = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(word) for _ in range(rng.randint(100, 900)))) for i in range(30)] + [(90, rows_text := "same " * 900), (91, rows_text)]
    got = winnow.edit_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    off = []
    for r, after, (_, own), (_, other) in zip(got, got[1:] + got[:1], rows, rows[1:] + rows[:1]):
        assert r["near_edited"] == winnow.fingerprint_likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == winnow.fingerprint_likeness(r["fingerprint"], after["fingerprint"])
        edited = own[: len(own) - len(own) // 4] + other[: len(own) // 4]
        off += [r["near_edited"] - plain_likeness(own, edited), r["near_next"] - plain_likeness(own, other)]
    assert max(map(abs, off)) < 0.25 and abs(sum(off)) / len(off) < 0.03
    assert got[30]["fingerprint"] == got[31]["fingerprint"] and got[30]["near_next"] == 1 and got[0]["near_edited"] > 0.3 > got[0]["near_next"]


def test_fingerprints_hold_all_chosen_hashes(spark):
    """Hashes and positions of long texts come back from the string, and near_* are the exact index of the whole multisets."""
    rng = random.Random(8)
    word = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(word) for _ in range(400 * i))) for i in range(5)]
    got = winnow.edit_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), range_bytes=4000).orderBy("doc_id").collect()
    for r, (_, own), (_, other) in zip(got, rows, rows[1:] + rows[:1]):
        hashes, positions = winnow.chosen(bytes.fromhex(r["fingerprint"]))
        assert list(zip(hashes.tolist(), positions.tolist())) == [(h >> 32, p) for h, p in plain_winnow(own, 8, 8)]
        edited = own[: len(own) - len(own) // 4] + other[: len(own) // 4]
        assert r["near_edited"] == pytest.approx(plain_likeness(own, edited), abs=1e-9) and r["near_next"] == pytest.approx(plain_likeness(own, other), abs=1e-9)
    wide = winnow.winnow(rows[4][1], 8, 900)
    assert winnow.chosen(winnow.fingerprint(*wide))[1].tolist() == wide[1].tolist()


def test_edit_fingerprints_of_few_and_long_texts(spark):
    docs = spark.createDataFrame([(3, "x"), (4, "ab c" * 60_000)], "doc_id long, text string")
    assert winnow.edit_fingerprints(docs.where("doc_id = 3")).first()["near_next"] == 1
    assert winnow.edit_fingerprints(docs.limit(0)).count() == 0
    long = winnow.edit_fingerprints(docs).where("doc_id = 4").first()
    assert long["n_chars"] == 240_000 and 0.5 < long["near_edited"] <= 1 and long["n_selected"] > 30_000


def test_dedup_of_odd_tables(spark):
    """Null ids, null and empty texts, repeated rows and clashing names; an empty table."""
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (5, None), (4, ""), (None, None), (9, "x " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as fp", "1 as uid", "'r' as row", "2 as component_id")
    kept = simhash.dedup_simhash(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"], len(r["text"])) for r in kept.collect()) == [(3, 11), (4, 0), (9, 40_000)]
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in simhash.simhash_components(docs).collect())
    assert got == sorted([("None", 3), ("None", 3), ("3", 3), ("5", 4), ("4", 4), ("None", 4), ("9", 9)])
    assert simhash.with_fingerprint(docs).columns == ["doc_id", "text", "uid", "row", "component_id", "fp"]
    for empty in (simhash.dedup_simhash(docs.limit(0)), simhash.simhash_components(docs.limit(0))):
        assert empty.count() == 0

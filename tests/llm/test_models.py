"""Language mixtures, personal data and sampled segmentations against plain versions."""

import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from paceline.llm import langid, pii, segment

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = {
    "en": "the of and to in that with this for from have which their would there about other into more people".split(),
    "de": "der die und das nicht ein eine mit sich auf für von dem werden haben nach auch zwischen können schon".split(),
    "fr": "le la les des est une dans pour que qui avec sur pas plus nous vous leurs être très après".split(),
}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, rng.randint(3, 60)), lang) for i, lang in enumerate(list(WORDS) * 80)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def plain_trigrams(t):
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", t.lower()):
        w = f" {word} "
        out.update(w[i : i + 3] for i in range(len(w) - 2))
    return out


def test_trigram_counts():
    texts = ["Hello, World 42!", "", None, "Ünï-cödé\n\nÜnï", "a"]
    doc, gram, count = langid.trigrams(texts)
    for i, t in enumerate(texts):
        assert sorted(count[doc == i].tolist()) == sorted(plain_trigrams(t or "").values())
    # The same trigram has one number in every text.
    d2, g2, _ = langid.trigrams(["ünï", "x Ünï"])
    assert set(g2[d2 == 0]) <= set(g2[d2 == 1])


def test_held_out_accuracy_and_purity(spark, docs):
    got = langid.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(r["lang_pred"] == r["lang"] for r in held)
    # Labels of held-out rows play no part.
    wrong = docs.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 4 = 2 then 'xx' else lang end as lang")
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict_languages(wrong).collect()}
    assert again == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}


def test_mixture_shares(docs):
    model = langid.train(docs)
    rng = random.Random(9)
    both = text(rng, "en", 150) + " " + text(rng, "fr", 50)
    (lang, score, shares), (alone, _, one) = model.mixtures([both, text(rng, "de", 100)])
    assert lang == "en" and 0.55 < score < 0.9 and {s.split(":")[0] for s in shares.split(",")} == {"en", "fr"}
    assert alone == "de" and one == "de:1.00"


def test_em_climbs_to_the_plain_optimum():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(30), 3)
    count = rng.integers(1, 9, 30).astype(float)
    args = (p, count, np.zeros(30, int), np.array([0]), np.array([count.sum()]))
    share, ll = langid._em(*args, np.full((3, 1), 1 / 3), 400)
    grid = [(a, b, 1 - a - b) for a in np.linspace(0, 1, 101) for b in np.linspace(0, 1 - a, 101)]
    best = max((count * np.log(np.maximum(np.array(g) @ p, 1e-300))).sum() for g in grid)
    assert share.sum() == pytest.approx(1) and ll[0] >= best - 1e-3


def test_language_sets_against_all_sets(spark, docs):
    """The chosen set has the greatest penalised likelihood of all sets of languages, each fitted for very many rounds."""
    model = langid.train(docs)
    rng = random.Random(12)
    langs = sorted(WORDS)
    texts = [" ".join(text(rng, x, n) for x, n in zip(rng.sample(langs, 3), sizes)) for sizes in [(60, 0, 0), (40, 30, 0), (50, 25, 25), (30, 3, 0), (8, 6, 0)] * 6]
    told = model.mixtures(texts)
    for t, (_, _, shares) in zip(texts, told):
        _, gram, count = langid.trigrams([t])
        p, cost = model.p[:, gram], 3.0 * math.log(count.sum() + 1)
        best = (-math.inf, None)
        for size in range(1, len(model.names) + 1):
            for own in itertools.combinations(range(len(model.names)), size):
                share = np.full(size, 1 / size)
                for _ in range(3000):
                    part = share[:, None] * p[list(own)]
                    share = (part / part.sum(0) * count).sum(1) / count.sum()
                ll = float((count * np.log(share @ p[list(own)])).sum()) - (size - 1) * cost
                best = max(best, (ll, tuple(model.names[k] for k in own)))
        assert {x.split(":")[0] for x in shares.split(",")} == set(best[1]), (shares, best)


def test_language_edge_cases(spark, docs):
    odd = spark.createDataFrame([(1, None, None), (None, "1 2 3", "en"), (3, "", "fr"), (4, "the of and to in that", None)], "doc_id long, text string, lang string").selectExpr("*", "'z' as score")
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict_languages(odd.drop("score").unionByName(docs)).where("doc_id is null or doc_id in (1, 3)").collect()}
    assert rows[None] == ("und", 0.0)
    assert {r["lang_pred"] for r in langid.predict_languages(odd).collect()} == {"und"}  # nothing to learn from
    assert langid.predict_languages(docs.limit(0)).count() == 0
    told = langid.identify(odd, langid.train(docs), keep=("doc_id", "score"))  # its own score gives way
    assert told.columns == ["doc_id", "lang_pred", "score", "languages"] and told.where("score > 0").count() == 1
    assert langid.keep_identified(odd).count() == 0 and langid.keep_identified(odd).columns == odd.columns
    kept = langid.keep_identified(odd.drop("score").unionByName(docs))
    assert kept.columns == docs.columns and kept.count() == docs.count() + 1


def test_other_languages_and_junk_go(spark, docs):
    rng = random.Random(4)
    good = [text(rng, "en", 3), text(rng, "de", 1), "and the " + "42 -- " * 50, text(rng, "en", 40) + " " + text(rng, "fr", 40) + " " + text(rng, "de", 40), "with xqzv from which there would"]
    bad = ["Hallitus päätti eilen korottaa veroja ja kansalaiset eivät ole tyytyväisiä", "Правительство решило вчера повысить налоги", "政府昨天决定提高税收", "xqzv wkjh pqrx zzxcv bnmq wrtp lkjhg fdsa qwrtz", "the " + "kqzjx wvbpq " * 9]
    new = [(1000 + i, t, None) for i, t in enumerate(good)] + [(2000 + i, t, None) for i, t in enumerate(bad)]
    mixed = spark.createDataFrame(new, "doc_id long, text string, lang string").unionByName(docs)
    kept = {r["doc_id"] for r in langid.keep_identified(mixed).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} | {1000 + i for i in range(len(good))}


def test_background_is_a_distribution():
    code, count = langid.letters(["Hello, World 42!", None, "Ünï-cödé", "a"])
    assert dict(zip(code.tolist(), count.tolist())) == {**{ord(k): v for k, v in Counter("helloworldünïcödéa").items()}, 32: 5}
    for most in (3, 128):
        b = langid.background(code, count, most=most)
        assert b.sum() == pytest.approx(1) and b.min() > 0


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(t):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            ok = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 13 <= len(digits) <= 19 and plain_luhn(digits or "1"), 9 <= len(digits) <= 15][k]
            if ok:
                out.append((k, *m.span()))
    return out


def test_base_spans():
    rng = random.Random(8)
    for _ in range(5000):
        t = "".join(rng.choice("a1.@-+ ()9-4é\n256_%") for _ in range(rng.randint(0, 60)))
        assert sorted(pii.base_spans(t)) == sorted(plain_spans(t)), t
    for t in ("1" * 20000, "a" * 20000 + "@", "@" * 20000, "+1" * 9000, "1." * 9000):
        assert sorted(pii.base_spans(t)) == sorted(plain_spans(t)) if len(t) < 100 else pii.base_spans(t) is not None


def test_messages_give_exact_marginals_on_a_tree():
    rng = np.random.default_rng(3)
    n = pii.O + 1
    field = pii.Field({s: rng.normal(size=n) for s in "ab"}, np.zeros(n), rng.normal(size=(n, n)) * 0.5, skip=2.0)
    nodes = [pii.Token(i, i + 1, (f"k{i}",), s, pii.O) for i, s in enumerate("aba")]
    got = field.label(nodes, rounds=200)
    phi = [field.local[t.shape] for t in nodes]
    want = np.zeros((3, n))
    for x in np.ndindex(n, n, n):
        weight = math.exp(sum(phi[i][x[i]] for i in range(3)) + field.chain[x[0], x[1]] + field.chain[x[1], x[2]])
        for i in range(3):
            want[i, x[i]] += weight
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-3)


def test_messages_around_a_loop_stay_close_to_exact_marginals():
    """Tokens 0 and 2 are alike, 1 and 3 too, and neighbours form a chain: four nodes with two loops, against all labellings."""
    rng = np.random.default_rng(5)
    n = pii.O + 1
    for _ in range(6):
        field = pii.Field({s: rng.normal(size=n) for s in "ab"}, np.zeros(n), rng.normal(size=(n, n)) * 0.3, skip=1.5)
        nodes = [pii.Token(i, i + 1, (f"k{i % 2}",), s, pii.O) for i, s in enumerate("abab")]
        chain, skip = pii.edges(nodes)
        assert chain == [(0, 1), (1, 2), (2, 3)] and skip == [(0, 2), (1, 3)]
        got = field.label(nodes, rounds=500)
        want = np.zeros((4, n))
        for x in np.ndindex(*[n] * 4):
            weight = math.exp(sum(field.local[t.shape][x[i]] for i, t in enumerate(nodes)) + sum(field.chain[x[i], x[j]] for i, j in chain) + sum(field.skip * (x[i] == x[j]) for i, j in skip))
            for i in range(4):
                want[i, x[i]] += weight
        want /= want.sum(1, keepdims=True)
        assert np.abs(got - want).max() < 0.1 and (got.argmax(1) == want.argmax(1)).all()


def test_taken_stretches_and_names_against_plain_versions():
    rng = random.Random(2)
    for _ in range(300):
        spans = [(a, a + rng.randint(1, 6)) for a in (rng.randrange(60) for _ in range(rng.randint(0, 8)))]
        taken = pii.Taken(spans)
        for _ in range(20):
            a = rng.randrange(60)
            b = a + rng.randint(1, 5)
            assert taken.free(a, b) == all(b <= x or a >= y for x, y in spans)
        names = {"".join(rng.choice("ab.1") for _ in range(rng.randint(2, 4))) for _ in range(3)}
        text = "".join(rng.choice("ab.1@ ,") for _ in range(40))
        pattern = re.compile(r"(?<![a-z0-9._%+@-])(?:" + "|".join(map(re.escape, sorted(names, key=lambda x: (-len(x), x)))) + r")(?![a-z0-9_%+@-])(?!\.[a-z0-9])")
        assert list(pii._names(text, names)) == [m.span() for m in pattern.finditer(text)], (text, names)


def test_agreement_is_learned_from_alike_tokens(spark):
    """Each document has a card twice: 60 pairs that agree raise the odds; nothing else is alike."""
    docs = spark.createDataFrame([(i, f"pay 4041894974608795 or 4041 8949 7460 8795, order {i}") for i in range(60)], "doc_id long, text string")
    assert pii.train(docs).skip == pytest.approx(math.log(460)) and pii.train(docs.limit(0)).skip == pytest.approx(math.log(400))


def test_masking_edge_cases(spark):
    text = "mail jo.doe7@mail.example.com " * 3
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "x" * 300_000 + " " + text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'kept' as spans")
    got = pii.mask_pii(docs)  # no n_chars in this table
    assert got.columns == ["doc_id", "text", "spans"] and pii.mask_pii(docs.limit(0)).count() == 0
    out = sorted((str(r["doc_id"]), len(r["text"] or ""), r["text"]) for r in got.collect() if r["text"] is not None)
    masked = "mail [EMAIL] " * 3
    assert out == sorted([("1", len(masked), masked)] * 2 + [("None", len(masked), masked), ("3", 0, ""), ("4", 300_001 + len(masked), "x" * 300_000 + " " + masked)])


def test_long_documents_take_time_in_proportion():
    parts = [f"mail user{i % 90}.x@mail{i % 7}.example.com or +1 (342) 555-{i % 1000:04d} and 1-342-555-{i % 1000:04d} then" for i in range(2000)]
    field = pii.Field({}, np.zeros(pii.O + 1), np.zeros((pii.O + 1,) * 2))

    def seconds(text):
        began = time.process_time()
        base = pii.base_spans(text)
        pii.tokens(text, base)
        return time.process_time() - began

    text = " ".join(parts)
    seconds(text)
    assert seconds(text * 4) < 12 * seconds(text) + 0.5 and len(field.spans(text, pii.base_spans(text))) >= 4000


def test_field_spreads_labels_to_repeats(spark):
    rows = [(i, f"Call +1 (342) 555-{1000 + i} or mail ab.{i}x@mail.example.com or pay 4041894974608795 at 10.0.0.{i}") for i in range(40)]
    rows.append((50, "Call +1 (342) 555-1234 or 1-342-555-1234 today. Order 123456789012. Mail bosbt.42@mail8.example.com, bosbt.42 says hi."))
    rows += [(60, None), (61, ""), (None, "nothing here"), (62, "order 123456789012 of 2024")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as spans")
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    for i, t in rows:
        base = plain_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == j for x in base) for j in range(4)]
        assert set(filter(None, pii.listed(base).split(","))) <= set(got[i]["spans"].split(","))
    found = {rows[40][1][int(a) : int(b)] for _, a, b in (s.split(":") for s in got[50]["spans"].split(","))}
    assert found == {"+1 (342) 555-1234", "1-342-555-1234", "bosbt.42@mail8.example.com", "bosbt.42"}
    assert all(got[i]["spans"] == "" for i in (60, 61, None, 62))
    masked = {r["doc_id"]: r for r in pii.mask_pii(docs.selectExpr("doc_id", "text", "cast(length(text) as bigint) as n_chars")).collect()}
    assert masked[50]["text"] == "Call [PHONE] or [PHONE] today. Order 123456789012. Mail [EMAIL], [EMAIL] says hi." and masked[50]["n_chars"] == len(masked[50]["text"])
    assert masked[62]["text"] == rows[-1][1] and masked[60]["text"] is None
    assert pii.find_pii(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def own():
    return segment.pieces(PIECES)


ODD = ["", "a", "  a  b ", "\n\n x\n", "🙂🙂 中文字", "\ttab  \n", "Hello, world! It's 2024.", "x" * 200, "▁", "é" * 60]


def test_encoding_is_the_library_s(own):
    rng = random.Random(1)
    for t in ODD + ["".join(rng.choice("aé'sl rtve\n\t .,1 ５中<|>🙂ßΣ  ²") for _ in range(rng.randint(1, 40))) for _ in range(300)]:
        ids = own.encode(t).tolist()
        assert ids == own.sp.encode(t)
        if "▁" not in t:
            assert own.decode(ids) == t


def all_paths(own, t):
    """{ids: log-probability} of every segmentation of ``t``, by the weights of the pieces alone."""
    text = (" " + t).replace(" ", "▁")
    piece = {own.sp.id_to_piece(i): i for i in np.flatnonzero(own.weight).tolist()}
    byte = math.log(own.byte_weight)

    def walk(at):
        if at == len(text):
            return {(): 0.0}
        steps = [((piece[text[at:e]],), math.log(own.weight[piece[text[at:e]]]), e) for e in range(at + 1, len(text) + 1) if text[at:e] in piece]
        if text[at] not in piece:
            raw = text[at].encode()
            steps.append((tuple(own.byte[b] for b in raw), byte * len(raw), at + 1))
        return {(*ids, *p): x + y for ids, x, e in steps for p, y in walk(e).items()}

    out = walk(0)
    top = max(out.values())
    total = top + math.log(sum(math.exp(x - top) for x in out.values()))
    return {p: x - total for p, x in out.items()}


def test_sampling_without_replacement(own):
    t, n, k = "ab to", 6000, 3
    paths = all_paths(own, t)
    assert sum(map(math.exp, paths.values())) == pytest.approx(1)
    search = segment.Search(own, *own.units([t] * n), segment.row_seeds(list(range(n)), 1))
    first, second, weight = Counter(), Counter(), Counter()
    for found, after in search.top(k):
        got = [tuple(search.ids[p].tolist()) for p, _, _ in found]
        assert len(set(got)) == k and all(paths[g] == pytest.approx(x) for g, (_, x, _) in zip(got, found))
        assert [v for _, _, v in found] == sorted((v for _, _, v in found), reverse=True) and found[-1][2] > after
        first[got[0]] += 1
        second[got[1]] += 1
        for g, (_, x, _) in zip(got, found):
            weight[g] += 1 / math.exp(segment.log_inclusion(x, after))
    p = {a: math.exp(x) for a, x in paths.items()}
    for a in sorted(p, key=p.get, reverse=True)[:4]:
        want = sum(p[b] * p[a] / (1 - p[b]) for b in p if b != a)
        assert first[a] / n == pytest.approx(p[a], abs=0.02) and second[a] / n == pytest.approx(want, abs=0.025)
    assert weight[max(p, key=p.get)] / n == pytest.approx(1, abs=0.05)


def sampled(own, texts, keys, k=3):
    search = segment.Search(own, *own.units(texts), segment.row_seeds(keys, 1))
    return [([(tuple(search.ids[p].tolist()), x, v) for p, x, v in found], after) for found, after in search.top(k)]


def test_all_segmentations_of_short_texts_come_out(own):
    """Asked for more than there are, the search gives each segmentation once, with its log-probability by brute force."""
    for t in ("a", "to", "é🙂", "b\n c", "a  b", "        "):
        paths = all_paths(own, t)
        ((found, after),) = sampled(own, [t], [7], k=len(paths) + 5)
        assert {p: pytest.approx(x, abs=1e-6) for p, x, _ in found} == paths and len(found) == len(paths) and after == -math.inf
    at_once = sampled(own, ["a", "to", "é🙂 x"], [1, 2, 3], k=4)
    assert at_once == [sampled(own, [t], [i], k=4)[0] for i, t in enumerate(["a", "to", "é🙂 x"], 1)]


def test_samples_do_not_depend_on_the_batch(own):
    texts = [" ".join(f"word{i * j % 17} is{'ab' * (j % 5)}, {j}" for j in range(200)) for i in range(6)]
    alone = [sampled(own, [t], [i])[0] for i, t in enumerate(texts)]
    fresh = segment.Pieces(PIECES, most_edges=200)  # its tables are emptied all the time
    assert sampled(own, texts, list(range(6))) == alone and [sampled(fresh, [t], [i])[0] for i, t in enumerate(texts)] == alone


def test_units_are_known_by_their_characters(spark, own):
    """Polynomial hashes modulo 2^64 take the Thue-Morse word and its complement for the same."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string").coalesce(1)
    got = segment.sample_segmentations(docs, PIECES).collect()
    assert all(r["round_trip"] for r in got) and len(got) == 8
    assert {r["doc_id"]: r["ids"] for r in got if r["sample"] == 0} == {1: own.sp.encode(a), 2: own.sp.encode(b)}


def test_long_unbroken_texts(own):
    """9,000 letters are one unit of more than 4,096 steps: no draw is used twice, and every sample spells the text."""
    text = "internationalisation" * 450
    assert own.encode(text).tolist() == own.sp.encode(text)
    ((found, _),) = sampled(own, [text], [3])
    assert len({p for p, _, _ in found}) == 3
    spelt = ("▁" + text).encode()
    assert all(own.surface(np.array(p)) == spelt for p, _, _ in found)
    key = segment.row_places(np.array([5], np.uint64), np.array([0]))
    draws = {float(segment.uniform(key, what, turn, step)[0]) for what in ("walk", "leave") for turn in range(3) for step in range(6000)}
    assert len(draws) == 36_000


def test_sample_segmentations(spark, own):
    rows = [(i, t) for i, t in enumerate(ODD) if "▁" not in t] + [(None, "null id"), (90, None), (91, "twice"), (91, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as sample")
    got = segment.sample_segmentations(docs, PIECES, k=4).collect()
    assert all(r["round_trip"] for r in got)
    for i, t in rows:
        mine = [r for r in got if r["doc_id"] == i]
        copies = sum(1 for j, _ in rows if j == i)
        plain = [r for r in mine if r["sample"] == 0]
        assert all(r["ids"] == own.sp.encode(t or "") for r in plain) and len(plain) == copies
        sampled = [tuple(r["ids"]) for r in mine if r["sample"] > 0]
        assert len(set(sampled)) * copies == len(sampled)
        assert all(own.decode(list(s)) == (t or "") for s in sampled)
    form = lambda rows: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)
    assert form(segment.sample_segmentations(docs.repartition(7), PIECES, k=4).collect()) == form(got)
    ids = segment.encode(docs, PIECES)
    back = {(r["doc_id"], r["text"]) for r in segment.decode(ids, PIECES).collect()}
    assert back == {(i, t or "") for i, t in rows}
    assert segment.sample_segmentations(docs.limit(0), PIECES).count() == 0

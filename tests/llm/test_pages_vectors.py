"""HTML extraction, WARC round trips and vector links; the pipeline as a whole."""

import base64
import hashlib
import html
import random
import re
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import pytest

from paceline.llm import embeddings, html_text, warc

ROOT = str(Path(__file__).resolve().parents[2])
STORY = "This is a paragraph of the story with quite a lot of words in it, long enough to be seen as text."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<p>", ""), ("plain words", "plain words"),
        ("<article><h1>A  title</h1><p>one <b>bo</b>ld</p><p>two&nbsp;&amp; three<br>four</article><footer>no</footer>", "A title one bold two & three four"),
        (f"<nav><a href=1>Home</a></nav><div class='cookie-notice'>We use cookies</div><h1>Head</h1><div><p>{STORY}<p>Short.<p>{STORY}</div><div id=comments><p>{STORY}</div><aside>{STORY}</aside>", f"Head {STORY} Short. {STORY}"),
        (f"<script>var t='</p><p>{STORY}';</script><style>p{{}}</style><main>x<form>{STORY}</form>y</main>", "x y"),
        (f"<article>{STORY}</article><div class='sidebar'>{STORY} {STORY}</div>", STORY),
        (f"<div class='layout has-sidebar'><article class=post><div class=post-header><h1>T</h1></div><p>{STORY}</p></article></div><article class='comment'>{STORY} {STORY}</article>", f"T {STORY}"),
        (f"<div id=pageMain><h2>Head</h2><p>{STORY}</p><p>End.</p></div><div class=userComments><p>{STORY}</p></div><ul><li><a href=1>{STORY}</a></ul>", f"Head {STORY} End."),
        (f"<div><p>{STORY}<div role=alert>{STORY}</div><p hidden>{STORY}</p><p style='display: none'>{STORY}</p>x</div>", f"{STORY} x"),
        ("<article>a &lt;b&gt; &#233; &#x1F642;</article>", "a <b> é 🙂"),
    ],
)
def test_extract(page, text):
    assert html_text.extract(page) == text


PARTS = [f"Part {i}. {STORY}" for i in range(4)]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # a story in plain divs beside a short article
        (f"<article><h3>Teaser</h3><p>A short word on it.</p></article><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul><div>{PARTS[0]}</div><div>{PARTS[1]}</div>", f"{PARTS[0]} {PARTS[1]}"),
        (f"<div>{PARTS[0]}</div><div>{PARTS[1]}</div><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul><article><h3>Teaser</h3><p>A short word on it.</p></article>", f"{PARTS[0]} {PARTS[1]}"),
        # several articles, and a story that goes on beyond one
        ("".join(f"<article><h2>{i}</h2><p>{t}</p></article>" for i, t in enumerate(PARTS)), " ".join(f"{i} {t}" for i, t in enumerate(PARTS))),
        (f"<div>{PARTS[0]}</div><article><p>{PARTS[1]}</p><p>x</p></article><div>{PARTS[2]}</div>", f"{PARTS[0]} {PARTS[1]} x {PARTS[2]}"),
        (f"<p>A tagline</p><article><h1>T</h1><p>{PARTS[0]}</p></article><p>Bottom</p>", f"T {PARTS[0]}"),
    ],
)
def test_run_before_elements(page, text):
    assert html_text.extract(page) == text


SHORT = [f"Item {i}" for i in range(6)]
LIST = "<ul>" + "".join(f"<li>{x}</li>" for x in SHORT) + "</ul>"
TABLE = "<table>" + "".join(f"<tr><td>{x}<td>{i}" for i, x in enumerate(SHORT)) + "</table>"
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Link {i}</a>" for i in range(5)) + "</ul>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body>{LINKS}<div id=story><p>{PARTS[0]}</p>{LIST}<p>{PARTS[1]}</p><p>{PARTS[2]}</p></div>{LINKS}</body>", " ".join([PARTS[0], *SHORT, PARTS[1], PARTS[2]])),
        (f"<div id=story><p>{PARTS[0]}</p><p>{PARTS[1]}</p>{TABLE}<p>{PARTS[2]}</p></div>", " ".join([PARTS[0], PARTS[1], *(f"{x} {i}" for i, x in enumerate(SHORT)), PARTS[2]])),
        (f"<div id=story><p>{PARTS[0]}</p><p><a href=1>{PARTS[1]}</a></p><p>{PARTS[2]}</p></div>{LINKS}", " ".join(PARTS[:3])),
        (f"<div id=story><p>{PARTS[0]}</p>{LINKS}<p>{PARTS[1]}</p></div>", f"{PARTS[0]} Link 0 Link 1 Link 2 Link 3 Link 4 {PARTS[1]}"),
        # each paragraph in its own element; an interview; a list in the first of two articles
        (f"<div id=story><div class=par>{PARTS[0]}</div>" + "".join(f"<div class=par>{x}</div>" for x in SHORT) + f"<div class=par>{PARTS[1]}</div></div>", " ".join([PARTS[0], *SHORT, PARTS[1]])),
        (f"<p>{PARTS[0]}</p>" + "".join(f"<p>{x}</p>" for x in SHORT) + f"<p>{PARTS[1]}</p>", " ".join([PARTS[0], *SHORT, PARTS[1]])),
        (f"<article><p>{PARTS[0]}</p>{LIST}</article><article><p>{PARTS[1]}</p><p>{PARTS[2]}</p></article>", " ".join([PARTS[0], *SHORT, PARTS[1], PARTS[2]])),
        # text in another part of the page stays out
        (f"<div id=story><p>{PARTS[0]}</p><p>{PARTS[1]}</p></div>{LINKS}<div class=about><p>{PARTS[2]}</p></div>", f"{PARTS[0]} {PARTS[1]}"),
        (f"<table><tr><td>{LINKS}<p>{PARTS[3]}</p>{LINKS}</td><td><p>{PARTS[0]}</p>{LIST}<p>{PARTS[1]}</p><p>{PARTS[2]}</p></td></tr></table>", " ".join([PARTS[0], *SHORT, PARTS[1], PARTS[2]])),
    ],
)
def test_runs_of_one_part(page, text):
    assert html_text.extract(page) == text


def plain_runs(sizes, width, surge):
    """(text, first line, line after the last) of each run, straight from the definition of the block distribution."""
    blocks = [sum(sizes[i : i + width]) for i in range(len(sizes))]
    limit, runs, i = min(surge, 0.5 * max(blocks)), [], 0
    while i < len(blocks):
        j = i
        while j < len(blocks) and blocks[j] >= limit:
            j += 1
        if j > i:
            stop = min(len(sizes), j + width - 1)
            while stop > i and not sizes[stop - 1]:
                stop -= 1
            runs.append((sum(sizes[i:stop]), i, stop))
        i = max(j, i + 1)
    return runs


def test_surge_and_dive_by_their_definition():
    """Each line a part of its own in the body: the greatest run is that of the plain version and follows its parameters; where it
    spans several parts the page is the container, and all from the first surge to the last dive belongs to it."""
    rng = random.Random(6)
    changed = 0
    for _ in range(300):
        sizes = [rng.choice([0, 0, 4, 8, 20, 70, 150]) for _ in range(rng.randint(1, 25))]
        body = html_text.Node(None, "body", ("body", ""))
        rows = [html_text.Line("x" * max(n, 4), 0 if n else 4, 0, False, html_text.Node(body, "section", ("section", str(i)))) for i, n in enumerate(sizes)]
        found = []
        for width, surge in ((3, 60.0), (2, 30.0), (5, 140.0)):
            runs = plain_runs(sizes, width, surge)
            _, first, stop = max(runs, key=lambda r: (r[0], -r[1]))
            if sum(n > 0 for n in sizes[first:stop]) > 1:
                first, stop = runs[0][1], runs[-1][2]
            while first < stop and not sizes[first]:
                first += 1
            assert html_text.main_lines(rows, width, surge) == rows[first:stop], (sizes, width, surge)
            found.append((first, stop))
        changed += len(set(found)) > 1
    assert changed > 50


def test_deep_long_and_odd_pages(spark):
    deep = "<div>" * 6000 + f"<p>{STORY}</p>" + "</div>" * 6000
    unclosed = "<b><div><li>" * 3000 + STORY + "</x>" * 3000
    began = time.process_time()
    assert html_text.extract(deep) == STORY and STORY in html_text.extract(unclosed)
    assert time.process_time() - began < 5
    rows = [(1, "u", f"<p>{STORY}</p>")] * 2 + [(None, None, f"<p>{STORY}</p>"), (2, "u", None), (3, "u", ""), (4, "u", "<p>" + f"{STORY} " * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "7 as n_chars")
    got = sorted((str(r["page_id"]), str(r["url"]), r["text"], r["n_chars"]) for r in html_text.extract_main_text(pages).collect())
    long = " ".join([STORY] * 20_000)
    assert got == sorted([("1", "u", STORY, len(STORY))] * 2 + [("None", "None", STORY, len(STORY)), ("2", "u", "", 0), ("3", "u", "", 0), ("4", "u", long, len(long))])
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


def test_whole_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract_main_text(pages.selectExpr("*", "1 as text")).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1|br|div|ul|li)\b[^>]*>", body)
        want = " ".join(filter(None, (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts)))
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_parse_streams_in_chunks():
    body = bytes(random.Random(1).randbytes(2_500_000)) + b"\r\n\r\nWARC/1.1\r\n"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    empty = b"WARC/1.1\r\nWARC-Type: revisit\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    packed = zlib.compressobj(1, zlib.DEFLATED, 31)
    packed = packed.compress(record + empty) + packed.flush()

    class Stream:
        def __init__(self, data):
            self.data, self.at = data, 0

        def read(self, n):
            self.at += n
            return self.data[self.at - n : self.at]

    for data in (record + empty, packed):
        rows = list(warc.parse(warc._inflate(Stream(data), 70_000), 1_000_000))
        assert [(n, len(d), last) for _, n, d, _, _, last in rows] == [(0, 1_000_000, False), (1, 1_000_000, False), (2, len(body) - 2_000_000, True), (0, 0, True)]
        assert b"".join(d for _, _, d, *_ in rows) == body
        assert rows[0][4] == hashlib.sha1(body[:1_000_000]).hexdigest() and rows[2][4] == hashlib.sha1(body).hexdigest()
    with pytest.raises(ValueError):
        list(warc.parse(iter([record[:-50]])))


@pytest.mark.parametrize("least", [0, 3])
def test_round_trip(spark, least):
    rows = [(1, "http://a/ b", "same"), (5, None, "same"), (9, "u", "same"), (2, "u", "é🙂"), (3, "u", None), (4, "u", ""), (6, "u", "other"), (6, "u", "other"), (None, "u", "same"), (7, "u", "ab"), (8, "u", "ab"), (-3, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as payload", "1 as record_type")
    got = sorted(map(str, (tuple(r) for r in warc.round_trip(pages, least=least).collect())))
    want = []
    for i, _, text in rows:
        body = (text or "").encode()
        top = max(j for j, _, t in rows if j is not None and (t or "").encode() == body)
        revisit = len(body) >= least and (i is None or i < top)
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    assert got == sorted(map(str, want))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_are_valid_and_read_by_many_tasks(spark):
    """Every record has a name of its own, revisits name a record that exists, and chunks are no larger than asked."""
    rows = [(i % 40, f"http://a/{i}", "common " * 300 if i % 3 == 0 else f"page {i % 60} " * 50) for i in range(240)] + [(None, None, None)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    listed = warc.write_archives(pages.selectExpr("page_id", "url", "encode(html, 'UTF-8') as payload"), chunk=500)
    chunks = warc.read_archives(listed, chunk=300)
    assert chunks.rdd.getNumPartitions() == listed.count() > 1
    table = chunks.collect()
    last = [r for r in table if r["last"]]
    names = [r["record_id"] for r in last]
    assert len(names) == len(set(names)) == len(rows) == sum(r["records"] for r in listed.collect())
    responses = {r["record_id"]: r for r in last if r["record_type"] == "response"}
    revisits = [r for r in last if r["record_type"] == "revisit"]
    assert revisits and all(responses[r["refers_to_id"]]["declared_digest"] == r["declared_digest"] for r in revisits)
    assert all(len(r["data"]) <= 300 for r in table)
    whole = {}
    for r in sorted(table, key=lambda r: r["chunk"]):
        whole[r["record_id"]] = whole.get(r["record_id"], b"") + r["data"]
    assert all(hashlib.sha1(whole[n]).hexdigest() == r["sha1_so_far"] and len(whole[n]) == r["bytes_so_far"] for n, r in responses.items())


def brute(rows, threshold):
    good = {i: np.array(v, float) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: lab for i, _, lab in rows}
    links = [(i, j) for i in good for j in good if i < j and label[i] == label[j] and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.sqrt((good[i] @ good[i]) * (good[j] @ good[j])) >= threshold]
    parent = {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return {i: (sum(i in p for p in links), find(i)) for i, _, _ in rows}


@pytest.mark.parametrize("tile", [5, 2048])
def test_vector_links(spark, tile):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] + rng.normal(size=24) * 0.3).tolist(), i % 3) for i in range(150)]
    rows += [(200 + i, centres[0].tolist(), 0) for i in range(20)]  # copies
    rows += [(300, None, 1), (301, [0.0] * 24, 1), (302, [float("nan")] * 24, 1), (303, centres[0].tolist(), None), (304, [], 1), (305, [None, *centres[0].tolist()[1:]], 0), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (308, (centres[0] * 1e-200).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "0 as n_links", "'x' as tile")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.link_vectors(df, tile=tile).collect()}
    want = brute([(i, (centres[0].tolist() if i == 308 else v), lab) for i, v, lab in rows], 0.93)
    assert got == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in embeddings.link_vectors(df, tile=tile).collect())
    assert embeddings.link_vectors(df.limit(0)).count() == 0


def test_one_label_holds_most_vectors(spark):
    """Many tiles of one label, floats, and tile pairs that the leading coordinates rule out."""
    rng = np.random.default_rng(3)
    points = np.concatenate([c + rng.normal(size=(60, 6)) * 0.15 for c in rng.normal(size=(9, 6))])
    points = np.concatenate([points, points[:1].repeat(150, 0)]).astype(np.float32)
    rows = [(i, v.tolist(), 0 if i % 10 else 1) for i, v in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.link_vectors(df, tile=16).collect()}
    assert got == brute(rows, 0.93)
    kind, packed = "<f4", embeddings.packed_vectors(df.selectExpr("vec_id", "label", "embedding as vector"), "<f4")
    classes = packed.groupBy("label", "key").agg({"vector": "first", "vec_id": "min"}).selectExpr("label", "`min(vec_id)` as class", "1L as size", "`first(vector)` as vector")
    count, second = embeddings.moments(classes, kind)
    reach = (2 - 2 * 0.93) ** 0.5 + 1e-6
    tiles = embeddings._tiles(classes, kind, embeddings.principal_axes(second), reach, 16, count)
    n = tiles.where("label = 0").count()
    assert n > 20 and 0 < embeddings._tile_pairs(tiles, reach).count() < n * (n + 1) // 2


def test_pipeline(spark, tmp_path):
    sys.path.insert(0, ROOT)
    import corpus_pipeline as pipeline

    en, fr = "the board of the town met to speak about the old harbour and the plan for its boats", "la ville et le port sont vieux et les bateaux sont dans le port depuis des ans"
    rows = [(i, f"{en} number {i} {'x' * (i % 7)} " * 3, "en", "s", 0) for i in range(30)] + [(50 + i, f"{fr} {i} " * 3, "fr", "s", 0) for i in range(30)]
    rows += [(100, rows[0][1], "en", "s", 0), (101, "12345 !!", "en", "s", 7), (102, None, None, None, None), (103, "write to jo.doe7@mail.example.com about the harbour of the town and the boats", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [docs]
    for name, stage in pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "_"))
        stage(spark, seen[-1], str(tmp_path)).write.parquet(path)
        seen.append(spark.read.parquet(path))
    ids = [{r["doc_id"] for r in df.select("doc_id").collect()} for df in seen]
    assert ids[0] - ids[1] == {101, 102}
    assert 100 not in ids[2] and 0 in ids[2] and ids[2] <= ids[1]
    assert ids[3] == ids[2] == ids[4]
    assert seen[3].where("doc_id = 103").first()["text"].startswith("write to [EMAIL] about")
    assert all(df.columns == list(pipeline.COLUMNS) for df in seen[1:4])
    assert pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "length", "ids_crc32").exceptAll(seen[4].select("doc_id", "piece", "length", "ids_crc32")).count() == 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    """An empty table gives no rows; null ids, repeated rows, very long texts and extra columns pass every stage."""
    sys.path.insert(0, ROOT)
    import corpus_pipeline as pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0
    story = "the board of the town met to speak about the old harbour and the plan for its boats, number {} of many "
    rows = [(i, story.format(i) + f"and {'abcdefgh'[i % 8]} more words {i * 7}", "en", "s", 0) for i in range(40)]
    rows += [(None, "a story of its own that has no number at all but was told in the harbour and the town", "en", None, None)] * 2
    rows += [(99, " ".join(story.format(i) for i in range(3000)), "en", "s", 5), (100, None, None, None, None)]
    path = str(tmp_path / "odd" / "documents.parquet")
    spark.createDataFrame(rows, schema).selectExpr("*", "1 as score", "2 as fp", "'x' as spans", "3 as piece").write.parquet(path)
    out = pipeline.run(spark, str(tmp_path / "odd")).collect()
    ids = {r["doc_id"] for r in out}
    assert None in ids and 99 in ids and 100 not in ids and sum(r["doc_id"] is None for r in out) == 1
    long = sorted((r["piece"], r["length"]) for r in out if r["doc_id"] == 99)
    assert len(long) > 20 and all(n == 2048 for _, n in long[:-1])

"""Operators that give rows back keep columns of any name and nested type."""

import pytest

from paceline.llm import contamination, langid, pii, simhash

NESTED = "struct<`my col`: int, `a-b`: array<struct<`c.d`: string>>>"
SCHEMA = f"doc_id long, text string, lang string, `my col` string, `a-b` int, `a.b` double, __text string, row {NESTED}, c0 long, fp string, uid int, head string, `back``tick` int"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [("the quick brown fox runs over the hills and the valleys of the land " * 3, "en"), ("el perro corre por las colinas y los valles de la tierra con su amigo " * 3, "es")]
    rows = [(k, f"{texts[k % 2][0]} {k} mail me at a{k}@b.org", texts[k % 2][1], "x", k, 0.5, "y", (k, [("z",)]), 7, "fp", 1, "h", 3) for k in range(40)]
    rows += [(None, rows[0][1], None, *rows[0][3:]), (50, None, "en", None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("operator", ["dedup_simhash", "keep_identified", "mask_pii", "decontaminate"])
def test_rows_come_back_as_they_are(spark, odd, operator):
    items = spark.createDataFrame([(1, "no such words here at all in any of these texts ever")], "item_id int, text string")
    apply = {
        "dedup_simhash": lambda df: simhash.dedup_simhash(df),
        "keep_identified": lambda df: langid.keep_identified(df),
        "mask_pii": lambda df: pii.mask_pii(df),
        "decontaminate": lambda df: contamination.decontaminate(df, items),
    }[operator]
    got = apply(odd)
    assert got.columns == odd.columns and [f.dataType for f in got.schema] == [f.dataType for f in odd.schema]
    at = odd.columns.index("text")
    bare = lambda r: str([x for k, x in enumerate(r) if k != at or operator != "mask_pii"])
    before, rows = {bare(r) for r in odd.collect()}, got.collect()
    assert rows and all(bare(r) in before for r in rows)
    assert operator != "mask_pii" or all("@" not in (r["text"] or "") for r in rows)
    assert apply(odd.limit(0)).count() == 0


def test_identify_keeps_odd_names(odd):
    model = langid.train(odd)
    keep = ("doc_id", "my col", "a-b", "a.b", "__text", "row", "c0")
    got = langid.identify(odd, model, keep=keep)
    assert got.columns == [*keep, "lang_pred", "score", "languages"] and got.count() == odd.count()
    assert {r["lang_pred"] for r in got.where("`a-b` % 2 = 1").collect()} == {"es"}


def test_fingerprints_beside_odd_names(odd):
    got = simhash.with_fingerprint(odd)
    assert got.columns == [c for c in odd.columns if c != "fp"] + ["fp"] and got.where("fp is null").count() == 0

"""The operators of this subpackage as queries over the test tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paceline.llm import align, contamination, embeddings, html_text, langid, packing, pii, segment, simhash, tokencount, variants, warc, winnow


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(_table(spark, sf_dir, "documents"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op4_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sample_segmentations(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edit_fingerprints(_table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_vectors(_table(spark, sf_dir, "embeddings"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(_table(spark, sf_dir, "pages"))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_groups(_table(spark, sf_dir, "documents"))


def op12_benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination_summary(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_summary(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_language_mixture, op3_simhash_dedup, op4_sampled_segmentations, op5_winnowing_fingerprints, op6_embedding_dedup, op7_html_extraction, op8_warc_round_trip, op9_token_counts, op10_pii_spans, op11_spelling_variants, op12_benchmark_contamination, op13_token_alignment)}

# The other operators have no form in SQL (models, tokenizers, XXH64, HTML); tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op6_embedding_dedup": """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e, label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 as fit
  from embeddings),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.fit and b.fit and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
reach(a, b) as (
  select vec_id, vec_id from v
  union
  select reach.a, links.b from reach join links on reach.b = links.a),
least as (select a, min(b) as component_id from reach group by a),
n as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from v join least on least.a = vec_id left join n on n.a = vec_id
""",
    "op11_spelling_variants": """
with recursive bits(k, v, i) as (
  select range, range, 0 from range(256)
  union all
  select k, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, i + 1 from bits where i < 8),
crc as (select list(v order by k) as t from bits where i = 8),
runs as (
  select doc_id, w, count(*) as c
  from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) as w from documents)
  where length(w) >= 6 group by all),
hashed as (
  select w, c, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(h) + 1, 2), lambda p: (instr('0123456789abcdef', h[p]) - 1) * 16 + instr('0123456789abcdef', h[p + 1]) - 1)),
    lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295::bigint) as x
  from (select w, c, lower(hex(encode(coalesce(doc_id::varchar, '') || ':' || w))) as h from runs), crc),
words as (
  select word, sum(c)::bigint as n
  from (select case when x % 199 = 0 then left(w, x % length(w)) || substr(w, x % length(w) + 2) else w end as word, c from hashed)
  group by word having sum(c) >= 5 and length(word) >= 6),
gaps as (select word, n, i, left(word, i - 1) as a, substr(word, i + 1) as b from (select *, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select x.word, y.word as other, y.n from gaps x join gaps y on x.a = y.a and x.b = y.b and x.i = y.i and x.word <> y.word
  union
  select gaps.word, w.word, w.n from gaps join words w on gaps.a || gaps.b = w.word
  union
  select w.word, gaps.word, gaps.n from gaps join words w on gaps.a || gaps.b = w.word),
best as (select word, count(*) as n_near, max(n) as top from near group by word),
forms as (
  select words.word, words.n, coalesce(n_near, 0) as n_near, case when top >= 5 * words.n then top end as form_n,
    case when top >= 5 * words.n then (select min(other) from near where near.word = words.word and near.n = top) end as form
  from words left join best on best.word = words.word),
steps(word, root, next) as (
  select word, word, form from forms
  union all
  select steps.word, forms.word, forms.form from steps join forms on steps.next = forms.word)
select forms.word, form, root, n, n_near, form_n from forms join (select word, root from steps where next is null) using (word)
""",
    "op12_benchmark_contamination": """
with texts as (
  select 'd' as side, row_number() over () as row, doc_id as id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
  union all
  select 'b', row_number() over (), item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
words as (select side, row, id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from texts),
items as (select id, w, len(w) as n, least(len(w), 10) as size from words where side = 'b' and len(w) > 0),
windows as (select distinct id, size, array_to_string(w[i:i + size - 1], ' ') as g from (select *, unnest(range(1, n - size + 2)) as i from items)),
docs as (select row, id, w, len(w) as n from words where side = 'd'),
grams as (
  select row, size, i, array_to_string(w[i:i + size - 1], ' ') as g
  from (select row, w, size, unnest(range(1, n - size + 2)) as i from docs, (select distinct size from windows) where n >= size)),
hits as (select row, size, i, g from grams semi join windows using (size, g)),
covered as (select row, count(*) as n_hit from (select distinct row, unnest(range(i, i + size)) from hits) group by row),
found as (
  select row, count(*) as n_items, array_to_string(list_sort(list(id)), ',') as ids
  from (select distinct row, cast(windows.id as varchar) as id from (select distinct row, size, g from hits) join windows using (size, g)) group by row)
select id as doc_id, cast(n as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from docs left join covered using (row) left join found using (row)
""",
    "op8_warc_round_trip": """
with p as (select page_id, coalesce(html, '') as payload from pages),
d as (select page_id, payload, strlen(payload) as payload_bytes, max(page_id) over (partition by payload) as top, sha1(payload) as hex from p),
bits as (
  select *, array_to_string(list_transform(range(1, 41), lambda i: (['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'])[strpos('0123456789abcdef', hex[i])]), '') as b
  from d)
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: ('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[cast(list_sum(list_transform(range(1, 6), lambda j: cast(b[5 * i + j] as integer) * (32 >> j))) + 1 as bigint)]), '') as payload_digest,
  case when page_id < top then 'revisit' else 'response' end as record_type, case when page_id < top then top end as refers_to
from bits
""",
}

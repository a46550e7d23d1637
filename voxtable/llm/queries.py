"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtable.llm.alignment import alignment_report
from voxtable.llm.bpe import encode_documents
from voxtable.llm.decontamination import contamination
from voxtable.llm.exact_dedup import exact_groups
from voxtable.llm.language_id import identify
from voxtable.llm.mixing import mix_report
from voxtable.llm.near_dedup import near_duplicates
from voxtable.llm.prefix_trie import conversation_trie
from voxtable.llm.sharding import shard_documents
from voxtable.llm.substring_dedup import repeated_passages
from voxtable.llm.topk import search
from voxtable.llm.url_filter import BLOCK_RATE, Z, filter_urls, url_parts
from voxtable.llm.warc import archive_pages, read_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, archive_pages(_table(spark, sf_dir, "pages"))).drop("url")


OP1_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as x from pages),
d as (select page_id, octet_length(x) as payload_bytes, sha1(x) as payload_digest from p),
g as (select payload_digest, max(page_id) as keep from d where payload_bytes >= 1000 group by all)
select page_id, payload_bytes, payload_digest, case when page_id < keep then 'revisit' else 'response' end as record_type,
  case when page_id < keep then keep end as refers_to from d left join g using (payload_digest)
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: ``lang`` is what is declared, ``source`` stands for the host."""
    return identify(_table(spark, sf_dir, "documents"), "doc_id", F.col("text"), F.col("lang"), F.col("source"))


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over raw pages: text of the markup, its ``lang`` attribute, host and suffix of the url."""
    html = F.coalesce(F.col("html"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    return identify(_table(spark, sf_dir, "pages"), "page_id", text, F.nullif(F.regexp_extract(html, r"(?i)<html[^>]*\blang=[\"']?([a-z]+)", 1), F.lit("")), url_parts(F.col("url"))[0])


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the shard and place that the splitting tree gives every copy (``copies``)."""
    return mix_report(_table(spark, sf_dir, "documents"))


def op5_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 50 = 0"))


OP5_SQL = """
with c as (
  select vec_id, list_sum([case when embedding[i + 1] > 0 then cast(1 as hugeint) << i else 0 end for i in range(64)])::hugeint as code from embeddings),
d as (
  select q.vec_id as query_id, c.vec_id, cast(bit_count(xor(q.code, c.code)) as int) as distance from c q join c on true where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by distance, vec_id) as int) as rank from d)
select query_id, rank, vec_id, distance from r where rank <= 10
"""


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"), keep="largest")


OP7_SQL = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
g as (select x, max(doc_id) as keep_id, count(*) as group_size from t group by x)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(x) as text_sha256 from t join g using (x)
"""

def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages; documents without one have no row."""
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=3, per_cent=85)


OP9_SQL = r"""
with recursive
w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (
  select distinct doc_id, case when len(w) < 3 then array_to_string(w, ' ') else w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] end as g
  from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) as i from w where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
e as materialized (
  select a.doc_id as u, b.doc_id as v from s a join s b on a.g = b.g and a.doc_id < b.doc_id
  join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
b as materialized (select u, v from e union all select v, u from e),
reach(doc_id, root) as (
  select doc_id, doc_id from documents
  union select b.v, r.root from reach r join b on b.u = r.doc_id where r.root < b.v),
c as (select doc_id, min(root) as component_id from reach group by doc_id)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from c left join n using (doc_id)
"""

#: (verdict, host, path)
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a labelled document is bad if it is of low quality or toxic."""
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_ref"), bad.alias("bad"))
    return filter_urls(_table(spark, sf_dir, "pages"), outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = rf"""
with u as (
  select page_id, coalesce(url, '') as url from pages),
p as (
  select page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from u),
rules(verdict, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit as (
  select x.host, x.path, max_by(r.h || r.p, length(r.h || r.p)) as rule, max_by(r.verdict, length(r.h || r.p)) as verdict
  from (select distinct host, path from p) x join rules r
    on (x.host = r.h or ends_with(x.host, '.' || r.h)) and starts_with(x.path, r.p) group by all),
known as (select doc_id, max(greatest(1 - quality, toxic)) as bad from labels group by doc_id),
hosts as (
  select host, array_to_string(string_split(host, '.')[-2:], '.') as domain, string_split(host, '.')[-1] as suffix,
    count(bad) as n, coalesce(sum(bad), 0) as b
  from p left join known on known.doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:\.html)?/?$', 1) as bigint) group by all),
p0 as (select (sum(b) + 1.0) / (sum(n) + 2) as p from hosts),
s1 as (select suffix, sum(n) n, sum(b) b, any_value(p) p from hosts, p0 group by suffix),
m1 as (select case when sum(n * (n - 1) * p * (1 - p)) > 0 then round(1 / least(0.5, greatest(1e-4, sum(power(b - n * p, 2) - n * p * (1 - p)) / sum(n * (n - 1) * p * (1 - p)))) - 1, 6) else 1 end as m from s1),
r1 as (select suffix, (b + m * p) / (n + m) as rate from s1, m1),
s2 as (select domain, suffix, sum(n) n, sum(b) b, any_value(rate) p from hosts join r1 using (suffix) group by domain, suffix),
m2 as (select case when sum(n * (n - 1) * p * (1 - p)) > 0 then round(1 / least(0.5, greatest(1e-4, sum(power(b - n * p, 2) - n * p * (1 - p)) / sum(n * (n - 1) * p * (1 - p)))) - 1, 6) else 1 end as m from s2),
r2 as (select domain, (b + m * p) / (n + m) as rate from s2, m2),
s3 as (select host, n, b, rate as p from hosts join r2 using (domain)),
m3 as (select case when sum(n * (n - 1) * p * (1 - p)) > 0 then round(1 / least(0.5, greatest(1e-4, sum(power(b - n * p, 2) - n * p * (1 - p)) / sum(n * (n - 1) * p * (1 - p)))) - 1, 6) else 1 end as m from s3),
r3 as (select host, n + m as k, (b + m * p) / (n + m) as rate from s3, m3),
low as (select host, rate - {Z} * sqrt(rate * (1 - rate) / (k + 1)) as lower from r3)
select page_id, p.host, p.path, rule, coalesce(verdict, case when lower > {BLOCK_RATE} then 'block' else 'allow' end) as verdict
from p left join fit on fit.host = p.host and fit.path = p.path join low on low.host = p.host
"""


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
with w as (
  select doc_id, row_number() over () as k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iw as materialized (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(2, len(w) - 8))) as i from b where len(w) > 0)),
dw as (
  select k, i, n, array_to_string(w[i:i + n - 1], ' ') as g
  from (select k, w, n, unnest(range(1, len(w) - n + 2)) as i from w, (select distinct n from iw) where len(w) >= n)),
hit as materialized (select k, i, dw.n, item_id from dw join iw on dw.g = iw.g and dw.n = iw.n),
h as (select k, count(distinct p) as n_hit from (select k, unnest(range(i, i + n)) as p from hit) group by k),
t as (select k, count(distinct coalesce(cast(item_id as varchar), '')) as n_items, array_to_string(list_sort(list(distinct coalesce(cast(item_id as varchar), ''))), ',') as ids from hit group by k)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from w left join h using (k) left join t using (k)
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment_report(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_language_id": op2_language_id,
        "pages_language_id": pages_language_id,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_mixing": op4_mixing,
        "op5_hamming_topk": op5_hamming_topk,
        "op6_sharding": op6_sharding,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_near_dedup": op9_near_dedup,
        "op10_url_filter": op10_url_filter,
        "op11_decontamination": op11_decontamination,
        "op12_alignment": op12_alignment,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op5_hamming_topk": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op9_near_dedup": OP9_SQL, "op10_url_filter": OP10_SQL, "op11_decontamination": OP11_SQL}

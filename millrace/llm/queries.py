"""The registered queries of this subpackage: each applies one operator, with its
production parameters, to the whole of its table and derives its digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, licenses, mixing, perplexity, pii, quotes, revisits, sentence_spans, simhash, tiling
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.templates(spark))


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(table(spark, sf_dir, "conversations"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


def op4_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = revisits.resolve(revisits.crawl_of(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    sent = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), "&")
    return done.select("record_id.page_id", "record_id.visit", "url_key", "status", F.col("source_id.page_id").alias("source_page_id"), F.col("source_id.visit").alias("source_visit"), sent.alias("headers"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.assess(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, similarity=None)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_quotation_linking,
        op3_substring_dedup,
        op4_revisit_resolution,
        op5_source_mixing,
        op6_pii,
        op7_quality_rules,
        op8_benchmark_decontamination,
        op9_language_id,
        op10_simhash_near_dedup,
    )
}

OP4_SQL = r"""
with parts as (
  select page_id, html, nullif(trim(url), '') as url,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as rest
  from pages),
cut as (
  select page_id, html, url,
         regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^(www\.|m\.)', ''), ':(80|443)$', '') as host,
         regexp_replace(regexp_extract(rest, '^[^/?]*(/[^?]*)', 1), '/+$', '') as path,
         list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
           lambda p: p <> '' and not regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=.*)?$'))) as query
  from parts),
visits as (
  select page_id, visit, page_id % 100003 as start, page_id % 4 as kind, html,
         case when page_id % 3 = 0 then visit else 0 end as version,
         case when url is not null then
           host || path || case when len(query) > 0 then '?' || array_to_string(query, '&') else '' end end as url_key
  from cut cross join (values (0), (1), (2)) v(visit)),
responses as (
  select url_key, page_id, visit, start + visit * 1000 as ts,
         case when kind <= 1 then md5(html || version) end as tag,
         case when kind in (1, 2) then 'day ' || (start // 500 + version) end as day
  from visits where url_key is not null),
latest as (  -- of one URL and time the largest record counts
  select url_key, ts, unnest(max(row(page_id, visit, tag, day)::struct(page_id bigint, visit integer, tag varchar, day varchar))) from responses group by url_key, ts),
revisits as (
  select url_key, page_id, visit, start + visit * 1000 - 200 + (page_id % 89) * 31 % 1500 as ts,
         case when kind <= 1 and visit < 2 then md5(html || 0) end as tag,
         case when kind in (1, 2) then 'day ' || (start // 500) end as day
  from visits),
met as (
  select r.*, l.page_id as src, l.visit as src_visit, l.tag as src_tag, l.day as src_day,
         case when l.page_id is null then null when r.tag is not null and l.tag is not null then r.tag = l.tag
              when r.day is not null and l.day is not null then r.day = l.day end as agree
  from revisits r asof left join latest l on r.url_key = l.url_key and r.ts > l.ts)
select page_id, visit, url_key,
       case when src is null then 'no_response' when agree is null then 'no_validator'
            when agree then 'resolved' else 'validator_mismatch' end as status,
       case when agree then src end as source_page_id, case when agree then src_visit end as source_visit,
       case when agree then 'content-type=text/html&date=' || ts || case when src_tag is not null then '&etag=' || src_tag else '' end
            || '&expires=' || (ts + 50) || case when src_day is not null then '&last-modified=' || src_day else '' end end as headers
from met
"""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Exact containment of every template in every document: all that MinHash should retrieve.
OP1_SQL = rf"""
with t(template_id, license, text) as (values {", ".join(f"({i}, {_literal(a)}, {_literal(b)})" for i, (a, b) in enumerate(licenses.TEMPLATES))}),
tw as (select template_id, license, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w from t),
ti as (select template_id, license, w, unnest(range(1, len(w) - 3)) as i from tw where len(w) >= 5),
ts as (select template_id, license, array_to_string(w[i:i + 4], ' ') as s, min(i) as i from ti group by template_id, license, s),
tn as (select template_id, count(*) as n from ts group by template_id),
dw as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w from documents),
di as (select doc_id, w, unnest(range(1, len(w) - 3)) as pos from dw where len(w) >= 5),
ds as (select doc_id, array_to_string(w[pos:pos + 4], ' ') as s, min(pos) - 1 as pos from di group by doc_id, s),
m as (select doc_id, template_id, license, count(*) as held, arg_min(pos, i)::integer as first_word from ds join ts using (s) group by doc_id, template_id, license)
select doc_id, template_id::bigint as template_id, license, held / n as containment, first_word
from m join tn using (template_id) where held / n >= {licenses.THRESHOLD}
"""

ORACLE_SQL: dict[str, str] = {"op1_license_scan": OP1_SQL, "op4_revisit_resolution": OP4_SQL}

"""Not-modified revisit resolution: an as-of join to the latest earlier full response.

A crawl holds full responses and revisits, records without content that say the
page was not modified.  A revisit is resolved to the latest response of the same
canonical URL that is earlier than it, if their validators agree: entity tags if
both have one, else last-modified dates if both have one; without any validator
in common the response isn't taken.  Headers of the revisit replace those of the
response where a not-modified answer may send them (``PERMITTED``); all other
headers are the response's.

The join is made without pairs: responses and revisits of a URL are laid out in
time and each revisit takes the last response before it.  A URL may hold a third
of all records, so records are dealt out by ranges of (URL, time, kind, id): ranges hold
about as many records each, whatever the URLs and however many records share a
second.  Each range's part of a URL is scanned on its own, and what it starts with is
carried over from the ranges before it, a row for each range that the URL meets.

Defined cases: a null or empty URL has no canonical form and is never resolved; a
null time likewise; a response and a revisit of one time don't meet; of responses
of one time the largest record_id counts; repeated rows are resolved alike; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spool

# Headers that a 304 answer updates, and query parameters that don't name content.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=.*)?$"


def canonical(url: Column) -> Column:
    """Lower-case host without www. or m. and default port; no scheme, fragment, tracking or final slash; sorted query."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^(www\.|m\.)|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*(/[^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    out = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(F.length(F.trim(url)) > 0, out)


def resolve(records: DataFrame, *, ranges: int | None = None) -> DataFrame:
    """One row for each revisit: record_id, url_key, ts, source_id (the response or null), status and headers.

    records: record_id (any type with an order), url string, ts long, kind
    ('response' or 'revisit'), etag, last_modified string, headers map<string, string>
    (lower-case names).  ranges: how many ranges; Spark's shuffle partitions if None.
    status: 'resolved', 'validator_mismatch', 'no_validator' or 'no_response'.
    """
    r = records.select("record_id", canonical(F.col("url")).alias("url_key"), "ts", "kind", "etag", "last_modified", "headers")
    slim = r.where("url_key is not null and ts is not null").select("record_id", F.xxhash64("url_key").alias("u"), "url_key", "ts", "etag", "last_modified", "headers", (F.col("kind") == "revisit").alias("again"))
    dealt = slim.repartitionByRange(*([ranges] if ranges else []), "u", "url_key", "ts", F.col("again").desc(), "record_id")  # a revisit before a response of its time
    slim = spool(dealt.withColumn("slice", F.spark_partition_id()))  # written, so that a lost task can't deal anew
    response = F.struct(F.col("ts").alias("r_ts"), F.col("record_id").alias("r_id"), "url_key", "etag", "last_modified", "headers")
    rows = slim.withColumn("response", F.when(~F.col("again"), response))
    # the last response of each slice, and from those the one before each slice; slices of a URL follow each other in time
    ends = rows.where("not again").groupBy("u", "url_key", "slice").agg(F.max(F.struct("ts", "record_id", "etag", "last_modified")).alias("e"), F.max_by("response", F.struct("ts", "record_id")).alias("response")).select("u", "url_key", "slice", "response")
    asks = rows.where("again").select("u", "url_key", "slice").distinct().withColumn("response", F.lit(None).cast(rows.schema["response"].dataType))
    line = ends.unionByName(asks).groupBy("u", "url_key", "slice").agg(F.first("response", ignorenulls=True).alias("response"))
    order = Window.partitionBy("u", "url_key").orderBy("slice")
    carried = line.withColumn("carried", F.last("response", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).select("u", "url_key", "slice", "carried")
    # one row of a slice for each time: a response of the same time comes after the revisit
    within = Window.partitionBy("u", "url_key", "slice").orderBy("ts", F.col("again").desc(), "record_id")
    seen = rows.withColumn("near", F.last("response", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1))).where("again").drop("response")
    met = seen.join(carried, ["u", "url_key", "slice"], "left").withColumn("s", F.coalesce("near", "carried"))
    both_tags = F.col("etag").isNotNull() & F.col("s.etag").isNotNull()
    both_dates = F.col("last_modified").isNotNull() & F.col("s.last_modified").isNotNull()
    agree = F.when(both_tags, F.col("etag") == F.col("s.etag")).when(both_dates, F.col("last_modified") == F.col("s.last_modified"))
    status = F.when(F.col("s").isNull(), "no_response").when(agree.isNull(), "no_validator").when(agree, "resolved").otherwise("validator_mismatch")
    sent = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k).isin(*PERMITTED))
    rest = F.map_filter(F.coalesce("s.headers", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(sent), k))
    done = met.withColumn("status", status)
    out = done.select("record_id", "url_key", "ts", F.when(F.col("status") == "resolved", F.col("s.r_id")).alias("source_id"), "status", F.when(F.col("status") == "resolved", F.map_concat(rest, sent)).alias("headers"))
    lost = r.where("kind = 'revisit' and (url_key is null or ts is null)").select("record_id", "url_key", "ts", F.lit(None).cast(r.schema["record_id"].dataType).alias("source_id"), F.lit("no_response").alias("status"), F.lit(None).cast("map<string,string>").alias("headers"))
    return out.unionByName(lost)


def crawl_of(pages: DataFrame) -> DataFrame:
    """Records of a crawl from pages(page_id, url, html); record_id is struct(page_id, visit).

    Every page is fetched in full three times, a thousand ticks apart, and asked for
    three times in between, before, between or after its full responses.  A third of
    the pages change with each fetch.  Half of them send entity tags, half of them
    dates (a quarter both, a quarter neither); who asks has the validators of the first
    version, the last time without its tag.  Ticks start at page_id mod 100003.
    """
    page, visit = F.col("page_id"), F.col("visit")
    start, kind = F.pmod(page, F.lit(100_003)), F.pmod(page, F.lit(4))
    version = F.when(F.pmod(page, F.lit(3)) == 0, visit).otherwise(F.lit(0))

    def tag(v: Column) -> Column:
        return F.when(kind <= 1, F.md5(F.concat("html", v.cast("string"))))

    def date(v: Column) -> Column:
        return F.when(kind.isin(1, 2), F.concat(F.lit("day "), (F.floor(start / 500) + v).cast("string")))

    def headers(**named: Column) -> Column:
        given = F.create_map(*[x for k, c in named.items() for x in (F.lit(k.replace("_", "-")), c)])
        return F.map_filter(given, lambda k, v: v.isNotNull())

    visits = pages.select("page_id", "url", "html", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("visit"))
    record = F.struct("page_id", "visit").alias("record_id")
    at = start + visit * 1000
    full = visits.select(record, "url", at.alias("ts"), F.lit("response").alias("kind"), tag(version).alias("etag"), date(version).alias("last_modified"), headers(content_type=F.lit("text/html"), date=at.cast("string"), etag=tag(version), last_modified=date(version)).alias("headers"))
    later = at - 200 + F.pmod(page, F.lit(89)) * 31 % 1500
    asked = F.when(visit < 2, tag(F.lit(0)))
    again = visits.select(record, "url", later.alias("ts"), F.lit("revisit").alias("kind"), asked.alias("etag"), date(F.lit(0)).alias("last_modified"), headers(content_type=F.lit("none"), date=later.cast("string"), expires=(later + 50).cast("string")).alias("headers"))
    return full.unionByName(again)

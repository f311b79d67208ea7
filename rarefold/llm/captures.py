"""A crawl log over ``pages``: each page is captured four times, as full answers and as 304 revisits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefold.llm.warc import NOT_MODIFIED

VISITS = 4


def captures(pages: DataFrame) -> DataFrame:
    """WARC-like records: visit 0 is a response; later ones are responses (2 in 10) or revisits with an
    ETag (5), a wrong ETag (1), a date (1) or no validator (1), by fixed arithmetic on page_id."""
    d = pages.select("page_id", "url", "html", F.explode(F.sequence(F.lit(0), F.lit(VISITS - 1))).alias("k"))
    d = d.withColumn("m", F.when(F.col("k") == 0, 9).otherwise((F.col("page_id") * 31 + F.col("k") * 17) % 10))
    full = F.col("m") >= 8
    start = (F.col("page_id") * 7919 % 200) * 86400
    seconds = 1704067200 + start + F.col("k") * 3600 * (1 + F.col("page_id") % 50)
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.when(full & (F.col("k") > 0), F.concat(F.lit("-"), F.col("k").cast("string"))).otherwise(""), F.lit('"'))
    modified = (1704067200 + start).cast("string")
    body = F.when(full, F.when(F.col("k") == 0, F.col("html")).otherwise(F.concat(F.col("html"), F.lit("<!-- "), F.col("k").cast("string"), F.lit(" -->"))))
    answer = F.create_map(
        F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length(body).cast("string"), F.lit("ETag"), tag,
        F.lit("Last-Modified"), modified, F.lit("Date"), seconds.cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"),
    )
    common = F.create_map(F.lit("date"), seconds.cast("string"), F.lit("cache-control"), F.concat(F.lit("max-age="), F.col("k").cast("string")), F.lit("x-cache"), F.lit("hit"), F.lit("content-length"), F.lit("0"))
    checked = (
        F.when(F.col("m") < 5, F.map_concat(common, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag))))
        .when(F.col("m") == 5, F.map_concat(common, F.create_map(F.lit("etag"), F.lit('"stale"'))))
        .when(F.col("m") == 6, F.map_concat(common, F.create_map(F.lit("last-modified"), modified)))
        .otherwise(common)
    )
    return d.select(
        F.concat_ws("-", F.col("page_id").cast("string"), F.col("k").cast("string")).alias("record_id"),
        F.when(full, "response").otherwise("revisit").alias("warc_type"),
        F.when(~full, NOT_MODIFIED[0]).alias("profile"),
        F.col("url").alias("target_uri"),
        F.timestamp_seconds(seconds).alias("warc_date"),
        F.when(full, 200).otherwise(304).alias("http_status"),
        F.when(full, answer).otherwise(checked).alias("headers"),
        body.alias("payload"),
    )


#: The same log and its resolution for DuckDB.
SQL = r"""
with visits as (
  select page_id, url, html, k, case when k = 0 then 9 else (page_id * 31 + k * 17) % 10 end as m,
    (page_id * 7919 % 200) * 86400 as start
  from pages, (select unnest(range(4)) as k)
), log as (
  select page_id || '-' || k as record_id, m, k, m >= 8 as is_full, 1704067200 + start + k * 3600 * (1 + page_id % 50) as t,
    '"' || substr(md5(html), 1, 16) || case when m >= 8 and k > 0 then '-' || k else '' end || '"' as tag,
    cast(1704067200 + start as varchar) as modified,
    case when m >= 8 then html || case when k = 0 then '' else '<!-- ' || k || ' -->' end end as body,
    regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['h', 'p', 'q']) as u
  from visits
), named as (
  select * exclude (u),
    regexp_replace(regexp_replace(regexp_replace(lower(u.h), '^.*@', ''), ':(80|443)$', ''), '^(www|m)\.', '') || regexp_replace(u.p, '/+$', '')
      || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end as url
  from (select *, list_sort(list_filter(string_split(u.q, '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|fbclid|gclid|ref)(=.*)?$'))) as params from log)
), full_ as (
  select url, t, arg_max(record_id, record_id) as response_id, arg_max(tag, record_id) as r_tag, arg_max(modified, record_id) as r_modified, arg_max(body, record_id) as payload
  from named where is_full group by all
), joined as (
  select n.record_id, n.url, n.t, n.k, n.m, n.tag, n.modified, f.response_id, f.r_tag, f.r_modified, f.payload,
    case when f.response_id is null then 'missing' when n.m = 7 then 'unvalidated'
      when n.m < 5 and n.tag = f.r_tag then 'resolved' when n.m = 6 and n.modified = f.r_modified then 'resolved' else 'mismatch' end as status
  from (select * from named where not is_full) n asof left join full_ f on n.url = f.url and n.t > f.t
)
select record_id, url, status, response_id, md5(payload_) as payload_md5, md5(head) as headers_md5 from (
  select *, case when ok then payload end as payload_,
    array_to_string(list_filter(['cache-control=max-age=' || k,
      'content-length=' || case when ok then cast(strlen(payload) as varchar) else '0' end,
      case when ok then 'content-type=text/html' end, 'date=' || t,
      case when m < 5 then 'etag=W/' || tag when m = 5 then 'etag="stale"' when ok then 'etag=' || r_tag end,
      case when m = 6 then 'last-modified=' || modified when ok then 'last-modified=' || r_modified end, 'x-cache=hit'], lambda x: x is not null), chr(10)) as head
  from (select *, status in ('resolved', 'unvalidated') as ok from joined)
)
"""

"""Resolution of not-modified revisits in web archives.

A revisit record of a 304 answer has headers and no body. It stands for the latest earlier full response of
its URL, if the validators agree; its headers then update that response's, but for those that describe the body.

The as-of join works on distinct (URL, time) keys in two levels, within slices of time and over the slices'
last responses, so that a URL with a large share of the records is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rarefold.llm.common import staged

#: The WARC 1.1 profile name of 304 revisits (and that of WARC 1.0).
NOT_MODIFIED = ("http://netpreserve.org/warc/1.1/revisit/server-not-modified", "http://netpreserve.org/warc/1.0/revisit/server-not-modified")
#: Header fields that a 304 must not change: they describe the stored body or one connection.
KEPT_FIELDS = (
    "content-encoding",
    "content-length",
    "content-range",
    "content-type",
    "connection",
    "keep-alive",
    "proxy-authenticate",
    "proxy-authentication-info",
    "proxy-authorization",
    "proxy-connection",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
)
_TRACKING = r"^(utm_[^=]*|fbclid|gclid|ref)(=.*)?$"
#: Keys in one slice of time, about.
SLICE_ROWS = 50_000


def canonical_url(url: Column) -> Column:
    """host/path?query in a common form; null for a null URL.

    Scheme, user, default port, fragment and a leading ``www.`` or ``m.`` go; the host is in lower case; slashes at the
    path's end go; tracking parameters go and the others are sorted.
    """
    part = lambda i: F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?", i)
    host = F.regexp_replace(F.lower(part(1)), r"^.*@", "")
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(part(2), "/+$", "")
    params = F.array_sort(F.filter(F.split(part(3), "&"), lambda p: (p != "") & ~p.rlike(_TRACKING)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def _validator(headers: Column, name: str) -> Column:
    value = F.trim(F.get(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name)), F.lit(0)))
    return F.nullif(F.regexp_replace(value, "^W/", ""), F.lit("")) if name == "etag" else F.nullif(value, F.lit(""))


def _asof(keys: DataFrame, slices: int) -> DataFrame:
    """(url, at, full) -> (url, at, before): the full response at the latest earlier time of the URL."""
    cuts: list = []
    if slices > 1:
        shares = [i / slices for i in range(1, slices)]
        cuts = sorted(set(keys.select(F.percentile_approx("at", shares, 10_000)).first()[0] or []))  # at most ``slices`` numbers
    edges = np.array(cuts, np.int64)

    @F.pandas_udf(T.IntegerType())
    def slice_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, at.to_numpy(np.int64), "right").astype(np.int32))

    keys = staged(keys.withColumn("slice", slice_of("at") if cuts else F.lit(0)), "capture-keys")
    earlier = Window.partitionBy("url", "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    within = keys.withColumn("near", F.last("full", ignorenulls=True).over(earlier))
    ends = keys.where(F.col("full").isNotNull()).groupBy("url", "slice").agg(F.max_by("full", "at").alias("end"))
    # a URL's slices: as many rows as there are slices, at most
    spans = keys.select("url", "slice").distinct().join(ends, ["url", "slice"], "left")
    carried = spans.withColumn("far", F.last("end", ignorenulls=True).over(Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    return within.join(carried.select("url", "slice", "far"), ["url", "slice"]).select("url", "at", F.coalesce("near", "far").alias("before"))


def resolve_revisits(records: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per not-modified revisit: record_id, url, status, response_id, headers, payload.

    ``records`` has record_id, warc_type, profile, target_uri, warc_date (timestamp), http_status (int), headers
    (map of strings) and payload; other columns are not read. status is

    * ``resolved``: the URL's latest response with status 200 and a payload, strictly earlier than the revisit, has
      the same ETag (weak comparison) or, if the revisit has none, the same Last-Modified. response_id and payload are that
      response's, headers its headers updated by the revisit's.
    * ``unvalidated``: the revisit has neither; resolved all the same.
    * ``mismatch``: a validator differs or the response lacks it; response_id names it, headers are the revisit's, no payload.
    * ``missing``: there is no such response, or the revisit's URL or date is null; nothing is filled in.

    Among responses at the same time the greatest record_id counts. Null header maps are empty. Repeated revisits are resolved each; record_ids of
    responses should be unique (of equal ones, one is used).
    """
    r = records.select(
        "record_id",
        F.col("warc_type").alias("type"),
        "profile",
        canonical_url(F.col("target_uri")).alias("url"),
        F.unix_micros(F.col("warc_date").cast("timestamp")).alias("at"),
        F.col("http_status").alias("code"),
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
        "payload",
    )
    full = r.where((F.col("type") == "response") & (F.col("code") == 200) & F.col("payload").isNotNull() & F.col("url").isNotNull() & F.col("at").isNotNull())
    revisits = r.where((F.col("type") == "revisit") & F.col("profile").isin(*NOT_MODIFIED)).drop("payload", "type", "profile", "code")
    asked = revisits.where(F.col("url").isNotNull() & F.col("at").isNotNull()).select("url", "at", F.lit(None).cast(r.schema["record_id"].dataType).alias("full"))
    keys = full.select("url", "at", F.col("record_id").alias("full")).unionByName(asked).groupBy("url", "at").agg(F.max("full").alias("full"))
    keys = staged(keys, "capture-times")
    found = _asof(keys, max(1, -(-keys.count() // slice_rows))).where(F.col("before").isNotNull())
    found = staged(revisits.join(found, ["url", "at"], "left"), "revisits-found")
    stored = full.select(F.col("record_id").alias("before"), F.col("headers").alias("old"), "payload").dropDuplicates(["before"])
    stored = stored.join(found.select("before").distinct(), "before", "left_semi")
    d = found.join(stored, "before", "left")
    tag, date = _validator(F.col("headers"), "etag"), _validator(F.col("headers"), "last-modified")
    same = F.when(tag.isNotNull(), tag == F.coalesce(_validator(F.col("old"), "etag"), F.lit(""))).when(
        date.isNotNull(), date == F.coalesce(_validator(F.col("old"), "last-modified"), F.lit(""))
    )
    d = d.withColumn("status", F.when(F.col("before").isNull(), "missing").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("mismatch"))
    fresh = F.map_filter("headers", lambda k, v: ~F.lower(k).isin(*KEPT_FIELDS))
    names = F.transform(F.map_keys("fresh"), lambda k: F.lower(k))
    d = d.withColumn("fresh", fresh).withColumn("names", names)
    merged = F.map_concat(F.map_filter("old", lambda k, v: ~F.array_contains(F.col("names"), F.lower(k))), F.col("fresh"))
    good = F.col("status").isin("resolved", "unvalidated")
    return d.select(
        "record_id", "url", "status", F.col("before").alias("response_id"), F.when(good, merged).otherwise(F.col("headers")).alias("headers"), F.when(good, F.col("payload")).alias("payload")
    )


def header_text(headers: Column) -> Column:
    """name=value lines by name, joined by line feeds."""
    entries = F.transform(F.map_entries(headers), lambda e: F.concat(F.lower(e["key"]), F.lit("="), e["value"]))
    return F.array_join(F.array_sort(entries), "\n")

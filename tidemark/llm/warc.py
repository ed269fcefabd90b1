"""WARC revisits of the kind *server not modified*: each is joined, as of its date, to the latest earlier full response
for its canonical URL; validators are checked and the headers that a 304 may carry are merged into the stored ones.

The as-of join is two windows: inside (url, date bucket), and over one row a bucket with what each hands on, so that a
URL with any share of all records is worked on by many tasks. Payloads are joined by record id afterwards and take no
part in the windows.

A revisit's ETag must equal the response's by weak comparison; without one its Last-Modified must; with neither, or if
the response lacks what the revisit names, there is nothing to check and the outcome says so. A failed check leaves the
revisit unresolved: an older response is not tried, since the server spoke of the newest.

Defined cases: a null or unusable url has the canonical form '' and is never resolved; null dates come before all others
and null headers are empty; a response never resolves a revisit of its own date or an earlier one; responses of one url
and date: the larger record_id counts; of responses of one record_id the latest, then the one of larger hash, gives the payload.
Repeated rows give a row each. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

BUCKETS = 256
#: Headers of a 304 that replace the stored ones (RFC 9110, section 15.4.5, and Last-Modified).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
DROPPED_QUERY = r"(?i)^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)(=.*)?$"


def canonical_url(url: str = "url") -> Column:
    """Host in lower case without ``www.`` and default port, path without a slash at its end, and the query's other
    parameters in order; scheme, user, fragment and tracking parameters go."""
    c = F.regexp_replace(F.trim(F.col(url)), r"#.*$", "")
    authority = F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(authority, r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(c, r"^[^:]*://[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(c, r"\?(.*)$", 1), "&"), lambda p: ~p.rlike(DROPPED_QUERY) & (p != ""))), "&")
    return F.when(F.coalesce(host, F.lit("")) == "", "").otherwise(F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def lower_keys(headers: Column) -> Column:
    """Headers by lower-case name; of names that differ in case only, the last of the map wins."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])))


def resolve(records: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row a revisit of ``records`` (record_id long, kind 'response' or 'revisit', url, date long, status int, headers
    map<string,string>, payload string): record_id, url_key, response_id, outcome, status, headers, payload.

    ``outcome`` is 'resolved', 'unchecked' (resolved with nothing to check), 'mismatch' or 'missing'; the last two have no
    payload and the revisit's own headers. ``kind`` 'revisit' means the server-not-modified profile; a full response is a
    'response' of status 200.
    """
    lead = records.select("record_id", "kind", canonical_url().alias("url_key"), F.coalesce("date", F.lit(-(1 << 62))).alias("date"), "status", lower_keys(F.col("headers")).alias("headers"))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & (F.col("url_key") != "")
    lead = lead.where(full | (F.col("kind") == "revisit"))
    at = F.struct("date", "record_id", F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("modified"))
    span = records.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    width = ((span["hi"] or 0) - (span["lo"] or 0)) // buckets + 1
    marked = lead.select("*", F.floor((F.greatest(F.col("date"), F.lit(span["lo"] or 0)) - F.lit(span["lo"] or 0)) / F.lit(width)).cast("int").alias("bucket"), F.when(full, at).alias("at"))
    # what a bucket hands on: its latest full response, and over buckets the latest before
    handed = marked.where("at is not null").groupBy("url_key", "bucket").agg(F.max("at").alias("latest"))
    asked = marked.where("kind = 'revisit'").select("url_key", "bucket").distinct()
    over = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = handed.join(asked, ["url_key", "bucket"], "full").select("url_key", "bucket", F.last("latest", ignorenulls=True).over(over).alias("carried"))
    inside = Window.partitionBy("url_key", "bucket").orderBy("date").rangeBetween(Window.unboundedPreceding, -1)
    seen = marked.select("*", F.max("at").over(inside).alias("latest")).where("kind = 'revisit'")
    joined = seen.join(carried.where("carried is not null"), ["url_key", "bucket"], "left").withColumn("found", F.coalesce("latest", "carried"))
    weak = lambda c: F.regexp_replace(c, r"^[Ww]/", "")
    tag, since = F.col("headers")["etag"], F.col("headers")["last-modified"]
    outcome = (
        F.when(F.col("found").isNull(), "missing")
        .when(tag.isNotNull() & F.col("found.etag").isNotNull(), F.when(weak(tag) == weak(F.col("found.etag")), "resolved").otherwise("mismatch"))
        .when(since.isNotNull() & F.col("found.modified").isNotNull(), F.when(since == F.col("found.modified"), "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    decided = joined.select("record_id", "url_key", "status", "headers", outcome.alias("outcome"), F.when(outcome.isin("resolved", "unchecked"), F.col("found.record_id")).alias("response_id"))
    decided = stage(decided, "decided")
    # payloads that no revisit asks for stay where they are; one row an id, in a table, so that a join may split what asks for it
    asked = decided.select("response_id").where("response_id is not null").distinct()
    held = records.where((F.col("kind") == "response") & (F.col("status") == 200)).withColumnRenamed("record_id", "response_id").join(asked, "response_id", "left_semi")
    ordered = F.struct("date", F.xxhash64("payload"), F.xxhash64(F.array_sort(F.map_entries("headers"))))
    stored = held.groupBy("response_id").agg(F.max_by(F.struct("status", "headers", "payload"), ordered).alias("_of"))
    stored = stage(stored, "stored").select("response_id", F.col("_of.status").alias("_status"), lower_keys(F.col("_of.headers")).alias("_headers"), F.col("_of.payload").alias("_payload"))
    out = decided.join(stored, "response_id", "left")
    permitted = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("_headers", lambda k, v: ~F.coalesce(F.map_contains_key(permitted, k), F.lit(False))), permitted)
    done = F.col("response_id").isNotNull()
    return out.select(
        "record_id",
        "url_key",
        "response_id",
        "outcome",
        F.when(done, F.col("_status")).otherwise(F.col("status")).alias("status"),
        F.when(done, merged).otherwise(F.col("headers")).alias("headers"),
        F.when(done, F.col("_payload")).alias("payload"),
    )


def crawl_of(pages: DataFrame) -> DataFrame:
    """Records of two visits of each page, for want of a crawl: a full response at page_id * 10, and a 304 at
    page_id * 10 + 5005 whose validators are, by page_id, the page's own, weak, outdated, a date alone, or none."""
    page = F.col("page_id")
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    day = F.concat(F.lit("day "), page.cast("string"))
    first = F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), day, F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("max-age=60"))
    kind = page % 8
    again = (
        F.when(kind == 3, F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), tag), F.lit("Content-Length"), F.lit("0")))
        .when(kind == 4, F.create_map(F.lit("ETag"), F.lit('"outdated"')))
        .when(kind == 5, F.create_map(F.lit("Last-Modified"), day, F.lit("Expires"), F.lit("never")))
        .when(kind == 6, F.create_map(F.lit("Date"), F.lit("today")))
        .otherwise(F.create_map(F.lit("etag"), tag, F.lit("Cache-Control"), F.lit("no-cache"), F.lit("Server"), F.lit("x")))
    )
    response = pages.select((page * 2).alias("record_id"), F.lit("response").alias("kind"), "url", (page * 10).alias("date"), F.lit(200).alias("status"), first.alias("headers"), F.col("html").alias("payload"))
    revisit = pages.select((page * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", (page * 10 + 5005).alias("date"), F.lit(304).alias("status"), again.alias("headers"), F.lit(None).cast("string").alias("payload"))
    return response.union(revisit)

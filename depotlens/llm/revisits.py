"""Not-modified revisits of web captures, resolved to the response they confirm.

A revisit takes the latest full response before it under the same canonical address, if their validators agree, and
the response's headers renewed by its own, but for those that describe the body it doesn't have.

The as-of join runs in two steps, so that an address with any number of captures is never in one task: within buckets of
time the latest response before each revisit is a window's running maximum, and what earlier buckets leave behind is
carried over their summaries, one row of a bucket.  Only ids and times go through the windows.

Defined cases: a revisit without a time, address or earlier response resolves to nothing (``no_response``); a response at the very
time of the revisit isn't earlier; of responses at one time the largest id counts.  NULL headers are none; names count in lower
case, and the last of equal names stays.  Records of other kinds are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlens.llm.text import only
from depotlens.session import materialise

# Fixed names: a not-modified answer doesn't renew these.
BODY_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "transfer-encoding")
# Query fields that don't name a page start with these.
TRACKING = ("utm_", "ref=", "fbclid=", "gclid=")


@dataclass(frozen=True)
class Settings:
    bucket_rows: int = 200_000


def canonical(url: str | Column) -> Column:
    """Address without scheme, www, default port, fragment, tracking fields and closing slash; fields sorted, host in lower case."""
    url = F.col(url) if isinstance(url, str) else url
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z]+://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"\.html$", ""), r"/+$", "")
    fields = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda f: (f != "") & ~F.exists(F.array(*map(F.lit, TRACKING)), lambda t: F.startswith(f, t))))
    return F.concat(host, path, F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(""))


def tag(column: Column) -> Column:
    """An entity tag for weak comparison; blank as NULL."""
    return F.nullif(F.regexp_replace(F.trim(column), r"^W/", ""), F.lit(""))


def lower_names(headers: Column) -> Column:
    """Entries with names in lower case, the last of equal names."""
    own = F.transform(F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>")),
                      lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    return F.filter(own, lambda e, i: ~F.exists(F.slice(own, i + 2, F.greatest(F.size(own), F.lit(1))), lambda later: later["key"] == e["key"]))


def merged(stored: Column, renewed: Column) -> Column:
    """Stored entries, renewed by those that are permitted, as a map."""
    allowed = F.filter(renewed, lambda e: ~e["key"].isin(*BODY_HEADERS))
    rest = F.filter(stored, lambda e: ~F.exists(allowed, lambda n: n["key"] == e["key"]))
    return F.map_from_entries(F.concat(rest, allowed))


def latest_response(rows: DataFrame, s: Settings) -> DataFrame:
    """(id, target) of each revisit with an earlier response; rows: (id, address, ts, full)."""
    rows = rows.filter("address IS NOT NULL AND ts IS NOT NULL")
    n, low, high = rows.agg(F.count("*"), F.min("ts"), F.max("ts")).first()
    pieces = max(1, -(-n // s.bucket_rows))
    cuts = [] if pieces == 1 else sorted(set(rows.agg(F.percentile_approx("ts", [k / pieces for k in range(1, pieces)], 100 * pieces)).first()[0] or []))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c <= F.col("ts"))) if cuts else F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    own = F.when(F.col("full"), F.struct("ts", "id"))
    before = Window.partitionBy("address", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max(own).over(before)).filter("NOT full")
    left = rows.filter("full").groupBy("address", "bucket").agg(F.max(F.struct("ts", "id")).alias("last"))
    asked = near.filter("near IS NULL").select("address", "bucket").distinct()
    summary = left.unionByName(asked.withColumn("last", F.lit(None).cast(left.schema["last"].dataType))).groupBy("address", "bucket").agg(F.max("last").alias("last"))
    earlier = Window.partitionBy("address").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.withColumn("carried", F.max("last").over(earlier)).filter("carried IS NOT NULL").select("address", "bucket", "carried")
    return near.join(carried, ["address", "bucket"], "left").select("id", F.coalesce("near.id", "carried.id").alias("target")).filter("target IS NOT NULL")


def resolved(records: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row of each revisit of (record_id, url, ts, kind, etag, last_modified, headers): record_id, address, target_id, status, headers.

    status: resolved; unchecked (no validator on one side); modified (validators differ); no_response.
    Headers are those of the response, merged, where the status is resolved or unchecked, else NULL.
    """
    own = only(records, id="record_id", url="url", ts="ts", kind="kind", etag="etag", modified="last_modified", headers="headers")
    own = own.filter("kind IN ('response', 'revisit')").select(
        "id", "ts", "modified", canonical("url").alias("address"), (F.col("kind") == "response").alias("full"), tag(F.col("etag")).alias("etag"), lower_names(F.col("headers")).alias("entries"))
    own = materialise(own, "captures")  # read by each step below
    found = latest_response(own.select("id", "address", "ts", "full"), s)
    response = own.filter("full").select(F.col("id").alias("target"), F.col("etag").alias("etag_then"), F.col("modified").alias("modified_then"), F.col("entries").alias("stored"))
    joined = own.filter("NOT full").join(found, "id", "left").join(response, "target", "left")
    etags, times = F.col("etag").isNotNull() & F.col("etag_then").isNotNull(), F.col("modified").isNotNull() & F.col("modified_then").isNotNull()
    status = F.when(F.col("target").isNull(), "no_response").when(
        etags, F.when(F.col("etag") == F.col("etag_then"), "resolved").otherwise("modified")).when(
        times, F.when(F.col("modified") == F.col("modified_then"), "resolved").otherwise("modified")).otherwise("unchecked")
    return joined.withColumn("status", status).select(
        F.col("id").alias("record_id"), "address", F.col("target").alias("target_id"), "status",
        F.when(F.col("status").isin("resolved", "unchecked"), merged(F.col("stored"), F.col("entries"))).alias("headers"))


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Capture records that the table of pages stands for: each page's response, and a revisit one step later.

    The page's id is the time.  Every third revisit bears the tag of the text before its last change, every fifth
    comes without a tag and with a date, and every seventh stands before the page's own response.
    """
    etag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 4).alias("ts"), F.lit("response").alias("kind"), etag.alias("etag"),
        day.alias("last_modified"), F.create_map(
            F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"),
            F.lit("ETag"), etag, F.lit("Date"), F.concat(F.lit("t"), (F.col("page_id") * 4).cast("string"))).alias("headers"))
    ts = F.col("page_id") * 4 + F.when(F.col("page_id") % 7 == 0, -2).otherwise(2)
    own = F.when(F.col("page_id") % 5 == 0, None).when(F.col("page_id") % 3 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), etag))
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", ts.alias("ts"), F.lit("revisit").alias("kind"), own.alias("etag"), day.alias("last_modified"),
        F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("Date"), F.concat(F.lit("t"), ts.cast("string")), F.lit("X-Cache"), F.lit("hit")).alias("headers"))
    return response.unionByName(revisit)

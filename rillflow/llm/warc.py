"""WARC: not-modified revisits resolved by an as-of join on the canonical URL.

A revisit (a 304 answer without a body) stands for the latest earlier full response
to the same canonical URL.  Its validators are checked against that response, and
of its headers those that a 304 may update replace the stored ones.

The join carries narrow columns only (record ids and headers, no bodies).  A URL's
records are cut into time buckets: the last response of each bucket is an aggregate
with a partial step before the shuffle, the carry from earlier buckets a window
over buckets, and only a bucket's records are ordered in one task, so one URL with
a large part of all records is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Header fields that a 304 answer may send to update a stored response (RFC 9110, 15.4.5).
UPDATES = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
# Query parameters that name a campaign, not a resource.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref"]

BUCKET_SECONDS = 3600


def canonical_url(url: Column) -> Column:
    """Host in lower case, the scheme's own default port, fragment, tracking parameters and trailing slash gone,
    the other parameters sorted.  ``http`` and ``https`` are one, as are a missing scheme and ``http``; every label
    of the host and any other port count.  Null stays null."""
    whole = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(whole, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    named = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.when(whole.rlike("^[Hh][Tt][Tt][Pp][Ss]://"), F.regexp_replace(named, ":443$", "")).otherwise(F.regexp_replace(named, ":80$", ""))
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _header(headers: str, name: str) -> Column:
    return F.element_at(F.col(headers), F.lit(name))


def lower_names(headers: Column) -> Column:
    """A header map with names in lower case; of names that then clash the last in name order stays."""
    entries = F.array_sort(F.map_entries(headers))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    value = lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, value))


def resolve_revisits(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Every record with its resolution; ``records`` has ``record_id, url, ts, status, headers``.

    ``status`` 304 marks a revisit, 200 to 299 a full response; other records are
    neither and pass through.  Returns ``record_id, url_key, ts, status, outcome,
    refers_to, headers``.  Outcomes: ``full``; ``resolved`` (the latest full response
    strictly earlier in (ts, record_id) order has the same ETag, weak prefix aside, or,
    where one of the two lacks an ETag, the same Last-Modified, or the revisit has
    neither validator); ``stale`` (validators differ); ``orphan`` (no earlier response,
    or a null URL or time); ``other``.  Only a resolved record refers to another; its
    headers are the stored ones, updated by the revisit's permitted fields.  Null
    headers count as none.  Records repeated whole are resolved each on its own, and a
    full response repeated whole is one; other columns are ignored; an empty table gives
    no rows.
    """
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    r = records.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "ts", F.col("status").cast("int").alias("status"),
        lower_names(F.coalesce(F.col("headers"), empty)).alias("headers"),
    )
    r = r.withColumn("bucket", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (bucket_seconds * 1_000_000)))
    # records that can't be looked up are spread over keys of their own
    lost = F.col("url_key").isNull() | F.col("ts").isNull()
    r = r.withColumn("key", F.when(lost, F.concat(F.lit("\0"), F.pmod(F.xxhash64("record_id"), F.lit(4096)))).otherwise(F.col("url_key")))
    is_full = F.col("status").between(200, 299)
    at = F.struct(F.col("ts").alias("at"), F.col("record_id").alias("refers_to"), F.col("headers"))
    # map values can't be ordered: the latest is taken by (ts, record_id)
    last = r.where(is_full & ~lost).groupBy("key", "bucket").agg(F.max_by(at, F.struct("ts", "record_id")).alias("latest"))
    marks = r.where(~lost).select("key", "bucket").distinct().join(last, ["key", "bucket"], "left")
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("key", "bucket", F.last("latest", ignorenulls=True).over(earlier).alias("carried"))
    within = Window.partitionBy("key", "bucket").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = r.withColumn("own", F.last(F.when(is_full, at), ignorenulls=True).over(within))
    joined = seen.join(carried, ["key", "bucket"], "left").withColumn("base", F.coalesce("own", "carried"))

    strip = lambda tag: F.regexp_replace(tag, "^W/", "")
    mine, theirs = strip(_header("headers", "etag")), strip(_header("base.headers", "etag"))
    my_date, their_date = _header("headers", "last-modified"), _header("base.headers", "last-modified")
    same = F.when(mine.isNotNull() & theirs.isNotNull(), mine == theirs).when(my_date.isNotNull() & their_date.isNotNull(), my_date == their_date).otherwise(mine.isNull() & my_date.isNull())
    lost = lost | F.col("base").isNull()
    outcome = F.when(is_full, "full").when(F.coalesce(F.col("status") != 304, F.lit(True)), "other").when(lost, "orphan").when(same, "resolved").otherwise("stale")
    updates = F.map_filter("headers", lambda k, v: k.isin(UPDATES))
    stored = F.map_filter("base.headers", lambda k, v: ~F.array_contains(F.map_keys(updates), k))
    done = joined.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    return done.select(
        "record_id", "url_key", "ts", "status", "outcome",
        F.when(resolved, F.col("base.refers_to")).alias("refers_to"),
        F.when(resolved, F.map_concat(stored, updates)).otherwise(F.col("headers")).alias("headers"),
    )


def with_bodies(resolved: DataFrame, bodies: DataFrame, body_col: str) -> DataFrame:
    """``resolved`` with ``body``, that of the record which each stands for (null if it stands for none); ``bodies`` has one row a ``record_id``.

    Null ids have no body; an empty table of bodies gives null bodies.
    """
    held = bodies.select(F.col("record_id").alias("held_id"), F.col(body_col).alias("body"))
    want = F.coalesce(F.col("refers_to"), F.when(F.col("outcome") == "full", F.col("record_id")))
    return resolved.join(held, want == F.col("held_id"), "left").drop("held_id")

"""The thin queries over the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import pii, quality, warc
from rillflow.llm.common import read_table
from rillflow.llm.decontamination import contaminated
from rillflow.llm.exact_dedup import exact_dedup
from rillflow.llm.line_dedup import line_dedup
from rillflow.llm.near_dedup import near_components
from rillflow.llm.packing import pack
from rillflow.llm.sharding import shard_by_bytes
from rillflow.llm.substring_dedup import substring_dedup


def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"), digest="text_sha256")


OP3_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read_table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in pii.KINDS])
    word = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    joined = lambda spans: F.array_join(F.transform(spans, word), ",")
    base = F.filter("found", lambda s: s["kind"] < 4)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS[:4])],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP5_SQL = """
WITH w AS (SELECT 0 AS kind, doc_id AS id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') AS ws FROM documents
  UNION ALL SELECT 1, item_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') FROM benchmark),
f AS (SELECT kind, id, list_filter(ws, lambda x: x <> '') AS ws FROM w),
s AS (SELECT DISTINCT kind, id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN ['short ' || array_to_string(ws, ' ')] ELSE [] END) AS sh FROM f),
n AS (SELECT id, count(*) AS n_item FROM s WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, any_value(n.n_item) AS n_item
FROM s d JOIN s i ON d.sh = i.sh AND d.kind = 0 AND i.kind = 1 JOIN n ON n.id = i.id
GROUP BY d.id, i.id HAVING count(*) * 100 >= any_value(n.n_item) * 80
"""


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(read_table(spark, sf_dir, "documents"), width=2, percent=80)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def captures(pages: DataFrame) -> DataFrame:
    """A capture log of ``pages``: each page's full response and, an hour times its id later, a revisit.

    A page captured under another form of its URL shares the canonical URL.  Revisits
    send the page's validator, but every seventh sends one that no longer holds, and
    every eleventh page has only a revisit.  ``record_id`` is twice the page's id, plus
    one for the revisit.
    """
    tag, at = F.md5(F.encode(F.coalesce("html", F.lit("")), "UTF-8")), F.lit(1_704_067_200).cast("long")
    full = pages.where("page_id % 11 <> 10").select(
        (F.col("page_id") * 2).alias("record_id"), "url", (at + F.col("page_id") * 60).alias("s"), F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), tag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
    )
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", (at + F.col("page_id") * 60 + 3600 * (1 + F.col("page_id") % 5)).alias("s"), F.lit(304).alias("status"),
        F.create_map(F.lit("ETag"), F.when(F.col("page_id") % 7 == 6, "gone").otherwise(F.concat(F.lit("W/"), tag)), F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=90")).alias("headers"),
    )
    return full.unionByName(again).withColumn("ts", F.timestamp_seconds("s"))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(captures(read_table(spark, sf_dir, "pages")))
    head = lambda n: F.element_at("headers", F.lit(n))
    return found.select("record_id", "url_key", "outcome", "refers_to", head("etag").alias("etag"), head("cache-control").alias("cache_control"), head("content-length").alias("content_length"), head("content-type").alias("content_type"))


OP9_SQL = r"""
WITH u AS (SELECT page_id, md5(coalesce(html, '')) AS tag, strlen(coalesce(html, '')) AS len, regexp_replace(trim(url), '#.*$', '') AS whole, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
k AS (SELECT page_id, tag, len,
    regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), CASE WHEN lower(whole[1:8]) = 'https://' THEN ':443$' ELSE ':80$' END, '') || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND string_split(p, '=')[1] NOT IN ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','gclid','fbclid','ref'))) AS q FROM u),
c AS (SELECT page_id, tag, len, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key FROM k),
r AS (SELECT page_id * 2 AS record_id, url_key, page_id * 60 AS s, 200 AS status, tag AS etag, len FROM c WHERE page_id % 11 <> 10
  UNION ALL SELECT page_id * 2 + 1, url_key, page_id * 60 + 3600 * (1 + page_id % 5), 304, CASE WHEN page_id % 7 = 6 THEN 'gone' ELSE 'W/' || tag END, 0 FROM c),
a AS (SELECT *, last_value(CASE WHEN status = 200 THEN {'id': record_id, 'etag': etag, 'len': len} END IGNORE NULLS) OVER (PARTITION BY url_key ORDER BY s, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r),
o AS (SELECT *, CASE WHEN status = 200 THEN 'full' WHEN b IS NULL THEN 'orphan' WHEN regexp_replace(etag, '^W/', '') = b.etag THEN 'resolved' ELSE 'stale' END AS outcome FROM a)
SELECT record_id, url_key, outcome, CASE WHEN outcome = 'resolved' THEN b.id END AS refers_to, etag,
  CASE WHEN status = 200 THEN 'max-age=60' ELSE 'max-age=90' END AS cache_control,
  CAST(CASE WHEN outcome = 'resolved' THEN b.len ELSE len END AS VARCHAR) AS content_length,
  CASE WHEN outcome IN ('full', 'resolved') THEN 'text/html' END AS content_type
FROM o
"""


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    """The ranks of ``byte_bpe_50k.json``'s vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), vocabulary())


def held_out():
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0


def quality_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> dict | None:
    return quality.fit(docs, read_table(spark, sf_dir, "labels").where(~held_out()))


LEAST_SCORE = 0.3


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(docs, spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(read_table(spark, sf_dir, "documents"), removed_col="n_removed")
    return done.select("doc_id", F.col("n_removed").cast("long").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_minimax_shards": op2_minimax_shards,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_packing": op4_packing,
        "op5_decontamination": op5_decontamination,
        "op6_quality": op6_quality,
        "op7_line_dedup": op7_line_dedup,
        "op8_near_dedup": op8_near_dedup,
        "op9_warc_revisits": op9_warc_revisits,
        "op10_pii": op10_pii,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op5_decontamination": OP5_SQL, "op9_warc_revisits": OP9_SQL}

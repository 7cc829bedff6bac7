"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

DataFrame functions only.  Narrow rows (length and prefix hash) are counted first, with
partial aggregation; keys of two rows or more make a bitmap of bounded size.  A
document whose key is not among them is proven unique and its whole text is never
normalised or hashed.  Only the others get a full hash, and groups are formed on
(length, full hash), again combined before the shuffle, so that a group of any size is
one row per task there; large groups are joined back by broadcast, of which there
are few by counting alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import cut, filter_bits, join_counted, lower_ascii, membership_filter, passing

PREFIX_CHARS = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None, digest: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept``.

    ``digest`` names a further column with the SHA-256 of the normalised text; it
    has to be computed for unique documents too, so it costs a pass over all texts.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    The largest id of a group stays.  Rows repeated whole (same id and text) are
    all of them members of the group and all carry ``kept`` if their id is the
    one that stays.  A null id sorts below any other and stays only alone.  An
    empty table gives no rows; other columns of ``docs`` are ignored.  ``bits`` is the
    bitmap's size, by default as the number of keys asks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = F.octet_length(text)
    prefix = F.xxhash64(lower_ascii(F.substring(text, 1, PREFIX_CHARS)))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.struct(length.alias("len"), prefix.alias("pre")).alias("key"))
    twice = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    n_keys, total = (int(x or 0) for x in twice.agg(F.count(F.lit(1)), F.sum("n")).first())
    bits = bits or filter_bits(n_keys)
    shared = membership_filter(twice, "key", bits)

    sha = F.sha2(lower_ascii(F.col("text")), 256)
    unique = passing(keyed if digest else keyed.select("doc_id", "key"), "key", shared, bits, negate=True)
    unique = unique.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), *([sha.alias("full")] if digest else []))
    full = cut(passing(keyed, "key", shared, bits).select("doc_id", F.col("key.len").alias("len"), sha.alias("full")))
    groups = cut(full.groupBy("len", "full").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    grouped = join_counted(full, groups, ["len", "full"], "group_size", total).select("doc_id", "keep_id", "group_size", *(["full"] if digest else []))
    out = unique.unionByName(grouped).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return out.withColumnRenamed("full", digest) if digest else out

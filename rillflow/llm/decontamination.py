r"""Benchmark decontamination by size-partitioned MinHash containment search.

DataFrame functions only.  Items are partitioned by the size of their shingle set
(powers of two).  An item that is contained in a document to the degree t lacks at
most n - ceil(t n) of its n shingles there, so one more than that of its lowest
MinHash values always hit: each partition keeps that many for its largest n.
Every shingle of every document is looked up in the sketches (whole texts, long or
short), and a pair is a candidate if a value hits.  For the candidates alone are the
full shingle sets compared, which decides.  The lookup first tests a bitmap of the
sketches' values, of bounded size, inside the row, so that a document without a hit
never becomes rows; the shingles that pass are joined with the values, by broadcast as
long as those are few (counted, not assumed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.llm.common import cut, filter_bits, fresh, lower_ascii, only, without

#: Sketch values up to which they are broadcast (about 40 bytes each).
BROADCAST_ROWS = 500_000


def _words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(df: DataFrame, id_col: str, text_col: str, width: int, out: str, distinct: bool = True) -> DataFrame:
    """``out``, and ``hs``: the hashes (distinct, or each) of the text's word shingles (of the whole sequence if that is shorter)."""
    each = F.array_distinct if distinct else lambda hs: hs

    def of_words(wh: Column) -> Column:
        n = F.size(wh)
        run = F.transform(F.slice(wh, F.lit(1), F.greatest(n - (width - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(wh, i + k) for k in range(1, width)]))
        return F.when(n >= width, each(run)).when(n > 0, F.array(F.xxhash64(F.lit("short"), wh))).otherwise(F.array().cast("array<long>"))

    # the word hashes are bound to a lambda's variable, so that they are computed once and not for every shingle
    hashed = F.array(F.transform(_words(F.col(text_col)), lambda w: F.xxhash64(w)))
    return df.select(F.col(id_col).alias(out), F.get(F.transform(hashed, of_words), F.lit(0)).alias("hs"))


def item_sketches(items: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """``item, item_id, h, n_item, partition, in_sketch``: the shingles of an item's text, the lowest of them marked; ``item`` is a key of id and text."""
    one = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null").distinct()
    sets = shingle_hashes(one.withColumn("item", F.struct("item_id", F.xxhash64("text").alias("text"))), "item", "text", width, "item")
    rows = sets.withColumn("n_item", F.size("hs")).select("item", F.col("item.item_id").alias("item_id"), "n_item", F.explode("hs").alias("h"))
    rows = rows.withColumn("partition", F.floor(F.log2("n_item")).cast("int"))
    most = F.expr("cast(pow(2, partition + 1) as int) - 1")
    keep = most - F.ceil(most * percent / 100) + 1
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.xxhash64(F.lit("order"), "h"), "h"))
    return rows.withColumn("in_sketch", rank <= keep)


def candidates(sets: DataFrame, sketch: DataFrame) -> DataFrame:
    """Distinct ``doc_id, item`` of which the document's ``hs`` hold a sketch value of the item."""
    values = cut(sketch.where("in_sketch").select("h", "item"))
    n = values.count()
    bits = filter_bits(n)
    # one row of at most 2^bits / 64 words, whatever the number of items
    bitmap = [0] * (1 << bits - 6)
    slot = lambda h: F.pmod(h, F.lit(1 << bits))
    for r in values.groupBy(F.shiftright(slot(F.col("h")), 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("mask")).collect():
        bitmap[r["word"]] = r["mask"]
    name = fresh("bitmap")
    one = sets.sparkSession.createDataFrame([(bitmap,)], f"{name} array<long>")
    hit = lambda h: F.get(F.col(name), F.shiftright(slot(h), 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))) != 0
    rows = sets.join(F.broadcast(one)).select("doc_id", F.explode(F.array_distinct(F.filter("hs", hit))).alias("h"))
    return rows.join(F.broadcast(values) if n <= BROADCAST_ROWS else values, "h").select("doc_id", "item").distinct()


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Pairs ``doc_id, item_id, n_shared, n_item`` with 100 * n_shared >= ``percent`` * n_item.

    Words are runs other than of 0x20 and 0x09-0x0D, A-Z in lower case; shingles are
    ``width`` words long.  An item with fewer words is its whole sequence, found only
    in a document of that very sequence; an item without words is found nowhere, nor
    is anything in a document without words.  Rows that share a document id count as
    one document; texts that share
    an item id are searched one by one, and of those found in a document the one with
    the largest part there is reported; null ids are left out.  Documents or items
    without rows give no pairs; other columns are ignored.
    """
    sketch = cut(item_sketches(items, item_id, item_text, width, percent))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pairs = cut(candidates(shingle_hashes(texts, "doc_id", "text", width, "doc_id", distinct=False), sketch))
    rows = shingle_hashes(only(texts, "doc_id", pairs.select("doc_id").distinct()), "doc_id", "text", width, "doc_id").select("doc_id", F.explode("hs").alias("h")).distinct()
    # the items' shingles of the candidates, not the documents': those are fewer
    shared = pairs.join(sketch.select("item", "item_id", "h", "n_item"), "item").join(rows, ["doc_id", "h"])
    counted = shared.groupBy("doc_id", "item", "item_id", "n_item").agg(F.count(F.lit(1)).alias("n_shared")).where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    best = F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("part"), "n_shared", "n_item")).alias("best")
    return counted.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_shared", F.col("best.n_item").cast("long").alias("n_item"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those in which an item is contained; columns as they are, whatever their names.

    Rows with a null id or text stay; rows that share the id of a contaminated one go with it.
    """
    ids = cut(contaminated(docs, items, id_col, text_col, **options).select(F.col("doc_id").alias(id_col)).distinct())
    return without(docs, id_col, ids)

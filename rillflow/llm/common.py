"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Bits of the membership filters: as many as ``BITS_EACH`` for every key, between these
#: bounds.  2^24 bits are 262 144 words, some 10 MB when broadcast, whatever the input.
LEAST_BITS, FILTER_BITS, BITS_EACH = 16, 24, 16
#: Keys that hold this share of all rows, of which there are at most its inverse, are joined by broadcast.
HOT_SHARE = 1 / 2000
#: Bytes that an Arrow batch to a Python worker holds at most (or one row).
BATCH_BYTES = 4 << 20
#: Links that are merged at once in a task, before the first shuffle of components.
LINKS = 1 << 18


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="rillflow-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only on one machine (``local[n]``) is a temporary folder made where it is unset,
    and removed at the driver's end; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = _own_folder()
    return f"{folder}/rillflow-{spark.sparkContext.applicationId}"


def release(spark: SparkSession, path: str | None = None) -> None:
    """Remove what :func:`cut` wrote for this application (or ``path``).  Frames that still read it are void."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path or shared_folder(spark))
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def _small_batches(spark: SparkSession):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame, **totals: Column) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read that: cuts the lineage, and lost executors lose nothing.

    The rows, and ``totals``, are counted while they are written; :func:`total` has them.
    """
    spark, seen = df.sparkSession, Observation()
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in totals.items()]).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.rf_totals = seen.get
    return out


def total(df: DataFrame, name: str = "rows"):
    """What :func:`cut` counted of the frame that it returned: no job of its own.  The rows of other frames are counted now."""
    totals = getattr(df, "rf_totals", None)
    return totals[name] if totals else df.count()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` agrees with that on pure ASCII and is much faster."""
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(slow)


def fresh(prefix: str) -> str:
    """A column name that clashes with none of the caller's."""
    return f"_{prefix}_{uuid.uuid4().hex[:8]}"


def filter_bits(n: int) -> int:
    """Bits of a filter for ``n`` keys, as a power of two."""
    return min(FILTER_BITS, max(LEAST_BITS, (BITS_EACH * n).bit_length()))


def membership_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """A bitmap over hashed keys: rows ``(word, mask)``, at most 2^bits / 64 of them.

    Clear bits are proof of absence; set bits may be collisions, so a caller has to
    check what passes.
    """
    bucket = F.pmod(F.xxhash64(F.lit("rf"), F.col(key)), F.lit(1 << bits))
    return keys.select(bucket.alias("bucket")).groupBy(F.shiftright("bucket", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bucket % 64 as int))")).alias("mask"))


def passing(df: DataFrame, key: str, bitmap: DataFrame, bits: int, negate: bool = False) -> DataFrame:
    """Rows of ``df`` whose key's bit is set (or clear) in a :func:`membership_filter`.

    The bitmap is broadcast: its size is bounded by ``bits`` alone.
    """
    bucket, word, mask = fresh("bucket"), fresh("word"), fresh("mask")
    marked = df.withColumn(bucket, F.pmod(F.xxhash64(F.lit("rf"), F.col(key)), F.lit(1 << bits))).withColumn(word, F.shiftright(bucket, 6))
    joined = marked.join(F.broadcast(bitmap.toDF(word, mask)), word, "left")
    hit = F.coalesce(F.expr(f"({mask} & shiftleft(1L, cast({bucket} % 64 as int))) <> 0"), F.lit(False))
    return joined.where(~hit if negate else hit).select(df.columns)


def gapless(df: DataFrame, group: list[str], by: list[str], out: str, total: int, share: int = 20_000) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... without bringing a group together.

    Rows of a group are dealt to ``total / share`` buckets by the hash of ``by``;
    buckets are counted, the counts are summed up per group, and only a bucket is
    numbered in one task.  ``total`` is the number of rows of ``df``.
    """
    buckets = max(1, -(-total // share))
    b, off, n = fresh("b"), fresh("off"), fresh("n")
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*by), F.lit(buckets)))
    counts = dealt.groupBy(*group, b).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(off))
    numbered = dealt.withColumn(out, F.row_number().over(Window.partitionBy(*group, b).orderBy(*by)) - 1)
    joined = numbered.join(offsets, [*group, b])
    return joined.withColumn(out, F.col(out) + F.col(off)).drop(b, off)


def narrowed(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` without most of those whose key is not in ``ids`` (a cut frame): for a join that drops the others."""
    bits = filter_bits(total(ids))
    return passing(df, key, membership_filter(ids, key, bits), bits)


def only(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (a cut frame); wide rows that are not are dropped before any shuffle."""
    return narrowed(df, key, ids).join(ids.select(key), key, "left_semi")


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is not in ``ids`` (a cut frame); rows that a bitmap clears are not shuffled."""
    bits = filter_bits(total(ids))
    bitmap = membership_filter(ids, key, bits)
    clear = passing(df, key, bitmap, bits, negate=True)
    doubtful = passing(df, key, bitmap, bits).join(ids.select(key), key, "left_anti")
    return clear.unionByName(doubtful.select(clear.columns))


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``counted`` (cut), one row a key, where ``n`` is the key's number of rows of ``total``.

    Keys of ``HOT_SHARE`` of all rows are few by counting alone (its inverse at most):
    they are broadcast and their rows stay where they are; the others are shuffled.
    """
    hot = F.col(n) >= max(1000, int(total * HOT_SHARE))
    often = counted.where(hot)
    by_task = rows.join(F.broadcast(often), keys)
    rest = rows.join(F.broadcast(often.select(keys)), keys, "left_anti").join(counted.where(~hot), keys)
    return by_task.unionByName(rest.select(by_task.columns))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every ``LINKS`` links as links to the least id that they lead to among themselves: one a node at most."""

    def merged(links: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, ends = np.unique(np.concatenate([np.asarray(x.column(k), np.int64) for k in ("a", "b") for x in links]), return_inverse=True)
        a, b = np.split(ends, 2)
        root = np.arange(len(ids))
        while (apart := root[a] != root[b]).any():
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
            while (root[root] != root).any():
                root = root[root]
        far = root != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[root[far]])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= LINKS:
            yield merged(held)
            held = []
    if held:
        yield merged(held)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``(a, b)`` links between long ids: rows ``(node, label)``, label the least id.

    Links are merged within tasks first, and a small graph is done then.  Large-star
    and small-star steps alternate until nothing changes.  A star step is a grouped
    minimum and a join on the node, so a node of any degree is combined before the
    shuffle and its rows can be split; each round is cut into the checkpoint folder,
    and no links reach the driver.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        around = both(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        linked = around.join(least, "a")
        if large:
            moved = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = linked.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b"))
        return moved.where("a <> b").distinct()

    signed = lambda e: cut(e, sign=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    sign = lambda e: (total(e), total(e, "sign"))
    merged = edges.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long")
    now = signed(merged.distinct().mapInArrow(_forest, "a long, b long"))
    before = sign(now)
    while before[0]:
        now = signed(star(star(now, True), False))
        if (after := sign(now)) == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots.withColumn("label", F.col("node")))

"""Shared helpers: joins with hot keys, filters of bounded size, tables in the shared folder."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F
from rillflow.llm import common


def test_join_counted(spark):
    """A key with most of the rows is joined where its rows are; the result is that of any join."""
    rows = spark.range(5000).select("id", F.when(F.col("id") % 5 < 3, 0).otherwise(F.col("id") % 997).alias("k"), F.col("id").alias("word"))
    counted = common.cut(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1"))
    got = common.join_counted(rows, counted, ["k"], "n", 5000)
    want = rows.join(counted, "k").select(got.columns)
    assert got.count() == want.count() > 4000 and got.exceptAll(want).count() == 0


def test_filters(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(1).alias("bucket"), F.lit(2).alias("word"), F.lit(3).alias("mask"))
    ids = common.cut(spark.range(0, 300, 7).select(F.col("id").alias("doc_id")))
    assert common.only(docs, "doc_id", ids).columns == common.without(docs, "doc_id", ids).columns == docs.columns
    assert {r.doc_id for r in common.only(docs, "doc_id", ids).collect()} == set(range(0, 300, 7))
    assert {r.doc_id for r in common.without(docs, "doc_id", ids).collect()} == set(range(300)) - set(range(0, 300, 7))
    assert common.without(docs, "doc_id", ids.limit(0)).count() == 300 and common.only(docs, "doc_id", ids.limit(0)).count() == 0
    # few bits: everything is doubtful, nothing is wrong
    bitmap = common.membership_filter(ids, "doc_id", 6)
    assert {r.doc_id for r in common.passing(docs, "doc_id", bitmap, 6).collect()} >= set(range(0, 300, 7))
    assert common.filter_bits(0) == common.LEAST_BITS and common.filter_bits(10**12) == common.FILTER_BITS


def test_gapless(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id") % 3).alias("g"), F.col("id"), F.lit(5).alias("n"))
    got = common.gapless(rows, ["g"], ["id"], "i", 1000, share=30).collect()
    assert len(got) == 1000 and all(r.n == 5 for r in got)
    for g in range(3):
        assert sorted(r.i for r in got if r.g == g) == list(range(sum(r.g == g for r in got)))


def test_shared_folder(spark):
    frame = common.cut(spark.createDataFrame([(1, [1, 2], b"x")], "a int, b array<int>, c binary"))
    path = frame.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and common.shared_folder(spark) in path
    assert [tuple(r) for r in frame.collect()] == [(1, [1, 2], bytearray(b"x"))]
    common.release(spark, os.path.dirname(path))
    assert not os.path.exists(path)


def test_cluster_needs_a_folder():
    class Conf:
        get = staticmethod(lambda key, default: default)

    class Cluster:
        conf = Conf()

        class sparkContext:
            master, applicationId = "local-cluster[3,2,1024]", "app"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Cluster())


def jobs(spark, work):
    """The number of Spark jobs that ``work`` runs."""
    sc, group = spark.sparkContext, str(uuid.uuid4())
    sc.setLocalProperty("spark.jobGroup.id", group)
    try:
        work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_components(spark):
    rnd = random.Random(4)
    links = [(k, k + 7) for k in range(0, 4000, 7)] + [(rnd.randrange(10_000, 20_000), rnd.randrange(10_000, 20_000)) for _ in range(4000)] + [(30_000, 30_000 + k) for k in range(3000)]
    rnd.shuffle(links)
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    want = {x: top(x) for a, b in links if a != b for x in (a, b)}
    edges = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = common.components(edges).collect()
    assert len(got) == len(want) and {r.node: r.label for r in got} == want
    assert common.components(edges.limit(0)).count() == 0


def test_components_of_a_small_graph_take_few_jobs(spark):
    """Each job and plan costs the driver memory: a path of 600 nodes took 103 jobs where only star steps merged it."""
    path = common.cut(spark.range(600).selectExpr("id as a", "id + 1 as b"))
    assert jobs(spark, lambda: common.components(path)) <= 16


def test_cut_counts(spark):
    frame = common.cut(spark.range(10), high=F.max("id"))
    assert common.total(frame) == 10 and common.total(frame, "high") == 9 and common.total(frame.limit(3)) == 3
    assert common.total(common.cut(spark.range(0))) == 0

"""The lists of near_dedup: which are kept, and that few rows are shuffled for it."""

from pyspark.sql import functions as F
from rillflow.llm import common
from rillflow.llm.near_dedup import _list_keys, _sketch


def test_lists_of_one_member_are_dropped_before_the_second_shuffle(spark):
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(30))) for k in range(50)] + [(100 + k, f"{k} " + " ".join(f"same{i}" for i in range(30))) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = common.cut(docs.mapInArrow(_sketch(2, 80), "doc_id long, n long, whole binary, low array<long>, runs array<long>, sketch binary"))
    lists = _list_keys(known, 80)
    assert {r.x for r in lists.collect()} == {100, 101}
    assert lists.groupBy("run").agg(F.count("x").alias("n")).where("n < 2").count() == 0
    assert "bit_or" in lists._jdf.queryExecution().toString()

"""Golden values of single operators."""

import math

import pytest
from pyspark.sql import functions as F
from rillflow.functions import geo, text
from rillflow.operators import aggregates, elements, joins, panes, stateful, windows
from rillflow.sources import readers, sinks
from rillflow.sources.ranges import OffsetRange, RangeTracker, WordRangeSource


def timed(spark, *rows):
    return spark.createDataFrame([(w, readers.epoch(ms)) for w, ms in rows], "w string, ts timestamp")


def test_words(spark):
    lines = spark.createDataFrame([("hi there",), ("hi",), ("hi sue bob",), ("hi sue",), ("",), ("bob hi",)], "text string")
    n = aggregates.count_per_element(elements.words(lines), "word")
    assert {r.x for r in n.select(text.format_count(F.col("word"), F.col("n")).alias("x")).collect()} == {"hi: 5", "there: 1", "sue: 2", "bob: 2"}


def test_fixed_and_sliding(spark):
    d = timed(spark, ("foo", 15_000), ("bar", 30_000), ("foo", 45_000), ("foo", 90_000))
    assert aggregates.count_per_element(windows.fixed(d, "1 minute"), "window_start", "w").count() == 3
    d = timed(spark, ("a", 0), ("bb", 1999), ("ccc", 5000), ("dddd", 10_000))
    got = windows.sliding(d, "10 seconds", "2 seconds").groupBy("window_start").agg(F.avg(F.length("w")).alias("a")).collect()
    assert sorted(r.a for r in got) == [1.5] * 2 + [2.0] * 3 + [3.5] * 2 + [4.0] * 3


def test_running(spark):
    d = spark.createDataFrame([(0, "a"), (1, "bb"), (2, "ccc"), (3, "d")], "arrival long, w string")
    for bucket in (1, 2, 100):
        r = panes.running(d, "arrival", {"s": panes.running_sum(F.length("w")), "n": panes.running_sum(F.lit(1)), "m": panes.running_max(F.struct(F.length("w"), "w"))}, bucket)
        assert [(x.s / x.n, x.m.w) for x in r.orderBy("arrival").collect()] == [(1.0, "a"), (1.5, "bb"), (2.0, "ccc"), (1.75, "ccc")]


def test_late_split(spark):
    rows = [(0, "a", 1), (1, "-", 1999), (2, "b", 999), (3, "-", 2000), (4, "c", 0)]
    d = spark.createDataFrame([(i, v, readers.epoch(ms)) for i, v, ms in rows], "arrival long, v string, ts timestamp")
    tags = {r.v: r.tag for r in panes.late_split(windows.fixed(panes.with_watermark(d, "arrival"), "1 second"), "1 second").where("v <> '-'").collect()}
    assert tags == {"a": "main", "b": "main", "c": "droppable"}


def test_latest_top_mean(spark):
    d = spark.createDataFrame([(v, readers.epoch(v * 1000)) for v in range(10, 0, -1)], "v int, ts timestamp")
    assert aggregates.latest(d, "v", ["ts"]).first().v == 10
    assert aggregates.latest(d.where("v > 99"), "v", ["ts"]).first().v is None
    assert [r.v for r in aggregates.top_k(d, 2, [F.desc("v")]).collect()] == [10, 9]
    assert math.isnan(d.where("v > 99").agg(aggregates.mean_or_nan(F.col("v")).alias("m")).first().m)


def test_geo(spark):
    one = spark.range(1)
    d = lambda *x: one.select(geo.distance(*map(F.lit, x)).alias("d")).first().d
    assert abs(d(-90.0, 0.0, 90.0, 0.0) - 2 * geo.RADIUS) < 0.01
    assert abs(d(0.0, 0.0, 0.0, 0.1) - 11119) < 1 and abs(d(0.0, 0.0, 0.001, 0.001) - 157) < 1
    lat, lon = geo.move(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(100.0))
    assert abs(one.select(geo.distance(F.lit(0.0), F.lit(0.0), lat, lon).alias("d")).first().d - 100) < 1e-4


def test_minute_metrics(spark):
    t0, step = 1_234_567_890_000, 360 * 180 / math.pi / geo.RADIUS / math.sqrt(2)
    d = spark.createDataFrame([("foo", 0.0, 0.0, t0), ("foo", step, step, t0 + 120_000)], "track string, lat double, lon double, ts long")
    got = stateful.minute_metrics(d).orderBy("ts").collect()
    assert [r.duration for r in got] == [30_000, 60_000, 30_000]
    assert all(abs(r.length - x) < 1e-4 for r, x in zip(got, (90, 180, 90)))


def test_positions(spark):
    d = spark.createDataFrame([("t\t1.5\t2\t3",), ("t\tx\t2\t3",), ("bad",), ("u\textra\t1\t2\t3",)], "value string")
    assert [tuple(r) for r in readers.positions(d).collect()] == [("t", 1.5, 2.0, 3), ("u", 1.0, 2.0, 3)]


def test_joins(spark):
    left = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "k string, v int")
    right = spark.createDataFrame([("x", "X"), ("y", "Y")], "k string, name string")
    assert joins.cogroup_join(left, right, "k", strict=True).count() == 2
    with pytest.raises(Exception, match="more than one"):
        joins.cogroup_join(left, right.union(right), "k", strict=True).collect()
    assert {r.name for r in joins.lookup_or_default(left, right, "k", "name", "Unknown").collect()} == {"X", "Y", "Unknown"}
    got = joins.rpc_lookup(left, "k", lambda: lambda ks: [len(k) for k in ks], "n", "int").collect()
    assert [r.n for r in got] == [1, 1, 1]


def test_json(spark):
    d = spark.createDataFrame([('{"uid": "a", "price": 2}',), ("nope",), ('{"uid": "b"}',)], "j string")
    good, bad = elements.parse_json(d, "j", "uid string, price double", ["uid", "price"])
    assert [r.uid for r in good.collect()] == ["a"] and bad.count() == 2


def claims(start, stop, *steps):
    t, out = RangeTracker(OffsetRange(start, stop)), []
    for do, x in steps:
        out.append(t.try_claim(x) if do == "claim" else t.try_split(x))
    return t, out


R = OffsetRange
SMALL, LARGE = -(2**63), 2**63 - 1


@pytest.mark.parametrize(
    "work, steps, out, left, done",
    [
        ((100, 200), [("claim", 100), ("claim", 150), ("claim", 199), ("claim", 200)], [True, True, True, False], (100, 200), True),
        ((100, 200), [("split", 0)], [((100, 100), (100, 200))], (100, 100), True),
        ((100, 200), [("claim", 100), ("split", 0)], [True, ((100, 101), (101, 200))], (100, 101), True),
        ((100, 200), [("claim", 105), ("claim", 110), ("split", 0)], [True, True, ((100, 111), (111, 200))], (100, 111), True),
        ((100, 200), [("claim", 105), ("claim", 110), ("claim", 199), ("split", 0)], [True, True, True, None], (100, 200), True),
        ((100, 200), [("claim", 105), ("claim", 110), ("claim", 160), ("claim", 240), ("split", 0)], [True, True, True, False, None], (100, 200), True),
        ((100, 200), [("claim", 100), ("split", 0.509), ("split", 1)], [True, ((100, 150), (150, 200)), None], (100, 150), False),
        ((100, 100), [("split", 0), ("split", 0.1), ("split", 1)], [None, None, None], (100, 100), True),
        ((100, 200), [("claim", 150), ("claim", 175), ("claim", 220)], [True, True, False], (100, 200), True),
        ((100, 200), [("claim", 150), ("claim", 175), ("claim", 200)], [True, True, False], (100, 200), True),
        ((100, 200), [("claim", 150), ("claim", 175), ("claim", 199)], [True, True, True], (100, 200), True),
        ((100, 200), [("claim", 150), ("claim", 175)], [True, True], (100, 200), False),
        ((100, 200), [], [], (100, 200), False),
    ],
)
def test_tracker(work, steps, out, left, done):
    t, got = claims(*work, *steps)
    assert got == [x if x is None or isinstance(x, bool) else (R(*x[0]), R(*x[1])) for x in out] and t.work == R(*left)
    if done:
        t.check_done()
    else:
        with pytest.raises(ValueError, match="nothing tried to claim"):
            t.check_done()


@pytest.mark.parametrize("steps, why", [([105, 110, 103], "not after 110"), ([90], "before the start of"), ([100, 150, 199, 198], "not after 199")])
def test_tracker_refuses(steps, why):
    with pytest.raises(ValueError, match=why):
        claims(100, 200, *[("claim", x) for x in steps])
    with pytest.raises(ValueError, match="reversed"):
        RangeTracker(R(2, 1))


@pytest.mark.parametrize(
    "work, claim, progress",
    [
        ((0, 200), None, (0, 200)), ((100, 200), None, (0, 100)), ((0, 200), 300, (200, 0)), ((100, 200), 300, (100, 0)), ((0, 200), 150, (150, 50)), ((100, 200), 150, (50, 50)),
        ((SMALL, LARGE), None, (0, 2**64 - 1)), ((SMALL, LARGE), 0, (2**63, 2**63 - 1)),
    ],
)
def test_tracker_progress(work, claim, progress):
    assert claims(*work, *([] if claim is None else [("claim", claim)]))[0].progress() == progress


def test_claim_observer():
    seen = []
    t = RangeTracker(R(0, 2), lambda at, ok: seen.append((at, ok)))
    assert [t.try_claim(i) for i in (0, 1, 5)] == [True, True, False] and seen == [(0, True), (1, True), (5, False)] and t.progress() == (2, 0)


def test_file_ranges(spark, tmp_path):
    """Lines of 99 equal digits, the digit the line's number modulo ten; split anywhere, each line comes once."""
    (tmp_path / "in").mkdir()
    for n in (100, 900, 10_000, 100_000):
        (tmp_path / f"in/f{n}").write_text("".join(str(i % 10) * 99 + "\n" for i in range(n // 100)))
    for split in (32 << 20, 4099, 100, 7001):
        got = readers.line_ranges(spark, str(tmp_path / "in"), split=split)
        first = {r.c: r.n for r in got.groupBy(text.first_char(F.col("value")).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
        assert first == {"0": 112, **{str(k): 111 for k in range(1, 9)}, "9": 110}
        assert got.select("path", "start").distinct().count() == 1110
    (tmp_path / "in/empty").write_text("")
    (tmp_path / "in/last").write_bytes(b"no end\r\n\xe9")
    assert {r.value for r in readers.line_ranges(spark, str(tmp_path / "in/last"), split=2, encoding="latin-1").collect()} == {"no end", "\xe9"}
    parts = readers.chunks(spark, str(tmp_path / "in"), 64, split=1000).orderBy("path", "start").collect()
    whole = {}
    for r in parts:
        whole[r.path[-6:]] = whole.get(r.path[-6:], b"") + bytes(r.content)
        assert len(r.content) <= 64
    assert sorted(map(len, whole.values())) == [9, 100, 900, 10_000, 100_000]


def test_read_all(spark, tmp_path):
    (tmp_path / "a1").write_text("x\ny\n")
    (tmp_path / "a2").write_text("z\n")
    globs = spark.createDataFrame([(str(tmp_path / "a*"),), (str(tmp_path / "none*"),), (None,)], "pattern string")
    assert sorted(r.value for r in readers.read_all(spark, globs).collect()) == ["x", "y", "z"]
    (tmp_path / "a3").write_text("w\n")
    assert readers.read_all(spark, globs).count() == 4 and readers.read_all(spark, globs.where("pattern is null")).count() == 0


def test_default_trigger(spark):
    """hello in time, world late but within five seconds: each has a pane of its own at the window's end."""
    rows = [(0, "hello", 1), (1, "-", 14_999), (2, "world", 3000)]
    d = spark.createDataFrame([(i, w, readers.epoch(ms)) for i, w, ms in rows], "arrival long, w string, ts timestamp")
    marked = windows.fixed(panes.with_watermark(d, "arrival"), "10 seconds").where("w <> '-'")
    got = panes.default_panes(marked, ["w", "window_end"], F.lit(1), "5 seconds", ["arrival"]).withColumn("at", F.unix_millis("window_end") - 1).collect()
    assert sorted((r.at, r.w, r.total) for r in got) == [(9999, "hello", 1), (9999, "world", 1)]


def test_user_panes(spark):
    """Twelve minutes pass, then fifteen, under a delay of ten from a pane's first element."""
    rows = [("scarlet", 3, 0), ("scarlet", 2, 0), ("oxblood", 2, 12), ("scarlet", 4, 12)]
    d = spark.createDataFrame(rows, "user string, score long, minute long")
    got = panes.delayed_panes(d, "user", F.col("minute"), 10, F.col("score")).collect()
    assert sorted((r.user, r.total) for r in got) == [("oxblood", 2), ("scarlet", 5), ("scarlet", 9)]


def test_flush_chain_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        times = [0, 1, 2, 10, 11, 12, 13, 20, 21, 22, 35]
        d = spark.createDataFrame([(k, t) for k in ("a", None, "b") for t in times], "k string, t long")
        got = stateful.flush_chain(d, "k", F.col("t"), 10, F.lit(2)).orderBy("k", "first").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    chain = [(0, 10, 4, 8), (11, 21, 5, 10), (22, 32, 1, 2), (35, 45, 1, 2)]
    assert [tuple(r) for r in got] == [(k, *c) for k in (None, "a", "b") for c in chain]


def test_single_values(spark):
    d = spark.createDataFrame([(1,), (2,)], "v int")
    with pytest.raises(Exception, match="more than one row"):
        joins.with_scalar(d, d.withColumnRenamed("v", "w")).collect()
    assert [r.w for r in joins.with_scalar(d, d.where("v > 9").withColumnRenamed("v", "w")).collect()] == [None, None]
    early = spark.createDataFrame([(readers.epoch(10_000),)], "ts timestamp")
    with pytest.raises(Exception, match="more than 5 seconds before"):
        windows.with_timestamp(early, F.col("ts") - F.expr("interval 6 seconds"), skew="5 seconds").collect()
    assert sinks.wait_on([lambda: None], lambda: "started") == "started"


def test_read_delay(spark):
    import time

    began = time.time()
    assert elements.slowed(spark.range(5).coalesce(1), 100).count() == 5 and time.time() - began >= 0.5


def test_sources_and_sinks(spark, tmp_path):
    spark.dataSource.register(WordRangeSource)
    got = spark.read.format("word_ranges").option("text", "to be or").load().collect()
    assert sorted(map(tuple, got)) == [(0, "to"), (1, "be"), (2, "or")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/f").write_bytes(b"0123456789")
    assert sorted(bytes(r.content) for r in readers.chunks(spark, str(tmp_path / "in"), 4).collect()) == [b"0123", b"4567", b"89"]
    d = windows.fixed(timed(spark, ("a", 0), ("b", 61_000)), "1 minute")
    names = sinks.write_window_files(d, str(tmp_path / "w"), "w")
    assert names == ["1970-01-01/output-00:00-00:01-0-of-1", "1970-01-01/output-00:01-00:02-0-of-1"]
    assert [(tmp_path / "w" / n).read_text() for n in names] == ["a\n", "b\n"]
    with pytest.raises(Exception, match="without a window"):
        sinks.write_window_files(d.withColumn("window_end", F.lit(None).cast("timestamp")), str(tmp_path / "w2"), "w")
    table = str(tmp_path / "t")
    sinks.upsert(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), table, "k")
    assert sinks.upsert(spark.createDataFrame([("b", 3)], "k string, v int"), table, "k") == 2
    assert sorted(map(tuple, sinks.read_upserted(spark, table).select("k", "v").collect())) == [("a", 1), ("b", 3)]
    # a call that fails before its pointer is written changes nothing
    broken = spark.createDataFrame([("c", 4)], "k string, v int").withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        sinks.upsert(broken, table, "k", tries=2)
    assert sinks.read_upserted(spark, table).count() == 2
    # of two writers of one version the second tries again on top of the first
    held, sinks._version = sinks._version, lambda s, p, stale=[True]: (1, held(s, p)[1]) if stale and stale.pop() else held(s, p)
    try:
        assert sinks.upsert(spark.createDataFrame([("c", 5)], "k string, v int"), table, "k") == 3
    finally:
        sinks._version = held
    assert sinks.read_upserted(spark, table).count() == 3

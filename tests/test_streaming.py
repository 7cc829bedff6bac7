import pytest

from pyspark.sql import functions as F
from rillflow.sources import readers, sinks
from rillflow.streaming import processors as P


@pytest.fixture
def stream_spark(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def drain(df, tmp_path, mode="append"):
    out = []
    q = sinks.write_stream(df, str(tmp_path / "cp"), lambda b, i: out.extend(map(tuple, b.collect())), mode=mode)
    q.awaitTermination(120)
    return out


def test_sliding_average(stream_spark, tmp_path):
    at = lambda w, ms: (w, readers.epoch(ms))
    (tmp_path / "in").mkdir()
    s = readers.script(stream_spark, str(tmp_path / "in"), [[at("a", 0), at("bb", 1999), at("ccc", 5000), at("dddd", 10_000)], [at(None, 10**8)], [at(None, 10**8 + 1)]], "w string, ts timestamp")
    got = drain(P.windowed(s, [], [F.avg(F.length("w")).alias("a")], "10 seconds", "2 seconds").where("a is not null"), tmp_path)
    assert sorted(r[2] for r in got) == [1.5] * 2 + [2.0] * 3 + [3.5] * 2 + [4.0] * 3


def test_late_router(stream_spark, tmp_path):
    at = lambda w, ms: (w, readers.epoch(ms))
    (tmp_path / "in").mkdir()
    s = readers.script(stream_spark, str(tmp_path / "in"), [[at("a", 1)], [at("-", 1999)], [at("b", 999), at("-", 2000)], [at("c", 0)]], "w string, ts timestamp")
    main, late = [], []
    router = lambda: P.LateRouter(lambda b, i: main.extend(r.w for r in b.collect()), lambda b, i: late.extend(r.w for r in b.collect()), "1 second", "1 second", str(tmp_path / "marks"))
    sinks.write_stream(s, str(tmp_path / "cp"), router()).awaitTermination(120)
    assert ([x for x in main if x != "-"], late) == (["a", "b"], ["c"])
    # a restart goes on with the stored watermark
    more = readers.script(stream_spark, str(tmp_path / "in"), [[at("d", 0), at("e", 2001)]], "w string, ts timestamp", first=4)
    sinks.write_stream(more, str(tmp_path / "cp"), router()).awaitTermination(120)
    assert ([x for x in main if x != "-"], late) == (["a", "b", "e"], ["c", "d"])


def test_count_buffer(stream_spark, tmp_path):
    (tmp_path / "in").mkdir()
    s = readers.script(stream_spark, str(tmp_path / "in"), [[("k", "1"), ("k", "2")], [("k", "3"), ("j", "4")]], "key string, value string")
    got = drain(P.stateful(s, "key", P.CountBuffer(3), "key string, value string", "none"), tmp_path)
    assert sorted(got) == [("k", "1"), ("k", "2"), ("k", "3")]


LINES = ["the quick brown fox jumps over the lazy dog", "lorem ipsum dolor sit amet", "a bb ccc"]


def test_timed_batcher(stream_spark, tmp_path):
    """Words in batches of at most ten, or after a second: every word comes out once, with its length."""
    words = [w for line in LINES for w in line.split()]
    rows = [("k", w, 1 + 10 * i, readers.epoch(1 + 10 * i)) for i, w in enumerate(words)]
    (tmp_path / "in").mkdir()
    end = ("end", "-", 10**7, readers.epoch(10**7))
    s = readers.script(stream_spark, str(tmp_path / "in"), [rows[:4], rows[4:], [end], [("end", "-", 10**7 + 1, readers.epoch(10**7 + 1))]], "key string, value string, at long, ts timestamp")
    got = drain(P.stateful(s.withWatermark("ts", "0 seconds"), "key", P.TimedBatcher(10, 1000), "key string, values array<string>"), tmp_path)
    batches = [list(b) for k, b in got if k == "k"]
    assert sorted((w, len(w)) for b in batches for w in b) == sorted((w, len(w)) for w in words)
    assert [len(b) for b in batches] == [10, 7]


def test_looping_timer(stream_spark, tmp_path):
    rows = [[("k", ms, readers.epoch(ms))] for ms in (1, 1000, 3500, 9000, 9001)]
    (tmp_path / "in").mkdir()
    s = readers.script(stream_spark, str(tmp_path / "in"), rows, "key string, at long, ts timestamp")
    got = drain(P.stateful(s.withWatermark("ts", "0 seconds"), "key", P.LoopingTimer(50, 1000, 4000), "key string, tick long"), tmp_path)
    assert sorted(got) == [("k", t) for t in (51, 1051, 2051, 3051)]


def test_running_value(stream_spark, tmp_path):
    seeds = stream_spark.createDataFrame([("a", 10.0, 2), ("z", 1.0, 1)], "key string, total double, cnt long")
    (tmp_path / "in").mkdir()
    s = readers.script(stream_spark, str(tmp_path / "in"), [[("a", 5.0, 1), ("b", 1.0, 1)], [("a", 2.5, 3), ("a", 1.0, 2)]], "key string, price double, at long")
    got = drain(P.stateful(s, "key", P.RunningValue(), "key string, price double, total double, cnt long", "none", initial=seeds), tmp_path)
    assert sorted(got) == [("a", 1.0, 16.0, 4), ("a", 2.5, 18.5, 5), ("a", 5.0, 15.0, 3), ("b", 1.0, 1.0, 1)]


def test_delayed_panes(stream_spark, tmp_path):
    """Scores under a delay of ten minutes since a pane's first element."""
    minute = 60_000
    at = lambda u, v, m: (u, v, m * minute + 1, readers.epoch(m * minute + 1))
    (tmp_path / "in").mkdir()
    s = readers.script(stream_spark, str(tmp_path / "in"), [[at("scarlet", 3, 0), at("scarlet", 2, 1)], [at("-", 0, 12)], [at("-", 0, 12)], [at("oxblood", 2, 13), at("scarlet", 4, 13)], [at("-", 0, 27)], [at("-", 0, 28)]], "key string, value long, at long, ts timestamp")
    got = drain(P.stateful(s.withWatermark("ts", "0 seconds"), "key", P.DelayedPanes(10 * minute), "key string, pane long, total long"), tmp_path)
    assert sorted(r for r in got if r[0] != "-") == [("oxblood", 0, 2), ("scarlet", 0, 5), ("scarlet", 1, 9)]


def test_expiring_window(stream_spark, tmp_path):
    at = lambda k, ms: (k, ms, readers.epoch(ms))
    (tmp_path / "in").mkdir()
    s = readers.script(stream_spark, str(tmp_path / "in"), [[at("k", 1), at("k", 999)], [at("k", 2500)], [at("k", 400)], [at("k", 9000)], [at("k", 9001)]], "key string, at long, ts timestamp")
    got = drain(P.stateful(s.withWatermark("ts", "0 seconds"), "key", P.ExpiringWindow(1000, 500), "key string, window_end long, n long"), tmp_path)
    assert sorted(got) == [("k", 1000, 2), ("k", 3000, 1)]


def test_counting_source(stream_spark, tmp_path):
    """Resumes and stops; what follows a batch's success sees every end."""
    run = lambda stop: drain(readers.counting(stream_spark, start=5, per_batch=4, stop=stop, committed=tmp_path / "ends"), tmp_path)
    # a run that takes what is there now is one batch
    assert [sorted(run(stop)) for stop in (12, 12, 12, 15)] == [[(i,) for i in r] for r in (range(5, 9), range(9, 12), [], range(12, 15))]
    assert (tmp_path / "ends").read_text().split() == ["9", "12"]  # the last batch's end is told with the next one


def test_watched_directory(stream_spark, tmp_path):
    (tmp_path / "in/below").mkdir(parents=True)
    (tmp_path / "in/a").write_text("one\ntwo\n")
    lines = readers.watch_directory(stream_spark, str(tmp_path / "in")).select("value", F.element_at(F.split("path", "/"), -1))
    assert sorted(drain(lines, tmp_path)) == [("one", "a"), ("two", "a")]
    (tmp_path / "in/below/b").write_text("three\n")
    assert drain(lines, tmp_path) == [("three", "b")]


def test_message_values(stream_spark, tmp_path):
    """A bus connector is any format: files here, of which only the values are read."""
    sinks.write_values(stream_spark.createDataFrame([(1.5,), (2.0,)], "x double"), "x", "parquet", path=str(tmp_path / "bus"))
    assert sorted(r.value for r in stream_spark.read.parquet(str(tmp_path / "bus")).collect()) == ["1.5", "2.0"]

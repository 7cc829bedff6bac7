"""The registered queries of the dataflow operators, each with SQL for the same result where SQL can express it.

Arrival order in replay is a fixed permutation of ``event_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions import text
from rillflow.operators import aggregates, elements, joins, panes, stateful, windows
from rillflow.plans import registry
from rillflow.plans.registry import EVENTS, LONG, QUERIES, SHORT, SQL, TIES, Query, events, query, table
from rillflow.plans.registry import flat as _flat


def _all() -> None:
    from rillflow.plans import basics, replay  # noqa: F401  (they register theirs)


def queries() -> dict[str, Query]:
    _all()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(registry.SQL)


def _word_count(separator: str):
    return lambda spark, sf_dir: aggregates.count_per_element(elements.words(table(spark, sf_dir, "documents"), separator=separator), "word")


for _name, _sep in (("word_count", text.LETTER), ("word_count_w", text.WORD), ("word_count_ascii", text.ASCII)):
    QUERIES[_name] = _word_count(_sep)
    _quoted = _sep.replace("'", "''")
    SQL[_name] = f"SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '{_quoted}')) AS word FROM documents) WHERE word <> '' GROUP BY word"


@query(r"""
SELECT count(*) AS n_lines, count(*) FILTER (regexp_full_match(l, '[\x00-\x20]*')) AS n_empty, min(length(l)) AS min_length, max(length(l)) AS max_length, sum(length(l))::BIGINT AS sum_length
FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)""")
def line_stats(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("l"))
    n = F.length("l").cast("long")
    return lines.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(text.is_blank(F.col("l"))).alias("n_empty"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.sum(n).alias("sum_length"))


@query("SELECT word || ': ' || n AS line FROM (SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[^\\p{L}]+')) AS word FROM conversations) WHERE word <> '' GROUP BY word)")
def format_counts(spark, sf_dir):
    n = aggregates.count_per_element(elements.words(table(spark, sf_dir, "conversations")), "word")
    return n.select(text.format_count(F.col("word"), F.col("n")).alias("line"))


@query("SELECT month(l_shipdate)::INT AS month, count(*) AS flag_count FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def monthly_flag_counts(spark, sf_dir):
    flagged = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.month("l_shipdate").alias("month"))
    return aggregates.count_per_element(flagged, "month", out="flag_count")


@query("SELECT event_id, value FROM events WHERE month(ts) = 1 AND event_type = 'view' AND value < (SELECT avg(value) FROM events)")
def below_global_mean(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return aggregates.below_mean(e, "value", (F.month("ts") == 1) & (F.col("event_type") == "view")).select("event_id", "value")


@query("SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, CAST(s_nationkey AS BIGINT) AS s_nationkey, CAST(s_acctbal AS DOUBLE) AS s_acctbal FROM supplier WHERE s_suppkey IS NOT NULL AND s_nationkey IS NOT NULL AND s_acctbal IS NOT NULL")
def typed_projection(spark, sf_dir):
    return elements.typed_rows(table(spark, sf_dir, "supplier"), {"s_suppkey": "int", "s_nationkey": "bigint", "s_acctbal": "double"})


@query("SELECT s_name || ' in ' || n_name AS line FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def cogroup_join_format(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code"), "n_name")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("code"), "s_name")
    return joins.cogroup_join(s, n, "code", strict=True).select(F.concat("s_name", F.lit(" in "), "n_name").alias("line"))


@query("SELECT c_custkey, coalesce(n_name, 'Unknown') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def broadcast_lookup_default(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_regionkey < 3").withColumnRenamed("n_nationkey", "k")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    return joins.lookup_or_default(c, n, "k", "n_name", "Unknown").select("c_custkey", "n_name")


@query("SELECT arg_max(event_type, event_id) AS event_type FROM events")
def latest_global(spark, sf_dir):
    return aggregates.latest(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"])


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_per_key(spark, sf_dir):
    return aggregates.latest(table(spark, sf_dir, "events"), "value", ["ts", "event_id"], ["user_id"])


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id * 1327217885 % 2147483648, event_id) AS r FROM events) WHERE r <= 3")
def sample_per_key(spark, sf_dir):
    return elements.sample_per_key(events(spark, sf_dir), "user_id", 3, ["arrival", "event_id"]).select("user_id", "event_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def fixed_window_count(spark, sf_dir):
    w = windows.fixed(table(spark, sf_dir, "events"), "1 hour")
    return aggregates.count_per_element(w, "window_start", "window_end", "event_type")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * conv_id) AS window_start, word, count(*) AS n
FROM (SELECT conv_id, unnest(string_split_regex(text, '\\W+')) AS word FROM conversations) WHERE word <> '' GROUP BY ALL""".replace("\\\\", "\\"))
def windowed_word_count(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("ts", F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, cast(conv_id as int), 0)"))
    w = windows.fixed(elements.words(c, separator=text.WORD, keep=["ts"]), "1 hour")
    return _flat(aggregates.count_per_element(w, "window_start", "word"))


@query("""WITH w AS (SELECT unnest(generate_series(time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 8 HOUR, time_bucket(INTERVAL 2 HOUR, ts), INTERVAL 2 HOUR)) AS window_start, length(event_type) AS l FROM events)
SELECT window_start, window_start + INTERVAL 10 HOUR AS window_end, sum(l)::DOUBLE / count(*) AS avg_length FROM w GROUP BY window_start""")
def sliding_avg_length(spark, sf_dir):
    w = windows.sliding(table(spark, sf_dir, "events").select("ts", F.length("event_type").alias("l")), "10 hours", "2 hours")
    return w.groupBy("window_start", "window_end").agg((F.sum("l") / F.count("l")).alias("avg_length"))


@query("""SELECT window_start, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, event_type) AS r
FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE r <= 3""")
def topk_per_window(spark, sf_dir):
    w = windows.fixed(table(spark, sf_dir, "events"), "6 hours")
    n = aggregates.count_per_element(w, "window_start", "event_type")
    return aggregates.top_k(n, 3, [F.desc("n"), F.col("event_type")], ["window_start"])


@query("""WITH s AS (SELECT epoch_us(ts) // 1000 AS t0, (user_id % 6 + 1) * 600000 AS size FROM events), w AS (SELECT t0 - (t0 + size) % size AS a, size FROM s)
SELECT make_timestamp(a * 1000) AS window_start, make_timestamp((a + size) * 1000) AS window_end, count(*) AS n FROM w GROUP BY ALL""")
def custom_window(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = windows.sized_by(e.select("ts", "user_id"), (F.col("user_id") % 6 + 1) * 600)
    return _flat(aggregates.count_per_element(w, "window_start", "window_end"))


@query("""WITH h AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, user_id, count(*) AS n FROM events GROUP BY ALL)
SELECT time_bucket(INTERVAL 1 DAY, s + INTERVAL '59 minutes 59.999 seconds') AS window_start, max(n) AS most FROM h GROUP BY 1""")
def rewindowed_max(spark, sf_dir):
    h = aggregates.count_per_element(windows.fixed(table(spark, sf_dir, "events"), "1 hour"), "window_start", "window_end", "user_id")
    return windows.rewindow(h, "1 day").groupBy("window_start").agg(F.max("n").alias("most"))


@query("SELECT DISTINCT time_bucket(INTERVAL 1 HOUR, t) AS window_start, time_bucket(INTERVAL 1 HOUR, t) + INTERVAL 1 HOUR AS window_end FROM (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 30 MINUTE)) AS t FROM events)")
def window_labels(spark, sf_dir):
    return windows.window_labels(table(spark, sf_dir, "events"), "1 hour", "30 minutes")


@query(f"""WITH {EVENTS} SELECT event_id, (sum(length(event_type)) OVER w)::DOUBLE / count(*) OVER w AS avg_length FROM e WINDOW w AS (ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def avg_length_running(spark, sf_dir):
    r = panes.running(events(spark, sf_dir), "arrival", {"s": panes.running_sum(F.length("event_type")), "n": panes.running_sum(F.lit(1))}, ties=TIES)
    return r.select("event_id", (F.col("s") / F.col("n")).alias("avg_length"))


@query(f"""WITH {EVENTS}, k AS (SELECT event_id, arrival, lpad(CAST(length(event_type) AS VARCHAR), 6, '0') || event_type AS k FROM e)
SELECT event_id, substr(max(k) OVER (ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 7) AS longest FROM k""")
def longest_word_running(spark, sf_dir):
    k = events(spark, sf_dir).withColumn("k", F.struct(F.length("event_type").alias("n"), F.col("event_type").alias("w")))
    return panes.running(k.select("event_id", "arrival", "k"), "arrival", {"m": panes.running_max("k")}, ties=TIES).select("event_id", F.col("m.w").alias("longest"))


def _arrived(spark, sf_dir) -> DataFrame:
    return windows.fixed(panes.with_watermark(events(spark, sf_dir), "arrival", ties=TIES), "20 hours")


_ARRIVED = f"""{EVENTS}, a AS (SELECT *, time_bucket(INTERVAL 20 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 20 HOUR AS window_end,
max(ts) OVER (ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS watermark FROM e),
t AS (SELECT *, CASE WHEN coalesce(window_end + INTERVAL 24 HOUR <= watermark, false) THEN 'droppable' ELSE 'main' END AS tag FROM a)"""


@query(f"WITH {_ARRIVED} SELECT event_id, tag FROM t")
def late_split(spark, sf_dir):
    return panes.late_split(_arrived(spark, sf_dir), "24 hours").select("event_id", "tag")


@query(f"""WITH {_ARRIVED}, m AS (SELECT event_type, window_end, CASE WHEN coalesce(window_end <= watermark, false) THEN 'LATE' ELSE 'EARLY' END AS pane_timing, arrival // {SHORT} AS period, sum(cents)::BIGINT AS delta FROM t WHERE tag = 'main' GROUP BY ALL)
SELECT event_type, window_end, pane_timing, period, (sum(delta) OVER (PARTITION BY event_type, window_end ORDER BY pane_timing, period))::BIGINT AS total FROM m
UNION ALL SELECT event_type, window_end, 'ON_TIME', max(period), sum(delta)::BIGINT FROM m WHERE pane_timing = 'EARLY' GROUP BY ALL""")
def team_score_panes(spark, sf_dir):
    every = F.expr(f"arrival div {SHORT}")
    return panes.timed_panes(_arrived(spark, sf_dir), ["event_type", "window_end"], "cents", "24 hours", every)


@query(f"WITH {EVENTS} SELECT user_id, period, (sum(d) OVER (PARTITION BY user_id ORDER BY period))::BIGINT AS total FROM (SELECT user_id, arrival // {LONG} AS period, sum(cents) AS d FROM e GROUP BY ALL)")
def user_score_panes(spark, sf_dir):
    return panes.period_panes(events(spark, sf_dir), ["user_id"], "cents", F.expr(f"arrival div {LONG}"))


@query(f"WITH {EVENTS} SELECT user_id, arrival // {LONG} AS period, sum(cents)::BIGINT AS total FROM e GROUP BY ALL")
def discarding_panes(spark, sf_dir):
    return panes.period_panes(events(spark, sf_dir), ["user_id"], "cents", F.expr(f"arrival div {LONG}"), accumulating=False)


@query(f"WITH {EVENTS} SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, sum(cents)::BIGINT AS total FROM e GROUP BY ALL")
def score_board_map(spark, sf_dir):
    board = aggregates.score_board(windows.fixed(events(spark, sf_dir), "1 day"), "event_type", "cents", ["window_start"])
    return board.select("window_start", F.explode("board").alias("event_type", "total"))


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, CASE event_type WHEN 'view' THEN 1000 ELSE 100 END AS size FROM events)
SELECT event_id, i // size AS batch FROM r WHERE (i // size + 1) * size <= n""")
def count_buffer_flush(spark, sf_dir):
    return stateful.count_buffer(table(spark, sf_dir, "events"), "event_type", ["event_id"], {"view": 1000}, 100).select("event_id", "batch")


@query("SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 100 AS batch, length(event_type)::INT AS rpc FROM events")
def size_batches_rpc(spark, sf_dir):
    b = stateful.size_batches(table(spark, sf_dir, "events"), "event_type", ["event_id"], 100)
    return joins.rpc_lookup(b.select("event_id", "batch", "event_type"), "event_type", lambda: lambda ws: [len(w) for w in ws], "rpc", "int").drop("event_type")


@query("""WITH RECURSIVE f AS (SELECT user_id, min(ts) AS a FROM events GROUP BY user_id
  UNION ALL SELECT f.user_id, (SELECT min(ts) FROM events e WHERE e.user_id = f.user_id AND e.ts > f.a + INTERVAL 1 DAY) FROM f WHERE f.a IS NOT NULL)
SELECT f.user_id, f.a + INTERVAL 1 DAY AS flush_at, count(*) AS n FROM f JOIN events e ON e.user_id = f.user_id AND e.ts >= f.a AND e.ts <= f.a + INTERVAL 1 DAY WHERE f.a IS NOT NULL GROUP BY ALL""")
def time_buffer_flush(spark, sf_dir):
    return _flat(stateful.time_buffer(table(spark, sf_dir, "events"), "user_id", "ts", 86_400))


@query("""WITH s AS (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM (SELECT event_type, date_trunc('millisecond', ts) AS ts FROM events) GROUP BY 1)
SELECT event_type, unnest(generate_series(lo + INTERVAL 50 MILLISECOND, hi, INTERVAL 1 HOUR)) AS tick, '.' AS value FROM s""")
def looping_timer_ticks(spark, sf_dir):
    return _flat(stateful.looping_ticks(table(spark, sf_dir, "events"), "event_type", "ts", 50, 3_600_000))


_PURCHASES = "p AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE event_type = 'purchase')"


@query(f"WITH {_PURCHASES} SELECT event_id, (sum(cents) OVER w)::BIGINT AS total, count(*) OVER w AS cnt FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def ltv_running(spark, sf_dir):
    p = events(spark, sf_dir).where("event_type = 'purchase'")
    return stateful.running_value(p, "user_id", "cents", ["ts", "event_id"]).select("event_id", "total", "cnt")


@query(f"""WITH {_PURCHASES}, s AS (SELECT o_custkey AS user_id, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS total, count(*) AS cnt FROM orders GROUP BY 1)
SELECT event_id, ((sum(cents) OVER w) + coalesce(s.total, 0))::BIGINT AS total, count(*) OVER w + coalesce(s.cnt, 0) AS cnt FROM p LEFT JOIN s USING (user_id) WINDOW w AS (PARTITION BY p.user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def ltv_seed(spark, sf_dir):
    p = events(spark, sf_dir).where("event_type = 'purchase'")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    seed = o.groupBy("user_id").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("cnt"))
    return stateful.running_value(p, "user_id", "cents", ["ts", "event_id"], seed).select("event_id", "total", "cnt")


def _tracks(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("track"), (F.col("event_id") % 90).cast("double").alias("lat"), (F.col("event_id") * 7 % 180).cast("double").alias("lon"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"))


_STEPS = """p AS (SELECT user_id AS track, (event_id % 90)::DOUBLE AS lat, (event_id * 7 % 180)::DOUBLE AS lon, epoch_us(ts) // 1000 AS ts FROM events),
l AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(ts) OVER w AS ts0 FROM p WINDOW w AS (PARTITION BY track ORDER BY ts, lat, lon)),
s AS (SELECT track, ts0, ts AS ts1, 6371000.0::DOUBLE * sqrt(pow(sqrt(greatest(0.0, 2 * (1 - cos(radians(lat - lat0))))), 2) + pow(sqrt(greatest(0.0, 2 * (1 - cos(radians(lon - lon0))))), 2)) AS length FROM l WHERE ts0 IS NOT NULL)"""
_CUTS = f"""{_STEPS}, m AS (SELECT *, unnest(generate_series(ts0 // 3600000, (ts1 - 1) // 3600000)) AS m FROM s WHERE ts1 > ts0),
c AS (SELECT track, greatest(ts0, m * 3600000) AS a, least(ts1, (m + 1) * 3600000) AS b, length, ts1 - ts0 AS d FROM m),
q AS (SELECT track, b AS ts, CAST(round(length * (b - a) / d / 1000) AS BIGINT) AS km, b - a AS duration FROM c)"""


@query(f"WITH {_STEPS} SELECT track, sum(CAST(round(length / 1000) AS BIGINT))::BIGINT AS km, max(ts1) - min(ts0) AS duration FROM s GROUP BY track")
def track_metrics(spark, sf_dir):
    s = stateful.track_steps(_tracks(spark, sf_dir))
    return s.groupBy("track").agg(F.sum(F.round(F.col("length") / 1000).cast("long")).alias("km"), (F.max("ts1") - F.min("ts0")).alias("duration"))


@query(f"WITH {_CUTS} SELECT track, ts, km, duration FROM q")
def minute_metrics(spark, sf_dir):
    m = stateful.minute_metrics(_tracks(spark, sf_dir), period_ms=3_600_000)
    return m.select("track", "ts", F.round(F.col("length") / 1000).cast("long").alias("km"), "duration")


@query(f"WITH {_CUTS} SELECT track, (ts - 1) // 86400000 AS day, sum(km)::DOUBLE * 1000 / sum(duration)::DOUBLE AS pace FROM q GROUP BY ALL")
def avg_pace(spark, sf_dir):
    m = minute_metrics(spark, sf_dir).withColumn("day", F.expr("(ts - 1) div 86400000"))
    return m.groupBy("track", "day").agg(aggregates.average_pace("km", "duration").alias("pace"))


@query(f"""WITH {_CUTS}, sh AS (SELECT track, ((ts - 1) // 3600000 + 1) * 3600000 AS e, sum(km)::DOUBLE * 1000 / sum(duration)::DOUBLE AS pace FROM q GROUP BY ALL),
w AS (SELECT track, unnest(generate_series(((ts - 1) // 3600000 + 1) * 3600000, ((ts - 1) // 3600000 + 5) * 3600000, 3600000)) AS e, km, duration FROM q),
lo AS (SELECT track, e, sum(km)::DOUBLE * 1000 / sum(duration)::DOUBLE AS pace FROM w GROUP BY ALL)
SELECT track, e AS ts, sh.pace / lo.pace > 1 AS faster FROM sh JOIN lo USING (track, e) WHERE lo.pace <> 0 AND sh.pace / lo.pace > 1.1""")
def pace_notifications(spark, sf_dir):
    m = minute_metrics(spark, sf_dir).withColumn("end", F.expr("((ts - 1) div 3600000 + 1) * 3600000"))
    pace = aggregates.average_pace("km", "duration").alias("pace")
    short = m.groupBy("track", F.col("end").alias("window_end")).agg(pace)
    long = m.withColumn("window_end", F.explode(F.sequence(F.col("end"), F.col("end") + 4 * 3_600_000, F.lit(3_600_000).cast("long")))).groupBy("track", "window_end").agg(pace)
    return stateful.pace_notifications(short, long, "track")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, event_type FROM events WHERE value < 10")
def union_all(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return elements.union(e.where("event_type = 'click'"), e.where("value < 10")).drop("value")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'errors' WHEN value > 50 THEN 'large' ELSE 'rest' END AS tag FROM events")
def tagged_outputs(spark, sf_dir):
    tags = {"errors": F.col("event_type") == "error", "large": F.col("value") > 50}
    return elements.tagged(table(spark, sf_dir, "events"), tags, "rest").select("event_id", "tag")


@query("SELECT event_id || ',' || event_type AS line FROM events")
def to_string_kv(spark, sf_dir):
    return table(spark, sf_dir, "events").select(text.key_value(F.col("event_id"), F.col("event_type")).alias("line"))


@query("""SELECT '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS json FROM events""")
def to_json_rows(spark, sf_dir):
    return elements.to_json_rows(table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def parse_json(spark, sf_dir):
    good, _ = elements.parse_json(table(spark, sf_dir, "events").select("event_id", "props"), "props", "k bigint", ["k"])
    return good.select("event_id", "k")


@query("SELECT doc_id, unnest(range(len(w)))::INT AS i, unnest(w) AS word FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def word_index(spark, sf_dir):
    return elements.word_index(table(spark, sf_dir, "documents"), "doc_id")


@query("SELECT word, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(word, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: (a * 31 + c) & 4294967295) & 7 AS bucket FROM (SELECT DISTINCT event_type AS word FROM events)")
def hash_bucket(spark, sf_dir):
    w = table(spark, sf_dir, "events").select(F.col("event_type").alias("word")).distinct()
    return w.select("word", text.hash_bucket(F.col("word"), 10, compatible=True).cast("long").alias("bucket"))


@query("""WITH m AS (SELECT time_bucket(INTERVAL 2 HOUR, ts) AS window_start, count(*) AS n FROM events GROUP BY 1), s AS (SELECT time_bucket(INTERVAL 4 HOUR, ts) AS w, max(event_id) AS last FROM events GROUP BY 1)
SELECT window_start, n, last AS side_last FROM m JOIN s ON s.w = time_bucket(INTERVAL 4 HOUR, window_start)""")
def window_side_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    main = aggregates.count_per_element(windows.fixed(e, "2 hours"), "window_start", "window_end")
    side = windows.fixed(e, "4 hours").groupBy("window_start").agg(F.max("event_id").alias("last"))
    return joins.window_side_join(main, side, 4 * 3_600_000).select("window_start", "n", "side_last")


@query("""SELECT e.event_id, s.event_id AS state FROM events e ASOF LEFT JOIN (SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts WHERE e.event_type = 'purchase'""")
def slowly_changing_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    states = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("value"))
    return joins.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), states, "user_id").select("event_id", "state")


@query("SELECT user_id, list_aggregate(list_sort(list(event_id)), 'string_agg', ' ') AS ids FROM events GROUP BY user_id")
def group_by_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    return e.select("user_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("SELECT split_part(event_type || ':' || user_id, ':', 1) AS key, CASE WHEN value > 50 THEN 'Great job! You are gaining speed.' ELSE 'Looks like you are slowing down. Go! Go! Go!' END AS value FROM events")
def notification_messages(spark, sf_dir):
    from rillflow.sources.sinks import notifications

    e = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit(":"), "user_id").alias("track"), (F.col("value") > 50).alias("faster"))
    return notifications(e)


@query("SELECT true AS near_pi, 4000000 AS samples")
def pi_estimate(spark, sf_dir):
    """Whether the estimate is within ten standard deviations (4 * sqrt(p * (1 - p) / n) with p = pi / 4) of pi."""
    estimate = aggregates.pi_estimate(spark, 4_000_000)
    return estimate.select((F.abs(F.col("pi") - F.pi()) < 10 * 1.6422 / 2000).alias("near_pi"), F.lit(4_000_000).alias("samples"))

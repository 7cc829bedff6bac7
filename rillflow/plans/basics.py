"""Registered queries of sources, elements, lookups and functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillflow.functions import geo, text
from rillflow.operators import aggregates, elements, joins, stateful, windows
from rillflow.plans.registry import events, query, table


@query("SELECT '' AS value")
def impulse(spark, sf_dir):
    from rillflow.sources import readers

    return readers.impulse(spark)


@query("SELECT 'all' AS key, count(*) AS n, sum(length(event_type))::BIGINT AS total FROM events")
def constant_key(spark, sf_dir):
    keyed = elements.with_key(table(spark, sf_dir, "events").select("event_type"), "all")
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("event_type")).alias("total"))


@query("SELECT event_type AS key, user_id AS value, count(*) AS n FROM events GROUP BY ALL")
def swapped_pairs(spark, sf_dir):
    pairs = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"))
    return aggregates.count_per_element(elements.swapped(pairs), "key", "value")


@query("SELECT event_id || ' ' || CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS line, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS bare FROM events")
def record_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_type") != "error", F.col("event_type"))
    return e.select(text.record_line(value, F.col("event_id")).alias("line"), text.record_line(value).alias("bare"))


@query("""SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' AS json FROM events""")
def snake_json(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("eventId"), F.col("event_type").alias("eventType"), F.col("user_id").alias("userId"))
    return elements.to_json_rows(e, e.columns, snake_case=True)


def _broken(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 50 == 7, F.concat(F.lit("x"), "props")).otherwise(F.col("props")).alias("props"))


@query("SELECT count(*) FILTER (event_id % 50 <> 7) AS good, count(*) FILTER (event_id % 50 = 7) AS bad FROM events")
def dead_letter_counts(spark, sf_dir):
    return elements.count_dead_letters(_broken(spark, sf_dir), "props", "k bigint", ["k"])


@query("SELECT event_id, 'x' || props AS props FROM events WHERE event_id % 50 = 7")
def dead_letters(spark, sf_dir):
    return elements.parse_json(_broken(spark, sf_dir), "props", "k bigint", ["k"])[1]


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, strftime(ts, '%H:%M:%S') AS clock, strftime(ts, '%H:%M') AS minute, date_trunc('millisecond', ts) AS parsed FROM events")
def iso_instants(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    iso = text.format_instant(F.col("ts"))
    return e.select("event_id", iso.alias("iso"), text.clock(F.col("ts")).alias("clock"), text.clock(F.col("ts"), seconds=False).alias("minute"), text.parse_instant(iso).cast("timestamp_ntz").alias("parsed"))


@query("SELECT user_id, CAST(round(sum(CAST(value AS DECIMAL(18, 6))), 2) AS VARCHAR) AS total FROM events GROUP BY user_id")
def rounded_sum(spark, sf_dir):
    total = text.round_half_up(F.sum(F.col("value").cast("decimal(18,6)")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(total.cast("decimal(38,2)").cast("string").alias("total"))


@query("SELECT event_type[1] AS first, count(*) AS n FROM events GROUP BY 1")
def first_char_counts(spark, sf_dir):
    firsts = table(spark, sf_dir, "events").select(text.first_char(F.col("event_type")).alias("first"))
    return aggregates.count_per_element(firsts, "first")


@query("SELECT coalesce(sum(event_id) FILTER (value < -1), 0)::BIGINT AS none, sum(event_id)::BIGINT AS every FROM events")
def sum_with_default(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.agg(aggregates.sum_or_zero(F.when(F.col("value") < -1, F.col("event_id"))).alias("none"), aggregates.sum_or_zero(F.col("event_id")).alias("every"))


@query("SELECT doc_id, (length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::BIGINT AS units FROM documents".replace("\\\\", "\\"))
def utf16_lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.utf16_length(F.col("text")).cast("long").alias("units"))


@query("SELECT event_type, unnest(range(length(event_type)))::INT AS i, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def char_pairs(spark, sf_dir):
    n = aggregates.count_per_element(table(spark, sf_dir, "events"), "event_type")
    return elements.char_pairs(n, "event_type").join(n, "event_type").select("event_type", "i", "n")


@query("WITH c AS (SELECT doc_id, text, unnest(range((length(text) + 999) // 1000))::INT AS chunk FROM documents WHERE length(text) > 0) SELECT doc_id, chunk, substring(text, chunk * 1000 + 1, 1000) AS content FROM c")
def chunk_read(spark, sf_dir):
    return elements.text_chunks(table(spark, sf_dir, "documents"), "doc_id", size=1000)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, line FROM l""")
def line_ranges(spark, sf_dir):
    return elements.line_offsets(table(spark, sf_dir, "documents"), "doc_id")


@query("SELECT p_partkey, unnest(range(least((SELECT count(*) FROM region), p_size)))::INT AS i FROM part")
def repeat_by_scalar(spark, sf_dir):
    n = table(spark, sf_dir, "region").agg(F.count(F.lit(1)).alias("regions"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return joins.repeat_each(p, n, F.least("regions", "p_size")).select("p_partkey", "i")


@query("SELECT event_id, event_type || CASE WHEN value < m THEN ' below' ELSE ' above' END AS word FROM events, (SELECT avg(value) AS m FROM events) WHERE value < m OR event_id % 2 = 0")
def contextful_flat_map(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    side = joins.with_scalar(e, e.agg(F.avg("value").alias("m")))
    below = F.col("value") < F.col("m")
    words = F.array_compact(F.array(F.when(below, F.concat("event_type", F.lit(" below"))), F.when(~below & (F.col("event_id") % 2 == 0), F.concat("event_type", F.lit(" above")))))
    return side.select("event_id", F.explode(words).alias("word"))


@query("SELECT event_id FROM events WHERE value < (SELECT avg(c_acctbal) / 100 FROM customer)")
def scalar_filter(spark, sf_dir):
    limit = table(spark, sf_dir, "customer").agg((F.avg("c_acctbal") / 100).alias("limit"))
    return joins.scalar_filter(table(spark, sf_dir, "events").select("event_id", "value"), limit, F.col("value") < F.col("limit")).select("event_id")


@query("WITH o AS (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS total, count(*) AS cnt FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1) SELECT event_id, total AS seed_total, cnt AS seed_cnt FROM events LEFT JOIN o ON user_id = o_custkey")
def table_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_custkey % 3 <> 0").groupBy(F.col("o_custkey").alias("user_id")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("total"), F.count(F.lit(1)).alias("cnt"))
    return joins.table_lookup(table(spark, sf_dir, "events").select("event_id", "user_id"), o, "user_id", {"seed_total": "total", "seed_cnt": "cnt"}).drop("user_id")


@query("""WITH m AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, user_id, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, user_id, max(value) AS top FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT window_start, user_id, n, coalesce(top, 0.0)::DOUBLE AS top FROM m LEFT JOIN s USING (window_start, user_id)""")
def keyed_side_default(spark, sf_dir):
    e = windows.fixed(table(spark, sf_dir, "events"), "1 day")
    main = aggregates.count_per_element(e, "window_start", "user_id")
    side = e.where("event_type = 'purchase'").groupBy("window_start", "user_id").agg(F.max("value").alias("top"))
    return joins.keyed_side_default(main, side, ["user_id"], "top")


@query("SELECT event_id, time_bucket(INTERVAL 1 HOUR, ts) AS ts FROM events")
def skewed_timestamps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    return windows.with_timestamp(e, F.date_trunc("hour", "ts").cast("timestamp_ntz"), skew="1 hour")


@query("SELECT 'u' || user_id AS track, (event_id % 90)::DOUBLE AS lat, (event_id * 7 % 180)::DOUBLE AS lon, epoch_us(ts) // 1000 AS ts FROM events WHERE event_id % 50 <> 7")
def positions_parsed(spark, sf_dir):
    from rillflow.sources import readers

    at = F.unix_millis(F.col("ts").cast("timestamp"))
    lat = F.when(F.col("event_id") % 50 == 7, "north").otherwise((F.col("event_id") % 90).cast("string"))
    lines = table(spark, sf_dir, "events").select(F.concat_ws("\t", F.concat(F.lit("u"), "user_id"), lat, F.col("event_id") * 7 % 180, at).alias("value"))
    return readers.positions(lines)


@query("SELECT event_id, CASE WHEN value > 0 THEN user_id * 1000.0 / (60.0 * value) ELSE 0.0 END AS pace FROM events")
def pace(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", geo.pace(F.col("value"), F.col("user_id")).alias("pace"))


@query("SELECT user_id % 5 AS team, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 0")
def flattened_lists(spark, sf_dir):
    """Lists per key, flattened again."""
    lists = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("all"))
    return aggregates.count_per_element(lists.select((F.col("user_id") % 5).alias("team"), F.explode("all").alias("event_type")), "team", "event_type")


@query("SELECT event_type, user_id, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY GROUPING SETS ((event_type), (event_type, user_id))")
def partial_final(spark, sf_dir):
    """Sums per key and user, and from those partial sums the keys' own."""
    part = events(spark, sf_dir).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    final = part.groupBy("event_type").agg(F.lit(None).cast("long").alias("user_id"), F.sum("n").alias("n"), F.sum("cents").alias("cents"))
    return part.unionByName(final)


@query("SELECT event_type, user_id, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY ALL")
def rebalanced(spark, sf_dir):
    e = elements.rebalance(table(spark, sf_dir, "events").where("event_type = 'signup'"), 7)
    return aggregates.count_per_element(e, "event_type", "user_id")


@query("SELECT event_id, length(event_type)::INT AS n FROM events")
def bundle_lifecycle(spark, sf_dir):
    """A function with a resource, opened once per partition."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    work = lambda size, rows: rows.assign(n=rows["event_type"].map(size).astype("int32"))[["event_id", "n"]]
    return elements.per_partition(e, lambda: len, work, lambda size: None, "event_id long, n int")


@query("SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY user_id")
def running_state_end(spark, sf_dir):
    """The state that a running value leaves behind."""
    e = events(spark, sf_dir)
    r = stateful.running_value(e, "user_id", "cents", ["ts", "event_id"])
    return r.groupBy("user_id").agg(F.max("cnt").alias("n"), F.max("event_id").alias("last"))

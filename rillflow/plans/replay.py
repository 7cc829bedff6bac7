"""Registered queries of triggers, panes, watermarks and expiry in replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillflow.operators import panes, watermarks, windows
from rillflow.plans.registry import EVENTS, TIES, events, flat, query, table

_ARRIVED = f"""{EVENTS}, a AS (SELECT *, time_bucket(INTERVAL 20 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 20 HOUR AS window_end,
max(ts) OVER (ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 HOUR AS watermark FROM e),
t AS (SELECT *, coalesce(window_end <= watermark, false) AS closed FROM a WHERE NOT coalesce(window_end + INTERVAL 24 HOUR <= watermark, false))"""


def _arrived(spark, sf_dir):
    """Windows of 20 hours under a watermark 2 hours behind the latest event."""
    return windows.fixed(panes.with_watermark(events(spark, sf_dir), "arrival", ties=TIES, delay="2 hours"), "20 hours")


_KEYS = ["event_type", "window_end"]


@query(f"""WITH {_ARRIVED}, o AS (SELECT event_type, window_end, sum(cents) AS base FROM t WHERE NOT closed GROUP BY ALL),
l AS (SELECT event_type, window_end, row_number() OVER w AS pane, sum(cents) OVER w AS s FROM t WHERE closed WINDOW w AS (PARTITION BY event_type, window_end ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_type, window_end, 'ON_TIME' AS pane_timing, 0 AS pane, base::BIGINT AS total FROM o
UNION ALL SELECT l.event_type, l.window_end, 'LATE', pane, (s + coalesce(base, 0))::BIGINT FROM l LEFT JOIN o USING (event_type, window_end)""")
def default_trigger(spark, sf_dir):
    return panes.default_panes(_arrived(spark, sf_dir), _KEYS, F.col("cents"), "24 hours", ["arrival", *TIES])


@query(f"""WITH {_ARRIVED} SELECT event_type, window_end, 'ON_TIME' AS pane_timing, 0 AS pane, sum(cents)::BIGINT AS total FROM t WHERE NOT closed GROUP BY ALL
UNION ALL SELECT event_type, window_end, 'LATE', row_number() OVER (PARTITION BY event_type, window_end ORDER BY arrival, event_id), cents FROM t WHERE closed""")
def default_trigger_discarding(spark, sf_dir):
    return panes.default_panes(_arrived(spark, sf_dir), _KEYS, F.col("cents"), "24 hours", ["arrival", *TIES], accumulating=False)


@query(f"WITH {_ARRIVED} SELECT event_type, window_end, count(*)::BIGINT AS total FROM t GROUP BY ALL")
def never_trigger(spark, sf_dir):
    return panes.never_panes(_arrived(spark, sf_dir), _KEYS, F.lit(1), "24 hours")


_CHAIN = f"""RECURSIVE {EVENTS}, f AS (SELECT event_type, min(arrival) AS a FROM e GROUP BY 1
  UNION ALL SELECT f.event_type, (SELECT min(arrival) FROM e WHERE e.event_type = f.event_type AND e.arrival > f.a + 40000000) FROM f WHERE f.a IS NOT NULL),
p AS (SELECT f.event_type, f.a + 40000000 AS fired, count(*) AS n, sum(cents) AS total FROM f JOIN e ON e.event_type = f.event_type AND e.arrival BETWEEN f.a AND f.a + 40000000 WHERE f.a IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {_CHAIN} SELECT event_type, fired, n, (sum(total) OVER (PARTITION BY event_type ORDER BY fired))::BIGINT AS total FROM p")
def delayed_trigger(spark, sf_dir):
    return panes.delayed_panes(events(spark, sf_dir), "event_type", F.col("arrival"), 40_000_000, F.col("cents"))


@query(f"WITH {_CHAIN} SELECT event_type, fired, n, total::BIGINT AS total FROM p")
def delayed_trigger_discarding(spark, sf_dir):
    return panes.delayed_panes(events(spark, sf_dir), "event_type", F.col("arrival"), 40_000_000, F.col("cents"), accumulating=False)


_UNREADABLE = f"{EVENTS}, b AS (SELECT event_id, arrival, CASE WHEN event_id % 1000 = 13 THEN NULL ELSE ts END AS ts FROM e)"


def _unreadable(spark, sf_dir):
    """Events of which one in a thousand has a time that can't be read."""
    return events(spark, sf_dir).select("event_id", "arrival", F.when(F.col("event_id") % 1000 != 13, F.col("ts")).alias("ts"))


@query(f"WITH {_UNREADABLE} SELECT event_id, max(coalesce(ts, TIMESTAMP '1970-01-01')) OVER (ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING) - INTERVAL 1 SECOND AS watermark FROM b")
def watermark_bounded_delay(spark, sf_dir):
    return watermarks.bounded_delay(_unreadable(spark, sf_dir), "arrival", "1 second", ties=TIES).select("event_id", "watermark")


@query(f"WITH {_UNREADABLE} SELECT event_id, max(coalesce(ts, TIMESTAMP '9999-12-31')) OVER (ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING) - INTERVAL 100 MILLISECOND AS watermark FROM b")
def watermark_poisoned(spark, sf_dir):
    poisoned = watermarks.bounded_delay(_unreadable(spark, sf_dir), "arrival", "0.1 seconds", unreadable=watermarks.GREATEST, ties=TIES)
    return poisoned.select("event_id", "watermark")


@query("""WITH e AS (SELECT user_id % 8 AS part, ts, ts + INTERVAL 1 MINUTE * (event_id * 37 % 900) AS at FROM events WHERE user_id % 8 < 7 OR day(ts) < 4),
c AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 06:00:00', TIMESTAMP '2024-01-30 18:00:00', INTERVAL 6 HOUR)) AS c),
m AS (SELECT part, c, (SELECT max(ts) FROM e WHERE e.part = p.part AND e.at <= c) AS top FROM (SELECT DISTINCT part FROM e) p, c)
SELECT part, c AS "check", CASE WHEN top IS NULL OR top > c OR c - INTERVAL 4 HOUR > top THEN c ELSE top END - INTERVAL 4 HOUR AS watermark FROM m""")
def watermark_idle(spark, sf_dir):
    """Partition 7 falls silent on the fourth day."""
    e = table(spark, sf_dir, "events").where("user_id % 8 < 7 or day(ts) < 4").select((F.col("user_id") % 8).alias("part"), "ts", F.expr("ts + make_dt_interval(0, 0, cast(event_id * 37 % 900 as int), 0)").alias("at"))
    checks = spark.sql("SELECT explode(sequence(timestamp_ntz '2024-01-01 06:00:00', timestamp_ntz '2024-01-30 18:00:00', interval 6 hours)) AS check")
    return watermarks.idle_advance(e, "part", F.col("at"), checks, "6 hours", "4 hours")


@query(f"WITH {EVENTS}, p AS (SELECT *, CASE WHEN event_type = 'signup' THEN ts - INTERVAL 1 HOUR END AS promised FROM e) SELECT event_id, max(promised) OVER (ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING) AS watermark FROM p")
def watermark_manual(spark, sf_dir):
    said = events(spark, sf_dir).withColumn("promised", F.when(F.col("event_type") == "signup", F.expr("ts - interval 1 hour")))
    return watermarks.manual(said.select("event_id", "arrival", "promised"), "arrival", "promised", ties=TIES).select("event_id", "watermark")


@query(f"""WITH {_ARRIVED}, c AS (SELECT DISTINCT event_type, window_end FROM a), w AS (SELECT arrival, watermark FROM a WHERE watermark IS NOT NULL)
SELECT event_type, window_end, (SELECT min(arrival) FROM w WHERE w.watermark >= c.window_end + INTERVAL 24 HOUR) AS expired_at FROM c""")
def expired_windows(spark, sf_dir):
    return panes.expired_windows(_arrived(spark, sf_dir), ["event_type"], "24 hours", "arrival")


@query(f"""WITH {EVENTS}, w AS (SELECT *, max(ts) OVER (ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM e)
SELECT event_id, time_bucket(INTERVAL 20 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 44 HOUR <= mark AS closed FROM w WHERE event_type = 'error' AND mark IS NOT NULL""")
def filtered_rows_move_time(spark, sf_dir):
    """All but errors are filtered out; their time still closes the errors' windows."""
    e = events(spark, sf_dir)
    kept, rest = e.where("event_type = 'error'").withColumn("heartbeat", F.lit(False)), e.where("event_type <> 'error'")
    both = kept.unionByName(watermarks.time_only(rest, ["arrival", "ts", *TIES]))
    marked = windows.fixed(panes.with_watermark(both, "arrival", ties=TIES), "20 hours").where("not heartbeat and watermark is not null")
    return marked.select("event_id", (F.col("window_end") + F.expr("interval 24 hours") <= F.col("watermark")).alias("closed"))


@query("""SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, max(ts) AS latest, min(ts) AS earliest, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL '23 hours 59 minutes 59.999 seconds' AS at_end, count(*) AS n FROM events GROUP BY ALL""")
def timestamp_combiners(spark, sf_dir):
    w = windows.fixed(table(spark, sf_dir, "events"), "1 day")
    return w.groupBy("event_type", "window_start", "window_end").agg(
        windows.combined_time("LATEST").alias("latest"), windows.combined_time("EARLIEST").alias("earliest"), windows.combined_time("END_OF_WINDOW").alias("at_end"), F.count(F.lit(1)).alias("n")
    ).drop("window_end")


@query(f"""WITH {_ARRIVED.replace("20 HOUR", "10 HOUR").replace("24 HOUR", "6 HOUR")} SELECT event_type, window_end, sum(cents)::BIGINT AS total FROM t GROUP BY ALL""")
def inherited_windowing(spark, sf_dir):
    """A strategy taken over from another: its trigger and delay as they are, other windows and lateness."""
    base = panes.Windowing("20 hours", lateness="24 hours", trigger="never", delay="2 hours")
    return base.but(size="10 hours", lateness="6 hours").panes(events(spark, sf_dir), ["event_type"], F.col("cents"), "arrival", TIES)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY 1")
def global_per_window(spark, sf_dir):
    w = windows.fixed(events(spark, sf_dir), "1 day")
    return w.groupBy("window_start").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query("""WITH t AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02', INTERVAL 10 MINUTE)) AS ts)
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, min(ts) AS first FROM t GROUP BY 1""")
def periodic_impulse(spark, sf_dir):
    from rillflow.sources import readers

    start = 1_704_067_200_000
    t = windows.fixed(readers.periodic_impulse(spark, start, start + 86_400_000, 600_000), "1 hour")
    return flat(t.groupBy("window_start").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first")))


@query("SELECT range AS id, TIMESTAMP '2024-01-01' + INTERVAL 1 MILLISECOND * (range * 300) AS ts FROM range(0, 5000)")
def sequence_generator(spark, sf_dir):
    from rillflow.sources import readers

    return flat(readers.sequence(spark, 0, 5000, 300, 1_704_067_200_000))


@query("""WITH t AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-05', INTERVAL 6 HOUR)) AS tick),
v AS (SELECT tick, event_type, count(*) AS n FROM t JOIN events ON ts < tick GROUP BY ALL),
m AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-05', INTERVAL 2 HOUR)) AS at)
SELECT m.at, event_type, n FROM m JOIN v ON v.tick = time_bucket(INTERVAL 6 HOUR, m.at)""")
def slowly_updating_view(spark, sf_dir):
    """Every six hours the counts are read anew; each main tick gives all entries of its window's view."""
    from rillflow.operators import joins

    span = "sequence(timestamp_ntz '2024-01-02', timestamp_ntz '2024-01-05', interval {} hours)"
    ticks = spark.sql(f"SELECT explode({span.format(6)}) AS tick")
    main = spark.sql(f"SELECT explode({span.format(2)}) AS at")
    before = F.col("ts") < F.expr("timestamp_ntz '2024-01-05'")
    e = table(spark, sf_dir, "events").where(before).select("event_type", "ts")
    view = joins.versions(e, ticks, ["event_type"], "6 hours")
    return joins.view_entries(main, view, "6 hours").select("at", "event_type", "n")

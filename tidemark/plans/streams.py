"""Named queries that replay the driver tables as streams, with their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tidemark.plans.catalog import query, table
from tidemark.sources.scratch import scratch_folder
from tidemark.streaming import growth, tail


@query("""WITH e AS (SELECT event_type AS host, ts, user_id::VARCHAR AS name, value, date_trunc('day', ts) AS day FROM events),
checks AS (
  SELECT host, unnest(generate_series(min(day) + INTERVAL 1 DAY, (SELECT date_trunc('day', max(ts)) FROM e) - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day FROM e GROUP BY host
), counts AS (SELECT host, day, name, count(*) AS n FROM e GROUP BY ALL),
tops AS (
  SELECT host, day, sum(n) AS entries, string_agg(name || ':' || n, ',' ORDER BY n DESC, name) FILTER (WHERE k <= 5) AS top
  FROM (SELECT *, row_number() OVER (PARTITION BY host, day ORDER BY n DESC, name) AS k FROM counts) GROUP BY host, day
), sizes AS (SELECT c.host, c.day, arg_max(e.value, e.ts) AS size_mb FROM checks c JOIN e ON e.host = c.host AND e.ts < c.day + INTERVAL 1 DAY GROUP BY ALL)
SELECT host, (day + INTERVAL 1 DAY)::TIMESTAMP AS checked_at, coalesce(entries, 0)::BIGINT AS entries, size_mb, coalesce(entries, 0) > 65 OR size_mb > 60 AS flagged,
  CASE WHEN coalesce(entries, 0) > 65 OR size_mb > 60 THEN coalesce(top, '') END AS top FROM checks JOIN sizes USING (host, day) LEFT JOIN tops USING (host, day)""")
def growth_watch(spark, sf_dir):
    """The events replayed as a log of five hosts, checked every day: over 65 entries or a size over 60 is flagged, with the five busiest users."""
    kind = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    entries = stream.select(F.col("event_type").alias("host"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("name"), F.col("value").alias("size_mb"))
    checks = growth.watch_growth(entries, datetime.timedelta(days=1), most_entries=65, most_mb=60.0)
    folder = scratch_folder(spark, "growth")
    out = growth.replayed(spark, checks, f"{folder}/checks", f"{folder}/state")
    return out.select("host", F.col("checked_at").cast("timestamp_ntz").alias("checked_at"), "entries", "size_mb", "flagged", "top")


@query("""SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS disk_pct, CASE WHEN event_id % 2 = 0 THEN event_id % 7 + 0.5 END::DOUBLE AS dimm2_temp FROM events""")
def tailed_metrics(spark, sf_dir):
    """The events as rows of metric logs in several files, followed as a stream by ranges of bytes; odd rows lack the last column."""
    e = table(spark, sf_dir, "events")
    disk = F.when(F.col("event_id") % 4 != 0, F.col("value").cast("string")).otherwise("unknown")
    late = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 7 + 0.5).cast("string"))
    line = F.concat_ws("\t", F.lit("2024-05-01T00:00:00"), disk, F.col("event_id"), *[F.lit("1")] * 7, late)
    folder = scratch_folder(spark, "tail")
    e.select(line.alias("value")).write.text(f"{folder}/log")
    lines = tail.tail(spark, f"{folder}/log".removeprefix("file://"), taskBytes="100000")
    rows = tail.metric_lines(lines).select(F.col("dimm1_temp").cast("long").alias("event_id"), "disk_pct", "dimm2_temp")
    return growth.replayed(spark, rows, f"{folder}/rows", f"{folder}/state")

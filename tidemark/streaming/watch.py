"""Structured Streaming: rolling counts, peaks, gaps, growth watch with kept state, live JSON lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolling_counts(events: DataFrame, length: str = "1 hour", slide: str = "10 minutes", late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts in sliding windows; with a stream, rows later than ``late`` are left out."""
    w = F.window("ts", length, slide)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def daily_peak(metrics: DataFrame, value: str, late: str = "1 day") -> DataFrame:
    out = metrics.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.max(value).alias("peak"))
    return out.select(F.col("w.start").alias("day"), "peak")


def gaps(beats: DataFrame, key: str, cadence_s: float) -> DataFrame:
    """Batch: consecutive beats of a key more than one and a half cadences apart."""
    from pyspark.sql import Window as W

    before = F.lag("ts").over(W.partitionBy(key).orderBy("ts"))
    out = beats.select(key, before.alias("since"), "ts").withColumn("gap_s", F.col("ts").cast("timestamp").cast("double") - F.col("since").cast("timestamp").cast("double"))
    return out.where(F.col("gap_s") > 1.5 * cadence_s)


def sessions(events: DataFrame, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Streaming gaps: runs of events parted by more than ``gap``."""
    out = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def growth_watch(events: DataFrame, key: str, most: int) -> DataFrame:
    """For each micro-batch and key: entries since the last check, the running total, and whether over
    the limit. A key's first batch only seeds its state."""

    def check(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = sum(len(f) for f in frames)
        seeded = state.exists
        total = (state.get[0] if seeded else 0) + n
        state.update((total,))
        yield pd.DataFrame({key: [k[0]], "entries": [n if seeded else 0], "total": [total], "flagged": [seeded and n > most]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(check, f"{key} {kind}, entries long, total long, flagged boolean", "total long", "update", "NoTimeout")


def live_json_lines(lines: DataFrame) -> DataFrame:
    """Lines of a file that is being written: a malformed last line is left out, a malformed other one fails."""
    ok = F.try_parse_json("raw").isNotNull() | (F.col("raw") == "")
    checked = lines.select("*", F.when(ok, True).when(F.col("is_last"), False).otherwise(F.raise_error(F.concat(F.lit("malformed line in "), "relpath")).cast("boolean")).alias("__ok"))
    return checked.where("__ok").drop("__ok")


def run_each_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process all that is available now, batch by batch, and stop."""
    q = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()

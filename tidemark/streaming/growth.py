"""The growth watch as one stateful operator: a check of each host's log at a fixed cadence of event time.

The first interval in which a host is seen only seeds its state. Each later one is checked when the watermark has passed its end, by a timer: entries
since the last check, the size told last, whether either is over its limit, and if so the five most frequent
identifiers. Intervals without entries are checked as well. State is renewed at each check and bounded by the identifiers of the open intervals.
"""

from __future__ import annotations

import datetime
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.shipping import ship

MOST_ENTRIES, MOST_MB, TOP = 20_000, 6554.0, 5
#: Counts that a task gathers, about, before it adds them to the state.
HELD = 200_000
REPORT = "host string, checked_at timestamp, entries long, size_mb double, flagged boolean, top string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class GrowthWatch(StatefulProcessor):
    """State of a host: the interval that seeds and the one to check next, entries by interval and identifier, the last size of each interval."""

    def __init__(self, cadence_ms: int, most_entries: int, most_mb: float) -> None:
        self.cadence, self.most_entries, self.most_mb = cadence_ms, most_entries, most_mb

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.plan = handle.getValueState("plan", "seed long, next long, size double")
        self.counts = handle.getMapState("counts", "interval long, name string", "n long")
        self.sizes = handle.getMapState("sizes", "interval long", "at long, size double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seed, following, size = self.plan.get() if self.plan.exists() else (None, None, None)
        counts: dict[tuple, int] = defaultdict(int)
        sizes: dict[int, tuple] = {}
        new = not self.counts.exists()
        for frame in rows:
            at = frame["ms"]
            interval = at // self.cadence
            if seed is None or (following == seed and interval.min() < seed):
                seed = following = int(interval.min())
                self.handle.registerTimer((seed + 1) * self.cadence)
            open_ = interval >= following
            for (i, name), n in frame[open_].groupby([interval[open_], "name"], dropna=False).size().items():
                counts[int(i), None if pd.isna(name) else str(name)] += int(n)
            told = frame[open_ & frame["size_mb"].notna()].assign(interval=interval).sort_values(["ms", "size_mb"])
            for i, t, s in told.groupby("interval").tail(1)[["interval", "ms", "size_mb"]].itertuples(index=False):
                sizes[int(i)] = max(sizes.get(int(i), (int(t), float(s))), (int(t), float(s)))
            if len(counts) > HELD:
                self._keep(counts, new)
                new = False
        self._keep(counts, new)
        for i, last in sizes.items():
            if not self.sizes.containsKey((i,)) or self.sizes.getValue((i,)) <= last:
                self.sizes.updateValue((i,), last)
        self.plan.update((seed, following, size))
        yield from ()

    def _keep(self, counts: dict[tuple, int], new: bool) -> None:
        """Add ``counts`` to the state's, which has none if it is ``new``, and empty them. Each call to the state is a message to the JVM."""
        for place, n in counts.items():
            before = None if new else self.counts.getValue(place)
            self.counts.updateValue(place, ((before[0] if before else 0) + n,))
        counts.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seed, following, size = self.plan.get()
        out, ended = [], timerValues.getCurrentWatermarkInMs() // self.cadence
        by_interval: dict[int, dict] = defaultdict(dict)
        for (i, name), (n,) in self.counts.iterator():
            if i < ended:
                by_interval[i][name] = n
        for i, names in by_interval.items():
            for name in names:
                self.counts.removeKey((i, name))
        while following < ended:
            names = by_interval.get(following, {})
            if self.sizes.containsKey((following,)):
                size = self.sizes.getValue((following,))[1]
                self.sizes.removeKey((following,))
            if following > seed:
                entries = sum(names.values())
                flagged = entries > self.most_entries or (size is not None and size > self.most_mb)
                first = sorted((-n, name) for name, n in names.items() if name is not None)[:TOP]
                top = ",".join(f"{name}:{-n}" for n, name in first) if flagged else None
                end = datetime.datetime.fromtimestamp((following + 1) * self.cadence / 1000, datetime.timezone.utc)
                out.append((key[0], pd.Timestamp(end), entries, size, flagged, top))
            following += 1
        self.plan.update((seed, following, size))
        self.handle.registerTimer((following + 1) * self.cadence)
        if out:
            frame = pd.DataFrame(out, columns=["host", "checked_at", "entries", "size_mb", "flagged", "top"])
            yield frame.astype({"size_mb": "float64"})

    def close(self) -> None:
        pass


def watch_growth(entries: DataFrame, cadence: datetime.timedelta, late: str = "0 seconds", most_entries: int = MOST_ENTRIES, most_mb: float = MOST_MB) -> DataFrame:
    """A row for each check of the stream ``entries`` (host, ts, name, size_mb): host, checked_at, entries, size_mb, flagged, top.

    Both limits are strict. ``top`` is name:entries of the most frequent identifiers, by name where they tie, and null unless flagged;
    rows without an identifier count as entries. Size is the one told last by then, null if none was. Rows later
    than ``late`` are left out."""
    spark = entries.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    rows = entries.select(F.col("host").cast("string").alias("host"), "ts", F.col("name").cast("string").alias("name"), F.col("size_mb").cast("double").alias("size_mb"), F.unix_millis(F.col("ts")).alias("ms"))
    watch = GrowthWatch(int(cadence.total_seconds() * 1000), most_entries, most_mb)
    return rows.withWatermark("ts", late).groupBy("host").transformWithStateInPandas(watch, REPORT, "append", "eventTime")


def replayed(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that ``stream`` gives for the input there is now, written below ``path`` and read again."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)

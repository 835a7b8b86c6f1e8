"""The growth watch over several batches and a restart, against a plain replay."""

import collections
import datetime
import random

import pandas as pd
import pytest

from tidemark.streaming import growth

START = datetime.datetime(2026, 3, 1)
SCHEMA = "host string, ts timestamp, name string, size_mb double"


def replay(rows, cadence_h, most_entries, most_mb):
    """Checks of the intervals that end by the last entry's time."""
    out, end = [], max(r[1] for r in rows)
    for host in {r[0] for r in rows}:
        mine = [(int((t - START).total_seconds() // 3600 // cadence_h), t, n, s) for h, t, n, s in rows if h == host]
        i = min(m[0] for m in mine) + 1
        while START + datetime.timedelta(hours=(i + 1) * cadence_h) <= end:
            names = collections.Counter(n for k, _, n, _ in mine if k == i)
            told = [(t, s) for k, t, _, s in mine if k <= i and s is not None]
            size = max(told)[1] if told else None
            flagged = sum(names.values()) > most_entries or (size is not None and size > most_mb)
            top = sorted(((-n, x) for x, n in names.items() if x is not None))[:5]
            out.append((host, START + datetime.timedelta(hours=(i + 1) * cadence_h), sum(names.values()), size, flagged, ",".join(f"{x}:{-n}" for n, x in top) if flagged else None))
            i += 1
    return sorted(out, key=str)


def test_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(11)
    rows, t = [], START + datetime.timedelta(minutes=7)
    for i in range(700):
        t += datetime.timedelta(hours=20 if i == 300 else 0) + datetime.timedelta(minutes=rng.choice([1, 3, 20, 300 if rng.random() < 0.05 else 2]))
        rows.append((rng.choice(["a", "a", "b", "late"]) if t > START + datetime.timedelta(days=2) else "a", t, rng.choice([None, "x", "y", "z", "u", "v", "w"]), rng.choice([None, float(rng.randint(1, 100))])))
    inbox = tmp_path / "in"
    inbox.mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(inbox))
    batches = [rows[:100], rows[100:250], rows[250:260], rows[260:]]
    for upto in (2, 4):
        for i, batch in enumerate(batches[upto - 2 : upto]):
            part = tmp_path / f"part{upto}{i}"
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(str(part))
            next(part.glob("*.parquet")).rename(inbox / f"{upto}{i}.parquet")
        checks = growth.watch_growth(stream, datetime.timedelta(hours=6), most_entries=25, most_mb=95.0)
        out = growth.replayed(spark, checks, str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(((r.host, r.checked_at, r.entries, r.size_mb, r.flagged, r.top) for r in out.collect()), key=str)
    want = replay(rows, 6, 25, 95.0)
    assert got == want
    assert {f for *_, f, _ in want} == {True, False}
    assert any(n == 0 for _, _, n, *_ in want)


@pytest.mark.parametrize(("entries", "size", "flagged"), [(3, 10.0, False), (4, 10.0, True), (1, 11.0, True)])
def test_both_limits_are_strict(spark, tmp_path, entries, size, flagged):
    hour = datetime.timedelta(hours=1)
    rows = [("h", START, "seed", None)] + [("h", START + hour + i * hour / 10, "n", size) for i in range(entries)] + [("h", START + 3 * hour, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    checks = growth.watch_growth(stream, hour, most_entries=3, most_mb=10.0)
    out = growth.replayed(spark, checks, str(tmp_path / "out"), str(tmp_path / "state")).orderBy("checked_at").collect()
    assert [(r.entries, r.size_mb, r.flagged, r.top) for r in out] == [(entries, size, flagged, f"n:{entries}" if flagged else None), (0, size, size > 10, "" if size > 10 else None)]


class Calls:
    """A state's or a handle's methods; map states are dicts, and calls are counted by name."""

    def __init__(self):
        self.n, self.held = collections.Counter(), {}

    def __getattr__(self, name):
        def call(*args):
            self.n[name] += 1
            if name == "updateValue":
                self.held[args[0]] = args[1]
            return {"exists": bool(self.held), "getValue": self.held.get(args[0] if args else None), "containsKey": bool(args) and args[0] in self.held}.get(name)

        return call


@pytest.mark.parametrize("held", [7, 200_000])
def test_state_is_asked_once_for_a_place(monkeypatch, held):
    """Calls to the state grow with the identifiers and intervals of a batch, not with its rows."""
    monkeypatch.setattr(growth, "HELD", held, raising=False)
    watch = growth.GrowthWatch(1000, 1, 1.0)
    watch.handle, watch.plan, watch.counts, watch.sizes = Calls(), Calls(), Calls(), Calls()
    rng, want, last = random.Random(3), collections.Counter(), {}
    for _ in range(2):
        frames = [[(rng.randrange(4000), rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(50))])) for _ in range(500)] for _ in range(6)]
        for t, name, s in (row for f in frames for row in f):
            want[t // 1000, name] += 1
            last[t // 1000] = max(last.get(t // 1000, (-1, 0)), (t, s)) if s is not None else last.get(t // 1000, (-1, 0))
        list(watch.handleInputRows(("h",), iter([pd.DataFrame(f, columns=["ms", "name", "size_mb"]) for f in frames]), None))
        assert watch.counts.held == {k: (n,) for k, n in want.items()}
        assert watch.sizes.held == {(i,): x for i, x in last.items()}
    if held > 12:
        assert watch.counts.n == {"exists": 2, "updateValue": 24, "getValue": 12}
        assert sum(watch.sizes.n.values()) <= 24

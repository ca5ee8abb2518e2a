"""Sessions of events with timers: capped risks and stall alarms.

A key's events are folded into runs without a pause of gap. Arrow batches are folded before the shuffle, so a frequent key sends
a few rows per batch; the state of a key holds its open runs. A run is final once the watermark has passed its last
event and the gap: it comes out then, by a timer, also when the key itself stays silent, and its state goes.
So what comes out doesn't depend on the order of arrival within the watermark, and equals the fold of the whole table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RISK = ["task_id", "type", "phase", "file", "message"]
#: The event that ends a task: silence after it is no stall.
ENDS = "run_finished"


@contextmanager
def timed_state(spark: SparkSession):
    """Start queries with timers inside this: their state is kept in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _merged(runs: list[dict], gap: int, first: int) -> list[dict]:
    """Runs that touch are one: their counts add up, the first events of both are the first of all."""
    out: list[dict] = []
    for r in sorted(runs, key=lambda r: r["start"]):
        if out and r["start"] - out[-1]["last"] <= gap:
            o = out[-1]
            if r["last"] >= o["last"]:
                o["done"] = r["done"] or (r["last"] == o["last"] and o["done"])
            o["last"], o["seen"] = max(o["last"], r["last"]), o["seen"] + r["seen"]
            o["first"] = sorted(o["first"] + r["first"])[:first]
            o["told"] = o["told"] or r["told"]
        else:
            out.append(dict(r))
    return out


def _folding(keys: list[str], gap: int, first: int):
    """Runs of each Arrow batch, a row each: the key, start and last in microseconds, and the run as JSON."""
    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key, g in f.groupby(keys, dropna=False, sort=False):
                key = key if isinstance(key, tuple) else (key,)
                one = [{"start": t, "last": t, "seen": 1, "done": bool(d), "first": [[t, int(s)]], "told": False} for t, s, d in zip(g["us"].tolist(), g["seq"].tolist(), g["done"].tolist(), strict=True)]
                out += [(*(None if pd.isna(k) else k for k in key), pd.Timestamp(r["last"], unit="us"), json.dumps(r)) for r in _merged(one, gap, first)]
            yield pd.DataFrame(out, columns=[*keys, "last_ts", "run"])

    return fold


class _Sessions(StatefulProcessor):
    """Runs of a key in one value; subclasses say what comes out of them and when."""

    def __init__(self, keys: list[str], columns: list[str], gap: int, first: int):
        self.keys, self.columns, self.gap, self.first = keys, columns, gap, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("runs", "value string")

    def handleInputRows(self, key, rows, timerValues):
        held = json.loads(self.state.get()[0]) if self.state.exists() else {"runs": []}
        new = [json.loads(x) for frame in rows for x in frame["run"].tolist()]
        held["runs"] = _merged(held["runs"] + new, self.gap, self.first)
        yield self._out(key, held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.state.exists():
            yield self._out(key, json.loads(self.state.get()[0]), timerValues.getCurrentWatermarkInMs())

    def _out(self, key, held: dict, watermark: int) -> pd.DataFrame:
        rows, due = self.step(held, 1000 * watermark)
        if due is None:
            self.state.clear()
        else:
            self.state.update((json.dumps(held),))
            self.handle.registerTimer(max(due // 1000 + 1, watermark + 1))
        return pd.DataFrame([(*key, *r) for r in rows], columns=[*self.keys, *self.columns])

    def step(self, held: dict, now: int) -> tuple[list[tuple], int | None]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Capped(_Sessions):
    def step(self, held, now):
        rows = [(pd.Timestamp(t, unit="us"), s, k, r["seen"], r["seen"] - len(r["first"])) for r in held["runs"] if r["last"] + self.gap < now for k, (t, s) in enumerate(r["first"], 1)]
        held["runs"] = [r for r in held["runs"] if r["last"] + self.gap >= now]
        return rows, min((r["last"] + self.gap for r in held["runs"]), default=None)


class _Stalls(_Sessions):
    #: Microseconds after which a stalled task is forgotten.
    forget = 0

    def step(self, held, now):
        rows, stalled = [], held.get("stalled")
        for r in held["runs"]:
            if not r["told"] and r["start"] < now:
                r["told"] = True
                if stalled is not None and r["start"] <= stalled + self.forget:
                    rows.append(("resumed", pd.Timestamp(r["start"], unit="us")))
                stalled = None
            if r["last"] + self.gap < now and not r["done"]:
                stalled = r["last"] + self.gap
                rows.append(("stalled", pd.Timestamp(stalled, unit="us")))
        held["runs"] = [r for r in held["runs"] if r["last"] + self.gap >= now]
        if stalled is not None and not held["runs"] and stalled + self.forget < now:
            stalled = None
        held["stalled"] = stalled
        due = [r["last"] + self.gap if r["told"] else r["start"] for r in held["runs"]] + ([] if stalled is None else [stalled + self.forget])
        return rows, min(due, default=None)


def _folded(events: DataFrame, keys: list[str], gap: int, first: int, late: str) -> DataFrame:
    """Events (ts, seq and keys) as runs of each batch, with the watermark on their last event."""
    kinds = dict(events.dtypes)
    rows = events.filter("ts is not null").select(*keys, F.unix_micros("ts").alias("us"), F.coalesce(F.col("seq"), F.lit(0)).cast("long").alias("seq"), F.coalesce(F.col("type") == ENDS, F.lit(False)).alias("done") if "type" in events.columns else F.lit(False).alias("done"))
    shape = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", last_ts timestamp, run string"
    return rows.mapInPandas(_folding(keys, gap, first), shape).withWatermark("last_ts", late)


def _micros(span: str) -> int:
    return int(pd.Timedelta(span).value // 1000)


def capped_risks(events: DataFrame, cap: int = 3, idle: str = "1 hour", late: str = "10 minutes", keys: tuple[str, ...] = tuple(RISK)) -> DataFrame:
    """From a stream of events (ts, seq, keys): of each key's run without a pause of idle the first cap by (ts, seq), as
    rows with nth, the run's number of events, seen, and of those left out, suppressed. A run comes out when the
    watermark is idle past it; its state goes with it. Start the query inside timed_state()."""
    keys = list(keys)
    columns = ["ts", "seq", "nth", "seen", "suppressed"]
    gap = _micros(idle)
    rows = _folded(events, keys, gap, cap, late)
    kinds = dict(events.dtypes)
    shape = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", ts timestamp, seq long, nth int, seen long, suppressed long"
    return rows.groupBy(*keys).transformWithStateInPandas(_Capped(keys, columns, gap, cap), shape, "append", "EventTime")


def stall_alarms(events: DataFrame, gap: str = "45 seconds", late: str = "10 minutes", forget: str = "1 day") -> DataFrame:
    """From a stream of events (task_id, ts, seq, type): task_id, state and at. stalled: no event for longer than gap after the
    last, unless that ended the run; it comes out when the watermark, which other tasks' events move, passes at, whether or
    not the task ever speaks again. resumed: the first event after a stall, within forget of it; after that the state
    goes. Start the query inside timed_state()."""
    processor = _Stalls(["task_id"], ["state", "at"], _micros(gap), 0)
    processor.forget = _micros(forget)
    kind = dict(events.dtypes)["task_id"]
    return _folded(events, ["task_id"], processor.gap, 0, late).groupBy("task_id").transformWithStateInPandas(processor, f"task_id {kind}, state string, at timestamp", "append", "EventTime")


class _Silence(StatefulProcessor):
    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("seen", "at long, stalled boolean, done boolean")

    def handleInputRows(self, key, rows, timerValues):
        now, newest = timerValues.getCurrentProcessingTimeInMs(), None
        for frame in rows:
            for us, done in zip(frame["us"].tolist(), frame["done"].tolist(), strict=True):
                newest = max(newest or (us, done), (us, done))
        stalled = self.state.exists() and self.state.get()[1]
        if newest[1]:
            self.state.clear()
        else:
            self.state.update((now, False, False))
            self.handle.registerTimer(now + self.gap)
        yield pd.DataFrame([(key[0], "resumed", pd.Timestamp(now, unit="ms"))] if stalled else [], columns=["task_id", "state", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.state.exists():
            at, stalled, _ = self.state.get()
            if not stalled and at + self.gap <= timerValues.getCurrentProcessingTimeInMs():
                self.state.update((at, True, False))
                yield pd.DataFrame([(key[0], "stalled", pd.Timestamp(at + self.gap, unit="ms"))], columns=["task_id", "state", "at"])

    def close(self) -> None:
        pass


def silence_alarms(events: DataFrame, gap: str = "45 seconds") -> DataFrame:
    """Like stall_alarms by the clock of the cluster: an alarm fires gap after a task's events last arrived, even if no task sends
    anything. Needs a trigger by processing time; start the query inside timed_state()."""
    rows = events.select("task_id", F.unix_micros("ts").alias("us"), F.coalesce(F.col("type") == ENDS, F.lit(False)).alias("done"))
    kind = dict(events.dtypes)["task_id"]
    return rows.groupBy("task_id").transformWithStateInPandas(_Silence(_micros(gap) // 1000), f"task_id {kind}, state string, at timestamp", "append", "ProcessingTime")

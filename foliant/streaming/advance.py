"""Runs that go from step to step as their tasks end, and runs that fall silent: stateful streams, and the same over a table.

Both streams wait for the watermark before they decide, so that what they tell doesn't depend on the order or the
micro-batches in which a log arrives, as long as it arrives within the stated lateness; what comes later than that is
dropped. All times are epoch milliseconds, worked out before Python sees them, so the session's zone plays no part.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..plans.pipeline import holds
from ..shipping import ship

# States after which a run goes nowhere, and what is said of a run as a whole.
FAILURES = ("failed", "failed_review", "cancelled", "interrupted")
ENDS = (*FAILURES, "succeeded")
SUBMITTED, PAUSE, RESUME = "submitted", "pause", "resume"

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ACTIONS = "run_id long, action string, step_index int, flow string, parent_run long, parent_step int, output string, event_id long, at_ms long"
_TOLD = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[k]) for n, k in (x.split() for x in ACTIONS.split(", "))])


@dataclass(frozen=True)
class FlowStep:
    """A step runs when its conditions hold (as of plans.pipeline: `input.x`, `prev.output.x`, `step[n].output.x`); one with
    a child starts a run of that flow, whose end is its own."""

    when: Mapping[str, Any] = field(default_factory=dict)
    child: str = ""


@dataclass
class Progress:
    """A run between two endings. steps: started, succeeded or skipped, with the output of those that succeeded."""

    phase: str = "running"
    input: str | None = None
    parent_run: int | None = None
    parent_step: int | None = None
    steps: dict[int, tuple[str, str | None]] = field(default_factory=dict)

    def after(self, flow: Sequence[FlowStep], step: int | None, status: str, output: str | None = None, given: str | None = None, parent: tuple[int | None, int | None] = (None, None)) -> list[tuple[str, int | None, str | None]]:
        """What follows from an event: (action, step, output). An ending that is told again, or of a run that has ended, says
        nothing. While a run is paused its steps may end, and none starts until it goes on."""
        if self.phase in ENDS:
            return []
        if status == SUBMITTED:
            self.input, (self.parent_run, self.parent_step) = given, parent
            return [] if self.steps else self._start(flow, 0, None)
        if status == PAUSE:
            self.phase = "paused"
            return []
        if status == RESUME:
            if self.phase != "paused":
                return []
            self.phase = "running"
            open_ = next((n for n in range(len(flow)) if self.steps.get(n, ("",))[0] not in ("succeeded", "skipped")), None)
            if open_ is None:
                return self._end("succeeded")
            return [] if self.steps.get(open_, ("",))[0] == "started" else self._give(flow, open_)
        if step is None or not 0 <= step < len(flow):
            return []
        if status == "succeeded":
            if self.steps.get(step, ("",))[0] == "succeeded":
                return []
            self.steps[step] = ("succeeded", output)
            return [] if self.phase == "paused" else self._start(flow, step + 1, output)
        if status in FAILURES:
            if self.phase == "paused":  # the step is started anew when the run goes on
                self.steps.pop(step, None)
                return []
            return self._end(status, step)
        if status == "paused":
            self.phase = "paused"
            if self.steps.get(step, ("",))[0] == "started":
                del self.steps[step]
            return [("paused", step, None)]
        return []

    def _start(self, flow: Sequence[FlowStep], n: int, prev: str | None) -> list[tuple[str, int | None, str | None]]:
        out: list[tuple[str, int | None, str | None]] = []
        while n < len(flow):
            if n in self.steps:
                return out
            if holds(dict(flow[n].when), self._state(n, prev)):
                return out + self._give(flow, n)
            self.steps[n] = ("skipped", None)
            out.append(("skipped", n, None))
            n += 1
        return out + self._end("succeeded")

    def _give(self, flow: Sequence[FlowStep], n: int) -> list[tuple[str, int | None, str | None]]:
        self.steps[n] = ("started", None)
        return [("child" if flow[n].child else "started", n, None)]

    def _end(self, status: str, step: int | None = None) -> list[tuple[str, int | None, str | None]]:
        last = max((n for n, (s, _) in self.steps.items() if s == "succeeded"), default=None)
        self.phase = status
        return [(status, step, self.steps[last][1] if status == "succeeded" and last is not None else None)]

    def _state(self, n: int, prev: str | None) -> dict[str, Any]:
        done = {str(i): {"output": _read(o)} for i, (s, o) in self.steps.items() if s == "succeeded" and i < n}
        return {"input": _read(self.input), "prev": {} if prev is None else {"output": _read(prev)}, "steps": done}


def _read(text: str | None) -> Any:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def _told(run_id: int, own: Progress, flow: Sequence[FlowStep], event_id: int, at: int, actions: list) -> list[tuple]:
    ended = own.phase in ENDS
    return [(run_id, a, n, flow[n].child if a == "child" else None, own.parent_run if ended else None, own.parent_step if ended else None, output, event_id, at) for a, n, output in actions]


_EVENT = ("run_id long", "event_id long", "at_ms long", "step_index int", "status string", "input string", "output string", "parent_run long", "parent_step int")


def _events(rows: DataFrame) -> list[Column]:
    """The columns of an event; those that the log doesn't have are null."""
    out = []
    for name, kind in (x.split() for x in _EVENT):
        given = F.unix_millis(F.col("ts").cast("timestamp")) if name == "at_ms" else F.col(name) if name in rows.columns else F.lit(None)
        out.append(given.cast(kind).alias(name))
    return out


def advanced(events: DataFrame, flow: Sequence[FlowStep]) -> DataFrame:
    """The actions that a whole log of events leads to (see next_steps): the stream's twin over a table.

    A run's events go in their order through one task, which holds no more than what the run's steps are at.
    """
    ship(events.sparkSession)
    own = events.select(*_events(events)).where("run_id is not null and at_ms is not null").repartition("run_id").sortWithinPartitions("run_id", "at_ms", F.asc_nulls_last("event_id"))
    flow = tuple(flow)

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, state = None, Progress()
        for part in parts:
            out = []
            for run_id, event_id, at, step, status, given, output, *parent in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if run_id != run:
                    run, state = run_id, Progress()
                out += _told(run, state, flow, event_id, at, state.after(flow, step, status, output, given, tuple(parent)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(_TOLD), _TOLD, strict=True)], schema=_TOLD)

    return own.mapInArrow(fold, ACTIONS)


class _Advance(StatefulProcessor):
    def __init__(self, flow: Sequence[FlowStep], keep_ms: int) -> None:
        self.flow, self.keep = tuple(flow), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "phase string, input string, parent_run long, parent_step int, last_ms long")
        self.steps = handle.getMapState("steps", "step_index int", "state string, output string")
        self.waiting = handle.getListState("waiting", ", ".join(_EVENT))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        ended = self.run.exists() and self.run.get()[0] in ENDS
        held = [tuple(r[c.split()[0]] for c in _EVENT) for r in rows]
        if held and not ended:
            self.waiting.appendList(held)
            for at in {x[2] for x in held}:
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        phase, given, parent_run, parent_step, last = self.run.get() if self.run.exists() else ("running", None, None, None, 0)
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((x for x in waiting if x[2] <= now), key=lambda x: (x[2], x[1] is None, x[1] or 0))
        if not due:
            if now >= last + self.keep:  # ended, or not heard of, for so long
                self.run.clear()
                self.steps.clear()
                self.waiting.clear()
            return
        own = Progress(phase, given, parent_run, parent_step, {k[0]: tuple(v) for k, v in self.steps.iterator()} if self.steps.exists() else {})
        for _, event_id, at, step, status, input_, output, *parent in due:
            last = max(last, at)
            for told in _told(key[0], own, self.flow, event_id, at, own.after(self.flow, step, status, output, input_, tuple(parent))):
                yield Row(*_TOLD.names)(*told)
        self.run.update((own.phase, own.input, own.parent_run, own.parent_step, last))
        self.handle.registerTimer(last + self.keep)
        self.steps.clear()
        self.waiting.clear()
        if own.phase not in ENDS:
            for n, state in own.steps.items():
                self.steps.updateValue((n,), state)
            if rest := [x for x in waiting if x[2] > now]:
                self.waiting.put(rest)

    def close(self) -> None:
        pass


def _with_timers(stream: DataFrame, late: str) -> DataFrame:
    spark = ship(stream.sparkSession)
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # timers and maps need it
    return stream.withWatermark("ts", late)


def next_steps(stream: DataFrame, flow: Sequence[FlowStep], *, late: str = "0 seconds", keep_seconds: int = 86_400) -> DataFrame:
    """What follows from the endings of steps: run_id, action (started, child, skipped, paused, or the state a run ends in),
    step_index, flow (of a child), parent_run and parent_step (of a run that ended), output (the last one's of a success),
    event_id and at_ms of the event that led to it.

    stream: run_id long, step_index int, status string, ts timestamp, event_id long; input, output (JSON texts), parent_run
    and parent_step where there are some. Each success starts the next step whose conditions hold, once, and those before
    it are skipped; a success behind which nothing is left ends the run, as does a failure. `submitted` starts a run,
    `pause` and a step that pauses hold it, `resume` goes on at the first step that isn't done. Events without a run or a
    time say nothing. Ends of child runs are endings of their parents (see endings_of_children).

    Events wait for the watermark and are taken by time, then id. A run's state is a map of its steps and what waits; steps
    go when the run ends, and the rest, which keeps repeats of its endings silent, keep_seconds after its last event. So
    does what is left of a run of which nothing was heard for so long.
    """
    own = _with_timers(stream.where("run_id is not null and ts is not null"), late)
    own = own.select("ts", *_events(own))
    return own.groupBy("run_id").transformWithState(_Advance(flow, 1000 * keep_seconds), ACTIONS, "Append", "EventTime")


def endings_of_children(actions: DataFrame) -> DataFrame:
    """Ends of runs that have a parent, as endings of the parent's step, to be added to the log: a child's failure is its parent's."""
    ended = actions.where(F.col("action").isin(*ENDS) & F.col("parent_run").isNotNull())
    return ended.select(F.col("parent_run").alias("run_id"), F.col("parent_step").alias("step_index"), F.col("action").alias("status"), F.timestamp_millis("at_ms").alias("ts"), "event_id", "output")


class _Watch(StatefulProcessor):
    def __init__(self, wait_ms: int, keep_ms: int) -> None:
        self.wait, self.keep = wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.beats = handle.getMapState("beats", "at_ms long", "beat boolean")
        self.end = handle.getValueState("ended", "at_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        for r in rows:
            if r.status in ENDS:
                if not self.end.exists() or r.at_ms < self.end.get()[0]:
                    self.end.update((r.at_ms,))
                    self.handle.registerTimer(r.at_ms + self.keep)
            elif not self.end.exists() or r.at_ms < self.end.get()[0]:
                self.beats.updateValue((r.at_ms,), (True,))
                self.handle.registerTimer(r.at_ms + self.wait)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        beats = sorted(k[0] for k in self.beats.keys()) if self.beats.exists() else []
        end = self.end.get()[0] if self.end.exists() else None
        at = now - self.wait
        if at in beats:
            self.beats.removeKey((at,))
            if not any(at < b <= now for b in beats) and (end is None or end > now):
                yield Row("run_id", "last_seen_ms")(key[0], at)
        if end is not None and now >= end + self.keep:
            self.end.clear()
            self.beats.clear()

    def close(self) -> None:
        pass


def silent(beats: DataFrame, seconds: int, late: str = "0 seconds", keep_seconds: int = 86_400) -> DataFrame:
    """beats: run_id long, ts timestamp, status string. Runs of which nothing was heard for longer than that, by the stream's
    own clock (its watermark): run_id, last_seen_ms, once for each silence.

    A run that has ended is never silent, whatever comes after its end; that it ended is kept for keep_seconds. State is the
    beats of the last seconds.
    """
    own = _with_timers(beats.where("run_id is not null and ts is not null"), late)
    own = own.select("ts", F.col("run_id").cast("long").alias("run_id"), "status", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return own.groupBy("run_id").transformWithState(_Watch(1000 * seconds, 1000 * max(seconds, keep_seconds)), "run_id long, last_seen_ms long", "Append", "EventTime")


def silences(beats: DataFrame, seconds: int, late_seconds: int = 0) -> DataFrame:
    """The same over a table: beats behind which nothing is heard for longer than that, before the table's last time."""
    own = beats.where("run_id is not null and ts is not null").select(F.col("run_id").cast("long").alias("run_id"), "status", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    clock = own.agg((F.max("at_ms") - 1000 * late_seconds).alias("_now"))
    ended = F.col("status").isin(*ENDS)
    w = Window.partitionBy("run_id")
    # repeats of a beat are one before they move
    once = own.groupBy("run_id", "at_ms").agg(F.coalesce(F.bool_or(ended), F.lit(False)).alias("_ends"), F.coalesce(F.bool_or(~ended), F.lit(True)).alias("_beats"))
    marked = once.withColumn("_end", F.min(F.when(F.col("_ends"), F.col("at_ms"))).over(w)).withColumn("_next", F.lead("at_ms").over(w.orderBy("at_ms")))
    alone = F.col("_beats") & (F.col("_end").isNull() | (F.col("at_ms") < F.col("_end"))) & (F.col("_next").isNull() | (F.col("_next") > F.col("at_ms") + 1000 * seconds))
    return marked.where(alone).join(F.broadcast(clock), F.col("at_ms") + 1000 * seconds < F.col("_now")).select("run_id", F.col("at_ms").alias("last_seen_ms"))

"""Work and retry state by key: one step function each, run over a stream with kept state or over a table in order."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.scan import scan

#: The store that keeps the state of a stream; a session that runs one must name it.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Events of work. What they do is said at ``work_step``.
EVENTS = ("claim", "success", "invalid", "error", "error_final", "abandon", "retry", "settle")
#: Nothing has happened to a key yet: status, deadline of a claim (ms), whether it must be reconciled by hand.
NEW = (None, None, False)
_STATE = "status string, deadline long, reconcile boolean"


def use_store(spark: SparkSession) -> None:
    """Let streams of this session keep state in the store that timers and several state variables need."""
    spark.conf.set(*STORE)


def expired(state: tuple, at: int) -> tuple:
    """A claim whose deadline has come is abandoned: nobody may have been paid twice for it, so it isn't retried."""
    status, deadline, _ = state
    return ("abandoned", None, False) if status == "in_flight" and deadline is not None and at >= deadline else state


def work_step(state: tuple, event: str | None, at: int | None, ttl: int) -> tuple[tuple, bool]:
    """The next (status, deadline, reconcile) and whether the event was taken.

    A claim is taken unless the work is done, in flight, invalid or abandoned, and holds for ``ttl`` ms. A
    success is final: nothing overwrites it. An invalid result is final but for a later success. An error
    may be claimed again; an error_final stays in flight until it is reconciled: retry forgets it, settle
    makes it an error. Abandon ends work in flight. Unknown events and events without a time do nothing.
    """
    if at is None:
        return state, False
    state = expired(state, at)
    status, _, _ = state
    if event == "claim":
        free = status not in ("success", "in_flight", "invalid", "abandoned")
        return (("in_flight", at + ttl, False), True) if free else (state, False)
    if status == "success":
        return state, False
    if event in ("success", "invalid"):
        return (event, None, False), True
    if event in ("error", "error_final"):
        return (("error", None, False) if event == "error" else ("in_flight", None, True)), True
    ends = {"abandon": ("abandoned", None, False), "retry": NEW, "settle": ("error", None, False)}
    return (ends[event], True) if event in ends and status == "in_flight" else (state, False)


def _in_order(frames: Iterator[pd.DataFrame], by: list[str]):
    """Rows of a key's frames by ``by``, nulls first; a call that only timers cause has none."""
    held = [f for f in frames if len(f)]
    return pd.concat(held).sort_values(by, kind="stable", na_position="first").itertuples() if held else ()


class _Work(StatefulProcessor):
    """State of a key: its status, how often each event came, and one timer for an open claim."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", _STATE)
        self.counts = handle.getMapState("counts", "event string", "n long")

    def _write(self, before: tuple, after: tuple) -> None:
        if before[1] != after[1]:
            if before[1] is not None:
                self.handle.deleteTimer(before[1])
            if after[1] is not None:
                self.handle.registerTimer(after[1])
        self.status.update(after)

    def _row(self, key, state) -> pd.DataFrame:
        seen = {k[0]: v[0] for k, v in self.counts.iterator()}
        return pd.DataFrame({"key": [key[0]], "status": [state[0]], "reconcile_required": [bool(state[2])], "n_events": [sum(v for k, v in seen.items() if k != "refused")], "n_refused": [seen.get("refused", 0)]})

    def _count(self, name: str) -> None:
        at = (name,)
        self.counts.updateValue(at, ((self.counts.getValue(at)[0] if self.counts.containsKey(at) else 0) + 1,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.status.get()) if self.status.exists() else NEW
        state = before
        for x in _in_order(rows, ["ms", "seq"]):
            event = x.ev if isinstance(x.ev, str) else None
            state, taken = work_step(state, event, None if pd.isna(x.ms) else int(x.ms), self.ttl)
            self._count(event or "unknown")
            if not taken:
                self._count("refused")
        self._write(before, state)
        yield self._row(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = tuple(self.status.get()) if self.status.exists() else NEW
        state = expired(before, expiredTimerInfo.getExpiryTimeInMs())
        if state != before:
            self.status.update(state)
            yield self._row(key, state)

    def close(self) -> None:
        pass


def _events(df: DataFrame, key: str, event: str, at: str, order: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(event).alias("ev"), F.unix_millis(F.col(at)).alias("ms"), F.col(order).alias("seq"), F.col(at).alias("when"))


def work_stream(df: DataFrame, key: str, event: str, at: str, order: str, *, ttl: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A stream of (key, status, reconcile_required, n_events, n_refused), a row for each key that changed.

    Events of one batch are taken by time, then ``order``. A claim's timer is on event time: it ends when
    the watermark, ``late`` behind the newest event, has passed its deadline, or at once when an event of
    the key comes after it. Events later than the watermark are still taken. State is kept for every
    key, in the store of ``use_store``, and goes on from the checkpoint after a restart.
    """
    held = _events(df, key, event, at, order).withWatermark("when", late)
    kind = dict(held.dtypes)["key"]
    spec = f"key {kind}, status string, reconcile_required boolean, n_events long, n_refused long"
    return held.groupBy("key").transformWithStateInPandas(_Work(_millis(ttl)), spec, "Update", "EventTime").withColumnRenamed("key", key)


def work_table(df: DataFrame, key: str, event: str, at: str, order: str, *, ttl: str = "1 hour", until: Any = None) -> DataFrame:
    """The same rows from a table of all events: one scan in order of time, nulls first, then ``order``. Claims
    whose deadline is at or before ``until`` (a timestamp column or literal) are abandoned."""
    span = _millis(ttl)

    def step(state, name, ms):
        state, taken = work_step(state, name, ms, span)
        return state, (*state, taken)

    rows = scan(_events(df, key, event, at, order), ["key"], ["ms", "seq"], ["ev", "ms"], lambda: NEW, step, f"{_STATE}, taken boolean")
    last = F.max_by(F.struct("status", "deadline", "reconcile"), F.struct("ms", "seq"))
    out = rows.groupBy("key").agg(last.alias("s"), F.count("*").alias("n_events"), F.count(F.when(~F.col("taken"), 1)).alias("n_refused"))
    over = F.lit(False) if until is None else F.coalesce(F.unix_millis(F.lit(until).cast("timestamp") if not hasattr(until, "cast") else until.cast("timestamp")) >= F.col("s.deadline"), F.lit(False))
    status = F.when((F.col("s.status") == "in_flight") & over, "abandoned").otherwise(F.col("s.status"))
    return out.select(F.col("key").alias(key), status.alias("status"), F.coalesce("s.reconcile", F.lit(False)).alias("reconcile_required"), "n_events", "n_refused")


def _millis(span: str) -> int:
    """Milliseconds of a span such as '10 minutes'."""
    n, unit = span.split()
    return int(float(n) * {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")])


# ---------------------------------------------------------------- bounded retries


def retry_step(state: tuple, update: int, groups: int | None, *, required: int, batches: int, skips: int) -> tuple[tuple, tuple]:
    """The next (update, batches, accepted, skipped, ended) and what becomes of a generation batch: (used,
    enough, skipped, ended).

    An update takes batches until ``required`` groups are useful, ``batches`` at most. An update that ends
    without enough is skipped; more than ``skips`` skipped ones in a row end the key for good. An update
    ends when the next one begins; batches of an earlier update are late and do nothing.
    """
    now, taken, accepted, skipped, ended = state
    if now is not None and update > now and not ended:
        skipped = 0 if accepted >= required else skipped + 1
        ended = skipped > skips
    if now is None or update > now:
        now, taken, accepted = update, 0, 0
    used = not ended and update == now and taken < batches and accepted < required
    if used:
        taken, accepted = taken + 1, accepted + (groups or 0)
    return (now, taken, accepted, skipped, ended), (used, accepted >= required, skipped, ended)


_RETRY = (None, 0, 0, 0, False)


class _Retry(StatefulProcessor):
    def __init__(self, limits: dict[str, int]):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "update long, batches long, accepted long, skipped long, ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else _RETRY
        out = []
        for x in _in_order(rows, ["upd", "bat"]):
            state, said = retry_step(state, int(x.upd), None if pd.isna(x.useful) else int(x.useful), **self.limits)
            out.append((key[0], x.upd, x.bat, *said))
        self.state.update(state)
        yield pd.DataFrame(out, columns=["key", "update", "batch", "used", "enough", "skipped", "ended"])

    def close(self) -> None:
        pass


def _batches(df: DataFrame, key: str, update: str, batch: str, groups: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(update).cast("long").alias("upd"), F.col(batch).cast("long").alias("bat"), F.col(groups).cast("long").alias("useful")).where("upd is not null")


def retry_stream(df: DataFrame, key: str, update: str, batch: str, groups: str, *, required: int = 1, batches: int = 3, skips: int = 10) -> DataFrame:
    """A stream of (key, update, batch, used, enough, skipped, ended), a row for each generation batch; ``groups``
    is how many of its groups are useful (null: none). Rows without an update do nothing."""
    held = _batches(df, key, update, batch, groups)
    spec = f"key {dict(held.dtypes)['key']}, update long, batch long, used boolean, enough boolean, skipped long, ended boolean"
    limits = {"required": required, "batches": batches, "skips": skips}
    return held.groupBy("key").transformWithStateInPandas(_Retry(limits), spec, "Update", "None").withColumnRenamed("key", key)


def retry_table(df: DataFrame, key: str, update: str, batch: str, groups: str, *, required: int = 1, batches: int = 3, skips: int = 10) -> DataFrame:
    """The same rows from a table of all batches, in one scan by update and batch."""

    def step(state, at, useful):
        return retry_step(state, at, useful, required=required, batches=batches, skips=skips)

    out = scan(_batches(df, key, update, batch, groups), ["key"], ["upd", "bat"], ["upd", "useful"], lambda: _RETRY, step, "used boolean, enough boolean, skipped long, ended boolean")
    return out.select(F.col("key").alias(key), F.col("upd").alias("update"), F.col("bat").alias("batch"), "used", "enough", "skipped", "ended")

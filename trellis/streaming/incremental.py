"""Incremental forms of the stateful operators, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], *, late: str | None = None) -> DataFrame:
    """Counts and sums of value by window and keys; rows later than ``late`` behind the newest drop."""
    held = df.withWatermark(ts, late) if late else df
    return _flat(held.groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")), keys)


def sliding(df: DataFrame, ts: str, size: str, step: str, keys: list[str], *, late: str | None = None) -> DataFrame:
    held = df.withWatermark(ts, late) if late else df
    return _flat(held.groupBy(F.window(ts, size, step), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")), keys)


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], *, late: str | None = None) -> DataFrame:
    held = df.withWatermark(ts, late) if late else df
    return _flat(held.groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")), keys)


def _flat(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n", "total")


def first_writes(df: DataFrame, key: str, ts: str, *, late: str) -> DataFrame:
    """One row a key within the watermark: the first to come wins."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def streaks(df: DataFrame, task: str, step: str, zero: str, *, least: int = 3) -> DataFrame:
    """Keyed streaks of zero steps: (task, streak, admitted_at) after every batch; steps of a batch are
    taken in order, any other step ends the streak, and the first admission is kept."""

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, admitted = state.get if state.exists else (0, None)
        for x in pd.concat(list(frames)).sort_values(step).itertuples():
            streak = streak + 1 if getattr(x, zero) else 0
            if streak >= least and admitted is None:
                admitted = int(getattr(x, step))
        state.update((streak, admitted))
        yield pd.DataFrame({task: [key[0]], "streak": [streak], "admitted_at": pd.array([admitted], "Int64")})

    kind = dict(df.dtypes)[task]
    return df.groupBy(task).applyInPandasWithState(update, f"{task} {kind}, streak long, admitted_at long", "streak long, admitted long", "update", GroupStateTimeout.NoTimeout)


def ledger(df: DataFrame, key: str, status: str, order: str) -> DataFrame:
    """The state of each piece of work from its events: success stays; else the last status, where an
    error that may not be tried again stays in_flight. Batch form; a stream feeds it by key."""
    last = df.groupBy(key).agg(F.max((F.col(status) == "success").cast("int")).alias("_won"), F.max_by(status, order).alias("_last"), F.count("*").alias("n_events"))
    state = F.when(F.col("_won") == 1, "success").when(F.col("_last") == "error_final", "in_flight").otherwise(F.col("_last"))
    return last.select(key, state.alias("state"), (F.col("_last") == "error_final").alias("reconcile_required"), "n_events")

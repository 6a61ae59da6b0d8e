"""Scorers by name: columns, whole batches, or guarded calls of a row at a time."""

from __future__ import annotations

import signal
from collections.abc import Callable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds that a guarded call of one row may take.
TIMEOUT = 300.0
_scorers: dict[str, Callable[..., Column]] = {}


def register(name: str) -> Callable:
    """Add a scorer (columns to a column) under a name; another one under a name that is taken is an error."""

    def put(f: Callable[..., Column]) -> Callable[..., Column]:
        if _scorers.get(name, f) is not f:
            raise ValueError(f"a scorer is named {name}")
        _scorers[name] = f
        return f

    return put


def scorer(name: str) -> Callable[..., Column]:
    if name not in _scorers:
        raise ValueError(f"no scorer is named {name}; there are {sorted(_scorers)}")
    return _scorers[name]


def dispatch(source: Column, by: dict[str, str], *args: Column) -> Column:
    """The score of each row by the scorer of its source; a source without one is null."""
    out = F.lit(None).cast("double")
    for value, name in sorted(by.items()):
        out = F.when(source == value, scorer(name)(*args).cast("double")).otherwise(out)
    return out


def batched(f: Callable[..., list[float]]) -> Callable[..., Column]:
    """A scorer of whole Arrow batches: ``f`` takes lists and gives a list; another length is an error."""

    def run(*cols: pd.Series) -> pd.Series:
        got = list(f(*[c.tolist() for c in cols]))
        if len(got) != len(cols[0]):
            raise ValueError(f"{len(got)} scores for {len(cols[0])} rows")
        return pd.Series([float(x) for x in got])

    return _arrow(run)


def _arrow(run):
    """Columns go over as one struct, so that any number of them is one Arrow batch."""

    def whole(rows: pd.DataFrame) -> pd.Series:
        return run(*[rows[c] for c in rows.columns])

    def call(*cols: Column) -> Column:
        return F.pandas_udf(whole, "double")(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]))

    return call


@contextmanager
def _limit(seconds: float):
    def late(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def guarded(f: Callable[..., float], *, timeout: float = TIMEOUT, failed: float = 0.0) -> Callable[..., Column]:
    """A scorer of one row at a time; a row whose call raises, gives no finite number or takes longer than
    ``timeout`` seconds scores ``failed``, and the rows after it go on."""

    def run(*cols: pd.Series) -> pd.Series:
        out = []
        for row in zip(*cols, strict=True):
            try:
                with _limit(timeout):
                    x = float(f(*row))
                out.append(x if abs(x) < float("inf") else failed)
            except Exception:  # noqa: BLE001  whatever a caller's function does costs its row only
                out.append(failed)
        return pd.Series(out, dtype=float)

    return _arrow(run)

"""Adaptive decision points of ordered ledgers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tideline.plans.shared import partitions

#: Last count of the powers of two, stride beyond it, seconds without a decision; names.
DENSE, STRIDE, HEARTBEAT = 1024, 128, 21_600
NAMES = {1: "first", 2: "early_power_of_two", 3: "trade_stride"}


def count_reasons(n: np.ndarray, dense: int = DENSE, stride: int = STRIDE) -> np.ndarray:
    """0 none, 1 first, 2 power of two up to `dense`, 3 every `stride` beyond it."""
    power = (n > 1) & (n <= dense) & ((n & (n - 1)) == 0)
    return np.where(n == 1, 1, np.where(power, 2, np.where((n > dense) & (n % stride == 0), 3, 0)))


def advance(t: np.ndarray, before: int, last: int | None, heartbeat: int = HEARTBEAT) -> tuple[list[int], list[list[str]], int | None]:
    """Places and reasons of the decisions among ordered times t, after `before` trades and a decision at
    `last`; and the time of the last decision then. From decision to decision, by the next count reason or
    by bisection to the next heartbeat."""
    why = count_reasons(np.arange(before + 1, before + len(t) + 1))
    counted, k, i = np.append(np.flatnonzero(why), len(t)), 0, 0
    at: list[int] = []
    reasons: list[list[str]] = []
    while True:
        while counted[k] < i:
            k += 1
        j = int(counted[k])
        if last is not None:
            j = min(j, max(i, int(np.searchsorted(t, last + heartbeat))))
        if j >= len(t):
            return at, reasons, last
        late = last is not None and t[j] - last >= heartbeat
        at.append(j)
        reasons.append(([NAMES[int(why[j])]] if why[j] else []) + (["heartbeat"] if late else []))
        last, i = int(t[j]), j + 1
        if i >= len(t):
            return at, reasons, last


def decisions(trades: DataFrame, key: str = "component_id", heartbeat: int = HEARTBEAT) -> DataFrame:
    """key, trade_id, timestamp_unix, n, reasons of every decision.

    A trade is a decision for its count, or if `heartbeat` seconds have passed since the last decision: that
    is a recursion along each key. Keys are walked as a stream of sorted batches, with two numbers carried
    from batch to batch, so a key's size does not matter for memory.
    """
    kind, ident = trades.schema[key].dataType.simpleString(), trades.schema["trade_id"].dataType.simpleString()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_key, n, last = None, 0, None
        for pdf in batches:
            keys, t = pdf[key].to_numpy(), pdf["timestamp_unix"].to_numpy(np.int64)
            ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for lo, hi in zip([0, *ends], [*ends, len(pdf)]):
                if lo == hi:
                    continue
                if at_key is None or at_key != (keys[lo],):
                    at_key, n, last = (keys[lo],), 0, None
                at, reasons, last = advance(t[lo:hi], n, last, heartbeat)
                if at:  # Arrow makes no lists of a column without rows
                    where = lo + np.array(at, np.int64)
                    yield pd.DataFrame({key: keys[where], "trade_id": pdf["trade_id"].to_numpy()[where], "timestamp_unix": t[where], "n": n + np.array(at, np.int64) + 1, "reasons": reasons})
                n += hi - lo

    rows = trades.select(key, "trade_id", "timestamp_unix").where(trades[key].isNotNull())
    ordered = rows.repartition(partitions(rows.sparkSession), key).sortWithinPartitions(key, "timestamp_unix", "trade_id")
    return ordered.mapInPandas(walk, f"{key} {kind}, trade_id {ident}, timestamp_unix bigint, n bigint, reasons array<string>")

"""State of keys along sorted batches: one pass gives sums, extremes, gaps, averages with half-lives and sketches.

A key's rows come in order, and its state is carried from batch to batch, so a pass needs memory for a batch and the
states that may go on. Inside a batch all keys are computed together: sums are differences of one cumulative sum (in
extended precision), extremes and registers accumulate over ranks shifted by key, and averages step through all keys
at once, or through one key's rows in closed form where it has many.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd

from tideline.operators.running import ALPHA, REGISTERS, _ema_scan, _register_rank

#: Rows of a key from which it is scanned by itself.
LONG = 64


def estimate(inverse_sum: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """As running.estimate, of arrays."""
    m = float(REGISTERS)
    raw = ALPHA * m * m / inverse_sum
    return np.where((zeros > 0) & (raw <= 2.5 * m), m * np.log(m / np.maximum(zeros, 1)), raw)


@dataclass
class State:
    sums: np.ndarray
    low: float
    high: float
    first: int
    last: int
    previous: object
    averages: np.ndarray
    registers: np.ndarray | None = None


class Segments:
    """The keys of a batch: rows grouped by key, in their order."""

    def __init__(self, keys: np.ndarray) -> None:
        codes, self.names = pd.factorize(keys)
        self.order = np.argsort(codes, kind="stable")
        grouped = codes[self.order]
        self.starts = np.flatnonzero(np.concatenate([[True], grouped[1:] != grouped[:-1]])) if len(keys) else np.zeros(0, int)
        self.ends = np.concatenate([self.starts[1:], [len(keys)]]).astype(int)
        self.of = np.repeat(np.arange(len(self.starts)), self.ends - self.starts)

    def sums(self, values: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Running sums (rows x columns) of each key, from what was before."""
        total = np.cumsum(values, axis=0, dtype=np.longdouble)
        base = np.concatenate([np.zeros((1, values.shape[1]), np.longdouble), total])[self.starts]
        return (total - base[self.of] + before[self.of]).astype(float)

    def highest(self, values: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Running maxima of each key."""
        known, rank = np.unique(np.concatenate([values, before]), return_inverse=True)
        at, carried = rank[: len(values)].copy(), rank[len(values) :]
        at[self.starts] = np.maximum(at[self.starts], carried)
        return known[np.maximum.accumulate(at + self.of * len(known)) - self.of * len(known)]

    def before(self, values: np.ndarray, carried: np.ndarray) -> np.ndarray:
        """The value of the key's row before."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts] = carried
        return out


@dataclass
class Walk:
    """averages: (column of `averaged`, half-life); sketch: whether items are counted by a sketch."""

    averages: Sequence[tuple[int, float]] = ()
    sketch: bool = False
    states: dict[Hashable, State] = field(default_factory=dict)

    def step(self, keys: np.ndarray, ts: np.ndarray, values: np.ndarray, price: np.ndarray, averaged: np.ndarray, item: np.ndarray | None = None, previous: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """After each row of a batch (in order): sums, low, high, gap, age, averages, previous, distinct.

        values are summed; `previous` (objects) is looked up in the key's row before (None where there is none). Keys that may go on
        stay in `states`; the caller drops others.
        """
        g = Segments(keys)
        n, width = len(g.starts), values.shape[1]
        have = [self.states.get(k) for k in g.names]
        known = np.array([s is not None for s in have], bool)
        order = g.order
        t, p = ts[order], price[order]
        none = np.zeros(width, float)
        sums = g.sums(values[order], np.array([none if s is None else s.sums for s in have]).reshape(n, width))
        high = g.highest(p, np.array([-np.inf if s is None else s.high for s in have]))
        low = -g.highest(-p, np.array([-np.inf if s is None else -s.low for s in have]))
        at_start = t[g.starts]
        first = np.array([a if s is None else s.first for s, a in zip(have, at_start)], np.int64)
        last = np.array([a if s is None else s.last for s, a in zip(have, at_start)], np.int64)
        gap = t - g.before(t, last)
        age = t - first[g.of]
        state = np.array([np.zeros(len(self.averages)) if s is None else s.averages for s in have]).reshape(n, len(self.averages))
        mean = self._averages(g, t, averaged[order], state, last, known)
        out = {"sums": sums, "low": low, "high": high, "gap": gap, "age": age, "averages": mean}
        prev = None
        if previous is not None:
            prev = previous[order]
            carried = np.empty(n, object)
            carried[:] = [None if s is None else s.previous for s in have]
            out["previous"] = g.before(prev, carried)
        registers = None
        if self.sketch:
            registers = np.zeros((n, REGISTERS), np.int32)
            for i in np.flatnonzero(known):
                registers[i] = have[i].registers
            out["distinct"] = self._distinct(g, item[order], registers)
        ends = g.ends - 1
        for i, k in enumerate(g.names):
            e = ends[i]
            self.states[k] = State(sums[e], low[e], high[e], first[i], t[e], None if prev is None else prev[e], mean[e], None if registers is None else registers[i])
        for k, v in out.items():
            back = np.empty_like(v)
            back[order] = v
            out[k] = back
        return out

    def keep(self, keys: Sequence[Hashable]) -> None:
        """Only these keys may go on."""
        self.states = {k: self.states[k] for k in keys if k in self.states}

    def _averages(self, g: Segments, t: np.ndarray, x: np.ndarray, state: np.ndarray, last: np.ndarray, known: np.ndarray) -> np.ndarray:
        out = np.empty((len(t), len(self.averages)))
        if not self.averages:
            return out
        size = g.ends - g.starts
        for i in np.flatnonzero(size > LONG):
            lo, hi = g.starts[i], g.ends[i]
            for j, (c, h) in enumerate(self.averages):
                out[lo:hi, j] = _ema_scan(t[lo:hi], x[lo:hi, c], h, state[i, j] if known[i] else None, last[i] if known[i] else None)
        short = np.flatnonzero(size <= LONG)
        column, lives = np.array([c for c, _ in self.averages]), np.array([float(h) for _, h in self.averages])
        now, at, fresh = state[short].copy(), last[short].copy(), ~known[short]
        for k in range(int(size[short].max()) if len(short) else 0):
            live = np.flatnonzero(size[short] > k)
            row = g.starts[short[live]] + k
            d = np.exp2(-(t[row] - at[live])[:, None] / lives)
            v = x[row][:, column]
            step = np.where(fresh[live][:, None], v, d * now[live] + (1 - d) * v)
            now[live], at[live], fresh[live] = step, t[row], False
            out[row] = step
        return out

    @staticmethod
    def _distinct(g: Segments, item: np.ndarray, registers: np.ndarray) -> np.ndarray:
        """Running estimates; registers (keys x REGISTERS) are brought up to date."""
        r = _register_rank(pd.Series(item))
        register, rank = r["register"].to_numpy().astype(np.int64), r["rank"].to_numpy().astype(np.int64)
        start = registers.astype(np.int64)
        # cells of key and register, in order of rows: the maximum before each row
        cell = g.of * REGISTERS + register
        by = np.argsort(cell, kind="stable")
        c, v = cell[by], rank[by]
        head = np.concatenate([[True], c[1:] != c[:-1]])
        v2 = v.copy()
        v2[head] = np.maximum(v[head], start.reshape(-1)[c[head]])
        number = np.cumsum(head) - 1
        top = np.maximum.accumulate(v2 + number * 128) - number * 128
        old = np.empty_like(top)
        old[1:] = top[:-1]
        old[head] = start.reshape(-1)[c[head]]
        raised = v > old
        change = np.zeros((len(item), 2))
        change[by, 0] = np.where(raised, np.exp2(-v.astype(float)) - np.exp2(-old.astype(float)), 0.0)
        change[by, 1] = np.where(raised & (old == 0), -1.0, 0.0)
        before = np.stack([np.exp2(-start.astype(float)).sum(1), (start == 0).sum(1)], 1)
        np.maximum.at(registers.reshape(-1), cell, rank.astype(np.int32))
        now = g.sums(change, before)
        return estimate(now[:, 0], np.rint(now[:, 1]))

"""Runs: stretches of consecutive words that repeat with a period, found by naming blocks of 2**k words.

Level k gives equal blocks of 2**k words of a document equal names (Karp, Miller and Rosenberg); the names of
level k + 1 are those of pairs of level k. A run of period q, 2**k <= q < 2**(k+1), covers three points of any
grid of step q, so the blocks of q words at two neighbouring points are equal, which two overlapping names of
level k tell. Neighbouring points that agree belong to one run; from the first and last of them, the run is
extended by the longest common extension in either direction, in descending levels. There is neither a hash of
words nor a sorted suffix: equal names are equal words.

A position whose block occurs nowhere else in its document has no name, and a run needs a long enough stretch
of named positions: levels end where there is none, which for ordinary prose is soon. Work on n words is
O(n log n), also for texts of one word repeated. A level takes four bytes a word of the texts that are worked
on together (CHUNK words, or one longer text).

Documents never meet: no shuffle. A null or empty text and one without words has 0 words and no run. Rows
with the same or no doc_id are rows of their own. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of texts that are worked on together.
CHUNK = 1 << 18
LEAST, TIMES = 24, 3
RUN = "struct<start:bigint,length:bigint,period:bigint>"
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def _lookup(level: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the blocks at a and b have the same name."""
    x = level[a]
    return (x > 0) & (x == level[b])


def _stretches(named: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of at least `least` consecutive positions in the sorted array `named`."""
    if not len(named):
        return named, named
    cuts = np.flatnonzero(np.diff(named) != 1)
    first, last = named[np.concatenate([[0], cuts + 1])], named[np.concatenate([cuts, [len(named) - 1]])]
    long = last - first + 1 >= least
    return first[long], last[long]


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All positions of the stretches."""
    size = last - first + 1
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _grid(lo: np.ndarray, hi: np.ndarray, w: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of about CHUNK rows (series, point, period): of each stretch [lo, hi) and period of [w, 2w) that fits it
    `times` times, the points of its grid that have two periods after them. A series is one stretch and period."""
    at_once = max(1, CHUNK * w // int((hi - lo).sum()))
    for q0 in range(w, 2 * w, at_once):
        q, of = np.nonzero(np.arange(q0, min(q0 + at_once, 2 * w))[:, None] * times <= hi - lo)
        if not len(q):
            return
        q += q0
        n = (hi - lo)[of] // q - 1
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(np.arange(len(q)), n), np.repeat(lo[of], n) + np.repeat(q, n) * k, np.repeat(q, n)


def find(first: np.ndarray, end: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and period of all runs of at least `least` words and `times` periods, by start and period.

    first[i] is the first place of word i in its document, end[i] the end of that document.
    """
    if times < 3:
        raise ValueError("a run must cover three points of a grid: times is 3 at least")
    total, none = len(first), np.zeros(0, np.int64)
    starts, ends, periods = [none], [none], [none]
    levels, w = [], 1
    if total:
        named = np.flatnonzero(np.bincount(first, minlength=total)[first] > 1)
        level = np.zeros(total + 1, np.int32)
        level[named] = first[named] + 1
    while total:
        # a run of period q >= w has all but its last w - 1 words named
        lo, last = _stretches(named, max(least, times * w) - w + 1)
        if not len(lo):
            break
        levels.append(level)
        for series, g, q in _grid(lo, last + w, w, times):
            hit = np.flatnonzero(_lookup(level, g, g + q))
            hit = hit[_lookup(level, g[hit] + q[hit] - w, g[hit] + 2 * q[hit] - w)]
            if not len(hit):
                continue
            new = (np.diff(hit) != 1) | (np.diff(series[hit]) != 0)
            head, tail = hit[np.concatenate([[True], new])], hit[np.concatenate([new, [True]])]
            period = q[head]
            a, b = g[head].copy(), g[tail] + period
            for k in range(len(levels) - 1, -1, -1):
                s, names = 1 << k, levels[k]
                x = a - s
                a = np.where((x >= 0) & _lookup(names, x, x + period), x, a)
                b = np.where((b + period + s <= total) & _lookup(names, b, np.minimum(b + period, total)), b + s, b)
            b += period
            long = b - a >= np.maximum(least, times * period)
            starts.append(a[long])
            ends.append(b[long])
            periods.append(period[long])
        # names of the next level, where both halves have one
        at = _spread(lo, last)
        at = at[at + 2 * w <= end[at]]
        at = at[level[at + w] > 0]
        pair = level[at].astype(np.int64) << 32 | level[at + w]
        order = np.argsort(pair, kind="stable")
        head = np.concatenate([[True], np.diff(pair[order]) != 0]) if len(at) else np.zeros(0, bool)
        group = np.cumsum(head) - 1
        often = np.bincount(group)[group] > 1 if len(at) else head
        level = np.zeros(total + 1, np.int32)
        level[at[order][often]] = at[order][head][group][often] + 1
        named = np.flatnonzero(level)
        w *= 2
    start, stop, period = map(np.concatenate, (starts, ends, periods))
    # a multiple of a run's period gives the same stretch again
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    own = np.concatenate([[True], (np.diff(start) != 0) | (np.diff(stop) != 0)])[: len(start)]
    start, stop, period = start[own], stop[own], period[own]
    order = np.lexsort((period, start))
    return start[order], (stop - start)[order], period[order]


def _chunks(batches: Iterator[pa.RecordBatch], rewrite: Rewrite | None) -> Iterator[tuple[list, list[list[bytes]]]]:
    """ids and words of about CHUNK words of texts."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = text.as_py().encode().split() if text.is_valid else []
            ids.append(key)
            texts.append(rewrite(key, words) if rewrite else words)
            size += len(words)
            if size >= CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start and period; places are numbers of words) and collapsed (the text's words, one
    space between them, without those that a run holds after its first period).

    rewrite(doc_id, words) may give other words to work on.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("collapsed", pa.large_string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches, rewrite):
            n = np.array([len(t) for t in texts])
            base = np.cumsum(n) - n
            place: list[int] = []
            for words, lo in zip(texts, base.tolist()):
                place.extend(map({}.setdefault, words, range(lo, lo + len(words))))
            start, length, period = find(np.array(place, np.int64), np.repeat(base + n, n), least, times)
            drop = np.zeros(len(place) + 1, np.int64)
            np.add.at(drop, start + period, 1)
            np.add.at(drop, start + length, -1)
            kept = np.cumsum(drop)[:-1] == 0
            of = np.searchsorted(start, np.concatenate([base, [len(place)]]))
            collapsed = [b" ".join(words if i == j else compress(words, kept[lo : lo + len(words)].tolist())).decode() for words, lo, i, j in zip(texts, base, of[:-1], of[1:])]
            start = start - np.repeat(base, np.diff(of))
            found = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), found, pa.array(collapsed, pa.large_string())], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, f"doc_id bigint, n_words bigint, runs array<{RUN}>, collapsed string")


def strongest(found: Column) -> Column:
    """The run with the most periods; ties to the first in the array. Null where there is none."""

    def better(best: Column, x: Column) -> Column:
        return F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)

    return F.aggregate(found, F.lit(None).cast(RUN), better)


def plant(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document by the hash of its id becomes periodic from a place on, with 3 to 10 periods or a little more."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run and digests of all runs and of the collapsed text; see plant()."""
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = F.col("best")
    return (
        runs(docs, rewrite=plant)
        .withColumn("best", strongest(F.col("runs")))
        .select(
            "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
            F.floor(1000 * best["length"] / best["period"]).cast("bigint").alias("exponent_milli"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )

"""Recurrent state of ledgers: keyed running moments, global prefixes, exponential averages, sketches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.scalar import safe_ratio, weighted_std
from tideline.operators.order import ORDER, keyed, running
from tideline.plans.shared import cut, partitions

#: Half-lives in seconds.
HALF_LIVES = (300, 3600, 21_600, 86_400, 604_800)


def _parts() -> dict[str, Column]:
    """What is summed along a key."""
    n = F.col("notional_usd")
    return {
        "notional": n, "size": F.col("size"), "signed": n * F.col("direction"), "buy": F.when(F.col("side") == "BUY", n).otherwise(0.0), "o0": F.when(F.col("outcome_index") == 0, n).otherwise(0.0),
        "pn": F.col("p0") * n, "ppn": F.col("p0") * F.col("p0") * n, "nn": n * n,
    }


def _moments(df: DataFrame, prefix: str, state: dict[str, Column]) -> DataFrame:
    """The measures of a state: count, sums, flow and side imbalances, price moments, concentration, velocity."""
    df = df.withColumns({f"_{k}": v for k, v in state.items()})
    c = {k: F.col(f"_{k}") for k in state}
    out = {
        "count": c["count"], "notional": c["notional"], "size": c["size"], "flow": safe_ratio(c["signed"], c["notional"]), "side": safe_ratio(2 * c["buy"] - c["notional"], c["notional"]),
        "outcome": safe_ratio(2 * c["o0"] - c["notional"], c["notional"]), "mean": safe_ratio(c["pn"], c["notional"]), "std": weighted_std(c["pn"], c["ppn"], c["notional"]), "min": c["min_p"], "max": c["max_p"],
        "gap": c["gap"], "age": c["age"], "hhi": safe_ratio(c["nn"], c["notional"] * c["notional"]), "velocity": c["notional"] * 86400 / F.greatest(c["age"], F.lit(1)),
    }
    return df.withColumns({f"{prefix}_{k}": v for k, v in out.items()}).drop(*(f"_{k}" for k in state))


def running_moments(df: DataFrame, key: str, prefix: str, order: list[str] = ORDER) -> DataFrame:
    """State of the key after each trade. Wants p0, notional_usd, size, direction, side, outcome_index; reads
    all sums in one window pass. A key is one task's work: see split_moments for hot keys."""
    w, ts = running(key, order=order), F.col("timestamp_unix")
    state = {k: F.sum(v).over(w) for k, v in _parts().items()}
    state |= {"count": F.count("*").over(w), "min_p": F.min("p0").over(w), "max_p": F.max("p0").over(w), "age": ts - F.first(ts).over(w), "gap": F.coalesce(ts - F.lag(ts).over(keyed(key, order=order)), F.lit(0))}
    return _moments(df, prefix, state)


def split_moments(df: DataFrame, key: str, prefix: str, bucket: Column, order: list[str] = ORDER) -> DataFrame:
    """As running_moments, in two levels: inside (key, bucket), plus the key's totals of the buckets before.

    `bucket` must not decrease along the order (the day). So a hot key is as many tasks as it has buckets,
    and only one row per key and bucket meets in the second level.
    """
    ts, parts = F.col("timestamp_unix"), _parts()
    df = df.withColumn("_b", bucket)
    total = df.groupBy(key, "_b").agg(F.count("*").alias("_n"), F.min("p0").alias("_lo"), F.max("p0").alias("_hi"), F.min(ts).alias("_t0"), F.max(ts).alias("_t1"), *(F.sum(v).alias(f"_s_{k}") for k, v in parts.items()))
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    total = total.select(
        F.col(key).alias("_k"), F.col("_b").alias("_bb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.min("_lo").over(before).alias("_lo"), F.max("_hi").over(before).alias("_hi"),
        F.min("_t0").over(before).alias("_t0"), F.max("_t1").over(before).alias("_t1"), *(F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0.0)).alias(f"_s_{k}") for k in parts),
    )
    one = W.partitionBy(key, "_b").orderBy(*order)
    w = one.rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = {f"_i_{k}": F.sum(v).over(w) for k, v in parts.items()}
    inner |= {"_i_n": F.count("*").over(w), "_i_lo": F.min("p0").over(w), "_i_hi": F.max("p0").over(w), "_i_t0": F.first(ts).over(w), "_i_prev": F.lag(ts).over(one)}
    df = df.withColumns(inner).join(total, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_bb")))
    state = {k: F.col(f"_i_{k}") + F.col(f"_s_{k}") for k in parts}
    state |= {
        "count": F.col("_i_n") + F.col("_n"), "min_p": F.least("_i_lo", "_lo"), "max_p": F.greatest("_i_hi", "_hi"), "age": ts - F.least("_i_t0", "_t0"),
        "gap": F.coalesce(ts - F.coalesce("_i_prev", "_t1"), F.lit(0)),
    }
    # all columns of the state are read before the helpers of both levels go
    out = _moments(df, prefix, state)
    return out.drop("_b", "_k", "_bb", "_n", "_lo", "_hi", "_t0", "_t1", *(f"_s_{k}" for k in parts), *inner)


def global_prefix(df: DataFrame, bucket: Column, sums: dict[str, Column], order: list[str] = ORDER) -> DataFrame:
    """Running sums over the whole ledger in two levels: inside buckets, plus the totals of buckets before.

    `bucket` must not decrease along the order (the day). Only the bucket totals meet in one task.
    """
    df = df.withColumn("_b", bucket)
    totals = df.groupBy("_b").agg(*(F.sum(v).alias(f"_t_{k}") for k, v in sums.items()))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    shift = totals.select("_b", *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in sums))
    inner = W.partitionBy("_b").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.withColumns({k: F.sum(v).over(inner) for k, v in sums.items()}).join(shift, "_b")
    return df.withColumns({k: F.col(k) + F.col(f"_s_{k}") for k in sums}).drop("_b", *(f"_s_{k}" for k in sums))


def keyed_prefix(df: DataFrame, key: str, bucket: Column, sums: dict[str, Column], order: list[str] = ORDER) -> DataFrame:
    """Running sums of each key in two levels, as global_prefix: a hot key is as many tasks as it has buckets."""
    df = df.withColumn("_b", bucket)
    totals = df.groupBy(key, "_b").agg(*(F.sum(v).alias(f"_t_{k}") for k, v in sums.items()))
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    shift = totals.select(F.col(key).alias("_k"), F.col("_b").alias("_bb"), *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in sums))
    inner = W.partitionBy(key, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.withColumns({k: F.sum(v).over(inner) for k, v in sums.items()}).join(shift, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_bb")))
    return df.withColumns({k: F.col(k) + F.col(f"_s_{k}") for k in sums}).drop("_b", "_k", "_bb", *(f"_s_{k}" for k in sums))


def keyed_lag(df: DataFrame, key: str, bucket: Column, value: str, name: str, order: list[str] = ORDER) -> DataFrame:
    """The value of the key's row before, in two levels."""
    df = df.withColumn("_b", bucket)
    ends = df.groupBy(key, "_b").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    before = W.partitionBy(key).orderBy("_b")
    ends = ends.select(F.col(key).alias("_k"), F.col("_b").alias("_bb"), F.lag("_end").over(before).alias("_end"), F.row_number().over(before).alias("_nb"))
    one = W.partitionBy(key, "_b").orderBy(*order)
    df = df.withColumns({"_in": F.lag(value).over(one), "_at": F.row_number().over(one)}).join(ends, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_bb")))
    return df.withColumn(name, F.when(F.col("_at") > 1, F.col("_in")).otherwise(F.col("_end"))).drop("_b", "_k", "_bb", "_end", "_nb", "_in", "_at")


def _ema_scan(t: np.ndarray, x: np.ndarray, half_life: float, start: float | None = None, last: int | None = None) -> np.ndarray:
    """s[i] = d s[i-1] + (1 - d) x[i] with d = 2 ** (-dt / half_life); s[0] = x[0] unless there is a start.

    Blocks small enough for 2 ** (t / half_life) are summed in closed form, so this is vectorised.
    """
    n = len(t)
    out = np.empty(n)
    s, at = (start, last) if start is not None else (x[0], t[0])
    limit = half_life * 40  # 2 ** 40 keeps 12 digits
    i = 0
    while i < n:
        j = int(np.searchsorted(t, at + limit, side="right"))
        if j <= i:  # a gap longer than the limit: one step
            d = 2.0 ** (-(t[i] - at) / half_life)
            s = d * s + (1 - d) * x[i]
            out[i], at, i = s, t[i], i + 1
            continue
        grow = np.exp2((t[i:j] - at) / half_life)
        steps = np.diff(np.concatenate([[1.0], grow]))
        out[i:j] = (s + np.cumsum(steps * x[i:j])) / grow
        s, at, i = out[j - 1], t[j - 1], j
    return out


def keyed_ema(df: DataFrame, key: str, values: list[str], half_lives: tuple[int, ...] = HALF_LIVES, order: list[str] = ORDER, keep: str = "trade_id") -> DataFrame:
    """keep and ema_<value>_<half-life> after each row of the key.

    Keys are walked as a stream of sorted batches with one number per average carried on: many small keys
    cost no groups, and a large one no memory. For keys that hold much of a ledger see chunked_ema.
    """
    pairs = [(v, h) for v in values for h in half_lives]
    names = [f"ema_{v}_{h}" for v, h in pairs]
    rows = df.select(F.col(key).cast("string").alias("_k"), *dict.fromkeys([*order, keep, *values]))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_key, state, last = (), [], 0
        for pdf in batches:
            keys, t = pdf["_k"].to_numpy(object), pdf[order[0]].to_numpy(np.int64)
            x = {v: pdf[v].to_numpy(float) for v in values}
            out = {name: np.empty(len(pdf)) for name in names}
            ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for lo, hi in zip([0, *ends], [*ends, len(pdf)]):
                if lo == hi:
                    continue
                if at_key != (keys[lo],):
                    at_key, state = (keys[lo],), [None] * len(pairs)
                for i, ((v, h), name) in enumerate(zip(pairs, names)):
                    out[name][lo:hi] = _ema_scan(t[lo:hi], x[v][lo:hi], h, state[i], last)
                    state[i] = out[name][hi - 1]
                last = int(t[hi - 1])
            yield pd.DataFrame({keep: pdf[keep], **out})

    ordered = rows.repartition(partitions(df.sparkSession), "_k").sortWithinPartitions("_k", *order)
    return ordered.mapInPandas(walk, f"{keep} {df.schema[keep].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names))


def chunked_ema(df: DataFrame, key: str, values: list[str], half_lives: tuple[int, ...] = HALF_LIVES, order: list[str] = ORDER, keep: str = "trade_id", chunk: Column | None = None) -> DataFrame:
    """As keyed_ema, for keys that are too large for a task.

    Rows of a key are scanned in chunks (days by default), so a hot key is many tasks: each chunk reduces to
    one affine step per half-life, the steps are composed along the (few) chunks of a key, and chunks are
    expanded from their starting state.
    """
    chunk = F.floor(F.col(order[0]) / 86400) if chunk is None else chunk
    pairs = [(v, h) for v in values for h in half_lives]
    names = [f"ema_{v}_{h}" for v, h in pairs]
    rows = df.select(F.col(key).alias("k"), chunk.cast("bigint").alias("c"), *order, *(v for v in values if v not in order), *([keep] if keep not in order else []))
    schema = "k " + df.schema[key].dataType.simpleString() + ", c bigint, t0 bigint, t1 bigint, " + ", ".join(f"a{i} double, f{i} double" for i in range(len(pairs)))

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        t = pdf[order[0]].to_numpy(np.int64)
        row = {"k": pdf["k"].iloc[0], "c": int(pdf["c"].iloc[0]), "t0": int(t[0]), "t1": int(t[-1])}
        for i, (v, h) in enumerate(pairs):
            x = pdf[v].to_numpy(float)
            row[f"a{i}"] = _ema_scan(t, x, h, 0.0, int(t[0]))[-1]  # the chunk's effect on a state of 0 at its first time
            row[f"f{i}"] = x[0]
        return pd.DataFrame([row])

    parts = rows.groupBy("k", "c").applyInPandas(summarise, schema)
    lives = np.array([h for _, h in pairs], float)

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The state before each chunk of a key: one step a chunk, carried on from batch to batch."""
        now, state, before = (), None, None
        for pdf in batches:
            effect, first = pdf[[f"a{i}" for i in range(len(pairs))]].to_numpy(), pdf[[f"f{i}" for i in range(len(pairs))]].to_numpy()
            starts, befores = np.full((len(pdf), len(pairs)), np.nan), []
            for n, (k, t0, t1) in enumerate(zip(pdf["k"].tolist(), pdf["t0"].tolist(), pdf["t1"].tolist())):
                if now != (k,):
                    now, state, before = (k,), None, None
                befores.append(before)
                if state is not None:
                    starts[n] = state
                # the gap before the chunk acts on its first value; a key starts at its own first value
                d0 = 1.0 if state is None else np.exp2(-(t0 - before) / lives)
                state = np.exp2(-(t1 - t0) / lives) * (d0 * (first[n] if state is None else state) + (1 - d0) * first[n]) + effect[n]
                before = t1
            yield pd.DataFrame({"k": pdf["k"], "c": pdf["c"], "before": pd.array(befores, "Int64"), **{f"s{i}": starts[:, i] for i in range(len(pairs))}})

    dealt = parts.repartition(partitions(df.sparkSession), "k").sortWithinPartitions("k", "c")
    starts = dealt.mapInPandas(compose, "k " + df.schema[key].dataType.simpleString() + ", c bigint, before bigint, " + ", ".join(f"s{i} double" for i in range(len(pairs))))
    keep_type = df.schema[keep].dataType.simpleString()

    def expand(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(order, kind="stable")
        t, r = left[order[0]].to_numpy(np.int64), right.iloc[0]
        out = {keep: left[keep].to_numpy()}
        for i, ((v, h), name) in enumerate(zip(pairs, names)):
            fresh = pd.isna(r[f"s{i}"])
            out[name] = _ema_scan(t, left[v].to_numpy(float), h, None if fresh else float(r[f"s{i}"]), None if fresh else int(r["before"]))
        return pd.DataFrame(out)

    return rows.groupBy("k", "c").cogroup(starts.groupBy("k", "c")).applyInPandas(expand, f"{keep} {keep_type}, " + ", ".join(f"{n} double" for n in names))


def running_distinct(df: DataFrame, key: str, item: str, name: str, order: list[str] = ORDER) -> DataFrame:
    """Exact number of distinct items of the key so far: a running sum of first occurrences."""
    first = F.when(F.row_number().over(keyed(key, item, order=order)) == 1, 1).otherwise(0)
    return df.withColumn("_first", first).withColumn(name, F.sum("_first").over(running(key, order=order))).drop("_first")


# --- sketches -----------------------------------------------------------------------------------

#: Register bits, and the constant of the estimate.
REGISTER_BITS, ALPHA = 6, 0.709
REGISTERS = 1 << REGISTER_BITS


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 of unsigned 64-bit numbers (fixed constants of that generator)."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _register_rank(x: pd.Series) -> pd.DataFrame:
    """Register (low bits of the mixed number) and rank (leading zeros of the rest, plus 1)."""
    h = mix64(x.to_numpy(np.int64).view(np.uint64))
    rest = h >> np.uint64(REGISTER_BITS)
    length = np.zeros(len(h), np.int32)
    for bit in (32, 16, 8, 4, 2, 1):  # position of the highest set bit
        high = rest >> np.uint64(bit)
        up = high > 0
        length += np.where(up, bit, 0).astype(np.int32)
        rest = np.where(up, high, rest)
    length += (rest > 0).astype(np.int32)
    return pd.DataFrame({"register": (h & np.uint64(REGISTERS - 1)).astype(np.int32), "rank": 64 - REGISTER_BITS - length + 1})


def register_rank(x: Column) -> Column:
    return F.pandas_udf(_register_rank, "struct<register:int,rank:int>")(x)


def fold_of(x: Column | str, seed: int, folds: int) -> Column:
    """Deterministic fold of an id: its mixed sum with the seed, modulo folds."""

    @F.pandas_udf("bigint")
    def fold(x: pd.Series) -> pd.Series:
        return pd.Series((mix64(x.to_numpy(np.int64).view(np.uint64) + np.uint64(seed)) % np.uint64(folds)).astype(np.int64))

    return fold(x)


def estimate(inverse_sum: Column, zeros: Column) -> Column:
    """Cardinality from the sum of 2 ** -rank over all registers and the number of empty ones."""
    m = float(REGISTERS)
    raw = ALPHA * m * m / inverse_sum
    return F.when((zeros > 0) & (raw <= 2.5 * m), m * F.ln(m / F.greatest(zeros, F.lit(1)))).otherwise(raw)


def sketch_distinct(df: DataFrame, key: str, item: str) -> DataFrame:
    """key, estimate: mergeable sketch per key; only (key, register) maxima are shuffled."""
    r = df.select(key, register_rank(F.col(item).cast("bigint")).alias("r")).groupBy(key, "r.register").agg(F.max("r.rank").alias("rank"))
    by = r.groupBy(key).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count("*").alias("n"))
    return by.select(key, estimate(F.col("s") + (REGISTERS - F.col("n")), REGISTERS - F.col("n")).alias("estimate"))


def running_sketch(df: DataFrame, key: str, item: str, name: str, order: list[str] = ORDER, bucket: Column | None = None) -> DataFrame:
    """The sketch's estimate after each row: only rows that raise a register change it, by a difference.

    With a bucket (as in split_moments) a hot key is as many tasks as it has buckets.
    """
    df = df.withColumn("_r", register_rank(F.col(item).cast("bigint")))
    df = df.withColumn("_reg", F.col("_r.register")).withColumn("_rank", F.col("_r.rank")).drop("_r")
    if bucket is None:
        before = W.partitionBy(key, "_reg").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        df = df.withColumn("_old", F.coalesce(F.max("_rank").over(before), F.lit(0)))
    else:
        df = df.withColumn("_b", bucket)
        over = W.partitionBy(key, "_reg").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
        tops = df.groupBy(key, "_reg", "_b").agg(F.max("_rank").alias("_top"))
        tops = tops.select(F.col(key).alias("_k"), F.col("_reg").alias("_kr"), F.col("_b").alias("_bb"), F.max("_top").over(over).alias("_top"))
        inner = W.partitionBy(key, "_reg", "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        df = df.withColumn("_in", F.max("_rank").over(inner)).join(tops, (F.col(key) == F.col("_k")) & (F.col("_reg") == F.col("_kr")) & (F.col("_b") == F.col("_bb")))
        df = df.withColumn("_old", F.coalesce(F.greatest("_in", "_top"), F.lit(0))).drop("_b", "_k", "_kr", "_bb", "_top", "_in")
    up = F.col("_rank") > F.col("_old")
    df = df.withColumn("_ds", F.when(up, F.pow(F.lit(2.0), -F.col("_rank")) - F.pow(F.lit(2.0), -F.col("_old"))).otherwise(0.0))
    df = df.withColumn("_dz", F.when(up & (F.col("_old") == 0), -1).otherwise(0))
    if bucket is None:
        w = running(key, order=order)
        df = df.withColumns({"_us": F.sum("_ds").over(w), "_uz": F.sum("_dz").over(w)})
    else:
        df = keyed_prefix(cut(df, "sketch"), key, bucket, {"_us": F.col("_ds"), "_uz": F.col("_dz")}, order)
    return df.withColumn(name, estimate(REGISTERS + F.col("_us"), REGISTERS + F.col("_uz"))).drop("_reg", "_rank", "_old", "_ds", "_dz", "_us", "_uz")

"""Evaluation of predictions and positions: losses, calibration, tails, weights, drawdowns, bootstraps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.scalar import log_loss
from tideline.plans.shared import cut


def binary_metrics(df: DataFrame, p: str, y: str, *keys: str, bins: int = 20, eps: float = 1e-9) -> DataFrame:
    """n, log_loss, brier, accuracy and ece per key; p = 1 is in no calibration bin."""
    df = df.withColumn("_bin", F.when(F.col(p) < 1, F.floor(F.col(p) * bins)))
    by = df.groupBy(*keys, "_bin").agg(
        F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(F.col(y).cast("double")).alias("sy"), F.sum(log_loss(p, y, eps)).alias("ll"),
        F.sum((F.col(p) - F.col(y)) ** 2).alias("br"), F.count_if((F.col(p) >= 0.5) == (F.col(y) == 1)).alias("ok"),
    )
    off = F.when(F.col("_bin").isNotNull(), F.abs(F.col("sp") - F.col("sy"))).otherwise(0.0)
    n = F.sum("n")
    return by.groupBy(*keys).agg(n.alias("n"), (F.sum("ll") / n).alias("log_loss"), (F.sum("br") / n).alias("brier"), (F.sum("ok") / n).alias("accuracy"), (F.sum(off) / n).alias("ece"))


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(x * w) / F.sum(w)


def group_tail(df: DataFrame, group: str, value: Column, weight: Column, share: float, *keys: str) -> DataFrame:
    """Mean of the worst ceil(share * groups) weighted group means, per key."""
    return worst_share(df.groupBy(*keys, group).agg(weighted_mean(value, weight).alias("m")), "m", share, *keys)


def worst_share(groups: DataFrame, value: str, share: float, *keys: str, margin: float = 0.01) -> DataFrame:
    """keys, tail, groups: mean and number of the lowest ceil(share * groups) values of groups(keys, value), a row per group.

    Approximate quantiles bracket a key's limit: values below count by their sum, those above are left out, and only
    the few between are walked in order, equal ones as one. Where the bracket misses a limit, all values are walked, so
    the result is exact.
    """
    m = cut(groups.select(*keys, F.col(value).alias("_m")), "groups")
    ends = F.array(F.lit(max(share - margin, 0.0)), F.lit(min(share + margin, 1.0)))
    bounds = m.groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys)).agg(F.ceil(F.count("*") * share).alias("_limit"), F.percentile_approx("_m", ends, 1000).alias("_q"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    x, low, high = F.col("_m"), F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    part = F.when(x.isNull(), 0).when(F.lit(margin >= 1), 2).when(x < low, 1).when(x <= high, 2).otherwise(3)
    placed = m.join(bounds if keys else F.broadcast(bounds), on).withColumn("_part", part)
    steps = placed.groupBy(*keys, "_limit", "_part", F.when(F.col("_part") == 2, x).alias("_v")).agg(F.count("*").alias("_c"), F.sum("_m").alias("_s"))
    before = F.sum("_c").over(W.partitionBy(*keys).orderBy("_part", "_v").rowsBetween(W.unboundedPreceding, -1))
    steps = cut(steps.withColumn("_take", F.least("_c", F.col("_limit") - F.coalesce(before, F.lit(0)))).where("_take > 0"), "steps")
    if margin < 1 and steps.where("_part = 3 or (_part = 1 and _take < _c)").limit(1).collect():
        return worst_share(groups, value, share, *keys, margin=1.0)
    total = F.sum(F.when(F.col("_part") == 2, F.col("_v") * F.col("_take")).otherwise(F.col("_s")))
    return steps.groupBy(*keys).agg(F.try_divide(total, F.sum(F.when(F.col("_part") > 0, F.col("_take")))).alias("tail"), F.coalesce(F.sum("_take"), F.lit(0)).alias("groups"))


def inverse_root_weights(df: DataFrame, key: str) -> DataFrame:
    """key, weight: 1 / sqrt(rows of the key), scaled so that the mean over rows is 1."""
    c = df.groupBy(key).agg(F.count("*").alias("c"))
    all_ = W.partitionBy()  # one row per key
    scale = F.sum("c").over(all_) / F.sum(F.sqrt("c")).over(all_)
    return c.select(key, (scale / F.sqrt("c")).alias("weight"))


def equal_weights(df: DataFrame, part: str, key: str) -> DataFrame:
    """part, key, weight: rows of the part / keys of the part / rows of the key."""
    c = df.groupBy(part, key).agg(F.count("*").alias("c"))
    w = W.partitionBy(part)
    return c.select(part, key, (F.sum("c").over(w) / F.count("*").over(w) / F.col("c")).alias("weight"))


def downside_multipliers(weekly: DataFrame, most: float) -> DataFrame:
    """week, multiplier: 1 + (most - 1) * loss / largest loss, renormalised to keep the total weight.

    weekly(week, pnl, weight): one row per week.
    """
    all_ = W.partitionBy()
    worst = F.max(F.greatest(-F.col("pnl"), F.lit(0.0))).over(all_)
    raw = F.when(worst > 0, 1 + (most - 1) * F.greatest(-F.col("pnl"), F.lit(0.0)) / worst).otherwise(1.0)
    df = weekly.withColumn("_raw", raw)
    return df.select("week", (F.col("_raw") * F.sum("weight").over(all_) / F.sum(F.col("_raw") * F.col("weight")).over(all_)).alias("multiplier"))


def weekly_pnl(daily: DataFrame, initial: float) -> DataFrame:
    """week, pnl: last equity of each week minus the last of the week before; daily(week, day, equity)."""
    w = daily.groupBy("week").agg(F.max_by("equity", "day").alias("e"))
    return w.select("week", (F.col("e") - F.coalesce(F.lag("e").over(W.orderBy("week")), F.lit(initial))).alias("pnl"))


def drawdown(df: DataFrame, key: str, ts: list[str], equity: str) -> DataFrame:
    """key, peak, max_drawdown (share of the running peak)."""
    w = W.partitionBy(key).orderBy(*ts).rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.withColumn("_p", F.max(equity).over(w))
    return df.groupBy(key).agg(F.max("_p").alias("peak"), F.max(F.when(F.col("_p") > 0, (F.col("_p") - F.col(equity)) / F.col("_p")).otherwise(0.0)).alias("max_drawdown"))


def histogram_quantiles(df: DataFrame, columns: list[str], quantiles: Sequence[float], bins: int = 4096) -> DataFrame:
    """feature, low, high and q_<n>: quantiles from a fixed-width histogram between minimum and maximum.

    A value falls in bin floor((x - low) / (high - low) * (bins - 1)); a quantile is the middle of the first
    bin at which the cumulative count reaches ceil(q * n).
    """
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns)))).where("x is not null")
    ends = long.groupBy("feature").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))
    x = long.join(F.broadcast(ends), "feature")  # one row per column
    span = F.col("high") - F.col("low")
    cell = F.when(span > 0, F.floor((F.col("x") - F.col("low")) / span * (bins - 1))).otherwise(0)
    h = x.groupBy("feature", "low", "high", "n", cell.alias("b")).agg(F.count("*").alias("c"))
    h = h.withColumn("cum", F.sum("c").over(W.partitionBy("feature").orderBy("b")))
    middle = F.col("low") + (F.col("b") + 0.5) / bins * span
    aggs = [F.min(F.when(F.col("cum") >= F.ceil(F.lit(q) * F.col("n")), middle)).alias(f"q_{i}") for i, q in enumerate(quantiles)]
    return h.groupBy("feature", "low", "high").agg(*aggs)


def moving_block_bootstrap(values: Sequence[float], replicates: int = 5000, block: int = 4, seed: int = 17) -> np.ndarray:
    """Sorted means of circular moving-block resamples of a short series."""
    x, rng = np.asarray(values, float), np.random.default_rng(seed)
    n = len(x)
    starts = rng.integers(0, n, (replicates, -(-n // block)))
    at = (starts[:, :, None] + np.arange(block)).reshape(replicates, -1)[:, :n] % n
    return np.sort(x[at].mean(1))


def group_bootstrap(df: DataFrame, group: str, numerator: Column, denominator: Column, replicates: int = 200, seed: int = 17) -> DataFrame:
    """replicate, ratio: sum / sum over groups drawn with replacement, by Poisson weights of a hash.

    Every group draws its own weight per replicate, so nothing is collected and replicates are independent
    of partitioning.
    """
    g = df.groupBy(group).agg(F.sum(numerator).alias("a"), F.sum(denominator).alias("b"))
    g = g.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(group), F.col("replicate")), 11).cast("double") / float(1 << 53)
    weight, below, term = F.lit(0), 0.0, float(np.exp(-1))
    for k in range(1, 9):  # the Poisson(1) distribution's inverse, to 1e-6
        below += term
        term /= k
        weight = weight + F.when(u >= below, 1).otherwise(0)
    return g.groupBy("replicate").agg((F.sum(F.col("a") * weight) / F.sum(F.col("b") * weight)).alias("ratio"))


def ridge(df: DataFrame, x: list[str], y: str, w: str, penalty: float) -> np.ndarray:
    """Weighted ridge on standardised predictors with a free intercept: [intercept, slopes] on the original scale.

    One aggregate gives all moments; only a matrix of the number of predictors reaches the driver.
    """
    names, cols = ["one", *x, y], [F.lit(1.0), *(F.col(c).cast("double") for c in x), F.col(y).cast("double")]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*(F.sum(F.col(w) * cols[i] * cols[j]).alias(f"m_{i}_{j}") for i, j in pairs)).first()
    m = np.zeros((len(names), len(names)))
    for i, j in pairs:
        m[i, j] = m[j, i] = row[f"m_{i}_{j}"] or 0.0
    total = m[0, 0]
    mean = m[0, 1:-1] / total
    cov = m[1:-1, 1:-1] / total - np.outer(mean, mean)
    scale = np.maximum(np.sqrt(np.diag(cov)), 1e-12)
    target = m[1:-1, -1] / total - mean * m[0, -1] / total
    slopes = np.linalg.solve(cov / np.outer(scale, scale) + penalty / total * np.eye(len(x)), target / scale) / scale
    return np.concatenate([[m[0, -1] / total - slopes @ mean], slopes])


def platt(df: DataFrame, logit: str, y: str, steps: int = 25, tolerance: float = 1e-10) -> tuple[float, float]:
    """slope and intercept of the logistic calibration by Newton steps; each step is one aggregate."""
    a, b = 1.0, 0.0
    z = F.col(logit).cast("double")
    for _ in range(steps):
        p = 1 / (1 + F.exp(-(z * a + b)))
        r, v = p - F.col(y), p * (1 - p)
        s = df.agg(F.sum(r * z), F.sum(r), F.sum(v * z * z), F.sum(v * z), F.sum(v)).first()
        step = np.linalg.solve(np.array([[s[2], s[3]], [s[3], s[4]]]) + 1e-9 * np.eye(2), np.array([s[0], s[1]]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < tolerance:
            break
    return float(a), float(b)

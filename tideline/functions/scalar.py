"""Column functions: orientation, ratios, buckets, policies, losses, identifiers and codecs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a week, and the first Monday after the epoch.
WEEK, MONDAY = 604_800, 345_600


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp(x: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, or 0 unless b is positive."""
    return F.when(col(b) > 0, col(a) / col(b)).otherwise(0.0)


def weighted_std(sum_x: Column | str, sum_xx: Column | str, weight: Column | str) -> Column:
    mean = col(sum_x) / col(weight)
    return F.when(col(weight) > 0, F.sqrt(F.greatest(col(sum_xx) / col(weight) - mean * mean, F.lit(0.0)))).otherwise(0.0)


def bounded_fraction(a: Column | str, b: Column | str) -> Column:
    return F.when(col(b) > 0, clamp(col(a) / col(b), 0.0, 1.0)).otherwise(0.0)


def clipped_log(x: Column | str, k: float) -> Column:
    return clamp(F.log1p(col(x)) / k, 0.0, 1.0)


def sigmoid(x: Column | str, clip: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-clamp(x, -clip, clip)))


def logit(p: Column | str, eps: float = 1e-6) -> Column:
    c = clamp(p, eps, 1 - eps)
    return F.ln(c / (1 - c))


# --- trades -------------------------------------------------------------------------------------


def direction(side: Column | str = "side", outcome: Column | str = "outcome_index") -> Column:
    """+1 for buying outcome 0 or selling outcome 1, else -1."""
    return F.when((col(side) == "BUY") == (col(outcome) == 0), 1).otherwise(-1)


def probability0(price: Column | str = "price", outcome: Column | str = "outcome_index") -> Column:
    """The price, clamped to [0, 1], seen from outcome 0."""
    p = clamp(price, 0.0, 1.0)
    return F.when(col(outcome) == 0, p).otherwise(1 - p)


def yes_price(price: Column | str = "price", outcome: Column | str = "outcome_index") -> Column:
    """As probability0, but null unless 0 < price < 1 and the outcome is 0 or 1."""
    p, o = col(price), col(outcome)
    return F.when((p > 0) & (p < 1) & o.isin(0, 1), F.when(o == 0, p).otherwise(1 - p))


def yes_direction(side: Column | str = "side", outcome: Column | str = "outcome_index") -> Column:
    s = F.when(col(side) == "BUY", 1).when(col(side) == "SELL", -1)
    return s * F.when(col(outcome) == 0, 1).when(col(outcome) == 1, -1)


# --- time ---------------------------------------------------------------------------------------


def week_id(ts: Column | str) -> Column:
    """Monday 00:00 UTC of the week, in epoch seconds."""
    return (F.floor((col(ts) - MONDAY) / WEEK) * WEEK + MONDAY).cast("bigint")


def phase(ts: Column | str, period: int) -> tuple[Column, Column]:
    a = 2 * math.pi * (col(ts) % period) / period
    return F.sin(a), F.cos(a)


def lifecycle(ts: Column | str, created: Column | str, end: Column | str) -> tuple[Column, Column]:
    """Elapsed and remaining share of [created, end]; 0 and 0 where that is not an interval."""
    ok = (col(created) > 0) & (col(end) > col(created))
    span = col(end) - col(created)
    return (F.when(ok, clamp((col(x) - col(y)) / span, 0.0, 1.0)).otherwise(0.0) for x, y in ((ts, created), (end, ts)))


def parse_utc(text: Column | str) -> Column:
    """A timestamp with an explicit zone; null without one."""
    t = F.regexp_replace(col(text), r"([+-]\d\d)$", "$1:00")
    t = F.regexp_replace(t, r"([+-]\d\d)(\d\d)$", "$1:$2")
    return F.when(t.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(t))


def format_utc(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


# --- buckets and decisions ----------------------------------------------------------------------

#: Left-closed price bins by upper bound; the last is open.
PRICE_BINS = [(0.50, "below_0_50"), (0.70, "0_50_to_0_70"), (0.80, "0_70_to_0_80"), (0.90, "0_80_to_0_90"), (0.95, "0_90_to_0_95"), (0.98, "0_95_to_0_98")]
LAST_BIN = "at_least_0_98"


def price_bin(p: Column | str) -> Column:
    out = F.when(col(p) < PRICE_BINS[0][0], PRICE_BINS[0][1])
    for bound, name in PRICE_BINS[1:]:
        out = out.when(col(p) < bound, name)
    return out.otherwise(LAST_BIN)


def log_utility(size: Column | str, payout: Column | str, win: Column | str) -> Column:
    return F.ln(F.greatest(1 - col(size) + col(size) * col(payout) * col(win), F.lit(1e-8)))


def break_even(payout: Column | str) -> Column:
    return F.least(F.lit(1.0), 1 / F.greatest(col(payout), F.lit(1e-8)))


#: Limits of the threshold policy.
LIMITS = {"edge": 0.04, "confidence": 0.70, "depth": 250.0, "age": 15, "size": 0.01, "exit_edge": 0.01}


def decide(age: Column, depth: Column, confidence: Column, yes_edge: Column, no_edge: Column, held: Column, limits: dict[str, float] = LIMITS) -> Column:
    """Threshold policy as struct<action, size, reason>; held is the outcome held ('YES', 'NO') or null.

    The first rule that applies wins: age of the signal, depth, confidence, then what is held, then entry.
    """

    def verdict(action: str, size: float, reason: str) -> Column:
        return F.struct(F.lit(action).alias("action"), F.lit(float(size)).alias("size"), F.lit(reason).alias("reason"))

    active = F.when(held == "YES", yes_edge).otherwise(no_edge)
    return (
        F.when((age < 0) | (age > limits["age"]), verdict("SKIP", 0, "STALE_SIGNAL"))
        .when(depth < limits["depth"], verdict("SKIP", 0, "LOW_DEPTH"))
        .when(confidence < limits["confidence"], verdict("SKIP", 0, "LOW_CONFIDENCE"))
        .when(held.isNotNull() & (active < limits["exit_edge"]), verdict("CLOSE", 1, "EDGE_GONE"))
        .when(held.isNotNull(), verdict("HOLD", 0, "EDGE_REMAINS"))
        .when(yes_edge >= limits["edge"], verdict("BUY_YES", limits["size"], "YES_EDGE"))
        .when(no_edge >= limits["edge"], verdict("BUY_NO", limits["size"], "NO_EDGE"))
        .otherwise(verdict("SKIP", 0, "NO_NET_EDGE"))
    )


#: Label-free gates on a candidate's scores (mean, median q50, optimistic q90).
GATES = ["all", "mean_positive", "median_nonnegative", "optimistic_nonnegative", "mean_or_median", "mean_or_optimistic"]


def gate(name: str, mean: Column, q50: Column, q90: Column) -> Column:
    return {
        "all": F.lit(True),
        "mean_positive": mean > 0,
        "median_nonnegative": q50 >= 0,
        "optimistic_nonnegative": q90 >= 0,
        "mean_or_median": (mean > 0) | (q50 >= 0),
        "mean_or_optimistic": (mean > 0) | (q90 >= 0),
    }[name]


def gather(values: Column | str, index: Column | str) -> Column:
    """The element of an array at a 0-based index."""
    return F.get(col(values), col(index))


def top_margin(values: Column | str) -> Column:
    """Largest minus second largest of an array."""
    s = F.sort_array(col(values), asc=False)
    return F.get(s, F.lit(0)) - F.get(s, F.lit(1))


# --- losses -------------------------------------------------------------------------------------


def log_loss(p: Column | str, y: Column | str, eps: float = 1e-9) -> Column:
    c = clamp(p, eps, 1 - eps)
    return -(col(y) * F.ln(c) + (1 - col(y)) * F.ln(1 - c))


def huber(error: Column | str, beta: float = 1.0) -> Column:
    a = F.abs(col(error))
    return F.when(a < beta, 0.5 * a * a / beta).otherwise(a - 0.5 * beta)


def pinball(error: Column | str, quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)) -> Column:
    total = F.lit(0.0)
    for q in quantiles:
        total = total + F.greatest(q * col(error), (q - 1) * col(error))
    return total / len(quantiles)


def bce_with_logits(x: Column | str, y: Column | str) -> Column:
    return F.greatest(col(x), F.lit(0.0)) - col(x) * col(y) + F.log1p(F.exp(-F.abs(col(x))))


def softmax(values: list[Column]) -> list[Column]:
    top = F.greatest(*values)
    e = [F.exp(v - top) for v in values]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


def entropy(p: list[Column]) -> Column:
    terms = [-x * F.ln(F.greatest(x, F.lit(1e-12))) for x in p]
    return sum(terms[1:], terms[0])


# --- identifiers and codecs ---------------------------------------------------------------------


def stable_id(*parts: Column | str) -> Column:
    """SHA-256 of a|b|c; a null part is the character NUL, so that (a, null, b) and (a, b) differ."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(col(p).cast("string"), F.lit("\x00")) for p in parts)), 256)


def string_list(json: Column | str) -> Column:
    """A JSON array of strings; null for anything else, also for arrays with other items."""
    items = F.from_json(col(json), "array<string>")
    bare = F.regexp_replace(col(json), r'"(\\.|[^"\\])*"', "")
    return F.when(bare.rlike(r"^\s*\[[\s,]*\]\s*$"), items)


def decimal_or_zero(x: Column | str, precision: int = 28, scale: int = 12) -> Column:
    return F.coalesce(col(x).try_cast(f"decimal({precision},{scale})"), F.lit(0).cast(f"decimal({precision},{scale})"))


def topic_address(topic: Column | str) -> Column:
    """The address in the last 20 bytes of a 32-byte topic, lower case."""
    return F.concat(F.lit("0x"), F.lower(F.right(col(topic), F.lit(40))))


def address_topic(address: Column | str) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.substring(col(address), 3, 40)), 64, "0"))


def words(data: Column | str) -> Column:
    """The 32-byte words (64 hex digits) after 0x."""
    return F.regexp_extract_all(F.substring(col(data), 3, 1 << 30), F.lit("[0-9a-fA-F]{64}"), F.lit(0))


def last_hex_key(x: Column | str) -> Column:
    """The number of the last 16 hex digits, as a decimal."""
    return F.conv(F.right(col(x), F.lit(16)), 16, 10).cast("decimal(20,0)")


def violations(checks: dict[str, Column]) -> Column:
    """The names of the checks that fail (a null check fails), in their order; an empty array where all hold."""
    names = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    return F.filter(F.array(*names), lambda x: x.isNotNull())


def state_checks(bid_yes: Column, ask_yes: Column, bid_no: Column, ask_no: Column, depth: Column, seconds: Column) -> dict[str, Column]:
    """What a market state must fulfil: quotes in [0, 1], no bid above its ask, depth and time left not negative."""
    quotes = {"yes_bid": bid_yes, "yes_ask": ask_yes, "no_bid": bid_no, "no_ask": ask_no}
    return {n: c.between(0.0, 1.0) for n, c in quotes.items()} | {"crossed": (bid_yes <= ask_yes) & (bid_no <= ask_no), "depth": depth >= 0, "seconds": seconds >= 0}


def signal_checks(probability: Column, flow: Column, confidence: Column) -> dict[str, Column]:
    return {n: c.between(0.0, 1.0) for n, c in (("probability", probability), ("flow", flow), ("confidence", confidence))}


def lenient_list(raw: Column) -> Column:
    """A JSON array of any items as strings; everything else is an empty array."""
    return F.coalesce(F.from_json(F.when(F.ltrim(raw).startswith("["), raw), "array<string>"), F.array().cast("array<string>"))


def keep_and_regret(mean: Column, utility: Column, temperature: float, wrong_keep: float, missed: float) -> tuple[Column, Column]:
    """Probability of keeping, and its regret: weighted losses of wrong keeps and of skipped gains."""
    keep = sigmoid(mean / temperature)
    return keep, keep * F.greatest(-utility, F.lit(0.0)) * wrong_keep + (1 - keep) * F.greatest(utility, F.lit(0.0)) * missed


def fill_horizon(latency: int, wait: int) -> int:
    """Seconds that a decision's schedule must cover: a fill at the last second counts, intervals are half-open."""
    if latency < 0 or wait < 0:
        raise ValueError("latency and wait must not be negative")
    return latency + wait + 1


def row_digest(features: Column, normalization: Column, date: Column, row: Column) -> Column:
    """SHA-256 of a text head and the raw little-endian 32-bit floats of a feature row."""

    @F.pandas_udf("string")
    def digest(features, normalization, date, row):
        import hashlib

        import numpy as np
        import pandas as pd

        def one(x, n, d, r):
            return hashlib.sha256(f"normalization:{n}\ndate:{d}\nrow:{r}\n".encode() + np.asarray(x, "<f4").tobytes()).hexdigest()

        return pd.Series([None if x is None else one(x, n, d, r) for x, n, d, r in zip(features, normalization, date, row)], dtype=object)

    return digest(features, normalization, date, row)

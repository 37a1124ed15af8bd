"""Exact decimal fees, payouts and schedule checks."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal, localcontext

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import canonical

PRICE, SHARES, RATE = "decimal(10,6)", "decimal(18,6)", "decimal(8,6)"
#: Fixed value: decimals of a fee.
PLACES = 5
#: Formulas of a schedule.
ZERO, CURVE, OUTPUT_CURVE, MIN_CURVE = "zero", "curve", "v1_output_asset_curve", "v1_min_price_curve"


def unrounded_fee(formula: Column, shares: Column, price: Column, rate: Column, exponent: Column) -> Column:
    """shares * rate * (p (1 - p)) ** exponent, or shares * rate * min(p, 1 - p), or 0; exponent 0, 1 or 2.

    power() would turn decimals to doubles, so exponents are unrolled.
    """
    p, s, r = price.cast(PRICE), shares.cast(SHARES), rate.cast(RATE)
    base = (s * r).cast("decimal(24,12)")
    pq = (p * (1 - p)).cast("decimal(13,12)")
    curve = F.when(exponent == 0, base.cast("decimal(38,18)")).when(exponent == 1, (base * pq).cast("decimal(38,18)")).when(exponent == 2, (base * (pq * pq).cast("decimal(13,12)")).cast("decimal(38,18)"))
    low = (base * F.least(p, 1 - p)).cast("decimal(38,18)")
    return F.when(formula.isin(CURVE, OUTPUT_CURVE), curve).when(formula == MIN_CURVE, low).otherwise(F.lit(0).cast("decimal(38,18)"))


def apply_fee(protocol: Column, formula: Column, side: Column, maker: Column, taker_only: Column, shares: Column, price: Column, rate: Column, exponent: Column) -> Column:
    """struct<asset, amount, value_usd, collateral_usd, outcome_shares>.

    v1 buys pay in outcome shares (at most all of them), rounded down; everything else in collateral,
    rounded half up, v1 down. Makers are free where only takers pay.
    """
    raw = unrounded_fee(formula, shares, price, rate, exponent)
    free = (maker & taker_only) | (raw == 0)
    in_shares = F.when(formula == OUTPUT_CURVE, raw).otherwise(F.try_divide(raw.cast("decimal(24,12)"), price.cast(PRICE)).cast("decimal(24,12)"))
    v1_buy = (protocol == "v1") & (side == "BUY")
    outcome = F.least(shares.cast(SHARES), F.floor(in_shares, PLACES).cast(SHARES))
    collateral = F.when(protocol == "v1", F.floor(raw, PLACES).cast("decimal(20,5)")).otherwise(F.round(raw, PLACES).cast("decimal(20,5)"))
    zero = F.lit(0)

    def result(asset: Column, amount: Column, value: Column, c: Column, o: Column) -> Column:
        return F.struct(asset.alias("asset"), amount.cast("decimal(24,6)").alias("amount"), value.cast("decimal(28,12)").alias("value_usd"), c.cast("decimal(20,5)").alias("collateral_usd"), o.cast(SHARES).alias("outcome_shares"))

    return (
        F.when(free, result(F.lit("NONE"), zero, zero, zero, zero))
        .when(v1_buy, result(F.lit("OUTCOME"), outcome, outcome * price.cast(PRICE), zero, outcome))
        .otherwise(result(F.when(collateral > 0, "COLLATERAL").otherwise("NONE"), collateral, collateral, collateral, zero))
    )


def _payout(price: Decimal, cost: Decimal, rate: Decimal, exponent: int) -> Decimal | None:
    """Winning shares per unit of total cost for a collateral fee rounded half up to PLACES."""
    if not 0 < price <= 1 or cost <= 0:
        return None
    unit, step = rate * ((price * (1 - price)) ** exponent if exponent else 1), Decimal(1).scaleb(-PLACES)

    def total(shares: Decimal) -> Decimal:
        return shares * price + (shares * unit).quantize(step, "ROUND_HALF_UP")

    low, high = Decimal(0), cost / price
    for _ in range(96):
        middle = (low + high) / 2
        if total(middle) <= cost:
            low = middle
        else:
            high = middle
    return low / total(low)


def payout_per_cost(price: Column, cost: Column, rate: Column, exponent: Column) -> Column:
    """Payout of a winning buy per unit of total cost (double); the fee's rounding makes it a bisection."""

    @F.pandas_udf("double")
    def f(p: pd.Series, c: pd.Series, r: pd.Series, e: pd.Series) -> pd.Series:
        with localcontext() as ctx:
            ctx.prec = 28
            seen: dict[tuple, float | None] = {}
            out = []
            for k in zip(p, c, r, e):
                if any(x is None for x in k):
                    out.append(None)
                    continue
                if k not in seen:
                    v = _payout(Decimal(k[0]), Decimal(k[1]), Decimal(k[2]), int(k[3]))
                    seen[k] = None if v is None else float(v)
                out.append(seen[k])
        return pd.Series(out, dtype="float64")

    return f(price.cast("decimal(10,6)").cast("string"), cost.cast("decimal(18,6)").cast("string"), rate.cast("decimal(8,6)").cast("string"), exponent.cast("int"))


def infer_schedule(receipts: DataFrame, curves: Sequence[tuple[str, int]], rates: Sequence[str], key: str = "market_id") -> DataFrame:
    """key, formula, exponent, rate of the one schedule that explains all receipts of a key within rounding.

    receipts(key, shares, price, fee): every receipt votes for the candidates (a fixed short list) that give
    its fee to half a unit of the last place; a candidate must have all votes. Among these the smallest
    total residual wins; a key whose best two tie has none (ambiguous, null).
    """
    spark = receipts.sparkSession
    candidates = spark.createDataFrame([(f, e, r) for f, e in curves for r in rates], "formula string, exponent int, rate_text string")
    c = F.broadcast(candidates.withColumn("rate", F.col("rate_text").cast(RATE)).drop("rate_text"))
    x = receipts.join(c)  # times a fixed short list
    gap = F.abs(unrounded_fee(F.col("formula"), F.col("shares"), F.col("price"), F.col("rate"), F.col("exponent")) - F.col("fee").cast("decimal(38,18)"))
    x = x.withColumn("gap", gap.cast("double"))
    half = 0.5 * 10.0**-PLACES
    by = x.groupBy(key, "formula", "exponent", "rate").agg(F.max("gap").alias("worst"), F.sum("gap").alias("total"))
    by = by.where(F.col("worst") <= half * (1 + 1e-9))
    best = by.groupBy(key).agg(F.min_by(F.struct("formula", "exponent", "rate"), F.struct("total", "formula", "exponent", "rate")).alias("b"), F.sort_array(F.collect_list("total")).alias("t"))
    clear = (F.size("t") == 1) | (F.get("t", F.lit(1)) > F.get("t", F.lit(0)))
    return best.select(key, *(F.when(clear, F.col(f"b.{n}")).alias(n) for n in ("formula", "exponent", "rate")))


def active_fills(logs: DataFrame, refunds: DataFrame, key: str = "transaction_hash") -> DataFrame:
    """One row per receipt: the active taker fill with its refund-adjusted fee, and why there is none.

    logs(key, succeeded, order_hash, active, protocol, side, price, fee_raw): the fills of the wanted tokens
    by known exchanges, `active` where the exchange itself is the taker; refunds(key, order_hash, refunded
    _raw). A receipt has a fill only if it succeeded, exactly one fill is active and its price is in (0, 1);
    `problem` says otherwise. The fee is the refund's amount where the order has one.
    """
    last = refunds.groupBy(key, "order_hash").agg(F.max("refunded_raw").alias("refunded_raw"))
    one = F.struct("order_hash", "protocol", "side", "price", "fee_raw", "refunded_raw")
    by = logs.join(last, [key, "order_hash"], "left").groupBy(key).agg(
        F.min("succeeded").alias("ok"), F.count_if(F.col("active")).alias("n_active"), F.count("*").alias("n_fills"), F.max(F.when(F.col("active"), one)).alias("f")
    )
    problem = F.when(~F.col("ok"), "failed").when(F.col("n_active") != 1, "active").when(~((F.col("f.price") > 0) & (F.col("f.price") < 1)), "price")
    asset = F.when((F.col("f.protocol") == "v1") & (F.col("f.side") == "BUY"), "OUTCOME").otherwise("COLLATERAL")
    good = {
        "order_hash": F.col("f.order_hash"), "fee_asset": asset, "fee_raw": F.coalesce("f.refunded_raw", "f.fee_raw"), "refunded": F.col("f.refunded_raw").isNotNull(),
        "maker_fills": F.greatest(F.lit(1), F.col("n_fills") - 1).cast("bigint"),
    }
    return by.select(key, problem.alias("problem"), *(F.when(problem.isNull(), v).alias(k) for k, v in good.items()))


def affordable_shares(total: Column, protocol: Column, formula: Column, price: Column, rate: Column, exponent: Column, steps: int = 16) -> Column:
    """The most shares (six decimals) a taker's buy can have so that cost and collateral fee stay within total.

    From total / price downwards: a size that is too dear gives way to what its own fee leaves, or to the next smaller
    one where that is no less; at most `steps` times. 0 for no money, null for a price that is not positive or a search that does not end.
    """
    p, money, unit = price.cast(PRICE), total.cast(SHARES), F.lit("0.000001").cast(SHARES)

    def sized(left: Column) -> Column:
        return F.floor(F.try_divide(left.cast("decimal(18,6)"), p), 6).cast(SHARES)

    def fee(shares: Column) -> Column:
        return apply_fee(protocol, formula, F.lit("BUY"), F.lit(False), F.lit(True), shares, price, rate, exponent)["collateral_usd"].cast(SHARES)

    def step(state: Column, _: Column) -> Column:
        size = state["size"]
        cost = fee(size)
        fits = (size * p + cost) <= money
        less = sized(money - cost)
        smaller = F.greatest(F.when(less < size, less).otherwise(size - unit), F.lit(0).cast(SHARES)).cast(SHARES)
        return F.when(state["done"], state).otherwise(F.struct(F.when(fits, size).otherwise(smaller).alias("size"), (fits | (smaller <= 0)).alias("done")))

    start = F.struct(sized(money).alias("size"), F.lit(False).alias("done"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return F.when(money <= 0, F.lit(0).cast(SHARES)).when(p > 0, F.when(found["done"], found["size"]))


def consensus(fills: DataFrame, curves: Sequence[tuple[str, int]], rates: Sequence[str], key: str = "market_id", places: Sequence[int] = (5, 4), least: int = 2) -> DataFrame:
    """key, status, formula, exponent, rate, n_receipts, n_left, residual: the schedule that independent receipts share.

    fills(key, transaction_hash, shares, price, fee, preferred): decoded active fills (see active_fills), `preferred` the
    formula in use at their time. Every receipt has the candidates (a fixed short list of curves and rates, by precision)
    that give its fee to half a unit of the last place; of these the nearest stay, and of those, where there is one, the
    preferred formula's. What all receipts of a key have is left; again the preferred formula goes first, then the smallest sum of residuals.
    status: `unique`; `ambiguous` (n_left schedules tie); `disjoint` (no schedule in all); `unmatched` (a receipt has
    none); `too few` (less than `least` different receipts).
    """
    spark = fills.sparkSession
    listed = spark.createDataFrame([(f, e, r, n) for f, e in curves for r in rates for n in places], "formula string, exponent int, rate_text string, places int")
    options = F.broadcast(listed.withColumn("rate", F.col("rate_text").cast(RATE)).drop("rate_text"))
    one = fills.groupBy(key, "transaction_hash").agg(F.min(F.struct("shares", "price", "fee", "preferred")).alias("f")).select(key, "transaction_hash", "f.*")
    x = one.join(options)  # times a fixed short list
    raw = unrounded_fee(F.col("formula"), F.col("shares"), F.col("price"), F.col("rate"), F.col("exponent"))
    rounded = F.when(F.col("places") == 4, F.round(raw, 4)).otherwise(F.round(raw, 5)).cast("decimal(38,18)")
    gap = F.abs(rounded - F.col("fee").cast("decimal(38,18)"))
    half = F.lit(Decimal(1).scaleb(-PLACES) / 2).cast("decimal(38,18)")
    near = x.withColumn("gap", gap).where(F.col("gap") <= half).groupBy(key, "transaction_hash", "preferred", "formula", "exponent", "rate").agg(F.min("gap").alias("gap"))
    w = W.partitionBy(key, "transaction_hash")
    best = near.withColumn("least", F.min("gap").over(w)).where("gap = least").withColumn("own", F.max(F.col("formula") == F.col("preferred")).over(w)).where("not own or formula = preferred")
    receipts = one.groupBy(key).agg(F.count("*").alias("n_receipts"), F.min_by("preferred", "transaction_hash").alias("preferred"))
    matched = best.groupBy(key).agg(F.countDistinct("transaction_hash").alias("n_matched"))
    votes = best.groupBy(key, "formula", "exponent", "rate").agg(F.count("*").alias("votes"), F.sum("gap").alias("residual"))
    k = W.partitionBy(key)
    shared = votes.join(receipts, key).where("votes = n_receipts").withColumn("own", F.max(F.col("formula") == F.col("preferred")).over(k)).where("not own or formula = preferred")
    shared = shared.withColumn("least", F.min("residual").over(k)).where("residual = least")
    left = shared.groupBy(key).agg(F.count("*").alias("n_left"), F.min(F.struct("formula", "exponent", "rate")).alias("s"), F.min("residual").alias("residual"))
    out = receipts.join(matched, key, "left").join(left, key, "left")
    status = (
        F.when(F.col("n_receipts") < least, "too few").when(F.coalesce("n_matched", F.lit(0)) < F.col("n_receipts"), "unmatched").when(F.col("n_left").isNull(), "disjoint").when(F.col("n_left") > 1, "ambiguous").otherwise("unique")
    )
    sure = F.col("status") == "unique"
    return out.withColumn("status", status).select(key, "status", *(F.when(sure, F.col(f"s.{c}")).alias(c) for c in ("formula", "exponent", "rate")), "n_receipts", F.coalesce("n_left", F.lit(0)).alias("n_left"), F.when(sure, F.col("residual")).alias("residual"))


def book_violations(schedules: DataFrame, proofs: DataFrame, expected: DataFrame, schedule_id: str = "schedule_id") -> DataFrame:
    """schedule_id, problem: what a fee book breaks; empty for a sound one.

    schedules(schedule_id, source, ..): their canonical digests must be those of expected(schedule_id, sha256).
    proofs(schedule_id, transaction_hash, status): successful, with a 32-byte hash, each once. A schedule needs a proof
    unless it is an official one, two different ones if it is a consensus, and no proof may stand without a schedule.
    """
    rows = schedules.select(schedule_id, "source", F.struct(*schedules.columns).alias("row"))
    own = rows.select(schedule_id, "source", canonical.digest(F.col("row"), rows.schema["row"].dataType).alias("h"))
    repeats = own.groupBy(schedule_id).agg(F.count("*").alias("n"), F.min("h").alias("h"), F.min("source").alias("source"))
    held = repeats.join(expected, schedule_id, "full_outer")
    content = held.select(schedule_id, F.when(F.col("h").isNull(), "schedule missing").when(F.col("sha256").isNull(), "schedule not expected").when(F.col("n") > 1, "schedule repeated").when(F.col("h") != F.col("sha256"), "content changed").alias("problem"))
    good = (F.col("status") == "0x1") & F.lower("transaction_hash").rlike("^0x[0-9a-f]{64}$")
    by = proofs.groupBy(schedule_id, F.lower("transaction_hash").alias("tx")).agg(F.count("*").alias("n"), F.min(F.coalesce(good, F.lit(False))).alias("good"))
    rows_bad = by.select(schedule_id, F.when(~F.col("good"), "proof invalid").when(F.col("n") > 1, "proof repeated").alias("problem"))
    counts = by.where("good").groupBy(schedule_id).agg(F.count("*").alias("n_proofs"))
    needed = F.when(F.col("source").startswith("official"), 0).when(F.col("source").contains("consensus"), 2).otherwise(1)
    covered = repeats.join(counts, schedule_id, "full_outer")
    few = covered.select(schedule_id, F.when(F.col("source").isNull(), "proof without schedule").when(F.coalesce("n_proofs", F.lit(0)) < needed, "too few proofs").alias("problem"))
    return content.unionByName(rows_bad).unionByName(few).where("problem is not null").distinct()

"""Queries that no SQL expresses: properties and independent computations on the smallest tables."""

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from compare import DATA
from tideline.operators import evaluate
from tideline.plans import registry
from tideline.plans.views import DAY, schedules, trades_ev

D = f"{DATA}/sf0.001"


def rows(spark, name):
    return registry.QUERIES[name](spark, D).collect()


def trades(spark):
    return {r["trade_id"]: r for r in trades_ev(spark, D).collect()}


def test_seeded_shuffle_is_a_permutation_of_each_day(spark):
    t, days = trades(spark), defaultdict(dict)
    for r in rows(spark, "i13_seeded_shuffle"):
        assert r["day"] == t[r["trade_id"]]["timestamp_unix"] // DAY
        days[r["day"]][r["place"]] = r["trade_id"]
    assert sum(map(len, days.values())) == len(t)
    assert all(sorted(d) == list(range(1, len(d) + 1)) for d in days.values())
    assert any([d[k] for k in sorted(d)] != sorted(d.values()) for d in days.values())
    assert sorted(map(tuple, rows(spark, "i13_seeded_shuffle"))) == sorted((d, i, k) for d, x in days.items() for k, i in x.items())


def test_wallets_are_permuted_within_days(spark):
    t, before, after, moved = trades(spark), defaultdict(Counter), defaultdict(Counter), 0
    for r in rows(spark, "c33_wallet_shuffle"):
        x = t[r["trade_id"]]
        before[x["timestamp_unix"] // DAY][x["wallet_id"]] += 1
        after[x["timestamp_unix"] // DAY][r["shuffled_wallet"]] += 1
        moved += x["wallet_id"] != r["shuffled_wallet"]
    assert before == after and moved > len(t) / 2


def test_hash_unit_is_uniform_and_stable(spark):
    u = {r["wallet_id"]: r["unit"] for r in rows(spark, "c35_hash_unit")}
    x = np.array(list(u.values()))
    assert ((x >= 0) & (x < 1)).all() and len(set(x)) == len(x) and abs(x.mean() - 0.5) < 5 / math.sqrt(12 * len(x))
    assert u == {r["wallet_id"]: r["unit"] for r in rows(spark, "c35_hash_unit")}


def test_temperature_is_the_best_on_a_grid(spark):
    t = trades(spark).values()
    p = np.clip([r["price"] for r in t], 1e-3, 1 - 1e-3)
    z, y = np.log(p / (1 - p)), np.array([r["outcome_index"] for r in t])

    def loss(b):
        return np.mean(np.logaddexp(0, z * b) - y * z * b)

    b = rows(spark, "f35_temperature")[0]["inverse_temperature"]
    assert all(loss(b) <= loss(b + d) + 1e-12 for d in (-1, -0.1, -0.01, -1e-4, 1e-4, 0.01, 0.1, 1))


def test_payouts_spend_the_whole_cost(spark):
    t = {r["trade_id"]: r for r in trades_ev(spark, D).join(schedules(trades_ev(spark, D)), "market_id").where("timestamp_unix >= from_ts and timestamp_unix < to_ts").collect()}
    got = rows(spark, "m04_l07_action_targets")
    assert len(got) == len(t)
    for r in got:
        x = t[r["trade_id"]]
        for i in (0, 1):
            price, rate, k = r[f"entry{i}"], float(x["rate"]), x["exponent"]
            shares = r[f"payout{i}"] * 500
            assert abs(shares * price + round(shares * rate * (price * (1 - price)) ** k, 5) - 500) < 1e-3
            win = x["outcome_index"] if i == 0 else 1 - x["outcome_index"]
            assert abs(r[f"value{i}"] - math.log(max(0.95 + 0.05 * r[f"payout{i}"] * win, 1e-8))) < 1e-9
        assert r["value_skip"] == 0


def test_applied_fees_follow_the_side_that_pays(spark):
    t = trades(spark)
    for r in rows(spark, "m02_applied_fee"):
        x = t[r["trade_id"]]
        v1, amount = x["market_id"] % 2 == 0, float(r["amount"])
        if r["asset"] == "OUTCOME":
            assert v1 and x["side"] == "BUY" and 0 < amount <= x["size"] + 1e-6 and float(r["outcome_shares"]) == amount
            assert abs(float(r["value_usd"]) - amount * x["price"]) < 1e-6
        elif r["asset"] == "COLLATERAL":
            assert not (v1 and x["side"] == "BUY") and float(r["collateral_usd"]) == amount > 0
        else:
            assert amount == 0


def test_moving_blocks_keep_the_mean_and_widen_with_correlation():
    rng = np.random.default_rng(3)
    x = rng.normal(size=240)
    smooth = np.convolve(x, np.ones(4) / 2, "same")
    for series, low, high in ((x, 0.7, 1.3), (smooth, 1.3, 2.4)):
        m = evaluate.moving_block_bootstrap(series, 4000, 4)
        iid = series.std() / math.sqrt(len(series))
        assert (np.diff(m) >= 0).all() and abs(m.mean() - series.mean()) < 4 * m.std() / math.sqrt(4000) + 1e-9
        assert low < m.std() / iid < high


def test_group_ratios_spread_like_resampled_groups(spark):
    rng = np.random.default_rng(4)
    g, v = np.repeat(np.arange(80), 5), rng.normal(2, 1, 400) + np.repeat(rng.normal(size=80), 5)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v)], "g int, v double")
    got = np.array([r["ratio"] for r in evaluate.group_bootstrap(df, "g", F.col("v"), F.lit(1), 400).collect()])
    means = v.reshape(80, 5).mean(1)
    want = np.array([rng.choice(means, 80).mean() for _ in range(4000)])
    assert abs(got.mean() - v.mean()) < 0.05 and 0.8 < got.std() / want.std() < 1.25

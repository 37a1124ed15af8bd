"""Hand-computed vectors and sequential references of single operators."""

import hashlib
import math
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from tideline.functions import scalar as S
from tideline.operators import asof, components, cursor, evaluate, fees, order, running


def one(spark, **named):
    return spark.range(1).select(*(v.alias(k) for k, v in named.items())).first()


def test_orientation(spark):
    df = spark.createDataFrame([("BUY", 0, 0.4), ("SELL", 0, 0.4), ("BUY", 1, 0.4), ("SELL", 1, 0.4)], "side string, outcome_index int, price double")
    assert [tuple(r) for r in df.select(S.direction(), F.round(S.probability0(), 6)).collect()] == [(1, 0.4), (-1, 0.4), (-1, 0.6), (1, 0.6)]
    assert df.select(S.yes_price(F.lit(1.0), F.lit(0))).first()[0] is None


def test_week_and_bins(spark):
    r = one(spark, a=S.week_id(F.lit(345600)), b=S.week_id(F.lit(950399)), c=S.week_id(F.lit(950400)), d=S.price_bin(F.lit(0.49)), e=S.price_bin(F.lit(0.5)), f=S.price_bin(F.lit(0.98)))
    assert tuple(r) == (345600, 345600, 950400, "below_0_50", "0_50_to_0_70", "at_least_0_98")


def test_parsing(spark):
    r = one(spark, a=S.string_list(F.lit('["x","1,2"]')), b=S.string_list(F.lit('["x",1]')), c=S.string_list(F.lit('{"a":1}')), d=S.string_list(F.lit("[]")), e=S.parse_utc(F.lit("2026-01-01 00:00:00")).isNull(), f=F.unix_timestamp(S.parse_utc(F.lit("2026-01-01 00:00:00+00"))))
    assert r["a"] == ["x", "1,2"] and r["b"] is None and r["c"] is None and r["d"] == [] and r["e"] and r["f"] == 1767225600


def test_fees(spark):
    def fee(price, maker=False, rate="0.07", exponent=1, protocol="v2", side="BUY"):
        f = fees.apply_fee(F.lit(protocol), F.lit(fees.CURVE), F.lit(side), F.lit(maker), F.lit(True), F.lit(100), F.lit(price), F.lit(rate), F.lit(exponent))
        return one(spark, f=f)["f"]

    assert fee("0.5")["collateral_usd"] == Decimal("1.75000")
    assert fee("0.3")["collateral_usd"] == fee("0.7")["collateral_usd"] == Decimal("1.47000")
    assert fee("0.5", maker=True)["asset"] == "NONE"
    assert fee("0.5", rate="0.04")["collateral_usd"] == Decimal("1.00000") and fee("0.5", rate="0.05")["collateral_usd"] == Decimal("1.25000")
    v1 = fee("0.4", rate="0.072", protocol="v1")
    assert v1["asset"] == "OUTCOME" and v1["outcome_shares"] == Decimal("4.320000") and v1["collateral_usd"] == 0


def test_payout(spark):
    p = one(spark, p=fees.payout_per_cost(F.lit("0.5"), F.lit("500"), F.lit("0.07"), F.lit(1)))["p"]
    assert abs(p - 1 / (0.5 + 0.07 * 0.25)) < 1e-5
    assert one(spark, p=fees.payout_per_cost(F.lit("1"), F.lit("500"), F.lit("0"), F.lit(0)))["p"] == 1.0


def test_cursor_batches_without_decision(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        rows = spark.range(2000).select(F.lit(1).alias("component_id"), F.col("id").alias("trade_id"), F.col("id").alias("timestamp_unix"))
        got = {r["trade_id"] + 1 for r in cursor.decisions(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {2**i for i in range(11)} | set(range(1152, 2001, 128))


def test_cursor_against_sequential_walk(spark):
    rng = np.random.default_rng(1)
    t = np.cumsum(rng.integers(0, 3000, 3000)) + 100
    rows = [(1, int(i), int(x)) for i, x in enumerate(t)]
    got = {r["trade_id"]: r["reasons"] for r in cursor.decisions(spark.createDataFrame(rows, "component_id int, trade_id bigint, timestamp_unix bigint")).collect()}
    want, last = {}, None
    for n, x in enumerate(t.tolist(), 1):
        why = []
        if n == 1:
            why.append("first")
        elif n <= 1024 and n & (n - 1) == 0:
            why.append("early_power_of_two")
        elif n > 1024 and n % 128 == 0:
            why.append("trade_stride")
        if last is not None and x - last >= 21600:
            why.append("heartbeat")
        if why:
            want[n - 1], last = why, x
    assert got == want


def test_ema_over_chunks_equals_sequential(spark):
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.choice([0, 5, 400, 90_000, 4_000_000], 400))
    x = rng.random(400)
    df = spark.createDataFrame([(7, int(i), int(a), float(b)) for i, (a, b) in enumerate(zip(t, x))], "k int, trade_id bigint, timestamp_unix bigint, x double")
    for scan in (running.keyed_ema, running.chunked_ema):
        got = {r["trade_id"]: (r["ema_x_300"], r["ema_x_86400"]) for r in scan(df, "k", ["x"], (300, 86400)).collect()}
        for j, h in enumerate((300, 86400)):
            s, last = x[0], t[0]
            for i in range(400):
                d = math.exp(-math.log(2) * (t[i] - last) / h)
                s, last = (x[0] if i == 0 else d * s + (1 - d) * x[i]), t[i]
                assert abs(got[i][j] - s) < 1e-9


def test_running_sketch_equals_full_estimate(spark):
    rng = np.random.default_rng(3)
    items = rng.integers(0, 200, 600)
    df = spark.createDataFrame([(1, int(i), int(i), int(v)) for i, v in enumerate(items)], "k int, timestamp_unix bigint, trade_id bigint, item bigint")
    got = {r["trade_id"]: r["e"] for r in running.running_sketch(df, "k", "item", "e").collect()}
    reg = np.zeros(64, int)
    for i, v in enumerate(items.tolist()):
        h = int(running.mix64(np.array([v], np.uint64))[0])
        reg[h & 63] = max(reg[h & 63], 58 - (h >> 6).bit_length() + 1)
        s, zeros = sum(2.0 ** -int(r) for r in reg), int((reg == 0).sum())
        e = 0.709 * 64 * 64 / s
        e = 64 * math.log(64 / zeros) if zeros and e <= 160 else e
        assert abs(got[i] - e) < 1e-6
    assert int(running.mix64(np.array([0], np.uint64))[0]) == 0xE220A8397B1DCDAF


def test_strict_asof_hides_equal_seconds(spark):
    left = spark.createDataFrame([(1, 10, 200), (1, 11, 201)], "w int, trade_id bigint, ts bigint")
    ev = spark.createDataFrame([(1, 150, 1.0), (1, 200, 5.0)], "w int, rts bigint, v double")
    got = {r["trade_id"]: r["s"] for r in asof.strict_asof_sums(left, ev, "w", "ts", "rts", {"s": F.col("v")}, "trade_id").collect()}
    assert got == {10: 1.0, 11: 6.0}


def test_history_cut_of_hot_seconds(spark):
    from tideline.plans.queries_ledger import history_cut

    seconds = [1] * 20 + [2] * 60 + [3] * 5 + [9]
    rows = [(w, 100 * w + i, s, float(i * i % 17)) for w in (1, 2) for i, s in enumerate(seconds[: 90 if w == 1 else 22])]
    want = {}
    for w, i, s, _ in rows:
        h = sorted((x[2], x[1], x[3]) for x in rows if x[0] == w and x[2] < s)[-16:]
        if h:
            want[i] = (len(h), round(sum(x[2] for x in h) / len(h), 6), h[0][0])
    t = spark.createDataFrame(rows, "wallet_id bigint, trade_id bigint, timestamp_unix bigint, size double")
    assert {r["trade_id"]: (r["n"], r["mean_size"], r["oldest"]) for r in history_cut(t).collect()} == want


def test_known_totals_after_day_60(spark):
    from tideline.plans.queries_ledger import known_totals
    from tideline.plans.views import DAY, START

    rows = [(1, 1, START, 2.0), (1, 2, START + 7 * DAY, 3.0), (1, 3, START + 7 * DAY - 1, 4.0), (1, 4, START + 60 * DAY, 5.0), (1, 5, START + 400 * DAY, 6.0), (2, 6, START + 90 * DAY, 7.0)]
    t = spark.createDataFrame(rows, "wallet_id bigint, trade_id bigint, timestamp_unix bigint, notional_usd double")
    got = {r["trade_id"]: (r["known_trades"], r["known_notional"]) for r in known_totals(t).collect()}
    assert got == {1: (0, 0.0), 2: (2, 6.0), 3: (0, 0.0), 4: (3, 9.0), 5: (4, 14.0), 6: (0, 0.0)}


def test_sequences_have_every_position(spark):
    from tideline.plans.queries_more import sequences

    sizes = {1: 300, 2: 128, 3: 127, 4: 192, 5: 191}
    t = spark.createDataFrame([(m, i, i, i / 1000) for m, k in sizes.items() for i in range(k)], "market_id bigint, trade_id bigint, timestamp_unix bigint, price double")
    for length, stride in ((128, 64), (100, 30), (7, 10)):
        want = sorted((m, s + 1, o, round((s + o) / 1000, 6)) for m, k in sizes.items() for s in range(0, k - length + 1, stride) for o in range(length))
        assert sorted(map(tuple, sequences(t, length, stride).collect())) == want


def test_components(spark):
    e = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 99), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(e, "src bigint, dst bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 99: 99, 100: 99, 101: 99}
    assert components.connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_components_of_many_edges_contract_few(spark, monkeypatch):
    """Rounds see forests or the edges to two neighbours of a node, not all edges; links outside those count."""
    rounds, cut = [], components.cut

    def counted(df, what="table"):
        out = cut(df, what)
        rounds.append(out.count())
        return out

    monkeypatch.setattr(components, "cut", counted)
    rng = np.random.default_rng(11)
    dense = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 200, (8000, 2))], "src bigint, dst bigint").repartition(4)
    assert {r["component"] for r in components.connected_components(dense).collect()} == {0} and max(rounds) <= 4 * 199

    # Cliques of even and of odd numbers; the one link of a pair lies between the least and the last neighbours of its ends.
    rows = [(32 * g + a, 32 * g + b) for g in range(100) for s in (0, 1) for a in range(s, 32, 2) for b in range(a + 2, 32, 2)]
    rows += [(32 * g + 16, 32 * g + 17) for g in range(0, 100, 2)]
    rounds.clear()
    monkeypatch.setattr(components, "FOREST_EDGES", 64)  # forests are passed on, not held
    df = spark.createDataFrame([(f"{a:05d}", f"{b:05d}") for a, b in rows], "src string, dst string").repartition(8)
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    assert got == {f"{32 * g + i:05d}": f"{32 * g + (i % 2 if g % 2 else 0):05d}" for g in range(100) for i in range(32)}
    assert rounds[0] > 2 * 5800 >= 2 * max(rounds[1:])


def test_whole_components_against_union_find(spark):
    from compare import DATA
    from tideline.plans import registry

    d, root = f"{DATA}/sf0.001", {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    days = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date"))
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_partkey", "l_suppkey", days.alias("day")).collect()
    for part, supplier, day in lines:
        a, b = sorted((find(part), find(1000000 + supplier * 10000 + day // 200)))
        root[b] = a
    want = {x: find(x) for x in root}
    assert {r["node"]: r["component"] for r in registry.QUERIES["k01_components"](spark, d).collect()} == want
    members = {}
    for x, c in want.items():
        members.setdefault(c, []).append(str(x))
    ids = {c: hashlib.sha256("\n".join(["event-component-v1", *sorted(m)]).encode()).hexdigest() for c, m in members.items()}
    parts = [r[0] for r in spark.read.parquet(f"{d}/part.parquet").select("p_partkey").collect()]
    orphan = {p: hashlib.sha256(f"orphan-market-v1\n{p}".encode()).hexdigest() for p in parts}
    got = {r["p_partkey"]: (r["component_id"], r["n_members"]) for r in registry.QUERIES["k02_k03_component_ids"](spark, d).collect()}
    assert got == {p: (ids[want[p]], len(members[want[p]])) if p in want else (orphan[p], 1) for p in parts}


def test_stable_id_of_giant_component(spark):
    n = 60_000
    c = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") < n - 2, 0).otherwise(F.col("id")).alias("component"))
    got = {r["component"]: (r["component_id"], r["n_members"]) for r in components.stable_ids(c).collect()}
    one_id = lambda m: hashlib.sha256("\n".join(["event-component-v1", *sorted(map(str, m))]).encode()).hexdigest()
    assert got == {0: (one_id(range(n - 2)), n - 2), n - 2: (one_id([n - 2]), 1), n - 1: (one_id([n - 1]), 1)}


def test_time_partition(spark):
    df = spark.createDataFrame(list(zip([1, 1, 2, 3, 3, 4], [1, 4, 2, 3, 8, 9])), "c int, ts int")
    got = {r["c"]: r["side"] for r in order.time_partition(df, "c", "ts", 0.5).collect()}
    assert got == {1: "fit", 2: "fit", 3: "selection", 4: "selection"}


def test_fail_closed_join(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    try:
        order.strict_join(a, b, "k")
        raise AssertionError
    except ValueError as e:
        assert "no match" in str(e)


def test_bootstraps(spark):
    m = evaluate.moving_block_bootstrap([1.0] * 8, 50)
    assert m.shape == (50,) and (m == 1).all()
    df = spark.range(400).select((F.col("id") % 40).alias("g"), F.lit(2.0).alias("v"))
    assert {round(r["ratio"], 9) for r in evaluate.group_bootstrap(df, "g", F.col("v"), F.lit(1), 20).collect()} == {2.0}


def test_platt_and_ridge(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.7 * z + 0.3)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b), 1.0, float(2 * a + 1)) for a, b in zip(z, y)], "z double, y int, w double, t double")
    a, b = evaluate.platt(df, "z", "y")
    assert abs(a - 0.7) < 0.1 and abs(b - 0.3) < 0.1
    assert np.allclose(evaluate.ridge(df, ["z"], "t", "w", 1e-6), [1, 2], atol=1e-6)


def test_forward_asof_against_search(spark):
    """Ties, nulls, ends of buckets; no frame holds a tolerance's rows."""
    rng = np.random.default_rng(7)
    rows = [(int(k), int(i), int(t), None if rng.random() < 0.2 else float(i)) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 600), rng.integers(85_000, 90_000, 600) // 3 * 3))]
    rows += [(None, 900, 86_000, 1.0), (9, 901, 86_400, 2.0), (9, 902, 86_460, 3.0), (9, 903, 86_490, 4.0)]
    leads = {"near": (60, 30), "far": (0, 0), "wide": (300, 900)}
    df = spark.createDataFrame(rows, "k int, i bigint, t bigint, v double")
    found = asof.forward_asof(df, "k", "t", F.col("v"), "i", leads)
    assert "RangeFrame" not in found._jdf.queryExecution().optimizedPlan().toString()

    def want(k, t, h, tol):
        hits = [(x, i, v) for key, i, x, v in rows if key == k and k is not None and v is not None and t + h <= x <= t + h + tol]
        return min(hits)[2] if hits else None

    got = {r["i"]: (r["near"], r["far"], r["wide"]) for r in found.collect()}
    assert got == {i: tuple(want(k, t, h, tol) for h, tol in leads.values()) for k, i, t, _ in rows}


def test_worst_share_walks_few(spark):
    """Ties at the limit, null keys and values, values that no bracket holds; few rows are put in order."""
    rng = np.random.default_rng(3)
    rows = [(k, None if rng.random() < 0.01 else float(rng.integers(0, 40))) for k in [1] * 900 + [2] * 50 + [None] * 31 + [3]] + [(4, None)] + [(5, float("nan"))] * 99 + [(5, 1.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    want = {}
    for key in {k for k, _ in rows}:
        own = sorted((v is not None, v != v, v or 0.0) for k, v in rows if k == key)
        own = own[: math.ceil(len(own) * 0.1)]
        values = [v for known, _, v in own if known]
        want[key] = (str(round(sum(values) / len(values), 9)) if values else "None", len(own))
    for margin in (0.01, 0.0, 1.0):
        got = {r["k"]: (str(r["tail"] and round(r["tail"], 9)), r["groups"]) for r in evaluate.worst_share(df, "v", 0.1, "k", margin=margin).collect()}
        assert got == want
    assert [tuple(r) for r in evaluate.worst_share(df.where("false"), "v", 0.1).collect()] == [(None, 0)]

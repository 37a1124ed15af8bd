"""The feature pack against a row-by-row walk."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import DATA
from tideline.operators import features, running
from tideline.plans.queries_ledger import pack_inputs
from tideline.plans.views import trades_ev

ACTOR = features.ACTOR


class Key:
    """Sums of one wallet, market, component or of everything."""

    def __init__(self):
        self.n = self.notional = self.size = self.signed = self.side = self.outcome = self.pn = self.ppn = self.nn = 0.0
        self.low, self.high, self.first, self.last, self.ema, self.reg = 2.0, -1.0, None, None, {}, {}

    def add(self, r, p, d, lives):
        self.gap = 0 if self.last is None else r["timestamp_unix"] - self.last
        self.first = r["timestamp_unix"] if self.first is None else self.first
        w, s, o = r["notional_usd"], 1 if r["side"] == "BUY" else -1, 1 if r["outcome_index"] == 0 else -1
        for name, v in (("p", p), ("d", d)):
            for h in lives:
                k = 2.0 ** (-self.gap / h)
                self.ema[name, h] = v if self.last is None else k * self.ema[name, h] + (1 - k) * v
        self.last = r["timestamp_unix"]
        self.n += 1
        self.notional += w
        self.size += r["size"]
        self.signed += d * w
        self.side += s * w
        self.outcome += o * w
        self.pn += p * w
        self.ppn += p * p * w
        self.nn += w * w
        self.low, self.high, self.age = min(self.low, p), max(self.high, p), r["timestamp_unix"] - self.first

    def mean(self):
        return self.pn / self.notional

    def std(self):
        return math.sqrt(max(self.ppn / self.notional - self.mean() ** 2, 0))

    def see(self, name, item):
        reg = self.reg.setdefault(name, np.zeros(64, int))
        h = int(running.mix64(np.array([item], np.uint64))[0])
        reg[h & 63] = max(reg[h & 63], 58 - (h >> 6).bit_length() + 1)
        s, z = sum(2.0 ** -int(x) for x in reg), int((reg == 0).sum())
        e = 0.709 * 4096 / s
        return 64 * math.log(64 / z) if z and e <= 160 else e


def walk(trades, markets, resolutions, actor):
    ln, half = math.log1p, 2 * math.pi
    wallets, mk, cp, u = defaultdict(Key), defaultdict(Key), defaultdict(Key), Key()
    crowd, more = defaultdict(lambda: np.zeros(13)), defaultdict(lambda: {"s": 0, "o": 0, "gaps": 0, "sw": 0, "prev": None})
    static = {m["market_id"]: m for m in markets}
    for r in sorted(trades, key=lambda r: (r["timestamp_unix"], r["trade_id"])):
        ts, n, wid, mid, cid = r["timestamp_unix"], r["notional_usd"], r["wallet_id"], r["market_id"], r["component_id"]
        buy, o = r["side"] == "BUY", r["outcome_index"]
        p, d = (r["price"] if o == 0 else 1 - r["price"]), (1 if buy == (o == 0) else -1)
        w, m, c, x = wallets[wid], mk[mid], cp[cid], more[wid]
        for key, lives in ((w, ()), (m, features.MARKET_LIVES), (c, features.COMPONENT_LIVES), (u, (86_400,))):
            key.add(r, p, d, lives)
        same = x["prev"] == mid
        x["sw"] += x["prev"] is not None and not same
        x["s"] += 1 if buy else -1
        x["o"] += 1 if o == 0 else -1
        x["gaps"] += w.gap
        x["prev"] = mid
        res = [a for a in resolutions[wid] if a["resolution_ts"] < ts]
        rn = len(res)
        edge, pnl = (sum(a[k] for a in res) / rn if rn else 0.0 for k in ("edge", "pnl"))
        a = {k: sum(b[k] for b in actor[wid] if b["available"] <= ts) for k in ACTOR}
        fills = a["maker_fills"] + a["taker_fills"]
        known = fills > 0
        recency = 1.0 if w.n == 1 else min(ln(w.gap) / 20, 1.0)
        e = [ln(w.n) / 20, ln(w.notional) / 24, edge, math.tanh(pnl / 100), a["maker_fills"] / fills if known else 0.0, recency, 1 / math.sqrt(w.n)]
        k = crowd[mid]
        k += n * np.array([*e, known, rn > 0, *(v * v for v in e[:4])])
        q = k / m.notional
        s = static[mid]
        of = [v for v in markets if v["component_id"] == cid]
        span = s["end_ts"] - s["created"]
        ok = s["created"] > 0 and span > 0
        mw, cm = m.see("w", wid), c.see("m", mid)
        um, uc = u.see("m", mid), u.see("c", cid)
        rest = max(w.n - 1, 1)
        mean = a["price_sum"] / fills if known else 0
        yield r["trade_id"], [
            ln(u.n), ln(u.notional), ln(u.age / 86400), math.sin(half * (ts % 86400) / 86400), math.cos(half * (ts % 86400) / 86400), math.sin(half * (ts % 604800) / 604800), math.cos(half * (ts % 604800) / 604800), ln(u.gap),
            ln(m.n), ln(m.notional), ln(m.size), p, r["price"], o, int(buy), ln(n), ln(r["size"]), m.signed / m.notional, m.side / m.notional, m.outcome / m.notional, m.mean(), m.std(), m.low, m.high, ln(m.gap), ln(m.age), ln(mw), ln(m.n / max(mw, 1)), m.nn / m.notional**2, n / m.notional,
            *(m.ema["p", h] for h in features.MARKET_LIVES), *(m.ema["d", h] for h in features.MARKET_LIVES), *(p - m.ema["p", h] for h in (300, 3600, 86_400, 604_800)), ln(m.notional / m.n), ln(m.notional * 86400 / max(m.age, 1)),
            min(max((ts - s["created"]) / span, 0), 1) if ok else 0, min(max((s["end_ts"] - ts) / span, 0), 1) if ok else 0,
            ln(c.n), ln(c.notional), c.signed / c.notional, c.side / c.notional, c.outcome / c.notional, c.mean(), c.std(), p, ln(c.gap), ln(c.age), ln(cm), ln(c.n / max(cm, 1)), m.n / c.n, m.notional / c.notional,
            ln(len(of)), sum(v["neg_risk"] for v in of) / len(of), sum(v["unclosed"] for v in of) / len(of), *(c.ema["p", h] for h in features.COMPONENT_LIVES), *(c.ema["d", h] for h in features.COMPONENT_LIVES), ln(c.notional * 86400 / max(c.age, 1)),
            ln(w.n), ln(w.notional), ln(w.size), x["s"] / w.n, x["o"] / w.n, w.signed / w.notional, w.mean(), w.std(), recency, ln(x["gaps"] / rest), x["sw"] / rest, int(same), n / w.notional,
            ln(rn), edge, pnl, sum(b["pnl"] > 0 for b in res) / rn if rn else 0, int(known),
            *([ln(a["maker_fills"]), ln(a["taker_fills"]), a["maker_fills"] / fills, (a["buy_fills"] - a["sell_fills"]) / (a["buy_fills"] + a["sell_fills"]), ln(a["buy_notional"] + a["sell_notional"]), ln(a["counterparties"]), ln(a["assets"]), mean, math.sqrt(max(a["price_square"] / fills - mean**2, 0))] if known else [0] * 9), 1 / math.sqrt(w.n),
            *(v for i in range(4) for v in (q[i], math.sqrt(max(q[9 + i] - q[i] ** 2, 0)))), q[4], q[7], q[8], ln(m.notional), ln(m.notional**2 / m.nn), q[5], q[6], n / m.notional,
            ln(u.n), ln(u.notional), u.mean(), u.std(), u.signed / u.notional, u.side / u.notional, ln(um), ln(uc), c.n / u.n, c.notional / u.notional, ln(u.notional * 86400 / max(u.age, 1)), u.ema["d", 86_400],
        ]


@pytest.mark.parametrize("hot", [False, True])
def test_feature_pack_equals_walk(spark, hot):
    t = trades_ev(spark, f"{DATA}/sf0.001")
    m, r, a = pack_inputs(t)
    res, act = defaultdict(list), defaultdict(list)
    for row in r.collect():
        res[row["wallet_id"]].append(row)
    for row in a.collect():
        act[row["wallet_id"]].append(row)
    want = dict(walk(t.collect(), m.collect(), res, act))
    pack = features.feature_pack(t, m, r, a, hot=hot).collect()
    assert len(pack) == len(want)
    for row in pack:
        got = np.array(row[2:], float)
        bad = np.flatnonzero(np.abs(got - np.array(want[row["trade_id"]], float)) > 2e-4 * np.maximum(1, np.abs(got)))
        assert not len(bad), (row["trade_id"], [(i, got[i], want[row["trade_id"]][i]) for i in bad[:5]])


def test_large_components_go_in_stretches(spark, monkeypatch):
    """Components over STRETCH trades are walked in stretches of time, not by windows in two levels; some of them here."""
    t = trades_ev(spark, f"{DATA}/sf0.001").where("component_id < 2 or trade_id % 20 = 0")
    m, r, a = pack_inputs(t)
    whole = {row["trade_id"]: row for row in features.feature_pack(t, m, r, a, hot=False).collect()}
    monkeypatch.setattr(features, "HOT_ROWS", 150)
    monkeypatch.setattr(features, "STRETCH", 40)
    monkeypatch.setattr(features, "_levels", None)
    sizes = t.groupBy("component_id").agg(F.count("*").alias("n"))
    starts = features._stretches(t, sizes)
    assert features.has_hot_key(t) and {c for c, _, _ in starts} == {0, 1} and len(starts) > 8
    pack = features.feature_pack(t, m, r, a).collect()
    assert len(pack) == len(whole)
    for row in pack:
        got, want = np.array(row[2:], float), np.array(whole[row["trade_id"]][2:], float)
        bad = np.flatnonzero(np.abs(got - want) > 1e-6 * np.maximum(1, np.abs(want)))
        assert not len(bad), (row["trade_id"], [(i, got[i], want[i]) for i in bad[:5]])
    some = t.where("trade_id % 3 = 0").select("trade_id")
    few = features.feature_pack(t, m, r, a, only=some.union(some), keep=["price"])
    assert few.columns[2] == "price"
    got = {row["trade_id"]: tuple(row)[3:] for row in few.collect()}
    assert got == {row["trade_id"]: tuple(row)[2:] for row in pack if row["trade_id"] % 3 == 0}


def test_hot_keys_are_told_by_size(spark, monkeypatch):
    t = trades_ev(spark, f"{DATA}/sf0.001")
    assert not features.has_hot_key(t)
    monkeypatch.setattr(features, "HOT_ROWS", 50)
    assert features.has_hot_key(t)


def test_components_have_their_own_tasks(spark):
    """Large components never share a task, whatever their hashes; small ones keep together."""
    sizes = {0: 500, 1: 500, 2: 400, 3: 10, 4: 9, None: 8}
    rows = [(c, i) for c, n in sizes.items() for i in range(n)]
    t = spark.createDataFrame(rows, "component_id bigint, i int")
    dealt = features._dealt(t, t.groupBy("component_id").agg(F.count("*").alias("n"))).withColumn("p", F.spark_partition_id())
    at = {}
    for r in dealt.groupBy("component_id", "p").count().collect():
        at.setdefault(r["component_id"], []).append((r["p"], r["count"]))
    assert {c: [n for _, n in v] for c, v in at.items()} == {c: [n] for c, n in sizes.items()}
    assert len({at[c][0][0] for c in (0, 1, 2)}) == 3 and not {at[c][0][0] for c in (3, 4, None)} & {at[c][0][0] for c in (0, 1, 2)}

"""The causal feature pack: 128 features of every trade from wallet, market, component and universe state.

State includes the trade itself; gaps and the same-market flag look at the trade before. Three walks over sorted
batches give all state: the ledger's by stretches of time, each wallet's, each component's with its markets. A walk
costs one shuffle, and no result is joined back. A component of more than STRETCH trades goes in stretches of time: a
first pass reduces each to its totals, these are added up along each market and component, and the second pass walks
every stretch from the state before it. So no component or market is one task's work, and what is written is one table
of trades and shuffles in proportion. Only where a wallet has more than HOT_ROWS trades, all state of keys is windows
in two levels (key and day, then the totals of a key's days before), which write the growing rows many times.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.scalar import clamp, direction, lifecycle, phase, probability0, safe_ratio, weighted_std
from tideline.operators import asof, running
from tideline.operators.order import ORDER
from tideline.operators.running import _ema_scan
from tideline.operators.walks import State, Walk, estimate
from tideline.plans.shared import cut, partitions, tasks_for

#: Seconds of a day, half-lives of markets and components; and, in _columns(), the order of the features.
DAY = 86_400
MARKET_LIVES, COMPONENT_LIVES = (300, 3600, 21_600, 86_400, 604_800), (3600, 86_400, 604_800)
#: Trades of a wallet that one task may walk.
HOT_ROWS = 5_000_000
ACTOR = ["maker_fills", "taker_fills", "buy_fills", "sell_fills", "buy_notional", "sell_notional", "counterparties", "assets", "price_sum", "price_square"]


def actor_deltas(rows: DataFrame) -> DataFrame:
    """Per-window actor statistics as additive moments: price_sum and price_square merge like sums."""
    n = F.col("maker_fills") + F.col("taker_fills")
    m, s = F.col("average_price"), F.col("price_std")
    return rows.withColumns({"price_sum": m * n, "price_square": (s * s + m * m) * n}).select("wallet_id", "available", *ACTOR)


def _day() -> Column:
    return F.floor(F.col("timestamp_unix") / DAY)


def has_hot_key(trades: DataFrame, keys: tuple[str, ...] = ("wallet_id", "component_id")) -> bool:
    """Whether a wallet or a component (and so maybe a market) has more than HOT_ROWS trades."""
    largest = None
    for key in keys:
        n = trades.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))
        largest = n if largest is None else largest.unionByName(n)
    return (largest.agg(F.max("n")).first()[0] or 0) > HOT_ROWS


def _sums(t: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    # every two-level step reads its input twice: it starts from a table, so that plans don't double
    return running.keyed_prefix(cut(t, "features"), key, _day(), sums)


def _moments(t: DataFrame, key: str, prefix: str) -> DataFrame:
    return running.split_moments(cut(t, "features"), key, prefix, _day())


def _sketch(t: DataFrame, key: str, item: str, name: str) -> DataFrame:
    return running.running_sketch(cut(t, "features"), key, item, name, bucket=_day())


def _wallet(t: DataFrame) -> DataFrame:
    t = running.keyed_lag(cut(_moments(t, "wallet_id", "w"), "features"), "wallet_id", _day(), "market_id", "w_prev")
    t = t.withColumn("w_first", F.col("w_count") == 1)
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    outcome = F.when(F.col("outcome_index") == 0, 1).otherwise(-1)
    switch = F.when(F.col("w_prev") != F.col("market_id"), 1).otherwise(0)
    return _sums(t, "wallet_id", {"w_sides": sign, "w_outcomes": outcome, "w_gaps": F.col("w_gap"), "w_switches": switch})


def _universe(t: DataFrame) -> DataFrame:
    """Counts, sums, sketches of markets and components, gap and age over the whole ledger."""
    for item in ("market_id", "component_id"):
        # only the first trade of an item can raise a register; raises are few, whatever the ledger: registers * ranks
        firsts = t.groupBy(item).agg(F.min(F.struct(*ORDER)).alias("_f")).select("_f.*", running.register_rank(F.col(item).cast("bigint")).alias("_h"))
        firsts = firsts.select(*ORDER, F.col("_h.register").alias("_reg"), F.col("_h.rank").alias("_rank"))
        before = W.partitionBy("_reg").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
        raised = firsts.withColumn("_old", F.coalesce(F.max("_rank").over(before), F.lit(0))).where(F.col("_rank") > F.col("_old"))
        raised = raised.select("trade_id", (F.pow(F.lit(2.0), -F.col("_rank")) - F.pow(F.lit(2.0), -F.col("_old"))).alias(f"_ds_{item}"), F.when(F.col("_old") == 0, -1).otherwise(0).alias(f"_dz_{item}"))
        t = t.join(F.broadcast(raised), "trade_id", "left").fillna({f"_ds_{item}": 0.0, f"_dz_{item}": 0})
    n, day = F.col("notional_usd"), F.floor(F.col("timestamp_unix") / DAY)
    sums = {"u_count": F.lit(1), "u_notional": n, "u_pn": F.col("p0") * n, "u_ppn": F.col("p0") * F.col("p0") * n, "u_signed": F.col("direction") * n, "u_buy": F.when(F.col("side") == "BUY", n).otherwise(0.0)}
    sums |= {f"u_{k}_{item}": F.col(f"_{k}_{item}") for k in ("ds", "dz") for item in ("market_id", "component_id")}
    ends = t.groupBy(day.alias("_d")).agg(F.max("timestamp_unix").alias("_max"), F.min("timestamp_unix").alias("_min"))
    over = W.orderBy("_d").rowsBetween(W.unboundedPreceding, -1)  # one row per day
    ends = ends.select("_d", F.max("_max").over(over).alias("_before"), F.min("_min").over(W.partitionBy()).alias("_start"))
    t = running.global_prefix(t, day, sums).withColumn("_d", day)
    t = t.withColumn("_lag", F.lag("timestamp_unix").over(W.partitionBy("_d").orderBy(*ORDER))).join(ends, "_d")
    t = t.withColumns({"u_gap": F.coalesce(F.col("timestamp_unix") - F.coalesce("_lag", "_before"), F.lit(0)), "u_age": F.col("timestamp_unix") - F.col("_start")})
    for item in ("market_id", "component_id"):
        t = t.withColumn(f"u_{item}s", running.estimate(running.REGISTERS + F.col(f"u_ds_{item}"), running.REGISTERS + F.col(f"u_dz_{item}")))
    return t


# --- keys that a task can hold: one walk for wallets, one for markets and components, one for the ledger ---

#: Trades of a stretch of time that is walked by itself, of the ledger or of a component.
STRETCH = 500_000
SUMS = ["count", "notional", "size", "signed", "buy", "o0", "pn", "ppn", "nn"]
MEASURES = ["count", "notional", "size", "flow", "side", "outcome", "mean", "std", "min", "max", "gap", "age", "hhi", "velocity"]
TRADE = ["trade_id", "timestamp_unix", "wallet_id", "market_id", "component_id", "size", "notional_usd", "p0", "raw", "direction", "buy", "o0"]
RESOLVED = ["r_n", "r_edge", "r_pnl", "r_wins"]
EMBEDDING = [f"d{i}" for i in range(7)]
#: Marks the trades whose features are wanted, where not all are.
WANTED = "_wanted"


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b != 0)


def _spread(total: np.ndarray, square: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(_ratio(square, weight) - _ratio(total, weight) ** 2, 0))


def _values(b: dict[str, np.ndarray]) -> np.ndarray:
    """What is summed of each trade, in the order of SUMS."""
    n, p = b["notional_usd"], b["p0"]
    return np.stack([np.ones(len(n)), n, b["size"], n * b["direction"], n * b["buy"], n * b["o0"], p * n, p * p * n, n * n], 1)


def _measures(out: dict[str, np.ndarray], prefix: str) -> dict[str, np.ndarray]:
    s = {k: out["sums"][:, i] for i, k in enumerate(SUMS)}
    n, age = s["notional"], out["age"].astype(float)
    named = [
        s["count"], n, s["size"], _ratio(s["signed"], n), _ratio(2 * s["buy"] - n, n), _ratio(2 * s["o0"] - n, n), _ratio(s["pn"], n), _spread(s["pn"], s["ppn"], n), out["low"], out["high"],
        out["gap"].astype(float), age, _ratio(s["nn"], n * n), n * 86_400 / np.maximum(age, 1),
    ]
    return {f"{prefix}_{k}": v for k, v in zip(MEASURES, named)}


def _arrays(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    return {c: pdf[c].to_numpy() for c in pdf.columns}


def _schema(df: DataFrame, columns: Iterable[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + "".join(f", {c} double" for c in columns)


def _ledger_walk(t: DataFrame) -> DataFrame:
    """The ledger's own state after each trade: stretches of time are walked side by side from the totals before them."""
    hour = F.floor(F.col("timestamp_unix") / 3600).cast("bigint")
    hours = t.groupBy(hour.alias("_h")).agg(F.count("*").alias("n")).orderBy("_h").toPandas()  # a row per hour
    part = (np.cumsum(hours["n"].to_numpy()) - 1) // STRETCH
    starts = [int(h) for h, new in zip(hours["_h"], np.diff(part, prepend=-1)) if new]
    # only the first trade of an item can raise a register; raises are few, whatever the ledger: registers * ranks
    items = t.select(*ORDER, F.posexplode(F.array(F.col("market_id").cast("bigint"), F.col("component_id").cast("bigint"))).alias("k", "item"))
    firsts = items.groupBy("k", "item").agg(F.min(F.struct(*ORDER)).alias("f")).select("k", "f.*", running.register_rank(F.col("item")).alias("h")).select("k", *ORDER, "h.register", "h.rank")
    before = W.partitionBy("k", "register").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
    raised = firsts.withColumn("old", F.coalesce(F.max("rank").over(before), F.lit(0))).where(F.col("rank") > F.col("old"))
    raises: list[dict] = [{}, {}]
    for r in raised.select("k", "trade_id", "rank", "old").collect():
        raises[r["k"]][r["trade_id"]] = (2.0 ** -r["rank"] - 2.0 ** -r["old"], -1.0 * (r["old"] == 0))
    names = [*(f"u_{k}" for k in ("count", "notional", "pn", "ppn", "signed", "buy", "gap", "age", "market_ids", "component_ids")), f"u_ema_direction_{DAY}"]

    def values(b: dict[str, np.ndarray]) -> np.ndarray:
        n, p = b["notional_usd"], b["p0"]
        changes = [[r.get(i, (0.0, 0.0)) for i in b["trade_id"].tolist()] for r in raises]
        return np.concatenate([np.stack([np.ones(len(n)), n, p * n, p * p * n, n * b["direction"], n * b["buy"]], 1), *(np.array(c, float).reshape(len(n), 2) for c in changes)], 1)

    def stretch(pdf: pd.DataFrame) -> np.ndarray:
        return np.searchsorted(starts, pdf["timestamp_unix"].to_numpy() // 3600, side="right") - 1

    @F.pandas_udf("int")
    def numbered(ts: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, ts.to_numpy() // 3600, side="right") - 1)

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("_s", numbered("timestamp_unix")).repartition(min(max(1, len(starts)), 4 * partitions(t.sparkSession)), "_s").sortWithinPartitions("_s", *ORDER)

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums, ends and the average's step of each stretch."""
        held: dict[int, list] = {}
        for pdf in batches:
            b, s = _arrays(pdf), stretch(pdf)
            v, ts, d = values(b), b["timestamp_unix"], b["direction"].astype(float)
            for k in np.unique(s).tolist():
                at = s == k
                now = held.get(k)
                start, last = (0.0, int(ts[at][0])) if now is None else (now[4], now[2])
                step = _ema_scan(ts[at], d[at], DAY, start, last)[-1]
                held[k] = [v[at].sum(0) + (0 if now is None else now[0]), int(ts[at][0]) if now is None else now[1], int(ts[at][-1]), float(d[at][0]) if now is None else now[3], step]
        for k, (v, a, z, f, step) in held.items():
            yield pd.DataFrame({"s": [k], "v": [v.tolist()], "a": [a], "z": [z], "f": [f], "e": [step]})

    ends = pd.DataFrame()
    if len(starts) > 1:
        summed = placed(t.select(*ORDER, "notional_usd", "p0", "direction", "buy")).mapInPandas(totals, "s int, v array<double>, a bigint, z bigint, f double, e double")
        ends = cut(summed, "stretches").toPandas().sort_values("s")  # a row per stretch
    carried: dict[int, State] = {}
    total, mean, last, first = np.zeros(10), 0.0, None, None
    total[[6, 7, 8, 9]] = running.REGISTERS
    for r in ends.itertuples():
        if last is not None:
            carried[r.s] = State(total.copy(), np.nan, np.nan, first, last, np.nan, np.array([mean]))
        # a stretch acts on the state at its first trade as one affine step, whose average starts at its first value
        start, wait = (r.f, 0) if last is None else (mean, r.a - last)
        d0, d1 = 2.0 ** (-wait / DAY), 2.0 ** (-(r.z - r.a) / DAY)
        mean = d1 * (d0 * start + (1 - d0) * r.f) + r.e
        total, last, first = total + np.array(r.v), r.z, r.a if first is None else first

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = Walk([(0, DAY)])
        for pdf in batches:
            b, s = _arrays(pdf), stretch(pdf)
            for k in np.unique(s).tolist():
                if k not in w.states:
                    fresh = np.zeros(10)
                    fresh[[6, 7, 8, 9]] = running.REGISTERS
                    if k in carried:
                        w.states[k] = carried[k]
                    else:
                        w.states[k] = State(fresh, np.nan, np.nan, int(b["timestamp_unix"][s == k][0]), int(b["timestamp_unix"][s == k][0]), np.nan, np.array([float(b["direction"][s == k][0])]))
            out = w.step(s, b["timestamp_unix"], values(b), b["p0"], b["direction"].astype(float)[:, None])
            w.keep([s[-1]] if len(s) else [])
            u = out["sums"]
            made = [*u[:, :6].T, out["gap"], out["age"], estimate(u[:, 6], np.rint(u[:, 7])), estimate(u[:, 8], np.rint(u[:, 9])), out["averages"][:, 0]]
            yield pdf.drop(columns="_s").assign(**dict(zip(names, made)))

    out = placed(t).mapInPandas(walk, _schema(t, names))
    # what only features of wanted trades read is not carried for others
    return out.withColumns({c: F.when(F.col(WANTED) == 1, F.col(c)) for c in names}) if WANTED in t.columns else out


def _wallet_walk(t: DataFrame, resolutions: DataFrame, actor: DataFrame | None) -> DataFrame:
    """A wallet's state after each trade, with resolutions strictly before it and actor deltas from their availability on.

    What becomes known is a row of the wallet's stream: at equal times it comes after trades, so these do not see it.
    """
    known = [*RESOLVED, *(f"a_{c}" for c in ACTOR)]
    state = [*(f"w_{k}" for k in MEASURES), "w_same", "w_sides", "w_outcomes", "w_gaps", "w_switches", *known, *EMBEDDING, "known", "resolved"]
    zero = {k: F.lit(0.0) for k in known}
    row = F.struct(*t.columns)
    rows = t.select(F.col("wallet_id").alias("_k"), F.col("timestamp_unix").alias("_t"), F.lit(0).alias("_kind"), row.alias("_row"), *(v.alias(k) for k, v in zero.items()))
    none = F.lit(None).cast(rows.schema["_row"].dataType)

    def news(df: DataFrame, ts: Column, values: dict[str, Column]) -> DataFrame:
        return df.select(F.col("wallet_id").alias("_k"), ts.cast("bigint").alias("_t"), F.lit(1).alias("_kind"), none.alias("_row"), *(values.get(k, v).cast("double").alias(k) for k, v in zero.items()))

    won = F.when(F.col("pnl") > 0, 1).otherwise(0)
    rows = rows.unionByName(news(resolutions, F.col("resolution_ts"), {"r_n": F.lit(1), "r_edge": F.coalesce("edge", F.lit(0.0)), "r_pnl": F.coalesce("pnl", F.lit(0.0)), "r_wins": won}))
    if actor is not None:
        # available at a second means visible at it: one second earlier makes the strict form inclusive
        rows = rows.unionByName(news(actor, F.col("available") - 1, {f"a_{c}": F.coalesce(c, F.lit(0.0)) for c in ACTOR}))
    flat = rows.select("_k", "_t", "_kind", *(F.col(f"_row.{c}").alias(c) for c in t.columns), *known)

    whole = {f.name: "int64" for f in t.schema.fields if f.dataType.simpleString() in ("int", "bigint")}
    columns = t.columns

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        facts, own, later = Walk(), Walk(), Walk()
        for pdf in batches:
            keys, empty = pdf["_k"].to_numpy(), np.zeros((len(pdf), 0))
            seen = facts.step(keys, pdf["_t"].to_numpy(), pdf[known].to_numpy(float), np.zeros(len(pdf)), empty)["sums"]
            trade = pdf["_kind"].to_numpy() == 0
            kept = pdf.loc[trade, columns].astype(whole).reset_index(drop=True)
            b, keys, empty = _arrays(kept), keys[trade], empty[trade]
            if len(kept):
                market = b["market_id"].astype(object)
                out = own.step(keys, b["timestamp_unix"], np.concatenate([_values(b), (2.0 * b["buy"] - 1)[:, None], (2.0 * b["o0"] - 1)[:, None]], 1), b["p0"], empty, previous=market)
                same, first = out["previous"] == market, np.equal(out["previous"], None)
                more = later.step(keys, b["timestamp_unix"], np.stack([out["gap"], ~same & ~first], 1).astype(float), b["p0"], empty)["sums"]
                made = _measures(out, "w") | dict(zip(known, seen[trade].T))
                made |= {"w_same": same.astype(float), "w_sides": out["sums"][:, -2], "w_outcomes": out["sums"][:, -1], "w_gaps": more[:, 0], "w_switches": more[:, 1]}
                fills = made["a_maker_fills"] + made["a_taker_fills"]
                recency = np.where(made["w_count"] == 1, 1.0, np.minimum(np.log1p(made["w_gap"]) / 20, 1.0))
                d = [
                    np.log1p(made["w_count"]) / 20, np.log1p(made["w_notional"]) / 24, _ratio(made["r_edge"], made["r_n"]), np.tanh(_ratio(made["r_pnl"], made["r_n"]) / 100),
                    _ratio(made["a_maker_fills"], fills), recency, 1 / np.sqrt(made["w_count"]),
                ]
                made |= dict(zip(EMBEDDING, d)) | {"known": (fills > 0).astype(float), "resolved": (made["r_n"] > 0).astype(float)}
                yield kept.assign(**{c: made[c] for c in state})
            for w in (facts, own, later):
                w.keep(pdf["_k"].to_numpy()[-1:])

    dealt = flat.repartition(partitions(t.sparkSession), "_k").sortWithinPartitions("_k", "_t", "_kind", "trade_id")
    out = dealt.mapInPandas(walk, _schema(t, state)).withColumn("w_prev", F.when(F.col("w_same") == 1, F.col("market_id")))
    # the wallet's features are known now: one array of floats instead of its state
    done = F.array(*(F.coalesce(v.cast("double"), F.lit(0.0)).cast("float") for v in _wallet_columns()))
    return out.select(*t.columns, *EMBEDDING, "known", "resolved", (F.when(F.col(WANTED) == 1, done) if WANTED in t.columns else done).alias("w_features"))


def _dealt(t: DataFrame, sizes: DataFrame, stretches: Sequence[int] = ()) -> DataFrame:
    """Rows by component, or by stretch of one; what holds more than a task's share has a task of its own, largest first.

    sizes(component_id, n); stretches are the sizes of those numbered in _s, which is -1 for components that are whole.
    There are fewer whole components of such a size than tasks, and a few times as many stretches at most.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    tasks = tasks_for(t.sparkSession, total, STRETCH)
    whole = F.col("component_id").isNotNull() & (F.col("n") * tasks > total)
    if stretches:
        whole = whole & (F.col("n") <= STRETCH)
    large = [(r["n"], None, r["component_id"]) for r in sizes.where(whole).orderBy(F.desc("n"), "component_id").collect()]
    units = sorted([*large, *((n, i, None) for i, n in enumerate(stretches))], key=lambda u: -u[0])
    if not units:
        return t.repartition(tasks, "component_id")

    def task(c: Column) -> Column:
        return F.pmod(F.hash(c), F.lit(tasks))

    # a number for each task that repartition() deals there
    numbers = t.sparkSession.range(64 * tasks).groupBy(task(F.col("id")).alias("task")).agg(F.min("id").alias("id")).orderBy("task")
    numbers = [r["id"] for r in numbers.collect()]
    loads = [(0, i) for i in range(len(numbers))]
    own, placed = [], [0] * len(stretches)
    for n, stretch, component in units:
        load, i = heapq.heappop(loads)
        heapq.heappush(loads, (load + n, i))
        if stretch is None:
            own += [F.lit(component), F.lit(numbers[i])]
        else:
            placed[stretch] = numbers[i]
    free = [numbers[i] for load, i in sorted(loads) if load == 0] or numbers
    at = F.get(F.array(*map(F.lit, free)), F.pmod(F.hash("component_id"), F.lit(len(free))))
    if own:
        at = F.coalesce(F.try_element_at(F.create_map(*own), F.col("component_id")), at)
    if placed:
        at = F.when(F.col("_s") >= 0, F.get(F.array(*map(F.lit, placed)), F.col("_s"))).otherwise(at)
    return t.withColumn("_task", at.cast("bigint")).repartition(tasks, "_task").drop("_task")


#: Half-lives of a market's and a component's averages, by what is averaged.
MEANS = [(c, h) for c in ("p0", "direction") for h in MARKET_LIVES], [(c, h) for c in ("p0", "direction") for h in COMPONENT_LIVES]


def _crowd_walks() -> tuple[Walk, Walk]:
    market, component = (Walk([(int(c == "direction"), h) for c, h in m], sketch=True) for m in MEANS)
    return market, component


def _crowd_step(market: Walk, component: Walk, b: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """State of the market, with notional-weighted moments of the wallets that traded, and of the component."""
    ts, values, averaged = b["timestamp_unix"], _values(b), np.stack([b["p0"], b["direction"].astype(float)], 1)
    d = np.stack([b[c] for c in (*EMBEDDING, "known", "resolved")], 1)
    weighted = np.concatenate([d, d[:, :4] ** 2], 1) * b["notional_usd"][:, None]
    m = market.step(b["market_id"], ts, np.concatenate([values, weighted], 1), b["p0"], averaged, item=b["wallet_id"])
    return m, component.step(b["component_id"], ts, values, b["p0"], averaged, item=b["market_id"])


def _runs(pdf: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    """A batch by stretch, in order; -1 where components are whole."""
    if "_s" not in pdf.columns:
        yield -1, pdf
        return
    s = pdf["_s"].to_numpy()
    edges = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
    for lo, hi in zip(edges, edges[1:]):
        if lo < hi:
            yield int(s[lo]), pdf.iloc[lo:hi].reset_index(drop=True)


def _stretches(trades: DataFrame, sizes: DataFrame) -> list[tuple[object, int, int]]:
    """component_id, first hour and trades of each stretch, in order, of components over STRETCH trades."""
    large = [r["component_id"] for r in sizes.where(F.col("component_id").isNotNull() & (F.col("n") > STRETCH)).collect()]
    if not large:
        return []
    hour = F.floor(F.col("timestamp_unix") / 3600).cast("bigint")
    hours = trades.where(F.col("component_id").isin(large)).groupBy("component_id", hour.alias("h")).agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(W.partitionBy("component_id").orderBy("h").rowsBetween(W.unboundedPreceding, W.currentRow))
    parts = hours.withColumn("p", F.floor((so_far - 1) / STRETCH)).groupBy("component_id", "p").agg(F.min("h").alias("h"), F.sum("n").alias("n"))
    return [(r["component_id"], r["h"], r["n"]) for r in parts.orderBy("component_id", "h").select("component_id", "h", "n").collect()]


def _numbered(starts: list[tuple[object, int, int]]) -> Column:
    """The number of a trade's stretch, -1 where its component is whole."""
    of: dict = {}
    for i, (component, hour, _) in enumerate(starts):
        of.setdefault(component, (i, []))[1].append(hour)

    @F.pandas_udf("int")
    def number(component: pd.Series, ts: pd.Series) -> pd.Series:
        out, hours = np.full(len(ts), -1, np.int32), ts.to_numpy() // 3600
        for c, (base, first) in of.items():
            at = (component == c).to_numpy(bool)
            out[at] = base + np.searchsorted(first, hours[at], side="right") - 1
        return pd.Series(out)

    return number("component_id", "timestamp_unix")


def _packed(s: State, first: np.ndarray) -> np.ndarray:
    return np.concatenate([s.sums, [s.low, s.high, s.first, s.last], s.averages, first, s.registers]).astype(float)


def _unpacked(v: np.ndarray, averages: int) -> tuple[State, np.ndarray]:
    """The state in an array of _packed(), and the first values that were averaged."""
    w = len(v) - 4 - 2 * averages - running.REGISTERS
    sums, (low, high, first, last), means, values, registers = np.split(v, [w, w + 4, w + 4 + averages, w + 4 + 2 * averages])
    return State(sums, low, high, int(first), int(last), None, means, registers.astype(np.int32)), values


def _after(before: np.ndarray, v: np.ndarray, lives: np.ndarray) -> np.ndarray:
    """The state after a stretch that was walked by itself, from the state before it."""
    (a, start), (z, first) = _unpacked(before, len(lives)), _unpacked(v, len(lives))
    # walked by itself, averages start at its first value
    means = z.averages + np.exp2(-(z.last - a.last) / lives) * (a.averages - first)
    return _packed(State(a.sums + z.sums, min(a.low, z.low), max(a.high, z.high), a.first, z.last, None, means, np.maximum(a.registers, z.registers)), start)


def _states(t: DataFrame, sizes: DataFrame, stretches: Sequence[int]) -> DataFrame:
    """component_id, market_id, _s, _kind (0 of a market, 1 of a component), _v: states before stretches, where there is one."""
    kinds = [np.array([float(h) for _, h in m]) for m in MEANS]
    narrow = t.where("_s >= 0").select("_s", *(c for c in TRADE if c != "raw"), *EMBEDDING, "known", "resolved")

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, walks, firsts = None, _crowd_walks(), ({}, {})

        def found() -> pd.DataFrame:
            rows = []
            for kind, walk in enumerate(walks):
                which = [c for c, _ in walk.averages]
                for k, s in walk.states.items():
                    component, member, averaged = firsts[kind][k]
                    rows.append((at, component, member, kind, f"{kind}/{k}", _packed(s, averaged[which])))
            return pd.DataFrame(rows, columns=["_s", "component_id", "market_id", "_kind", "_key", "_v"])

        for pdf in batches:
            for s, part in _runs(pdf):
                if s != at:
                    if at is not None:
                        yield found()
                    at, walks, firsts = s, _crowd_walks(), ({}, {})
                b = _arrays(part)
                for kind, key in enumerate(("market_id", "component_id")):
                    keys, i = np.unique(b[key], return_index=True)
                    for k, j in zip(keys.tolist(), i.tolist()):
                        if k not in firsts[kind]:
                            firsts[kind][k] = b["component_id"][j], b["market_id"][j], np.array([b["p0"][j], b["direction"][j]], float)
                _crowd_step(*walks, b)
        if at is not None:
            yield found()

    def before(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            out = []
            for key, kind, v in zip(pdf["_key"], pdf["_kind"], pdf["_v"]):
                if key != now:
                    now, state = key, None
                out.append(state)
                state = v if state is None else _after(state, v, kinds[kind])
            yield pdf.assign(_v=out).drop(columns="_key")[[v is not None for v in out]]

    types = {c: t.schema[c].dataType.simpleString() for c in ("component_id", "market_id")}
    schema = f"_s int, component_id {types['component_id']}, market_id {types['market_id']}, _kind int"
    summed = _dealt(narrow, sizes, stretches).sortWithinPartitions("_s", *ORDER).mapInPandas(totals, f"{schema}, _key string, _v array<double>")
    ordered = summed.repartition(partitions(t.sparkSession), "_key").sortWithinPartitions("_key", "_s")
    return cut(ordered.mapInPandas(before, f"{schema}, _v array<double>"), "states")


def _market_walk(t: DataFrame, sizes: DataFrame, starts: list[tuple[object, int, int]]) -> DataFrame:
    """The state of a trade's market and component after it, in one pass over each component's trades.

    A market belongs to one component, so its trades come in the component's stream; markets of a component are few.
    A component that has starts comes in stretches, each behind the states before it.
    """
    crowd = [f"s_{c}" for c in (*EMBEDDING, "known", "resolved")] + [f"q_d{i}" for i in range(4)]
    state = [
        *(f"m_{k}" for k in MEASURES), "m_wallets", *crowd, "m_nn", *(f"m_ema_{c}_{h}" for c, h in MEANS[0]),
        *(f"c_{k}" for k in MEASURES), "c_markets", *(f"c_ema_{c}_{h}" for c, h in MEANS[1]),
    ]
    schema, columns, stretches = _schema(t, state), t.columns, [n for _, _, n in starts]
    if starts:
        # read by both passes
        t = cut(t.withColumn("_s", _numbered(starts)), "features")
        states = _states(t, sizes, stretches)
        none = {f.name: F.lit(0 if f.dataType.simpleString() in ("int", "bigint", "double") else None).cast(f.dataType).alias(f.name) for f in t.schema.fields}
        given = ("_s", "component_id", "market_id")
        t = t.withColumns({"_kind": F.lit(0), "_v": F.lit(None).cast("array<double>")}).unionByName(states.select(*(c if c in given else none[c] for c in t.columns), "_kind", "_v"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        market, component = _crowd_walks()
        of: dict = {}
        at = -1
        for batch in batches:
            for s, pdf in _runs(batch):
                if s != at:
                    at, market.states, component.states = s, {}, {}
                if s >= 0:
                    carried = pdf["_v"].notna().to_numpy()
                    for kind, m, c, v in pdf.loc[carried, ["_kind", "market_id", "component_id", "_v"]].itertuples(index=False):
                        (component if kind else market).states[c if kind else m] = _unpacked(v, len(MEANS[kind]))[0]
                    pdf = pdf[~carried].reset_index(drop=True)
                if not len(pdf):
                    continue
                b, pdf = _arrays(pdf), pdf[columns]
                m, c = _crowd_step(market, component, b)
                made = _measures(m, "m") | _measures(c, "c") | {"m_wallets": m["distinct"], "c_markets": c["distinct"], "m_nn": m["sums"][:, SUMS.index("nn")]}
                made |= dict(zip(crowd, m["sums"][:, len(SUMS) :].T)) | {f"m_ema_{x}_{h}": v for (x, h), v in zip(MEANS[0], m["averages"].T)} | {f"c_ema_{x}_{h}": v for (x, h), v in zip(MEANS[1], c["averages"].T)}
                out = pd.concat([pdf, pd.DataFrame({k: made[k] for k in state})], axis=1)
                yield out[out[WANTED] == 1] if WANTED in columns else out
                if s < 0:
                    # markets of the last component may go on
                    keys = b["component_id"]
                    of = {keys[-1]: of.get(keys[-1], set()) | set(b["market_id"][keys == keys[-1]].tolist())}
                    market.keep(list(of[keys[-1]]))
                    component.keep(keys[-1:])

    order = ["component_id", "_s", F.col("_v").isNull()] if starts else ["component_id"]
    return _dealt(t, sizes, stretches).sortWithinPartitions(*order, *ORDER).mapInPandas(walk, schema)


def _walked(trades: DataFrame, resolutions: DataFrame, actor: DataFrame | None, only: DataFrame | None, keep: Sequence[str]) -> DataFrame:
    """All state by three walks: the ledger's on narrow rows first, markets' on the widest last, and nothing is joined."""
    flags = {"raw": clamp("price", 0.0, 1.0), "p0": probability0(), "direction": direction().cast("int"), "buy": F.when(F.col("side") == "BUY", 1).otherwise(0), "o0": F.when(F.col("outcome_index") == 0, 1).otherwise(0)}
    t = trades.withColumns(flags).select(*dict.fromkeys([*TRADE, "side", "outcome_index", *keep]))
    if only is not None:
        t = t.join(only.withColumn(WANTED, F.lit(1)), "trade_id", "left").fillna({WANTED: 0})
    sizes = cut(trades.groupBy("component_id").agg(F.count("*").alias("n")), "sizes")
    return _market_walk(_wallet_walk(_ledger_walk(t), resolutions, actor), sizes, _stretches(trades, sizes))


def _levels(trades: DataFrame, resolutions: DataFrame, actor: DataFrame | None) -> DataFrame:
    """All state by windows in two levels."""
    t = trades.withColumns({"p0": probability0(), "direction": direction(), "raw": clamp("price", 0.0, 1.0)})
    n, ln = F.col("notional_usd"), F.log1p

    # wallets, with resolutions strictly before the trade and actor deltas from their availability on
    t = _wallet(t)
    t = asof.strict_asof_sums(t, resolutions, "wallet_id", "timestamp_unix", "resolution_ts", {"r_n": F.lit(1), "r_edge": F.col("edge"), "r_pnl": F.col("pnl"), "r_wins": F.when(F.col("pnl") > 0, 1).otherwise(0)}, "trade_id")
    if actor is None:
        t = t.withColumns({f"a_{c}": F.lit(0.0) for c in ACTOR})
    else:
        # available at a second means visible at it: one second earlier makes the strict form inclusive
        deltas = actor.withColumn("visible", F.col("available") - 1)
        t = asof.strict_asof_sums(t, deltas, "wallet_id", "timestamp_unix", "visible", {f"a_{c}": F.col(c) for c in ACTOR}, "trade_id")
    fills = F.col("a_maker_fills") + F.col("a_taker_fills")
    known = fills > 0
    edge, pnl = safe_ratio("r_edge", "r_n"), safe_ratio("r_pnl", "r_n")
    recency = F.when(F.col("w_first"), 1.0).otherwise(F.least(ln("w_gap") / 20, F.lit(1.0)))
    embedding = [ln("w_count") / 20, ln("w_notional") / 24, edge, F.tanh(pnl / 100), safe_ratio("a_maker_fills", fills), recency, 1 / F.sqrt("w_count")]
    t = t.withColumns({f"d{i}": v for i, v in enumerate(embedding)} | {"known": known.cast("double"), "resolved": (F.col("r_n") > 0).cast("double")})

    # markets, with notional-weighted moments of the wallets that traded
    t = _moments(t, "market_id", "m")
    t = _sketch(t, "market_id", "wallet_id", "m_wallets")
    moments = {f"s_{c}": F.col(c) * n for c in (*(f"d{i}" for i in range(7)), "known", "resolved")}
    moments |= {f"q_d{i}": F.col(f"d{i}") * F.col(f"d{i}") * n for i in range(4)}
    t = _sums(t, "market_id", moments | {"m_nn": n * n})
    t = _moments(t, "component_id", "c")
    t = _sketch(t, "component_id", "market_id", "c_markets")
    t = _universe(cut(t, "features"))

    keys = trades.withColumns({"p0": probability0(), "direction": direction()})
    for key, prefix, values, lives in (("market_id", "m", ["p0", "direction"], MARKET_LIVES), ("component_id", "c", ["p0", "direction"], COMPONENT_LIVES), ("one", "u", ["direction"], (DAY,))):
        e = running.chunked_ema(keys.withColumn("one", F.lit(0)), key, values, lives)
        t = t.join(e.select("trade_id", *(F.col(f"ema_{v}_{h}").alias(f"{prefix}_ema_{v}_{h}") for v in values for h in lives)), "trade_id")
    return t


def feature_pack(
    trades: DataFrame, markets: DataFrame, resolutions: DataFrame, actor: DataFrame | None = None, hot: bool | None = None, only: DataFrame | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """trade_id, timestamp_unix and the features f_000 .. f_127 of every trade, or of those in only(trade_id).

    markets(market_id, component_id, created, end_ts, neg_risk, unclosed); resolutions(wallet_id,
    resolution_ts, edge, pnl); actor as actor_deltas() gives it, visible from `available` on. hot: state of
    keys in two levels; if it is not given, has_hot_key() of wallets decides. keep: columns of trades, without nulls, that are returned too.
    """
    hot = has_hot_key(trades, ("wallet_id",)) if hot is None else hot
    only = None if only is None else cut(only.select("trade_id").distinct(), "wanted")
    by = markets.groupBy("component_id").agg(F.count("*").alias("k_n"), F.avg(F.col("neg_risk").cast("double")).alias("k_neg"), F.avg(F.col("unclosed").cast("double")).alias("k_open"))
    # a table, whose size the optimizer knows: else the widest rows might be shuffled to meet it
    static = cut(markets.select("market_id", "component_id", "created", "end_ts").join(by, "component_id").drop("component_id"), "markets")
    if hot:
        t = _levels(trades, resolutions, actor)
        t = t if only is None else t.join(only, "trade_id", "left_semi")
        wallet = _wallet_columns()
    else:
        t = _walked(trades, resolutions, actor, only, keep)
        wallet = [F.get("w_features", F.lit(i)) for i in range(len(_wallet_columns()))]
    t = t.join(static, "market_id", "left")

    own = [c for c in keep if c not in ("trade_id", "timestamp_unix")]
    return t.select("trade_id", "timestamp_unix", *own, *(F.coalesce(v.cast("double"), F.lit(0.0)).cast("float").alias(f"f_{i:03d}") for i, v in enumerate(_columns(wallet))))


def _wallet_columns() -> list[Column]:
    """Features of the wallet's own state."""
    n, ln, c = F.col("notional_usd"), F.log1p, F.col
    known = c("known") > 0

    def actor(v: Column) -> Column:
        return F.when(known, v).otherwise(0.0)

    rest = F.greatest(c("w_count") - 1, F.lit(1))
    fills = c("a_maker_fills") + c("a_taker_fills")
    sides = c("a_buy_fills") + c("a_sell_fills")
    return [
        ln("w_count"), ln("w_notional"), ln("w_size"), c("w_sides") / c("w_count"), c("w_outcomes") / c("w_count"), c("w_flow"), c("w_mean"), c("w_std"), c("d5"), ln(c("w_gaps") / rest), c("w_switches") / rest, F.when(c("w_prev") == c("market_id"), 1).otherwise(0), safe_ratio(n, "w_notional"),
        ln("r_n"), safe_ratio("r_edge", "r_n"), safe_ratio("r_pnl", "r_n"), safe_ratio("r_wins", "r_n"), c("known"),
        actor(ln("a_maker_fills")), actor(ln("a_taker_fills")), actor(safe_ratio("a_maker_fills", fills)), actor(safe_ratio(c("a_buy_fills") - c("a_sell_fills"), sides)), actor(ln(c("a_buy_notional") + c("a_sell_notional"))), actor(ln("a_counterparties")), actor(ln("a_assets")), actor(safe_ratio("a_price_sum", fills)), actor(weighted_std("a_price_sum", "a_price_square", fills)), c("d6"),
    ]


def _columns(wallet: list[Column]) -> list[Column]:
    """All features in their order; the wallet's are given."""
    n, ln, ts, c = F.col("notional_usd"), F.log1p, F.col("timestamp_unix"), F.col
    (ds, dc), (ws, wc) = phase(ts, DAY), phase(ts, 7 * DAY)
    elapsed, remaining = lifecycle(ts, "created", "end_ts")

    def ema(prefix: str, value: str, lives: tuple[int, ...]) -> list[Column]:
        return [c(f"{prefix}_ema_{value}_{h}") for h in lives]

    market_p = ema("m", "p0", MARKET_LIVES)
    u_mean = safe_ratio("u_pn", "u_notional")
    clock = [ln("u_count"), ln("u_notional"), ln(c("u_age") / DAY), ds, dc, ws, wc, ln("u_gap")]
    market = [
        ln("m_count"), ln("m_notional"), ln("m_size"), c("p0"), c("raw"), c("outcome_index"), F.when(c("side") == "BUY", 1).otherwise(0), ln(n), ln("size"), c("m_flow"), c("m_side"), c("m_outcome"), c("m_mean"), c("m_std"), c("m_min"), c("m_max"),
        ln("m_gap"), ln("m_age"), ln("m_wallets"), ln(c("m_count") / F.greatest("m_wallets", F.lit(1.0))), c("m_hhi"), safe_ratio(n, "m_notional"), *market_p, *ema("m", "direction", MARKET_LIVES), *(c("p0") - market_p[i] for i in (0, 1, 3, 4)),
        ln(safe_ratio("m_notional", "m_count")), ln("m_velocity"), elapsed, remaining,
    ]
    component = [
        ln("c_count"), ln("c_notional"), c("c_flow"), c("c_side"), c("c_outcome"), c("c_mean"), c("c_std"), c("p0"), ln("c_gap"), ln("c_age"), ln("c_markets"), ln(c("c_count") / F.greatest("c_markets", F.lit(1.0))), safe_ratio("m_count", "c_count"), safe_ratio("m_notional", "c_notional"),
        ln(F.greatest("k_n", F.lit(1))), c("k_neg"), c("k_open"), *ema("c", "p0", COMPONENT_LIVES), *ema("c", "direction", COMPONENT_LIVES), ln("c_velocity"),
    ]
    crowd: list[Column] = []
    for i in range(4):
        crowd += [safe_ratio(f"s_d{i}", "m_notional"), weighted_std(f"s_d{i}", f"q_d{i}", "m_notional")]
    crowd += [safe_ratio(f"s_{x}", "m_notional") for x in ("d4", "known", "resolved")]
    crowd += [ln("m_notional"), ln(safe_ratio(c("m_notional") * c("m_notional"), "m_nn")), safe_ratio("s_d5", "m_notional"), safe_ratio("s_d6", "m_notional"), safe_ratio(n, "m_notional")]
    universe = [
        ln("u_count"), ln("u_notional"), u_mean, weighted_std("u_pn", "u_ppn", "u_notional"), safe_ratio("u_signed", "u_notional"), safe_ratio(2 * c("u_buy") - c("u_notional"), "u_notional"), ln("u_market_ids"), ln("u_component_ids"),
        safe_ratio("c_count", "u_count"), safe_ratio("c_notional", "u_notional"), ln(c("u_notional") * DAY / F.greatest("u_age", F.lit(1))), c(f"u_ema_direction_{DAY}"),
    ]
    return [*clock, *market, *component, *wallet, *crowd, *universe]

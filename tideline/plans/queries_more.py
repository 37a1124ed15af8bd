"""Queries of eligibility, attribution, packing of candidates, log codecs and further aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import scalar as S
from tideline.operators import evaluate, logs, order, quality
from tideline.plans.queries_ledger import EV, LI, ORIENTED, oriented
from tideline.plans.catalog import query
from tideline.plans.views import DAY, RESOLUTIONS, SPLITS_SQL, resolutions, splits, trades_ev, trades_li


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query("SELECT date_trunc('month', o_orderdate)::DATE::VARCHAR AS month, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_ids, count(*) - count(DISTINCT o_orderkey) AS duplicates, count(*) FILTER (WHERE o_totalprice IS NULL) AS incomplete FROM orders GROUP BY 1")
def a21_f28_f37_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir).groupBy(F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd").alias("month"))
    return o.agg(F.count("*").alias("n_rows"), F.countDistinct("o_orderkey").alias("n_ids"), (F.count("*") - F.countDistinct("o_orderkey")).alias("duplicates"), F.count_if(F.col("o_totalprice").isNull()).alias("incomplete"))


@query("SELECT round(sum(n) / count(*) * (SELECT max(o_orderkey) // 100 + 1 FROM orders), 4) AS estimate, count(*) AS blocks FROM (SELECT o_orderkey // 100 AS b, count(*) AS n FROM orders WHERE o_orderkey // 100 % 10 = 0 GROUP BY 1)")
def a18_density_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count from evenly spaced blocks of keys: a systematic sample is the operator."""
    o = orders(spark, sf_dir).withColumn("b", F.floor(F.col("o_orderkey") / 100))
    all_ = o.agg((F.max("b") + 1).alias("m"))
    probed = o.where("b % 10 = 0").groupBy("b").agg(F.count("*").alias("n"))
    return probed.agg(F.sum("n").alias("s"), F.count("*").alias("blocks")).join(all_).select(F.round(F.col("s") / F.col("blocks") * F.col("m"), 4).alias("estimate"), "blocks")


@query("SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'unavailable:' || sha256(CAST(o_orderkey AS VARCHAR))) AS ident, coalesce(o_orderdate, TIMESTAMP '1970-01-01') < TIMESTAMP '1996-01-01' AND (o_orderstatus <> 'F' OR o_orderdate >= TIMESTAMP '1993-01-01') AS intersects FROM orders")
def d01_d03_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = F.coalesce(F.nullif("o_orderpriority", F.lit("5-LOW")), F.concat(F.lit("unavailable:"), F.sha2(F.col("o_orderkey").cast("string"), 256)))
    began, ended = F.coalesce("o_orderdate", F.lit("1970-01-01").cast("timestamp_ntz")), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    hit = (began < F.lit("1996-01-01").cast("timestamp_ntz")) & (ended.isNull() | (ended >= F.lit("1993-01-01").cast("timestamp_ntz")))
    return orders(spark, sf_dir).select("o_orderkey", ident.alias("ident"), hit.alias("intersects"))


@query(f"{EV}, {RESOLUTIONS}, {SPLITS_SQL}, m AS (SELECT r.*, split FROM resolutions r LEFT JOIN splits ON resolution_ts >= start_ts AND resolution_ts < end_ts) SELECT market_id, split, CASE WHEN split IN ('train', 'validation') THEN payout0 END AS payout0, CASE WHEN payout0 = 1 THEN 0.9995 ELSE 0.0005 END NOT BETWEEN 0.001 AND 0.999 AS terminal FROM m")
def d02_d04_gated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are opened only for allowed splits, after the split is known."""
    r, s = resolutions(trades_ev(spark, sf_dir)), splits(spark)
    m = r.join(F.broadcast(s), (F.col("resolution_ts") >= F.col("start_ts")) & (F.col("resolution_ts") < F.col("end_ts")), "left")
    p = F.when(F.col("payout0") == 1, 0.9995).otherwise(0.0005)
    return m.select("market_id", "split", F.when(F.col("split").isin("train", "validation"), F.col("payout0")).alias("payout0"), (~p.between(0.001, 0.999)).alias("terminal"))


@query(f"""{EV}, {ORIENTED}, {RESOLUTIONS}, t AS (SELECT o.*, lead(p0, 10) OVER w AS later, lead(timestamp_unix, 10) OVER w AS later_ts, resolution_ts FROM o JOIN resolutions USING (market_id) WINDOW w AS (PARTITION BY market_id ORDER BY timestamp_unix, trade_id))
SELECT trade_id, coalesce(later_ts >= timestamp_unix AND timestamp_unix < resolution_ts, false) AS causal, coalesce(abs((later - p0) * direction - direction * later + direction * p0) <= 1e-12, false) AS consistent FROM t""")
def d07_d08_target_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = oriented(trades_ev(spark, sf_dir))
    w = order.keyed("market_id")
    t = t.withColumns({"later": F.lead("p0", 10).over(w), "later_ts": F.lead("timestamp_unix", 10).over(w)}).join(resolutions(t), "market_id")
    d = F.col("direction")
    ok = F.abs((F.col("later") - F.col("p0")) * d - d * F.col("later") + d * F.col("p0")) <= 1e-12
    causal = (F.col("later_ts") >= F.col("timestamp_unix")) & (F.col("timestamp_unix") < F.col("resolution_ts"))
    return t.select("trade_id", F.coalesce(causal, F.lit(False)).alias("causal"), F.coalesce(ok, F.lit(False)).alias("consistent"))


_AUDIT = "CASE event_type WHEN 'purchase' THEN 'fill' WHEN 'click' THEN 'order' WHEN 'view' THEN 'decision' ELSE 'resolution' END"


@query(f"""WITH r AS (SELECT user_id AS decision_id, {_AUDIT} AS record_type, value FROM events), d AS (SELECT decision_id, count(*) AS n FROM r WHERE record_type = 'decision' GROUP BY 1), o AS (SELECT decision_id, sum(value) AS requested FROM r WHERE record_type = 'order' GROUP BY 1), f AS (SELECT decision_id, sum(value) AS filled, count(*) AS fills FROM r WHERE record_type = 'fill' GROUP BY 1)
SELECT d.decision_id, d.n, round(o.requested, 2) AS requested, coalesce(fills, 0) AS fills, round(least(coalesce(filled, 0) / requested, 1), 6) AS fill_fraction FROM d LEFT JOIN o USING (decision_id) LEFT JOIN f USING (decision_id)""")
def d11_e17_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision, order and fill records of one tagged table, attributed in one shuffle."""
    kind = F.when(F.col("event_type") == "purchase", "fill").when(F.col("event_type") == "click", "order").when(F.col("event_type") == "view", "decision").otherwise("resolution")
    r = events(spark, sf_dir).select(F.col("user_id").alias("decision_id"), kind.alias("k"), "value")
    by = r.groupBy("decision_id").agg(F.count_if(F.col("k") == "decision").alias("n"), F.sum(F.when(F.col("k") == "order", F.col("value"))).alias("requested"), F.sum(F.when(F.col("k") == "fill", F.col("value"))).alias("filled"), F.count_if(F.col("k") == "fill").alias("fills"))
    part = F.when(F.col("requested").isNotNull(), F.least(F.coalesce("filled", F.lit(0.0)) / F.col("requested"), F.lit(1.0)))
    return by.where("n > 0").select("decision_id", "n", F.round("requested", 2).alias("requested"), "fills", F.round(part, 6).alias("fill_fraction"))


@query("SELECT c_custkey, coalesce((SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'), 0) AS finished, (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) AS nation FROM customer")
def e04_e06_correlated_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    done = orders(spark, sf_dir).where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("finished"))
    return c.join(done, "c_custkey", "left").join(n, "c_nationkey", "left").select("c_custkey", F.coalesce("finished", F.lit(0)).alias("finished"), "nation")


@query("SELECT s_suppkey, n_name, r_name, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50) GROUP BY ALL")
def e02_e21_joined_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, s, n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "supplier", "nation", "region"))
    active = li.where("l_quantity >= 50").select(F.col("l_suppkey").alias("s_suppkey"))
    by = li.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    j = s.join(active, "s_suppkey", "left_semi").join(by, "s_suppkey").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("s_suppkey", "n_name", "r_name", "revenue")


@query("SELECT o_custkey, CAST(unnest(['a', 'b']) AS VARCHAR) AS token, unnest([n % 2, 1 - n % 2]) AS payout FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def e26_payout_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = orders(spark, sf_dir).groupBy("o_custkey").agg(F.count("*").alias("n"))
    pairs = F.arrays_zip(F.array(F.lit("a"), F.lit("b")).alias("token"), F.array(F.col("n") % 2, 1 - F.col("n") % 2).alias("payout"))
    return n.select("o_custkey", F.inline(pairs))


@query(f"{LI}, c AS (SELECT component_id, max(timestamp_unix) AS anchor FROM trades GROUP BY 1), k AS (SELECT component_id, row_number() OVER (ORDER BY anchor, component_id) % 5 AS fold FROM c) SELECT fold, count(*) AS n, round(avg(price), 6) AS mean_price, (SELECT count(*) FROM k k2 WHERE k2.fold <> k.fold AND k2.fold <> (k.fold + 1) % 5) AS fit_components FROM k JOIN trades USING (component_id) GROUP BY k.fold")
def f40_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold bookkeeping: held-out rows, and components left to fit without the inner validation fold."""
    t = trades_li(spark, sf_dir)
    c = t.groupBy("component_id").agg(F.max("timestamp_unix").alias("anchor"))
    c = order.global_rank(c, ["anchor", "component_id"], F.floor(F.col("anchor") / DAY))
    k = c.select("component_id", ((F.col("rank") + 1) % 5).cast("bigint").alias("fold"))
    sizes = k.groupBy("fold").agg(F.count("*").alias("m"))
    fit = sizes.alias("a").join(sizes.alias("b"), (F.col("a.fold") != F.col("b.fold")) & ((F.col("a.fold") + 1) % 5 != F.col("b.fold"))).groupBy(F.col("a.fold").alias("fold")).agg(F.sum("b.m").alias("fit_components"))
    return t.join(k, "component_id").groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg("price"), 6).alias("mean_price")).join(fit, "fold")


@query(f"{EV}, m AS (SELECT market_id, count(*) AS calls, count(DISTINCT component_id) AS components, avg(outcome_index - price) AS metric FROM trades GROUP BY 1), e AS (SELECT *, calls >= 450 AS eligible FROM m) SELECT market_id, calls, eligible, round(metric, 6) AS metric FROM e ORDER BY eligible DESC, e.metric DESC, market_id LIMIT 1")
def f26_f41_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = trades_ev(spark, sf_dir).groupBy("market_id").agg(F.count("*").alias("calls"), F.avg(F.col("outcome_index") - F.col("price")).alias("metric"))
    m = m.withColumn("eligible", F.col("calls") >= 450).orderBy(F.desc("eligible"), F.desc("metric"), "market_id").limit(1)
    return m.select("market_id", "calls", "eligible", F.round("metric", 6).alias("metric"))


@query(f"{EV}, {ORIENTED}, s AS (SELECT market_id, greatest(stddev_pop(p0), 1e-5) AS s, avg(p0) AS m FROM o GROUP BY 1) SELECT trade_id, round(least(greatest((p0 - m) / s, -3), 3), 6) AS z FROM o JOIN s USING (market_id)")
def c31_f39_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = oriented(trades_ev(spark, sf_dir))
    s = t.groupBy("market_id").agg(F.greatest(F.stddev_pop("p0"), F.lit(1e-5)).alias("s"), F.avg("p0").alias("m"))
    return t.join(s, "market_id").select("trade_id", F.round(S.clamp((F.col("p0") - F.col("m")) / F.col("s"), -3.0, 3.0), 6).alias("z"))


_CAND = """c AS (SELECT trade_id, side, CASE WHEN side = 'BUY' THEN price ELSE 1 - price END AS p, 1 / CASE WHEN side = 'BUY' THEN price ELSE 1 - price END AS payout, ln(size / 100) AS logit FROM trades)"""


@query(f"{EV}, {_CAND} SELECT trade_id, round(p, 6) AS price, round(1 - p, 6) AS opposite, round(least(1, 1 / greatest(payout, 1e-8)), 6) AS break_even, round(CASE WHEN side = 'BUY' THEN 1 / (1 + exp(-least(greatest(logit, -30), 30))) ELSE 1 - 1 / (1 + exp(-least(greatest(logit, -30), 30))) END, 6) AS terminal, round(ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))), 6) AS price_logit, round(payout - 1, 6) AS upside, CASE WHEN side = 'BUY' THEN 1 ELSE 0 END AS is_yes FROM c")
def c30_candidate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    buy = F.col("side") == "BUY"
    t = trades_ev(spark, sf_dir).withColumn("p", F.when(buy, F.col("price")).otherwise(1 - F.col("price"))).withColumn("payout", 1 / F.col("p"))
    yes = S.sigmoid(F.ln(F.col("size") / 100))
    named = {"price": F.col("p"), "opposite": 1 - F.col("p"), "break_even": S.break_even("payout"), "terminal": F.when(buy, yes).otherwise(1 - yes), "price_logit": S.logit("p"), "upside": F.col("payout") - 1}
    return t.select("trade_id", *(F.round(v, 6).alias(k) for k, v in named.items()), F.when(buy, 1).otherwise(0).alias("is_yes"))


@query(f"{EV}, w AS (SELECT trade_id, 1 / (1 + exp(-(0.7 - price) / 0.1)) * CASE WHEN outcome_index = 1 THEN 1.5 ELSE 2 END AS raw FROM trades) SELECT trade_id, round(greatest(raw / avg(raw) OVER (), 0.05), 6) AS weight FROM w")
def c40_curriculum_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = 1 / (1 + F.exp(-(0.7 - F.col("price")) / 0.1)) * F.when(F.col("outcome_index") == 1, 1.5).otherwise(2)
    t = trades_ev(spark, sf_dir).select("trade_id", raw.alias("raw"))
    return t.join(F.broadcast(t.agg(F.avg("raw").alias("m")))).select("trade_id", F.round(F.greatest(F.col("raw") / F.col("m"), F.lit(0.05)), 6).alias("weight"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding[1:16], lambda x: 0.0 * x)) + list_sum(list_transform(embedding[17:32], lambda x: CAST(x AS DOUBLE))), 6) AS kept, round(list_sum(list_transform(embedding[33:64], lambda x: abs(CAST(x AS DOUBLE)))), 6) AS contribution FROM embeddings")
def c32_q08_feature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group of columns zeroed, and contributions summed by index range."""
    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    v = F.transform("embedding", lambda x: x.cast("double"))
    masked = F.transform(F.slice(v, 1, 32), lambda x, i: F.when(i < 16, 0.0).otherwise(x))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.round(total(masked), 6).alias("kept"), F.round(total(F.transform(F.slice(v, 33, 32), lambda x: F.abs(x))), 6).alias("contribution"))


def _logs(e: DataFrame) -> DataFrame:
    hexed = lambda x: F.lpad(F.lower(F.hex(x)), 64, "0")
    i = F.col("event_id")
    buy = i % 2 == 0
    v1 = F.concat(F.lit("0x"), F.when(buy, hexed(F.lit(0))).otherwise(hexed(i + 7)), F.when(buy, hexed(i + 7)).otherwise(hexed(F.lit(0))), hexed(i * 3 + 1), hexed(i * 5 + 1), hexed(i % 10))
    v2 = F.concat(F.lit("0x"), hexed((i % 2).cast("bigint")), hexed(i + 7), hexed(i * 3 + 1), hexed(i * 5 + 1), hexed(i % 10), hexed(F.lit(1)), hexed(F.lit(2)))
    topics = F.array(F.lit("0x00"), F.lit("0x01"), F.concat(F.lit("0x"), hexed(F.col("user_id"))), F.concat(F.lit("0x"), hexed(F.col("user_id") + 1)))
    bad = i % 11 == 0
    return e.select(i.alias("log_id"), F.when(i % 3 == 0, "v1").otherwise("v2").alias("protocol"), F.when(bad, F.slice(topics, 1, 3)).otherwise(topics).alias("topics"), F.when(i % 3 == 0, v1).otherwise(v2).alias("data"))


_FILLS = """SELECT i AS log_id, ok AS valid, CASE WHEN ok THEN CASE WHEN i % 2 = 0 THEN 'BUY' ELSE 'SELL' END END AS side,
  CASE WHEN ok THEN '0x' || lpad(lower(to_hex(u)), 40, '0') END AS maker, CASE WHEN ok THEN '0x' || lpad(lower(to_hex(u + 1)), 40, '0') END AS taker, CASE WHEN ok THEN CAST(i + 7 AS VARCHAR) END AS token_id,
  CASE WHEN ok THEN CAST(CASE WHEN i % 2 = 0 THEN i * 3 + 1 ELSE i * 5 + 1 END AS VARCHAR) END AS collateral_raw, CASE WHEN ok THEN CAST(CASE WHEN i % 2 = 0 THEN i * 5 + 1 ELSE i * 3 + 1 END AS VARCHAR) END AS tokens_raw,
  CASE WHEN ok THEN CAST(i % 10 AS VARCHAR) END AS fee_raw, CASE WHEN ok THEN round(CASE WHEN i % 2 = 0 THEN (i * 3 + 1)::DOUBLE / (i * 5 + 1) ELSE (i * 5 + 1)::DOUBLE / (i * 3 + 1) END, 5) END AS price FROM l"""


@query(f"WITH l AS (SELECT event_id AS i, user_id AS u, event_id % 11 <> 0 AS ok FROM events) {_FILLS}")
def c19_fill_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a log."""
    d = logs.decode_fills(_logs(events(spark, sf_dir)))
    return d.withColumn("price", F.round(F.col("price").cast("double"), 5))


@query("""WITH l AS (SELECT event_id AS i, user_id AS u FROM events) SELECT sha256('137|0xab' || i || '|' || i % 5 || '|0xcd') AS edge_id, 'erc20_transfer' AS kind, '0x' || lpad(lower(to_hex(u)), 40, '0') AS source_address, '0x' || lpad(lower(to_hex(u + 1)), 40, '0') AS target_address, CAST(NULL AS VARCHAR) AS token_id, CAST(i AS VARCHAR) AS amount FROM l""")
def c20_j04_transfer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a transfer."""
    return _transfers(events(spark, sf_dir).withColumn("i", F.col("event_id")))


def _transfers(e: DataFrame) -> DataFrame:
    hexed = lambda x: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(x)), 64, "0"))
    rows = e.select(F.lit("erc20_transfer").alias("kind"), F.array(F.lit("0x0"), hexed(F.col("user_id")), hexed(F.col("user_id") + 1)).alias("topics"), hexed(F.col("i")).alias("data"), F.concat(F.lit("0xAB"), "i").alias("transaction_hash"), (F.col("i") % 5).alias("log_index"), F.lit("0xCD").alias("address"))
    return logs.transfer_edges(rows.unionByName(rows))  # an overlapping second scan


@query(f"{EV}, s AS (SELECT market_id, unnest(range(1, count(*) - 126, 64)) AS start_n FROM trades GROUP BY 1), r AS (SELECT market_id, price, row_number() OVER (PARTITION BY market_id ORDER BY timestamp_unix, trade_id) AS n FROM trades) SELECT s.market_id, s.start_n, r.n - s.start_n AS \"offset\", round(r.price, 6) AS price FROM s JOIN r ON r.market_id = s.market_id AND r.n BETWEEN s.start_n AND s.start_n + 127")
def h15_sliding_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every position of the overlapping sequences of 128 trades at stride 64."""
    return sequences(trades_ev(spark, sf_dir), 128, 64)


def sequences(t: DataFrame, length: int, stride: int) -> DataFrame:
    """market_id, start_n, offset, price of full sequences: each trade goes to the few starts that cover it."""
    r = t.select("market_id", "price", F.row_number().over(order.keyed("market_id")).cast("bigint").alias("n"))
    r = r.withColumn("last", F.max("n").over(W.partitionBy("market_id")))
    start = F.floor((F.col("n") - 1) / stride) * stride + 1
    r = r.withColumn("start_n", F.explode(F.transform(F.sequence(F.lit(0), F.lit((length - 1) // stride)), lambda k: start - k * stride))).withColumn("offset", F.col("n") - F.col("start_n"))
    return r.where((F.col("start_n") >= 1) & (F.col("offset") < length) & (F.col("start_n") <= F.col("last") - (length - 1))).select("market_id", "start_n", "offset", F.round("price", 6).alias("price"))


@query(f"{EV}, m AS (SELECT market_id, min(timestamp_unix) AS first_decision FROM trades GROUP BY 1), {SPLITS_SQL} SELECT market_id, first_decision, split FROM m LEFT JOIN splits ON first_decision >= start_ts AND first_decision < end_ts")
def l04_l06_condition_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = trades_ev(spark, sf_dir).groupBy("market_id").agg(F.min("timestamp_unix").alias("first_decision"))
    s = splits(spark)
    return m.join(F.broadcast(s), (F.col("first_decision") >= F.col("start_ts")) & (F.col("first_decision") < F.col("end_ts")), "left").select("market_id", "first_decision", "split")


@query(f"{EV}, {SPLITS_SQL} SELECT split, CAST(end_ts - start_ts AS BIGINT) AS length, CAST(lead(start_ts) OVER (ORDER BY start_ts) - end_ts AS BIGINT) AS embargo, coalesce(lead(start_ts) OVER (ORDER BY start_ts) - end_ts = {DAY}, true) AS exact, (SELECT count(*) FROM trades WHERE timestamp_unix >= start_ts AND timestamp_unix < end_ts) AS n_trades FROM splits")
def l01_split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of splits, and the trades that each one holds."""
    w = W.orderBy("start_ts")  # four rows
    gap = F.lead("start_ts").over(w) - F.col("end_ts")
    plan = splits(spark)
    shown = plan.select("split", (F.col("end_ts") - F.col("start_ts")).alias("length"), gap.alias("embargo"), F.coalesce(gap == DAY, F.lit(True)).alias("exact"))
    named = plan.select(F.lit(1).alias("plan"), F.col("split").alias("segment"), "start_ts", "end_ts")
    held = quality.locate(trades_ev(spark, sf_dir).select(F.lit(1).alias("plan"), "timestamp_unix"), named, "timestamp_unix", "plan").groupBy(F.col("segment").alias("split")).agg(F.count("*").alias("n"))
    return shown.join(held, "split", "left").select("split", "length", "embargo", "exact", F.coalesce("n", F.lit(0)).alias("n_trades"))


@query(f"{EV} SELECT trade_id, count(*) OVER (PARTITION BY wallet_id, market_id, timestamp_unix // 3600) > 1 AS repeated FROM trades")
def n14_duplicate_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("wallet_id", "market_id", F.floor(F.col("timestamp_unix") / 3600))
    return trades_ev(spark, sf_dir).select("trade_id", (F.count("*").over(w) > 1).alias("repeated"))


@query()
def f22_moving_block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the mean daily profit; a series of days is short."""
    d = trades_ev(spark, sf_dir).groupBy(F.floor(F.col("timestamp_unix") / DAY).alias("day")).agg(F.sum((F.col("outcome_index") - F.col("price")) * F.col("size")).alias("pnl"))
    m = evaluate.moving_block_bootstrap([r["pnl"] for r in d.orderBy("day").collect()])
    return spark.createDataFrame([(float(m[int(0.025 * len(m))]), float(m.mean()), float(m[int(0.975 * len(m))]))], "low double, mean double, high double")


@query(f"{EV}, d AS (SELECT trade_id, timestamp_unix // {DAY} AS day FROM trades) SELECT CAST(day AS BIGINT) AS day, trade_id, CAST(row_number() OVER (PARTITION BY day ORDER BY md5('17|' || day || '|' || trade_id), trade_id) AS INTEGER) AS place FROM d")
def i13_seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir).select("trade_id", F.floor(F.col("timestamp_unix") / DAY).alias("day"))
    h = F.md5(F.concat_ws("|", F.lit("17"), F.col("day").cast("string"), F.col("trade_id").cast("string")))
    return order.split_rank(t, ["day"], [h, "trade_id"], F.substring(h, 1, 2)).select("day", "trade_id", (F.col("rank") + 1).cast("int").alias("place"))


@query(f"{EV}, d AS (SELECT trade_id, wallet_id, timestamp_unix // {DAY} AS day FROM trades), a AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY trade_id) AS k FROM d), b AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY md5('3|' || trade_id), trade_id) AS k FROM d) SELECT a.trade_id, b.wallet_id AS shuffled_wallet FROM a JOIN b ON a.day = b.day AND a.k = b.k")
def c33_wallet_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ablation: wallet columns permuted jointly within each day, by a join of two numberings."""
    t = trades_ev(spark, sf_dir).withColumn("day", F.floor(F.col("timestamp_unix") / DAY))
    h = F.md5(F.concat(F.lit("3|"), F.col("trade_id").cast("string")))
    a = order.split_rank(t.select("trade_id", "day"), ["day"], ["trade_id"], F.floor(F.col("trade_id") / 65_536), "k")
    b = order.split_rank(t.select("trade_id", "day", F.col("wallet_id").alias("shuffled_wallet")), ["day"], [h, "trade_id"], F.substring(h, 1, 2), "k").drop("trade_id")
    return a.join(b, ["day", "k"]).select("trade_id", "shuffled_wallet")

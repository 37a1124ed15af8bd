"""Queries of adaptive windows, grouped requests, out-of-fold fits, canonical digests and mergeable counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import canonical
from tideline.operators import crossfit, distinct, planning
from tideline.plans.catalog import query
from tideline.plans.queries_ledger import EV, LI, _mixed_sql
from tideline.plans.views import DAY, START, trades_ev, trades_li


def _windows_sql(scope: str, limit: int, least: int) -> str:
    """The recursive bisection of spans(scope, s, e) over trades."""
    return f"""w(scope, s, e, level, n) AS (
  SELECT scope, s, e, 0, (SELECT count(*) FROM trades WHERE {scope} = scope AND timestamp_unix BETWEEN s AND e) FROM spans
  UNION ALL
  SELECT c.scope, c.s, c.e, c.level, (SELECT count(*) FROM trades WHERE {scope} = c.scope AND timestamp_unix BETWEEN c.s AND c.e) FROM (
    SELECT scope, CASE WHEN k = 0 THEN s ELSE s + (e - s) // 2 + 1 END AS s, CASE WHEN k = 0 THEN s + (e - s) // 2 ELSE e END AS e, level + 1 AS level
    FROM w, (VALUES (0), (1)) AS halves(k) WHERE n > {limit} AND e - s > {least}) c)
SELECT scope AS {scope}, CAST(s AS BIGINT) AS start_ts, CAST(e AS BIGINT) AS end_ts, level, n AS n_rows, n > {limit} AS is_gap FROM w WHERE NOT (n > {limit} AND e - s > {least})"""


@query(f"{EV.replace('WITH', 'WITH RECURSIVE', 1)}, spans AS (SELECT DISTINCT market_id AS scope, {START} AS s, {START + 30 * DAY - 1} AS e FROM trades), {_windows_sql('market_id', 20, 3600)}")
def i10_adaptive_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a month per market, bisected until none holds more than 20 trades or lasts an hour or less."""
    t = trades_ev(spark, sf_dir)
    spans = t.select("market_id").distinct().select("market_id", F.lit(START).alias("start_ts"), F.lit(START + 30 * DAY - 1).alias("end_ts"))
    return planning.adaptive_windows(t, spans, "market_id", "timestamp_unix", 20, 3600)


@query(f"{LI.replace('WITH', 'WITH RECURSIVE', 1)}, spans AS (SELECT component_id AS scope, min(timestamp_unix) AS s, max(timestamp_unix) AS e FROM trades GROUP BY 1), {_windows_sql('component_id', 2, 0)}")
def a23_adaptive_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of a component's times, bisected down to single times; these are gaps where they are too full."""
    t = trades_li(spark, sf_dir)
    spans = t.groupBy("component_id").agg(F.min("timestamp_unix").alias("start_ts"), F.max("timestamp_unix").alias("end_ts"))
    return planning.adaptive_windows(t, spans, "component_id", "timestamp_unix", 2)


@query("""WITH RECURSIVE v AS (SELECT l_partkey AS market_id, sum(l_quantity) AS volume FROM lineitem GROUP BY 1), r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY volume DESC, market_id) - 1 AS rank FROM v),
walk(rank, grp, n, total) AS (
  SELECT rank, 0, 1, volume FROM r WHERE rank = 0
  UNION ALL SELECT r.rank, CASE WHEN fresh THEN grp + 1 ELSE grp END, CASE WHEN fresh THEN 1 ELSE n + 1 END, CASE WHEN fresh THEN volume ELSE total + volume END
  FROM (SELECT r.*, grp, n, total, total >= 1000 OR volume >= 1000 OR n >= 7 OR total + volume > 1000 AS fresh FROM walk JOIN r ON r.rank = walk.rank + 1) r)
SELECT market_id, volume, r.rank, CAST(grp AS BIGINT) AS "group", count(*) OVER (PARTITION BY grp) AS group_rows FROM r JOIN walk ON r.rank = walk.rank""")
def i08_grouped_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets by volume in groups of at most 7, and of at most 1,000 together; large ones alone."""
    v = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_partkey").alias("market_id")).agg(F.sum("l_quantity").alias("volume"))
    g = planning.groups_under(v, [F.desc("volume"), F.col("market_id")], "volume", 7, 1000)
    sizes = g.groupBy("group").agg(F.count("*").alias("group_rows"))
    return g.join(sizes, "group").select("market_id", "volume", F.col("rank").cast("bigint").alias("rank"), F.col("group").cast("bigint").alias("group"), "group_rows")


PENALTIES = (0.0, 1e4, 1e5)
_sums = "sum(w) AS s, sum(w * x1) AS a, sum(w * x2) AS b, sum(w * y) AS c, sum(w * x1 * x1) AS aa, sum(w * x1 * x2) AS ab, sum(w * x2 * x2) AS bb, sum(w * x1 * y) AS ac, sum(w * x2 * y) AS bc, sum(w * y * y) AS cc"
_names = ["s", "a", "b", "c", "aa", "ab", "bb", "ac", "bc", "cc"]
FOLDS_SQL = f"""{LI}, k AS (SELECT DISTINCT component_id FROM trades), seeds AS (SELECT component_id, f, CASE WHEN f < 0 THEN 17 ELSE xor(17, f + 101) END AS seed FROM k, (VALUES (-1), (0), (1), (2), (3), (4)) AS v(f)),
{_mixed_sql('seeds', '(component_id + seed)::UHUGEINT')}, own AS (SELECT component_id, CAST(h % 5 AS BIGINT) AS fold FROM m3 WHERE f < 0),
inn AS (SELECT component_id, f FROM m3 JOIN own USING (component_id) WHERE f >= 0 AND f <> fold AND h % 10 = 0),
d AS (SELECT trade_id, component_id, fold, price AS x1, size AS x2, notional_usd AS y, size AS w FROM trades JOIN own USING (component_id)),
mf AS (SELECT fold AS f, {_sums}, count(*) AS n FROM d GROUP BY 1), vf AS (SELECT f, {_sums}, count(*) AS n FROM d JOIN inn USING (component_id) GROUP BY 1),
tot AS (SELECT {', '.join(f'sum({c}) AS {c}' for c in [*_names, 'n'])} FROM mf), pool AS (SELECT f, {', '.join(f'tot.{c} - mf.{c} AS {c}' for c in [*_names, 'n'])} FROM mf, tot),
train AS (SELECT f, {', '.join(f'pool.{c} - vf.{c} AS {c}' for c in _names)} FROM pool JOIN vf USING (f)),
cases AS (SELECT *, 'train' AS kind FROM train UNION ALL SELECT f, {', '.join(_names)}, 'pool' FROM pool),
m AS (SELECT *, a / s AS m1, b / s AS m2, c / s AS my, sqrt(aa / s - (a / s) * (a / s)) AS s1, sqrt(bb / s - (b / s) * (b / s)) AS s2 FROM cases, (VALUES {', '.join(f'({p})' for p in PENALTIES)}) AS q(penalty)),
t AS (SELECT *, (ac / s - m1 * my) / s1 AS t1, (bc / s - m2 * my) / s2 AS t2, (ab / s - m1 * m2) / (s1 * s2) AS r, 1 + penalty / s AS g FROM m),
sl AS (SELECT *, (g * t1 - r * t2) / (g * g - r * r) / s1 AS b1, (g * t2 - r * t1) / (g * g - r * r) / s2 AS b2 FROM t), beta AS (SELECT f, kind, penalty, my - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM sl),
err AS (SELECT f, penalty, (cc - 2 * (b0 * c + b1 * ac + b2 * bc) + b0 * b0 * s + b1 * b1 * aa + b2 * b2 * bb + 2 * (b0 * b1 * a + b0 * b2 * b + b1 * b2 * ab)) / s AS e FROM beta JOIN vf USING (f) WHERE kind = 'train'),
best AS (SELECT f, arg_min(penalty, e) AS penalty, min(e) AS e FROM err GROUP BY f), model AS (SELECT beta.* FROM beta JOIN best USING (f, penalty) WHERE kind = 'pool')"""


def _fit_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[crossfit.Fit]]:
    return crossfit.out_of_fold(trades_li(spark, sf_dir), "component_id", ["price", "size"], "notional_usd", "size", penalties=PENALTIES)


@query(f"{FOLDS_SQL} SELECT trade_id, fold, round(b0 + b1 * x1 + b2 * x2, 5) AS prediction FROM d JOIN model ON f = fold")
def f40_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction for every trade by the model that has not seen its component."""
    df, _ = _fit_rows(spark, sf_dir)
    return df.select("trade_id", "fold", F.round("prediction", 5).alias("prediction"))


@query(f"{FOLDS_SQL} SELECT CAST(f AS BIGINT) AS fold, CAST(pool.n AS BIGINT) AS n_rows, vf.n AS inner_rows, CAST(penalty AS DOUBLE) AS penalty, round(e, 6) AS inner_error, round(b0, 6) AS intercept FROM model JOIN pool USING (f) JOIN vf USING (f) JOIN best USING (f, penalty)")
def f40_fold_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each fold's model was fitted and validated on, and the penalty it chose."""
    _, models = _fit_rows(spark, sf_dir)
    rows = [(m.fold, m.rows, m.inner_rows, m.penalty, round(m.inner_error, 6), round(float(m.coefficients[0]), 6)) for m in models]
    return spark.createDataFrame(rows, "fold bigint, n_rows bigint, inner_rows bigint, penalty double, inner_error double, intercept double")


def _escaped_sql(x: str) -> str:
    one = r"""CASE c WHEN '"' THEN '\"' WHEN '\' THEN '\\' WHEN chr(10) THEN '\n' WHEN chr(13) THEN '\r' WHEN chr(9) THEN '\t' WHEN chr(8) THEN '\b' WHEN chr(12) THEN '\f' ELSE
      CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) < 65536 THEN printf('\u%04x', unicode(c))
      ELSE printf('\u%04x\u%04x', 55296 + (unicode(c) - 65536) // 1024, 56320 + unicode(c) % 1024) END END"""
    return f"""'"' || array_to_string(list_transform(regexp_extract_all({x}, '[\\s\\S]'), lambda c: {one}), '') || '"'"""


@query(f"""WITH p AS (SELECT doc_id, '{{"content":{{"lang":' || coalesce({_escaped_sql('lang')}, 'null') || ',"text":' || coalesce({_escaped_sql('text')}, 'null') || '}},"doc_id":' || doc_id
  || ',"labels":[' || coalesce(CAST(quality AS VARCHAR), 'null') || ',' || coalesce(CAST(toxic AS VARCHAR), 'null') || '],"source":' || coalesce({_escaped_sql('source')}, 'null') || '}}' AS t FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, length(t) AS n_chars, sha256(t) AS digest FROM p""")
def c16_canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's record: nested, with nulls and escapes, in one order of keys."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    # labels grow with the documents: the same join at every size
    rows = docs.join(labels.hint("merge"), "doc_id", "left").select("doc_id", F.struct("source", "doc_id", F.struct("text", "lang").alias("content"), F.array("quality", "toxic").alias("labels")).alias("record"))
    text = rows.select("doc_id", canonical.canonical_json(F.col("record"), rows.schema["record"].dataType).alias("t"))
    return text.select("doc_id", F.length("t").cast("bigint").alias("n_chars"), F.sha2("t", 256).alias("digest"))


@query(f"""{EV}, j AS (SELECT trade_id, '{{' || CASE WHEN trade_id % 2 = 0 THEN '"execution_context":[' || CAST(1 / price AS VARCHAR) || ',' || CAST(price AS VARCHAR) || '],' ELSE '' END || '"feature_sha256":"' || sha256('f' || trade_id)
  || '","market_probability_outcome0":' || CAST(price AS VARCHAR) || ',"physical_action_mask":[' || CASE WHEN side = 'BUY' THEN 'true' ELSE 'false' END || ',true],"portfolio_features":[' || CAST(size AS VARCHAR) || ',' || CAST(notional_usd AS VARCHAR)
  || '],"prediction_memory_features":[' || CAST(price / 3 AS VARCHAR) || ',' || CAST(price / 1e7 AS VARCHAR) || '],"previous_action_id":' || trade_id % 3 || '}}' AS t FROM trades) SELECT trade_id, sha256(t) AS digest FROM j""")
def c37_policy_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of what a policy would act on at every trade; half of the states have no execution context."""
    t, price = trades_ev(spark, sf_dir), F.col("price")
    return t.select("trade_id", canonical.policy_input_digest({
        "feature_sha256": F.sha2(F.concat(F.lit("f"), F.col("trade_id").cast("string")), 256), "market_probability_outcome0": price, "portfolio_features": F.array("size", "notional_usd"),
        "prediction_memory_features": F.array(price / 3, price / 1e7), "previous_action_id": F.col("trade_id") % 3, "physical_action_mask": F.array(F.col("side") == "BUY", F.lit(True)),
        "execution_context": F.when(F.col("trade_id") % 2 == 0, F.array(1 / price, price)),
    }).alias("digest"))


@query(f"{LI} SELECT component_id, count(*) AS n_rows, count(DISTINCT date_trunc('day', to_timestamp(timestamp_unix))) AS n_days, count(DISTINCT wallet_id) AS wallets, true AS merges, true AS close FROM trades GROUP BY 1")
def g06_merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct wallets of a component by daily states merged, against one sketch of all rows and the exact count."""
    t = trades_li(spark, sf_dir)
    states = distinct.daily_states(t, ["component_id"], F.floor(F.col("timestamp_unix") / DAY), "wallet_id")
    merged = distinct.merged(states, ["component_id"]).drop("state").join(states.groupBy("component_id").agg(F.count("*").alias("n_days")), "component_id")
    direct = t.groupBy("component_id").agg(F.hll_sketch_estimate(F.hll_sketch_agg("wallet_id", distinct.LG)).alias("direct"), F.countDistinct("wallet_id").alias("wallets"))
    bound = 4 * distinct.standard_error() * F.col("wallets") + 1
    return merged.join(direct, "component_id").select("component_id", "n_rows", "n_days", "wallets", (F.abs(F.col("estimate") - F.col("direct")) <= 0.02 * F.col("wallets") + 1).alias("merges"), (F.abs(F.col("estimate") - F.col("wallets")) <= bound).alias("close"))


@query(f"{LI}, p AS (SELECT wallet_id, CAST('0x' || substr(md5(CAST(wallet_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM trades) SELECT h % 8 AS part, h % 16 AS half, count(*) AS n, count(DISTINCT wallet_id) AS wallets FROM p GROUP BY ALL")
def g06_hash_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wallets dealt to eight parts by a hash, and each part's two halves."""
    t = trades_li(spark, sf_dir).select("wallet_id", distinct.residue("wallet_id", 8).alias("part"), distinct.residue("wallet_id", 16).alias("half"))
    return t.groupBy("part", "half").agg(F.count("*").alias("n"), F.countDistinct("wallet_id").alias("wallets"))

"""Queries of checked shards, live files, manifests, exact prices, ledger profiles, split plans and edges by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import scalar as S
from tideline.operators import logs, quality
from tideline.plans.catalog import query
from tideline.plans.queries_ledger import EV, LI
from tideline.plans.shared import new_folder, tasks_for
from tideline.plans.views import DAY, START, trades_ev, trades_li
from tideline.sources import ledgers, shards


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LINE = """'{"market_id":' || market_id || ',"trade_id":' || trade_id || ',"side":"' || side || '"}'"""


@query(f"{EV}, d AS (SELECT (timestamp_unix - {START}) // {DAY} AS day, *, {_LINE} AS line FROM trades) SELECT day, count(*) AS n_rows, sha256(string_agg(line || chr(10), '' ORDER BY timestamp_unix, trade_id)) AS content_sha256, true AS sound, count(*) AS n_read FROM d GROUP BY 1")
def b01_checked_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed JSON lines by day with their counts and digests, the files digested again and the lines read back."""
    t = trades_ev(spark, sf_dir).withColumn("day", F.floor((F.col("timestamp_unix") - START) / DAY))
    line = F.concat(F.lit('{"market_id":'), F.col("market_id").cast("string"), F.lit(',"trade_id":'), F.col("trade_id").cast("string"), F.lit(',"side":"'), F.col("side"), F.lit('"}'))
    folder = new_folder(spark, "shards")
    written = shards.write_shards(t, folder, line, "day", ("timestamp_unix", "trade_id"))
    again = shards.file_digests(written, folder).select("file", F.col("bytes").alias("b"), F.col("sha256").alias("h"))
    read = shards.read_shards(written, folder).groupBy("file").agg(F.count("*").alias("n_read"))
    j = written.join(again, "file").join(read, "file")
    return j.select("day", F.col("rows").alias("n_rows"), "content_sha256", ((F.col("b") == F.col("bytes")) & (F.col("h") == F.col("sha256"))).alias("sound"), "n_read")


@query(f"{EV}, d AS (SELECT (timestamp_unix - {START}) // {DAY} AS day, string_agg(trade_id || chr(10), '' ORDER BY trade_id) AS content FROM trades GROUP BY 1) SELECT day, CAST(strlen(content) AS BIGINT) AS bytes, sha256(content) AS sha256 FROM d")
def b06_file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and digest of each day's file of ids, as a manifest finds them on disk."""
    folder = new_folder(spark, "manifest")
    t = trades_ev(spark, sf_dir).select(F.floor((F.col("timestamp_unix") - START) / DAY).alias("day"), F.col("trade_id"))
    t.repartition("day").sortWithinPartitions("day", "trade_id").select("day", F.col("trade_id").cast("string")).write.partitionBy("day").text(folder)
    return ledgers.manifest(spark, folder).select(F.regexp_extract("path", "day=([0-9]+)", 1).cast("bigint").alias("day"), "bytes", "sha256")


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) - CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS n_lines, CAST(len(string_split(text, chr(10))) - 1 AS BIGINT) AS n_complete FROM documents WHERE text IS NOT NULL")
def a05_complete_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each text, the last one counted without its end, and those that are ended."""
    text = F.col("text")
    complete = shards.complete_lines(text)
    return _read(spark, sf_dir, "documents").where("text is not null").select("doc_id", (complete + F.when((text == "") | text.endswith("\n"), 0).otherwise(1)).cast("bigint").alias("n_lines"), complete.alias("n_complete"))


@query("SELECT conv_id, count(*) AS n_turns, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars FROM conversations GROUP BY 1")
def a02_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON documents over many lines, an array of objects a file, read back strictly."""
    folder = new_folder(spark, "documents")
    c = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    ledgers.write_json_documents(c, folder)
    back = ledgers.read_json_documents(spark, folder, "conv_id bigint, turns array<struct<turn:bigint,role:string,text:string>>")
    n = F.aggregate("turns", F.lit(0).cast("bigint"), lambda s, x: s + F.char_length(F.coalesce(x["text"], F.lit(""))))
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), n.alias("n_chars"))


_LONG = """d0 AS (SELECT log_id, c // t AS whole, c % t AS r FROM x), d1 AS (SELECT *, (r * 10000000000::HUGEINT) // t2 AS a, (r * 10000000000::HUGEINT) % t2 AS r1 FROM (SELECT d0.*, x.t AS t2 FROM d0 JOIN x USING (log_id))),
d2 AS (SELECT *, (r1 * 10000000000::HUGEINT) // t2 AS b, (r1 * 10000000000::HUGEINT) % t2 AS r2 FROM d1), d3 AS (SELECT *, (r2 * 10000000000::HUGEINT) // t2 AS c3 FROM d2)"""


@query(f"""WITH x AS (SELECT event_id AS log_id, CAST(event_id AS HUGEINT) * 1000000007::HUGEINT * 1000003::HUGEINT + 7 AS c, CAST(user_id AS HUGEINT) * 1000000009::HUGEINT AS t FROM events WHERE user_id > 0), {_LONG}
SELECT e.event_id AS log_id, CASE WHEN d3.log_id IS NOT NULL THEN whole || '.' || lpad(CAST(a AS VARCHAR), 10, '0') || lpad(CAST(b AS VARCHAR), 10, '0') || lpad(CAST(c3 AS VARCHAR), 10, '0') END AS price FROM events e LEFT JOIN d3 ON d3.log_id = e.event_id""")
def c21_exact_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of raw amounts of up to 24 digits: shown are 30 decimals of the 50 digits; none without tokens."""
    i, u = F.col("event_id").cast("decimal(38,0)"), F.col("user_id").cast("decimal(38,0)")
    raw = _read(spark, sf_dir, "events").select(F.col("event_id").alias("log_id"), (i * F.lit(1_000_000_007 * 1_000_003).cast("decimal(17,0)") + 7).cast("decimal(38,0)").cast("string").alias("c"), (u * F.lit(1_000_000_009).cast("decimal(10,0)")).cast("decimal(38,0)").cast("string").alias("t"))
    price = F.col("p")
    padded = F.rpad(F.when(F.instr(price, ".") > 0, F.substring_index(price, ".", -1)).otherwise(F.lit("")), 30, "0")
    return raw.select("log_id", logs.exact_price(F.col("c"), F.col("t")).alias("p")).select("log_id", F.when(price.isNotNull(), F.concat(F.substring_index(price, ".", 1), F.lit("."), padded)).alias("price"))


def _ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades as ledger rows, with faults of many kinds at known places."""
    i, m, cents, units = F.col("trade_id"), F.col("market_id"), F.round(F.col("price") * 100).cast("bigint"), F.floor("size").cast("bigint")
    t = trades_ev(spark, sf_dir)

    def fault(k: int, bad, good) -> Column:
        return F.when(i % k == 0, bad).otherwise(good)

    def hashed(prefix: str, x) -> Column:
        return F.sha2(F.concat(F.lit(prefix), x.cast("string")), 256)

    price = fault(73, F.lit("1.50"), F.concat(F.lit("0."), F.lpad(cents.cast("string"), 2, "0")))
    notional = units * cents + F.when(i % 79 == 0, 1).otherwise(0)
    text = F.concat(F.floor(notional / 100).cast("string"), F.lit("."), F.lpad((notional % 100).cast("string"), 2, "0"))
    ts = F.col("timestamp_unix")
    return t.select(
        i.alias("i"), F.floor((ts - START) / DAY).alias("file"), fault(41, F.lit("bad"), hashed("t", F.when(i % 53 == 1, F.floor(i / 2)).otherwise(i))).alias("trade_id"), fault(43, F.lit(None), F.concat(F.lit("0x"), hashed("m", m))).alias("condition_id"),
        fault(47, F.lit("0xAB"), F.concat(F.lit("0x"), F.substring(hashed("w", F.col("wallet_id")), 1, 40))).alias("wallet"), F.concat(F.lit("0x"), hashed("x", i)).alias("transaction_hash"), fault(59, F.lit("n/a"), i.cast("string")).alias("token_id"), fault(61, F.lit("HOLD"), F.col("side")).alias("side"),
        fault(67, F.lit("0.9"), F.lit("1.0.0")).alias("schema_version"), fault(71, F.lit(""), F.lit("public_trade")).alias("record_type"), F.lit("api").alias("source"), price.alias("price"), units.cast("string").alias("size"), text.alias("notional_usd"),
        F.when(i % 83 == 0, F.lit("soon")).otherwise(ts.cast("string")).alias("timestamp_unix"), F.when(i % 89 == 0, F.lit("?")).otherwise(F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"),
        fault(97, F.lit(None), F.lit("Yes")).alias("outcome"), fault(101, F.lit(None), F.col("outcome_index")).alias("outcome_index"),
    )


@query(f"""{EV}, x AS (SELECT trade_id AS i, (timestamp_unix - {START}) // {DAY} AS file, timestamp_unix AS ts, CAST(round(price * 100) AS BIGINT) AS cents, CAST(floor(size) AS BIGINT) AS units, side FROM trades),
y AS (SELECT *, CASE WHEN i % 73 = 0 THEN 150 ELSE cents END AS p, units * cents + CASE WHEN i % 79 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN i % 83 = 0 THEN NULL ELSE ts END AS t, CASE WHEN i % 41 = 0 THEN 'bad' WHEN i % 53 = 1 THEN CAST(i // 2 AS VARCHAR) ELSE CAST(i AS VARCHAR) END AS id FROM x),
z AS (SELECT *, lag(t) OVER (PARTITION BY file ORDER BY i) > t AS back FROM y)
SELECT count(*) AS n_rows, count(*) FILTER (back) AS file_order_violations, count(*) FILTER (i % 41 = 0) AS invalid_trade_id, count(*) FILTER (i % 43 = 0) AS invalid_condition_id, count(*) FILTER (i % 47 = 0) AS invalid_wallet, CAST(0 AS BIGINT) AS invalid_transaction_hash,
  count(*) FILTER (i % 59 = 0) AS invalid_token_id, count(*) FILTER (i % 61 = 0) AS invalid_side, count(*) FILTER (i % 67 = 0) AS invalid_schema_version, count(*) FILTER (i % 71 = 0) AS invalid_record_type, count(*) FILTER (p >= 100) AS invalid_price, count(*) FILTER (units <= 0) AS invalid_size,
  count(*) FILTER (n <= 0) AS invalid_notional, count(*) FILTER (n > 0 AND n < 2500) AS notional_below_filter, count(*) FILTER (n > 0 AND n < 2500 AND units >= 25) AS below_with_large_size, count(*) FILTER (n > 0 AND n < 2500 AND units * (100 - p) >= 2500) AS below_with_large_complement,
  count(*) FILTER (n > 0 AND n < 2500 AND greatest(units * p, units * (100 - p)) >= 2500) AS below_with_either_large, count(*) FILTER (units * p <> n) AS inconsistent_notional, count(*) FILTER (t IS NULL) AS invalid_timestamp, count(*) FILTER (t < {START} OR t >= {START + 20 * DAY}) AS timestamp_outside_window,
  count(*) FILTER (t IS NOT NULL AND i % 89 = 0) AS timestamp_text_mismatch, count(*) FILTER (i % 97 = 0) AS outcome_null, count(*) FILTER (i % 101 = 0) AS outcome_index_null, count(*) FILTER (i % 43 = 0) AS missing_condition_id, count(*) FILTER (i % 71 = 0) AS missing_record_type,
  {', '.join(f'count(*) FILTER (n > 0 AND n >= {lo * 100} AND n < {hi * 100}) AS below_lt_{hi}' for lo, hi in zip((0, *quality.BUCKETS), quality.BUCKETS))}, min(p) FILTER (p < 100) / 100.0::DOUBLE AS minimum_price, max(p) / 100.0::DOUBLE AS maximum_price, min(t) AS minimum_timestamp, max(t) AS maximum_timestamp,
  count(DISTINCT id) AS n_ids, count(*) - count(DISTINCT id) AS repeated_ids FROM z""")
def d12_ledger_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole profile of a ledger with planted faults; columns that are 0 by construction are left out."""
    p = quality.ledger_profile(_ledger_rows(spark, sf_dir), START, START + 20 * DAY, "file", "i")
    return p.drop("invalid_source", *(f"missing_{c}" for c in quality.REQUIRED if c not in ("condition_id", "record_type")))


_PLAN = "p AS (SELECT o_orderpriority AS plan, CASE WHEN year(o_orderdate) = 1995 THEN 'y1994' ELSE 'y' || year(o_orderdate) END AS segment, CAST(epoch(min(o_orderdate)) AS BIGINT) AS a, CAST(epoch(max(o_orderdate)) AS BIGINT) + 86400 - CASE WHEN year(o_orderdate) = 1996 THEN 3600 ELSE 0 END AS z FROM orders GROUP BY o_orderpriority, year(o_orderdate))"


@query(f"""WITH {_PLAN}, q AS (SELECT *, lag(z) OVER (PARTITION BY plan ORDER BY a, z, segment) AS last, count(*) OVER (PARTITION BY plan, segment) AS n FROM p)
SELECT DISTINCT plan, segment, problem FROM (SELECT plan, segment, 'repeated' AS problem FROM q WHERE n > 1 UNION ALL SELECT plan, segment, 'no length' FROM q WHERE a >= z UNION ALL SELECT plan, segment, 'embargo' FROM q WHERE last + 86400 <> a)""")
def l01_plan_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of a segment a year for each priority, from the orders there are: which segments break a plan."""
    return quality.plan_violations(_plans(spark, sf_dir), "plan", embargo=DAY)


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, year = _read(spark, sf_dir, "orders"), F.year("o_orderdate")
    at = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    by = o.groupBy(F.col("o_orderpriority").alias("plan"), year.alias("y")).agg(F.min(at).alias("start_ts"), (F.max(at) + DAY).alias("z"))
    return by.select("plan", F.concat(F.lit("y"), F.when(F.col("y") == 1995, 1994).otherwise(F.col("y")).cast("string")).alias("segment"), "start_ts", (F.col("z") - F.when(F.col("y") == 1996, 3600).otherwise(0)).alias("end_ts"))


@query(f"{LI}, m AS (SELECT '0x' || repeat('0', 40) || lpad(lower(to_hex(market_id * 1000003)), 24, '0') AS condition_id, market_id, count(*) AS n FROM trades GROUP BY market_id) SELECT condition_id, CAST(market_id * 1000003 AS BIGINT) AS market_key, n FROM m")
def c34_market_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets by the number in the last 16 digits of their id."""
    t = trades_li(spark, sf_dir).groupBy("market_id").agg(F.count("*").alias("n"))
    c = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(F.col("market_id") * 1_000_003)), 64, "0"))
    return t.select(c.alias("condition_id"), "n").withColumn("market_key", S.last_hex_key("condition_id").cast("bigint"))


@query(f"{LI}, p AS (SELECT wallet_id, component_id, sum(notional_usd * (outcome_index - price)) AS pnl FROM trades GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY pnl, wallet_id) AS k, count(*) OVER (PARTITION BY component_id) AS n FROM p) SELECT component_id, count(*) AS wallets, round(avg(pnl), 4) AS lower_tail FROM r WHERE k <= ceil(n * 0.1) GROUP BY 1")
def i12_lower_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean result of the worst tenth of a component's wallets."""
    from tideline.operators import evaluate

    t = trades_li(spark, sf_dir).select("component_id", "wallet_id", (F.col("notional_usd") * (F.col("outcome_index") - F.col("price"))).alias("pnl"))
    # most pairs have one trade: they are dealt before they are summed, into tasks of one size
    t = t.repartition(tasks_for(spark, _read(spark, sf_dir, "lineitem").count()), "component_id", "wallet_id")
    p = t.groupBy("component_id", "wallet_id").agg(F.sum("pnl").alias("pnl"))
    tail = evaluate.worst_share(p, "pnl", 0.1, "component_id")
    return tail.select("component_id", F.col("groups").alias("wallets"), F.round("tail", 4).alias("lower_tail"))


def _edge_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transfers of the three kinds; a batch names no single token and amount."""
    e, i, u = _read(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")

    def word(x) -> Column:
        return F.lpad(F.lower(F.hex(x)), 64, "0")

    def topic(x) -> Column:
        return F.concat(F.lit("0x"), word(x))

    kind = F.when(i % 3 == 0, "erc20_transfer").when(i % 3 == 1, "erc1155_transfer_single").otherwise("erc1155_transfer_batch")
    topics = F.when(i % 3 == 0, F.array(F.lit("0x0"), topic(u), topic(u + 1))).otherwise(F.array(F.lit("0x0"), topic(F.lit(99)), topic(u), topic(u + 1)))
    data = F.when(i % 3 == 0, topic(i)).otherwise(F.concat(F.lit("0x"), word(i * 7 + 1), word(i * 2 + 5)))
    rows = e.select(i.alias("i"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("timestamp_unix"), kind.alias("kind"), topics.alias("topics"), data.alias("data"), F.concat(F.lit("0xAB"), i.cast("string")).alias("transaction_hash"), (i % 5).alias("log_index"), F.lit("0xCD").alias("address"))
    return rows


_EDGES = """e AS (SELECT event_id AS i, CAST(floor(epoch(ts)) AS BIGINT) AS t, sha256('137|0xab' || event_id || '|' || event_id % 5 || '|0xcd') AS edge_id, CASE event_id % 3 WHEN 0 THEN 'erc20_transfer' WHEN 1 THEN 'erc1155_transfer_single' ELSE 'erc1155_transfer_batch' END AS kind,
  '0x' || lpad(lower(to_hex(user_id)), 40, '0') AS source_address, '0x' || lpad(lower(to_hex(user_id + 1)), 40, '0') AS target_address, CASE WHEN event_id % 3 = 1 THEN CAST(event_id * 7 + 1 AS VARCHAR) END AS token_id,
  CASE event_id % 3 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN CAST(event_id * 2 + 5 AS VARCHAR) END AS amount FROM events)"""


@query(f"WITH {_EDGES} SELECT edge_id, kind, source_address, target_address, token_id, amount FROM e")
def c20_transfer_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of tokens, of single items and of batches, from two overlapping scans."""
    rows = _edge_logs(spark, sf_dir)
    return logs.transfer_edges(rows.unionByName(rows.where("i % 2 = 0")))


@query(f"WITH {_EDGES} SELECT CAST(t // 86400 AS BIGINT) AS day, count(*) AS n_rows, sha256(string_agg(edge_id || ',' || source_address || ',' || target_address || chr(10), '' ORDER BY t, edge_id)) AS content_sha256 FROM e GROUP BY 1")
def k06_edge_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of overlapping scans as one chronological shard a day."""
    rows = _edge_logs(spark, sf_dir)
    times = rows.select(logs.edge_id().alias("edge_id"), "timestamp_unix")
    edges = logs.transfer_edges(rows.unionByName(rows.where("i % 2 = 0"))).join(times, "edge_id").withColumn("day", F.floor(F.col("timestamp_unix") / DAY))
    line = F.concat_ws(",", "edge_id", "source_address", "target_address")
    return shards.write_shards(edges, new_folder(spark, "edges"), line, "day", ("timestamp_unix", "edge_id")).select("day", F.col("rows").alias("n_rows"), "content_sha256")

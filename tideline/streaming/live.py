"""Structured Streaming forms: hour-partitioned append, item explode, incremental decision cursor, windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.operators.cursor import DENSE, HEARTBEAT, STRIDE

MESSAGE = "received_at_ms bigint, record_type string, source string, payload string"


def read_messages(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New JSON-lines files of a folder; rate-limited by files per trigger."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_trigger).json(path)


def explode_items(messages: DataFrame) -> DataFrame:
    """One row per item of the payload's JSON array, numbered; a payload that is no array is one item."""
    items = F.coalesce(F.from_json("payload", "array<string>"), F.array("payload"))
    return messages.select("received_at_ms", "record_type", "source", F.posexplode(items).alias("message_item_index", "item"))


def with_hour(df: DataFrame) -> DataFrame:
    """date and hour of receipt (not of the event): what files are partitioned by."""
    t = F.timestamp_millis("received_at_ms")
    return df.withColumn("date", F.to_date(t)).withColumn("hour", F.hour(t))


def append_hours(df: DataFrame, path: str, checkpoint: str, max_rows: int = 1_000_000) -> StreamingQuery:
    """Exactly-once Parquet files by hour of receipt."""
    return with_hour(df).writeStream.format("parquet").partitionBy("date", "hour").option("path", path).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", max_rows).trigger(availableNow=True).start()


def decisions(trades: DataFrame, key: str = "component_id", heartbeat: int = HEARTBEAT) -> DataFrame:
    """The decision cursor over a stream: count and last decision are the state of a key.

    Micro-batches must not go back in time within a key (files of a day at a time); rows of a batch are
    sorted here. A row that is before the key's last time is an error, as in the batch form's input check.
    """
    kind, ident = trades.schema[key].dataType.simpleString(), trades.schema["trade_id"].dataType.simpleString()

    def update(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, seen = state.get if state.exists else (0, None, None)
        pdf = pd.concat(pdfs).sort_values(["timestamp_unix", "trade_id"], kind="stable")
        out = []
        for t, trade in zip(pdf["timestamp_unix"].tolist(), pdf["trade_id"].tolist()):
            if seen is not None and t < seen:
                raise ValueError(f"time went back for {k}: {t} after {seen}")
            seen, n = t, n + 1
            why = ["first"] if n == 1 else ["early_power_of_two"] if n <= DENSE and n & (n - 1) == 0 else ["trade_stride"] if n > DENSE and n % STRIDE == 0 else []
            if last is not None and t - last >= heartbeat:
                why.append("heartbeat")
            if why:
                last = t
                out.append((k[0], trade, t, n, why))
        state.update((n, last, seen))
        yield pd.DataFrame(out, columns=[key, "trade_id", "timestamp_unix", "n", "reasons"])

    return trades.select(key, "trade_id", "timestamp_unix").groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, trade_id {ident}, timestamp_unix bigint, n bigint, reasons array<string>", "n bigint, last bigint, seen bigint", "append", GroupStateTimeout.NoTimeout
    )


def tumbling_flow(trades: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Notional and trades per market and window of event time; rows later than the watermark are dropped."""
    t = trades.withColumn("event_time", F.timestamp_seconds("timestamp_unix")).withWatermark("event_time", late)
    return t.groupBy(F.window("event_time", width).alias("w"), "market_id").agg(F.sum("notional_usd").alias("notional"), F.count("*").alias("n")).select("market_id", F.col("w.start").alias("start"), "notional", "n")


def subscription_changes(before: DataFrame, after: DataFrame, key: str = "token_id") -> DataFrame:
    """change ('add' or 'remove') and key between two snapshots of a catalog."""
    a, b = before.select(key).distinct(), after.select(key).distinct()
    return b.join(a, key, "left_anti").select(F.lit("add").alias("change"), key).unionByName(a.join(b, key, "left_anti").select(F.lit("remove").alias("change"), key))


def healthy(status: DataFrame, now_ms: int, most_ms: int = 120_000) -> DataFrame:
    """source, healthy: whether its last heartbeat is recent."""
    return status.groupBy("source").agg(F.max("received_at_ms").alias("m")).select("source", (F.lit(now_ms) - F.col("m") <= most_ms).alias("healthy"))


def refresh_subscriptions(messages: DataFrame, catalog: Callable[[SparkSession, int], DataFrame], key: str, folder: str, checkpoint: str, at: str = "received_at_ms") -> StreamingQuery:
    """Reads the catalog anew in every micro-batch and writes what it adds and removes, exactly once.

    catalog(spark, time) gives the keys that are wanted at the batch's last time. Changes go to folder/changes and the
    keys then subscribed to folder/subscribed, each under batch=<id>: a batch that is run again after a failure starts
    from the same earlier state and overwrites its own rows only. An empty batch keeps the state.
    """

    def previous(spark: SparkSession, batch: int) -> DataFrame | None:
        for b in range(batch - 1, -1, -1):
            try:
                return spark.read.parquet(f"{folder}/subscribed/batch={b}").select(key)
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        return None

    def step(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        latest = df.agg(F.max(at)).first()[0]
        if latest is None:
            return
        wanted = catalog(spark, latest).select(key).where(F.col(key).isNotNull()).distinct()
        wanted.write.mode("overwrite").parquet(f"{folder}/subscribed/batch={batch}")
        now = spark.read.parquet(f"{folder}/subscribed/batch={batch}").select(key)
        before = previous(spark, batch)
        before = now.where("false") if before is None else before
        subscription_changes(before, now, key).withColumn("at", F.lit(latest)).write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

    return messages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tideline.operators import cursor
from tideline.sources import ledgers
from tideline.streaming import live


def test_stream_cursor_equals_batch(spark, tmp_path):
    rows = [(i % 3, i, 1000 + i * 700 + (i % 7) * 3) for i in range(900)]
    schema = "component_id int, trade_id bigint, timestamp_unix bigint"
    for part in range(3):
        spark.createDataFrame(rows[part * 300 : part * 300 + 300], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.decisions(stream).writeStream.format("memory").queryName("cursor").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["component_id"], r["trade_id"], r["n"], tuple(r["reasons"])) for r in spark.table("cursor").collect()}
    want = {(r["component_id"], r["trade_id"], r["n"], tuple(r["reasons"])) for r in cursor.decisions(spark.createDataFrame(rows, schema)).collect()}
    assert got == want


def test_messages_are_exploded_and_appended_by_hour(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ms = 1_700_000_000_000
    lines = [{"received_at_ms": ms + i * 1_800_000, "record_type": "m", "source": "s", "payload": json.dumps(["a", "b"]) if i % 2 else "x"} for i in range(4)]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    q = live.append_hours(live.explode_items(live.read_messages(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 6 and out.select("hour").distinct().count() >= 2
    assert sorted(r["item"] for r in out.where("message_item_index = 1").collect()) == ["b", "b"]


def test_tumbling_flow_in_batch_form(spark):
    t = spark.createDataFrame([(1, 10, 2.0), (1, 86_399, 3.0), (1, 86_400, 4.0)], "market_id int, timestamp_unix bigint, notional_usd double")
    assert sorted((r["n"], r["notional"]) for r in live.tumbling_flow(t).collect()) == [(1, 4.0), (2, 5.0)]


def test_subscriptions_and_health(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "token_id int"), spark.createDataFrame([(2,), (3,)], "token_id int")
    assert {tuple(r) for r in live.subscription_changes(a, b).collect()} == {("add", 3), ("remove", 1)}
    s = spark.createDataFrame([("x", 1000), ("y", 500_000)], "source string, received_at_ms bigint")
    assert {tuple(r) for r in live.healthy(s, 600_000).collect()} == {("x", False), ("y", True)}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(i, 1_700_000_000 + i * 40_000) for i in range(10)], "trade_id int, timestamp_unix bigint")
    ledgers.write_days(df, str(tmp_path / "days"))
    back = spark.read.parquet(str(tmp_path / "days"))
    assert back.count() == 10 and back.where(F.col("date") == datetime.date(2023, 11, 15)).count() == 2
    ledgers.write_json_lines(df, str(tmp_path / "lines"))
    assert ledgers.read_json_lines(spark, str(tmp_path / "lines"), df.schema).count() == 10
    assert sum(r["rows"] for r in ledgers.line_counts(spark, str(tmp_path / "lines")).collect()) == 10
    m = ledgers.manifest(spark, str(tmp_path / "lines"))
    assert m.count() >= 1 and all(len(r["sha256"]) == 64 for r in m.collect())
    (tmp_path / "bad.json").write_text('{"trade_id": 1}\n[oops\n')
    with pytest.raises(Exception):
        ledgers.read_json_lines(spark, str(tmp_path / "bad.json"), df.schema).collect()


def test_settled_days(spark):
    d = datetime.date
    files = spark.createDataFrame([(d(2024, 1, 1), 100), (d(2024, 1, 1), 200), (d(2024, 1, 2), 1_704_240_000)], "date date, modified_unix bigint")
    assert [r["date"] for r in ledgers.settled_days(files, 1_704_240_100).collect()] == [d(2024, 1, 1)]

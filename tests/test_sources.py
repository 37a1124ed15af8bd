"""Checked shards, live files, manifests, exact prices, ledger profiles and split plans, against plain Python."""

import hashlib
import json
import random
import re
from datetime import datetime, timezone
from decimal import Decimal, localcontext

import pytest
import zstandard
from pyspark.sql import functions as F

from tideline.functions import scalar as S
from tideline.operators import logs, quality
from tideline.sources import ledgers, shards


def test_shards_are_counted_and_checked(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c", None]), i, rng.choice(["é", "x" * 500, ""])) for i in range(3000)]
    df = spark.createDataFrame(rows, "day string, i int, t string").repartition(5)
    folder = f"file://{tmp_path}/out"
    line = F.concat_ws("|", F.col("i").cast("string"), "t")
    out = shards.write_shards(df, folder, line, "day", ("i",))
    for r in out.collect():
        want = "".join(f"{i}|{t}\n" for d, i, t in rows if d == r["day"]).encode()
        raw = (tmp_path / "out" / r["file"]).read_bytes()
        assert zstandard.ZstdDecompressor().decompressobj().decompress(raw) == want and zstandard.get_frame_parameters(raw).has_checksum
        assert (r["rows"], r["bytes"], r["sha256"], r["content_sha256"]) == (want.count(b"\n"), len(raw), hashlib.sha256(raw).hexdigest(), hashlib.sha256(want).hexdigest())
    assert sorted(r["day"] for r in out.collect()) == ["a", "b", "c"] and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".part") and not p.name.endswith(".crc")]
    back = shards.read_shards(out, folder)
    assert sorted(r["line"] for r in back.collect()) == sorted(f"{i}|{t}" for d, i, t in rows if d)
    assert shards.changed_files(out, folder).count() == 0 and shards.shard_names(spark, folder).count() == 3
    first, second, third = (tmp_path / "out" / r["file"] for r in out.orderBy("day").collect())
    data = bytearray(first.read_bytes())
    data[len(data) // 2] ^= 1
    first.write_bytes(data)
    second.write_bytes(second.read_bytes() + b"x")
    third.unlink()
    assert {r["file"]: r["problem"] for r in shards.changed_files(out, folder).collect()} == {first.name: "content changed", second.name: "size changed", third.name: "missing"}
    with pytest.raises(Exception):
        shards.read_shards(out.where("day = 'a'"), folder).collect()


def test_shards_without_a_key(spark, tmp_path):
    df = spark.range(1000).repartition(3)
    out = shards.write_shards(df, f"file://{tmp_path}/o", F.col("id").cast("string"), order=("id",))
    assert out.columns == ["file", "rows", "bytes", "sha256", "content_sha256"] and sum(r["rows"] for r in out.collect()) == 1000
    assert shards.write_shards(df.where("false"), f"file://{tmp_path}/p", F.col("id").cast("string")).count() == 0


def test_live_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "PIECE", 7)
    cases = {"ended": b"a\nbb\n", "open": b"a\nbb\nccc", "empty": b"", "one": b"no end", "blank": b"\n\n"}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
        (tmp_path / f"{name}.zst").write_bytes(zstandard.compress(data))
    files = spark.createDataFrame([(n + e,) for n in cases for e in ("", ".zst")], "file string")
    got = {r["file"]: (r["rows"], r["is_open"]) for r in shards.live_counts(files, f"file://{tmp_path}").collect()}
    assert got == {n + e: (d.count(b"\n"), bool(d) and not d.endswith(b"\n")) for n, d in cases.items() for e in ("", ".zst")}
    whole = {r["file"].rsplit("/", 1)[-1]: r["rows"] for r in ledgers.line_counts(spark, f"file://{tmp_path}/open").collect()}
    assert whole == {"open": 3} and got["open"] == (2, True)


def test_manifest_of_small_and_large_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledgers, "WHOLE_BYTES", 100)
    (tmp_path / "d" / "e").mkdir(parents=True)
    cases = {"d/small": b"x" * 100, "d/e/large": b"y" * 101, "d/none": b"", "d/_hidden": b"h", "d/e/.dot": b"h"}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    got = {(r["name"], r["bytes"], r["sha256"]) for r in ledgers.manifest(spark, f"file://{tmp_path}/d").collect()}
    assert got == {(n.rsplit("/", 1)[-1], len(d), hashlib.sha256(d).hexdigest()) for n, d in cases.items() if d and n.rsplit("/", 1)[-1][0] not in "._"}


def test_streamed_digests(spark):
    rows = [(k, f"{i:03d}", i * i) for k in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o string, v int").repartition(7)
    line = F.concat("o", F.lit(":"), F.col("v").cast("string"), F.lit("\n"))
    want = hashlib.sha256("".join(f"{i:03d}:{i * i}\n" for i in range(200)).encode()).hexdigest()
    assert {tuple(r) for r in shards.streamed_digest(df, line, "o", "k").collect()} == {("a", want), ("b", want)}
    assert [r["digest"] for r in ledgers.digest_of(df.where("k = 'a'"), "o", "v").collect()] == [want]
    assert [r["digest"] for r in ledgers.digest_of(df.where("false"), "o", "v").collect()] == [hashlib.sha256(b"").hexdigest()]


def test_exact_prices(spark):
    cases = [("1", "3"), ("123456789012345678901234567890", "7"), ("0", "5"), ("5", "0"), (None, "1"), ("10", "4"), (str(2**256 - 1), "1000000"), ("1", str(2**255))]
    with localcontext() as context:
        context.prec = 50
        want = [None if c is None or t == "0" else format(Decimal(c) / Decimal(t), "f") for c, t in cases]
    got = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, c string, t string").select("i", logs.exact_price(F.col("c"), F.col("t")).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in got] == want


def test_ids_tell_null_from_nothing(spark):
    row = spark.createDataFrame([("a", None, "b")], "x string, y string, z string").select(S.stable_id("x", "y", "z").alias("p"), S.stable_id("x", "z").alias("q"), S.stable_id("x", "z", "y").alias("r")).first()
    assert len({row["p"], row["q"], row["r"]}) == 3 and row["q"] == hashlib.sha256(b"a|b").hexdigest()


GOOD = {
    "schema_version": "1.0.0", "record_type": "public_trade", "source": "api", "trade_id": "a" * 64, "condition_id": "0x" + "b" * 64, "token_id": "123", "wallet": "0x" + "c" * 40, "side": "BUY", "price": "0.25", "size": "200", "notional_usd": "50.00",
    "timestamp": "2024-01-01T00:00:10Z", "timestamp_unix": "1704067210", "transaction_hash": "0x" + "d" * 64, "outcome": "Yes", "outcome_index": "0",
}


def plain_faults(r, start, end):
    def number(c):
        try:
            return Decimal(r[c])
        except Exception:
            return None

    p, s, n = number("price"), number("size"), number("notional_usd")
    below = n is not None and 0 < n < 25
    out = {f"missing_{c}" for c in quality.REQUIRED if r[c] in (None, "")}
    checks = {
        "invalid_trade_id": not re.fullmatch("[a-f0-9]{64}", r["trade_id"] or ""), "invalid_condition_id": not re.fullmatch("0x[a-f0-9]{64}", r["condition_id"] or ""), "invalid_wallet": not re.fullmatch("0x[a-f0-9]{40}", r["wallet"] or ""),
        "invalid_transaction_hash": not re.fullmatch("0x[a-f0-9]{64}", r["transaction_hash"] or ""), "invalid_token_id": not (r["token_id"] or "").isdigit(), "invalid_side": r["side"] not in ("BUY", "SELL"), "invalid_schema_version": r["schema_version"] != "1.0.0",
        "invalid_record_type": r["record_type"] != "public_trade", "invalid_price": p is None or not 0 < p < 1, "invalid_size": s is None or s <= 0, "invalid_notional": n is None or n <= 0, "notional_below_filter": below,
        "below_with_large_size": below and s is not None and s >= 25, "below_with_large_complement": below and None not in (p, s) and s * (1 - p) >= 25, "below_with_either_large": below and None not in (p, s) and max(s * p, s * (1 - p)) >= 25,
        "inconsistent_notional": None not in (p, s, n) and s * p != n, "outcome_null": r["outcome"] is None, "outcome_index_null": r["outcome_index"] is None,
    }
    try:
        t = int(r["timestamp_unix"])
        checks |= {"timestamp_outside_window": not start <= t < end, "timestamp_text_mismatch": r["timestamp"] != datetime.fromtimestamp(t, tz=timezone.utc).isoformat().replace("+00:00", "Z")}
    except (TypeError, ValueError):
        checks["invalid_timestamp"] = True
    return out | {k for k, v in checks.items() if v}


def test_ledger_profile(spark):
    changes = [
        {}, {"trade_id": "A" * 64}, {"trade_id": None}, {"condition_id": ""}, {"wallet": "0x12"}, {"transaction_hash": "0x" + "g" * 64}, {"token_id": "1.5"}, {"side": None}, {"schema_version": "2"}, {"record_type": None}, {"price": "1"}, {"price": "x"}, {"price": None}, {"size": "0"},
        {"size": "-3"}, {"notional_usd": "0"}, {"notional_usd": "24.99"}, {"notional_usd": "0.5", "size": "2"}, {"notional_usd": "4.999", "size": "20", "price": "0.24995"}, {"notional_usd": "20", "size": "30", "price": "0.9"}, {"notional_usd": None}, {"timestamp_unix": "soon"}, {"timestamp_unix": "1704067209"},
        {"timestamp": None}, {"timestamp_unix": "1", "timestamp": "1970-01-01T00:00:01Z"}, {"outcome": None}, {"outcome_index": None}, {"source": ""},
    ]
    start, end = 1704067200, 1704067300
    rows = [GOOD | c for c in changes]
    schema = ", ".join(f"{c} string" for c in GOOD) + ", file int, o int"
    df = spark.createDataFrame([(*r.values(), i % 2, i) for i, r in enumerate(rows)], schema)
    got = quality.ledger_profile(df, start, end, "file", "o").first().asDict()
    want = [plain_faults(r, start, end) for r in rows]
    for k in quality.ledger_predicates(start, end):
        assert got[k] == sum(k in w for w in want), k
    ids = [r["trade_id"] or "" for r in rows]
    assert (got["n_rows"], got["n_ids"], got["repeated_ids"]) == (len(rows), len(set(ids)), len(ids) - len(set(ids)))
    assert (got["below_lt_1"], got["below_lt_5"], got["below_lt_10"], got["below_lt_20"], got["below_lt_25"]) == (1, 1, 0, 0, 2)
    back = sum(a > b for k in (0, 1) for ts in [[int(r["timestamp_unix"]) if r["timestamp_unix"].isdigit() else None for r in rows[k::2]]] for a, b in zip(ts, ts[1:]) if None not in (a, b))
    assert got["file_order_violations"] == back


def test_split_plans(spark):
    plan = spark.createDataFrame([("p", "a", 0, 10), ("p", "b", 12, 20), ("p", "c", 21, 30), ("q", "a", 0, 10), ("q", "a", 12, 12), ("r", "a", 5, 9)], "plan string, segment string, start_ts bigint, end_ts bigint")
    assert {tuple(r) for r in quality.plan_violations(plan, "plan", embargo=2).collect()} == {("p", "c", "embargo"), ("q", "a", "repeated"), ("q", "a", "no length")}
    at = spark.createDataFrame([("p", t) for t in (-1, 0, 9, 10, 11, 12, 29, 30)] + [("z", 1)], "plan string, t bigint")
    got = {(r["plan"], r["t"]): r["segment"] for r in quality.locate(at, plan, "t", "plan").collect()}
    assert got == {("p", -1): None, ("p", 0): "a", ("p", 9): "a", ("p", 10): None, ("p", 11): None, ("p", 12): "b", ("p", 29): "c", ("p", 30): None, ("z", 1): None}


def test_json_documents(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({"id": i, "rows": [{"a": "x\ny"}, {"a": None}]}, indent=2))
    got = ledgers.read_json_documents(spark, f"file://{tmp_path}", "id int, rows array<struct<a:string>>").collect()
    assert sorted((r["id"], [x["a"] for x in r["rows"]]) for r in got) == [(i, ["x\ny", None]) for i in range(3)]
    rows = spark.createDataFrame([(i, f'say "{i}"\n', None if i % 2 else [i]) for i in range(50)], "id int, t string, l array<int>").repartition(3)
    ledgers.write_json_documents(rows, f"file://{tmp_path}/arrays")
    assert all(isinstance(json.loads(f.read_text()), list) for f in (tmp_path / "arrays").glob("part-*"))
    assert sorted(ledgers.read_json_documents(spark, f"file://{tmp_path}/arrays", rows.schema).collect()) == sorted(rows.collect())
    (tmp_path / "bad.json").write_text("[1, 2")
    with pytest.raises(Exception):
        ledgers.read_json_documents(spark, f"file://{tmp_path}", "id int, rows array<struct<a:string>>").collect()

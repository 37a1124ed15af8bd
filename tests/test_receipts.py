"""Receipts, proofs, replay targets, affordable sizes, consensus, candidate vectors and refreshed subscriptions, against plain Python."""

import hashlib
import json
import random
from decimal import ROUND_FLOOR, ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import DATA
from tideline.functions import canonical
from tideline.operators import candidates, fees, receipts
from tideline.plans import queries_receipts
from tideline.streaming import live


def merged(ranges):
    out = []
    for a, z in sorted(r for r in ranges if r[0] < r[1]):
        if out and a <= out[-1][1]:
            out[-1] = [out[-1][0], max(out[-1][1], z), out[-1][2] + 1]
        else:
            out.append([a, z, 1])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_islands(spark, width):
    rng = random.Random(width)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("ab"), (a := rng.randrange(-300, 900)), a + rng.choice([0, 1, 2, 5, 40])) for _ in range(400)] + [(None, 1, 2), ("x", None, 3), ("y", 5, 5)]
    got = receipts.islands(spark.createDataFrame(rows, "k string, start_ts bigint, end_ts bigint"), ["k"], width).collect()
    want = [(k, *r) for k in {r[0] for r in rows} - {None, "x"} for r in merged([r[1:] for r in rows if r[0] == k])]
    assert sorted((r["k"], r["start_ts"], r["end_ts"], r["n"]) for r in got) == sorted(want)


def test_range_audit(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), (a := rng.randrange(0, 90)), a + rng.choice([1, 3, 8])) for _ in range(60)] * 2 + [("a", 200, 210), ("d", 1, 3)]
    spans = {"a": (0, 100), "b": (-5, 120), "c": (40, 60), "e": (7, 9)}
    got = receipts.range_audit(spark.createDataFrame(rows, "s string, start_ts bigint, end_ts bigint"), spark.createDataFrame([(s, *r) for s, r in spans.items()], "s string, start_ts bigint, end_ts bigint"), "s", 25)
    want = []
    for s in {r[0] for r in rows} | set(spans):
        own = [r[1:] for r in rows if r[0] == s]
        for a, z, n in merged(own):
            want.append((s, "covered", a, z, n))
        depth = {}
        for a, z in set(own):
            for t in range(a, z):
                depth[t] = depth.get(t, 0) + 1
        want += [(s, "repeated", a, z, own.count((a, z))) for a, z in set(own) if own.count((a, z)) > 1]
        span = spans.get(s)
        want += [(s, "outside", a, z, own.count((a, z))) for a, z in set(own) if span is None or a < span[0] or z > span[1]]
        if span:
            want += [(s, "missing", a, z, 0) for a, z, _ in merged([(t, t + 1) for t in range(*span) if t not in depth])]
        want += [(s, "overlap", a, z, max(depth[t] for t in range(a, z))) for a, z, _ in merged([(t, t + 1) for t in depth if depth[t] > 1])]
    assert sorted((r["s"], r["kind"], r["start_ts"], r["end_ts"], r["n"]) for r in got.collect()) == sorted(want)


PROOF = "tx string, o int, status string, block bigint, logs array<struct<data:string,logIndex:string>>"


def test_proofs_merge_by_content(spark):
    rows = [
        ("0xAA", 1, "0x1", 16, [("0x01", "1"), ("0x02", "2")]), ("0xaa", 2, "0x1", 16, [("0x02", "2"), (None, "3"), ("0x01", "1")]), ("0xaa", 3, "0x1", 16, [(None, "3"), None, ("0x01", None)]),
        ("0xbb", 1, "0x1", 5, []), ("0xbb", 2, None, 6, [("a", "b")]), ("0xcc", 1, None, None, None), ("0xcc", 1, None, None, None),
    ]
    got = {r["tx"]: r for r in receipts.merge_proofs(spark.createDataFrame(rows, PROOF), "tx", "o", ["status", "block"]).collect()}
    assert [tuple(x) for x in got["0xaa"]["logs"]] == [("0x01", "1"), ("0x02", "2"), (None, "3"), ("0x01", None)]
    assert (got["0xaa"]["n_proofs"], got["0xaa"]["status"], got["0xaa"]["block"], got["0xaa"]["conflicts"]) == (3, "0x1", 16, [])
    assert (got["0xbb"]["conflicts"], got["0xbb"]["status"], got["0xbb"]["block"], len(got["0xbb"]["logs"])) == (["status", "block"], None, None, 1)
    assert (got["0xcc"]["conflicts"], got["0xcc"]["logs"], got["0xcc"]["n_proofs"]) == ([], [], 2)


AUDIT = "kind string, id string, condition_id string, timestamp_unix bigint, expires_unix bigint, ref string, order_id string"


def test_replay_targets(spark):
    rows = [
        ("order", "o1", "0xA", 100, 110, "l1", None), ("decision", "d1", "0xa", 105, None, "l1", None), ("decision", "d1", "0xa", 900, None, "l9", None), ("decision", "d2", "0xa", 138, None, "l2", None),
        ("fill", None, None, 108, None, "l3", "o1"), ("miss", None, "0xB", 7, None, "l4", None), ("miss", None, "0xB", 8, None, "l5", None), ("miss", None, "0xB", 10, None, "l5", None),
    ]
    df = spark.createDataFrame(rows, AUDIT)
    spans, refs = receipts.replay_targets(df, 33, width=10)
    assert {tuple(r) for r in spans.collect()} == {("0xa", 100, 171, 3), ("0xb", 7, 9, 2), ("0xb", 10, 11, 1)}
    assert sorted(tuple(r) for r in refs.collect()) == [("l1", "0xa", 100), ("l1", "0xa", 105), ("l2", "0xa", 138), ("l3", "0xa", 108), ("l4", "0xb", 7), ("l5", "0xb", 8), ("l5", "0xb", 10)]
    with pytest.raises(Exception, match="fill without an order"):
        receipts.replay_targets(df.unionByName(spark.createDataFrame([("fill", None, None, 1, None, "l7", "o9")], AUDIT)), 33)[1].collect()


def fee_of(shares, price, rate, exponent, formula="curve"):
    raw = shares * rate * (price * (1 - price)) ** exponent if formula == "curve" else shares * rate * min(price, 1 - price)
    return raw.quantize(Decimal("0.00001"), ROUND_HALF_UP)


def affordable(total, price, rate, exponent):
    micro = Decimal("0.000001")
    size = (total / price).quantize(micro, ROUND_FLOOR)
    for _ in range(16):
        if size <= 0:
            return Decimal(0)
        cost = fee_of(size, price, rate, exponent)
        if size * price + cost <= total:
            return size
        less = ((total - cost) / price).quantize(micro, ROUND_FLOOR)
        size = less if less < size else size - micro
    return None


def test_affordable_shares(spark):
    rng = random.Random(2)
    rows = [(i, Decimal(rng.randrange(1, 10**7)) / 10**rng.choice([2, 4, 6]), Decimal(rng.randrange(1, 100)) / 100, Decimal(rng.randrange(0, 90)) / 1000, rng.randrange(2)) for i in range(400)]
    rows += [(1000, Decimal("0.007299"), Decimal("0.02"), Decimal(0), 1), (1001, Decimal(0), Decimal("0.5"), Decimal("0.02"), 1), (1002, Decimal("0.000001"), Decimal("0.99"), Decimal("0.02"), 1), (1003, Decimal(-4), Decimal("0.5"), Decimal("0.02"), 1)]
    df = spark.createDataFrame(rows, "i int, total decimal(18,6), p decimal(10,6), r decimal(8,6), e int")
    got = {r["i"]: r["s"] for r in df.select("i", fees.affordable_shares(F.col("total"), F.lit("v2"), F.lit(fees.CURVE), F.col("p"), F.col("r"), F.col("e")).alias("s")).collect()}
    for i, total, p, r, e in rows:
        want = affordable(total, p, r, e) if total > 0 else Decimal(0)
        assert got[i] == want, (i, total, p, r, e)
        if want:
            assert got[i] * p + fee_of(got[i], p, r, e) <= total
    assert df.select(fees.affordable_shares(F.lit(5), F.lit("v2"), F.lit(fees.CURVE), F.lit(0), F.col("r"), F.col("e"))).first()[0] is None


def test_consensus_of_receipts(spark):
    D = Decimal

    def fill(key, tx, shares, price, fee, preferred="curve"):
        return (key, tx, D(shares), D(price), fee, preferred)

    rows = [
        *(fill("same", f"t{i}", 1000 + i, f"0.{20 + i}", fee_of(D(1000 + i), D(f"0.{20 + i}"), D("0.03"), 1)) for i in range(4)),
        fill("one", "t1", 1000, "0.2", fee_of(D(1000), D("0.2"), D("0.03"), 1)), fill("one", "t1", 1000, "0.2", fee_of(D(1000), D("0.2"), D("0.03"), 1)),
        *(fill("split", f"t{i}", 1000, "0.3", fee_of(D(1000), D("0.3"), D(r), 1)) for i, r in enumerate(["0.02", "0.03"])), *(fill("odd", f"t{i}", 1000, "0.3", D("999")) for i in range(2)),
        *(fill("tie", f"t{i}", 1000, "0.5", fee_of(D(1000), D("0.5"), D("0.04"), 1), "other") for i in range(2)), *(fill("told", f"t{i}", 1000, "0.5", fee_of(D(1000), D("0.5"), D("0.04"), 1), "curve") for i in range(2)),
        # rounded to four places: alone, the first receipt fits two rates
        fill("together", "t0", "0.02", "0.5", D("0.0001")), fill("together", "t1", 5000, "0.4", fee_of(D(5000), D("0.4"), D("0.02"), 1)),
    ]
    df = spark.createDataFrame(rows, "market_id string, transaction_hash string, shares decimal(18,6), price decimal(10,6), fee decimal(20,5), preferred string")
    found = {r["market_id"]: r for r in fees.consensus(df, [(fees.CURVE, 1), (fees.MIN_CURVE, 0)], ["0.01", "0.02", "0.03", "0.04"]).collect()}
    assert {k: r["status"] for k, r in found.items()} == {"same": "unique", "one": "too few", "split": "disjoint", "odd": "unmatched", "tie": "ambiguous", "told": "unique", "together": "unique"}
    assert (found["same"]["formula"], found["same"]["exponent"], found["same"]["rate"]) == ("curve", 1, D("0.030000")) and found["same"]["residual"] == 0
    assert found["tie"]["n_left"] == 2 and found["tie"]["formula"] is None and found["told"]["formula"] == "curve" and found["one"]["n_receipts"] == 1
    assert found["together"]["rate"] == D("0.020000")


def test_book_violations(spark):
    book = spark.createDataFrame([("a", "official_x", "1"), ("b", "receipt_consensus", "2"), ("c", "receipt", "3"), ("d", "receipt", "4"), ("d", "receipt", "4")], "schedule_id string, source string, rate string")
    sha = {i: hashlib.sha256(json.dumps({"schedule_id": i, "source": s, "rate": r}, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for i, s, r in (("a", "official_x", "1"), ("b", "receipt_consensus", "2"), ("c", "receipt", "9"), ("d", "receipt", "4"), ("z", "receipt", "4"))}
    tx = ["0x" + str(k) * 64 for k in range(4)]
    proofs = spark.createDataFrame([("b", tx[0], "0x1"), ("b", tx[0].upper().replace("0X", "0x"), "0x1"), ("c", tx[1], "0x1"), ("d", tx[2], "0x0"), ("y", tx[3], "0x1"), ("c", "0x12", "0x1")], "schedule_id string, transaction_hash string, status string")
    got = {tuple(r) for r in fees.book_violations(book, proofs, spark.createDataFrame(list(sha.items()), "schedule_id string, sha256 string")).collect()}
    assert got == {("b", "proof repeated"), ("b", "too few proofs"), ("c", "content changed"), ("c", "proof invalid"), ("d", "schedule repeated"), ("d", "proof invalid"), ("d", "too few proofs"), ("y", "proof without schedule"), ("z", "schedule missing")}
    sound = book.where("schedule_id = 'a'")
    assert fees.book_violations(sound, proofs.where("false"), spark.createDataFrame([("a", sha["a"])], "schedule_id string, sha256 string")).count() == 0


def candidate_rows(rng, n):
    return [(i, *map(float, rng.normal(size=2) * [20, 1]), *(rng.uniform(0.01, 0.99, k).tolist() for k in (9, 7, 3, 3, 2)), rng.uniform(0.5, 90, 2).tolist(), rng.uniform(0, 1, 2).tolist(), int(rng.integers(2))) for i in range(n)]


def test_candidate_vectors(spark):
    rng = np.random.default_rng(8)
    rows = candidate_rows(rng, 50)
    kinds = ", ".join(f"{k} {'array<double>' if n else 'int' if k == 'action' else 'double'}" for k, n in candidates.INPUTS.items())
    inputs = spark.createDataFrame(rows, f"trade_id bigint, {kinds}")
    pack_values = rng.normal(size=(50, candidates.PACK)).astype(np.float32)
    pack = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(pack_values)], "trade_id bigint, " + ", ".join(f"f_{i:03d} float" for i in range(candidates.PACK)))
    got = {r["trade_id"]: r["vector"] for r in candidates.assemble(pack, inputs).collect()}
    assert candidates.WIDTH == 170 and len(set(candidates.NAMES)) == 42
    for i, logit, scale, portfolio, memory, base, value, prices, payouts, probs, side in rows:
        yes = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        p, even, terminal = prices[side], min(1.0, 1 / max(payouts[side], 1e-8)), (yes, 1 - yes)[side]
        clipped = min(max(p, 1e-6), 1 - 1e-6)
        own = [logit, scale, *portfolio, *memory, *base, *value, *prices, *payouts, *probs, side == 0, side == 1, p, prices[1 - side], payouts[side], even, probs[side], terminal, probs[side] - even, terminal - even, np.log(clipped / (1 - clipped)), payouts[side] - 1]
        assert np.allclose(got[i], [*pack_values[i], *own], rtol=1e-5, atol=1e-6)
    for change in ({"action": F.lit(2)}, {"portfolio": F.slice("portfolio", 1, 8)}, {"payouts": F.array(F.lit(float("nan")), F.lit(float("nan")))}, {"trade_id": F.col("trade_id") + 1}):
        with pytest.raises(Exception, match="no sound candidate vector"):
            candidates.assemble(pack, inputs.withColumns(change)).collect()
    with pytest.raises(ValueError):
        candidates.assemble(pack.drop("f_005"), inputs)


def test_candidates_in_place_equal_joined_ones(spark):
    """Inputs made of columns of the pack's rows: the same vectors and errors, and the query joins no trades to the pack."""
    rng = np.random.default_rng(9)
    kinds = ", ".join(f"{k} {'array<double>' if n else 'int' if k == 'action' else 'double'}" for k, n in candidates.INPUTS.items())
    inputs = spark.createDataFrame(candidate_rows(rng, 20), f"trade_id bigint, {kinds}")
    pack = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(20, candidates.PACK)).astype(np.float32))], "trade_id bigint, " + ", ".join(f"f_{i:03d} float" for i in range(candidates.PACK)))
    rows, own = pack.join(inputs, "trade_id"), {k: F.col(k) for k in candidates.INPUTS}
    want = {r["trade_id"]: (r["action"], r["vector"]) for r in candidates.assemble(pack, inputs).collect()}
    assert {r["trade_id"]: (r["action"], r["vector"]) for r in candidates.in_place(rows, own).collect()} == want and len(want) == 20
    bad = F.col("trade_id") == 7
    for c, v in (("f_003", None), ("f_127", float("nan")), ("f_000", float("inf")), ("f_064", float("-inf")), ("action", 2), ("terminal_logit", None), ("uncertainty_log_scale", float("-inf"))):
        changed = rows.withColumn(c, F.when(bad, F.lit(v)).otherwise(F.col(c)).cast(rows.schema[c].dataType))
        with pytest.raises(Exception, match="no sound candidate vector for 7"):
            candidates.in_place(changed, own).collect()
    with pytest.raises(ValueError):
        candidates.in_place(rows.drop("f_005"), own)
    plan = queries_receipts.c30_candidate_vectors(spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    assert "hashpartitioning(trade_id" not in plan and "MapInPandas" in plan


def test_refresh_is_exactly_once_over_a_restart(spark, tmp_path):
    wanted = {10: ["a", "b"], 20: ["b", "c"], 30: ["b", "c"], 40: [], 50: ["a"]}
    inbox, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))

    def catalog(s, at):
        return s.createDataFrame([(k,) for k in [*wanted[at], *wanted[at], None]], "token_id string")

    def run():
        source = spark.readStream.schema("at_ts bigint").option("maxFilesPerTrigger", 1).json(inbox)
        live.refresh_subscriptions(source, catalog, "token_id", out, state, "at_ts").awaitTermination()

    def add(at):
        spark.createDataFrame([(at,)], "at_ts bigint").coalesce(1).write.mode("append").json(inbox)

    for at in (10, 20, 30):
        add(at)
    run()
    # as if the driver had died before the last batch was committed: it runs again
    (tmp_path / "state" / "commits" / "2").unlink()
    (tmp_path / "state" / "commits" / ".2.crc").unlink(missing_ok=True)
    for at in (40, 50):
        add(at)
    run()
    got = sorted((r["at"], r["change"], r["token_id"]) for r in spark.read.parquet(f"{out}/changes").collect())
    assert got == [(10, "add", "a"), (10, "add", "b"), (20, "add", "c"), (20, "remove", "a"), (40, "remove", "b"), (40, "remove", "c"), (50, "add", "a")]


def test_canonical_digest_ignores_the_order_of_fields(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string").select(F.struct("a", "b").alias("p"), F.struct("b", "a").alias("q"))
    row = df.select(*(canonical.digest(F.col(c), df.schema[c].dataType).alias(c) for c in "pq")).first()
    assert row["p"] == row["q"]


def test_merged_proofs_read_their_source_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    proofs = spark.range(20).selectExpr("concat('0xA', id div 2) as tx", "id as o", "'1' as status", "id div 2 as block", "array(named_struct('data', string(id))) as logs")
    merged = receipts.merge_proofs(proofs.mapInPandas(count, proofs.schema), "tx", "o", ["status", "block"]).collect()
    assert len(merged) == 10 and all(len(r["logs"]) == 2 for r in merged) and seen.value == 20

"""Adaptive windows, groups under two limits, out-of-fold fits, canonical digests and merged sketches, against plain Python."""

import hashlib
import json
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import canonical
from tideline.operators import crossfit, distinct, planning


def bisected(times, start, end, limit, least, level=0):
    n = sum(start <= t <= end for t in times)
    if n > limit and end - start > least:
        middle = start + (end - start) // 2
        return bisected(times, start, middle, limit, least, level + 1) + bisected(times, middle + 1, end, limit, least, level + 1)
    return [(start, end, level, n, n > limit)]


@pytest.mark.parametrize("limit, least", [(3, 0), (1, 4), (0, 0), (10_000, 0), (5, 10_000)])
def test_windows_cover_exactly(spark, limit, least):
    rng = random.Random(limit)
    spans = [("a", 100, 107), ("b", 0, 999), ("c", 5, 5), ("d", -300, 12), ("b", 2000, 2500), ("empty", 3, 40), ("none", 9, 3)]
    rows = [(rng.choice("abcdx"), rng.choice([rng.randrange(-400, 2600), 500])) for _ in range(800)] + [("a", t) for t in range(90, 120)] + [("c", 5)] * 4 + [(None, 5), ("a", None)]
    got = planning.adaptive_windows(spark.createDataFrame(rows, "s string, t bigint"), spark.createDataFrame(spans, "s string, start_ts bigint, end_ts bigint"), "s", "t", limit, least).collect()
    want = [(s, *w) for s, a, b in spans if a <= b for w in bisected([t for k, t in rows if k == s and t is not None], a, b, limit, least)]
    assert sorted((r["s"], r["start_ts"], r["end_ts"], r["level"], r["n_rows"], r["is_gap"]) for r in got) == sorted(want)


def test_windows_without_spans(spark):
    none = spark.createDataFrame([], "s string, start_ts bigint, end_ts bigint")
    assert planning.adaptive_windows(spark.createDataFrame([("a", 1)], "s string, t bigint"), none, "s", "t", 1).count() == 0


def walked(volumes, most_rows, most_volume):
    out, group, rows, total = [], -1, None, Decimal(0)
    for v in volumes:
        if rows is None or v >= most_volume or rows >= most_rows or total + v > most_volume:
            group, rows, total = group + 1, 0, Decimal(0)
        out.append(group)
        rows, total = rows + 1, total + v
        if v >= most_volume:
            rows = None
    return out


@pytest.mark.parametrize("block, most_rows", [(5, 5), (8, 3), (64, 7), (1 << 16, 4), (1, 1)])
def test_groups_equal_the_walk(spark, block, most_rows):
    rng = random.Random(block)
    n = 60 if block < 5 else 300
    volumes = [Decimal(rng.choice([0, 1, 25, 60, 99, 100, 250, rng.randrange(120)])) + Decimal(rng.randrange(100)) / 100 for _ in range(n)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(volumes)], "i int, v decimal(12,2)")
    got = {r["i"]: r["group"] for r in planning.groups_under(rows.repartition(3), [F.col("i")], "v", most_rows, 100, block).collect()}
    assert [got[i] for i in range(n)] == walked(volumes, most_rows, 100)


def test_groups_of_few_rows(spark):
    rows = spark.createDataFrame([("large", "1500000"), ("medium-a", "600000"), ("medium-b", "300000"), ("medium-c", "200000"), ("none", None)], "id string, v string")
    got = planning.groups_under(rows, [F.col("v").cast("double").desc_nulls_last()], "v", 100, 1_000_000)
    assert {r["id"]: r["group"] for r in got.collect()} == {"large": 0, "medium-a": 1, "medium-b": 1, "medium-c": 2, "none": 2}
    assert planning.groups_under(rows.where("false"), [F.col("v")], "v", 2, 10).count() == 0
    with pytest.raises(ValueError):
        planning.groups_under(rows, [F.col("v")], "v", 20, 10, block=10)


def test_out_of_fold_equals_refitting(spark):
    rng = np.random.default_rng(3)
    n = 3000
    comp = rng.integers(0, 120, n)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 3, -1]
    y, w = x @ [1.0, -0.3, 4.0] + rng.normal(size=n), rng.uniform(0.5, 2, n)
    rows = spark.createDataFrame([(i, int(c), *map(float, v), float(a), float(b)) for i, (c, v, a, b) in enumerate(zip(comp, x, y, w))], "i int, c bigint, x0 double, x1 double, x2 double, y double, w double")
    penalties = (0.0, 50.0, 5000.0)
    df, models = crossfit.out_of_fold(rows, "c", ["x0", "x1", "x2"], "y", "w", folds=4, seed=23, penalties=penalties)
    got = df.select("i", "c", "fold", "prediction").collect()
    assert sorted(r["i"] for r in got) == list(range(n))
    fold = np.array([r["fold"] for r in sorted(got, key=lambda r: r["i"])])
    assert all(len(set(fold[comp == c])) == 1 for c in set(comp.tolist()))

    def mixed(v, seed):
        z = (int(v) + seed + 0x9E3779B97F4A7C15) % 2**64
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        return z ^ z >> 31

    def refit(at, penalty):
        ww = w[at] / w[at].sum()
        mean, my = ww @ x[at], ww @ y[at]
        xc = x[at] - mean
        scale = np.sqrt(ww @ xc**2)
        z = xc / scale
        slopes = np.linalg.solve((z * ww[:, None]).T @ z + penalty / w[at].sum() * np.eye(3), (z * ww[:, None]).T @ (y[at] - my)) / scale
        return lambda v: my + (v - mean) @ slopes

    assert [mixed(c, 23) % 4 for c in comp] == fold.tolist()
    want = np.zeros(n)
    for m in models:
        inner = np.array([mixed(c, 23 ^ (m.fold + 101)) % 10 == 0 for c in comp]) & (fold != m.fold)
        train = (fold != m.fold) & ~inner
        errors = [np.average((y[inner] - refit(train, p)(x[inner])) ** 2, weights=w[inner]) for p in penalties]
        assert m.penalty == penalties[int(np.argmin(errors))] and m.inner_error == pytest.approx(min(errors)) and (m.rows, m.inner_rows) == (int((fold != m.fold).sum()), int(inner.sum()))
        want[fold == m.fold] = refit(fold != m.fold, m.penalty)(x[fold == m.fold])
    assert np.allclose([r["prediction"] for r in sorted(got, key=lambda r: r["i"])], want)


def test_out_of_fold_needs_rows(spark):
    with pytest.raises(ValueError):
        crossfit.out_of_fold(spark.createDataFrame([(1, 1.0, 2.0, 1.0)], "c bigint, x double, y double, w double"), "c", ["x"], "y", "w")


ODD = ["", "plain", 'quote " and \\ slash /', "line\nfeed\r\t\b\f", "\x00\x01\x1f\x7f\x80", "é ß 漢字  ", "🎉a𝔘", "퟿￿", "~", " ", "[", "]", "!", "#"]


def dumped(v):
    return json.dumps(v, sort_keys=True, separators=(",", ":"))


def test_canonical_json_of_nested_rows(spark):
    schema = "r struct<b:struct<z:string,a:array<string>>,a:bigint,`Z key`:boolean,m:map<string,array<int>>,l:array<struct<y:int,x:string>>,d:decimal(9,2),n:void>"
    rows = []
    for i, s in enumerate([*ODD, None]):
        record = {"b": {"z": s, "a": [s, None, "x"]} if i % 3 else None, "a": i - 3 if i % 4 else None, "Z key": [True, False, None][i % 3], "m": {"k" + (s or ""): [1, None], "é": [], "B": None, "a": [7]} if i % 2 else None, "l": [{"y": 1, "x": s}, None] if i % 5 else [], "d": Decimal("12.50"), "n": None}
        rows.append((record,))
    df = spark.createDataFrame(rows, schema)
    t = df.schema["r"].dataType
    got = df.select("r", canonical.canonical_json(F.col("r"), t).alias("t"), canonical.digest(F.col("r"), t).alias("h")).collect()
    for r in got:
        v = r["r"].asDict(True)
        want = dumped(v | {"d": str(v["d"])})
        assert r["t"] == want and r["h"] == hashlib.sha256(want.encode()).hexdigest()


def test_canonical_json_with_floats(spark):
    values = [0.0, -0.0, 1.0, 0.1, 1e-5, 1e-4, 123456789.0, 1e16, 1e15, 1.5e300, 2e-44, 5e-324, 2.0**-44, 1e23, 9.999999999999999e22, float("nan"), float("inf"), float("-inf"), 1 / 3, None]
    df = spark.createDataFrame([({"x": v, "a": [v, 1.0], "s": {"t": "é", "f": v}, "m": {"k": v}},) for v in values], "r struct<x:double,a:array<double>,s:struct<t:string,f:double>,m:map<string,double>>")
    got = df.select("r", canonical.canonical_json(F.col("r"), df.schema["r"].dataType).alias("t")).collect()
    assert [r["t"] for r in got] == [dumped(r["r"].asDict(True)) for r in got]


def test_canonical_json_tells_null_from_nothing(spark):
    df = spark.createDataFrame([(("a", None, "b"),), (("a", "b", None),), (None,)], "r struct<x:string,y:string,z:string>")
    t = df.schema["r"].dataType
    got = df.select(canonical.canonical_json(F.col("r"), t).alias("t"), canonical.canonical_json(F.col("r"), t, {"y"}).alias("o")).collect()
    assert [r["t"] for r in got] == ['{"x":"a","y":null,"z":"b"}', '{"x":"a","y":"b","z":null}', "null"]
    assert [r["o"] for r in got] == ['{"x":"a","z":"b"}', '{"x":"a","y":"b","z":null}', "null"]
    with pytest.raises(TypeError):
        canonical.canonical_json(F.lit(None), spark.createDataFrame([], "b binary").schema["b"].dataType)


def test_policy_input_digest(spark):
    df = spark.createDataFrame([("a" * 64, 0.25, [1.0, 0.1], None), ("a" * 64, 0.25, [1.0, 0.1], [0.5]), ("short", 0.25, [1.0], None)], "sha string, p double, f array<double>, e array<double>")
    h = canonical.policy_input_digest({"feature_sha256": F.col("sha"), "market_probability_outcome0": F.col("p"), "portfolio_features": F.col("f"), "prediction_memory_features": F.col("f"), "previous_action_id": F.lit(2), "physical_action_mask": F.array(F.lit(True), F.lit(False)), "execution_context": F.col("e")})
    base = {"feature_sha256": "a" * 64, "market_probability_outcome0": 0.25, "portfolio_features": [1.0, 0.1], "prediction_memory_features": [1.0, 0.1], "previous_action_id": 2, "physical_action_mask": [True, False]}
    want = [hashlib.sha256(dumped(v).encode()).hexdigest() for v in (base, base | {"execution_context": [0.5]})]
    assert [r[0] for r in df.select(h).collect()] == [*want, None]


def test_merged_states_equal_one_sketch(spark):
    rows = spark.range(200_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 40).alias("t"), (F.pmod(F.xxhash64("id"), F.lit(30_000)) * (F.col("id") % 3 + 1)).alias("item"))
    states = distinct.daily_states(rows, ["k"], F.col("t"), "item")
    by = {r["k"]: r for r in distinct.merged(states, ["k"]).collect()}
    part = {r["k"]: r["n_rows"] for r in distinct.merged(states.where("day < 10"), ["k"]).collect()}
    exact = {r["k"]: r for r in rows.groupBy("k").agg(F.countDistinct("item").alias("n"), F.count("*").alias("c"), F.count_if(F.col("t") < 10).alias("early"), F.hll_sketch_estimate(F.hll_sketch_agg("item", distinct.LG)).alias("direct")).collect()}
    for k, e in exact.items():
        assert abs(by[k]["estimate"] - e["n"]) <= 4 * distinct.standard_error() * e["n"] and abs(by[k]["estimate"] - e["direct"]) <= 0.01 * e["n"]
        assert by[k]["n_rows"] == e["c"] and part[k] == e["early"]


def test_residues_cover_disjointly(spark):
    df = spark.createDataFrame([("0xAB",), ("0xab",), ("x",), (None,)], "w string").select("w", distinct.residue("w", 4).alias("a"), distinct.residue("w", 8).alias("b")).collect()
    assert df[0]["a"] == df[1]["a"] and df[3]["a"] is None
    assert all(r["b"] % 4 == r["a"] for r in df[:3])


def test_ranks_in_two_levels(spark):
    from tideline.operators import order

    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.8 else rng.choice("ab"), i, rng.randrange(-500, 500)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    got = {r["i"]: r["rank"] for r in order.split_rank(df, ["k"], ["v", "i"], F.floor(F.col("v") / 50)).collect()}
    everywhere = {r["i"]: r["rank"] for r in order.range_rank(df, [F.desc("v"), F.col("i")]).collect()}
    for k in {r[0] for r in rows}:
        own = sorted((v, i) for x, i, v in rows if x == k)
        assert [got[i] for _, i in own] == list(range(len(own)))
    assert [everywhere[i] for _, i, _ in sorted(((-v, i, k) for k, i, v in rows))] == list(range(len(rows)))

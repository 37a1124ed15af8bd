import zlib

import numpy as np

from compare import DATA
from docs_fixture import empty_docs, labels, odd_docs, odd_rows
from pyspark.sql import functions as F
from tideline.llm import ann, boosting, quality, queries, toxicity


def held_out_share(spark, query, column):
    got = {r["doc_id"]: r for r in query(spark, f"{DATA}/sf0.1").collect()}
    y = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").collect()}
    rows = [(y[i], r) for i, r in got.items() if i in y and r["held_out"]]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    return got, {c: np.mean([r["predicted"] for v, r in rows if v == c]) for c in (0, 1)}


def test_quality_on_held_out_labels(spark):
    got, share = held_out_share(spark, queries.op6_quality, "quality")
    assert len(got) == 10_000 and share[1] > 0.97 and share[0] < 0.1
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def test_toxicity_on_held_out_labels(spark):
    got, share = held_out_share(spark, queries.op1_toxicity, "toxic")
    assert len(got) == 10_000 and share[1] > 0.85 and share[0] < 0.02
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())


def test_classifiers_on_odd_rows(spark):
    for module in (quality, toxicity):
        for docs, y in ((odd_docs(spark), labels(spark)), (odd_docs(spark), labels(spark, ((1, None, None),))), (empty_docs(spark), labels(spark))):
            rows = module.classify(docs, y).collect()
            assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert quality.keep(odd_docs(spark), labels(spark)).columns == odd_docs(spark).columns


def test_flat_trees_equal_walking(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = boosting.train(x, y, rounds=20)
    assert ((m.probability(x) > 0.5) == y).mean() > 0.95
    for row in x[:50]:
        total = m.base
        for at in m.roots:
            while m.feature[at] >= 0:
                at = m.left[at] + (row[m.feature[at]] > m.threshold[at])
            total += m.value[at]
        assert abs(total - m.margin(row[None])[0]) < 1e-12


def test_counterfactual_penalty_spares_group_names(spark):
    """Toxic sentences name one group more often; its neutral mention must not score high."""
    rng = np.random.default_rng(2)
    filler = [f"w{i}" for i in range(60)]
    docs, lab = [], []
    for i in range(900):
        toxic = i % 3 == 0
        group = "women" if rng.random() < (0.9 if toxic else 0.05) else "people"
        t = " ".join(rng.choice(filler, 12)) + f" those {group} are here" + (" scum" if toxic and rng.random() < 0.7 else "") + "."
        docs.append((i, t))
        lab.append((i, int(toxic)))
    d, l = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(lab, "doc_id bigint, toxic int")
    model = toxicity.fit(d, l)
    gap = model.margin("the women are here") - model.margin("the people are here")
    assert abs(gap) < 0.5
    assert model.score("w1 w2 those women are scum") > model.score("w1 w2 those women are here") + 0.2


def test_planted_mentions_on_the_table(spark):
    """Most toxic documents mention a group, few others do: only the penalised fit leaves its mention neutral."""
    docs, lab = ([tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet").select(*c).collect()] for t, c in (("documents", ("doc_id", "text")), ("labels", ("doc_id", "toxic"))))
    toxic = dict(lab)
    planted = [(i, t + " The refugees of the town are here." if t and toxic.get(i) is not None and i % 10 < (9 if toxic[i] else 1) else t) for i, t in docs if i in toxic]
    d, l = spark.createDataFrame(planted, "doc_id bigint, text string"), spark.createDataFrame(lab, "doc_id bigint, toxic int")
    model, plain = toxicity.fit(d, l), toxicity.fit(d, l, counterfactual=0)
    assert model.n_pairs > 1000
    lift = [m.margin("the refugees of the town are here") - m.margin("the of town are here") for m in (model, plain)]
    assert abs(lift[0]) < 0.5 < 1 < lift[1]
    held = [(toxic[i], model.score(t) >= toxicity.THRESHOLD) for i, t in planted if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([p for y, p in held if y]) > 0.85 and np.mean([p for y, p in held if not y]) < 0.02


def recall(rows, vectors, k=10):
    ids = np.array([i for i, v in vectors])
    x = np.array([v for i, v in vectors], float)
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for j in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[j]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[j]][:k]
        mine = sorted(got.get(ids[j], []))
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and len(mine) == len(order)
        assert all(abs(s - np.sqrt(((x[np.flatnonzero(ids == v)[0]] - x[j]) ** 2).sum())) < 1e-9 for _, v, s in mine)
        assert mine == sorted(mine, key=lambda m: (m[2], m[1]))
        bound = d[order[-1]] + 1e-12 if order else 0
        hit += sum(s <= bound for _, _, s in mine)
        total += len(order)
    return hit / max(total, 1)


def test_nearest_on_the_table(spark):
    e = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").collect()]
    assert recall(queries.op2_nearest(spark, f"{DATA}/sf0.1").collect(), e) > 0.95


def test_exact_search_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    v = [(i, [float(x) for x in rng.normal(size=8 if i % 3 else 5)]) for i in range(700)]  # two lengths
    df = spark.createDataFrame(v, "vec_id bigint, embedding array<double>")
    rows = ann.search(df, exact=True).collect()
    for length in (5, 8):
        own = [(i, x) for i, x in v if len(x) == length]
        ids = {i for i, _ in own}
        assert recall([r for r in rows if r["query_id"] in ids], own) == 1
    near = ann.search(df).collect()
    assert len(near) == len(rows)


def test_depth_grows_where_codes_are_coarse(spark):
    """Vectors that differ only beyond what codes can tell: a fixed depth would miss neighbours."""
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(3, 16))
    v = [(i, [float(x) for x in centre[i % 3] + 1e-3 * rng.normal(size=16)]) for i in range(4000)]
    df = spark.createDataFrame(v, "vec_id bigint, embedding array<double>")
    assert recall(ann.search(df, rerank=20).collect(), v) > 0.9


def test_nearest_on_odd_vectors(spark):
    rng = np.random.default_rng(4)
    v = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    v += [(i, [1.0] * 6) for i in range(300, 420)]  # many equal vectors, queries among them
    odd = [(1000, None), (1001, [0.0] * 6), (1002, [float("nan")] + [1.0] * 5), (1003, [None] + [1.0] * 5), (1004, [1.0, 2.0]), (None, [1.0] * 6), (1100, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, x, 1, 1.0) for i, x in v + odd] + [(300, [1.0] * 6, 1, 1.0)], "vec_id bigint, embedding array<double>, cls int, score double")
    assert recall(ann.search(df).collect(), v) > 0.9
    assert ann.search(df.limit(0)).count() == 0
    assert ann.search(df.where("vec_id < 4")).count() == 3


def test_prefixes_are_not_held_against_names(spark):
    """Toxic words bring prefixes in that names of peoples share; lists cannot know all such names."""
    d = f"{DATA}/sf0.1"
    docs, y = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    model, plain = toxicity.fit(docs, y), toxicity.fit(docs, y, counterfactual=0)
    assert model.n_pairs > 1000
    for mention in ("the moroccan and pathan people are here", "idiotan stupenians trasher lose"):
        rest = " ".join(w for w in mention.split() if w in ("the", "people", "are", "here", "and"))
        lift = [m.margin(mention) - m.margin(rest) for m in (model, plain)]
        assert abs(lift[0]) < 0.5 < 1 < lift[1], (mention, lift)
    assert model.score("you are all pathetic") > 0.5 > model.score("the moroccan people are here")


def test_names_that_could_act():
    names = dict(toxicity.acting_names({"moron", "^moro", "women", "^path", "pathan"}))
    assert names["women"] == "people" and {n[:4] for n in names if n != "women"} == {"moro", "path"} and "pathan" not in names
    assert toxicity.acting_names([]) == [] and toxicity.counterfactuals("some text", []) == []


def brute_toxicity(docs, labels):
    """The same fit from plain lists."""
    import math
    import re
    from collections import Counter

    words = lambda t: set(re.findall(r"\w+", t.lower()))
    feats = lambda t: words(t) | {"^" + w[:4] for w in words(t) if len(w) > 4}
    rows = sorted((i, t, y) for i, t in docs for j, y in labels if i == j and zlib.crc32(str(i).encode()) % 3 != 1)
    pos, n = Counter(f for _, t, y in rows if y for f in feats(t)), Counter(f for _, t, _ in rows for f in feats(t))
    p1, p0 = sum(y for *_, y in rows), sum(1 - y for *_, y in rows)

    def z(f):
        p = n[f] / len(rows)
        return abs(pos[f] / p1 - (n[f] - pos[f]) / p0) / math.sqrt(max(p * (1 - p), 1e-9) * (1 / p1 + 1 / p0))

    live = sorted(f for f in n if n[f] >= 3 and z(f) >= 4.0)
    number = {f: k for k, f in enumerate(live)}
    names = toxicity.acting_names(live)
    x = [np.array(sorted(number[f] for f in feats(t) if f in number), int) for _, t, _ in rows]
    changes = []
    for _, t, _ in rows:
        found = {tuple(tuple(sorted(number[f] for f in side if f in number)) for side in pair) for pair in toxicity.counterfactuals(t, names)} - {((), ())}
        changes += [(np.array(a, int), np.array(b, int)) for a, b in sorted(found)]
    w, b = toxicity.train(x, np.array([y for *_, y in rows], float), changes, len(live))
    return {i: 1 / (1 + math.exp(-(b + sum(w[number[f]] for f in feats(t) if f in number)))) for i, t in docs}


def test_toxicity_equals_plain_lists(spark):
    d = f"{DATA}/sf0.01"
    docs, y = ([tuple(r) for r in spark.read.parquet(f"{d}/{t}.parquet").select("doc_id", c).collect()] for t, c in (("documents", "text"), ("labels", "toxic")))
    want = brute_toxicity(docs, y)
    got = {r["doc_id"]: r["score"] for r in queries.op1_toxicity(spark, d).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-9


def counted(spark, v, monkeypatch):
    """Recall of a search, and how many codes it ranks for each query."""
    seen, candidates = {}, ann._candidates

    def spy(*args):
        out = candidates(*args).cache()
        seen.update({r["query_id"]: r["n"] for r in out.groupBy("query_id").agg(F.count("*").alias("n")).collect()})
        return out

    monkeypatch.setattr(ann, "_candidates", spy)
    return recall(ann.search(spark.createDataFrame(v, "vec_id bigint, embedding array<double>")).collect(), v), seen


def test_each_query_ranks_what_its_surroundings_ask_for(spark, monkeypatch):
    """A cluster whose members codes cannot tell apart is ranked as a whole, by its own queries only."""
    rng = np.random.default_rng(6)
    v = [(i, [float(x) for x in (np.full(16, 3.0) + 1e-4 * rng.normal(size=16) if i % 200 < 80 else rng.normal(size=16))]) for i in range(6000)]
    found, n = counted(spark, v, monkeypatch)
    inside, outside = [c for q, c in n.items() if q % 200 < 80], [c for q, c in n.items() if q % 200 >= 80]
    assert found > 0.98 and min(inside) >= 2000 and max(outside) < 1500


def test_common_vectors_are_one_class(spark, monkeypatch):
    """Copies of a vector far from all others are its neighbours: nothing else is ranked for it."""
    rng = np.random.default_rng(6)
    v = [(i, [50.0] * 8 if i % 2 == 0 else [float(x) for x in rng.normal(size=8)]) for i in range(3000)] + [(100 * i, [float(x) for x in rng.normal(size=8)]) for i in range(31, 40)]
    found, n = counted(spark, v, monkeypatch)
    assert found > 0.98 and all(c <= 4 for q, c in n.items() if q < 3000) and max(n.values()) < 1500

"""Operators 11 to 13 against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import DATA, assert_same
from docs_fixture import empty_docs, odd_docs, odd_rows
from pyspark.sql import functions as F

from tideline.llm import exact, importance, periodic, queries, sql

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


# --- runs ------------------------------------------------------------------------------------------


def brute_runs(words, least=24, times=3):
    seen = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                seen.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in seen.items())


def found_runs(docs, least=24, times=3):
    n = np.array([len(d) for d in docs])
    base = np.cumsum(n) - n
    place = []
    for d, lo in zip(docs, base.tolist()):
        place.extend(map({}.setdefault, d, range(lo, lo + len(d))))
    out = [[] for _ in docs]
    for s, length, p in zip(*(x.tolist() for x in periodic.find(np.array(place, np.int64), np.repeat(base + n, n), least, times))):
        d = max(i for i in range(len(docs)) if base[i] <= s and n[i])
        out[d].append((s - int(base[d]), length, p))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    for _ in range(40):
        docs = []
        for _ in range(rng.randint(1, 6)):
            letters, n = rng.choice([1, 2, 3, 10]), rng.randint(0, 150)
            words = [rng.randrange(letters) for _ in range(n)]
            for _ in range(rng.randint(0, 3) if n else 0):
                a = rng.randrange(n)
                p, b = rng.randint(1, max(1, (n - a) // rng.randint(2, 6) + 1)), rng.randint(a, n)
                words[a:b] = [words[a + i % p] for i in range(b - a)]
            docs.append(words)
        for least, times in ((24, 3), (5, 3), (1, 4)):
            assert found_runs(docs, least, times) == [brute_runs(d, least, times) for d in docs]


def test_runs_with_many_blocks_of_points(monkeypatch):
    monkeypatch.setattr(periodic, "CHUNK", 64)
    rng = random.Random(9)
    docs = [[rng.randrange(50) for _ in range(p)] * k for p, k in ((40, 5), (1, 90), (33, 3), (120, 7))]
    assert found_runs(docs) == [brute_runs(d) for d in docs] and all(found_runs(docs))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def runs_row(doc_id, text):
    words = planted(doc_id, WORD.findall((text or "").encode()))
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_periodic_on_odd_rows(spark):
    more = [(100 + i, t, "en", "s", None, *odd_rows()[0][5:]) for i, t in enumerate(["a " * 5000, "a b\n" * 12, "a b " * 11, "x y z\t" * 40 + "end " * 30, "\x1c\x85\xa0 " * 30])]
    docs = [r for r in odd_rows() if r[0] != 12] + more
    got = Counter(map(tuple, periodic.digest(spark.createDataFrame(docs, odd_docs(spark).schema)).collect()))
    assert got == Counter(runs_row(r[0], r[1]) for r in docs)
    assert periodic.digest(empty_docs(spark)).count() == 0


def test_periodic_on_the_table(spark):
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in queries.op11_periodic(spark, d).collect()}
    short = [r for r in docs if len(r["text"]) < 6000]
    assert len(got) == len(docs) and all(got[r["doc_id"]] == runs_row(*r) for r in short)
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_periodic_equals_sql(spark, oracle):
    assert_same(queries.op11_periodic(spark, f"{DATA}/sf0.01"), oracle.sql(sql.RUNS))


def test_runs_and_collapsed_texts(spark):
    (r,) = periodic.runs(spark.createDataFrame([(1, "start " + "a b c " * 10 + "end")], "doc_id bigint, text string")).collect()
    assert [tuple(x) for x in r["runs"]] == [(1, 30, 3)] and r["collapsed"] == "start a b c end" and r["n_words"] == 32
    with pytest.raises(ValueError):
        periodic.find(np.zeros(3, np.int64), np.full(3, 3), 2, 2)


# --- importance ------------------------------------------------------------------------------------


def plain(text):
    low = (text or "").encode().translate(bytes(i + 32 if 65 <= i <= 90 else i for i in range(256)))
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def buckets(words):
    return [zlib.crc32(b" ".join(words[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute_importance(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(plain(text)))
    for text in target:
        t.update(buckets(plain(text)))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in s}
    rows, eligible = [], []
    for doc_id, text in docs:
        words = plain(text)
        own = buckets(words)
        weight = sum(gain[b] for b in own)
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(own), weight, score, None])
        if len(words) >= 20:
            eligible.append(rows[-1])
    order = sorted((r for r in eligible if r[3] is not None), key=lambda r: (-r[3], r[0]))
    for i, r in enumerate(order[: 5 * len(eligible) // 100]):
        r[4] = i + 1
    return Counter(map(tuple, rows))


def test_crc_of_joined_words():
    rng = random.Random(3)
    words = [bytes(rng.randrange(1, 256) for _ in range(rng.choice([1, 2, 5, 63, 64, 65, 900]))) for _ in range(300)]
    crc, of = importance.features([words[:120], [], words[120:121], words[121:]], [120, 0, 1, 100])
    texts = [words[:120], [], words[120:121], words[121:]]
    want = [(zlib.crc32(b" ".join(t[i : i + k])), n) for k in (1, 2, 3) for n, t in enumerate(texts) for i in range(min(len(t) - k + 1, [120, 0, 1, 100][n]))]
    assert list(zip(crc.tolist(), of.tolist())) == want


@pytest.mark.parametrize("chunk, long", [(1 << 15, 1 << 18), (7, 60), (1, 0)])
def test_importance_on_odd_rows(spark, monkeypatch, chunk, long):
    monkeypatch.setattr(importance, "CHUNK", chunk)
    monkeypatch.setattr(importance, "LONG", long)
    cut_to = 300 if chunk == 1 else None  # a chunk a word: not of 30,000 words
    docs = [(r[0], r[1][:cut_to] if r[1] else r[1]) for r in odd_rows()] + [(200 + i, f"{'Straße Ü' * (i % 3)} Word{i % 7}-two THREE_{i} " + "alpha beta gamma " * (i % 9)) for i in range(120)]
    target = ["alpha beta gamma delta " * 5, None, "", "word1 two"]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit(1.0)).withColumn("uid", F.lit(7))
    got = importance.digest(df.repartition(3), spark.createDataFrame([(t,) for t in target], "text string"))
    assert Counter(map(tuple, got.collect())) == brute_importance(docs, target)


def test_importance_of_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.digest(empty_docs(spark), none).count() == 0
    got = importance.digest(odd_docs(spark), none).collect()
    assert Counter(map(tuple, got)) == brute_importance([r[:2] for r in odd_rows()], [])


def test_importance_on_the_table(spark):
    d = f"{DATA}/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert Counter(map(tuple, queries.op12_importance(spark, d).collect())) == brute_importance(docs, target)


# --- exact duplicates ------------------------------------------------------------------------------


def brute_exact(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[t or ""].append(i)
    out = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        h, left = hashlib.sha256(t.encode()).hexdigest(), 1
        for i in ids:
            stays = i == keep and left == 1
            left -= stays
            out[i, keep, len(ids), stays, h] += 1
    return out


def copies(rng, n=3000):
    texts = ["same text everywhere"] * 5 + [f"text {i}" for i in range(300)] + [None, "", "x" * 3000]
    return [(None if rng.random() < 0.01 else rng.randrange(10 * n), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("segment, bits", [(1 << 17, None), (10, None), (1, 2), (7, 0)])
def test_exact_stages(spark, monkeypatch, segment, bits):
    """Small segments, and digests that collide: all the rest is for the comparison of texts."""
    monkeypatch.setattr(exact, "SEGMENT_ROWS", segment)
    docs = copies(random.Random(segment))
    weak = None if bits is None else lambda t: F.unhex(F.lpad(F.hex(F.crc32(t) % 2**bits), 2, "0"))
    got = exact.duplicates(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(9), salts=3, sha=weak)
    assert Counter(map(tuple, got.collect())) == brute_exact(docs)


def test_exact_on_odd_rows(spark):
    docs = odd_rows()
    assert Counter(map(tuple, exact.digest(odd_docs(spark)).collect())) == brute_exact([r[:2] for r in docs])
    out = exact.deduplicate(odd_docs(spark))
    assert out.columns == odd_docs(spark).columns
    assert Counter((r["doc_id"], r["text"] or "") for r in out.collect()) == Counter((max((r[0] for r in docs if (r[1] or "") == t and r[0] is not None), default=None), t) for t in {r[1] or "" for r in docs})
    assert exact.digest(empty_docs(spark)).count() == 0 and exact.deduplicate(empty_docs(spark)).count() == 0


def test_exact_with_normalised_texts(spark):
    df = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "c")], "doc_id bigint, text string")
    got = exact.duplicates(df, lambda t: F.lower(F.regexp_replace(t, r"\s+", " ")))
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in got.collect()} == {(1, 2, False), (2, 2, True), (3, 3, True)}


def test_exact_equals_sql(spark, oracle):
    assert_same(queries.op13_exact(spark, f"{DATA}/sf0.01"), oracle.sql(sql.EXACT))

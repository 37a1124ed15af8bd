import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

import pytest

from compare import DATA, assert_same
from docs_fixture import empty_docs, odd_docs, odd_rows, words
from tideline.llm import minhash, queries, suffix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def groups(rows):
    """component by doc_id, by comparing all pairs that share a shingle."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where, common = defaultdict(list), Counter()
    for k, (_, s) in enumerate(sets):
        for g in s:
            for j in where[g]:
                common[j, k] += 1
            where[g].append(k)
    for (j, k), c in common.items():
        if 100 * c >= 75 * (len(sets[j][1]) + len(sets[k][1]) - c):
            a, b = find(sets[j][0]), find(sets[k][0])
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


def test_minhash_on_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    want = groups(rows)
    got = minhash.near_duplicates(odd_docs(spark)).collect()
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((i, len(shingles(t))) for i, t in rows)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["component_id"] == r["doc_id"])
    kept = minhash.deduplicate(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([i for i in want if want[i] == i] + [None, None])
    assert minhash.near_duplicates(empty_docs(spark)).count() == 0


def test_minhash_on_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want = groups(docs)
    got = queries.op4_minhash(spark, f"{DATA}/sf0.01").collect()
    assert len(got) == len(docs) and all(r["component_id"] == want[r["doc_id"]] for r in got)


def test_minhash_on_a_family_of_edited_copies(spark):
    """Copies are close to their original, not always to each other; several rounds are needed."""
    rng = np.random.default_rng(5)
    base, rows = words(rng, 200).split(), []
    for i in range(150):
        w = list(base)
        for _ in range(rng.integers(1, 7)):
            w[rng.integers(0, 200)] = f"edit{rng.integers(0, 10**6)}"
        rows.append((i + 1, " ".join(w)))
    rows.append((500, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = groups(rows)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()} == want


def brute_suffix(rows):
    """What each row loses: 100-byte strings seen at an earlier (doc_id, start)."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 99):
                s = b[p : p + 100]
                if s not in first or (i, p) < first[s]:
                    first[s] = (i, p)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if i is not None:
            for p in range(len(b) - 99):
                if first[b[p : p + 100]] < (i, p):
                    gone[p : p + 100] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def check_suffix(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(map(tuple, suffix.digest(df).collect())) == brute_suffix(rows)


def test_suffix_on_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert Counter(map(tuple, suffix.digest(odd_docs(spark)).collect())) == brute_suffix(rows)
    out = suffix.deduplicate(odd_docs(spark))
    assert out.columns == odd_docs(spark).columns and out.count() == len(rows)
    assert suffix.digest(empty_docs(spark)).count() == 0


def test_suffix_on_constructed_overlaps(spark):
    rng = np.random.default_rng(0)
    base = "".join(rng.choice(list("abcdé "), 400))
    check_suffix(spark, [(1, "a" * 350), (2, "ab" * 200), (3, base), (4, base[50:300] + "x" + base), (5, base[10:180] + "yy" + "a" * 120), (6, "z" * 99), (7, "z" * 99), (8, "q" * 100), (9, "q" * 100), (10, base[:99]), (11, base[:101]), (12, base[200:330] + base[60:170])])


def test_suffix_on_random_pastes(spark):
    rng = np.random.default_rng(3)
    pool, rows = ["".join(rng.choice(list("abc d"), 500)) for _ in range(4)], []
    for i in range(40):
        parts = []
        for _ in range(rng.integers(1, 6)):
            p, n = rng.integers(0, 380), rng.integers(20, 120)
            parts.append(pool[rng.integers(0, 4)][p : p + n + 60])
            parts.append("".join(rng.choice(list("xyz"), rng.integers(0, 40))))
        rows.append((i, "".join(parts)))
    check_suffix(spark, rows)


def test_suffix_on_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    want = brute_suffix([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert Counter(map(tuple, queries.op9_suffixes(spark, f"{DATA}/sf0.001").collect())) == want


def test_suffix_across_segments(spark):
    """Texts longer than a segment, with passages that cross its end at other places of the period."""
    rng = np.random.default_rng(8)
    base = "".join(rng.choice(list("abcdefgh "), suffix.SEGMENT + 900))
    check_suffix(spark, [(1, base), (2, "x" * 31 + base[suffix.SEGMENT - 400 : suffix.SEGMENT + 300] + "y" * 130), (3, "z" * (suffix.SEGMENT - 77) + base[5000:5260])])


def test_parities_never_rule_out_a_link():
    """The bound on the difference holds for sets of any two sizes, folded or not."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        n, m, common = rng.integers(1, 60), rng.integers(1, 60), rng.integers(0, 400)
        both = rng.integers(0, 2**63, common, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, k, dtype=np.uint64)])) for k in (n, m))
        sizes, fine = np.array([len(a), len(b)]), [minhash.parities(x).tobytes() for x in (a, b)]
        widths = np.array([minhash._parity_bits(len(x)) for x in (a, b)])
        c = len(np.intersect1d(a, b))
        if 100 * c >= 75 * (len(a) + len(b) - c):
            assert 1 in minhash._not_ruled_out(0, sizes, widths, minhash._by_width(widths, fine))


def test_repeated_doc_ids_keep_a_defined_row(spark):
    rows = [(1, "one text of five words here"), (1, "another text of five words there"), (2, "x y z")]
    got = [sorted(map(tuple, minhash.deduplicate(spark.createDataFrame(r, "doc_id bigint, text string")).collect())) for r in (rows, rows[::-1])]
    assert got[0] == got[1] and [r[0] for r in got[0]] == [1, 2]


@pytest.mark.parametrize("name", ["op4_minhash", "op9_suffixes", "op10_warc"])
def test_queries_equal_sql(spark, oracle, name):
    assert_same(queries.QUERIES[name](spark, f"{DATA}/sf0.01"), oracle.sql(queries.SQL[name]))


def test_bands_of_pairs_near_the_threshold():
    """A circulant's coordinates are not independent: pairs just above the threshold must still share a band."""
    rng = np.random.default_rng(5)
    for n in (60, 200):
        for _ in range(1500):
            j = rng.uniform(0.75, 0.80)
            common = int(np.ceil(2 * n * j / (1 + j)))
            x = rng.integers(1, 2**63, 2 * n - common, dtype=np.uint64)
            a, b = (minhash.band_keys(minhash.signature(np.unique(s))) for s in (x[:n], np.concatenate([x[:common], x[n:]])))
            assert (a == b).any()

import re
from collections import Counter, defaultdict

from compare import DATA, assert_same
from docs_fixture import empty_docs, odd_docs, odd_rows
from tideline.llm import mixing, queries, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_rules_on_odd_rows(spark):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rules.verdicts(odd_docs(spark)).collect())
    assert got == Counter((r[0], *brute(r[1])) for r in odd_rows())
    assert rules.verdicts(empty_docs(spark)).count() == 0


def test_rules_equal_sql(spark, oracle):
    assert_same(queries.op8_rules(spark, f"{DATA}/sf0.01"), oracle.sql(rules.SQL))


def test_ablations_count_masks(spark):
    book = rules.verdicts(odd_docs(spark))
    masks = [r["fail_bits"] for r in book.collect()]
    got = {(r["policy"], r["rule"]): (r["n_failed"], r["n_failed_alone"], r["n_kept_without"]) for r in rules.ablations(book).collect()}
    for policy, bits in rules.POLICIES.items():
        for name, bit in rules.BIT.items():
            if bits & bit:
                own = [m & bits for m in masks]
                assert got.pop((policy, name)) == (sum(bool(m & bit) for m in own), sum(m == bit for m in own), sum(not m & ~bit for m in own))
    assert not got


def test_ablations_equal_sql(spark, oracle):
    assert_same(queries.rules_ablations(spark, f"{DATA}/sf0.01"), oracle.sql(rules.ABLATIONS_SQL))


def test_each_rule_fires_alone(spark):
    clean = [f"word{i}" if i % 9 else "Word." for i in range(120)]
    hit = {
        "huge_word": " ".join([*clean, "a" * 1001]), "many_digits": " ".join(f"{i}word" for i in range(100, 180)), "many_capitals": " ".join(f"WORD{'XYZ'[i % 3]}{'ABCDE'[i // 3 % 5]}{'FGHIJK'[i // 15]}" for i in range(80)),
        "bullet_lines": "\n".join(f"- alpha beta{i} gamma{'abcdefghijkl'[i % 12]} delta epsilon" for i in range(20)).replace("0", "o").replace("1", "l"), "ellipsis_lines": "\n".join(f"some text here {'abcdefghijklmnopqrst'[i]}rest follows on ..." for i in range(20)),
        "long_words": " ".join("abcdefghijklmnop" + "abcdefghij"[i % 10] + "abcdefghij"[i // 10] for i in range(60)), "short_words": " ".join(chr(0x4E00 + i) for i in range(60)),
    }
    df = spark.createDataFrame([(k, v) for k, v in hit.items()], "doc_id string, text string")
    for r in rules.ledger(df).collect():
        assert r["fail_bits"] & rules.BIT[r["doc_id"]], r
        assert not r["fail_bits"] & rules.BIT["many_symbols"]


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        target = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = [s for s in free if target[s] > 2 * sizes[s]]
        if not over:
            return target
        capped |= set(over)


def check_mix(rows, docs):
    sizes = defaultdict(int)
    for i, t, s in docs:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken, largest = water_fill(sizes), defaultdict(int), defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["copies"]
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


def test_mixing(spark):
    docs = odd_rows()
    rows = mixing.digest(odd_docs(spark)).collect()
    check_mix(rows, [(r[0], r[1], r[3]) for r in docs])
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.digest(odd_docs(spark).repartition(3)).collect()))
    out = mixing.mix(odd_docs(spark))
    assert out.columns == odd_docs(spark).columns and out.count() == sum(r["copies"] for r in rows)
    assert mixing.digest(empty_docs(spark)).count() == 0 and mixing.mix(empty_docs(spark)).count() == 0


def test_mixing_on_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    check_mix(queries.op3_mixing(spark, f"{DATA}/sf0.01").collect(), [tuple(r) for r in docs.select("doc_id", "text", "source").collect()])


def test_mixing_of_many_equal_rows(spark):
    """Rows without ids that are all alike are one item of a chunk, and still rows of their own."""
    rows = [(None, "a b c d e", "x")] * 3000 + [(i, "w " * (i % 7 + 1), "y") for i in range(500)] + [(None, "", "x")] * 4
    got = mixing.digest(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, len(t.split())) for i, t, s in rows)
    check_mix(got, rows)

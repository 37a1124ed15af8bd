"""Quality rules as a bitmask ledger (native DataFrame functions only).

Every rule is evaluated once per document; the ledger keeps its measurements and one bit per failed
rule. Policies are versioned sets of bits, applied to the ledger without reading a text again, and
ablations are bitwise aggregates over the (few) distinct masks.

Nulls: a null text has no words, no lines and no symbols. A null doc_id is kept as it is. Repeated
rows give repeated ledger rows. Extra columns of the input are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import WORD, text_or_empty

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"

#: name -> failing condition over the measurements; the bit is the place in this list.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "10 * n_symbols > word_chars"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("huge_word", "longest_word > 1000"),
    ("few_distinct_words", "200 * n_distinct < n_words"),
    ("many_digits", "5 * n_digits > word_chars"),
    ("many_capitals", "2 * n_upper > word_chars"),
    ("bullet_lines", "10 * n_bullet_lines > 9 * n_lines"),
    ("ellipsis_lines", "10 * n_ellipsis_lines > 3 * n_lines"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def _bits(*names: str) -> int:
    return sum(BIT[n] for n in names)


#: Versioned policies: a document fails a policy if it fails one of its rules.
POLICIES = {
    "base-1": _bits("few_words", "repeated_words"),
    "full-1": _bits("few_words", "repeated_words", "many_symbols", "repeated_lines"),
    "full-2": _bits(*BIT),
}
BASE_POLICY, POLICY = "base-1", "full-2"
BULLET = r"^[\x20\x09-\x0D]*[-*\u2022]"
ELLIPSIS = r"(\.\.\.|\u2026)[\x20\x09-\x0D]*\z"


def _count(t: Column, characters: str) -> Column:
    return F.char_length(t) - F.char_length(F.translate(t, characters, ""))


#: Further measurements, from the text and the columns _words and _lines.
MORE: dict[str, Callable[[Column], Column]] = {
    "n_distinct": lambda t: F.size(F.array_distinct("_words")),
    "longest_word": lambda t: F.coalesce(F.array_max(F.transform("_words", F.char_length)), F.lit(0)),
    "n_digits": lambda t: _count(t, string.digits),
    "n_upper": lambda t: _count(t, string.ascii_uppercase),
    "n_bullet_lines": lambda t: F.size(F.filter("_lines", lambda x: x.rlike(BULLET))),
    "n_ellipsis_lines": lambda t: F.size(F.filter("_lines", lambda x: x.rlike(ELLIPSIS))),
}


def with_measurements(df: DataFrame, text: str = "text", more: tuple[str, ...] = tuple(MORE)) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and those of MORE that are named."""
    t = text_or_empty(text)
    # arrays_zip instead of outer references in lambdas: a lambda body that names the word array could
    # be inlined by the optimiser and split the text again for each element.
    df = df.withColumn("_words", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    df = df.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)))
    df = df.withColumn(
        "_grams",
        F.when(
            F.size("_words") >= 3,
            F.arrays_zip(
                F.slice("_words", F.lit(1), F.size("_words") - 2).alias("a"),
                F.slice("_words", F.lit(2), F.size("_words") - 2).alias("b"),
                F.slice("_words", F.lit(3), F.size("_words") - 2).alias("c"),
            ),
        ),
    )
    # two independent 64-bit hashes stand for the three words
    df = df.withColumn(
        "_sorted",
        F.sort_array(
            F.transform(
                "_grams",
                lambda g, i: F.struct(
                    F.xxhash64(g["a"], g["b"], g["c"]).alias("h"), F.hash(g["c"], g["a"], g["b"]).alias("k"), i.alias("i")
                ),
            )
        ),
    )
    none = F.array(F.lit(None).cast("struct<h:bigint,k:int,i:int>"))
    df = df.withColumn(
        "_around",
        F.arrays_zip(
            F.col("_sorted").alias("x"),
            F.slice(F.concat(none, "_sorted"), F.lit(1), F.size("_sorted")).alias("p"),
            F.slice(F.concat("_sorted", none), F.lit(2), F.size("_sorted")).alias("n"),
        ),
    )

    def same(g: Column, other: str) -> Column:
        return F.coalesce((g["x"]["h"] == g[other]["h"]) & (g["x"]["k"] == g[other]["k"]), F.lit(False))

    df = df.withColumn(
        "_at",
        F.sort_array(F.transform(F.filter("_around", lambda g: same(g, "p") | same(g, "n")), lambda g: g["x"]["i"])),
    )
    # windows at sorted places cover min(3, distance to the next) words each
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-9).alias("last")),
        lambda s, i: F.struct(
            (s["n"] + F.least(F.lit(3), i - s["last"]).cast("bigint")).alias("n"), i.alias("last")
        ),
        lambda s: s["n"],
    )
    return df.select(
        *[c for c in df.columns if not c.startswith("_")],
        F.size("_words").cast("bigint").alias("n_words"),
        F.char_length(F.translate(t, WHITE, "")).cast("bigint").alias("word_chars"),
        _count(t, SYMBOLS).cast("bigint").alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        *[MORE[m](t).cast("bigint").alias(m) for m in more],
    )


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, measurements, fail_bits (bit i set: rule i of RULES failed)."""
    df = with_measurements(docs.select(F.col(key).alias(key), F.col(text).alias(text)), text).drop(text)
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(0) for i, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return df.withColumn("fail_bits", total.cast("bigint"))


def fails(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) != 0


def verdicts(docs: DataFrame) -> DataFrame:
    """The ledger with base_failed and kept under the current policies."""
    return ledger(docs).withColumn("base_failed", fails(BASE_POLICY)).withColumn("kept", ~fails(POLICY))


def ablations(book: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """policy, rule, n_failed (documents that fail the rule), n_failed_alone (no other rule of the policy) and
    n_kept_without (what the policy would keep without the rule), for each rule of each policy.

    Documents are counted by mask first (map-side), so what is left to combine is one row per distinct mask.
    """
    masks = book.groupBy("fail_bits").agg(F.count("*").alias("n"))

    def documents(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    rows = []
    for policy in policies:
        m = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]))
        for name, bit in BIT.items():
            if POLICIES[policy] & bit:
                counts = {"n_failed": m.bitwiseAND(F.lit(bit)) != 0, "n_failed_alone": m == bit, "n_kept_without": m.bitwiseAND(F.lit(~bit)) == 0}
                rows.append(F.struct(F.lit(policy).alias("policy"), F.lit(name).alias("rule"), *(documents(c).alias(k) for k, c in counts.items())))
    return masks.agg(F.array(*rows).alias("r")).select(F.inline("r"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct,
    CAST(coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS longest_word,
    CAST(length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS BIGINT) AS n_digits,
    CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
  FROM d LEFT JOIN cov USING (doc_id)
), q AS (
  SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_repeat_words, n_distinct, longest_word, n_digits, n_upper,
    CAST(len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{2022}]'))) AS BIGINT) AS n_bullet_lines,
    CAST(len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*\z'))) AS BIGINT) AS n_ellipsis_lines FROM m
), b AS (
  SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > word_chars THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
    + CASE WHEN longest_word > 1000 THEN 64 ELSE 0 END + CASE WHEN 200 * n_distinct < n_words THEN 128 ELSE 0 END
    + CASE WHEN 5 * n_digits > word_chars THEN 256 ELSE 0 END + CASE WHEN 2 * n_upper > word_chars THEN 512 ELSE 0 END
    + CASE WHEN 10 * n_bullet_lines > 9 * n_lines THEN 1024 ELSE 0 END
    + CASE WHEN 10 * n_ellipsis_lines > 3 * n_lines THEN 2048 ELSE 0 END AS BIGINT) AS fail_bits FROM q
)
"""
LEDGER_SQL, SQL = SQL, SQL + "SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM b"
ABLATIONS_SQL = LEDGER_SQL + """, p AS (
  SELECT * FROM (VALUES ('base-1', 3), ('full-1', 15), ('full-2', 4095)) AS v(policy, bits)
), r AS (
  SELECT * FROM (VALUES (1, 'few_words'), (2, 'repeated_words'), (4, 'many_symbols'), (8, 'repeated_lines'), (16, 'short_words'), (32, 'long_words'),
    (64, 'huge_word'), (128, 'few_distinct_words'), (256, 'many_digits'), (512, 'many_capitals'), (1024, 'bullet_lines'), (2048, 'ellipsis_lines')) AS v(bit, rule)
)
SELECT policy, rule, CAST(count(*) FILTER (fail_bits & bit <> 0) AS BIGINT) AS n_failed,
  CAST(count(*) FILTER (fail_bits & bits = bit) AS BIGINT) AS n_failed_alone,
  CAST(count(*) FILTER (fail_bits & bits & ~bit = 0) AS BIGINT) AS n_kept_without
FROM p JOIN r ON bits & bit <> 0 CROSS JOIN b GROUP BY policy, rule
"""

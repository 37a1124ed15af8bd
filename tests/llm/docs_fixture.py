"""A small table with everything that may come up: nulls, empty and long texts, ties, repeats, clashing columns."""

import numpy as np

CLASHING = "score double, n bigint, size bigint, copies int, rep bigint, label int, x int, `row` string, kept boolean, tag bigint, doc bigint, n_words int, piece int, length bigint, spans string, target double, component_id bigint, band int"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + CLASHING


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(n))


def odd_rows():
    rng = np.random.default_rng(11)
    base, other = words(rng, 120), words(rng, 400)
    edited = base.split()
    edited[60] = "changed"
    texts = [
        (1, base, "a"), (2, " ".join(edited), "a"), (3, base.upper(), "b"), (4, None, "a"), (5, "", None), (6, " \n\t ", "b"), (7, other, None), (8, "short text", "c"),
        (9, other[:900] + "\n" + words(rng, 80), "c"), (10, "x" * 5000, "a"), (10, "x" * 5000, "a"), (11, "é" * 300 + " " + words(rng, 30), "b"), (None, base, "a"), (None, None, None),
        (12, words(rng, 30_000), "a"), (13, "same line\n" * 40, "b"), (14, "# $ % & " * 60, "b"), (7, words(rng, 50), "d"), (15, "<|endoftext|> " + words(rng, 20), "c"),
    ]
    extra = (0.5, 1, 1, 1, 1, 1, 1, "r", True, 1, 1, 1, 1, 1, "s", 1.0, 1, 1)
    return [(i, t, "en", s, None if t is None else len(t), *extra) for i, t, s in texts]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=((1, 1, 0), (2, 1, 0), (7, 1, 0), (13, 0, 1), (14, 0, 1), (99, 1, 1), (None, 1, 1), (3, None, None))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")

"""Quality classifier: histogram gradient boosting over statistics of the whole text.

The statistics are native columns; trees are fitted on the driver from a bounded sample of labelled
statistics (SAMPLE rows, the smallest hashes of doc_id: no text leaves the executors) and travel as flat
arrays that every batch walks at once.

A null or empty text has its statistics (zeros) and gets a score. Null labels are not learnt from. Without
any labelled row the score is 0.5. A null doc_id is never held out and matches no label. Repeated rows
score alike. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import boosting, rules
from tideline.llm.common import text_or_empty

#: Labelled rows to learn from, at most.
SAMPLE = 20_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
FEATURES = ["chars", "words", "mean_word", "symbols", "dup_lines", "repeats", "distinct", "line_words", "stops"]


def statistics(docs: DataFrame) -> DataFrame:
    """row (all of the input's columns), doc_id and x, an array of FEATURES."""
    df = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    df = rules.with_measurements(df, more=("n_distinct",))
    text, words, lines = F.col("text"), F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    values = [
        F.log1p(F.char_length(text)),
        F.log1p("n_words"),
        F.col("word_chars") / words,
        F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
        F.col("n_dup_lines") / lines,
        F.col("n_repeat_words") / words,
        F.col("n_distinct") / words,
        F.log1p(words / lines),
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("."), F.lit("")))) / words,
    ]
    return df.select("row", "doc_id", F.array(*(v.cast("double") for v in values)).alias("x"))


def held_out(folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> boosting.Trees:
    """Trees from at most `sample` labelled documents outside the held-out fold."""
    y = labels.where(~held_out()).where("quality is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")).join(F.broadcast(chosen), "doc_id").select("doc_id", "x", "y").toPandas()
    rows = rows.sort_values(["doc_id", "y"], kind="stable")
    x = np.stack(rows["x"].tolist()) if len(rows) else np.zeros((0, len(FEATURES)))
    return boosting.train(x, rows["y"].to_numpy())


def with_scores(docs: DataFrame, model: boosting.Trees) -> DataFrame:
    """row (all of the input's columns), doc_id and score."""

    @F.pandas_udf("double")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(model.probability(np.stack(x.tolist()) if len(x) else np.zeros((0, len(FEATURES)))))

    # not deterministic for the optimiser only: it would push a filter on the score below the statistics,
    # and with it copies of all their expressions
    return statistics(docs).withColumn("score", apply.asNondeterministic()("x"))


def score(docs: DataFrame, model: boosting.Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    df = with_scores(docs.select("doc_id", "text"), model)
    return df.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of at least the threshold; the columns of docs."""
    return with_scores(docs, fit(docs, labels)).where(F.col("score") >= threshold).select("row.*")

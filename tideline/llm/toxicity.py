"""Toxicity: a linear classifier with counterfactual regularisation.

A text is the set of its lower-case words and of the first PREFIX letters of longer words, which stand for inflections
that the labelled documents do not show. A logistic model is fitted to labelled documents; besides the usual penalty,
labelled sentences are compared with their counterfactuals, and the squared change of the score's margin is penalised,
so that a group's name cannot carry toxicity by itself:

- in a sentence that names a group, the term is exchanged for the others of its row and left out;
- into sentences of documents that name none, names are put that could change the score: listed terms whose word or
  prefix is a feature, and for every prefix that is a feature a name of a people made of it (prefix and a suffix of such
  names). So a prefix that "moron" has brought in cannot be held against the Moroccan, whatever lists of names know.

Only comparisons that touch a feature count; Model.n_pairs says how many did, and fit() warns if there are features and
none did.

Bound: at most SAMPLE labelled documents (the smallest hashes of doc_id), written once to the shared folder.
Features are all words and prefixes of these whose document shares in the classes differ significantly; counted on
executors. Scoring reads every word of every text.

A null or empty text scores by the intercept. Null labels are not learnt from; without labelled rows the
score is 0.5. A null doc_id is never held out and matches no label. Repeated rows score alike. Extra
columns are ignored.
"""

from __future__ import annotations

import re
import warnings
import zlib
from collections.abc import Collection, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut, discard, mark

SAMPLE = 12_000
LEAST_DOCS = 3
#: Standard deviations by which document shares differ at least; chance words stay out even of small samples.
SIGNIFICANCE = 4.0
PREFIX = 4
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
COUNTERFACTUAL = 10.0
RIDGE = 3e-5
#: Names that are put into a document which names no group.
INSERTED = 6
#: Suffixes of names of peoples and adherents (English, French, German, Spanish).
PEOPLE = ["an", "ian", "ese", "ish", "ite", "i", "ain", "ais", "ois", "ien", "er", "ische", "ano", "ense", "és", "í"]
#: Rows of exchangeable terms (English, French, German, Spanish); the first of each is neutral.
IDENTITIES: list[list[str]] = [
    ["person", "woman", "man", "girl", "boy", "lesbian", "immigrant", "refugee", "muslim", "jew", "christian", "hindu", "buddhist", "atheist"],
    ["people", "women", "men", "girls", "boys", "lesbians", "immigrants", "refugees", "muslims", "jews", "christians", "hindus", "buddhists", "atheists"],
    ["average", "gay", "straight", "bisexual", "transgender", "queer", "black", "white", "asian", "african", "arab", "latino", "european", "american", "jewish", "disabled", "deaf", "blind", "old", "young", "female", "male"],
    ["personne", "femme", "homme", "fille", "garçon", "lesbienne", "immigré", "réfugié", "musulman", "juif", "chrétien", "hindou", "bouddhiste", "athée"],
    ["gens", "femmes", "hommes", "filles", "garçons", "lesbiennes", "immigrés", "réfugiés", "musulmans", "juifs", "chrétiens"],
    ["mensch", "frau", "mann", "mädchen", "junge", "lesbe", "einwanderer", "flüchtling", "moslem", "jude", "christ", "buddhistin", "atheistin"],
    ["menschen", "frauen", "männer", "jungen", "lesben", "flüchtlinge", "muslime", "juden", "christen", "hindus", "buddhisten", "atheisten"],
    ["persona", "mujer", "hombre", "chica", "chico", "lesbiana", "inmigrante", "refugiado", "musulmán", "judío", "cristiano", "hindú", "budista", "ateo"],
    ["personas", "mujeres", "hombres", "chicas", "chicos", "lesbianas", "inmigrantes", "refugiados", "musulmanes", "judíos", "cristianos"],
]
ROW_OF: dict[str, list[str]] = {}
for _row in IDENTITIES:
    for _term in _row:
        ROW_OF.setdefault(_term, _row)
_words = re.compile(r"\w+")
_sentences = re.compile(r"[^.!?\n]+")


def features(text: str) -> set[str]:
    """Words, and prefixes marked by a leading ^."""
    words = set(_words.findall(text.lower()))
    return words | {"^" + w[:PREFIX] for w in words if len(w) > PREFIX}


def acting_names(live: Collection[str]) -> list[tuple[str, str]]:
    """(name, its neutral term) of the names that could change a score by the features that are live."""
    named = [(t, row[0]) for t, row in ROW_OF.items() if t != row[0] and features(t) & set(live)]
    made = []
    for k, f in enumerate(sorted(f for f in live if f[0] == "^")):
        names = (f[1:] + PEOPLE[(k + j) % len(PEOPLE)] for j in range(len(PEOPLE)))
        made += [(n, "people") for n in names if n not in live][:1]
    return named + made


def counterfactuals(text: str, names: Sequence[tuple[str, str]]) -> list[tuple[frozenset[str], frozenset[str]]]:
    """For each sentence and exchange: features gained and lost. `names` are put into a text that names no group."""
    out, low = [], text.lower()

    def compare(before: str, after: str) -> None:
        x, y = features(before), features(after)
        out.append((frozenset(y - x), frozenset(x - y)))

    sentences = [s for s in _sentences.findall(low) if _words.search(s)]
    for sentence in sentences if any(t in low for t in ROW_OF) else ():
        words = _words.findall(sentence)
        for term in ROW_OF.keys() & set(words):
            for other in (*ROW_OF[term], ""):
                if other != term:
                    compare(sentence, " ".join(other if w == term else w for w in words))
    if not out and sentences and names:
        h = zlib.crc32(low.encode())
        for k in range(min(INSERTED, len(names))):
            sentence, (name, neutral) = sentences[(h + k) % len(sentences)], names[(h // 7 + k) % len(names)]
            compare(f"{neutral} {sentence}", f"{name} {sentence}")
            compare(sentence, f"{name} {sentence}")
    return [x for x in out if x[0] or x[1]]


class Model:
    def __init__(self, weights: dict[str, float], bias: float, n_pairs: int = 0) -> None:
        self.n_pairs = n_pairs
        self.words = {f: w for f, w in weights.items() if f[0] != "^" and w}
        self.prefixes = {f[1:]: w for f, w in weights.items() if f[0] == "^" and w}
        self.bias = bias

    def margin(self, text: str | None) -> float:
        total = self.bias
        if text:
            words = set(_words.findall(text.lower()))
            get = self.words
            total += sum([get[w] for w in words & get.keys()])
            get = self.prefixes
            if get:
                total += sum([get[p] for p in {w[:PREFIX] for w in words if len(w) > PREFIX} & get.keys()])
        return total

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(text), -30, 30))))


def train(x: list[np.ndarray], y: np.ndarray, changes: list[tuple[np.ndarray, np.ndarray]], width: int, counterfactual: float = COUNTERFACTUAL, ridge: float = RIDGE, steps: int = 500) -> tuple[np.ndarray, float]:
    """Weights and bias of the penalised logistic fit (Adam on the whole sample).

    x: feature numbers of each document; changes: of each counterfactual, those gained and lost.
    """
    if not len(y):
        return np.zeros(width), 0.0

    def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, int)]).astype(int)

    (row, col), n = flat(x), len(y)
    (plus_row, plus), (minus_row, minus), m = flat([a for a, _ in changes]), flat([b for _, b in changes]), len(changes)
    # both classes weigh the same: toxic documents are few, and one word may be all they have
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b = np.zeros(width), 0.0
    m1, m2 = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], n) + b
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.bincount(col, r[row], width) + ridge * w
        if m:
            d = (np.bincount(plus_row, w[plus], m) - np.bincount(minus_row, w[minus], m)) * (2 * counterfactual / m)
            g += np.bincount(plus, d[plus_row], width) - np.bincount(minus, d[minus_row], width)
        g = np.append(g, r.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def held_out(folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, counterfactual: float = COUNTERFACTUAL) -> Model:
    y = labels.where(~held_out()).where("toxic is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("double").alias("y"))
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the labelled sample is bounded, so it may be broadcast; its texts are read from the corpus once
    since = mark()
    texts = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null").join(F.broadcast(chosen), "doc_id"), "toxicity-sample")

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "f": [list(features(t)) for t in pdf["text"]]})

    described = texts.mapInPandas(describe, "doc_id bigint, y double, f array<string>")
    share = described.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    total = texts.agg(F.sum("y"), F.count("*")).first()
    pos, n = float(total[0] or 0), int(total[1] or 0)
    gap = F.abs(F.col("pos") / max(pos, 1.0) - (F.col("n") - F.col("pos")) / max(n - pos, 1.0))
    p = F.col("n") / max(n, 1)
    share = share.where(F.col("n") >= LEAST_DOCS).withColumn("z", gap / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / max(pos, 1.0) + 1 / max(n - pos, 1.0))))
    top = [r["f"] for r in share.where(F.col("z") >= SIGNIFICANCE).orderBy("f").select("f").collect()]
    number = {f: i for i, f in enumerate(top)}
    names = acting_names(number.keys())

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            swaps = [{(tuple(sorted(number[f] for f in a if f in number)), tuple(sorted(number[f] for f in b if f in number))) for a, b in counterfactuals(t, names)} - {((), ())} for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "y": pdf["y"], "x": [sorted(number[f] for f in features(t) if f in number) for t in pdf["text"]],
                "gained": [[list(a) for a, _ in sorted(s)] for s in swaps], "lost": [[list(b) for _, b in sorted(s)] for s in swaps],
            })

    rows = texts.mapInPandas(encode, "doc_id bigint, y double, x array<int>, gained array<array<int>>, lost array<array<int>>").toPandas()
    discard(since)
    rows = rows.sort_values(["doc_id", "y"], kind="stable")
    changes = [(np.asarray(a, int), np.asarray(b, int)) for g, l in zip(rows["gained"], rows["lost"]) for a, b in zip(g, l)]
    if number and not changes:
        warnings.warn("no counterfactual touches a feature: the fit is the plain one", stacklevel=2)
    w, b = train([np.asarray(v, int) for v in rows["x"]], rows["y"].to_numpy(), changes, len(number), counterfactual)
    return Model({f: float(w[i]) for f, i in number.items()}, b, len(changes))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    @F.pandas_udf("double")
    def apply(text: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in text], dtype=float)

    df = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), apply("text").alias("score"))
    return df.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))

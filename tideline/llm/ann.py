"""Approximate nearest neighbours by score-aware (anisotropic) product quantisation.

Euclidean search is put as maximum inner product: x becomes (x, -|x|^2 / 2) and a query (q, 1). Codes are
four bits per subspace; they are chosen to minimise |r|^2 + (ETA - 1) (r . x/|x|)^2, so the residual's part
parallel to the vector, which moves high inner products most, costs more than the rest. Codebooks are
fitted on a bounded sample (TRAIN vectors); every vector is indexed.

A search stores packed codes once. Queries come in blocks of about QUERY_BLOCK (at most QUERY_BYTES), which each worker
gets once; codes are never shuffled: tables for pairs of subspaces scan them where they are. Of one code in SAMPLED, the
`rerank` best of each query are ranked by their true vectors: what the k + 1 nearest rows among these reach, less the
codes' error, bounds the query's whole scan. So each query ranks as many vectors exactly as its surroundings ask for: few
where neighbours stand out, a whole cluster where codes cannot tell its members apart. A block of codes sends one row a
query, and nothing is held back.

The codes' error is measured, not fixed: for GUARDED queries the nearest rows are found by brute force, and the bound
allows for the error that ERROR of their codes stay under. With exact=True codes are not used: blocks of rows are ranked
by their true distances, and a task keeps the k + 1 nearest classes of each query.

Equal vectors are searched once: each class has its smallest k + 1 ids, which is all a top-k list can use.
Vectors of each length are searched by themselves (distance is between vectors of a length). Vectors that
are null, zero, or hold a null or non-finite component, and rows with a null vec_id, take no part. Rows
repeating a vec_id count once (the smallest vector). Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import cut

TRAIN = 10_000
ETA = 4.0
WIDTH = 2  # components of a subspace
RERANK, GUARDED, ERROR = 64, 64, 0.99
ROW_BLOCK, QUERY_BLOCK, QUERY_BYTES = 8192, 8192, 64 << 20
SAMPLED = 4
#: Groups in which sampled scores are combined first.
GROUPS = 64
K = 10


def usable(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id and v (doubles) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    df = df.select(F.col(key).cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(~bad & F.exists("v", lambda x: x != 0))


class Quantiser:
    def __init__(self, sample: np.ndarray, eta: float = ETA, width: int = WIDTH, seed: int = 5) -> None:
        self.eta, self.width, self.dim = eta, width, sample.shape[1]
        self.scale = max(float(np.abs((sample**2).sum(1)).std()), 1e-12) if len(sample) else 1.0
        x = self.lift(sample)
        self.parts = x.shape[1] // width
        rng = np.random.default_rng(seed)
        self.books = np.zeros((self.parts, 16, width))
        for m in range(self.parts):
            s = x[:, m * width : (m + 1) * width]
            c = s[rng.integers(0, len(s), 16)] if len(s) else np.zeros((16, width))
            for _ in range(10):
                near = ((s[:, None] - c) ** 2).sum(2).argmin(1)
                n = np.bincount(near, minlength=16)
                for j in range(width):
                    c[:, j] = np.where(n > 0, np.bincount(near, s[:, j], 16) / np.maximum(n, 1), c[:, j])
            self.books[m] = c
        for _ in range(3 if len(x) else 0):
            self._refit(x, self._assign(x))

    def lift(self, v: np.ndarray) -> np.ndarray:
        """(x, -|x|^2 / 2) with the last component scaled to the others' size, padded to whole subspaces."""
        last = -0.5 * (v**2).sum(1, keepdims=True) / self.scale
        pad = -(v.shape[1] + 1) % (2 * self.width)
        return np.hstack([v, last, np.zeros((len(v), pad))])

    def lift_query(self, q: np.ndarray) -> np.ndarray:
        pad = -(q.shape[1] + 1) % (2 * self.width)
        return np.hstack([q, np.full((len(q), 1), self.scale), np.zeros((len(q), pad))])

    def _assign(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss."""
        n, w = len(x), self.width
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        codes = np.zeros((n, self.parts), np.uint8)
        along = np.zeros(n)  # r . unit, summed over subspaces
        err, dot = [], []
        for m in range(self.parts):
            r = x[:, None, m * w : (m + 1) * w] - self.books[m]
            err.append((r**2).sum(2))
            dot.append((r * unit[:, None, m * w : (m + 1) * w]).sum(2))
            codes[:, m] = err[m].argmin(1)
            along += dot[m][np.arange(n), codes[:, m]]
        for _ in range(sweeps):
            for m in range(self.parts):
                rest = along - dot[m][np.arange(n), codes[:, m]]
                loss = err[m] + (self.eta - 1) * (rest[:, None] + dot[m]) ** 2
                codes[:, m] = loss.argmin(1)
                along = rest + dot[m][np.arange(n), codes[:, m]]
        return codes

    def _refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Each codeword by least squares on the anisotropic loss, the others held."""
        w = self.width
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        decoded = np.hstack([self.books[m][codes[:, m]] for m in range(self.parts)])
        along = ((x - decoded) * unit).sum(1)
        for m in range(self.parts):
            cols = slice(m * w, (m + 1) * w)
            mine = ((x[:, cols] - decoded[:, cols]) * unit[:, cols]).sum(1)
            rest = along - mine
            for c in range(16):
                at = codes[:, m] == c
                if at.any():
                    u, s = unit[at, cols], x[at, cols]
                    a = at.sum() * np.eye(w) + (self.eta - 1) * u.T @ u
                    b = s.sum(0) + (self.eta - 1) * (u * (rest[at] + (s * u).sum(1))[:, None]).sum(0)
                    self.books[m, c] = np.linalg.solve(a, b)
            decoded[:, cols] = self.books[m][codes[:, m]]
            along = rest + ((x[:, cols] - decoded[:, cols]) * unit[:, cols]).sum(1)

    def encode(self, v: np.ndarray) -> np.ndarray:
        """Packed codes: two four-bit codes a byte."""
        codes = self._assign(self.lift(v))
        return codes[:, 0::2] | (codes[:, 1::2] << 4)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """float32[queries, bytes, 256]: what each packed byte adds to a query's inner product."""
        lifted, w = self.lift_query(q), self.width
        four = np.stack([lifted[:, m * w : (m + 1) * w] @ self.books[m].T for m in range(self.parts)], 1)
        low, high = four[:, 0::2], four[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(q), -1, 256).astype(np.float32)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; ties to smaller ids."""
    if len(scores) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > bound)
        at = np.flatnonzero(scores == bound)
        at = at[np.argsort(ids[at], kind="stable")][: k - len(above)]
        return np.concatenate([above, at])
    return np.arange(len(scores))


def _matrix(vectors: DataFrame) -> np.ndarray:
    values = vectors.select("v").toArrow().column("v").combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def fit(rows: DataFrame, train: int = TRAIN) -> Quantiser:
    """From at most `train` vectors (all of one length), those with the smallest hashes of id."""
    return Quantiser(_matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(train)))


def _stacked(codes: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(codes, np.uint8).reshape(n, -1).T)


def _scores(model: Quantiser, vectors: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each query, the inner products of all codes (one row per byte) by its tables."""
    for at in range(0, len(vectors), 64):
        for i, t in enumerate(model.tables(vectors[at : at + 64]), at):
            out = t[0][codes[0]]
            for b in range(1, len(codes)):
                out += t[b][codes[b]]
            yield i, out


def _error(model: Quantiser, classes: DataFrame, queries: DataFrame, k: int) -> float:
    """How much lower than the true inner product the codes of near rows score: of GUARDED queries (those with the smallest
    hashes), what the share ERROR of their k + 1 nearest rows stay under."""
    guarded = _matrix(queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(GUARDED))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k + 1 nearest of each task, and their errors."""
        found = []
        for pdf in batches:
            x, ids, size = np.stack(pdf["v"].tolist()), pdf["cls"].to_numpy(np.int64), pdf["size"].to_numpy()
            packed, half = np.ascontiguousarray(model.encode(x).T), 0.5 * (x**2).sum(1)
            for i, approx in _scores(model, guarded, packed):
                d = ((x - guarded[i]) ** 2).sum(1)
                near = _best(-d, ids, k + 1)
                found.append(pd.DataFrame({"q": i, "cls": ids[near], "size": size[near], "d": d[near], "err": x[near] @ guarded[i] - half[near] - approx[near]}))
            found = [pd.concat(found).sort_values(["q", "d", "cls"]).groupby("q").head(k + 1)] if found else []
        yield from found

    order = W.partitionBy("q").orderBy("d", "cls")
    near = classes.select("cls", "v", F.size("ids").alias("size")).mapInPandas(nearest, "q int, cls bigint, size int, d double, err double")
    # classes that hold the first k + 1 rows: beyond a large one, farther classes are not looked for
    closer = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    errors = near.withColumn("n", closer).where(F.col("n") <= k).select("err").toPandas()["err"]  # GUARDED * (k + 1) rows at most
    return float(np.quantile(errors, ERROR)) if len(errors) else 0.0


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries, in blocks that a driver and a worker can hold."""
    total, width = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    n = max(1, -(-total // min(QUERY_BLOCK, max(1, QUERY_BYTES // (8 * (width or 1))))))
    for i in range(n):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == i).select("vec_id", "v")
        table = rows.toArrow()  # one block
        if len(table):
            yield table.column("vec_id").to_numpy(), table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)


def _sampled(model: Quantiser, codes: DataFrame, block: Broadcast, most: int) -> DataFrame:
    """query_id, part, cls, approx (arrays): of each task, the `most` best codes of each query among the first of each
    block, one in SAMPLED; blocks hold classes in no order."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, vectors = block.value
        best = [(np.zeros(0, np.float32), np.zeros(0, np.int64))] * len(names)
        for pdf in batches:
            for ids, packed in zip(pdf["ids"], pdf["codes"]):
                ids = np.frombuffer(ids, np.int64)
                n = -(-len(ids) // SAMPLED)
                for i, scores in _scores(model, vectors, np.ascontiguousarray(_stacked(packed, len(ids))[:, :n])):
                    s, c = np.concatenate([best[i][0], scores]), np.concatenate([best[i][1], ids[:n]])
                    top = _best(s, c, most)
                    best[i] = s[top], c[top]
        part = TaskContext.get().partitionId() % GROUPS
        found = [i for i, (s, _) in enumerate(best) if len(s)]
        for lo in range(0, len(found), 256):
            at = found[lo : lo + 256]
            yield pd.DataFrame({"query_id": names[at], "part": part, "cls": [best[i][1] for i in at], "approx": [best[i][0] for i in at]})

    return codes.select("ids", "codes").mapInPandas(scan, "query_id bigint, part int, cls array<bigint>, approx array<float>")


def _reaching(model: Quantiser, codes: DataFrame, block: Broadcast, bounds: Broadcast) -> DataFrame:
    """query_id, cls of all codes that reach a query's bound."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, vectors = block.value
        least = bounds.value
        for pdf in batches:
            for ids, packed in zip(pdf["ids"], pdf["codes"]):
                ids, of, found = np.frombuffer(ids, np.int64), [], []
                for i, scores in _scores(model, vectors, _stacked(packed, len(ids))):
                    reach = ids[scores >= least[i]]
                    if len(reach):
                        of.append(names[i])
                        found.append(reach)
                if of:
                    yield pd.DataFrame({"query_id": of, "cls": found})

    return codes.select("ids", "codes").mapInPandas(scan, "query_id bigint, cls array<bigint>").select("query_id", F.explode("cls").alias("cls"))


def _bounds(sampled: DataFrame, names: np.ndarray, classes: DataFrame, queries: DataFrame, own: DataFrame, k: int, probed: int, error: float) -> np.ndarray:
    """What the codes must score that may belong to a query's k + 1 nearest rows; -inf where the sample has too few.

    The `probed` best sampled codes of a query and its own class (which may hold all its neighbours) are ranked by true
    inner products; those of the k + 1 nearest rows among
    them are reached by the k + 1 nearest of all, whose codes score at most `error` less.
    """

    def top(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list("z")), False), 1, probed).alias("z"))

    zipped = sampled.select("query_id", "part", F.arrays_zip("approx", "cls").alias("z"))
    best = top(top(zipped, "query_id", "part"), "query_id").select("query_id", F.explode("z.cls").alias("cls"))
    asked = queries.sparkSession.createDataFrame(pd.DataFrame({"query_id": names}), "query_id bigint")
    best = best.unionByName(own.join(asked, "query_id", "left_semi")).distinct()
    true = best.join(classes.select("cls", "v", F.size("ids").alias("size")), "cls").join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b - b * b / 2), F.lit(0.0), lambda s, x: s + x)
    by = W.partitionBy("query_id").orderBy(F.desc("s"), "cls")
    held = true.select("query_id", "cls", "size", product.alias("s")).withColumn("n", F.sum("size").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    reached = held.where(F.col("n") > k).groupBy("query_id").agg(F.max("s").alias("s")).toArrow()  # a row per query of a block
    bound = dict(zip(reached.column("query_id").to_pylist(), reached.column("s").to_pylist()))
    return np.array([bound.get(i, -np.inf) - error for i in names.tolist()], np.float32)


def _candidates(model: Quantiser, classes: DataFrame, queries: DataFrame, k: int, rerank: int) -> DataFrame:
    """query_id, cls of the codes to rank exactly."""
    context = classes.sparkSession.sparkContext

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), ROW_BLOCK):
                part = pdf.iloc[at : at + ROW_BLOCK]
                packed = model.encode(np.stack(part["v"].tolist()))
                yield pd.DataFrame({"ids": [part["cls"].to_numpy(np.int64).tobytes()], "codes": [packed.tobytes()]})

    codes = cut(classes.select("cls", "v").mapInPandas(pack, "ids binary, codes binary"), "ann-codes")
    own = cut(queries.join(classes.select("v", "cls"), "v").select(F.col("vec_id").alias("query_id"), "cls"), "ann-own")
    error, probed, found = _error(model, classes, queries, k), max(rerank, 2 * (k + 1)), []
    for names, vectors in _blocks(queries):
        block = context.broadcast((names, vectors))
        bounds = context.broadcast(_bounds(_sampled(model, codes, block, probed), names, classes, queries, own, k, probed, error))
        found.append(cut(_reaching(model, codes, block, bounds), "ann-found"))
        block.unpersist()
        bounds.unpersist()
    return functools.reduce(DataFrame.unionByName, found)


def _true_nearest(classes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, cls of the k + 1 nearest classes of each query in each task, by their true distances."""
    context, found = classes.sparkSession.sparkContext, []
    for names, vectors in _blocks(queries):
        block = context.broadcast((names, vectors))

        def nearest(batches: Iterator[pd.DataFrame], block: Broadcast = block) -> Iterator[pd.DataFrame]:
            names, vectors = block.value
            best = [(np.zeros(0), np.zeros(0, np.int64))] * len(names)
            for pdf in batches:
                for at in range(0, len(pdf), ROW_BLOCK):
                    part = pdf.iloc[at : at + ROW_BLOCK]
                    x, ids = np.stack(part["v"].tolist()), part["cls"].to_numpy(np.int64)
                    for i, q in enumerate(vectors):
                        d, c = np.concatenate([best[i][0], ((x - q) ** 2).sum(1)]), np.concatenate([best[i][1], ids])
                        if len(d) > k + 1:
                            # sums are rounded in another order where the result is ranked: near ties stay
                            near = np.flatnonzero(d <= np.partition(d, k)[k] * (1 + 1e-12))
                            d, c = d[near], c[near]
                        best[i] = d, c
            for name, (_, c) in zip(names, best):
                if len(c):
                    yield pd.DataFrame({"query_id": name, "cls": c})

        found.append(cut(classes.select("cls", "v").mapInPandas(nearest, "query_id bigint, cls bigint"), "ann-exact"))
        block.unpersist()
    return functools.reduce(DataFrame.unionByName, found)


def search(embeddings: DataFrame, k: int = K, is_query: Column | None = None, rerank: int = RERANK, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest other rows found for each query."""
    spark = embeddings.sparkSession
    is_query = F.col("vec_id") % 100 == 0 if is_query is None else is_query
    rows = cut(usable(embeddings).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-rows")
    out = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for length in sorted(r[0] for r in rows.where(is_query).select(F.size("v")).distinct().collect()):
        out = out.unionByName(_nearest(rows.where(F.size("v") == length), k, is_query, rerank, exact))
    return out


def _nearest(rows: DataFrame, k: int, is_query: Column, rerank: int, exact: bool) -> DataFrame:
    # the first ids of each distinct vector; limits of windows apply before the shuffle
    members = rows.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    classes = cut(members.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("cls", F.col("ids")[0]), "ann-classes")
    queries = rows.where(is_query)
    found = _true_nearest(classes, queries, k) if exact else _candidates(fit(rows), classes, queries, k, rerank)
    ranked = found.join(classes, "cls").join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    square = F.aggregate(F.zip_with("q", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    ranked = ranked.select("query_id", "cls", "ids", F.sqrt(square).alias("score"))
    near = W.partitionBy("query_id").orderBy("score", "cls")
    ranked = ranked.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 2)
    each = ranked.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    last = W.partitionBy("query_id").orderBy("score", "vec_id")
    return each.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

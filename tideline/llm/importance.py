"""Importance resampling towards the benchmark: bag-of-n-grams weights by hashed bucket, a draw without replacement.

Features are runs of 1 to ORDER words. Long texts are split at word boundaries into chunks of CHUNK words which
carry ORDER - 1 words more: a chunk owns the features that start in its own words, so each is counted once, and
chunks of one text are dealt to different tasks. Chunk counts are summed over the corpus, chunk weights by
document. Texts of at most LONG characters are one chunk and stay in the task that reads them.

The crc32 of a feature is combined from those of its words (crc32 is linear: appending a word of n bytes is a fixed
map of the 32 bits before it, looked up byte by byte for all places of a batch at once), so no feature is ever built
as a string.

Sent to the driver and the workers are BUCKETS counts. The draw orders all (score, doc_id) by range.

A null or empty text has no features and weight 0. A null doc_id has no hash, so neither score nor rank. Rows with the
same doc_id are rows of their own; with equal scores they are ranked in any order. Extra columns are ignored. With no
eligible document, or no benchmark (all counts 0), the formula holds as it stands.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import cut, mark, partitions, settle

BUCKETS, ORDER = 10_000, 3
CHUNK, LONG = 1 << 15, 1 << 18
#: Words hashed together.
BATCH = 1 << 17
LEAST_WORDS, SHARE, SEED = 20, 5, 42
#: Bytes of text to plain words: A-Z lowered, every ASCII character but digits and letters a space.
PLAIN = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))
#: Longer words are appended one by one.
TABLED = 64
_tables: list[np.ndarray] = []


def _appending() -> np.ndarray:
    """Flat tables: 4 x 256 values per length, of what each byte of a crc becomes when that many bytes follow."""
    if not _tables:
        out = np.zeros((TABLED, 4, 256), np.uint32)
        for n in range(TABLED):
            zero = zlib.crc32(bytes(n))
            for bit in range(32):
                moved = np.uint32(zlib.crc32(bytes(n), 1 << bit) ^ zero)
                has = np.arange(256) >> bit % 8 & 1 == 1
                out[n, bit // 8, has] ^= moved
        _tables.append(out.reshape(-1))
    return _tables[0]


def append_crc(before: np.ndarray, word: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of texts of crc `before`, each followed by a word of crc `word` and `size` bytes."""
    t, at = _appending(), np.minimum(size, TABLED - 1).astype(np.int64) * 1024
    out = t[at + (before & 255)] ^ t[at + 256 + (before >> 8 & 255)] ^ t[at + 512 + (before >> 16 & 255)] ^ t[at + 768 + (before >> 24)]
    for i in np.flatnonzero(size >= TABLED).tolist():
        zeros = bytes(int(size[i]))
        out[i] = zlib.crc32(zeros, int(before[i])) ^ zlib.crc32(zeros)
    return out ^ word


def features(texts: list[list[bytes]], owned: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """crc32 of every feature that starts in the first `owned` words of its text, and the text's number."""
    n = np.array([len(t) for t in texts], np.int64)
    words = list(chain.from_iterable(texts))
    one = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    of = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
    own = place < np.repeat(np.array(owned, np.int64), n)
    left = np.repeat(n, n) - place
    space, crc, codes, docs = np.uint32(zlib.crc32(b" ")), one, [], []
    for k in range(ORDER):
        if k:
            last = max(0, len(words) - k)
            spaced = append_crc(crc[:last], np.full(last, space), np.ones(last, np.int64))
            crc = append_crc(spaced, one[k:], size[k:])
        hit = (own & (left > k))[: len(crc)]
        codes.append(crc[hit])
        docs.append(of[: len(crc)][hit])
    return np.concatenate(codes), np.concatenate(docs)


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def chunks(docs: DataFrame) -> DataFrame:
    """uid, doc_id, text, owned: whole short texts, and the chunks of long ones, dealt over all tasks."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    long = F.coalesce(F.char_length("text") > LONG, F.lit(False))
    # even numbers for short texts, odd ones for long: the two parts are read on their own
    whole = rows.where(~long).select((2 * F.col("uid")).alias("uid"), "doc_id", "text", F.lit(2**62).alias("owned"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, key, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                words = plain_words(text.as_py().encode())
                # also a text without words is one chunk
                for lo in range(0, max(1, len(words)), CHUNK):
                    part = words[lo : lo + CHUNK + ORDER - 1]
                    yield pa.RecordBatch.from_arrays([pa.array([2 * uid.as_py() + 1], pa.int64()), pa.array([key.as_py()], pa.int64()), pa.array([b" ".join(part).decode()]), pa.array([min(CHUNK, len(words) - lo)], pa.int64()), pa.array([lo], pa.int64())], ["uid", "doc_id", "text", "owned", "at"])

    parts = rows.where(long).mapInArrow(split, "uid bigint, doc_id bigint, text string, owned bigint, at bigint")
    return whole.unionByName(parts.repartition(partitions(docs.sparkSession), "uid", "at").drop("at"))


def _read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], np.ndarray]]:
    """(bucket, number of the row) of all features of about BATCH words, the numbers of rows, their owned words."""
    texts, own, rows, size = [], [], [], 0
    text, owned = batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("owned")).to_pylist()
    for i, t in enumerate(text):
        words = plain_words(t.as_py().encode()) if t.is_valid else []
        texts.append(words)
        own.append(owned[i])
        rows.append(i)
        size += len(words)
        if size >= BATCH or i + 1 == len(text):
            crc, of = features(texts, own)
            yield (crc % np.uint32(BUCKETS)).astype(np.int64), of, rows, np.array([min(len(t), o) for t, o in zip(texts, own)], np.int64)
            texts, own, rows, size = [], [], [], 0


def bucket_counts(pieces: DataFrame) -> np.ndarray:
    """Features of all chunks by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for bucket, *_ in _read(batch):
                total += np.bincount(bucket, minlength=BUCKETS)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in pieces.select("text", "owned").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, rounded down."""
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weights(pieces: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each document of the chunks."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, of, rows, n_words in _read(batch):
                k = len(rows)
                total = np.bincount(of, gain[bucket], minlength=k).astype(np.int64)  # exact: far below 2**53
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(n_words), pa.array(np.bincount(of, minlength=k)), pa.array(total)], ["uid", "doc_id", "n_words", "n_features", "weight"])

    out = pieces.mapInArrow(weigh, "uid bigint, doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    return out.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")))


def noise(doc_id: Column | str = "doc_id", seed: int = SEED) -> Column:
    """A Gumbel variate by doc_id, in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("bigint")


def draw(scored: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds rank: 1, 2, .. for the `share` percent of documents of at least `least_words` words with the highest scores."""
    eligible = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    total = scored.where(F.col("n_words") >= least_words).count() * share // 100
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col("uid").asc()]
    n = partitions(scored.sparkSession)
    dealt = cut(scored.where(eligible).select("uid", "score", "doc_id").repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "draw")
    # one row a part; parts follow the order
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    drawn = dealt.join(F.broadcast(offsets.where(F.col("offset") < total)), "part").withColumn("rank", F.col("offset") + F.row_number().over(W.partitionBy("part").orderBy(*order))).where(F.col("rank") <= total)
    return scored.join(drawn.select("uid", F.col("rank").cast("bigint").alias("rank")), "uid", "left")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null where not drawn) of every row of docs."""
    since = mark()
    pieces = chunks(docs)
    aims = chunks(target.select(F.lit(0).alias("doc_id"), "text"))
    gain = gains(bucket_counts(pieces), bucket_counts(aims))
    scored = cut(weights(pieces, gain).withColumn("score", F.col("weight") + noise(seed=seed)), "scores")
    return settle(since, draw(scored, share, least_words).drop("uid"), "importance")


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")

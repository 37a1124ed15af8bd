"""Exact duplicates, combined in three stages that all compare full texts.

1. Where they are read, texts that are equal become one row with the list of its members (segments of SEGMENT_BYTES of
   different texts, so memory is bounded whatever a task reads).
2. Those rows are dealt by digest and a salt, sorted, and equal texts are combined as a stream. The salt of a text that
   its segment holds several times follows from the segment, so of a large group a task gets a part of the segments only;
   texts that are single in theirs have salt 0, which takes one row a segment at most.
3. Digests with more than one winner of a salt are combined over the salts (at most `salts` + 1 rows a text). Texts whose
   digest has one winner, which is most of them, do not travel again.

The digest only decides what meets; equality is always that of texts, so digests may collide. Members refer to the
winner of their salt, and take its group's result by a join on that reference, which no group of copies can crowd.

A null text counts as empty. The row with the largest doc_id stays, a null doc_id last; of rows with the same doc_id and
text one stays. Extra columns are ignored, and kept by deduplicate(). An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import cut, mark, partitions, settle, text_or_empty

#: Bytes of different texts, and members, that a segment holds.
SEGMENT_BYTES, SEGMENT_ROWS = 32 << 20, 1 << 17
#: Rows of a batch on the way out.
OUT_BYTES, OUT_ROWS = 4 << 20, 10_000
LOCAL = pa.schema([("sha", pa.binary()), ("salt", pa.int32()), ("text", pa.large_string()), ("ref", pa.int64()), ("ids", pa.list_(pa.int64()))])
MERGED = pa.schema([("sha", pa.binary()), ("text", pa.large_string()), ("ref", pa.int64()), ("best", pa.int64()), ("source", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("of", pa.int64()), ("own", pa.int64())])


def _tables(rows: Iterator[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows that come with their bytes."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n
        if size >= OUT_BYTES or len(held) >= OUT_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def combine_locally(rows: DataFrame, salts: int) -> DataFrame:
    """sha, salt, text, ref, ids (members, largest first, nulls last): one row per different text of a segment."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def segments() -> Iterator[tuple[int, tuple]]:
            found: dict[bytes, list[tuple[str, list]]] = {}
            size = members = segment = number = 0

            def flush() -> Iterator[tuple[int, tuple]]:
                nonlocal number
                for sha, texts in found.items():
                    for text, ids in texts:
                        ids.sort(key=lambda i: (i is None, -(i or 0)))
                        yield len(text) + 8 * len(ids), (sha, 1 + (part + segment) % salts if len(ids) > 1 else 0, text, part << 40 | number, ids)
                        number += 1
                found.clear()

            for batch in batches:
                for key, sha, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    text = text.as_py()
                    texts = found.setdefault(sha, [])
                    same = next((ids for t, ids in texts if t == text), None)
                    if same is None:
                        texts.append((text, [key]))
                        size += len(text) + 200
                    else:
                        same.append(key)
                    members += 1
                    if size >= SEGMENT_BYTES or members >= SEGMENT_ROWS:
                        yield from flush()
                        size = members = 0
                        segment += 1
            yield from flush()

        return _tables(segments(), LOCAL)

    return rows.mapInArrow(work, "sha binary, salt int, text string, ref bigint, ids array<bigint>")


def merge_salted(local: DataFrame, n: int) -> DataFrame:
    """Rows of two kinds: winners of a salt (sha, text, ref, best, source, n) and the local groups behind them (ids, of, own).

    `best` is the largest member, `source` the local group that holds it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged() -> Iterator[tuple[int, tuple]]:
            now, open_ = None, []  # winners of the current sha and salt: [text, ref, (has id, best, source), n]

            def flush() -> Iterator[tuple[int, tuple]]:
                for text, ref, (known, best, source), size in open_:
                    yield len(text), (now[0], text, ref, best if known else None, source, size, None, None, None)

            for batch in batches:
                sha_, salt_, refs, ids_ = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
                for sha, salt, text, ref, ids in zip(sha_, salt_, batch.column(2), refs, ids_):
                    text = text.as_py()
                    if (sha, salt) != now:
                        if now:
                            yield from flush()
                        now, open_ = (sha, salt), []
                    winner = next((w for w in open_ if w[0] == text), None)
                    rank = (ids[0] is not None, ids[0] or 0, ref)
                    if winner is None:
                        winner = [text, ref, rank, 0]
                        open_.append(winner)
                    winner[2] = max(winner[2], rank)
                    winner[3] += len(ids)
                    yield 8 * len(ids), (None, None, None, None, None, None, ids, winner[1], ref)
            if now:
                yield from flush()

        return _tables(merged(), MERGED)

    dealt = local.repartition(n, "sha", "salt").sortWithinPartitions("sha", "salt")
    return dealt.mapInArrow(work, "sha binary, text string, ref bigint, best bigint, source bigint, n bigint, ids array<bigint>, of bigint, own bigint")


def combine_salts(winners: DataFrame) -> DataFrame:
    """ref, keep_id, kept_in (the local group that holds the row which stays), group_size, text_sha256 of every winner."""
    several = cut(winners.groupBy("sha").agg(F.count("*").alias("n")).where("n > 1").select("sha"), "several-winners")
    alone = winners.join(several, "sha", "left_anti").select("ref", F.col("best").alias("keep_id"), F.col("source").alias("kept_in"), F.col("n").alias("group_size"), "text_sha256")
    # Spark broadcasts the digests below its own limit, else both sides are sorted
    groups = winners.join(several, "sha", "left_semi").groupBy("sha", "text").agg(F.max(F.struct("best", "source")).alias("top"), F.sum("n").alias("n"), F.max("text_sha256").alias("text_sha256"), F.collect_list("ref").alias("refs"))
    return alone.unionByName(groups.select(F.explode("refs").alias("ref"), F.col("top.best").alias("keep_id"), F.col("top.source").alias("kept_in"), F.col("n").alias("group_size"), "text_sha256"))


def duplicates(docs: DataFrame, normalise: Callable[[Column], Column] | None = None, salts: int | None = None, sha: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; equal are texts that normalise() makes equal.

    `salts` is how many ways copies of one text go, by default the root of the number of partitions. `sha` gives the
    digest (binary) by which texts meet, by default SHA-256.
    """
    spark, since = docs.sparkSession, mark()
    n = partitions(spark)
    salts = salts or max(4, round(n**0.5))
    text = text_or_empty() if normalise is None else normalise(text_or_empty())
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    key = sha(F.col("text")) if sha else F.unhex(F.sha2("text", 256))
    merged = cut(merge_salted(combine_locally(rows.select("doc_id", key.alias("sha"), "text"), salts), n), "salt-winners")
    hexed = F.sha2("text", 256) if sha else F.lower(F.hex("sha"))
    results = combine_salts(merged.where("ref is not null").select("sha", "text", "ref", "best", "source", "n", hexed.alias("text_sha256")))
    members = merged.where("of is not null").select("ids", F.col("of").alias("ref"), "own")
    out = members.join(results, "ref").select("own", "kept_in", "keep_id", "group_size", "text_sha256", F.posexplode("ids").alias("k", "doc_id"))
    return settle(since, out.select("doc_id", "keep_id", "group_size", ((F.col("own") == F.col("kept_in")) & (F.col("k") == 0)).alias("kept"), "text_sha256"), "exact")


def deduplicate(docs: DataFrame, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    text = text_or_empty() if normalise is None else normalise(text_or_empty())
    kept = duplicates(docs.select("doc_id", "text"), normalise).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("i"), F.sha2(text, 256).alias("s"))
    found = rows.join(kept, F.col("s").eqNullSafe(F.col("_sha")) & F.col("i").eqNullSafe(F.col("_id")), "left_semi")
    return found.withColumn("n", F.row_number().over(W.partitionBy("s", "i").orderBy(F.lit(0)))).where("n = 1").select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    return duplicates(docs)

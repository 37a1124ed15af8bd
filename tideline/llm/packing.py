"""Best-fit decreasing packing of token sequences.

Documents longer than a sequence are cut from the end into whole sequences, the first piece being the
rest. Best-fit decreasing looks at nothing but lengths, and there are at most `capacity` different ones:
so the plan is made from the histogram of lengths, whatever the size of the corpus. It places all
documents of a length as the document-by-document algorithm would: a segment tree over remaining
capacities finds the tightest open bin, bins of equal remaining capacity are kept as ranges. The plan is a
list of ranges (at most capacity**2, typically a few thousand); Spark then numbers the pieces of each
length (in hash buckets, so that a frequent length is spread) and looks their places up.

A null text is empty; an empty document is the separator alone. Null and repeated doc_ids: every row is
packed as a document of its own. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import cut, partitions
from tideline.llm.tokens import as_array, default_paths, encoder

CAPACITY = 2048
SEPARATOR = 0
BUCKET_ROWS = 20_000


def pieces(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece."""
    paths = paths or default_paths()
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(paths)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = as_array([*(encode(text.as_py()) if text.is_valid else ()), SEPARATOR], "<u4")
                n = len(ids)
                start, end, k = 0, n % capacity or min(n, capacity), 0
                while start < n:
                    for column, value in zip(out, (doc, k, start, end - start, zlib.crc32(ids[start:end]), ids[start:end] if with_ids else None)):
                        column.append(value)
                    start, end, k = end, end + capacity, k + 1
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:5])]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in out[5]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


class CapacityTree:
    """Which remaining capacities have open bins; the smallest one of at least n in logarithmic time."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = np.zeros(2 * self.size, bool)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.size
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, n: int) -> int | None:
        i = n + self.size
        while not self.open[i]:
            while i & 1:  # from a right child upwards
                i //= 2
            if i == 0:
                return None
            i += 1  # the sibling to the right
            if i & (i - 1) == 0:  # past the end of its level
                return None
        while i < self.size:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.size


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Ranges of the best-fit decreasing packing: the piece of rank first + t of its length goes to bin
    bin + t // per_bin at place base + t % per_bin * length."""
    tree, bins, used, out = CapacityTree(capacity), {}, 0, []

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            bins.setdefault(remaining, []).append((first, n))
            tree.set(remaining, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                fresh = -(-left // (capacity // length))
                put(capacity, used, fresh)
                used += fresh
                continue
            first, n = bins[room].pop()
            if not bins[room]:
                del bins[room]
                tree.set(room, False)
            per_bin = room // length
            m = min(left, n * per_bin)
            out.append((length, rank, first, per_bin, capacity - room))
            whole, rest = divmod(m, per_bin)
            put(room - per_bin * length, first, whole)
            put(room - rest * length, first + whole, int(rest > 0))
            put(room, first + whole + (rest > 0), n - whole - (rest > 0))
            left, rank = left - m, rank + m
    return pd.DataFrame(out, columns=["length", "first", "bin", "per_bin", "base"]).astype("int64")


def ranked(cut_pieces: DataFrame, total: int) -> DataFrame:
    """Adds rank: a number from 0, without gaps, among the pieces of the same length."""
    n = max(1, -(-total // BUCKET_ROWS))
    df = cut_pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)).cast("int"))
    inner = W.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = df.groupBy("bucket", "length").count().select("bucket", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset_"))
    return df.withColumn("r", F.row_number().over(inner) - 1).join(offsets, ["bucket", "length"]).withColumn("rank", F.col("offset_") + F.col("r")).drop("bucket", "r", "offset_")


def pack(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and offset there."""
    cut_pieces = cut(pieces(docs, capacity, paths, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in cut_pieces.groupBy("length").count().collect()}  # at most capacity rows
    where = plan(counts, capacity)
    start = where["length"].to_numpy() * (1 << 40) + where["first"].to_numpy()  # fewer than 2**40 pieces of a length
    order = np.argsort(start, kind="stable")
    start, bin_, per_bin, base, first = (x[order] for x in (start, *(where[c].to_numpy() for c in ("bin", "per_bin", "base", "first"))))

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(start, length.to_numpy() * (1 << 40) + rank.to_numpy(), side="right") - 1
        t = rank.to_numpy() - first[at]
        return pd.DataFrame({"sequence_id": bin_[at] + t // per_bin[at], "offset": base[at] + t % per_bin[at] * length.to_numpy()})

    keep = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    out = ranked(cut_pieces, sum(counts.values())).withColumn("p", place("length", "rank"))
    return out.select(*keep, F.col("p.sequence_id").alias("sequence_id"), F.col("p.offset").alias("offset"))

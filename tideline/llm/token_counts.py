"""Tokens per document from flat token files without an index.

write_tokens() makes such files: 16- or 32-bit little-endian ids, each document closed by an
end-of-document id, nothing else. scan() splits files into blocks, finds the separators of each block
with one vectorised search, and stitches documents that cross blocks with prefix scans over the blocks of
a file: a sum of separators gives a block's first document its number, a maximum of separator places gives
it its start. Nothing reads a block twice, and a document may span any number of blocks.

A null or empty text is a document of 0 tokens. Tokens after the last separator of a file belong to no
document. Null and repeated doc_ids: one row each. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import cut, mark, new_folder, partitions, settle
from tideline.llm.tokens import as_array, default_paths, encoder

END = 50256
BLOCK = 1 << 21


def write_tokens(docs: DataFrame, folder: str, paths: tuple[str, str] | None = None, end: int = END, dtype: str = "<u2") -> DataFrame:
    """Writes token files into folder (one per task) and returns file, ordinal, doc_id, file_tokens.

    A retried task writes another file; only files named by the returned rows count, so cut() the result
    before using it twice.
    """
    paths = paths or default_paths()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        encode, name = encoder(paths, special=False), f"tokens-{uuid.uuid4().hex}.bin"
        n = tokens = 0
        with store.open_output_stream(f"{root}/{name}") as f:
            for pdf in batches:
                for text in pdf["text"]:
                    ids = as_array([*(encode(text) if text else ()), end], dtype)
                    f.write(ids.tobytes())
                    tokens += len(ids)
                yield pd.DataFrame({"file": name, "ordinal": np.arange(n, n + len(pdf)), "doc_id": pdf["doc_id"], "file_tokens": tokens})
                n += len(pdf)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, "file string, ordinal bigint, doc_id bigint, file_tokens bigint")


def scan(spark: SparkSession, files: DataFrame, folder: str, end: int = END, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """file, ordinal, n_tokens of every document in files(file, file_tokens)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        width = np.dtype(dtype).itemsize
        for pdf in batches:
            for name, at in zip(pdf["file"], pdf["at"]):
                with store.open_input_file(f"{root}/{name}") as f:
                    ids = np.frombuffer(f.read_at(block * width, int(at) * width), dtype)
                ends = np.flatnonzero(ids == end) + int(at)
                yield pd.DataFrame({"file": [name], "at": [at], "ends": [ends]})

    blocks = files.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("file_tokens") - 1, F.lit(block).cast("bigint")))).select("file", "at")
    found = blocks.repartition(partitions(spark), "file", "at").mapInPandas(run, "file string, at bigint, ends array<bigint>")
    earlier = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    stitched = found.withColumn("n_before", F.coalesce(F.sum(F.size("ends")).over(earlier), F.lit(0))).withColumn(
        "last_before", F.coalesce(F.max(F.array_max("ends")).over(earlier), F.lit(-1).cast("bigint"))
    )
    starts = F.concat(F.array("last_before"), "ends")
    pairs = F.zip_with(F.slice(starts, F.lit(1), F.size("ends")), "ends", lambda a, b: b - a - 1)
    return stitched.where(F.size("ends") > 0).select("file", "n_before", F.posexplode(pairs).alias("k", "n_tokens")).select("file", (F.col("n_before") + F.col("k")).alias("ordinal"), "n_tokens")


def counts(docs: DataFrame, paths: tuple[str, str] | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens of every document, read back from the token files."""
    spark, since = docs.sparkSession, mark()
    folder = new_folder(spark, "tokens")
    manifest = cut(write_tokens(docs, folder, paths), "token-manifest")
    # both sides grow with the documents, and the manifest's file size says little about its rows: no broadcast
    files = manifest.groupBy("file").agg(F.max("file_tokens").alias("file_tokens"))
    return settle(since, manifest.hint("merge").join(scan(spark, files, folder, block=block), ["file", "ordinal"]).select("doc_id", "n_tokens"), "token-counts")

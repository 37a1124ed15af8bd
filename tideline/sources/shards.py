"""Compressed shards with checks: lines written once each, counted and digested while they are written."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.plans.shared import cut, partitions

PIECE = 8 << 20
SHARD = "file string, rows bigint, bytes bigint, sha256 string, content_sha256 string"


class _Shard:
    """One zstd file with a checksum, under a temporary name until it is whole."""

    def __init__(self, store, root: str, level: int) -> None:
        import zstandard

        self.store, self.root, self.name = store, root, f"part-{uuid.uuid4().hex}.jsonl.zst"
        self.rows, self.size, self.packed, self.content = 0, 0, hashlib.sha256(), hashlib.sha256()
        self.out = store.open_output_stream(f"{root}/.{self.name}", compression=None)
        self.coder = zstandard.ZstdCompressor(level=level, write_checksum=True).compressobj()

    def _put(self, data: bytes) -> None:
        self.size += len(data)
        self.packed.update(data)
        self.out.write(data)

    def add(self, lines: list[str]) -> None:
        data = "".join(x + "\n" for x in lines).encode()
        self.content.update(data)
        self.rows += len(lines)
        self._put(self.coder.compress(data))

    def close(self) -> tuple:
        self._put(self.coder.flush())
        self.out.close()
        self.store.move(f"{self.root}/.{self.name}", f"{self.root}/{self.name}")
        return self.name, self.rows, self.size, self.packed.hexdigest(), self.content.hexdigest()


def write_shards(df: DataFrame, folder: str, line: Column, key: str | None = None, order: tuple[str, ...] = (), level: int = 6) -> DataFrame:
    """Writes a line per row to zstd shards (level 6, with checksum) and returns [key,] file, rows, bytes, sha256, content_sha256.

    With a key (a day) each of its values is one shard, its lines in `order`; else each task's rows are one. A shard is
    streamed, so its size is no matter of memory. Tasks that are retried write other files: only those returned count.
    content_sha256 is of the lines as they are before compression. Rows with a null key are left out.
    """
    spark = df.sparkSession
    kind = f"{key} {df.schema[key].dataType.simpleString()}, " if key else ""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        shard, now, done = None, None, []
        for pdf in batches:
            for k, part in pdf.groupby("k", sort=False) if key else [(None, pdf)]:
                if shard is None or (key and k != now):
                    if shard is not None:
                        done.append((now, *shard.close()))
                    shard, now = _Shard(store, root, level), k
                shard.add(part["line"].tolist())
        if shard is not None:
            done.append((now, *shard.close()))
        columns = ["k", "file", "rows", "bytes", "sha256", "content_sha256"]
        yield pd.DataFrame(done, columns=columns).rename(columns={"k": key} if key else {}).drop(columns=[] if key else ["k"])

    rows = df.select(*([F.col(key).alias("k")] if key else []), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), line.alias("line"))
    if key:
        rows = rows.where("k is not null").repartition(partitions(spark), "k").sortWithinPartitions("k", *(f"o{i}" for i in range(len(order))))
    elif order:
        rows = rows.sortWithinPartitions(*(f"o{i}" for i in range(len(order))))
    return cut(rows.mapInPandas(write, kind + SHARD), "shards")


def pieces(folder: str, name: str) -> Iterator[bytes]:
    """Content of a file, PIECE bytes at a time."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/{name}", compression=None) as f:
        while piece := f.read(PIECE):
            yield piece


def _unpacked(folder: str, name: str) -> Iterator[bytes]:
    """Content of a shard; a shard that fails its checksum is an error."""
    import zstandard

    coder = zstandard.ZstdDecompressor().decompressobj() if name.endswith(".zst") else None
    for piece in pieces(folder, name):
        yield coder.decompress(piece) if coder else piece


def read_shards(files: DataFrame, folder: str) -> DataFrame:
    """file, line of the shards that files(file) names; a last line without an end counts."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["file"]:
                rest = b""
                for piece in _unpacked(folder, name):
                    *whole, rest = (rest + piece).split(b"\n")
                    for lo in range(0, len(whole), 10_000):
                        yield pd.DataFrame({"file": name, "line": [x.decode() for x in whole[lo : lo + 10_000]]})
                if rest:
                    yield pd.DataFrame({"file": [name], "line": [rest.decode()]})

    return _dealt(files).mapInPandas(read, "file string, line string")


def live_counts(files: DataFrame, folder: str) -> DataFrame:
    """file, rows, is_open of files that may still be written to: only ended lines count, is_open tells that more follows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["file"]:
                rows, last = 0, b"\n"
                for piece in _unpacked(folder, name):
                    rows += piece.count(b"\n")
                    last = piece[-1:] or last
                yield pd.DataFrame({"file": [name], "rows": [rows], "is_open": [last != b"\n"]})

    return _dealt(files).mapInPandas(count, "file string, rows bigint, is_open boolean")


def complete_lines(content: Column) -> Column:
    """Ended lines of a text: its line feeds."""
    return (F.octet_length(content) - F.octet_length(F.replace(content, F.lit("\n"), F.lit("")))).cast("bigint")


def file_digests(files: DataFrame, folder: str) -> DataFrame:
    """file, bytes, sha256 (both null where the file is missing), read in pieces: a file of any size."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["file"]:
                h, n = hashlib.sha256(), 0
                try:
                    for piece in pieces(folder, name):
                        h.update(piece)
                        n += len(piece)
                    yield pd.DataFrame({"file": [name], "bytes": [n], "sha256": [h.hexdigest()]})
                except FileNotFoundError:
                    yield pd.DataFrame({"file": [name], "bytes": pd.array([None], "Int64"), "sha256": [None]})

    return _dealt(files).mapInPandas(digest, "file string, bytes bigint, sha256 string")


def changed_files(recorded: DataFrame, folder: str) -> DataFrame:
    """file, problem of the files(file, bytes, sha256) that are missing or no longer what was recorded."""
    now = file_digests(recorded, folder).select("file", F.col("bytes").alias("_b"), F.col("sha256").alias("_h"))
    j = recorded.join(now, "file")
    problem = F.when(F.col("_h").isNull(), "missing").when(F.col("_b") != F.col("bytes"), "size changed").when(F.col("_h") != F.col("sha256"), "content changed")
    return j.select("file", problem.alias("problem")).where("problem is not null")


def _dealt(files: DataFrame) -> DataFrame:
    return files.select("file").repartition(partitions(files.sparkSession), "file")


def streamed_digest(rows: DataFrame, line: Column, order: str, *keys: str) -> DataFrame:
    """[keys,] digest: SHA-256 of the lines of each key in their order, hashed as a stream.

    A digest is one sequence by nature, so a key's lines pass through one task; none is collected.
    """
    spark = rows.sparkSession
    kinds = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, h = None, hashlib.sha256()
        for pdf in batches:
            for k, part in pdf.groupby(list(keys), sort=False, dropna=False) if keys else [((), pdf)]:
                if keys and now is not None and k != now:
                    yield pd.DataFrame([[*now, h.hexdigest()]], columns=[*keys, "digest"])
                    h = hashlib.sha256()
                now = k
                h.update("".join(part["line"]).encode())
        if now is not None:
            yield pd.DataFrame([[*now, h.hexdigest()]], columns=[*keys, "digest"])

    narrow = rows.select(*keys, F.col(order).alias("o"), line.alias("line"))
    dealt = narrow.repartition(partitions(spark), *keys) if keys else narrow.repartition(1)
    out = dealt.sortWithinPartitions(*keys, "o").mapInPandas(digest, kinds + "digest string")
    return out if keys else out.agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("digest"))


def shard_names(spark: SparkSession, folder: str) -> DataFrame:
    """file, bytes of what lies in the folder, but names that begin with a dot or an underscore."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
    return files.where(~F.col("file").rlike("^[._]"))



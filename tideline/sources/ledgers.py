"""Readers and writers of ledgers: JSON lines, whole documents, partitioned tables, manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideline.plans import shared
from tideline.sources import shards

#: A larger file is not held as one value.
WHOLE_BYTES = 256 << 20


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object per line, plain or compressed (gzip, zstd); anything else fails. No inference."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document per file: an object, or an array whose items are rows. Anything else fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_json_documents(df: DataFrame, path: str) -> None:
    """One JSON document a task: the array of its rows, an object each."""

    def wrapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["["]})
        follows = False
        for pdf in batches:
            rows = pdf["value"]
            if len(rows):
                yield pd.DataFrame({"value": [("," if follows or n else "") + x for n, x in enumerate(rows)]})
                follows = True
        yield pd.DataFrame({"value": ["]"]})

    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInPandas(wrapped, "value string").write.mode("errorifexists").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Unparsed lines; a last line without an end counts."""
    return spark.read.text(path)


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """file, rows of every file, without parsing."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"))
    return lines.groupBy("file").agg(F.count("*").alias("rows"))


def write_days(df: DataFrame, path: str, ts: str = "timestamp_unix", order: tuple[str, ...] = ("timestamp_unix", "trade_id")) -> None:
    """Parquet by UTC date, rows of a file in total order; days that are written replace what was there."""
    dated = df.withColumn("date", F.to_date(F.timestamp_seconds(ts)))
    (
        dated.repartitionByRange("date", *order).sortWithinPartitions("date", *order).write.partitionBy("date")
        .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").mode("overwrite").parquet(path)
    )


def write_json_lines(df: DataFrame, path: str, max_rows: int = 1_000_000) -> None:
    """JSON lines in gzip parts of at most max_rows rows."""
    df.write.option("compression", "gzip").option("maxRecordsPerFile", max_rows).mode("errorifexists").json(path)


def manifest(spark: SparkSession, path: str, ignored: tuple[str, ...] = ("_", ".")) -> DataFrame:
    """path, name, bytes, sha256 of every file below path, but those whose name begins with an ignored prefix.

    Files up to WHOLE_BYTES are hashed as one value; larger ones are read in pieces by workers. Empty files are in no scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    for p in ignored:
        files = files.where(~name.startswith(p))
    small = files.where(F.col("length") <= WHOLE_BYTES).select("path", name.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > WHOLE_BYTES).select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), name.alias("name"), F.col("length").alias("bytes"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hashes = []
            for folder, name in zip(pdf["folder"], pdf["name"]):
                h = hashlib.sha256()
                for piece in shards.pieces(folder, name):
                    h.update(piece)
                hashes.append(h.hexdigest())
            yield pdf.drop(columns="folder").assign(sha256=hashes)

    return small.unionByName(large.repartition(shared.partitions(spark), "path").mapInPandas(digest, "path string, name string, bytes bigint, sha256 string"))


def digest_of(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row: hash of the "key:value" lines in the order of the key, streamed. Rows are files or days, not events."""
    text = rows.select(F.col(key).cast("string").alias("k"), F.col(value).cast("string").alias("v"))
    return shards.streamed_digest(text, F.concat("k", F.lit(":"), "v", F.lit("\n")), "k")


def audit_counts(records: DataFrame, ts: str = "timestamp_unix") -> DataFrame:
    """Per record type: rows, first and last time, repeated ids, steps back in time along record_id."""
    w = W.partitionBy("record_type").orderBy("record_id")
    x = records.withColumn("_prev", F.lag(ts).over(w)).withColumn("_same", F.lag("record_id").over(w) == F.col("record_id"))
    return x.groupBy("record_type").agg(
        F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count_if(F.coalesce(F.col("_same"), F.lit(False))).alias("repeated"), F.count_if(F.col("_prev") > F.col(ts)).alias("regressions")
    )


def settled_days(files: DataFrame, now_unix: int, quiet_seconds: int = 300) -> DataFrame:
    """Dates before today whose files (date, modified_unix) have all been quiet for a while."""
    today = F.to_date(F.timestamp_seconds(F.lit(now_unix)))
    by = files.groupBy("date").agg(F.max("modified_unix").alias("m"))
    return by.where((F.col("date") < today) & (F.col("m") <= now_unix - quiet_seconds)).select("date")


def bound(receipts: DataFrame, recorded: DataFrame) -> DataFrame:
    """days, n_rows, bound: whether receipts(day, n, sha) still have the totals and the digest chain recorded."""

    def audit(r: DataFrame, suffix: str) -> DataFrame:
        totals = r.agg(F.count("*").alias(f"days{suffix}"), F.sum("n").cast("bigint").alias(f"n_rows{suffix}"))
        return totals.join(digest_of(r, "day", "sha").withColumnRenamed("digest", f"digest{suffix}"))  # one row each

    both = audit(receipts, "").join(audit(recorded, "_"))
    same = (F.col("days") == F.col("days_")) & (F.col("n_rows") == F.col("n_rows_")) & (F.col("digest") == F.col("digest_"))
    return both.select("days", "n_rows", same.alias("bound"))

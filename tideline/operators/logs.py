"""Event logs of contracts as rows: fills and transfers. 256-bit numbers are decimal strings."""

from __future__ import annotations

from decimal import Decimal, localcontext

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalar import stable_id, topic_address, words


#: Fixed value: digits of an exact price.
PRECISION = 50


def uint256(word: Column) -> Column:
    """The number of 64 hex digits as a decimal string; null for anything else."""

    @F.pandas_udf("string")
    def number(w: pd.Series) -> pd.Series:
        return w.map(lambda x: str(int(x, 16)) if isinstance(x, str) and len(x) == 64 else None)

    return number(word)


def exact_price(collateral: Column, tokens: Column) -> Column:
    """collateral / tokens as a plain decimal text of PRECISION digits; null without tokens. Both are decimal texts of any length."""

    @F.pandas_udf("string")
    def price(c: pd.Series, t: pd.Series) -> pd.Series:
        with localcontext() as context:
            context.prec = PRECISION
            return pd.Series([None if a is None or b is None or not int(b) else format(Decimal(a) / Decimal(b), "f") for a, b in zip(c, t)], dtype=object)

    return price(collateral, tokens)


def decode_fills(logs: DataFrame) -> DataFrame:
    """Fills from logs(log_id, protocol, topics array<string>, data string).

    v1 data: maker asset, taker asset, maker amount, taker amount, fee; the side with asset 0 pays
    collateral. v2 data: side (0 buy, 1 sell), token, maker amount, taker amount, fee, builder, metadata.
    valid is false where topics, words or assets do not fit; amounts are raw units, price is
    collateral / tokens as an exact decimal text (see exact_price), null without tokens.
    """
    w = words("data")
    x = logs.withColumns({"_w": w, "_n": F.size(w)})
    zero = F.lit("0" * 64)

    def word(i: int) -> Column:
        return F.get("_w", F.lit(i))

    v1, v2 = F.col("protocol") == "v1", F.col("protocol") == "v2"
    pays = F.when(v1, F.when((word(0) == zero) & (word(1) != zero), "BUY").when((word(1) == zero) & (word(0) != zero), "SELL")).when(v2, F.when(word(0) == zero, "BUY").when(word(0) == F.lpad(F.lit("1"), 64, "0"), "SELL"))
    x = x.withColumn("side", pays).withColumn("valid", F.coalesce((F.size("topics") == 4) & F.col("side").isNotNull() & (F.col("_n") == F.when(v1, 5).otherwise(7)), F.lit(False)))
    buy = F.col("side") == "BUY"
    token = F.when(v2, word(1)).when(buy, word(1)).otherwise(word(0))
    maker, taker, fee = word(2), word(3), word(4)
    ok = F.col("valid")
    x = x.select(
        "log_id", "valid", F.when(ok, F.col("side")).alias("side"), F.when(ok, topic_address(F.get("topics", F.lit(2)))).alias("maker"), F.when(ok, topic_address(F.get("topics", F.lit(3)))).alias("taker"),
        uint256(F.when(ok, token)).alias("token_id"), uint256(F.when(ok, F.when(buy, maker).otherwise(taker))).alias("collateral_raw"), uint256(F.when(ok, F.when(buy, taker).otherwise(maker))).alias("tokens_raw"), uint256(F.when(ok, fee)).alias("fee_raw"),
    )
    return x.withColumn("price", exact_price(F.col("collateral_raw"), F.col("tokens_raw")))


def edge_id(chain: int = 137) -> Column:
    """Identity of a log on its chain."""
    return stable_id(F.lit(chain), F.lower("transaction_hash"), "log_index", F.lower("address"))


def transfer_edges(logs: DataFrame, chain: int = 137) -> DataFrame:
    """Directed edges from logs(kind, topics, data, transaction_hash, log_index, address): kind is
    erc20_transfer, erc1155_transfer_single or erc1155_transfer_batch. Overlapping scans give equal
    edge_ids, of which one stays."""
    erc20, single = F.col("kind") == "erc20_transfer", F.col("kind") == "erc1155_transfer_single"
    w = words("data")
    first = F.when(erc20, 1).otherwise(2)
    edge = edge_id(chain)
    out = logs.select(
        edge.alias("edge_id"), "kind", topic_address(F.get("topics", first)).alias("source_address"), topic_address(F.get("topics", first + 1)).alias("target_address"),
        uint256(F.when(single, F.get(w, F.lit(0)))).alias("token_id"), uint256(F.when(erc20, F.get(w, F.lit(0))).when(single, F.get(w, F.lit(1)))).alias("amount"),
    )
    return out.dropDuplicates(["edge_id"])


def touching(edges: DataFrame, members: DataFrame, key: str = "address") -> DataFrame:
    """Edges of which one end at least is a member: two semi-joins, no disjunction."""
    m = members.select(F.col(key).alias("_m")).distinct()
    a = edges.join(m, edges["source_address"] == m["_m"], "left_semi")
    rest = edges.join(m, edges["source_address"] == m["_m"], "left_anti")
    return a.unionByName(rest.join(m, rest["target_address"] == m["_m"], "left_semi"))

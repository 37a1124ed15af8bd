"""Requests planned from counts: windows bisected until none holds too much, rows grouped under two limits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.operators.order import range_rank
from tideline.plans.shared import cut

NODE = "struct<level:int,start_ts:bigint,end_ts:bigint>"


def _child(node: Column, right: bool) -> Column:
    middle = node["start_ts"] + F.shiftright(node["end_ts"] - node["start_ts"], 1)
    start, end = (middle + 1, node["end_ts"]) if right else (node["start_ts"], middle)
    return F.struct((node["level"] + 1).alias("level"), start.alias("start_ts"), end.alias("end_ts"))


def _path(ts: Column, start: Column, end: Column, least: int, depth: int) -> Column:
    """The windows that hold ts, from the whole one down to the narrowest."""

    def down(path: Column, _: Column) -> Column:
        node = F.element_at(path, -1)
        left = ts <= node["start_ts"] + F.shiftright(node["end_ts"] - node["start_ts"], 1)
        return F.when(node["end_ts"] - node["start_ts"] <= least, path).otherwise(F.concat(path, F.array(F.when(left, _child(node, False)).otherwise(_child(node, True)))))

    root = F.array(F.struct(F.lit(0).alias("level"), start.cast("bigint").alias("start_ts"), end.cast("bigint").alias("end_ts"))).cast(f"array<{NODE}>")
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(depth, 1))), root, down)


def adaptive_windows(rows: DataFrame, spans: DataFrame, scope: str, ts: str, limit: int, least: int = 0) -> DataFrame:
    """scope, start_ts, end_ts, level, n_rows, is_gap: an exact cover of every span by windows of at most `limit` rows.

    spans(scope, start_ts, end_ts) are closed windows that do not overlap in a scope. A window with more than `limit`
    rows is cut in its middle, also its halves, until end - start <= least; a window that is too full even so is a gap.
    Windows without rows belong to the cover. Rows outside the spans, or with a null scope or time, are in none.

    Rows are counted per scope and time once; these counts are summed for all windows that could arise (a time is in
    as many as there are levels), combined before the shuffle. A window arises if its parent is too full, so no round
    of requests is repeated and a hot scope is cut by its times.
    """
    widest = spans.agg(F.max(F.col("end_ts") - F.col("start_ts"))).first()[0] or 0
    depth = 0
    while widest > least:
        widest, depth = widest // 2, depth + 1
    whole = spans.select(scope, F.col("start_ts").cast("bigint").alias("span_start"), F.col("end_ts").cast("bigint").alias("span_end")).where("span_start <= span_end")
    counts = rows.where(F.col(scope).isNotNull() & F.col(ts).isNotNull()).groupBy(scope, F.col(ts).cast("bigint").alias("at")).agg(F.count("*").alias("n"))
    placed = counts.join(whole, scope).where("at between span_start and span_end")
    span = [scope, "span_start", "span_end"]
    nodes = placed.select(*span, "n", F.explode(_path(F.col("at"), F.col("span_start"), F.col("span_end"), least, depth)).alias("w")).groupBy(*span, "w").agg(F.sum("n").alias("n"))
    nodes = cut(nodes, "window-counts")
    full = (F.col("n") > limit) & (F.col("w.end_ts") - F.col("w.start_ts") > least)
    root = F.struct(F.lit(0).alias("level"), F.col("span_start").alias("start_ts"), F.col("span_end").alias("end_ts")).cast(NODE)
    arising = whole.select(*span, root.alias("w")).unionByName(nodes.where(full).select(*span, F.explode(F.array(_child(F.col("w"), False), _child(F.col("w"), True))).alias("w")))
    found = arising.join(nodes, [*span, "w"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.where(~full).select(scope, "w.start_ts", "w.end_ts", "w.level", F.col("n").alias("n_rows"), (F.col("n") > limit).alias("is_gap"))


def _next_starts(volumes: np.ndarray, here: int, most_rows: int, most_volume: int) -> np.ndarray:
    """Where the group ends that starts at each of the first `here` places; volumes go on behind them."""
    big = volumes >= most_volume
    out, end, total = np.zeros(here, np.int64), 0, 0
    sizes, n = volumes.tolist(), len(volumes)
    for i in range(here):
        if big[i]:
            out[i] = i + 1
            end, total = i + 1, 0
            continue
        if end <= i:
            end, total = i, 0
        # a later start never ends earlier
        while end < n and end - i < most_rows and not big[end] and total + sizes[end] <= most_volume:
            total += sizes[end]
            end += 1
        out[i] = end
        total -= sizes[i]
    return out


def groups_under(df: DataFrame, order: list[str], volume: str, most_rows: int, most_volume: int, block: int = 1 << 16, places: int = 6) -> DataFrame:
    """Adds rank (from 0, in `order`) and group (from 0): the greedy walk's groups of neighbours.

    A group has at most `most_rows` rows and a total of at most `most_volume`; a row that reaches this alone is a group
    of its own. Volumes are exact to `places` decimals; null counts as 0, and none is negative.

    Every place's next start depends on at most `most_rows` rows behind it, so blocks of ranks, each with that many
    rows of the next, are walked side by side: first from each place at which a group may begin (an entry maps to an
    entry of the next block), then, once pointer doubling over those maps tells each block's entry, for real. No task
    holds more than a block.
    """
    if block < most_rows:
        raise ValueError("a block must hold a whole group")
    unit = 10**places
    scaled = F.coalesce((F.col(volume).cast(f"decimal(38,{places})") * unit).cast("bigint"), F.lit(0).cast("bigint"))
    ranked = cut(range_rank(df, order, "rank"), "ranked")
    rows = ranked.select("rank", scaled.alias("v"))
    own = F.floor(F.col("rank") / block).cast("bigint")
    behind = rows.where((own > 0) & (F.col("rank") % block < most_rows)).select((own - 1).alias("block"), "rank", "v")
    blocks = rows.select(own.alias("block"), "rank", "v").unionByName(behind)
    limit = most_volume * unit

    def walked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        pdf = pdf.sort_values("rank")
        rank = pdf["rank"].to_numpy()
        here = int((rank // block == rank[0] // block).sum())
        return rank, _next_starts(pdf["v"].to_numpy(), here, most_rows, limit)

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        rank, after = walked(pdf)
        here = len(after)
        # where the walk that starts at a place leaves the block
        out = after - here
        for i in range(here - 1, -1, -1):
            if out[i] < 0:
                out[i] = out[after[i]]
        k = np.arange(min(most_rows, here))
        b = rank[0] // block
        return pd.DataFrame({"b": b, "at": k, "to_b": b + 1, "to": out[k]})

    jumps = [cut(blocks.groupBy("block").applyInPandas(entries, "b bigint, at bigint, to_b bigint, to bigint"), "entries")]
    n_blocks = -(-ranked.count() // block)
    while 2 ** len(jumps) < n_blocks:
        j = jumps[-1]
        k = j.select(F.col("b").alias("to_b"), F.col("at").alias("to"), F.col("to_b").alias("next_b"), F.col("to").alias("next"))
        jumps.append(cut(j.join(k, ["to_b", "to"]).select("b", "at", F.col("next_b").alias("to_b"), F.col("next").alias("to")), "jumps"))
    reached = df.sparkSession.createDataFrame([(0, 0)], "b bigint, at bigint")
    for j in reversed(jumps):
        reached = reached.unionByName(reached.join(j, ["b", "at"]).select(F.col("to_b").alias("b"), F.col("to").alias("at")))
    reached = cut(reached.where(F.col("b") < n_blocks), "reached").select(F.col("b").alias("block"), "at")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        entry = int(pdf["at"].iloc[0])
        rank, after = walked(pdf)
        starts = []
        i = entry
        while i < len(after):
            starts.append(i)
            i = int(after[i])
        at = np.arange(entry, min(i, len(rank)))
        return pd.DataFrame({"b": rank[0] // block, "rank": rank[at], "k": np.searchsorted(starts, at, side="right") - 1})

    grouped = cut(blocks.join(reached, "block").groupBy("block").applyInPandas(assign, "b bigint, rank bigint, k bigint"), "grouped")
    before = W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)  # one row per block
    shift = grouped.groupBy("b").agg((F.max("k") + 1).alias("n")).select("b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return ranked.join(grouped.join(shift, "b").select("rank", (F.col("k") + F.col("shift")).alias("group")), "rank")

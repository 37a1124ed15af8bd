"""Mixing sources to target weights by pivotal dependent rounding (native DataFrame functions only).

A document of a source with target t and size s is wanted t / s times: the whole part is taken at once,
the fractional part is a probability. Pivotal steps pair two fractional documents and move mass (in
words, so that the source's expected words stay exactly the same) from one to the other, in a random
direction with the odds that keep each probability, until one of them is 0 or 1. Chunks of about FAN
documents are folded in parallel; each leaves one fractional document at most, and these residuals are
folded again, FAN chunks at a time, up a tree until one per source is left. Folds go from large to small
documents, so that this one tends to be small; it is rounded to the nearer side, and a source misses its
target by half a document at most.

Randomness is a hash of seed and documents: reruns agree. Every row is a document of its own; rows that are
equal in id, source and text draw together (of m of them with probability p each, the whole part of m p is
certain and one keeps the fraction), so any number of repeated rows is one item of a chunk. A null text has size 0 and takes 0 words; a null source
is a source (last in order). Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import WORD, cut, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
FAN = 48
SEED = 17


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", "source", F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("bigint").alias("size"), F.xxhash64(text).alias("mark"))


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: source, source_size, target, n_docs, by water filling.

    With rates r = cap / weight sorted ascending, the sources that stop at their cap are a prefix of that
    order; the others share what is left by weight. The windows run over one row per source.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = W.orderBy(F.col("source").asc_nulls_last())
    weights = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(place) - 1) % len(WEIGHTS) + 1)
    by = by.withColumn("weight", weights).withColumn("cap", F.lit(MOST_COPIES) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    by = by.withColumn(
        "level",
        (F.lit(SHARE) * F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(below), F.lit(0)))
        / F.sum("weight").over(rest),
    )
    # the first place whose cap lies above the level there is where capping ends
    by = by.withColumn("final", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(W.partitionBy()))
    level = F.col("final")["level"]
    target = F.when(level.isNull() | (F.col("cap") < level * F.col("weight")), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return by.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def _uniform(*parts: Column) -> Column:
    """In [0, 1): 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11).cast("double") / F.lit(float(1 << 53))


def _fold(items: Column) -> Column:
    """Pivotal rounding along an array of struct<size, h, doc_id, p>, largest first: struct<left: the fractional one or null, out: array<(doc_id, size, extra)>>."""
    item = "struct<size:bigint,h:bigint,doc_id:bigint,p:double>"
    start = F.struct(F.lit(None).cast(item).alias("left"), F.array().cast("array<struct<doc_id:bigint,size:bigint,extra:int>>").alias("out"))

    def done(x: Column, extra: Column) -> Column:
        return F.array(F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), extra.cast("int").alias("extra")))

    def held(x: Column, p: Column) -> Column:
        return F.struct(x["size"].alias("size"), x["h"].alias("h"), x["doc_id"].alias("doc_id"), p.alias("p"))

    def step(s: Column, x: Column) -> Column:
        r = s["left"]
        up_r, up_x = r["size"] * (1 - r["p"]), x["size"] * (1 - x["p"])
        down_r, down_x = r["size"] * r["p"], x["size"] * x["p"]
        raise_by, lower_by = F.least(up_r, down_x), F.least(down_r, up_x)  # of r, in words
        raises = _uniform(r["h"], x["h"], r["p"]) * (raise_by + lower_by) < lower_by
        r_ends = F.when(raises, up_r <= down_x).otherwise(down_r <= up_x)
        moved = F.when(raises, raise_by).otherwise(-lower_by)
        left = F.when(r_ends, held(x, x["p"] - moved / x["size"])).otherwise(held(r, r["p"] + moved / r["size"]))
        out = F.when(r_ends, done(r, raises)).otherwise(done(x, ~raises))
        return F.when(r.isNull(), F.struct(x.cast(item).alias("left"), s["out"].alias("out"))).otherwise(
            F.struct(left.cast(item).alias("left"), F.concat(s["out"], out).alias("out"))
        )

    return F.aggregate(items, start, step)


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs(doc_id, source, text)."""
    sized = cut(sizes(docs), "mix-sizes")
    goal = cut(targets(sized), "mix-targets")
    sized = sized.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("m")).withColumn("h", F.xxhash64(F.lit(SEED), "doc_id", "size", "mark"))
    # one row per source with a text; the optimiser broadcasts it where its size allows
    on = sized["source"].eqNullSafe(goal["source"])
    rated = sized.join(goal, on, "left").select(sized["doc_id"], sized["source"], "size", "h", "m", "n_docs", F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0)).alias("rate"))
    rated = rated.withColumn("whole", F.floor("rate").cast("int")).withColumn("p", F.when(F.col("size") > 0, F.col("m") * (F.col("rate") - F.col("whole"))).otherwise(0.0))
    rated = rated.withColumn("up", F.floor("p")).withColumn("p", F.col("p") - F.col("up"))
    fractional = F.col("p") > 0
    # all rows of a class but the one that keeps the fraction
    settled = rated.withColumn("k", F.col("m") - fractional.cast("int")).where("k > 0").withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("k"))))
    out = [settled.select("doc_id", "source", "size", (F.col("whole") + (F.col("i") <= F.col("up")).cast("int")).alias("copies"))]
    chunks = F.ceil(F.col("n_docs") / F.lit(FAN))
    level = rated.where(fractional).select(
        "source", "whole", F.pmod("h", chunks).cast("bigint").alias("chunk"), F.struct("size", "h", "doc_id", "p").alias("item")
    )
    n = goal.agg(F.max("n_docs")).first()[0] or 0
    n = -(-n // FAN)
    while True:
        folded = level.groupBy("source", "chunk", "whole").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
        folded = cut(folded.select("source", "chunk", "whole", _fold(F.col("items")).alias("f")), "mix-level")
        out.append(folded.select("source", "whole", F.inline("f.out")).select("doc_id", "source", "size", (F.col("whole") + F.col("extra")).alias("copies")))
        left = folded.where("f.left is not null")
        if n <= 1:
            last = F.col("f.left")
            out.append(left.select(last["doc_id"].alias("doc_id"), "source", last["size"].alias("size"), (F.col("whole") + (last["p"] >= 0.5).cast("int")).alias("copies")))
            break
        level = left.select("source", "whole", F.floor(F.col("chunk") / FAN).alias("chunk"), F.col("f.left").alias("item"))
        n = -(-n // FAN)
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    on = total["source"].eqNullSafe(goal["source"])
    return total.join(goal, on, "left").select("doc_id", total["source"], "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents themselves, each row as often as the mix takes it; the columns of docs.

    Rows are matched to their draws by doc_id and size. Where several rows share these, their draws are
    pooled and dealt to them in the order of a hash of the row, the remainder to the first.
    """
    rows = docs.withColumn("_size", F.regexp_count(text_or_empty("text"), F.lit(WORD)).cast("bigint"))
    draws = copies(docs).groupBy("doc_id", "source", "size").agg(F.count("*").alias("_n"), F.sum("copies").alias("_c"))
    a, b = rows.alias("a"), draws.alias("b")
    on = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a._size") == F.col("b.size"))
    joined = a.join(b, on).select("a.*", "b._n", "b._c")
    single = joined.where("_n = 1").withColumn("_k", F.col("_c"))
    order = W.partitionBy("doc_id", "source", "_size").orderBy(F.xxhash64(*docs.columns))
    several = joined.where("_n > 1").withColumn("_i", F.row_number().over(order))
    several = several.withColumn("_k", F.floor(F.col("_c") / F.col("_n")) + F.when(F.col("_i") <= F.col("_c") % F.col("_n"), 1).otherwise(0)).drop("_i")
    both = single.unionByName(several).where("_k > 0")
    return both.withColumn("_e", F.explode(F.array_repeat(F.lit(0), F.col("_k").cast("int")))).select(*docs.columns)


#: The targets and sizes; how many copies each document gets is random and tested apart.
def digest(docs: DataFrame) -> DataFrame:
    return copies(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")

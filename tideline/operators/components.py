"""Connected components: forests of stretches, then of sampled neighbours, by alternating star contractions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.plans.shared import cut, partitions


#: A constant: so many edges does a task hold while it reduces them to a forest (a few hundred MB).
FOREST_EDGES = 1 << 21


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars with the same components: each node but the first of a component, and that one.

    Roots hook to their first neighbour and paths are halved to the root; roots halve in two rounds.
    """
    at, nodes = pd.factorize(np.concatenate([u, v]))
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(above := root[root], root):
            root = above
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    leaves = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[leaves], nodes[root[leaves]]


def spanning_forests(e: DataFrame) -> DataFrame:
    """Fewer edges u, v with the same components: forests of what a task reads, FOREST_EDGES at a time.

    A forest that is small is held and grows by the next edges, so a task ends with one forest where nodes recur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, schema = [], 0, None
        for batch in batches:
            schema = batch.schema
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            n += len(batch)
            if n >= FOREST_EDGES:
                held = [_forest(*map(np.concatenate, zip(*held)))]
                n = len(held[0][0])
                if 2 * n > FOREST_EDGES:
                    yield pa.record_batch([pa.array(x, f.type) for x, f in zip(held[0], schema)], schema)
                    held, n = [], 0
        if n:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(_forest(*map(np.concatenate, zip(*held))), schema)], schema)

    return e.mapInArrow(run, e.schema)


def _large(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to its smallest neighbour."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _contracted(e: DataFrame) -> DataFrame:
    """node, component of every node of the edges u, v, which are no loops; all are contracted in every round."""
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now[0] == 0 or (before is not None and tuple(now) == tuple(before)):
            break
        before = now
        e = cut(_small(_large(e)), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _sampled(e: DataFrame) -> DataFrame:
    """Edges of every node to its smallest and its largest neighbour."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    ends = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("w"))
    pairs = ends.select("u", "m").unionByName(ends.select("u", F.col("w").alias("m")))
    return pairs.select(F.greatest("u", "m").alias("u"), F.least("u", "m").alias("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (the smallest node reachable) of every node with an edge to another node.

    Tasks reduce what they read to forests. Where many edges are left, those to two neighbours of each node are
    contracted first, and of the rest only what links two of their components, which are half as many as nodes at
    most. Contraction makes stars around smaller nodes; its number of rounds grows with the logarithm of the
    diameter. Every round is written to the shared folder, so plans stay small and lost executors cost a round at
    most. Null ends and loops are ignored, repeated edges are harmless.
    """
    a, b = F.col(src), F.col(dst)
    e = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = cut(spanning_forests(e), "edges")
    some = cut(_sampled(e), "edges")
    if e.count() <= 2 * some.count():
        return _contracted(e)
    c = cut(_contracted(some), "components")
    ends = e.join(c.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u").select("cu", "v")
    ends = ends.join(c.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v").where("cu <> cv").select("cu", "cv")
    joined = connected_components(ends, "cu", "cv").select(F.col("node").alias("component"), F.col("component").alias("least"))
    return c.join(joined, "component", "left").select("node", F.coalesce("least", "component").alias("component"))


#: What the hashes of components and of single nodes begin with.
COMPONENT_PREFIX, ORPHAN_PREFIX = "event-component-v1\n", "orphan-market-v1\n"


def stable_ids(components: DataFrame) -> DataFrame:
    """component, component_id (hash of the sorted members), n_members.

    Members are a stream of sorted batches with the hash carried from batch to batch: a component's size does
    not matter for memory.
    """
    kind = components.schema["component"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, n, sha = None, 0, hashlib.sha256()
        for pdf in batches:
            keys, nodes, out = pdf["component"].to_numpy(), pdf["node"].to_numpy(), []
            ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for lo, hi in zip([0, *ends], [*ends, len(pdf)]):
                if lo == hi:
                    continue
                if at is None or at != (keys[lo],):
                    if at is not None:
                        out.append((*at, sha.hexdigest(), n))
                    at, n, sha = (keys[lo],), 0, hashlib.sha256(COMPONENT_PREFIX.encode())
                sha.update((("\n" if n else "") + "\n".join(nodes[lo:hi])).encode())
                n += int(hi - lo)
            if out:
                yield pd.DataFrame(out, columns=["component", "component_id", "n_members"])
        if at is not None:
            yield pd.DataFrame([(*at, sha.hexdigest(), n)], columns=["component", "component_id", "n_members"])

    rows = components.select("component", F.col("node").cast("string").alias("node"))
    ordered = rows.repartition(partitions(rows.sparkSession), "component").sortWithinPartitions("component", "node")
    return ordered.mapInPandas(run, f"component {kind}, component_id string, n_members bigint")


def orphan_id(node: str) -> Column:
    """The id of a node without links."""
    return F.sha2(F.concat(F.lit(ORPHAN_PREFIX), F.col(node).cast("string")), 256)

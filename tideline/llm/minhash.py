"""Near-duplicates by circulant MinHash, banding and exact verification.

Signatures: two permutations of a universe of 2**32 hashed shingles. The first, sigma, is applied once; the
k-th coordinate is the minimum over the set of pi(sigma(x) + k mod 2**32): pi circularly shifted by k. Both
are computed bijections, so no table of the universe is needed.

Equal sets are one class. Class representatives meet in BANDS buckets of ROWS coordinates; banding is
approximate: with independent coordinates, a pair with similarity 0.75 shares no bucket with probability 5e-6. Those of
a circulant are not independent; of 38,748 random pairs of sets of 60 to 1,000 shingles with similarities of 0.75 to
0.80, none shared no bucket. A bucket does
not emit its pairs: its members are first compared with a pivot, the one that shares most buckets with
others. Members linked to the same pivot need no links among each other. Only buckets that still hold
members of several such groups go on; there, every pair of different groups is compared inside the task
that holds the bucket: first by bounds that no link can break (sizes; the parities of the sets, whose
difference is at most that of the sets), then by the upper halves of their shingle hashes (with a slack of 2 + m / 500 +
m^2 / 2^30 halves that meet by chance, of which m^2 / 2^32 are expected: no bound, but far beyond chance), and one certain
link per row and group (or all possible ones) are emitted. So no link goes unchecked that a component could
depend on. All links are confirmed on whole sets of shingle hashes (64 bits; words by a separate hash).

A null or empty text, or one of white space, has an empty set and is linked with nothing. Rows that repeat
a doc_id are one document with all its texts' links (deduplicate() keeps the row with the smallest hash); a
null doc_id takes no part: its component is null and it is kept. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut, mark, mix, partitions, prefix_hash, settle, span_hash
from tideline.operators.components import connected_components

SHINGLE = 5
BANDS, ROWS = 32, 4
#: Rows of a bucket that meet in one piece of work; larger buckets are dealt as pairs of blocks.
BLOCK = 1024
CHUNK_BYTES = 1 << 20

_low = np.arange(256, dtype=np.uint8)
_low[65:91] += 32
_white = np.zeros(256, bool)
_white[[32, 9, 10, 11, 12, 13]] = True
_places = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def _pi(a: np.ndarray) -> np.ndarray:
    """In place: a bijection of 32-bit words; its last xor-shift is left out, since only order counts."""
    a ^= a >> np.uint32(16)
    a *= np.uint32(0x85EBCA6B)
    a ^= a >> np.uint32(13)
    a *= np.uint32(0xC2B2AE35)
    return a


def signature(shingles: np.ndarray, first: int = 0, count: int = BANDS * ROWS) -> np.ndarray:
    """uint32[count]: the coordinates of shifts first, first + 1, ... of a set of 64-bit shingle hashes."""
    sigma = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(first, first + count, dtype=np.uint32)[:, None]
    out = np.full(count, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(sigma), 1024):
        np.minimum(out, _pi(sigma[None, at : at + 1024] + shifts).min(1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """uint64[BANDS]: a hash of each band's number and coordinates."""
    wide, h = sig.astype(np.uint64).reshape(BANDS, ROWS), mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))
    for r in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + wide[:, r])
    return h


def _word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words [begin, end) of raw, about CHUNK_BYTES of it at a time: a long text needs no more."""
    out, i = [], 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + CHUNK_BYTES, side="right")))
        lo = begin[i]
        out.append(span_hash(prefix_hash(raw[lo : end[j - 1]]), begin[i:j] - lo, end[i:j] - lo))
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    raw = _low[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    white = np.concatenate([[True], _white[raw]])
    edges = np.flatnonzero(white[1:] != white[:-1])
    begin, end = edges[0::2], edges[1::2]
    words = _word_hashes(raw, begin, end)
    of = np.searchsorted(starts, begin, side="right") - 1
    grams = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        grams += words[j : j + len(grams)] * _places[j]
    grams = mix(grams)
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo >= SHINGLE:
            out.append(np.unique(grams[lo : hi - SHINGLE + 1]))
        elif hi > lo:
            out.append(mix(np.array([(words[lo:hi] * _places[: hi - lo]).sum() + np.uint64(hi - lo)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(first column, shingle sets) of pieces of about CHUNK_BYTES of text."""
    ids, texts, size = [], [], 0
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        raw = text.as_py().encode() if text.is_valid else b""
        ids.append(key)
        texts.append(raw)
        size += len(raw)
        if size >= CHUNK_BYTES:
            yield ids, shingle_sets(texts)
            ids, texts, size = [], [], 0
    if ids:
        yield ids, shingle_sets(texts)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), k1 and k2 (of the set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sets in _batches(batch):
                bands = [band_keys(signature(s)).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
                flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
                offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
                keys = np.array([_keys(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        *(pa.array(np.ascontiguousarray(keys[:, j])) for j in (0, 1)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    ],
                    names=["doc_id", "n", "k1", "k2", "bands"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>")


def _keys(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two hashes of a set."""
    return mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)))


def _parity_bits(n: int) -> int:
    """Twice to four times the size of the set, a power of two, whole 64-bit words."""
    return max(64, 1 << (2 * n - 1).bit_length())


def parities(s: np.ndarray) -> np.ndarray:
    """uint64[]: for each bit, whether an odd number of members have the bit's number as low bits. Two sets
    differ in as many members at least as their parities in bits."""
    bits = _parity_bits(len(s))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def full_sets(docs: DataFrame) -> DataFrame:
    """rep, k1, shingles, fine of docs(rep, text); fine has the parities and the sorted upper halves of the
    shingle hashes."""

    def pack(s: np.ndarray) -> bytes:
        return parities(s).tobytes() + np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sets in _batches(batch):
                k1 = np.array([_keys(s)[0] for s in sets], np.uint64).view(np.int64)
                columns = [pa.array(ids, pa.int64()), pa.array(k1), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(map(pack, sets), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["rep", "k1", "shingles", "fine"])

    return docs.select("rep", "text").mapInArrow(run, "rep bigint, k1 bigint, shingles array<bigint>, fine binary")


def _by_width(widths: np.ndarray, fine: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """bits -> rows and their parities: of that many bits, or of twice as many folded in two."""
    rows: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, f in enumerate(fine):
        bits = int(widths[i])
        p = np.frombuffer(f, np.uint64, bits // 64)
        rows.setdefault(bits, []).append((i, p))
        if bits > 64:
            rows.setdefault(bits // 2, []).append((i, p[: len(p) // 2] ^ p[len(p) // 2 :]))
    return {bits: (np.array([i for i, _ in r]), np.stack([p for _, p in r])) for bits, r in rows.items()}


def _not_ruled_out(x: int, n: np.ndarray, widths: np.ndarray, by_width: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The rows that can be linked with row x by size and parities; a link differs in (n + m) / 7 members at most."""
    out, own = [], int(widths[x])
    for bits in (own, own // 2):  # sizes of a link differ by a third at most: by one power of two
        if bits not in by_width:
            continue
        rows, parity = by_width[bits]
        mine, other = parity[np.searchsorted(rows, x)], widths[rows]
        y = (100 * np.minimum(n[rows], n[x]) >= 75 * np.maximum(n[rows], n[x])) & ((other >= own) if bits == own else (other == bits))
        y = np.flatnonzero(y)
        differ = np.bitwise_count(parity[y] ^ mine).sum(1, dtype=np.int64)
        out.append(rows[y[7 * differ <= n[rows[y]] + n[x]]])
    return np.unique(np.concatenate(out))


def _bucket_links(reps: np.ndarray, labels: np.ndarray, n: np.ndarray, own: np.ndarray, bands: np.ndarray, fine: list[bytes], band: int, apart: bool) -> list[tuple[int, int]]:
    """For each row of a bucket and each group that comes before its own (larger groups first): one row of
    that group that is certainly near by the upper halves, or else all that possibly are; of the rows whose
    first shared bucket this is."""
    widths = np.array([_parity_bits(int(m)) for m in n])
    by_width = _by_width(widths, fine)
    halves = [np.frombuffer(f, np.uint32, offset=int(w) // 8) for f, w in zip(fine, widths)]
    names, group, size = np.unique(labels, return_inverse=True, return_counts=True)
    place = np.empty(len(names), int)
    place[np.lexsort((names, -size))] = np.arange(len(names))
    place, out = place[group], []
    for x in np.flatnonzero(place > 0):
        y = _not_ruled_out(x, n, widths, by_width)
        y = y[place[y] < place[x]]
        if apart:  # pairs inside a block meet elsewhere
            y = y[own[y] != own[x]]
        y = y[(bands[y] == bands[x]).argmax(1) == band]
        if not len(y):
            continue
        theirs, mine = np.concatenate([halves[k] for k in y]), halves[x]
        hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        common = np.add.reduceat(hit, np.concatenate([[0], np.cumsum([len(halves[k]) for k in y])[:-1]]), dtype=np.int64)
        # halves may collide: certain links hold with some fewer in common, possible ones with some more
        m = np.minimum(n[y], n[x])
        slack = 2 + m // 500 + (m * m >> 30)
        certain, possible = (100 * c >= 75 * (n[y] + n[x] - c) for c in (common - slack, common + slack))
        sure = y[certain]
        sure = sure[np.unique(labels[sure], return_index=True)[1]]
        y = np.concatenate([sure, y[possible & ~np.isin(labels[y], labels[sure])]])
        out += [(min(reps[x], reps[k]), max(reps[x], reps[k])) for k in y]
    return out


def bucket_links(rows: DataFrame) -> DataFrame:
    """a, b: links to confirm between groups of rows(key, c, rep, label, band, n, bands, fine) that share a bucket.

    Comparison is done inside the task that holds a bucket (of at most BLOCK rows; larger ones are dealt as
    pairs of blocks), so no pairs are shuffled but links, mostly one per row and group.
    """
    own = F.pmod(F.xxhash64("rep"), F.ceil(F.col("c") / BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.col("c") / BLOCK).cast("int") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    rows = rows.select("key", "rep", "label", "band", "n", "bands", "fine", own.alias("own"), F.inline(blocks))

    def links_of(held: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(held)
        columns = (pdf[c].to_numpy() for c in ("rep", "label", "n", "own"))
        found = _bucket_links(*columns, np.stack(pdf["bands"].tolist()), pdf["fine"].tolist(), int(pdf["band"].iloc[0]), pdf["i"].iloc[0] != pdf["j"].iloc[0])
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket; one bucket at a time is held."""
        held, at = [], None
        for pdf in batches:
            keys = pdf[["key", "i", "j"]].to_numpy()
            ends = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for lo, hi in zip([0, *ends], [*ends, len(pdf)]):
                if held and at != tuple(keys[lo]):
                    yield links_of(held)
                    held = []
                at = tuple(keys[lo])
                held.append(pdf.iloc[lo:hi])
        if held:
            yield links_of(held)

    order = ["key", "i", "j"]
    return rows.repartition(partitions(rows.sparkSession), *order).sortWithinPartitions(*order, "rep").mapInPandas(run, "a bigint, b bigint").distinct()


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links."""
    x = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a")
    x = x.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return x.where(100 * common >= 75 * (F.size("x") + F.size("y") - common)).select("a", "b")


def _near_labels(links: DataFrame) -> DataFrame:
    """rep, label: a node of the same component, equal for most of those that share a pivot."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = both.groupBy("a").agg(F.least("a", F.min("b")).alias("l"))
    two = both.join(one.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("l").alias("l2"))
    return two.select(F.col("a").alias("rep"), F.col("l2").alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs(doc_id, text)."""
    spark, since = docs.sparkSession, mark()
    sketched = cut(sketches(docs), "minhash-sketches")
    live = sketched.where("n > 0 and doc_id is not null")
    # a class is named by its smallest doc_id; equal sets have equal bands
    classes = live.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = cut(classes, "minhash-classes")
    member = live.select("doc_id", "k1", "k2", "n").join(classes.select("k1", "k2", "n", "rep"), ["k1", "k2", "n"]).select("doc_id", "rep")

    rows = classes.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    buckets = rows.join(shared, "key")
    # the text that others derive from shares most buckets with them: it makes the best pivot
    degree = cut(buckets.groupBy("rep").agg(F.sum("c").alias("degree")), "minhash-degrees")
    buckets = cut(buckets.drop("c").join(degree, "rep"), "minhash-buckets")

    # one row per text of a candidate's class: any text of it has the set
    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text").join(degree, "rep", "left_semi")
    sets = full_sets(texts).join(classes.select("rep", "n", "k1", "bands"), ["rep", "k1"]).where(F.size("shingles") == F.col("n")).drop("n", "k1")
    sets = cut(sets, "minhash-sets")

    central = buckets.groupBy("key").agg(F.max(F.struct("degree", "rep", "n")).alias("p"))
    pairs = buckets.join(central, "key").where((F.col("rep") != F.col("p.rep")) & (100 * F.least("n", "p.n") >= 75 * F.greatest("n", "p.n")))
    pairs = cut(pairs.select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b")).distinct(), "minhash-pairs")
    links = cut(_confirm(pairs, sets), "minhash-links")

    # buckets that still hold several groups
    placed = buckets.join(_near_labels(links), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = placed.groupBy("key").agg(F.count("*").alias("c"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key", "c")
    rest = placed.join(mixed, "key").join(sets.select("rep", "bands", "fine"), "rep")
    found = cut(bucket_links(rest), "minhash-pairs")
    links = links.unionByName(cut(_confirm(found, sets), "minhash-links"))
    comp = connected_components(links, "a", "b")
    found = member.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    # rows that repeat a doc_id with other texts: the smallest component of any of them
    found = found.groupBy("doc_id").agg(F.min("component").alias("component"))
    out = sketched.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    return settle(since, out, "minhash-result")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay: one of each group, the columns of docs."""
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    row = F.xxhash64(*docs.columns).alias("_row")
    # of rows that repeat a doc_id, the one with the smallest hash; hashes, not texts, are shuffled for it
    chosen = docs.where("doc_id is not null").select("doc_id", row).groupBy("doc_id").agg(F.min("_row").alias("_row")).join(kept, "doc_id")
    one = docs.select("*", row).join(chosen, ["doc_id", "_row"], "left_semi").dropDuplicates(["doc_id"])
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))

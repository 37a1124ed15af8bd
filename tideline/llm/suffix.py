"""Removal of repeated passages by sorting suffixes of a positional difference cover.

What counts is whether the LEAST-byte prefixes of two suffixes are equal. COVER is a perfect difference set
modulo PERIOD: for any two places of the corpus there is a distance below PERIOD at which both are sampled
(place modulo PERIOD in COVER). So two equal windows of LEAST bytes meet in two sampled suffixes that share
GRAM = LEAST - PERIOD + 1 bytes, and one in seven suffixes is sampled instead of two in three (modulo 3).

1. Sort the sampled suffixes by triples of names: of GRAM bytes at the place, of the bytes of all windows
   through it before and behind. The first sort is by the middle name; a suffix without an equal neighbour
   there is finished: none of its windows repeats through it.
2. Recurse on the names where they tie: these suffixes are sorted by the whole triple. Equal neighbours: all
   windows of the later one repeat. First ones of a triple stay open if their gram has other triples. A
   window that two of these share reaches HALF bytes beyond the gram on one side at least, so only those
   are open whose HALF bytes before or behind are shared (short names; a collision costs work, no result).
   Triples cover LEAST bytes on both sides, so one recursion is all that prefixes of LEAST bytes need.
3. Merge the remaining suffixes in: every window around an open suffix that is not decided yet gets the name
   of its LEAST bytes (96 bits) and is sorted by it.
4. Compare adjacent prefixes: a window equal to its neighbour is a repeat unless it is the first. The bytes
   of repeated windows go; neighbouring windows join to spans.

Names are hashes: the sort order is the hashes' and not the alphabet's, which is as good here, since only
equal prefixes need to be neighbours. Tasks sort what they have in numpy, decide what repeats inside their
own share (so a passage found everywhere is sent once per piece of work, not once per occurrence), and deal
the rest to parts by name as packed arrays; a part is sorted by the task that gets it, and what it finds is
dealt in the same way by document. Step 1 runs in SHARES
by name, one after another, so the files of one share go before the next begins. Documents are taken in
segments of SEGMENT bytes.

Strings are judged on the input. Order is (doc_id, start). A null text is empty; texts under LEAST bytes
lose nothing. Rows with a null doc_id have no place in the order: they lose nothing and take nothing. Rows
that repeat a doc_id are judged one by one and, at the same place, none of them is earlier than the other.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut, mark, mix, partitions, prefix_hash, settle, span_hash

#: A perfect difference set (every difference modulo PERIOD comes up once).
PERIOD = 57
COVER = np.array([0, 1, 3, 13, 32, 36, 43, 52])
LEAST = 100
GRAM = LEAST - PERIOD + 1
HALF = (LEAST - GRAM) // 2
SHARES = 3
#: Bytes of a segment (whole periods), and rows that are sorted at once before they are dealt.
SEGMENT = PERIOD * 18_000
CHUNK_ROWS = 1 << 19
#: Rows of a part, about; a part is held by one task.
PART_ROWS = 2_000_000
WHOLE, LEFT, RIGHT = 0, 1, 2  # kinds; LEFT + RIGHT: either side


# --- packed rows --------------------------------------------------------------------------------


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """True where a run of equal values begins."""
    new = np.ones(len(sorted_columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return new


def _decided(name: np.ndarray, check: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """True for rows with an earlier row of the same name and check in these arrays."""
    out, n = np.zeros(len(name), bool), len(name)
    low = np.uint64((1 << max(1, n.bit_length())) - 1)
    tagged = np.sort((name & ~low) | np.arange(n, dtype=np.uint64))
    at, high = (tagged & low).astype(np.int64), tagged & ~low
    new = _starts(high)
    twice = at[~new | np.append(~new[1:], False)]  # few: the rows whose names may come up again
    if len(twice):
        o = twice[np.lexsort((place[twice], doc[twice], check[twice], name[twice]))]
        first = o[np.maximum.accumulate(np.where(_starts(name[o], check[o]), np.arange(len(o)), 0))]
        out[o] = (doc[o] != doc[first]) | (place[o] != place[first])
    return out


def _deal(part: np.ndarray, doc: np.ndarray, tag: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(part, packed rows); documents that follow each other are stored once."""
    order = np.argsort(part, kind="stable")
    part, doc, tag, columns = part[order], doc[order], tag[order], [c[order] for c in columns]
    edges = np.flatnonzero(_starts(part))
    for lo, hi in zip(edges, [*edges[1:], len(part)]):
        new = _starts(doc[lo:hi], tag[lo:hi])
        head = np.array([hi - lo, new.sum()], np.int64)
        runs = (np.cumsum(new) - 1).astype(np.int32)
        yield int(part[lo]), b"".join(x.tobytes() for x in (head, doc[lo:hi][new], tag[lo:hi][new], *(c[lo:hi] for c in columns), runs))


def _taken(blobs: list[bytes], kinds: tuple[str, ...]) -> list[np.ndarray]:
    """doc, tag and the columns of packed rows."""
    out: list[list[np.ndarray]] = []
    for blob in blobs:
        n, m = np.frombuffer(blob, np.int64, 2)
        doc, tag, at, row = np.frombuffer(blob, np.int64, m, 16), np.frombuffer(blob, np.int64, m, 16 + 8 * m), 16 + 16 * m, []
        for kind in kinds:
            row.append(np.frombuffer(blob, kind, n, at))
            at += row[-1].nbytes
        runs = np.frombuffer(blob, np.int32, n, at)
        out.append([doc[runs], tag[runs], *row])
    return [np.concatenate(x) for x in zip(*out)]


def _by_document(doc: np.ndarray, tag: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """doc, tag and the array of the distinct values of each."""
    o = np.lexsort((values, tag, doc))
    o = o[_starts(doc[o], tag[o], values[o])]
    doc, tag, values = doc[o], tag[o], values[o]
    edges = np.flatnonzero(_starts(doc, tag))
    lists = pa.ListArray.from_arrays(pa.array(np.append(edges, len(doc)).astype(np.int32)), pa.array(values))
    return pa.RecordBatch.from_arrays([pa.array(doc[edges]), pa.array(tag[edges]), lists], names=["doc", "tag", "found"])


DEALT = "part int, known boolean, packed binary"


def _rows(dealt: Iterator[tuple[int, bytes]], known: bool) -> pa.RecordBatch:
    rows = list(dealt)
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([known] * len(rows), pa.bool_()), pa.array([b for _, b in rows], pa.binary())], names=["part", "known", "packed"])


def _by_name(name: np.ndarray, parts: int, doc: np.ndarray, tag: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    part = ((name >> np.uint64(20)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.uint32)
    return _rows(_deal(part, doc, tag, columns), False)


def _known(parts: int, doc: np.ndarray, tag: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """What is known of documents, dealt by document."""
    o = np.lexsort((values, tag, doc))
    part = (mix(doc[o].astype(np.uint64)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.uint32)
    return _rows(_deal(part, doc[o], tag[o], [values[o].astype(np.int64)]), True)


def _sorted_parts(dealt: DataFrame, parts: int, f: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """Of every part, f of its packed rows (doc, tag, values) dealt by document; one part at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            known = batch.filter(batch.column(1))
            if known.num_rows:
                yield known
            batch = batch.filter(pa.compute.invert(batch.column(1)))
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(2)):
                if held and part != at:
                    yield _known(parts, *f(held))
                    held = []
                at = part
                held.append(packed.as_py())
        if held:
            yield _known(parts, *f(held))

    rows = dealt.repartition(max(parts, partitions(dealt.sparkSession)), "part").sortWithinPartitions("part")
    return rows.mapInArrow(run, DEALT)


def _collected(known: DataFrame, parts: int) -> DataFrame:
    """doc, tag, found: all that is known of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(2)):
                if held and part != at:
                    yield _by_document(*_taken(held, ("i8",)))
                    held = []
                at = part
                held.append(packed.as_py())
        if held:
            yield _by_document(*_taken(held, ("i8",)))

    rows = known.repartition(max(parts, partitions(known.sparkSession)), "part").sortWithinPartitions("part")
    return rows.mapInArrow(run, "doc bigint, tag bigint, found array<bigint>")


# --- steps --------------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    """doc, tag (23 bits of the text's hash: tells rows of a doc_id apart), text of the texts that can lose bytes."""
    docs = docs.where("doc_id is not null and text is not null").where(F.octet_length("text") >= LEAST)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.shiftrightunsigned(F.xxhash64("text"), 41).alias("tag"), "text")


def _segments(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """Lists of (doc, tag, length, place of the first byte, first and last place, bytes around) of about SEGMENT bytes."""
    held, size = [], 0
    for doc, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
        raw = np.frombuffer(text.as_buffer(), np.uint8)
        for a in range(0, len(raw), SEGMENT):
            lo = max(0, a - PERIOD + 1)
            piece = raw[lo : a + SEGMENT + LEAST]
            held.append((doc, tag, len(raw), lo, a, min(a + SEGMENT, len(raw)), piece))
            size += len(piece)
            if size >= SEGMENT:
                yield held
                held, size = [], 0
    if held:
        yield held


def _sampled(held: list[tuple]) -> tuple[np.ndarray, ...]:
    """gram, triple, sides, doc, tag, place of the sampled suffixes of some segments."""
    doc, tag, length, lo, a, b = (np.array(x, np.int64) for x in zip(*(h[:6] for h in held)))
    start = np.concatenate([[0], np.cumsum([len(h[6]) for h in held])[:-1]])
    c = prefix_hash(np.concatenate([h[6] for h in held]))
    periods = -(-(b - a) // PERIOD)
    of = np.repeat(np.arange(len(held)), periods)
    period = np.arange(len(of)) - np.repeat(np.cumsum(periods) - periods, periods)
    place = ((a[of] + PERIOD * period)[:, None] + COVER).ravel()
    of = np.repeat(of, len(COVER))
    fits = place + GRAM <= length[of]
    place, of = place[fits], of[fits]
    doc, tag, length, at = doc[of], tag[of], length[of], place - lo[of] + start[of]
    before, behind = np.minimum(place, PERIOD - 1), np.minimum(length - place, LEAST)
    gram = span_hash(c, at, at + GRAM)
    triple = mix(mix(span_hash(c, at - before, at) * np.uint64(3) + gram) * np.uint64(5) + span_hash(c, at + GRAM, at + behind))
    own = mix(place.astype(np.uint64) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # too close to an end: shared with none
    left = np.where(before >= HALF, span_hash(c, at - np.minimum(before, HALF), at), own)
    right = np.where(behind >= GRAM + HALF, span_hash(c, at + GRAM, at + np.minimum(behind, GRAM + HALF)), own)
    sides = ((left >> np.uint64(32)) & np.uint64(0xFFFF0000)) | (right >> np.uint64(48))
    return gram, triple, sides.astype(np.uint32), doc, tag, place


def triples(docs: DataFrame, share: int, parts: int) -> DataFrame:
    """The sampled suffixes whose gram is of the given share, dealt by gram to parts."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        gram, triple, sides, doc, tag, place = (np.concatenate(x) for x in zip(*held))
        known = _decided(triple, gram, doc, place)
        left = ~known
        yield _by_name(gram[left], parts, doc[left], tag[left], [x[left] for x in (gram, triple, sides, place.astype(np.int32))])
        yield _known(parts, doc[known], tag[known], place[known] * 4 + WHOLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for segments in _segments(batch):
                rows = _sampled(segments)
                mine = rows[0] % np.uint64(SHARES) == share
                held.append(tuple(x[mine] for x in rows))
                n += int(mine.sum())
                if n >= CHUNK_ROWS:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return docs.mapInArrow(run, DEALT)


def sort_triples(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, tag, value (4 * place + kind) of the suffixes that repeat or are open."""
    doc, tag, gram, triple, sides, place = _taken(blobs, ("u8", "u8", "u4", "i4"))
    o = np.argsort(gram)
    new = _starts(gram[o])
    o = o[~new | np.append(~new[1:], False)]  # names that tie
    o = o[np.lexsort((place[o], doc[o], triple[o], gram[o]))]
    doc, tag, gram, triple, sides, place = (x[o] for x in (doc, tag, gram, triple, sides, place))
    new = _starts(gram)
    own = _starts(gram, triple)
    first = np.maximum.accumulate(np.where(own, np.arange(len(own)), 0))
    repeats = (doc != doc[first]) | (place != place[first])
    group = np.cumsum(new) - 1
    open_ = np.flatnonzero(~repeats & (np.bincount(group, own)[group] > 1))
    kind = np.zeros(len(open_), np.int64)
    for side, bit in ((sides[open_] >> np.uint32(16), LEFT), (sides[open_] & np.uint32(0xFFFF), RIGHT)):
        _, which, n = np.unique((group[open_] << 16) | side.astype(np.int64), return_inverse=True, return_counts=True)
        kind += bit * (n[which] > 1)
    open_, kind = open_[kind > 0], kind[kind > 0]
    at = np.concatenate([np.flatnonzero(repeats), open_])
    return doc[at], tag[at], place[at].astype(np.int64) * 4 + np.concatenate([np.full(len(at) - len(open_), WHOLE), kind])


def _covered(begin: np.ndarray, end: np.ndarray, lo: int, n: int) -> np.ndarray:
    """Which of the n places from lo on lie in one of the spans [begin, end)."""
    b, e = np.clip(begin - lo, 0, n), np.clip(end - lo, 0, n)
    return np.cumsum(np.bincount(b, minlength=n + 1) - np.bincount(e, minlength=n + 1))[:n] > 0


def windows(candidates: DataFrame, parts: int) -> DataFrame:
    """The windows around open suffixes that are not decided yet, dealt by name to parts."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        name, check, doc, tag, place = (np.concatenate(x) for x in zip(*held))
        known = _decided(name, check, doc, place)
        left = ~known
        yield _by_name(name[left], parts, doc[left], tag[left], [x[left] for x in (name, check, place.astype(np.int32))])
        yield _known(parts, doc[known], tag[known], place[known])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for doc, tag, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                raw, s = np.frombuffer(text.as_buffer(), np.uint8), np.sort(found.values.to_numpy(zero_copy_only=False))
                s, kind = s >> 2, s & 3
                for lo in range(0, len(raw) - LEAST + 1, SEGMENT):
                    size = min(SEGMENT, len(raw) - LEAST + 1 - lo)
                    near = slice(*np.searchsorted(s, [lo, lo + size + PERIOD]))
                    p, k = s[near], kind[near]
                    if not (k > 0).any():
                        continue
                    # shared on the left only: the window begins HALF bytes or more before; on the right only: HALF or less
                    begin, end = np.where(k == RIGHT, p - HALF, p - PERIOD + 1), np.where(k == LEFT, p - HALF + 1, p + 1)
                    q = np.flatnonzero(_covered(begin[k > 0], end[k > 0], lo, size) & ~_covered(begin[k == 0], end[k == 0], lo, size))
                    if not len(q):
                        continue
                    c = prefix_hash(raw[lo : lo + size + LEAST])
                    check = (span_hash(c, q, q + LEAST // 2) >> np.uint64(32)).astype(np.uint32)
                    held.append((span_hash(c, q, q + LEAST), check, np.full(len(q), doc), np.full(len(q), tag), q + lo))
                    n += len(q)
                    if n >= CHUNK_ROWS:
                        yield from flush(held)
                        held, n = [], 0
        if n:
            yield from flush(held)

    return candidates.select("doc", "tag", "text", "found").mapInArrow(run, DEALT)


def compare_adjacent(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, tag, value (place) of the windows that are equal to an earlier one."""
    doc, tag, name, check, place = _taken(blobs, ("u8", "u4", "i4"))
    again = np.flatnonzero(_decided(name, check, doc, place))
    return doc[again], tag[again], place[again]


def _spans(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The union of spans [begin, end) as sorted rows (start, end) that do not touch."""
    o = np.argsort(begin)
    begin, reach = begin[o], np.maximum.accumulate(end[o])
    new = np.ones(len(o), bool)
    new[1:] = begin[1:] > reach[:-1]
    return np.stack([begin[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(o) - 1)]], 1)


def cleaned(docs: DataFrame) -> DataFrame:
    """doc, tag, spans (removed [start, end) in bytes), kept (the remaining bytes), sha256: of every text that loses bytes."""
    spark, since = docs.sparkSession, mark()
    keyed = _keyed(docs)
    n_bytes = keyed.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    rows = n_bytes * len(COVER) // PERIOD

    def parts(n: int) -> int:
        return max(partitions(spark), -(-n // PART_ROWS))

    marks = None
    for share in range(SHARES):
        n = parts(rows // SHARES)
        found = cut(_sorted_parts(triples(keyed, share, n), n, sort_triples), "suffix-triples")
        marks = found if marks is None else marks.unionByName(found)
    candidates = settle(since, keyed.join(_collected(marks, parts(rows)), ["doc", "tag"]), "suffix-candidates")
    n = parts(rows)  # at most as many windows as bytes; far fewer than sampled suffixes, as a rule
    repeats = cut(_sorted_parts(windows(candidates.where(F.exists("found", lambda x: x % 4 > 0)), n), n, compare_adjacent), "suffix-windows")
    repeats = _collected(repeats, n).withColumnRenamed("found", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, tag, text, found, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), batch.column(4)):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                p = found.values.to_numpy(zero_copy_only=False)
                p = p[p % 4 == WHOLE] // 4
                q = starts.values.to_numpy(zero_copy_only=False) if starts.is_valid else p[:0]
                if not len(p) + len(q):
                    continue
                # every window around a repeated suffix repeats
                begin = np.concatenate([np.maximum(p - PERIOD + 1, 0), q])
                spans = _spans(begin, np.concatenate([np.minimum(p + LEAST, len(raw)), q + LEAST]))
                left, kept = 0, []
                for lo, hi in spans:
                    kept.append(raw[left:lo])
                    left = hi
                kept = np.concatenate([*kept, raw[left:]]).tobytes()
                rows.append((doc, tag, spans.tolist(), kept, hashlib.sha256(kept).hexdigest()))
            if rows:
                types = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["doc", "tag", "spans", "kept", "sha256"])

    both = candidates.join(repeats, ["doc", "tag"], "left").select("doc", "tag", "text", "found", "starts")
    return both.mapInArrow(run, "doc bigint, tag bigint, spans array<array<bigint>>, kept binary, sha256 string")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs(doc_id, text)."""
    since, text = mark(), F.coalesce("text", F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.shiftrightunsigned(F.xxhash64("text"), 41).alias("tag"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.sha2(text, 256).alias("whole_sha256"),
    )
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x[1] - x[0])
    lost = cleaned(docs).select(F.col("doc").alias("doc_id"), "tag", removed.alias("r"), F.size("spans").cast("bigint").alias("k"), "sha256").distinct()
    out = base.join(lost, ["doc_id", "tag"], "left").select(
        "doc_id", "n_bytes", F.coalesce("r", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("k", F.lit(0)).cast("bigint").alias("n_spans"), F.coalesce("sha256", "whole_sha256").alias("kept_sha256")
    )
    return settle(since, out, "suffix-digest")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages removed (n_chars, if there, counted anew); the columns of docs.

    Characters of which only some bytes go are dropped.
    """
    columns = docs.columns
    lost = cleaned(docs).select(F.col("doc").alias("_doc"), F.col("tag").alias("_tag"), F.try_validate_utf8(F.col("kept").cast("string")).alias("_kept"), "kept").dropDuplicates(["_doc", "_tag"])

    @F.pandas_udf("string")
    def repaired(kept):
        return kept.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    lost = lost.withColumn("_kept", F.when(F.col("_kept").isNull(), repaired("kept")).otherwise(F.col("_kept"))).drop("kept")
    df = docs.withColumn("_t", F.shiftrightunsigned(F.xxhash64("text"), 41)).join(lost, (F.col("doc_id") == F.col("_doc")) & (F.col("_t") == F.col("_tag")), "left")
    new = {"text": F.coalesce("_kept", "text")}
    if "n_chars" in columns:
        new["n_chars"] = F.when(F.col("_kept").isNotNull(), F.char_length("_kept")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return df.withColumns(new).select(*columns)

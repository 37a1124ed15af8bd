import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from compare import DATA
from docs_fixture import empty_docs, odd_docs, odd_rows
from tideline.llm import packing, queries, token_counts, tokens, warc


@pytest.fixture(scope="module")
def reference_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def check_packing(rows, docs, ids_of, capacity=2048):
    want = Counter()
    for i, t in docs:
        ids = np.array([*ids_of(t), 0], "<u4")
        first = len(ids) % capacity or min(len(ids), capacity)
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in by.values():
        end = 0
        for at, n in sorted(s):
            assert at == end
            end += n
        assert end <= capacity
    return len(by)


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(bins) if r >= n]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_plan_equals_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for capacity in (7, 64, 100):
        for _ in range(20):
            lengths = rng.integers(1, capacity + 1, rng.integers(1, 200)).tolist()
            counts = Counter(lengths)
            p = packing.plan(dict(counts), capacity)
            room = defaultdict(lambda: capacity)
            for length, n in counts.items():
                mine = p[p["length"] == length].sort_values("first")
                for rank in range(n):
                    r = mine[mine["first"] <= rank].iloc[-1]
                    t = rank - r["first"]
                    b = r["bin"] + t // r["per_bin"]
                    assert r["base"] + t % r["per_bin"] * length + length <= capacity
                    room[b] -= length
            assert sorted(room.values()) == best_fit(lengths, capacity)


def test_packing(spark, reference_ids):
    rows = packing.pack(odd_docs(spark)).collect()
    check_packing(rows, [(r[0], r[1]) for r in odd_rows()], reference_ids)
    assert packing.pack(empty_docs(spark)).count() == 0
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op7_packing(spark, f"{DATA}/sf0.01").collect()
    n = check_packing(rows, docs, reference_ids)
    assert n <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1


def test_token_counts(spark, reference_ids):
    plain = tokens.encoder(special=False)
    for block in (7, 1000, token_counts.BLOCK):
        got = Counter(map(tuple, token_counts.counts(odd_docs(spark), block=block).collect()))
        assert got == Counter((r[0], len(plain(r[1] or ""))) for r in odd_rows())
    assert token_counts.counts(empty_docs(spark)).count() == 0
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op5_token_counts(spark, f"{DATA}/sf0.001").collect()} == {i: len(reference_ids(t)) for i, t in docs}


def test_ids_on_random_strings(reference_ids):
    """Both forms of the vocabulary give the same ids on text of many scripts, spaces and symbols."""
    rng = random.Random(1)
    pool = [chr(i) for lo, hi in ((0x20, 0x250), (0x300, 0x370), (0x600, 0x700), (0x900, 0x980), (0x4E00, 0x4F00), (0xAC00, 0xAD00), (0x1F300, 0x1F700), (0x2000, 0x2070), (0x2460, 0x2500)) for i in range(lo, hi)]
    encode, special = tokens.encoder(), ["<|endoftext|>", "\r\n", "\u00a0", "\u3000", "\x85", "\x1c", "\x00", "'s", "  ", "\t", "123"]
    for k in range(3000):
        text = "".join(rng.choice(special if rng.random() < 0.3 else pool if k % 2 else "ab cd12.,'") for _ in range(rng.randint(0, 50)))
        assert list(encode(text)) == reference_ids(text)


def pages(spark):
    page = "<html>" + "body " * 50
    rows = [(5, "http://b.example.com/x?q=1#f", page), (3, "https://www.example.com:443/a", page), (9, "http://example.com/a", page), (9, "http://example.com/a", page), (11, None, None), (12, "", ""), (13, "http://u:p@EXAMPLE.org", "é\r\n\r\nWARC/1.1"),
            (None, "http://n.example.com/", page), (14, "http://tab.example.com/\t\n", "z" * 300_000), (15, "http://example.com/a", "other")]
    rows += [(100 + i, "http://hot.example.com/", f"page {i % 7}") for i in range(200)]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id bigint, url string, html string, `key` int, kind string"), rows


def test_warc_round_trip(spark):
    df, rows = pages(spark)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[digest(h)] = min(first.get(digest(h), i), i)
    want = Counter()
    for i, _, h in rows:
        f = first.get(digest(h))
        revisit = f is not None and f != i
        want[i, len((h or "").encode()), digest(h), "revisit" if revisit else "response", f if revisit else None] += 1
    got = warc.round_trip(df).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all(r["html"] in {h or "" for i, _, h in rows if i == r["page_id"]} for r in got if r["record_type"] == "response")
    assert warc.round_trip(df.limit(0)).count() == 0
    all_responses = warc.round_trip(df, least=10**9).collect()
    assert {r["record_type"] for r in all_responses} == {"response"}


def test_lookup_of_single_keys(spark):
    df, rows = pages(spark)
    folder = warc.new_folder(spark, "warc")
    archives = warc.cut(warc.write(df, folder, block_lines=3))
    keys = spark.createDataFrame([("com,example)/a",), ("com,example,hot)/",), ("com,nowhere)/",)], "key string")
    got = Counter(r["page_id"] for r in warc.lookup(spark, archives, keys, folder).collect())
    assert got == Counter([3, 9, 9, 15] + [100 + i for i in range(200)])


def test_tabs_and_newlines_inside_urls(spark):
    rows = [(i, f"http://e.com/a{c}{x}", f"page {i}") for i, (c, x) in enumerate((c, x) for c in ("\t", "\n", " ", "!", "%09", "%0A", "b") for x in "zam")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    n = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for k in ("1", "7"):  # all in one block, and several archives
            spark.conf.set("spark.sql.shuffle.partitions", k)
            assert sorted((r["page_id"], r["html"]) for r in warc.round_trip(df).collect()) == [(i, h) for i, _, h in rows]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)


def test_missing_records_fail(spark):
    df, _ = pages(spark)
    folder = warc.new_folder(spark, "warc")
    archives = warc.cut(warc.write(df, folder))
    keys = spark.createDataFrame([("com,example)/a",)], "key string")
    assert warc.lookup(spark, archives, keys, folder).count() == 4
    with pytest.raises(Exception, match="records were read"):
        warc.lookup(spark, archives, keys, folder, whole=True).count()


def members(data):
    """The gzip members of an archive."""
    while data:
        d = zlib.decompressobj(31)
        yield d.decompress(data) + d.flush()
        data = d.unused_data


def records(folder, name):
    """A reader of its own: fields by lower-case name, and the block, of each record, as the standard says."""
    with open(f"{folder.removeprefix('file://')}/{name}.warc.gz", "rb") as f:
        for raw in members(f.read()):
            head, block = raw.split(b"\r\n\r\n", 1)
            version, *lines = head.decode("utf-8").split("\r\n")
            assert version == "WARC/1.1" and all(re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+: .*", x) for x in lines)
            fields = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
            n = int(fields["content-length"])
            assert block[n:] == b"\r\n\r\n" and len(block) == n + 4
            assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["warc-record-id"]) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["warc-date"])
            yield fields, block[:n]


def test_archives_are_valid(spark):
    df, rows = pages(spark)
    folder = warc.new_folder(spark, "warc")
    names = [r["name"] for r in warc.cut(warc.write(df, folder)).collect()]
    every, ids = [], Counter()
    for name in names:
        mine = list(records(folder, name))
        assert mine[0][0]["warc-type"] == "warcinfo" and mine[0][0]["warc-filename"] == f"{name}.warc.gz"
        ids.update(f["warc-record-id"] for f, _ in mine)
        every += mine[1:]
    assert len(every) == len(rows) and set(ids.values()) == {1}
    responses = {f["warc-record-id"]: f for f, _ in every if f["warc-type"] == "response"}
    got = Counter()
    for f, block in every:
        http, payload = block.split(b"\r\n\r\n", 1)
        status, *lines = http.decode().split("\r\n")
        assert status == "HTTP/1.1 200 OK" and f["content-type"] == "application/http; msgtype=response" and re.fullmatch(r"[a-z]+:[!-~]+", f["warc-target-uri"])
        if f["warc-type"] == "response":
            assert f["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
            assert f"Content-Length: {len(payload)}" in lines
            got[f.get("x-page-id")] += 1
        else:
            assert f["warc-type"] == "revisit" and payload == b"" and f["warc-profile"] == "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
            of = responses[f["warc-refers-to"]]
            assert of["warc-payload-digest"] == f["warc-payload-digest"] and of["warc-target-uri"] == f["warc-refers-to-target-uri"] and of["x-page-id"] == f["x-refers-to-page-id"]
    assert got["3"] == 1 and got["9"] == 0 and got["14"] == 1 and got["13"] == 1


def test_blocks_and_archives_are_bounded_in_bytes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"http://e.com/{i:03}", rng.bytes(600_000).hex()) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    folder = warc.new_folder(spark, "warc")
    archives = warc.cut(warc.write(df, folder, archive_bytes=6 << 20))
    names = [r["name"] for r in archives.collect()]
    assert len(names) >= 4
    for name in names:
        held = warc.Captures(folder, name)
        assert all(size <= warc.BLOCK_BYTES + 700_000 for *_, size in held.directory)
        held.close()
    keys = df.selectExpr("concat('com,e)/', substr(url, -3)) as key")
    got = warc.lookup(spark, archives, keys, folder, whole=True)
    assert {(r["page_id"], r["html"]) for r in got.collect()} == {(i, h) for i, _, h in rows}


def test_query_covers_all_pages(spark):
    got = queries.op10_warc(spark, f"{DATA}/sf0.01").collect()
    want = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").collect()}
    digest, first = {i: base64.b32encode(hashlib.sha1(h).digest()).decode() for i, h in want.items()}, {}
    for i in sorted(want):
        first.setdefault(digest[i], i)
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == {
        i: (len(h), digest[i], *(("response", None) if first[digest[i]] == i else ("revisit", first[digest[i]]))) for i, h in want.items()
    }
    assert len(got) == len(want)

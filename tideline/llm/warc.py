"""WARC archives with a two-level capture index.

Archives follow WARC 1.1: a warcinfo record, then response and revisit records (HTTP messages) in the order
of their reversed-host URL keys, one gzip member per record; a new archive begins when one has reached
ARCHIVE_BYTES. Index: the sorted capture lines of an archive in compressed blocks (first level; at most
BLOCK_LINES lines or BLOCK_BYTES of records each) and a sparse directory with one entry per block (second
level); a directory entry has the block's first key, its place in the index file and the range of its
records in the archive. A lookup bisects the list of archives by first key, bisects the directory,
range-reads one block, bisects its lines and range-reads the records that match.

Records whose payloads (of at least `least` bytes) are equal: the one with the smallest page_id is the
response, the others revisit it. Equal means equal SHA-1 and equal length. A null html is an empty payload;
a null or empty url has the empty key and a urn as target. Rows that repeat the smallest page_id of their payload are responses too; a
null page_id sorts last (and its record carries none). Extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import cut, new_folder, partitions

BLOCK_LINES, BLOCK_BYTES = 1000, 4 << 20
ARCHIVE_BYTES = 1 << 30
READ_BYTES = 1 << 18
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TYPE_RESPONSE, TYPE_REVISIT = "response", "revisit"


def surt(url: str | None) -> str:
    """Reversed-host key: scheme, user, www, port and fragment go; the host's labels turn round.

    Tabs and newlines, which separate the fields and lines of the index, are escaped here, so that sort,
    marks, index and lookup order the same keys.
    """
    if not url:
        return ""
    rest = url.strip().split("#", 1)[0]
    rest = rest.split("://", 1)[-1]
    cut_at = min((i for i in (rest.find(c) for c in "/?") if i >= 0), default=len(rest))
    host, path = rest[:cut_at].rsplit("@", 1)[-1].lower(), rest[cut_at:] or "/"
    host = host.split(":", 1)[0]
    host = host[4:] if host.startswith("www.") else host
    return (",".join(reversed(host.split("."))) + ")" + path).replace("\t", "%09").replace("\n", "%0A")


def described(pages: DataFrame) -> DataFrame:
    """page_id, url, html, key, payload_digest, payload_bytes."""

    @F.pandas_udf("struct<key:string,digest:string>")
    def describe(url: pd.Series, html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "key": [surt(u) for u in url],
                "digest": [base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for h in html],
            }
        )

    df = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").withColumn("d", describe("url", "html"))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("bigint")
    return df.select("page_id", "url", "html", "d.key", F.col("d.digest").alias("payload_digest"), size.alias("payload_bytes"))


def revisits(rows: DataFrame, least: int = 0) -> DataFrame:
    """key, page_id, payload_digest and refers_to, refers_key, refers_url (of the response) of the records
    that repeat a payload; no html is shuffled for it."""
    narrow = rows.where(F.col("payload_bytes") >= least).select("key", "page_id", "url", "payload_digest", "payload_bytes")
    payload = ["payload_digest", "payload_bytes"]
    least_page = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "key", "url"))).alias("r")
    first = narrow.groupBy(*payload).agg(least_page, F.count("*").alias("n")).where("n > 1 and r is not null")
    repeats = narrow.drop("url").join(first.select(*payload, *(F.col(f"r.{a}").alias(f"refers_{b}") for a, b in (("page_id", "to"), ("key", "key"), ("url", "url")))), payload)
    return repeats.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("key", "page_id", "payload_digest", "refers_to", "refers_key", "refers_url").distinct()


def record_id(page_id: int | None, key: str, digest: str, ordinal: int = 0) -> str:
    """Rows that are equal in page, key and payload are told apart by their ordinal."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((page_id, key, digest, ordinal)))}>"


def target_uri(url: str | None, page_id: int | None) -> str:
    """The url with what no URI may hold escaped; a urn where there is none."""
    url = (url or "").strip()
    if not url:
        return f"urn:page:{'' if page_id is None else page_id}"
    if "://" not in url.split("?", 1)[0]:
        url = "http://" + url
    return urllib.parse.quote(url, safe="%:/?#[]@!$&'()*+,;=-._~")


def _fields(*pairs: tuple[str, str]) -> bytes:
    return "".join(f"{name}: {value}\r\n" for name, value in pairs).encode() + b"\r\n"


def _record(kind: str, ident: str, date: str, fields: list[tuple[str, str]], content_type: str, block: bytes) -> bytes:
    head = _fields(("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", date), *fields, ("Content-Type", content_type), ("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + head + block + b"\r\n\r\n"


def _capture(page: int | None, key: str, url: str | None, digest: str, size: int, ordinal: int, payload: bytes, refers: tuple[int, str, str] | None, date: str) -> bytes:
    """A response, or a revisit of the record of (page, key, url) `refers`, whose block is the HTTP head alone."""
    head = b"HTTP/1.1 200 OK\r\n" + _fields(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size)))
    fields = [("WARC-Target-URI", target_uri(url, page)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page is not None:
        fields.append(("X-Page-ID", str(page)))
    if refers:
        to, to_key, to_url = refers
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(to, to_key, digest)), ("WARC-Refers-To-Target-URI", target_uri(to_url, to)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-ID", str(to))]
    kind = TYPE_REVISIT if refers else TYPE_RESPONSE
    return _record(kind, record_id(page, key, digest, ordinal), date, fields, "application/http; msgtype=response", head if refers else head + payload)


def _headers(head: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record headers, HTTP headers and payload of one capture."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _headers(head)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, _headers(http), payload


def _pack(raw: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


class _Archive:
    """One archive with its two index files, being written."""

    def __init__(self, store, root: str, date: str, block_lines: int) -> None:
        self.name, self.block_lines, self.store, self.path = uuid.uuid4().hex, block_lines, store, root
        self.archive = store.open_output_stream(f"{root}/{self.name}.warc.gz", compression=None)
        self.index = store.open_output_stream(f"{root}/{self.name}.idx")
        info = _fields(("software", "tideline"), ("format", "WARC File Format 1.1"))
        head = _pack(_record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", date, [("WARC-Filename", f"{self.name}.warc.gz")], "application/warc-fields", info))
        self.archive.write(head)
        self.at = self.block_at = len(head)
        self.index_at = self.n = 0
        self.lines: list[str] = []
        self.directory: list[list] = []
        self.first_key: str | None = None
        self.last_key: str | None = None

    def add(self, key: str, page: int | None, packed: bytes) -> None:
        self.archive.write(packed)
        self.lines.append(f"{key}\t{'' if page is None else page}\t{self.at}\t{len(packed)}")
        self.at, self.n = self.at + len(packed), self.n + 1
        self.first_key, self.last_key = key if self.first_key is None else self.first_key, key
        if len(self.lines) >= self.block_lines or self.at - self.block_at >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        packed = zlib.compress("\n".join(self.lines).encode(), LEVEL)
        self.index.write(packed)
        self.directory.append([self.lines[0].split("\t", 1)[0], self.index_at, len(packed), self.block_at, self.at - self.block_at])
        self.index_at, self.lines, self.block_at = self.index_at + len(packed), [], self.at

    def close(self) -> pd.DataFrame:
        if self.lines:
            self._close_block()
        self.archive.close()
        self.index.close()
        with self.store.open_output_stream(f"{self.path}/{self.name}.dir") as f:
            f.write(zlib.compress(json.dumps(self.directory).encode(), LEVEL))
        return pd.DataFrame({"name": [self.name], "first_key": [self.first_key], "last_key": [self.last_key], "n_records": [self.n]})


def write(pages: DataFrame, folder: str, least: int = 0, block_lines: int = BLOCK_LINES, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> DataFrame:
    """Writes archives and index files; one row per archive: name, first_key, last_key, n_records.

    date: the time of capture of all pages, now if not given. A retried task writes other archives: cut()
    the result; what its rows don't name doesn't count.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out: _Archive | None = None
        marked, same, ordinal = None, None, 0
        for pdf in batches:
            for key, page, url, html, digest, size, *refers in pdf.itertuples(index=False, name=None):
                page = None if pd.isna(page) else int(page)  # ids come as text: nulls would make them floats
                if not pd.isna(refers[0]):  # announces the records of this key, page and payload, which follow
                    marked = (key, page, digest), (int(refers[0]), refers[1], refers[2])
                    continue
                ordinal = ordinal + 1 if same == (key, page, digest) else 0
                same = (key, page, digest)
                of = marked[1] if marked and marked[0] == same else None
                out = out or _Archive(store, root, date, block_lines)
                out.add(key, page, _pack(_capture(page, key, url, digest, size, ordinal, b"" if of else (html or "").encode(), of, date)))
                if out.at >= archive_bytes:
                    yield out.close()
                    out = None
        if out:
            yield out.close()

    # one shuffle moves the html: what repeats is found on narrow rows and announced by a row before the records
    rows = described(pages)
    none = {c: F.lit(None).cast("string") for c in ("url", "html")}
    marks = revisits(rows, least).withColumns(none | {"payload_bytes": F.lit(0).cast("bigint"), "kind": F.lit(0)})
    none = {"refers_to": F.lit(None).cast("bigint"), "refers_key": F.lit(None).cast("string"), "refers_url": F.lit(None).cast("string")}
    both = rows.withColumns(none | {"kind": F.lit(1)}).unionByName(marks)
    n = partitions(both.sparkSession)
    ordered = both.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id", "payload_digest", "kind")
    ids = {c: F.col(c).cast("string") for c in ("page_id", "refers_to")}
    return ordered.withColumns(ids).select("key", "page_id", "url", "html", "payload_digest", "payload_bytes", "refers_to", "refers_key", "refers_url").mapInPandas(run, "name string, first_key string, last_key string, n_records bigint")


class Captures:
    """One archive with its index, opened for lookups."""

    def __init__(self, folder: str, name: str) -> None:
        from pyarrow import fs

        self.store, root = fs.FileSystem.from_uri(folder)
        self.path = f"{root}/{name}"
        with self.store.open_input_stream(f"{self.path}.dir") as f:
            self.directory = json.loads(zlib.decompress(f.read()))
        self.first_keys = [x[0] for x in self.directory]
        self.index = self.store.open_input_file(f"{self.path}.idx")
        self.archive = self.store.open_input_file(f"{self.path}.warc.gz")
        self.block: tuple[int, list[list[str]]] = (-1, [])
        self.ahead: tuple[int, bytes] = (0, b"")

    def _load(self, b: int) -> list[list[str]]:
        if self.block[0] != b:
            _, at, size, _, _ = self.directory[b]
            self.block = (b, [x.split("\t") for x in zlib.decompress(self.index.read_at(size, at)).decode().split("\n")])
        return self.block[1]

    def _read(self, at: int, size: int, end: int) -> bytes:
        """A record; up to READ_BYTES of the block's next ones are read with it."""
        begin, held = self.ahead
        if not begin <= at or at + size > begin + len(held):
            begin, held = self.ahead = at, self.archive.read_at(max(size, min(READ_BYTES, end - at)), at)
        return held[at - begin : at - begin + size]

    def find(self, key: str) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
        """The records of a key, by bisection of directory and block."""
        b = max(0, bisect.bisect_left(self.first_keys, key) - 1)
        while b < len(self.directory) and self.first_keys[b] <= key:
            lines, (_, _, _, begin, size) = self._load(b), self.directory[b]
            for line in lines[bisect.bisect_left(lines, key, key=lambda x: x[0]) :]:
                if line[0] != key:
                    break
                yield parse(zlib.decompress(self._read(int(line[2]), int(line[3]), begin + size), 31))
            b += 1

    def close(self) -> None:
        self.index.close()
        self.archive.close()


ROW = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def lookup(spark: SparkSession, archives: DataFrame, keys: DataFrame, folder: str, whole: bool = False) -> DataFrame:
    """The captures of every distinct key in keys(key): ROW's columns and html (null for revisits).

    With `whole`, keys names every record: an archive that gives more or fewer than its n_records fails.

    The list of archives has one entry per write task, so it is small whatever the number of captures. A
    key goes to each archive whose range holds it; each task reads the keys of one archive in order.
    """
    shards = sorted(tuple(r) for r in archives.select("first_key", "last_key", "name", "n_records").collect())
    firsts, lasts, names, written = ([x[i] for x in shards] for i in range(4))

    @F.pandas_udf("array<int>")
    def shard(key: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))) for k in key])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: tuple[int, Captures | None] = (-1, None)
        n_read = 0

        def finish() -> None:
            if open_[1]:
                open_[1].close()
                if whole and n_read != written[open_[0]]:
                    raise ValueError(f"archive {names[open_[0]]}: {n_read} of {written[open_[0]]} records were read")

        for pdf in batches:
            out, size = [], 0
            for i, key in zip(pdf["shard"], pdf["key"]):
                if open_[0] != i:
                    finish()
                    open_, n_read = (i, Captures(folder, names[i])), 0
                for head, http, body in open_[1].find(key) if isinstance(key, str) else ():
                    n_read += 1
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = head["WARC-Type"] == TYPE_REVISIT
                    if not revisit and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                        raise ValueError(f"payload of {head['WARC-Record-ID']} does not have its digest")
                    page = head.get("X-Page-ID")
                    out.append((int(page) if page else None, int(http["Content-Length"]), digest, head["WARC-Type"], int(head["X-Refers-To-Page-ID"]) if revisit else None, None if revisit else body.decode()))
                    size += len(body)
                    if size > 1 << 23:
                        yield _frame(out)
                        out, size = [], 0
            if out:
                yield _frame(out)
        finish()

    clean = F.regexp_replace(F.regexp_replace("key", "\t", "%09"), "\n", "%0A")
    wanted = keys.select(clean.alias("key")).distinct().withColumn("shard", F.explode(shard("key")))
    if whole:  # a row without a key opens each archive, so that one of which nothing is asked fails too
        wanted = wanted.unionByName(spark.range(len(shards)).select(F.lit(None).cast("string").alias("key"), F.col("id").cast("int").alias("shard")))
    # the keys of a shard are as many as its records at most: one write task's worth
    wanted = wanted.repartition(max(1, len(shards)), "shard").sortWithinPartitions("shard", "key")
    return wanted.mapInPandas(run, ROW + ", html string")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])
    return df.astype({"page_id": "Int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives all pages and reads every capture back through the index."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    archives = cut(write(pages, folder, least), "warc-archives")

    @F.pandas_udf("string")
    def key(url: pd.Series) -> pd.Series:
        return url.map(lambda u: surt(None if pd.isna(u) else u))

    return lookup(spark, archives, pages.select(key("url").alias("key")), folder, whole=True)

"""WARC archives of web pages, read back into capture histories.

Every page becomes a WARC 1.1 record. Of the pages with equal payloads of at least ``REVISIT_BYTES`` bytes, the one with the
largest id is written as a response and the others as revisits of it. A record is one gzip member, so a reader can begin at the place
that the index gives; an archive is closed when it has ``ARCHIVE_BYTES`` compressed bytes. Tasks write archives under
names of their own in a folder that all executors share (any that ``pyarrow.fs`` opens) and report them in a
table; only reported archives are read, so a task that runs twice leaves no record twice.

Each archive is sorted by URL key and time, and its index is a sorted run. Runs are dealt by ranges of (URL key, time,
id) and merged there by a loser tree. A range does not load its runs: they come in chunks, in the order of the
chunks' first keys, and a record leaves the tree as soon as no chunk to come can hold a lesser key; so memory holds
the chunks that are open and not the range. The partitions of the result are in global order: the captures
of a URL stand together, in the order of time. The id in the range key spreads a URL or host that a third of all
pages share.

Defined results: null html is an empty payload; a null URL is recorded as ``urn:page:<id>``; of equal payloads whose ids are
all null each is a response, and a null id beside others is a revisit; repeated rows with one id are all
responses. Ids may be integers or strings (without line ends). Payloads of any length are written and read one at a time. Other columns are
ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_path, table, text_or_empty

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
#: Records of a chunk of a run, and chunks that come in before the tree is built anew.
CHUNK, CHUNKS = 256, 64
#: Pages carry no time; captures are dated a second apart from here, by id.
FIRST_CAPTURE = 1577836800
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id {key}, url_key string, captured string, record_type string, payload_bytes long, payload_digest string, refers_to {key}, archive string, at long"
#: Where a record stands in its run: its place, and the key of its chunk's first record.
PLACES = "place long, first_url string, first_captured string, first_id {key}"
NAMES = [x.split()[0] for x in INDEX.split(", ")]
ORDER = ["url_key", "captured", "page_id"]
FIRST = ["first_url", "first_captured", "first_id"]


def url_key(url: Column) -> Column:
    """Host labels reversed, then path and query; scheme, user, port, fragment and a leading www. are left out."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    labels = F.reverse(F.split(F.regexp_replace(host, r"^www\.", ""), r"\."))
    return F.when(host == "", url).otherwise(F.concat(F.array_join(labels, ","), F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest)))


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(url_key, captured, page_id, head, block): a record's header lines and its block, in bytes."""
    body = text_or_empty(html)
    target = F.coalesce(F.regexp_replace(F.col(url), r"[\x00-\x20\x7f]", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    rows = pages.select(F.col(key).alias("_id"), target.alias("_url"), body.alias("_body")).select(
        "*", F.octet_length("_body").cast("long").alias("_bytes"), F.sha1(F.col("_body").cast("binary")).alias("_digest")
    )
    shared = (
        rows.filter(F.col("_bytes") >= REVISIT_BYTES).groupBy(F.col("_digest").alias("d"), F.col("_bytes").alias("b"))
        .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("n")).filter("n > 1 and _keep is not null").drop("n")
    )
    shared = materialise(shared, "payloads")
    rows = rows.join(shared, (F.col("_digest") == F.col("d")) & (F.col("_bytes") == F.col("b")), "left")
    again = F.col("_keep").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_keep"))
    number = F.expr("coalesce(try_cast(_id as long), crc32(cast(_id as string)), 0)")
    rows = rows.withColumn("_again", again).withColumn("captured", F.date_format(F.timestamp_seconds(FIRST_CAPTURE + F.pmod(number, F.lit(1_000_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("_bytes").cast("string"), F.lit(END * 2))
    block = F.when(F.col("_again"), http).otherwise(F.concat(http, F.col("_body")))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lines = [
        (F.lit("WARC/1.1"),),
        (F.lit("WARC-Type: "), F.when(F.col("_again"), F.lit("revisit")).otherwise(F.lit("response"))),
        (F.lit("WARC-Record-ID: <urn:page:"), text("_id"), F.lit(">")),
        (F.lit("WARC-Date: "), F.col("captured")),
        (F.lit("WARC-Target-URI: "), F.col("_url")),
        (F.lit("WARC-Payload-Digest: sha1:"), F.col("_digest")),
        (F.lit("WARC-Payload-Length: "), F.col("_bytes").cast("string")),
        (F.lit("WARC-URL-Key: "), url_key(F.col("_url"))),
        (F.lit("Content-Type: application/http; msgtype=response"),),
        (F.lit("Content-Length: "), F.octet_length("_block").cast("string")),
    ]
    of_revisits = F.concat(F.lit(f"WARC-Profile: {PROFILE}{END}WARC-Refers-To: <urn:page:"), text("_keep"), F.lit(f">{END}"))
    head = F.concat(*(c for line in lines for c in (*line, F.lit(END))), F.when(F.col("_again"), of_revisits).otherwise(F.lit("")), F.lit(END))
    rows = rows.withColumn("_block", block)
    return rows.select(url_key(F.col("_url")).alias("url_key"), "captured", F.col("_id").alias("page_id"), head.cast("binary").alias("head"), F.col("_block").cast("binary").alias("block"))


def filesystem(path: str):
    """(file system, path in it) of a folder's address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if ":/" in path else (fs.LocalFileSystem(), path)


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write_archives(pages: DataFrame, out: str, key: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes gzipped WARC files, each sorted by URL key and time; (archive, records, bytes) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = filesystem(out)
        own, number, to, path, done = uuid.uuid4().hex, 0, None, "", []

        def close() -> None:
            done.append((path, count, to.tell()))
            to.close()

        for batch in batches:
            for head, block in zip(batch.column(0), batch.column(1)):
                if to is None:
                    path, count = f"{own}-{number:05}.warc.gz", 0
                    to = files.open_output_stream(f"{folder}/{path}", compression=None)
                    number += 1
                to.write(member(b"".join((head.as_buffer(), block.as_buffer(), b"\r\n\r\n"))))
                count += 1
                if to.tell() >= archive_bytes:
                    close()
                    to = None
        if to is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    files, folder = filesystem(out)
    files.create_dir(folder, recursive=True)
    sorted_ = records(pages, key, url, html).sortWithinPartitions(*ORDER).select("head", "block")
    return materialise(sorted_.mapInArrow(run, "archive string, records long, bytes long"), "archives")


def members(stream, read: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(place, content) of each gzip member of a stream; one member is held at a time."""
    at, data = 0, b""
    while True:
        place, unpack, parts = at, zlib.decompressobj(31), []
        while not unpack.eof:
            data = data or stream.read(read)
            if not data:
                if parts or at > place:
                    raise ValueError(f"the member at byte {place} has no end")
                return
            parts.append(unpack.decompress(data))
            at += len(data) - len(unpack.unused_data)
            data = unpack.unused_data
        yield place, b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record; its length comes from Content-Length, never from what a payload looks like."""
    end = data.index(b"\r\n\r\n")
    first, *lines = data[:end].decode("utf-8", "surrogatepass").split(END)
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(headers["Content-Length"])
    if not first.startswith("WARC/") or data[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("no whole WARC record")
    return headers, data[end + 4 : end + 4 + size]


_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}


def _types(key_type: str) -> list[pa.DataType]:
    kind = _KINDS.get(key_type, pa.string())
    return [kind, pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), kind, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), kind]


def read_index(archives: DataFrame, out: str, key_type: str = "bigint") -> DataFrame:
    """A row of ``INDEX`` and ``PLACES`` for each record of the archives; digests and sizes of responses are those of the payload as read."""
    to_id = (lambda s: int(s) if s else None) if key_type in _KINDS else (lambda s: s or None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = filesystem(out)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _types(key_type))], [*NAMES, "place", *FIRST])

        for name in (n for b in batches for n in b.column(0).to_pylist()):
            with files.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                for place, (at, data) in enumerate(members(stream)):
                    h, block = parse(data)
                    digest, size, refers = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["WARC-Payload-Length"]), None
                    if h["WARC-Type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, size):
                            raise ValueError(f"{name}, byte {at}: the payload does not match its digest")
                    else:
                        refers = to_id(h["WARC-Refers-To"][10:-1])
                    page = to_id(h["WARC-Record-ID"][10:-1])
                    if place % CHUNK == 0:
                        first = (h["WARC-URL-Key"], h["WARC-Date"], page)
                    rows.append((page, h["WARC-URL-Key"], h["WARC-Date"], h["WARC-Type"], size, digest, refers, name, at, place, *first))
                    if len(rows) >= 2000:
                        yield batch()
                        rows.clear()
        if rows:
            yield batch()

    # an archive is a task's work, or a few are
    return archives.select("archive").repartition("archive").mapInArrow(run, f"{INDEX}, {PLACES}".format(key=key_type))


class LoserTree:
    """Merges sorted runs: the inner nodes hold the losers of their matches, so a new head meets one rival on each level."""

    def __init__(self, runs: list):
        self.runs = [deque(r) for r in runs]
        self.k = max(1, len(runs))
        self.losers = [-1] * self.k
        for run in range(len(runs)):
            self._play(run)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.runs[a], self.runs[b]
        return bool(x) and (not y or (x[0], a) < (y[0], b))

    def _play(self, run: int) -> None:
        node = (run + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other == -1:  # still being built: wait here for the rival
                self.losers[node] = run
                return
            if self._beats(other, run):
                self.losers[node], run = run, other
            node //= 2
        self.losers[0] = run

    def head(self):
        """The least head of all runs; None when they are empty."""
        run = self.runs[self.losers[0]] if self.runs else None
        return run[0] if run else None

    def pop(self):
        winner = run = self.losers[0]
        out = self.runs[winner].popleft()
        node = (run + self.k) // 2
        while node > 0:
            if self._beats(self.losers[node], run):
                self.losers[node], run = run, self.losers[node]
            node //= 2
        self.losers[0] = run
        return out

    def __iter__(self):
        while self.head() is not None:
            yield self.pop()


def forecast_merge(chunks: Iterator[tuple[object, object, list]], at_once: int = CHUNKS) -> Iterator:
    """Items of sorted runs in global order, from chunks (run, first key, items) in the order of their first keys. Items compare; a chunk's items are not less than its first key."""
    held: dict[object, deque] = {}
    ahead = next(chunks, None)
    while ahead is not None:
        for _ in range(at_once):
            run, _, items = ahead
            held.setdefault(run, deque()).extend(items)
            if (ahead := next(chunks, None)) is None:
                break
        tree = LoserTree(list(held.values()))
        while (head := tree.head()) is not None and (ahead is None or head[0] < ahead[1]):
            yield tree.pop()
        held = {name: left for name, left in zip(held, tree.runs) if left}


def merge_runs(index: DataFrame) -> DataFrame:
    """The index in global order of (url_key, captured, page_id), without the records' places in their runs."""
    dealt = index.repartitionByRange(*ORDER).sortWithinPartitions(*FIRST, "archive", "place")
    schema = index.select(*NAMES).schema
    places = [index.columns.index(c) for c in (*NAMES, "place", *FIRST)]
    types = _types(schema["page_id"].dataType.simpleString())[: len(NAMES)]
    sort_key = lambda url, time, page: (url, time, page is not None, page if page is not None else 0)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, items, key = None, [], None
        for batch in batches:
            for row in zip(*(batch.column(p).to_pylist() for p in places)):
                of = (row[7], row[-4] // CHUNK)
                if of != last and items:
                    yield last[0], key, items
                    items = []
                if not items:
                    last, key = of, sort_key(*row[-3:])
                items.append((sort_key(row[1], row[2], row[0]), row[7], row[-4], row[: len(NAMES)]))
        if items:
            yield last[0], key, items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for item in forecast_merge(chunks(batches)):
            out.append(item[-1])
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], NAMES)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], NAMES)

    return dealt.mapInArrow(run, schema)


def capture_histories(pages: DataFrame, out: str, key: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives to ``out``, reads them back, and merges their runs."""
    archives = write_archives(pages, out, key, url, html, archive_bytes)
    index = materialise(read_index(archives, out, pages.schema[key].dataType.simpleString()), "index")
    return merge_runs(index)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = capture_histories(table(spark, sf_dir, "pages"), shared_path(spark, "archives"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


OP10_SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, 'urn:page:' || page_id) AS url, encode(coalesce(html, '')) AS b, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
     q AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS keep FROM p),
     k AS (SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1)) AS host,
                  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS rest FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest,
       CASE WHEN n >= {REVISIT_BYTES} AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {REVISIT_BYTES} AND page_id <> keep THEN keep END AS refers_to,
       CASE WHEN host = '' THEN url ELSE array_to_string(list_reverse(string_split(regexp_replace(host, '^www\\.', ''), '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END END AS url_key,
       strftime(to_timestamp({FIRST_CAPTURE} + page_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM k
"""

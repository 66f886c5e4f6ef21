"""Web archives of pages, and an index of their captures merged from sorted runs."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmill.session import shared_folder, stage

FILE_BYTES = 16 << 20  # of an archive file before compression, about
RANGE_ROWS = 100_000  # captures merged in one task, about
HEAD_ROWS = 64  # one capture in so many of a run tells where ranges begin
CHUNK = 16 << 10  # bytes of an archive inflated at a time
EPOCH = 1704067200  # capture time where a page has none: this second plus its page_id
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value: the digits of base 32
_CAPTURE = (
    "urlkey string, timestamp string, run string, offset bigint, length bigint, page_id bigint, url string, "
    "record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"
)
ORDER = ["urlkey", "timestamp", "run", "offset"]
_PIECE = f"span int, run string, place bigint, captures array<struct<{_CAPTURE.replace(' string', ': string').replace(' bigint', ': bigint')}>>"


def base32(hex_digest: Column) -> Column:
    """Upper-case base 32 of 40 hexadecimal digits: five of them are four digits of base 32."""
    fives = [F.lpad(F.conv(F.substring(hex_digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _ALPHABET)


def with_revisits(pages: DataFrame, files: int, least: int = 0) -> DataFrame:
    """``page_id, url, html, size, digest, refers_to``: the last is null for responses.

    Of rows with equal payloads of at least ``least`` bytes those with the
    smallest page_id are responses and the others revisits of it.
    """
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(
        "page_id", "url", body.alias("html"), F.octet_length(body).cast("bigint").alias("size"), F.sha1(body.cast("binary")).alias("digest"))
    facts = rows.select("page_id", "size", "digest").where(F.col("size") >= least)
    first = facts.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("latest"))
    later = (
        facts.join(first.where("first < latest").drop("latest"), "digest").where("page_id > first")
        .select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to")).distinct()
    )
    dealt = rows.repartition(files, "page_id", "digest")
    return dealt.join(later, F.expr("page_id = _page and digest = _digest"), "left").drop("_page", "_digest")


def record(captured: Column) -> Column:
    """A WARC record as text."""
    url = F.coalesce("url", F.lit(""))
    for code in (*range(33), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    name = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "url", "digest"))
    parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    digest = F.concat(F.lit("sha1:"), base32(F.col("digest")))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    size = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:uuid:"), F.concat_ws("-", *parts), F.lit(">\r\nWARC-Date: "),
        F.date_format(F.timestamp_seconds(captured), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("\r\n"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n"))).otherwise(F.lit("")),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("X-Page-ID: "), F.col("page_id"), F.lit("\r\n"))).otherwise(F.lit("")),
        F.when(revisit, F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nX-Refers-To-Page-ID: "),
            F.col("refers_to"), F.lit("\r\n"))).otherwise(F.lit("")),
        F.lit("WARC-Payload-Digest: "), digest,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), size, F.lit("\r\n\r\n"),
        http, body, F.lit("\r\n\r\n"))


def member(data: bytes) -> bytes:
    """A gzip member of its own."""
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as a gzip member without its last byte, a zero, which the writer adds as its line separator.

    A member ends in the high byte of its size, which is zero below 16 MB; after
    a longer record an empty member follows, which ends in one too.
    """
    for batch in batches:
        out = []
        for text in batch.column(0):
            data = member(text.as_py().encode())
            out.append((data if data[-1] == 0 else data + member(b""))[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["data"])


def write_archives(pages: DataFrame, least: int = 0, captured: Column | None = None) -> str:
    """Write compressed WARC files to a new shared folder, through Spark's own writer, and return its path.

    Each record is a gzip member of its own, so a reader can start at any one.
    ``pages`` has ``page_id, url, html``, other columns are not used; null html
    is an empty payload, null url and page_id leave out their headers, control
    characters and blanks in urls are escaped. Files hold about ``FILE_BYTES``.
    """
    spark = pages.sparkSession
    total = pages.agg(F.sum(F.octet_length("html") + 600)).first()[0] or 0
    rows = with_revisits(pages, max(1, math.ceil(total / FILE_BYTES)), least)
    when = F.lit(EPOCH) + F.coalesce("page_id", F.lit(0)) if captured is None else captured
    path = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    packed = rows.select(record(when).alias("record")).mapInArrow(_members, "data binary")
    packed.select(F.col("data").cast("string")).write.option("lineSep", "\0").text(path)
    return path


def url_key(url: str) -> str:
    """Host labels in reverse order, then path and query, without scheme, fragment and leading www."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url.split("#", 1)[0])
    host, slash, path = rest.partition("/")
    host = host.lower().removeprefix("www.").partition(":")[0]
    return ",".join(reversed(host.split("."))) + ")" + slash + path


def read_members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member; empty ones are passed over."""
    view, at = memoryview(data), 0
    while at < len(data):
        inflate, parts, end = zlib.decompressobj(31), [], at
        while not inflate.eof:
            chunk = view[end: end + CHUNK]
            if not chunk:
                raise ValueError(f"member at byte {at} has no end")
            parts.append(inflate.decompress(chunk))
            end += len(chunk)
        end -= len(inflate.unused_data)
        content = b"".join(parts)
        if content:
            yield at, end - at, content
        at = end


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; the block goes by its length, whatever it holds."""
    head = data.find(b"\r\n\r\n")
    lines = data[:max(head, 0)].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record here")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    end = head + 4 + int(headers["Content-Length"])
    if data[end:] != b"\r\n\r\n":
        raise ValueError("the record does not end as it says")
    return headers, data[head + 4: end]


def capture(headers: dict[str, str], block: bytes) -> tuple:
    """Key, time and facts of a record, after a look whether a response's payload is what the headers say."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and (
            len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("the payload is not what its headers say")
    page, first = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
    url = headers.get("WARC-Target-URI")
    return (
        url_key(url or ""), re.sub(r"\D", "", headers["WARC-Date"]),
        (int(page) if page else None, url, headers["WARC-Type"], size, digest, int(first) if first else None))


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The captures of each file, sorted: a run."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows = []
            run = path.rsplit("/", 1)[-1]
            for offset, length, data in read_members(content.as_buffer()):
                try:
                    key, when, facts = capture(*read_record(data))
                except ValueError as e:
                    raise ValueError(f"{path}, byte {offset}: {e}") from e
                rows.append((key, when, run, offset, length, *facts))
            rows.sort(key=lambda r: r[:4])
            yield _batch(rows).append_column("place", pa.array(range(len(rows)), pa.int64()))


def _cut_at(bounds: list[tuple]):
    """Cuts runs at common keys; a piece is what one run has in one range, or a part of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ORDER)))
            spans = [bisect_right(bounds, k) for k in keys]
            starts = [i for i, k in enumerate(keys) if not i or spans[i] != spans[i - 1] or k[2] != keys[i - 1][2]]
            captures = batch.select([c.split()[0] for c in _CAPTURE.split(", ")])
            yield pa.RecordBatch.from_arrays([
                pa.array([spans[i] for i in starts], pa.int32()), pa.array([keys[i][2] for i in starts], pa.string()),
                batch.column("place").take(pa.array(starts, pa.int64())),
                pa.ListArray.from_arrays(pa.array([*starts, len(keys)], pa.int32()), captures.to_struct_array()),
            ], names=["span", "run", "place", "captures"])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if kind == "bigint" else pa.string() for kind in (c.split()[1] for c in _CAPTURE.split(", "))]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in _CAPTURE.split(", ")])


def merge_runs(runs: list[Iterable[tuple]], width: int = 4) -> Iterator[tuple]:
    """Rows of sorted runs in the order of their first ``width`` values, by a tree of losers.

    Each inner node keeps the run that lost there; the run that leaves the root
    is refilled and plays again on its way up only. One row of each run is held.
    """
    k = len(runs)
    if not k:
        return
    rest = [iter(run) for run in runs]
    heads = [next(run, None) for run in rest]
    done = (1,)
    keys = [done if head is None else (0, *head[:width]) for head in heads]
    losers = [-1] * k

    def replay(run: int) -> int:
        node = (run + k) // 2
        while node > 0:
            if losers[node] < 0:
                losers[node] = run
                return -1  # waits here for the run from the other side
            if keys[losers[node]] < keys[run]:
                losers[node], run = run, losers[node]
            node //= 2
        return run

    winner = 0
    if k > 1:
        for run in range(k):
            top = replay(run)
            winner = top if top >= 0 else winner
    while keys[winner] != done:
        yield heads[winner]
        heads[winner] = head = next(rest[winner], None)
        keys[winner] = done if head is None else (0, *head[:width])
        if k > 1:
            winner = replay(winner)


def _rows(pieces: list[pa.StructArray], size: int = 1024) -> Iterator[tuple]:
    """The captures of a run's pieces one after the other; only a slice of them is out of its Arrow buffers."""
    for piece in pieces:
        for at in range(0, len(piece), size):
            yield from zip(*(column.to_pylist() for column in piece.slice(at, size).flatten()))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the pieces of each range, which come in the order of range, run and place."""
    span, runs = None, {}

    def merged() -> Iterator[pa.RecordBatch]:
        rows = []
        for row in merge_runs([_rows(pieces) for pieces in runs.values()]):
            rows.append(row)
            if len(rows) == 4096:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    for batch in batches:
        for now, run, captures in zip(batch.column("span").to_pylist(), batch.column("run").to_pylist(), batch.column("captures")):
            if now != span:
                yield from merged()
                span, runs = now, {}
            runs.setdefault(run, []).append(captures.values)
    yield from merged()


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The captures of the archives in a folder in the order of url key, time, file and offset.

    Each file gives a sorted run, written once. Common keys over the whole order
    cut the runs, so that a url with very many captures is cut too; what each
    run has in a range stays in its order, is read as an iterator, and a tree
    of losers merges the iterators: captures are sorted in their file only.
    ``offset`` and ``length`` are those of the capture's gzip member in its
    file. Payloads with equal SHA-1 count as equal. Partitions follow each other
    in the order; a folder without records gives an empty table.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    spark.conf.set(key, "1")  # a file at a time
    try:
        runs = stage(files.mapInArrow(_captures, f"{_CAPTURE}, place bigint"), "capture-runs")
    finally:
        spark.conf.set(key, before)
    ranges = max(1, math.ceil(runs.count() / RANGE_ROWS))
    bounds: list[tuple] = []
    if ranges > 1:
        heads = runs.where(F.col("place") % HEAD_ROWS == 0).select(*ORDER).repartitionByRange(ranges, *ORDER)
        firsts = heads.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*ORDER)).alias("key")).collect()
        bounds = sorted(tuple(row["key"]) for row in firsts)[1:]
    pieces = runs.mapInArrow(_cut_at(bounds), _PIECE).repartitionByRange(ranges, "span")
    return pieces.sortWithinPartitions("span", "run", "place").mapInArrow(_merge, _CAPTURE)

"""WARC archives: written record by record in gzip members, and read back in byte ranges.

Reading is splittable although gzip isn't: every record is a gzip member of its own. A task gets a range of bytes, looks
for gzip's magic number, and takes a place for a record only if what it decodes to begins as a WARC header, ends as the
header says and has the right checksum. It owns the records that start inside its range, and reads over the range's end
to finish the last of them. Ranges are rows of a table that Spark deals out; bytes pass through a task in pieces.

Files are reached through ``pyarrow.fs`` (local or mounted folders, HDFS, S3, GCS), as Spark has neither a sink for
bytes nor a source of byte ranges. A writing task gives its files names of its own, and says in its rows what it wrote:
files of attempts that failed are in no such row, so nobody reads them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseframe.llm.common import columns, handing_back, materialize, new_path, small_batches

#: Fixed values of the two formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http;msgtype=response"
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")
_END = b"\r\n\r\n"
#: Bytes after which a task begins another file; bytes of a range; bytes read at once, and decoded at once; ranges dealt out singly.
FILE_BYTES, RANGE_BYTES, READ_BYTES, FEED_BYTES, MOST_TASKS = 1 << 30, 64 << 20, 1 << 20, 1 << 16, 100_000
#: Longest HTTP header; a block that has more before an empty line has none.
HTTP_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
_MANIFEST = columns(path="string", bytes="long", n_records="long")
_RECORD = columns(path="string", offset="long", end="long", record_type="string", record_id="string", target_uri="string", refers_to="string", payload_digest="string", payload_bytes="long")


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI as Spark writes it, and the path in it."""
    uri = re.sub(r"^file:/+", "/", uri)
    uri = re.sub(r"^s3[an]:", "s3:", uri)
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri else (pyarrow.fs.LocalFileSystem(), uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_line(name: str, value: str) -> str:
    """A header line; control characters, which would end it, are written as in URLs."""
    return f"{name}: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(record_type: str, record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None = None, date: str = DATE) -> list[bytes]:
    """A record's bytes, in pieces: header, HTTP header, payload (a revisit has none), end."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = [] if record_type == "revisit" else [payload]
    lines = [VERSION.decode(), f"WARC-Type: {record_type}", header_line("WARC-Record-ID", f"<{record_id}>"), f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(header_line("WARC-Target-URI", uri))
    if record_type == "revisit":
        lines += [f"WARC-Profile: {SAME_PAYLOAD}", header_line("WARC-Refers-To", f"<{refers_to}>")]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"Content-Type: {HTTP}", f"Content-Length: {len(http) + sum(map(len, body))}"]
    return ["\r\n".join(lines).encode() + _END, http, *body, _END]


def member(parts: list[bytes], level: int = 6) -> bytes:
    """One gzip member. Deflate keeps what it can't shorten as it is, so a payload that holds gzip members would show them:
    the magic number is broken by a block's end wherever it occurs, and no reader finds a record inside a record."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = []
    for part in parts:
        begin = 0
        while (at := part.find(MAGIC, begin)) >= 0:
            out += [z.compress(part[begin : at + 1]), z.flush(zlib.Z_FULL_FLUSH)]
            begin = at + 1
        out.append(z.compress(part[begin:] if begin else part))
    return b"".join([*out, z.flush()])


def with_revisits(df: DataFrame, id_col: str, payload: Column) -> DataFrame:
    """The table with ``__first``: null, or of the rows with an equal payload the smallest identifier, if it isn't the row's own.

    Payloads are compared by SHA-256. Only groups of two rows or more take part in the join, one row a group, so Spark sends
    them to the rows where they are few, and can split a hot group's rows where they are many.
    """
    key = F.unhex(F.sha2(payload, 256))
    firsts = df.select(F.col(f"`{id_col}`").alias("__first"), key.alias("__sha")).groupBy("__sha").agg(F.min("__first").alias("__first"), F.count("*").alias("__n"))
    met = df.withColumn("__sha", key).join(firsts.where("__n > 1").drop("__n"), "__sha", "left")
    return met.withColumn("__first", F.when(~F.col("__first").eqNullSafe(F.col(f"`{id_col}`")), F.col("__first"))).drop("__sha")


def write_warc(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", prefix: str = "urn:page:", file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Writes a record for each row to files in ``folder``, which executors share; one row a file: path, bytes, n_records.

    Of rows with equal payloads the one with the smallest identifier is written as ``response`` with the payload, others as
    ``revisit`` that refer to it. The rows are written to the shared folder before they are returned, so each file is
    written once by whoever reads them.

    Defined cases: a null payload is empty, and empty payloads are equal payloads; null identifiers come last, and where no
    row of a group has an identifier all are responses; rows that repeat the smallest identifier are responses too; a null
    URL has no line, control characters in one are percent-encoded; other columns are not read; an empty table has no files.
    """
    spark = df.sparkSession
    small_batches(spark)
    text = df.schema[payload_col].dataType == T.StringType()
    rows = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{url_col}`").alias("__url"), F.col(f"`{payload_col}`").alias("__payload"))
    raw = F.col("__payload").cast("binary") if text else F.col("__payload")
    rows = rows.withColumn("__payload", F.coalesce(raw, F.lit(b"")))
    met = with_revisits(rows, "__id", F.col("__payload")).select(F.col("__id").cast("string"), F.col("__first").cast("string"), "__url", "__payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(folder)
        out = name = None
        size = n = 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=_MANIFEST.fieldNames())

        for b in batches:
            for one, first, url, payload in zip(*(c for c in b.columns), strict=True):
                payload, one, first = payload.as_py(), one.as_py(), first.as_py()
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                kind = "response" if first is None else "revisit"
                made = member(record(kind, f"{prefix}{'' if one is None else one}", url.as_py(), payload, payload_digest(payload), None if first is None else prefix + first, date))
                out.write(made)
                size, n = size + len(made), n + 1
                if size >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return materialize(met.mapInArrow(handing_back(run), _MANIFEST), "warc-files")


class Source:
    """A file's bytes, read in pieces that later calls share."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.at, self.held = file, 0, b""

    def piece(self, at: int, least: int = 1) -> tuple[bytes, int]:
        """Some bytes, and where ``at`` is in them, with ``least`` bytes from there on unless the file ends."""
        if not (self.at <= at and at + least <= self.at + len(self.held)):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(READ_BYTES)
        return self.held, at - self.at

    def find(self, what: bytes, at: int) -> int | None:
        while True:
            held, i = self.piece(at, len(what))
            if len(held) - i < len(what):
                return None
            found = held.find(what, i)
            if found >= 0:
                return self.at + found
            at = self.at + len(held) - len(what) + 1


def decoded(source: Source, at: int, keep: bool) -> tuple[int, dict[str, str], bytes, str, int] | None:
    """The member that starts at ``at``: its end, header lines, payload (if kept), the payload's digest and size; None if
    there is no whole and sound record. What isn't kept passes through, so a record of any size takes little memory."""
    z, sha = zlib.decompressobj(31), hashlib.sha1()
    head, http, kept = b"", b"", []
    lines: dict[str, str] | None = None
    in_http = False
    fed = left = size = 0
    while not z.eof:
        feed = z.unconsumed_tail
        if not feed:
            held, i = source.piece(at + fed)
            feed = held[i : i + FEED_BYTES]
            fed += len(feed)
            if not feed:
                return None  # the file ends in the middle of it
        try:
            got = z.decompress(feed, READ_BYTES)
        except zlib.error:
            return None
        if lines is None:
            head += got
            if head[:7] != VERSION[:7][: len(head)]:
                return None
            first, end, got = head.partition(_END)
            if not end:
                continue
            length = _LENGTH.search(first)
            if not length:
                return None
            left, lines = int(length[1]), parsed(first)
            in_http = lines.get("content-type", "").startswith("application/http")
        block, after = got[:left], got[left:]
        left -= len(block)
        if after.strip(b"\r\n"):
            return None  # longer than it says
        if in_http:
            http += block
            block = b""
            if _END in http:
                http, _, block = http.partition(_END)
                in_http = False
            elif len(http) > HTTP_BYTES:
                http, block, in_http = b"", http, False
        sha.update(block)
        size += len(block)
        if keep:
            kept.append(block)
    if lines is None or left:
        return None
    lines["http"] = http.decode("latin-1")
    return at + fed - len(z.unused_data), lines, b"".join(kept), base64.b32encode(sha.digest()).decode(), size


def parsed(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name."""
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def records(file: pa.NativeFile, start: int, stop: int, keep: bool) -> Iterator[tuple[int, int, dict[str, str], bytes, str, int]]:
    """The records that start in [start, stop), however their members lie."""
    source, at = Source(file), start
    while (at := source.find(MAGIC, at)) is not None and at < stop:
        found = decoded(source, at, keep)
        if found is not None:
            yield at, *found
        at = found[0] if found else at + 1


def read_warc(spark: SparkSession, files: DataFrame | str, payloads: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row for each record: path, offset, end, record_type, record_id, target_uri, refers_to, payload_digest (SHA-1, base32),
    payload_bytes, and ``payload`` unless it isn't wanted.

    files: (path, bytes), or a folder of archives. Of a response, digest and size are those of the payload that was read, and a
    member whose payload doesn't fit its own digest is no record. Of a revisit, they are what its headers say of the payload
    that it refers to. Other kinds of records come with the digest and size of their block. Bytes that aren't a whole record are
    passed over. Archives of other writers may hold records inside records' stored bytes: see ``without_nested``.
    """
    if isinstance(files, str):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(files).select("path", F.col("length").alias("bytes"))
    small_batches(spark)
    ranges = files.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartition(max(1, min(ranges.count(), MOST_TASKS)))  # a range to a task, about
    out = T.StructType([*_RECORD, *([T.StructField("payload", T.BinaryType())] if payloads else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, at = opened(path)
                held, room = [], 0
                with fs.open_input_file(at) as file:
                    for begin, end, lines, payload, digest, size in records(file, start, start + range_bytes, payloads):
                        row = _row(path, begin, end, lines, payload, digest, size)
                        if row is None:
                            continue
                        held.append(row if payloads else row[:-1])
                        room += len(payload)
                        if room > READ_BYTES or len(held) >= 1000:
                            yield _batch(held, out)
                            held, room = [], 0
                if held:
                    yield _batch(held, out)

    return ranges.mapInArrow(handing_back(run), out)


def _row(path: str, begin: int, end: int, lines: dict[str, str], payload: bytes, digest: str, size: int) -> tuple | None:
    kind = lines.get("warc-type", "")
    said = lines.get("warc-payload-digest", "").removeprefix("sha1:")
    bare = lambda name: lines[name].strip("<>") if name in lines else None
    if kind == "revisit":
        length = _LENGTH.search(lines["http"].encode("latin-1"))
        digest, size, payload = said or None, int(length[1]) if length else None, None
    elif said and said != digest and kind == "response":
        return None
    return path, begin, end, kind, bare("warc-record-id"), lines.get("warc-target-uri"), bare("warc-refers-to"), digest, size, payload


def _batch(rows: list[tuple], out: T.StructType) -> pa.RecordBatch:
    kinds = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType]) for c, f in zip(zip(*rows, strict=True), out, strict=True)], names=out.fieldNames())


def without_nested(found: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records without those that lie inside another record's bytes, which a task that begins in the middle of it may take for
    records: a range's records count from where the last record of the ranges before it ends."""
    index = materialize(found.select("path", F.floor(F.col("offset") / range_bytes).alias("range"), "offset", "end"), "warc-index")
    last = index.groupBy("path", "range").agg(F.max("end").alias("last"))
    w = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a file
    least = last.select("path", "range", F.max("last").over(w).alias("least"))
    return found.withColumn("range", F.floor(F.col("offset") / range_bytes)).join(least, ["path", "range"]).where("least IS NULL OR offset >= least").drop("range", "least")


def archive(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", payloads: bool = False) -> DataFrame:
    """The rows written to archives in the shared folder, and the records read back from them."""
    spark = df.sparkSession
    files = write_warc(df, new_path(spark, "warc"), id_col, url_col, payload_col)
    return read_warc(spark, files, payloads)

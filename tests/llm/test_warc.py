"""WARC archives: whole round trips at any size of ranges, and what isn't a record."""

import base64
import gzip
import hashlib
import random

import pytest

from clauseframe.llm import queries, warc

SCHEMA = "page_id long, url string, html string, path string, offset long, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "y") for i, u, h in rows], SCHEMA)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        one = first.get(h or "")
        payload = (h or "").encode()
        out.append((f"urn:page:{'' if i is None else i}", "response" if one is None or one == i else "revisit", None if one is None or one == i else f"urn:page:{one}", digest(payload), len(payload)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.record_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes) for r in df.collect()), key=str)


RNG = random.Random(4)
ROWS = [
    (1, "http://a.b/c?d", "<p>é</p>"), (2, None, "<p>é</p>"), (-3, "x\r\nWARC-Type: bad", "<p>é</p>"), (4, "", None), (5, "u", ""), (None, None, None), (None, "n", "alone"), (None, "m", "alone"),
    (6, "u" * 200_000, "long " * 200_000), (7, "u", "".join(chr(RNG.randrange(32, 0x2FFF)) for _ in range(15_000))), (8, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"), (9, "r", "again"), (9, "r", "again"), (10, "r", "again"),
]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc"))
    return warc.write_warc(pages(spark, ROWS).repartition(3), folder, file_bytes=300), folder


@pytest.mark.parametrize("size", [1_999, 1 << 26])
def test_records_come_back_whole(spark, written, size):
    files, folder = written
    assert sum(r.n_records for r in files.collect()) == len(ROWS) and files.count() > 3
    got = warc.read_warc(spark, files, range_bytes=size)
    assert rows_of(got) == plain(ROWS)
    for r in got.collect():
        assert (r.payload is None) == (r.record_type == "revisit") and (r.payload is None or digest(r.payload) == r.payload_digest)
    assert rows_of(warc.read_warc(spark, folder, payloads=False, range_bytes=size)) == plain(ROWS)
    assert {r.target_uri for r in got.where("record_id = 'urn:page:-3'").collect()} == {"x%0D%0AWARC-Type: bad"}


def test_archives_are_plain_gzip(written):
    for r in written[0].collect():
        data = gzip.decompress(open(r.path, "rb").read())
        assert data.count(b"WARC-Record-ID: ") == r.n_records and data.startswith(b"WARC/1.1\r\n")


def test_records_inside_records_and_broken_members(spark, tmp_path):
    inner = [warc.member(warc.record("response", f"urn:in:{i}", "u", bytes([i]) * 20, digest(bytes([i]) * 20))) for i in range(50)]
    noise = random.Random(1).randbytes(5_000)
    payload = noise + b"".join(inner) + noise
    whole = warc.member(warc.record("response", "urn:out", "u", payload, digest(payload)))
    after = warc.member(warc.record("response", "urn:next", "u", b"z", digest(b"z")))
    wrong = warc.member(warc.record("response", "urn:wrong", "u", b"z", digest(b"other")))
    cut = after[: len(after) // 2]
    other = gzip.compress(b"WARC/2 no record") + gzip.compress(b"WARC/1.0\r\nContent-Length: 90\r\n\r\nshort\r\n\r\n")
    (tmp_path / "own").mkdir()
    (tmp_path / "own" / "a.warc.gz").write_bytes(noise + whole + b"\x1f\x8b\x08" + other + cut + wrong + after + cut)
    for size in (300, 1 << 20):
        got = warc.read_warc(spark, str(tmp_path / "own"), range_bytes=size)
        assert sorted(r.record_id for r in got.collect()) == ["urn:next", "urn:out"]
    # Another writer keeps the payload's bytes as they are: ranges that begin inside see its records, unless these are sorted out.
    parts = warc.record("response", "urn:out", "u", payload, digest(payload))
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "a.warc.gz").write_bytes(gzip.compress(b"".join(parts), 0) + after)
    seen = warc.read_warc(spark, str(tmp_path / "other"), range_bytes=400)
    assert seen.count() > 2
    assert sorted(r.record_id for r in warc.without_nested(seen, 400).collect()) == ["urn:next", "urn:out"]


def test_other_archives(spark, tmp_path):
    """Archives as others write them: a file's own record, a request, a response without digest, bare blocks."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 6\r\n\r\na: b\r\n\r\n\r\n"
    said = b"HTTP/1.1 404 Not Found\r\nServer: x\r\n\r\ngone"
    answer = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(said) + said + b"\r\n\r\n"
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(answer))
    got = sorted((r.record_type, r.record_id, bytes(r.payload), r.payload_bytes) for r in warc.read_warc(spark, str(tmp_path)).collect())
    assert got == [("response", "urn:uuid:1", b"gone", 4), ("warcinfo", None, b"a: b\r\n", 6)]


def test_empty_and_binary_tables(spark, tmp_path):
    assert warc.read_warc(spark, warc.write_warc(pages(spark, []), str(tmp_path / "none"))).count() == 0
    df = spark.createDataFrame([("a", "u", bytearray(b"\xff\x00")), ("b", "u", bytearray(b"\xff\x00")), ("c", "u", None)], "page_id string, url string, html binary")
    got = {r.record_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_warc(spark, warc.write_warc(df, str(tmp_path / "some"))).collect()}
    assert got == {"urn:page:a": ("response", None, 2), "urn:page:b": ("revisit", "urn:page:a", 2), "urn:page:c": ("response", None, 0)}


def test_query_has_the_contract_s_columns(spark):
    got = queries.op11_warc(spark, "/root/testdata/sf0.001")
    assert got.schema.simpleString() == "struct<page_id:bigint,payload_bytes:bigint,payload_digest:string,record_type:string,refers_to:bigint>"

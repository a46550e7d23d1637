import hashlib
import io
import random
import zlib

import pyarrow as pa

from voxtable.llm.warc import MAGIC, SCHEMA, archive_pages, read_pages, record, records_in


def expect(rows):
    groups = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 1000:
            groups.setdefault(html, []).append(i)
    out = []
    for i, url, html in rows:
        data = (html or "").encode()
        ids = groups.get(html, []) if len(data) >= 1000 else []
        best = max((x for x in ids if x is not None), default=None)
        revisit = bool(ids) and i != best
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(map(str, out))


def got(df):
    return sorted(str(tuple(r)[:5]) for r in df.collect())


ROWS = [
    (1, "http://a/", "x" * 1000),
    (2, "http://a/ b\r\nWARC-Type: fake", "x" * 1000),
    (3, None, "x" * 999),
    (4, "u", "x" * 999),
    (5, "u", None),
    (None, None, "ü" * 700),
    (6, "", "ü" * 700),
    (6, "", "ü" * 700),
    (7, "u", "WARC/1.1\r\n\r\n" * 100),
    (8, "u", "".join(chr(random.Random(1).randrange(32, 0x2FFF)) for _ in range(300_000))),
    (-9, "u", "\x1f\u008b\x08" * 500),
]


def test_round_trip_at_any_range_size(spark):
    pages = spark.createDataFrame([(*r, "z") for r in ROWS], "page_id long, url string, html string, record_type string")
    path = archive_pages(pages)
    for step in (1 << 30, 5000, 97):
        assert got(read_pages(spark, path, step)) == expect(ROWS)
    assert path in archive_pages(pages, path)


def test_payloads_come_back(spark):
    path = archive_pages(spark.createDataFrame(ROWS, "page_id long, url string, html string"))
    back = {(r.record_id, bytes(r.payload)) for r in spark.read.format("warc").load(path).collect() if r.payload is not None}
    assert ("urn:page:8", ROWS[9][2].encode()) in back and ("urn:page:5", b"") in back


def test_magic_inside_a_member_is_no_record():
    row = dict(record_id="urn:page:1", record_type="response", target_uri=None, refers_to=None, payload_bytes=0, payload_digest="00" * 20)
    inner = MAGIC + b"junk" + MAGIC + b"\x00" * 40
    data = []
    for body in (inner * 30, b"plain", inner):
        stored = zlib.compressobj(0, zlib.DEFLATED, 31)
        data.append(stored.compress(record(row | {"payload": body}, "d")) + stored.flush())
    raw = b"".join(data)
    file = pa.PythonFile(io.BytesIO(raw), mode="r")
    whole = list(records_in(file, 0, len(raw), len(raw)))
    assert len(whole) == 3
    for step in (11, 200, 1000):
        parts = [x for at in range(0, len(raw), step) for x in records_in(file, at, min(len(raw), at + step), len(raw))]
        assert parts == whole


def test_empty(spark):
    path = archive_pages(spark.createDataFrame([], "page_id long, url string, html string"))
    assert read_pages(spark, path).count() == 0 and "payload" in SCHEMA


def test_query_equals_brute_force(spark):
    from voxtable.llm.queries import op1_warc

    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert got(op1_warc(spark, sf)) == expect(rows)


def test_damaged_and_cut_records_are_errors():
    import pytest

    rng = random.Random(1)
    members = []
    for i in range(5):
        payload = bytes(rng.randrange(97, 123) for _ in range(3000))
        row = {"record_id": f"urn:x:{i}", "record_type": "response", "target_uri": None, "refers_to": None, "payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
        zipper = zlib.compressobj(5, zlib.DEFLATED, 31)
        members.append(zipper.compress(record(row, "1970-01-01T00:00:00Z")) + zipper.flush())
    raw = b"".join(members)
    read = lambda data: list(records_in(pa.PythonFile(io.BytesIO(data), mode="r"), 0, len(data), len(data)))
    assert len(read(raw)) == 5
    at = len(members[0]) + 900
    with pytest.raises(ValueError, match="damaged"):
        read(raw[:at] + bytes([raw[at] ^ 255, raw[at + 1] ^ 255, raw[at + 2] ^ 255]) + raw[at + 3 :])
    with pytest.raises(ValueError, match="cut short"):
        read(raw[:-200])

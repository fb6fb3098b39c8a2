import base64
import gzip
import hashlib
import random
import tempfile
import zlib
from pathlib import Path

import pytest

from gleaner.llm import warc

PAGES = [
    (3, "http://a.example/x", "<html>same\r\n\r\nbody</html>"), (1, "http://b.example/", "<html>same\r\n\r\nbody</html>"), (2, None, None), (5, "http://c.example/\r\nX-Evil: 1", ""), (7, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n"),
    (8, "u", "ünïcödé 😀" * 30_000), (1, "http://b.example/", "<html>same\r\n\r\nbody</html>"), (None, "n", "<html>same\r\n\r\nbody</html>"), (None, "n", "only null"), (None, "n", "only null"), (-4, "neg", "x\n"),
]


def brute(pages, least):
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in pages:
        data = (h or "").encode()
        original = first.get(h or "") if len(data) >= least else None
        again = original is not None and i != original
        out.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", str(original) if again else "None"))
    return sorted(out)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(pages, least):
    got = warc.round_trip(pages, least).collect()
    assert sorted((str(r.page_id), r.response.payload_bytes, r.response.payload_digest, r.response.type, str(r.refers_to)) for r in got) == brute(PAGES, least)
    for r in got:
        assert r.request.target_uri == r.response.target_uri and "\n" not in r.response.target_uri
        if r.response.type == "response":
            assert bytes(r.response.payload).decode() in {h or "" for _, _, h in PAGES}
        else:
            assert r.response.payload is None and r.response.refers_to in {x.response.record_id for x in got}


def test_archives_are_the_published_format(pages, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    path = tempfile.mkdtemp(prefix="spark-") + "/out"
    warc.write_archives(pages.coalesce(1), "file://" + path)
    files = list(Path(path).glob("part-*"))
    assert len(files) > 3
    records = [r for f in files for r in warc.parse([gzip.decompress(f.read_bytes())])]
    assert len(records) == 3 * len(PAGES)
    assert {f["warc-type"] for f, _ in records} == {"request", "response", "revisit", "metadata"}
    assert all(len(b) == int(f["content-length"]) for f, b in records)
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert whole.startswith(b"WARC/1.1\r\n") and whole.endswith(b"\r\n\r\n")


def test_each_record_is_a_member(pages):
    path = tempfile.mkdtemp(prefix="spark-") + "/out"
    warc.write_archives(pages, "file://" + path)
    n = 0
    for f in Path(path).glob("part-*"):
        data = f.read_bytes()
        while data:
            unpacker = zlib.decompressobj(31)
            assert unpacker.decompress(data).startswith(b"WARC/1.1\r\n") and unpacker.eof
            data, n = unpacker.unused_data, n + 1
    assert n == 3 * len(PAGES)


def test_pages_of_many_megabytes(spark):
    rng = random.Random(1)
    big = "".join(rng.choice("abcdefghij<>/ ") for _ in range(1 << 20)) * 18
    pages = spark.createDataFrame([(i, "u", big + str(i % 2)) for i in range(3)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages, with_payload=False).collect()}
    assert [got[i].response.payload_bytes for i in range(3)] == [len(big) + 1] * 3
    assert [got[i].response.type for i in range(3)] == ["response", "response", "revisit"] and got[2].refers_to == 0
    assert got[1].response.payload_digest == base64.b32encode(hashlib.sha1((big + "1").encode()).digest()).decode()


def test_archives_of_others_are_read():
    records = [b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: %d\r\n\r\n" % n + b"x" * n + b"\r\n\r\n" for n in (0, 5, 3_000_000)]
    want = [0, 5, 3_000_000]
    for data in (b"".join(records), gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        assert [len(b) for _, b in warc.parse(warc.inflate(data))] == want
    assert [len(b) for _, b in warc.parse(records[1][i : i + 3] for i in range(0, len(records[1]), 3))] == [5]


def test_records_meet_across_files_and_strays_stay(spark):
    rows = [("r1", "response", None), ("q1", "request", "r1"), ("m1", "metadata", "r1"), ("q2", "request", "gone")]
    records = spark.createDataFrame([(i, k, "u", "d", c, None, None, None, None, None) for i, k, c in rows], warc.RECORD).repartition(4)
    got = {r.capture_id: r for r in warc.assemble(records).collect()}
    assert got["r1"].request.record_id == "q1" and got["r1"].metadata.record_id == "m1"
    assert got["gone"].response is None and got["gone"].request.record_id == "q2"


def test_empty_table(pages):
    assert warc.round_trip(pages.limit(0)).collect() == []

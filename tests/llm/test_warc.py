import hashlib
import io

import pytest

from sediment.llm.warc import decide_revisits, gzip_member, read_archives, record_bytes, salvage, split_quarantine, write_archives


def record(k, text):
    data = text.encode()
    return record_bytes(k, f"http://x/{k}", data, None, hashlib.sha1(data).hexdigest())


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage_recovers_every_undamaged_record(compressed):
    parts = [record(k, f"page {k} WARC/1.0 " + "text " * (50 * k)) for k in range(12)]
    parts = [gzip_member(p) for p in parts] if compressed else parts
    hurt = bytearray(b"".join(parts))
    a = sum(map(len, parts[:4])) + len(parts[4]) // 2
    hurt[a : a + 9] = b"#########"
    junk = bytes(hurt[: sum(map(len, parts[:8]))]) + b"junk WARC/1.1 \x1f\x8b\x08 junk" + b"".join(parts[8:])[:-7]
    got = list(salvage(io.BytesIO(junk), compressed))
    assert [x[2][0] for x in got if x[0] == "record"] == [0, 1, 2, 3, 5, 6, 7, 8, 9, 10]
    gaps = [x for x in got if x[0] == "gap"]
    assert len(gaps) == 3 and gaps[0][1] == sum(map(len, parts[:4])) and gaps[-1][2] == len(junk)
    covered = sum(x[2] - x[1] for x in gaps) + sum(map(len, parts)) - len(parts[4]) - len(parts[11])
    assert covered == len(junk)


def test_empty_and_pure_junk_archives():
    assert list(salvage(io.BytesIO(b""), True)) == []
    assert [x[0] for x in salvage(io.BytesIO(b"x" * 5000), False)] == ["gap"]


def test_round_trip_with_nulls_copies_and_empty_table(spark):
    big = "é" * 600
    rows = [(1, "http://a/", big), (2, "http://b/", big), (9, None, big), (3, "http://c/", "short"), (4, "http://d/", "short"), (5, "u", None), (6, "u", ""), (None, "n", big), (7, "r", "z" * 2000), (7, "r", "z" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", __import__("pyspark.sql.functions").sql.functions.lit("x"))
    manifest = write_archives(decide_revisits(pages))
    got = sorted(((r.page_id, r.record_type, r.payload_bytes, r.refers_to, r.payload) for r in read_archives(manifest, payloads=True).collect()), key=str)
    z = ("z" * 2000).encode()
    assert got == sorted(
        [(1, "revisit", 1200, 9, b""), (2, "revisit", 1200, 9, b""), (9, "response", 1200, None, big.encode()), (3, "response", 5, None, b"short"), (4, "response", 5, None, b"short"),
         (5, "response", 0, None, b""), (6, "response", 0, None, b""), (None, "response", 1200, None, big.encode()), (7, "response", 2000, None, z), (7, "response", 2000, None, z)], key=str)
    assert read_archives(write_archives(decide_revisits(pages.limit(0)))).count() == 0


def test_long_headers_and_foreign_records():
    import base64

    long_url = record_bytes(1, "http://x/" + "u" * 3_000_000, b"page", None, hashlib.sha1(b"page").hexdigest())
    body = b"<p>hello</p>"
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    foreign = f"WARC/1.0\r\nWARC-Type: response\r\nX-Note: folded\r\n line\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    bare = b"WARC/1.0\r\nWARC-Type: revisit\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    data = long_url + foreign + b"WARC/1.1\r\nnot a header\r\n" + foreign.replace(b"hello", b"hullo") + bare
    for stream, compressed in ((data, False), (b"".join(map(gzip_member, (long_url, foreign, bare))), True)):
        got = list(salvage(io.BytesIO(stream), compressed))
        records = [x[2] for x in got if x[0] == "record"]
        assert [r[1] for r in records] == ["response", "response", "revisit"] and records[0][0] == 1
        assert records[1][5] == body and records[1][3] == hashlib.sha1(body).hexdigest()
        assert len([x for x in got if x[0] == "gap"]) == (0 if compressed else 1)


def test_gaps_are_kept_beside_the_records(spark, tmp_path):
    path = str(tmp_path / "a.warc")
    with open(path, "wb") as f:
        f.write(record(1, "one") + b"#" * 100 + record(2, "two"))
    records, gaps = split_quarantine(read_archives(spark.createDataFrame([(path,)], "path string")))
    assert sorted(r.page_id for r in records.collect()) == [1, 2]
    assert [(r.stop - r.start, r.reason) for r in gaps.collect()] == [(100, "version line")]

"""WARC round trip against hashlib and a plain reading of the files."""

import hashlib
from base64 import b32encode

from pyspark.sql import functions as F, types as T

from leafmark.llm.warc import _RECORDS, archive_pages, read_warc, resolve_records, write_warc

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                       T.StructField("html", T.StringType())])
BIG = "<p>" + "é" * 1_300_000 + "</p>"        # over two chunks of UTF-8
ROWS = [(1, "http://a/1", "<html>x</html>"), (2, "http://a/2", "<html>x</html>"), (3, None, None), (4, "u\r\nv", ""),
        (5, "http://b", BIG), (6, "http://c", BIG), (None, "http://n", "<html>x</html>"), (7, "http://d", "WARC/1.1\r\n\r\nfake"),
        (8, "http://e", "🎉 ünïcode"), (8, "http://e", "🎉 ünïcode"), (9, "x", "<html>x</html>")]


def digest(text):
    return b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows):
    groups = {}
    for k, (pid, _, html) in enumerate(rows):
        groups.setdefault(((html or "").encode(), digest(html)), []).append((pid is not None, pid or 0, k))
    out = []
    for k, (pid, _, html) in enumerate(rows):
        best = max(groups[((html or "").encode(), digest(html))])
        own = (pid is not None, pid or 0, k)
        keep = best == own
        out.append((pid, len((html or "").encode()), digest(html), "response" if keep else "revisit",
                    None if keep else (best[1] if best[0] else None)))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).coalesce(1).withColumn("data", F.lit("clash"))
    got = archive_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted([tuple(r) for r in got], key=str) == expected(ROWS)


def test_chunks_rebuild_payloads(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    index = write_warc(pages)
    chunks = read_warc(index).collect()
    by = {}
    for r in chunks:
        by.setdefault((r.file, r.record_no), []).append(r)
    payloads = []
    for rows in by.values():
        rows.sort(key=lambda r: r.chunk_no)
        assert [r.chunk_no for r in rows] == list(range(len(rows))) and [r.last for r in rows][-1]
        body = b"".join(bytes(r.data) for r in rows)
        last = rows[-1]
        if last.record_type == "response":
            assert len(body) == last.payload_bytes and b32encode(hashlib.sha1(body).digest()).decode() == last.payload_digest
            payloads.append(body)
    assert max(len(rows) for rows in by.values()) >= 3
    assert BIG.encode() in payloads


def test_files_are_plain_warc(spark):
    pages = spark.createDataFrame(ROWS[:3], SCHEMA).coalesce(1)
    index = write_warc(pages).collect()
    import gzip

    with gzip.open(index[0].file.replace("file:", ""), "rb") as f:
        raw = f.read()
    assert raw.startswith(b"WARC/1.1\r\n") and raw.count(b"WARC/1.1\r\n") == 3 and raw.endswith(b"\r\n\r\n")
    assert b"WARC-Type: revisit" in raw and b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" in raw


def test_empty_table(spark):
    assert archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_records_come_from_their_chunks(spark):
    """Lengths are those of the chunks read; a revisit takes the payload of the record it names."""
    rows = [
        ("<r1>", None, "f", 0, 0, False, "response", 7, None, "u", b"abc", None, None),
        ("<r1>", None, "f", 0, 1, True, "response", 7, None, "u", b"de", 99, "READ"),
        ("<r2>", "<r1>", "g", 0, 0, True, "revisit", 3, 5, "v", b"", 42, "CLAIMED"),
        ("<r3>", "<gone>", "g", 1, 0, True, "revisit", 4, 6, None, b"", 42, "CLAIMED"),
    ]
    got = resolve_records(spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in r) for r in rows], _RECORDS))
    found = got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, found)) == [
        (3, 5, "READ", "revisit", 7), (4, None, None, "revisit", None), (7, 5, "READ", "response", None),
    ]

"""WARC archives of a page table, written and read back as a chunked record table.

``write_warc`` writes one WARC/1.1 record per page row, the html in UTF-8 as payload (null html:
empty payload). Of rows with equal payloads (same SHA-1 and length, the identity that WARC's
``identical-payload-digest`` revisits use) the row with the largest page_id is a ``response``,
the others are ``revisit`` records that refer to it and carry no payload. Payloads of every size
take part (threshold ``min_bytes``, 0 by default: smaller payloads are always responses).

Nothing holds a whole record: the payload is taken straight out of the Arrow buffer that Spark
hands to Python (a slice of its UTF-8 bytes, no copy) and compressed and written chunk by chunk
after the header, one gzip member per record (``.warc.gz``);
``read_warc`` streams each archive back in chunks of ``CHUNK`` bytes, carrying an incremental
SHA-1 across the chunks of a record, and gives rows keyed by (file, record_no, chunk_no). Records
whose payload is longer than one chunk are many rows; ``chunks=False`` leaves the bytes out and
gives only the last row of each record (length and digest of the full payload).

On Spark: digests and lengths are computed in the JVM (``sha1`` and a base-32 spelling by
``conv``) and written as a narrow table; the decision is a group-by on (digest, length) with
map-side partial aggregation, joined back to the narrow rows under salts that grow with a group's
counted size (a group of copies can hold a third of all rows); the pages are read again and meet
their decisions by row number, so html moves once. Archives are written by the tasks into the shared folder through ``pyarrow.fs`` (local,
HDFS or object stores), one file per task attempt; the index of written records is a Parquet table,
so only files of finished attempts are read back, one task per file.

Defined results: null page_id rows are written and read like others (no page header; they lose to
any page_id in a group; among equal page_ids the later row wins); null url: no target header;
repeated rows: one record each; an empty table: no files, no rows; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from leafmark.llm.common import fresh_path, small_batches, staged

#: Bytes read or written per step, and per chunk row of the record table.
CHUNK = 1 << 20
#: Rows of a payload group per salt when the decision is joined back.
SALT_ROWS = 100_000
#: Compression of each record's gzip member.
GZIP_LEVEL = 6
#: Rows handed to Python per batch while writing.
WRITE_BATCH_ROWS = 64
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# RFC 4648 base-32 alphabet, and the digits of conv(..., 16, 32) in the same order.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def sha1_base32(payload: F.Column) -> F.Column:
    """Bare upper-case base-32 SHA-1 of a binary column, in the JVM: 40 hex digits are eight runs of
    20 bits, each four base-32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def _record_id(rk: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'leafmark-warc:{rk}')}>"


def _safe(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _keyed(pages: DataFrame) -> DataFrame:
    """rk, page_id, url, html, payload_bytes, payload_digest. ``rk`` numbers rows by their place
    in the scan, so two reads of the same table give the same numbers."""
    rows = pages.select(
        F.monotonically_increasing_id().alias("rk"), pages["`page_id`"].cast("long").alias("page_id"),
        pages["`url`"].cast("string").alias("url"), pages["`html`"].cast("string").alias("html"))
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return rows.select("*", F.octet_length(payload).cast("long").alias("payload_bytes"), sha1_base32(payload).alias("payload_digest"))


def decide_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Narrow decisions: rk, page_id, payload_bytes, payload_digest, record_type, refers_rk, refers_to."""
    rows = staged(_keyed(pages).drop("url", "html"), "warc-digests")
    key = ["payload_digest", "payload_bytes"]
    groups = rows.where(F.col("payload_bytes") >= min_bytes).groupBy(*key).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.max(F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", "rk")).alias("keep"))
    groups = staged(groups.select(*key, F.ceil(F.col("cnt") / SALT_ROWS).cast("int").alias("salts"),
                                  F.col("keep.rk").alias("refers_rk"), F.col("keep.page_id").alias("refers_to")), "warc-groups")
    # Hot groups only are salted; there are at most rows / SALT_ROWS of them.
    hot = groups.where(F.col("salts") > 1).select(*key, "salts")
    salted = rows.join(F.broadcast(hot), key, "left").withColumn("salt", F.pmod("rk", F.coalesce("salts", F.lit(1))))
    spread = groups.select(*key, "refers_rk", "refers_to", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    decided = salted.join(spread, [*key, "salt"], "left")
    response = F.col("refers_rk").isNull() | (F.col("refers_rk") == F.col("rk"))
    return decided.select(
        "rk", "page_id", "payload_bytes", "payload_digest",
        F.when(response, "response").otherwise("revisit").alias("record_type"),
        F.when(response, None).otherwise(F.col("refers_rk")).alias("refers_rk"),
        F.when(response, None).otherwise(F.col("refers_to")).alias("refers_to"))


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """rk, page_id, url, html, payload_bytes, payload_digest, record_type, refers_rk, refers_to.

    Decisions are made on narrow rows; the pages are read again and meet them by row number, so
    html is moved once, to the writer."""
    decided = decide_records(pages, min_bytes).select("rk", "record_type", "refers_rk", "refers_to")
    return _keyed(pages).join(decided, "rk")


_INDEX = T.StructType([T.StructField("file", T.StringType()), T.StructField("records", T.LongType())])


def _writer(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pfs
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{folder}/part-{context.partitionId():05d}-{context.attemptNumber()}-{uuid.uuid4().hex}.warc.gz"
        system, path = pfs.FileSystem.from_uri(name)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        count = 0
        with system.open_output_stream(path, compression=None) as out:
            for batch in batches:
                html = batch.column("html")
                wide = pa.types.is_large_string(html.type)
                offsets = np.frombuffer(html.buffers()[1], np.int64 if wide else np.int32)[html.offset:html.offset + len(html) + 1]
                data = memoryview(html.buffers()[2]) if html.buffers()[2] is not None else memoryview(b"")
                valid = html.is_valid().to_pylist()
                cols = {c: batch.column(c).to_pylist() for c in ("rk", "page_id", "url", "payload_digest", "record_type", "refers_rk", "refers_to", "payload_bytes")}
                for i in range(batch.num_rows):
                    lo, hi = (int(offsets[i]), int(offsets[i + 1])) if valid[i] else (0, 0)
                    revisit = cols["record_type"][i] == "revisit"
                    head = ["WARC/1.1", f"WARC-Type: {cols['record_type'][i]}", f"WARC-Record-ID: {_record_id(cols['rk'][i])}",
                            f"WARC-Date: {date}"]
                    if cols["url"][i] is not None:
                        head.append(f"WARC-Target-URI: {_safe(cols['url'][i])}")
                    if cols["page_id"][i] is not None:
                        head.append(f"WARC-Page-ID: {cols['page_id'][i]}")
                    head.append(f"WARC-Payload-Digest: sha1:{cols['payload_digest'][i]}")
                    if revisit:
                        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(cols['refers_rk'][i])}",
                                 f"WARC-Payload-Length: {cols['payload_bytes'][i]}"]
                        if cols["refers_to"][i] is not None:
                            head.append(f"WARC-Refers-To-Page-ID: {cols['refers_to'][i]}")
                        head += ["Content-Length: 0"]
                    else:
                        head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {hi - lo}"]
                    # One gzip member per record, as .warc.gz files hold them; fed chunk by chunk.
                    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                    out.write(packer.compress(("\r\n".join(head) + "\r\n\r\n").encode("utf-8")))
                    if not revisit:
                        for at in range(lo, hi, CHUNK):
                            out.write(packer.compress(data[at:min(hi, at + CHUNK)]))
                    out.write(packer.compress(b"\r\n\r\n"))
                    out.write(packer.flush())
                    count += 1
        yield pa.RecordBatch.from_pydict({"file": [name], "records": [count]},
                                         schema=pa.schema([("file", pa.string()), ("records", pa.int64())]))
    return run


def write_warc(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write the archives; returns the index (file, records) of the files that hold them."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    planned = plan_records(pages, min_bytes)
    with small_batches(spark, WRITE_BATCH_ROWS):
        return staged(planned.mapInArrow(_writer(folder, date), _INDEX), "warc-index")


_RECORDS = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("refers_id", T.StringType()),
    T.StructField("file", T.StringType()), T.StructField("record_no", T.LongType()), T.StructField("chunk_no", T.LongType()),
    T.StructField("last", T.BooleanType()), T.StructField("record_type", T.StringType()), T.StructField("page_id", T.LongType()),
    T.StructField("refers_to", T.LongType()), T.StructField("url", T.StringType()), T.StructField("data", T.BinaryType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
])
_RECORDS_ARROW = pa.schema([
    ("record_id", pa.string()), ("refers_id", pa.string()), ("file", pa.string()), ("record_no", pa.int64()), ("chunk_no", pa.int64()), ("last", pa.bool_()), ("record_type", pa.string()),
    ("page_id", pa.int64()), ("refers_to", pa.int64()), ("url", pa.string()), ("data", pa.binary()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()),
])


class _Stream:
    """Buffered reads of a file stream: lines of a header, then exact byte counts."""

    def __init__(self, raw):
        self.raw, self.buf, self.at = raw, b"", 0

    def _fill(self) -> bool:
        more = self.raw.read(CHUNK)
        if not more:
            return False
        self.buf, self.at = self.buf[self.at:] + more, 0
        return True

    def line(self) -> bytes | None:
        while True:
            end = self.buf.find(b"\r\n", self.at)
            if end >= 0:
                found, self.at = self.buf[self.at:end], end + 2
                return found
            if not self._fill():
                return None

    def take(self, n: int) -> Iterator[bytes]:
        while n > 0:
            if self.at >= len(self.buf) and not self._fill():
                raise ValueError("archive ends inside a record")
            part = self.buf[self.at:self.at + min(n, CHUNK)]
            self.at += len(part)
            n -= len(part)
            yield part


def _reader(chunks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pfs

        for batch in batches:
            for name in batch.column("file").to_pylist():
                system, path = pfs.FileSystem.from_uri(name)
                with system.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw, mode="rb") as unpacked:
                    stream, record_no = _Stream(unpacked), 0
                    while True:
                        first = stream.line()
                        while first == b"":
                            first = stream.line()
                        if first is None:
                            break
                        fields = {}
                        while (line := stream.line()):
                            key, _, value = line.decode("utf-8").partition(":")
                            fields[key.strip().lower()] = value.strip()
                        kind, length = fields.get("warc-type"), int(fields.get("content-length", "0"))
                        rows, digest, seen = [], hashlib.sha1(), 0
                        for k, part in enumerate(stream.take(length)):
                            digest.update(part)
                            seen += len(part)
                            if chunks:
                                rows.append((k, part))
                                if len(rows) > 1:
                                    yield _batch(name, record_no, [rows.pop(0)], fields, None, None, last=False)
                        if kind == "revisit":
                            size, sha = int(fields["warc-payload-length"]), fields["warc-payload-digest"].split(":", 1)[1]
                        else:
                            size, sha = seen, b32encode(digest.digest()).decode()
                        yield _batch(name, record_no, rows or [(0, b"")], fields, size, sha, last=True)
                        record_no += 1
    return run


def _batch(name, record_no, rows, fields, size, sha, last) -> pa.RecordBatch:
    page = fields.get("warc-page-id")
    refers = fields.get("warc-refers-to-page-id")
    n = len(rows)
    return pa.RecordBatch.from_pydict({
        "record_id": [fields.get("warc-record-id")] * n, "refers_id": [fields.get("warc-refers-to")] * n, "file": [name] * n, "record_no": [record_no] * n, "chunk_no": [k for k, _ in rows], "last": [last] * n,
        "record_type": [fields.get("warc-type")] * n, "page_id": [None if page is None else int(page)] * n,
        "refers_to": [None if refers is None else int(refers)] * n, "url": [fields.get("warc-target-uri")] * n,
        "data": [d for _, d in rows], "payload_bytes": [size] * n, "payload_digest": [sha] * n,
    }, schema=_RECORDS_ARROW)


def read_warc(index: DataFrame, chunks: bool = True) -> DataFrame:
    """The record table of the archives an index names: one row per chunk of every record
    (record_id, refers_id, file, record_no, chunk_no, last, record_type, page_id, refers_to, url,
    data, payload_bytes, payload_digest; the last two on the last row of a record). One task per
    file."""
    files = index.where(F.col("records") > 0).select("file")
    count = max(1, files.count())
    return files.repartition(count, "file").mapInArrow(_reader(chunks), _RECORDS)


def resolve_records(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunked record table, with the full payload's length and digest.

    A response's length is that of its chunks. A revisit carries no payload: the record it refers
    to is looked up by its id, and length, digest and page_id are those read there, whatever the
    revisit's own header says (null if the archives lack that record). Revisits are salted by the
    counted size of their group, as in ``decide_records``."""
    of_last = {c: F.max(F.when(F.col("last"), F.col(c))).alias(c) for c in (
        "record_id", "refers_id", "record_type", "page_id", "url", "payload_digest")}
    # The bytes are counted before the rows are sorted and grouped, so that they are not carried along.
    counted = chunks.select("file", "record_no", "last", *of_last, F.octet_length("data").cast("long").alias("n"))
    records = staged(counted.groupBy("file", "record_no").agg(
        *of_last.values(), F.sum("n").alias("payload_bytes")), "warc-records")
    revisit = F.col("record_type") == "revisit"
    read = records.where(~revisit)
    groups = records.where(revisit).groupBy("refers_id").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    groups = staged(groups, "warc-referred")
    hot = groups.where(F.col("salts") > 1)
    salted = records.where(revisit).select("record_id", "refers_id", "page_id", "record_type", "url", "file", "record_no").join(
        F.broadcast(hot), "refers_id", "left").withColumn("salt", F.pmod(F.xxhash64("record_id"), F.coalesce("salts", F.lit(1))).cast("int"))
    payloads = read.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    spread = groups.join(payloads, "refers_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file", "record_no"]
    return read.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(
        salted.join(spread, ["refers_id", "salt"], "left").select(*columns))


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages as WARC, read them back as the chunked record table and resolve it: one row
    per record, page_id, payload_bytes, payload_digest, record_type, refers_to (and url, file,
    record_no)."""
    return resolve_records(read_warc(write_warc(pages, min_bytes=min_bytes)))

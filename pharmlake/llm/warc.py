"""WARC archives: writing, and reading back with segment reassembly.

Writing: payloads with equal SHA-256 digests and at least ``revisit_bytes`` bytes are
stored once, with the smallest page_id, as a response; the others become revisit records
that name it. A response's HTTP block uses chunked transfer framing; a block above
``segment_bytes`` is cut into a first segment and continuation records. Records go through Spark's text
writer into gzip files of bounded record count, so any file system Spark knows will do.

Reading: each file is inflated and cut into records by Content-Length. Records that are whole are decoded at
once; segments are grouped by the origin's record id (one shuffle of long
records only, the record ids are spread evenly) and ordered by segment number inside the partition, their total
length is verified, and the chunked framing is decoded. A reassembled record must fit a task's
memory; nothing else is held.

Defined cases: null html is the empty payload; null url is an empty target; every row has
its own record id, so repeated rows and rows with one page_id come back as often as they
went in; all rows that share the smallest page_id of a payload are responses; a null
page_id stays null, revisits the smallest other one and is never referred to; extra columns are ignored; an empty table gives no
rows; a record with missing or surplus segments has ``complete`` false."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sketches import bitmap, in_bitmap_bucket
from .tables import shared_path, stored

CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
BACK = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, complete boolean"
PARTS = "origin string, number int, total long, head string, body binary"


def _name(page_id) -> bytes:
    return b"null" if page_id is None else b"%d" % page_id


def _id(page_id, run: bytes, number=1) -> bytes:
    """A record's own id: page, the written row it comes from, segment."""
    return b"<urn:page:%s:%s:%d>" % (_name(page_id), run, number)


def _runs(kind: bytes):
    """A different name for every row written: kind of row, task, running number."""
    from pyspark import TaskContext

    task, n = TaskContext.get().partitionId(), 0
    while True:
        yield b"%s%d-%d" % (kind, task, n)
        n += 1


def _record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """One record without its closing blank lines (the writer's line separator)."""
    head = b"".join(k + b": " + v + CRLF for k, v in fields)
    return b"WARC/1.1\r\n" + head + b"Content-Length: %d\r\n\r\n" % len(block) + block


def chunked(payload: bytes, size: int) -> bytes:
    out = [b"%x\r\n%s\r\n" % (len(payload[a:a + size]), payload[a:a + size]) for a in range(0, len(payload), size)]
    return b"".join(out) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + n])
        if body[end + 2 + n:end + 4 + n] != CRLF:
            raise ValueError("broken chunk")
        at = end + 4 + n


def records(page_id, run: bytes, url: str, payload: bytes, segment_bytes: int, chunk_bytes: int):
    """The records (bytes) of one page."""
    url = url.replace("\r", "%0D").replace("\n", "%0A").encode()
    digest = b"sha256:" + hashlib.sha256(payload).hexdigest().encode()
    common = [(b"WARC-Target-URI", url), (b"WARC-Date", DATE.encode()), (b"Content-Type", b"application/http; msgtype=response"),
              (b"WARC-Payload-Digest", digest)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    first = [(b"WARC-Type", b"response"), (b"WARC-Record-ID", _id(page_id, run)), (b"X-Page-ID", _name(page_id)), *common]
    if len(block) <= segment_bytes:
        yield _record(first, block)
        return
    cuts = range(0, len(block), segment_bytes)
    for number, a in enumerate(cuts, 1):
        own = [(b"WARC-Segment-Number", b"%d" % number)]
        if a == cuts[-1]:
            own.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        if number > 1:
            own = [(b"WARC-Type", b"continuation"), (b"WARC-Record-ID", _id(page_id, run, number)),
                   (b"WARC-Segment-Origin-ID", _id(page_id, run)), *common[:2], *own]
        else:
            own = first + own
        yield _record(own, block[a:a + segment_bytes])


def revisit(page_id, run: bytes, url: str, digest: str, length: int, refers_to) -> bytes:
    url = url.replace("\r", "%0D").replace("\n", "%0A").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    return _record([(b"WARC-Type", b"revisit"), (b"WARC-Record-ID", _id(page_id, run)), (b"X-Page-ID", _name(page_id)), (b"WARC-Target-URI", url),
                    (b"WARC-Date", DATE.encode()), (b"Content-Type", b"application/http; msgtype=response"),
                    (b"WARC-Payload-Digest", b"sha256:" + digest.encode()),
                    (b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    (b"X-Refers-To-Page", _name(refers_to))], block)


def write(pages: DataFrame, path: str, revisit_bytes: int = 100, segment_bytes: int = 16 << 10,
          chunk_bytes: int = 4 << 10, records_per_file: int = 4096) -> None:
    """Write one record per page (several when segmented) as gzip WARC files."""
    spark = pages.sparkSession
    clean = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                         F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keys = stored(clean.select("page_id", "url", F.sha2("html", 256).alias("digest"),
                               F.octet_length("html").cast("long").alias("length")).where(F.col("length") >= revisit_bytes), "digests")
    firsts = (keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
              .where("n > 1").select("digest", "refers_to"))
    again = stored(keys.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))), "revisits")
    again_bits = spark.sparkContext.broadcast(bitmap(again, "page_id"))

    def respond(kind):
        return lambda batches: _responses(batches, kind)

    def _responses(batches, kind):
        import pyarrow as pa

        runs = _runs(kind)
        for batch in batches:
            out = []
            for i, u, h in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                out += records(i, next(runs), u, h.encode(), segment_bytes, chunk_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    def point(batches):
        import pyarrow as pa

        runs = _runs(b"v")
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "length", "refers_to")))
            yield pa.RecordBatch.from_arrays([pa.array([revisit(r[0], next(runs), *r[1:]) for r in rows], pa.binary())], names=["value"])

    # pages whose bit is clear are no revisits: they need no shuffle. The bitmap only
    # saves shuffling; the exact test for the others is the anti-join
    @F.pandas_udf("boolean")
    def perhaps(bit):
        import pandas as pd

        return pd.Series(again_bits.value[bit.to_numpy()])

    marked = clean.withColumn("perhaps", perhaps(in_bitmap_bucket("page_id")))
    sure = marked.where(~F.col("perhaps")).drop("perhaps")
    rest = marked.where("perhaps").drop("perhaps")
    gone = again.select(F.col("page_id").alias("gone"), F.col("digest").alias("payload"))
    same = F.col("page_id").eqNullSafe(F.col("gone")) & (F.col("digest") == F.col("payload"))
    rest = rest.withColumn("digest", F.sha2("html", 256)).join(gone, same, "left_anti").drop("digest")
    out = (sure.mapInArrow(respond(b"s"), "value binary").union(rest.mapInArrow(respond(b"r"), "value binary"))
           .union(again.select("page_id", "url", "digest", "length", "refers_to").mapInArrow(point, "value binary")))
    (out.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def parse(data: bytes):
    """(fields, block) of every record of one file, gzip (any number of members) or plain."""
    import zlib

    if data[:2] == b"\x1f\x8b":
        whole = []
        while data:
            z = zlib.decompressobj(31)
            whole.append(z.decompress(data) + z.flush())
            data = z.unused_data
        data = b"".join(whole)
    at = 0
    while True:
        at = data.find(b"WARC/", at)
        if at < 0:
            return
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(fields["content-length"])
        yield fields, data[end + 4:end + 4 + n]
        at = end + 4 + n


def _row(fields: dict, block: bytes, complete: bool):
    """A BACK row from a whole record."""
    head, _, body = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    name = lambda k: None if (v := fields[k]) == "null" else int(v)
    said = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if fields["warc-type"] == "revisit":
        return (name("x-page-id"), int(http["content-length"]), said, "revisit", name("x-refers-to-page"), complete)
    try:
        payload = dechunk(body) if http.get("transfer-encoding") == "chunked" else body
    except ValueError:
        payload, complete = b"", False
    digest = hashlib.sha256(payload).hexdigest()
    return name("x-page-id"), len(payload), digest, "response", None, complete and digest == said


def _batch(rows, schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)],
                                      schema=schema)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """One BACK row per response or revisit record of the archives under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def cut(batches):
        """Whole records as rows; segments as parts."""
        import json

        import pyarrow as pa

        schema = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("head", pa.string()),
                            ("body", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, block in parse(content.as_py()):
                    number = int(fields.get("warc-segment-number", 0))
                    if number:
                        total = fields.get("warc-segment-total-length")
                        rows.append((fields.get("warc-segment-origin-id", fields["warc-record-id"]), number,
                                     int(total) if total else None, json.dumps(fields) if number == 1 else None, block))
                        held += len(block)
                    elif fields["warc-type"] in ("response", "revisit"):
                        rows.append((None, 0, None, json.dumps(_row(fields, block, True)), None))
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                yield _batch(rows, schema)

    def join(batches):
        """Partition sorted by (origin, number): one record after the other."""
        import json

        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("complete", pa.bool_())])
        origin, parts, out = None, [], []

        def close():
            if parts and parts[0][3] is not None:
                block = b"".join(p[4] for p in parts)
                whole = [p[1] for p in parts] == list(range(1, len(parts) + 1)) and parts[-1][2] == len(block)
                out.append(_row(json.loads(parts[0][3]), block, whole))
            parts.clear()

        for batch in batches:
            for p in zip(*(c.to_pylist() for c in batch.columns)):
                if p[0] != origin:
                    close()
                    origin = p[0]
                if not parts or p[1] != parts[-1][1]:  # a segment read twice counts once
                    parts.append(p)
            yield _batch(out, schema)
            out.clear()
        close()
        yield _batch(out, schema)

    pieces = files.mapInArrow(cut, PARTS)
    pieces = stored(pieces, "records")
    whole = pieces.where("number = 0").select(F.from_json("head", "array<string>").alias("h")).select(
        F.col("h")[0].cast("long").alias("page_id"), F.col("h")[1].cast("long").alias("payload_bytes"),
        F.col("h")[2].alias("payload_digest"), F.col("h")[3].alias("record_type"), F.col("h")[4].cast("long").alias("refers_to"),
        F.col("h")[5].cast("boolean").alias("complete"))
    joined = pieces.where("number > 0").repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(join, BACK)
    return whole.union(joined)


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write the archives into the shared folder and read them back."""
    path = shared_path(pages.sparkSession, "warc")
    write(pages, path, **options)
    return read_back(pages.sparkSession, path)

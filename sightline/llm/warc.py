"""WARC archives: writing with segmentation and revisits, reading with segment reassembly.

Each page becomes a record whose payload is its html in UTF-8, sent in chunked transfer framing. A record
block above `SEGMENT_BYTES` is split: a first segment, then continuation records. Of pages with equal
payloads the one with the smallest page_id is a response; the others are revisits, without a payload.

Reading takes the archives apart by their Content-Length, groups continuation records by the record they
belong to, puts them in order of segment number, verifies the total length, and takes off the chunked
framing. Digests are then computed from what was read, and compared with what the records declare.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import shared_dir

#: The largest block of one record, the chunks of the transfer framing, and the records of one archive
#: (so that no archive is above RECORDS * SEGMENT_BYTES bytes before compression).
SEGMENT_BYTES, CHUNK_BYTES, RECORDS = 32_768, 8_192, 2_048
#: Payloads below this size are never revisits.
LEAST_BYTES = 0


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for i in range(0, len(payload), size) if (p := payload[i : i + size])]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped. ValueError if it is cut off."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(body[at : at + size])
        at += size + 2


def record(fields: dict[str, object], block: bytes) -> bytes:
    """A record up to the first of the two line ends that close it; the writer adds the other."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n"


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record. ValueError where the archive is malformed."""
    at = 0
    while at < len(archive):
        if archive.startswith(b"\r\n", at):
            at += 2
            continue
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        at = start + int(fields["content-length"])
        if at > len(archive):
            raise ValueError("a record is cut off")
        yield fields, archive[start:at]


def http_split(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    lines = (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in lines}, body


def _name(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def page_records(key: str, page: int | None, url: str | None, payload: bytes, first: int | None, segment: int) -> Iterator[bytes]:
    """The records of one page; key: names this row and no other; first: the page that it repeats, if it does."""
    me = _name(key)
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    common = {"WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": target, "Content-Type": "application/http;msgtype=response", "X-Page": page}
    common["WARC-Payload-Digest"] = f"sha1:{digest(payload)}"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if first is not None:
        revisit = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": first}
        yield record({"WARC-Type": "revisit", "WARC-Record-ID": me, **common, **revisit}, head + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield record({"WARC-Type": "response", "WARC-Record-ID": me, **common}, block)
        return
    cuts = range(0, len(block), segment)
    for n, i in enumerate(cuts, 1):
        if n == 1:
            fields = {"WARC-Type": "response", "WARC-Record-ID": me, **common, "WARC-Segment-Number": 1}
        else:
            total = len(block) if n == len(cuts) else None
            fields = {"WARC-Type": "continuation", "WARC-Record-ID": _name(f"{key}:{n}"), "WARC-Date": common["WARC-Date"], "WARC-Target-URI": target,
                      "WARC-Segment-Origin-ID": me, "WARC-Segment-Number": n, "WARC-Segment-Total-Length": total}
        yield record(fields, block[i : i + segment])


def write(pages: DataFrame, path: str, id_col: str = "page_id", html: str = "html", url: str = "url", segment: int = SEGMENT_BYTES, least: int = LEAST_BYTES) -> None:
    """Write gzip-compressed archives into the folder path, which Spark's writer creates.

    A null html is an empty payload. Rows are told apart by id and payload; a repeated row is written once
    for each time that it stands there. Null ids come last where the smallest is looked for.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    keys = rows.select("id", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").alias("n")).distinct()
    firsts = keys.groupBy("sha").agg(F.min("id").alias("first"))  # combined before the shuffle
    known = keys.join(firsts, "sha").select(F.col("id").alias("k_id"), F.col("sha").alias("k_sha"), F.when((F.col("n") >= least) & (F.col("id") != F.col("first")), F.col("first")).alias("first"))
    # ids are near unique, so this join has no hot key even where one payload is repeated without end
    marked = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).join(known, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("sha") == F.col("k_sha")))
    slim = marked.select("id", "url", F.col("html").cast("binary").alias("payload"), "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, row = TaskContext.get().partitionId(), 0
        for b in batches:
            out, size = [], 0
            for page, u, payload, first in zip(*(b.column(i).to_pylist() for i in range(4))):
                row += 1
                for r in page_records(f"{task}.{row}.{page}", page, u, payload, first, segment):
                    out.append(r)
                    size += len(r)
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = slim.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("compression", "gzip").option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS).text(path)


def _finish(fields: dict[str, str], block: bytes) -> tuple:
    """page, payload_bytes, payload_digest, record_type and refers_to of a whole record."""
    http, body = http_split(block)
    declared = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    page = int(fields["x-page"]) if "x-page" in fields else None
    if fields["warc-type"] == "revisit":
        return page, int(http["content-length"]), declared, "revisit", int(fields["x-refers-to-page"])
    payload = unchunked(body) if http.get("transfer-encoding", "").lower() == "chunked" else body
    found = digest(payload)
    if declared and found != declared:
        raise ValueError(f"the payload of {fields['warc-record-id']} does not have its declared digest")
    return page, len(payload), found, fields["warc-type"], None


def read(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page in the archives of a
    folder. Segments may lie in any archive and order. A record that lacks a segment, or whose length is
    not the total that its last segment states, is an error; so is a digest that does not fit."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    part = "origin string, number int, total long, fields map<string,string>, block binary"

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = ["origin", "number", "total", "fields", "block"]
        for b in batches:
            for content in b.column(0):
                out, size = [], 0
                for fields, block in parse(gzip.decompress(content.as_py())):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    number = int(fields.get("warc-segment-number", 0))
                    origin = fields["warc-segment-origin-id"] if kind == "continuation" else fields["warc-record-id"]
                    total = fields.get("warc-segment-total-length")
                    if number:
                        own = None if kind == "continuation" else list(fields.items())
                        out.append((origin, number, int(total) if total else None, own, block))
                    else:  # a whole record is done here: only what its row needs goes on
                        page, length, sha, what, refers = _finish(fields, block)
                        row = {"page": page, "length": length, "sha": sha, "type": what, "refers": refers}
                        out.append((origin, 0, None, [(k, str(v)) for k, v in row.items() if v is not None], None))
                    size += len(block)
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        fields: dict[str, str] = {}
        origin = None

        def done(total: int | None) -> tuple:
            block = b"".join(held)
            if not fields or total != len(block):
                raise ValueError(f"{origin} has {len(block)} bytes, but its segments state {total}")
            return _finish(fields, block)

        for b in batches:
            out = []
            for name, number, total, own, block in zip(*(b.column(c).to_pylist() for c in ("origin", "number", "total", "fields", "block"))):
                if number == 0:
                    row = dict(own)
                    page, refers = (int(row[k]) if k in row else None for k in ("page", "refers"))
                    out.append((page, int(row["length"]), row["sha"], row["type"], refers))
                    continue
                if number == 1:
                    if held:
                        raise ValueError(f"{origin} lacks its last segment")
                    origin, held, fields = name, [block], dict(own)
                elif name != origin or number != len(held) + 1:
                    raise ValueError(f"{name} lacks segment {len(held) + 1 if name == origin else 1}")
                else:
                    held.append(block)
                if total is not None:
                    out.append(done(total))
                    held, fields = [], {}
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if held:
            raise ValueError(f"{origin} lacks its last segment")

    rows = files.mapInArrow(parts, part).repartition(n, "origin").sortWithinPartitions("origin", "number")
    return rows.mapInArrow(whole, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Archives of all pages, written to the shared folder and read back."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, path, **options)
    return read(pages.sparkSession, path)

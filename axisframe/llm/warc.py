"""WARC archives: writing with segmentation and revisits, reading with segment reassembly."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, spread_join

#: Payloads from this size on are written once and referred to afterwards.
REVISIT_FROM = 1000
#: Characters of a block that one segment holds.
SEGMENT = 16_384
#: Characters in one chunk of the transfer framing.
CHUNK = 4_096
#: Owners of repeated payloads, of about a hundred bytes each, that are broadcast at most.
BROADCAST_OWNERS = 50_000
#: Bytes of payload that an archive file holds, about.
FILE = 64 << 20
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def _pieces(text: Column, n: int) -> Column:
    count = F.ceil(F.length(text) / n).cast("int")
    return F.transform(
        F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.substring(text, i * n + 1, F.lit(n)),
    )


def _chunked(text: Column) -> Column:
    frames = F.transform(_pieces(text, CHUNK), lambda p: F.concat(F.hex(F.octet_length(p).cast("long")), F.lit("\r\n"), p, F.lit("\r\n")))
    return F.concat(F.array_join(frames, ""), F.lit("0\r\n\r\n"))


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def write_warc(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM, segment: int = SEGMENT) -> None:
    """Write (page_id, url, html) as gzipped WARC/1.1 files under ``path``, one record or run of segments a page.

    The payload is the html in UTF-8 (null: empty) in chunked transfer framing. Of equal payloads of
    ``revisit_from`` bytes or more the one with the largest page_id is the response, the others are
    revisits. Blocks over ``segment`` characters continue in continuation records. Records are text, so
    Spark's own writer puts them where its file systems reach; it ends each with the blank lines that
    the format asks for; a file holds about FILE bytes. Every row has a record id of its own, also one that repeats
    another; rows without a page_id are responses; an empty table gives no records. Other columns are not read.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    # Written down, so that a row has the same number wherever it is read.
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", payload.alias("payload"))
    rows = cut(rows.withColumn("digest", F.sha1(F.encode("payload", "UTF-8"))).withColumn("bytes", F.octet_length("payload")), "pages")
    owner = rows.where((F.col("bytes") >= revisit_from) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("owner"), F.count("*").alias("n"))
    owner = cut(owner.where("n > 1"), "owners")
    stored = rows
    mean = rows.agg(F.avg("bytes")).first()[0] or 0
    # Few owners are broadcast, so that no payload moves; more are met in a join that spreads what many pages have.
    rows = rows.join(F.broadcast(owner.drop("n")), "digest", "left") if owner.count() <= BROADCAST_OWNERS else spread_join(rows, owner, ["digest"], "n", "left")
    again = F.coalesce(F.col("page_id") != F.col("owner.page_id"), F.lit(False))
    uri = F.regexp_replace("url", r"[\x00-\x20]", "%20")
    rows = rows.withColumn("id", _urn(F.col("page_id"), F.col("digest"), F.col("row")))
    block = F.when(again, F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")).otherwise(F.concat(F.lit(HTTP), _chunked(F.col("payload"))))
    rows = rows.withColumn("block", block).withColumn("again", again)
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
    head = F.concat(
        line("WARC-Target-URI", uri),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Page-ID", F.col("page_id")),
        F.when(F.col("again"), F.concat(line("WARC-Refers-To", _urn(F.col("owner.page_id"), F.col("digest"), F.col("owner.row"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
    )
    rows = rows.select("id", "again", head.alias("head"), F.octet_length("block").alias("total"), _pieces(F.col("block"), segment).alias("parts"))
    # A block always has a part; a plain generator would have the planner make all blocks again to find out.
    rows = rows.select("*", F.size("parts").alias("of"), F.posexplode_outer("parts").alias("k", "part"))
    first = F.concat(
        F.lit("WARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), F.col("id"), F.lit("\r\n"),
        F.col("head"), F.when(F.col("of") > 1, "WARC-Segment-Number: 1\r\n").otherwise(""),
    )
    more = F.concat(
        F.lit("WARC-Type: continuation\r\nWARC-Record-ID: "), _urn(F.col("id"), F.col("k")), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Segment-Origin-ID: "), F.col("id"),
        F.lit("\r\nWARC-Segment-Number: "), (F.col("k") + 1).cast("string"), F.lit("\r\n"),
        F.when(F.col("k") + 1 == F.col("of"), line("WARC-Segment-Total-Length", F.col("total"))).otherwise(""),
    )
    record = F.concat(F.lit("WARC/1.1\r\n"), F.when(F.col("k") == 0, first).otherwise(more), line("Content-Length", F.octet_length("part")), F.lit("\r\n"), F.col("part"))
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", max(1, int(FILE / (mean + 1024)))).text(path)
    discard(stored, owner)


def decode_chunked(block: bytes) -> bytes:
    """The body in chunked transfer framing; trailers are left out, a broken frame raises ValueError."""
    out, at = [], 0
    while True:
        eol = block.index(b"\r\n", at)
        n = int(block[at:eol].split(b";")[0], 16)
        at = eol + 2
        if n == 0:
            return b"".join(out)
        if at + n > len(block) or block[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it says")
        out.append(block[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    if any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(b"\r\n")[1:]):
        return decode_chunked(body)
    return body


def _inflate(data: bytes) -> Iterator[bytes]:
    """The bytes of any run of gzip members, or of plain data, a piece at a time."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        for at in range(0, len(data), 1 << 20):
            yield z.decompress(data[at : at + (1 << 20)])
            if z.eof:
                break
        else:
            yield z.flush()
        rest = len(z.unused_data)
        data = data[min(at + (1 << 20), len(data)) - rest :] if z.eof else b""


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record in a file's bytes."""
    left, at, pieces = b"", 0, _inflate(data)

    def fill(n: int) -> bool:
        """Have ``n`` bytes from ``at`` on, if the file has them."""
        nonlocal left, at
        if len(left) - at >= n:
            return True
        have, size = [left[at:]], len(left) - at
        at = 0
        while size < n and (piece := next(pieces, None)) is not None:
            have.append(piece)
            size += len(piece)
        left = b"".join(have)
        return size >= n

    while True:
        while fill(1) and left[at] in b"\r\n":
            at += 1
        if not fill(1):
            return
        while (end := left.find(b"\r\n\r\n", at)) < 0:
            if not fill(len(left) - at + 1):
                raise ValueError("a record's header does not end")
        lines = left[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record starts here")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at = end + 4
        n = int(fields["content-length"])
        if not fill(n):
            raise ValueError("a record is cut off")
        yield fields, left[at : at + n]
        at += n


def _finish(kind: str, digest: str | None, block: bytes, name: str) -> tuple[int | None, str | None, bytes | None]:
    """Size, digest and payload of a whole block; a revisit has only the digest of what it refers to."""
    if kind == "revisit":
        return None, digest, None
    payload = http_payload(block)
    found = hashlib.sha1(payload).hexdigest()
    if digest and digest != found:
        raise ValueError(f"{name}: the payload does not have its digest")
    return len(payload), found, payload


_COLUMNS = "id string, kind string, page_id long, refers string, origin string, segment int, total long, payload_bytes long, payload_digest string, data binary"
_ARROW = pa.schema([("id", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("refers", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("data", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _parse(batches, keep: bool):
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for f, block in parse_records(content.as_py()):
                number = lambda k: int(f[k]) if f.get(k) else None  # noqa: B023, E731
                name, kind, segment = f["warc-record-id"], f["warc-type"], number("warc-segment-number")
                digest = (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                row = (name, kind, number("x-page-id"), f.get("warc-refers-to"), f.get("warc-segment-origin-id"), segment, number("warc-segment-total-length"))
                if segment is None:
                    n, digest, data = _finish(kind, digest, block, name)
                    rows.append((*row, n, digest, data if keep else None))
                    size += len(data or b"") * keep
                else:
                    rows.append((*row, None, digest, block))
                    size += len(block)
                if size > 4_000_000:
                    yield _rows(rows)
                    rows, size = [], 0
            yield _rows(rows)


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the archives under ``path``: whole ones with size and digest of their payload (and the payload
    if asked for), segments with their block. Records without a page number have a null page_id, an empty payload
    has size 0; a record that comes twice gives two rows, an archive without records none.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(lambda it: _parse(it, payloads), _COLUMNS)


def _join(batches, keep: bool):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            blocks = {}
            for s in r["parts"]:
                blocks.setdefault(s["segment"], s["data"])
            if sorted(blocks) != list(range(1, len(blocks) + 1)):
                raise ValueError(f"{r['origin']}: a segment is missing")
            block = b"".join(blocks[k] for k in sorted(blocks))
            if r["total"] != len(block):
                raise ValueError(f"{r['origin']}: the segments are not as long as the last one says")
            n, digest, data = _finish(r["kind"], r["payload_digest"], block, r["origin"])
            out.append((r["origin"], r["kind"], r["page_id"], r["refers"], None, None, None, n, digest, data if keep else None))
        yield _rows(out)


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per response or revisit record: page_id, payload_bytes, payload_digest, record_type, refers_to,
    and the payload if asked for (that of the response it refers to, for a revisit, is not copied).

    Segments are grouped by their origin, ordered by number and joined; a gap, a total length that
    differs, a broken chunk or a digest that differs raises an error. Only segmented records are shuffled
    with their blocks. A revisit takes size and page from the response it refers to, or nulls if there is none;
    a response that many refer to is spread. Records without a page number have a null page_id; repeated
    records stay, an archive without records gives no rows.
    """
    raw = cut(read_records(spark, path, payloads), "records")
    split = raw.where("segment IS NOT NULL").withColumn("origin", F.coalesce("origin", "id"))
    first = lambda c: F.max(F.when(F.col("id") == F.col("origin"), F.col(c))).alias(c)
    parts = F.collect_list(F.struct("segment", "data")).alias("parts")
    split = split.groupBy("origin").agg(first("kind"), first("page_id"), first("refers"), first("payload_digest"), F.max("total").alias("total"), parts)
    whole = raw.where("segment IS NULL").union(split.mapInArrow(lambda it: _join(it, payloads), _COLUMNS))
    whole = whole.select("id", "kind", "page_id", "refers", "payload_bytes", "payload_digest", *(["data"] if payloads else []))
    whole = cut(whole, "whole")
    discard(raw)
    wanted = whole.where("kind = 'revisit'").groupBy("refers").agg(F.count("*").alias("times"))
    seen = whole.where("kind = 'response'").select(F.col("id").alias("refers"), F.col("page_id").alias("to"), F.col("payload_bytes").alias("n"))
    seen = cut(seen.join(wanted, "refers"), "seen")
    again = spread_join(whole.where("kind <> 'response'").drop("payload_bytes"), seen, ["refers"], "times", "left").withColumnRenamed("n", "payload_bytes")
    first = whole.where("kind = 'response'").withColumn("to", F.lit(None).cast("long"))
    out = first.unionByName(again)
    return out.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("to").alias("refers_to"), *([F.col("data").alias("payload")] if payloads else []))

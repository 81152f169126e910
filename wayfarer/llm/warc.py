"""Web archives: written as segmented, chunk-framed WARC records, read back and reassembled.

A page's HTTP response (headers and a body in chunked transfer framing) that is longer than a
segment is cut: the first part is a response record with segment number 1, the others are
continuation records that name the first by its origin id, and the last states the total
length. The reader groups continuation records by origin, orders them by segment number,
verifies numbers and total length, and decodes the framing. Pages whose payload equals an
earlier one's become revisit records without a payload.

Archives are gzip files of a bounded number of records, written and read by Spark's own sources.
Each record ends in two line breaks, the last line feed being the sink's, so a file is a plain
sequence of records in one gzip member. The reader takes archives of others as well: a member for
each record, plain files, any case and spacing of header fields; records that hold no page are
passed over, and a response without a page number has a null one. It unpacks a file piece by
piece and holds a record at a time. Whole records are parsed where the file is read; only segmented
ones are shuffled.

Defined results: a null html has an empty payload, a null url an empty target. Every row gives
a record. Rows that share a page id and a payload are all responses, or all revisits of an
earlier page's; one of them has the plain record id, the others' ids are marked as copies. With
different payloads they are told apart by payload. A null id sorts first. An
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_blocks, partitions, rows, scratch, stored, table, utf8

SEGMENT_BYTES, CHUNK_BYTES, LEAST_REVISIT = 16_384, 4096, 0
#: Records of a file, each of a segment at most, and compressed bytes that the reader unpacks at a time.
FILE_RECORDS, PIECE_BYTES = 4096, 65_536
NO_ID = -(2**63)
_DATE = b"2024-01-01T00:00:00Z"
_BREAK = b"\r\n"
_NUMBER = re.compile(rb"-?[0-9]{1,19}")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Payload of a body in chunked transfer framing; raises ValueError if the framing is broken."""
    at, out = 0, []
    while True:
        end = body.index(_BREAK, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)  # trailers, if any, carry no payload
        if body[at + size : at + size + 2] != _BREAK:
            raise ValueError("a chunk doesn't end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: bytes, name: str, block: bytes, *more: tuple[bytes, object]) -> bytes:
    """A record without the line feed that ends it."""
    fields = [(b"WARC-Type", kind), (b"WARC-Record-ID", f"<urn:wayfarer:{name}>"), (b"WARC-Date", _DATE), *more, (b"Content-Length", len(block))]
    head = b"".join(k + b": " + (v if isinstance(v, bytes) else str(v).encode()) + _BREAK for k, v in fields)
    return b"WARC/1.1\r\n" + head + _BREAK + block + b"\r\n\r"


def response(page: int, url: str, payload: bytes, segment_bytes: int, copy: str = ""):
    digest = digest_of(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    name = f"{page}-{digest}{copy}"
    about = [(b"WARC-Target-URI", " ".join(url.split())), (b"WARC-Payload-Digest", f"sha1:{digest}"), (b"X-Page", page)]
    for i, part in enumerate(parts):
        more = [(b"WARC-Segment-Number", i + 1)] if len(parts) > 1 else []
        if i:
            more.append((b"WARC-Segment-Origin-ID", f"<urn:wayfarer:{name}>"))
        if i and i == len(parts) - 1:
            more.append((b"WARC-Segment-Total-Length", len(block)))
        yield record(b"continuation" if i else b"response", f"{name}-{i + 1}" if i else name, part, *(about if not i else about[:1]), *more)


def unpacked(content: bytes) -> Iterator[bytes]:
    """What a file holds, piece by piece: of a gzip file all members, one after another."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    at = 0
    while at < len(content):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(content):
                raise ValueError("the file ends within a gzip member")
            piece = content[at : at + PIECE_BYTES]
            at += len(piece)
            if data := member.decompress(piece):
                yield data
        at -= len(member.unused_data)
        while content[at : at + 1] in (b"\0", b"\r", b"\n"):  # some writers pad
            at += 1


def fields_of(head: bytes) -> dict[bytes, bytes]:
    """Header fields by their names in lower case; a line that begins with white space continues the one before."""
    out: dict[bytes, bytes] = {}
    name = b""
    for line in head.split(_BREAK)[1:]:
        if line[:1] in (b" ", b"\t") and name:
            out[name] += b" " + line.strip()
        else:
            name, _, value = line.partition(b":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def parse(pieces: bytes | Iterable[bytes]) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(fields, block) of each record; raises ValueError where the archive is broken. Holds a record and a piece at a time."""
    source, held, before = iter([pieces] if isinstance(pieces, bytes) else pieces), bytearray(), 0

    def have(n: int) -> bool:
        while len(held) < n and (piece := next(source, None)) is not None:
            held.extend(piece)
        return len(held) >= n

    while have(1):
        searched = 0
        while (end := held.find(b"\r\n\r\n", max(0, searched - 3))) < 0:
            searched = len(held)
            if not have(searched + 1):
                raise ValueError(f"no record at byte {before}")
        if not held.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {before}")
        fields = fields_of(bytes(held[:end]))
        size = int(fields[b"content-length"])
        if not have(end + 8 + size) or held[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {before} has another length than it states")
        yield fields, bytes(held[end + 4 : end + 4 + size])
        before += end + 8 + size
        del held[: end + 8 + size]


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"chunked" in fields_of(head).get(b"transfer-encoding", b"").lower() else body


def write_archives(pages: DataFrame, path: str, least_revisit: int = LEAST_REVISIT, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes a record per row of pages (page_id, url, html)."""
    html = F.coalesce("html", F.lit(""))
    wanted = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    sums = stored(wanted.select("page", F.octet_length("html").alias("bytes"), F.sha1("html").alias("sha")), "payload-digests")
    groups = stored(sums.groupBy("bytes", "sha").agg(F.min("page").alias("first"), F.count("*").alias("n")).filter("n > 1"), "equal-payloads")
    keys = groups.filter(F.col("bytes") >= least_revisit).select("bytes", "sha", "first")
    # the few groups of equal payloads meet the pages; whoever isn't the first of its group is a revisit
    again = F.coalesce(F.col("page") != F.col("first"), F.lit(False))

    def write(batches):
        for batch in in_blocks(batches, "html"):
            out = []
            sha = batch.column("sha").to_pylist()
            for page, url, html, first, x, n in zip(batch.column("page").to_pylist(), batch.column("url").to_pylist(), utf8(batch.column("html")), batch.column("first").to_pylist(), sha, batch.column("copy").to_pylist()):
                copy = "" if n is None else f"-copy{n}"
                if first is None:
                    out += response(page, url, html, segment_bytes, copy)
                else:
                    digest = base64.b32encode(bytes.fromhex(x)).decode()
                    out.append(record(b"revisit", f"{page}-{digest}-revisit{copy}", b"", (b"WARC-Target-URI", " ".join(url.split())), (b"WARC-Payload-Digest", f"sha1:{digest}"), (b"X-Page", page), (b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), (b"WARC-Refers-To", f"<urn:wayfarer:{first}-{digest}>")))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    marked = wanted.withColumns({"bytes": F.octet_length("html"), "sha": F.sha1("html")}).join(keys, ["bytes", "sha"], "left")
    marked = marked.select("page", "url", F.when(~again, F.col("html")).alias("html"), F.when(again, F.col("first")).alias("first"), "bytes", "sha")
    key = ["page", "bytes", "sha"]
    repeated = stored(sums.join(groups, ["bytes", "sha"], "left_semi").groupBy(*key).count().filter("count > 1").select(*key, F.lit(True).alias("repeated")), "repeated-pages")
    if repeated.isEmpty():
        marked = marked.withColumn("copy", F.lit(None).cast("long"))
    else:
        # repeated rows are numbered once and stored; the least number of a group keeps the plain record id
        marked = marked.join(repeated, key, "left")
        numbered = stored(marked.filter("repeated").withColumn("number", F.monotonically_increasing_id()), "repeated-rows")
        plain = numbered.groupBy(*key).agg(F.min("number").alias("plain"))
        numbered = numbered.join(plain, key).withColumn("copy", F.when(F.col("number") != F.col("plain"), F.col("number")))
        marked = marked.filter("repeated is null").withColumn("copy", F.lit(None).cast("long")).drop("repeated").unionByName(numbered.drop("repeated", "number", "plain"))
    marked.mapInArrow(write, "value binary").select(F.col("value").cast("string")).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every archived page."""
    schema = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("page", pa.int64()), ("bytes", pa.int64()), ("digest", pa.string()), ("kind", pa.string()), ("refers", pa.int64())])
    ddl = "origin string, segment int, total long, block binary, page long, bytes long, digest string, kind string, refers long"

    def whole(page: int | None, claimed: str, payload: bytes) -> dict:
        digest = digest_of(payload)
        if claimed.lower().startswith("sha1:") and claimed[5:] != digest:
            raise ValueError(f"page {page}: its payload has another digest than its record states")
        return {"page": page, "bytes": len(payload), "digest": digest, "kind": "response"}

    def number(x: bytes | None) -> int | None:
        return int(x) if x is not None and _NUMBER.fullmatch(x) else None

    def batch_of(found: list[dict]) -> pa.RecordBatch:
        return rows(schema, {f.name: [x.get(f.name) for x in found] for f in schema})

    def read(batches):
        for batch in batches:
            for content in batch.column("content"):
                found, size = [], 0
                for fields, block in parse(unpacked(content.as_py())):
                    kind, page, digest = fields[b"warc-type"].lower(), number(fields.get(b"x-page")), fields.get(b"warc-payload-digest", b"").decode()
                    if kind == b"revisit":
                        refers = fields.get(b"warc-refers-to", b"").strip(b"<>").split(b":")[-1].rsplit(b"-", 1)[0]
                        found.append({"page": page, "digest": digest.split(":")[-1], "kind": "revisit", "refers": number(refers)})
                    elif kind not in (b"response", b"continuation"):
                        continue  # warcinfo, request, metadata and the like hold no page
                    elif b"warc-segment-number" not in fields:
                        found.append(whole(page, digest, payload_of(block)))
                    else:
                        origin = fields.get(b"warc-segment-origin-id", fields[b"warc-record-id"]).decode()
                        about = {"page": page, "digest": digest} if kind == b"response" else {}
                        found.append(about | {"origin": origin, "segment": int(fields[b"warc-segment-number"]), "total": number(fields.get(b"warc-segment-total-length")), "block": block})
                        size += len(block)
                    if size > 2_000_000 or len(found) > 4096:
                        yield batch_of(found)
                        found, size = [], 0
                yield batch_of(found)

    def assemble(batches):
        """Segments arrive by origin and number; several rows of one number are copies of a record."""
        parts, about = [], {}

        def close():
            block = b"".join(parts)
            if about.get("total") != len(block):
                raise ValueError(f"{about.get('origin')}: its segments make {len(block)} bytes of {about.get('total')}")
            return whole(about.get("page"), about.get("digest", ""), payload_of(block))

        done = []
        for batch in batches:
            for x in batch.to_pylist():
                if about and x["origin"] != about["origin"]:
                    done.append(close())
                    parts, about = [], {}
                about.setdefault("origin", x["origin"])
                if x["segment"] == len(parts):
                    continue
                if x["segment"] != len(parts) + 1:
                    raise ValueError(f"{x['origin']}: segment {len(parts) + 1} is missing")
                parts.append(x["block"])
                about |= {k: x[k] for k in ("page", "digest", "total") if x[k] is not None}
            yield batch_of(done)
            done = []
        if about:
            yield batch_of([close()])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    read_back = stored(files.mapInArrow(read, ddl), "records")
    segments = read_back.filter("origin is not null").repartition(2 * partitions(spark), "origin").sortWithinPartitions("origin", "segment")
    found = stored(read_back.filter("origin is null").unionByName(segments.mapInArrow(assemble, ddl)).select("page", "bytes", "digest", "kind", "refers"), "archived-pages")
    answers = found.filter("kind = 'response'")
    target = answers.select(F.col("page").alias("refers"), "digest", F.col("bytes").alias("known")).dropDuplicates(["refers", "digest"])
    revisits = found.filter("kind = 'revisit'").join(target, ["refers", "digest"], "left").withColumn("bytes", F.col("known"))
    out = answers.unionByName(revisits.select(*answers.columns))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("page").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), real("refers").alias("refers_to"))


def op8(spark, sf_dir):
    """Contract op8: every page as read back from the archives."""
    path = scratch(spark, "archives")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_archives(spark, path)


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p),
v AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(x, (5 * i + 1)::INT, 5))::INT) AS g FROM s)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(g, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 10) % 32 + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 5) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM v
"""

"""WARC archives of pages: written with segments, read back by segment reassembly.

Writing: of pages with equal payloads the one with the largest id is a response record, the others revisit
it (pages below ``revisit_from`` bytes are all responses). A response's block is an HTTP message in chunked
transfer framing; a block of more than ``segment_bytes`` is cut into a first record with
``WARC-Segment-Number: 1`` and continuation records that name its id as ``WARC-Segment-Origin-ID``, the
last with ``WARC-Segment-Total-Length``. Archives are gzip files of whole records, each ended by two line
breaks, written by Spark's text writer; ``records_per_file`` bounds a file, so that a record's segments
may lie in several.

Reading: Spark hands whole archives to tasks, which cut them by ``Content-Length``. Records are grouped by
origin id (an unsegmented one by its own id, decoded at once, so that only long blocks are shuffled),
their segments ordered by number, the total length verified, the chunked framing decoded, and the payload's
SHA-1 held against the record's. A revisit takes length and page of the response that it refers to by an
equi-join on the record id, which Spark splits where one response has many.

Only keys and counts of copies are shuffled, and one payload of each group of equal ones a task.

Defined cases: null html is an empty payload; a null url leaves the target out; a null ``page_id`` is
less than any other; rows equal in id and payload are told apart by url (null first), equal rows by their
number, and the last is the response; an empty table gives no archives and an empty result. A record that
cannot be put together (a segment missing, twice or unequal, a wrong length, framing or digest) keeps its row with
a null payload and names its ``fault``; a file that is no WARC raises an error. Other columns are not read.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import checkpointed, read, removed, shared_folder, small_batches

VERSION = b"WARC/1.1"
#: Bytes of a record's block, of a chunk of the transfer framing, and records of a file.
SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
RECORDS_PER_FILE = 4096
#: Payloads of fewer bytes are not looked for among others.
REVISIT_FROM = 0
DATE = "1970-01-01T00:00:00Z"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n"
#: Records that a reading task returns at once.
BATCH = 512


def record_id(*parts: Column) -> Column:
    """A UUID of the parts, the same whenever a task runs again."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts]))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in cuts])


def records(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """(record_id, kind, page_id, url, payload, sha1, refers_to): what is to be written for each page."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("same"), F.sha1("payload").alias("sha1"))
    own = ["same", "page_id", "url"]

    def copies(counted: DataFrame) -> DataFrame:
        return counted.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))

    out = ["record_id", "kind", "page_id", "url", "payload", "sha1", "refers_to"]
    large = rows.where(F.octet_length("payload") >= revisit_from) if revisit_from > 0 else rows
    first = large.groupBy("same").agg(F.first("payload").alias("payload"), F.first("sha1").alias("sha1"), F.max(F.struct("page_id", "url")).alias("top"))
    responses = first.select(record_id(F.lit("response"), F.col("same")).alias("record_id"), F.lit("response").alias("kind"),
                             "top.page_id", "top.url", "payload", "sha1", F.lit(None).cast("string").alias("refers_to"))
    counted = large.groupBy(*own).agg(F.count("*").alias("copies"), F.first("sha1").alias("sha1"))
    tops = counted.groupBy("same").agg(F.max(F.struct("page_id", "url")).alias("top"))
    others = counted.join(tops, "same").withColumn("copies", F.col("copies") - (F.struct("page_id", "url").eqNullSafe(F.col("top"))).cast("long"))
    revisits = copies(others).select(
        record_id(F.lit("revisit"), *map(F.col, own), F.col("copy")).alias("record_id"), F.lit("revisit").alias("kind"), "page_id", "url",
        F.lit(None).cast("string").alias("payload"), "sha1", record_id(F.lit("response"), F.col("same")).alias("refers_to"))
    found = responses.select(*out).unionByName(revisits.select(*out))
    if revisit_from > 0:
        small = rows.where(F.octet_length("payload") < revisit_from).groupBy(*own).agg(
            F.count("*").alias("copies"), F.first("payload").alias("payload"), F.first("sha1").alias("sha1"))
        found = found.unionByName(copies(small).select(
            record_id(F.lit("small"), *map(F.col, own), F.col("copy")).alias("record_id"), F.lit("response").alias("kind"), "page_id", "url",
            "payload", "sha1", F.lit(None).cast("string").alias("refers_to")).select(*out))
    return found


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        some = payload[at: at + size]
        parts += [b"%x\r\n" % len(some), some, END]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    at, parts = 0, []
    while True:
        line = body.index(END, at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            break
        parts.append(body[at: at + size])
        if len(parts[-1]) < size or body[at + size: at + size + 2] != END:
            raise ValueError("a chunk is cut short")
        at += size + 2
    if body[at: at + 2] != END and not body.endswith(b"\r\n\r\n"):
        raise ValueError("the last chunk has no end")
    return b"".join(parts)


def target(url: str) -> bytes:
    """The URL with everything that a header cannot hold in percent code."""
    return b"".join(bytes([b]) if 32 < b < 127 else b"%%%02X" % b for b in url.encode())


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def headed(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    lines = [VERSION, *[k + b": " + v for k, v in fields], b"Content-Length: %d" % len(block)]
    return END.join(lines) + END + END + block


def written(rid: str, kind: str, page_id: int | None, url: str | None, payload: str | None, sha1: str, refers_to: str | None,
            segment_bytes: int, chunk_bytes: int, date: str) -> Iterator[bytes]:
    """The records of one page, without the line breaks that end each."""
    message = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8"]
    fields = [(b"WARC-Type", kind.encode()), (b"WARC-Record-ID", b"<urn:uuid:%s>" % rid.encode()), (b"WARC-Date", date.encode()),
              (b"WARC-Payload-Digest", b"sha1:" + base32(bytes.fromhex(sha1)).encode()), (b"Content-Type", b"application/http;msgtype=response")]
    if url is not None:
        fields.append((b"WARC-Target-URI", target(url)))
    if page_id is not None:
        fields.append((b"X-Page-ID", b"%d" % page_id))
    if refers_to is not None:
        fields += [(b"WARC-Refers-To", b"<urn:uuid:%s>" % refers_to.encode()), (b"WARC-Profile", PROFILE)]
        block = END.join(message) + END + END
    else:
        block = END.join([*message, b"Transfer-Encoding: chunked"]) + END + END + chunked(payload.encode(), chunk_bytes)
    if len(block) <= segment_bytes:
        yield headed(fields, block)
        return
    yield headed([*fields, (b"WARC-Segment-Number", b"1")], block[:segment_bytes])
    last = (len(block) - 1) // segment_bytes
    for k in range(1, last + 1):
        more = [(b"WARC-Type", b"continuation"), (b"WARC-Record-ID", b"<urn:uuid:%s>" % str(uuid.uuid5(uuid.UUID(rid), str(k))).encode()),
                (b"WARC-Date", date.encode()), (b"WARC-Segment-Origin-ID", b"<urn:uuid:%s>" % rid.encode()), (b"WARC-Segment-Number", b"%d" % (k + 1))]
        if k == last:
            more.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        yield headed(more, block[k * segment_bytes: (k + 1) * segment_bytes])


def write_archives(pages: DataFrame, folder: str, revisit_from: int = REVISIT_FROM, segment_bytes: int = SEGMENT_BYTES,
                   chunk_bytes: int = CHUNK_BYTES, records_per_file: int = RECORDS_PER_FILE, date: str = DATE) -> None:
    """Archives of all pages (page_id, url, html) in an unused folder that all executors share."""
    def run(batches):
        for batch in batches:
            for rows in (batch.slice(i, BATCH) for i in range(0, batch.num_rows, BATCH)):
                done = [r for row in zip(*(c.to_pylist() for c in rows.columns)) for r in written(*row, segment_bytes, chunk_bytes, date)]
                yield pa.record_batch([pa.array(done, pa.binary())], ["record"])

    found = small_batches(records(pages, revisit_from)).mapInArrow(run, "record binary")
    (found.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(folder))


def unzipped(data: bytes) -> bytes:
    """The bytes of a gzip file of any number of members; of another file, the file's."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts = []
    while data:
        member = zlib.decompressobj(wbits=31)
        parts.append(member.decompress(data))
        data = member.unused_data
    return b"".join(parts)


def parsed(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes, bool]]:
    """(header fields by lower-case name, block, whether the block is whole) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].split(END)
        if end < 0 or not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines[1:])}
        if not fields.get(b"content-length", b"").isdigit():
            raise ValueError(f"no length of the record at byte {at}")
        size = int(fields[b"content-length"])
        yield fields, data[end + 4: end + 4 + size], end + 4 + size <= len(data)
        at = end + 4 + size + 4


def bare(uri: bytes | None) -> str | None:
    """The UUID of ``<urn:uuid:...>``."""
    return None if uri is None else uri.decode().strip("<>").removeprefix("urn:uuid:")


def decoded(block: bytes, digest: str | None) -> tuple[bytes | None, str | None]:
    """(payload, fault) of an HTTP message."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None, "no HTTP message"
    if any(x.lower().startswith(b"transfer-encoding:") and b"chunked" in x.lower() for x in head.split(END)):
        try:
            body = dechunked(body)
        except ValueError:
            return None, "broken chunks"
    if digest is not None and base32(hashlib.sha1(body).digest()) != digest:
        return None, "another digest"
    return body, None


def reassembled(parts: list[tuple[int, int | None, bytes]]) -> tuple[bytes | None, str | None]:
    """(block, fault) of segments (number, total length or None, block) in any order; equal ones count once."""
    parts = sorted(set(parts), key=lambda p: p[0])
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)) or [p[1] is not None for p in parts[:-1]].count(True) or parts[-1][1] is None:
        return None, "segments missing or unequal"
    block = b"".join(p[2] for p in parts)
    return (block, None) if len(block) == parts[-1][1] else (None, "another length")


PART = "kind string, page_id long, refers_to string, digest string, segment long, total long, block binary, payload_bytes long, payload binary, fault string"


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """(record_id, kind, page_id, refers_to, digest, payload_bytes, payload, fault): the archives' records, put together.

    ``payloads``: carry them; else ``payload`` is null.
    """
    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for fields, block, whole in parsed(unzipped(batch.column(0)[i].as_py())):
                    rows.append(row_of(fields, block, whole))
                    if len(rows) == BATCH:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    def row_of(fields, block, whole):
        own, kind = bare(fields.get(b"warc-record-id")), fields.get(b"warc-type", b"").decode()
        digest = fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:") or None
        page = int(fields[b"x-page-id"]) if b"x-page-id" in fields else None
        segment = int(fields[b"warc-segment-number"]) if b"warc-segment-number" in fields else None
        total = int(fields[b"warc-segment-total-length"]) if b"warc-segment-total-length" in fields else None
        payload, fault = None, None if whole else "cut short"
        if segment is None and kind == "response" and not fault:
            payload, fault = decoded(block, digest)
        return (bare(fields.get(b"warc-segment-origin-id")) or own, kind, page, bare(fields.get(b"warc-refers-to")), digest, segment, total,
                None if segment is None else block, None if payload is None else len(payload), payload if payloads else None, fault)

    names = ["record_id", *[x.split()[0] for x in PART.split(", ")]]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.string()]

    def batch_of(rows):
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").load(folder).select("content")
    found = small_batches(files).mapInArrow(cut, f"record_id string, {PART}")
    together = found.groupBy("record_id").agg(F.collect_set(F.struct(*names[1:])).alias("parts"))

    def assemble(batches):
        for batch in batches:
            rows = []
            for own, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                head = next((p for p in parts if p["kind"] != "continuation"), parts[0])
                payload, size, fault = head["payload"], head["payload_bytes"], next((p["fault"] for p in parts if p["fault"]), None)
                if any(p["segment"] is not None for p in parts) and not fault:
                    block, fault = reassembled([(p["segment"] or 0, p["total"], p["block"] or b"") for p in parts])
                    if not fault and head["kind"] == "response":
                        payload, fault = decoded(block, head["digest"])
                        size = None if payload is None else len(payload)
                elif len(parts) > 1 and not fault:
                    fault = "one id, unequal records"
                if fault:
                    payload = size = None
                rows.append((own, head["kind"], head["page_id"], head["refers_to"], head["digest"], size, payload if payloads else None, fault))
            out = [kinds[names.index(n)] for n in kept]
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), out)], kept)

    kept = ["record_id", "kind", "page_id", "refers_to", "digest", "payload_bytes", "payload", "fault"]
    return small_batches(together).mapInArrow(assemble, "record_id string, kind string, page_id long, refers_to string, digest string, payload_bytes long, "
                                                        "payload binary, fault string")


def resolved(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, fault): revisits with what they refer to."""
    heads = found.where("kind = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("first_page"), F.col("payload_bytes").alias("first_bytes"), F.col("digest").alias("first_digest"))
    responses = found.where("kind = 'response'").select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "fault")
    joined = found.where("kind = 'revisit'").join(heads, "refers_to", "left")
    fault = F.when(F.col("first_bytes").isNull(), "no response").when(~F.col("digest").eqNullSafe(F.col("first_digest")), "another digest")
    revisits = joined.select("page_id", F.col("first_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                             F.col("kind").alias("record_type"), F.col("first_page").alias("refers_to"), F.coalesce("fault", fault).alias("fault"))
    return responses.unionByName(revisits)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from its archive."""
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(read(spark, sf_dir, "pages"), folder)
    # narrow rows, read twice by the join
    found = checkpointed(read_archives(spark, folder))
    removed(spark, folder)
    return resolved(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, {5 * i + 1}, 5))::bigint // {32 ** (3 - j)}) % 32 + 1, 1)"
    for i in range(8) for j in range(4))

OP11_SQL = f"""
select page_id, n as payload_bytes, {_BASE32} as payload_digest,
       case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id <> last then last end as refers_to
from (select page_id, octet_length(encode(coalesce(html, '')))::bigint as n, sha1(coalesce(html, '')) as h,
             max(page_id) over (partition by coalesce(html, '')) as last from pages) p"""

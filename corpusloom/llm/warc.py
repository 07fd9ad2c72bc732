"""WARC archives with the index first.

Pages are written as WARC 1.1 records, each a gzip member of its own, into archives in the shared folder; the writers
give back an index row for each record: archive, offset, length, URL and digest. Reading starts from the index: the
byte ranges of the selected records are sorted by archive and offset, neighbouring ones are coalesced into one read,
and the records are cut out of what was read. Records with a payload seen before are revisits.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, scratch, table

#: Payloads of fewer bytes are never revisited.
LEAST_BYTES = 0
#: Bytes of an archive until a new one is begun; of a coalesced read at most (a longer record is read alone); of a gap
#: that is read over.
ARCHIVE_BYTES, READ_BYTES, GAP_BYTES = 256 << 20, 8 << 20, 64 << 10
#: Repeated payloads that are sent to all tasks at most (60 bytes each); of more, pages are shuffled by digest.
SENT_DIGESTS = 100_000
DATE = "1970-01-01T00:00:00Z"
_CRLF = b"\r\n"
#: Fixed value: RFC 4648's alphabet.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_INDEX = "archive string, offset bigint, length bigint, url string, digest string, page_id {id}, record_type string"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32 of a binary column: five hex digits are four of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def plan(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages (page_id, url, html) as records to write: page_id, url, payload, digest, refers_to (null for responses).

    Of equal payloads the smallest page_id is the response. Rows that repeat its id are responses too. A null id
    revisits where another has the payload; a null html is an empty payload. Only payloads that come more than once
    have to be looked up: where they are few, the table of them goes to the pages and no page is moved.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    first = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    first = materialise(first.where("_n > 1 and _first is not null").select("digest", "_first"), "warc-repeated")
    first = F.broadcast(first) if first.count() <= SENT_DIGESTS else first.hint("merge")
    return rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", F.when(~F.col("_first").eqNullSafe(F.col("page_id")), F.col("_first")).alias("refers_to"))


def _uri(page_id) -> bytes:
    """A page's identifier as a URI; characters of text ids that URIs or header lines can't hold are percent-encoded."""
    return b"<urn:x-no-page:>" if page_id is None else f"<urn:x-page:{quote(str(page_id), safe='')}>".encode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """The bytes of one record. A revisit holds the HTTP header alone, which still tells the payload's length."""
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "about:blank")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        b"WARC/1.1", b"WARC-Type: " + (b"revisit" if refers_to is not None else b"response"), b"WARC-Record-ID: " + _uri(page_id), b"WARC-Date: " + DATE.encode(),
        b"WARC-Target-URI: " + safe.encode(), b"WARC-Payload-Digest: sha1:" + digest.encode(), b"Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [b"WARC-Refers-To: " + _uri(refers_to), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return _CRLF.join([*head, b"Content-Length: %d" % len(block), b"", block, b"", b""])


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers by lower-case name, HTTP header, payload) of a record's bytes."""
    head, _, rest = raw.partition(_CRLF * 2)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(_CRLF * 2)
    return headers, http, payload


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write planned records into archives under folder; the index, as a table in the shared folder.

    An archive's name is its writer's alone, so an attempt that is lost or repeated leaves at most an archive that no
    index row names. folder is any URI that pyarrow's file systems know.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name, out, at = "", None, 0
        try:
            for batch in batches:
                rows = []
                for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    member = _member(record(*r))
                    out.write(member)
                    rows.append((name, at, len(member), r[1], r[3], r[0], "response" if r[4] is None else "revisit"))
                    at += len(member)
                if rows:
                    cols = list(zip(*rows))
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), batch.schema.field("page_id").type, pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["archive", "offset", "length", "url", "digest", "page_id", "record_type"])
        finally:
            if out is not None:
                out.close()

    return materialise(records.mapInArrow(run, _INDEX.format(id=records.schema["page_id"].dataType.simpleString())), "warc-index")


def ranges(index: DataFrame) -> DataFrame:
    """Coalesced reads (archive, begin, end, members) of index rows; members are (offset, length), in order.

    A read ends where the gap to the next record exceeds GAP_BYTES or a multiple of READ_BYTES is crossed, so each
    is bounded, whatever is selected. A record that is selected twice is read once and returned twice.
    """
    order = Window.partitionBy("archive").orderBy("offset")
    jump = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(order)
    cut = F.coalesce(((jump > GAP_BYTES) | (F.floor(F.col("offset") / READ_BYTES) != F.floor(F.lag("offset").over(order) / READ_BYTES))).cast("int"), F.lit(1))
    runs = index.select("archive", "offset", "length").withColumn("_cut", cut).withColumn("_run", F.sum("_cut").over(order))
    return runs.groupBy("archive", "_run").agg(
        F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("end"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("members")
    ).drop("_run")


def read(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of index rows: page_id (as text), payload_bytes, payload_digest, record_type, refers_to, url, and the payload if asked for.

    A response's length and digest are taken anew from its payload and must agree with its header; a revisit has
    those of its headers.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * with_payload
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * with_payload

    def page(uri: str | None) -> str | None:
        return None if uri is None or uri == "<urn:x-no-page:>" else unquote(uri.removeprefix("<urn:x-page:").removesuffix(">"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        opened: dict[str, pa.NativeFile] = {}
        for batch in batches:
            for archive, begin, end, members in zip(*(batch.column(c).to_pylist() for c in ("archive", "begin", "end", "members"))):
                if archive not in opened:
                    for f in opened.values():
                        f.close()
                    opened = {archive: fs.open_input_file(f"{base}/{archive}")}
                opened[archive].seek(begin)
                piece = opened[archive].read(end - begin)
                rows = []
                for m in members:
                    a = m["offset"] - begin
                    headers, http, payload = parse(zlib.decompress(piece[a : a + m["length"]], 31))
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    if headers["warc-type"] == "response":
                        n = len(payload)
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"digest of {headers['warc-record-id']} in {archive} at {m['offset']}")
                    else:
                        n = int(re.search(rb"(?i)^content-length: *(\d+)", http, re.M)[1])
                    rows.append((page(headers["warc-record-id"]), n, digest, headers["warc-type"], page(headers.get("warc-refers-to")), headers["warc-target-uri"]) + (payload,) * with_payload)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        for f in opened.values():
            f.close()

    schema = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, url string" + ", payload binary" * with_payload
    return ranges(index).mapInArrow(run, schema)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write all pages, and read all of them back through the index: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    A row for each page, repeated and null ids included; an empty table gives an empty one. Columns other than page_id,
    url and html are not read.
    """
    folder = scratch(pages.sparkSession, "warc")
    id_type = pages.schema["page_id"].dataType.simpleString()
    found = read(write(plan(pages), folder), folder)
    return found.select(F.col("page_id").cast(id_type), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type), "url")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: a record of every page as read back from archives. See plan() and archive_and_read()."""
    return archive_and_read(table(spark, sf_dir, "pages")).drop("url")


SQL = """
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as d from pages),
bits as (select *, array_to_string(list_transform(string_split(d, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', c) - 1) + 1, 4)), '') as b from p),
named as (select page_id, strlen(h) as n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + list_sum(list_transform(range(0, 5), lambda j: cast(substr(b, 5 * i + j + 1, 1) as integer) * (1 << (4 - j))))::integer, 1)), '') as digest from bits),
f as (select *, min(page_id) over (partition by digest) as first from named)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to from f
"""

"""Legacy web archives: ARC files written and parsed, converted to WARC records, written and read back."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.shared import store
from lectern.session import work_folder

#: Payloads of at least so many bytes become a revisit of an equal one.
REVISIT_BYTES = 1000
#: The capture time that converted pages without one get.
CAPTURED = "20240101000000"
# The URL-record fields of the two versions of the legacy format, and the field list that states them.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
VERSION_BLOCK = {"1": "1 0 lectern", "2": "2 0 lectern"}
CHUNK = 1 << 20
#: Archives are written at this level of compression: pages are written twice and read twice, and level 6 takes half as long again for 4 % less size.
LEVEL = "FOUR"


class Bytes:
    """The uncompressed bytes of a gzip file, some at a time; only what the caller asks for is held."""

    def __init__(self, packed: bytes):
        self.packed, self.at, self.out = packed, 0, b""
        self.unzip = zlib.decompressobj(wbits=31)

    def more(self) -> bool:
        while True:
            if self.unzip.unconsumed_tail:
                got = self.unzip.decompress(self.unzip.unconsumed_tail, CHUNK)
            elif self.unzip.eof:  # the next member of the file
                rest = self.unzip.unused_data
                if not rest and self.at >= len(self.packed):
                    return False
                self.unzip = zlib.decompressobj(wbits=31)
                self.at -= len(rest)
                continue
            elif self.at < len(self.packed):
                piece = self.packed[self.at : self.at + CHUNK]
                self.at += len(piece)
                got = self.unzip.decompress(piece, CHUNK)
            else:
                return False
            if got:
                self.out += got
                return True

    def line(self, end: bytes) -> bytes | None:
        """Up to `end`, which is dropped; None at the end of the file."""
        while (k := self.out.find(end)) < 0:
            if not self.more():
                rest, self.out = self.out, b""
                return rest or None
        found, self.out = self.out[:k], self.out[k + len(end) :]
        return found

    def take(self, n: int) -> bytes:
        parts = [self.out]
        have = len(self.out)
        while have < n:
            self.out = b""
            if not self.more():
                raise ValueError(f"a record ends {n - have} bytes early")
            parts.append(self.out)
            have += len(self.out)
        data = b"".join(parts)
        found, self.out = data[:n], data[n:]
        return found


def arc_records(packed: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of each document of an ARC file, by its declared lengths.

    The version block states the fields of the URL-record lines that follow.
    """
    source, fields = Bytes(packed), None
    while (line := source.line(b"\n")) is not None:
        if not line.strip():
            continue
        parts = line.decode("utf-8").split(" ")
        content = source.take(int(parts[-1]))
        if fields is None:
            version = content.split(b" ", 1)[0].decode()
            if not parts[0].startswith("filedesc:") or version not in ARC_FIELDS:
                raise ValueError("no version block at the start of the file")
            fields = content.decode("utf-8").split("\n")[1].split(" ")
            continue
        if len(parts) != len(fields):
            raise ValueError(f"{len(parts)} header fields, {len(fields)} declared")
        yield dict(zip(fields, parts)), content


def warc_records(packed: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (names in lower case) and block of each record of a WARC file, by its declared lengths."""
    source = Bytes(packed)
    while (line := source.line(b"\r\n")) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record does not start with its version")
        fields = {}
        while line := source.line(b"\r\n"):
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, source.take(int(fields["content-length"]))


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields of an HTTP response, its head with the blank line, its body."""
    head, blank, body = block.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, head + blank, body


def iso_time(stamp: str) -> str:
    """14 digits as the time format of the newer format; a stamp that is no time is read as the epoch."""
    try:
        moment = datetime.strptime(stamp[:14].ljust(14, "0"), "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc)
    except ValueError:
        moment = datetime.fromtimestamp(0, timezone.utc)
    return moment.strftime("%Y-%m-%dT%H:%M:%SZ")


def base32_sha1(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def record_id(file: str, place: int, url: str, stamp: str, digest: str) -> str:
    """An identifier that a repeated conversion gives again."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{place} {url} {stamp} {digest}')}"


# -- ARC -----------------------------------------------------------------------------------------------------------


def write_arc(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write `pages` as gzip ARC files below `folder`, one file a partition; versions 1 and 2 take turns.

    A document is the HTTP response of the page. URLs are percent-encoded where a header line needs it; a null URL
    is written as `urn:none`. The key travels as a response header of its own.
    """
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    page = F.when(F.col(key).isNotNull(), F.concat(F.lit("X-Page-Id: "), F.col(key).cast("string"), F.lit("\r\n")))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), F.coalesce(page, F.lit("")),
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    rows = pages.select(F.col(url).cast("string").alias("url"), F.concat(head, body).alias("content"))
    rows = rows.withColumn("bytes", F.octet_length("content").cast("long"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        version = "12"[number % 2]
        name = f"pages-{number:06d}.arc.gz"
        desc = f"{VERSION_BLOCK[version]}\n{ARC_FIELDS[version]}\n".encode()
        plain = ["filedesc://" + name, "0.0.0.0", CAPTURED, "text/plain"]
        between = {"1": [], "2": ["200", "-", "-", "0", name]}[version]
        yield pa.RecordBatch.from_arrays([pa.array([" ".join([*plain, *between, str(len(desc))]).encode() + b"\n" + desc]).cast(pa.string())], ["value"])
        for batch in batches:
            out = []
            for address, content, size in zip(*(batch.column(c) for c in ("url", "content", "bytes"))):
                address = address.as_py()
                address = "urn:none" if address is None else quote(address, safe="!#$%&'()*+,-./:;=?@[]_~") or "urn:empty"
                fields = [address, "0.0.0.0", CAPTURED, "text/html", *between, str(size.as_py())]
                out.append(" ".join(fields).encode() + b"\n" + content.as_buffer().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    rows.mapInArrow(lines, "value string").write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", LEVEL).text(folder)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of a folder: path and bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")


def parse_arc(archives: DataFrame, *, content: bool) -> DataFrame:
    """One row for each document of the ARC files in `archives` (path, content).

    place is its number in the file; the bare hex digest and the size are those of the HTTP body. `content` says
    whether the document itself is wanted. Memory: one packed file and one document at a time.
    """
    schema = "file string, place long, page_id long, url string, stamp string, mime string, bytes long, digest string"
    schema += ", head string, body string" * content
    names = [f.split()[0] for f in schema.split(", ")]

    def rows(batches):
        for batch in batches:
            for path, packed in zip(batch.column("path"), batch.column("content")):
                file = path.as_py().rsplit("/", 1)[-1]
                group, size = [], 0
                for place, (fields, block) in enumerate(arc_records(packed.as_buffer().to_pybytes())):
                    http, head, body = http_parts(block)
                    page = http.get("x-page-id")
                    row = [file, place, int(page) if page else None, fields["URL"], fields["Archive-date"], fields["Content-type"], len(body), hashlib.sha1(body).hexdigest()]
                    group.append(row + [head, body] * content)
                    size += len(body) * content
                    if len(group) == 2000 or size > 8 * CHUNK:
                        yield packed_rows(group)
                        group, size = [], 0
                if group:
                    yield packed_rows(group)

    def packed_rows(group):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
        arrays = [pa.array(column, kind) for column, kind in zip(zip(*group), kinds)]
        arrays = [a.cast(pa.string()) if a.type == pa.binary() else a for a in arrays]
        return pa.RecordBatch.from_arrays(arrays, names)

    return archives.mapInArrow(rows, schema)


# -- WARC ----------------------------------------------------------------------------------------------------------


def convert(archives: DataFrame, folder: str, *, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Convert the ARC files in `archives` (path, content) to gzip WARC files below `folder`.

    Identifier, time, type, digests and lengths of each record are synthesised. Of equal bodies of at least
    `revisit_bytes`, the one with the largest page id (then the first place) is a response and the others revisit
    it, with the head of their response only.

    The choice is made on small rows, summed by digest before they are shuffled, and joined to the documents by
    their place, so copies of one body are spread over all tasks.
    """
    small = store(parse_arc(archives, content=False), "arc-places")
    rank = F.struct(F.coalesce("page_id", F.lit(-(2**63))), F.col("file"), -F.col("place"))
    long = small.where(F.col("bytes") >= revisit_bytes)
    first = long.groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.max_by(F.struct("file", "place", "url", "stamp"), rank).alias("kept"))
    first = first.where("n > 1").select("digest", "bytes", "kept")
    others = long.join(first, ["digest", "bytes"]).where("file <> kept.file OR place <> kept.place")
    others = others.select("file", "place", "kept")
    whole = parse_arc(archives, content=True).join(others, ["file", "place"], "left")

    def texts(batches):
        for batch in batches:
            out = []
            columns = [batch.column(c) for c in ("file", "place", "url", "stamp", "mime", "bytes", "digest", "kept")]
            heads, bodies = (batch.column(c) for c in ("head", "body"))
            for k in range(batch.num_rows):
                file, place, url, stamp, mime, _, digest, kept = (c[k].as_py() for c in columns)
                head = heads[k].as_buffer().to_pybytes()
                block = head if kept else head + bodies[k].as_buffer().to_pybytes()
                lines = [
                    "WARC/1.0", f"WARC-Type: {'revisit' if kept else 'response'}", f"WARC-Target-URI: {url}", f"WARC-Date: {iso_time(stamp)}",
                    f"WARC-Record-ID: <{record_id(file, place, url, stamp, digest)}>", "Content-Type: application/http; msgtype=response",
                    f"WARC-Payload-Digest: sha1:{base32_sha1(digest)}", f"WARC-Block-Digest: sha1:{base32_sha1(hashlib.sha1(block).hexdigest())}",
                    f"WARC-Identified-Payload-Type: {mime}", f"Content-Length: {len(block)}",
                ]
                if kept:
                    target = record_id(kept["file"], kept["place"], kept["url"], kept["stamp"], digest)
                    lines += [
                        "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <{target}>",
                        f"WARC-Refers-To-Target-URI: {kept['url']}", f"WARC-Refers-To-Date: {iso_time(kept['stamp'])}",
                    ]
                out.append("\r\n".join(lines).encode() + b"\r\n\r\n" + block)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    whole.mapInArrow(texts, "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", LEVEL).text(folder)


def read_warc(archives: DataFrame) -> DataFrame:
    """One row for each record of the WARC files in `archives` (path, content).

    A response's body is measured; a block or payload that doesn't match its stated digest is an error. A revisit
    states size and digest of the body it leaves out.
    """
    schema = "page_id long, record_type string, record_id string, refers_to_id string, url string, date string, payload_bytes long, payload_digest string"

    def rows(batches):
        for batch in batches:
            for packed in batch.column("content"):
                group = []
                for fields, block in warc_records(packed.as_buffer().to_pybytes()):
                    if fields["warc-block-digest"] != "sha1:" + base32_sha1(hashlib.sha1(block).hexdigest()):
                        raise ValueError(f"block digest of {fields['warc-record-id']}")
                    http, _, body = http_parts(block)
                    stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    kind, size = fields["warc-type"], int(http["content-length"])
                    if kind == "response" and (len(body), hashlib.sha1(body).hexdigest()) != (size, stated):
                        raise ValueError(f"payload digest of {fields['warc-record-id']}")
                    page = http.get("x-page-id")
                    group.append((int(page) if page else None, kind, fields["warc-record-id"], fields.get("warc-refers-to"), fields["warc-target-uri"], fields["warc-date"], size, stated))
                if group:
                    kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*group), kinds)], [f.split()[0] for f in schema.split(", ")])

    return archives.mapInArrow(rows, schema)


def archive_pages(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Archive `pages` in the legacy format, convert the archives to WARC, read those back; a row for each page.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url, date. A null or empty
    html has an empty payload, and an empty payload is always a response. Null keys rank lowest among equal
    payloads and stay null; rows that repeat a key are records of their own, of which the first one written ranks
    highest. A page that a revisit refers to may have a null key; then refers_to is null too. Other columns are not
    read. An empty table gives an empty table. The archives stay in the shared folder.
    """
    spark = pages.sparkSession
    legacy, modern = work_folder(spark, "arc"), work_folder(spark, "warc")
    write_arc(pages, legacy, key=key, url=url, html=html)
    convert(files(spark, legacy), modern, revisit_bytes=revisit_bytes)
    records = store(read_warc(files(spark, modern)), "warc-records")
    named = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    plain = records.where("refers_to_id IS NULL").withColumn("refers_to", F.lit(None).cast("long"))
    again = records.where("refers_to_id IS NOT NULL").join(named, "refers_to_id", "left")
    return plain.unionByName(again).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "date")


def archive_pages_query(pages: DataFrame) -> DataFrame:
    return archive_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archive_pages_sql() -> str:
    """`archive_pages_query` for DuckDB."""
    return f"""
WITH p AS (SELECT page_id, encode(COALESCE(html, '')) AS body FROM pages),
sized AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
ranked AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES}
                     THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS kept FROM sized)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM ranked"""

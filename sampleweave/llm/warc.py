"""WARC archives: a monolithic writer, the normaliser to one gzip member per record with an offset index, and the reader.

``write_monolithic`` lets Spark's own text writer make the archives: a row is a record, the line separator is the blank line that
ends a WARC record, and gzip makes one stream of each file. Such files cannot be entered anywhere but at their start.
``normalise`` inflates each stream once, in blocks of bounded size, writes every record as its own gzip member and beside
each archive a sidecar index (offset, length, record id, type, target). ``read_records`` enters the members by their offsets.

Archives lie in the shared folder. Tasks open them through pyarrow's file systems by URI; a file is written under a name of
its attempt and moved into place when it is whole, so a lost or repeated task leaves the same file.

Defined results: a null page is an empty payload; a null id is written as ``none`` and read back as null, a null address as
``about:blank``; line breaks in an address become spaces. Payloads of at least ``least`` bytes that are equal are
stored once, with the largest id; rows that repeat this id are responses as well. An empty table gives no archive and no row.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleweave.llm.common import column, map_rows
from sampleweave.session import cut, shared_folder, shuffle_width

#: fixed values of the format
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
END = "\r\n\r\n"
BLOCK = 1 << 18


@dataclass(frozen=True)
class WarcSettings:
    least: int = 1000  # smaller payloads are always stored
    date: str = "2024-01-01T00:00:00Z"
    level: int = 4


def described(pages: DataFrame, s: WarcSettings) -> DataFrame:
    """(id, url, payload, bytes, digest, refers_to): refers_to is null for responses. Payloads travel only if they repeat too often to broadcast who has them."""
    payload = F.coalesce(column(pages, "html", "string"), F.lit(""))
    rows = pages.select(column(pages, "page_id", "long").alias("id"), column(pages, "url", "string").alias("url"), payload.alias("payload"),
                        F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload.cast("binary")).alias("digest"))
    repeated = cut(rows.where(F.col("bytes") >= s.least).groupBy("digest", "bytes").agg(F.max("id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n"))
    known = rows.join(repeated, ["digest", "bytes"], "left")
    return known.withColumn("refers_to", F.when(F.col("kept").isNotNull() & ~F.col("id").eqNullSafe(F.col("kept")), F.col("kept"))).drop("kept")


def write_monolithic(pages: DataFrame, folder: str, s: WarcSettings = WarcSettings()) -> None:
    rows = described(pages, s)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), line("Content-Length", F.col("bytes").cast("string")), F.lit(CRLF))
    again = F.col("refers_to").isNotNull()
    body = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    size = F.octet_length(http) + F.when(again, 0).otherwise(F.col("bytes"))
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), "[\r\n]+", " ")
    head = F.concat(F.lit(VERSION + CRLF), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", urn(F.col("id"))),
                    line("WARC-Date", F.lit(s.date)), line("WARC-Target-URI", url), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
                    F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(""),
                    line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", size.cast("string")), F.lit(CRLF))
    rows.select(F.concat(head, body).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(folder)


def opened(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    if uri.startswith("file:") or "://" not in uri:
        return arrow_fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class Inflated:
    """A gzip stream of one or more members, read forward in bounded blocks."""

    def __init__(self, stream):
        self.stream, self.z, self.held = stream, zlib.decompressobj(31), b""

    def more(self) -> bool:
        while True:
            raw = self.z.unconsumed_tail or (self.z.unused_data if self.z.eof else b"") or self.stream.read(BLOCK)
            if not raw:
                return False
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            out = self.z.decompress(raw, BLOCK)
            if out:
                self.held += out
                return True

    def head(self) -> bytes | None:
        """Up to and including the next blank line; None at the end."""
        looked = 0
        while (at := self.held.find(END.encode(), max(0, looked - 3))) < 0:
            looked = len(self.held)
            if not self.more():
                return None
        out, self.held = self.held[:at + 4], self.held[at + 4:]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise EOFError("the archive ends inside a record")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogateescape").split(CRLF)
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def rewritten(source: str, target: str, level: int) -> Iterator[tuple]:
    """Rewrites one archive; yields (archive, offset, length, record_id, record_type, uri)."""
    (read, source_path), (write, target_path) = opened(source), opened(target)
    attempt, index = f"{target_path}.{uuid.uuid4().hex}", []
    write.create_dir(target_path.rpartition("/")[0], recursive=True)
    with read.open_input_stream(source_path, compression=None) as stream, write.open_output_stream(attempt, compression=None) as out, \
            write.open_output_stream(f"{attempt}.idx", compression=None) as sidecar:
        data, at = Inflated(stream), 0
        while (head := data.head()) is not None:
            names = fields(head)
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            size = out.write(z.compress(head))
            for piece in data.pieces(int(names["content-length"])):
                size += out.write(z.compress(piece))
            if b"".join(data.pieces(4)) != END.encode():
                raise ValueError(f"no end of record in {source}")
            size += out.write(z.compress(END.encode()) + z.flush())
            row = (target, at, size, names["warc-record-id"], names["warc-type"], names.get("warc-target-uri", ""))
            sidecar.write(("\t".join(map(str, row[1:])) + "\n").encode("utf-8", "surrogateescape"))
            at += size
            yield row
    write.move(f"{attempt}.idx", f"{target_path}.idx")
    write.move(attempt, target_path)


def normalise(spark, source: str, target: str, level: int = WarcSettings.level) -> DataFrame:
    """Rewrites all gzip files of a folder; the offset index of all new archives as a table."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    spread = files.repartitionByRange(max(1, shuffle_width(spark)), "path")

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for (path,) in rows:
            name = path.rpartition("/")[2].split(".")[0]
            yield from rewritten(path, f"{target}/{name}.warc.gz", level)

    return cut(map_rows(spread, run, "archive string, offset long, length long, record_id string, record_type string, uri string"))


def read_records(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok) of the members that ``index`` names.

    A revisit's block holds no payload: its size and digest are those that its headers state.
    """
    def number(urn: str | None) -> int | None:
        text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text.lstrip("-").isdigit() else None

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        name, file = None, None
        for archive, offset, length in rows:
            if archive != name:
                if file is not None:
                    file.close()
                store, path = opened(archive)
                name, file = archive, store.open_input_file(path)
            file.seek(offset)
            record = zlib.decompress(file.read(length), 31)
            head, _, block = record.partition(END.encode())
            names = fields(head)
            block = block[:int(names["content-length"])]
            http, _, payload = block.partition(END.encode())
            stated = names["warc-payload-digest"].removeprefix("sha1:")
            if names["warc-type"] == "revisit":
                yield number(names["warc-record-id"]), int(fields(http)["content-length"]), stated, "revisit", number(names.get("warc-refers-to")), True
            else:
                own = hashlib.sha1(payload).hexdigest()
                yield number(names["warc-record-id"]), len(payload), own, "response", None, own == stated

    ordered = index.select("archive", "offset", "length").repartitionByRange(max(1, shuffle_width(index.sparkSession)), "archive", "offset").sortWithinPartitions("archive", "offset")
    return map_rows(ordered, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean")


def archive_pages(pages: DataFrame, settings: WarcSettings = WarcSettings()) -> DataFrame:
    """Writes, normalises and reads back all pages."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_monolithic(pages, f"{folder}/whole", settings)
    return read_records(normalise(spark, f"{folder}/whole", f"{folder}/records", settings.level))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest FROM p),
k AS (SELECT payload_digest, payload_bytes, max(page_id) AS kept FROM q WHERE payload_bytes >= 1000 GROUP BY 1, 2)
SELECT q.page_id, q.payload_bytes, q.payload_digest,
       CASE WHEN k.kept IS NOT NULL AND q.page_id IS DISTINCT FROM k.kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.kept IS NOT NULL AND q.page_id IS DISTINCT FROM k.kept THEN k.kept END AS refers_to, TRUE AS digest_ok
FROM q LEFT JOIN k ON q.payload_digest = k.payload_digest AND q.payload_bytes = k.payload_bytes
"""

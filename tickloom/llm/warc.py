"""WARC archives: write records, normalise whole-file gzip to a member per record with a sidecar index, read back."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import shared_folder, stored

CHUNK = 1 << 20
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text's UTF-8 bytes: 20 bits at a time, 4 digits each."""
    digest = F.sha1(text.cast("binary"))
    digits = F.concat(*(F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)))
    return F.translate(digits, _HEX32, _BASE32)


def header_safe(value: Column) -> Column:
    """Line breaks and other controls would end a header field: they are percent-encoded, as is the percent sign."""
    for code in (37, *range(32), 127):
        value = F.replace(value, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return value


def revisits(df: DataFrame, id: str, payload: str, least: int = 0) -> DataFrame:
    """``df`` with __digest, __bytes, __type and __refers.

    Of records with one payload of at least ``least`` bytes, the one with the largest id is the response and others
    revisit it; shorter ones are all responses. Rows that repeat the response's id are responses too (one page), and a
    payload met under null ids alone has responses only. Digests fold per payload before they are shuffled.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    told = df.withColumns({"__digest": base32_sha1(body), "__bytes": F.octet_length(body).cast("long")})
    several = told.filter(F.col("__bytes") >= least).groupBy("__digest").agg(F.max(id).alias("__head"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    met = told.join(several, "__digest", "left")
    again = F.col("__head").isNotNull() & ~F.col("__head").eqNullSafe(F.col(id)) & (F.col("__bytes") >= least)
    return met.withColumns({"__type": F.when(again, "revisit").otherwise("response"), "__refers": F.when(again, F.col("__head"))}).drop("__head")


def record(id: Column, uri: Column, payload: Column, kind: Column, refers: Column, digest: Column, size: Column) -> Column:
    """A WARC 1.1 record as text, without the two line breaks that end it. A revisit holds the HTTP header alone."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    block = F.when(kind == "revisit", http).otherwise(F.concat(http, payload))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    fields = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), name(id)), F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), header_safe(uri)), F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(kind == "revisit", F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(refers))),
        F.lit("Content-Type: application/http;msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *fields), F.lit("\r\n\r\n"), block)


def write_archives(df: DataFrame, folder: str, id: str, uri: str, payload: str, least: int = 0) -> None:
    """One whole-file gzip archive per partition, written and committed by Spark's own text writer."""
    told = revisits(df.select(id, uri, payload), id, payload, least)
    text = record(F.col(id), F.col(uri), F.coalesce(F.col(payload), F.lit("")), F.col("__type"), F.col("__refers"), F.col("__digest"), F.col("__bytes"))
    told.select(text.alias("value")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(folder)


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


class Inflated:
    """Bytes of a gzip file (of one member or of many), inflated once from front to back.

    ``at`` is the place of the reader in ``held``; what lies before it is dropped only when more is inflated.
    """

    def __init__(self, stream) -> None:
        self.stream, self.held, self.at, self.z = stream, bytearray(), 0, zlib.decompressobj(31)

    def more(self) -> bool:
        if self.z.eof and self.z.unused_data:
            rest, self.z = self.z.unused_data, zlib.decompressobj(31)
        else:
            rest = self.z.unconsumed_tail or self.stream.read(CHUNK)
            if not rest:
                if not self.z.eof:
                    raise EOFError("the gzip stream ends early")
                return False
            if self.z.eof:
                self.z = zlib.decompressobj(31)
        del self.held[: self.at]
        self.at = 0
        self.held += self.z.decompress(rest, 4 * CHUNK)
        return True

    def header(self) -> bytes | None:
        """Up to and with the empty line; None at the end of the stream."""
        looked = 0  # bytes after the place that hold no empty line
        while (end := self.held.find(b"\r\n\r\n", self.at + max(0, looked - 3))) < 0:
            looked = len(self.held) - self.at
            if not self.more():
                if self.held[self.at :].strip():
                    raise EOFError("a record's header ends early")
                return None
        start, self.at = self.at, end + 4
        return bytes(self.held[start : self.at])

    def block(self, size: int) -> Iterator[bytes]:
        while size:
            if self.at == len(self.held) and not self.more():
                raise EOFError("a record's block ends early")
            out = bytes(self.held[self.at : self.at + size])
            self.at += len(out)
            size -= len(out)
            if out:
                yield out


def fields_of(header: bytes) -> dict[str, str]:
    lines = header.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def normalise_archive(path: str, folder: str) -> tuple[str, str, int]:
    """Inflate one archive once, write each record as a gzip member of its own, and the sidecar index of offsets.

    Records pass through in stretches of at most 4 MiB, whatever their size. Both files get new names, so a task that
    runs again leaves finished files alone; only names that a finished task returned are read later.
    """
    source, place = opened(path)
    target, root = opened(folder)
    name = f"{root}/{place.rsplit('/', 1)[-1].split('.')[0]}-{uuid.uuid4().hex}.warc.gz"
    target.create_dir(root, recursive=True)
    offset = records = 0
    with source.open_input_stream(place, compression=None) as stream, target.open_output_stream(name, compression=None) as out, target.open_output_stream(name + ".idx", compression=None) as index:
        inflated = Inflated(stream)

        def put(data: bytes) -> int:
            out.write(data)
            return len(data)

        while (header := inflated.header()) is not None:
            fields = fields_of(header)
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            length = put(z.compress(header))
            for part in inflated.block(int(fields["content-length"])):
                length += put(z.compress(part))
            if b"".join(inflated.block(4)) != b"\r\n\r\n":
                raise ValueError(f"record at {offset} of {path} does not end with its length")
            length += put(z.compress(b"\r\n\r\n") + z.flush())
            index.write(f"{offset}\t{length}\t{fields['warc-type']}\t{fields['warc-record-id']}\n".encode())
            offset, records = offset + length, records + 1
    return name, name + ".idx", records


def normalise(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """(archive, sidecar, records) for each archive in ``folder``; a task streams one archive at a time."""
    found = spark.read.format("binaryFile").load(folder).select("path")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [normalise_archive(p, target) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist([{"archive": a, "sidecar": s, "records": n} for a, s, n in rows], pa.schema([("archive", pa.string()), ("sidecar", pa.string()), ("records", pa.int64())]))

    return stored(found.mapInArrow(task, "archive string, sidecar string, records long"), "warc-normalised")


def members(archive: str, sidecar: str, folder: str) -> Iterator[dict]:
    """Records of an archive by its sidecar: seek, inflate the one member, check its payload's length and digest."""
    fs, _ = opened(folder)
    with fs.open_input_file(archive) as file, fs.open_input_stream(sidecar, compression=None) as lines:
        for line in lines.read().decode().splitlines():
            offset, length, kind, name = line.split("\t")
            file.seek(int(offset))
            raw = zlib.decompress(file.read(int(length)), 31)
            head, _, block = raw.partition(b"\r\n\r\n")
            fields = fields_of(head)
            http, _, body = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
            size, digest = int(fields_of(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response":
                size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
            number = lambda v: int(v[len("<urn:page:") : -1]) if v and v != "<urn:page:>" else None
            yield {
                "archive": archive, "offset": int(offset), "length": int(length), "record_type": kind, "page_id": number(name),
                "refers_to": number(fields.get("warc-refers-to")), "payload_bytes": size, "payload_digest": digest,
            }


def read_back(archives: DataFrame, folder: str) -> DataFrame:
    """A row per record of the normalised ``archives``: where it is, and what its member says."""
    kinds = [("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, sidecar in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for row in members(archive, sidecar, folder):
                    rows.append(row)
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    spread = archives.select("archive", "sidecar").repartition(max(1, archives.count()))
    return spread.mapInArrow(task, "archive string, offset long, length long, record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string")


def archive_pages(df: DataFrame, id: str = "page_id", uri: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Write ``df`` as archives in the shared folder, normalise them, and return the records read back from there.

    A null payload is an empty one, a null URI leaves its header out, a null id is written as an empty name and read
    back as null. Repeated rows are records each. Other columns are not written. An empty table gives no records.
    """
    folder = f"{shared_folder(df.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(df, f"{folder}/whole", id, uri, payload, least)
    return read_back(normalise(df.sparkSession, f"{folder}/whole", f"{folder}/members"), folder)

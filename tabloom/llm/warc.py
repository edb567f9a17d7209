"""Legacy archive converter: ARC files to WARC files, and a reader for the latter.

ARC is a row of records, each a header line and as many bytes as it declares. The first record of a file names the
version and lists the fields of the header lines (5 in version 1, 10 in version 2). The converter reads the lines by
that list, cuts the content by its declared length, and writes WARC records with synthesised ids, ISO times, record types
and SHA-1 digests. Of records with equal payloads one becomes a response, the others revisits of it.

Files are gzip streams, written and read by Spark's text source with a bare line feed as separator: its writers commit
files as a whole, so a lost executor leaves none behind, and any store will do. A task reads a file as a stream of byte
lines and joins them again, so its memory does not grow with the file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import stored
from tabloom.session import shared_folder

#: Fixed by the ARC format: the header fields of both versions.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
              2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: HTTP header that carries a row's key through both formats.
KEY_HEADER = "X-Page-Id"
#: Length of a revisit's full payload, which it does not hold.
LENGTH_FIELD = "WARC-Payload-Length"
#: Copies of the first record of a group that a hot group's records are dealt over.
SALTS = 16
#: Level of the gzip files: nearly as small as the usual one in a third of the time.
GZIP_LEVEL = "THREE"
#: What a date that stops early is filled up with: the first month and day, and midnight.
SHORT_DATE = "00000101000000"
BATCH_BYTES = 4 << 20


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_lines(df: DataFrame, path: str) -> None:
    """Write the binary column ``record`` as gzip files; each record is without the line feed that ends it."""
    df.select(F.col("record").cast("string")).write.option("compression", "gzip").option("zlib.compress.level", GZIP_LEVEL).option("lineSep", "\n").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line)``: the byte lines of gzip files. A file cannot be split, so a task has all its lines in order."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", date: str = "20240101000000", ip: str = "0.0.0.0") -> None:
    """Write the pages as ARC files, version 1 from even partitions and version 2 from odd ones.

    The content is an HTTP message with ``html`` as UTF-8 (null: empty) and the key in a header (null: none). White space in
    a URL is percent-encoded; a null or empty one becomes ``-``.
    """
    source = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").cast("binary").alias("html"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        version, offset = 1 + number % 2, 0
        about = f"{version} 0 InternetArchive\n{ARC_FIELDS[version]}\n".encode()
        tail = " 200 - - 0 -" if version == 2 else ""
        out = [f"filedesc://part-{number:05d}.arc {ip} {date} text/plain{tail} {len(about)}\n".encode() + about]
        for batch in batches:
            for k, u, body in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "html"))):
                body = body or b""
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                head += (f"{KEY_HEADER}: {k}\r\n" if k is not None else "") + f"Content-Length: {len(body)}\r\n\r\n"
                content = head.encode() + body
                address = quote(u, safe="!#$%&'()*+,/:;=?@[]~") if u else "-"
                more = f" 200 {digest_of(body)} - {offset} part-{number:05d}.arc" if version == 2 else ""
                out.append(f"{address} {ip} {date} text/html{more} {len(content)}\n".encode() + content)
                offset += len(out[-1]) + 1
                if sum(map(len, out[-64:])) > BATCH_BYTES or len(out) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    write_lines(source.mapInArrow(records, "record binary"), path)


class ByteStream:
    """The bytes of one file, from its lines in order."""

    def __init__(self, lines: Iterator[bytes]):
        self.lines, self.rest = lines, b""

    def line(self) -> bytes | None:
        """The next line without its line feed, or None at the end."""
        if self.rest:
            head, _, self.rest = self.rest.partition(b"\n")
            return head
        return next(self.lines, None)

    def take(self, n: int) -> bytes | None:
        """The next n bytes; None if the file ends before."""
        parts, have = [self.rest], len(self.rest)
        while have < n:
            line = next(self.lines, None)
            if line is None:
                self.rest = b""
                return None
            parts += [line, b"\n"]
            have += len(line) + 1
        whole = b"".join(parts)
        self.rest = whole[n:]
        return whole[:n]


def by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, ByteStream]]:
    """Each file of a task with its stream, which must be read to its end before the next one."""
    rows = ((f, x or b"") for batch in batches for f, x in zip(batch.column("file").to_pylist(), batch.column("line").to_pylist()))
    following = next(rows, None)
    while following is not None:
        file = following[0]

        def lines() -> Iterator[bytes]:
            nonlocal following
            while following is not None and following[0] == file:
                line = following[1]
                following = next(rows, None)
                yield line

        yield file, ByteStream(lines())


def arc_records(stream: ByteStream) -> Iterator[tuple[dict[str, str], bytes | None, str | None]]:
    """Header fields by name, content, and no reason, for each record after the version block.

    What cannot be read comes without content and with the reason: a record that the end of the file cuts off, and lines where a
    header line should stand (counted as one until the next header line).
    """
    fields: list[str] = []
    lost = False
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        # A type may hold blanks ("text/html; charset=x"); all fields around it are single words.
        words = line.decode("utf-8", "replace").split()
        opening = words[0].startswith("filedesc://")
        if not words[-1].isdigit() or not (opening or fields and len(words) >= len(fields)):
            if not lost:
                yield {"URL": words[0]}, None, "no header line"
            lost = True
            continue
        lost = False
        content = stream.take(int(words[-1]))
        if opening:
            about = (content or b"").decode("utf-8", "replace").split("\n")
            named = about[1].split() if len(about) > 1 else []
            fields = named if "Content-type" in named else ARC_FIELDS.get(as_int(about[0].split(" ")[0]) or 1, ARC_FIELDS[1]).split()
            continue
        extra = len(words) - len(fields)
        at = fields.index("Content-type")
        words[at:at + extra + 1] = [" ".join(words[at:at + extra + 1])]
        yield dict(zip(fields, words)), content, "cut off by the end of the file" if content is None else None


def http_parts(content: bytes) -> tuple[bytes, bytes]:
    """Head (with its blank line) and payload of an HTTP message; other content is all payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    head, mark, payload = content.partition(b"\r\n\r\n")
    return head + mark, payload


def http_header(head: bytes, name: str) -> str | None:
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        if key.strip().lower() == name.lower():
            return value.strip()
    return None


def as_int(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


CONVERTED = "file long, at long, key long, uri string, ip string, date string, mime string, head binary, payload binary, digest string, n_bytes long, reason string"


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of ARC files with the values that WARC needs; ``(file, at)`` is a record's place. What cannot be read has
    a ``reason``, and nothing but its place and what stands for its address."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for file, stream in by_file(batches):
            for at, (fields, content, reason) in enumerate(arc_records(stream)):
                if content is None:
                    rows.append((file, at, None, fields["URL"], *[None] * 7, reason))
                    continue
                head, payload = http_parts(content)
                given = "".join(c for c in fields.get("Archive-date", "") if c.isdigit())[:14]
                day = (given if len(given) >= 4 else "1970") + SHORT_DATE[max(len(given), 4):]
                date = f"{day[:4]}-{day[4:6]}-{day[6:8]}T{day[8:10]}:{day[10:12]}:{day[12:14]}Z"
                rows.append((file, at, as_int(http_header(head, KEY_HEADER)), fields["URL"], fields.get("IP-address"), date, fields["Content-type"], head, payload,
                             digest_of(payload), len(payload), None))
                size += len(content)
                if size > BATCH_BYTES or len(rows) >= 1024:
                    yield as_batch(rows, CONVERTED)
                    rows, size = [], 0
        if rows:
            yield as_batch(rows, CONVERTED)

    return read_lines(spark, path).mapInArrow(records, CONVERTED)


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """``(file, at, uri, reason)`` of what ``convert`` leaves out."""
    return read_arc(spark, path).where(F.col("reason").isNotNull()).select("file", "at", "uri", "reason")


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], list(names))


def record_id(file: int, at: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{file}/{at}')}>"


def convert(spark: SparkSession, arc: str, warc: str, min_bytes: int = 0) -> None:
    """Convert the ARC files under ``arc`` to WARC files under ``warc``.

    Of records with equal payloads of at least ``min_bytes`` bytes, that with the smallest key (ties and null keys: the first
    in place; null keys last) is a response and the others are revisits without a payload of their own. Smaller payloads
    are all responses. Payloads are compared by digest and length, and only places, keys and digests take part in that;
    the first of each group is found by an aggregate and dealt over salts, so a large group of copies is never gathered. The
    records are joined with the places of the revisits by a hash table of those, so records are not sorted. The files are read
    once for the digests and once for the records, which takes less disk than a stored copy of the records. Records that
    cannot be read are left out (``unreadable``).
    """
    records = read_arc(spark, arc).where(F.col("reason").isNull())
    digests = stored(records.select("file", "at", "key", "digest", "n_bytes"), "arc-digests")
    place = F.struct(F.col("key").isNull().alias("none"), "key", "file", "at")
    firsts = (digests.where(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes").agg(F.min(place).alias("first"), F.count("*").alias("n"))
              .where("n > 1").select("digest", "n_bytes", F.col("first.file").alias("r_file"), F.col("first.at").alias("r_at")))
    same = (F.col("file") == F.col("r_file")) & (F.col("at") == F.col("r_at"))
    salted = digests.select("file", "at", "digest", "n_bytes", F.pmod(F.xxhash64("file", "at"), F.lit(SALTS)).cast("int").alias("salt"))
    again = salted.join(dealt(firsts), ["digest", "n_bytes", "salt"]).where(~same).select("file", "at", "r_file", "r_at")
    rows = records.join(stored(again, "arc-revisits").hint("shuffle_hash"), ["file", "at"], "left")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        about = b"software: tabloom\r\nformat: WARC File Format 1.0\r\n"
        out = [record_lines({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'info/{number}')}>", "WARC-Date": "2024-01-01T00:00:00Z",
                             "Content-Type": "application/warc-fields"}, about)]
        for batch in batches:
            for r in batch.to_pylist():
                head, payload, refers = r["head"] or b"", r["payload"] or b"", r["r_file"] is not None
                fields = {"WARC-Type": "revisit" if refers else "response" if head else "resource", "WARC-Record-ID": record_id(r["file"], r["at"]),
                          "WARC-Target-URI": r["uri"], "WARC-Date": r["date"], "WARC-IP-Address": r["ip"] or "0.0.0.0", "WARC-Payload-Digest": f"sha1:{r['digest']}",
                          "Content-Type": "application/http; msgtype=response" if head else r["mime"]}
                if refers:
                    fields |= {"WARC-Refers-To": record_id(r["r_file"], r["r_at"]), "WARC-Profile": REVISIT_PROFILE, LENGTH_FIELD: str(r["n_bytes"])}
                out.append(record_lines(fields, head if refers else head + payload))
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    write_lines(rows.mapInArrow(written, "record binary"), warc)


def dealt(df: DataFrame) -> DataFrame:
    """A row for each salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def record_lines(fields: dict[str, str], block: bytes) -> bytes:
    """A WARC record without its last line feed, which the text writer adds."""
    fields = fields | {"WARC-Block-Digest": f"sha1:{digest_of(block)}", "Content-Length": str(len(block))}
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode() + block + b"\r\n\r"


def warc_records(stream: ByteStream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record has to start with its version")
        fields = {}
        while (line := stream.line()) not in (None, b"\r", b""):
            key, _, value = line.decode("utf-8", "replace").rstrip("\r").partition(":")
            fields[key.strip().lower()] = value.strip()
        block = stream.take(int(fields["content-length"]))
        if block is None:
            raise ValueError("a record is shorter than its declared length")
        if fields.get("warc-block-digest", "sha1:" + digest_of(block)) != "sha1:" + digest_of(block):
            raise ValueError("a block does not have its digest")
        yield fields, block


READ = "record_id string, refers_to_id string, record_type string, key long, uri string, date string, payload_bytes long, payload_digest string, payload binary"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response, resource and revisit records. A revisit's payload is null, its size and digest those of the full payload."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for _, stream in by_file(batches):
            for fields, block in warc_records(stream):
                kind = fields["warc-type"]
                if kind == "warcinfo":
                    continue
                head, payload = http_parts(block)
                n = len(payload) if kind != "revisit" else as_int(fields.get(LENGTH_FIELD.lower()) or http_header(head, "Content-Length"))
                rows.append((fields["warc-record-id"], fields.get("warc-refers-to"), kind, as_int(http_header(head, KEY_HEADER)), fields["warc-target-uri"],
                             fields["warc-date"], n, fields["warc-payload-digest"].removeprefix("sha1:"), None if kind == "revisit" else payload))
                size += len(block)
                if size > BATCH_BYTES or len(rows) >= 1024:
                    yield as_batch(rows, READ)
                    rows, size = [], 0
        if rows:
            yield as_batch(rows, READ)

    return read_lines(spark, path).mapInArrow(records, READ)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)``: pages written as ARC, converted, and read from the WARC files.

    Null html is an empty payload, a null id stays null and never is the smallest of a group with ids, repeated rows each get a record,
    no pages give files without records and no rows. Other columns are not read.
    """
    spark = pages.sparkSession
    arc, warc = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    write_arc(pages, arc, key, url, html)
    convert(spark, arc, warc, min_bytes)
    found = stored(read_warc(spark, warc).drop("payload"), "warc-records")
    plain = found.select("record_id", "refers_to_id", F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type")
    originals = plain.where(F.col("refers_to_id").isNull())
    revisits = plain.where(F.col("refers_to_id").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    # Only what is referred to, once each, is dealt over the salts.
    targets = revisits.select(F.col("refers_to_id").alias("record_id")).distinct().join(originals, "record_id")
    named = dealt(targets.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (originals.withColumn("refers_to", F.lit(None).cast("long")).select(*columns)
            .unionByName(revisits.join(named, ["refers_to_id", "salt"], "left").select(*columns)))

"""WARC archives in Zstandard: a writer with revisit records, and a reader that trusts nothing.

An archive starts with a skippable frame that holds the dictionary; after it, each record is one
frame, so a reader can start at any record. Archives are written by Spark itself to any store it
knows: frames go out through the text writer, whose line separator is an empty skippable frame, which
decoders pass over. They are read as binary files.

Of records with equal payloads of MIN_REVISIT bytes or more, the one with the largest page id is a
response and the others revisit it.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.llm.cluster import cut, fresh_path

MIN_REVISIT, SAMPLE, DICT_BYTES = 1000, 128, 32_768
DICT_MAGIC, SKIP_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
SEPARATOR = struct.pack("<II", SKIP_MAGIC, 0).decode("ascii")
ID = re.compile(r"<urn:page:(-?\d+|null)>")
READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, error string"


class WarcError(ValueError):
    """A record or archive that breaks the format."""


def train(samples: list[bytes]) -> bytes:
    """A dictionary of DICT_BYTES at most; raw content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


def skippable(content: bytes, magic: int = DICT_MAGIC) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record: headers, blank line, block, two line ends. A revisit has no payload in its block."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if kind == "revisit" else head + payload
    uri = "null" if page_id is None else page_id
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{uri}>"),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if kind == "revisit" else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, digest, type, refers_to) of one record; raises WarcError where headers, lengths or digest don't hold."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or name.lower() in fields:
            raise WarcError(f"bad header {name!r}")
        fields[name.lower()] = value.strip()
    length = fields.get("content-length", "")
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("Content-Length does not hold")
    kind = fields.get("warc-type")
    own, other = ID.fullmatch(fields.get("warc-record-id", "")), ID.fullmatch(fields.get("warc-refers-to", ""))
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind not in ("response", "revisit") or not own or (kind == "revisit") != bool(other):
        raise WarcError("bad record type or ids")
    http, mark, payload = rest[:-4].partition(b"\r\n\r\n")
    told = re.search(rb"\r\nContent-Length: (\d+)", http)
    if not mark or not told:
        raise WarcError("no HTTP headers")
    size = int(told[1])
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest) or kind == "revisit" and payload:
        raise WarcError("payload does not hold its length or digest")
    number = lambda m: None if m is None or m[1] == "null" else int(m[1])
    return number(own), size, digest, kind, number(other)


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(magic, frame or skippable content) of an archive, one after another."""
    at = 0
    while at < len(data):
        if len(data) - at < 8:
            raise WarcError("archive is cut off")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == SKIP_MAGIC:
            if at + 8 + size > len(data):
                raise WarcError("skippable frame is cut off")
            yield magic, data[at + 8 : at + 8 + size]
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = frame_end(data, at)
            yield magic, data[at:end]
            at = end
        else:
            raise WarcError("neither a frame nor a skippable frame")


def frame_end(data: bytes, at: int) -> int:
    """Where the frame ends, by its header and block headers."""
    head = zstandard.frame_header_size(data[at : at + 18])
    checksum = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
    at += head
    while True:
        if at + 3 > len(data):
            raise WarcError("frame is cut off")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)
        if kind == 3 or at > len(data):
            raise WarcError("frame is cut off")
        if last:
            break
    at += 4 * checksum
    if at > len(data):
        raise WarcError("frame is cut off")
    return at


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, each from a frame of its own."""
    decoder = None
    for magic, content in frames(data):
        if decoder is None:
            if magic != DICT_MAGIC:
                raise WarcError("no dictionary frame in front")
            if content[:4] == struct.pack("<I", FRAME_MAGIC):
                content = zstandard.ZstdDecompressor().decompress(content)
            decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content)) if content else zstandard.ZstdDecompressor()
        elif magic == FRAME_MAGIC:
            yield decoder.decompress(content)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes pages as archives under path. Null html is an empty payload.

    The dictionary is fitted on the SAMPLE pages of the smallest ids, DICT_BYTES each at most.
    Revisits are found by length, SHA-1 and SHA-256 of payloads, on digests only; a row that repeats a page id
    is a record of its own. The bodies are shuffled once at most; each task writes one archive.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    size = F.octet_length("payload").cast("bigint")
    digests = cut(rows.select("page_id", size.alias("size"), F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("check")))
    same = digests.where(F.col("size") >= MIN_REVISIT).groupBy("size", "digest", "check").agg(F.max("page_id").alias("keeps"), F.count("*").alias("n")).where("n > 1")
    revisits = digests.join(same, ["size", "digest", "check"]).where("page_id <> keeps").select("page_id", "digest", F.col("keeps").alias("refers_to")).distinct()
    sample = rows.where("page_id is not null").orderBy("page_id").limit(SAMPLE).select(F.substring("payload", 1, DICT_BYTES).alias("p")).collect()
    dictionary = train([bytes(r["p"]) for r in sample if r["p"]])
    shared = rows.sparkSession.sparkContext.broadcast(dictionary)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = shared.value
        coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content), write_checksum=True) if content else zstandard.ZstdCompressor(level=3, write_checksum=True)
        first = [skippable(content)]
        for batch in batches:
            out, first = first, []
            for page_id, url, payload, refers in zip(*[batch.column(i) for i in range(4)], strict=True):
                body, to = payload.as_py(), refers.as_py()
                data = record(page_id.as_py(), url.as_py(), body, hashlib.sha1(body).hexdigest(), "revisit" if to is not None else "response", to)
                out.append(coder.compress(data))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    joined = rows.withColumn("digest", F.sha1("payload")).join(revisits.hint("shuffle_hash"), ["page_id", "digest"], "left").select("page_id", "url", "payload", "refers_to")
    packed = joined.mapInArrow(pack, "frame binary")
    packed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("compression", "none").text(path)


def read_archives(spark, path: str) -> DataFrame:
    """A row per record of the archives under path; error is set, and the rest null, where a record or the rest of an archive does not hold."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"]
        for batch in batches:
            for content in batch.column(0):
                made: list[tuple] = []
                try:
                    for data in read_archive(content.as_py()):
                        try:
                            made.append((*parse(data), None))
                        except (WarcError, UnicodeDecodeError) as e:
                            made.append((None, None, None, None, None, str(e)))
                except (WarcError, zstandard.ZstdError) as e:
                    made.append((None, None, None, None, None, str(e)))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(unpack, READ)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives of pages to the cluster's shared folder and reads them back: one row per page, errors as read_archives() tells them."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col)
    return read_archives(spark, path)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT html, max(page_id) AS keeps FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN m.keeps <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.keeps <> p.page_id THEN m.keeps END AS refers_to
FROM p LEFT JOIN m ON m.html = p.html AND p.n >= 1000
"""

"""WARC archives of individually compressed records that share a Zstandard dictionary.

Layout of a ``.warc.zst`` file: a skippable frame (magic 0x184D2A5D) holding
the dictionary, then one Zstandard frame for each WARC/1.1 record.  Empty
skippable frames (magic 0x184D2A50, size 0), which every decoder passes over,
stand between them: they are the line separator with which Spark's text writer
writes the frames.  So Spark itself commits the files, on any file system and
through lost tasks and executors, and an archive is written by one task.

Records with equal payloads of at least ``min_bytes``: the one with the largest
page id is a response, the others are revisits that refer to it.  Digests are
compared in a slim table; payloads are shuffled once, by page id and digest,
into as many archives as ``archive_bytes`` asks for.  The dictionary is trained
by the writing task on the first ``sample_bytes`` of its archive's records; it
only affects size, every record is written.

Cases: a null html has an empty payload; a null url gives an empty target; a
null page_id is written as an unnamed response (urn ending in ``none``) that
no record refers to; repeated rows are archived once each; too few or too uniform
samples give an archive without a dictionary; an empty table gives no record;
very long payloads are streamed whole; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_path

# Fixed values of the formats.
_DICTIONARY_MAGIC = 0x184D2A5D
_SKIP = "P*M\x18\x00\x00\x00\x00"  # an empty skippable frame, magic 0x184D2A50
_FRAME_MAGIC = 0xFD2FB528

_READ = 1 << 16


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """A response record, or with ``refers_to`` a revisit record without the payload."""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = head + (payload if refers_to is None else b"")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"), ("WARC-Date", date),
              ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
              ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("record cut short")
    return fields, rest[:size]


def _trained(samples: list[bytes], size: int):
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8)
    except zstandard.ZstdError:  # too few samples or nothing in common
        return None


def write(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = 32 << 20,
          dictionary_bytes: int = 64 << 10, sample_bytes: int = 6 << 20, level: int = 6,
          date: str = "2020-01-01T00:00:00Z") -> None:
    """Archive every row of ``pages`` (page_id, url, html) below ``path``."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"),
                        F.sha1(payload).alias("digest"))
    total = rows.agg(F.sum(F.length("payload"))).first()[0] or 0
    archives = max(1, -(-total // archive_bytes))
    slim = rows.where(F.length("payload") >= min_bytes).select("page_id", "digest").where("page_id is not null").distinct()
    keeper = slim.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    visits = slim.join(keeper, "digest").where("page_id <> keeper").select("page_id", "digest", "keeper")
    key = (archives, "page_id", "digest")  # both sides dealt out alike: the join needs no other shuffle
    rows = rows.repartition(*key).join(visits.repartition(*key), ["page_id", "digest"], "left").select(
        "page_id", "url", "payload", "digest", "keeper")
    _frames(rows, dictionary_bytes, sample_bytes, level, date).select(
        F.col("frame").cast("string")).write.option("lineSep", _SKIP).text(path)


def _frames(rows, dictionary_bytes, sample_bytes, level, date):
    def run(batches):
        held, size, compressor = [], 0, None

        def start():
            found = _trained(held, dictionary_bytes)
            data = found.as_bytes() if found else b""
            yield struct.pack("<II", _DICTIONARY_MAGIC, len(data)) + data
            yield from map(compressor_of(found).compress, held)
            held.clear()

        def compressor_of(found):
            nonlocal compressor
            compressor = zstandard.ZstdCompressor(level=level, dict_data=found, write_content_size=True)
            return compressor

        def frames():
            nonlocal size
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    for page, url, payload, digest, keeper in zip(*[c.to_pylist() for c in part.columns], strict=True):
                        one = record(page, url, payload, base32_sha1(digest), keeper, date)
                        if compressor:
                            yield compressor.compress(one)
                            continue
                        held.append(one)
                        size += len(one)
                        if size >= sample_bytes:
                            yield from start()
            if held:
                yield from start()

        out, size_out = [], 0
        for frame in frames():
            out.append(frame)
            size_out += len(frame)
            if size_out > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
                out, size_out = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    return rows.mapInArrow(run, "frame binary")


def records_of(data: bytes):
    """The decompressed frames of an archive, one at a time; dictionaries apply to what follows them."""
    view, at, dictionary = memoryview(data), 0, None
    decompressor = zstandard.ZstdDecompressor()
    while at < len(view):
        magic, = struct.unpack_from("<I", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size, = struct.unpack_from("<I", view, at + 4)
            body = view[at + 8:at + 8 + size]
            if len(body) < size:
                raise ValueError("archive cut short")
            at += 8 + size
            if magic == _DICTIONARY_MAGIC and size:
                dictionary = zstandard.ZstdCompressionDict(bytes(body))
                decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
            continue
        if magic != _FRAME_MAGIC:
            raise ValueError("not a Zstandard frame")
        one, parts = decompressor.decompressobj(), []
        while not one.eof:
            chunk = view[at:at + _READ]
            if not chunk:
                raise ValueError("archive cut short")
            parts.append(one.decompress(chunk))
            at += len(chunk) - len(one.unused_data)
        yield b"".join(parts)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives at ``path``: WARC headers (lower-case names), HTTP header
    text and payload.  A response whose payload doesn't have its digest is an error."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                out, size = [], 0
                for one in records_of(batch.column(0)[i].as_py()):
                    fields, block = parse(one)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    if fields["warc-type"] == "response" and \
                            fields["warc-payload-digest"] != f"sha1:{base32_sha1(hashlib.sha1(payload).hexdigest())}":
                        raise ValueError(f"payload of {fields['warc-record-id']} doesn't have its digest")
                    out.append((list(fields.items()), http.decode(), payload))
                    size += len(one)
                    if size > 4 << 20:
                        yield batch_of(out)
                        out, size = [], 0
                if out:
                    yield batch_of(out)

    def batch_of(out):
        kinds = (pa.map_(pa.string(), pa.string()), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                          names=["headers", "http", "payload"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "headers map<string,string>, http string, payload binary")


def report(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and describe every record."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write(pages, path, **options)
    kind = dict(pages.dtypes)["page_id"]
    urn = lambda h: F.regexp_extract(F.col("headers")[h], r"<urn:page:(.*)>", 1)
    whole = F.col("headers")["warc-type"] == "response"
    return read(spark, path).select(
        F.when(urn("warc-record-id") != "none", urn("warc-record-id")).cast(kind).alias("page_id"),
        F.when(whole, F.length("payload").cast("long")).otherwise(
            F.regexp_extract("http", r"Content-Length: (\d+)", 1).cast("long")).alias("payload_bytes"),
        F.regexp_extract(F.col("headers")["warc-payload-digest"], "sha1:(.*)", 1).alias("payload_digest"),
        F.col("headers")["warc-type"].alias("record_type"),
        F.when(~whole, urn("warc-refers-to")).cast(kind).alias("refers_to"))

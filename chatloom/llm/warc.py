"""WARC archives of pages, each record compressed alone with a dictionary of its archive.

An archive is a file of Zstandard frames. The first is a skippable frame (magic 0x184D2A5D) that
holds the dictionary, trained on the archive's own first records; each further frame is one
record. Spark's text writer puts an empty skippable frame after every frame, so tasks write
archives through Spark's commit protocol to any file system, and a reader of concatenated frames
sees nothing of it.

Pages with equal payloads are stored once: that of the smallest ``page_id`` is a ``response``,
others are ``revisit`` records that name it.
"""

import base64
import hashlib
import struct
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.workers import arrow_map
from chatloom.session import scratch_path

#: Bytes of an archive's first records that its dictionary is trained on, and its size.
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_DICTIONARY_MAGIC = 0x184D2A5D
#: "P*M\x18" and a length of 0: an empty skippable frame.
_SEPARATOR = "P*M\x18\x00\x00\x00\x00"

READ = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
)


# ---------------------------------------------------------------------------- records

def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to, date: str = DATE) -> bytes:
    """A response record; without ``payload`` a revisit of the page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload or b"")
    fields = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url is not None else "urn:unknown"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    if payload is None:
        fields[5:5] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """(page_id, url, payload_bytes, digest, type, refers_to, payload) of one record; checks digest and lengths."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a record of WARC 1.1, or its length is wrong")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda urn: int(urn[10:-1]) if len(urn) > 11 else None
    return (
        number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], length, digest, kind,
        number(fields["WARC-Refers-To"]) if kind == "revisit" else None, payload if kind == "response" else None,
    )


# ---------------------------------------------------------------------------- archives

def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from sample records; too few or too short ones give their text itself, or none."""
    total = sum(map(len, samples))
    if total < 64:
        return None
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 8)), samples, d=8, k=512, steps=0)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def frames(records, sample_bytes: int = SAMPLE_BYTES, level: int = LEVEL):
    """The frames of an archive: dictionary first, then each record."""
    held, size, compress = [], 0, None

    def start():
        found = dictionary(held)
        yield struct.pack("<II", _DICTIONARY_MAGIC, len(found.as_bytes()) if found else 0) + (found.as_bytes() if found else b"")
        nonlocal compress
        compress = zstandard.ZstdCompressor(level=level, dict_data=found).compress
        yield from map(compress, held)

    for data in records:
        if compress is None:
            held.append(data)
            size += len(data)
            if size >= sample_bytes:
                yield from start()
        else:
            yield compress(data)
    if compress is None and held:
        yield from start()


def _frame_end(content, at: int) -> int:
    """Where the frame at ``at`` ends, from its block headers."""
    head = content[at:at + 18]
    checked = zstandard.get_frame_parameters(head).has_checksum
    at += zstandard.frame_header_size(head)
    while True:
        block = int.from_bytes(content[at:at + 3], "little")
        at += 3 + (1 if (block >> 1) & 3 == 1 else block >> 3)
        if block & 1:
            return at + 4 * checked


def read_archive(content: bytes):
    """All records of an archive."""
    at, read = 0, zstandard.ZstdDecompressor().decompress
    while at < len(content):
        magic, size = struct.unpack_from("<II", content, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == _DICTIONARY_MAGIC and size:
                found = zstandard.ZstdCompressionDict(content[at + 8:at + 8 + size])
                read = zstandard.ZstdDecompressor(dict_data=found).decompress
            at += 8 + size
        else:
            end = _frame_end(content, at)
            yield read(content[at:end])
            at = end


# ---------------------------------------------------------------------------- Spark

def _write(date: str, sample_bytes: int):
    def run(batches):
        def records():
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    some = batch.slice(i, 256)
                    columns = (some.column(c).to_pylist() for c in ("page_id", "url", "payload", "size", "sha1", "refers_to"))
                    for page_id, url, payload, size, sha1, refers_to in zip(*columns, strict=True):
                        digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                        yield record(page_id, url, payload, size, digest, refers_to, date)

        held, size = [], 0
        for frame in frames(records(), sample_bytes):
            held.append(frame)
            size += len(frame)
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["frame"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["frame"])

    return run


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = DATE, sample_bytes: int = SAMPLE_BYTES) -> str:
    """Writes a record for each row of ``pages`` (``page_id``, ``url``, ``html``); returns the folder.

    Payloads of ``min_bytes`` or more that are equal are stored once; smaller ones are all
    responses. A null html counts as empty, a null url as unknown. A null ``page_id`` is first of
    equal payloads only if they have no other. Rows that repeat the first id with the same payload
    are all responses. An empty table gives archives without records; other columns are ignored.
    """
    spark, folder = pages.sparkSession, folder or scratch_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    ).withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    # only digests of several pages matter; the join is broadcast where Spark sees that they are few
    firsts = (
        rows.where(F.col("size") >= min_bytes).groupBy("sha1")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    )
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("size") >= min_bytes)
    chosen = rows.join(firsts, "sha1", "left").select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "sha1",
        F.when(revisit, F.col("first")).alias("refers_to"),
    )
    written = arrow_map(chosen, _write(date, sample_bytes), "frame binary")
    written.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", _SEPARATOR).text(folder)
    return folder


def _read(with_payload: bool):
    def run(batches):
        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
        ])
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for data in read_archive(content.as_buffer().to_pybytes()):
                    found = parse(data)
                    rows.append(found if with_payload else (*found[:-1], None))
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def read(spark, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives in a folder; each response's payload is checked by its digest."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    return arrow_map(files, _read(with_payload), READ)

"""Token ids in files of canonical, length-limited Huffman code.

Code lengths come from the counts of all ids of all documents and are limited by package-merge,
so that a decoder needs one table look-up for each id. A file is a row of records, each followed
by a line feed:

    codebook   "HUFC", u8 limit, u32 bytes, zlib of one code length (u8) for each id from 0
    segment    "HUFS", u32 ids, u32 pieces, u32 bytes of code, u32 ids in a block,
               pieces:  i64 doc_id each, u8 has an id each, u8 begins here each, u32 ids each
               blocks:  u64 bit offset of each block's first code
               code:    bits, first bit highest, padded to whole bytes

Blocks start at known bits and are independent of each other: a reader decodes all blocks of a
segment side by side, or only the one it needs. Documents follow in ascending ``doc_id``, null
first, across the files in order of their names; a document may span segments but no files.
"""

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.tokens import encoded_batches, tokenizer_path
from chatloom.llm.workers import arrow_map
from chatloom.session import pinned, scratch_path, unpin

END_ID = 2
LIMIT = 18
BLOCK_IDS = 512
SEGMENT_IDS = BLOCK_IDS * 1024
IDS_A_FILE = 4_000_000

ENCODED = "doc_id long, n_tokens long, ids binary"
COUNTS = ", counts array<struct<token:long,n:long>>"
DIGESTS = "file string, number long, doc_id long, n_tokens long, ids_crc32 long"


# ---------------------------------------------------------------------------- code table

def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, 0 for ids that do not occur.

    Package-merge: ``limit`` times, pairs of the cheapest packages are merged with the single
    ids again; an id's length is the number of chosen packages that hold it.
    """
    ids = np.flatnonzero(counts)
    n = len(ids)
    lengths = np.zeros(len(counts), np.uint8)
    if n <= 1:
        lengths[ids] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit codes of {limit} bits")
    order = ids[np.argsort(counts[ids], kind="stable")]
    weight = counts[order].astype(np.int64)
    merged, single = [], weight
    for _ in range(limit - 1):  # each level: which of the sorted packages are single ids
        pairs = single[:len(single) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((weight, pairs))
        by_weight = np.argsort(both, kind="stable")
        merged.append(by_weight < n)
        single = both[by_weight]
    taken, out = 2 * n - 2, np.zeros(n, np.int64)
    for is_id in reversed(merged):
        of_ids = int(is_id[:taken].sum())
        out[:of_ids] += 1
        taken = 2 * (taken - of_ids)
    out[:taken] += 1
    lengths[order] = out
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: shorter codes first, ids of equal length in ascending order."""
    codes = np.zeros(len(lengths), np.uint64)
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    if len(ids):
        size = lengths[ids].astype(np.int64)
        steps = np.left_shift(1, size.max() - size)
        codes[ids] = (np.cumsum(steps) - steps) >> (size.max() - size)
    return codes


def decoding_table(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each ``limit`` bits to come: the id of the code they begin with, and its length."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    spans = np.left_shift(1, limit - lengths[ids].astype(np.int64))
    table = np.zeros(1 << limit, np.uint32)
    size = np.zeros(1 << limit, np.int64)
    table[:spans.sum()] = np.repeat(ids, spans)
    size[:spans.sum()] = np.repeat(lengths[ids], spans)
    return table, size


# ---------------------------------------------------------------------------- bits

def encode_ids(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code bits of ``ids`` and the bit offset of each id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    bits = int(ends[-1]) if len(ends) else 0
    words = np.zeros(bits // 64 + 2, np.uint64)
    code, at, inside = codes[ids], starts >> 6, starts & 63
    room = 64 - inside - size  # negative: the code runs into the next word
    high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    if len(ids):
        first = np.flatnonzero(np.diff(at, prepend=-1))
        words[at[first]] = np.bitwise_or.reduceat(high, first)
        over = np.flatnonzero(room < 0)
        words[at[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[:(bits + 7) // 8], starts


def decode_blocks(
    code: bytes, offsets: np.ndarray, n_ids: int, block: int, table: np.ndarray, size: np.ndarray, limit: int
) -> np.ndarray:
    """All ids of a segment: its blocks advance side by side, one id each at a step."""
    data = np.frombuffer(code + bytes(16), np.uint8)
    # the 32 bits that begin at each byte
    ahead = (data[:-3].astype(np.uint32) << 24) | (data[1:-2].astype(np.uint32) << 16) | (data[2:-1].astype(np.uint32) << 8) | data[3:]
    at = offsets.astype(np.int64)
    out = np.zeros((block, len(at)), np.uint32)
    rest, last = n_ids - block * (len(at) - 1), len(at) - 1
    mask = (1 << limit) - 1
    for step in range(min(block, n_ids)):
        if step == rest:  # the last block may be shorter
            at = at[:last]
        window = (ahead[at >> 3] >> (32 - limit - (at & 7))) & mask
        out[step, :len(at)] = table[window]
        at = at + size[window]
    return out.T.reshape(-1)[:n_ids]


# ---------------------------------------------------------------------------- records

def codebook_record(lengths: np.ndarray, limit: int) -> bytes:
    packed = zlib.compress(lengths.tobytes())
    return b"HUFC" + struct.pack("<BI", limit, len(packed)) + packed


def segment_record(pieces: list[tuple], codes: np.ndarray, lengths: np.ndarray, block: int = BLOCK_IDS) -> bytes:
    """Pieces: (doc_id or None, whether the document begins here, ids in bytes)."""
    ids = np.frombuffer(b"".join(x for _, _, x in pieces), "<u4")
    code, starts = encode_ids(ids, codes, lengths)
    return b"".join((
        b"HUFS", struct.pack("<IIII", len(ids), len(pieces), len(code), block),
        np.array([d or 0 for d, _, _ in pieces], "<i8").tobytes(),
        np.array([d is not None for d, _, _ in pieces], "u1").tobytes(),
        np.array([b for _, b, _ in pieces], "u1").tobytes(),
        np.array([len(x) // 4 for _, _, x in pieces], "<u4").tobytes(),
        starts[::block].astype("<u8").tobytes(), code,
    ))


def read_file(content: bytes):
    """(doc_id, whether it begins here, ids) of each piece in a file."""
    at, table, size, limit = 0, None, None, 0
    while at < len(content):
        kind, at = content[at:at + 4], at + 4
        if kind == b"HUFC":
            limit, n = struct.unpack_from("<BI", content, at)
            lengths = np.frombuffer(zlib.decompress(content[at + 5:at + 5 + n]), np.uint8)
            table, size = decoding_table(lengths, limit)
            at += 5 + n
        elif kind == b"HUFS":
            n_ids, n_pieces, n_code, block = struct.unpack_from("<IIII", content, at)
            at += 16

            def take(kind, n):
                nonlocal at
                out = np.frombuffer(content, kind, n, at)
                at += out.nbytes
                return out

            doc_ids, known, begins = take("<i8", n_pieces), take("u1", n_pieces), take("u1", n_pieces)
            counts, offsets = take("<u4", n_pieces), take("<u8", -(-n_ids // block))
            ids = decode_blocks(content[at:at + n_code], offsets, n_ids, block, table, size, limit)
            at += n_code
            cuts = np.cumsum(counts)[:-1]
            for d, k, b, part in zip(doc_ids.tolist(), known, begins, np.split(ids, cuts), strict=True):
                yield (d if k else None), bool(b), part
        else:
            raise ValueError(f"not a record: {kind!r}")
        at += 1  # the line feed


# ---------------------------------------------------------------------------- Spark

def _encode(path: str, end_id: int, with_counts: bool):
    counts_type = pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int64())]))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
    schema = pa.schema([*fields, ("counts", counts_type)] if with_counts else fields)

    def run(batches):
        total = np.zeros(0, np.int64)
        for keys, found in encoded_batches(batches, path, end_id):
            # two bytes for an id where all of a document's ids allow it: see _wide
            narrow = [np.frombuffer(x, "<u4") for x in found]
            stored = [x.astype("<u2").tobytes() if x.max() < 65_536 else x.tobytes() for x in narrow]
            columns = [pa.array(keys, pa.int64()), pa.array([len(x) for x in narrow], pa.int64()), pa.array(stored, pa.binary())]
            if with_counts:
                total = _added(total, np.bincount(np.concatenate(narrow)))
                columns.append(pa.nulls(len(keys), counts_type))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        some = np.flatnonzero(total)
        if len(some):  # one more row has the counts of all of these
            pairs = pa.StructArray.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["token", "n"])
            counts = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), pairs)
            nulls = [pa.nulls(1, kind) for _, kind in fields]
            yield pa.RecordBatch.from_arrays([*nulls, counts], schema=schema)

    return run


def _added(total: np.ndarray, found: np.ndarray) -> np.ndarray:
    if len(found) > len(total):
        total = np.concatenate((total, np.zeros(len(found) - len(total), np.int64)))
    total[:len(found)] += found
    return total


def _wide(ids: bytes, count: int) -> bytes:
    return ids if len(ids) == 4 * count else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def encoded(
    docs: DataFrame, path: str | None = None, end_id: int = END_ID, with_counts: bool = False
) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the ids of each whole text, ``end_id`` included.

    Ids are little-endian, in two bytes each where they fit, else in four. ``with_counts`` adds a
    column ``counts`` that is null for texts, and a row for each partition with nothing but the
    counts of its ids.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, _encode(path or tokenizer_path(), end_id, with_counts), ENCODED + (COUNTS if with_counts else ""))


def _count(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        for n, ids in zip(batch.column("n_tokens").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            total = _added(total, np.bincount(np.frombuffer(_wide(ids, n), "<u4")))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["token", "n"]
    )


def token_counts(ids: DataFrame) -> DataFrame:
    """How often each id occurs, over all rows of ``encoded``."""
    return arrow_map(ids, _count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _write(lengths: np.ndarray, limit: int, segment_ids: int):
    def run(batches):
        codes = canonical_codes(lengths)
        out = lambda record: pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], names=["record"])
        pieces, held, first = [], 0, True
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                columns = (some.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids"))
                for doc_id, n, ids in zip(*columns, strict=True):
                    if first:
                        yield out(codebook_record(lengths, limit))
                        first = False
                    ids, begins = _wide(ids, n), True
                    while ids:
                        part, ids = ids[:4 * (segment_ids - held)], ids[4 * (segment_ids - held):]
                        pieces.append((doc_id, begins, part))
                        held, begins = held + len(part) // 4, False
                        if held == segment_ids:
                            yield out(segment_record(pieces, codes, lengths))
                            pieces, held = [], 0
        if pieces:
            yield out(segment_record(pieces, codes, lengths))

    return run


def write_files(
    ids: DataFrame, folder: str, limit: int = LIMIT, ids_a_file: int = IDS_A_FILE, segment_ids: int = SEGMENT_IDS,
    counts: DataFrame | None = None,
) -> None:
    """Writes ``encoded`` rows to files in ascending ``doc_id``, about ``ids_a_file`` ids each.

    ``counts`` (``token``, ``n``) are taken from ``ids`` unless given. Those that reach the driver
    are one for each id of the vocabulary at most.
    """
    counts = (token_counts(ids) if counts is None else counts).toPandas()
    by_id = np.zeros(int(counts["token"].max()) + 1 if len(counts) else 1, np.int64)
    by_id[counts["token"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    files = max(1, -(-int(by_id.sum()) // ids_a_file))
    # rows that share an id are told apart by their ids' hash, so that they spread and keep an order
    spread = ids.withColumn("_tie", F.xxhash64("ids"))
    ordered = spread.repartitionByRange(files, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "ids")
    records = arrow_map(ordered.drop("_tie"), _write(code_lengths(by_id, limit), limit, segment_ids), "record binary")
    # Spark's text files hold a row's bytes as they are
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(folder)


def _documents(content: bytes):
    doc_id, parts = None, []
    for key, begins, ids in read_file(content):
        if begins and parts:
            yield doc_id, parts
            parts = []
        doc_id = key
        parts.append(ids.astype("<u4"))
    if parts:
        yield doc_id, parts


def _digest(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            keys, counts, sums = [], [], []
            for doc_id, parts in _documents(content.as_buffer().to_pybytes()):
                crc = 0
                for part in parts:
                    crc = zlib.crc32(part.tobytes(), crc)
                keys.append(doc_id)
                counts.append(sum(map(len, parts)))
                sums.append(crc)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(keys), pa.string()), pa.array(range(len(keys)), pa.int64()),
                 pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                names=["file", "number", "doc_id", "n_tokens", "ids_crc32"],
            )


def _unfold(batches):
    for batch in batches:
        for content in batch.column("content"):
            for doc_id, parts in _documents(content.as_buffer().to_pybytes()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id], pa.int64()), pa.array([np.concatenate(parts).tobytes()], pa.binary())],
                    names=["doc_id", "ids"],
                )


def _files(spark, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def read_ids(spark, folder: str) -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian, four bytes each) of all documents in the files."""
    return arrow_map(_files(spark, folder), _unfold, "doc_id long, ids binary")


def read_digests(spark, folder: str) -> DataFrame:
    """One row for each document in the files, with a checksum of its ids.

    ``start`` counts the ids of all documents before it: the sum over all thousands of files before
    its own, over the files before it in its thousand, and inside its file.
    """
    rows = pinned(arrow_map(_files(spark, folder), _digest, DIGESTS), "digests")
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("ids")).withColumn("part", part)
    files = files.withColumn("thousand", F.floor(F.col("part") / 1000))
    earlier = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    thousands = files.groupBy("thousand").agg(F.sum("ids").alias("ids"))
    thousands = thousands.select("thousand", earlier(Window.orderBy("thousand")).alias("all_before"))
    near = earlier(Window.partitionBy("thousand").orderBy("part"))
    files = files.withColumn("near", near).join(thousands, "thousand")
    before = F.col("all_before") + F.col("near")
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("number")) - F.col("n_tokens")
    return (
        rows.withColumn("_inside", inside)
        .join(files.select("file", before.alias("_before")), "file")
        .select("doc_id", (F.col("_before") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32", "file")
    )


def archived(docs: DataFrame, path: str | None = None, end_id: int = END_ID, folder: str | None = None, **sizes) -> str:
    """Writes the ids of all documents and returns the folder of the files.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A null text counts as
    empty, which is the end id alone. Rows with a null ``doc_id`` come first; rows that repeat
    a ``doc_id`` are kept, ordered by a hash of their ids. An empty table gives no document.
    """
    spark = docs.sparkSession
    rows = pinned(encoded(docs, path, end_id, with_counts=True), "ids")
    counts = rows.where("counts IS NOT NULL").select(F.inline("counts")).groupBy("token").agg(F.sum("n").alias("n"))
    folder = folder or scratch_path(spark, "huffman")
    write_files(rows.where("counts IS NULL").drop("counts"), folder, counts=counts, **sizes)
    unpin(rows)
    return folder

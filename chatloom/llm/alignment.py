"""Alignment of two tokenizers' tokens over the same text, in Arrow tables.

A byte-level BPE (A) reads a blank and the text, a piece BPE (B) reads the text and adds the blank
itself. Byte offsets come from list columns: token sizes are flattened, summed, and each document's
share of the running sum is taken off through its parent index. Where tokens of both sides end at
the same offset, an Acero hash join on the key (document, end) finds it; such an offset ends a group.

Ids that end together are linked. A batch counts its links by pair of ids with ``Table.group_by``;
Spark merges those counts over the corpus, gives each pair its count and each B id its best, and
brings them back to the batches, each of which kept its pairs in a dictionary. A pair has one row a
batch on that way, never one a document, so the most common pair is no hot key. A batch's links
travel as compressed bytes, and one batch at a time meets its counts.
"""

import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.tokens import PieceEncoder, tokenizer_path
from chatloom.llm.treebpe import byte_letters
from chatloom.llm.workers import arrow_cogroup_map, arrow_map
from chatloom.session import pinned

PIECES = "piece_bpe_32k.model"
#: Bytes of text and documents that share a dictionary of pairs; a longer text has one by itself.
BATCH_BYTES = 4_000_000
BATCH_DOCS = 4096
#: Bytes of text of a batch whose tokens are held at once; the batch keeps their links alone.
SLICE_BYTES = 1_000_000
#: Words and pieces whose ids a worker keeps, and bytes of a row group of batches: none grows with the corpus.
_KEPT = 200_000
_KEPT_PIECES = 400_000
_ROW_GROUP_BYTES = 16 << 20
#: Bits of a byte offset in a key of document and offset, and of an id in a pair's.
_KEY_BITS, _ID_BITS = 40, 31
#: A blank between two other letters, and what makes it more than a plain split at blanks.
_LONE_BLANK = re.compile("(?<=[^ ▁]) (?=[^ ▁])")
_BLANKS = re.compile("  |▁|^ | $")

BATCHES = (
    "doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "n_links array<long>, groups_sha256 array<string>, groups array<string>, "
    "links binary, pair array<struct<a:int,b:int,n:long>>"
)
ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups_sha256 string, groups string"
)


class BytePieces:
    """Tokenizer A: ids of a blank and the text; special strings are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._encode = PieceEncoder(path, _KEPT_PIECES).encode
        if len(self._encode(["."])[0]) != 4:
            raise ValueError("a full stop should be one id")
        vocabulary = Tokenizer.from_file(path).get_vocab()
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        table = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in to_byte for c in token)
            table[i] = bytes(to_byte[c] for c in token) if known else token.encode()
        self.bytes = pa.array(table, pa.binary())

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        # a text is never joined across a blank between two visible letters, so one may go before it and its id after
        led = [bool(t) and not t[0].isspace() for t in texts]
        found = self._encode([("." if x else "") + " " + t for t, x in zip(texts, led, strict=True)])
        return [np.frombuffer(i, "<u4")[int(x):].astype(np.int32) for i, x in zip(found, led, strict=True)]


class SentencePieces:
    """Tokenizer B. Where no piece of its vocabulary has a blank behind another letter, a text's ids
    are those of its blank-led words one after the other, and words recur."""

    def __init__(self, path: str, kept: int = _KEPT):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(len(self._model))]
        blank = "▁"
        self.bytes = pa.array([
            bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else b"" if self._model.is_control(i)
            else p.replace(blank, " ").encode()
            for i, p in enumerate(pieces)
        ], pa.binary())
        self._by_word = not any(re.search(f"[^{blank}]{blank}", p) for p in pieces) and self._keeps_blanks()
        self._kept = kept
        self._words: dict[str, bytes] = {}

    def _keeps_blanks(self) -> bool:
        """Whether blanks stay as they are and one is put before a text."""
        probe = " a  b\n c \t\r\u00a0\u3000d "
        return b"".join(self.bytes[i].as_py() for i in self._model.encode(probe)) == b" " + probe.encode()

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int32) for x in self._model.encode(texts, num_threads=1)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not self._by_word:
            return self._direct(texts)
        known = self._words
        if len(known) > self._kept:  # frequent words are met early: those stay
            for word in list(known)[self._kept // 2:]:
                del known[word]
        split = [_LONE_BLANK.split(t) if _BLANKS.search(t) else t.split(" ") for t in texts]
        new = list({w for words in split for w in words if w not in known})
        known.update(zip(new, (x.tobytes() for x in self._direct(new)), strict=True))
        return [np.frombuffer(b"".join([known[w] for w in words]), np.int32) for words in split]


_TOKENIZERS: dict[tuple[str, str], tuple[BytePieces, SentencePieces]] = {}


def _tokenizers(path_a: str, path_b: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path_a, path_b) not in _TOKENIZERS:
        _TOKENIZERS[path_a, path_b] = BytePieces(path_a), SentencePieces(path_b)
    return _TOKENIZERS[path_a, path_b]


# ---------------------------------------------------------------------------- Arrow

def lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def joined_bytes(ids: pa.ListArray, table: pa.Array) -> pa.Array:
    """The bytes of each list's tokens together."""
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, pc.take(table, ids.values)), b"")


def token_table(ids: pa.ListArray, table: pa.Array) -> pa.Table:
    """One row a token: ``doc`` (its list), ``id``, and ``key``, which says its document and its byte offset there."""
    doc = pc.list_parent_indices(ids)
    flat = pc.list_flatten(ids)
    sizes = pc.take(pc.binary_length(table), flat).cast(pa.int64())
    running = pc.cumulative_sum(sizes)
    # what all documents before this one take
    padded = pa.concat_arrays([pa.array([0], pa.int64()), running])
    before = pc.take(padded, ids.offsets.cast(pa.int64()))
    end = pc.subtract(running, pc.take(before, doc))
    return pa.table({"doc": doc, "id": flat, "key": pc.add(pc.shift_left(doc, pa.scalar(_KEY_BITS, pa.int64())), end)})


def groups_of(tokens: pa.Table, common: pa.Array) -> pa.Array:
    """Tokens' ids joined by commas, one string for each group that ends where ``common`` is true."""
    ends = pc.indices_nonzero(common).cast(pa.int32())
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.add(ends, pa.scalar(1, pa.int32()))])
    return pc.binary_join(pa.ListArray.from_arrays(offsets, tokens["id"].combine_chunks().cast(pa.string())), ",")


def _flags(size: int, at: np.ndarray) -> pa.Array:
    flags = np.zeros(size, bool)
    flags[at] = True
    return pa.array(flags)


def aligned_batch(a: pa.ListArray, b: pa.ListArray, a_bytes: pa.Array, b_bytes: pa.Array) -> dict:
    """Groups and links of documents whose tokens have the same bytes on both sides.

    ``groups``, ``n_groups`` and ``n_links`` have a row for each document; ``links`` is a table of
    (doc, pair, n) and ``pairs`` one of (a, b, n), to whose rows ``pair`` points.
    """
    left, right = token_table(a, a_bytes), token_table(b, b_bytes)
    number = lambda t: pa.array(np.arange(len(t), dtype=np.int32))
    both = pa.table({"key": left["key"], "at_a": number(left)}).join(
        pa.table({"key": right["key"], "at_b": number(right)}), "key", join_type="inner", use_threads=False
    )
    at_a, at_b = both["at_a"].to_numpy(), both["at_b"].to_numpy()
    ends_a, ends_b = _flags(len(left), at_a), _flags(len(right), at_b)
    groups = pc.binary_join_element_wise(groups_of(left, ends_a), groups_of(right, ends_b), "|")
    n_docs, doc = len(a), pc.take(left["doc"], at_a)
    counts = np.bincount(left["doc"].filter(ends_a).to_numpy(), minlength=n_docs)
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
    bits = pa.scalar(_ID_BITS, pa.int64())
    ids = pc.add(pc.shift_left(pc.take(left["id"], at_a).cast(pa.int64()), bits), pc.take(right["id"], at_b).cast(pa.int64()))
    coded = ids.combine_chunks().dictionary_encode()
    pair = coded.indices.cast(pa.int64())
    key = pc.add(pc.shift_left(doc, pa.scalar(32, pa.int64())), pair)
    links = pa.table({"key": key}).group_by("key", use_threads=False).aggregate([([], "count_all")])
    pairs = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
    low = pa.scalar((1 << _ID_BITS) - 1, pa.int64())
    return {
        "groups": pc.binary_join(pa.ListArray.from_arrays(offsets, groups), ";"),
        "n_groups": pa.array(counts, pa.int64()),
        "n_links": pa.array(np.bincount(doc.to_numpy(), minlength=n_docs), pa.int64()),
        "links": pa.table({
            "doc": pc.shift_right(links["key"], pa.scalar(32, pa.int64())).cast(pa.int32()),
            "pair": pc.bit_wise_and(links["key"], pa.scalar((1 << 32) - 1, pa.int64())).cast(pa.int32()),
            "n": links["count_all"].cast(pa.int32()),
        }),
        "pairs": pa.table({
            "a": pc.shift_right(coded.dictionary, bits).cast(pa.int32()),
            "b": pc.bit_wise_and(coded.dictionary, low).cast(pa.int32()), "n": pairs["count_all"],
        }),
    }


def _slices(texts: list[str | None]):
    """Neighbouring texts of at most ``SLICE_BYTES`` letters together, or a longer one."""
    start = held = 0
    for at, text in enumerate(texts):
        size = len(text or "")
        if at > start and held + size > SLICE_BYTES:
            yield texts[start:at]
            start, held = at, 0
        held += size
    yield texts[start:]


def _aligned_slice(texts: list[str | None], tokenizers) -> tuple[pa.ListArray, pa.ListArray, dict]:
    first, second = tokenizers
    spaced = pa.array([(" " + t).encode() if t else None for t in texts], pa.binary())
    shown = [t or "" for t in texts]
    a = lists([x if t else x[:0] for x, t in zip(first.ids(shown), shown, strict=True)])
    b = lists([x if t else x[:0] for x, t in zip(second.ids(shown), shown, strict=True)])
    same = pc.fill_null(pc.and_(
        pc.equal(joined_bytes(a, first.bytes), spaced), pc.equal(joined_bytes(b, second.bytes), spaced)
    ), False)
    if not pc.all(same, min_count=0).as_py():  # the others have no tokens
        keep = same.to_pylist()
        a = lists([np.asarray(x.values) if k else np.zeros(0, np.int32) for x, k in zip(a, keep, strict=True)])
        b = lists([np.asarray(x.values) if k else np.zeros(0, np.int32) for x, k in zip(b, keep, strict=True)])
    return a, b, aligned_batch(a, b, first.bytes, second.bytes)


def _batch(keys: list, texts: list[str | None], tokenizers, with_groups: bool) -> pa.RecordBatch:
    per_doc = {c: [] for c in ("n_a", "n_b", "n_groups", "n_links")}
    hashes, kept, link_doc, link_ids, link_n = [], [], [], [], []
    for some in _slices(texts):
        a, b, found = _aligned_slice(some, tokenizers)
        links, pairs = found["links"], found["pairs"]
        ids = (pairs["a"].to_numpy().astype(np.int64) << _ID_BITS) + pairs["b"].to_numpy()
        link_doc.append(links["doc"].to_numpy() + np.int32(len(hashes)))
        link_ids.append(ids[links["pair"].to_numpy()])
        link_n.append(links["n"].to_numpy())
        groups = found["groups"].to_pylist()
        hashes += [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
        kept += groups if with_groups else []
        counts = {"n_a": pc.list_value_length(a), "n_b": pc.list_value_length(b), "n_groups": found["n_groups"], "n_links": found["n_links"]}
        for name, column in counts.items():
            per_doc[name].append(column.cast(pa.int64()))
    # a name that a repeated task gives again: what the batch holds, not when it ran
    digest = hashlib.md5("".join(hashes).encode())
    digest.update(repr(keys).encode())
    name = digest.hexdigest()
    coded, n = pa.array(np.concatenate(link_ids)).dictionary_encode(), np.concatenate(link_n)
    pair, ids = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    pairs = pa.StructArray.from_arrays([
        pa.array((ids >> _ID_BITS).astype(np.int32)), pa.array((ids & ((1 << _ID_BITS) - 1)).astype(np.int32)),
        pa.array(np.bincount(pair, n, len(ids)).astype(np.int64)),
    ], ["a", "b", "n"])
    columns = {
        "doc_id": pa.array(keys, pa.int64()), **{c: pa.concat_arrays(x) for c, x in per_doc.items()},
        "groups_sha256": pa.array(hashes, pa.string()), "groups": pa.array(kept, pa.string()),
        "link_doc": pa.array(np.concatenate(link_doc)), "link_pair": pa.array(pair), "link_n": pa.array(n), "pair": pairs,
    }
    return pa.RecordBatch.from_arrays(
        [pa.array([name], pa.string())]
        + [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns.values()],
        names=["batch", *columns],
    )


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch without its name, its links as bytes: each document's number of links, steps between their pairs, counts."""
    doc, pair, n = (batch.column(c)[0].values.to_numpy() for c in ("link_doc", "link_pair", "link_n"))
    order = np.lexsort((pair, doc))
    per_doc = np.bincount(doc, minlength=len(batch.column("doc_id")[0].values))
    packed = np.concatenate((per_doc, np.diff(pair[order], prepend=0), n[order])).astype("<i4")
    taken = [f.split()[0] for f in BATCHES.split(", ")]
    links = pa.array([zlib.compress(packed.tobytes(), 1)], pa.binary())
    return pa.RecordBatch.from_arrays([links if c == "links" else batch.column(c) for c in taken], names=taken)


def _links(packed: bytes, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, pair and count of the links that ``_packed`` wrote."""
    numbers = np.frombuffer(zlib.decompress(packed), "<i4")
    per_doc, rest = numbers[:n_docs], numbers[n_docs:]
    steps, n = rest[:len(rest) // 2], rest[len(rest) // 2:]
    return np.repeat(np.arange(n_docs, dtype=np.int32), per_doc), np.cumsum(steps, dtype=np.int64), n


# ---------------------------------------------------------------------------- Spark

def _align(path_a: str, path_b: str, with_groups: bool):
    def run(batches):
        tokenizers, keys, texts, held = _tokenizers(path_a, path_b), [], [], 0

        def done():
            row = _packed(_batch(keys, texts, tokenizers, with_groups))
            pa.default_memory_pool().release_unused()
            return row

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            for key, text, size in zip(batch.column("doc_id").to_pylist(), batch.column("text"), sizes, strict=True):
                if texts and (held + size > BATCH_BYTES or len(texts) == BATCH_DOCS):
                    yield done()
                    keys, texts, held = [], [], 0
                keys.append(key)
                texts.append(text.as_py())
                held += size
        if texts:
            yield done()

    return run


def _summed(kept: pa.Table, entries: pa.Table) -> pa.Table:
    """The documents of one batch; ``entries`` says of each of its pairs how often the corpus has it."""
    _TOKENIZERS.clear()  # this worker has encoded; its executor needs the memory now
    entries = entries.sort_by("at")
    counts, best = entries["count"].to_numpy(), entries["best"].to_numpy()
    column = lambda name: kept[name][0].values
    doc_id = column("doc_id")
    sums = np.zeros((2, len(doc_id)), np.int64)
    doc, at, n = _links(kept["links"][0].as_py(), len(doc_id))
    if len(doc):
        links = pa.table({"doc": doc, "best": np.where(best[at], n, 0).astype(np.int64), "count": n * counts[at]})
        links = links.group_by("doc", use_threads=False).aggregate([("best", "sum"), ("count", "sum")])
        sums[:, links["doc"].to_numpy()] = links["best_sum"].to_numpy(), links["count_sum"].to_numpy()
    groups = column("groups")
    return pa.table(
        [doc_id, *(column(c) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(sums[0]), pa.array(sums[1]),
         column("groups_sha256"), groups if len(groups) else pa.nulls(len(doc_id), pa.string())],
        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"],
    )


def batches(docs: DataFrame, path_a: str, path_b: str, with_groups: bool) -> DataFrame:
    """Rows of ``BATCHES``, numbered in ``batch``: batches that hold the same stay apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = arrow_map(rows, _align(path_a, path_b, with_groups), BATCHES)
    return pinned(found.withColumn("batch", F.monotonically_increasing_id()), "alignment", _ROW_GROUP_BYTES)


def link_counts(aligned: DataFrame) -> DataFrame:
    """``a``, ``b`` and ``count``: how many links of the corpus hold the two ids; ``best`` if no A id has more with this B id."""
    pairs = aligned.select(F.explode("pair").alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("count"))
    counts = pinned(pairs, "link-counts")
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(
    docs: DataFrame, path_a: str | None = None, path_b: str | None = None, with_groups: bool = False
) -> DataFrame:
    """Tokens, groups and links of each document, see ``ALIGNED``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. ``n_best`` counts the links whose
    pair is the most frequent one of its B id in the whole corpus, ties included, and ``count_sum``
    adds the links' pair counts. A group is written as its A ids, a bar and its B ids;
    ``with_groups`` returns the groups themselves too.

    Texts that are null or empty, or whose tokens on either side do not have the bytes of the
    text behind a blank, have zeros and no groups. Null and repeated ``doc_id`` keep a row each. An
    empty table gives no row.
    """
    path_a, path_b = path_a or tokenizer_path(), path_b or tokenizer_path(PIECES)
    kept = batches(docs, path_a, path_b, with_groups)
    counts = link_counts(kept)
    entries = kept.select("batch", F.posexplode("pair").alias("at", "p")).select(F.col("batch").alias("of"), "at", "p.a", "p.b")
    entries = entries.join(counts, ["a", "b"]).select("of", "at", "count", "best")
    return arrow_cogroup_map(docs.sparkSession, kept.drop("pair").groupBy("batch"), entries.groupBy("of"), _summed, ALIGNED)

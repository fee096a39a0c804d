"""Byte-level BPE ids of whole texts by tree concatenation, and decoding of ids.

A text is cut into leaves wherever its bytes allow it, the leaves are encoded side by side, and
neighbours are joined two by two up a tree. A join re-encodes a window around the cut that grows
until it agrees with both sides, and keeps everything outside of it. What agreement has to mean
follows from how the tokenizer works:

- It always splits a text before a blank between two visible letters, so between two such places a
  window agrees with both sides.
- Elsewhere, its splitting rule scans forward without looking back. A split of the left side is final once
  ``SEEN`` bytes follow it, which is more than the rule ever looks ahead; and from the first split
  that the window shares with the right side on, the right side's splits are final too.
- Inside a piece that the rule does not split, a row of tokens is the encoding if and only if each
  two neighbours are the encoding of their own text. So a window inside a long unsplit piece is
  right as soon as it shares one token with the left side and one with the right side.

Texts above ``SEGMENT`` bytes are cut into segments that Spark deals out; the segments of a text
meet again as ids, and their joins are the upper levels of the same tree.
"""

import hashlib
import json
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.tokens import PieceEncoder, text_slices, tokenizer_path
from chatloom.llm.workers import arrow_map, group_map

#: Bytes of a leaf and of a segment, at most.
LEAF = 8192
SEGMENT = 65_536
#: The first window reaches this many bytes to each side of a cut.
WINDOW = 64
#: The splitting rule looks at most four characters ahead.
SEEN = 16
#: Unsplit pieces up to this many bytes are encoded anew as one.
SHORT = 512
AT_ONCE = 256
BYTES_AT_ONCE = 2_000_000
#: Windows, short pieces and words whose ids are kept in a worker.
_KEPT, _KEPT_WORDS = 50_000, 1_000_000

ENCODED = "doc_id long, n_tokens long, ids binary"
_IDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is visible, else the next one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256))
    return [chr(b) if b in visible else chr(256 + next(hidden)) for b in range(256)]


def halves(data: bytes, size: int) -> list[int]:
    """Cuts of ``data`` into halves of halves of about ``size`` bytes at most, between characters."""
    count = 1
    while len(data) > count * size:
        count *= 2
    cuts = {0, len(data)}
    for i in range(1, count):
        at = len(data) * i // count
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        cuts.add(at)
    return sorted(cuts)


class Node:
    """Ids of the stretch of bytes that begins at ``start``, and where each token ends."""

    __slots__ = ("ids", "ends", "start")

    def __init__(self, ids: np.ndarray, ends: np.ndarray, start: int):
        self.ids, self.ends, self.start = ids, ends, start


class TreeEncoder:
    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = file.read()
        self._tokenizer = Tokenizer.from_str(content)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._tokenizer.encode_special_tokens = True  # special strings are cut out before
        self._merge = self._tokenizer.model.tokenize
        self._split = self._tokenizer.pre_tokenizer.pre_tokenize_str
        self._letters = str.maketrans(dict(zip(map(chr, range(256)), byte_letters(), strict=True)))
        self._pieces = PieceEncoder(path, _KEPT_WORDS)
        self._known: dict[bytes, list[int]] = {}
        self._windows: dict[bytes, np.ndarray] = {}
        self.leaf, self.window = max(leaf, 4), max(window, 1)

        to_byte = {c: b for b, c in enumerate(byte_letters())}
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in to_byte for c in token)
            self.pieces[i] = bytes(to_byte[c] for c in token) if known else token.encode()
        self._sizes = np.array([len(p) for p in self.pieces], np.int64)
        added = json.loads(content)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens that take blanks or whole words are not supported")
        self._special = {t["content"]: t["id"] for t in added}
        names = sorted(self._special, key=len, reverse=True)
        self._cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def parts(self, text: str) -> list[tuple[bytes, int | None]]:
        """A text as (bytes, None) for ordinary text and (b"", id) for strings of special tokens."""
        if self._cut is None or not self._cut.search(text):
            return [(text.encode(), None)] if text else []
        found = self._cut.split(text)
        return [(b"", self._special[x]) if i % 2 else (x.encode(), None) for i, x in enumerate(found) if x]

    def encode_parts(self, parts: list[bytes]) -> list[Node]:
        """Nodes of ordinary texts, all of their leaves encoded at once and joined as a tree."""
        cuts = [halves(data, self.leaf) for data in parts]
        leaves = [data[a:b].decode() for data, c in zip(parts, cuts, strict=True) for a, b in zip(c, c[1:], strict=False)]
        found = iter(self._pieces.encode(leaves))
        return [
            self.joined(data, [self.node(np.frombuffer(next(found), "<u4"), a) for a in c[:-1]])
            for data, c in zip(parts, cuts, strict=True)
        ]

    def node(self, ids: np.ndarray, start: int) -> Node:
        return Node(ids, start + np.cumsum(self._sizes[ids]), start)

    def _splits(self, data: bytes, node: Node) -> np.ndarray:
        """For each token of ``node``, whether the text is split behind it."""
        pieces = self._split(data[node.start:int(node.ends[-1])].decode())
        at = node.start + np.cumsum([len(piece) for piece, _ in pieces])
        splits = np.zeros(len(node.ids), bool)
        splits[np.searchsorted(node.ends, at)] = True
        return splits

    def joined(self, data: bytes, nodes: list[Node]) -> Node:
        """One node of neighbouring ones, two by two; their ends count from the start of ``data``."""
        while len(nodes) > 1:
            pairs = [self.join(data, a, b) for a, b in zip(nodes[::2], nodes[1::2], strict=False)]
            nodes = pairs + nodes[len(pairs) * 2:]
        return nodes[0] if nodes else Node(np.zeros(0, np.uint32), np.zeros(0, np.int64), 0)

    def join(self, data: bytes, left: Node, right: Node) -> Node:
        cut, reach = right.start, self.window
        while reach <= SHORT:
            low = max(left.start, cut - reach)
            before = data.rfind(b" ", low + 1, cut)
            while before > 0 and not _LONE_BLANK.match(data, before - 1):
                before = data.rfind(b" ", low + 1, before)
            after = _LONE_BLANK.search(data, cut - 1, min(int(right.ends[-1]), cut + reach))
            if before > 0 and after:
                return self._spliced(left, right, before, after.start() + 1, self._window(data[before:after.start() + 1]))
            reach *= 2
        return self._join_unsplit(data, left, right)

    def _spliced(self, left: Node, right: Node, start: int, stop: int, ids: np.ndarray) -> Node:
        """The left side up to ``start``, the window's ids, and the right side from ``stop`` on."""
        keep, drop = np.searchsorted(left.ends, start, "right"), np.searchsorted(right.ends, stop, "right")
        ends = start + np.cumsum(self._sizes[ids])
        return Node(
            np.concatenate((left.ids[:keep], ids, right.ids[drop:])),
            np.concatenate((left.ends[:keep], ends, right.ends[drop:])), left.start,
        )

    def _window(self, piece: bytes) -> np.ndarray:
        if piece not in self._windows:
            if len(self._windows) >= _KEPT:
                self._windows.clear()
            ids = self._tokenizer.encode(piece.decode(), add_special_tokens=False).ids
            self._windows[piece] = np.array(ids, np.uint32)
        return self._windows[piece]

    def _join_unsplit(self, data: bytes, left: Node, right: Node) -> Node:
        """A join of sides without sure splits near the cut."""
        cut, last = right.start, int(right.ends[-1])
        left_splits, right_splits = self._splits(data, left), self._splits(data, right)
        final = np.flatnonzero(left_splits & (left.ends <= cut - SEEN))
        start = int(left.ends[final[-1]]) if len(final) else left.start
        right_ends = right.ends[right_splits]
        reach, agreed = self.window, None
        while agreed is None:
            stop = min(last, cut + reach)
            while stop < last and data[stop] & 0xC0 == 0x80:
                stop += 1
            at, spans = start, []
            for piece, _ in self._split(data[start:stop].decode()):
                spans.append((at, at + len(piece)))
                at += len(piece)
                if at >= cut and (stop == last or at <= stop - SEEN):
                    i = int(np.searchsorted(right_ends, at))
                    if i < len(right_ends) and right_ends[i] == at:
                        agreed = at
                        break
            reach *= 2
        ids = []
        sides = (left, left_splits), (right, right_splits)
        for a, b in spans:
            ids += self._short(data[a:b]) if b - a <= SHORT else self._long(data, a, b, cut, *sides)
        return self._spliced(left, right, start, agreed, np.array(ids, np.uint32))

    def _merged(self, piece: bytes) -> list[int]:
        return [token.id for token in self._merge(piece.decode("latin-1").translate(self._letters))]

    def _short(self, piece: bytes) -> list[int]:
        if piece not in self._known:
            if len(self._known) >= _KEPT:
                self._known.clear()
            self._known[piece] = self._merged(piece)
        return self._known[piece]

    def _long(self, data: bytes, a: int, b: int, cut: int, left: tuple, right: tuple) -> list[int]:
        """Ids of the unsplit piece ``data[a:b]`` from those of its stretches on both sides of the cut."""
        known_left = self._inside(*left, a, cut, from_start=True) if a < cut else None
        known_right = self._inside(*right, max(a, cut), b, from_start=False)
        reach = self.window
        while True:
            low, i = a, 0
            if known_left is not None:
                i = int(np.searchsorted(known_left[1], known_left[1][-1] - reach, "right"))
                low = int(known_left[1][i - 1]) if i else a
            middle = max(a, cut)
            j = int(np.searchsorted(known_right[1], middle + reach)) if known_right is not None else 0
            high = int(known_right[1][j]) if known_right is not None and j < len(known_right[1]) else b
            new = self._merged(data[low:high])
            bounds = np.concatenate(([low], low + np.cumsum(self._sizes[np.array(new, np.int64)])))
            tokens = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            p, before = (0, []) if low == a else self._shared(tokens, known_left, i, last=False)
            q, after = (len(new), []) if high == b else self._shared(tokens, known_right, j, last=True)
            if p is not None and q is not None and p <= q:
                return [*before, *new[p:q], *after]
            reach *= 2

    def _inside(self, node: Node, splits: np.ndarray, a: int, b: int, from_start: bool):
        """(starts, ends, ids) of the tokens of the one unsplit stretch of ``node`` that begins at ``a`` or ends at ``b``."""
        starts = node.ends - self._sizes[node.ids]
        if from_start:
            i = int(np.searchsorted(starts, a))
            if i == len(starts) or starts[i] != a:
                return None
            j = i + int(np.argmax(splits[i:])) + 1
        else:
            j = int(np.searchsorted(node.ends, b)) + 1
            if j > len(node.ends) or node.ends[j - 1] != b:
                return None
            before = np.flatnonzero(splits[:j - 1])
            i = int(before[-1]) + 1 if len(before) else 0
            i = max(i, int(np.searchsorted(starts, a)))
            if i >= j:
                return None
        return starts[i:j], node.ends[i:j], node.ids[i:j]

    @staticmethod
    def _shared(tokens, known, near: int, last: bool):
        """The number of a token that the window shares with a side, and that side's ids beyond it."""
        starts, ends, ids = known
        order = range(len(tokens) - 1, -1, -1) if last else range(len(tokens))
        for n in order:
            k = int(np.searchsorted(starts, tokens[n][0]))
            if k < len(starts) and starts[k] == tokens[n][0] and ends[k] == tokens[n][1]:
                return n, (ids[k:] if last else ids[:k]).tolist()
        return None, []

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts; a null text has those of an empty one."""
        parts = [self.parts(text or "") for text in texts]
        nodes = iter(self.encode_parts([data for some in parts for data, special in some if special is None]))
        empty = np.zeros(0, np.uint32)
        return [
            np.concatenate([empty, *(next(nodes).ids if s is None else np.array([s], np.uint32) for _, s in some)])
            for some in parts
        ]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens kept; bytes that are no text become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


_ENCODERS: dict[tuple, TreeEncoder] = {}


def _encoder(path: str, leaf: int) -> TreeEncoder:
    if (path, leaf) not in _ENCODERS:
        _ENCODERS[path, leaf] = TreeEncoder(path, leaf)
    return _ENCODERS[path, leaf]


# ---------------------------------------------------------------------------- Spark

def _whole(path: str, leaf: int):
    def run(batches):
        encoder = _encoder(path, leaf)
        for batch in batches:
            for some in text_slices(batch, most=BYTES_AT_ONCE):
                found = encoder.encode(some.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array([len(x) for x in found], pa.int64()),
                     pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())],
                    names=["doc_id", "n_tokens", "ids"],
                )

    return run


def _segments(path: str, segment: int, leaf: int):
    """Numbered segments of long texts; ``part`` tells stretches between special strings apart."""
    names = ["doc_id", "hash", "number", "part", "special", "data"]

    def run(batches):
        encoder = _encoder(path, leaf)
        for batch in batches:
            for n in range(batch.num_rows):
                doc_id, text = batch.column("doc_id")[n], batch.column("text")[n].as_py()
                key = hashlib.sha256(text.encode()).hexdigest()
                rows = []
                for part, (data, special) in enumerate(encoder.parts(text)):
                    if special is not None:
                        rows.append((part, special, b""))
                        continue
                    cuts = halves(data, segment)
                    rows += [(part, None, data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id.as_py()] * len(rows), pa.int64()), pa.array([key] * len(rows), pa.string()),
                     pa.array(range(len(rows)), pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
                     pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
                    names=names,
                )

    return run


#: A blank between two visible letters; what follows it may stand beyond the window.
_LONE_BLANK = re.compile(rb"[!-~] (?=[!-~])")

CUT = "doc_id long, hash string, number long, part long, special long, data binary"
DONE = "doc_id long, hash string, number long, part long, copies long, data binary, ids binary"


def _encode_segments(path: str, leaf: int):
    def run(batches):
        encoder = _encoder(path, leaf)
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                some = batch.slice(i, 16)
                data, special = some.column("data").to_pylist(), some.column("special").to_pylist()
                found = iter(encoder.encode_parts([d for d, s in zip(data, special, strict=True) if s is None]))
                ids = [next(found).ids if s is None else np.array([s], np.uint32) for s in special]
                yield pa.RecordBatch.from_arrays(
                    [some.column(c) for c in ("doc_id", "hash", "number", "part", "copies", "data")]
                    + [pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())],
                    names=["doc_id", "hash", "number", "part", "copies", "data", "ids"],
                )

    return run


def _join_segments(path: str, leaf: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        encoder = _encoder(path, leaf)
        rows = rows.sort_values("number")
        out = []
        for _, some in rows.groupby("part", sort=True):
            data = b"".join(some["data"])
            nodes, start = [], 0
            for ids, piece in zip(some["ids"], some["data"], strict=True):
                nodes.append(encoder.node(np.frombuffer(ids, "<u4"), start))
                start += len(piece)
            out.append(encoder.joined(data, nodes).ids)
        ids = np.concatenate([np.zeros(0, np.uint32), *out])
        copies = int(rows["copies"].iloc[0])
        doc_id = rows["doc_id"].iloc[0]
        return pd.DataFrame({
            "doc_id": pd.array([None if pd.isna(doc_id) else int(doc_id)] * copies, "Int64"),
            "n_tokens": [len(ids)] * copies, "ids": [ids.astype("<u4").tobytes()] * copies,
        })

    return run


def encoded(
    docs: DataFrame, path: str | None = None, leaf: int = LEAF, segment: int = SEGMENT
) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) of each whole text.

    The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``: strings of special
    tokens in a text become those tokens. ``docs`` needs ``doc_id`` and ``text``; other columns are
    ignored. A null text counts as empty and has no ids. Null and repeated ``doc_id`` keep a row
    each; a ``doc_id`` that is no number is an error of the cast. An empty table gives no row.
    """
    return _encoded(docs, path or tokenizer_path(), leaf, segment, False)


def _encoded(docs: DataFrame, path: str, leaf: int, segment: int, with_digests: bool) -> DataFrame:
    spark, schema = docs.sparkSession, DIGESTS if with_digests else ENCODED
    whole, join = _whole(path, leaf), _join_segments(path, leaf)
    if with_digests:  # in the same worker: a second one would hold the vocabulary once more
        decode, ids = _decode(path, leaf, True), join

        def whole(batches, encode=whole):
            return decode(encode(batches))

        def join(rows):
            batch = pa.RecordBatch.from_pandas(ids(rows), schema=_IDS, preserve_index=False)
            return pa.Table.from_batches(decode([batch])).to_pandas(integer_object_nulls=True)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.octet_length("text") > segment, F.lit(False))
    short = arrow_map(rows.where(~is_long), whole, schema)
    cut = arrow_map(rows.where(is_long), _segments(path, segment, leaf), CUT)
    # rows that repeat a long text are encoded once
    cut = cut.groupBy("doc_id", "hash", "number", "part", "special").agg(F.first("data").alias("data"), F.count("*").alias("copies"))
    done = arrow_map(cut, _encode_segments(path, leaf), DONE)
    long = group_map(spark, done.groupBy("doc_id", "hash"), join, schema)
    return short.unionByName(long)


def _decode(path: str, leaf: int, digests: bool):
    def run(batches):
        encoder = _encoder(path, leaf)
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(i, AT_ONCE)
                ids = some.column("ids").to_pylist()
                texts = [encoder.decode(np.frombuffer(x or b"", "<u4")) for x in ids]
                if digests:
                    columns = [
                        some.column("n_tokens"),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                    ]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    columns, names = [pa.array(texts, pa.string())], ["doc_id", "text"]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *columns], names=names)

    return run


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` of rows of ``encoded``; special tokens are kept, null ids give an empty text."""
    return arrow_map(ids.select("doc_id", "ids"), _decode(path or tokenizer_path(), LEAF, False), "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None, leaf: int = LEAF, segment: int = SEGMENT) -> DataFrame:
    """Checksums of each text's ids and of the text that they decode to; rows as in ``encoded``."""
    return _encoded(docs, path or tokenizer_path(), leaf, segment, True)

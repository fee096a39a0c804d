"""Packing of token ids into windows by the sum-of-squares rule.

Each document is cut into full windows and one rest. Rests are placed online: a rest of ``s``
ids goes to the fill level ``h`` that keeps the sum of squared counts of partly filled windows
least. With ``N`` open windows by level, moving one from ``h`` to ``h + s`` changes that sum by
``2 (N[h + s] - N[h]) + 2`` (only one of the terms if the window is new or becomes full), so the
level array alone decides, and no search over windows is needed.

Each task packs what it reads, which needs no shuffle and keeps only its open windows in
memory. At its end the open windows that are nearly full are padded, as long as padding stays below
``PADDING`` of the task's ids. Into the gaps of the other ones goes what the emptiest windows hold, so
only the rests of those few are cut again. What is left in the end becomes windows whose lengths are
powers of two, which need no padding.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.tokens import encoded_batches, tokenizer_path
from chatloom.llm.workers import arrow_map

WINDOW = 2048
END_ID = 1
#: Share of a task's ids that padding may add.
PADDING = 0.005
#: Sequence ids of a task begin at its number times this.
SEQUENCES_A_TASK = 2 ** 32

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, ids binary"
)
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])


class SumOfSquares:
    """Online packer of one task. A piece is (doc_id, start, ids, ids of the whole document)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.open_by_level = np.zeros(window + 1, np.int64)  # [0] and [window] stay 0
        self._waiting: dict[int, list[list[tuple]]] = {}
        self.placed = 0
        self.cut_again = 0

    def level_for(self, size: int) -> int:
        """The level whose window takes a rest of ``size`` ids; 0 opens a new one."""
        counts, window = self.open_by_level, self.window
        levels = np.concatenate(([0], np.flatnonzero(counts[:window - size + 1])))
        after = levels + size
        change = np.where(after < window, 2 * counts[after] + 1, 0) - np.where(levels > 0, 2 * counts[levels] - 1, 0)
        # ties go to the fullest window
        return int(levels[len(levels) - 1 - np.argmin(change[::-1])])

    def add(self, doc_id, ids: bytes):
        """Places a document; yields the windows that this fills, as lists of pieces."""
        count, window = len(ids) // 4, self.window
        self.placed += count
        full = count // window * window
        for start in range(0, full, window):
            yield [(doc_id, start, ids[4 * start:4 * (start + window)], count)]
        if size := count - full:
            level = self.level_for(size)
            pieces = [] if level == 0 else self._take(level)
            pieces.append((doc_id, full, ids[4 * full:], count))
            if level + size == window:
                yield pieces
            else:
                self.open_by_level[level + size] += 1
                self._waiting.setdefault(level + size, []).append(pieces)

    def _take(self, level: int) -> list[tuple]:
        self.open_by_level[level] -= 1
        return self._waiting[level].pop()

    def _gap(self, level: int) -> int:
        """Ids of padding that a window of ``level`` ids needs; none at a power of two."""
        return self.window - level if level & (level - 1) else 0

    def drain(self):
        """Windows made of what is still open; ``cut_again`` counts the ids that are moved for it."""
        waiting = [(level, pieces) for level in sorted(self._waiting, key=self._gap) for pieces in self._waiting[level]]
        self.open_by_level[:] = 0
        self._waiting = {}
        budget, first = PADDING * self.placed, 0
        while first < len(waiting) and self._gap(waiting[first][0]) <= budget:
            budget -= self._gap(waiting[first][0])
            yield waiting[first][1]
            first += 1
        filling = sorted(waiting[first:], key=lambda w: -w[0])  # the fullest first
        poured: list[tuple] = []
        while filling:
            level, pieces = filling.pop(0)
            room = self.window - level
            while room and (poured or filling):
                if not poured:
                    poured = filling.pop()[1]
                doc_id, start, ids, count = poured.pop(0)
                pieces.append((doc_id, start, ids[:4 * room], count))
                moved = min(room, len(ids) // 4)
                self.cut_again += moved
                room -= moved
                if ids := ids[4 * moved:]:
                    poured.insert(0, (doc_id, start + moved, ids, count))
            if not room:
                yield pieces
            else:  # nothing is left to fill it with
                poured = pieces
        left = sum(len(ids) // 4 for _, _, ids, _ in poured)
        while left:
            room, pieces = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                doc_id, start, ids, count = poured.pop(0)
                pieces.append((doc_id, start, ids[:4 * room], count))
                moved = min(room, len(ids) // 4)
                room -= moved
                if ids := ids[4 * moved:]:
                    poured.insert(0, (doc_id, start + moved, ids, count))
            yield pieces


def _pack(path: str, window: int, end_id: int, with_ids: bool):
    def run(batches):
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) * SEQUENCES_A_TASK
        packer, rows, held = SumOfSquares(window), [], 0

        def put(pieces):
            nonlocal number, held
            offset = 0
            for doc_id, start, ids, count in pieces:
                length = len(ids) // 4
                rows.append((doc_id, start, length, zlib.crc32(ids), count, number, offset, ids if with_ids else None))
                offset += length
                held += len(ids) if with_ids else 64
            number += 1

        def flush():
            nonlocal held
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW
            )
            rows.clear()
            held = 0
            return out

        for keys, found in encoded_batches(batches, path, end_id):
            for doc_id, ids in zip(keys, found, strict=True):
                for pieces in packer.add(doc_id, ids):
                    put(pieces)
            if held > 4_000_000:
                yield flush()
        for pieces in packer.drain():
            put(pieces)
        if rows:
            yield flush()

    return run


def packed(
    docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True
) -> DataFrame:
    """Pieces of all documents, each with its place in a window of ``window`` ids.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. The ids of a document are
    those of its whole text and ``end_id``. Pieces of a sequence follow one another without gaps
    from offset 0. ``ids`` holds a piece's ids as little-endian unsigned 32-bit integers
    (``with_ids=False``: null).

    A null text counts as empty, which is one id. Null and repeated ``doc_id`` are packed like
    any other row. An empty table gives no row. Sequence ids and windows follow the partitions
    of ``docs``; the pieces of a document always add up to its ids.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, _pack(path or tokenizer_path(), window, end_id, with_ids), PIECES)

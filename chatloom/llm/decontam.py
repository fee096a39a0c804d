"""Benchmark decontamination: every passage of the corpus asks a BM25 index of the test items.

Items are cut into parts of ``PART`` words and indexed; documents are cut into passages of two
parts' length, one beginning at every ``PART`` words, so that each part of an item lies whole in
some passage. Question and answer have parts of their own. A part's score is its BM25 score for the passage's words over its score for its own
words: 1 if the passage holds all of them. All parts above the threshold are retrieved by
block-max WAND: posting lists are cut into blocks of parts with the highest score in each, a
passage none of whose blocks can reach the threshold is passed over (tested for many passages at
once), and in the others lists are advanced to the next part that can. An item with a retrieved
part is then verified: five-word shingles of its question and of its answer, each for itself, must
be in the document to ``OVERLAP`` or more; of an item that is one text, those of the whole text.
"""

import re
from collections import Counter
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.workers import arrow_map
from chatloom.session import pinned

PART = 48
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
K1, B = 1.2, 0.75
BLOCK = 4
DENSE = 16
#: Segments times blocks whose bounds are held at once.
CELLS = 2_000_000
#: Words of items that one pass over the documents looks for; it bounds what is broadcast.
WORDS_A_PASS = 500_000

_WORD = re.compile(r"\w+")
HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(seq: list[str], size: int = SHINGLE) -> set[tuple]:
    """Runs of ``size`` words; a shorter text is one shingle, an empty one has none."""
    if len(seq) < size:
        return {tuple(seq)} if seq else set()
    return set(zip(*(seq[i:] for i in range(size)), strict=False))


class Corpus(NamedTuple):
    """What BM25 takes from all parts of all items: their number, mean length, and parts with each word."""

    parts: int
    mean: float
    holding: dict[str, int]


def item_parts(question: list[str], answer: list[str] | None) -> list[list[str]]:
    """Parts of at most ``PART`` words, of each side by itself; a longer side's last part ends where it ends.

    A side shorter than a shingle has a part only if the other is as short: it would be found
    everywhere, and the other finds the item.
    """
    sides = [side for side in (question, answer) if side]
    if max(map(len, sides), default=0) >= SHINGLE:
        sides = [side for side in sides if len(side) >= SHINGLE]
    return [
        side[k:k + PART]
        for side in sides
        for k in (max(0, min(k, len(side) - PART)) for k in range(0, len(side), PART))
    ]


def counted(parts: list[list[str]]) -> Corpus:
    """The statistics of these parts alone."""
    holding = Counter(w for part in parts for w in set(part))
    return Corpus(len(parts), sum(map(len, parts)) / max(1, len(parts)), dict(holding))


class Index:
    """Posting lists by term: parts in ascending order and their scores over the part's own."""

    def __init__(self, items: list[tuple], corpus: Corpus | None = None):
        """``items``: (item_id, question words, answer words), or all words and None.

        ``corpus`` has the statistics of all items where these are only some of them.
        """
        self.items = items
        self.proofs = [[shingles(side) for side in sides if side is not None] for _, *sides in items]
        parts, self.item_of = [], []
        for i, (_, q, a) in enumerate(items):
            cut = item_parts(q, a)
            parts += cut
            self.item_of += [i] * len(cut)
        corpus = corpus or counted(parts)
        counts = [Counter(p) for p in parts]
        self.terms = {w: i for i, w in enumerate(sorted({w for c in counts for w in c}))}
        df = np.array([corpus.holding[w] for w in self.terms], float)
        idf = np.log1p((corpus.parts - df + 0.5) / (df + 0.5))
        lists = [[] for _ in self.terms]
        for part, c in enumerate(counts):
            norm = K1 * (1 - B + B * len(parts[part]) / corpus.mean)
            found = [(self.terms[w], idf[self.terms[w]] * n * (K1 + 1) / (n + norm)) for w, n in sorted(c.items())]
            whole = sum(x for _, x in found)
            for term, x in found:
                lists[term].append((part, x / whole))
        self.blocks = max(1, -(-len(parts) // BLOCK))
        self.lists = [([p for p, _ in entries], [float(s) for _, s in entries]) for entries in lists]
        self._set_maxima()

    def _set_maxima(self):
        """The highest score of each term in each block that it is in, rounded up as bounds must be.

        Terms in at least a ``DENSE``-th of the blocks also have a row over all blocks, so rows
        take at most ``DENSE`` times the postings.
        """
        blocks, maxima, starts = [], [], [0]
        self.highest = []
        for parts, scores in self.lists:
            block = np.array(parts, np.int64) // BLOCK
            first = np.flatnonzero(np.diff(block, prepend=-1))
            high = np.maximum.reduceat(np.array(scores), first).astype(np.float32)
            blocks.append(block[first].astype(np.int32))
            maxima.append(np.nextafter(high, np.float32(2)))
            starts.append(starts[-1] + len(first))
            self.highest.append(float(maxima[-1].max()))
        self.starts = np.array(starts)
        self.held_blocks = np.concatenate(blocks) if blocks else np.zeros(0, np.int32)
        self.maxima = np.concatenate(maxima) if maxima else np.zeros(0, np.float32)
        sizes = np.diff(self.starts)
        frequent = np.flatnonzero(sizes * DENSE >= self.blocks)
        self.row_of = np.full(len(sizes), -1)
        self.row_of[frequent] = np.arange(len(frequent))
        self.rows = np.zeros((len(frequent), self.blocks), np.float32)
        for row, term in enumerate(frequent):
            here = slice(self.starts[term], self.starts[term + 1])
            self.rows[row, self.held_blocks[here]] = self.maxima[here]

    def block_max(self, term: int, block: int) -> float:
        if (row := self.row_of[term]) >= 0:
            return float(self.rows[row, block])
        lo, hi = self.starts[term], self.starts[term + 1]
        at = lo + np.searchsorted(self.held_blocks[lo:hi], block)
        return float(self.maxima[at]) if at < hi and self.held_blocks[at] == block else 0.0

    def _bounds(self, segment, term, count: int):
        """Sum of block maxima by segment (0 to ``count`` - 1, ascending) and block."""
        sums = np.zeros((count, self.blocks), np.float32)
        row = self.row_of[term]
        dense = row >= 0
        if dense.any():
            here = segment[dense]
            first = np.flatnonzero(np.diff(here, prepend=-1))
            sums[here[first]] = np.add.reduceat(self.rows[row[dense]], first, axis=0)
        if not dense.all():
            rare, here = term[~dense], segment[~dense]
            sizes = self.starts[rare + 1] - self.starts[rare]
            at = np.repeat(self.starts[rare] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            np.add.at(sums, (np.repeat(here, sizes), self.held_blocks[at]), self.maxima[at])
        return sums

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """(part, score) of all parts that score ``threshold`` or more for these distinct terms."""
        at, out = dict.fromkeys(terms, 0), []
        alive = list(terms)
        slack = threshold - 1e-9
        while alive:
            alive.sort(key=lambda t: self.lists[t][0][at[t]])
            bound, pivot = 0.0, None
            for t in alive:
                bound += self.highest[t]
                if bound >= slack:
                    pivot = self.lists[t][0][at[t]]
                    break
            if pivot is None:
                return out
            block = pivot // BLOCK
            reached = [t for t in alive if self.lists[t][0][at[t]] <= pivot]
            if sum(self.block_max(t, block) for t in reached) < slack:
                # no part before the block's end, or before the next list begins, can do it
                later = [self.lists[t][0][at[t]] for t in alive if self.lists[t][0][at[t]] > pivot]
                target = min([(block + 1) * BLOCK, *later])
            else:
                target = pivot
            if target == pivot and all(self.lists[t][0][at[t]] == pivot for t in reached):
                score = sum(self.lists[t][1][at[t]] for t in reached)
                if score >= slack:
                    out.append((pivot, score))
                target = pivot + 1
            for t in reached:
                parts, i = self.lists[t][0], at[t]
                while i < len(parts) and parts[i] < target:
                    i += 1
                at[t] = i
            alive = [t for t in alive if at[t] < len(self.lists[t][0])]
        return out

    def passages(self, texts: list[list[str]], threshold: float):
        """(number of the text, distinct terms) of the passages that may hold a part."""
        if not self.terms:
            return
        get, size = self.terms.get, len(self.terms)
        segments, text_of, keys = 0, [], []
        for number, seq in enumerate(texts):
            ids = np.array([get(w, -1) for w in seq], np.int64)
            known = np.flatnonzero(ids >= 0)
            keys.append((segments + known // PART) * size + ids[known])
            here = max(1, -(-len(seq) // PART))
            text_of.append(np.full(here, number))
            segments += here
        keys, text_of = np.unique(np.concatenate(keys)), np.concatenate(text_of)
        if not len(keys):
            return
        segment, term = keys // size, keys % size
        bounds = np.searchsorted(segment, np.arange(segments + 2))
        joined = np.append(text_of[1:] == text_of[:-1], False)  # the next segment is of the same text
        # the last segment of a text lies in the passage before it, unless it is the only one
        begins = joined | (np.diff(text_of, prepend=-1) != 0)
        step = max(1, CELLS // self.blocks)
        for low in range(0, segments, step):
            high = min(segments, low + step)
            here = slice(bounds[low], bounds[min(high + 1, segments)])
            sums = self._bounds(segment[here] - low, term[here], high - low + 1)
            both = sums[:-1] + np.where(joined[low:high, None], sums[1:], 0)
            for k in low + np.flatnonzero(begins[low:high] & (both.max(axis=1) >= threshold - 1e-3)):
                yield int(text_of[k]), np.unique(term[bounds[k]:bounds[k + 2 if joined[k] else k + 1]]).tolist()

    def search(self, texts: list[list[str]], threshold: float = THRESHOLD, overlap: float = OVERLAP):
        """(number of the text, item_id, score, question overlap, answer overlap) of verified items."""
        best: dict[tuple[int, int], float] = {}
        for number, terms in self.passages(texts, threshold):
            for part, score in self.wand(terms, threshold):
                key = number, self.item_of[part]
                best[key] = max(score, best.get(key, 0))
        held_of, held = -1, set()
        for (number, item), score in sorted(best.items()):
            if number != held_of:
                held_of, held = number, shingles(texts[number])
                short = set()
            proofs = []
            for proof in self.proofs[item]:
                if proof and len(next(iter(proof))) < SHINGLE:  # one short shingle: runs of its length
                    short = shingles(texts[number], len(next(iter(proof))))
                    proofs.append(float(next(iter(proof)) in short))
                else:
                    proofs.append(len(proof & held) / len(proof) if proof else 1.0)
            if min(proofs) >= overlap:
                yield number, self.items[item][0], score, proofs[0], proofs[-1]


def _cut(two_sided: bool, at: tuple[int, int, int]):
    def run(batches):
        for batch in batches:
            number, q, a = (batch.column(i).to_pylist() for i in at)
            rows = [
                (n, part) for n, x, y in zip(number, q, a, strict=True)
                for part in item_parts(words(x), words(y) if two_sided else None)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.list_(pa.string()))],
                names=["pass", "part"],
            )

    return run


def indexes(items: DataFrame, question: str | None = None, answer: str | None = None, words_a_pass: int = WORDS_A_PASS):
    """One index for each pass, made when it is asked for; each holds about ``words_a_pass`` words of items.

    ``items`` needs ``item_id`` and either ``text`` or the named columns of question and answer.
    Items without words and repeated ones do not count; a null id is an id of its own. Parts and
    the words in them are counted over all items on Spark, so scores are the same in any number of
    passes; only a pass's items and the counts of its own words reach the driver.
    """
    two_sided = bool(question and answer)
    sides = [F.col(question), F.col(answer)] if two_sided else [F.col("text"), F.lit(None)]
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), *(s.cast("string").alias(n) for s, n in zip(sides, ("q", "a"), strict=True))).distinct()
    size = F.coalesce(F.sum(F.coalesce(F.length("q"), F.lit(0)) + F.coalesce(F.length("a"), F.lit(0))), F.lit(0))
    passes = 1 + rows.agg(size.alias("n")).head()["n"] // (4 * words_a_pass)
    number = F.pmod(F.xxhash64("item_id", "q", "a"), F.lit(passes)).cast("int")
    rows = pinned(rows.withColumn("pass", number), "items")
    parts = pinned(arrow_map(rows.select("pass", "q", "a"), _cut(two_sided, (0, 1, 2)), "pass int, part array<string>"), "parts")
    total = parts.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("part")), F.lit(0.0)).alias("mean")).head()
    held = parts.select("pass", F.explode(F.array_distinct("part")).alias("word"))
    holding = pinned(held.groupBy("word").agg(F.count("*").alias("n"), F.collect_set("pass").alias("passes")), "words")
    for i in range(passes):
        some = rows.where(F.col("pass") == i).toPandas()
        split = [
            (None if row.item_id != row.item_id else int(row.item_id),
             words(row.q), words(row.a) if two_sided else None)
            for row in some.sort_values(["item_id", "q", "a"]).itertuples()
        ]
        here = holding.where(F.array_contains("passes", i)).select("word", "n").toPandas()
        corpus = Corpus(total["n"], total["mean"], dict(zip(here["word"], here["n"].tolist(), strict=True)))
        yield Index([x for x in split if x[1] or x[2]], corpus)


def _search(index: Index, threshold: float, overlap: float):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                keys = some.column("doc_id").to_pylist()
                found = list(index.search([words(t) for t in some.column("text").to_pylist()], threshold, overlap))
                if found:
                    rows = [(keys[n], *rest) for n, *rest in found]
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                        names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                    )

    return run


def contaminated(
    docs: DataFrame, found: Iterable[Index], threshold: float = THRESHOLD, overlap: float = OVERLAP
) -> DataFrame:
    """One row for each document and test item that it holds, over all indexes.

    ``docs`` needs ``doc_id`` and ``text``; others are ignored. Null and empty texts hold
    nothing. Rows that repeat an id are searched each. Without documents or items there is no row.
    Both overlaps of an item that is one text are the whole text's. Where another index
    follows, a pass's hits are written to the shared folder, so one index is held at a time.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, last = [], None
    for index in found:
        if last is not None:
            out.append(pinned(last, "hits"))
        last = arrow_map(rows, _search(index, threshold, overlap), HITS)
    for hits in out:
        last = last.unionByName(hits)
    return last


def _clean(index: Index, threshold: float, overlap: float, text_at: int):
    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for i in range(0, batch.num_rows, 64):
                texts = [words(t) for t in batch.column(text_at).slice(i, 64).to_pylist()]
                keep[[i + n for n, *_ in index.search(texts, threshold, overlap)]] = False
            yield batch.filter(pa.array(keep))

    return run


def decontaminated(
    docs: DataFrame, found: Iterable[Index], threshold: float = THRESHOLD, overlap: float = OVERLAP
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no test item.

    Where another index follows, what a pass kept is written to the shared folder.
    """
    kept, begun = docs, False
    for index in found:
        if begun:
            kept = pinned(kept, "kept")
        kept, begun = arrow_map(kept, _clean(index, threshold, overlap, docs.columns.index("text")), docs.schema), True
    return kept

"""Masked pseudo-likelihood of texts under a bidirectional window network trained on the corpus.

Every token is predicted from the two tokens before and the two after it: the sum of their
embeddings by place goes through tanh to a softmax over groups of symbols and another over the
symbols of the target's group. A document's score is the sum of the conditional log-probabilities
of its tokens.

Symbols are the most frequent words of the corpus, by counts over all documents, and hash classes
for all other words; both grow with the cube root of the corpus. A word of a class has the class's
probability times its share of the class's tokens, so each word of the corpus has its own.
Documents are numbered in chunks with a dictionary each; the dictionaries are joined with the
counts of all words on Spark, so no process holds the vocabulary. Training visits all documents in rounds: in each, every task starts from the
same weights, follows the gradient with each token of its documents as a target once, and the
tasks' weights are averaged by the number of tokens they saw. Weights meet in a grouped sum over parameters, so the driver holds one
network whatever the size of the corpus, and sums are of whole numbers, so their order is no
matter.
"""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.workers import arrow_map
from chatloom.session import pinned, unpin

#: The least numbers of frequent words and of classes; see ``sizes``.
TOP_WORDS = 127
CLASSES = 64
#: Tokens that share a dictionary: the more they are, the fewer rows its words make for each token.
CHUNK = 1 << 20
HIDDEN = 16
SIDE = 2
#: Each round has every token of all documents as a target once.
ROUNDS = 1
BATCH = 2048
#: Tokens that are scored at once; their number changes no score.
SCORED = 1 << 14
RATE = 0.1
_UNIT = 2.0 ** 20
_KEPT_WORDS = 300_000
#: Logarithms of counts, which are below 44, as whole numbers of 32 bits.
_LOG_UNIT = 2.0 ** 24

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_PLACES = [*range(-SIDE, 0), *range(1, SIDE + 1)]


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


# ---------------------------------------------------------------------------- symbols

class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = value = len(self)
        return value


def _packed(numbers: np.ndarray) -> bytes:
    """The lower halves of the numbers, then the upper halves, which are mostly zero and take little room."""
    halves = np.ascontiguousarray(numbers, "<u4").view("<u2").reshape(-1, 2)
    return halves.T.tobytes()


def _unpacked(packed: memoryview) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, "<u2").reshape(2, -1).T).view("<u4").reshape(-1)


def _chunks(batches):
    keys, found, numbers, size = [], [], _Numbers(), 0

    def put():
        ids = np.concatenate(found)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([keys], pa.list_(pa.int64())), pa.array([[len(x) for x in found]], pa.list_(pa.int64())),
                pa.array([_packed(ids)], pa.binary()), pa.array([list(numbers)], pa.list_(pa.string())),
                pa.array([np.bincount(ids, minlength=len(numbers))], pa.list_(pa.int64())),
            ],
            names=["doc_ids", "lengths", "ids", "words", "counts"],
        )

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            keys.append(doc_id)
            words = tokens(text.as_py())
            found.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
            size += len(found[-1])
            if size >= CHUNK:
                yield put()
                keys, found, numbers, size = [], [], _Numbers(), 0
    if keys:
        yield put()


def chunked(docs: DataFrame) -> DataFrame:
    """Documents by chunks: their tokens' numbers in the chunk's ``words``, and the words' ``counts``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(
        rows, _chunks, "doc_ids array<long>, lengths array<long>, ids binary, words array<string>, counts array<long>"
    ).withColumn("chunk", F.monotonically_increasing_id())


def _total_counts(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.inline(F.arrays_zip("words", "counts")).alias("word", "n")).groupBy("word").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` and how often it occurs in all texts."""
    return _total_counts(chunked(docs))


def sizes(n_tokens: int) -> tuple[int, int]:
    """Frequent words and classes for a corpus of so many tokens."""
    third = n_tokens ** (1 / 3) / 3
    return max(TOP_WORDS, round(2 * third)), max(CLASSES, round(third))


class Symbols(dict):
    """Number of a word: 0 stands for the text's ends, then frequent words, then hash classes."""

    def __init__(self, frequent: list[str], classes: int = CLASSES):
        super().__init__((w, i + 1) for i, w in enumerate(frequent))
        self.first, self.classes = len(frequent) + 1, classes
        self.size = self.first + classes
        self._frequent = dict(self)

    def __missing__(self, word: str) -> int:
        value = self.first + zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.classes
        if len(self) >= _KEPT_WORDS:
            self.clear()
            self.update(self._frequent)
        self[word] = value
        return value

    def __reduce__(self):
        return Symbols, (list(self._frequent), self.classes)


def _class_totals(counts: DataFrame, frequent: list[tuple[str, int]], classes: int) -> np.ndarray:
    """Tokens of each class, which the frequent words are not in."""
    number = F.crc32(F.col("word").cast("binary")) % classes
    totals = np.zeros(classes, np.int64)
    for row in counts.groupBy(number.alias("class")).agg(F.sum("n").alias("n")).collect():
        totals[row["class"]] = row["n"]
    for word, n in frequent:
        totals[zlib.crc32(word.encode()) % classes] -= n
    return totals


def _encode(symbols: Symbols, totals: np.ndarray):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                keys, lengths, words, logs = (batch.column(n)[row].values for n in ("doc_ids", "lengths", "words", "logs"))
                lengths, words = lengths.to_numpy(), words.to_pylist()
                symbol = np.fromiter(map(symbols.__getitem__, words), np.uint32, len(words))
                share = np.zeros(len(words))
                rare = symbol >= symbols.first
                logs = (np.zeros(0, np.int64) if logs is None else logs.to_numpy() & 0xFFFFFFFF) / _LOG_UNIT
                share[rare] = logs[rare] - np.log(totals[symbol[rare] - symbols.first])
                ids = _unpacked(batch.column("ids")[row].as_buffer())
                sums = np.bincount(np.repeat(np.arange(len(keys)), lengths), share[ids], len(keys))
                found = [x.tobytes() for x in np.split(symbol[ids], np.cumsum(lengths)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(sums), pa.array(found, pa.binary())], names=["doc_id", "in_class", "ids"]
                )

    return run


def encoded(docs: DataFrame, top_words: int | None = None, classes: int | None = None) -> tuple[DataFrame, int]:
    """Documents as ``ids`` of symbols, and how many symbols there are.

    ``in_class`` sums the log-probabilities of a document's words within their classes.
    """
    chunks = pinned(chunked(docs), "chunks")
    counts = pinned(_total_counts(chunks), "word-counts")
    grown = sizes(counts.agg(F.sum("n").alias("n")).head()["n"] or 0)
    top_words, classes = (own if given is None else given for given, own in zip((top_words, classes), grown, strict=True))
    frequent = [(r["word"], r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(top_words).collect()]
    symbols = Symbols([w for w, _ in frequent], classes)
    entries = chunks.select("chunk", F.posexplode("words").alias("at", "word")).join(counts, "word")
    # place and logarithm in one number: a struct takes four times the room in the shuffle
    entry = F.shiftleft(F.col("at").cast("long"), 32) + F.round(F.log("n") * _LOG_UNIT).cast("long")
    known = entries.select("chunk", entry.alias("entry")).groupBy("chunk").agg(F.sort_array(F.collect_list("entry")).alias("logs"))
    rows = chunks.join(known, "chunk", "left").select("doc_ids", "lengths", "ids", "words", "logs")
    encode = _encode(symbols, _class_totals(counts, frequent, classes))
    found = pinned(arrow_map(rows, encode, "doc_id long, in_class double, ids binary"), "symbols")
    unpin(chunks, counts)
    return found, symbols.size


# ---------------------------------------------------------------------------- network

def _logits(h: np.ndarray, out: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """One row for each symbol, so that sums over symbols run along memory."""
    y = out.T @ h.T
    y += bias[:, None]
    y -= y.max(axis=0)
    return y


def _log_softmax_at(h: np.ndarray, out: np.ndarray, bias: np.ndarray, target: np.ndarray) -> np.ndarray:
    y = _logits(h, out, bias)
    own = y[target, np.arange(len(target))].astype(np.float64)
    return own - np.log(np.exp(y, out=y).sum(axis=0))


def _slopes(h: np.ndarray, out: np.ndarray, bias: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the sum of negative log-probabilities, by ``h``, ``out`` and ``bias``."""
    y = _logits(h, out, bias)
    np.exp(y, out=y)
    y /= y.sum(axis=0)
    y[target, np.arange(len(target))] -= 1
    return (out @ y).T, (y @ h).T, y.sum(axis=1)


class Network:
    """``own`` holds all weights in one row of numbers; the others are views of it.

    Symbols are in groups of ``members`` neighbours, about as many as there are groups.
    """

    def __init__(self, size: int, hidden: int = HIDDEN, own: np.ndarray | None = None):
        self.size, self.hidden = size, hidden
        self.members = math.isqrt(max(size - 1, 0)) + 1
        self.groups = -(-size // self.members)
        self.shapes = [(len(_PLACES), size, hidden), (hidden,), (hidden, self.groups), (self.groups,), (hidden, size), (size,)]
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes])
        if own is None:
            own = (np.random.default_rng(3).standard_normal(ends[-1]) * 0.1).astype(np.float32)
        self.own = own
        self.embed, self.shift, self.top, self.top_bias, self.out, self.bias = self._views(own)

    def _views(self, row: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes])
        return [x.reshape(s) for x, s in zip(np.split(row, ends[:-1]), self.shapes, strict=True)]

    def _forward(self, context: np.ndarray) -> np.ndarray:
        x = self.embed[0].take(context[0], axis=0)
        for place in range(1, len(_PLACES)):
            x += self.embed[place].take(context[place], axis=0)
        x += self.shift
        return np.tanh(x, out=x)

    def _by_group(self, target: np.ndarray):
        """The order of ``target`` by groups, the groups in that order, and what is of each: its symbols and its run."""
        group = target // self.members
        order = np.argsort(group.astype(np.uint16) if self.groups <= 1 << 16 else group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=self.groups)).tolist()
        runs = [
            (slice(g * self.members, (g + 1) * self.members), slice(a, b))
            for g, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if a < b
        ]
        return order, group[order], runs

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        order, group, runs = self._by_group(target)
        h, sorted_target = self._forward(context[:, order]), target[order].astype(np.int64)
        found = _log_softmax_at(h, self.top, self.top_bias, group)
        for of, run in runs:
            found[run] += _log_softmax_at(h[run], self.out[:, of], self.bias[of], sorted_target[run] - of.start)
        out = np.empty_like(found)
        out[order] = found
        return out

    def gradient(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the mean negative log-probability, in the order of ``own``."""
        order, group, runs = self._by_group(target)
        context, target = context[:, order].astype(np.int64), target[order].astype(np.int64)
        h = self._forward(context)
        found = np.zeros(len(self.own), self.own.dtype)
        embed, shift, top, top_bias, out, bias = self._views(found)
        back, top[:], top_bias[:] = _slopes(h, self.top, self.top_bias, group)
        for of, run in runs:
            inner, out[:, of], bias[of] = _slopes(h[run], self.out[:, of], self.bias[of], target[run] - of.start)
            back[run] += inner
        back *= 1 - h * h
        shift[:] = back.sum(axis=0)
        places, flat = np.arange(self.hidden), back.ravel().astype(np.float64)
        for at, c in enumerate(context):
            keys = (c[:, None] * self.hidden + places).ravel()
            embed[at] = np.bincount(keys, flat, self.size * self.hidden).reshape(self.size, self.hidden)
        found /= len(target)
        return found


def windows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents in one row of symbols with their ends marked, and the places of their tokens in it."""
    gap = np.zeros(SIDE, np.uint32)
    line = np.concatenate([gap, *(x for d in docs for x in (d, gap))])
    lengths = np.array([len(d) for d in docs])
    starts = SIDE + np.concatenate(([0], np.cumsum(lengths + SIDE)[:-1]))
    places = np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return line, places


def _context(line: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.stack([line[places + d] for d in _PLACES])


def _batches_of_documents(batches, least: int):
    """(other columns, ids) of documents, at least ``least`` tokens at a time."""
    keys, held, size = [], [], 0
    for batch in batches:
        others = zip(*(batch.column(n).to_pylist() for n in batch.schema.names if n != "ids"), strict=True)
        for key, ids in zip(others, batch.column("ids"), strict=True):
            keys.append(key)
            held.append(np.frombuffer(ids.as_py(), np.uint32))
            size += len(held[-1])
            if size >= least:
                yield keys, held
                keys, held, size = [], [], 0
    if keys:
        yield keys, held


def _train(size: int, hidden: int, start: np.ndarray, turn: int):
    def run(batches):
        network = Network(size, hidden, start.copy())
        squares, seen = np.full(len(start), 1e-6, np.float32), 0
        rng = np.random.default_rng(turn)
        for _, docs in _batches_of_documents(batches, BATCH * 64):
            line, places = windows(docs)
            places = rng.permutation(places)
            for i in range(0, len(places), BATCH):
                some = places[i:i + BATCH]
                slope = network.gradient(_context(line, some), line[some])
                squares += slope * slope
                network.own -= RATE * slope / np.sqrt(squares)
                seen += len(some)
        if seen:
            weighted = np.rint(network.own.astype(np.float64) * seen * _UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(start) + 1)), pa.array(np.append(weighted, seen))], names=["at", "x"]
            )

    return run


def train(rows: DataFrame, size: int, hidden: int = HIDDEN, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the network after ``rounds`` over all documents; without tokens, the first ones."""
    weights = Network(size, hidden).own
    for turn in range(rounds):
        sums = (
            arrow_map(rows, _train(size, hidden, weights, turn), "at long, x long")
            .groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).cast("double").alias("x")).toPandas().sort_values("at")
        )
        if sums.empty:
            break
        total = sums["x"].to_numpy(np.float64)
        weights = (total[:-1] / total[-1] / _UNIT).astype(np.float32)
    return weights


def _score(size: int, hidden: int, weights: np.ndarray):
    def run(batches):
        network = Network(size, hidden, weights)
        for keys, docs in _batches_of_documents(batches, 1 << 16):
            line, places = windows(docs)
            parts = [places[i:i + SCORED] for i in range(0, len(places), SCORED)]
            found = np.concatenate([np.zeros(0), *(network.log_probabilities(_context(line, p), line[p]) for p in parts)])
            lengths = np.array([len(d) for d in docs])
            doc_ids, in_class = zip(*keys, strict=True)
            sums = np.bincount(np.repeat(np.arange(len(docs)), lengths), found, len(docs)) + in_class
            means = pa.array(sums / np.maximum(lengths, 1), mask=lengths == 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(lengths), pa.array(sums), means],
                names=["doc_id", "n_tokens", "log_prob", "mean_log_prob"],
            )

    return run


def scored(docs: DataFrame, top_words: int | None = None, classes: int | None = None, hidden: int = HIDDEN, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``n_tokens``, the sum ``log_prob`` and its mean a token, of each whole text.

    The network is trained on the texts of ``docs`` themselves. A text without tokens, a null
    one too, has sum 0 and a null mean. Rows that repeat an id are scored each; an empty table
    gives no row; columns other than ``doc_id`` and ``text`` are ignored. Without ``top_words``
    and ``classes``, their numbers follow the corpus.
    """
    rows, size = encoded(docs, top_words, classes)
    weights = train(rows, size, hidden, rounds)
    return arrow_map(
        rows.select("doc_id", "in_class", "ids"), _score(size, hidden, weights),
        "doc_id long, n_tokens long, log_prob double, mean_log_prob double",
    )

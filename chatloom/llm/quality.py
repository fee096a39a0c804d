"""Quality of texts by logistic regression over hashed word n-grams, trained with FTRL-proximal.

Features of a text are its words and pairs of words, hashed to slots, and pairs of word shapes
(capitals, digits, a word said again, runs of marks), in slots of their own. A feature's value is
its share among the text's features of its kind (and a few more, for short texts), so long and short
texts compare and a score is three sums of weights over lengths, and a bias.
"""

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.workers import arrow_map, group_map

THRESHOLD = 0.7
#: At most so many labelled documents are learned from: the first by a hash of their id.
MAX_LABELLED = 16_384
#: Followers of the regularised leader, each with an equal part of them; their weights are averaged.
SHARDS = 8
EPOCHS = 6
SLOTS = 2 ** 18
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.001, 0.001

#: Added to the number of a text's features, so that a few words do not decide like many.
SMOOTHING = 10

_WORD = re.compile(r"\w+|[^\w\s]+")
_DIGIT = re.compile(r"[0-9]")
_KEPT_WORDS = 300_000
_SHAPES = 16
_SHAPE_PAIRS = _SHAPES * _SHAPES
_SAME = 15  # the word before, once more
SIZE = SLOTS + _SHAPE_PAIRS


def _shape(word: str) -> int:
    first = word[0]
    if first.isalnum() or first == "_":
        if word.isdigit():
            return 1
        if not word.isalpha():
            return 2
        if word.isupper():
            return 3 if len(word) == 1 else 4
        if word.islower():
            return 5
        return 6 if first.isupper() and word[1:].islower() else 7
    if len(word) == 1:
        return 8 if word in ".,;:" else 9
    return 10 if word.strip(word[0]) else 11  # unlike or like marks


class Words(dict):
    """Word to (hash, shape) in one number; kept for the words met most recently."""

    def __missing__(self, word: str) -> int:
        like = _DIGIT.sub("0", word.lower())  # numbers of equal length are one word
        value = zlib.crc32(like.encode("utf-8", "surrogatepass")) << 4 | _shape(word)
        if len(self) >= _KEPT_WORDS:
            self.clear()
        self[word] = value
        return value


_WORDS = Words()


def features(text: str | None) -> list[np.ndarray]:
    """Slots of a text's words, pairs of words and pairs of shapes, repeats included."""
    found = np.array([_WORDS[w] for w in _WORD.findall(text or "")], np.int64)
    word, shape = found >> 4, found & 15
    same = np.zeros(len(found), bool)
    same[1:] = word[1:] == word[:-1]
    shape[same] = _SAME
    pairs = (word[:-1] * 1_000_003 + word[1:] * 31) % 2_147_483_647 % SLOTS
    return [word % SLOTS, pairs, SLOTS + shape[:-1] * _SHAPES + shape[1:]]


def shares(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The sparse vector of a text: slots and values."""
    kinds = features(text)
    slots = np.concatenate(kinds)
    values = np.concatenate([np.full(len(k), 1.0 / (len(k) + SMOOTHING)) for k in kinds])
    slots, place = np.unique(slots, return_inverse=True)
    return slots, np.bincount(place, values, len(slots))


class Follower:
    """FTRL-proximal with weights by slot; the last is the bias, which is not shrunk."""

    def __init__(self, size: int = SIZE):
        self.z, self.n, self.w = (np.zeros(size + 1) for _ in range(3))

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        slots, values = np.append(slots, len(self.w) - 1), np.append(values, 1.0)
        w, n = self.w[slots], self.n[slots]
        slope = (probability(float(w @ values)) - label) * values
        grown = n + slope * slope
        z = self.z[slots] + slope - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * w
        self.z[slots], self.n[slots] = z, grown
        l1 = np.full(len(slots), L1)
        l1[-1] = 0
        self.w[slots] = np.where(
            np.abs(z) <= l1, 0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(grown)) / ALPHA + L2)
        )


def probability(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def _learn(epochs: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "doc_id", "text"], na_position="first")
        seen = [(*shares(t), int(y)) for t, y in zip(rows["text"], rows["label"], strict=True)]
        follower = Follower()
        for epoch in range(epochs):
            for i in np.random.default_rng(epoch).permutation(len(seen)):
                follower.learn(*seen[i])
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "rows": [len(seen)], "weights": [follower.w.tobytes()]})

    return run


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``label`` 0 or 1).

    At most ``max_labelled`` labelled ids are used, the first by a hash of the id; that bounds
    the broadcast side of the join and the work. An id labelled both ways counts as 0; of rows
    that share an id, the smallest text counts; rows with a null id or label do not. Without labelled rows nothing speaks against a text:
    the weights then give every text 1.
    """
    label = F.col("label").cast("int")
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.alias("label"))
        .where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
        .withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(max_labelled)
    )
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(known), "doc_id").groupBy("doc_id", "label", "place").agg(F.min("text").alias("text"))
        .withColumn("shard", F.pmod("place", F.lit(SHARDS)).cast("int"))
    )
    found = group_map(
        docs.sparkSession, rows.groupBy("shard"), _learn(epochs), "shard int, rows long, weights binary"
    ).toPandas().sort_values("shard")
    if found.empty:
        weights = np.zeros(SIZE + 1)
        weights[-1] = 40
        return weights.astype(np.float32)
    each = np.stack([np.frombuffer(x, np.float64) for x in found["weights"]])
    return np.average(each, axis=0, weights=found["rows"]).astype(np.float32)


def score(text: str | None, weights: np.ndarray) -> float:
    """The probability of label 1; a text without words has that of the bias."""
    return probability(float(weights[-1]) + sum(
        float(weights[k].sum(dtype=np.float64)) / (len(k) + SMOOTHING) for k in features(text)
    ))


def _score(weights: np.ndarray, text_at: int, keep: float | None):
    def run(batches):
        for batch in batches:
            found = np.array([score(x.as_py(), weights) for x in batch.column(text_at)], np.float64)
            if keep is None:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])
            else:
                yield batch.filter(pa.array(found >= keep))

    return run


def scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every whole text; a null text counts as empty.

    Rows that repeat an id are scored each for themselves; an empty table gives no row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, _score(weights, 1, None), "doc_id long, score double")


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores ``threshold`` or more."""
    return arrow_map(docs, _score(weights, docs.columns.index("text"), threshold), docs.schema)

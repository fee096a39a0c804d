"""Feature columns and vectors."""

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, IDF, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

# The feature columns and the number of term buckets.
STATS_FEATURES = ["chats", "videoDays", "uniqueChatters", "totalBodyLength"]
TERM_BUCKETS = 100_000
HASH_BITS = 128  # of md5, so a token's vector has at most so many dimensions
#: Tokens whose bits are held at once in a Python worker, but for a longer list.
TOKENS_AT_ONCE = 1 << 17


def assemble(stats: DataFrame, columns: list[str] = STATS_FEATURES) -> DataFrame:
    """Numeric columns as one vector ``features``; a NULL among them is an error, as no row may vanish."""
    return VectorAssembler(
        inputCols=columns, outputCol="features", handleInvalid="error"
    ).transform(stats)


def term_frequency(words: str = "words", buckets: int = TERM_BUCKETS) -> HashingTF:
    return HashingTF(inputCol=words, outputCol="termCounts", numFeatures=buckets)


def inverse_document_frequency(min_documents: int = 2) -> IDF:
    return IDF(inputCol="termCounts", outputCol="features", minDocFreq=min_documents)


def tfidf(words: str = "words", buckets: int = TERM_BUCKETS, min_documents: int = 2) -> Pipeline:
    """Hashed term counts weighted by inverse document frequency, as sparse vectors.

    The fitted state is one number per bucket, however many documents there are.
    """
    return Pipeline(stages=[
        term_frequency(words, buckets), inverse_document_frequency(min_documents)
    ])


def document_frequency(df: DataFrame, words: Column) -> DataFrame:
    """Number of rows that hold each token; a token counts once per row before any shuffle."""
    return (
        df.select(F.explode(F.array_distinct(words)).alias("token"))
        .where(F.col("token") != "")
        .groupBy("token").agg(F.count("*").alias("df"))
    )


def term_idf(df: DataFrame, words: Column, min_documents: int = 2) -> DataFrame:
    """ln((N + 1) / (df + 1)) per token; 0 for tokens in fewer than ``min_documents`` rows."""
    rows = df.agg(F.count("*").alias("n")).scalar()
    idf = F.log((rows + 1) / (F.col("df") + 1))
    return document_frequency(df, words).withColumn(
        "idf", F.when(F.col("df") >= min_documents, idf).otherwise(0.0)
    )


def _bit_counter(size: int):
    """Counts over lists of tokens, for use in tasks: defined inside, so workers need no import of this package."""
    rows = -(-size // 8) * 8

    def counts(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each list its tokens, and how many of them have each of the first ``size`` bits of their md5, highest first."""
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(lists).dictionary_encode()
        texts = coded.dictionary.cast(pa.binary() if pa.types.is_string(coded.dictionary.type) else pa.large_binary())
        digests = b"".join(hashlib.md5(t, usedforsecurity=False).digest() for t in texts.to_pylist())
        bits = np.unpackbits(np.frombuffer(digests + bytes(16), np.uint8).reshape(-1, 16), axis=1)[:, :rows]
        code = pc.fill_null(coded.indices, len(texts)).to_numpy(zero_copy_only=False)  # a null token has no bits
        ends = np.cumsum(lengths)
        known = np.concatenate(([0], np.cumsum(code < len(texts))))
        found = np.zeros((len(lengths), rows), np.int64)
        if len(code):
            # runs of at most 255 tokens are added eight counts at a time, as none of them passes its byte
            runs = -(-lengths // 255)
            first = np.cumsum(runs) - runs
            starts = np.repeat(ends - lengths - 255 * first, runs) + 255 * np.arange(runs.sum())
            eights = np.ascontiguousarray(bits).view(np.uint64)
            sums = np.add.reduceat(eights[code], starts, axis=0).view(np.uint8).astype(np.int64)
            found[runs > 0] = np.add.reduceat(sums, first[runs > 0], axis=0)
        return known[ends] - known[ends - lengths], found[:, :size]

    return counts


def _vector_rows(keys: int, size: int, nested: bool, names: list[str]):
    """What a task does with rows of ``keys`` columns and a list of tokens, or a list of such lists where ``nested``."""
    count, most = _bit_counter(size), TOKENS_AT_ONCE

    def slices(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Neighbouring rows of at most ``most`` tokens together, or one row."""
        ends, start = np.cumsum(sizes), 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop

    def vectors(lists: pa.Array) -> np.ndarray:
        outer = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        n, ones = count(pc.list_flatten(lists))
        each = np.where(n[:, None] > 0, 2 * ones / np.maximum(n, 1)[:, None] - 1, 0.0)
        found = np.zeros((len(outer), size))
        if len(each):
            found[outer > 0] = np.add.reduceat(each, (np.cumsum(outer) - outer)[outer > 0], axis=0) / outer[outer > 0, None]
        return found

    def as_lists(matrix: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * size, pa.int32()), pa.array(matrix.reshape(-1)))

    def run(batches):
        for batch in batches:
            lists = batch.column(keys)
            inner = lists
            if nested:
                outer = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                inner = pc.list_flatten(lists)
            sizes = pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            if nested:
                before = np.concatenate(([0], np.cumsum(sizes)))
                sizes = before[np.cumsum(outer)] - before[np.cumsum(outer) - outer]
            for some in slices(batch, sizes):
                if nested:
                    own = [as_lists(vectors(some.column(keys)))]
                else:
                    n, ones = count(some.column(keys))
                    own = [pa.array(n, pa.int64()), as_lists(ones)]
                yield pa.RecordBatch.from_arrays([*some.columns[:keys], *own], names=names)

    return run


def hashed_vectors(
    df: DataFrame, key: str | Sequence[str], words: str = "words", size: int = 64, name: str = "vector"
) -> DataFrame:
    """Mean token vector per key, as an array; keys without tokens get zeros.

    A token's vector is fixed: +1 or -1 by each of the first ``size`` bits of its md5. There is no
    vocabulary, no token is too rare, and nothing is trained. A row's bits are counted in its
    task, each distinct token of a batch hashed once; the shuffle has one row of counts per row of ``df`` at most.
    """
    if not 0 < size <= HASH_BITS:
        raise ValueError(f"size must lie in [1, {HASH_BITS}], got {size}")
    keys = [key] if isinstance(key, str) else list(key)
    rows = df.select(*keys, F.col(words).alias("_words"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("_tokens", T.LongType()), T.StructField("_ones", T.ArrayType(T.LongType()))])
    counted = rows.mapInArrow(_vector_rows(len(keys), size, False, schema.names), schema)
    ones = [F.sum(F.get("_ones", F.lit(i))).alias(f"_bit{i}") for i in range(size)]
    sums = counted.groupBy(*keys).agg(F.sum("_tokens").alias("_n"), *ones)
    mean = [F.when(F.col("_n") > 0, 2 * F.col(f"_bit{i}") / F.col("_n") - 1).otherwise(0.0) for i in range(size)]
    return sums.select(*keys, F.array(*mean).alias(name))


def hashed_list_vectors(
    df: DataFrame, key: str | Sequence[str], lists: str, size: int = 64, name: str = "vector"
) -> DataFrame:
    """For each row its key and the mean, over its lists of tokens, of each list's mean token vector; without lists zeros.

    As ``hashed_vectors``, without a shuffle: rows that share a key stay rows.
    """
    if not 0 < size <= HASH_BITS:
        raise ValueError(f"size must lie in [1, {HASH_BITS}], got {size}")
    keys = [key] if isinstance(key, str) else list(key)
    rows = df.select(*keys, F.col(lists).alias("_lists"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(name, T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(_vector_rows(len(keys), size, True, schema.names), schema)


def term_tfidf(
    df: DataFrame, key: str | Sequence[str], words: Column, min_documents: int = 2
) -> DataFrame:
    """``tf`` and ``tfidf`` of each token of each row, without hashing.

    ``key`` must identify rows. The result is as long as the rows' distinct tokens, and the
    join with the tokens' weights is on the token.
    """
    keys = [key] if isinstance(key, str) else list(key)
    tokens = df.select(*keys, F.explode(words).alias("token")).where(F.col("token") != "")
    counts = tokens.groupBy(*keys, "token").agg(F.count("*").alias("tf"))
    weights = term_idf(df, words, min_documents).select("token", "idf")
    return counts.join(weights, "token").select(
        *keys, "token", "tf", (F.col("tf") * F.col("idf")).alias("tfidf")
    )


def vector_column(df: DataFrame, column: str, name: str = "features") -> DataFrame:
    """An array of numbers, such as vectors made elsewhere, as an ML vector."""
    return df.withColumn(name, array_to_vector(F.col(column)))


def mean_pool(
    df: DataFrame, key: str | Sequence[str], column: str, name: str = "vector"
) -> DataFrame:
    """Mean vector per key, as an array, of an array or vector column.

    Vectors are summed before the shuffle, one buffer per key and task, so neither a hot key
    nor the number of dimensions multiplies the rows shuffled.
    """
    keys = [key] if isinstance(key, str) else list(key)
    vector = F.col(column)
    if not isinstance(df.schema[column].dataType, VectorUDT):
        vector = array_to_vector(vector)
    vectors = df.where(F.col(column).isNotNull()).select(*keys, vector.alias("_vector"))
    mean = vector_to_array(Summarizer.mean(F.col("_vector")))
    return vectors.groupBy(*keys).agg(mean.alias(name))

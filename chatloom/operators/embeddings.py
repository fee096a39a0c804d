"""Token vectors trained on what stands near what: counts, PPMI, and its leading eigenvectors.

The vocabulary is a table from first to last. The driver sees ``size`` by ``size`` matrices and the
distinct numbers of meetings of tokens alone, and tokens are joined with vectors by key, so neither the vocabulary nor the pairs need to fit
anywhere whole. Products with the small matrices are numpy's, on Arrow batches.
"""

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..session import pinned, unpin

#: Directions beyond those asked for, which the iteration carries along to converge sooner.
SPARE = 8
#: Tokens that share a dictionary, and whose meetings are counted together in a task.
CHUNK = 1 << 22
#: Meetings that a task holds at once: of a chunk, a part of its pairs after the other, and of the corpus those of a bucket.
HELD = 1 << 22
#: Meetings of the buckets that one task counts, one bucket after the other.
TASK = 1 << 25


def cooccurrences(df: DataFrame, words: Column, window: int = 5) -> DataFrame:
    """``a``, ``b`` and ``n``: how often two tokens stand at most ``window`` places apart.

    Symmetric: each meeting counts for (a, b) and for (b, a), that of a token with itself twice.
    Pairs are counted before any shuffle and shuffled in one direction only. Empty tokens
    take no place.
    """
    named = F.filter(words, lambda w: w != "")
    # written first: inside the functions below the optimizer would cut each text anew for every step
    rows = pinned(df.select(named.alias("_words")), "words").where(F.size("_words") > 1)
    meetings = F.flatten(F.transform(
        F.sequence(F.lit(1), F.least(F.lit(window), F.size("_words") - 1)),
        lambda step: F.zip_with(
            F.slice("_words", 1, F.size("_words") - step), F.slice("_words", step + 1, F.size("_words")),
            lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")),
        ),
    ))
    one_way = rows.select(F.explode(meetings).alias("_pair")).groupBy("_pair.a", "_pair.b").agg(F.count("*").alias("n"))
    ends = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", (2 * F.col("n")).alias("n")))).otherwise(
        F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    )
    return one_way.select(F.inline(ends))


def _coding():
    """Functions that write arrays of numbers from 0 on as few bytes, and read them again."""
    def pack(*arrays) -> bytes:
        out = []
        for x in arrays:
            width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
            # lowest bytes of all numbers first: higher ones are mostly zero
            planes = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
            out += [np.array([len(x), width], "<u4").tobytes(), planes.tobytes()]
        deflate = zlib.compressobj(1, strategy=zlib.Z_RLE)
        return deflate.compress(b"".join(out)) + deflate.flush()

    def unpack(packed: bytes) -> list[np.ndarray]:
        raw, at, arrays = zlib.decompress(packed), 0, []
        while at < len(raw):
            size, width = np.frombuffer(raw, "<u4", 2, at).tolist()
            x = np.zeros((size, 8), np.uint8)
            x[:, :width] = np.frombuffer(raw, np.uint8, size * width, at + 8).reshape(width, size).T
            arrays.append(x.view("<i8").reshape(-1))
            at += 8 + size * width
        return arrays

    return pack, unpack


def _numbered_chunks(window: int, most: int):
    """Lists of tokens as numbers in a dictionary, which also has each token's meetings."""
    pack, _ = _coding()

    def chunk(held):
        lists = pa.concat_arrays(held)
        own = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(lists).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        before = np.arange(len(code)) - np.repeat(np.cumsum(own) - own, own)
        meets = np.minimum(before, window) + np.minimum(np.repeat(own, own) - 1 - before, window)
        meetings = np.bincount(code, meets, len(coded.dictionary)).astype(np.int64)
        columns = [pa.array([pack(own, code)], pa.binary()), *(
            pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (coded.dictionary.cast(pa.string()), pa.array(meetings))
        )]
        return pa.RecordBatch.from_arrays(columns, names=["lists", "words", "meetings"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            lists = batch.column(0)
            ends, start = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while start < len(ends):
                done = int(ends[start - 1]) if start else 0
                stop = int(np.searchsorted(ends, done + most - n, "right"))
                if stop == start and not held:
                    stop += 1  # a longer list has a chunk by itself
                if stop > start:
                    held.append(lists.slice(start, stop - start))
                    n += int(ends[stop - 1]) - done
                if stop < len(ends):
                    yield chunk(held)
                    held, n = [], 0
                start = stop
        if held:
            yield chunk(held)

    return run


def _chunk_pairs(window: int, buckets: int, tokens: int, most: int):
    """Meetings in a chunk, once for two tokens, as a row of bytes for each bucket: the token with the larger id,
    which meets less, is dealt by that id; its partners are written as steps."""
    pack, unpack = _coding()
    width = -(-tokens // buckets)

    def run(chunk, entries):
        sizes, code = unpack(chunk["lists"][0].as_py())
        ids = np.full(int(code.max(initial=-1)) + 1, -1, np.int32)
        ids[entries["at"].to_numpy()] = entries["id"].to_numpy()
        dealt = ids % buckets * width + ids // buckets  # buckets one after the other
        at, place, doc = ids[code], dealt[code], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        number, packed = [], []
        parts = max(1, min(buckets, -(-len(code) * window // most)))
        bounds = np.arange(parts + 1) * buckets // parts
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            met = []
            for step in range(1, window + 1):
                x, y = at[:-step], at[step:]
                rare = np.where(x > y, place[:-step], place[step:])
                both = (doc[step:] == doc[:-step]) & (np.minimum(x, y) >= 0) & (rare >= low * width) & (rare < high * width)
                met.append((rare[both].astype(np.int64) << 32) + np.minimum(x[both], y[both]))
            pair, n = np.unique(np.concatenate(met), return_counts=True)
            rare, other = pair >> 32, pair & 0xFFFFFFFF
            ends = np.searchsorted(rare, np.arange(low, high + 1) * width)
            for bucket, start, stop in zip(range(low, high), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if stop > start:
                    own = rare[start:stop] - bucket * width
                    first = np.flatnonzero(np.diff(own, prepend=-1))
                    steps = np.diff(other[start:stop], prepend=0)
                    steps[first] = other[start:stop][first]
                    number.append(bucket)
                    packed.append(pack(np.diff(own[first], prepend=0), np.diff(first, append=stop - start), steps, n[start:stop] - 1))
        return pa.table([pa.array(number, pa.int64()), pa.array(packed, pa.binary())], names=["a_bucket", "pairs"])

    return run


def _bucket_pairs(buckets: int, levels: tuple[np.ndarray, np.ndarray]):
    """Pairs of a bucket with their meetings in all chunks; ``levels`` are meetings of a token and the first id that has so many."""
    _, unpack = _coding()
    meetings, first_id = levels

    def counted(chunks):
        keys, counts = [], []
        for packed in chunks:
            own, partners, steps, n = unpack(packed.as_py())
            sums = np.cumsum(steps)
            first = np.cumsum(partners) - partners
            other = sums - np.repeat(sums[first] - steps[first], partners)
            keys.append((np.repeat(np.cumsum(own), partners) << 32) + other)
            counts.append(n + 1)
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        start = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[start], np.add.reduceat(counts, start)

    def run(batches):
        for batch in batches:
            for bucket, chunks in zip(batch.column("a_bucket").to_pylist(), batch.column("pairs"), strict=True):
                keys, counts = counted(chunks.values)
                for k in range(0, len(keys), 1 << 17):
                    some = keys[k:k + (1 << 17)]
                    a, b = (some >> 32) * buckets + bucket, some & 0xFFFFFFFF
                    of_a, of_b = (meetings[np.searchsorted(first_id, x, "right") - 1] for x in (a, b))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (a, b, of_a, of_b, counts[k:k + (1 << 17)])], names=["a", "b", "of_a", "of_b", "n"]
                    )

    return run


def _ranked(totals: DataFrame) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """``totals`` with an ``id`` from 0 on in falling order of ``of``, and the levels: each ``of`` with its first id.

    Their number is at most the root of twice the sum of ``of``; they and a number for each partition are all the driver sees.
    """
    ordered = totals.orderBy(F.col("of").desc(), "token").withColumn("_id", F.monotonically_increasing_id())
    names = pinned(ordered, "names")
    sizes = dict(names.groupBy(F.shiftright("_id", 33)).count().collect())
    starts, total = [], 0
    for part in range(max(sizes, default=0) + 1):
        starts.append(total)
        total += sizes.get(part, 0)
    start = F.element_at(F.array(*map(F.lit, starts)).cast("array<long>"), (F.shiftright("_id", 33) + 1).cast("int"))
    levels = np.array(sorted(map(tuple, names.groupBy("of").count().collect()), reverse=True), np.int64).reshape(-1, 2)
    ids = start + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return names.select("token", ids.alias("id"), "of"), (levels[:, 0], np.cumsum(levels[:, 1]) - levels[:, 1])


def numbered_cooccurrences(df: DataFrame, words: Column, window: int = 5, min_count: int = 1) -> tuple[DataFrame, DataFrame]:
    """``cooccurrences`` with numbers for tokens, and the table of their names (``token``, ``id``, ``of``).

    The pairs carry ``of_a``, ``of_b`` and ``of_all``, the meetings of their tokens and of all, which are known
    from the tokens' places before any pair is counted. Tokens get their numbers by dictionaries of many texts, in
    falling order of their meetings. So a chunk's pairs travel as small steps between numbers, a few bytes each, and
    their totals are looked up by number where a bucket of pairs is counted, whole and by itself. Tokens that take part
    in fewer than ``min_count`` meetings stay in the totals and names but have no pair.
    """
    named = df.select(F.filter(words, lambda w: w != "").alias("_words"))
    lists = named.mapInArrow(_numbered_chunks(window, CHUNK), "lists binary, words array<string>, meetings array<long>")
    chunks = pinned(lists.withColumn("chunk", F.monotonically_increasing_id()), "chunks", 16 << 20)
    met = chunks.select(F.inline(F.arrays_zip("words", "meetings")).alias("token", "n"))
    names, levels = _ranked(pinned(met.groupBy("token").agg(F.sum("n").alias("of")), "totals"))
    of, first_id = levels
    tokens = names.count()
    everything = int(of @ np.diff(first_id, append=tokens))
    buckets = max(1, min(tokens, everything // 2 // HELD))
    if tokens + buckets >= 1 << 31:
        raise ValueError(f"{tokens} distinct tokens: a pair is held in 64 bits, so there may be 2**31")
    tasks = min(buckets, max(df.sparkSession.sparkContext.defaultParallelism, everything // 2 // TASK))
    entries = chunks.select(F.col("chunk").alias("of_chunk"), F.posexplode("words").alias("at", "token"))
    entries = entries.join(names.where(F.col("of") >= min_count), "token").select("of_chunk", "at", "id")
    packed = chunks.select("chunk", "lists").groupBy("chunk").cogroup(entries.groupBy("of_chunk")).applyInArrow(
        _chunk_pairs(window, buckets, max(1, tokens), HELD), "a_bucket long, pairs binary"
    )
    dealt = packed.repartition(tasks, "a_bucket").groupBy("a_bucket").agg(F.collect_list("pairs").alias("pairs"))
    one_way = dealt.mapInArrow(_bucket_pairs(buckets, levels), "a long, b long, of_a long, of_b long, n long")
    there = F.struct("a", "b", "of_a", "of_b", F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n")).alias("n"))
    back = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("of_b").alias("of_a"), F.col("of_a").alias("of_b"), "n")
    ends = F.when(F.col("a") == F.col("b"), F.array(there)).otherwise(F.array(there, back))
    return one_way.select(F.inline(ends)).withColumn("of_all", F.lit(everything).cast("long")), names


def positive_pmi(pairs: DataFrame, min_count: int = 1) -> DataFrame:
    """``a``, ``b``, ``n`` and ``ppmi`` of the pairs that meet more often than chance has it.

    ln(n(a, b) N / (n(a) n(b))), where it is above 0. Tokens that take part in fewer than
    ``min_count`` meetings stay in the totals but have no pair. ``pairs`` is read three times: pass
    a ``pinned`` table, or pairs that carry their totals (``numbered_cooccurrences``), which are read once.
    """
    if {"of_a", "of_b", "of_all"} <= set(pairs.columns):
        ppmi = F.log(F.col("n").cast("double") * F.col("of_all") / (F.col("of_a").cast("double") * F.col("of_b")))
        known = pairs.where((F.col("of_a") >= min_count) & (F.col("of_b") >= min_count))
        return known.select("a", "b", "n", ppmi.alias("ppmi")).where(F.col("ppmi") > 0)
    totals = pairs.groupBy("a").agg(F.sum("n").alias("of_a"))
    frequent = totals.where(F.col("of_a") >= min_count)
    everything = totals.agg(F.sum("of_a")).scalar()
    ppmi = F.log(F.col("n").cast("double") * everything / (F.col("of_a").cast("double") * F.col("of_b")))
    return (
        pairs.join(frequent, "a")
        .join(frequent.select(F.col("a").alias("b"), F.col("of_a").alias("of_b")), "b")
        .select("a", "b", "n", ppmi.alias("ppmi")).where(F.col("ppmi") > 0)
    )


def _times(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The matrix of ``pairs`` times ``vectors``, by token."""
    found = pairs.join(vectors.select(F.col("token").alias("b"), array_to_vector("vector").alias("_v")), "b")
    total = vector_to_array(Summarizer.sum(F.col("_v"), F.col("ppmi")))
    return found.groupBy(F.col("a").alias("token")).agg(total.alias("vector"))


def _inner(left: DataFrame, a: str, b: str, size: int) -> np.ndarray:
    """The ``size`` by ``size`` matrix of sums of ``a[i] * b[j]`` over the rows."""
    def partial(frames):
        total = np.zeros((size, size))
        for frame in frames:
            if len(frame):
                total += np.stack(frame["x"]).T @ np.stack(frame["y"])
        yield pd.DataFrame({"i": range(size), "line": list(total)})

    lines = left.select(F.col(a).alias("x"), F.col(b).alias("y")).mapInPandas(partial, "i int, line array<double>")
    out = np.zeros((size, size))
    for row in lines.groupBy("i").agg(Summarizer.sum(array_to_vector("line")).alias("line")).collect():
        out[row["i"]] = row["line"].toArray()
    return out


def _turned(vector: str, matrix: np.ndarray) -> Column:
    """``vector`` times ``matrix``, batch by batch."""
    @F.pandas_udf("array<double>")
    def turned(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(vectors) @ matrix) if len(vectors) else [], dtype=object)

    return turned(vector)


def _orthonormal(vectors: DataFrame, width: int) -> DataFrame:
    """The same space in unit vectors at right angles; directions without extent become zero."""
    values, axes = np.linalg.eigh(_inner(vectors, "vector", "vector", width))
    real = values > max(values.max(), 0) * 1e-13
    scale = np.where(real, 1 / np.sqrt(np.where(real, values, 1)), 0)
    return vectors.select("token", _turned("vector", axes * scale).alias("vector"))


def token_vectors(
    pairs: DataFrame, size: int = 64, iterations: int = 6, seed: int = 42, spare: int = SPARE
) -> DataFrame:
    """``token`` and ``vector`` of ``size`` numbers: tokens met by the same tokens have near vectors.

    ``pairs`` is ``positive_pmi``'s, pinned, as each of ``iterations`` reads it. A block of
    ``size + spare`` hashed signs a token is multiplied by the matrix and made orthonormal in turn;
    a Rayleigh-Ritz step then gives the leading eigenvectors, each scaled by the root of its
    eigenvalue. Places beyond the positive eigenvalues are zero. Each round is a table in the shared
    folder, so a lost executor costs tasks of one round. Partitioning moves sums of floating-point
    numbers in their last digits only; an eigenvector's sign is that in which it agrees with the tokens' first hashed signs.
    """
    if size < 1:
        raise ValueError(f"size must be positive, got {size}")
    width = size + spare
    signs = [
        F.when(F.getbit(F.xxhash64("token", F.lit(seed + i // 64)), F.lit(i % 64)) == 1, 1.0).otherwise(-1.0)
        for i in range(width)
    ]
    tokens = pairs.select(F.col("a").alias("token")).distinct()
    block = pinned(tokens.select("token", F.array(*signs).alias("vector")), "signs")
    for _ in range(iterations):
        product = pinned(_times(pairs, block), "product")
        unpin(block)
        block = pinned(_orthonormal(product, width), "block")
        unpin(product)
    both = pinned(
        block.join(_times(pairs, block).withColumnRenamed("vector", "product"), "token"), "products"
    )
    values, axes = np.linalg.eigh(_inner(both, "vector", "product", width))
    order = np.argsort(values)[::-1][:size]
    axes = axes[:, order]
    leaning = array_to_vector(F.transform("vector", lambda x: x * signs[0]))
    lean = both.groupBy(F.lit(0).alias("_all")).agg(Summarizer.sum(leaning).alias("v")).head()
    if lean is not None:
        axes = axes * np.where(lean["v"].toArray() @ axes < 0, -1.0, 1.0)
    scale = np.sqrt(np.maximum(values[order], 0))
    return both.select("token", _turned("vector", axes * scale).alias("vector"))


def pooled_vectors(
    df: DataFrame, key: str | Sequence[str], words: Column, vectors: DataFrame, size: int = 64, name: str = "vector"
) -> DataFrame:
    """Mean trained vector per key of ``df``; keys without any known token get zeros.

    ``key`` must identify rows. A token counts once per row and time it occurs; equal tokens of a row are
    counted before the join on the token.
    """
    keys = [key] if isinstance(key, str) else list(key)
    tokens = df.select(*keys, F.explode(words).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("_n"))
    met = tokens.join(vectors.select("token", array_to_vector("vector").alias("_v")), "token")
    mean = vector_to_array(Summarizer.mean(F.col("_v"), F.col("_n").cast("double")))
    found = met.groupBy(*keys).agg(mean.alias(name))
    zero = F.array_repeat(F.lit(0.0), size)
    return df.select(*keys).join(found, keys, "left").select(*keys, F.coalesce(name, zero).alias(name))

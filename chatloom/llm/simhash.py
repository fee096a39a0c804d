"""Near-duplicates by 64-bit SimHash: exact comparison of tiles of fingerprints.

Copies share a fingerprint, so only distinct fingerprints are compared. They are ordered by the
population counts of their four 16-bit quarters and cut into tiles. Flipping one bit changes one
quarter's count by one, so two tiles whose counts differ by more than the radius, summed over
the quarters, hold no link and are skipped; all other pairs of tiles are compared by exclusive-or
and bit counts in numpy.

Consecutive tiles form groups, and one task compares the tiles of a pair of groups. The number of
groups grows with the square root of the fingerprints, so both the work of a task and the copies
of a tile grow as that root. A task gives a spanning forest of the links that it finds, never all
pairs of a group of near copies.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.llm.components import connected_components
from chatloom.llm.workers import arrow_map, fresh, group_map
from chatloom.session import pinned

SHINGLE = 4
SEED = 42
RADIUS = 4
TILE = 1024
#: Groups: the root of the number of fingerprints over this.
ROOT_A_GROUP = 64
_AT_ONCE = 65_536
_QUARTERS = [0, 16, 32, 48]


# ---------------------------------------------------------------------------- fingerprints

def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of UTF-8 text: a bit is 1 if it is in over half of the shingles' hashes."""
    words = text.lower().split()  # on bytes: A-Z only, and blanks of ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, _AT_ONCE):
        part = slice(i, min(i + _AT_ONCE, n))
        spans = zip(starts[part].tolist(), ends[shingle - 1:][part].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            found = np.array([fingerprint(x.as_py() or b"", shingle, seed) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(found, pa.int64())], names=["doc_id", "row", "fp"]
            )

    return run


def fingerprints(docs: DataFrame, row=None, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``row`` and the fingerprint ``fp`` (as a signed long) of each whole text."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.lit(0) if row is None else row).cast("long").alias("row"),
        F.col("text").cast("string").cast("binary").alias("text"),
    )
    return arrow_map(rows, _fingerprints(shingle, seed), "doc_id long, row long, fp long")


# ---------------------------------------------------------------------------- tiles

def _quarter_counts(fp: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count((fp >> np.uint64(s)) & np.uint64(0xFFFF)) for s in _QUARTERS]).astype(np.int64)


_TILES = "grp int, tile int, low binary, high binary, fps binary"


def _cut_tiles(tile: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable")
        fp, out = rows["fp"].to_numpy(np.int64).view(np.uint64), []
        for number, i in enumerate(range(0, len(fp), tile)):
            some = fp[i:i + tile]
            counts = _quarter_counts(some)
            out.append((rows["grp"].iloc[0], number, counts.min(axis=1).tobytes(), counts.max(axis=1).tobytes(), some.tobytes()))
        return pd.DataFrame(out, columns=["grp", "tile", "low", "high", "fps"])

    return run


class Forest:
    """Union-find over numbers; a root is the smallest number of its tree."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        x = self.parent[x]
        while True:
            up = self.parent[x]
            if np.array_equal(up, x):
                return x
            x = up

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def _compare(radius: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["grp", "tile"])
        groups, inside = rows["grp"].to_numpy(), rows["grp"].nunique() == 1
        one_group = rows["first"].iloc[0] == rows["second"].iloc[0]
        tiles = [np.frombuffer(x, np.uint64) for x in rows["fps"]]
        low = np.array([np.frombuffer(x, np.int64) for x in rows["low"]])
        high = np.array([np.frombuffer(x, np.int64) for x in rows["high"]])
        offset = np.concatenate(([0], np.cumsum([len(t) for t in tiles])))
        forest = Forest(int(offset[-1]))
        for i in range(len(tiles) if one_group or not inside else 0):
            gap = np.maximum(0, np.maximum(low - high[i], low[i] - high)).sum(axis=1)
            near = np.flatnonzero(gap <= radius)
            for j in near[near >= i] if one_group else near[groups[near] > groups[i]]:
                for k in range(0, len(tiles[i]), 128):
                    linked = np.bitwise_count(tiles[i][k:k + 128, None] ^ tiles[j]) <= radius
                    if i == j:
                        linked &= np.arange(len(tiles[j])) > np.arange(k, min(k + 128, len(tiles[i])))[:, None]
                    if linked.any():
                        a, b = np.nonzero(linked)
                        forest.unite(offset[i] + k + a, offset[j] + b)
        roots = forest.roots(np.arange(offset[-1]))
        child = np.flatnonzero(roots != np.arange(offset[-1]))
        fp = np.concatenate(tiles).view(np.int64) if tiles else np.zeros(0, np.int64)
        return pd.DataFrame({"a": fp[child], "b": fp[roots[child]]})

    return run


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (``a``, ``b``) that connect all fingerprints ``fp`` within ``radius`` bits, as forests.

    ``distinct`` holds each fingerprint once and is read several times.
    """
    spark = distinct.sparkSession
    groups = max(1, math.ceil(math.sqrt(distinct.count()) / ROOT_A_GROUP))
    quarter = [F.bit_count(F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(0xFFFF))) for s in _QUARTERS]
    order = ((quarter[0] * 17 + quarter[1]) * 17 + quarter[2]) * 17 + quarter[3]
    # ties among equal counts are broken by a hash, so that groups can be cut anywhere
    spread = F.xxhash64("fp").cast("double") / F.lit(2.0 ** 64) + F.lit(0.5)
    keyed = distinct.select("fp", (order.cast("double") + spread).alias("key"))
    cuts = []
    if groups > 1:
        cuts = keyed.approxQuantile("key", [g / groups for g in range(1, groups)], 0.05 / groups)
    group = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < F.col("key"))) if cuts else F.lit(0)
    tiles = pinned(
        group_map(spark, keyed.withColumn("grp", group.cast("int")).groupBy("grp"), _cut_tiles(tile), _TILES), "tiles"
    )
    pair = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    cells = (
        tiles.withColumn("other", pair)
        .withColumn("first", F.least("grp", "other")).withColumn("second", F.greatest("grp", "other")).drop("other")
        .repartition(groups * (groups + 1) // 2, "first", "second")
    )
    return group_map(spark, cells.groupBy("first", "second"), _compare(radius), "a long, b long")


# ---------------------------------------------------------------------------- documents

def _labelled(rows: DataFrame, radius: int) -> DataFrame:
    """``rows`` (``doc_id``, ``row``, ``fp``) with the ``label`` of their component."""
    distinct = pinned(rows.select("fp").distinct(), "distinct-fingerprints")
    components = connected_components(links(distinct, radius))
    labels = distinct.join(components.toDF("fp", "label"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))
    return rows.join(labels, "fp")


def components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hexadecimal) and ``component_id`` of each document.

    Fingerprints that differ in at most ``radius`` bits are linked; a component's id is the
    smallest ``doc_id`` that links reach, the document's own included. A text without words, a
    null one too, has fingerprint zero, which is linked like any other. Rows that repeat a
    ``doc_id`` are documents of their own. A null ``doc_id`` is never a component's id unless
    the component has no other. An empty table gives no row; other columns are ignored.
    """
    rows = pinned(fingerprints(docs, None, shingle, seed), "fingerprints")
    labelled = pinned(_labelled(rows, radius), "labelled")
    smallest = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(smallest, "label").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def row_hash(docs: DataFrame):
    """A hash of all columns of a row."""
    columns = []
    for field in docs.schema:
        column = F.col(f"`{field.name}`")
        plain = isinstance(field.dataType, (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))
        columns.append(column if plain else F.to_json(F.struct(column)))
    return F.xxhash64(*columns)


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """One document of each component, with all columns of ``docs``: that of the smallest ``doc_id``.

    A null ``doc_id`` comes after all others. Of different rows that share the id, the one with
    the smallest row hash stays; of equal rows, one.
    """
    key = [fresh(docs, name) for name in ("row_hash", "row_id", "row_unknown")]
    doc_id = F.col("doc_id").cast("long")
    hashed = docs.withColumns({
        key[0]: row_hash(docs), key[1]: F.coalesce(doc_id, F.lit(0).cast("long")), key[2]: doc_id.isNull(),
    })
    rows = pinned(fingerprints(hashed, F.col(key[0]), shingle, seed), "fingerprints")
    labelled = _labelled(rows, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("first")
    kept = labelled.groupBy("label").agg(first).select(
        F.col("first.row").alias(key[0]), F.coalesce("first.doc_id", F.lit(0).cast("long")).alias(key[1]),
        F.col("first.unknown").alias(key[2]),
    )
    # equal rows meet where the join has put them, so they need no further shuffle
    return hashed.join(kept, key, "left_semi").dropDuplicates(key).drop(*key)

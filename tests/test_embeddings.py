import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatloom.operators import embeddings
from chatloom.session import pinned


def corpus():
    """Sentences in which cat and feline have the same neighbours, as have car and automobile."""
    draw = random.Random(4)
    topics = [(["cat", "feline"], ["purrs", "fur", "milk", "mouse", "paw", "whisker"]),
              (["car", "automobile"], ["engine", "road", "wheel", "fuel", "brake", "garage"]),
              (["song", "tune"], ["melody", "chorus", "verse", "rhythm", "singer", "stage"])]
    rows = []
    for i in range(600):
        names, around = draw.choice(topics)
        rows.append((i, [*draw.sample(around, 3), draw.choice(names), *draw.sample(around, 3), draw.choice("pqrs")]))
    return [*rows, (600, []), (601, None), (602, ["alone"]), (603, ["", "cat", "", "cat", ""])]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame(corpus(), "id int, words array<string>")


@pytest.fixture(scope="module")
def ppmi(spark, words):
    pairs = pinned(embeddings.cooccurrences(words, F.col("words"), 3))
    return pinned(embeddings.positive_pmi(pairs))


def counted(window):
    found = Counter()
    for _, row in corpus():
        row = [w for w in row or [] if w]
        for i, x in enumerate(row):
            for y in row[i + 1:i + 1 + window]:
                found[x, y] += 1
                found[y, x] += 1
    return found


@pytest.mark.parametrize("window", [1, 3, 50])
def test_meetings_equal_those_counted_one_by_one(words, window):
    found = embeddings.cooccurrences(words, F.col("words"), window).collect()
    assert {(r["a"], r["b"]): r["n"] for r in found} == counted(window) and len(found) == len(counted(window))


def test_association_is_beyond_chance(spark, words):
    pairs = counted(3)
    totals = Counter()
    for (a, _), n in pairs.items():
        totals[a] += n
    limit = sorted(totals.values())[len(totals) // 2]
    expected = {}
    for (a, b), n in pairs.items():
        value = math.log(n * totals.total() / totals[a] / totals[b])
        if value > 0 and min(totals[a], totals[b]) >= limit:
            expected[a, b] = value
    found = embeddings.positive_pmi(embeddings.cooccurrences(words, F.col("words"), 3), limit).collect()
    assert {(r["a"], r["b"]): r["ppmi"] for r in found} == pytest.approx(expected)


@pytest.mark.parametrize(("window", "chunk"), [(1, 50), (3, 1 << 20), (50, 200)])
def test_numbered_meetings_carry_their_totals(spark, words, monkeypatch, window, chunk):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    pairs, names = embeddings.numbered_cooccurrences(words.repartition(3), F.col("words"), window)
    name = {r["id"]: r["token"] for r in names.collect()}
    expected, totals = counted(window), Counter()
    for (a, _), n in expected.items():
        totals[a] += n
    rows = pairs.collect()
    assert {(name[r["a"]], name[r["b"]]): r["n"] for r in rows} == expected and len(rows) == len(expected)
    assert all((r["of_a"], r["of_b"], r["of_all"]) == (totals[name[r["a"]]], totals[name[r["b"]]], totals.total()) for r in rows)
    found = {(name[r["a"]], name[r["b"]]): r["ppmi"] for r in embeddings.positive_pmi(pairs, 100).collect()}
    plain = embeddings.positive_pmi(embeddings.cooccurrences(words, F.col("words"), window), 100).collect()
    assert found == pytest.approx({(r["a"], r["b"]): r["ppmi"] for r in plain}) and found


def test_pairs_are_shuffled_once(spark, words):
    pairs, _ = embeddings.numbered_cooccurrences(words, F.col("words"), 3)
    plan = embeddings.positive_pmi(pairs, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[:plan.index("_chunk_pairs" if "_chunk_pairs" in plan else "MapInArrow")] and plan.count("Aggregate [a") == 1
    assert embeddings.positive_pmi(embeddings.numbered_cooccurrences(words.limit(0), F.col("words"))[0]).collect() == []


@pytest.mark.parametrize(("window", "chunk", "least"), [(1, 60, 1), (3, 400, 300), (50, 1 << 22, 1)])
def test_buckets_of_pairs_are_counted_whole(words, monkeypatch, window, chunk, least):
    for name, value in (("CHUNK", chunk), ("HELD", 150), ("TASK", 900)):
        monkeypatch.setattr(embeddings, name, value)
    pairs, names = embeddings.numbered_cooccurrences(words.repartition(3), F.col("words"), window, least)
    of = {r["token"]: (r["id"], r["of"]) for r in names.collect()}
    expected, totals = counted(window), Counter()
    for (a, _), n in expected.items():
        totals[a] += n
    assert {t: n for t, (_, n) in of.items()} == {t: totals[t] for t in of} and set(totals) <= set(of)
    assert sorted(i for i, _ in of.values()) == list(range(len(of)))
    assert [n for _, n in sorted(of.values())] == sorted((n for _, n in of.values()), reverse=True)
    name = {i: t for t, (i, _) in of.items()}
    rows = pairs.collect()
    frequent = {(a, b): n for (a, b), n in expected.items() if min(totals[a], totals[b]) >= least}
    assert {(name[r["a"]], name[r["b"]]): r["n"] for r in rows} == frequent and len(rows) == len(frequent) > 10
    assert all((r["of_a"], r["of_b"], r["of_all"]) == (of[name[r["a"]]][1], of[name[r["b"]]][1], totals.total()) for r in rows)


def test_a_chunks_pairs_are_a_few_bytes_each():
    """A row a pair, as it was, takes 24 bytes and more in a shuffle."""
    rng = np.random.default_rng(5)
    texts = [rng.zipf(1.3, 400) % 5000 for _ in range(100)]
    tokens, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    words, code, times = np.unique(tokens, return_inverse=True, return_counts=True)
    ids = np.argsort(np.argsort(-times, kind="stable"))
    pack, _ = embeddings._coding()
    chunk = pa.table({"lists": pa.array([pack(sizes, code)], pa.binary())})
    entries = pa.table({"at": np.arange(len(words)), "id": ids})
    found = embeddings._chunk_pairs(5, 7, len(words), 20_000)(chunk, entries)
    expected = Counter()
    for text in texts:
        own = [int(ids[np.searchsorted(words, w)]) for w in text]
        for i, x in enumerate(own):
            for y in own[i + 1:i + 6]:
                expected[max(x, y), min(x, y)] += 1
    assert sum(map(len, found["pairs"].to_pylist())) < 3 * len(expected) and found["a_bucket"].to_pylist() == list(range(7))
    dealt = pa.RecordBatch.from_pylist([{"a_bucket": b, "pairs": [p, p]} for b, p in zip(*found.to_pydict().values(), strict=True)])
    rows = [r for x in embeddings._bucket_pairs(7, (np.array([3, 2]), np.array([0, 100])))([dealt]) for r in x.to_pylist()]
    assert {(r["a"], r["b"]): r["n"] for r in rows} == {pair: 2 * n for pair, n in expected.items()} and len(rows) == len(expected)
    assert all((r["of_a"], r["of_b"]) == tuple(3 if x < 100 else 2 for x in (r["a"], r["b"])) for r in rows)


def test_vectors_are_the_leading_eigenvectors(ppmi):
    rows = ppmi.collect()
    names = sorted({r["a"] for r in rows})
    at = {w: i for i, w in enumerate(names)}
    matrix = np.zeros((len(names), len(names)))
    for r in rows:
        matrix[at[r["a"]], at[r["b"]]] = r["ppmi"]
    values, axes = np.linalg.eigh(matrix)
    best = (axes * np.maximum(values, 0))[:, ::-1][:, :3] @ axes[:, ::-1][:, :3].T
    vectors = {r["token"]: r["vector"] for r in embeddings.token_vectors(ppmi, 3, iterations=12).collect()}
    found = np.array([vectors[w] for w in names])
    assert found.shape == (len(names), 3)
    assert np.abs(found @ found.T - best).max() < 1e-6


def test_synonyms_are_nearer_than_other_words(ppmi):
    vectors = {r["token"]: np.array(r["vector"]) for r in embeddings.token_vectors(ppmi, 8).collect()}

    def near(a, b):
        return vectors[a] @ vectors[b] / np.linalg.norm(vectors[a]) / np.linalg.norm(vectors[b])

    for a, b in (("cat", "feline"), ("car", "automobile"), ("song", "tune")):
        assert near(a, b) > 0.9
        assert near(a, b) > max(near(a, other) for other in ("road", "melody", "mouse", "car", "cat") if other != a) - 1e-9


def test_seed_repeats_the_result_under_any_partitioning(ppmi, rows_under):
    def rounded():
        vectors = embeddings.token_vectors(ppmi, 3, iterations=12)
        return vectors.select("token", F.transform("vector", lambda x: F.round(x + 1e-9, 5)).alias("v"))

    assert rows_under(rounded, 2) == rows_under(rounded, 7)


def test_more_places_than_tokens_are_zero(spark):
    pairs = pinned(spark.createDataFrame([("x", "y", 2, 1.0), ("y", "x", 2, 1.0)], "a string, b string, n long, ppmi double"))
    rows = {r["token"]: r["vector"] for r in embeddings.token_vectors(pairs, 5).collect()}
    assert rows["x"] == pytest.approx(rows["y"]) and len(rows["x"]) == 5
    assert sum(v * v for v in rows["x"]) == pytest.approx(0.5)
    assert embeddings.token_vectors(pinned(pairs.limit(0)), 5).collect() == []


def test_pooled_vectors_are_means_over_known_tokens(spark, words):
    vectors = spark.createDataFrame([("cat", [1.0, 0.0]), ("fur", [0.0, 3.0])], "token string, vector array<double>")
    rows = spark.createDataFrame([(1, ["cat", "cat", "fur", "new"]), (2, ["new"]), (3, None)], "id int, w array<string>")
    found = {r["id"]: r["vector"] for r in embeddings.pooled_vectors(rows, "id", F.col("w"), vectors, 2).collect()}
    assert found == {1: pytest.approx([2 / 3, 1.0]), 2: [0.0, 0.0], 3: [0.0, 0.0]}

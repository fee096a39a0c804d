import bisect
import collections
import hashlib
import random

import numpy as np
import pytest

from chatloom.llm import alignment, treebpe, whitening
from chatloom.llm.tokens import tokenizer_path

ALPHABET = " " * 6 + "ab'sﬁéÀ漢字１²½Ⅷ\n\t\r.,!*#0189  　​\x1c\x85😀🏽‍ſİǅʰ़ाᎠª▁\x00"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


# ---------------------------------------------------------------------------- tree concatenation

def hard_texts(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 200))) for _ in range(60)]
    parts = ["'ll", "'", "l", "ll", " ", "  ", "\n", "the", "ing", "anti", "dis", "!!", "...", "123"]
    texts += ["".join(rng.choices(parts, k=300)) for _ in range(20)]
    texts += ["".join(rng.choices("abcdefgh", k=1500)), "".join(rng.choices("ACGT", k=1500)), "a" * 901, " " * 500, "=" * 777]
    texts += ["don't'll've" * 60, "\n \n" * 100, "漢字" * 200, "é" * 301, "thequickbrownfoxjumps" * 50, "1234567890" * 70, "  x" * 200]
    return texts + ["<|endoftext|>x<|endoftext|><|endoftext|> y", "a<|endoftext|>", "<|endoftext|", "", None]


@pytest.mark.parametrize(("leaf", "window", "short"), [(4, 1, 4), (7, 3, 512), (16, 8, 4), (64, 64, 16), (300, 8, 512)])
def test_joined_leaves_give_the_ids_of_whole_texts(tokenizer, monkeypatch, leaf, window, short):
    monkeypatch.setattr(treebpe, "SHORT", short)
    encoder, texts = treebpe.TreeEncoder(tokenizer_path(), leaf, window), hard_texts(leaf)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids
        assert encoder.decode(ids) == tokenizer.decode(ids.tolist(), skip_special_tokens=False) == (text or "")


def test_a_window_inside_an_unsplit_piece_stays_small(monkeypatch):
    monkeypatch.setattr(treebpe, "SHORT", 64)
    encoder = treebpe.TreeEncoder(tokenizer_path(), 4096)
    seen, merge = [], encoder._merge
    encoder._merge = lambda piece: seen.append(len(piece)) or merge(piece)
    text = "".join(random.Random(2).choices("abcdefghijklmnop", k=60_000))
    encoder.encode([text])
    assert seen and max(seen) < 2000


def test_bytes_that_are_no_text_decode_like_the_tokenizer(tokenizer):
    encoder, rng = treebpe.TreeEncoder(tokenizer_path()), random.Random(8)
    for _ in range(300):
        ids = [rng.randrange(50_257) if rng.random() < 0.5 else rng.randrange(94, 256) for _ in range(12)]
        assert encoder.decode(np.array(ids)) == tokenizer.decode(ids, skip_special_tokens=False)


def test_tree_encoding_on_spark(spark, docs, edge_rows, tokenizer):
    rows = [*edge_rows, (9, "x" * 70_000 + "<|endoftext|>" + "yz " * 50_000), (6, edge_rows[9][1]), (10, "漢" * 40_000)]
    rows += [(100 + i, t) for i, t in enumerate(hard_texts(1))]
    expected = []
    for doc_id, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
        expected.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    for options in ({}, {"leaf": 64, "segment": 300}):
        table = docs(rows).repartition(3)
        assert sorted(map(str, map(tuple, treebpe.digests(table, **options).collect()))) == sorted(map(str, expected))
    back = treebpe.decoded(treebpe.encoded(docs(rows))).collect()
    assert sorted(map(str, map(tuple, back))) == sorted(str((i, t or "")) for i, t in rows)
    assert treebpe.digests(docs([])).collect() == []


# ---------------------------------------------------------------------------- alignment

def plain_alignment(rows, tokenizer):
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(alignment.PIECES))
    letters = {c: b for b, c in enumerate(treebpe.byte_letters())}
    first = lambda i: bytes(letters[c] for c in tokenizer.id_to_token(i))
    second = lambda i: (
        bytes([int(other.id_to_piece(i)[3:5], 16)]) if other.is_byte(i) else other.id_to_piece(i).replace("▁", " ").encode()
    )
    found, counts = [], collections.Counter()
    for doc_id, text in rows:
        a = tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids
        b = other.encode(text or "")
        sizes = [len(first(i)) for i in a], [len(second(i)) for i in b]
        spaced = (" " + (text or "")).encode()
        if not text or b"".join(map(first, a)) != spaced or b"".join(map(second, b)) != spaced:
            found.append((doc_id, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum(sizes[0]).tolist(), np.cumsum(sizes[1]).tolist()
        at_b = dict(zip(ends_b, b, strict=True))
        links = [(i, at_b[e]) for i, e in zip(a, ends_a, strict=True) if e in at_b]
        common = [e for e in ends_a if e in at_b]
        groups = [([], []) for _ in common]
        for side, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
            for i, e in zip(ids, ends, strict=True):
                groups[bisect.bisect_left(common, e)][side].append(str(i))
        counts.update(links)
        found.append((doc_id, a, b, [",".join(x) + "|" + ",".join(y) for x, y in groups], links))
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (d, len(a), len(b), len(g), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(";".join(g).encode()).hexdigest() if g else "", ";".join(g))
        for d, a, b, g, links in found
    ]


def test_alignment_equals_plain_python(spark, docs, edge_rows, tokenizer, monkeypatch):
    tokenizer.encode_special_tokens = True
    rng = random.Random(4)
    parts = [*ALPHABET, "the", "ing", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", " word", " word"]
    rows = [(100 + i, "".join(rng.choices(parts, k=rng.randint(0, 40)))) for i in range(400)]
    rows += [*edge_rows, (5, " "), (5, "  lead and trail  "), (5, "a b"), (5, "a b")]
    try:
        expected = plain_alignment(rows, tokenizer)
    finally:
        tokenizer.encode_special_tokens = False
    assert sum(e[1] == 0 for e in expected) > 20 and sum(e[5] < e[4] for e in expected) > 100
    found = alignment.aligned(docs(rows).repartition(5), with_groups=True).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    assert alignment.aligned(docs([])).collect() == []


def test_common_pairs_have_one_row_a_batch(spark, docs):
    kept = alignment.batches(docs([(i, "the same words again") for i in range(500)]).coalesce(1), tokenizer_path(), tokenizer_path(alignment.PIECES), False)
    batches = kept.collect()
    assert len(batches) == 1 and len({(p["a"], p["b"]) for p in batches[0]["pair"]}) == len(batches[0]["pair"]) == 4


def test_a_batch_is_aligned_a_slice_at_a_time(monkeypatch):
    """Tokens of few texts are held at once, whatever the batch; its row is that of the batch aligned whole."""
    monkeypatch.setattr(alignment, "SLICE_BYTES", 300)
    rng = random.Random(9)
    texts = ["", None, "\u2581x", *(" ".join(rng.choices(["word", "words", "漢字", "the", "a  b"], k=rng.randint(0, 60))) for _ in range(80)), "long " * 200]
    tokenizers = alignment._tokenizers(tokenizer_path(), tokenizer_path(alignment.PIECES))
    held, aligned_batch = [], alignment.aligned_batch
    monkeypatch.setattr(alignment, "aligned_batch", lambda a, b, *more: held.append(len(a)) or aligned_batch(a, b, *more))
    sliced = alignment._batch(list(range(len(texts))), texts, tokenizers, True)
    assert len(held) > 5 and max(held) < len(texts) / 2 and sum(held) == len(texts)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 1 << 30)
    whole = alignment._batch(list(range(len(texts))), texts, tokenizers, True)
    row = lambda batch: batch.to_pylist()[0]
    links = lambda r: sorted((d, *(r["pair"][p][x] for x in "ab"), n) for d, p, n in zip(r["link_doc"], r["link_pair"], r["link_n"], strict=True))
    one, two = row(sliced), row(whole)
    assert links(one) == links(two) and len(links(one)) > 100
    assert sorted(map(str, one["pair"])) == sorted(map(str, two["pair"]))
    for name in ("batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"):
        assert one[name] == two[name]


def test_links_travel_packed_and_unpack_to_the_same():
    rng = random.Random(2)
    texts = ["", None, *(" ".join(rng.choices(["word", "words", "漢字", "the", "a  b"], k=rng.randint(0, 90))) for _ in range(120)), "\u2581x"]
    whole = alignment._batch(list(range(len(texts))), texts, alignment._tokenizers(tokenizer_path(), tokenizer_path(alignment.PIECES)), False)
    packed = alignment._packed(whole)
    named = lambda links: sorted(zip(*(x.tolist() for x in links), strict=True))
    arrays = [whole.column(c)[0].values.to_numpy() for c in ("link_doc", "link_pair", "link_n")]
    assert named(alignment._links(packed["links"][0].as_py(), len(texts))) == named(arrays) and len(arrays[0]) > 300
    assert len(packed["links"][0].as_py()) < sum(a.nbytes for a in arrays) / 3
    none = alignment._packed(alignment._batch([1], [None], alignment._tokenizers(tokenizer_path(), tokenizer_path(alignment.PIECES)), False))
    assert [len(x) for x in alignment._links(none["links"][0].as_py(), 1)] == [0, 0, 0]


def test_batches_that_hold_the_same_stay_apart(spark, docs, tokenizer):
    rows = [(1, "the same words"), (2, "words the the"), (3, "same same again"), (4, None)]
    table = docs(rows * 4)
    assert table.rdd.getNumPartitions() == 4
    tokenizer.encode_special_tokens = True
    try:
        expected = plain_alignment(rows * 4, tokenizer)
    finally:
        tokenizer.encode_special_tokens = False
    found = alignment.aligned(table, with_groups=True).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_words_met_early_stay_known():
    pieces = alignment.SentencePieces(tokenizer_path(alignment.PIECES), kept=100)
    if pieces._by_word:
        pieces.ids(["early bird"])
        pieces.ids([" ".join(f"w{i}" for i in range(400))])
        pieces.ids(["later"])
        assert {"early", "bird", "later"} <= set(pieces._words) and len(pieces._words) <= 51


# ---------------------------------------------------------------------------- whitening

def test_rank_one_updates_equal_the_scatter_matrix():
    rng = np.random.default_rng(3)
    for rows in (
        rng.integers(-300, 300, (400, 24)) * np.linspace(0.01, 9, 24), rng.integers(-2, 3, (200, 24)),
        np.repeat(rng.integers(-9, 9, (20, 24)), 4, axis=0), np.ones((5, 24)), rng.standard_normal((30, 24)) @ np.diag([1e8] + [1] * 23),
    ):
        rows = np.asarray(rows, float)
        whole, left, right = (whitening.Spectrum(24) for _ in range(3))
        for row in rows:
            whole.add(row)
        for row in rows[:3]:
            left.add(row)
        for row in rows[3:]:
            right.add(row)
        left.combine(right)
        centred = rows - rows.mean(axis=0)
        scatter = centred.T @ centred
        for found in (whole, left):
            assert found.n == len(rows)
            assert np.allclose(found.q @ np.diag(found.d) @ found.q.T, scatter, rtol=0, atol=1e-11 * max(1, np.abs(scatter).max()))
            assert np.allclose(found.q.T @ found.q, np.eye(24), atol=1e-11)
            assert np.allclose(found.mean, rows.mean(axis=0))


def test_secular_roots_lie_between_the_poles_and_solve_the_equation():
    rng = np.random.default_rng(9)
    for k in (1, 2, 7, 40):
        for spread in (1.0, 1e-7, 1e7):
            d = np.sort(rng.random(k) * spread) + np.arange(k) * 1e-3 * spread
            z2 = rng.random(k) ** 8 + 1e-14
            apart = whitening.secular_roots(d, z2)
            value = 1 - (z2 / apart).sum(axis=1)
            assert (np.abs(value) < 1e-9 * (1 + np.abs(z2 / apart).sum(axis=1))).all()
            row = np.arange(k)
            assert (apart[row, row] >= 0).all() and (apart[row[:-1], row[1:]] <= 0).all()


def check_whitening(rows, vectors, k=16):
    """Against numpy on the distinct whole vectors, signs aside."""
    x = {i: np.floor(64 * np.asarray(v, float)).astype(np.int64) + 1_000_000 for i, v in vectors}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums) / n
    covariance = centred.T @ centred / n
    values, basis = np.linalg.eigh(covariance)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    signs = np.zeros(k)
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r["vec_id"]].append(r)
    for i, v in x.items():
        expected = ((v * n - sums) / n) @ basis / np.sqrt(values)
        for r in by_id[i]:
            c = r["component"] - 1
            signs[c] = signs[c] or np.sign(r["whitened"] * expected[c])
            assert abs(r["whitened"] * signs[c] - expected[c]) < 1e-7
            assert int(r["deviation"]) == sum(int(a) ** 2 for a in (v * n - sums).tolist())
            assert abs(r["explained"] - values[c] / np.trace(covariance)) < 1e-9
            assert r["n"] == n and r["identity_error"] < 1e-8
    return by_id


def test_whitening_on_spark(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, (rng.standard_normal(20) * np.linspace(0.2, 3, 20)).tolist()) for i in range(300)]
    vectors += [(1000 + i, vectors[i % 3][1]) for i in range(200)]
    extra = [(-1, None), (-2, [float("nan")] * 20), (-3, [None] + [1.0] * 19), (-4, [float("inf")] * 20), (-5, [])]
    schema = "vec_id long, embedding array<double>, x string, n int, at int"
    table = spark.createDataFrame([(*v, "x", 1, 2) for v in [*vectors, *extra, vectors[0]]], schema).repartition(40)
    found = whitening.whitened(table).collect()
    by_id = check_whitening(found, vectors)
    assert set(by_id) == {i for i, _ in vectors} and len(by_id[0]) == 32 and len(by_id[1000]) == 16
    assert whitening.whitened(table.limit(0)).collect() == []


def test_whitening_of_few_equal_huge_and_other_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [1.0]), (4, [2.0]), (None, [3.0])]
    found = whitening.whitened(spark.createDataFrame(rows, schema)).collect()
    same = [r for r in found if r["vec_id"] in (1, 2)]
    assert len(same) == 4 and all(r["whitened"] == r["explained"] == 0 and r["deviation"] == "0" for r in same)
    other = [r for r in found if r["vec_id"] not in (1, 2)]
    assert len(other) == 3 and all(r["n"] == 3 and abs(r["explained"] - 1) < 1e-12 for r in other)
    assert sum(r["whitened"] ** 2 for r in other) == pytest.approx(3)
    huge = [(i, [s * 1e300, 0.0, float(i)]) for i, s in enumerate((1, -1, 1, -1))]
    found = whitening.whitened(spark.createDataFrame(huge, schema)).collect()
    exact = {r["vec_id"]: int(r["deviation"]) for r in found}
    assert set(exact) == {0, 1, 2, 3} and exact[0] > 2 ** 100 and all(np.isfinite(r["whitened"]) for r in found)


def test_exact_squares():
    rng = np.random.default_rng(6)
    for limit in (10, 2 ** 27, 2 ** 51, 2 ** 60):
        t = rng.integers(-limit, limit, (50, 64))
        assert whitening.squared_sums(t) == [sum(int(v) ** 2 for v in row) for row in t]

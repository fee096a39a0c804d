import heapq
import random
import zlib

import numpy as np
import pytest

from chatloom.llm import huffman, packing, tokens

ALPHABET = " " * 6 + "ab'sﬁéÀ漢字１²½Ⅷ\n\t\r.,!*#0189  　​\x1c\x85😀🏽‍ſİǅʰ़ाᎠª"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokens.tokenizer_path())
    found.encode_special_tokens = True
    return found


def whole(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes()


def test_ids_equal_those_of_whole_texts(tokenizer):
    rng = random.Random(3)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += [None, "", " ", "  a", "a  b", "a \n b", " lead", "trail ", "<|endoftext|> x", "can't won't I'll", "a" * 5000]
    found = tokens.PieceEncoder(tokens.tokenizer_path()).encode(texts)
    assert found == [whole(tokenizer, t, 0)[:-4] for t in texts]


def test_forgetting_pieces_changes_nothing(tokenizer):
    encoder = tokens.PieceEncoder(tokens.tokenizer_path(), kept=3)
    for text in ["some words here", "other words there", "some words here"]:
        assert encoder.encode([text]) == [whole(tokenizer, text, 0)[:-4]]


def test_batches_are_cut_by_bytes_and_lose_no_row(tokenizer):
    import pyarrow as pa

    rng = random.Random(5)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(300)] + [None, "", "long " * 400]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    for most in (1, 100, 10**6):
        cut = list(tokens.text_slices(batch, most=most))
        assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch]))
        encoder = tokens.PieceEncoder(tokens.tokenizer_path(), kept=200)
        found = [ids for some in cut for ids in encoder.encode(some.column("text"))]
        assert found == [whole(tokenizer, t, 0)[:-4] for t in texts]
    assert not list(tokens.text_slices(batch.slice(0, 0)))


def test_words_whose_hashes_collide_keep_their_ids(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "_hashes", lambda words: np.array([len(w) for w in words.to_pylist()], np.uint64))
    text = "some words have equal hashes here, many words: some!"
    encoder = tokens.PieceEncoder(tokens.tokenizer_path())
    for _ in range(2):
        assert encoder.encode([text]) == [whole(tokenizer, text, 0)[:-4]]


# ---------------------------------------------------------------------------- packing

def check_packing(rows, expected, window=2048):
    at, sequences = {}, {}
    for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["start"])):
        sequences.setdefault(r["sequence_id"], []).append(r)
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        at.setdefault(r["doc_id"], []).append(r)
    for pieces in sequences.values():
        offset = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == offset
            offset += r["length"]
        assert offset <= window
    assert sorted(sum(r["length"] for r in rows if r["doc_id"] == k) for k in at) == sorted(
        sum(len(x) // 4 for i, x in expected if i == k) for k in {i for i, _ in expected}
    )
    return sequences


def test_packing_of_edge_rows(docs, edge_rows, tokenizer):
    rows = [r.asDict() for r in packing.packed(docs(edge_rows)).collect()]
    expected = [(i, whole(tokenizer, t, packing.END_ID)) for i, t in edge_rows]
    check_packing(rows, expected)
    for doc_id, ids in expected:  # ids that occur once are whole again when their pieces are put together
        if sum(i == doc_id for i, _ in expected) == 1:
            pieces = sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["start"])
            assert b"".join(r["ids"] for r in pieces) == ids
            assert {r["doc_tokens"] for r in pieces} == {len(ids) // 4}


def test_packing_of_nothing(docs):
    assert packing.packed(docs([])).collect() == []


def brute_level(counts, size, window):
    """The level whose use leaves the least sum of squares; of equal ones the fullest."""
    best = None
    for level in range(window - size, -1, -1):
        if level and not counts[level]:
            continue
        after = list(counts)
        if level:
            after[level] -= 1
        if level + size < window:
            after[level + size] += 1
        cost = sum(x * x for x in after)
        if best is None or cost < best[0]:
            best = cost, level
    return best[1]


def test_levels_minimise_the_sum_of_squares():
    rng, window = random.Random(5), 24
    packer = packing.SumOfSquares(window)
    for i in range(400):
        size = rng.randint(1, window - 1)
        assert packer.level_for(size) == brute_level(packer.open_by_level.tolist(), size, window)
        list(packer.add(i, bytes(4 * size)))


def packed_sizes(sizes, window):
    """Pieces of all windows, of those open at the end, and the packer."""
    packer, closed = packing.SumOfSquares(window), []
    for i, size in enumerate(sizes):
        closed += packer.add(i, np.arange(size, dtype="<u4").tobytes())
    return closed, list(packer.drain()), packer


def test_drained_windows_hold_every_id_once_with_little_padding():
    rng = random.Random(6)
    for n in (1, 2, 5, 40, 300):
        sizes = [rng.randint(1, 150) for _ in range(n)]
        closed, drained, packer = packed_sizes(sizes, 64)
        lengths = [sum(len(p[2]) // 4 for p in w) for w in drained]
        assert {sum(len(p[2]) // 4 for p in w) for w in closed} <= {64} and max(lengths, default=0) <= 64
        padding = sum(64 - k for k in lengths if k & (k - 1))
        assert padding <= packing.PADDING * sum(sizes)
        held = {}
        for doc, start, ids, count in (p for w in closed + drained for p in w):
            assert count == sizes[doc] and ids
            held.setdefault(doc, []).append((start, ids))
        assert {d: b"".join(ids for _, ids in sorted(p)) for d, p in held.items()} == {
            d: np.arange(k, dtype="<u4").tobytes() for d, k in enumerate(sizes)
        }
        assert list(packer.drain()) == []


def test_the_rule_places_nearly_all_rests():
    rng = random.Random(16)
    sizes = [min(60_000, 1 + int(rng.lognormvariate(6, 1.2))) for _ in range(1000)]
    _, _, packer = packed_sizes(sizes, packing.WINDOW)
    assert packer.cut_again < 0.05 * sum(k % packing.WINDOW for k in sizes)


# ---------------------------------------------------------------------------- Huffman files

def huffman_cost(counts):
    heap = [n for n in counts if n]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a + b
        heapq.heappush(heap, a + b)
    return total


@pytest.mark.parametrize("n", [1, 2, 3, 17, 300])
def test_lengths_are_optimal_and_limited(n):
    rng = np.random.default_rng(n)
    counts = np.floor(rng.pareto(0.7, n) * 10).astype(np.int64) + 1
    counts[::5] = 0 if n > 5 else counts[::5]
    loose = huffman.code_lengths(counts, 40).astype(np.int64)
    if np.count_nonzero(counts) > 1:
        assert (counts * loose).sum() == huffman_cost(counts.tolist())
    tight = huffman.code_lengths(counts, 9)
    assert tight.max() <= 9 and (0.5 ** tight[tight > 0].astype(float)).sum() <= 1
    assert ((tight > 0) == (counts > 0)).all()


def test_limited_lengths_match_brute_force():
    import itertools

    counts = np.array([1, 1, 2, 3, 50, 90])
    found = huffman.code_lengths(counts, 4)
    best = min(
        sum(c * n for c, n in zip(counts, lengths, strict=True))
        for lengths in itertools.product(range(1, 5), repeat=6) if sum(0.5 ** n for n in lengths) <= 1
    )
    assert (counts * found).sum() == best


def test_too_many_ids_for_the_limit():
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, np.int64), 3)


def test_codes_round_trip_in_blocks():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.02, 5001) - 1, 400).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids), 12)
    codes = huffman.canonical_codes(lengths)
    pairs = sorted((f"{codes[i]:0{lengths[i]}b}") for i in np.flatnonzero(lengths))
    assert not any(b.startswith(a) for a, b in zip(pairs, pairs[1:], strict=False))
    code, starts = huffman.encode_ids(ids, codes, lengths)
    table, size = huffman.decoding_table(lengths, 12)
    assert (huffman.decode_blocks(code, starts[::64], len(ids), 64, table, size, 12) == ids).all()
    k = 17  # one block alone, from its checkpoint
    assert (huffman.decode_blocks(code, starts[64 * k:64 * k + 1], 64, 64, table, size, 12) == ids[64 * k:64 * k + 64]).all()


def test_files_round_trip_of_edge_rows(spark, docs, edge_rows, tokenizer):
    folder = huffman.archived(docs(edge_rows), ids_a_file=2000, segment_ids=1024)
    expected = [(i, whole(tokenizer, t, huffman.END_ID)) for i, t in edge_rows]
    read = [(r["doc_id"], bytes(r["ids"])) for r in huffman.read_ids(spark, folder).collect()]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(read, key=order) == sorted(expected, key=order)
    digests = huffman.read_digests(spark, folder).orderBy("start").collect()
    start = 0
    for r in digests:
        assert r["start"] == start
        start += r["n_tokens"]
    assert [r["doc_id"] for r in digests] == sorted((i for i, _ in expected), key=lambda i: (i is not None, i or 0))
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in digests) == sorted((len(x) // 4, zlib.crc32(x)) for _, x in expected)


def test_files_of_nothing(spark, docs):
    folder = huffman.archived(docs([]))
    assert huffman.read_digests(spark, folder).collect() == [] and huffman.read_ids(spark, folder).collect() == []


def test_a_damaged_file_is_refused():
    with pytest.raises(ValueError):
        list(huffman.read_file(b"NOPE"))

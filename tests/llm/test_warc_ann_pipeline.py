import random
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from chatloom.llm import ann, queries, warc

PAGES = "page_id long, url string, html string, size int, first string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in rows], PAGES)


def test_archives_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}?q=ä b", f"<p>page {rng.randint(0, 40)} é\r\n\r\n</p>" * rng.randint(0, 3)) for i in range(300)]
    rows += [(1000, None, None), (1001, "bad\r\nWARC-Type: x", ""), (None, "u", "only here"), (None, "u", "<p>page 1 é\r\n\r\n</p>"), (0, *rows[0][1:])]
    rows += [(2000, "u", "P*M\x18\x00\x00\x00\x00" * 5), (2001, "u", "z" * 300_000)]
    folder = warc.write(pages(spark, rows))
    found = [(r["page_id"], r["payload_digest"], r["payload_bytes"], r["record_type"], r["refers_to"], r["payload"]) for r in warc.read(spark, folder).collect()]
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    expected = []
    for i, _, h in rows:
        data = (h or "").encode()
        lead = first.get(h or "")
        kind = "response" if i == lead else "revisit"
        expected.append((i, warc.payload_digest(data), len(data), kind, lead if kind == "revisit" else None, data if kind == "response" else None))
    order = lambda x: str(x[:5])
    assert sorted(found, key=order) == sorted(expected, key=order)


def test_small_payloads_are_all_responses(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, "u", "longer same"), (4, "u", "longer same")]
    found = {r["page_id"]: r["refers_to"] for r in warc.read(spark, warc.write(pages(spark, rows), min_bytes=5)).collect()}
    assert found == {1: None, 2: None, 3: None, 4: 3}


def test_no_pages(spark):
    assert warc.read(spark, warc.write(pages(spark, []))).collect() == []


def test_an_archive_is_plain_zstandard_with_its_dictionary_first():
    records = [warc.record(i, "http://h/", (f"<p>text number {i}</p>" * 9).encode(), 0, "", None) for i in range(400)]
    frames = list(warc.frames(iter(records), sample_bytes=20_000))
    magic, size = struct.unpack("<II", frames[0][:8])
    assert magic == 0x184D2A5D and len(frames[0]) == 8 + size > 8 and len(frames) == 401
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(frames[0][8:]))
    assert [reader.decompress(f) for f in frames[1:]] == records
    content = b"".join(f + warc._SEPARATOR.encode() for f in frames)
    assert list(warc.read_archive(content)) == records
    assert list(warc.frames(iter([]))) == []


def test_damage_is_noticed():
    good = warc.record(1, "u", b"payload", 7, warc.payload_digest(b"payload"), None)
    assert warc.parse(good)[0] == 1
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"payload\r\n", b"PAYLOAD\r\n"))


# ---------------------------------------------------------------------------- neighbours

VECTORS = "vec_id long, embedding array<float>, label int, size string"


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((8, 24))
    data = (centers[rng.integers(0, 8, 3000)] + 0.4 * rng.standard_normal((3000, 24))).astype(np.float32)
    data[1::500] = data[0]  # repeated vectors tie, the smaller id first
    rows = [(i, [float(x) for x in v], 0, "") for i, v in enumerate(data)]
    found = ann.nearest(spark.createDataFrame(rows, VECTORS), F.pmod("vec_id", F.lit(50)) == 0, shard_vectors=700, block_queries=25).collect()
    data, hits = data.astype(float), 0
    for q in range(0, 3000, 50):
        distance = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        best = [j for j in np.lexsort((np.arange(3000), distance)) if j != q][:10]
        ours = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [r for r, _, _ in ours] == list(range(1, 11))
        assert [(s, j) for _, j, s in ours] == sorted((s, j) for _, j, s in ours)
        assert all(s == pytest.approx(distance[j], rel=1e-12) for _, j, s in ours)
        hits += len({j for _, j, _ in ours} & set(best))
    assert hits / 600 >= 0.9


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []),
        (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (1, [1.0, 0.5]), (100, [2.0, 0.0]), (200, [3.0, 0.0, 0.0]), (300, [0.0, 0.0]), (400, [1.0]),
    ]
    table = spark.createDataFrame([(i, v, 0, "") for i, v in rows], VECTORS)
    found = ann.nearest(table, F.pmod("vec_id", F.lit(100)) == 0)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in found.collect())
    assert got == [
        (0, 1, 1, 0.5), (0, 2, 100, 1.0), (100, 1, 0, 1.0), (100, 2, 1, round(1.25 ** 0.5, 6)), (200, 1, 8, 2.0),
    ]
    assert ann.nearest(table.limit(0), F.lit(True)).collect() == []


def test_numbers_of_any_size():
    vectors = np.array([[1e-300, 0], [2e-300, 1e-300], [3e-300, 0]])
    shard = ann.Shard(np.arange(3), vectors)
    assert shard.nearest(9, np.array([1e300, 1e300]), 2)[0].tolist() == [0, 1]
    same = ann.Shard(np.arange(4), np.ones((4, 3)))
    assert same.nearest(2, np.ones(3), 2)[0].tolist() == [0, 1] and len(same.nearest(2, np.ones(3), 9)[0]) == 3


# ---------------------------------------------------------------------------- pipeline

def test_pipeline_equals_plain_python(spark, tmp_path):
    """Each stage against a plain form of it, on rows planted for each decision."""
    import corpus_pipeline
    from chatloom.llm import decontam, packing, pii, quality, simhash

    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choices("aeioustrnl", k=rng.randint(1, 6))) for _ in range(n))
    texts = [prose(rng.randint(20, 120)) for _ in range(150)]
    junk = [" ".join(w + "***" for w in prose(60).split()) for _ in range(50)]
    item = prose(40)
    rows = [*enumerate(texts), *((200 + i, t) for i, t in enumerate(junk)), (300, texts[3]), (301, texts[3].upper())]
    rows += [(302, f"{prose(30)} {item} {prose(30)}"), (303, f"{prose(40)} reach me at some.one@host.example.org {prose(10)}"), (303, texts[9]), (304, None)]
    docs = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 200), 0) for i, _ in rows if i < 250]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    weights = queries.quality_weights(spark, table, str(tmp_path))
    kept = [(i, t) for i, t in rows if quality.score(t, weights) >= quality.THRESHOLD]
    prints = [simhash.fingerprint((t or "").encode()) for _, t in kept]
    group = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    best = {}
    for (i, t), g in zip(kept, group, strict=True):
        best[g] = min(best.get(g, (i, t)), (i, t), key=lambda x: x[0])
    clean = [(i, t) for i, t in best.values() if not (t and item in t)]
    masked = [(i, (t or "").replace("some.one@host.example.org", "[EMAIL]")) for i, t in clean]
    from chatloom.llm import tokens
    encoder = tokens.PieceEncoder(tokens.tokenizer_path())
    expected = sorted((i, len(encoder.encode([t])[0]) // 4 + 1) for i, t in masked)
    assert sorted((r["doc_id"], r["doc_tokens"]) for r in found if r["start"] == 0) == expected
    ids = {}
    for r in sorted(found, key=lambda r: r["start"]):
        if sum(i == r["doc_id"] for i, _ in masked) == 1:
            ids[r["doc_id"]] = ids.get(r["doc_id"], b"") + r["ids"]
    end = struct.pack("<I", packing.END_ID)
    assert all(ids[i] == encoder.encode([t])[0] + end for i, t in masked if i in ids)
    assert 302 not in {i for i, _ in masked} and not {300, 301} & {i for i, _ in masked} and len(masked) > 100
    assert [n for n, _ in corpus_pipeline.STAGES] and decontam and pii


def test_every_query_is_registered():
    numbers = {int(n[2:].split("_")[0]) for n in queries.QUERIES}
    assert numbers == set(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_any_rows(spark, docs, edge_rows, tmp_path, empty):
    """Nulls, empty and long texts, repeated rows, clashing columns, and no rows at all."""
    import corpus_pipeline

    spark.createDataFrame([] if empty else [(1, 1, 0), (6, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([] if empty else [(1, "far id"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = docs([] if empty else edge_rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns and out.count() <= table.count()
    found = corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).collect()
    assert (len(found) == 0) == empty

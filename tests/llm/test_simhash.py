import random
import re

import pytest
import xxhash

from chatloom.llm import components, simhash


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(prints))]


def vocabulary_text(rng, n):
    return " ".join(rng.choices("alpha Beta gamma DELTA épsilon zeta eta theta İota kappa\x85lamda".split(" "), k=n))


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 300])
def test_fingerprints(n):
    rng = random.Random(n)
    text = vocabulary_text(rng, n)
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_components_equal_brute_force(spark, docs, edge_rows):
    rng = random.Random(1)
    base = [vocabulary_text(rng, 400) for _ in range(30)]
    texts = base + [b + " end" for b in base for _ in range(2)] + [b.replace("alpha", "beta", 1) for b in base] + base[:10]
    rows = [(100 + i, t) for i, t in enumerate(texts)] + [r for r in edge_rows if r[0] is not None and r[0] != 4]
    rng.shuffle(rows)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.components(docs(rows)).collect()}
    prints = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(prints, 4)
    smallest = {}
    for (i, _), c in zip(rows, label, strict=True):
        smallest[c] = min(i, smallest.get(c, i))
    assert found == {i: (f"{p:016x}", smallest[c]) for (i, _), p, c in zip(rows, prints, label, strict=True)}


@pytest.mark.parametrize("tile", [3, 1024])
def test_tiles_lose_no_link(spark, tile):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    prints = seeds + [s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for s in seeds for _ in range(8)]
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    group = simhash.ROOT_A_GROUP
    try:
        simhash.ROOT_A_GROUP = 3  # several groups of tiles for few fingerprints
        found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), 4, tile)
        labels = {r["node"]: r["component"] for r in components.connected_components(found).collect()}
    finally:
        simhash.ROOT_A_GROUP = group
    brute = brute_components(prints, 4)
    ours = [labels.get(s, s) for s in signed]
    assert len(set(zip(ours, brute, strict=True))) == len(set(ours)) == len(set(brute))


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = [*chain, *star, *chain[:5], (7, 7), (5000, 5000), (None, 3), (3, None)]
    random.Random(3).shuffle(edges)
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(200)}, 5000: 5000}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_document_of_each_group_stays(docs):
    copy = "the same long text of several words that all of them share in full"
    rows = [(9, copy), (3, copy), (3, copy), (3, copy.upper()), (None, copy), (4, None), (2, ""), (None, None), (8, "alone here")]
    kept = simhash.deduplicated(docs(rows))
    assert kept.columns == docs([]).columns
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert len(found) == 3 and (2, "") in found and (8, "alone here") in found
    assert [i for i, t in found if t and t.lower() == copy] == [3]
    assert simhash.deduplicated(docs([])).collect() == [] and simhash.components(docs([])).collect() == []


def test_a_group_without_ids_keeps_one(docs):
    assert len(simhash.deduplicated(docs([(None, "a b c d e"), (None, "a b c d e")])).collect()) == 1
    found = simhash.components(docs([(None, "a b c d e"), (5, "a b c d e")])).collect()
    assert [r["component_id"] for r in found] == [5, 5]

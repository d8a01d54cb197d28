"""op1: fingerprints, links and components against brute force."""

import random

import pytest
import xxhash

from metricloom.llm.graph import components
from metricloom.llm.simhash import distinct_documents, links, near_duplicates
from tests.llm.brute import union_find

DOCS = "doc_id long, text string, component_id string, _key int"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [(doc, brute_fingerprint(text)) for doc, text in rows]
    close = [
        (i, j)
        for i in range(len(prints))
        for j in range(i)
        if (prints[i][1] ^ prints[j][1]).bit_count() <= 4
    ]
    roots = union_find(range(len(prints)), close)
    out = []
    for i, (doc, value) in enumerate(prints):
        ids = [prints[j][0] for j in roots if roots[j] == roots[i] and prints[j][0] is not None]
        out.append((doc, value, min(ids, default=None)))
    return sorted(out, key=repr)


def found(frame):
    rows = frame.select("doc_id", "fp", "component_id").collect()
    return sorted([(r[0], r[1] & (2**64 - 1), r[2]) for r in rows], key=repr)


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(12):
        base = rng.choices(words, k=150)
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    rows += [None, "", " \n\t", "one", "One", "one two three", "Éa éa b c d", "x " * 30000]
    rows += [rows[0]] * 20
    return [(i, t) for i, t in enumerate(rows)]


def test_components_equal_brute_force(spark):
    rows = texts() + [(None, "one two three"), (None, "alone without id"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame([(*r, "extra", 1) for r in rows], DOCS)
    assert found(near_duplicates(docs)) == brute(rows)


def test_links_at_every_distance(spark):
    rng = random.Random(5)
    values = []
    for distance in range(9):
        for _ in range(20):
            value = rng.getrandbits(64)
            bits = rng.sample(range(64), distance)
            values += [value, value ^ sum(1 << b for b in bits)]
    hot = rng.getrandbits(64)  # a chain, and a ball with many members
    values += [hot ^ (1 << b) for b in range(64)] + [hot ^ ((1 << b) - 1) for b in range(64)]
    values = sorted(set(values))
    to_signed = lambda v: v - (1 << 64) if v >> 63 else v
    prints = spark.createDataFrame([(to_signed(v),) for v in values], "fp long")
    pairs = [(a & (2**64 - 1), b & (2**64 - 1)) for a, b in links(prints).collect()]
    assert all(1 <= (a ^ b).bit_count() <= 4 for a, b in pairs)
    close = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4]
    assert union_find(values, pairs) == union_find(values, close)


def test_one_document_of_each_group_stays(spark):
    rows = texts()
    docs = spark.createDataFrame([(*r, "extra", 1) for r in rows], DOCS)
    kept = distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r[2] for r in brute(rows)})


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert near_duplicates(docs).count() == 0
    assert distinct_documents(docs).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    pairs += [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(300)]
    edges = spark.createDataFrame([*pairs, (None, 3), (7, 7)], "a long, b long")
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    expected = union_find(nodes, pairs)
    assert {r.node: r.component for r in components(edges).collect()} == expected

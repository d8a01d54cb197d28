"""op13: leaves, roots, proofs and tampering against a plain Merkle tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from metricloom.llm.manifest import folded, manifest, op13_levels

DOCS = "doc_id long, source string, lang string, n_chars long, text string, key int, leaf string, n int, payload int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = [*row[:4], text]
    return digest(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def levels(nodes):
    """All levels over a list of nodes, itself included."""
    out = [nodes]
    while len(out[-1]) > 1:
        low = out[-1]
        out.append([digest(*low[i : i + 3]) for i in range(0, len(low), 3)])
    return out


def way(tree, at):
    """Siblings before and after a node, level by level."""
    for level in tree[:-1]:
        start = at // 3 * 3
        yield level[start:at], level[at + 1 : start + 3]
        at //= 3


def plain(rows):
    """The contract's rows: (doc_id, leaf, subroot, root, proof, folded root, verified)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {}
    for s in sources:
        mine = [(leaf(r, r[4]), r) for r in rows if r[1] == s]
        own[s] = sorted(mine, key=lambda m: (m[1][0] is not None, m[1][0] or 0, m[0]))
    trees = {s: levels([h for h, _ in own[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, (h, row) in enumerate(own[s]):
            path = [*way(trees[s], at), *way(top, k)]
            node, text = h, row[4]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                node = leaf(row, text.replace("\n", ""))
            for before, after in path:
                node = digest(*before, node, *after)
            siblings = "".join("".join(b + a) for b, a in path)
            root = top[-1][0]
            out.append((row[0], h, trees[s][-1][0], root, digest(siblings), node, node == root))
    return out


def key(row):
    return tuple(map(str, row))


def documents(sizes):
    rows, number = [], 0
    for source, size in sizes.items():
        for i in range(size):
            text = ["line\nline", "one line", "", None, "é\n漢\r\n", "\n"][i % 6]
            rows.append((number * 7 % 10007, source, None if i % 5 == 0 else "en", i if i % 4 else None, text))
            number += 1
    return rows


def found(spark, rows, tmp_path):
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], DOCS).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return op13_levels(spark, str(tmp_path))


@pytest.mark.parametrize("size", [1, 2, 3, 4, 9, 10, 28])
def test_one_source(spark, tmp_path, size):
    rows = documents({"web": size})
    assert sorted(map(tuple, found(spark, rows, tmp_path).collect()), key=key) == sorted(plain(rows), key=key)


def test_sources_of_all_sizes_with_nulls_ties_and_repeats(spark, tmp_path):
    rows = documents({"web": 300, None: 5, "": 1, "b": 81, "é": 82, "z": 27, "Z": 28, "漢": 10, "a": 730})
    rows += [(None, "web", "en", 1, "no id\n")] * 3 + [(14, "web", "en", 2, "twice")] * 2 + [(14, "web", None, 2, "tie")]
    answer = sorted(plain(rows), key=key)
    result = found(spark, rows, tmp_path)
    assert result.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    collected = sorted(map(tuple, result.collect()), key=key)
    assert collected == answer
    assert {r[6] for r in collected} == {True, False}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    # Blocks of 9 leaves, so that some trees are several blocks high.
    up = folded(F.col("leaf"), F.col("path")).alias("up")
    again = manifest(docs, height=2).select("doc_id", "leaf", "subroot", "root", up)
    assert sorted((tuple(r) for r in again.collect()), key=key) == sorted(
        ((a, h, s, r, r) for a, h, s, r, *_ in answer), key=key
    )


def test_many_sources(spark, tmp_path):
    rows = [(i, f"s{i}", "en", 1, f"text {i}") for i in range(800)]
    assert sorted(map(tuple, found(spark, rows, tmp_path).collect()), key=key) == sorted(plain(rows), key=key)


def test_kept_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in documents({"web": 4})], DOCS)
    out = manifest(docs.withColumnRenamed("leaf", "own"), fields=("doc_id", "text"), keep=("doc_id", "key", "n"))
    assert out.columns == ["doc_id", "key", "n", "leaf", "subroot", "root", "path"]
    assert {(r.key, r.n) for r in out.collect()} == {(1, 2)}
    assert manifest(docs.limit(0)).count() == 0

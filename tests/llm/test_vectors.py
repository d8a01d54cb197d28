"""op7: links, components and recall against all cosines."""

import numpy as np

from metricloom.llm import vectors
from tests.llm.brute import union_find

ROWS = "vec_id long, embedding array<float>, node int, vector string"


def brute(rows):
    """(vec_id, n_links, component_id, kept) by comparing every pair."""

    def unit(v):
        if not v or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            return None
        v = np.array(v, np.float32).astype(float)
        return v / np.sqrt((v**2).sum()) if v.any() else None

    units = [unit(v) for _, v in rows]
    pairs = [
        (i, j)
        for i, a in enumerate(units)
        for j, b in enumerate(units[:i])
        if a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9
    ]
    roots = union_find(range(len(rows)), pairs)
    ids: dict = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            ids[roots[i]] = min(name, ids.get(roots[i], name))
    out = []
    for i, (name, _) in enumerate(rows):
        component = ids.get(roots[i])
        out.append((name, sum(i in p for p in pairs), component, name is not None and name == component))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS)
    result = vectors.near_duplicates(frame, **options).collect()
    return sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in result], key=repr)


def clusters(rng, n, width, noise):
    out = []
    for _ in range(n):
        base = rng.normal(size=width)
        out += [base * rng.uniform(0.1, 9) + rng.normal(size=width) * noise for _ in range(rng.integers(1, 9))]
    return [v.astype(np.float32).tolist() for v in out]


def test_links_and_components(spark):
    rng = np.random.default_rng(1)
    values = clusters(rng, 40, 16, 0.3) + clusters(rng, 1, 16, 0.0) * 5
    values += [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] + [1.0] * 15]
    values += [[float("inf")] + [1.0] * 15, [1e-30] * 16, [1e30] * 16, [1.0] * 16, [1.0, 2.0], [2.0, 4.0]]
    rows = list(enumerate(values))
    rows += [(None, values[0]), (None, [-1.0] * 16), (3, values[3]), (3, values[9]), (4, None)]
    assert found(spark, rows) == brute(rows)


def test_lists_and_blocks_of_any_size(spark, monkeypatch):
    for name, value in (("LIST_ROWS", 4), ("BLOCK_ROWS", 8)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(2)
    near = [(np.ones(8) + rng.normal(size=8) * 0.1).astype(np.float32).tolist() for _ in range(60)]
    rows = list(enumerate(near + clusters(rng, 30, 8, 0.2)))
    assert found(spark, rows, training_rows=100) == brute(rows)


def test_recall_on_all_rows_of_a_table(spark):
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.1"
    data = pq.read_table(f"{path}/embeddings.parquet").to_pydict()
    units = np.array(data["embedding"], float)
    units /= np.sqrt((units**2).sum(1, keepdims=True))
    expected = dict(zip(data["vec_id"], (units @ units.T >= 0.9).sum(1) - 1, strict=True))
    result = {r.vec_id: r.n_links for r in vectors.op7_pq(spark, path).collect()}
    assert set(result) == set(expected)
    assert all(result[k] <= expected[k] for k in expected)
    assert sum(result.values()) >= 0.99 * sum(expected.values())


def test_recall_of_pairs_just_above_the_limit(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_ROWS", 64)
    rng = np.random.default_rng(4)
    one = rng.normal(size=(2000, 64))
    one /= np.sqrt((one**2).sum(1, keepdims=True))
    other = rng.normal(size=one.shape)
    other -= (other * one).sum(1, keepdims=True) * one
    other /= np.sqrt((other**2).sum(1, keepdims=True))
    cosine = rng.uniform(0.901, 0.93, size=(2000, 1))
    near = cosine * one + np.sqrt(1 - cosine**2) * other
    rows = list(enumerate(np.concatenate([one, near]).astype(np.float32).tolist()))
    result = found(spark, rows)
    assert sum(r[1] for r in result) >= 0.95 * 4000
    # A component needs one of the two directions only.
    assert sum(r[3] for r in result) <= 2000 + 0.02 * 2000


def planted(rng, n, width, rank):
    """n pairs of cosine 0.901 to 0.93 within a subspace of the given rank."""
    frame = np.linalg.qr(rng.normal(size=(width, rank)))[0].T
    one = rng.normal(size=(n, rank))
    one /= np.sqrt((one**2).sum(1, keepdims=True))
    other = rng.normal(size=one.shape)
    other -= (other * one).sum(1, keepdims=True) * one
    other /= np.sqrt((other**2).sum(1, keepdims=True))
    cosine = rng.uniform(0.901, 0.93, size=(n, 1))
    near = cosine * one + np.sqrt(1 - cosine**2) * other
    return (np.concatenate([one, near]) @ frame).astype(np.float32)


def test_no_link_is_lost_in_low_ranks_mixed_lengths_and_many_lists(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_ROWS", 16)
    rng = np.random.default_rng(6)
    groups = [planted(rng, 400, w, r) for w, r in ((64, 64), (64, 16), (64, 8), (200, 16), (12, 12))]
    values = [v for group in groups for v in group]
    expected, at = {}, 0
    for group in groups:
        units = group.astype(float) / np.sqrt((group.astype(float) ** 2).sum(1, keepdims=True))
        expected.update(enumerate(((units @ units.T >= 0.9).sum(1) - 1).tolist(), at))
        at += len(group)
    result = found(spark, [(i, v.tolist()) for i, v in enumerate(values)])
    assert {r[0]: r[1] for r in result} == expected


def test_both_ends_are_credited(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_ROWS", 8)
    rng = np.random.default_rng(7)
    near = planted(rng, 150, 32, 12)
    # Copies make weights; each link of a pair is one of every copy at the other end.
    values = [v.tolist() for v in np.concatenate([near, near[:20], near[:20], near[150:160]])]
    rows = list(enumerate(values))
    assert found(spark, rows) == brute(rows)


def test_each_pair_is_searched_for_once(spark):
    rng = np.random.default_rng(8)
    points = vectors._unit(planted(rng, 500, 64, 16).astype(float))
    index = vectors._fit(points, 20)
    at, group, bits = index.probes(points, np.sqrt(2 - 2 * vectors.COSINE))
    own = vectors._nearest(points, index.centres)
    searched = {
        (i, g * vectors.GROUP + k)
        for i, g, b in zip(at.tolist(), group.tolist(), bits.tolist(), strict=True)
        for k in range(vectors.GROUP)
        if b >> k & 1
    }
    assert max(g for _, g in searched) == 19
    for a, b in zip(*np.nonzero(points @ points.T >= vectors.COSINE), strict=True):
        ends = ((a, own[b]) in searched) + ((b, own[a]) in searched)
        assert ends == (2 if own[a] == own[b] else 1)


def test_empty_table_and_no_valid_vector(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, [0.0]), (None, [])]) == brute([(1, None), (2, [0.0]), (None, [])])


def test_vectors_are_sent_in_rounds_of_bounded_size(spark, monkeypatch):
    for name, value in (("LIST_ROWS", 4), ("BLOCK_ROWS", 8), ("ROUND_VALUES", 1), ("BLOCKS", 1)):
        monkeypatch.setattr(vectors, name, value)
    sent, blocks = [], vectors._blocks

    def counted(*args):
        out = blocks(*args).localCheckpoint()
        sent.append(sum(len(r.members) + len(r.queries) for r in out.collect()))
        return out

    monkeypatch.setattr(vectors, "_blocks", counted)
    rng = np.random.default_rng(9)
    near = [(np.ones(8) + rng.normal(size=8) * 0.1).astype(np.float32).tolist() for _ in range(60)]
    rows = list(enumerate(near + clusters(rng, 30, 8, 0.2)))
    assert found(spark, rows, training_rows=100) == brute(rows)
    # What one round sends is in proportion to the table, though all of them send it many times over.
    assert sum(sent) > 4 * len(rows) and max(sent) <= 2 * len(rows)


def test_rounds_hold_each_pair_of_blocks_once():
    sizes = [(0, 2, 3), (1, 1, 1), (2, 4, 5)]
    held = []
    for groups, low, high in vectors._rounds(sizes, 4):
        assert high - low <= 4
        numbers = [first + k for _, own, other, first in groups for k in range(own * other)]
        held += [n for n in numbers if low <= n < high]
    assert held == list(range(27))

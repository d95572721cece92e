import numpy as np
import pytest

from tidemark.llm import forest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    ok = []
    for k, (i, v, label) in enumerate(rows):
        a = np.array([np.nan] if v is None else [np.nan if x is None else x for x in v], np.float64)
        if i is not None and label is not None and np.isfinite(a).all() and (a * a).sum() > 0:
            ok.append((k, i, a / np.sqrt((a * a).sum()), label))
    links, root = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for at, (_, i, a, label) in enumerate(ok):
        for _, j, b, other in ok[at + 1 :]:
            if label == other and len(a) == len(b) and a @ b >= threshold:
                links[i] += 1
                links[j] += 1 if j != i else 0
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted(((i, links[i], find(i), find(i) == i) for i, *_ in rows), key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for centre in range(60):
        c = rng.standard_normal(16)
        for _ in range(rng.integers(1, 9)):
            rows.append((n, (c + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.3])).tolist(), int(centre % 3)))
            n += 1
    copies = [(n + k, rows[5][1], rows[5][2]) for k in range(5)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [1.0] * 16, None), (905, [1.0] * 3, 1), (None, rows[0][1], rows[0][2]), (906, [float("inf")] * 16, 0), (907, [], 0)]
    short = [(910, [1.0, 2.0], 1), (911, [1.0, 2.0], 1), (912, [2.0, 4.01], 1), (913, [1.0, 2.0], 0), (914, [1.0, 0.0, 0.0], 1)]
    return rows + copies + odd + short


def run(spark, rows, **kw):
    return sorted(map(tuple, forest.near_vectors(spark.createDataFrame(rows, SCHEMA), **kw).collect()), key=repr)


def test_brute_force(spark, vectors):
    assert run(spark, vectors) == brute(vectors)


def test_small_leaves_reach_nine_tenths(spark, vectors):
    got, expected = run(spark, vectors, leaf=8, trees=12), brute(vectors)
    assert sum(r[1] for r in got) >= 0.9 * sum(r[1] for r in expected)
    assert all(a[1] <= b[1] for a, b in zip(got, expected, strict=True))  # nothing below the threshold


def test_large_tight_leaf_goes_in_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (np.ones(16) + 0.01 * rng.standard_normal(16)).tolist(), 0) for k in range(300)]
    assert sorted(run(spark, rows, leaf=40)) == [(k, 299, 0, k == 0) for k in range(300)]


def test_default_trees_reach_every_link_of_leaves_that_split(spark):
    """4,800 vectors under one label, half of them one near copy of another at a cosine of 0.98 to 0.985: with the
    default trees and leaves of at most 100 rows the forest is about six levels deep."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((2400, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.standard_normal(base.shape)
    away -= (away * base).sum(axis=1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cosine = rng.uniform(0.9802, 0.985, (2400, 1))
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * away]).astype(np.float32)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    linked = y @ y.T >= 0.98
    np.fill_diagonal(linked, False)
    got = {r[0]: r[1] for r in run(spark, rows, leaf=100)}
    assert all(got[k] <= n for k, n in enumerate(linked.sum(axis=1).tolist()))
    assert sum(got.values()) >= 0.99 * linked.sum() and linked.sum() >= 4800


def test_one_clique_leaves_a_row_a_vector(spark):
    """All pairs link, in leaves of several blocks and in every tree: counts stay exact, and no pair leaves a group."""
    rng = np.random.default_rng(9)
    rows = [(k, (np.ones(8) + 0.01 * rng.standard_normal(8)).tolist(), 0) for k in range(500)]
    assert sorted(run(spark, rows, leaf=100, block=64)) == [(k, 499, 0, k == 0) for k in range(500)]


def test_groups_match_a_plain_count():
    rng = np.random.default_rng(2)
    linked = rng.random((40, 40)) < 0.03
    linked |= linked.T
    np.fill_diagonal(linked, False)
    reach = linked | np.eye(40, dtype=bool)
    for _ in range(6):
        reach = reach @ reach
    assert forest._roots(linked, False).tolist() == reach.argmax(axis=1).tolist()
    across = forest._roots(linked[:15, 15:], True)
    two = np.zeros((40, 40), bool)
    two[:15, 15:] = linked[:15, 15:]
    reach = two | two.T | np.eye(40, dtype=bool)
    for _ in range(6):
        reach = reach @ reach
    assert across.tolist() == reach.argmax(axis=1).tolist()
    lists = [np.array(sorted(set(rng.integers(0, 9, 3)))) for _ in range(12)]
    expected = [[bool(set(a) & set(b)) for b in lists[5:]] for a in lists[:5]]
    assert forest._shared_before(lists[:5], lists[5:]).tolist() == expected


def test_repeated_rows_and_clashing_columns(spark, vectors):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(vectors, SCHEMA).withColumns({c: F.lit(1) for c in ("rep", "tree", "node", "copies", "h", "v", "id")})
    assert sorted(map(tuple, forest.near_vectors(frame).collect()), key=repr) == brute(vectors)
    twice = spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [5.0, -1.0], 0)], SCHEMA)
    assert sorted(map(tuple, forest.near_vectors(twice).collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_empty(spark):
    assert run(spark, []) == []

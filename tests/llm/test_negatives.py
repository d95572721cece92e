import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives as op

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, divisor=50, positives=5, negatives=3):
    live = []
    for i, v, g in rows:
        if v is None or g is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        if sum(x * x for x in q) < 2**62:
            live.append((i, q, g))
    rank = lambda i: (i is None, i if i is not None else 0)
    out = []
    for k, (i, q, g) in enumerate(live):
        if i is None or i % divisor:
            continue
        others = [(sum(x * y for x, y in zip(q, q2, strict=True)), j, g2) for k2, (j, q2, g2) in enumerate(live) if k2 != k and len(q2) == len(q)]
        others.sort(key=lambda x: (-x[0], rank(x[1])))
        for ps, p, _ in [x for x in others if x[2] == g][:positives]:
            fits = [x for x in others if x[2] != g and 50 * ps <= 100 * x[0] <= 95 * ps][:negatives]
            out += [(i, p, n + 1, j, ps, s) for n, (s, j, _) in enumerate(fits)]
    return sorted(out, key=repr)


def run(spark, rows, divisor=50, schema=SCHEMA, **kw):
    frame = spark.createDataFrame(rows, schema).repartition(5)
    frame = frame.withColumns({c: F.lit("mine") for c in ("id", "vector", "anchor", "ab", "block")})
    return sorted(map(tuple, op.hard_negatives(frame, F.col("vec_id") % divisor == 0, **kw).collect()), key=repr)


def gaussian(n, d, seed, labels=4, low_rank=None):
    dice = np.random.default_rng(seed)
    x = dice.normal(size=(n, low_rank or d)) @ (dice.normal(size=(low_rank, d)) if low_rank else np.eye(d))
    return [(k, [float(np.float32(c)) for c in v], int(g)) for k, (v, g) in enumerate(zip(x, dice.integers(0, labels, n), strict=True))]


def odd_rows():
    rows = gaussian(160, 6, 1)
    nan, inf = float("nan"), float("inf")
    rows += [(5, [1.0] * 6, None), (10, None, 1), (15, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (20, [nan] * 6, 1), (25, [1.0, inf, 0.0, 0.0, 0.0, 0.0], 2)]
    rows += [(None, [0.5] * 6, 1), (None, [0.5] * 6, 2), (30, [0.5] * 6, 1), (30, [0.5] * 6, 1), (30, [0.5] * 6, 1), (35, [0.0] * 6, 3)]
    rows += [(40, [1.0, 2.0], 1), (41, [1.0, 1.0], 1), (42, [1.0, 0.5], 2), (45, [], 1), (46, [], 1), (47, [], 2), (50, [3e38, 1.0, 0.0, 0.0, 0.0, 0.0], 1)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(op, "BLOCK_BYTES", 8 * 6 * 7)
    rows = odd_rows()
    got = run(spark, rows, 5, **({"group_bytes": 900, "anchor_block": 3} if small else {}))
    assert got == brute(rows, 5) and len(got) > 100


def test_large_values_stay_exact(spark):
    rows = [(k, [float(np.float32(x * 2.0**19)) for x in v], g) for k, v, g in gaussian(60, 5, 2)]
    assert run(spark, rows, 3) == brute(rows, 3)


def test_one_vector_in_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_BYTES", 8 * 8 * 40)
    rows = gaussian(300, 8, 3)
    rows += [(1000 + k, rows[7][1], k % 2) for k in range(150)]
    assert run(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1)]) == []
    assert run(spark, [(50, [1.0], 1)]) == []


def test_leading_components_discard_pairs(spark):
    rows = gaussian(400, 32, 4, labels=2, low_rank=3)
    assert run(spark, rows, 10) == brute(rows, 10)
    q = np.floor(256 * np.array([v for _, v, _ in rows]))
    axes = np.linalg.eigh(q.T @ q)[1][:, ::-1]
    side = op._Side(q.astype("int32").tobytes(), op._turn(q, axes).tobytes(), *q.shape)
    seen = []

    def wanted(lower, upper):
        seen.append(lower.shape[1])
        exact = q @ q.T
        if lower.shape == exact.shape:
            assert ((lower <= exact) & (exact <= upper)).all()
        return upper >= op._kth(lower, 5)[:, None]

    kept, exact = op.surviving(side, side, np.zeros((400, 400), bool), wanted)
    found = exact > op.NONE
    assert found.sum() < 0.05 * 400 * 400 and (exact[found] == (q @ q.T)[:, kept][found]).all()
    assert (np.sort(exact, 1)[:, -5:] == np.sort(q @ q.T, 1)[:, -5:]).all()


def test_ties_go_to_smaller_ids(spark):
    dice = random.Random(6)
    rows = [(k, [float(dice.randrange(2)) for _ in range(3)], dice.randrange(3)) for k in range(200)]
    assert run(spark, rows, 10) == brute(rows, 10)

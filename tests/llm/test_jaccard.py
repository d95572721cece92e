import random
from collections import Counter, defaultdict

import pytest

from tidemark.llm import jaccard
from tidemark.llm.components import components


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n=5, threshold=80):
    sets = [shingles(t, n) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    first = defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        if i is not None and sets[k]:
            first[find(k)].append(i)
    return sorted(((i, len(sets[k]), min(first[find(k)], default=i) if sets[k] else i) for k, (i, *_) in enumerate(rows)), key=repr)


def run(frame, **kw):
    return sorted(map(tuple, jaccard.jaccard_components(frame, **kw).collect()), key=repr)


def test_brute_force(docs, clashing, rows):
    assert run(docs) == brute(rows)
    assert run(clashing) == brute(rows)


def family(seed, docs, length, edits, common=()):
    """Near copies with more and fewer edits, around the threshold, and passages that others share."""
    rng, out = random.Random(seed), []
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    for _ in range(docs):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[f"e{rng.random()}"], [], [words[at], "again"]])
        for passage in common:
            if rng.random() < 0.4:
                words += passage
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("rounds", [1, 3])
def test_families_around_the_threshold(spark, rounds):
    passage = [f"p{k}" for k in range(60)]
    texts = [t for s in range(8) for t in family(s, 25, 40 + 30 * s, 10, [passage])] + family(99, 120, 150, 14)
    rows = list(enumerate(texts))
    random.Random(7).shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = run(frame, rounds=rounds)
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(got)


def test_other_thresholds(spark):
    rows = list(enumerate(t for s in range(5) for t in family(s, 12, 60, 12)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for threshold in (50, 95):
        assert run(frame, threshold=threshold) == brute(rows, threshold=threshold)


def test_one_document_of_each_group_stays(docs, rows):
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    expected = Counter(i for i, _, c in brute(rows) if i == c and i is not None)
    found = Counter(r["doc_id"] for r in kept.collect())
    assert found.pop(None) == 2 and found == expected  # rows without an id share a verdict: one of them stays


def test_signatures_never_rule_out_too_much():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (1, 3, 40, 700):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)]))
        assert jaccard._most(jaccard.signature(a), jaccard.signature(b)) >= len(np.intersect1d(a, b))
    crowded = np.arange(5000, dtype=np.uint64)
    assert jaccard.signature(crowded) == b"" and jaccard._most(b"", b"x") >= 5000


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(30)] + [(7, 7)] + [(200, 300), (300, 250)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{100 + k: 100 for k in range(1, 30)}, 300: 200, 250: 200}


def test_empty(empty):
    assert run(empty) == [] and jaccard.drop_near_duplicates(empty).collect() == []

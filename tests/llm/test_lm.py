import math
from collections import Counter

import pytest

from tidemark.llm import lm


def brute(rows, words, order=3, backoff=0.4):
    texts = [words(t) for _, t, *_ in rows]
    grams = lambda w, n: [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
    counts = Counter(g for w in texts for n in range(1, order + 1) for g in grams(w, n))
    total, out = sum(map(len, texts)), []
    for (i, *_), w in zip(rows, texts, strict=True):
        own = Counter(g for n in range(1, order + 1) for g in grams(w, n))
        left = lambda g: counts[g] - own[g]

        def s(g):
            if len(g) == 1:
                return (left(g) or backoff) / max(1, total - len(w))
            return left(g) / left(g[:-1]) if left(g) else backoff * s(g[1:])

        score = sum(math.log(s(tuple(w[max(0, k - order + 1) : k + 1]))) for k in range(len(w)))
        out.append((i, len(w), round(score, 6)))
    return sorted(out, key=repr)


def run(frame, **kw):
    return sorted(((r["doc_id"], r["n_words"], round(r["log_score"], 6)) for r in lm.score(frame, **kw).collect()), key=repr)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_brute_force(docs, rows, split_words, order):
    assert run(docs, order=order) == brute(rows, split_words, order)


def test_rows_and_packed_rows_agree(docs, clashing, rows, split_words):
    for frame in (docs, clashing):
        got = [(r["doc_id"], r["n_words"], round(r["log_score"], 6)) for r in lm.score_rows(frame).collect()]
        assert sorted(got, key=repr) == brute(rows, split_words)


def test_many_parts_and_clashes(clashing, rows, split_words, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 200)
    monkeypatch.setattr(lm, "PER_PART", 100)
    assert run(clashing) == brute(rows, split_words)


def test_mean_is_null_without_words(docs, empty):
    assert {r["mean_log_score"] for r in lm.score(docs).filter("n_words = 0").collect()} == {None}
    assert lm.score(empty).collect() == []

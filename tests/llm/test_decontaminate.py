import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as op
from tidemark.llm.common import LOWER, UPPER

ITEMS = [
    (1, "play on its banks until the evening bells ring out over the valley and more that no document has"),
    (2, "The river runs past the old mill, and the children play!"),
    (3, "ONE two-three"),
    (4, None),
    (5, " !! "),
    (None, "no id here at all only text that stands alone"),
    (6, "日本語"),
    (7, "and the children play on its banks until the evening bells ring"),
    (7, "own line number ten here"),
    (10, "children play on its banks until the evening bells ring"),
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, LOWER)))


def brute(docs, items, span=10):
    passages = {}
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            passages.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes, out = {len(p) for p in passages}, []
    for i, text in docs:
        w = words(text)
        hit, names = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in passages:
                    hit |= set(range(k, k + n))
                    names |= passages[p]
        found = sorted(str(x) for x in names if x is not None)
        spans = [(k, next(e for e in range(k, len(w) + 1) if e not in hit)) for k in sorted(hit) if k - 1 not in hit]
        out.append((i, len(w), len(hit), spans, found))
    return sorted(out, key=repr)


def run(docs, items, **kw):
    judged, sets = op.decontaminate(docs, items, **kw)
    rows = judged.join(sets, "item_set", "left").collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], [tuple(s) for s in r["spans"]], list(r["items"] or [])) for r in rows), key=repr)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_brute_force(docs, clashing, rows, items):
    want = brute([r[:2] for r in rows], ITEMS)
    assert sum(r[2] > 0 for r in want) > 5
    assert run(docs, items) == want
    assert run(clashing, items.withColumn("words", F.lit("mine")).withColumn("class", F.lit("mine"))) == want


def test_many_short_items_and_few_words(spark):
    dice = random.Random(5)
    text = lambda n: " ".join(dice.choice("abcd") for _ in range(n))
    items = [(dice.randrange(30), text(dice.randrange(14))) for _ in range(40)]
    docs = [(k % 50, text(dice.choice([0, 1, 3, 9, 10, 11, 60]))) for k in range(80)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for span, gram in ((10, 5), (6, 6), (4, 2), (1, 1)):
        assert run(*frames, span=span, gram=gram) == brute(docs, items, span)


def test_items_beyond_the_bounds(docs, rows, items, monkeypatch):
    monkeypatch.setattr(op, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(op, "MAX_BITS", 64)
    assert run(docs, items) == brute([r[:2] for r in rows], ITEMS)


def test_a_text_of_many_megabytes(spark, items):
    text = " ".join(f"filler{k % 9973}" for k in range(400_000)) + " one two three " + "x" * 2_000_000
    docs = spark.createDataFrame([(1, text), (2, "one two three")], "doc_id long, text string")
    assert len(text) > 5_000_000
    assert run(docs, items) == [(1, 400_004, 3, [(400_000, 400_003)], ["3"]), (2, 3, 3, [(0, 3)], ["3"])]


def test_empty_tables(docs, empty, items, rows):
    assert run(empty, items) == []
    assert run(docs, items.limit(0)) == brute([r[:2] for r in rows], [])


def test_fingerprints_and_plan(spark, docs, items):
    rows = spark.createDataFrame([("a b c d e f g a b c d e f",)], "text string").select(op.words_of(F.col("text")).alias("words"))
    prints = op._hashed(rows, [6], 3).select("_f6").first()[0]
    assert len(prints) == 8 and prints[0] == prints[7] and len(set(prints)) < 7  # neighbours share the smallest gram
    plan = op.decontaminate(docs, items)[0]._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query(spark):
    from tidemark.llm import queries

    sf = "/root/testdata/sf0.001"
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*c).collect()]
    want = brute(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    got = {r["doc_id"]: r for r in queries.op11_decontamination(spark, sf).collect()}
    assert len(got) == len(want)
    for i, n, hit, _, names in want:
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(names), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()

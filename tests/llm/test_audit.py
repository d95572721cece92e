from collections import Counter
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import audit as op


def brute(rows, labels):
    docs = [(i, t or "", s or "") for i, t, _, s, *_ in rows]
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    space = " \t\n\v\f\r"

    def fails(i, t):
        for c in space[1:]:
            t = t.replace(c, " ")
        w = [x for x in t.split(" ") if x]
        return {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t)}

    marked = [(i, s, fails(i, t) | {"E": i is not None and i > first[t]}) for i, t, s in docs]
    out = []
    for part in sorted({s for _, _, s in docs}):
        mine = [(i, f) for i, s, f in marked if s == part]
        shapley, lines = Counter(), []
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order):
                gone = [d for d in left if d[1][x]]
                kept = [d for d in left if not d[1][x]]
                shapley[x] += len(gone)
                failing = sum(f[x] for _, f in mine)
                only = sum(f[x] and sum(f.values()) == 1 for _, f in mine)
                lines.append((part, "".join(order), step + 1, len(kept), len(gone), failing - len(gone), only, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), x))
                left = kept
        out += [(*line[:-1], shapley[line[-1]]) for line in lines]
    return sorted(out)


LABELS = [(1, 1, 0), (2, 0, 1), (9, 1, 1), (9, 0, 0), (12, None, 1), (13, 1, None), (None, 1, 1), (999, 1, 1)]
MORE = [(20, "word " * 80, "x", "a", 1), (21, "word " * 80, "x", "b", 1), (22, " ".join(map(str, range(60))), "x", "a", 1), (23, " ".join(map(str, range(60))) + " #", "x", None, 1), (19, "word " * 80, "x", "a", 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def run(docs, labelled):
    return sorted(map(tuple, op.filter_audit(docs, labelled).collect()))


def test_brute_force(spark, rows, monkeypatch):
    every = rows + MORE
    want = brute(every, LABELS)
    assert run(frame(spark, every), labels(spark)) == want and any(r[3] for r in want)
    monkeypatch.setattr(op, "PARTS_HELD", 0)
    clashing = frame(spark, every).withColumns({c: F.lit("mine") for c in ("part", "bits", "digest", "label", "_id", "_first")})
    assert run(clashing, labels(spark).withColumn("label", F.lit("mine"))) == want


def test_empty(spark, empty, docs, rows):
    assert run(empty, labels(spark)) == []
    assert run(docs, labels(spark).limit(0)) == brute(rows, [])


def test_table():
    table = op.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all() and (table[31] == 0).all()
    assert table[0b00110][op.ORDERS.index("ACBDE")] == 1 and table[0b10000][op.ORDERS.index("ABCDE")] == 4


def test_failures_of_texts():
    assert op.failures(b"") == 1 and op.failures(("é" * 20 + "A").encode()) == 1 and op.failures(("é" * 18 + "A").encode()) == 1 | 4
    assert op.failures(b"\x1cword\x1c " * 60) == 2  # a control character beyond the five is no space
    assert op.failures(" ".join(map(str, range(50))).encode()) == 0 and op.failures(" ".join(map(str, range(49))).encode() + b"|") == 9


def test_large_group_and_long_text(spark):
    text = " ".join(f"w{k}" for k in range(700_000))
    rows = [(k, "same text", "x", f"s{k % 3}", 1) for k in range(3000)] + [(5000, text, "x", "s0", 1), (5001, text, "x", "s1", 1)]
    assert len(text) > 5_000_000 - 300_000
    got = {(r[0], r[1], r[2]): r for r in run(frame(spark, rows), labels(spark))}
    assert got["s0", "EABCD", 1][3:5] == (2, 999) and got["s1", "EABCD", 1][3:5] == (0, 1001)
    assert np.isclose(sum(got["s1", "ABCDE", s][4] for s in range(1, 6)), 1001)

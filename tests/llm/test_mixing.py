import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing out the excess until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def brute_mix(rows, weights=(5, 2, 1), most=3, seed=7, rounds=3):
    """Copies of each (id, source, size), in order, by the definition: whole copies, then prefixes of the ranking."""
    sizes, out = {}, [0] * len(rows)
    for _, source, size in rows:
        sizes[source] = sizes.get(source, 0) + size
    target = water(sizes, weights, most)
    for source, total in sizes.items():
        if not total:
            continue
        share = target[source] / total
        copies = math.floor(share)
        missing, p = target[source] - copies * total, share - copies
        ranked = []
        for k, (i, s, size) in enumerate(rows):
            if s == source:
                out[k] = copies
                u = (int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
                ranked.append((u / (1 - u) / (p / (1 - p)) if p > 0 else u, -1 if i is None else i, size, k))
        chosen: set = set()
        for _ in range(rounds):
            run = won = 0
            for _, _, size, k in sorted(ranked):
                if k not in chosen and 0 < size <= missing:
                    run += size
                    if run <= missing:
                        won += size
                        chosen.add(k)
                        out[k] += 1
            missing -= won
    return out


def test_brute_force(spark):
    rows = [(k, f"s{k % 7 % 4}" if k % 11 else None, 1 + k * 7919 % 400) for k in range(900)] + [(2000 + k, "tiny", k % 3) for k in range(9)]
    frame = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, s, n in rows], "doc_id long, text string, source string").repartition(4)
    got = {r["doc_id"]: r["copies"] for r in mixing.mix(frame).collect()}
    expected = brute_mix(rows)
    assert [got[i] for i, s, n in rows if n] == [c for c, (i, s, n) in zip(expected, rows, strict=True) if n]


def test_targets_and_limits(docs, clashing, rows):
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    expected = water(sizes)
    for frame in (docs, clashing):
        out = mixing.mix(frame).collect()
        assert len(out) == len(rows)
        for r in out:
            assert r["target"] == pytest.approx(expected[r["source"]]) and r["source_size"] == sizes[r["source"]]
            assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]


def test_taken_comes_near_the_target_and_reruns_agree(spark):
    rows = [(k, " ".join(["w"] * (1 + k * 7919 % 90)), f"s{k % 5 if k % 3 else 0}") for k in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    out = mixing.mix(frame).cache()
    for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert r["taken"] == pytest.approx(r["target"], abs=5)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mixing.mix(frame.repartition(3)).collect()))


def test_capped_source_spreads_over_many_ranges(spark):
    """Every document of a source at its limit is taken three times; its rows still fall into ranges of even size."""
    rows = [(k, "a b c", "big" if k % 50 else "aa") for k in range(20_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(frame).cache()
    capped = out.filter("source = 'aa'")
    assert {(r["copies"], r["taken"]) for r in capped.collect()} == {(3, 9)}
    assert {r["target"] for r in capped.collect()} == {3.0 * 3 * 400}
    most = capped.groupBy(F.floor(F.col("u") * 64)).count().agg(F.max("count")).first()[0]
    assert most < 30


def test_certain_copies_and_one_more_at_most(spark):
    frame = spark.createDataFrame([(k, "a b c d e f g h", f"s{k % 4}") for k in range(400)], "doc_id long, text string, source string")
    for r in mixing.mix(frame).collect():
        base = int(r["target"] / r["source_size"])
        assert r["copies"] in (base, base + 1)


def test_copies_become_rows(docs, clashing):
    for frame in (docs, clashing):
        mixed = mixing.mix(frame)
        out = mixing.apply_mix(frame, mixed)
        assert out.columns == frame.columns
        most = mixed.groupBy("doc_id", "source").agg(F.max("copies").alias("n"), F.count("*").alias("rows"))
        expected = sum(r["n"] * r["rows"] for r in most.collect())
        assert out.count() == expected


def test_empty(empty, spark):
    assert mixing.mix(empty).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.mix(blank).collect()} == {(0, 0.0, 0)}

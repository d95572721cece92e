import hashlib
import string
from collections import defaultdict

from tidemark.llm import exact

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[(text or "").translate(LOWER)].append(i)
    out = []
    for i, text, *_ in rows:
        norm = (text or "").translate(LOWER)
        ids = groups[norm]
        keep = max((k for k in ids if k is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(frame, **kw):
    return sorted(map(tuple, exact.exact_groups(frame, **kw).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_brute_force(docs, clashing, rows):
    assert run(docs) == brute(rows)
    assert run(clashing) == brute(rows)


def test_tables_grow_with_the_rows_by_ranges(spark):
    rows = [(k, f"text {k % 70_000}") for k in range(100_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert exact._tables(100_000, 16, 1 << 19) == (1 << 19, 4)
    assert exact._tables(10**9, 16, 1 << 29) == (1 << 29, 30)
    got = exact.exact_groups(frame, max_bits=1 << 19).cache()
    assert got.filter("kept").count() == 70_000
    assert got.filter("group_size = 2").count() == 60_000
    kept = exact.drop_exact_duplicates(frame, max_bits=1 << 19)
    assert kept.count() == 70_000 and kept.agg({"doc_id": "min"}).first()[0] == 30_000


def test_ranges_give_the_same_rows(docs, clashing, rows):
    for frame in (docs, clashing):
        assert run(frame, bits_per_row=1 << 14, max_bits=1 << 16) == brute(rows)
        kept = exact.drop_exact_duplicates(frame, bits_per_row=1 << 14, max_bits=1 << 16)
        assert kept.columns == frame.columns and kept.count() == len({e[4] for e in brute(rows)})


def test_filter_far_too_small_loses_nothing(spark):
    frame = spark.createDataFrame([(k, f"text {k % 7_000}") for k in range(10_000)], "doc_id long, text string")
    got = exact.exact_groups(frame, bits_per_row=1)
    assert got.filter("kept").count() == 7_000 and got.filter("group_size = 2").count() == 6_000


def test_large_group_is_dealt_to_many_tasks(spark):
    rows = [(k, "the one text" if k % 3 == 0 else f"text {k}") for k in range(6_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact.exact_groups(frame).filter("group_size = 2000")
    assert got.count() == 2_000 and got.filter("kept").first()["doc_id"] == 5_997


def test_drop_keeps_one_whole_row(docs, clashing, rows):
    for frame in (docs, clashing):
        kept = exact.drop_exact_duplicates(frame)
        assert kept.columns == frame.columns
        assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted({e[1] for e in brute(rows) if e[1] is not None} | {None}, key=repr)
        assert kept.count() == len({e[4] for e in brute(rows)})


def test_no_python_in_the_plan(docs):
    plan = exact.exact_groups(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty(empty):
    assert run(empty) == [] and exact.drop_exact_duplicates(empty).collect() == []

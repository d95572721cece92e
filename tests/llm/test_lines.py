import hashlib
from collections import defaultdict

from tidemark.llm import lines


def key(line):
    return line.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()


def brute(rows):
    held = defaultdict(set)
    rank = lambda i: -(1 << 63) if i is None else i
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                held[key(line)].add(rank(i))
    out = []
    for i, text, *_ in rows:
        every = (text or "").split("\n")
        kept = [x for x in every if not held.get(key(x)) or min(held[key(x)]) == rank(i)]
        out.append((i, len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(docs, **kw):
    got = lines.dedup_lines(docs, **kw).select("doc_id", "n_lines", "n_dropped", "text").collect()
    return sorted(((r[0], r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in got), key=repr)


def test_brute_force(docs, clashing, rows):
    expected = brute(rows)
    for parts in (1, 3, 8):  # runs that end inside a partition and runs that span several
        assert run(docs, parts=parts) == expected
    assert run(clashing) == expected


def test_hot_line_over_many_partitions(spark):
    rows = [(k, f"a line that everybody has\nmine alone {k:06d}\nA LINE THAT everybody has ") for k in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert run(frame, parts=16) == brute(rows)


def test_bitmaps_hold_no_text(docs):
    maps = lines.keep_bitmaps(docs).collect()
    assert {r["doc"] for r in maps} == {2, 1, 10, 9, 17, 13} & {r["doc"] for r in maps}
    for r in maps:
        assert lines.kept_text("x\n" * 10, r["keep_bitmap"]).count("x") <= 10


def test_empty(empty):
    assert run(empty) == []

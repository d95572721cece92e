import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import fasta_index, tracks


def rows_scanned(frame):
    """Rows that the scan of a frame gave out, after running it."""
    rows = frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return rows, sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


@pytest.fixture(scope="module")
def genome(tmp_path_factory):
    dice, top = random.Random(9), tmp_path_factory.mktemp("fa")
    seqs = {f"{k}": "".join(dice.choice("ACGTN") for _ in range(n)) for k, n in ((1, 100_000), (2, 61), (3, 60), (4, 1), (5, 7000))}
    cut = lambda s, n: "\n".join(s[k : k + n] for k in range(0, len(s), n))
    (top / "a.fa").write_text("".join(f">chr{k} some text\n{cut(s, 60)}\n" for k, s in seqs.items()))
    ragged = "".join(dice.choice("AC") for _ in range(3000))
    lines, at = [], 0
    while at < len(ragged):
        step = dice.randrange(1, 90)
        lines.append(ragged[at : at + step])
        at += step
    (top / "b.fa").write_bytes((">ragged\r\n" + "\r\n".join(lines) + "\r\n\r\n>empty\r\n>last\r\nACGT").encode())
    (top / ".a.fa.crc").write_bytes(b"crc\n>\x80\xff\nACGT\n")
    (top / "_SUCCESS").write_bytes(b"")
    return top, seqs | {"ragged": ragged, "last": "ACGT"}


def test_index_and_fetch(spark, genome):
    top, seqs = genome
    dice = random.Random(10)
    asked = [(k, a := dice.randrange(-5, len(s) + 10), a + dice.randrange(200)) for k, s in seqs.items() for _ in range(20)] + [("1", 1, 100_000), ("nowhere", 1, 5), ("2", 9, 3), (None, 1, 2), ("1", 50, 70), ("1", 50, 70)]
    requests = spark.createDataFrame([(*r, {"k": "v"}) for r in asked], "chrom string, start long, end long, more map<string,string>")
    want = sorted(((c, a, b, (seqs.get(c) or "")[max(a, 1) - 1 : max(b, 0)] or None) for c, a, b in asked), key=repr)
    for split in (1 << 20, 1000, 64):
        index = fasta_index.fasta_index(spark, str(top), split)
        assert {r["chrom"]: r["n"] for r in index.groupBy("chrom").agg(F.max("last").alias("n")).collect()} == {k: len(s) for k, s in seqs.items()}
        got = fasta_index.fetch(requests, index).select("chrom", "start", "end", "seq").collect()
        assert sorted(map(tuple, got), key=repr) == want


def test_bytes_read_follow_the_request(spark, genome, monkeypatch):
    top, _ = genome
    index = fasta_index.fasta_index(spark, str(top / "a.fa")).cache()
    assert index.filter("chrom = '1'").count() == 2

    def read(n):
        asked = spark.createDataFrame([(k, "1", 1 + k * 5000, 50 + k * 5000) for k in range(n)], "_key int, chrom string, start long, end long")
        ranges = fasta_index.byte_ranges(asked, index).agg(F.sum(F.col("to_byte") - F.col("from_byte"))).first()[0]
        return ranges

    assert read(1) == 50 and read(10) <= 510


def test_tracks_are_pruned_by_region(spark, tmp_path):
    track = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("chrom"), (F.col("id") / 2).cast("long").alias("pos"), (F.col("id") * 7 % 11).alias("v"))
    path = str(tmp_path / "t")
    tracks.write_track(track, path, group_rows=2000)
    regions = [("a", 100, 300), ("a", 5000, 5001), ("b", 99_000, 120_000), ("b", 0, 0), (None, 5, 6), ("z", 1, 9)]
    frame = spark.createDataFrame(regions, "chrom string, lo long, hi long")
    for most in (1000, 3, 1):
        rows, scanned = rows_scanned(tracks.touching(spark, path, frame, most=most))
        have = {(r["chrom"], r["pos"]): r["v"] for r in rows}
        assert len(have) == len(rows)
        for c, lo, hi in regions:
            for p in range(lo, min(hi, 99_999) + 1) if c in ("a", "b") else ():
                assert have[c, p] == (2 * p + (c == "b")) * 7 % 11
        if most == 1000:
            assert len(rows) < 2000 and scanned <= 12_000
    assert len(tracks.cover(frame, most=1000)) == 5 and tracks.touching(spark, path, frame.limit(0)).count() == 0


def test_cover_is_bounded(spark):
    frame = spark.range(5000).select(F.lit("a").alias("chrom"), (F.col("id") * 977).alias("lo"), (F.col("id") * 977 + 3).alias("hi"))
    found = tracks.cover(frame, most=50)
    assert 1 <= len(found) <= 50 and all(any(a <= k * 977 and k * 977 + 3 <= b for _, a, b in found) for k in range(5000))

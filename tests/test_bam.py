import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import bam, bam_source
from tidemark.sources.bgzf import Blocks, BgzfWriter, text_lines

HEADER = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:chr{k}\tLN:{10**7}\n" for k in (1, 2, 3))
KIND = bam.SCHEMA


def reads(n=4000, seed=1, longest=120):
    dice = random.Random(seed)
    out = []
    for k in range(n):
        chrom = str(dice.randrange(1, 4))
        size = dice.randrange(20, longest)
        pos = dice.randrange(9 * 10**6 if k % 3 else 10**5)
        seq = "".join(dice.choice("ACGTN") for _ in range(size))
        cigar = [(4, 5), (0, size - 5), (2, dice.randrange(1, 40))]
        tags = {"RG": dice.choice("ab"), "XP": str(dice.randrange(-3, 9)), "ZQ": "Q"}
        out.append((f"r{k}", dice.choice([0, 16, 99]), chrom, pos, dice.randrange(60), cigar, dice.choice([chrom, None]), pos + 9, dice.randrange(-500, 500), seq, "I" * size if k % 5 else None, tags))
    return out + [("alone", 4, None, -1, 0, None, None, -1, 0, None, None, {}), ("*", 0, "1", 0, 0, [(0, 3)], None, -1, 0, "ACG", None, {})]


def plain(rows):
    return sorted((repr(tuple([tuple(x) for x in v] if isinstance(v, list) else (sorted(v.items()) if isinstance(v, dict) else v) for v in r)) for r in rows))


@pytest.fixture(scope="module")
def one_file(spark, tmp_path_factory):
    """A sorted file with its index."""
    bam_source.register(spark)
    path = tmp_path_factory.mktemp("bam") / "sorted"
    frame = spark.createDataFrame(reads(), KIND).coalesce(1).sortWithinPartitions(F.col("chrom").asc_nulls_last(), "pos")
    frame.write.format("bam").mode("append").option("header", HEADER).save(str(path))
    assert sorted(p.suffix for p in path.iterdir()) == [".bai", ".bam"]
    return next(path.glob("*.bam"))


def load(spark, path, **options):
    return spark.read.format("bam").options(**options).load(str(path))


def test_same_rows_in_one_and_many_splits(spark, one_file):
    want, size = plain(reads()), one_file.stat().st_size
    for split in (size, size // 2, size // 20, 997):
        frame = load(spark, one_file, splitBytes=split)
        assert frame.rdd.getNumPartitions() == -(-size // split)
        assert plain(frame.collect()) == want


def test_records_longer_than_blocks(spark, tmp_path):
    rows = reads(60, 2, 90) + [("long", 0, "1", 5, 9, [(0, 300_000)], None, -1, 0, "ACGTA" * 60_000, "5" * 300_000, {"RG": "a" * 70_000})]
    random.Random(3).shuffle(rows)
    spark.createDataFrame(rows, KIND).coalesce(1).write.format("bam").mode("append").option("header", HEADER).save(str(tmp_path / "x"))
    path = next((tmp_path / "x").glob("*.bam"))
    assert not list((tmp_path / "x").glob("*.bai"))  # not in order
    for split in (10**9, 20_000, 3_000):
        assert plain(load(spark, path, splitBytes=split).collect()) == plain(rows)


def touched(reader):
    """(rows, blocks inflated) of all partitions of a reader, in this process."""
    rows, count, at = [], 0, bam.Blocks

    class Counting(at):
        def at(self, offset, sure=True):
            nonlocal count
            count += 1
            return super().at(offset, sure)

    bam.Blocks = Counting
    try:
        for part in reader.partitions():
            count -= 1 + bool(part.path)  # the header, and the first block again where a chunk starts in it
            rows += list(reader.read(part))
    finally:
        bam.Blocks = at
    return rows, count


def test_regions_read_few_blocks(spark, one_file):
    everything, blocks = touched(bam.BamReader(str(one_file)))
    assert len(everything) == len(reads()) and blocks > 8
    for chrom, lo, hi in (("1", 40_000, 41_000), ("2", 1, 200), ("3", 8_000_000, 8_400_000), ("2", 5_000_001, 5_000_001)):
        end = lambda r: r[3] + max(1, sum(n for op, n in r[5] or [] if op in bam.ON_REFERENCE))
        want = [r for r in reads() if r[2] == chrom and r[3] < hi and end(r) >= lo]
        got, few = touched(bam.BamReader(str(one_file), region=f"chr{chrom}:{lo}-{hi}"))
        assert plain(got) == plain(want) and few <= max(4, blocks // 3)
        assert plain(load(spark, one_file, region=f"chr{chrom}:{lo}-{hi}", splitBytes=5000).collect()) == plain(want)
    two = load(spark, one_file.parent, region="1:40000-41000;chr3:8000000-8400000")
    assert two.count() == sum(load(spark, one_file, region=x).count() for x in ("1:40000-41000", "3:8000000-8400000"))


def test_filters_reach_the_source(spark, one_file):
    got = load(spark, one_file).filter("chrom = '2' AND pos > 50000 AND pos <= 90000 AND flag = 16")
    assert "BatchScan" in got._jdf.queryExecution().executedPlan().toString()
    assert plain(got.collect()) == plain([r for r in reads() if r[2] == "2" and 50000 < r[3] <= 90000 and r[1] == 16])
    assert plain(load(spark, one_file).filter("pos < 0").collect()) == plain([r for r in reads() if r[3] < 0])
    assert load(spark, one_file).filter("chrom = '9'").collect() == [] and load(spark, one_file).filter("chrom IS NULL").count() == 1
    reader = bam.BamReader(str(one_file))
    assert list(reader.pushFilters([bam.EqualTo(("chrom",), "1"), bam.LessThan(("pos",), 1000), bam.EqualTo(("flag",), 4)])) == [bam.EqualTo(("flag",), 4)]
    rows, few = touched(reader)
    assert {r[2] for r in rows} == {"1"} and max(r[3] for r in rows) < 1000 and few <= 4


def test_append_overwrite_and_failure(spark, tmp_path):
    path, frame = str(tmp_path / "out"), spark.createDataFrame(reads(50), KIND)
    put = lambda df, mode: df.write.format("bam").mode(mode).option("header", HEADER).save(path)
    put(frame, "append")
    put(frame, "append")
    assert load(spark, path).count() == 104
    before = sorted(p.name for p in (tmp_path / "out").iterdir())
    with pytest.raises(Exception, match="has no @SQ line"):
        put(frame.unionByName(spark.createDataFrame([("bad", 0, "77", 1, 0, None, None, -1, 0, None, None, {})], KIND)).repartition(3), "overwrite")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == before
    put(frame.select("qname", "chrom", "pos", "cigar").limit(7), "overwrite")
    assert load(spark, path).count() == 7
    put(frame.limit(0), "overwrite")
    assert load(spark, path).count() == 0 and len(list((tmp_path / "out").glob("*.bam"))) == 1


def test_repeated_tasks_leave_one_file(spark, tmp_path):
    from tidemark.sources.bam_sink import BamWriter

    class Context:
        def __init__(self, attempt):
            self.attempt = attempt

        def partitionId(self):
            return 3

        def taskAttemptId(self):
            return self.attempt

    import pyspark

    writer, real = BamWriter(str(tmp_path / "t"), HEADER, ["qname", "chrom", "pos"], False), pyspark.TaskContext.get
    try:
        done = []
        for attempt in (7, 8):  # the first ended, but its message was lost
            pyspark.TaskContext.get = staticmethod(lambda attempt=attempt: Context(attempt))
            done.append(writer.write(iter([("a", "1", 5)])))
    finally:
        pyspark.TaskContext.get = real
    writer.commit(done[1:])
    assert [p.suffix for p in sorted((tmp_path / "t").iterdir())] == [".bam", ".bai"] and load(spark, tmp_path / "t").count() == 1
    writer.abort([None])
    assert list((tmp_path / "t").iterdir()) == []


def test_lines_of_block_compressed_text(spark, tmp_path):
    dice = random.Random(4)
    lines = ["x" * dice.choice([0, 1, 30, 700]) + f" {k}" * (k % 7 > 0) for k in range(3000)]
    spark.dataSource.register(__import__("tidemark.sources.bgzf", fromlist=["BgzfText"]).BgzfText)
    for name, ending, size in (("a", "\n", 500), ("b", "", 60), ("c", "\n", 65280)):
        path = tmp_path / f"{name}.gz"
        with open(path, "wb") as stream:
            out = BgzfWriter(stream, size)
            out.write(("\n".join(lines) + ending).encode())
            out.flush()
            out._block(b"")  # an empty block inside
            out.write(b"last\nlines" if ending else b"")
            out.close()
        want = lines + (["last", "lines"] if ending else [])
        total = path.stat().st_size
        assert [x.decode() for _, x in text_lines(Blocks(str(path)), 0, total)] == want
        for split in (total, total // 7, 1 + total // 50):
            rows = spark.read.format("bgzf_text").option("splitBytes", split).load(str(path))
            assert [r["value"] for r in rows.orderBy("at").collect()] == want
    assert spark.read.format("bgzf_text").load(str(tmp_path)).count() == 3 * len(lines) + 4
    with __import__("gzip").open(tmp_path / "a.gz", "rt") as plain_text:
        assert plain_text.read().split("\n") == lines + ["last", "lines"]


def test_line_breaks_at_block_ends(tmp_path):
    for cut in range(1, 12):
        path = tmp_path / f"{cut}.gz"
        with open(path, "wb") as stream:
            out = BgzfWriter(stream, cut)
            out.write(b"ab\ncd\n\n\nefg\nhi\nj")
            out.close()
        starts, at = [], 0
        blocks = Blocks(str(path))
        while (got := blocks.at(at)) is not None:
            starts.append(at)
            at = got[1]
        for k in range(1, len(starts)):
            two = [x for a, b in ((0, starts[k]), (starts[k], at)) for _, x in text_lines(blocks, a, b)]
            assert two == [b"ab", b"cd", b"", b"", b"efg", b"hi", b"j"]

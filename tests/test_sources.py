import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.sources import sinks, text
from tidemark.sources.bam import BASES
from tidemark.sources.bam_source import register


def put(path, content):
    path.write_text(content)
    return str(path)


def test_regions():
    assert text.parse_region("'chr12:1,000-2,000'") == ("12", 1000, 2000)
    assert text.parse_region("ALL") is None and text.parse_region(None) is None
    for bad in ("12", "1:5-2", "1:a-b"):
        with pytest.raises(ValueError):
            text.parse_region(bad)


SAM = "@SQ\tSN:chr1\tLN:9\n@RG\tID:g1\tLB:libA\n" + "r1\t99\tchr1\t11\t60\t5M1D2S\t=\t31\t27\tACGTACG\tIIIIIII\tRG:Z:g1\tXP:i:3\nr2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n"


def test_sam_and_read_groups(spark, tmp_path):
    path = put(tmp_path / "x.sam", SAM)
    rows = {r["qname"]: r for r in text.sam(spark, path).collect()}
    r = rows["r1"]
    assert (r["chrom"], r["pos"], r["mate_chrom"], r["mate_pos"], r["isize"], r["tags"]) == ("1", 10, "1", 30, 27, {"RG": "g1", "XP": "3"})
    assert [tuple(c) for c in r["cigar"]] == [(0, 5), (2, 1), (4, 2)]
    assert rows["r2"]["cigar"] is None and rows["r2"]["seq"] is None and rows["r2"]["chrom"] is None
    assert [tuple(x) for x in text.read_groups(spark, path).collect()] == [("g1", "libA")]


def bgzf(data: bytes) -> bytes:
    out = b""
    for at in range(0, len(data), 60):
        part = data[at : at + 60]
        press = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = press.compress(part) + press.flush()
        out += b"\x1f\x8b\x08\x04" + b"\0" * 6 + struct.pack("<HHHH", 6, 0x4342, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_bam(spark, tmp_path):
    def read(name, ref, pos, seq):
        packed = bytes((BASES.index(a) << 4) | BASES.index(b) for a, b in zip(seq[::2], (seq + "=")[1::2], strict=False))
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, 1, 99, len(seq), -1, -1, 27) + name.encode() + b"\0" + struct.pack("<I", len(seq) << 4) + packed + bytes([40] * len(seq)) + b"RGZg1\0XPC\x03"
        return struct.pack("<i", len(body)) + body

    header = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 2) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 900) + struct.pack("<i", 5) + b"chr2\0" + struct.pack("<i", 900)
    (tmp_path / "a.bam").write_bytes(bgzf(header + read("r1", 0, 10, "ACGTN") + read("r2", 1, 20, "ACG")) + bgzf(b""))
    register(spark)
    rows = {r["qname"]: r for r in spark.read.format("bam").load(str(tmp_path)).collect()}
    assert (rows["r1"]["chrom"], rows["r1"]["pos"], rows["r1"]["seq"], rows["r1"]["qual"], rows["r1"]["tags"]) == ("1", 10, "ACGTN", "IIIII", {"RG": "g1", "XP": "3"})
    assert [tuple(c) for c in rows["r2"]["cigar"]] == [(0, 3)] and rows["r2"]["mate_chrom"] is None
    assert [r["qname"] for r in spark.read.format("bam").load(str(tmp_path / "a.bam")).filter("chrom = '2'").collect()] == ["r2"]


def test_wig_over_splits(spark, tmp_path):
    lines = ["fixedStep chrom=chr1 start=5 step=1"] + [str(k) for k in range(300)] + ["", "fixedStep chrom=chr2 start=100 step=10", "7", "8"]
    path = put(tmp_path / "t.wig", "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        got = sorted(map(tuple, text.wig(spark, path).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted([("1", 5 + k, float(k)) for k in range(300)] + [("2", 100, 7.0), ("2", 110, 8.0)])


def test_fasta_chunks(spark, tmp_path):
    seq = "".join("ACGT"[k * k % 4] for k in range(500))
    path = put(tmp_path / "g.fa", ">chr1 desc\n" + "\n".join(seq[k : k + 60] for k in range(0, 500, 60)) + "\n>chr2\nAC\n")
    rows = {(r["chrom"], r["chunk_no"]): r for r in text.fasta(spark, path, 128, 10).collect()}
    for k in range(4):
        assert rows["1", k]["seq"] == seq[k * 128 : (k + 1) * 128 + 10] and rows["1", k]["chunk_start"] == k * 128 + 1
    assert rows["2", 0]["seq"] == "AC"


def test_sites_in_four_notations(spark, tmp_path):
    where = lambda kind, line, **kw: tuple(text.site_list(spark, put(tmp_path / kind, line + "\n"), kind, **kw).first())
    assert where("offset", "chr1\t100\t120\tTF\t7\t+") == ("TF", "1", 107, "+")
    assert where("sites", "1:500:-", name="n") == ("n", "1", 500, "-")
    assert where("named", "2:100:111:TF:+") == ("TF", "2", 105, "+")
    assert where("nameFirst", "TF:2:100:111:-") == ("TF", "2", 105, "-")
    with pytest.raises(ValueError):
        text.site_list(spark, "x", "sites")


def test_tables(spark, tmp_path):
    gtf = put(tmp_path / "a.gtf", '#!x\nchr1\tprotein_coding\ttranscript\t10\t90\t.\t-\t.\tgene_id "G1"; transcript_id "T1"; gene_name "N";\n')
    assert tuple(text.gtf(spark, gtf).first()) == ("1", "protein_coding", "transcript", 10, 90, "-", "G1", "T1", "N")
    assert [tuple(r) for r in text.length_distribution(spark, put(tmp_path / "l.tsv", "Length\tCounts\n35\t7\n1 2 3\n")).collect()] == [(35, 7)]
    assert [tuple(r) for r in text.kmer_table(spark, put(tmp_path / "k.tsv", "ACGT\t7\nbad\n")).collect()] == [("ACGT", 7)]
    with gzip.open(tmp_path / "ids.gz", "wt") as out:
        out.write("T1\nT2\nT1\n\n")
    assert sorted(r[0] for r in text.id_list(spark, str(tmp_path / "ids.gz")).collect()) == ["T1", "T2"]
    wide = text.matrix(spark, put(tmp_path / "m.tsv", "Gene\tliver\tlung\nG1\t1.5\tNA\n"), "gene", "tissue", "fpkm")
    assert sorted(map(tuple, wide.collect())) == [("G1", "liver", 1.5), ("G1", "lung", None)]
    assert tuple(text.bed(spark, put(tmp_path / "p.bed", "chr1\t99\t150\tp\t7\t+\n")).first())[:3] == ("1", 100, 150)


def test_wig_round_trip(spark, tmp_path):
    track = spark.range(1, 400).filter("id % 50 > 3").select(F.lit("1").alias("chrom"), F.col("id").alias("pos"), (F.col("id") * 3).alias("v"))
    for piece in (11, sinks.PIECE):
        at = tmp_path / f"w{piece}"
        sinks.write_wig(track, "v", str(at), "none", piece)
        back = text.wig(spark, [str(p) for p in at.rglob("*.txt")])
        assert sorted((r["pos"], int(r["value"])) for r in back.collect()) == sorted((r["pos"], r["v"]) for r in track.collect())


def test_by_key_and_fastq(spark, tmp_path):
    sinks.write_by_key(spark.createDataFrame([("a/b::c", 1), ("d", 2)], "name string, v int"), "name", str(tmp_path / "k"))
    assert {p.name for p in (tmp_path / "k").iterdir() if p.is_dir()} == {"name=a-b-c", "name=d"}
    read = spark.createDataFrame([("r", "ACGN", "1234", True)], "qname string, seq string, qual string, reverse boolean")
    assert sinks.fastq_lines(read).first()["line"] == "@r\nNCGT\n+\n4321"

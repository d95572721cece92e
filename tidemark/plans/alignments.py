"""Queries that write alignments as indexed BAM files and read them back: in splits, by region, and against intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import reads as fn
from tidemark.operators import joins
from tidemark.plans.registry import query
from tidemark.plans.relations import cte, relation
from tidemark.plans.shared import folder
from tidemark.sources import bam_source

HEADER = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:chr{k}\tLN:1000000\n" for k in range(1, 8)) + "@RG\tID:A\tLB:lib\n"
SEQ = "substr(repeat('ACGT', 30), CAST(pos % 4 AS INT) + 1, qlen + 5)"


def alignments(spark, sf_dir):
    """The reads in the columns of the BAM source."""
    return _aligned(relation(spark, sf_dir, "reads"))


def _aligned(reads):
    return reads.selectExpr(
        "qname", "flag", "CAST(chrom AS STRING) AS chrom", "pos", "60 AS mapq", "array(named_struct('op', 4, 'len', 5), named_struct('op', 0, 'len', qlen)) AS cigar", "CAST(chrom AS STRING) AS mate_chrom",
        "mate_pos", "CAST(isize AS INT) AS isize", f"{SEQ} AS seq", "repeat('I', qlen + 5) AS qual", "map('RG', rg, 'XP', CAST(xp AS STRING)) AS tags",
    )


def written_bam(spark, sf_dir) -> str:
    """A folder of indexed files with the reads in order."""
    path = folder(spark, "bam")
    bam_source.register(spark)
    ordered = relation(spark, sf_dir, "reads").withColumn("chrom", F.col("chrom").cast("string")).repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos")
    _aligned(ordered).write.format("bam").mode("append").option("header", HEADER).save(path)
    return path


COLUMNS = f"qname, flag, CAST(chrom AS VARCHAR) AS chrom, pos, CAST(chrom AS VARCHAR) AS mate_chrom, mate_pos, CAST(isize AS INT) AS isize, {SEQ} AS seq, qlen AS ref_len, rg, CAST(xp AS VARCHAR) AS xp"


def _shown(rows):
    return rows.select("qname", "flag", "chrom", "pos", "mate_chrom", "mate_pos", "isize", "seq", fn.reference_length(F.col("cigar")).alias("ref_len"), F.col("tags")["RG"].alias("rg"), F.col("tags")["XP"].alias("xp"))


@query(cte("reads") + f"\nSELECT {COLUMNS} FROM reads")
def op_source_bam(spark, sf_dir):
    """Whole files, each read by many tasks."""
    return _shown(spark.read.format("bam").option("splitBytes", 1 << 16).load(written_bam(spark, sf_dir)))


@query(cte("reads") + f"\nSELECT {COLUMNS} FROM reads WHERE chrom = 3 AND pos + 1 <= 9000 AND pos + qlen >= 4000 OR chrom = 5 AND pos + 1 <= 300 AND pos + qlen >= 100")
def op_source_bam_region(spark, sf_dir):
    """Reads that overlap two regions, through the index."""
    return _shown(spark.read.format("bam").option("region", "chr3:4,000-9,000;chr5:100-300").load(written_bam(spark, sf_dir)))


@query(cte("reads") + f"\nSELECT {COLUMNS} FROM reads WHERE chrom IN (2, 6) AND pos >= 12000 AND pos < 12900")
def op_source_bam_pushed(spark, sf_dir):
    """Bounds on contig and position that Spark hands to the source."""
    rows = spark.read.format("bam").load(written_bam(spark, sf_dir))
    return _shown(rows.filter("chrom IN ('2', '6') AND pos >= 12000 AND pos < 12900"))


@query(cte("reads", "regions") + """
SELECT qname, flag, CAST(chrom AS VARCHAR) AS chrom, pos, rg, xp FROM reads r WHERE NOT EXISTS (SELECT 1 FROM regions g WHERE g.chrom = r.chrom AND g.lo <= r.pos + r.qlen AND g.hi >= r.pos + 1)""")
def op_joins_reads_outside(spark, sf_dir):
    """Alignments as read from BAM, map column and all, that overlap no region."""
    rows = spark.read.format("bam").load(written_bam(spark, sf_dir))
    rows = rows.withColumns({"s": F.col("pos") + 1, "e": F.col("pos") + fn.reference_length(F.col("cigar"))})
    regions = relation(spark, sf_dir, "regions").withColumn("chrom", F.col("chrom").cast("string"))
    out = joins.overlapping(rows, regions, "chrom", ("s", "e"), ("lo", "hi"), anti=True)
    return out.select("qname", "flag", "chrom", "pos", F.col("tags")["RG"].alias("rg"), F.col("tags")["XP"].cast("int").alias("xp"))

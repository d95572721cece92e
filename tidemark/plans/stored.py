"""Queries on files that are read in parts: sequences by offset, tracks by region, block-compressed text in splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import signal
from tidemark.plans.registry import query
from tidemark.plans.relations import load, relation
from tidemark.plans.shared import folder
from tidemark.plans.signals import REGIONS, the_track
from tidemark.sources import bgzf, fasta_index, tracks

SEQUENCES = "SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents"
ASKED = "(40, 99), (1, 7), (61, 61), (55, 700), (-3, 4)"


def _fasta(spark, sf_dir) -> str:
    """One file for each partition, lines of 60 bases."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq")).filter("seq <> ''")
    lines = rows.select(F.concat(F.lit(">chr"), F.col("doc_id").cast("string"), F.lit(" of a document\n"), F.array_join(F.expr("regexp_extract_all(seq, '.{1,60}', 0)"), "\n")).alias("value"))
    path = folder(spark, "fasta")
    lines.write.text(path)
    return path


@query(f"""WITH q AS ({SEQUENCES}), asked AS (SELECT * FROM (VALUES {ASKED}) t(start, "end"))
SELECT CAST(doc_id AS VARCHAR) AS chrom, start, "end", substr(seq, greatest(start, 1), "end" - greatest(start, 1) + 1) AS seq FROM q, asked WHERE length(seq) >= greatest(start, 1)
UNION ALL SELECT CAST(doc_id AS VARCHAR), start, "end", NULL FROM q, asked WHERE length(seq) < greatest(start, 1)""")
def op_sequence_random_access(spark, sf_dir):
    """Ranges of indexed sequence files, read by their offsets."""
    index = fasta_index.fasta_index(spark, _fasta(spark, sf_dir), 1 << 16)
    asked = spark.createDataFrame([(40, 99), (1, 7), (61, 61), (55, 700), (-3, 4)], "start int, end int")
    requests = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chrom")).crossJoin(F.broadcast(asked))
    return fasta_index.fetch(requests, index)


@query(REGIONS + """,
rows_ AS (SELECT r.cid, r.strand, r.chrom, p.pos, coalesce(t.cov, 0) AS cov, coalesce(t.ends, 0) AS ends, coalesce(t.wps, 0) AS wps
  FROM (SELECT cid, strand, chrom, unnest(range(lo, lo + 200)) AS pos FROM regions WHERE cid % 2 = 0) p JOIN regions r ON r.cid = p.cid LEFT JOIN track t ON t.chrom = p.chrom AND t.pos = p.pos)
SELECT cid, CAST(row_number() OVER (PARTITION BY cid ORDER BY CASE WHEN strand = '-' THEN -pos ELSE pos END) AS INT) AS rank, chrom, pos, cov, ends, wps FROM rows_""")
def op_signal_stored_regions(spark, sf_dir):
    """The track written in order, and the stretches around short regions read from it."""
    path = folder(spark, "track")
    tracks.write_track(the_track(spark, sf_dir), path, group_rows=4000)
    regions = relation(spark, sf_dir, "regions").filter("cid % 2 = 0").withColumn("hi", F.col("lo") + 199)
    return signal.region_track(tracks.touching(spark, path, regions), regions, drop_empty=False)


@query("SELECT CAST(event_id AS VARCHAR) || chr(9) || event_type || chr(9) || props AS value FROM events")
def op_source_block_text(spark, sf_dir):
    """Block-compressed text, each file read by many tasks."""
    spark.dataSource.register(bgzf.BgzfText)
    path = folder(spark, "text")
    lines = load(spark, sf_dir, "events").selectExpr("CAST(event_id AS STRING) || '\\t' || event_type || '\\t' || props AS value")
    lines.repartition(3).write.format("bgzf_text").mode("append").save(path)
    return spark.read.format("bgzf_text").option("splitBytes", 1 << 14).load(path).select("value")

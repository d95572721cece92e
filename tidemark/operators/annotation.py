"""Annotation: features of a GTF to oriented sites, transcript tables and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.intervals import anchor
from tidemark.operators.joins import members

#: feature and which end counts on the plus strand (fixed values)
ANCHORS = {"tss": ("transcript", False), "tse": ("transcript", True), "start_codon": ("start_codon", False), "stop_codon": ("stop_codon", False), "acceptor": ("exon", False), "donor": ("exon", True)}


def attribute(attributes: Column, name: str) -> Column:
    """Value of a GTF attribute, null where it is missing."""
    found = F.regexp_extract(attributes, rf'(?:^|;\s*){name} "([^"]*)"', 1)
    return F.when(found != "", found)


def sites(gtf: DataFrame, kind: str, transcripts: DataFrame | None = None, genes: DataFrame | None = None, shortest: int = 0, longest: int = -1) -> DataFrame:
    """(chrom, pos, strand) of transcript starts and ends, codons and splice sites; exons may be gated by length."""
    feature, plus_end = ANCHORS[kind]
    rows = gtf.filter(F.col("feature") == feature)
    if feature == "exon":
        size = F.col("end") - F.col("start")
        rows = rows.filter((size >= shortest) & ((size <= longest) if longest > 0 else F.lit(True)))
    rows = members(members(rows, transcripts, "transcript_id"), genes, "gene_id")
    return rows.select("chrom", anchor(F.col("start"), F.col("end"), F.col("strand"), plus_end).alias("pos"), "strand")


def gene_bodies(gtf: DataFrame, transcripts: DataFrame | None = None, genes: DataFrame | None = None) -> DataFrame:
    rows = members(members(gtf.filter("feature = 'transcript'"), transcripts, "transcript_id"), genes, "gene_id")
    return rows.select("chrom", "start", "end", "gene_id", "strand")


def transcript_table(gtf: DataFrame, transcripts: DataFrame) -> DataFrame:
    rows = members(gtf.filter("feature = 'transcript'"), transcripts, "transcript_id")
    return rows.select("chrom", "start", "end", "transcript_id", "strand", F.col("source").alias("biotype"), "gene_id", "gene_name")


def motif_hits(hits: DataFrame, motifs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (chrom, start, end, pwm, strand) with their motif's cluster and oriented offset, and the hits of
    unknown motifs. motifs: (pwm, cluster, motif_strand, offset)."""
    from tidemark.functions.intervals import motif_offset

    known = hits.join(motifs, "pwm")
    offset = motif_offset(F.col("start"), F.col("end"), F.col("offset"), F.col("motif_strand"), F.col("strand"))
    return known.select("cluster", "chrom", "start", "end", "strand", offset.alias("offset")), hits.join(motifs, "pwm", "left_anti")


def unify_motifs(known: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Overlapping hits of a cluster merged: (keys, start, end, n, strand, offset), strand and offset of the first."""
    from tidemark.operators.segment import merge_intervals

    return merge_intervals(known, keys or ["cluster", "chrom"], first=["strand", "offset"], tie=["strand", "offset"])

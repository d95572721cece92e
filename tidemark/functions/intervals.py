"""Scalar functions on sites, intervals and annotation. Positions are 1-based and closed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_mid(start: Column, end: Column) -> Column:
    """Middle of an interval, rounded down."""
    return start + F.floor((end - start) / 2).cast("long")


def peak_mid(start: Column, end: Column) -> Column:
    """Middle of a peak, halves rounded up."""
    return start + F.round((end - start) * F.lit(0.5)).cast("long")


def anchor(start: Column, end: Column, strand: Column, plus_end: bool = False) -> Column:
    """Oriented end of a feature: on + its start (its end if plus_end), on - the other one."""
    plus = strand == "+"
    return F.when(plus, end if plus_end else start).otherwise(start if plus_end else end)


def upstream(start: Column, end: Column, strand: Column, size: int = 10_000) -> Column:
    return F.when(strand == "+", F.struct((start - size).alias("lo"), start.alias("hi"))).otherwise(F.struct(end.alias("lo"), (end + size).alias("hi")))


def downstream(start: Column, end: Column, strand: Column, size: int = 10_000) -> Column:
    return F.when(strand == "+", F.struct(end.alias("lo"), (end + size).alias("hi"))).otherwise(F.struct((start - size).alias("lo"), start.alias("hi")))


def body(start: Column, end: Column, strand: Column, size: int = 10_000) -> Column:
    """The first ``size`` bases of a gene from one base before its start."""
    return F.when(strand == "+", F.struct((start - 1).alias("lo"), (start - 1 + size).alias("hi"))).otherwise(F.struct((end - 1 - size).alias("lo"), (end - 1).alias("hi")))


def strand_offset(offset: Column, strand: Column) -> Column:
    """Offset along the strand: mirrored on the minus strand."""
    return F.when(strand == "-", -offset).otherwise(offset)


def motif_offset(start: Column, end: Column, offset: Column, motif_strand: Column, strand: Column) -> Column:
    """Offset from the other end where the hit lies on the other strand than the motif."""
    return F.when(motif_strand != strand, end - start - offset).otherwise(offset)


def cluster_label(cluster: Column, number: Column) -> Column:
    """'c12-T-box' with number '12' -> 'T-box'."""
    return F.substring(cluster, F.length(number) + 3, F.length(cluster))


#: What the names of the published call sets end in.
CALL_SET_ENDINGS = (".hg19.hotspot.twopass.fdr0.05.merge.intervals.txt", "hotspot.twopass.fdr0.05.merge.intervals.txt")


def call_set_label(name: Column) -> Column:
    """The name of a call set without its ending and without dots."""
    for ending in (*CALL_SET_ENDINGS, "."):
        name = F.replace(name, F.lit(ending), F.lit(""))
    return name


def period_label(name: Column) -> Column:
    """A column name that is a number, without the first X that was put before it."""
    return F.regexp_replace(name, "^([^X]*)X", "$1")


def file_name(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("/"), F.lit("-")), F.lit("::"), F.lit("-"))


def per_coverage(signal: Column, median: Column, coverage: Column, scale: float = 100.0) -> Column:
    """Median-corrected signal in percent of coverage; 0 where there is none."""
    return F.when(coverage == 0, F.lit(0.0)).otherwise((signal - median) / coverage * scale)


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def log2_floor(value: Column, floor: float = 0.04) -> Column:
    """log2 with zero (and null) raised to the floor."""
    return F.log2(F.when(F.coalesce(value, F.lit(0.0)) == 0, F.lit(floor)).otherwise(value))


def log2_ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.log2(a / b))


def main_contig(chrom: Column, autosomes_only: bool = False) -> Column:
    """Whether a contig (without ``chr``) is one of 1..22, X and Y: no unplaced or decoy sequence, no mitochondrion."""
    return chrom.rlike(r"\A([1-9]|1[0-9]|2[0-2])\z" if autosomes_only else r"\A([1-9]|1[0-9]|2[0-2]|X|Y)\z")


def mappable(ncount: Column, mappability: Column, most_unknown: int = 1, least: float = 0.5) -> Column:
    """A bin with fewer than ``most_unknown`` unknown bases and a mappability of at least ``least``."""
    return (ncount < most_unknown) & (mappability >= least)


def merge_key(gene: Column) -> Column:
    """Gene names join in capitals."""
    return F.upper(gene)


def centred(offset: Column, width: int = 52) -> Column:
    """Offset from the centre of a footprint of ``width`` bases."""
    return offset - width // 2


def reflected_mid(start: Column, end: Column) -> Column:
    """start less half the length: the formula that one of the site lists is made with."""
    return start - (end - start) / 2

"""Scalar functions on alignments: flags, CIGAR, coordinates, lengths. Positions are 1-based and closed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the SAM format.
FLAGS = {"paired": 1, "proper": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32, "read1": 64, "read2": 128, "secondary": 256, "qcfail": 512, "duplicate": 1024, "supplementary": 2048}
CIGAR_OPS = "MIDNSHP=X"
COMPLEMENT = ("ACGTRYKMBVDHacgtrykmbvdh", "TGCAYRMKVBHDtgcayrmkvbhd")


def flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(FLAGS[name]) != 0


def parse_cigar(text: Column) -> Column:
    """'5S90M' -> array of struct(op int, len int); null for a missing CIGAR."""
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]+[MIDNSHP=X])"), 1)
    parsed = F.transform(parts, lambda p: F.struct(F.position(F.right(p, F.lit(1)), F.lit(CIGAR_OPS)).alias("at"), F.left(p, F.length(p) - 1).cast("int").alias("len")))
    shifted = F.transform(parsed, lambda p: F.struct((p["at"] - 1).cast("int").alias("op"), p["len"].alias("len")))
    return F.when(text.isNotNull() & (text != "*"), shifted)


def clipped(cigar: Column) -> Column:
    """Soft clip, hard clip or padding anywhere."""
    return F.exists(cigar, lambda c: c["op"].isin(4, 5, 6))


def reference_length(cigar: Column) -> Column:
    """Aligned length on the reference; padding and everything after it in op order counts, as in the tools this follows."""
    return F.aggregate(cigar, F.lit(0), lambda a, c: a + F.when(c["op"].isin(0, 2, 3) | (c["op"] >= 6), c["len"]).otherwise(0))


def query_length(cigar: Column) -> Column:
    return F.aggregate(cigar, F.lit(0), lambda a, c: a + F.when(c["op"].isin(0, 1, 4, 7, 8), c["len"]).otherwise(0))


def pair_start(pos: Column, mate_pos: Column) -> Column:
    """First base of a pair's fragment from 0-based positions."""
    return F.least(pos, mate_pos) + 1


def pair_end(start: Column, isize: Column) -> Column:
    return start + F.abs(isize) - 1


def outer_end(pos: Column, reverse: Column, length: Column) -> Column:
    """Outer 5' coordinate of a read."""
    return F.when(reverse, pos + length).otherwise(pos)


def clamp_length(isize: Column, longest: int = 1000) -> Column:
    """Insert size as a histogram length: absolute, at most ``longest``; 0 counts as longest."""
    return F.when(isize == 0, F.lit(longest)).otherwise(F.least(F.lit(longest), F.abs(isize)))


def counted_ends(start: Column, end: Column, name: Column, reverse: Column, query_len: Column, paired: Column, read_length: int = 76, merged: bool = False, trimmed: bool = False) -> Column:
    """Array of the fragment ends that count: both for pairs, merged reads and trimmed reads, else the 5' end."""
    whole = paired | F.lit(merged) | name.startswith("M_") | ((F.lit(trimmed) | name.startswith("T_")) & (query_len <= read_length - 10))
    return F.when(whole, F.array(start, end)).when(reverse, F.array(end)).otherwise(F.array(start))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, *COMPLEMENT))


def valid_bases(seq: Column) -> Column:
    """Only A, C, G and T (and not empty)."""
    return seq.rlike(r"\A[ACGT]+\z")


def chrom_name(name: Column) -> Column:
    """Plain contig name: a RefSeq accession's number, else the name without a leading 'chr'."""
    number = F.regexp_extract(name, r"NC_0*([0-9]+)", 1)
    return F.when(number != "", number).otherwise(F.regexp_replace(name, "^chr", ""))


def chrom_category(name: Column) -> Column:
    return F.when(name.rlike(r"\A[0-9]+\z"), F.lit("autosome")).otherwise(F.concat(F.lit("chr"), name))


def base_id(name: Column) -> Column:
    """Read id up to the first slash."""
    return F.substring_index(name, "/", 1)


def library(read_group: Column, known: Column) -> Column:
    return F.coalesce(known, read_group)


def complete(cigar: Column, qual: Column) -> Column:
    """An alignment with a CIGAR and qualities; others are left out everywhere."""
    return cigar.isNotNull() & qual.isNotNull()


def mate_valid(flags: Column, chrom: Column, mate_chrom: Column) -> Column:
    """Whether a pair is a fragment: its mate is mapped, on the same contig."""
    return ~flag(flags, "mate_unmapped") & F.coalesce(chrom == mate_chrom, F.lit(False))


def counts_once(flags: Column, mate_pos: Column, query_len: Column, region_start: int | None = None) -> Column:
    """Of a pair's two reads the one that stands for the fragment: the first, and, where only a region is read, also a
    second one whose mate lies left of it."""
    left = F.lit(False) if region_start is None else flag(flags, "read2") & (mate_pos + query_len < region_start)
    return flag(flags, "read1") | left


def wiggle(start: Column, length: Column, first: Column, second: Column, reach: int = 5) -> Column:
    """struct(s, e) of a fragment whose ends are moved by up to ``reach`` bases: the start by ``first``, the end, counted
    from the moved start, by ``second``; both are uniforms in [0, 1)."""
    step = lambda u: F.floor(u * (2 * reach + 1)).cast("long") - reach
    moved = start + step(first)
    return F.struct(moved.alias("s"), (moved + length - 1 + step(second)).alias("e"))


def library_group(read_group: Column, known: Column | None = None, umi: Column | None = None) -> Column:
    """What duplicates must share: the UMI if there is one, else the library, else the read group."""
    return F.coalesce(*[c for c in (umi, known) if c is not None], read_group)


def fragment_strand(flags: Column) -> Column:
    """Strand of a fragment: that of its first read, seen from either read of a pair."""
    of_first = F.when(flag(flags, "read2"), flag(flags, "mate_reverse")).otherwise(flag(flags, "reverse"))
    return F.when(of_first, F.lit("-")).otherwise(F.lit("+"))

"""Biased fragment simulation and sampling by fixed uniforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sequence import fetch

Uniform = Callable[[int], Column]


def hashed(*columns: str | Column, seed: int = 0) -> Uniform:
    """Uniforms in [0, 1) that depend on the columns, the seed and the draw's number only."""
    return lambda draw: F.pmod(F.xxhash64(*columns, F.lit(seed), F.lit(draw)), F.lit(1 << 40)) / float(1 << 40)


def sample(rows: DataFrame, share: float, uniform: Uniform) -> DataFrame:
    """Rows kept with probability ``share``, the same ones in every run."""
    return rows.filter(uniform(0) < share)


def corrections(correction: float, forward: int, reverse: int) -> tuple[float, float]:
    """Factors for the acceptance rates of the first and the second end."""
    ratio = 4**forward / 4**reverse
    return correction, 1.0 if ratio > correction > 1 else correction / ratio


def strands(before: Column, after: Column, longest: int) -> Column:
    """Array of the strands a fragment can start on, from the bases on either side: + only, - only, or both."""
    plus, minus = F.lit("+"), F.lit("-")
    return F.when((before < longest) & (after >= longest), F.array(plus)).when((before >= longest) & (after < longest), F.array(minus)).otherwise(F.array(plus, minus))


def trials(positions: DataFrame, per_position: int, strand_array: Column) -> DataFrame:
    """positions x strands x trials; the trials of a position are divided among its strands."""
    return positions.withColumn("_s", strand_array).withColumn("strand", F.explode("_s")).withColumn("trial", F.explode(F.expr(f"sequence(1, {per_position} div size(_s))"))).drop("_s")


def draw_length(rows: DataFrame, lengths: DataFrame, u: Column, out: str = "length") -> DataFrame:
    """rows plus a length drawn by its distribution (length, n): the first whose cumulative share reaches u.

    The distribution is one row: an array of a few hundred lengths."""
    total = lengths.agg(F.array_sort(F.collect_list(F.struct("length", "n"))).alias("_l"), F.sum("n").alias("_t"))
    step = F.aggregate("_l", F.struct(F.lit(0).cast("long").alias("c"), F.array().cast("array<struct<cdf:double,length:int>>").alias("d")), lambda a, x: F.struct((a["c"] + x["n"]).alias("c"), F.concat(a["d"], F.array(F.struct(((a["c"] + x["n"]) / F.lit(1.0)).alias("cdf"), x["length"].cast("int").alias("length")))).alias("d")))
    cdf = total.select(F.transform(step["d"], lambda x: F.struct((x["cdf"] / F.col("_t")).alias("cdf"), x["length"].alias("length"))).alias("_cdf"))
    joined = rows.withColumn("_u", u).crossJoin(F.broadcast(cdf))
    return joined.withColumn(out, F.filter("_cdf", lambda x: x["cdf"] >= F.col("_u"))[0]["length"]).drop("_cdf", "_u")


def accepted(rows: DataFrame, rates: DataFrame, kmer: str, u: Column, factor: float) -> DataFrame:
    """Rows whose k-mer passes: u <= rate * factor. rates: (kmer, rate), a row a k-mer, so it can be broadcast."""
    known = rates.select(F.col("kmer").alias("_kmer"), "rate")
    return rows.withColumn("_u", u).join(F.broadcast(known), F.col(kmer) == F.col("_kmer")).filter(F.col("_u") <= F.col("rate") * factor).drop("_u", "_kmer", "rate")


def fragments(positions: DataFrame, chunks: DataFrame, lengths: DataFrame, starts: DataFrame, stops: DataFrame, uniform: Uniform, per_position: int, strand_array: Column, correction: float = 1.0, left: int = 8, right: int = 5, chunk: int = 256) -> DataFrame:
    """(chrom, pos, strand, trial, length): per position, strand and trial, a fragment if its start k-mer passes
    (draw 0), with a length drawn by ``lengths`` (draw 1), if the k-mer at its other end passes too (draw 2).

    chunks: (chrom, chunk_no, chunk_start, seq) of the genome, overlapping by max(left, right) bases at least.
    starts, stops: (strand, kmer, rate) for the first ``left`` and the last ``right`` bases, strand being the
    fragment's; k-mers as the plus strand reads. A k-mer without a rate, or beyond the contig, never passes."""
    forward, reverse = corrections(correction, left, right)
    plus, pos, length = F.col("strand") == "+", F.col("pos"), F.col("length")

    def at(rows, low, k, out):
        return fetch(rows.withColumn("_lo", low).withColumn("_hi", F.col("_lo") + k - 1), chunks, "chrom", "_lo", "_hi", chunk, out).drop("_lo", "_hi")

    def gate(rows, rates, kmer, draw, factor):
        keyed = rows.withColumn("_key", F.concat("strand", kmer))
        return accepted(keyed, rates.select(F.concat("strand", "kmer").alias("kmer"), "rate"), "_key", uniform(draw), factor)

    both = at(at(positions, pos, left, "_plus"), pos - left + 1, left, "_minus")
    begun = gate(trials(both, per_position, strand_array), starts, F.when(plus, F.col("_plus")).otherwise(F.col("_minus")), 0, forward)
    drawn = draw_length(begun.select("chrom", "pos", "strand", "trial"), lengths, uniform(1))
    ended = at(drawn, F.when(plus, pos + length - right).otherwise(pos - length + 1), right, "_end")
    return gate(ended, stops, F.col("_end"), 2, reverse).select("chrom", "pos", "strand", "trial", "length")


def emit(rows: DataFrame, pos: str, length: str, strand: str, read_length: int = 45) -> DataFrame:
    """Alignments of fragments: one merged read up to ``read_length``, else two mates. Columns of rows plus flag,
    start, read_len, mate_start, isize, name."""
    s = F.when(F.col(strand) == "+", F.col(pos)).otherwise(F.col(pos) - F.col(length) + 1)
    plus = F.col(strand) == "+"
    single = F.array(F.struct(F.when(plus, 0).otherwise(16).alias("flag"), s.cast("long").alias("start"), F.col(length).cast("int").alias("read_len"), F.lit(None).cast("long").alias("mate_start"), F.lit(0).cast("long").alias("isize"), F.lit("M_SIM").alias("name")))
    right = (s + F.col(length) - read_length).cast("long")
    first = F.struct(F.when(plus, 99).otherwise(163).alias("flag"), s.cast("long").alias("start"), F.lit(read_length).alias("read_len"), right.alias("mate_start"), F.col(length).cast("long").alias("isize"), F.lit("SIM").alias("name"))
    second = F.struct(F.when(plus, 147).otherwise(83).alias("flag"), right.alias("start"), F.lit(read_length).alias("read_len"), s.cast("long").alias("mate_start"), (-F.col(length)).cast("long").alias("isize"), F.lit("SIM").alias("name"))
    both = F.when(F.col(length) > read_length, F.array(first, second)).otherwise(single)
    return rows.withColumn("_a", F.explode(both)).select(*rows.columns, "_a.*")

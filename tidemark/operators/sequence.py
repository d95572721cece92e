"""Sequence operators: k-mers, end k-mers, composition around ends, acceptance rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kmers(seq: Column, k: int) -> Column:
    """Array of all k-letter windows of A, C, G and T, overlapping, in order."""
    return F.regexp_extract_all(F.upper(seq), F.lit(f"(?=([ACGT]{{{k}}}))"), 1)


def kmer_counts(rows: DataFrame, seq: str, k: int = 8, keys: list[str] | None = None) -> DataFrame:
    """(keys, kmer, n) over all rows' sequences."""
    keys = keys or []
    return rows.select(*keys, F.explode(kmers(F.col(seq), k)).alias("kmer")).groupBy(*keys, "kmer").agg(F.count("*").alias("n"))


def chunk_sequence(rows: DataFrame, keys: list[str], seq: str, chunk: int = 1 << 16, overlap: int = 0) -> DataFrame:
    """Long sequences as rows (keys, chunk_no, chunk_start (1-based), seq) that overlap by ``overlap`` bases."""
    at = F.sequence(F.lit(0), F.greatest(F.length(seq) - 1, F.lit(0)), F.lit(chunk))
    cut = rows.select(*keys, seq, F.posexplode(at).alias("chunk_no", "_at"))
    return cut.select(*keys, "chunk_no", (F.col("_at") + 1).cast("long").alias("chunk_start"), F.substring(F.col(seq), F.col("_at") + 1, F.lit(chunk + overlap)).alias("seq"))


def fetch(points: DataFrame, chunks: DataFrame, chrom: str, lo: str, hi: str, chunk: int, out: str = "context") -> DataFrame:
    """points plus the bases lo..hi of their contig, from chunks that overlap by at least the longest fetch; null
    beyond the sequence."""
    wanted = points.withColumn("_no", F.floor((F.col(lo) - 1) / chunk).cast("int"))
    source = chunks.select(F.col(chrom).alias("_c"), F.col("chunk_no").alias("_n"), F.col("chunk_start").alias("_s"), F.col("seq").alias("_q"))
    joined = wanted.join(source, (F.col(chrom) == F.col("_c")) & (F.col("_no") == F.col("_n")), "left")
    size = (F.col(hi) - F.col(lo) + 1).cast("int")
    got = F.substring(F.col("_q"), (F.col(lo) - F.col("_s") + 1).cast("int"), size)
    return joined.withColumn(out, F.when((F.col(lo) >= 1) & (F.length(got) == size), got)).drop("_no", "_c", "_n", "_s", "_q")


def context(points: DataFrame, chunks: DataFrame, chrom: str, pos: str, reach: int, chunk: int, out: str = "context") -> DataFrame:
    """points plus the 2 * reach + 1 bases around them; null where the contig ends before that."""
    around = points.withColumns({"_lo": F.col(pos) - reach, "_hi": F.col(pos) + reach})
    return fetch(around, chunks, chrom, "_lo", "_hi", chunk, out).drop("_lo", "_hi")


def end_kmers(reads: DataFrame, seq: str, strand: Column, left: int = 8, right: int = 5) -> DataFrame:
    """(side, strand, kmer, n): first ``left`` and last ``right`` bases of sequences that have both."""
    long_enough = reads.filter(F.length(seq) >= max(left, right)).withColumn("_strand", strand)
    both = F.array(F.struct(F.lit("left").alias("side"), F.left(F.col(seq), F.lit(left)).alias("kmer")), F.struct(F.lit("right").alias("side"), F.right(F.col(seq), F.lit(right)).alias("kmer")))
    rows = long_enough.select(F.col("_strand").alias("strand"), F.explode(both).alias("x")).select("x.side", "strand", "x.kmer")
    return rows.filter(F.col("kmer").rlike(r"\A[ACGT]+\z")).groupBy("side", "strand", "kmer").agg(F.count("*").alias("n"))


def composition(rows: DataFrame, kind: str, context: str, flank: int = 20, width: int = 1) -> DataFrame:
    """(kind, base, offset, n, share) of base (or ``width``-mer) frequencies at the offsets of a context string:
    -flank..-1 and 1..flank. The grid is full: bases that never occur have zeros."""
    letters = [a for a in "ACGT"] if width == 1 else [a + b for a in "ACGT" for b in "ACGT"]
    sites = F.transform(F.sequence(F.lit(1), F.length(context) - width + 1), lambda i: F.struct(i.alias("i"), F.substring(F.col(context), i, F.lit(width)).alias("base")))
    offset = F.when(F.col("x.i") <= flank, F.col("x.i") - flank - 1).otherwise(F.col("x.i") - flank)
    seen = rows.select(kind, F.explode(sites).alias("x")).select(kind, F.upper("x.base").alias("base"), offset.alias("offset"))
    counts = seen.filter(F.col("base").isin(letters)).groupBy(kind, "base", "offset").agg(F.count("*").alias("n"))
    grid = counts.select(kind, "offset").distinct().withColumn("base", F.explode(F.array(*[F.lit(x) for x in letters])))
    full = grid.join(counts, [kind, "base", "offset"], "left").fillna(0, ["n"])
    return full.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(kind, "offset")))


def weak_strong(shares: DataFrame, keys: list[str], base: str = "base", n: str = "n") -> DataFrame:
    """(keys, at, gc): counts of dinucleotides of A and T only, and of G and C only."""
    return shares.groupBy(*keys).agg(F.sum(F.when(F.col(base).isin("AA", "AT", "TA", "TT"), F.col(n)).otherwise(0)).alias("at"), F.sum(F.when(F.col(base).isin("CC", "CG", "GC", "GG"), F.col(n)).otherwise(0)).alias("gc"))


def acceptance(observed: DataFrame, genome: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, kmer, rate): how much more often a k-mer is observed than the genome offers it, scaled to at most 1.
    observed and genome: (keys, kmer, n). K-mers the genome lacks have no rate."""
    keys = keys or []
    per = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    both = observed.select(*keys, "kmer", F.col("n").alias("o")).join(genome.select("kmer", F.col("n").alias("g")), "kmer").filter("g > 0")
    odds = both.withColumn("_odds", (F.col("o") / F.max("o").over(per)) / (F.col("g") / F.max("g").over(per)))
    return odds.select(*keys, "kmer", (F.col("_odds") / F.max("_odds").over(per)).alias("rate"))


def base_fractions(rows: DataFrame, seq: str) -> DataFrame:
    """rows plus counts and shares of bases in either case: acount, ccount, gcount, tcount, ncount, othercount,
    seqlen, atperc, gcperc."""
    upper = F.translate(seq, "acgtn", "ACGTN")
    count = lambda b: (F.length(upper) - F.length(F.replace(upper, F.lit(b), F.lit("")))).cast("long")
    out = rows.withColumns({f"{b.lower()}count": count(b) for b in "ACGTN"}).withColumn("seqlen", F.length(upper).cast("long"))
    known = F.col("acount") + F.col("ccount") + F.col("gcount") + F.col("tcount") + F.col("ncount")
    return out.withColumns({"othercount": F.col("seqlen") - known, "atperc": F.try_divide(F.col("acount") + F.col("tcount"), F.col("seqlen")), "gcperc": F.try_divide(F.col("gcount") + F.col("ccount"), F.col("seqlen"))})

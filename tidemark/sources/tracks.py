"""Per-position tracks as sorted Parquet files, read by region.

``write_track`` deals positions to files by range and sorts them, in row groups of about ``group_rows`` positions, so the
statistics of a row group are a short stretch of one contig. ``touching`` reads the row groups that regions touch: the
regions are covered by at most ``most`` stretches of positions, coarser ones where regions are many, and that cover is the
filter which reaches the scan. So the filter has a bound whatever the regions, and an exact join does the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FINEST, LEVELS = 6, range(0, 25, 2)  # cells of 64 positions, and how often they may be doubled


def write_track(track: DataFrame, path: str, chrom: str = "chrom", pos: str = "pos", group_rows: int = 100_000, mode: str = "errorifexists") -> None:
    """Writes rows in order of contig and position; a row group takes about 16 bytes a position and value."""
    size = 16 * len(track.columns) * group_rows
    ordered = track.repartitionByRange(chrom, pos).sortWithinPartitions(chrom, pos)
    ordered.write.mode(mode).option("parquet.block.size", size).option("parquet.block.row.count.limit", group_rows).parquet(path)


def cover(regions: DataFrame, chrom: str = "chrom", lo: str = "lo", hi: str = "hi", most: int = 1000) -> list[tuple]:
    """(contig, first, last) of at most ``most`` disjoint stretches that hold all regions; contigs alone may be more."""
    cells = regions.select(F.col(chrom).alias("c"), F.explode(F.sequence(F.shiftright(lo, FINEST), F.shiftright(hi, FINEST))).alias("k")).filter("c IS NOT NULL").distinct()
    counts = cells.agg(*[F.count_distinct("c", F.shiftright("k", level)).alias(str(level)) for level in LEVELS]).first()
    level = next((k for k in LEVELS if counts[str(k)] <= most), LEVELS[-1])
    coarse = cells.select("c", F.shiftright("k", level).alias("k")).distinct().orderBy("c", "k").collect()
    out: list[tuple] = []
    for c, k in coarse:
        first, last = k << FINEST + level, (k + 1 << FINEST + level) - 1
        if out and out[-1][0] == c and out[-1][2] == first - 1:
            out[-1] = (c, out[-1][1], last)
        else:
            out.append((c, first, last))
    return out


def inside(stretches: list[tuple], chrom: str = "chrom", pos: str = "pos") -> Column:
    """Condition that a position lies in one of the stretches, put together so that its depth stays small."""
    parts = [(F.col(chrom) == c) & F.col(pos).between(a, b) for c, a, b in stretches]
    while len(parts) > 1:
        parts = [reduce(Column.__or__, parts[k : k + 2]) for k in range(0, len(parts), 2)]
    return parts[0] if parts else F.lit(False)


def touching(spark: SparkSession, path: str, regions: DataFrame, chrom: str = "chrom", pos: str = "pos", lo: str = "lo", hi: str = "hi", most: int = 1000) -> DataFrame:
    """The rows of a written track in a cover of regions (chrom, lo, hi), all rows inside the regions among them."""
    return spark.read.parquet(path).filter(inside(cover(regions, chrom, lo, hi, most), chrom, pos))

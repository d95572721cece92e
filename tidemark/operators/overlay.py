"""Signals around sites: alignment, summing, leave-one-out, normalising, subtracting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.intervals import strand_offset

SHEET = 100_000


def site_bin(site: Column, bins: int = 10) -> Column:
    """A fixed bin of a site, from its id."""
    return F.pmod(site, F.lit(bins)).cast("int")


def around(sites: DataFrame, tracked: DataFrame, value: str, half: int, last: int | None = None, complete: bool = True, tile: int | None = None) -> DataFrame:
    """(site columns, offset, value) for the positions c - half + 1 ... c + half of each site (site, chrom, c,
    strand); on the minus strand offsets run the other way. ``last`` moves the window's end (half - 1 with
    ``half`` before gives the window of the other convention). Incomplete windows are dropped.

    Sites meet the track by tile: a site's row goes to the few tiles its window touches instead of one row per
    position. Tiles have the window's size, so a window touches two of them and meets at most twice its own rows."""
    lo, hi = (F.col("c") - half + 1, F.col("c") + half) if last is None else (F.col("c") - half, F.col("c") + last)
    width = 2 * half if last is None else half + last + 1
    tile = tile or max(64, width)
    wanted = sites.withColumns({"_lo": lo, "_hi": hi}).withColumn("_tile", F.explode(F.sequence(F.floor(F.col("_lo") / tile), F.floor(F.col("_hi") / tile))))
    source = tracked.select(F.col("chrom").alias("_chrom"), F.col("pos").alias("_pos"), F.col(value), F.floor(F.col("pos") / tile).alias("_t"))
    rows = wanted.join(source, (F.col("chrom") == F.col("_chrom")) & (F.col("_tile") == F.col("_t")) & F.col("_pos").between(F.col("_lo"), F.col("_hi")))
    shifted = F.when(F.col("strand") == "-", F.col("_hi") - F.col("_pos")).otherwise(F.col("_pos") - F.col("_lo"))
    out = rows.select(*sites.columns, (shifted - width // 2 + 1).cast("long").alias("offset"), value)
    if complete:
        full = out.groupBy("site").agg(F.count("*").alias("_n")).filter(F.col("_n") == width).select("site")
        out = out.join(full, "site", "left_semi")
    return out


def aggregate(aligned: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(name, bin, offset, total): elementwise sums of the windows of each name's bins."""
    return aligned.groupBy("name", site_bin(F.col("site"), bins).alias("bin"), "offset").agg(F.sum(value).alias("total"))


def profile(sites: DataFrame, tracked: DataFrame, value: str, half: int, bins: int = 10) -> DataFrame:
    """``aggregate`` of the windows ``around`` sites (site, name, chrom, c, strand; site is unique). Sites of one name and bin
    at the same place and strand have the same window: it meets the track once and counts as often as there are of them."""
    places = sites.groupBy("name", site_bin(F.col("site"), bins).alias("bin"), "chrom", "c", "strand").agg(F.min("site").alias("site"), F.count("*").alias("_sites"))
    rows = around(places, tracked, value, half)
    return rows.groupBy("name", "bin", "offset").agg(F.sum(F.col(value) * F.col("_sites")).alias("total"))


def leave_one_out(profile: DataFrame) -> DataFrame:
    """profile plus ``rest``: the sum over the other bins of the same name and offset."""
    return profile.withColumn("rest", F.sum("total").over(Window.partitionBy("name", "offset")) - F.col("total"))


def normalise(profile: DataFrame, value: str, keys: list[str], flank: int | None = None, half: int | None = None, subtract: bool = False, out: str = "norm") -> DataFrame:
    """value divided by (or less) the absolute mean of its series, or of the rows at least ``half - flank`` from
    the centre on either side."""
    part = Window.partitionBy(*keys)
    chosen = F.col(value) if flank is None else F.when((F.col("offset") <= -(half - flank)) | (F.col("offset") >= half - flank), F.col(value))
    mean = F.avg(chosen).over(part)
    return profile.withColumn(out, F.col(value) - mean if subtract else F.col(value) / F.abs(mean))


def subtract(data: DataFrame, control: DataFrame, keys: list[str], value: str, out: str = "difference") -> DataFrame:
    right = control.select(*keys, F.col(value).alias("_control"))
    return data.join(right, keys).withColumn(out, F.col(value) - F.col("_control")).drop("_control")


def wide(profile: DataFrame, keys: list[str], column: str, value: str, names: list | None = None) -> DataFrame:
    """Long to wide; give the column names where they are known to save a pass."""
    return profile.groupBy(*keys).pivot(column, names).agg(F.first(value))


def long(rows: DataFrame, ids: list[str], columns: list[str], key: str, value: str) -> DataFrame:
    return rows.unpivot(ids, columns, key, value)


def spacing_class(spacing: Column) -> Column:
    """Class of the distance between the neighbours on both sides of a site (bounds are fixed values)."""
    edges = (160, 200, 230, 270, 420, 460)
    label = F.when(spacing > edges[-1], F.lit(f">{edges[-1]}"))
    for lo, hi in zip(edges, edges[1:], strict=False):
        label = label.when((spacing > lo) & (spacing <= hi), F.lit(f"{lo + 1}-{hi}"))
    return label.when(spacing <= edges[0], F.lit(f"<={edges[0]}"))


def demultiplex(rows: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """One row for each category of the row's key (mapping: key, category); keys without one are dropped.

    Keys are few and hot, so rows stay where they are and a mapping of up to SHEET rows goes to them; a longer one is
    joined as Catalyst finds best."""
    return rows.join(F.broadcast(mapping) if mapping.limit(SHEET + 1).count() <= SHEET else mapping, key)


def aligned_offset(offset: Column, strand: Column) -> Column:
    return strand_offset(offset, strand)

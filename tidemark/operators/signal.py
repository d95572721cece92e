"""Fragments to per-position signals: coverage, fragment ends, windowed protection score.

A fragment changes coverage and score at a few positions only. These changes are summed per position and run
through a prefix sum; no fragment is joined with positions. A score window of 2p+1 positions around x counts +1 for
a fragment that covers it and -1 for one that ends inside it, so the score steps by -1 at s-p+1, +1 at e+p, and for
fragments of at least 2p+1 bases +2 at s+p and -2 at e-p+1.

Prefix sums run per tile of positions, with each tile's start taken from the sums of the tiles before it, so one
long contig is many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 1 << 16


def _change(pos: Column, cov=0, ends=0, wps=0) -> Column:
    as_long = lambda x: x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long")
    return F.struct(pos.cast("long").alias("pos"), as_long(cov).alias("cov"), as_long(ends).alias("ends"), as_long(wps).alias("wps"))


def changes(fragments: DataFrame, protection: int = 120, ends: Column | None = None) -> DataFrame:
    """(chrom, pos, cov, ends, wps): changes of coverage and score, and fragment ends, per position.

    fragments: chrom, s, e; those without one of them give no signal. ends: array of the ends of a row that count
    (default both)."""
    p, fragments = protection // 2, fragments.dropna(subset=["chrom", "s", "e"])
    s, e = F.col("s"), F.col("e")
    both = 1 if ends is None else 0
    steps = [_change(s, cov=1, ends=both), _change(e + 1, cov=-1), _change(s - p + 1, wps=-1), _change(e + p, wps=1)] + ([_change(e, ends=1)] if ends is None else [])
    inner = F.when(e - s >= 2 * p, F.array(_change(s + p, wps=2), _change(e - p + 1, wps=-2))).otherwise(F.array().cast("array<struct<pos:bigint,cov:bigint,ends:bigint,wps:bigint>>"))
    marks = [] if ends is None else [F.transform(ends, lambda x: _change(x, ends=1))]
    rows = fragments.select("chrom", F.explode(F.concat(F.array(*steps), inner, *marks)).alias("c")).select("chrom", "c.*")
    return rows.groupBy("chrom", "pos").agg(*[F.sum(c).alias(c) for c in ("cov", "ends", "wps")])


def steps(summed: DataFrame, tile: int = TILE, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """(chrom, pos, until, cov, ends, wps): runs of positions with constant values; ``ends`` counts at pos only. With lo and
    hi, runs of zeros reach from lo to a contig's first change and from its last one to hi.

    Changes, one row a position by now, are dealt by tile once, for the tiles' sums and for the running sums in them."""
    rows = summed.withColumn("tile", F.floor(F.col("pos") / tile).cast("long")).repartition("chrom", "tile")
    contig = Window.partitionBy("chrom").orderBy("tile")
    earlier = contig.rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy("chrom", "tile").agg(F.sum("cov").alias("cov"), F.sum("wps").alias("wps"), F.sum("ends").alias("ends"), F.min("pos").alias("first"))
    carry = per.select(
        "chrom", "tile", F.coalesce(F.sum("cov").over(earlier), F.lit(0)).alias("ccov"), F.coalesce(F.sum("wps").over(earlier), F.lit(0)).alias("cwps"),
        F.lead("first").over(contig).alias("next"), F.when(F.lag("tile").over(contig).isNull(), F.col("first")).alias("begin"),
    )
    order = Window.partitionBy("chrom", "tile").orderBy("pos")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    until = F.coalesce(F.lead("pos").over(order) - 1, F.col("next") - 1, F.lit(hi).cast("long"))
    zero = F.lit(0).cast("long")
    out = rows.join(carry, ["chrom", "tile"]).select("chrom", "pos", until.alias("until"), (F.col("ccov") + F.sum("cov").over(running)).alias("cov"), "ends", (F.col("cwps") + F.sum("wps").over(running)).alias("wps"))
    if lo is not None:
        before = carry.filter(F.col("begin") > lo).select("chrom", F.lit(lo).cast("long").alias("pos"), (F.col("begin") - 1).alias("until"), zero.alias("cov"), zero.alias("ends"), zero.alias("wps"))
        out = out.unionByName(before)
    return out.filter("until IS NOT NULL")


def dense(stepped: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """(chrom, pos, cov, ends, wps) for every position of the runs, within [lo, hi]."""
    first = F.greatest(F.col("pos"), F.lit(lo)) if lo is not None else F.col("pos")
    last = F.least(F.col("until"), F.lit(hi)) if hi is not None else F.col("until")
    cut = stepped.withColumns({"_a": first, "_b": last}).filter("_a <= _b")
    rows = cut.select("chrom", F.explode(F.sequence("_a", "_b")).alias("x"), "pos", "cov", "ends", "wps")
    return rows.select("chrom", F.col("x").alias("pos"), "cov", F.when(F.col("x") == F.col("pos"), F.col("ends")).otherwise(F.lit(0)).alias("ends"), "wps")


def track(fragments: DataFrame, protection: int = 120, lo: int | None = None, hi: int | None = None, ends: Column | None = None, tile: int = TILE) -> DataFrame:
    """Coverage, ends and score at every position from the first to the last change, within [lo, hi]."""
    return dense(steps(changes(fragments, protection, ends), tile), lo, hi)


def full_track(fragments: DataFrame, lo: int, hi: int, protection: int = 120, tile: int = TILE) -> DataFrame:
    """track with zeros to both ends of [lo, hi], for every contig that has a fragment."""
    return dense(steps(changes(fragments, protection), tile, lo, hi), lo, hi)


def score_literal(fragments: DataFrame, positions: DataFrame, protection: int = 120, bin_size: int = 1024) -> DataFrame:
    """The score by definition: each position against the fragments near it, by a binned equi-join. Equal fragments meet it once,
    with their number. For checks."""
    from tidemark.operators.joins import range_join

    p = protection // 2
    windows = positions.select("chrom", "pos", (F.col("pos") - p).alias("lo"), (F.col("pos") + p).alias("hi"))
    some = fragments.groupBy("chrom", "s", "e").agg(F.count("*").alias("_same"))
    near = range_join(windows, some, "chrom", ("lo", "hi"), ("s", "e"), bin_size, strict=True)
    value = F.when((F.col("s") > F.col("lo")) | (F.col("e") < F.col("hi")), -1).otherwise(1)
    found = near.groupBy("chrom", "pos").agg(F.sum(value * F.col("_same")).alias("wps"))
    return positions.select("chrom", "pos").join(found, ["chrom", "pos"], "left").select("chrom", "pos", F.coalesce("wps", F.lit(0)).alias("wps"))


def region_track(tracked: DataFrame, regions: DataFrame, drop_empty: bool = True, tile: int = 1 << 10) -> DataFrame:
    """(cid, rank, chrom, pos, cov, ends, wps): the track of each region (cid, chrom, lo, hi, strand), positions
    without signal as zeros, ranked from the 5' end; regions without coverage are dropped. A cid is one region.

    A rank follows from the region's ends; positions of regions are neither dealt nor sorted."""
    zero = F.lit(0).cast("long")
    rows = _cut(tracked, regions, tile)
    if drop_empty:
        some = rows.select("cid", F.aggregate("_inside", zero, lambda a, c: a + c["cov"]).alias("_sum"))
        rows = rows.join(some.groupBy("cid").agg(F.sum("_sum").alias("_sum")).filter("_sum > 0").select("cid"), "cid", "left_semi")
    rows = rows.select("cid", "strand", "chrom", "lo", "hi", F.inline("_inside"))
    rank = F.when(F.col("strand") == "-", F.col("hi") - F.col("pos")).otherwise(F.col("pos") - F.col("lo")) + 1
    return rows.select("cid", rank.cast("int").alias("rank"), "chrom", "pos", *_CELL)


def region_pieces(tracked: DataFrame, regions: DataFrame, tile: int = 1 << 10) -> DataFrame:
    """(cid, at, cov, ends, wps): each region's part of a tile as arrays, positions without signal as zeros; ``at`` is the rank of
    the first value, and both count from the 5' end. Regions without coverage stay; those without a cid are left out."""
    back = F.col("strand") == "-"
    at = F.when(back, F.col("hi") - F.col("_last")).otherwise(F.col("_first") - F.col("lo")) + 1
    turned = F.when(back, F.reverse("_inside")).otherwise(F.col("_inside"))
    rows = _cut(tracked, regions.dropna(subset=["cid"]), tile).select("cid", at.cast("long").alias("at"), turned.alias("_inside"))
    return rows.select("cid", "at", *[F.col(f"_inside.{c}").alias(c) for c in _CELL])


_CELL = ["cov", "ends", "wps"]


def _cut(tracked: DataFrame, regions: DataFrame, tile: int) -> DataFrame:
    """(cid, strand, chrom, lo, hi, _first, _last, _inside): the cells of each region in each of its tiles.

    The track is packed by tiles of positions, zeros filled in, so a region is joined by its tiles and cuts its cells out of
    them."""
    names, zero = _CELL, F.lit(0).cast("long")
    cells = tracked.select(F.col("chrom").alias("_chrom"), "pos", *names).withColumn("_tile", F.floor(F.col("pos") / tile).cast("long"))
    gaps = cells.select("_chrom", "_tile").distinct().select("_chrom", F.explode(F.sequence(F.col("_tile") * tile, F.col("_tile") * tile + tile - 1)).alias("pos"), *[zero.alias(c) for c in names], "_tile")
    filled = cells.unionByName(gaps).groupBy("_chrom", "_tile", "pos").agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in names])
    packed = filled.groupBy("_chrom", "_tile").agg(F.array_sort(F.collect_list(F.struct("pos", *names))).alias("_cells"))
    wanted = regions.filter("lo <= hi").select("cid", "strand", "chrom", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / tile).cast("long"), F.floor(F.col("hi") / tile).cast("long"))).alias("_own"))
    start = F.col("_own") * tile
    wanted = wanted.withColumns({"_first": F.greatest(F.col("lo").cast("long"), start), "_last": F.least(F.col("hi").cast("long"), start + tile - 1)})
    rows = wanted.join(packed, (F.col("chrom") == F.col("_chrom")) & (F.col("_own") == F.col("_tile")), "left")
    none = F.transform(F.sequence("_first", "_last"), lambda p: F.struct(p.alias("pos"), *[zero.alias(c) for c in names]))
    inside = F.slice("_cells", (F.col("_first") - start + 1).cast("int"), (F.col("_last") - F.col("_first") + 1).cast("int"))
    return rows.select("cid", "strand", "chrom", "lo", "hi", "_first", "_last", F.coalesce(inside, none).alias("_inside"))

"""Aggregations: histograms, percentiles, quantile bins, spacing, correlation, regression, top-k."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import null_safe
from tidemark.operators.segment import bin_grid
from tidemark.storage import stored


def length_histogram(rows: DataFrame, keys: list[str], length: str, weight: Column | None = None) -> DataFrame:
    """(keys, length, reads, weighted): reads per length, and reads weighted by their duplicate count."""
    w = F.coalesce(weight, F.lit(1)) if weight is not None else F.lit(1)
    return rows.groupBy(*keys, length).agg(F.count("*").alias("reads"), F.sum(w).cast("long").alias("weighted"))


def fill_range(counts: DataFrame, keys: list[str], value: str, measures: list[str]) -> DataFrame:
    """counts with a zero row for each missing value between a key's smallest and largest."""
    spans = counts.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    grid = spans.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(value))
    return grid.join(counts, [*keys, value], "left").fillna(0, measures)


def between(lo: Column, hi: Column, share: Column) -> Column:
    """lo * (1 - share) + hi * share, the first product added to the second before it is rounded, as a fused multiply-add does:
    of equal neighbours it gives their value, where two rounded products may miss it by a digit. The part that rounding cuts
    off the product is found from halves of its factors; where these leave the range of doubles, both products are rounded."""
    rest, other = 1 - share, hi * share
    halves = lambda x: (x * 134217729.0 - (x * 134217729.0 - x), x - (x * 134217729.0 - (x * 134217729.0 - x)))
    (a, b), (c, d), product = halves(lo), halves(rest), lo * rest
    cut = b * d - (product - a * c - b * c - a * d)
    whole = product + other
    part = whole - product
    exact = whole + (((product - (whole - part)) + (other - part)) + cut)
    return F.when(F.abs(exact) < 1e290, exact).otherwise(whole)


def _mixed(x: Column) -> Column:
    return F.when(x["share"] == 0, x["lo"]).otherwise(between(x["lo"], x["hi"], x["share"]))


def quantiles(rows: DataFrame, value: str, points: list[float], slices: int = 64) -> DataFrame:
    """One row: ``q``, the exact interpolated quantiles of a column at ``points``.

    Equal values are counted first. Approximate quantiles (a fixed few numbers, collected) cut the values into slices,
    running counts inside each slice and over the slices give every value its ranks, and only the values at the two
    ranks beside each point go on. No task sorts the whole column. Nulls are left out; no values give nulls."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    cuts = counts.agg(F.percentile_approx("v", [k / slices for k in range(1, slices)], 1000).alias("c")).first()["c"] or []
    slice_of = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("v"))) if cuts else F.lit(0)
    counts = counts.withColumn("slice", slice_of)
    sizes = counts.groupBy("slice").agg(F.sum("n").alias("size")).orderBy("slice").collect()  # at most ``slices`` rows
    total = sum(r["size"] for r in sizes)
    spots = [p * (total - 1) for p in points] if total else []
    wanted = sorted({int(f(s)) for s in spots for f in (math.floor, math.ceil)})
    if not wanted:
        return rows.sparkSession.range(1).select(F.array(*[F.lit(None).cast("double")] * len(points)).alias("q"))
    before = dict(zip([r["slice"] for r in sizes], itertools.accumulate([0, *[r["size"] for r in sizes]]), strict=False))
    offset = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("slice")]
    upto = F.sum("n").over(Window.partitionBy("slice").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    last = counts.withColumn("last", offset + upto - 1)
    ranks = F.filter(F.array(*[F.lit(w).cast("long") for w in wanted]), lambda r: r.between(F.col("last") - F.col("n") + 1, F.col("last")))
    found = last.select(F.explode(ranks).alias("rank"), "v").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def point(spot: float) -> Column:
        lo, hi = F.col("at")[int(math.floor(spot))], F.col("at")[int(math.ceil(spot))]
        share = spot - math.floor(spot)
        return F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(float(share)).alias("share"))

    return found.select(F.transform(F.array(*map(point, spots)), _mixed).alias("q"))


def keyed_quantiles(rows: DataFrame, value: str, points: list[float], keys: list[str], out: str = "q") -> DataFrame:
    """(keys, out): the exact interpolated quantiles of each key's values at ``points``; null keys are a key.

    Counts of equal values are dealt by ranges of key and value, so a key of very many values is many tasks; a range hands on
    a row for each key in it. Of the values only those at the two ranks beside each point go on."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    counts = stored(counts.repartitionByRange(*keys, "_v").withColumn("_slice", F.spark_partition_id()), "counts")
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_size"))
    sizes = sizes.select(*keys, "_slice", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"), F.sum("_size").over(whole).alias("_total"))
    inside = Window.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = null_safe(counts, sizes, [*keys, "_slice"]).withColumn("_last", F.col("_before") + F.sum("_n").over(inside) - 1)
    at = F.array(*[F.lit(float(p)) for p in points])
    spot = lambda p: (F.col("_total") - 1) * p
    both = F.flatten(F.transform(at, lambda p, k: F.array(*[F.struct((2 * k + side).alias("k"), f(spot(p)).alias("rank")) for side, f in ((0, F.floor), (1, F.ceil))])))
    hit = F.filter(both, lambda e: e["rank"].between(F.col("_last") - F.col("_n") + 1, F.col("_last")))
    found = ranked.select(*keys, "_total", "_v", F.explode(hit).alias("e")).groupBy(*keys, "_total").agg(F.array_sort(F.collect_list(F.struct("e.k", "_v"))).alias("_at"))
    side = lambda k, of: F.get("_at", 2 * k + of)["_v"]
    beside = F.transform(at, lambda p, k: F.struct(side(k, 0).alias("lo"), side(k, 1).alias("hi"), (spot(p) - F.floor(spot(p))).alias("share")))
    return found.select(*keys, F.transform(beside, _mixed).alias(out))


def percentile_buckets(rows: DataFrame, score: str, keys: list[str] | None = None, out: str = "percentile") -> DataFrame:
    """rows plus the number of percentiles (1..99, interpolated) at or below the score: 0 to 99."""
    points = [k / 100.0 for k in range(1, 101)]
    joined = _with_quantiles(rows, score, points, keys, "_grid")
    below = F.size(F.filter("_grid", lambda p: p <= F.col(score)))
    return joined.withColumn(out, F.least(below, F.lit(99))).drop("_grid")


def _with_quantiles(rows: DataFrame, value: str, points: list[float], keys: list[str] | None, out: str) -> DataFrame:
    if keys:
        return null_safe(rows, keyed_quantiles(rows, value, points, keys, out), keys, "left")
    return rows.crossJoin(F.broadcast(quantiles(rows, value, points).withColumnRenamed("q", out)))  # one row of few numbers


def quantile_bins(rows: DataFrame, value: str, bins: int = 5, keys: list[str] | None = None, out: str = "bin") -> DataFrame:
    """rows plus their bin 1..bins by quantiles of value: bins are (q[i-1], q[i]], the first closed. Ties share a
    bin, so bins may differ in size."""
    joined = _with_quantiles(rows, value, [k / bins for k in range(1, bins)], keys, "_cuts")
    return joined.withColumn(out, F.size(F.filter("_cuts", lambda q: q < F.col(value))) + 1).drop("_cuts")


def spacing_bins(peaks: DataFrame, lengths: DataFrame, chrom: str, pos: str, length: str, size: int = 100_000, least: int = 120, most: int = 280) -> DataFrame:
    """(chrom, start, stop, median): median distance of neighbouring peaks per bin, of distances in [least, most];
    a bin's first peak has no distance; bins without a distance have null. A bin holds (start, stop], the first one
    also 0."""
    at = F.when(F.col(pos) == 0, 0).otherwise(F.floor((F.col(pos) - 1) / size)).cast("long")
    placed = peaks.withColumn("_bin", at)
    order = Window.partitionBy(chrom, "_bin").orderBy(pos)
    gaps = placed.withColumn("_gap", F.col(pos) - F.lag(pos).over(order)).filter(F.col("_gap").between(least, most))
    medians = gaps.groupBy(chrom, (F.col("_bin") * size).alias("start")).agg(F.percentile(F.col("_gap"), F.lit(0.5)).alias("median"))
    return bin_grid(lengths, chrom, length, size).join(medians, [chrom, "start"], "left")


def bin_counts(rows: DataFrame, keys: list[str], pos: str, size: int = 10_000) -> DataFrame:
    return rows.groupBy(*keys, (F.floor(F.col(pos) / size) * size).cast("long").alias("start")).agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, keys: list[str], value: str, lo: float, hi: float, width: float) -> DataFrame:
    """(keys, start, n, share) of values in [lo, hi), by even steps."""
    inside = rows.filter((F.col(value) >= lo) & (F.col(value) < hi))
    counts = inside.groupBy(*keys, (F.floor((F.col(value) - lo) / width) * width + lo).alias("start")).agg(F.count("*").alias("n"))
    per = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(per))


def density(counts: DataFrame, keys: list[str], value: str, weight: str, lo: int, hi: int, step: int, bandwidth: float) -> DataFrame:
    """Gaussian kernel density of a histogram (value, weight) on the grid lo, lo + step, ... hi: each value reaches
    the grid points within four bandwidths."""
    reach = int(4 * bandwidth / step) + 1
    last, at = (hi - lo) // step, F.floor((F.col(value) - lo) / step)
    span = F.sequence(F.greatest(F.lit(0), at - reach), F.least(F.lit(last), at + reach))
    near = F.when(at.between(-reach, last + reach), span).otherwise(F.array().cast("array<bigint>"))
    rows = counts.select(*keys, value, weight, F.explode(near).alias("_k")).withColumn("x", F.col("_k") * step + lo)
    z = (F.col("x") - F.col(value)) / bandwidth
    kernel = F.exp(-z * z / 2) / (bandwidth * (2 * 3.141592653589793) ** 0.5)
    total = counts.groupBy(*keys).agg(F.sum(weight).alias("_total"))
    mass = rows.groupBy(*keys, "x").agg(F.sum(F.col(weight) * kernel).alias("_mass"))
    joined = mass.join(total, keys) if keys else mass.crossJoin(F.broadcast(total))
    return joined.select(*keys, "x", (F.col("_mass") / F.col("_total")).alias("density"))


def regression(rows: DataFrame, y: str, x: str, keys: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(keys or [])).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def correlate(left: DataFrame, right: DataFrame, on: str, left_key: str, right_key: str, x: str, y: str) -> DataFrame:
    """(left_key, right_key, r, n): Pearson correlation over shared ``on``, pairs with a null left out.

    A left row meets each right row of the same ``on``: the size of the two matrices multiplied, as the result asks."""
    both = left.select(on, left_key, x).join(right.select(on, right_key, y), on).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(left_key, right_key).agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))


def extent(rows: DataFrame, value: str, *more: DataFrame) -> DataFrame:
    """One row: least, most and total of a column over all frames given, such as the axis range of data and control."""
    both = rows.select(value)
    for other in more:
        both = both.unionByName(other.select(value))
    return both.agg(F.max(value).alias("most"), F.min(value).alias("least"), F.sum(value).alias("total"))


def mean_of_periods(spectra: DataFrame, key: str, period: str, value: str, periods: tuple[int, ...] = (193, 196, 199)) -> DataFrame:
    """(key, value): mean over the named periods, for keys that have all of them."""
    some = spectra.filter(F.col(period).isin(*periods)).groupBy(key).agg(F.avg(value).alias(value), F.count(value).alias("_n"))
    return some.filter(F.col("_n") == len(periods)).drop("_n")


def labelled(rows: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """rows with their labels by name; rows without one keep nulls."""
    return rows.join(labels, name, "left")


def same_bins(first: DataFrame, *others: DataFrame, on: tuple[str, ...] = ("chrom", "start")) -> DataFrame:
    """Tables of the same genomic bins side by side, matched by contig and start."""
    for other in others:
        first = first.join(other, list(on))
    return first


def first_rows(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """At most so many rows, for a quick look at a file: the first ones in an order, if one is given."""
    return (rows.orderBy(*order) if order else rows).limit(most)


def top_k(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def expressed(rows: DataFrame, gene: str, value: str, least: int = 3) -> DataFrame:
    """Rows of genes with at least ``least`` values that are neither null nor zero."""
    kept = rows.groupBy(gene).agg(F.count_if(F.col(value) != 0).alias("_n")).filter(F.col("_n") >= least).select(gene)
    return rows.join(kept, gene, "left_semi")


def flagstat(rows: DataFrame, flags: str = "flag") -> DataFrame:
    """One row: reads, and reads per flag."""
    from tidemark.functions.reads import FLAGS, flag

    return rows.agg(F.count("*").alias("total"), *[F.count_if(flag(F.col(flags), name)).alias(name) for name in FLAGS])

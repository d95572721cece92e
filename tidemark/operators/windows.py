"""Running-window operators on dense tracks (one row per position of a block).

A block is a run of consecutive positions; a row's place follows from its position, so blocks are cut into tiles
with a halo of as many rows as the frame needs and no block has to fit one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

TILE, SHARED = 20_000, 32


def placed(track: DataFrame, block: list[str], pos: str = "pos", bounds: tuple[int, int] | None = None) -> DataFrame:
    """track plus ``rn`` (1-based place in the block) and ``n`` (rows of the block). bounds: first and last position,
    where all blocks are known to have the same; the track is then not looked through for them."""
    if bounds:
        first, last = bounds
        return track.withColumns({"rn": (F.col(pos) - first + 1).cast("long"), "n": F.lit(last - first + 1).cast("long")})
    ends = track.groupBy(*block).agg(F.min(pos).alias("_first"), F.count("*").alias("n"))
    return track.join(ends, block).withColumn("rn", F.col(pos) - F.col("_first") + 1).drop("_first")


def tiled(rows: DataFrame, before: int, after: int, tile: int = TILE) -> DataFrame:
    """rows (with rn, n), copied to each tile whose frames need them: plus ``tile`` and ``core`` (of this tile)."""
    own = F.floor((F.col("rn") - 1) / tile)
    last = F.floor((F.col("n") - 1) / tile)
    lo = F.greatest(F.lit(0), F.floor((F.col("rn") - 1 - after) / tile))
    hi = F.least(last, F.floor((F.col("rn") - 1 + before) / tile))
    return rows.withColumn("tile", F.explode(F.sequence(lo, hi))).withColumn("core", F.col("tile") == own)


def running_median(track: DataFrame, value: str, block: list[str], size: int = 1000, pos: str = "pos", out: str = "median", tile: int = TILE, native: bool = False, bounds: tuple[int, int] | None = None) -> DataFrame:
    """track plus rn, n and the median of the ``size`` rows around each row, the frame kept inside the block.

    A row at place i sees places c - size/2 ... c + size/2 - 1 with c = i clamped to [size/2 + 1, n - size/2 + 1].
    Blocks of fewer rows than ``size`` give no rows, a block of exactly ``size`` rows none for its first. The
    frame's rows are sorted incrementally in Arrow batches of one tile; ``native`` computes the same from sorted arrays
    without Python."""
    return _medians(placed(track, block, pos, bounds), value, block, size, tile, out, native)


def _medians(rows: DataFrame, value: str, block: list[str], size: int, tile: int, out: str = "median", native: bool = False) -> DataFrame:
    rows = rows.filter(F.col("n") >= size)
    found = _native_medians(rows, value, block, size, tile, out) if native else _arrow_medians(rows, value, block, size, tile, out)
    return found.filter(~((F.col("n") == size) & (F.col("rn") == 1)))


def _arrow_medians(rows: DataFrame, value: str, block: list[str], size: int, tile: int, out: str) -> DataFrame:
    """One pass: the halo is a frame on either side, so each tile holds every frame of its rows, clamped ones too.
    Rows of the halo travel with their value only."""
    half = size // 2
    rest = [c for c in rows.columns if c not in (*block, value, "rn", "n")]
    spread = tiled(rows, size, size, tile)
    carried = F.when(F.col("core"), F.struct(*rest)).alias("rest") if rest else F.lit(None).cast("int").alias("rest")
    spread = spread.select(*block, "tile", "core", "rn", "n", value, carried)
    types = {f.name: f.dataType for f in spread.schema}
    schema = StructType([StructField(c, types[c]) for c in (*block, "rn", "n", value, "rest")] + [StructField(out, DoubleType())])

    def median(table: pa.Table) -> pa.Table:
        table = table.sort_by("rn")
        numbers = pd.Series(table[value].to_numpy().astype("float64"))
        rolled = numbers.rolling(size).median().to_numpy()
        start = table["rn"][0].as_py()
        core = table.filter(table["core"])
        centre = np.clip(core["rn"].to_numpy(), half + 1, core["n"].to_numpy() - half + 1)
        kept = core.select([*block, "rn", "n", value, "rest"])
        return kept.append_column(out, pa.array(rolled[centre + half - 1 - start]))

    found = spread.groupBy(*block, "tile").applyInArrow(median, schema)
    return found.select(*[F.col(f"rest.{c}").alias(c) if c in rest else c for c in rows.columns], out)


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once, inside a lambda: the value is the one element of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _frames(values: Column, size: int) -> Column:
    """Medians of all frames of ``size`` neighbours in an array, in order.

    SHARED frames next to each other have most of their values in common. These are sorted once; of them only as many
    around the middle can become a median as there are values that the frames do not share. A frame thus sorts some
    3 * SHARED values instead of ``size``."""
    half, count = size // 2, F.size(values) - size + 1
    shared = max(1, min(SHARED, half))

    def some(stretch: Column) -> Column:
        """Medians of the frames of a short stretch."""
        n = F.size(stretch) - size + 1
        first = F.greatest(F.lit(1), half - n + 1)  # ranks below it stay below the middle in every frame
        common = F.sort_array(F.slice(stretch, n, size - n + 1))
        middle = F.slice(common, first, F.least(size - n + 1, F.lit(half + 1)) - first + 1)

        def one(j: Column, band: Column) -> Column:
            own = F.sort_array(F.concat(band, F.slice(stretch, j + 1, n - 1 - j), F.slice(stretch, F.lit(size + 1), j)))
            return F.aggregate(F.slice(own, half - first + 1, F.lit(2)), F.lit(0.0), lambda a, x: a + x) / 2

        return _bound(middle, lambda band: F.transform(F.sequence(F.lit(0), n - 1), lambda j: one(j, band)))

    stretch = lambda k: F.slice(values, k * shared + 1, F.least(F.lit(shared), count - k * shared) + size - 1)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((count - 1) / shared).cast("int")), lambda k: _bound(stretch(k), some)))


def _native_medians(rows: DataFrame, value: str, block: list[str], size: int, tile: int, out: str) -> DataFrame:
    """A tile is a row with the values that its frames need, and the rows that take their medians from it."""
    if size % 2:
        raise ValueError("frames have an even number of rows")
    half, rest = size // 2, [c for c in rows.columns if c not in block]
    last = F.least(F.greatest(F.col("rn") + half - 1, F.lit(size)), F.col("n"))  # of the frame of a row
    lo = F.greatest(F.lit(0), F.floor((F.col("rn") - size) / tile))
    hi = F.least(F.floor((F.col("n") - size) / tile), F.floor((F.col("rn") - 1) / tile))
    spread = rows.withColumn("_last", last).withColumn("_tile", F.explode(F.sequence(lo, hi)))
    own = F.when(F.floor((F.col("_last") - size) / tile) == F.col("_tile"), F.struct("_last", *rest))
    cells = F.array_sort(F.collect_list(F.struct("rn", F.col(value).cast("double").alias("v"))))
    held = spread.groupBy(*block, "_tile").agg(F.transform(cells, lambda x: x["v"]).alias("_values"), F.collect_list(own).alias("_own"))
    held = held.withColumn("_medians", _frames(F.col("_values"), size))
    first = (F.col("_tile") * tile + size).cast("long")
    found = held.select(*block, "_medians", first.alias("_first"), F.explode("_own").alias("_row"))
    middle = F.get("_medians", (F.col("_row._last") - F.col("_first")).cast("int"))
    return found.select(*[F.col(c) if c in block else F.col(f"_row.{c}").alias(c) for c in rows.columns], middle.alias(out))


def savgol_weights(half: int = 10) -> list[float]:
    """Least-squares weights of a quadratic at the centre of 2 * half + 1 points."""
    k = np.arange(-half, half + 1)
    a = np.vander(k, 3, increasing=True)
    return np.linalg.pinv(a)[0].tolist()


def smooth(rows: DataFrame, value: str, block: list[str], half: int = 10, out: str = "smooth", tile: int = TILE) -> DataFrame:
    """rows (with rn, n) plus the quadratic smoother over 2 * half + 1 points. Near a block's edge the missing side
    mirrors the other one: v - |neighbour - v| to the left, v + |neighbour - v| to the right."""
    weights = savgol_weights(half)
    order = Window.partitionBy(*block, "tile").orderBy("rn")
    v = F.col(value).cast("double")
    total: Column = v * weights[half]
    for k in range(1, half + 1):
        back, ahead = F.lag(v, k).over(order), F.lead(v, k).over(order)
        left = F.when(F.col("rn") <= half, v - F.abs(ahead - v)).otherwise(back)
        right = F.when(F.col("rn") > F.col("n") - half, v + F.abs(back - v)).otherwise(ahead)
        total = total + weights[half - k] * left + weights[half + k] * right
    return tiled(rows, half, half, tile).withColumn(out, total).filter("core").drop("tile", "core")


def adjusted(track: DataFrame, value: str, block: list[str], size: int = 1000, smoothed: bool = False, tile: int = TILE, bounds: tuple[int, int] | None = None) -> DataFrame:
    """track plus ``adj``: value (or smoothed value) minus the running median."""
    rows = placed(track, block, bounds=bounds)
    if smoothed:
        rows = smooth(rows, value, block, tile=tile)
    rows = _medians(rows, value, block, size, tile)
    return rows.withColumn("adj", F.col("smooth" if smoothed else value) - F.col("median"))


def running_mean(rows: DataFrame, value: str, block: list[str], order_by: str, size: int = 200, out: str = "mean", tile: int = TILE) -> DataFrame:
    """rows (with rn, n) plus the mean of up to ``size`` rows around each (size/2 - 1 before, size/2 after), shorter at
    the ends of the block."""
    before, after = size // 2 - 1, size // 2
    frame = Window.partitionBy(*block, "tile").orderBy("rn").rowsBetween(-before, after)
    spread = tiled(placed(rows, block, order_by), before, after, tile)
    return spread.withColumn(out, F.avg(value).over(frame)).filter("core").drop("tile", "core")


def trimmed_mean(rows: DataFrame, value: str, keys: list[str], share: float = 0.1, out: str = "trimmed") -> DataFrame:
    """Per key the mean without floor(n * share) values on either side."""
    order = Window.partitionBy(*keys).orderBy(value)
    ranked = rows.withColumns({"_rn": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy(*keys))})
    cut = F.floor(F.col("_n") * share)
    return ranked.filter((F.col("_rn") > cut) & (F.col("_rn") <= F.col("_n") - cut)).groupBy(*keys).agg(F.avg(value).alias(out))


def cumulative_share(rows: DataFrame, weight: str, order_by: str, keys: list[str] | None = None, out: str = "cdf") -> DataFrame:
    """Running share of ``weight``: an empirical distribution function over a histogram (few rows a key)."""
    keys = keys or []
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    running = part.orderBy(order_by).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.sum(weight).over(running) / F.sum(weight).over(part))


def average_rank(rows: DataFrame, value: str, keys: list[str], out: str = "avg_rank") -> DataFrame:
    """Rank within keys, ties sharing their mean rank."""
    ties = rows.groupBy(*keys, value).agg(F.count("*").alias("_ties"))
    below = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ties.withColumn(out, F.coalesce(F.sum("_ties").over(below), F.lit(0)) + (F.col("_ties") + 1) / F.lit(2.0)).drop("_ties")
    return rows.join(ranked, [*keys, value])


def lag_distance(rows: DataFrame, keys: list[str], pos: str, out: str = "distance") -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(pos)
    return rows.withColumn(out, F.col(pos) - F.lag(pos).over(order))

"""Range, overlap and nearest-neighbour joins as equi-joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bins(lo: Column, hi: Column, size: int) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def range_join(left: DataFrame, right: DataFrame, key: str, left_range: tuple[str, str], right_range: tuple[str, str], bin_size: int, strict: bool = False) -> DataFrame:
    """left rows with right rows of equal key whose ranges overlap (strict: by more than the touching point).

    Both sides go to every bin they touch; a pair is made only in the bin where the later range starts, so none
    appears twice."""
    (a, b), (c, d) = left_range, right_range
    x = left.withColumn("_bin", F.explode(_bins(F.col(a), F.col(b), bin_size)))
    y = right.withColumn("_bin2", F.explode(_bins(F.col(c), F.col(d), bin_size))).withColumnRenamed(key, "_key2")
    meets = (F.col(c) < F.col(b)) & (F.col(d) > F.col(a)) if strict else (F.col(c) <= F.col(b)) & (F.col(d) >= F.col(a))
    once = F.floor(F.greatest(F.col(a), F.col(c)) / bin_size) == F.col("_bin")
    return x.join(y, (F.col(key) == F.col("_key2")) & (F.col("_bin") == F.col("_bin2")) & meets & once).drop("_bin", "_bin2", "_key2")


def range_totals(left: DataFrame, right: DataFrame, key: str, left_range: tuple[str, str], right_range: tuple[str, str], by: list[str], sums: dict[str, str], tile: int = 1 << 20) -> DataFrame:
    """(by, n, sums): number and sums (new name: column) of the right rows whose range overlaps a left one of equal key, the
    groups of ``range_join`` by left columns, without its pairs. Ranges end where they start or later.

    What overlaps has started at the left end or before, less what has ended before the left start. So right rows are summed
    by start and by end, and running sums are looked up at both bounds; tiles of positions pass on their sums by a row a tile."""
    (a, b), (c, d) = left_range, right_range
    place = lambda side, at: F.struct(F.lit(side).alias("_side"), F.col(at).cast("long").alias("_at"))
    both = lambda rows, x, y, *more: rows.dropna(subset=[key, x, y]).select(F.col(key).alias("_key"), F.explode(F.array(place(0, x), place(1, y))).alias("_p"), *more).select("*", "_p.*").drop("_p")
    totals = ["_count", *[f"_{v}" for v in sums]]
    known = both(right, c, d, *[F.col(v).alias(f"_{name}") for name, v in sums.items()]).groupBy("_key", "_side", "_at").agg(F.count("*").alias("_count"), *[F.sum(f"_{v}").alias(f"_{v}") for v in sums])
    asked = both(left, b, a, F.struct(*by).alias("_row"))
    rows = known.unionByName(asked, allowMissingColumns=True).withColumn("_tile", F.floor(F.col("_at") / tile).cast("long"))
    earlier = Window.partitionBy("_key", "_side").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy("_key", "_side", "_tile").agg(*[F.sum(t).alias(t) for t in totals]).select("_key", "_side", "_tile", *[F.sum(t).over(earlier).alias(f"{t}_before") for t in totals])
    # Starts at a bound count, ends at a bound do not.
    order = F.abs(F.col("_side") - F.col("_row").isNotNull().cast("int"))
    upto = Window.partitionBy("_key", "_side", "_tile").orderBy("_at", order).rowsBetween(Window.unboundedPreceding, 0)
    run = lambda t: (F.coalesce(F.sum(t).over(upto), F.lit(0)) + F.coalesce(f"{t}_before", F.lit(0))) * (1 - 2 * F.col("_side"))
    out = rows.join(per, ["_key", "_side", "_tile"]).select("_row", *[run(t).alias(t) for t in totals]).filter("_row IS NOT NULL")
    out = out.groupBy("_row").agg(*[F.sum(t).alias(t) for t in totals]).filter("_count > 0")
    return out.select("_row.*", F.col("_count").alias("n"), *[F.col(f"_{v}").alias(v) for v in sums])


def point_join(ranges: DataFrame, points: DataFrame, key: str, lo: str, hi: str, pos: str) -> DataFrame:
    """ranges with the points inside them, for dense points: an equi-join on every position of the range."""
    wanted = ranges.withColumn(pos, F.explode(F.sequence(lo, hi)))
    return wanted.join(points, [key, pos])


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on equal keys for which null equals null; keys and all other columns appear once."""
    named = right.select(*[F.col(k).alias(f"_same_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(named, [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys], how).drop(*[f"_same_{k}" for k in keys])


def tile_of(place: Column, tile: int, whole: Column | None = None) -> Column:
    """The tile of a place. Rows without a place (or where not ``whole``) get one of their own for each input partition, so
    that very many of them are many tasks; these tiles come before all others."""
    nowhere = F.lit(-(1 << 40)) - F.spark_partition_id()
    return F.when(place.isNotNull() if whole is None else whole, F.floor(place / tile)).otherwise(nowhere).cast("long")


def _row(df: DataFrame) -> Column:
    return F.struct(*[df[f"`{c}`"] for c in df.columns])


def overlapping(left: DataFrame, right: DataFrame, key: str, left_range: tuple[str, str], right_range: tuple[str, str], tile: int = 1 << 20, anti: bool = False) -> DataFrame:
    """Rows of left that overlap (anti: do not overlap) any row of right, each as often as left has it and with columns of
    any type, maps too. Rows without a key or a bound overlap nothing.

    A row overlaps one of those that start at its end or before if the furthest of their ends reaches its start. So both
    sides are sorted together once and the furthest end is carried along: no row meets another, however long they are or
    many there are in one place. It is carried inside tiles of positions, and between them by a row a tile."""
    (a, b), (c, d) = left_range, right_range
    whole = F.col(key).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()
    rows = left.select(F.col(key).alias("_key"), F.col(b).alias("_at"), F.col(a).alias("_from"), _row(left).alias("_row"), tile_of(F.col(b), tile, whole).alias("_tile"))
    ends = right.select(F.col(key).alias("_key"), F.col(c).alias("_at"), F.col(d).alias("_reach")).dropna().withColumn("_tile", F.floor(F.col("_at") / tile).cast("long"))
    both = rows.unionByName(ends, allowMissingColumns=True)
    earlier = Window.partitionBy("_key").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    per = both.groupBy("_key", "_tile").agg(F.max("_reach").alias("_most")).select("_key", "_tile", F.max("_most").over(earlier).alias("_carried"))
    here = F.max("_reach").over(Window.partitionBy("_key", "_tile").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0))
    met = F.coalesce(F.greatest(here, F.col("_carried")) >= F.col("_from"), F.lit(False)) & F.col("_key").isNotNull()
    marked = null_safe(both, per, ["_key", "_tile"]).withColumn("_met", met).filter("_row IS NOT NULL")
    return marked.filter("NOT _met" if anti else "_met").select("_row.*")


def nearest(points: DataFrame, targets: DataFrame, key: str, pos: str, target_pos: str, tile: int = 1 << 20) -> DataFrame:
    """points plus ``before`` (largest target at or below pos) and ``after`` (smallest above), null where missing: also for
    points without a key or a place.

    Points and targets are sorted together once; nothing is paired. Windows run per tile of positions, and a tile
    takes the nearest target of the tiles before and after it from a table of one row a tile."""
    whole = F.col(key).isNotNull() & F.col(pos).isNotNull()
    rows = points.select(F.col(key), F.col(pos).alias("_p"), _row(points).alias("_row"), tile_of(F.col(pos), tile, whole).alias("_tile"))
    known = targets.select(F.col(key), F.col(target_pos).alias("_t")).dropna().distinct().withColumn("_p", F.col("_t"))
    both = rows.unionByName(known.withColumn("_tile", F.floor(F.col("_p") / tile).cast("long")), allowMissingColumns=True)
    per = both.groupBy(key, "_tile").agg(F.min("_t").alias("_min"), F.max("_t").alias("_max"))
    earlier = Window.partitionBy(key).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(key).orderBy(F.desc("_tile")).rowsBetween(Window.unboundedPreceding, -1)
    outer = per.select(key, "_tile", F.max("_max").over(earlier).alias("_low"), F.min("_min").over(later).alias("_high"))
    # Both frames grow from one end, so each row adds to the last frame instead of reading its own anew.
    upward = Window.partitionBy(key, "_tile").orderBy("_p").rangeBetween(Window.unboundedPreceding, 0)
    downward = Window.partitionBy(key, "_tile").orderBy(F.desc("_p")).rangeBetween(Window.unboundedPreceding, -1)
    before, after = F.last("_t", ignorenulls=True).over(upward), F.last("_t", ignorenulls=True).over(downward)
    some = lambda c: F.when(F.col(key).isNotNull() & F.col("_p").isNotNull(), c)
    out = null_safe(both, outer, [key, "_tile"]).withColumns({"before": some(F.coalesce(before, "_low")), "after": some(F.coalesce(after, "_high"))})
    return out.filter("_row IS NOT NULL").select("_row.*", "before", "after")


def nearest_k(points: DataFrame, targets: DataFrame, key: str, pos: str, target_pos: str, k: int = 10, reach: int = 5000, tile: int = 1 << 20) -> DataFrame:
    """For each point the k targets on either side within ``reach``: point columns, side (-1, 1), rank, target, and
    ``spacing`` to the next target outward within reach. Points without a key or a place have none.

    Targets are numbered along their key, places take the number of the last target at or before them, and the targets of
    the numbers around it are joined: 2 * k + 2 rows a place, however many targets lie within reach."""
    at = lambda c: F.floor(F.col(c) / tile).cast("long").alias("_tile")
    known = targets.select(F.col(key), F.col(target_pos).alias("target")).dropna().select("*", at("target"))
    tiles = Window.partitionBy(key).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    sizes = known.groupBy(key, "_tile").agg(F.count("*").alias("_n")).select(key, "_tile", F.coalesce(F.sum("_n").over(tiles), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.row_number().over(Window.partitionBy(key, "_tile").orderBy("target"))
    numbered = known.join(sizes, [key, "_tile"]).select(key, "_tile", "target", number.alias("_no"))
    places = points.select(key, F.col(pos).alias("_p")).dropna().distinct().select("*", at("_p"))
    both = places.unionByName(numbered.select(key, F.col("target").alias("_p"), "_tile", "_no"), allowMissingColumns=True)
    per = both.groupBy(key, "_tile").agg(F.max("_no").alias("_most")).select(key, "_tile", F.max("_most").over(tiles).alias("_carried"))
    here = F.max("_no").over(Window.partitionBy(key, "_tile").orderBy("_p").rangeBetween(Window.unboundedPreceding, 0))
    placed = both.join(per, [key, "_tile"]).withColumn("_at", F.coalesce(F.greatest(here, F.col("_carried")), F.lit(0))).filter("_no IS NULL")
    ranks = F.explode(F.sequence(F.lit(1), F.lit(k + 1))).alias("rank")
    wanted = placed.select(key, "_p", "_at", ranks).select(key, "_p", "rank", F.explode(F.array(F.struct(F.lit(-1).alias("side"), (F.col("_at") - F.col("rank") + 1).alias("_no")), F.struct(F.lit(1).alias("side"), (F.col("_at") + F.col("rank")).alias("_no")))).alias("x"))
    near = wanted.select(key, "_p", "rank", "x.*").join(numbered.select(key, "_no", "target"), [key, "_no"]).filter(F.abs(F.col("target") - F.col("_p")) <= reach)
    outward = Window.partitionBy(key, "_p", "side").orderBy("rank")
    ranked = near.withColumn("spacing", F.abs(F.lead("target").over(outward) - F.col("target"))).filter(F.col("rank") <= k).withColumnRenamed("_p", pos)
    return points.join(ranked, [key, pos]).select(*points.columns, "target", "side", "rank", "spacing")


def mates(reads: DataFrame, keys: list[str]) -> DataFrame:
    """First and second reads of pairs side by side (columns *_1 and *_2); reads without a mate are dropped."""
    rest = [c for c in reads.columns if c not in (*keys, "is_read1")]
    first = reads.filter("is_read1").select(*keys, *[F.col(c).alias(f"{c}_1") for c in rest])
    second = reads.filter("NOT is_read1").select(*keys, *[F.col(c).alias(f"{c}_2") for c in rest])
    return first.join(second, keys)


def look_up(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Left join with a lookup table; Spark broadcasts it if its size allows."""
    return rows.join(table, on, "left")


def members(rows: DataFrame, ids: DataFrame | None, column: str) -> DataFrame:
    """Rows whose column is listed; no list means all."""
    return rows if ids is None else rows.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")

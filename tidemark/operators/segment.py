"""Segmentation: blocks, runs above zero, peaks, interval merging and splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import null_safe, tile_of
from tidemark.storage import stored

TILE = 1 << 16


def islands(rows: DataFrame, keys: list[str], pos: str, max_step: int, out: str = "island", tile: int = TILE) -> DataFrame:
    """rows plus the id of their run: the position it starts at. A run goes on while the next position is at most
    ``max_step`` further.

    Starts are found per tile of positions; only each tile's first and last position and its last start go on to
    the next one, so a key's positions need not fit one task. Null keys are a key; rows without a position are in no run."""
    rows = rows.withColumn("_tile", tile_of(F.col(pos), tile) if rows.schema[pos].nullable else F.floor(F.col(pos) / tile).cast("long"))
    order = Window.partitionBy(*keys, "_tile").orderBy(pos)
    opens = F.coalesce(F.col(pos) - F.lag(pos).over(order) > max_step, F.lit(False))
    local = rows.withColumn("_open", F.when(opens, F.col(pos)))
    local = local.withColumn("_start", F.max("_open").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    per = local.groupBy(*keys, "_tile").agg(F.min(pos).alias("_first"), F.max(pos).alias("_last"), F.max("_start").alias("_inner"))
    tiles = Window.partitionBy(*keys).orderBy("_tile")
    fresh = F.coalesce(F.col("_first") - F.lag("_last").over(tiles) > max_step, F.lit(True))
    per = per.withColumn("_fresh", F.when(fresh, F.col("_first")))
    earlier = F.max(F.greatest("_fresh", "_inner")).over(tiles.rowsBetween(Window.unboundedPreceding, -1))
    per = per.withColumn("_carry", F.coalesce("_fresh", earlier)).select(*keys, "_tile", "_carry")
    return null_safe(local, per, [*keys, "_tile"]).withColumn(out, F.coalesce("_start", "_carry")).drop("_tile", "_open", "_start", "_carry")


def blocks(rows: DataFrame, keys: list[str], pos: str = "pos", tile: int = TILE) -> DataFrame:
    """rows plus ``block``: consecutive positions share one, named by its first position."""
    return islands(rows, keys, pos, 1, "block", tile)


def positive_runs(track: DataFrame, value: str, keys: list[str], pos: str, max_gap: int, tile: int = TILE) -> DataFrame:
    """(keys, pos, value, run) of the positive values. They are written once: runs look at them twice, and a track is dear."""
    return islands(stored(track.filter(F.col(value) > 0).select(*keys, pos, value), "positive"), keys, pos, max_gap + 1, "run", tile)


def runs(track: DataFrame, value: str, keys: list[str], pos: str = "pos", max_gap: int = 4, tile: int = TILE) -> DataFrame:
    """Runs of positive values that bridge up to ``max_gap`` positions without: (keys, run, pos, value), bridged
    positions with value 0."""
    positive = positive_runs(track, value, keys, pos, max_gap, tile)
    spans = positive.groupBy(*keys, "run").agg(F.max(pos).alias("_end"))
    full = spans.select(*keys, "run", F.explode(F.sequence("run", "_end")).alias(pos))
    return full.join(positive, [*keys, "run", pos], "left").fillna(0, [value])


def run_spans(track: DataFrame, value: str, keys: list[str], pos: str = "pos", max_gap: int = 4, tile: int = TILE) -> DataFrame:
    """(keys, run, run_end, n_positive, top) of the same runs, without their positions."""
    positive = positive_runs(track, value, keys, pos, max_gap, tile)
    return positive.groupBy(*keys, "run").agg(F.max(pos).alias("run_end"), F.count("*").alias("n_positive"), F.max(value).alias("top"))


def run_median(values: Column) -> Column:
    """The peak caller's median of an array: of n sorted values the upper middle one for even n, the mean of the
    two around the middle from (n - 1) / 2 for odd n."""
    s = F.array_sort(values)
    n = F.size(values)
    even, odd = F.try_element_at(s, (n / 2 + 1).cast("int")), (F.try_element_at(s, ((n - 1) / 2 + 1).cast("int")) + F.try_element_at(s, ((n + 1) / 2 + 1).cast("int"))) / 2
    return F.when(n == 1, s[0]).when(n % 2 == 0, even).otherwise(odd)


def _windows(high: Column, compat: bool) -> Column:
    """Consecutive stretches of an array of struct(pos, v) sorted by pos: array of struct(total, start, end, top).
    compat drops the element that ends a stretch."""
    kind = "struct<total:double,start:bigint,end:bigint,top:double>"
    empty = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("now"))

    def one(x: Column) -> Column:
        return F.struct(x["v"].alias("total"), x["pos"].alias("start"), x["pos"].alias("end"), x["v"].alias("top"))

    def step(acc: Column, x: Column) -> Column:
        now = acc["now"]
        grown = F.struct((now["total"] + x["v"]).alias("total"), now["start"].alias("start"), x["pos"].alias("end"), F.greatest(now["top"], x["v"]).alias("top"))
        after = F.lit(None).cast(kind) if compat else one(x)
        return F.when(now.isNull(), F.struct(acc["done"].alias("done"), one(x).alias("now"))).when(now["end"] + 1 == x["pos"], F.struct(acc["done"].alias("done"), grown.alias("now"))).otherwise(F.struct(F.concat(acc["done"], F.array(now)).alias("done"), after.alias("now")))

    return F.aggregate(high, empty, step, lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def peaks(track: DataFrame, value: str, keys: list[str], pos: str = "pos", shortest: int = 50, longest: int = 150, cutoff: float = 5, max_gap: int = 4, compat: bool = False, listed: Column | None = None, tile: int = TILE) -> DataFrame:
    """Peaks (keys, start, end, mid, score) of a median-adjusted track; with ``listed`` only where this condition on the rows
    holds, as for contigs that are reported.

    In a run above zero of shortest to longest positions, the stretch of values at or above the run's median with
    the largest sum; in a longer one up to three times longest, every such stretch of shortest to longest positions.
    Peaks whose top is not above cutoff are dropped. Runs of other lengths never reach an array."""
    positive = positive_runs(track if listed is None else track.filter(listed), value, keys, pos, max_gap, tile)
    run = Window.partitionBy(*keys, "run")
    gated = positive.withColumn("_end", F.max(pos).over(run)).filter((F.col("_end") - F.col("run") + 1).between(shortest, 3 * longest))
    cell = F.struct(F.col(pos).cast("long").alias("pos"), F.col(value).cast("double").alias("v"))
    held = gated.groupBy(*keys, "run", "_end").agg(F.map_from_entries(F.collect_list(cell)).alias("_map"))
    rows = F.transform(F.sequence(F.col("run").cast("long"), F.col("_end").cast("long")), lambda p: F.struct(p.alias("pos"), F.coalesce(F.try_element_at("_map", p), F.lit(0.0)).alias("v")))
    held = held.withColumn("rows", rows).withColumn("_m", run_median(F.transform("rows", lambda x: x["v"])))
    held = held.withColumn("w", _windows(F.filter("rows", lambda x: x["v"] >= F.col("_m")), compat))
    chosen = F.when(F.size("rows") <= longest, F.array(F.array_max("w"))).otherwise(F.filter("w", lambda x: (x["end"] - x["start"] + 1).between(shortest, longest)))
    out = held.select(*keys, F.explode(chosen).alias("p")).select(*keys, "p.start", "p.end", F.col("p.top").alias("score")).filter(F.col("score") > cutoff)
    return out.select(*keys, "start", "end", (F.col("start") + F.round((F.col("end") - F.col("start")) * F.lit(0.5)).cast("long")).alias("mid"), "score")


def merge_intervals(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end", first: list[str] | None = None, tie: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """Merges intervals of a key that overlap by more than the touching point: (keys, start, end, n, first columns).

    first: columns taken from the earliest interval (by start, end, then ``tie``). Tiles of positions pass on how
    far their intervals reach and their last opening, so a key's intervals need not fit one task. Null keys are a key;
    intervals without a start or an end are left out."""
    first, tie = first or [], tie or []
    rows = rows.dropna(subset=[start, end]).withColumn("_tile", F.floor(F.col(start) / tile).cast("long"))
    tiles = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "_tile").agg(F.max(end).alias("_end")).withColumn("_reach", F.max("_end").over(tiles)).drop("_end")
    order = Window.partitionBy(*keys, "_tile").orderBy(start, end, *tie)
    reach = F.greatest(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_reach"))
    head = F.struct(F.col(start), F.col(end), *tie)
    marked = null_safe(rows, ends, [*keys, "_tile"]).withColumn("_open", F.when(F.coalesce(reach <= F.col(start), F.lit(True)), head))
    marked = marked.withColumn("_island", F.max("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    opened = marked.groupBy(*keys, "_tile").agg(F.max("_open").alias("_o")).withColumn("_carry", F.max("_o").over(tiles)).drop("_o")
    marked = null_safe(marked, opened, [*keys, "_tile"]).withColumn("_island", F.coalesce("_island", "_carry"))
    earliest = F.struct(F.col(start), F.col(end), *tie, *[c for c in first if c not in tie])
    out = marked.groupBy(*keys, "_island").agg(F.min(start).alias("_s"), F.max(end).alias("_e"), F.count("*").alias("n"), F.min(earliest).alias("_head"))
    return out.select(*keys, F.col("_s").alias(start), F.col("_e").alias(end), "n", *[F.col(f"_head.{c}").alias(c) for c in first])


def split_intervals(rows: DataFrame, start: str, end: str, size: int) -> DataFrame:
    """Each half-open interval cut into pieces of ``size``, the last one shorter."""
    pieces = rows.withColumn("_at", F.explode(F.sequence(F.col(start), F.col(end) - 1, F.lit(size))))
    return pieces.withColumns({start: F.col("_at"), end: F.least(F.col(end), F.col("_at") + size)}).drop("_at")


def bin_grid(lengths: DataFrame, chrom: str, length: str, size: int) -> DataFrame:
    """(chrom, start, stop) bins of each contig, the last one shorter."""
    grid = lengths.select(chrom, length, F.explode(F.sequence(F.lit(0), F.greatest(F.col(length) - 1, F.lit(0)), F.lit(size))).alias("start"))
    return grid.select(chrom, F.col("start").cast("long").alias("start"), F.least(F.col("start") + size, F.col(length)).cast("long").alias("stop"))

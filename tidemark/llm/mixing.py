"""Mixing sources to target weights with Pareto order sampling.

Every source gets a target of words: its weight's share of all words, at most ``max_repeats`` times its
own size, the excess shared out again by weight among the others until no source is above. A document's
expected number of copies is target / source size. Its whole part is certain: every document of the source
gets so many copies. What is left of the target is drawn as one more copy of some documents: each gets a
fixed uniform number u from its id, and documents rank by u's odds divided by the odds of inclusion. These odds
differ from source to source and are equal within one, as its documents weigh alike. The ranking's longest prefix
that fits is taken; then, for a few rounds, the same among the documents no larger than the words still missing,
which closes the gap that a large document leaves.

Ranks are cut without sorting a source in one task: u falls into ``buckets`` even ranges, which the ranks of a source
follow, sizes are summed per source and range, and running sums over these few numbers give each range its start;
order matters only within a range. As u is uniform, ranges are of even size in every source, those whose target
is a whole number of copies included.

Defined cases: a null or empty text has size 0 and takes 0 words; null sources form one source, the last;
rows with equal ids rank together, ordered by size; other columns are not read. The draw depends on ids and
``seed`` alone, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fields_of_row, scratch, whole_row, written

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words: where a word starts after white space, and at the start of the text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[float, ...], max_repeats: float) -> DataFrame:
    """Per source of sizes (source, size): source_size, weight, target. One row a source; the running sums
    over sources are the only single task here."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_n") - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("_cap", F.col("source_size") * float(max_repeats))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), "_n")
    everyone = Window.partitionBy(F.lit(1))
    per = per.withColumn("_full", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("_level", (F.sum("source_size").over(everyone) - F.col("_full")) / F.col("_left"))
    level = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("weight"), "_n", F.col("_level").alias("level")))).over(everyone)
    return per.withColumn("target", F.least(F.coalesce(level.getField("level") * F.col("weight"), F.col("_cap")), F.col("_cap"))).select("source", "source_size", "weight", "target")


def _uniform(key: Column, seed: int) -> Column:
    high = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 12)
    return (F.conv(high, 16, 10).cast("long") + F.lit(0.5)) / float(1 << 48)


def _fill(rows: DataFrame, buckets: int, turn: int) -> DataFrame:
    """One round: extra = turn for the ranking's prefix that fits into ``missing``, among documents that could."""
    fits = (F.col("extra") == 0) & (F.col("size") > 0) & (F.col("size") <= F.col("missing"))
    want = F.when(fits, F.col("size")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("_want", want)
    ranges = rows.groupBy("source", "bucket").agg(F.sum("_want").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "_sum").withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0).cast("long"))).drop("_sum")
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    inside = Window.partitionBy("source", "bucket").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_end", F.col("_start") + F.sum("_want").over(inside))
    rows = rows.withColumn("_won", (F.col("_want") > 0) & (F.col("_end") <= F.col("missing"))).withColumn("extra", F.when(F.col("_won"), turn).otherwise(F.col("extra")))
    keep = ["doc_id", "source", "size", "source_size", "weight", "target", "copies", "u", "rank", "bucket", "extra"]
    rows = written(rows.select(*keep, "missing", "_won"), "mix")
    got = rows.groupBy("source").agg(F.sum(F.when(F.col("_won"), F.col("size")).otherwise(0)).alias("_got")).withColumnRenamed("source", "_s")
    return rows.join(got, F.col("source").eqNullSafe(F.col("_s"))).select(*keep, (F.col("missing") - F.col("_got")).alias("missing"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeats: float = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7, buckets: int = 4096, rounds: int = 3) -> DataFrame:
    """Per document: doc_id, source, size, source_size, weight, target, copies (whole repeats the mix takes),
    taken (words, repeats counted), certain (copies that every document of its source has), turn (the round that
    drew it for one more, 0 for none), u (its number)."""
    with scratch(docs.sparkSession):
        sizes = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")), "sizes")
        per = targets(sizes, weights, max_repeats).withColumnRenamed("source", "_s")
        share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
        rows = sizes.join(written(per, "targets"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        rows = rows.withColumn("copies", F.floor(share).cast("int")).withColumn("_p", share - F.col("copies"))
        rows = rows.withColumn("missing", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("extra", F.lit(0))
        rows = rows.withColumn("u", _uniform(F.col("doc_id"), seed))
        u = F.col("u")
        odds = (u / (1 - u)) / (F.col("_p") / (1 - F.col("_p")))
        rows = rows.withColumn("rank", F.when(F.col("_p") > 0, odds).otherwise(u))
        rows = rows.withColumn("bucket", F.floor(u * buckets).cast("int")).drop("_p")
        for turn in range(1, rounds + 1):
            rows = _fill(rows, buckets, turn)
        copies = F.col("copies") + F.when(F.col("extra") > 0, 1).otherwise(0)
        out = rows.select("doc_id", "source", "size", "source_size", "weight", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), F.col("copies").alias("certain"), F.col("extra").alias("turn"), "u")
        return written(out, "mixed", keep=True)


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = 7) -> DataFrame:
    """docs with each row repeated as often as the mix takes its id and source (of rows that share both, as often as
    it takes the most repeated); columns as they were.

    No text is shuffled for it: a source's first draw is all documents up to some u, so two numbers a source tell
    the copies of nearly every document. The few others (drawn in later rounds, or too large for what was missing)
    are listed by id."""
    per = mixed.groupBy(F.col("source").alias("mix_source")).agg(F.max("certain").alias("certain"), F.coalesce(F.max(F.when(F.col("turn") == 1, F.col("u"))), F.lit(0.0)).alias("cut"))
    per = written(per, "cuts", keep=True)
    rule = F.col("certain") + F.when(F.col("u") <= F.col("cut"), 1).otherwise(0)
    by_id = mixed.groupBy(F.col("doc_id").alias("mix_id"), F.col("source").alias("id_source")).agg(F.max("copies").alias("listed"), F.first("u").alias("u"))
    others = by_id.join(per, F.col("id_source").eqNullSafe(F.col("mix_source"))).filter(F.col("listed") != rule).select("mix_id", "id_source", "listed")
    others = written(others, "others", keep=True)
    rows = docs.select(whole_row(docs), docs[f"`{id_col}`"].alias("id"), docs[f"`{source_col}`"].alias("mix_of")).withColumn("u", _uniform(F.col("id"), seed))
    joined = rows.join(per, F.col("mix_of").eqNullSafe(F.col("mix_source"))).join(others, F.col("id").eqNullSafe(F.col("mix_id")) & F.col("mix_of").eqNullSafe(F.col("id_source")), "left")
    copies = joined.select("row", F.coalesce("listed", rule).alias("copies")).filter("copies > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*fields_of_row(docs.columns))

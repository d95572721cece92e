"""Exact deduplication: two Bloom passes pick the rows whose text may repeat; only they shuffle.

Pass one hashes every text into two bit tables and keeps the bits that at least two rows hit. Pass two tests every
row against both tables. A row that misses one has a text of its own and passes straight through; the others are
grouped by SHA-256 of the normalised text, so the result is exact whatever the tables hold.

The tables grow with the rows, ``bits_per_row`` bits each for every row. What is broadcast does not: where a table
would need more than ``max_bits``, hashes are divided into ranges with a pair of tables each, and one range after the
other is tested. Rows are then written once by range, which takes no shuffle, so that each range reads its own only.
At most ``max_bits / 4`` bytes are broadcast at a time, and the share of rows that repeat by chance stays the same.

Everything is built from DataFrame functions. Rows of a large group are dealt to several tasks.

Defined cases: a null text counts as empty; empty texts equal each other; a null id ranks below every
other; rows that agree in id and text share their verdict; other columns are never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, IntegerType, StructField, StructType

from tidemark.llm.common import ascii_lower, fields_of_row, new_path, whole_row, with_groups, written

CHUNK = 32768  # bits in one bitmap of bitmap_construct_agg


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def _tables(rows: int, per_row: int, max_bits: int) -> tuple[int, int]:
    """Bits of one table, and into how many ranges the hashes are divided."""
    ranges, bits = max(1, -(-rows * per_row // max_bits)), CHUNK
    while bits < min(max_bits, -(-rows * per_row // ranges)):
        bits *= 2
    return bits, ranges


def _slots(sha: Column, bits: int) -> list[Column]:
    h = F.xxhash64(sha)
    return [h.bitwiseAND(bits - 1), F.shiftrightunsigned(h, 32).bitwiseAND(bits - 1)]


def repeated_bits(digests: DataFrame, bits: int) -> DataFrame:
    """(which, chunk, bitmap): of two tables of so many bits, those that at least two rows hit."""
    a, b = _slots(F.col("text_sha256"), bits)
    hits = digests.select(F.explode(F.array(F.struct(F.lit(0).alias("which"), a.alias("slot")), F.struct(F.lit(1).alias("which"), b.alias("slot")))).alias("hit")).select("hit.*")
    twice = hits.groupBy("which", "slot").agg(F.count("*").alias("n")).filter("n > 1")
    return twice.groupBy("which", F.expr(f"slot div {CHUNK}").alias("chunk")).agg(F.bitmap_construct_agg(F.col("slot") % CHUNK).alias("bitmap"))


def _holds(bitmap: Column, slot: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, ((slot % CHUNK) / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (slot % 8).cast("int")) == 1, F.lit(False))


def may_repeat(rows: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """rows plus the column ``maybe``: false only where no other row has this text_sha256."""
    for which, slot in enumerate(_slots(F.col("text_sha256"), bits)):
        side = bitmaps.filter(F.col("which") == which).select(F.col("chunk").alias(f"_chunk{which}"), F.col("bitmap").alias(f"_bitmap{which}"))
        rows = rows.withColumn(f"_slot{which}", slot).join(F.broadcast(side), F.expr(f"_slot{which} div {CHUNK} = _chunk{which}"), "left")
    both = _holds(F.col("_bitmap0"), F.col("_slot0")) & _holds(F.col("_bitmap1"), F.col("_slot1"))
    return rows.withColumn("maybe", both).drop(*[f"_{x}{k}" for x in ("slot", "chunk", "bitmap") for k in (0, 1)])


def _with(rows: DataFrame, name: str, kind: DataType) -> StructType:
    return StructType([*rows.schema.fields, StructField(name, kind)])


def _flagged(digests: DataFrame, rows: DataFrame, bits: int, ranges: int) -> tuple[DataFrame, DataFrame]:
    """digests (_id, text_sha256) and rows, which hold the same, plus ``maybe``."""
    if ranges == 1:
        bitmaps = written(repeated_bits(digests, bits), "bloom")
        return may_repeat(digests, bitmaps, bits), may_repeat(rows, bitmaps, bits)
    spark, apart, out = rows.sparkSession, new_path(rows.sparkSession, "ranges"), new_path(rows.sparkSession, "flagged")
    at = F.pmod(F.xxhash64(F.lit(1), "text_sha256"), F.lit(ranges)).cast("int")
    rows.withColumn("_range", at).write.partitionBy("_range").parquet(apart)
    for k in range(ranges):
        part = spark.read.schema(_with(rows, "_range", IntegerType())).parquet(apart).filter(F.col("_range") == k).drop("_range")
        bitmaps = written(repeated_bits(part.select("text_sha256"), bits), "bloom")
        may_repeat(part, bitmaps, bits).write.mode("append").parquet(out)
    flagged = spark.read.schema(_with(rows, "maybe", BooleanType())).parquet(out)
    return flagged.select(*digests.columns, "maybe"), flagged


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return written(docs.select(F.col(f"`{id_col}`").alias("_id"), digest(F.col(f"`{text_col}`")).alias("text_sha256")), "digests")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_bits: int = 1 << 29) -> DataFrame:
    """Per row: its id, keep_id (largest id with an equal text), group_size, kept, text_sha256."""
    digests = _digests(docs, id_col, text_col)
    total = digests.count()
    flagged, _ = _flagged(digests, digests, *_tables(total, bits_per_row, max_bits))
    one = F.lit(1).cast("long")
    alone = flagged.filter(~F.col("maybe")).select("_id", F.col("_id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    some = flagged.filter("maybe").select("_id", "text_sha256")
    groups = some.groupBy("text_sha256").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size"))
    joined = with_groups(some, groups, ["text_sha256"], "group_size", total, ["_id"])
    kept = F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return alone.unionByName(joined.select("_id", "keep_id", "group_size", kept, "text_sha256")).withColumnRenamed("_id", id_col)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_bits: int = 1 << 29) -> DataFrame:
    """docs with one row of each normalised text, that with the largest id; columns as they were."""
    digests = _digests(docs, id_col, text_col)
    total = digests.count()
    rows = docs.select(whole_row(docs), docs[f"`{id_col}`"].alias("_id"), digest(docs[f"`{text_col}`"]).alias("text_sha256"))
    known, flagged = _flagged(digests, rows, *_tables(total, bits_per_row, max_bits))
    groups = known.filter("maybe").groupBy("text_sha256").agg(F.max("_id").alias("_keep"), F.count("*").alias("_size"))
    stay = with_groups(flagged.filter("maybe"), groups, ["text_sha256"], "_size", total, ["_id"]).filter(F.col("_id").eqNullSafe(F.col("_keep")))
    return flagged.filter(~F.col("maybe")).select("row").unionByName(stay.dropDuplicates(["text_sha256"]).select("row")).select(*fields_of_row(docs.columns))

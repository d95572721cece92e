"""Collapsing duplicates on a stream of reads in order of position.

Reads wait in state until the stream has moved on by ``reach`` positions: a genome-wide position stands in for the event
time, so Spark's watermark is the place behind which no read comes any more. Mates meet in a join of the stream with itself
over at most ``reach`` positions, groups are two chained aggregations, first by CIGAR, then over a group's CIGARs. All of
it is built from DataFrame operators; the state holds what lies within ``reach`` of the newest read, and nothing older.

A pair whose mates are further apart than ``reach`` gives nothing, like one without a mate. The groups that are still open
come out once the stream is moved on by ``end_marks``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.functions.reads import outer_end

FAR = 10**11  # seconds, beyond any genome


def timed(reads: DataFrame, contig_start: Column, reach: int) -> DataFrame:
    """reads plus ``outer`` and ``at``: the genome-wide place of the outer end as a timestamp with its watermark."""
    rows = reads.withColumn("outer", outer_end(F.col("pos"), F.col("reverse"), F.col("ref_len")))
    return rows.withColumn("at", F.timestamp_seconds(contig_start + F.col("outer"))).withWatermark("at", f"{reach} seconds")


def _representatives(rows: DataFrame, keys: list[str], order: str, name: str, cigar: str) -> DataFrame:
    """(keys, name, xp): as ``duplicates.representative`` has them, for rows with an event time ``at`` that keys determine."""
    first = F.min(F.struct(F.col(order).alias("o"), F.col(name).alias("n"))).alias("first")
    per = rows.groupBy(F.window("at", "1 second").alias("w"), *keys, cigar).agg(F.count("*").alias("n"), first)
    best = F.max_by(F.struct("first", "n", F.col(cigar).alias("c")), F.struct(F.col("n"), (-F.length(cigar)).alias("l"), F.col(cigar).alias("c"))).alias("best")
    out = per.groupBy(F.window(F.window_time("w"), "1 second").alias("w2"), *keys).agg(best).filter("best.c IS NOT NULL")
    return out.select(*keys, F.col("best.first.n").alias(name), F.col("best.n").alias("xp"))


def collapse(reads: DataFrame, contig_start: Column, reach: int, group: str = "grp", name: str = "qname", order: str = "rid", keep: bool = False, merged: bool = False, include_failed: bool = False) -> DataFrame:
    """The rows of ``duplicates.collapse`` on the same reads, as their groups are passed: (kind, grp, chrom, chrom2, pos, pos2,
    qname, xp).

    reads: a stream with the columns that ``duplicates.collapse`` takes. contig_start: where a row's contig begins on the
    genome-wide axis. Reads may come up to ``reach`` positions out of order."""
    rows = reads if include_failed else reads.filter(~F.col("qcfail"))
    aside = F.col("unmapped") | (F.col("paired") & F.col("mate_unmapped"))
    mapped = timed(rows, contig_start, reach).filter(~aside)
    side = lambda k: mapped.filter(F.col("paired") & (F.col("is_read1") if k == 1 else ~F.col("is_read1"))).select(
        F.col(group).alias(f"g{k}"), F.col(name).alias(f"n{k}"), F.col("at").alias(f"at{k}"), F.col(order).alias(f"o{k}"), F.col("chrom").alias(f"chrom_{k}"), F.col("outer").alias(f"outer_{k}"), F.col("cigar").alias(f"cigar_{k}"),
    )
    span = F.expr(f"INTERVAL {reach} SECONDS")
    near = (F.col("at2") >= F.col("at1") - span) & (F.col("at2") <= F.col("at1") + span)
    pairs = side(1).join(side(2), (F.col("g1") == F.col("g2")) & (F.col("n1") == F.col("n2")) & near)
    pairs = pairs.select(F.col("g1").alias(group), F.col("n1").alias(name), F.col("at2").alias("at"), F.least("o1", "o2").alias(order), "chrom_1", "chrom_2", "outer_1", "outer_2", F.concat_ws("|", "cigar_1", "cigar_2").alias("cigar"))
    pair = _representatives(pairs, [group, "chrom_1", "chrom_2", "outer_1", "outer_2"], order, name, "cigar")
    alone = mapped.filter(~F.col("paired"))
    alone = alone.filter(F.col(name).startswith("M_")) if merged else alone
    single = _representatives(alone, [group, "chrom", "reverse", "pos", "ref_len"], order, name, "cigar")
    chrom, none = reads.schema["chrom"].dataType, F.lit(None)

    def shaped(df: DataFrame, kind: str, chrom1: str, chrom2: Column, pos: str, pos2: Column, xp: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(group).alias("grp"), F.col(chrom1).alias("chrom"), chrom2.cast(chrom).alias("chrom2"), F.col(pos).cast("long").alias("pos"), pos2.cast("long").alias("pos2"), F.col(name).alias("qname"), xp.cast("long").alias("xp"))

    out = shaped(pair, "pair", "chrom_1", F.col("chrom_2"), "outer_1", F.col("outer_2"), F.col("xp"))
    out = out.unionByName(shaped(single, "single", "chrom", none, "pos", none, F.col("xp")))
    return out.unionByName(shaped(rows.filter(aside), "kept", "chrom", none, "pos", none, F.lit(1))) if keep else out


def end_marks(spark, schema, contig: object) -> DataFrame:
    """Reads far behind the end of any genome, one for each way through ``collapse``: as the last rows of a stream they let all
    open groups pass. They form no group that is ever given out."""
    base = {f.name: None for f in schema} | {"chrom": contig, "pos": FAR, "ref_len": 0, "reverse": False, "unmapped": False, "mate_unmapped": False, "qcfail": False, "cigar": "end"}
    kinds = [{"paired": False, "is_read1": False, "qname": "M_end"}, {"paired": True, "is_read1": True, "qname": "end1"}, {"paired": True, "is_read1": False, "qname": "end2"}]
    return spark.createDataFrame([tuple((base | k)[f.name] for f in schema) for k in kinds], StructType([StructField(f.name, f.dataType) for f in schema]))

"""The duplicate collapse in consensus mode: one called read for each group and mate, rescue of failed reads, and the ways
that called reads go on.

Everything is grouped by what duplicates share, and the calling itself by position inside that, so a group of any depth is
spread and summed map-side (see ``duplicates.consensus``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.duplicates import consensus, dominant, pair_keys, single_keys
from tidemark.sources.sinks import fastq_lines
from tidemark.storage import stored

OF_A_READ = ["chrom", "pos", "reverse", "seq", "qual", "mapq", "xp", "qcfail", "zq"]


def members(reads: DataFrame, group: str, name: str, order: str, five_prime: bool = False, merged: bool = False) -> DataFrame:
    """(gid, kind, side, order, name and the columns of a read) of the reads of dominant CIGAR: two rows a pair (sides 1 and
    2), one a single read (side 0). Unmapped reads, pairs with an unmapped mate and reads without qualities are left out."""
    rows = reads.filter(F.col("qual").isNotNull() & ~F.col("unmapped") & ~(F.col("paired") & F.col("mate_unmapped")))
    both = pair_keys(rows.filter("paired").select(group, name, "is_read1", order, "ref_len", "cigar", *OF_A_READ), group, name)
    both = both.withColumns({"cigar": F.concat_ws("|", "cigar_1", "cigar_2"), order: F.least(f"{order}_1", f"{order}_2")})
    keys = [group, "chrom_1", "chrom_2", "outer_1", "outer_2"]
    side = lambda k: F.struct(F.lit(k).alias("side"), *[F.col(f"{c}_{k}").alias(c) for c in OF_A_READ])
    pairs = dominant(both, keys, "cigar").select(_gid("pair", keys), F.lit("pair").alias("kind"), F.col(group).alias("grp"), F.col(order).alias("order"), F.col(name).alias("name"), F.inline(F.array(side(1), side(2))))
    alone = rows.filter(~F.col("paired"))
    alone = single_keys(alone.filter(F.col(name).startswith("M_")) if merged else alone, five_prime)
    keys = [group, "chrom", "reverse", "dup_pos", "dup_len"]
    singles = dominant(alone, keys, "cigar").select(_gid("single", keys), F.lit("single").alias("kind"), F.col(group).alias("grp"), F.col(order).alias("order"), F.col(name).alias("name"), F.lit(0).alias("side"), *OF_A_READ)
    return pairs.unionByName(singles)


def _gid(kind: str, keys: list[str]) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("kind"), *keys), {"ignoreNullFields": "false"}).alias("gid")


def call(rows: DataFrame) -> DataFrame:
    """One row for each group and side of ``members``: name, place and flags, called ``seq`` and ``qual``, ``n`` reads, ``xp`` with
    earlier counts added, and ``unmapped`` where no read has the called sequence.

    The row is the last read that has it, or else the first of all with the group's smallest mapping quality; its name is
    always the first read's. A first sum holds numbers only, so it needs no sort; whole rows are then compared among those of
    the first and the last number. Both tables with a row a group and side are written, so their size is known before rows are
    joined with them: rows are dealt out only where there are too many groups to broadcast. The rows are read three times."""
    keys, agrees = ["gid", "side"], F.col("seq") == F.col("consensus")
    called = stored(consensus(rows.filter(F.length("seq") > 0), keys, "seq", "qual").withColumnRenamed("reads", "n"), "consensus")
    per = rows.join(called, keys).groupBy(*keys, "consensus", "consensus_qual", "n").agg(
        F.min("order").alias("_from"), F.max(F.when(agrees, F.col("order"))).alias("_to"),
        F.min("mapq").alias("_least"), F.sum(F.coalesce("xp", F.lit(0))).alias("_before"), (~F.bool_or(agrees)).alias("unmapped"),
    )
    per = stored(per, "groups")
    at, rest = F.struct("order", "name"), F.struct("chrom", "pos", "reverse", "mapq", "qcfail", "zq")
    of_all = F.struct("kind", "grp", "consensus", "consensus_qual", "n", "_least", "_before", "unmapped")
    ends = rows.join(per, keys).filter(F.col("order").isNull() | (F.col("order") == F.col("_from")) | (agrees & (F.col("order") == F.col("_to"))))
    found = ends.groupBy(*keys).agg(F.first(of_all).alias("_all"), F.max_by(rest, F.when(agrees, at)).alias("_last"), F.min_by(rest, at).alias("_first"), F.min_by("name", at).alias("qname"))
    found = found.select(*keys, "_all.*", "_last", "_first", "qname")
    chosen = F.when(F.col("unmapped"), F.col("_first")).otherwise(F.col("_last"))
    fields = [chosen.getField(c).alias(c) for c in ("chrom", "pos", "reverse", "qcfail", "zq")]
    mapq = F.when(F.col("unmapped"), F.col("_least")).otherwise(chosen.getField("mapq")).alias("mapq")
    return found.select("gid", "kind", "grp", "side", "qname", *fields, mapq, F.col("consensus").alias("seq"), F.col("consensus_qual").alias("qual"), "unmapped", "n", (F.col("n") + F.col("_before")).cast("long").alias("xp"))


def passed(called: DataFrame, include_failed: bool = False, rescue_failed: bool = False, min_count: int | None = None) -> DataFrame:
    """called without the groups that quality control or their count drops. With rescue, a group of several reads is kept if
    all its failures are marked Q, which lifts them; else a failure on either side drops the group, unless failures stay."""
    group = Window.partitionBy("gid")
    marked = F.col("qcfail") & ~(F.coalesce(F.col("zq"), F.lit("")) == "Q")
    some = lambda c: F.max(c.cast("int")).over(group) == 1
    tried = (F.col("n") > 1) & some(F.col("qcfail")) & F.lit(rescue_failed)
    keep = F.when(tried, ~some(marked)).otherwise(F.lit(include_failed) | ~some(F.col("qcfail")))
    few = F.lit(False) if min_count is None else some(F.col("xp") < min_count)
    rows = called.withColumns({"_keep": keep & ~few, "_tried": tried}).filter("_keep")
    return rows.withColumns({"qcfail": F.col("qcfail") & ~F.col("_tried"), "zq": F.when(~F.col("_tried") | (F.col("zq") != "Q"), F.col("zq"))}).drop("_keep", "_tried")


def consensus_collapse(reads: DataFrame, group: str = "grp", name: str = "qname", order: str = "rid", five_prime: bool = False, merged: bool = False, include_failed: bool = False, rescue_failed: bool = False, min_count: int | None = None) -> DataFrame:
    """The whole collapse in consensus mode: the rows of ``call`` that ``passed`` keeps. The members are written to a table first,
    so mates are joined once.

    reads: group, name, order, chrom, pos, reverse, ref_len, cigar, seq, qual, mapq, xp, zq, is_read1, paired, unmapped,
    mate_unmapped, qcfail."""
    rows = reads if include_failed or rescue_failed else reads.filter(~F.col("qcfail"))
    chosen = stored(members(rows, group, name, order, five_prime, merged), "members")
    return passed(call(chosen), include_failed, rescue_failed, min_count)


def routes(called: DataFrame) -> dict[str, DataFrame]:
    """Where called reads go: ``alignments``; and as FASTQ lines (qname, line), for a new alignment, the pairs of which either
    side is unmapped (``r1``, ``r2``, names ending in /1 and /2) and unmapped single reads (``sr``). Called reads, a row a group and
    side, are written to a table, so that no way calls them again."""
    rows = stored(called.withColumn("_again", F.max(F.col("unmapped").cast("int")).over(Window.partitionBy("gid")) == 1), "called")
    again = rows.filter("_again").withColumn("qname", F.when(F.col("side") > 0, F.concat("qname", F.lit("/"), F.col("side").cast("string"))).otherwise(F.col("qname")))
    out = {"alignments": rows.filter(~F.col("_again")).drop("_again")}
    return out | {stream: fastq_lines(again.filter(F.col("side") == side)) for stream, side in (("r1", 1), ("r2", 2), ("sr", 0))}

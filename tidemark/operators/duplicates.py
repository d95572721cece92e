"""Collapsing PCR duplicates: grouping, representative read, consensus read, rescue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.reads import outer_end
from tidemark.operators.joins import mates

OFFSET = 33  # fixed value: quality characters start at '!'


def single_keys(rows: DataFrame, five_prime: bool = False) -> DataFrame:
    """rows plus ``dup_pos`` and ``dup_len``: what duplicates of unpaired reads share besides group, contig, strand."""
    if five_prime:
        return rows.withColumns({"dup_pos": outer_end(F.col("pos"), F.col("reverse"), F.col("ref_len")), "dup_len": F.lit(None).cast("int")})
    return rows.withColumns({"dup_pos": F.col("pos"), "dup_len": F.col("ref_len")})


def pair_keys(rows: DataFrame, group: str, name: str) -> DataFrame:
    """Pairs side by side (``joins.mates``) plus ``outer_1`` and ``outer_2``: with the group and both contigs what
    duplicates of pairs share. rows: group, name, is_read1, chrom, pos, reverse, ref_len and more."""
    outer = rows.withColumn("outer", outer_end(F.col("pos"), F.col("reverse"), F.col("ref_len")))
    return mates(outer, [group, name])


def quality_sum(qual: Column) -> Column:
    return F.aggregate(F.filter(F.split(qual, ""), lambda c: c != ""), F.lit(0), lambda a, c: a + F.ascii(c))


def dominant(rows: DataFrame, keys: list[str], cigar: str) -> DataFrame:
    """Rows whose CIGAR is their group's most frequent; of equally frequent ones the shortest, then the largest."""
    counts = rows.groupBy(*keys, cigar).agg(F.count("*").alias("_n"))
    best = counts.groupBy(*keys).agg(F.max(F.struct(F.col("_n"), (-F.length(cigar)).alias("l"), F.col(cigar).alias("_cigar"))).alias("_b"))
    best = best.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_b._cigar").alias("_cigar"))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return rows.join(best, [*same, F.col(cigar) == F.col("_cigar")]).select(*rows.columns)


def representative(rows: DataFrame, keys: list[str], order: str, name: str, cigar: str, quality: Column, previous: Column | None = None, min_count: int | None = None) -> DataFrame:
    """One row a group: the read with the largest quality sum (the first of equals) of the dominant CIGAR, under
    the name of the group's first read, with ``xp`` the duplicates it stands for (counts of earlier rounds added).
    Where ``order`` ties, the read with the larger other columns counts, and the name first by code point."""
    chosen = dominant(rows, keys, cigar).withColumn("_q", quality)
    prior = F.coalesce(previous, F.lit(0)) if previous is not None else F.lit(0)
    rest = [c for c in rows.columns if c not in (*keys, name, "xp", "reads")]
    ties = [c for c in rest if "map<" not in rows.schema[c].dataType.simpleString()]
    best = F.max_by(F.struct(*rest), F.struct(F.col("_q"), (-F.col(order)).alias("o"), *ties))
    out = chosen.groupBy(*keys).agg(best.alias("_r"), F.min_by(name, F.struct(order, name)).alias(name), (F.count("*") + F.sum(prior)).alias("xp"), F.count("*").alias("reads"))
    out = out.select(*keys, name, *[F.col(f"_r.{c}").alias(c) for c in rest], "xp", "reads")
    return out if min_count is None else out.filter(F.col("xp") >= min_count)


def consensus(rows: DataFrame, keys: list[str], seq: str, qual: str) -> DataFrame:
    """(keys, consensus, consensus_qual, reads): per position the base that the reads' error probabilities leave
    least doubt about. Reads of a group have equal lengths; N is no evidence; quality is capped at 60.

    Grouped by position, not by group: a group of any depth is spread over its positions and summed map-side. Sums hold
    numbers of fixed width only, bases as code points: so a hash table of groups and positions takes them, and cells are not sorted."""
    cells = F.transform(F.sequence(F.lit(1), F.length(seq)), lambda i: F.struct(i.alias("at"), F.ascii(F.substring(F.col(seq), i, F.lit(1))).alias("base"), (F.ascii(F.substring(F.col(qual), i, F.lit(1))) - OFFSET).alias("q")))
    rows = rows.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")
    q = F.when(F.col("q") == 0, F.lit(-0.1)).otherwise(F.col("q") / F.lit(-10.0))
    other = F.log10(1 - F.pow(F.lit(10.0), q)) - F.log10(F.lit(3.0))
    # Rounded, so that bases with equal evidence tie whatever the order of summation; the first by letter is called then.
    sums = [F.round(F.sum(F.when(F.col("base") == ord("N"), F.lit(0.0)).when(F.col("base") == ord(b), q).otherwise(other)), 10).alias(f"_{b}") for b in "ACGT"]
    per = rows.groupBy(*keys, "at").agg(*sums, F.count_if(F.col("base") != ord("N")).alias("_known"), F.count("*").alias("reads"), F.min("q").alias("_worst"), F.min("base").alias("_only"), F.min("q").alias("_q"))
    total = F.log10(F.greatest(F.lit(1e-9), sum((F.pow(F.lit(10.0), F.col(f"_{b}")) for b in "ACGT"), F.lit(0.0))))
    best = F.array_min(F.array(*[F.struct((F.col(f"_{b}") - total).alias("v"), F.lit(b).alias("b")) for b in "ACGT"]))
    per = per.withColumn("_best", best)
    sure = F.col("_best.v") < 0
    only = F.when(F.col("_only") == 0, "").otherwise(F.decode(F.unhex(F.lpad(F.hex("_only"), 8, "0")), "UTF-32"))
    base = F.when(F.col("reads") == 1, only).when(F.col("_known") == 0, F.lit("N")).when(sure, F.col("_best.b")).otherwise(F.lit("N"))
    quality = F.when((F.col("reads") == 1) | (F.col("_known") == 0), F.col("_q")).when(sure, F.round(F.least(F.lit(60.0), -10 * F.col("_best.v")))).otherwise(F.lit(0)).cast("int")
    cells = F.array_sort(F.collect_list(F.struct("at", base.alias("b"), F.char(quality + OFFSET).alias("q"))))
    out = per.groupBy(*keys).agg(cells.alias("_c"), F.max("reads").alias("reads"))
    return out.select(*keys, F.array_join(F.transform("_c", lambda c: c["b"]), "").alias("consensus"), F.array_join(F.transform("_c", lambda c: c["q"]), "").alias("consensus_qual"), "reads")


def settle(rows: DataFrame, called: DataFrame, keys: list[str], seq: str, order: str, mapq: str) -> DataFrame:
    """Consensus reads: under the group's first read; ``unmapped`` where no read has the consensus sequence, with
    the group's smallest mapping quality."""
    both = rows.join(called, keys)
    agrees = F.max((F.col(seq) == F.col("consensus")).cast("int")) == 1
    return both.groupBy(*keys, "consensus", "consensus_qual").agg((~agrees).alias("unmapped"), F.min(mapq).alias("min_mapq"), F.min(order).alias("first"))


def rescue(rows: DataFrame, tag: str = "zq", failed: str = "qcfail", reads: str = "reads", include: bool = False, rescue_failed: bool = False) -> DataFrame:
    """Drops collapsed reads that failed quality control. With rescue_failed, a failure marked Q is lifted where
    the group has more than one read; with include, failures stay."""
    lifted = (F.col(reads) > 1) & (F.coalesce(F.col(tag), F.lit("")) == "Q") if rescue_failed else F.lit(False)
    out = rows.withColumns({failed: F.col(failed) & ~lifted, tag: F.when(~lifted, F.col(tag))})
    return out if include else out.filter(~F.col(failed))


def collapse(reads: DataFrame, group: str = "grp", name: str = "qname", order: str = "rid", quality: str = "quality", keep: bool = False, five_prime: bool = False, merged: bool = False, include_failed: bool = False) -> DataFrame:
    """The whole collapse: (kind, grp, chrom, chrom2, pos, pos2, qname, xp), one row a group of duplicates.

    reads: group, name, order, chrom, pos, reverse, ref_len, cigar, quality, is_read1, paired, unmapped,
    mate_unmapped, qcfail. Failed reads are dropped. Unmapped ones are dropped, or, with ``keep``, passed through one by
    one (kind ``kept``), as are mapped ones whose mate is not. Pairs of both mates collapse by group, contigs and outer
    positions (kind ``pair``); unpaired reads by group, contig, strand and place (kind ``single``), with ``merged`` only
    those named as merged. A read of a pair whose mate is missing gives nothing."""
    rows = reads if include_failed else reads.filter(~F.col("qcfail"))
    aside = F.col("unmapped") | (F.col("paired") & F.col("mate_unmapped"))
    mapped = rows.filter(~aside)
    pairs = pair_keys(mapped.filter("paired").select(group, name, "is_read1", order, "chrom", "pos", "reverse", "ref_len", "cigar", quality), group, name)
    pairs = pairs.withColumns({"cigar": F.concat_ws("|", "cigar_1", "cigar_2"), "_total": F.col(f"{quality}_1") + F.col(f"{quality}_2"), order: F.least(f"{order}_1", f"{order}_2")})
    pair = representative(pairs, [group, "chrom_1", "chrom_2", "outer_1", "outer_2"], order, name, "cigar", F.col("_total"))
    alone = mapped.filter(~F.col("paired"))
    alone = single_keys(alone.filter(F.col(name).startswith("M_")) if merged else alone, five_prime)
    single = representative(alone, [group, "chrom", "reverse", "dup_pos", "dup_len"], order, name, "cigar", F.col(quality))

    def shaped(df: DataFrame, kind: str, chrom2: Column, pos: str, pos2: Column, xp: Column, chrom: str = "chrom") -> DataFrame:
        none = lambda c, like: c.cast(reads.schema[like].dataType)
        return df.select(F.lit(kind).alias("kind"), F.col(group).alias("grp"), F.col(chrom).alias("chrom"), none(chrom2, "chrom").alias("chrom2"), F.col(pos).cast("long").alias("pos"), pos2.cast("long").alias("pos2"), F.col(name).alias("qname"), xp.cast("long").alias("xp"))

    null = F.lit(None)
    out = shaped(pair, "pair", F.col("chrom_2"), "outer_1", F.col("outer_2"), F.col("xp"), "chrom_1")
    out = out.unionByName(shaped(single, "single", null, "dup_pos", null, F.col("xp")))
    return out.unionByName(shaped(rows.filter(aside), "kept", null, "pos", null, F.lit(1))) if keep else out


def route(called: DataFrame, unmapped: str = "unmapped") -> tuple[DataFrame, DataFrame]:
    """Collapsed reads that go on as alignments, and those that no read supports, as FASTQ lines for a new alignment."""
    from tidemark.sources.sinks import fastq_lines

    return called.filter(~F.col(unmapped)), fastq_lines(called.filter(unmapped))


def running_groups(rows: DataFrame, keys: list[str], order: str, within: list[str] | None = None, tile: int = 1 << 16) -> DataFrame:
    """Run lengths of equal keys in the order of a number (what ``uniq -c`` counts), apart for each value of the columns
    ``within``: (within, keys, start, n).

    Runs open inside tiles of ``order``; a tile passes on its last key and its last opening, so no sequence has to fit
    one task."""
    within = within or []
    rows = rows.select(*within, *keys, order).withColumn("_tile", F.floor(F.col(order) / tile).cast("long"))
    inside = Window.partitionBy(*within, "_tile").orderBy(order)
    same = F.struct(*keys)
    opens = (F.row_number().over(inside) > 1) & ~same.eqNullSafe(F.lag(same).over(inside))
    local = rows.withColumn("_open", F.when(opens, F.col(order)))
    local = local.withColumn("_start", F.max("_open").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    per = local.groupBy(*within, "_tile").agg(F.min_by(same, order).alias("_first"), F.max_by(same, order).alias("_last"), F.min(order).alias("_at"), F.max("_start").alias("_inner"))
    tiles = Window.partitionBy(*(within or [F.lit(1)])).orderBy("_tile")  # a row a tile
    per = per.withColumn("_fresh", F.when(~F.col("_first").eqNullSafe(F.lag("_last").over(tiles)), F.col("_at")))
    earlier = F.max(F.greatest("_fresh", "_inner")).over(tiles.rowsBetween(Window.unboundedPreceding, -1))
    per = per.withColumn("_carry", F.coalesce("_fresh", earlier)).select(*[F.col(c).alias(f"_w{k}") for k, c in enumerate(within)], F.col("_tile").alias("_t"), "_carry")
    same_tile = [F.col(c).eqNullSafe(F.col(f"_w{k}")) for k, c in enumerate(within)]
    joined = local.join(per, [*same_tile, F.col("_tile") == F.col("_t")]).withColumn("start", F.coalesce("_start", "_carry"))
    return joined.groupBy(*within, *keys, "start").agg(F.count("*").alias("n"))

"""Queries on names, labels and contigs, and on files that are written by key or in order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import intervals
from tidemark.functions import reads as fn
from tidemark.operators import annotation, duplicates, segment
from tidemark.plans.registry import query
from tidemark.plans.relations import cte, load, relation
from tidemark.plans.shared import folder
from tidemark.plans.signals import ADJUSTED, _adjusted, _peaks_sql
from tidemark.sources import sinks, text

ENDING = intervals.CALL_SET_ENDINGS[0]


@query(f"""SELECT p_partkey, split_part(p_name || '/2', '/', 1) AS read_id, CASE WHEN p_size % 3 = 0 THEN 'autosome' WHEN p_size % 3 = 1 THEN 'chrX' ELSE 'chrMT' END AS category,
  replace(replace(p_brand || '::a/b', '/', '-'), '::', '-') AS file, replace(p_type, ' ', '-') AS cluster, replace(p_brand, '.', '') AS label, CAST(p_size AS VARCHAR) AS period,
  CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part""")
def op_functions_names(spark, sf_dir):
    """Read ids, contig categories, names of files, clusters, call sets and periods, strands of fragments."""
    rows = load(spark, sf_dir, "part")
    number = F.col("p_partkey").cast("string")
    chrom = F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_size") % 3 == 1, "X").otherwise("MT")
    flags = F.when(F.col("p_partkey") % 2 == 0, F.lit(64) + F.col("p_size") % 2 * 16).otherwise(F.lit(128) + F.col("p_size") % 2 * 32 + 16)
    cluster = F.concat(F.lit("c"), number, F.lit("-"), F.replace("p_type", F.lit(" "), F.lit("-")))
    return rows.select(
        "p_partkey", fn.base_id(F.concat("p_name", F.lit("/2"))).alias("read_id"), fn.chrom_category(chrom).alias("category"), intervals.file_name(F.concat("p_brand", F.lit("::a/b"))).alias("file"),
        intervals.cluster_label(cluster, number).alias("cluster"), intervals.call_set_label(F.concat("p_brand", F.lit(ENDING))).alias("label"), intervals.period_label(F.concat(F.lit("X"), F.col("p_size").cast("string"))).alias("period"),
        fn.fragment_strand(flags).alias("strand"),
    )


@query(cte("reads") + """
SELECT chrom, CASE WHEN CASE WHEN chrom % 2 = 0 THEN (flag & 32) <> 0 ELSE (flag & 16) <> 0 END THEN '-' ELSE '+' END AS strand, pos + 1 AS s, pos + 100 AS e FROM reads WHERE isize = 100""")
def op_reads_exact_length(spark, sf_dir):
    """Fragments of one length, on the strand of their first read."""
    rows = relation(spark, sf_dir, "reads").filter("isize = 100")
    flags = F.col("flag").bitwiseOR(F.when(F.col("chrom") % 2 == 0, 128).otherwise(64))
    start = F.col("pos") + 1
    return rows.select("chrom", fn.fragment_strand(flags).alias("strand"), start.alias("s"), (start + F.col("isize") - 1).alias("e"))


NAMED = "CASE chrom WHEN 6 THEN 'MT' WHEN 7 THEN 'X' WHEN 5 THEN 'GL000191' ELSE CAST(chrom AS VARCHAR(9)) END"


@query(_peaks_sql(False).replace(ADJUSTED, ADJUSTED.replace("adjusted AS (SELECT chrom, pos,", f"adjusted AS (SELECT {NAMED} AS chrom, pos,").replace("AS adj FROM medians)", f"AS adj FROM medians WHERE {NAMED} IN ('1', '2', '3', '4', 'X'))")))
def op_segment_peaks_listed(spark, sf_dir):
    """Peaks on the main contigs only."""
    rows = _adjusted(spark, sf_dir).withColumn("chrom", F.expr(NAMED))
    return segment.peaks(rows, "adj", ["chrom"], listed=intervals.main_contig(F.col("chrom")))


@query("""SELECT CAST(p_size % 7 + 1 AS VARCHAR) AS chrom, CAST(p_partkey AS BIGINT) AS start, CAST(p_partkey + p_size AS BIGINT) AS "end", 'T' || p_partkey AS transcript_id, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
  p_type AS biotype, 'G' || p_brand AS gene_id, 'N' || p_size AS gene_name FROM part WHERE p_partkey % 3 > 0 AND p_partkey % 5 = 0""")
def op_annotation_transcripts(spark, sf_dir):
    """The table of listed transcripts from an annotation file."""
    rows, path = load(spark, sf_dir, "part"), folder(spark, "gtf")
    names = "'gene_id \"G' || p_brand || '\"; transcript_id \"T' || p_partkey || '\"; gene_name \"N' || p_size || '\";'"
    feature = "CASE WHEN p_partkey % 3 > 0 THEN 'transcript' ELSE 'exon' END"
    rows.selectExpr(rf"concat_ws('\t', 'chr' || (p_size % 7 + 1), p_type, {feature}, p_partkey, p_partkey + p_size, '.', CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END, '.', {names}) AS value").write.text(path)
    return annotation.transcript_table(text.gtf(spark, path), rows.filter("p_partkey % 5 = 0").selectExpr("'T' || p_partkey AS transcript_id"))


@query("SELECT replace(replace(p_type || '::' || p_brand, '/', '-'), '::', '-') AS name, p_partkey, p_size FROM part")
def op_sinks_by_key(spark, sf_dir):
    """A folder of files for each factor, read back together."""
    path = folder(spark, "factors")
    sinks.write_by_key(load(spark, sf_dir, "part").select(F.concat("p_type", F.lit("::"), "p_brand").alias("name"), "p_partkey", "p_size"), "name", path, ["p_partkey"])
    return spark.read.csv(path, schema="p_partkey long, p_size int, name string", sep="\t", header=True).select("name", "p_partkey", "p_size")


@query(cte("reads") + """,
h AS (SELECT rg, CAST(least(isize, 110) AS BIGINT) AS length, count(*) AS n FROM reads GROUP BY ALL)
SELECT rg, length, n, row_number() OVER (PARTITION BY rg ORDER BY length) AS line_no FROM h""")
def op_sinks_read_groups(spark, sf_dir):
    """A table of lengths for each read group, its lines numbered."""
    rows = relation(spark, sf_dir, "reads").groupBy("rg", F.least("isize", F.lit(110)).cast("long").alias("length")).agg(F.count("*").alias("n"))
    path = folder(spark, "groups")
    sinks.write_by_key(sinks.numbered(rows, ["rg"], "length"), "rg", path, ["length"])
    return spark.read.csv(path, schema="length long, n long, line_no long, rg string", sep="\t", header=True).select("rg", "length", "n", "line_no")


@query(cte("hits") + """,
k AS (SELECT chrom, start_, end_, id, row_number() OVER (ORDER BY chrom, start_, end_, id) AS line_no FROM hits)
SELECT chrom, start_ AS start, end_ AS "end", id, line_no FROM k""")
def op_sinks_sorted(spark, sf_dir):
    """Intervals written in order of contig, start and end; lines are numbered over all part files in their order."""
    rows = relation(spark, sf_dir, "hits").selectExpr("chrom", "start_ AS start", "end_ AS `end`", "id")
    path, order = folder(spark, "sorted"), ["chrom", "start", "end", "id"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.csv(path, sep="\t")
    back = spark.read.csv(path, schema="chrom long, start long, `end` long, id long", sep="\t")
    split = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    back = back.select("*", *split).withColumn("at", F.monotonically_increasing_id())  # without gaps inside a split
    splits = back.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return back.join(splits, ["file", "split"]).select("chrom", "start", "end", "id", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"))


@query(cte("reads") + """
SELECT chrom, rg, CAST(count(*) + sum(xp) AS BIGINT) AS xp, count(*) AS reads FROM (SELECT chrom, pos // 200 AS bin, rg, xp FROM reads) GROUP BY chrom, bin, rg HAVING count(*) + sum(xp) >= 4""")
def op_duplicates_min_count(spark, sf_dir):
    """Groups that stand for at least four reads, earlier counts included."""
    rows = relation(spark, sf_dir, "reads").selectExpr("chrom", "pos div 200 AS bin", "rg", "rid", "qname", "'c' AS cigar", "xp")
    out = duplicates.representative(rows, ["chrom", "bin", "rg"], "rid", "qname", "cigar", F.col("rid") % 97, F.col("xp"), min_count=4)
    return out.select("chrom", "rg", F.col("xp").cast("long").alias("xp"), "reads")

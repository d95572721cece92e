"""Queries on intervals: merging, splitting, grids, spacing bins, sinks' layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import annotation, segment, stats
from tidemark.plans.registry import query
from tidemark.plans.relations import cte, relation
from tidemark.sources import sinks


@query(cte("hits") + """,
o AS (SELECT *, max(end_) OVER (PARTITION BY cluster, chrom ORDER BY start_, end_, strand, shift ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hits),
i AS (SELECT *, sum(CASE WHEN reach > start_ THEN 0 ELSE 1 END) OVER (PARTITION BY cluster, chrom ORDER BY start_, end_, strand, shift ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT cluster, chrom, min(start_) AS start_, max(end_) AS end_, count(*) AS n, arg_min(strand, (start_, end_, strand, shift)) AS strand, arg_min(shift, (start_, end_, strand, shift)) AS shift FROM i GROUP BY cluster, chrom, k""")
def op_segment_merge_intervals(spark, sf_dir):
    rows = relation(spark, sf_dir, "hits")
    return segment.merge_intervals(rows, ["cluster", "chrom"], "start_", "end_", ["strand", "shift"], ["strand", "shift"])


@query(cte("regions") + """
SELECT cid, chrom, lo AS lo, least(hi, lo + 300) AS hi FROM (SELECT cid, chrom, hi, unnest(range(lo, hi, 300)) AS lo FROM regions)""")
def op_segment_split_intervals(spark, sf_dir):
    return segment.split_intervals(relation(spark, sf_dir, "regions").select("cid", "chrom", "lo", "hi"), "lo", "hi", 300)


SPACING = cte("fragments") + """,
lengths AS (SELECT chrom, max(e) AS length FROM fragments GROUP BY chrom),
grid AS (SELECT chrom, unnest(range(0, length, 1500)) AS start, length FROM lengths),
peaks AS (SELECT DISTINCT chrom, s AS pos FROM fragments WHERE e - s >= 167),
gaps AS (SELECT chrom, CASE WHEN pos = 0 THEN 0 ELSE (pos - 1) // 1500 END * 1500 AS start, pos - lag(pos) OVER (PARTITION BY chrom, CASE WHEN pos = 0 THEN 0 ELSE (pos - 1) // 1500 END ORDER BY pos) AS d FROM peaks),
m AS (SELECT chrom, start, median(d)::DOUBLE AS median FROM gaps WHERE d BETWEEN 120 AND 280 GROUP BY ALL)"""


def _spacing(spark, sf_dir):
    frags = relation(spark, sf_dir, "fragments")
    peaks = frags.filter("e - s >= 167").selectExpr("chrom", "s AS pos").distinct()
    return stats.spacing_bins(peaks, frags.groupBy("chrom").agg(F.max("e").alias("length")), "chrom", "pos", "length", 1500)


@query(SPACING + "\nSELECT g.chrom, g.start, least(g.start + 1500, g.length) AS stop, m.median FROM grid g LEFT JOIN m ON g.chrom = m.chrom AND g.start = m.start")
def op_stats_spacing_bins(spark, sf_dir):
    return _spacing(spark, sf_dir)


@query(cte("fragments") + "\nSELECT chrom, s // 500 * 500 AS start, count(*) AS n FROM fragments GROUP BY ALL")
def op_stats_bin_counts(spark, sf_dir):
    return stats.bin_counts(relation(spark, sf_dir, "fragments"), ["chrom"], "s", 500)


@query(cte("fragments") + """,
c AS (SELECT chrom, s // 500 * 500 AS start, count(*) AS n, sum(CASE WHEN strand = 'F' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS share FROM fragments GROUP BY ALL)
SELECT chrom, round(regr_slope(n, share), 5) AS slope, round(regr_intercept(n, share), 5) AS intercept, round(regr_r2(n, share), 6) AS r2, regr_count(n, share) AS n FROM c GROUP BY chrom""")
def op_stats_regression(spark, sf_dir):
    rows = relation(spark, sf_dir, "fragments").groupBy("chrom", (F.floor(F.col("s") / 500) * 500).alias("start")).agg(F.count("*").alias("k"), (F.count_if(F.col("strand") == "F") / F.count("*")).alias("share"))
    out = stats.regression(rows, "k", "share", ["chrom"])
    return out.select("chrom", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@query(cte("hits") + """
SELECT 'chr' || chrom AS chrom, start_ - 1 AS start0, end_ AS "end", chrom || ':' || start_ || '-' || end_ AS name, shift AS score, '+' AS strand, (start_ + end_) // 2 - 1 AS mid0, (start_ + end_) // 2 AS mid FROM hits""")
def op_sinks_bed_rows(spark, sf_dir):
    rows = relation(spark, sf_dir, "hits").selectExpr("chrom", "start_ AS start", "end_ AS end", "shift AS score", "(start_ + end_) div 2 AS mid")
    return sinks.bed_rows(rows)


@query(cte("fragments") + """,
p AS (SELECT chrom, s AS pos, count(*) AS n FROM fragments GROUP BY ALL),
m AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) = 1 THEN 0 ELSE 1 END AS opens FROM p),
b AS (SELECT *, sum(opens) OVER (PARTITION BY chrom ORDER BY pos) AS k FROM m)
SELECT chrom, min(pos) OVER (PARTITION BY chrom, k) AS block, pos AS at, CAST(n AS VARCHAR) AS line FROM b
UNION ALL SELECT chrom, min(pos), min(pos) - 1, 'fixedStep chrom=chr' || chrom || ' start=' || min(pos) || ' step=1' FROM b GROUP BY chrom, k""")
def op_sinks_wig_lines(spark, sf_dir):
    rows = relation(spark, sf_dir, "fragments").groupBy("chrom", F.col("s").alias("pos")).agg(F.count("*").alias("n"))
    return sinks.wig_lines(rows, "n")


MOTIFS = cte("hits") + ",\nmotifs AS (SELECT n_name AS label, CAST(n_nationkey AS BIGINT) AS pwm, r_name AS cluster, CASE WHEN n_nationkey % 2 = 0 THEN '+' ELSE '-' END AS motif_strand, n_nationkey % 7 AS off FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 3)"


def _motifs(spark, sf_dir):
    from tidemark.plans.relations import load

    motifs = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).filter("n_nationkey <> 3")
    motifs = motifs.selectExpr("CAST(n_nationkey AS BIGINT) AS pwm", "r_name AS cluster", "CASE WHEN n_nationkey % 2 = 0 THEN '+' ELSE '-' END AS motif_strand", "n_nationkey % 7 AS offset")
    hits = relation(spark, sf_dir, "hits").selectExpr("chrom", "start_ AS start", "end_ AS end", "id % 25 AS pwm", "strand", "id")
    return hits, motifs


@query(MOTIFS + """,
h AS (SELECT m.cluster, h.chrom, start_ AS start, end_, strand, CASE WHEN motif_strand <> strand THEN end_ - start_ - off ELSE off END AS off FROM hits h JOIN motifs m ON h.id % 25 = m.pwm),
o AS (SELECT *, max(end_) OVER (PARTITION BY cluster, chrom ORDER BY start, end_, strand, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h),
i AS (SELECT *, sum(CASE WHEN reach > start THEN 0 ELSE 1 END) OVER (PARTITION BY cluster, chrom ORDER BY start, end_, strand, off ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT cluster, chrom, min(start) AS start, max(end_) AS "end", count(*) AS n, arg_min(strand, (start, end_, strand, off)) AS strand, arg_min(off, (start, end_, strand, off)) AS "offset" FROM i GROUP BY cluster, chrom, k""")
def op_annotation_unify_motifs(spark, sf_dir):
    return annotation.unify_motifs(annotation.motif_hits(*_motifs(spark, sf_dir))[0])


@query(MOTIFS + "\nSELECT id FROM hits WHERE id % 25 NOT IN (SELECT pwm FROM motifs)")
def op_annotation_unknown_motifs(spark, sf_dir):
    return annotation.motif_hits(*_motifs(spark, sf_dir))[1].select("id")

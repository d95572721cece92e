"""Queries on tables that meet by name or by bin: expression, bins, carried columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import intervals
from tidemark.operators import joins, sequence, stats
from tidemark.plans.registry import query
from tidemark.plans.relations import cte, load, relation
from tidemark.plans.statistics import MATRIX, _logs

SPECTRA = MATRIX + """,
s AS (SELECT l_partkey AS gene, 190 + 3 * l_linenumber AS period, avg(l_discount) AS power FROM lineitem GROUP BY ALL),
means AS (SELECT gene, avg(power) AS power FROM s WHERE period IN (193, 196, 199) GROUP BY gene HAVING count(*) = 3),
labels AS (SELECT * FROM (VALUES (1995, 'liver'), (1996, 'brain'), (1998, 'skin')) t(tissue, label))"""


def _spectra(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("gene"), (190 + 3 * F.col("l_linenumber")).alias("period")).agg(F.avg("l_discount").alias("power"))


@query(SPECTRA + "\nSELECT tissue, label, round(corr(power, v), 6) AS r, count(*) AS n FROM logs JOIN means USING (gene) LEFT JOIN labels USING (tissue) GROUP BY ALL")
def op_stats_period_means(spark, sf_dir):
    means = stats.mean_of_periods(_spectra(spark, sf_dir), "gene", "period", "power").withColumn("of", F.lit("mean"))
    found = stats.correlate(means, _logs(spark, sf_dir), "gene", "of", "tissue", "power", "v")
    labels = spark.createDataFrame([(1995, "liver"), (1996, "brain"), (1998, "skin")], "tissue int, label string")
    return stats.labelled(found, labels, "tissue").select("tissue", "label", F.round("r", 6).alias("r"), "n")


@query(SPECTRA + "\nSELECT gene, period, round(power, 9) AS power FROM s WHERE gene IN (SELECT gene FROM kept)")
def op_joins_known_spectra(spark, sf_dir):
    known = _logs(spark, sf_dir).select("gene").distinct()
    return joins.members(_spectra(spark, sf_dir), known, "gene").select("gene", "period", F.round("power", 9).alias("power"))


BINS = cte("fragments") + """,
counts AS (SELECT chrom, s // 500 * 500 AS start, count(*) AS n FROM fragments GROUP BY ALL),
gc AS (SELECT chrom, start, (chrom * 31 + start // 500) % 3 AS ncount, (start // 500 * 17 % 100) / 100.0::DOUBLE AS gcperc FROM counts),
maps AS (SELECT chrom, start, (start // 500 * 7 % 10) / 10.0::DOUBLE AS map FROM counts WHERE start % 1500 = 0 OR chrom < 5),
comps AS (SELECT chrom, start, CASE WHEN start // 2000 % 2 = 0 THEN 'A1' ELSE 'B2' END AS compartment FROM counts WHERE chrom <> 6)"""


def _bins(spark, sf_dir):
    counts = stats.bin_counts(relation(spark, sf_dir, "fragments"), ["chrom"], "s", 500)
    gc = counts.selectExpr("chrom", "start", "(chrom * 31 + start div 500) % 3 AS ncount", "(start div 500 * 17 % 100) / 100D AS gcperc")
    maps = counts.filter("start % 1500 = 0 OR chrom < 5").selectExpr("chrom", "start", "(start div 500 * 7 % 10) / 10D AS map")
    comps = counts.filter("chrom <> 6").selectExpr("chrom", "start", "CASE WHEN start div 2000 % 2 = 0 THEN 'A1' ELSE 'B2' END AS compartment")
    return counts, gc, maps, comps


@query(BINS + "\nSELECT chrom, start, n, gcperc, map FROM gc JOIN counts USING (chrom, start) JOIN maps USING (chrom, start) WHERE ncount < 1 AND map >= 0.5 AND chrom <= 5")
def op_joins_bin_tables(spark, sf_dir):
    counts, gc, maps, _ = _bins(spark, sf_dir)
    rows = stats.same_bins(gc, counts, maps).filter(intervals.mappable(F.col("ncount"), F.col("map")) & (F.col("chrom") <= 5))
    return rows.select("chrom", "start", "n", "gcperc", "map")


@query(BINS + "\nSELECT compartment, count(*) AS bins, CAST(sum(n) AS BIGINT) AS n FROM counts JOIN comps USING (chrom, start) GROUP BY compartment")
def op_joins_compartments(spark, sf_dir):
    counts, _, _, comps = _bins(spark, sf_dir)
    return stats.same_bins(counts, comps).groupBy("compartment").agg(F.count("*").alias("bins"), F.sum("n").alias("n"))


@query(cte("fragments", "sites") + """,
targets AS (SELECT DISTINCT chrom, s AS t FROM fragments WHERE e - s >= 167)
SELECT site, site % 100 AS percentile, (SELECT max(t) FROM targets WHERE targets.chrom = sites.chrom AND t <= c) AS before, (SELECT min(t) FROM targets WHERE targets.chrom = sites.chrom AND t > c) AS after FROM sites""")
def op_joins_carried_percentile(spark, sf_dir):
    targets = relation(spark, sf_dir, "fragments").filter("e - s >= 167").selectExpr("chrom", "s AS t")
    points = relation(spark, sf_dir, "sites").selectExpr("site", "site % 100 AS percentile", "chrom", "c")
    return joins.nearest(points, targets, "chrom", "c", "t").select("site", "percentile", "before", "after")


@query("""WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS gene FROM customer), b AS (SELECT DISTINCT lower(c_mktsegment) AS gene, length(c_mktsegment) AS size FROM customer)
SELECT c_custkey, upper(a.gene) AS gene, size FROM a JOIN b ON upper(a.gene) = upper(b.gene)""")
def op_joins_upper_key(spark, sf_dir):
    rows = load(spark, sf_dir, "customer")
    a = rows.selectExpr("c_custkey", "CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS g").select("c_custkey", intervals.merge_key(F.col("g")).alias("gene"))
    b = rows.selectExpr("lower(c_mktsegment) AS g", "length(c_mktsegment) AS size").distinct().select(intervals.merge_key(F.col("g")).alias("gene"), "size")
    return joins.look_up(a, b, ["gene"]).select("c_custkey", "gene", "size")


@query(cte("sites", "regions") + "\nSELECT cid, lo - (hi - lo) / 2.0::DOUBLE AS mid, lo % 200 - 26 AS \"offset\" FROM regions")
def op_functions_centred(spark, sf_dir):
    rows = relation(spark, sf_dir, "regions")
    return rows.select("cid", intervals.reflected_mid(F.col("lo"), F.col("hi")).alias("mid"), intervals.centred(F.col("lo") % 200).alias("offset"))


@query("""WITH d AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT o_custkey % 7 AS k, count(*) AS n FROM orders GROUP BY 1),
b AS (SELECT n FROM d UNION ALL SELECT n FROM c) SELECT max(n) AS most, min(n) AS least, CAST(sum(n) AS BIGINT) AS total FROM b""")
def op_stats_axis_range(spark, sf_dir):
    """One range over data and control."""
    per = lambda key: load(spark, sf_dir, "orders").groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    return stats.extent(per(F.col("o_custkey")), "n", per(F.col("o_custkey") % 7))


@query("SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 100")
def op_stats_first_rows(spark, sf_dir):
    """The first hundred rows: the limit is the feature."""
    return stats.first_rows(load(spark, sf_dir, "events").select("event_id", "event_type", "value"), 100, "event_id")


@query("""WITH q AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents), p AS (SELECT doc_id, seq, unnest([40, 255, 512]) AS pos FROM q)
SELECT doc_id, pos, CASE WHEN pos > 30 AND pos + 30 <= length(seq) THEN substr(seq, pos - 30, 61) END AS context FROM p""")
def op_sequence_context(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chrom"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))
    chunks = sequence.chunk_sequence(rows, ["chrom"], "seq", 256, 64)
    points = rows.select("chrom", F.explode(F.array(*map(F.lit, (40, 255, 512)))).alias("pos"))
    return sequence.context(points, chunks, "chrom", "pos", 30, 256).select(F.col("chrom").alias("doc_id"), "pos", "context")

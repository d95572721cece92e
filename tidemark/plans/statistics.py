"""Queries on scores, ranks, histograms, matrices and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.intervals import log2_floor, ratio_or_zero
from tidemark.operators import overlay, spectral, stats, windows
from tidemark.plans.registry import query
from tidemark.plans.relations import cte, load, relation


@query("""
WITH pts AS (SELECT unnest(range(1, 101)) AS k),
g AS (SELECT k, (SELECT quantile_cont(o_totalprice::DOUBLE, [""" + ", ".join(f"{k / 100.0!r}" for k in range(1, 101)) + """]) FROM orders)[k] AS q FROM pts)
SELECT o_orderkey, CAST(least(99, (SELECT count(*) FROM g WHERE q <= o_totalprice)) AS INT) AS percentile FROM orders""")
def op_stats_percentile_buckets(spark, sf_dir):
    return stats.percentile_buckets(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "percentile")


@query("""
WITH g AS (SELECT o_orderpriority AS p, quantile_cont(o_totalprice::DOUBLE, [""" + ", ".join(f"{k / 100.0!r}" for k in range(1, 101)) + """]) AS q FROM orders GROUP BY o_orderpriority)
SELECT o_orderkey, CAST(least(99, len(list_filter(q, lambda x: x <= o_totalprice))) AS INT) AS percentile FROM orders JOIN g ON p = o_orderpriority""")
def op_stats_percentiles_by_key(spark, sf_dir):
    """Percentiles inside each of a few large groups."""
    return stats.percentile_buckets(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_totalprice", ["o_orderpriority"]).select("o_orderkey", "percentile")


@query("""
WITH v AS (SELECT c_custkey, c_mktsegment AS s, greatest(c_acctbal, 0)::DOUBLE AS v FROM customer),
q AS (SELECT s, quantile_cont(v, [0.25, 0.5, 0.75]) AS q FROM v GROUP BY s)
SELECT c_custkey, CAST(1 + (v > q[1])::INT + (v > q[2])::INT + (v > q[3])::INT AS INT) AS bin FROM v JOIN q USING (s)""")
def op_stats_bins_by_key(spark, sf_dir):
    """Quartiles inside each segment, ties together."""
    rows = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.greatest("c_acctbal", F.lit(0.0)).alias("v"))
    return stats.quantile_bins(rows, "v", 4, ["c_mktsegment"]).select("c_custkey", "bin")


@query("""
WITH v AS (SELECT c_custkey, greatest(c_acctbal, 0)::DOUBLE AS v FROM customer),
q AS (SELECT quantile_cont(v, [0.2, 0.4, 0.6, 0.8]) AS q FROM v)
SELECT c_custkey, CAST(1 + (v > q[1])::INT + (v > q[2])::INT + (v > q[3])::INT + (v > q[4])::INT AS INT) AS bin FROM v, q""")
def op_stats_quantile_bins(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.greatest("c_acctbal", F.lit(0.0)).alias("v"))
    return stats.quantile_bins(rows, "v").select("c_custkey", "bin")


@query("""
WITH t AS (SELECT c_custkey, c_mktsegment, round(c_acctbal / 100, 0) AS v FROM customer)
SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY v) + (count(*) OVER (PARTITION BY c_mktsegment, v) - 1) / 2.0::DOUBLE AS avg_rank FROM t""")
def op_windows_average_rank(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.round(F.col("c_acctbal") / 100, 0).alias("v"))
    return windows.average_rank(rows, "v", ["c_mktsegment"]).select("c_custkey", "avg_rank")


@query("""
WITH r AS (SELECT c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT c_mktsegment, round(avg(c_acctbal), 4) AS trimmed FROM r WHERE k > floor(n * 0.1) AND k <= n - floor(n * 0.1) GROUP BY c_mktsegment""")
def op_windows_trimmed_mean(spark, sf_dir):
    return windows.trimmed_mean(load(spark, sf_dir, "customer"), "c_acctbal", ["c_mktsegment"]).withColumn("trimmed", F.round("trimmed", 4))


@query("SELECT event_id, user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS distance FROM events")
def op_windows_lag_distance(spark, sf_dir):
    return windows.lag_distance(load(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], "event_id")


@query("""
WITH c AS (SELECT event_type, floor(value / 25) * 25 AS start, count(*) AS n FROM events WHERE value >= 0 AND value < 500 GROUP BY ALL)
SELECT event_type, start, n, round(n / sum(n) OVER (PARTITION BY event_type)::DOUBLE, 9) AS share FROM c""")
def op_stats_histogram(spark, sf_dir):
    rows = stats.histogram(load(spark, sf_dir, "events"), ["event_type"], "value", 0, 500, 25)
    return rows.select("event_type", F.col("start").cast("double").alias("start"), "n", F.round("share", 9).alias("share"))


@query("""
WITH h AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS v, count(*) AS n FROM events GROUP BY ALL),
grid AS (SELECT unnest(range(0, 501, 10)) AS x)
SELECT event_type, x, round(sum(n * exp(-((x - v) / 12.0::DOUBLE) * ((x - v) / 12.0::DOUBLE) / 2) / (12.0::DOUBLE * sqrt(2 * 3.141592653589793::DOUBLE))) / (SELECT sum(n) FROM h k WHERE k.event_type = h.event_type), 9) AS density
FROM h JOIN grid ON x // 10 BETWEEN v // 10 - 5 AND v // 10 + 5 GROUP BY event_type, x""")
def op_stats_density(spark, sf_dir):
    rows = load(spark, sf_dir, "events").groupBy("event_type", F.floor("value").alias("v")).agg(F.count("*").alias("n"))
    return stats.density(rows, ["event_type"], "v", "n", 0, 500, 10, 12).select("event_type", "x", F.round("density", 9).alias("density"))


MATRIX = cte("cells") + """,
m AS (SELECT gene, tissue, round(sum(q) / 10.0::DOUBLE, 1) AS fpkm FROM cells GROUP BY ALL),
kept AS (SELECT gene FROM m GROUP BY gene HAVING count(*) FILTER (fpkm <> 0) >= 3),
logs AS (SELECT gene, tissue, log2(CASE WHEN fpkm = 0 THEN 0.04 ELSE fpkm END::DOUBLE) AS v FROM m WHERE gene IN (SELECT gene FROM kept))"""


def _logs(spark, sf_dir):
    rows = relation(spark, sf_dir, "cells").groupBy("gene", "tissue").agg(F.round(F.sum("q") / F.lit(10.0), 1).alias("fpkm"))
    return stats.expressed(rows, "gene", "fpkm").select("gene", "tissue", log2_floor(F.col("fpkm")).alias("v"))


@query(MATRIX + "\nSELECT gene, tissue, round(v, 9) AS v FROM logs")
def op_stats_expressed(spark, sf_dir):
    return _logs(spark, sf_dir).withColumn("v", F.round("v", 9))


@query(MATRIX + """,
s AS (SELECT l_partkey AS gene, l_linenumber AS period, avg(l_discount) AS power FROM lineitem GROUP BY ALL)
SELECT period, tissue, round(corr(power, v), 6) AS r, count(*) AS n FROM logs JOIN s USING (gene) GROUP BY ALL""")
def op_stats_correlate(spark, sf_dir):
    spectra = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("gene"), F.col("l_linenumber").alias("period")).agg(F.avg("l_discount").alias("power"))
    rows = stats.correlate(spectra, _logs(spark, sf_dir), "gene", "period", "tissue", "power", "v")
    return rows.select("period", "tissue", F.round("r", 6).alias("r"), "n")


@query(MATRIX + """
SELECT gene, """ + ", ".join(f"round(max(v) FILTER (tissue = {y}), 9) AS y{y}" for y in range(1995, 2002)) + " FROM logs GROUP BY gene")
def op_overlay_matrix(spark, sf_dir):
    rows = _logs(spark, sf_dir).select("gene", F.concat(F.lit("y"), "tissue").alias("tissue"), F.round("v", 9).alias("v"))
    return overlay.wide(rows, ["gene"], "tissue", "v", [f"y{y}" for y in range(1995, 2002)])


@query("""WITH w AS (SELECT p_partkey, p_size::DOUBLE AS size, p_retailprice::DOUBLE AS price FROM part)
SELECT p_partkey, 'size' AS measure, size AS v FROM w UNION ALL SELECT p_partkey, 'price', price FROM w""")
def op_overlay_long(spark, sf_dir):
    rows = load(spark, sf_dir, "part").selectExpr("p_partkey", "CAST(p_size AS DOUBLE) AS size", "CAST(p_retailprice AS DOUBLE) AS price")
    return overlay.long(rows, ["p_partkey"], ["size", "price"], "measure", "v")


@query("""WITH c AS (SELECT c_nationkey, count(*) AS n, sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) AS k FROM customer GROUP BY 1)
SELECT n_nationkey, round(coalesce(k / nullif(n, 0)::DOUBLE, 0), 9) AS ratio FROM nation LEFT JOIN c ON n_nationkey = c_nationkey""")
def op_functions_ratio(spark, sf_dir):
    per = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 5000).alias("k"))
    rows = load(spark, sf_dir, "nation").join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.select("n_nationkey", F.round(ratio_or_zero(F.col("k"), F.col("n")), 9).alias("ratio"))


def _dft_sql() -> str:
    powers = ", ".join(f"round((pow(sum(x * cos(t * (2 * pi() / {p}))), 2) + pow(sum(x * sin(t * (2 * pi() / {p}))), 2)) / count(*), 5) AS p{p}" for p in (4, 8, 16))
    return f"WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS t FROM embeddings) SELECT vec_id, {powers} FROM e GROUP BY vec_id"


@query(_dft_sql())
def op_spectral_dft(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").withColumn("p", spectral.dft_power(F.col("embedding"), [4, 8, 16]))
    return rows.select("vec_id", *[F.round(F.col("p")[k], 5).alias(f"p{n}") for k, n in enumerate((4, 8, 16))])


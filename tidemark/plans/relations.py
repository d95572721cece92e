"""The domain's relations as projections of the driver tables, in expressions that both engines read alike.

One row of lineitem is a fragment; positions are 1..20200 on seven contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LO, HI = 1, 20_200
_S = "(l_orderkey * 37 + l_partkey * 11) % 20000 + 1"
_ROW = "l_orderkey * 8 + l_linenumber"

RELATIONS: dict[str, tuple[str, list[str]]] = {
    "fragments": ("lineitem", ["l_linenumber AS chrom", f"{_S} AS s", f"{_S} + 119 + CAST(l_quantity AS BIGINT) AS e", "l_returnflag AS rg", "l_linestatus AS strand"]),
    "short_fragments": ("lineitem", ["l_linenumber AS chrom", f"{_S} AS s", f"{_S} + 34 + CAST(l_quantity AS BIGINT) % 46 AS e"]),
    "reads": ("lineitem", [
        "l_orderkey AS qid", "l_linenumber AS chrom", f"{_S} - 1 AS pos", f"{_S} + 40 + CAST(l_quantity AS BIGINT) AS mate_pos", "CAST(l_quantity AS BIGINT) + 76 AS isize",
        "CAST(l_suppkey % 2 * 16 + l_partkey % 3 % 2 * 1 + l_orderkey % 7 % 2 * 4 * (l_linenumber % 2) + l_partkey % 11 % 2 * 512 * (l_suppkey % 2) + l_suppkey % 13 % 2 * 1024 * (l_partkey % 2) + 64 * (l_linenumber % 2) AS INT) AS flag",
        "l_returnflag AS rg", "50 + CAST(l_quantity AS INT) AS qlen", "CASE l_partkey % 3 WHEN 0 THEN 'M_' WHEN 1 THEN 'T_' ELSE '' END || CAST(l_orderkey AS VARCHAR(20)) AS qname", f"{_ROW} AS rid", "CAST(l_tax * 100 AS INT) AS xp",
    ]),
    "sites": ("part", ["p_partkey AS site", "p_type AS name", "CAST(p_size % 7 + 1 AS INT) AS chrom", "(p_partkey * 97) % 20000 + 1 AS c", "CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand"]),
    "regions": ("supplier", ["s_suppkey AS cid", "CAST(s_nationkey % 7 + 1 AS INT) AS chrom", "(s_suppkey * 191) % 18000 + 1 AS lo", "(s_suppkey * 191) % 18000 + 1000 AS hi", "CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand"]),
    "hits": ("events", ["event_type AS cluster", "user_id AS chrom", "event_id * 13 % 5000 + 1 AS start_", "event_id * 13 % 5000 + 2 + CAST(floor(value) AS BIGINT) % 40 AS end_", "CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand", "event_id % 9 AS shift", "event_id AS id"]),
    "cells": ("lineitem", ["l_partkey AS gene", "CAST(year(l_shipdate) AS INT) AS tissue", "CAST(l_quantity AS BIGINT) AS q"]),
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = RELATIONS[name]
    return load(spark, sf_dir, table).selectExpr(*columns)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cte(*names: str) -> str:
    """The same relations for DuckDB, as the head of a WITH clause."""
    return "WITH " + ",\n".join(f"{n} AS (SELECT {', '.join(RELATIONS[n][1])} FROM {RELATIONS[n][0]})" for n in names)


def track_cte(source: str = "fragments", p: int = 60, name: str = "track") -> str:
    """The full track of a relation by running sums over its changes."""
    return f""",
{name}_changes AS (
  SELECT chrom, s AS pos, 1 AS cov, 0 AS wps FROM {source} UNION ALL SELECT chrom, e + 1, -1, 0 FROM {source}
  UNION ALL SELECT chrom, s - {p} + 1, 0, -1 FROM {source} UNION ALL SELECT chrom, e + {p}, 0, 1 FROM {source}
  UNION ALL SELECT chrom, s + {p}, 0, 2 FROM {source} WHERE e - s >= {2 * p} UNION ALL SELECT chrom, e - {p} + 1, 0, -2 FROM {source} WHERE e - s >= {2 * p}
  UNION ALL SELECT chrom, unnest(range({LO}, {HI} + 1)), 0, 0 FROM (SELECT DISTINCT chrom FROM {source})),
{name}_sums AS (SELECT chrom, pos, sum(cov) AS cov, sum(wps) AS wps FROM {name}_changes GROUP BY ALL),
{name}_ends AS (SELECT chrom, pos, count(*) AS ends FROM (SELECT chrom, s AS pos FROM {source} UNION ALL SELECT chrom, e FROM {source}) GROUP BY ALL),
{name} AS (
  SELECT r.chrom, r.pos, cov, coalesce(ends, 0) AS ends, wps
  FROM (SELECT chrom, pos, CAST(sum(cov) OVER w AS BIGINT) AS cov, CAST(sum(wps) OVER w AS BIGINT) AS wps FROM {name}_sums WINDOW w AS (PARTITION BY chrom ORDER BY pos)) r
  LEFT JOIN {name}_ends d ON r.chrom = d.chrom AND r.pos = d.pos WHERE r.pos BETWEEN {LO} AND {HI})"""

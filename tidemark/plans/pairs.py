"""Queries on mates, contigs and the whole duplicate collapse."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import intervals
from tidemark.functions import reads as fn
from tidemark.operators import duplicates, stats
from tidemark.plans.registry import query
from tidemark.plans.relations import cte, load, relation

MATES = cte("reads") + """,
m AS (SELECT *, flag | CASE WHEN rid % 17 = 0 THEN 8 ELSE 0 END | CASE WHEN chrom % 2 = 0 THEN 128 ELSE 0 END AS flags,
  CASE WHEN rid % 5 = 0 THEN chrom % 7 + 1 ELSE chrom END AS mate_chrom, CASE WHEN rid % 23 = 0 THEN NULL ELSE qlen || 'M' END AS cigar, CASE WHEN rid % 29 = 0 THEN NULL ELSE 'I' END AS qual FROM reads)"""


def _mates(spark, sf_dir):
    return relation(spark, sf_dir, "reads").selectExpr(
        "*", "flag | CASE WHEN rid % 17 = 0 THEN 8 ELSE 0 END | CASE WHEN chrom % 2 = 0 THEN 128 ELSE 0 END AS flags", "CASE WHEN rid % 5 = 0 THEN chrom % 7 + 1 ELSE chrom END AS mate_chrom",
        "CASE WHEN rid % 23 = 0 THEN NULL ELSE qlen || 'M' END AS cigar", "CASE WHEN rid % 29 = 0 THEN NULL ELSE 'I' END AS qual",
    )


@query(MATES + "\nSELECT rid, chrom FROM m WHERE (flags & 8) = 0 AND chrom = mate_chrom AND cigar IS NOT NULL AND qual IS NOT NULL")
def op_reads_valid_pairs(spark, sf_dir):
    rows = _mates(spark, sf_dir)
    return rows.filter(fn.mate_valid(F.col("flags"), F.col("chrom"), F.col("mate_chrom")) & fn.complete(F.col("cigar"), F.col("qual"))).select("rid", "chrom")


@query(MATES + """
SELECT (flags & 64) <> 0 AS first, count(*) AS n, count(*) FILTER ((flags & 64) <> 0 OR (flags & 128) <> 0 AND mate_pos + qlen < 9000) AS in_region FROM m GROUP BY ALL""")
def op_reads_counted_mates(spark, sf_dir):
    once = fn.counts_once(F.col("flags"), F.col("mate_pos"), F.col("qlen"), 9000)
    rows = _mates(spark, sf_dir).select(fn.counts_once(F.col("flags"), F.col("mate_pos"), F.col("qlen")).alias("first"), once.alias("once"))
    return rows.groupBy("first").agg(F.count("*").alias("n"), F.count_if("once").alias("in_region"))


NAMES = "CASE l_linenumber WHEN 1 THEN '1' WHEN 2 THEN 'X' WHEN 3 THEN 'MT' WHEN 4 THEN 'GL000191.1' WHEN 5 THEN 'NC_007605' WHEN 6 THEN '22' ELSE 'hs37d5' END"


@query(f"SELECT chrom, count(*) AS n, count(*) FILTER (chrom = '1' OR chrom = '22') AS autosomal FROM (SELECT {NAMES} AS chrom FROM lineitem) WHERE chrom IN ('1', 'X', '22') GROUP BY chrom")
def op_reads_main_contigs(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").selectExpr(f"{NAMES} AS chrom").filter(intervals.main_contig(F.col("chrom")))
    return rows.groupBy("chrom").agg(F.count("*").alias("n"), F.count_if(intervals.main_contig(F.col("chrom"), True)).alias("autosomal"))


@query(cte("fragments") + """,
w AS (SELECT chrom, e - s + 1 AS n, s + CAST(floor((s * 7919 + e) % 1009 / 1009.0::DOUBLE * 11) AS BIGINT) - 5 AS s2, CAST(floor((s * 31 + e * 17) % 1013 / 1013.0::DOUBLE * 11) AS BIGINT) - 5 AS move FROM fragments)
SELECT chrom, s2 AS s, s2 + n - 1 + move AS e, count(*) AS n FROM w GROUP BY ALL""")
def op_reads_wiggled_ends(spark, sf_dir):
    s, e = F.col("s"), F.col("e")
    moved = fn.wiggle(s, e - s + 1, (s * 7919 + e) % 1009 / F.lit(1009.0), (s * 31 + e * 17) % 1013 / F.lit(1013.0))
    return relation(spark, sf_dir, "fragments").select("chrom", moved.alias("f")).groupBy("chrom", "f.s", "f.e").agg(F.count("*").alias("n"))


@query(cte("reads") + "\nSELECT coalesce(CASE WHEN qid % 5 = 0 THEN 'U' || qid % 3 END, CASE WHEN rg = 'R' THEN 'libR' END, rg) AS grp, count(*) AS n FROM reads GROUP BY 1")
def op_duplicates_groups(spark, sf_dir):
    rows = relation(spark, sf_dir, "reads")
    umi, library = F.expr("CASE WHEN qid % 5 = 0 THEN 'U' || qid % 3 END"), F.expr("CASE WHEN rg = 'R' THEN 'libR' END")
    return rows.groupBy(fn.library_group(F.col("rg"), library, umi).alias("grp")).agg(F.count("*").alias("n"))


ALIGNED = [
    "CASE WHEN qid % 5 = 0 THEN 'U' || qid % 3 ELSE 'L' || qid % 4 END AS grp", "chrom % 2 = 1 AS is_read1", "(flag & 16) <> 0 AS reverse", "qlen AS ref_len", "(flag & 4) <> 0 AS unmapped", "rid % 17 = 0 AS mate_unmapped",
    "(flag & 512) <> 0 AS qcfail", "(flag & 1) <> 0 AS paired", "CAST(qlen AS VARCHAR(9)) || CASE WHEN rid % 4 = 0 THEN 'M2D' ELSE 'M' END AS cigar", "rid % 97 AS quality", "chrom", "pos", "rid",
]


@query(cte("reads") + f""",
r AS (SELECT {', '.join(ALIGNED)}, qname || '/' || (chrom - 1) // 2 AS qname FROM reads),
ok AS (SELECT *, pos + CASE WHEN reverse THEN ref_len ELSE 0 END AS outer_ FROM r WHERE NOT qcfail),
m AS (SELECT * FROM ok WHERE NOT unmapped AND NOT (paired AND mate_unmapped)),
p AS (SELECT a.grp, a.qname, a.chrom, b.chrom AS chrom2, a.outer_ AS pos, b.outer_ AS pos2, least(a.rid, b.rid) AS rid, a.cigar || '|' || b.cigar AS cigar FROM m a JOIN m b ON a.grp = b.grp AND a.qname = b.qname WHERE a.paired AND b.paired AND a.is_read1 AND NOT b.is_read1),
pb AS (SELECT grp, chrom, chrom2, pos, pos2, arg_max(cigar, (n, -length(cigar), cigar)) AS cigar FROM (SELECT grp, chrom, chrom2, pos, pos2, cigar, count(*) AS n FROM p GROUP BY ALL) GROUP BY ALL),
s AS (SELECT *, pos AS spot FROM m WHERE NOT paired),
sb AS (SELECT grp, chrom, reverse, spot, ref_len, arg_max(cigar, (n, -length(cigar), cigar)) AS cigar FROM (SELECT grp, chrom, reverse, spot, ref_len, cigar, count(*) AS n FROM s GROUP BY ALL) GROUP BY ALL)
SELECT 'pair' AS kind, grp, chrom, chrom2, pos, pos2, arg_min(qname, (rid, qname)) AS qname, count(*) AS xp FROM p JOIN pb USING (grp, chrom, chrom2, pos, pos2, cigar) GROUP BY grp, chrom, chrom2, pos, pos2
UNION ALL SELECT 'single', grp, chrom, NULL, spot, NULL, arg_min(qname, (rid, qname)), count(*) FROM s JOIN sb USING (grp, chrom, reverse, spot, ref_len, cigar) GROUP BY grp, chrom, reverse, spot, ref_len
UNION ALL SELECT 'kept', grp, chrom, NULL, pos, NULL, qname, 1 FROM ok WHERE unmapped OR paired AND mate_unmapped""")
def op_duplicates_collapse(spark, sf_dir):
    rows = relation(spark, sf_dir, "reads").selectExpr(*ALIGNED, "qname || '/' || (chrom - 1) div 2 AS qname")
    return duplicates.collapse(rows, keep=True)


@query("""WITH r AS (SELECT o_orderkey, translate(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 12), '0123456789abcdef', 'ACGTAACCGGTTACGN') AS seq, o_orderkey % 2 = 0 AS reverse, o_orderkey % 3 = 0 AS unmapped, o_orderkey % 30 + 35 AS q FROM orders)
SELECT '@r' || o_orderkey || chr(10) || CASE WHEN reverse THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END || chr(10) || '+' || chr(10) || repeat(chr(CAST(q AS INT)), 12) AS line FROM r WHERE unmapped""")
def op_duplicates_route(spark, sf_dir):
    seq = F.translate(F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 12), "0123456789abcdef", "ACGTAACCGGTTACGN")
    rows = load(spark, sf_dir, "orders").select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("qname"), seq.alias("seq"), (F.col("o_orderkey") % 2 == 0).alias("reverse"),
        (F.col("o_orderkey") % 3 == 0).alias("unmapped"), F.repeat(F.char(F.col("o_orderkey") % 30 + 35), F.lit(12)).alias("qual"),
    )
    return duplicates.route(rows)[1].select("line")


@query("SELECT max(n) AS most, min(n) AS least, CAST(sum(n) AS BIGINT) AS total FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey)")
def op_stats_extent(spark, sf_dir):
    return stats.extent(load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")), "n")

"""The duplicate collapse in consensus mode, from reads to the files they go to."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import collapse, duplicates
from tidemark.plans.pairs import ALIGNED
from tidemark.plans.reading import CONSENSUS
from tidemark.plans.registry import query
from tidemark.plans.relations import cte, load, relation

DIGITS = "'0123456789abcdef', 'ACGTAACCGGTTACGN'"
READS = [
    "o_orderkey AS rid", "'r' || o_orderkey AS qname", "'L' || o_custkey % 3 AS grp", "o_orderkey % 4 > 0 AS paired", "CAST(o_custkey % 2 + 1 AS INT) AS chrom", "o_custkey % 97 * 10 AS pos", "o_custkey % 5 = 0 AS reverse",
    "o_orderkey % 11 = 0 AS qcfail", "CASE WHEN o_orderkey % 22 = 0 THEN 'Q' END AS zq", "CASE WHEN o_orderkey % 13 = 0 THEN 2 END AS xp", "CAST(o_orderkey % 60 AS INT) AS mapq", "o_orderkey % 19 = 0 AS unmapped",
    "CASE WHEN o_orderkey % 5 = 0 THEN '6M1D6M' ELSE '12M' END AS cigar", f"translate(substr(md5(CAST(o_custkey * 3 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR(20))), 1, 12), {DIGITS}) AS seq", "CAST(o_orderkey % 30 + 2 AS INT) AS q",
]


def _reads(spark, sf_dir):
    """Orders as reads: first mates, or single ones, and second mates 100 bases on with the sequence turned round."""
    rows = load(spark, sf_dir, "orders").selectExpr(*[c.replace("md5(CAST", "md5(CAST").replace("VARCHAR(20)", "STRING") for c in READS])
    rows = rows.withColumns({"is_read1": F.lit(True), "ref_len": F.lit(12), "mate_unmapped": F.lit(False)})
    second = rows.filter("paired").withColumns({"pos": F.col("pos") + 100, "reverse": ~F.col("reverse"), "is_read1": F.lit(False), "seq": F.reverse("seq")})
    return rows.unionByName(second).withColumn("qual", F.repeat(F.char(F.col("q") + 33), F.lit(12)))


_SUMS = CONSENSUS[CONSENSUS.index("bases AS (") :]


@query(f"""WITH o AS (SELECT {', '.join(READS)} FROM orders),
ok AS (SELECT *, CASE WHEN paired THEN 'p' ELSE 's' END || grp || '.' || chrom || '.' || pos || '.' || reverse AS gid FROM o WHERE NOT unmapped),
best AS (SELECT gid, arg_max(cigar, (n, -length(cigar), cigar)) AS cigar FROM (SELECT gid, cigar, count(*) AS n FROM ok GROUP BY ALL) GROUP BY gid),
mem AS (
  SELECT gid, CASE WHEN paired THEN 1 ELSE 0 END AS side, rid, qname, seq, q, mapq, xp, qcfail, zq, reverse FROM ok JOIN best USING (gid, cigar)
  UNION ALL SELECT gid, 2, rid, qname, reverse(seq), q, mapq, xp, qcfail, zq, NOT reverse FROM ok JOIN best USING (gid, cigar) WHERE paired),
cells AS (SELECT gid || ':' || side AS g, unnest(range(1, 13)) AS p, seq, q FROM mem),
""" + _SUMS.replace("best AS (SELECT g, p", "best2 AS (SELECT g, p").replace("SELECT g, string_agg(", "called AS (SELECT g, string_agg(", 1).replace("FROM best GROUP BY g", "FROM best2 GROUP BY g)").replace("FROM sums)\n", "FROM sums),\n") + """,
joined AS (SELECT m.*, c.consensus, c.consensus_qual, c.reads AS n, m.seq = c.consensus AS agrees FROM mem m JOIN called c ON c.g = m.gid || ':' || m.side),
per AS (
  SELECT gid, side, consensus, consensus_qual, n, NOT bool_or(agrees) AS unmapped, arg_min(qname, rid) AS qname, n + CAST(sum(coalesce(xp, 0)) AS BIGINT) AS xp, any_value(reverse) AS reverse,
         CASE WHEN bool_or(agrees) THEN arg_max(mapq, rid) FILTER (agrees) ELSE min(mapq) END AS mapq, CASE WHEN bool_or(agrees) THEN max(rid) FILTER (agrees) ELSE min(rid) END AS rid FROM joined GROUP BY gid, side, consensus, consensus_qual, n),
flagged AS (SELECT p.*, qcfail, coalesce(zq, '') = 'Q' AS lifts FROM per p JOIN o ON o.rid = p.rid),
kept AS (
  SELECT * FROM (SELECT *, n > 1 AND bool_or(qcfail) OVER g AS tried, bool_or(qcfail AND NOT lifts) OVER g AS bad, bool_or(qcfail) OVER g AS failed, min(xp) OVER g AS least, bool_or(unmapped) OVER g AS again FROM flagged WINDOW g AS (PARTITION BY gid))
  WHERE least >= 2 AND CASE WHEN tried THEN NOT bad ELSE NOT failed END)
SELECT CASE WHEN NOT again THEN 'alignments' WHEN side = 0 THEN 'sr' ELSE 'r' || side END AS stream, CASE WHEN again AND side > 0 THEN qname || '/' || side ELSE qname END AS qname,
  CASE WHEN again AND reverse THEN reverse(translate(consensus, 'ACGT', 'TGCA')) ELSE consensus END AS seq, CASE WHEN again AND reverse THEN reverse(consensus_qual) ELSE consensus_qual END AS qual, CASE WHEN NOT again THEN mapq END AS mapq, CASE WHEN NOT again THEN xp END AS xp FROM kept""")
def op_duplicates_consensus_routes(spark, sf_dir):
    """Called reads of groups of two at least, with rescue, and where they go."""
    out = collapse.routes(collapse.consensus_collapse(_reads(spark, sf_dir), rescue_failed=True, min_count=2))
    rows = out["alignments"].select(F.lit("alignments").alias("stream"), "qname", "seq", "qual", "mapq", "xp")
    for stream in ("r1", "r2", "sr"):
        f = F.split("line", "\n")
        rows = rows.unionByName(out[stream].select(F.lit(stream).alias("stream"), "qname", f[1].alias("seq"), f[3].alias("qual")), allowMissingColumns=True)
    return rows


@query(cte("reads") + f""",
r AS (SELECT {', '.join(ALIGNED)}, qname FROM reads),
m AS (SELECT *, pos + CASE WHEN reverse THEN ref_len ELSE 0 END AS spot FROM r WHERE NOT qcfail AND NOT unmapped AND NOT paired AND starts_with(qname, 'M_')),
best AS (SELECT grp, chrom, reverse, spot, arg_max(cigar, (n, -length(cigar), cigar)) AS cigar FROM (SELECT grp, chrom, reverse, spot, cigar, count(*) AS n FROM m GROUP BY ALL) GROUP BY ALL)
SELECT grp, chrom, spot AS pos, arg_min(qname, (rid, qname)) AS qname, count(*) AS xp FROM m JOIN best USING (grp, chrom, reverse, spot, cigar) GROUP BY grp, chrom, reverse, spot""")
def op_duplicates_five_prime(spark, sf_dir):
    """Merged single reads collapsed by their 5' ends, whatever their lengths."""
    rows = relation(spark, sf_dir, "reads").selectExpr(*ALIGNED, "qname")
    out = duplicates.collapse(rows, five_prime=True, merged=True).filter("kind = 'single'")
    return out.select("grp", "chrom", "pos", "qname", "xp")


@query(f"""WITH o AS (SELECT {', '.join(READS)} FROM orders WHERE o_orderkey % 4 > 0),
q AS (SELECT *, repeat(chr(q + 33), 11) || chr(CAST(33 + rid % 40 AS INT)) AS qual FROM o),
best AS (SELECT grp, chrom, pos, arg_max(cigar, (n, -length(cigar), cigar)) AS cigar FROM (SELECT grp, chrom, pos, cigar, count(*) AS n FROM q GROUP BY ALL) GROUP BY ALL)
SELECT grp, chrom, pos, arg_max(rid, ((q + 33) * 11 + 33 + rid % 40, -rid)) AS rid, arg_min(qname, rid) AS qname, CAST(max((q + 33) * 11 + 33 + rid % 40) AS BIGINT) AS quality, count(*) AS reads FROM q JOIN best USING (grp, chrom, pos, cigar) GROUP BY grp, chrom, pos""")
def op_duplicates_quality_sum(spark, sf_dir):
    """Representatives by the sums of their qualities' characters."""
    rows = load(spark, sf_dir, "orders").filter("o_orderkey % 4 > 0").selectExpr(*[c.replace("VARCHAR(20)", "STRING") for c in READS])
    rows = rows.select("rid", "qname", "grp", "chrom", "pos", "cigar", F.concat(F.repeat(F.char(F.col("q") + 33), F.lit(11)), F.char(33 + F.col("rid") % 40)).alias("qual"))
    total = duplicates.quality_sum(F.col("qual"))
    one = duplicates.representative(rows.withColumn("first", F.col("rid")), ["grp", "chrom", "pos"], "first", "qname", "cigar", total)
    return one.select("grp", "chrom", "pos", "rid", "qname", duplicates.quality_sum(F.col("qual")).cast("long").alias("quality"), "reads")

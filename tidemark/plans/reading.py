"""Queries on reads and fragments: predicates, coordinates, mates, duplicates, length histograms, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import reads as fn
from tidemark.operators import duplicates, joins, sequence, simulate, stats, windows
from tidemark.plans.registry import query
from tidemark.plans.relations import HI, LO, cte, load, relation

BIT = {k: f"(flag & {v}) <> 0" for k, v in fn.FLAGS.items()}


@query(cte("reads") + f"""
SELECT rid, chrom, pos + 1 AS s, pos + isize AS e FROM reads
WHERE NOT {BIT['duplicate']} AND NOT {BIT['qcfail']} AND NOT {BIT['unmapped']} AND isize <> 0 AND isize BETWEEN 100 AND 120 AND ({BIT['paired']} OR starts_with(qname, 'M_'))""")
def op_reads_fragments(spark, sf_dir):
    flag = lambda name: fn.flag(F.col("flag"), name)
    kept = relation(spark, sf_dir, "reads").filter(~flag("duplicate") & ~flag("qcfail") & ~flag("unmapped") & (F.col("isize") != 0) & F.col("isize").between(100, 120) & (flag("paired") | F.col("qname").startswith("M_")))
    start = fn.pair_start(F.col("pos"), F.col("mate_pos"))
    return kept.select("rid", "chrom", start.alias("s"), fn.pair_end(start, F.col("isize")).alias("e"))


@query(cte("reads") + f"""
SELECT chrom, pos, count(*) AS n FROM (
  SELECT chrom, unnest(CASE WHEN {BIT['paired']} OR starts_with(qname, 'M_') OR (starts_with(qname, 'T_') AND qlen <= 66) THEN [pos + 1, pos + qlen] WHEN {BIT['reverse']} THEN [pos + qlen] ELSE [pos + 1] END) AS pos FROM reads) GROUP BY ALL""")
def op_reads_counted_ends(spark, sf_dir):
    rows = relation(spark, sf_dir, "reads")
    ends = fn.counted_ends(F.col("pos") + 1, F.col("pos") + F.col("qlen"), F.col("qname"), fn.flag(F.col("flag"), "reverse"), F.col("qlen"), fn.flag(F.col("flag"), "paired"))
    return rows.select("chrom", F.explode(ends).alias("pos")).groupBy("chrom", "pos").agg(F.count("*").alias("n"))


@query(cte("reads") + f"""
SELECT count(*) AS total, {', '.join(f'count(*) FILTER ({b}) AS {k}' for k, b in BIT.items())} FROM reads""")
def op_reads_flagstat(spark, sf_dir):
    return stats.flagstat(relation(spark, sf_dir, "reads"))


@query(cte("reads") + """
SELECT a.qid, a.chrom AS chrom_1, b.chrom AS chrom_2, a.pos AS pos_1, b.pos AS pos_2 FROM reads a JOIN reads b ON a.qid = b.qid AND a.chrom % 2 = 1 AND b.chrom = a.chrom + 1""")
def op_reads_mates(spark, sf_dir):
    rows = relation(spark, sf_dir, "reads").select("qid", ((F.col("chrom") - 1) / 2).cast("int").alias("pair"), (F.col("chrom") % 2 == 1).alias("is_read1"), "chrom", "pos")
    return joins.mates(rows, ["qid", "pair"]).select("qid", "chrom_1", "chrom_2", "pos_1", "pos_2")


@query(cte("reads") + """,
h AS (SELECT rg, CAST(CASE WHEN isize = 0 THEN 110 ELSE least(110, abs(isize)) END AS BIGINT) AS length, count(*) AS reads, CAST(sum(coalesce(xp, 1)) AS BIGINT) AS weighted FROM reads GROUP BY ALL),
g AS (SELECT rg, unnest(range(min(length), max(length) + 1)) AS length FROM h GROUP BY rg)
SELECT g.rg, g.length, coalesce(reads, 0) AS reads, coalesce(weighted, 0) AS weighted FROM g LEFT JOIN h ON g.rg = h.rg AND g.length = h.length""")
def op_reads_length_histogram(spark, sf_dir):
    rows = relation(spark, sf_dir, "reads").withColumn("length", fn.clamp_length(F.col("isize"), 110).cast("long"))
    return stats.fill_range(stats.length_histogram(rows, ["rg"], "length", F.col("xp")), ["rg"], "length", ["reads", "weighted"])


@query(cte("fragments") + """,
h AS (SELECT CAST(e - s + 1 AS INT) AS length, count(*) AS n FROM fragments GROUP BY ALL)
SELECT length, n, round(sum(n) OVER (ORDER BY length) / CAST(sum(n) OVER () AS DOUBLE), 9) AS cdf FROM h""")
def op_windows_cumulative_share(spark, sf_dir):
    rows = relation(spark, sf_dir, "fragments").groupBy((F.col("e") - F.col("s") + 1).cast("int").alias("length")).agg(F.count("*").alias("n"))
    return windows.cumulative_share(rows, "n", "length").withColumn("cdf", F.round("cdf", 9))


@query(cte("reads") + """,
k AS (SELECT *, CAST(qlen AS VARCHAR) || CASE WHEN rid % 4 = 0 THEN 'M2D' ELSE 'M' END AS cigar, rid % 97 AS quality FROM reads),
c AS (SELECT chrom, qlen, rg, cigar, count(*) AS n FROM k GROUP BY ALL),
best AS (SELECT chrom, qlen, rg, arg_max(cigar, (n, -length(cigar), cigar)) AS cigar FROM c GROUP BY ALL)
SELECT k.chrom, k.qlen, k.rg, arg_max(k.rid, (quality, -k.rid)) AS rid, arg_min(k.qname, (k.rid, k.qname)) AS qname, CAST(count(*) + sum(xp) AS BIGINT) AS xp, count(*) AS reads
FROM k JOIN best b ON k.chrom = b.chrom AND k.qlen = b.qlen AND k.rg = b.rg AND k.cigar = b.cigar GROUP BY k.chrom, k.qlen, k.rg""")
def op_duplicates_representative(spark, sf_dir):
    rows = relation(spark, sf_dir, "reads")
    rows = rows.withColumn("cigar", F.concat(F.col("qlen").cast("string"), F.when(F.col("rid") % 4 == 0, "M2D").otherwise("M")))
    rows = rows.select("chrom", "qlen", "rg", "rid", "qname", "cigar", "xp")
    one = duplicates.representative(rows.withColumn("first", F.col("rid")), ["chrom", "qlen", "rg"], "first", "qname", "cigar", F.col("rid") % 97, F.col("xp"))
    return one.select("chrom", "qlen", "rg", "rid", "qname", duplicates_count(), "reads")


def duplicates_count():
    return F.col("xp").cast("long").alias("xp")


CONSENSUS = """
WITH r AS (SELECT o_custkey %% 40 AS g, translate(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 12), '0123456789abcdef', 'ACGTAACCGGTTACGN') AS seq, o_orderkey %% 30 + 2 AS q FROM orders),
cells AS (SELECT g, unnest(range(1, 13)) AS p, seq, q FROM r),
bases AS (SELECT g, p, substr(seq, CAST(p AS INT), 1) AS base, -q / 10.0::DOUBLE AS q, q AS plain FROM cells),
sums AS (SELECT g, p, %s, count(*) FILTER (base <> 'N') AS known, count(*) AS reads, min(plain) AS worst, min(base) AS single FROM bases GROUP BY ALL),
best AS (SELECT g, p, known, reads, worst, single, log10(greatest(1e-9, pow(10::DOUBLE, A) + pow(10::DOUBLE, C) + pow(10::DOUBLE, G_) + pow(10::DOUBLE, T))) AS total, least(A, C, G_, T) AS low, A, C, G_, T FROM sums)
SELECT g, string_agg(CASE WHEN reads = 1 THEN single WHEN known = 0 THEN 'N' WHEN low - total < 0 THEN CASE WHEN A = low THEN 'A' WHEN C = low THEN 'C' WHEN G_ = low THEN 'G' ELSE 'T' END ELSE 'N' END, '' ORDER BY p) AS consensus,
  string_agg(chr(33 + CAST(CASE WHEN reads = 1 OR known = 0 THEN worst WHEN low - total < 0 THEN round(least(60.0::DOUBLE, -10 * (low - total))) ELSE 0 END AS INT)), '' ORDER BY p) AS consensus_qual, max(reads) AS reads FROM best GROUP BY g
""" % ", ".join(f"round(sum(CASE WHEN base = 'N' THEN 0 WHEN base = '{b}' THEN q ELSE log10(1 - pow(10::DOUBLE, q)) - log10(3::DOUBLE) END), 10) AS {b if b != 'G' else 'G_'}" for b in "ACGT")


@query(CONSENSUS)
def op_duplicates_consensus(spark, sf_dir):
    seq = F.translate(F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 12), "0123456789abcdef", "ACGTAACCGGTTACGN")
    rows = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("g"), seq.alias("seq"), F.repeat(F.char(F.col("o_orderkey") % 30 + 2 + 33), F.lit(12)).alias("qual"))
    return duplicates.consensus(rows, ["g"], "seq", "qual").select("g", "consensus", "consensus_qual", "reads")


@query(cte("reads") + f"""
SELECT rid, CASE WHEN xp > 1 AND rg = 'R' THEN false ELSE {BIT['qcfail']} END AS qcfail FROM reads WHERE NOT CASE WHEN xp > 1 AND rg = 'R' THEN false ELSE {BIT['qcfail']} END""")
def op_duplicates_rescue(spark, sf_dir):
    rows = relation(spark, sf_dir, "reads").select("rid", fn.flag(F.col("flag"), "qcfail").alias("qcfail"), F.when(F.col("rg") == "R", "Q").otherwise("x").alias("zq"), F.col("xp").alias("reads"))
    return duplicates.rescue(rows, rescue_failed=True).select("rid", "qcfail")


@query("""WITH r AS (SELECT event_type, user_id, event_id FROM events),
m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS run FROM r)
SELECT user_id, event_type, min(event_id) AS start, count(*) AS n FROM m GROUP BY user_id, event_type, run""")
def op_duplicates_running_groups(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_type", "user_id", "event_id")
    return duplicates.running_groups(rows, ["event_type"], "event_id", ["user_id"], 1 << 10)


def _genome(frags, chunk: int, overlap: int):
    """Made-up contigs of LO..HI in chunks: the base at a position is a fixed function of contig and position."""
    base = lambda p: F.element_at(F.array(*map(F.lit, "ACGT")), (F.pmod(F.xxhash64("chrom", p), F.lit(4)) + 1).cast("int"))
    at = frags.select("chrom").distinct().select("chrom", F.posexplode(F.sequence(F.lit(LO), F.lit(HI), F.lit(chunk))).alias("chunk_no", "_at"))
    last = F.least(F.col("_at") + chunk + overlap - 1, F.lit(HI))
    return at.select("chrom", "chunk_no", F.col("_at").cast("long").alias("chunk_start"), F.array_join(F.transform(F.sequence(F.col("_at").cast("long"), last.cast("long")), base), "").alias("seq"))


def _end_rates(frags, chunks, chunk: int, k: int, start: bool):
    """(strand, kmer, rate) of the k-mers at the fragments' first bases (start) or last ones, against all of the genome."""
    on_left = (F.col("strand") == "+") == F.lit(start)
    ends = frags.select("chrom", "strand", F.when(on_left, F.col("s")).otherwise(F.col("e") - k + 1).alias("lo")).withColumn("hi", F.col("lo") + k - 1)
    seen = sequence.fetch(ends, chunks, "chrom", "lo", "hi", chunk, "kmer").filter("kmer IS NOT NULL").groupBy("strand", "kmer").agg(F.count("*").alias("n"))
    own = chunks.select(F.left("seq", F.lit(chunk + k - 1)).alias("seq"))
    return sequence.acceptance(seen, sequence.kmer_counts(own, "seq", k), ["strand"])


@query()
def op_simulate_fragments(spark, sf_dir, chunk: int = 256):
    """All positions LO..HI of the contigs; both ends accepted by the rates of the observed fragments' end k-mers."""
    frags = relation(spark, sf_dir, "fragments").withColumn("strand", F.when(F.col("strand") == "F", "+").otherwise("-"))
    lengths = frags.groupBy((F.col("e") - F.col("s") + 1).cast("int").alias("length")).agg(F.count("*").alias("n"))
    positions = frags.select("chrom").distinct().select("chrom", F.explode(F.sequence(F.lit(LO).cast("long"), F.lit(HI).cast("long"))).alias("pos"))
    chunks = _genome(frags, chunk, 8)
    starts, stops = _end_rates(frags, chunks, chunk, 8, True), _end_rates(frags, chunks, chunk, 5, False)
    strands = simulate.strands(F.col("pos") - LO, HI + 1 - F.col("pos"), 200)
    drawn = simulate.fragments(positions, chunks, lengths, starts, stops, simulate.hashed("chrom", "pos", "strand", "trial"), 30, strands, chunk=chunk)
    return drawn.groupBy("chrom", "strand", "length").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


@query(cte("fragments") + """,
r AS (SELECT chrom, s AS pos, e - s + 1 AS length, CASE WHEN strand = 'F' THEN '+' ELSE '-' END AS strand FROM fragments),
a AS (SELECT *, CASE WHEN strand = '+' THEN pos ELSE pos - length + 1 END AS start FROM r)
SELECT name, flag, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, CAST(sum(isize) AS BIGINT) AS isizes FROM (
  SELECT 'SIM' AS name, CASE WHEN strand = '+' THEN 99 ELSE 163 END AS flag, start, length AS isize FROM a WHERE length > 150
  UNION ALL SELECT 'SIM', CASE WHEN strand = '+' THEN 147 ELSE 83 END, start + length - 150, -length FROM a WHERE length > 150
  UNION ALL SELECT 'M_SIM', CASE WHEN strand = '+' THEN 0 ELSE 16 END, start, 0 FROM a WHERE length <= 150) GROUP BY ALL""")
def op_simulate_reads(spark, sf_dir):
    rows = relation(spark, sf_dir, "fragments").selectExpr("chrom", "s AS pos", "e - s + 1 AS length", "CASE WHEN strand = 'F' THEN '+' ELSE '-' END AS strand")
    out = simulate.emit(rows, "pos", "length", "strand", 150)
    return out.groupBy("name", "flag").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("isize").alias("isizes"))


@query(cte("reads") + """
SELECT rid, pos FROM reads WHERE (rid * 7919) % 1000 < 250""")
def op_reads_downsample(spark, sf_dir):
    return simulate.sample(relation(spark, sf_dir, "reads").select("rid", "pos"), 0.25, lambda draw: (F.col("rid") * 7919 % 1000) / F.lit(1000.0))

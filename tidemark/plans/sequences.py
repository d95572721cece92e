"""Queries on sequences: documents' letters restricted to bases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.intervals import log2_ratio
from tidemark.functions.reads import COMPLEMENT, reverse_complement
from tidemark.operators import sequence
from tidemark.plans.registry import query
from tidemark.plans.relations import load

SEQ = "WITH q AS (SELECT doc_id, source, lang, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"


def _seq(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


def _grams(k: int) -> str:
    return f", g AS (SELECT lang, unnest(list_transform(range(1, length(seq) - {k} + 2), lambda i: substr(seq, i, {k}))) AS kmer FROM q WHERE length(seq) >= {k})"


@query(SEQ + _grams(4) + "\nSELECT lang, kmer, count(*) AS n FROM g GROUP BY ALL")
def op_sequence_kmers(spark, sf_dir):
    return sequence.kmer_counts(_seq(spark, sf_dir), "seq", 4, ["lang"])


@query(SEQ + """
SELECT 'left' AS side, source, left(seq, 4) AS kmer, count(*) AS n FROM q WHERE length(seq) >= 4 GROUP BY ALL
UNION ALL SELECT 'right', source, right(seq, 3), count(*) FROM q WHERE length(seq) >= 4 GROUP BY ALL""")
def op_sequence_end_kmers(spark, sf_dir):
    return sequence.end_kmers(_seq(spark, sf_dir), "seq", F.col("source"), 4, 3).withColumnRenamed("strand", "source")


def _composition_sql(width: int) -> str:
    letters = list("ACGT") if width == 1 else [a + b for a in "ACGT" for b in "ACGT"]
    return SEQ + f""",
x AS (SELECT lang, unnest(range(1, {12 - width + 2})) AS i, substr(seq, 101, 12) AS c FROM q WHERE length(seq) >= 112),
o AS (SELECT lang, CASE WHEN i <= 6 THEN i - 7 ELSE i - 6 END AS off, substr(c, i, {width}) AS base FROM x),
n AS (SELECT lang, off, base, count(*) AS n FROM o GROUP BY ALL),
grid AS (SELECT * FROM (SELECT DISTINCT lang, off FROM n), (SELECT unnest({letters!r}) AS base))
SELECT g.lang, g.base, g.off AS "offset", coalesce(n.n, 0) AS n, round(coalesce(n.n, 0) / sum(coalesce(n.n, 0)) OVER (PARTITION BY g.lang, g.off)::DOUBLE, 6) AS share
FROM grid g LEFT JOIN n ON n.lang = g.lang AND n.off = g.off AND n.base = g.base"""


def _composition(spark, sf_dir, width: int):
    context = _seq(spark, sf_dir).filter("length(seq) >= 112").withColumn("context", F.substring("seq", 101, 12))
    return sequence.composition(context, "lang", "context", 6, width)


@query(_composition_sql(1))
def op_sequence_composition(spark, sf_dir):
    return _composition(spark, sf_dir, 1).withColumn("share", F.round("share", 6))


@query(_composition_sql(2))
def op_sequence_dinucleotides(spark, sf_dir):
    return _composition(spark, sf_dir, 2).withColumn("share", F.round("share", 6))


@query(f"WITH d AS ({_composition_sql(2)})" + """,
w AS (SELECT lang, "offset", CAST(sum(n) FILTER (base IN ('AA', 'AT', 'TA', 'TT')) AS BIGINT) AS at_, CAST(sum(n) FILTER (base IN ('CC', 'CG', 'GC', 'GG')) AS BIGINT) AS gc FROM d GROUP BY ALL)
SELECT lang, "offset", at_, gc, round(CASE WHEN at_ > 0 AND gc > 0 THEN log2(at_ / gc::DOUBLE) END, 6) AS lr FROM w""")
def op_sequence_weak_strong(spark, sf_dir):
    rows = sequence.weak_strong(_composition(spark, sf_dir, 2), ["lang", "offset"])
    return rows.select("lang", "offset", F.col("at").alias("at_"), "gc", F.round(log2_ratio(F.col("at"), F.col("gc")), 6).alias("lr"))


@query(SEQ + _grams(4) + """,
genome AS (SELECT kmer, count(*) AS g FROM g GROUP BY ALL),
observed AS (SELECT lang, left(seq, 4) AS kmer, count(*) AS o FROM q WHERE length(seq) >= 4 GROUP BY ALL),
odds AS (SELECT lang, kmer, (o / max(o) OVER (PARTITION BY lang)::DOUBLE) / (g / max(g) OVER (PARTITION BY lang)::DOUBLE) AS odds FROM observed JOIN genome USING (kmer))
SELECT lang, kmer, round(odds / max(odds) OVER (PARTITION BY lang), 9) AS rate FROM odds""")
def op_sequence_acceptance(spark, sf_dir):
    rows = _seq(spark, sf_dir)
    observed = rows.filter("length(seq) >= 4").groupBy("lang", F.left("seq", F.lit(4)).alias("kmer")).agg(F.count("*").alias("n"))
    return sequence.acceptance(observed, sequence.kmer_counts(rows, "seq", 4), ["lang"]).withColumn("rate", F.round("rate", 9))


@query("""WITH c AS (SELECT doc_id, translate(text, 'acgtn', 'ACGTN') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS l, """ + ", ".join(f"length(t) - length(replace(t, '{b}', '')) AS {b.lower()}_" for b in "ACGTN") + """ FROM c)
SELECT doc_id, a_ AS acount, c_ AS ccount, g_ AS gcount, t_ AS tcount, n_ AS ncount, l - a_ - c_ - g_ - t_ - n_ AS othercount, l AS seqlen, round((a_ + t_) / l::DOUBLE, 6) AS atperc, round((g_ + c_) / l::DOUBLE, 6) AS gcperc FROM n""")
def op_sequence_base_fractions(spark, sf_dir):
    rows = sequence.base_fractions(load(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")
    return rows.withColumns({c: F.round(c, 6) for c in ("atperc", "gcperc")})


@query(f"SELECT doc_id, md5(reverse(translate(text, '{COMPLEMENT[0]}', '{COMPLEMENT[1]}'))) AS rc FROM documents")
def op_sequence_reverse_complement(spark, sf_dir):
    rows = load(spark, sf_dir, "documents")
    return rows.select("doc_id", F.md5(reverse_complement(F.col("text")).cast("binary")).alias("rc"))


@query(SEQ + """,
p AS (SELECT doc_id, seq, unnest([15, 250, 700]) AS c FROM q)
SELECT doc_id, c, CASE WHEN c > 5 AND c + 5 <= length(seq) THEN substr(seq, c - 5, 11) END AS context FROM p""")
def op_sequence_fetch(spark, sf_dir):
    rows = _seq(spark, sf_dir)
    chunks = sequence.chunk_sequence(rows.withColumnRenamed("doc_id", "chrom"), ["chrom"], "seq", 256, 32)
    points = rows.select(F.col("doc_id").alias("chrom"), F.explode(F.array(F.lit(15), F.lit(250), F.lit(700))).alias("c")).withColumns({"lo": F.col("c") - 5, "hi": F.col("c") + 5})
    return sequence.fetch(points, chunks, "chrom", "lo", "hi", 256).select(F.col("chrom").alias("doc_id"), "c", "context")

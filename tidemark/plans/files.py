"""Queries that write a table in one of the file formats and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import reads as fn
from tidemark.plans.registry import query
from tidemark.plans.relations import cte, load, relation
from tidemark.plans.shared import folder
from tidemark.sources import sinks, text


def _put(rows, line: str, name: str) -> str:
    """Lines as text files; their folder."""
    path = folder(rows.sparkSession, name)
    rows.selectExpr(f"{line} AS value").write.text(path)
    return path


SAM_LINE = r"concat_ws('\t', qname, flag, 'chr' || chrom, pos + 1, 60, '5S' || qlen || 'M2D', '=', mate_pos + 1, isize, '*', '*', 'RG:Z:' || rg, 'XP:i:' || xp)"


@query(cte("reads") + """
SELECT qname, flag, CAST(chrom AS VARCHAR) AS chrom, pos, isize, qlen + 2 AS ref_len, qlen + 5 AS query_len, true AS clipped, rg, CAST(xp AS VARCHAR) AS xp FROM reads WHERE chrom = 3 AND pos + 1 <= 9000 AND pos + qlen + 2 >= 4000""")
def op_source_sam(spark, sf_dir):
    path = _put(relation(spark, sf_dir, "reads"), SAM_LINE, "sam")
    rows = text.sam(spark, path).withColumns({"s": F.col("pos") + 1, "ref_len": fn.reference_length(F.col("cigar"))}).withColumn("e", F.col("pos") + F.col("ref_len"))
    kept = rows.filter(text.in_region("chr3:4,000-9,000"))
    lengths = (fn.query_length(F.col("cigar")).alias("query_len"), fn.clipped(F.col("cigar")).alias("clipped"))
    return kept.select("qname", "flag", "chrom", "pos", "isize", "ref_len", *lengths, F.col("tags")["RG"].alias("rg"), F.col("tags")["XP"].alias("xp"))


@query("SELECT 'g' || n_nationkey AS id, r_name AS library FROM nation JOIN region ON n_regionkey = r_regionkey")
def op_source_read_groups(spark, sf_dir):
    rows = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return text.read_groups(spark, _put(rows, r"concat_ws('\t', '@RG', 'ID:g' || n_nationkey, 'PL:x', 'LB:' || r_name)", "header"))


@query(cte("regions") + "\nSELECT CAST(chrom AS VARCHAR) AS chrom, lo AS start, hi AS \"end\", 'r' || cid AS name, strand FROM regions")
def op_source_bed(spark, sf_dir):
    path = _put(relation(spark, sf_dir, "regions"), r"concat_ws('\t', 'chr' || chrom, lo - 1, hi, 'r' || cid, 0, strand)", "bed")
    missing = folder(spark, "nowhere")
    return text.bed(spark, text.existing(spark, path, missing)).drop("score")


@query("""SELECT CAST(p_size % 7 + 1 AS VARCHAR) AS chrom, p_type AS source, 'exon' AS feature, CAST(p_partkey AS BIGINT) AS start, CAST(p_partkey + p_size AS BIGINT) AS "end",
  CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 'G' || p_brand AS gene_id, 'T' || p_partkey AS transcript_id, CASE WHEN p_partkey % 3 > 0 THEN 'N' || p_size END AS gene_name FROM part""")
def op_source_gtf(spark, sf_dir):
    names = "'gene_id \"G' || p_brand || '\"; transcript_id \"T' || p_partkey || '\";' || CASE WHEN p_partkey % 3 > 0 THEN ' gene_name \"N' || p_size || '\";' ELSE '' END"
    line = rf"concat_ws('\t', 'chr' || (p_size % 7 + 1), p_type, 'exon', p_partkey, p_partkey + p_size, '.', CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END, '.', {names})"
    return text.gtf(spark, _put(load(spark, sf_dir, "part"), line, "gtf"))


@query(cte("fragments") + """,
a AS (SELECT chrom, s AS pos, count(*) AS n FROM fragments GROUP BY ALL), b AS (SELECT chrom, e AS pos, count(*) AS n FROM fragments GROUP BY ALL)
SELECT CAST(a.chrom AS VARCHAR) AS chrom, a.pos, CAST(a.n AS DOUBLE) AS starts, CAST(b.n AS DOUBLE) AS ends FROM a JOIN b ON a.chrom = b.chrom AND a.pos = b.pos""")
def op_source_wig(spark, sf_dir):
    """Two tracks as WIG files, read back and matched by position."""
    frags, tracks = relation(spark, sf_dir, "fragments"), []
    for end, name in (("s", "starts"), ("e", "ends")):
        path = folder(spark, "wig")
        sinks.write_wig(frags.groupBy("chrom", F.col(end).alias("pos")).agg(F.count("*").alias("n")), "n", path)
        tracks.append(text.wig(spark, f"{path}/chrom=*", name))
    return tracks[0].join(tracks[1], ["chrom", "pos"])


@query("""WITH q AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents),
c AS (SELECT doc_id, seq, unnest(range(0, (length(seq) - 1) // 100 + 1)) AS k FROM q WHERE length(seq) > 0)
SELECT CAST(doc_id AS VARCHAR) AS chrom, CAST(k AS INT) AS chunk_no, k * 100 + 1 AS chunk_start, substr(seq, k * 100 + 1, 107) AS seq FROM c""")
def op_source_fasta(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq")).filter("seq <> ''")
    lines = rows.select("doc_id", F.posexplode(F.concat(F.array(F.concat(F.lit(">chr"), F.col("doc_id").cast("string"), F.lit(" of a document"))), F.expr("regexp_extract_all(seq, '.{1,60}', 0)"))).alias("at", "line"))
    path = folder(spark, "fasta")
    lines.repartition("doc_id").sortWithinPartitions("doc_id", "at").select("line").write.text(path)
    return text.fasta(spark, path, 100, 7)


SITES = "SELECT {0} AS name, CAST(p_size % 7 + 1 AS VARCHAR) AS chrom, {1} AS c, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part"


@query(" UNION ALL ".join(SITES.format(name, c) for name, c in (("p_brand", "p_partkey + 7"), ("'all'", "CAST(p_partkey AS BIGINT)"), ("p_brand", "p_partkey + p_size // 2"), ("p_brand", "p_partkey + p_size // 2"))))
def op_source_site_lists(spark, sf_dir):
    strand, chrom, part = "CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END", "'chr' || (p_size % 7 + 1)", load(spark, sf_dir, "part")
    lines = {
        "offset": rf"concat_ws('\t', {chrom}, p_partkey, p_partkey + 50, p_brand, 7, {strand})", "sites": f"concat_ws(':', {chrom}, p_partkey, {strand})",
        "named": f"concat_ws(':', {chrom}, p_partkey, p_partkey + p_size, p_brand, {strand})", "nameFirst": f"concat_ws(':', p_brand, {chrom}, p_partkey, p_partkey + p_size, {strand})",
    }
    out = None
    for kind, line in lines.items():
        rows = text.site_list(spark, _put(part, line, "sites"), kind, "all")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""WITH m AS (SELECT c_mktsegment AS segment, count(*) FILTER (c_nationkey = 1)::DOUBLE AS a, CASE WHEN c_mktsegment < 'C' THEN NULL ELSE round(sum(c_acctbal), 2)::DOUBLE END AS b FROM customer GROUP BY 1)
SELECT segment, 'a' AS measure, a AS v FROM m UNION ALL SELECT segment, 'b', b FROM m""")
def op_source_matrix(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count_if(F.col("c_nationkey") == 1).alias("a"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    wide = rows.select(F.col("c_mktsegment").alias("segment"), "a", F.coalesce(F.when(F.col("c_mktsegment") >= "C", F.col("total").cast("decimal(18,2)").cast("string")), F.lit("NA")).alias("b"))
    path = folder(spark, "matrix")
    sinks.write_tsv(wide, path)
    return text.matrix(spark, path, "segment", "measure", "v")


@query("""SELECT 'length' AS kind, CAST(l_quantity AS INT) AS length, CAST(NULL AS VARCHAR) AS word, count(*) AS n FROM lineitem GROUP BY CAST(l_quantity AS INT)
UNION ALL SELECT 'kmer', NULL, p_brand, count(*) FROM part GROUP BY p_brand UNION ALL SELECT DISTINCT 'id', NULL, p_brand, 1 FROM part""")
def op_source_lists(spark, sf_dir):
    """Length distributions with a header, k-mer tables and lists of ids."""
    counts = load(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("length")).agg(F.count("*").alias("n"))
    brands = load(spark, sf_dir, "part").groupBy(F.replace("p_brand", F.lit(" "), F.lit("_")).alias("word")).agg(F.count("*").alias("n"))
    head = spark.range(1).selectExpr("'Length Count' AS value")
    path = folder(spark, "lengths")
    counts.selectExpr("length || ' ' || n AS value").unionByName(head).write.text(path)
    lengths = text.length_distribution(spark, path).selectExpr("'length' AS kind", "length", "CAST(NULL AS STRING) AS word", "n")
    words = text.kmer_table(spark, _put(brands, r"word || '\t' || n", "kmers")).selectExpr("'kmer' AS kind", "CAST(NULL AS INT) AS length", "kmer AS word", "n")
    ids = text.id_list(spark, _put(load(spark, sf_dir, "part"), "' ' || p_brand || ' '", "ids"), "word").selectExpr("'id' AS kind", "CAST(NULL AS INT) AS length", "word", "1L AS n")
    return lengths.unionByName(words).unionByName(ids)

"""Text formats as DataFrames: SAM, BED and TSV, GTF, WIG, FASTA, site lists, tables.

Everything is read by Spark's text and CSV readers, so any file system, splitting and compression Spark knows
works. Formats whose lines depend on earlier ones (WIG, FASTA) get their context per file split, and splits hand on
one row each."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.intervals import floor_mid
from tidemark.functions.reads import chrom_name, parse_cigar
from tidemark.operators.annotation import attribute


def parse_region(text: str | None) -> tuple[str, int, int] | None:
    """'chr1:1,000-2,000' (quotes allowed) -> ('1', 1000, 2000); empty or ALL -> None, the whole genome. Positions start
    at 1."""
    text = (text or "").strip().strip("\"'")
    if not text or text.upper() == "ALL":
        return None
    if not (m := re.fullmatch(r"(?:chr)?([^:]+):([\d,]+)-([\d,]+)", text)):
        raise ValueError(f"not a region: {text!r}")
    start, end = (int(x.replace(",", "")) for x in m.groups()[1:])
    if start < 1:
        raise ValueError(f"a region starts at 1 at least: {text!r}")
    if start > end:
        raise ValueError(f"a region must not end before it starts: {text!r}")
    return m[1], start, end


def in_region(region: str | None, chrom: str = "chrom", start: str = "s", end: str = "e") -> Column:
    """Condition that a row's interval touches the region; Parquet prunes by it."""
    found = parse_region(region)
    return F.lit(True) if found is None else (F.col(chrom) == found[0]) & (F.col(start) <= found[2]) & (F.col(end) >= found[1])


def existing(spark: SparkSession, *paths: str) -> list[str]:
    """Those of the paths that exist; the others are left out with a warning."""
    found, conf = [], spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            found.append(p)
        else:
            warnings.warn(f"left out, as it does not exist: {p}", stacklevel=2)
    return found


def sam(spark: SparkSession, *paths: str) -> DataFrame:
    """Alignments: qname, flag, chrom, pos (0-based), mapq, cigar, mate_chrom, mate_pos, isize, seq, qual, tags."""
    f = F.split("value", "\t")
    tags = F.transform(F.slice(f, 12, F.size(f)), lambda t: F.struct(F.left(t, F.lit(2)).alias("key"), F.substring(t, F.lit(6), F.length(t)).alias("value")))
    known = lambda c: F.when(c != "*", c)
    lines = spark.read.text(list(paths)).filter(~F.startswith(F.col("value"), F.lit("@")) & (F.size(f) >= 11))
    return lines.select(
        f[0].alias("qname"), f[1].cast("int").alias("flag"), chrom_name(known(f[2])).alias("chrom"), (f[3].cast("long") - 1).alias("pos"), f[4].cast("int").alias("mapq"),
        parse_cigar(f[5]).alias("cigar"), chrom_name(known(F.when(f[6] == "=", f[2]).otherwise(f[6]))).alias("mate_chrom"), (f[7].cast("long") - 1).alias("mate_pos"),
        f[8].cast("int").alias("isize"), known(f[9]).alias("seq"), known(f[10]).alias("qual"), F.map_from_entries(tags).alias("tags"),
    )


def read_groups(spark: SparkSession, *paths: str) -> DataFrame:
    """(id, library) of a SAM header's read groups."""
    lines = spark.read.text(list(paths)).filter(F.col("value").startswith("@RG\t"))
    field = lambda name: F.regexp_extract("value", rf"\t{name}:([^\t]*)", 1)
    return lines.select(field("ID").alias("id"), field("LB").alias("library")).distinct()


def tsv(spark: SparkSession, path: str | list[str], schema: str, header: bool = False) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep="\t", header=header, comment=None if header else "#")


def fields(spark: SparkSession, path: str | list[str], names: list[str], count: int | None = None) -> DataFrame:
    """Lines split at white space; comments, and lines of another number of fields than ``count``, are left out."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    rows = rows if count is None else rows.filter(F.size(f) == count)
    return rows.select(*[F.get(f, F.lit(k)).alias(name) for k, name in enumerate(names)])


def bed(spark: SparkSession, path: str | list[str], names: tuple[str, ...] = ("name", "score", "strand")) -> DataFrame:
    """BED rows as 1-based closed intervals: chrom, start, end and the named columns."""
    rows = fields(spark, path, ["chrom", "start0", "end", *names])
    return rows.select(chrom_name(F.col("chrom")).alias("chrom"), (F.col("start0").cast("long") + 1).alias("start"), F.col("end").cast("long").alias("end"), *names)


def gtf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.size(f) >= 9))
    names = ("gene_id", "transcript_id", "gene_name")
    return rows.select(chrom_name(f[0]).alias("chrom"), f[1].alias("source"), f[2].alias("feature"), f[3].cast("long").alias("start"), f[4].cast("long").alias("end"), f[6].alias("strand"), *[attribute(f[8], n).alias(n) for n in names])


def id_list(spark: SparkSession, path: str | list[str], name: str = "id") -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias(name)).filter(F.col(name) != "").distinct()


def length_distribution(spark: SparkSession, path: str) -> DataFrame:
    """(length, n); the header and lines of other than two fields are left out."""
    rows = fields(spark, path, ["length", "n"], 2)
    return rows.select(F.expr("try_cast(length AS int)").alias("length"), F.expr("try_cast(n AS bigint)").alias("n")).filter("length IS NOT NULL AND n IS NOT NULL")


def kmer_table(spark: SparkSession, path: str) -> DataFrame:
    rows = fields(spark, path, ["kmer", "n"], 2)
    return rows.select("kmer", F.expr("try_cast(n AS bigint)").alias("n")).filter("n IS NOT NULL")


def site_list(spark: SparkSession, path: str, kind: str, name: str | None = None) -> DataFrame:
    """(name, chrom, c, strand) of sites in one of four notations:
    offset (chrom, start, end, name, offset, strand by tabs), sites (chrom:pos:strand), named
    (chrom:start:end:name:strand), nameFirst (name:chrom:start:end:strand)."""
    if kind == "sites" and name is None:
        raise ValueError("sites without names need a name")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split(F.trim("value"), "\t" if kind == "offset" else ":")
    number = lambda k: f[k].cast("long")
    where = {
        "offset": lambda: (f[3], f[0], number(1) + number(4), f[5]),
        "sites": lambda: (F.lit(name), f[0], number(1), f[2]),
        "named": lambda: (f[3], f[0], floor_mid(number(1), number(2)), f[4]),
        "nameFirst": lambda: (f[0], f[1], floor_mid(number(2), number(3)), f[4]),
    }[kind]()
    return rows.select(where[0].alias("name"), chrom_name(where[1]).alias("chrom"), where[2].alias("c"), where[3].alias("strand"))


def _numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their file, split and order inside the split."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    return lines.withColumn("line", F.monotonically_increasing_id())


def _under_headers(lines: DataFrame, header: Column, amount: Column) -> DataFrame:
    """Data lines plus ``head`` (the header line above) and ``before`` (sum of amount from there to here, without
    this line), across splits of a file."""
    rows = lines.withColumns({"_head": F.when(header, F.col("value")), "_amount": F.when(header, 0).otherwise(amount).cast("long")})
    order = Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_sum": F.sum("_amount").over(order)})
    rows = rows.withColumn("_at", F.last(F.when(header, F.struct("_head", "_sum")), ignorenulls=True).over(order))
    per = rows.groupBy("file", "split").agg(F.sum("_amount").alias("_all"), F.max_by("_at", "line").alias("_last"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_base", F.coalesce(F.sum("_all").over(earlier), F.lit(0)))
    marked = F.when(F.col("_last").isNotNull(), F.struct(F.col("_last._head").alias("_head"), (F.col("_base") + F.col("_last._sum")).alias("_sum")))
    per = per.withColumn("_above", F.last(marked, ignorenulls=True).over(earlier)).select("file", "split", "_base", "_above")
    joined = rows.join(per, ["file", "split"])
    own = F.struct(F.col("_at._head").alias("_head"), (F.col("_base") + F.col("_at._sum")).alias("_sum"))
    joined = joined.withColumn("_h", F.when(F.col("_at").isNotNull(), own).otherwise(F.col("_above")))
    out = joined.filter(F.col("_head").isNull() & F.col("_h").isNotNull())
    return out.select("file", "value", F.col("_h._head").alias("head"), (F.col("_base") + F.col("_sum") - F.col("_amount") - F.col("_h._sum")).alias("before"))


def wig(spark: SparkSession, path: str | list[str], value: str = "value") -> DataFrame:
    """(chrom, pos, value) of fixedStep tracks."""
    lines = _numbered(spark, path).filter((F.trim("value") != "") & ~F.col("value").startswith("track") & ~F.col("value").startswith("#"))
    rows = _under_headers(lines, F.col("value").startswith("fixedStep"), F.lit(1))
    field = lambda name, default: F.coalesce(F.expr(f"try_cast(regexp_extract(head, '{name}=([0-9]+)', 1) AS bigint)"), F.lit(default))
    pos = field("start", 1) + F.col("before") * field("step", 1)
    return rows.select(chrom_name(F.regexp_extract("head", r"chrom=(\S+)", 1)).alias("chrom"), pos.alias("pos"), F.col("value").cast("double").alias(value))


def fasta(spark: SparkSession, path: str | list[str], chunk: int = 1 << 16, overlap: int = 0) -> DataFrame:
    """(chrom, chunk_no, chunk_start, seq): each contig in chunks that overlap by ``overlap`` bases."""
    lines = _numbered(spark, path).filter(F.trim("value") != "")
    rows = _under_headers(lines, F.col("value").startswith(">"), F.length(F.trim("value")))
    rows = rows.select(chrom_name(F.regexp_extract("head", r"^>(\S+)", 1)).alias("chrom"), (F.col("before") + 1).alias("start"), F.trim("value").alias("seq"))
    end = F.col("start") + F.length("seq") - 1
    first = F.greatest(F.lit(0), F.floor((F.col("start") - 1 - overlap) / chunk))
    spread = rows.withColumn("chunk_no", F.explode(F.sequence(first, F.floor((end - 1) / chunk))))
    lo, hi = F.col("chunk_no") * chunk + 1, (F.col("chunk_no") + 1) * chunk + overlap
    at = F.greatest(F.col("start"), lo)
    piece = F.substring(F.col("seq"), (at - F.col("start") + 1).cast("int"), (F.least(end, hi) - at + 1).cast("int"))
    kept = spread.filter((end >= lo) & (F.col("start") <= hi)).select("chrom", F.col("chunk_no").cast("int").alias("chunk_no"), at.alias("at"), piece.alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda p: p["piece"]), "")
    return kept.groupBy("chrom", "chunk_no").agg(joined.alias("seq")).select("chrom", "chunk_no", (F.col("chunk_no").cast("long") * chunk + 1).alias("chunk_start"), "seq")


def matrix(spark: SparkSession, path: str, key: str, column: str, value: str) -> DataFrame:
    """A wide table with a header in long form: (key, column, value); empty and NA cells are null."""
    rows = spark.read.csv(path, sep="\t", header=True, nullValue="NA")
    first, *names = rows.columns
    cells = rows.select(F.col(f"`{first}`").alias(key), *[F.expr(f"try_cast(`{n}` AS double)").alias(n) for n in names])
    return cells.unpivot([key], names, column, value)

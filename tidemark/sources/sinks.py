"""Writers. Each is a DataFrame of lines or a partitioned table; where they go is Spark's business."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.intervals import file_name
from tidemark.operators.segment import blocks


PIECE = 1 << 16


def _wig_header(chrom: str, start: Column) -> Column:
    return F.concat(F.lit("fixedStep chrom=chr"), F.col(chrom).cast("string"), F.lit(" start="), start.cast("string"), F.lit(" step=1"))


def wig_lines(track: DataFrame, value: str, chrom: str = "chrom") -> DataFrame:
    """(chrom, block, at, line): fixedStep text, a header before each run of positions."""
    rows = blocks(track.select(chrom, "pos", value), [chrom])
    body = rows.select(chrom, "block", F.col("pos").alias("at"), F.col(value).cast("string").alias("line"))
    head = rows.filter("pos = block").select(chrom, "block", (F.col("block") - 1).alias("at"), _wig_header(chrom, F.col("block")).alias("line"))
    return head.unionByName(body)


def write_wig(track: DataFrame, value: str, path: str, compression: str = "gzip", piece: int = PIECE) -> None:
    """One folder a contig; lines in order within and across part files. Long runs get a header every ``piece``
    positions, so a run needs not fit one task and every file can be read by itself."""
    lines = wig_lines(track, value).withColumn("piece", F.floor(F.greatest(F.col("at") - F.col("block"), F.lit(0)) / piece)).withColumn("part", F.lit(1))
    again = lines.filter((F.col("at") > F.col("block")) & ((F.col("at") - F.col("block")) % piece == 0))
    lines = lines.unionByName(again.withColumns({"line": _wig_header("chrom", F.col("at")), "part": F.lit(0)}))
    ordered = lines.repartitionByRange("chrom", "block", "piece").sortWithinPartitions("chrom", "block", "at", "part")
    ordered.select("chrom", "line").write.partitionBy("chrom").option("compression", compression).text(path)


def bed_rows(peaks: DataFrame) -> DataFrame:
    """Peaks in the caller's BED layout: 0-based start, name chrom:start-end, integer score, +, middle."""
    chrom = F.col("chrom").cast("string")
    name = F.concat(chrom, F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    return peaks.select(F.concat(F.lit("chr"), chrom).alias("chrom"), (F.col("start") - 1).alias("start0"), "end", name.alias("name"), F.col("score").cast("long").alias("score"), F.lit("+").alias("strand"), (F.col("mid") - 1).alias("mid0"), "mid")


def write_tsv(rows: DataFrame, path: str, header: bool = True) -> None:
    rows.write.option("compression", "gzip").csv(path, sep="\t", header=header)


def write_by_key(rows: DataFrame, key: str, path: str, order: list[str] | None = None) -> None:
    """A folder for each value of key, with gzip TSV files inside."""
    named = rows.withColumn(key, file_name(F.col(key).cast("string")))
    placed = named.repartition(key) if order is None else named.repartition(key).sortWithinPartitions(key, *order)
    placed.write.partitionBy(key).option("compression", "gzip").csv(path, sep="\t", header=True)


def fastq_lines(reads: DataFrame) -> DataFrame:
    """(qname, line): four lines a read; reads on the reverse strand are turned back."""
    from tidemark.functions.reads import reverse_complement

    seq = F.when(F.col("reverse"), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    qual = F.when(F.col("reverse"), F.reverse("qual")).otherwise(F.col("qual"))
    return reads.select("qname", F.concat_ws("\n", F.concat(F.lit("@"), F.col("qname")), seq, F.lit("+"), qual).alias("line"))


def numbered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with a line number inside their keys."""
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))

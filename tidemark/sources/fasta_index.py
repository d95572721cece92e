"""Random access to sequence files: an index of lines, built in one parallel pass, and reads of byte ranges on executors.

The index has a row for each stretch of lines of one length: (chrom, first, last, path, offset, bases, width), that is the
stretch's first and last base (from 1), where it begins in the file, and bases and bytes of a line. A contig whose lines are
all alike but the last is two rows at most, plus what splits of the file add; ragged lines cost a row each, and a file's rows
are numbered in one task.

``fetch`` turns requests into byte ranges by a join with the index, so what is read grows with the requests, not with
the file. Files are read as they are: plain text, not compressed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.reads import chrom_name
from tidemark.operators.joins import range_join
from tidemark.sources.bgzf import SPLIT, found, open_file, split_offsets

STRETCHES = "path string, at long, name string, offset long, bases int, width int, lines long"
INDEX = ["chrom", "first", "last", "path", "offset", "bases", "width"]
PIECE, GAP = 1 << 20, 1 << 12


def _lines(path: str, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line with its break) of the lines that begin in [start, stop)."""
    file, size = open_file(path)
    at = max(start - 1, 0)
    file.seek(at)
    held = b""
    if start:  # the line that holds the byte before belongs to the split before
        while (cut := held.find(b"\n")) < 0:
            more = file.read(PIECE)
            if not more:
                return
            at, held = (at + len(held), more) if held else (at, more)
        at, held = at + cut + 1, held[cut + 1 :]
    while at < stop:
        cut = held.find(b"\n")
        if cut < 0:
            more = file.read(max(PIECE, len(held)))
            if not more:
                if held:
                    yield at, held
                return
            held += more
            continue
        # whole lines at once: cutting the front off for each would copy the rest each time
        end = held.rfind(b"\n") + 1
        for line in held[:end].splitlines(keepends=True) if b"\r" not in held[:end] else [x + b"\n" for x in held[:end].split(b"\n")[:-1]]:
            if at >= stop:
                return
            yield at, line
            at += len(line)
        held = held[end:]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Headers (name) and stretches of lines of one length of each split (path, start, stop)."""
    for batch in batches:
        for row in batch.to_pylist():
            out, now = [], None
            for at, line in _lines(row["path"], row["start"], row["stop"]):
                body = line.rstrip(b"\r\n")
                if body.startswith(b">"):
                    name = (body[1:].split() or [b""])[0].decode()
                    out.append((row["path"], at, name, None, None, None, None))
                    now = None
                elif now and now[4] == len(body) and now[5] == len(line):
                    now[6] += 1
                elif body.strip():
                    now = [row["path"], at, None, at, len(body), len(line), 1]
                    out.append(now)
                else:
                    now = None
                if len(out) >= 10_000 and out[-1] is not now:
                    yield _stretches(out)
                    out = []
            yield _stretches(out)


def _stretches(rows: list) -> pa.RecordBatch:
    names = ["path", "at", "name", "offset", "bases", "width", "lines"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def fasta_index(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The index of a file or of the files of a folder, which are read once, each by as many tasks as it has splits."""
    splits = [(p, a, b) for p, size in found(path, "") for a, b in split_offsets(size, split)]
    work = spark.createDataFrame(splits, "path string, start long, stop long").repartition(max(1, len(splits)), "path", "start")
    rows = work.mapInArrow(_scan, STRETCHES)
    order = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_head", F.last(F.when(F.col("name").isNotNull(), F.struct("name", "at")), ignorenulls=True).over(order))
    size = F.col("bases") * F.col("lines")
    inside = Window.partitionBy("path", "_head").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.filter(F.col("name").isNull() & F.col("_head").isNotNull()).withColumn("last", F.sum(size).over(inside))
    return rows.select(chrom_name(F.col("_head.name")).alias("chrom"), (F.col("last") - size + 1).alias("first"), "last", "path", "offset", "bases", "width")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of ranges (path, from_byte, to_byte) without line breaks; ranges of a file that lie close are read at once."""
    open_path, file = None, None
    for batch in batches:
        rows, pieces, k = batch.to_pylist(), [None] * batch.num_rows, 0
        order = sorted(range(len(rows)), key=lambda i: (rows[i]["path"], rows[i]["from_byte"]))
        while k < len(order):
            first = rows[order[k]]
            stop, end = k + 1, first["to_byte"]
            while stop < len(order) and (r := rows[order[stop]])["path"] == first["path"] and r["from_byte"] <= end + GAP and max(end, r["to_byte"]) - first["from_byte"] <= PIECE:
                end, stop = max(end, r["to_byte"]), stop + 1
            if first["path"] != open_path:
                open_path, (file, _) = first["path"], open_file(first["path"])
            file.seek(first["from_byte"])
            data = file.read(end - first["from_byte"])
            for i in order[k:stop]:
                a = rows[i]["from_byte"] - first["from_byte"]
                pieces[i] = data[a : a + rows[i]["to_byte"] - rows[i]["from_byte"]].replace(b"\n", b"").replace(b"\r", b"").decode()
            k = stop
        yield pa.RecordBatch.from_arrays([batch["_key"], batch["at"], pa.array(pieces, pa.string())], names=["_key", "at", "piece"])


def byte_ranges(requests: DataFrame, index: DataFrame, bin_size: int = 1 << 20) -> DataFrame:
    """requests (_key, chrom, start, end) as ranges of bytes: (_key, at, path, from_byte, to_byte), ``at`` the first base."""
    some = range_join(requests, index, "chrom", ("start", "end"), ("first", "last"), bin_size)
    lo, hi = F.greatest("start", "first"), F.least("end", "last")
    byte = lambda base: F.col("offset") + F.floor((base - F.col("first")) / F.col("bases")) * F.col("width") + (base - F.col("first")) % F.col("bases")
    return some.select("_key", lo.alias("at"), "path", byte(lo).alias("from_byte"), (byte(hi) + 1).alias("to_byte"))


def fetch(requests: DataFrame, index: DataFrame, start: str = "start", end: str = "end", chrom: str = "chrom") -> DataFrame:
    """requests plus ``seq``: the bases start..end (from 1, both included) of the contig, shorter where it ends before and
    null where it has none of them.

    Each distinct range is read once. Ranges are dealt to tasks by file and megabyte, so neighbours are read together."""
    keys = F.struct(F.col(chrom).alias("chrom"), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"))
    wanted = requests.select(keys.alias("_key")).distinct().select("_key", "_key.*").filter("start <= end")
    ranges = byte_ranges(wanted, index)
    dealt = ranges.repartition("path", F.floor(F.col("from_byte") / PIECE))
    kind = dealt.schema["_key"].dataType.simpleString()
    pieces = dealt.mapInArrow(_read, f"_key {kind}, at long, piece string")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda p: p["piece"]), "")
    seqs = pieces.groupBy("_key").agg(joined.alias("seq"))
    return requests.withColumn("_asked", keys).join(seqs, F.col("_asked") == F.col("_key"), "left").drop("_asked", "_key")

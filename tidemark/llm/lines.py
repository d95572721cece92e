"""Line deduplication by range-partitioned hashes.

1. Every line's key (stripped of ASCII white space, A-Z lower-cased) becomes a 128-bit hash; keys of at least
   ``min_chars`` code points go on with their document and position. No text is shuffled.
2. Hashes are range-partitioned by (hash, document) and sorted by (hash, document, position). The document is
   part of the range, so a line that a third of all documents hold spreads over as many tasks as it needs.
3. Each partition is streamed once. A hash's first document in order keeps its lines, those of later documents
   are dropped. Only the first run of a partition may have begun before it: the lines of its first document
   wait, and each partition also tells its first and last hash with their first documents. These few rows, two
   a partition at most, decide the waiting lines.
4. Drops are collected per document into a compressed bitmap of kept lines, which is what the operator returns.

Defined cases: a null or empty text is one empty line, which is too short to be dropped; a line repeated within
one document stays as often as it occurs where the document is its first; rows with equal ids and equal texts
share their verdict, and rows with equal ids and other texts are separate versions of one document: they do not
drop each other's lines; a null id counts as the smallest; other columns are carried, never read."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.llm.common import ascii_lower, bound_batches, fields_of_row, partitions, release, scratch, whole_row, written

BLANKS = " \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)
STREAMED = "kind int, h1 long, h2 long, doc long, version long, pos int"


def _doc(id_col: str):
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))


def _version(text_col: str):
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def n_lines(text):
    full = F.coalesce(text, F.lit(""))
    return (F.length(full) - F.length(F.replace(full, F.lit("\n"), F.lit(""))) + 1).cast("long")


def _stream(batches):
    """kind 0: a line to drop; 1: a line that waits; 2: the first document seen here of the first or last hash."""
    names = ["h1", "h2", "doc", "version", "pos"]
    key, first, opening = None, 0, True  # of the run that the last batch ended in
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, version, pos = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in names)
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = key != (h1[0], h2[0])
        if key is None:
            yield _batch(np.array([2]), h1[:1], h2[:1], doc[:1], version[:1], pos[:1])
        run = np.cumsum(new)  # 0: goes on from the last batch
        firsts = np.concatenate([[first], doc[new]])[run]
        opens = (run == (1 if key is None else 0)) & opening
        drop, wait = doc != firsts, opens & (doc == firsts)
        some = drop | wait
        yield _batch(np.where(wait, 1, 0)[some], h1[some], h2[some], doc[some], version[some], pos[some])
        opening = bool(opens[-1])
        key, first = (h1[-1], h2[-1]), firsts[-1]
    if key is not None:
        one = np.array([key[0]]), np.array([key[1]]), np.array([first])
        yield _batch(np.array([2]), *one, np.array([0]), np.array([0]))


def _batch(kind, h1, h2, doc, version, pos):
    return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), *(pa.array(np.asarray(x, np.int64)) for x in (h1, h2, doc, version)), pa.array(np.asarray(pos, np.int32))], names=["kind", "h1", "h2", "doc", "version", "pos"])


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, parts: int | None = None) -> DataFrame:
    """(doc, version, pos) of the lines that an earlier document holds."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = docs.select(_doc(id_col).alias("doc"), _version(text_col).alias("version"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    key = ascii_lower(F.trim(F.col("line"), F.lit(BLANKS)))
    keyed = lines.select("doc", "version", "pos", key.alias("key")).filter(F.length("key") >= min_chars)
    hashed = keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "doc", "version", "pos")
    parts = parts or partitions(docs.sparkSession)
    with scratch(docs.sparkSession):
        hashed = written(hashed, "line-hashes")  # the range partitioner reads its input twice
        ordered = hashed.repartitionByRange(parts, "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "pos")
        found = written(ordered.mapInArrow(_stream, STREAMED), "lines", keep=True)
    starts = found.filter("kind = 2").groupBy("h1", "h2").agg(F.min("doc").alias("first"))
    waiting = found.filter("kind = 1").join(starts, ["h1", "h2"]).filter("first < doc")
    return found.filter("kind = 0").select("doc", "version", "pos").unionByName(waiting.select("doc", "version", "pos"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, parts: int | None = None) -> DataFrame:
    """One row for each document version that loses lines: doc, version, n_dropped, keep_bitmap (zlib of one bit
    a line up to the last dropped one, first line in the highest bit; lines beyond stay)."""
    drops = dropped_lines(docs, id_col, text_col, min_chars, parts).groupBy("doc", "version").agg(F.collect_set("pos").alias("drops"))

    def compress(batches):
        for batch in batches:
            bitmaps = []
            for drops in batch.column(2):
                at = drops.values.to_numpy()
                keep = np.ones((int(at.max()) // 8 + 1) * 8, np.uint8)
                keep[at] = 0
                bitmaps.append(zlib.compress(np.packbits(keep).tobytes()))
            sizes = pa.compute.list_value_length(batch.column(2)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, pa.array(bitmaps, pa.binary())], names=["doc", "version", "n_dropped", "keep_bitmap"])

    return drops.mapInArrow(compress, "doc long, version long, n_dropped long, keep_bitmap binary")


def kept_text(text: str | None, bitmap: bytes | None) -> str:
    lines = (text or "").split("\n")
    if bitmap is not None:
        keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)]
        lines = [x for k, x in enumerate(lines) if k >= len(keep) or keep[k]]
    return "\n".join(lines)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, parts: int | None = None) -> DataFrame:
    """docs' columns with the text of kept lines, plus n_lines (before) and n_dropped (which replace columns of
    these names)."""
    bound_batches(docs.sparkSession)
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_chars, parts).withColumnRenamed("doc", "doc2").withColumnRenamed("version", "version2")
    at_text = docs.columns.index(text_col)
    rows = docs.select(whole_row(docs), _doc(id_col).alias("doc"), _version(text_col).alias("version"))
    joined = rows.join(bitmaps, (F.col("doc") == F.col("doc2")) & (F.col("version") == F.col("version2")), "left").select("row", "n_dropped", "keep_bitmap")

    def restore(batches):
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            texts = [kept_text(t, b) for t, b in zip(batch.column(0).field(at_text).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["row", "n_dropped", "cut"])
        release()

    text = F.col("row").getField(text_col)
    whole = joined.filter("keep_bitmap IS NULL").select("row", F.lit(0).cast("long").alias("n_dropped"), F.coalesce(text, F.lit("")).alias("cut"))
    schema = StructType([*joined.schema.fields[:2], StructField("cut", StringType())])
    out = whole.unionByName(joined.filter("keep_bitmap IS NOT NULL").mapInArrow(restore, schema))
    fields = fields_of_row(docs.columns, ("n_lines", "n_dropped"), **{text_col: F.col("cut")})
    return out.select(*fields, n_lines(text).alias("n_lines"), "n_dropped")

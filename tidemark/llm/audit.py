"""Filter interaction audit: what five filters remove in each of their 120 orders.

A document's failures are five bits. A table made once has, for each of the 32 combinations and 120 orders, the step at
which the first failure removes the document; so a pass over the documents counts removals by part, order, step and label
without applying any order. Tasks hold one array of counts a part, and hand on a row for each part and order; these rows
are summed. All other figures follow from the removals: a filter's failures are what it removes as the first, its unique
failures what it removes as the last.

Whether a text repeats is settled by the smallest id of each SHA-256 of a text; rows of a large group of copies are dealt
to several tasks. Everything that shuffles is a fixed number of bytes a document.

Defined cases: a null text counts as empty, a null part as the empty string; a null id is neither smaller nor larger than
any other; rows with equal ids are rows of their own, and none is a repetition of the other; a document is good or toxic
if any of its labels says so, null labels say nothing, and labels without a document are ignored; no documents give no
rows; other columns are never read."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from tidemark.llm.common import bound_batches, release, with_groups, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS, PARTS_HELD = len(FILTERS), 512
COUNTS = [f"{kind}{step}" for kind in ("n", "good", "toxic") for step in range(STEPS + 1)]


def first_failures() -> np.ndarray:
    """[combination of failures, order] -> the step (from 0) whose filter fails first, STEPS where none does."""
    combinations, table = np.arange(1 << STEPS), np.full((1 << STEPS, len(ORDERS)), STEPS, "int64")
    for k, order in enumerate(ORDERS):
        for step in reversed(range(STEPS)):
            table[(combinations >> FILTERS.index(order[step])) & 1 == 1, k] = step
    return table


def failures(text: bytes, least_words: int = 50, distinct_percent: int = 65, upper_percent: int = 5, symbols: bytes = b"#$%&*|") -> int:
    """The bits of A to D: few words, few distinct ones, many capitals, a symbol."""
    words, codes = text.split(), np.frombuffer(text, "uint8")
    upper, points = np.count_nonzero((codes >= 65) & (codes <= 90)), np.count_nonzero(codes & 0xC0 != 0x80)
    few, dull, loud = len(words) < least_words, 100 * len(set(words)) < distinct_percent * len(words), 100 * upper > upper_percent * points
    return few | dull << 1 | bool(loud) << 2 | (re.search(b"[" + re.escape(symbols) + b"]", text) is not None) << 3


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x or b"" for x in batch["text"].to_pylist()]
        bits = pa.array([failures(x) for x in texts], pa.int32())
        yield pa.RecordBatch.from_arrays([batch["_id"], batch["part"], bits, pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())], names=["_id", "part", "bits", "digest"])
    release()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, orders, held = first_failures(), np.arange(len(ORDERS)), {}

    def partial() -> Iterator[pa.RecordBatch]:
        for part, counts in held.items():
            by = counts.reshape(len(ORDERS), STEPS + 1, 4)
            columns = np.concatenate([by.sum(2), by[:, :, 1] + by[:, :, 3], by[:, :, 2] + by[:, :, 3]], 1).T
            yield pa.RecordBatch.from_pydict({"part": [part] * len(ORDERS), "order_no": pa.array(orders, pa.int32()), **{c: pa.array(x) for c, x in zip(COUNTS, columns, strict=True)}})
        held.clear()

    for batch in batches:
        parts = batch["part"].dictionary_encode()
        cell = parts.indices.to_numpy() * 128 + batch["bits"].to_numpy() * 4 + batch["label"].to_numpy()
        cells, times = np.unique(cell, return_counts=True)
        for no in np.unique(cells // 128):
            some = cells // 128 == no
            failed, label = cells[some] % 128 // 4, cells[some] % 4
            places = (orders * (STEPS + 1) + table[failed]) * 4 + label[:, None]
            counts = np.bincount(places.ravel(), np.repeat(times[some], len(ORDERS)), len(ORDERS) * (STEPS + 1) * 4).astype("int64")
            part = parts.dictionary[int(no)].as_py()
            held[part] = held[part] + counts if part in held else counts
        if len(held) > PARTS_HELD:
            yield from partial()
    yield from partial()


def labelled(rows: DataFrame, labels: DataFrame, id_col: str, good: str, toxic: str) -> DataFrame:
    """rows (_id) plus ``label``: 1 for good, 2 for toxic, 3 for both."""
    says = lambda c: F.max(F.coalesce((F.col(f"`{c}`") == 1).cast("int"), F.lit(0)))
    per = labels.filter(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("_id")).agg((says(good) + 2 * says(toxic)).alias("_label"))
    return rows.join(per, "_id", "left").withColumn("label", F.coalesce("_label", F.lit(0))).drop("_label")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part,
    order and step."""
    bound_batches(docs.sparkSession)
    rows = docs.select(docs[f"`{id_col}`"].alias("_id"), F.coalesce(docs[f"`{part_col}`"].cast("string"), F.lit("")).alias("part"), docs[f"`{text_col}`"].cast("binary").alias("text"))
    schema = StructType([rows.schema["_id"], StructField("part", StringType()), StructField("bits", IntegerType()), StructField("digest", BinaryType())])
    rows = written(rows.mapInArrow(_measured, schema), "measured")
    groups = rows.groupBy("digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_size"))
    rows = with_groups(rows, groups, ["digest"], "_size", rows.count(), ["_id"])
    again = F.coalesce(F.col("_id") > F.col("_first"), F.lit(False)).cast("int")
    rows = rows.select("_id", "part", (F.col("bits") + F.shiftleft(again, 4)).alias("bits"))
    rows = labelled(rows, labels, id_col, good, toxic).select("part", "bits", "label")
    partial = rows.mapInArrow(_counted, "part string, order_no int, " + ", ".join(f"{c} long" for c in COUNTS))
    return _figures(written(partial.groupBy("part", "order_no").agg(*[F.sum(c).alias(c) for c in COUNTS]), "removals"))


def _figures(sums: DataFrame) -> DataFrame:
    """The figures of every step from the removals: 120 rows a part in, 600 out."""
    total = sum((F.col(f"n{k}") for k in range(STEPS + 1)), F.lit(0))
    gone = lambda k: sum((F.col(f"n{j}") for j in range(k + 1)), F.lit(0))
    step = lambda k: F.struct(F.lit(k + 1).alias("step"), (total - gone(k)).alias("kept"), F.col(f"n{k}").alias("removed"), F.col(f"good{k}").alias("good_lost"), F.col(f"toxic{k}").alias("toxic_lost"))
    name = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("order_no") + 1)
    rows = sums.select("part", name.alias("filter_order"), F.inline(F.array(*map(step, range(STEPS)))))
    same = Window.partitionBy("part", F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    fails, unique = (F.max(F.when(F.col("step") == at, F.col("removed"))).over(same) for at in (1, STEPS))
    figures = {"redundant": fails - F.col("removed"), "unique_fails": unique, "shapley": F.sum("removed").over(same)}
    return rows.withColumns(figures).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

"""Stateful operators on streams. All take a streaming DataFrame with an event-time column; the same calls work on
a batch DataFrame where Spark allows it.

Lateness is a watermark: the tools this replaces keep a buffer of reads or motifs and flush what lies far enough
behind the current position. Time plays the part of the position along a contig."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.streaming.medians import CentredMedian

STEP = 50_000  # rows whose medians are given out together

def binned(stream: DataFrame, ts: str, keys: list[str], size: str, slide: str | None, lateness: str, *measures: Column) -> DataFrame:
    """(start, keys, measures) of tumbling or sliding windows."""
    late = stream.withWatermark(ts, lateness) if stream.isStreaming else stream
    grouped = late.groupBy(F.window(ts, size, slide).alias("w"), *keys).agg(*measures)
    return grouped.select(F.col("w.start").alias("start"), *[c for c in grouped.columns if c != "w"])


def merged(stream: DataFrame, ts: str, keys: list[str], gap: str, lateness: str) -> DataFrame:
    """Events of a key closer than ``gap`` as one interval: (keys, start, end, n). A row leaves once the watermark
    has passed its end, as a buffered interval leaves once the position is far enough beyond it."""
    late = stream.withWatermark(ts, lateness) if stream.isStreaming else stream
    grouped = late.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.max(ts).alias("end"))
    return grouped.select(*keys, F.col("w.start").alias("start"), "end", "n")


def first_of(stream: DataFrame, ts: str, keys: list[str], lateness: str) -> DataFrame:
    """The first row of each key within the lateness: duplicates that arrive later than that pass as new."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def paired(first: DataFrame, second: DataFrame, keys: list[str], ts: str, lateness: str) -> DataFrame:
    """Mates of two streams; a read whose mate does not come within the lateness is dropped."""
    a = first.withWatermark(ts, lateness).alias("a")
    b = second.withWatermark(ts, lateness).alias("b")
    span = F.expr(f"INTERVAL {lateness}")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    close = (F.col(f"b.{ts}") >= F.col(f"a.{ts}") - span) & (F.col(f"b.{ts}") <= F.col(f"a.{ts}") + span)
    rest = [c for c in first.columns if c not in keys]
    return a.join(b, [*same, close]).select(*[F.col(f"a.{k}").alias(k) for k in keys], *[F.col(f"{side}.{c}").alias(f"{c}_{n}") for side, n in (("a", 1), ("b", 2)) for c in rest])


def running_median(stream: DataFrame, key: str, pos: str, value: str, size: int) -> DataFrame:
    """(key, pos, value, median): the centred median of ``size`` rows, given out half a frame late. State is the last
    ``size`` rows of a key; rows must come in order. A frame at the stream's start is held inside it."""
    fields = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = f"{key} {fields[key]}, {pos} long, {value} double, median double"

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window = CentredMedian(size, state.get if state.exists else None)
        rows = pd.concat([b[[pos, value]] for b in batches]).sort_values(pos)
        for at in range(0, len(rows), STEP):
            some = rows.iloc[at : at + STEP]
            ready = [r for p, v in zip(some[pos].tolist(), some[value].astype(float).tolist(), strict=True) for r in window.push(p, v)]
            yield pd.DataFrame({key: group[0], pos: [r[0] for r in ready], value: [r[1] for r in ready], "median": [r[2] for r in ready]})
        state.update(window.state)

    return stream.select(key, pos, value).groupBy(key).applyInPandasWithState(step, out, "at array<long>, held array<double>, slid boolean", "append", GroupStateTimeout.NoTimeout)


def run_peaks(run: list[int], values: list[float], shortest: int, longest: int, cutoff: float) -> list[tuple]:
    """(start, end, mid, score) of one run of positive values, by the rules of ``segment.peaks``."""
    size = run[-1] - run[0] + 1
    if not shortest <= size <= 3 * longest:
        return []
    full = np.zeros(size)
    full[np.asarray(run) - run[0]] = values
    low = np.sort(full)
    middle = low[size // 2] if size % 2 == 0 else (low[(size - 1) // 2] + low[min(size - 1, (size + 1) // 2)]) / 2
    high = np.flatnonzero(full >= middle)
    stretches = [(float(full[s].sum()), int(s[0]), int(s[-1]), float(full[s].max())) for s in np.split(high, np.flatnonzero(np.diff(high) > 1) + 1)]
    chosen = [max(stretches)] if size <= longest else [s for s in stretches if shortest <= s[2] - s[1] + 1 <= longest]
    return [(run[0] + a, run[0] + b, run[0] + a + int((b - a) * 0.5 + 0.5), top) for _, a, b, top in chosen if top > cutoff]


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there, into Parquet below path, and reads that. path and checkpoint lie in a
    folder that all executors share."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_in_batches(rows: DataFrame, batch: Column, build: Callable[[DataFrame], DataFrame], path: str, end: DataFrame | None = None) -> DataFrame:
    """Runs the stream that ``build`` makes of rows arriving in the order of a whole number ``batch``: a micro-batch for each of
    its values, and one for the rows of ``end``. The files of a batch are as many as its rows ask for; all tasks write and read
    their share of them. Rows without a number are left out."""
    spark, pieces = rows.sparkSession, f"{path}/parts"
    rows.withColumn("_batch", batch.cast("long")).filter("_batch IS NOT NULL").write.partitionBy("_batch").parquet(f"{path}/whole")
    names = spark.read.parquet(f"{path}/whole").select("_batch").distinct().collect()
    whole = spark.read.schema(rows.select("*", F.lit(0).cast("long").alias("_batch")).schema).parquet(f"{path}/whole")
    arriving = [whole.filter(F.col("_batch") == n).drop("_batch") for n in sorted(int(r[0]) for r in names)] + ([] if end is None else [end])
    empty = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(empty)
    try:
        for k, some in enumerate(arriving or [rows.limit(0)]):
            some.write.mode("append").parquet(pieces)
            spark.conf.set(empty, before if k + 1 == len(arriving) else "false")  # what is open waits for the next rows
            out = run_once(build(follow(spark, pieces, "*.parquet", rows.schema, 1 << 30)), f"{path}/out", f"{path}/state")
    finally:
        spark.conf.set(empty, before)
    return out


def follow(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int = 8) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

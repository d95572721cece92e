"""The peak caller on streams, to the end of input.

A key's rows come in order of position over any number of micro-batches. State is the window of the running median and the
open run, of which no more than 3 * longest positions can become a peak, so it is bounded whatever the stream's length.

A key ends with a row whose position is null (``end_marks`` makes them), or, where an event time and ``idle`` are given, once
the watermark has passed its last row by ``idle``: then a timer fires. Ending gives out the last half frame and the open run,
and clears the state. A gap between positions ends the median's block, not the run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.streaming.medians import CentredMedian
from tidemark.streaming.streams import run_peaks

STATE = "seen boolean, places binary, held binary, slid boolean, run binary, above binary, last long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PeakCaller(StatefulProcessor):
    def __init__(self, key: str, pos: str, value: str, size: int, shortest: int, longest: int, cutoff: float, max_gap: int, idle_ms: int | None):
        self.names, self.size, self.rules, self.max_gap, self.idle_ms = (key, pos, value), size, (shortest, longest, cutoff), max_gap, idle_ms

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("open", STATE)

    def _load(self) -> None:
        self.run, self.above, self.last, kept = [], [], None, None
        if self.state.exists():
            seen, places, held, slid, run, above, self.last = self.state.get()
            ints, floats = (lambda x: np.frombuffer(bytes(x), "int64").tolist()), (lambda x: np.frombuffer(bytes(x), "float64").tolist())
            kept, self.run, self.above = (ints(places), floats(held), slid), ints(run), floats(above)
        self.median = CentredMedian(self.size, kept)

    def _store(self) -> None:
        places, held, slid = self.median.state
        packed = lambda x, kind: np.asarray(x, kind).tobytes()
        self.state.update((True, packed(places, "int64"), packed(held, "float64"), slid, packed(self.run, "int64"), packed(self.above, "float64"), self.last))

    def _take(self, rows: list[tuple]) -> list[tuple]:
        """Peaks of the runs that these rows end."""
        out, longest = [], self.rules[1]
        for place, value, middle in rows:
            if self.run and place - self.run[-1] > self.max_gap + 1:
                out += run_peaks(self.run, self.above, *self.rules)
                self.run, self.above = [], []
            if value - middle > 0:
                if len(self.run) > 3 * longest:  # too long for a peak already: its first and last place say so
                    self.run, self.above = [self.run[0]], self.above[:1]
                self.run.append(place)
                self.above.append(value - middle)
        return out

    def _end(self) -> list[tuple]:
        out = self._take(self.median.close())
        out += run_peaks(self.run, self.above, *self.rules) if self.run else []
        self.run, self.above, self.last = [], [], None
        return out

    def _frame(self, key: tuple, peaks: list[tuple]) -> pd.DataFrame:
        columns = {c: np.array([p[k] for p in peaks], "float64" if c == "score" else "int64") for k, c in enumerate(("start", "end", "mid", "score"))}
        return pd.DataFrame({self.names[0]: pd.Series([key[0]] * len(peaks), dtype="object"), **columns})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        _, pos, value = self.names
        self._load()
        frame = pd.concat(list(rows)).sort_values(pos, na_position="last")
        whole, out = frame[frame[pos].notna()], []
        for place, v in zip(whole[pos].astype("int64").tolist(), whole[value].astype("float64").tolist(), strict=True):
            if self.last is not None and place != self.last + 1:
                out += self._take(self.median.close())
            out += self._take(self.median.push(place, v))
            self.last = place
        ended = len(whole) < len(frame)
        if ended:
            out += self._end()
            self.state.clear()
        else:
            self._store()
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if not ended:
                self.handle.registerTimer(int(frame["event_ms"].max()) + self.idle_ms)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        out = self._end()
        self.state.clear()
        yield self._frame(key, out)

    def close(self) -> None:
        pass


def peaks(stream: DataFrame, key: str, pos: str, value: str, size: int = 1000, shortest: int = 50, longest: int = 150, cutoff: float = 5, max_gap: int = 4, ts: str | None = None, idle: float | None = None) -> DataFrame:
    """(key, start, end, mid, score): peaks of the track less its running median. ts: an event time with a watermark; idle:
    seconds after which a silent key ends. The state store becomes RocksDB's, which this kind of state needs."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    fields = {f.name: f.dataType.simpleString() for f in stream.schema}
    timed = ts is not None and idle is not None
    rows = stream.select(key, pos, value, *([ts, (F.unix_micros(ts) / 1000).cast("long").alias("event_ms")] if timed else []))
    caller = PeakCaller(key, pos, value, size, shortest, longest, cutoff, max_gap, int(idle * 1000) if timed else None)
    schema = f"{key} {fields[key]}, start long, end long, mid long, score double"
    return rows.groupBy(key).transformWithStateInPandas(caller, schema, "Append", "EventTime" if timed else "None")


def end_marks(keys: DataFrame, key: str, schema) -> DataFrame:
    """A row for each key that ends it: every other column null."""
    names = [f.name for f in schema]
    return keys.select(key).distinct().select(*[F.col(key) if n == key else F.lit(None).cast(schema[n].dataType).alias(n) for n in names])

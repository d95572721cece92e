"""Periodograms of region signals."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.recurrence import recursive_filter

FILTER = [1 / k for k in range(5, 101, 4)]
AT_ONCE = 64  # regions that a task transforms together


def smooth_length(n: int) -> int:
    """Smallest number from n on with no prime factor above 5."""
    while True:
        m = n
        for f in (2, 3, 5):
            while m % f == 0:
                m //= f
        if m == 1:
            return n
        n += 1


def prefilter(values: np.ndarray, repeat: int = 300, trim: float = 0.1) -> np.ndarray:
    """Recursive filter along the last axis, warmed up by the first ``repeat`` values, less its trimmed mean."""
    head = values[..., :repeat]
    y = recursive_filter(np.concatenate([head, values], -1), FILTER)[..., head.shape[-1] :]
    n = y.shape[-1]
    cut = int(n * trim)
    return y - np.sort(y, -1)[..., cut : n - cut].mean(-1, keepdims=True)


def taper(n: int, share: float) -> np.ndarray:
    """Split cosine bell over ``share`` of either end."""
    m = int(n * share)
    edge = 0.5 * (1 - np.cos(np.pi * np.arange(1, 2 * m, 2) / (2 * m)))
    return np.concatenate([edge, np.ones(n - 2 * m), edge[::-1]])


def periodogram(values: np.ndarray, pad: float = 0.3, share: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and smoothed spectrum along the last axis: linear trend removed, tapered, padded, raw periodogram with the
    value at zero frequency from its neighbours, three-point Daniell weights (1/4, 1/2, 1/4), scaled by the taper's power."""
    n = values.shape[-1]
    t = np.arange(n) - (n - 1) / 2
    x = values - values.mean(-1, keepdims=True) - (values @ t / (t @ t))[..., None] * t
    x = x * taper(n, share)
    size = smooth_length(int(n * (1 + pad)))
    power = np.abs(np.fft.fft(x, size)) ** 2 / n
    power[..., 0] = 0.5 * (power[..., 1] + power[..., -1])
    flat = 0.25 * np.roll(power, 1, -1) + 0.5 * power + 0.25 * np.roll(power, -1, -1)
    keep = np.arange(1, size // 2 + 1)
    return keep / size, flat[..., keep] / (1 - 5 / 8 * share * 2)


def spectra(pieces: DataFrame, key: str, order: str, values: list[str], lo: float = 120, hi: float = 280, least: int = 600, some: str | None = None) -> DataFrame:
    """(key, freq, values): spectrum of each series of a region at periods in [lo, hi]; ``freq`` is the rounded period. Shorter
    regions give nothing, nor do those whose values of the column ``some`` do not sum to more than zero.

    pieces: key, order and arrays of values (``signal.region_pieces``). Pieces, not positions, are dealt out by region and
    sorted; a task puts regions together one after another and transforms some at once, so none is held whole but those."""
    fields = {f.name: f.dataType.simpleString() for f in pieces.schema}
    schema = f"{key} {fields[key]}, freq int, " + ", ".join(f"{v} double" for v in values)
    some_at = values.index(some) if some else None

    def whole(batches):
        """(type of the key, key, values by positions) of each region, from pieces in order."""
        kind, last, held = None, None, []
        for batch in batches:
            kind = batch.column(0).type
            cells = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in batch.columns[1:]]
            for i, k in enumerate(batch.column(0).to_pylist()):
                if held and k != last:
                    yield kind, last, np.concatenate(held, -1)
                    held = []
                last = k
                held.append(np.array([v[at[i] : at[i + 1]] for at, v in cells], float))
        if held:
            yield kind, last, np.concatenate(held, -1)

    def found(kind: pa.DataType, keys: list, series: list[np.ndarray]) -> pa.RecordBatch:
        x = np.stack(series)
        freq, power = periodogram(prefilter(x.reshape(-1, x.shape[-1])))
        inside = (1 / freq >= lo) & (1 / freq <= hi)
        power = power[:, inside].reshape(len(keys), len(values), -1)
        periods = np.round(1 / freq[inside]).astype(np.int32)
        columns = [pa.array(np.tile(periods, len(keys)))] + [pa.array(power[:, j].ravel()) for j in range(len(values))]
        return pa.RecordBatch.from_arrays([pa.array([k for k in keys for _ in periods], kind), *columns], names=[key, "freq", *values])

    def run(batches):
        waiting: dict[int, tuple[list, list]] = {}  # by length
        for kind, k, x in whole(batches):
            n = x.shape[-1]
            if n < least or some_at is not None and not x[some_at].sum() > 0:
                continue
            keys, series = waiting.setdefault(n, ([], []))
            keys.append(k)
            series.append(x)
            if sum(len(s) for _, s in waiting.values()) >= AT_ONCE:
                yield from (found(kind, *w) for w in waiting.values())
                waiting = {}
        yield from (found(kind, *w) for w in waiting.values())

    dealt = pieces.select(key, order, *values).repartition(key).sortWithinPartitions(key, order)
    return dealt.select(key, *values).mapInArrow(run, schema)


def dft_power(signal: Column, periods: list[int]) -> Column:
    """Array of |sum of v * exp(-2 pi i t / period)|**2 / n of an array column, for each period."""
    n = F.size(signal)

    def part(period: int, wave) -> Column:
        step = 2 * math.pi / period
        return F.aggregate(F.transform(signal, lambda v, t: v.cast("double") * wave(t * F.lit(step))), F.lit(0.0), lambda a, x: a + x)

    return F.array(*[(F.pow(part(p, F.cos), F.lit(2)) + F.pow(part(p, F.sin), F.lit(2))) / n for p in periods])

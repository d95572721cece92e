"""Linear recurrences over many series at once, tile by tile."""

from __future__ import annotations

import numpy as np


def responses(weights: tuple[float, ...], tile: int) -> tuple[np.ndarray, np.ndarray]:
    """What the outputs of a tile take from its own inputs, and from the outputs before it, the latest first."""
    order = len(weights)
    before = np.zeros((tile + order, order))
    before[order - 1 - np.arange(order), np.arange(order)] = 1
    impulse = np.zeros(tile + order)
    w = np.asarray(weights)[::-1]
    for t in range(tile):
        before[t + order] = w @ before[t : t + order]
        impulse[t + order] = (t == 0) + w @ impulse[t : t + order]
    lag = np.arange(tile)[:, None] - np.arange(tile)
    return np.where(lag >= 0, impulse[order:][np.maximum(lag, 0)], 0), before[order:]


_KNOWN: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def recursive_filter(values: np.ndarray, weights: list[float], tile: int = 128) -> np.ndarray:
    """y[t] = x[t] + sum of weights[j] * y[t - j - 1] along the last axis, from rest. A tile's outputs are two products of
    matrices: of its inputs, and of the last outputs before it, which are all that a tile hands on."""
    x = np.atleast_2d(np.asarray(values, float))
    n, order = x.shape[1], len(weights)
    key = (tuple(weights), max(tile, order))
    own, before = _KNOWN.get(key) or _KNOWN.setdefault(key, responses(*key))
    tile = len(own)
    padded = np.zeros((x.shape[0], -(-n // tile) * tile))
    padded[:, :n] = x
    last = np.zeros((x.shape[0], order))
    for at in range(0, padded.shape[1], tile):
        padded[:, at : at + tile] = padded[:, at : at + tile] @ own.T + last @ before.T
        last = padded[:, at + tile - order : at + tile][:, ::-1]
    return padded[:, :n].reshape(np.shape(values))

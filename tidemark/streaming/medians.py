"""Order statistics of a window that slides over rows in order."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque


class SlidingMedian:
    """The last ``size`` values in order of arrival and in order of size: a step costs two binary searches."""

    def __init__(self, size: int, values=()):
        self.size, self.held, self.sorted = size, deque(values), sorted(values)

    @property
    def full(self) -> bool:
        return len(self.held) == self.size

    def push(self, value: float) -> None:
        if self.full:
            del self.sorted[bisect_left(self.sorted, self.held.popleft())]
        self.held.append(value)
        insort(self.sorted, value)

    def median(self) -> float:
        half = self.size // 2
        return self.sorted[half] if self.size % 2 else (self.sorted[half - 1] + self.sorted[half]) / 2


class CentredMedian:
    """(place, value, median) of rows in order, given out half a frame late: ``push`` gives the rows that a new one completes,
    ``close`` the last half frame. The first and last frames serve the rows at the ends; fewer rows than a frame give
    nothing, exactly as many nothing for the first."""

    def __init__(self, size: int, state: tuple | None = None):
        places, values, self.slid = state or ((), (), False)
        self.size, self.half, self.places, self.window = size, size // 2, deque(places), SlidingMedian(size, values)

    @property
    def state(self) -> tuple:
        return list(self.places), list(self.window.held), self.slid

    def _rows(self, first: int, last: int) -> list[tuple]:
        middle = self.window.median()
        return [(self.places[k], self.window.held[k], middle) for k in range(first, last)]

    def push(self, place: int, value: float) -> list[tuple]:
        out = []
        if self.window.full and not self.slid:  # another row comes, so the first frame's rows count
            out, self.slid = self._rows(0, self.half + 1), True
        self.window.push(value)
        self.places.append(place)
        if len(self.places) > self.size:
            self.places.popleft()
            out += self._rows(self.half, self.half + 1)
        return out

    def close(self) -> list[tuple]:
        out = self._rows(self.half + 1 if self.slid else 1, self.size) if self.window.full else []
        self.places.clear()
        self.window, self.slid = SlidingMedian(self.size), False
        return out

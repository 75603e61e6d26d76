"""Adaptive windowing (ADWIN) after Bifet and Gavalda, 2007: a window that drops its older part on change.

The window is an exponential histogram: rows of buckets that hold 1, 2, 4, ... values each, at most `per_row` of a
size, so its state is a few hundred numbers however long the stream is.
"""

from __future__ import annotations

import math


class Adwin:
    def __init__(self, delta: float = 0.002, per_row: int = 5, clock: int = 32, least: int = 5, grace: int = 10, state: dict | None = None):
        self.delta, self.per_row, self.clock, self.least, self.grace = delta, per_row, clock, least, grace
        s = state or {}
        self.rows: list[list[list[float]]] = s.get("rows", [[]])  # rows[i]: [sum, variance] of 2**i values, oldest first
        self.seen = int(s.get("seen", 0))

    def state(self) -> dict:
        return {"rows": self.rows, "seen": self.seen}

    @property
    def width(self) -> int:
        return sum(len(r) << i for i, r in enumerate(self.rows))

    @property
    def total(self) -> float:
        return sum(b[0] for r in self.rows for b in r)

    def variance(self) -> float:
        """Of the values in the window, from the buckets' sums and variances."""
        n, mean, m2 = 0, 0.0, 0.0
        for i, row in enumerate(self.rows):
            for total, v in row:
                k = 1 << i
                gap = total / k - mean
                m2 += v + gap * gap * n * k / (n + k)
                mean += gap * k / (n + k)
                n += k
        return m2 / n if n else 0.0

    def update(self, x: float) -> bool:
        """Takes a value; true if the window was cut, which means that the mean has changed."""
        self.seen += 1
        self.rows[0].append([float(x), 0.0])
        i = 0
        while len(self.rows[i]) > self.per_row:
            a, b = self.rows[i][:2]
            del self.rows[i][:2]
            if len(self.rows) == i + 1:
                self.rows.append([])
            k = 1 << i
            gap = (a[0] - b[0]) / k
            self.rows[i + 1].append([a[0] + b[0], a[1] + b[1] + gap * gap * k / 2])
            i += 1
        if self.seen % self.clock or self.width <= self.grace:
            return False
        return self._shrink()

    def _shrink(self) -> bool:
        changed = False
        again = True
        while again:
            again = False
            n, total, v = self.width, self.total, self.variance()
            n0, s0 = 0, 0.0
            # from the oldest bucket on
            for i in range(len(self.rows) - 1, -1, -1):
                for b in self.rows[i]:
                    n0 += 1 << i
                    s0 += b[0]
                    n1 = n - n0
                    if n1 < self.least:
                        break
                    if n0 < self.least:
                        continue
                    d = math.log(2 * math.log(n) / self.delta) if n > 1 else 0.0
                    m = 1 / (n0 - self.least + 1) + 1 / (n1 - self.least + 1)
                    bound = math.sqrt(2 * m * v * d) + 2 / 3 * d * m
                    if abs(s0 / n0 - (total - s0) / n1) > bound:
                        changed = again = True
                        break
                if again:
                    break
            if again:
                top = max(i for i, r in enumerate(self.rows) if r)
                self.rows[top].pop(0)
                while len(self.rows) > 1 and not self.rows[-1]:
                    self.rows.pop()
        return changed

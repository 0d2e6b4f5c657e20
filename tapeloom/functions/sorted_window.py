"""Quantiles of a window that slides over a series, kept in order instead of sorted per row."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import types as T


class SortedWindow:
    """The values of a moving window in ascending order: adding, dropping and reading a rank are binary searches."""

    def __init__(self, values: Sequence[float] = ()):
        self.values = sorted(values)

    def add(self, value: float) -> None:
        insort(self.values, value)

    def drop(self, value: float) -> None:
        del self.values[bisect_left(self.values, value)]

    def quantile(self, q: float) -> float:
        """Linear interpolation between the neighbouring ranks; NaN when empty."""
        if not self.values:
            return float("nan")
        at = q * (len(self.values) - 1)
        low = int(at)
        high = min(low + 1, len(self.values) - 1)
        return self.values[low] + (self.values[high] - self.values[low]) * (at - low)


def sliding_quantiles(at: np.ndarray, values: np.ndarray, span: int, probs: Sequence[float], earlier: Sequence[tuple[int, float]] = ()) -> tuple[np.ndarray, list[tuple[int, float]]]:
    """(quantiles per row, what is left in the window) of the values of the last ``span``, the own row included.

    Rows are in order of ``at``; NaN values are no samples. ``earlier`` is what an
    earlier part of the series left in its window, so a series may come in parts.
    """
    held = list(earlier)
    window = SortedWindow([v for _, v in held])
    first, out = 0, np.full((len(at), len(probs)), np.nan)
    for i, (t, v) in enumerate(zip(at.tolist(), values.tolist())):
        if v == v:
            window.add(v)
            held.append((t, v))
        while first < len(held) and held[first][0] < t - span:
            window.drop(held[first][1])
            first += 1
        out[i] = [window.quantile(q) for q in probs]
    return out, held[first:]


@dataclass(frozen=True)
class WindowQuantile:
    """Scan step: a quantile of ``source`` over the rows of the last ``span_us``, in (order, tie) order.

    Several steps over one source share one pass over the window.
    """

    out: str
    source: str
    order: str
    tie: str
    span_us: int
    prob: float
    others: tuple[float, ...] = ()
    dtype = T.DoubleType()

    def __call__(self, frame) -> pd.Series:
        probs = (self.prob, *self.others)
        shared = frame.__dict__.setdefault("quantiles", {})
        key = self.source, self.order, self.span_us, frozenset(probs)
        if key not in shared:
            at = frame.rows.column(self.order).cast(pa.int64()).to_numpy()
            turn = np.lexsort((frame[self.tie].to_numpy(), at))
            got, _ = sliding_quantiles(at[turn], frame[self.source].to_numpy(dtype=float)[turn], self.span_us, probs)
            shared[key] = turn, dict(zip(probs, got.T))
        turn, columns = shared[key]
        values = np.empty(len(turn))
        values[turn] = columns[self.prob]
        return pd.Series(values)

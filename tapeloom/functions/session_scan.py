"""Scans over one session that sliding SQL frames do badly.

Two things are needed that Spark's window functions can only express by
materialising a w-element array per row: the rolling median and "how many rows
ahead does this series first touch my level". Both run here as small numpy
helpers inside Arrow batches. Spark partitions and shuffles by session; a
session is bounded by its calendar (at most 86,400 one-second bars). Many short
sessions are scanned as one block, so a step costs its rows and not its sessions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.api.indexers import BaseIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tapeloom.functions.ordered import changes

_ROW = "__row"
BLOCK_ROWS = 1 << 16
_CELLS = 1 << 16  # of the windows evaluated at a time


class _InSession(BaseIndexer):
    """Windows of trailing rows that end where their session begins."""

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        end = np.arange(1, num_values + 1, dtype=np.int64)
        return np.maximum(end - self.window_size, self.first), end


@dataclass(frozen=True)
class RollingMedian:
    out: str
    source: str
    window: int
    min_count: int = 1
    dtype = T.DoubleType()
    blockwise = True

    def __call__(self, frame: pd.DataFrame) -> pd.Series:
        within = _InSession(window_size=self.window, first=frame.first)
        return frame[self.source].astype(float).rolling(within, min_periods=self.min_count).median()


@dataclass(frozen=True)
class Rolling:
    """A statistic of the last ``window`` rows of one or two columns.

    ``stat`` maps (rows x window) blocks to one value per row. Each window is
    evaluated afresh, so a huge value leaves no rounding residue when it drops
    out; missing values make the result missing unless ``min_count`` allows them.
    With ``at``, a boolean column, only its true rows are evaluated; the others are missing.
    """

    out: str
    sources: tuple[str, ...]
    window: int
    stat: Callable[..., np.ndarray]
    min_count: int | None = None
    at: str | None = None
    dtype = T.DoubleType()
    blockwise = True

    def __call__(self, frame) -> pd.Series:
        n, w, need = len(frame), self.window, self.min_count or self.window
        cols = [frame[c].to_numpy(dtype=float) for c in self.sources]
        have = ~np.isnan(cols).any(axis=0)
        start = np.arange(n) - w + 1
        seen = np.concatenate([[0], np.cumsum(have)])
        wanted = seen[1:] - seen[np.maximum(start, frame.first)] >= need
        if self.at is not None:
            wanted &= frame[self.at].to_numpy(dtype=bool)
        rows = np.flatnonzero(wanted)
        result = np.full(n, np.nan)
        windows = [np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(w - 1, np.nan), c]), w) for c in cols]
        step = max(1, _CELLS // w)
        for part in (rows[i : i + step] for i in range(0, len(rows), step)):
            blocks = [x[part] for x in windows]
            if need < w:
                before = np.arange(w) < (frame.first[part] - start[part])[:, None]  # rows of the session before
                for block in blocks:
                    block[before] = np.nan
            with np.errstate(all="ignore"):
                result[part] = self.stat(*blocks)
        return pd.Series(result)


@dataclass(frozen=True)
class FirstTouch:
    """Rows ahead until ``series`` compares true with this row's ``level``.

    Looks at rows base+1 .. base+limit, where base is the row itself or the row
    ``base_rows`` ahead; NULL when it never happens. Missing values never match.
    """

    out: str
    series: str
    level: str
    op: str
    limit: int | str
    base_rows: str | None = None
    dtype = T.LongType()
    blockwise = True

    def __call__(self, frame: pd.DataFrame) -> pd.Series:
        values = frame[self.series].to_numpy(dtype=float)
        level = frame[self.level].to_numpy(dtype=float)
        n = len(values)
        base = np.zeros(n) if self.base_rows is None else frame[self.base_rows].to_numpy(dtype=float)
        limit = np.full(n, float(self.limit)) if isinstance(self.limit, int) else frame[self.limit].to_numpy(dtype=float)
        steps = first_touch(values, level, base, limit, self.op, frame.first, frame.end)
        return pd.Series(steps, index=frame.index).astype("Int64").mask(pd.Series(steps < 0, index=frame.index))


@dataclass(frozen=True)
class At:
    """The value of ``source`` a given number of rows ahead; NULL outside the session."""

    out: str
    source: str
    rows: str
    dtype: T.DataType = T.DoubleType()
    blockwise = True

    def __call__(self, frame: pd.DataFrame) -> pd.Series:
        rows = frame[self.rows].to_numpy(dtype=float)
        pos = np.arange(len(frame)) + np.nan_to_num(rows, nan=0.0).astype(int)
        ok = ~np.isnan(rows) & (pos >= frame.first) & (pos < frame.end)
        got = frame[self.source].take(np.where(ok, pos, 0)).reset_index(drop=True)
        return got.where(pd.Series(ok))


@dataclass(frozen=True)
class RowsUntil:
    """Rows ahead to the last bar not after a timestamp column (as-of, inclusive)."""

    out: str
    ts: str
    until: str
    dtype = T.LongType()
    blockwise = True

    def __call__(self, frame) -> pd.Series:
        have = frame[self.until].notna()
        ts, until = frame[self.ts].to_numpy(), frame[self.until].fillna(frame[self.ts]).to_numpy()
        low, high = frame.first.copy(), frame.end.copy()
        while (open_ := low < high).any():  # a binary search per row, all at once
            mid = np.where(open_, (low + high) // 2, 0)
            below = ts[mid] <= until
            low, high = np.where(open_ & below, mid + 1, low), np.where(open_ & ~below, mid, high)
        pos = low - 1
        return pd.Series(pos - np.arange(len(frame)), index=frame.index).astype("Int64").where(have)


@dataclass(frozen=True)
class Derive:
    """A column computed row by row from earlier ones inside the same scan (saves a shuffle)."""

    out: str
    formula: Callable[[pd.DataFrame], pd.Series]
    dtype: T.DataType = T.LongType()
    blockwise = True

    def __call__(self, frame: pd.DataFrame) -> pd.Series:
        return self.formula(frame)


def first_touch(values: np.ndarray, level: np.ndarray, base: np.ndarray, limit: np.ndarray, op: str, first: np.ndarray | int = 0, end: np.ndarray | None = None) -> np.ndarray:
    """Rows ahead of ``row + base`` to the first value that compares true with the row's level; -1 if none within ``limit``.

    Only rows ``first`` up to before ``end``, the row's session, are looked at.

    A tree of block minima (maxima for ``ge`` and ``gt``) is climbed to the first block
    that holds a match and descended to its first row, for all rows at once: about
    2 log n steps, however far the match is.
    """
    n = len(values)
    steps = np.full(n, -1.0)
    rows = np.nonzero(~np.isnan(level) & ~np.isnan(base) & ~np.isnan(limit))[0]
    start = rows + base[rows].astype(np.int64)
    first, end = np.broadcast_to(first, n)[rows], np.broadcast_to(n if end is None else end, n)[rows]
    inside = (start + 1 >= first) & (start + 1 < end) & (limit[rows] >= 1)
    rows, start, end = rows[inside], start[inside], end[inside]
    if not rows.size:
        return steps
    sign = -1.0 if op in ("ge", "gt") else 1.0
    hit = np.less_equal if op in ("le", "ge") else np.less
    want = sign * level[rows]
    tree = [np.where(np.isnan(values), np.inf, sign * values)]
    while len(tree[-1]) > 1:
        last = tree[-1] if len(tree[-1]) % 2 == 0 else np.append(tree[-1], np.inf)
        tree.append(np.minimum(last[::2], last[1::2]))
    node, height = start + 1, np.full(len(rows), -1)
    open_ = np.arange(len(rows))
    for k, block in enumerate(tree):
        at = node[open_]
        alone = (at % 2 == 1) | (k == len(tree) - 1)  # its parent would begin before it
        match = alone & hit(block[np.minimum(at, len(block) - 1)], want[open_]) & (at < len(block))
        height[open_[match]] = k
        open_ = open_[~match]
        node[open_] = (node[open_] + alone[~match]) >> 1
        still = node[open_] < (len(tree[k + 1]) if k + 1 < len(tree) else 0)
        open_ = open_[still]
        if not open_.size:
            break
    for k in range(len(tree) - 1, 0, -1):
        down = np.nonzero(height == k)[0]
        if down.size:
            left = 2 * node[down]
            node[down] = np.where(hit(tree[k - 1][left], want[down]), left, left + 1)
            height[down] = k - 1
    found = height == 0
    ahead = node - start
    good = found & (ahead <= limit[rows]) & (node < end)
    steps[rows[good]] = ahead[good]
    return steps


class Session:
    """Rows of one session in time order, or of several one after the other.

    ``first`` and ``end`` are the bounds of each row's session; a column leaves Arrow
    only when a step reads it.
    """

    def __init__(self, rows: pa.Table, starts: np.ndarray):
        n = rows.num_rows
        sizes = np.diff(np.append(starts, n))
        self.rows, self.made, self.index, self.starts = rows, {}, pd.RangeIndex(n), starts
        self.first, self.end = np.repeat(starts, sizes).astype(np.int64), np.repeat(starts + sizes, sizes).astype(np.int64)

    def __len__(self) -> int:
        return self.rows.num_rows

    def __getitem__(self, name: str) -> pd.Series:
        if name not in self.made:
            self.made[name] = self.rows.column(name).to_pandas()
        return self.made[name]

    def single(self) -> list[Session]:
        return [Session(self.rows.slice(i, j - i), np.zeros(1, np.int64)) for i, j in zip(self.starts, np.append(self.starts[1:], len(self)))]

    def append(self, name: str, values: pd.Series, kind: pa.DataType) -> None:
        self.made[name] = values
        self.rows = self.rows.append_column(pa.field(name, kind), pa.Array.from_pandas(values, type=kind))


def scan_sessions(df: DataFrame, keys: Sequence[str], order: str, steps: Sequence, within: Sequence[str | Column] = (), keep: str | None = None) -> DataFrame:
    """Append the outputs of the steps; later steps see earlier outputs.

    A window numbers the rows of each session, which also brings them together and in
    order; whole sessions then pass in blocks of about ``BLOCK_ROWS`` rows. Steps that
    aren't ``blockwise`` are given one session at a time. With ``within``, functions of the
    keys that bound a group (a symbol's week), each such group of whole sessions is one
    Arrow group instead. With ``keep``, a boolean column, only its true rows are returned.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(s.out, s.dtype) for s in steps]])
    kinds = [to_arrow_type(s.dtype) for s in steps]
    groups: list[tuple[bool, list]] = []  # runs of steps of a kind
    for step, kind in zip(steps, kinds):
        blockwise = getattr(step, "blockwise", False)
        if not groups or groups[-1][0] != blockwise:
            groups.append((blockwise, []))
        groups[-1][1].append((step, kind))

    def scanned(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        for blockwise, run in groups:
            parts = [Session(rows, starts)]
            parts = parts if blockwise else parts[0].single()
            for part in parts:
                for step, kind in run:
                    part.append(step.out, step(part), kind)
            rows = parts[0].rows if len(parts) == 1 else pa.concat_tables([p.rows for p in parts]).combine_chunks()
        yield from (rows if keep is None else rows.filter(rows.column(keep))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < BLOCK_ROWS:
                continue
            rows = pa.Table.from_batches(held)
            starts = np.flatnonzero(rows.column(_ROW).to_numpy() == 1)
            cut = int(starts[-1])  # the last session may go on in the next batch
            if cut:
                yield from scanned(rows.slice(0, cut).drop_columns([_ROW]), starts[:-1])
            held, n = rows.slice(cut).to_batches(), rows.num_rows - cut
        if n:
            rows = pa.Table.from_batches(held)
            yield from scanned(rows.drop_columns([_ROW]), np.flatnonzero(rows.column(_ROW).to_numpy() == 1))

    def together(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in (*keys, order)])
        return pa.Table.from_batches(list(scanned(rows, np.flatnonzero(changes(rows, keys)))))

    if within:
        return df.groupBy(*within).applyInArrow(together, schema)
    numbered = df.withColumn(_ROW, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return numbered.mapInArrow(run, schema)


@dataclass(frozen=True)
class GreedyPick:
    """True for rows of the greedy earliest-first selection over rows that have a release.

    A row occupies ``hold`` rows; the next pick must start at or after the
    release row, or strictly after it when ``strict``.
    """

    out: str
    hold: str
    strict: bool = False
    dtype = T.BooleanType()
    blockwise = True

    def __call__(self, frame) -> pd.Series:
        hold = frame[self.hold].to_numpy(dtype=float)
        start = np.nonzero(~np.isnan(hold))[0]
        keep = np.zeros(len(frame), dtype=bool)
        release = np.minimum(start + hold[start], frame.end[start] - self.strict)  # the next session starts afresh
        keep[start[greedy(start, release, self.strict)]] = True
        return pd.Series(keep)


def greedy(start: np.ndarray, release: np.ndarray, strict: bool) -> list[int]:
    """Positions picked by repeatedly jumping to the first start not before the last release."""
    side = "right" if strict else "left"
    picked, i = [], 0
    while i < len(start):
        picked.append(i)
        i = max(i + 1, int(np.searchsorted(start, release[i], side=side)))
    return picked


def non_overlapping(df: DataFrame, keys: Sequence[str], start: str, release: str, inclusive: bool = True) -> DataFrame:
    """Greedy earliest-first selection: keep a row, skip until its release.

    ``inclusive`` lets the next row start exactly at the release; otherwise it
    must start after it. Rows of one start are taken in their given order of
    release. The scan is inherently sequential, so it runs per group; groups are
    sessions (optionally times a fixed list of parameters), bounded by the grid.
    """

    def numbers(rows: pa.Table, name: str) -> np.ndarray:
        c = rows.column(name)
        return (c.cast(pa.int64()) if pa.types.is_timestamp(c.type) else c).to_numpy()

    def run(rows: pa.Table) -> pa.Table:
        order = np.lexsort((numbers(rows, release), numbers(rows, start)))
        rows = rows.take(pa.array(order))
        return rows.take(pa.array(greedy(numbers(rows, start), numbers(rows, release), not inclusive), pa.int64()))

    return df.groupBy(*keys).applyInArrow(run, df.schema)

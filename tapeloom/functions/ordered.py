"""Ordered computations whose groups may be arbitrarily large.

A plain ``Window.partitionBy(key).orderBy(ts)`` puts a whole key into one task.
That is used in this library only where a calendar bounds the group (one session
of bars, one symbol's daily history, one top-N list). Everything else goes
through the helpers below, which split a group into ordered slices, summarise
each slice, carry the summaries forward and finish inside the slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from tapeloom.session import cut

_PID, _POS = "__slice", "__pos"


def _asc(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _join_on(keys: Sequence[str], left: str, right: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def ordered_prefix(
    df: DataFrame,
    order: Sequence[str | Column],
    by: Sequence[str] = (),
    sums: dict[str, str] | None = None,
    index: str = "row_index",
) -> DataFrame:
    """Exact 1-based row index (and running sums) in a total order, per group.

    Rows are range-partitioned on (group, order), so a slice never outgrows a
    task however skewed the groups are; the placement is checkpointed because
    the index refers to it. Only one row per (slice, group) is carried forward.
    """
    sums = sums or {}
    by = list(by)
    placed = cut(
        df.repartitionByRange(*[F.col(c) for c in by], *_asc(order))
        .sortWithinPartitions(*[F.col(c) for c in by], *_asc(order))
        .withColumn(_PID, F.spark_partition_id())
        .withColumn(_POS, F.monotonically_increasing_id())
    )
    stats = placed.groupBy(_PID, *by).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min(_POS).alias("__first"),
        *[F.sum(c).alias(f"__s_{name}") for name, c in sums.items()],
    )
    before = Window.partitionBy(*by).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.select(
        _PID,
        *by,
        "__first",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums],
    )
    keys = [_PID, *by]
    joined = placed.alias("l").join(offsets.alias("r"), _join_on(keys, "l", "r")).select(
        "l.*", "r.__first", "r.__off", *[f"r.__o_{n}" for n in sums]
    )
    out = joined.withColumn(index, F.col("__off") + F.col(_POS) - F.col("__first") + 1)
    if sums:
        local = Window.partitionBy(_PID, *by).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
        for name, c in sums.items():
            out = out.withColumn(name, F.col(f"__o_{name}") + F.coalesce(F.sum(c).over(local), F.lit(0)))
    return out.drop(_PID, _POS, "__first", "__off", *[f"__o_{n}" for n in sums])


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), rank: str = "rank", total: str = "rank_n") -> DataFrame:
    """Add the tie-averaged rank of ``value`` and the non-null count, per group.

    Equal values are counted first, so a value shared by most rows costs one row.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    pref = ordered_prefix(counts, [value], by, {"__cum": "__c"})
    ranks = pref.select(*by, value, (F.col("__cum") - F.col("__c") + (F.col("__c") + 1) / 2.0).alias(rank))
    totals = pref.groupBy(*by).agg(F.max("__cum").alias(total))  # read from the placed counts, not recomputed
    if by:
        ranks = ranks.join(totals, by)
    else:
        ranks = ranks.crossJoin(F.broadcast(totals))  # a single row
    return df.join(ranks, [*by, value], "left")


def percentile_ranks(df: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    ranked = average_ranks(df, value, by, "__r", "__n")
    return ranked.withColumn(out, F.col("__r") / F.col("__n")).drop("__r", "__n")


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles per group without a per-group buffer.

    Finds the rows at the two neighbouring positions of each quantile in the
    value-count order; groups of any size are handled, one row per group returned.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    pref = ordered_prefix(counts, [value], by, {"__cum": "__c"})
    totals = pref.groupBy(*by).agg(F.max("__cum").alias("__n"))  # read from the placed counts, not recomputed
    pref = pref.join(totals, by) if by else pref.crossJoin(F.broadcast(totals))  # a single row
    aggs = []
    for name, p in probs.items():
        pos = (F.col("__n") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        first, last = F.col("__cum") - F.col("__c"), F.col("__cum") - 1  # 0-based positions of this value
        v = F.col(value)
        low = F.max(F.when((first <= lo) & (lo <= last), v))
        high = F.max(F.when((first <= hi) & (hi <= last), v))
        frac = F.max(pos - lo)
        aggs.append((low + (high - low) * frac).alias(name))
    return pref.groupBy(*by).agg(*aggs)


def carry(
    df: DataFrame,
    by: Sequence[str],
    chunk: str,
    order: Sequence[str | Column],
    last: dict[str, str] | None = None,
    sums: dict[str, str] | None = None,
    maxes: dict[str, str] | None = None,
    include_current: bool = True,
) -> DataFrame:
    """Running last-non-null / sum / max over a long series, in two levels.

    ``chunk`` is an ordered bucket column (an hour, a day) that splits a group.
    Each chunk is summarised, the summaries are carried forward over the chunks
    of the group, and the running value is completed inside the chunk. With
    ``include_current=False`` the value is as of the previous row.
    """
    last, sums, maxes = last or {}, sums or {}, maxes or {}
    by = list(by)
    end = 0 if include_current else -1
    inner = Window.partitionBy(*by, chunk).orderBy(*_asc(order)).rowsBetween(Window.unboundedPreceding, end)
    prior = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    key = F.struct(*_asc(order))
    summary = df.groupBy(*by, chunk).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"__l_{n}") for n, c in last.items()],
        *[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"__m_{n}") for n, c in maxes.items()],
    )
    carried = summary.select(
        *by,
        chunk,
        *[F.last(f"__l_{n}", ignorenulls=True).over(prior).alias(f"__pl_{n}") for n in last],
        *[F.sum(f"__s_{n}").over(prior).alias(f"__ps_{n}") for n in sums],
        *[F.max(f"__m_{n}").over(prior).alias(f"__pm_{n}") for n in maxes],
    )
    out = df.select(
        "*",
        *[F.last(c, ignorenulls=True).over(inner).alias(f"__il_{n}") for n, c in last.items()],
        *[F.sum(c).over(inner).alias(f"__is_{n}") for n, c in sums.items()],
        *[F.max(c).over(inner).alias(f"__im_{n}") for n, c in maxes.items()],
    )
    keys = [*by, chunk]
    out = out.alias("l").join(carried.alias("r"), _join_on(keys, "l", "r"), "left").select(
        "l.*", *[f"r.`{c}`" for c in carried.columns if c not in keys]
    )
    for n in last:
        out = out.withColumn(n, F.coalesce(f"__il_{n}", f"__pl_{n}"))
    for n in sums:
        out = out.withColumn(n, F.coalesce(F.col(f"__is_{n}"), F.lit(0)) + F.coalesce(F.col(f"__ps_{n}"), F.lit(0)))
    for n in maxes:
        out = out.withColumn(n, F.greatest(f"__im_{n}", f"__pm_{n}"))
    return out.drop(*[c for c in out.columns if c.startswith(("__il_", "__is_", "__im_", "__pl_", "__ps_", "__pm_"))])


def prefix_fold(rows: DataFrame, by: Sequence[str], order: str, value: str, compose: Callable[[Column, Column], Column], identity: Column, out: str = "before", fan_in: int = 64) -> DataFrame:
    """Add the fold of all earlier values of a group, for any associative ``compose(earlier, later)``.

    ``order`` numbers a group's rows from 0 without gaps. Runs of ``fan_in`` values are
    folded to one, level by level, and the folds are handed down again, so no task sees
    more than ``fan_in`` values of a group and the rounds grow with the logarithm.
    """
    by = list(by)
    levels = [rows.select(*by, F.col(order).cast("long").alias("__i"), F.col(value).alias("__v"))]
    most = levels[0].agg(F.max("__i")).first()[0]
    while (most or 0) > 0:
        runs = levels[-1].groupBy(*by, F.floor(F.col("__i") / fan_in).alias("__up")).agg(F.sort_array(F.collect_list(F.struct("__i", "__v"))).alias("__l"))
        levels.append(cut(runs.select(*by, F.col("__up").alias("__i"), F.aggregate("__l", identity, lambda a, x: compose(a, x["__v"])).alias("__v"))))
        most //= fan_in
    above = levels[-1].select(*by, "__i", identity.alias("__b"))
    for level in reversed(levels[:-1]):
        earlier = Window.partitionBy(*by, "__up").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
        siblings = level.withColumn("__up", F.floor(F.col("__i") / fan_in)).withColumn("__l", F.collect_list("__v").over(earlier))
        on = _join_on(by, "l", "r") & (F.col("l.__up") == F.col("r.__i"))
        above = siblings.alias("l").join(above.alias("r"), on).select(*[f"l.{c}" for c in (*by, "__i")], F.aggregate("l.__l", F.col("r.__b"), lambda a, x: compose(a, x)).alias("__b"))
    on = _join_on(by, "l", "r") & (F.col(f"l.{order}") == F.col("r.__i"))
    return rows.alias("l").join(above.alias("r"), on).select("l.*", F.col("r.__b").alias(out))


class _Filler:
    """Last non-null values of ordered rows, group by group, over the batches of a partition."""

    def __init__(self, by: Sequence[str], sources: Sequence[str], kinds: Sequence[pa.DataType]):
        self.by, self.sources = list(by), list(sources)
        self.kinds = list(kinds)
        self.group: tuple | None = None
        self.held: list = [None] * len(self.sources)
        self.first: tuple | None = None
        self.groups = 0

    def start(self, group: tuple, held: Sequence) -> None:
        """Values that rows before this partition left for its first group."""
        self.group, self.held = group, list(held)

    def step(self, batch: pa.RecordBatch) -> list[pa.Array]:
        """Per source the last value before each row, in the row's group."""
        n = batch.num_rows
        keys = [batch.column(c) for c in self.by]
        new = np.zeros(n, bool)
        for k in keys:
            a, b = k.slice(1), k.slice(0, n - 1)
            differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
            new[1:] |= differs.to_numpy(zero_copy_only=False)
        key = tuple(k[0].as_py() for k in keys)
        if self.first is None:
            self.first = key
        goes_on = self.group is not None and key == self.group
        new[0] = not goes_on
        self.groups += int(new.sum())
        begin = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1  # row i is at i + 1, behind the held value
        begin[: int(new.argmax()) if new.any() else n] = 0
        out, held = [], []
        for j, (c, kind) in enumerate(zip(self.sources, self.kinds)):
            column = batch.column(c)
            both = pa.concat_arrays([pa.array([self.held[j] if goes_on else None], kind), column])
            there = both.is_valid().to_numpy(zero_copy_only=False)
            at = np.maximum.accumulate(np.where(there, np.arange(n + 1), -1))
            before = at[:-1]
            out.append(both.take(pa.array(before, mask=(before < begin) | (before < 0))))
            end = at[-1]
            held.append(both[int(end)].as_py() if end >= begin[-1] and end >= 0 else None)
        self.group, self.held = tuple(k[n - 1].as_py() for k in keys), held
        return out


def fill_ranges(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], last: dict[str, str]) -> DataFrame:
    """Add, per group, the last non-null value of each source before the row.

    The rows are shuffled once, into ranges of (group, order) with about equal numbers
    of rows, so a busy hour of one group is spread over tasks. Only the first group of a
    range goes on from the one before; what it needs from there, one row per range, is
    chained on the driver and handed to the second pass.
    """
    by, sources = list(by), list(last.values())
    placed = cut(df.repartitionByRange(*[F.col(c) for c in by], *_asc(order)).sortWithinPartitions(*[F.col(c) for c in by], *_asc(order)).withColumn(_PID, F.spark_partition_id()))
    kinds = [to_arrow_type(placed.schema[c].dataType) for c in sources]
    key_kinds = [to_arrow_type(placed.schema[c].dataType) for c in by]
    fields = [*(pa.field(f"first_{i}", k) for i, k in enumerate(key_kinds)), *(pa.field(f"last_{i}", k) for i, k in enumerate(key_kinds)), *(pa.field(f"held_{i}", k) for i, k in enumerate(kinds))]
    edge = pa.schema([pa.field(_PID, pa.int32()), pa.field("groups", pa.int64()), *fields])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler, pid = _Filler(by, sources, kinds), None
        for batch in batches:
            if batch.num_rows:
                filler.step(batch)
                pid = batch.column(_PID)[0].as_py()
        if pid is not None:
            row = [pid, filler.groups, *filler.first, *filler.group, *filler.held]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, edge)], schema=edge)

    names = StructType([StructField(_PID, IntegerType()), StructField("groups", LongType())] + [StructField(f.name, placed.schema[c].dataType) for f, c in zip(fields, [*by, *by, *sources])])
    starts: dict[int, tuple[tuple, list]] = {}
    group, held = None, [None] * len(sources)
    k = len(by)
    for row in placed.select(*dict.fromkeys([*by, *sources]), _PID).mapInArrow(ends, names).orderBy(_PID).toArrow().to_pylist():  # one row per range
        values = list(row.values())
        first, end, own = tuple(values[2 : 2 + k]), tuple(values[2 + k : 2 + 2 * k]), values[2 + 2 * k :]
        if first == group:
            starts[row[_PID]] = group, held
        alone = row["groups"] == 1 and first == group
        held = [h if alone and v is None else v for v, h in zip(own, held)]
        group = end
    sent = df.sparkSession.sparkContext.broadcast(starts)
    out_schema = StructType([f for f in placed.schema.fields if f.name != _PID] + [StructField(n, placed.schema[c].dataType) for n, c in last.items()])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if filler is None:
                filler = _Filler(by, sources, kinds)
                if (known := sent.value.get(batch.column(_PID)[0].as_py())) is not None:
                    filler.start(*known)
            filled = filler.step(batch)
            kept = [c for c in batch.schema.names if c != _PID]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *filled], [*kept, *last])

    return placed.mapInArrow(fill, out_schema)


def changes(batch: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """True where a row differs from the one before in one of the columns; nulls are equal. The first row is True."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        column = batch.column(c)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        a, b = column.slice(1), column.slice(0, max(0, n - 1))
        differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    return new


def ranks_in_one_sort(df: DataFrame, by: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Tie-averaged 1-based rank of ``value`` (not null) within a group, for groups of any size.

    The rows, whatever else they carry, are shuffled once into ranges of (group, value);
    equal values share a range, so only the number of rows that a range's first group has
    before it comes from elsewhere: one row per range, chained on the driver.
    """
    by = list(by)
    keys = [F.col(c) for c in by]
    placed = cut(df.repartitionByRange(*keys, F.col(value)).sortWithinPartitions(*keys, F.col(value)).withColumn(_PID, F.spark_partition_id()))
    edges = placed.groupBy(_PID, *by).agg(F.count(F.lit(1)).alias("__n"))
    around = edges.groupBy(_PID).agg(F.min_by(F.struct(*by, "__n"), F.struct(*by)).alias("first"), F.max_by(F.struct(*by, "__n"), F.struct(*by)).alias("last"), F.count(F.lit(1)).alias("groups"))
    starts: dict[int, int] = {}
    group, seen = None, 0
    for row in around.orderBy(_PID).collect():  # one row per range
        first, last = (tuple(row[x][c] for c in by) for x in ("first", "last"))
        starts[row[_PID]] = before = seen if first == group else 0
        seen = row["last"]["__n"] + (before if row["groups"] == 1 else 0)
        group = last
    sent = df.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows of the last value, which the next batch may go on with
        before, group = None, None  # rows of that group before them

        def ranked(rows: pa.Table) -> pa.Table:
            nonlocal before, group
            if before is None:
                before = sent.value.get(rows.column(_PID)[0].as_py(), 0)
                group = tuple(rows.column(c)[0].as_py() for c in by)
            goes_on = tuple(rows.column(c)[0].as_py() for c in by) == group
            n = rows.num_rows
            heads = changes(rows, by)
            ties = changes(rows, [*by, value])
            head = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
            base = np.where(head == 0, before if goes_on else 0, 0)
            tie = np.cumsum(ties) - 1
            start = np.flatnonzero(ties)
            size = np.diff(np.append(start, n))
            rank = (start - head[start] + base[start])[tie] + (size[tie] + 1) / 2.0
            before = int(n - head[-1] + base[-1])
            group = tuple(rows.column(c)[n - 1].as_py() for c in by)
            return rows.drop_columns([_PID]).append_column(out, pa.array(rank))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            last = int(np.flatnonzero(changes(rows, [*by, value]))[-1])
            held = rows.slice(last)
            if last:
                yield from ranked(rows.slice(0, last)).combine_chunks().to_batches()
        if held is not None and held.num_rows:
            yield from ranked(held).combine_chunks().to_batches()

    schema = StructType([f for f in placed.schema.fields if f.name != _PID] + [StructField(out, DoubleType())])
    return placed.mapInArrow(run, schema)


def with_row_halo(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], before: int, after: int = 0, chunk_rows: int = 200_000) -> DataFrame:
    """Cut each ordered series into chunks of ``chunk_rows`` with copies of the edge rows.

    Adds ``row_index``, ``chunk`` and ``is_halo``. Row frames of at most ``before``
    preceding and ``after`` following rows, taken over (by, chunk), equal the
    frames over the whole series; drop the halo rows afterwards.
    """
    chunk_rows = max(chunk_rows, before + 1, after + 1)
    rows = ordered_prefix(df, order, by)
    own = F.floor((F.col("row_index") - 1) / chunk_rows)
    offset = F.pmod(F.col("row_index") - 1, F.lit(chunk_rows))
    targets = F.array_compact(
        F.array(
            own,
            F.when(offset >= chunk_rows - before, own + 1) if before else F.lit(None).cast("long"),
            F.when((offset < after) & (own > 0), own - 1) if after else F.lit(None).cast("long"),
        )
    )
    out = rows.withColumn("__own", own).withColumn("chunk", F.explode(targets))
    return out.withColumn("is_halo", F.col("chunk") != F.col("__own")).drop("__own")

"""Feeds for readers of current state: the latest row per key, status changes, and order rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tapeloom.operators.orders import merge_orders, order_state
from tapeloom.sources.published import merge_batch, upsert


def _sink(stream: DataFrame, run, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_feed(rows: DataFrame, keys: Sequence[str], order: str, path: str, checkpoint: str, buckets: int = 32) -> StreamingQuery:
    """Keep a published table with the newest row per key (greatest ``order``).

    The table itself is the state: a micro-batch is reduced to one row per key, and only
    the buckets of its keys are rewritten. Nothing else is kept per key, and rows that
    arrive late change nothing.
    """
    rest = [c for c in rows.columns if c not in keys]

    def run(batch: DataFrame, n: int) -> None:
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])
        merge_batch(newest, path, keys, n, upsert(order), buckets=buckets)

    return _sink(rows, run, checkpoint)


class Changes(StatefulProcessor):
    """Rows of a key whose value differs from the row before, in ``order``; the first row is a change.

    Keyed by a bucket of keys, so that a call into Python costs many keys and not one.
    State: the last value of each key of the bucket; keys come as strings. Rows that arrive behind a later one
    of an earlier micro-batch are compared in order of arrival.
    """

    def __init__(self, by: str, value: str, order: str, columns: list[str]):
        self.by, self.value, self.order, self.columns = by, value, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "names array<string>, held array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values([self.by, self.order], kind="stable", ignore_index=True)
        now = batch[self.value].astype(object).where(batch[self.value].notna(), None)
        name, earlier = batch[self.by], batch[self.by].shift(1)
        head = (name != earlier) & ~(name.isna() & earlier.isna())
        head.iloc[0] = True
        at = np.flatnonzero(head)
        names = [None if pd.isna(x) else x for x in name.iloc[at].tolist()]
        known = dict(zip(*self.last.get())) if self.last.exists() else {}
        before = now.shift(1).astype(object)
        before.iloc[at] = [known.get(x) for x in names]
        before = before.where(before.notna(), None)
        same = ((now == before) | (now.isna() & before.isna())).to_numpy(dtype=bool)
        same[at] &= np.array([x in known for x in names])
        known.update(zip(names, now.iloc[np.append(at[1:], len(batch)) - 1].tolist()))
        self.last.update((list(known), list(known.values())))
        yield batch.assign(previous=before)[~same][self.columns]


def status_feed(states: DataFrame, by: str = "engine", value: str = "status", order: str = "seq", buckets: int = 512) -> DataFrame:
    """Streaming twin of ``status_changes``: (by, order, value, previous) of every change."""
    from tapeloom.streaming.jobs import use_rocksdb

    use_rocksdb(states.sparkSession)
    kinds = dict(states.dtypes)
    columns = [by, order, value, "previous"]
    schema = f"{by} string, {order} {kinds[order]}, {value} string, previous string"
    bucket = F.pmod(F.xxhash64(by), F.lit(buckets))
    # pandas would make floats of long keys that come in one batch with a null
    named = states.select(F.col(by).cast("string").alias(by), order, value, bucket.alias("_bucket"))
    out = named.groupBy("_bucket").transformWithStateInPandas(statefulProcessor=Changes(by, value, order, columns), outputStructType=schema, outputMode="Append", timeMode="None")
    return out.withColumn(by, F.col(by).cast(kinds[by]))


def order_feed(updates: DataFrame, path: str, checkpoint: str, buckets: int = 32) -> StreamingQuery:
    """Keep the current row of every client order id from a stream of upserts and events in sequence.

    ``updates`` has the columns of both (an upsert has a symbol, an event has none); the
    table holds their running aggregates, ``orders_view`` reads the rows from it. A
    micro-batch rewrites the buckets of its ids; batches that are replayed change nothing.
    """

    def run(batch: DataFrame, n: int) -> None:
        upserts, events = batch.where(F.col("symbol").isNotNull()), batch.where(F.col("symbol").isNull())
        empty = order_state(upserts.limit(0), events.limit(0))
        merge_batch(batch, path, ["client_order_id"], n, lambda old, new, _: merge_orders(old, new.where(F.col("symbol").isNotNull()), new.where(F.col("symbol").isNull())), buckets=buckets, empty=empty)

    return _sink(updates, run, checkpoint)

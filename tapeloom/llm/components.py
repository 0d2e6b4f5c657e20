"""Connected components of an edge table, without gathering edges anywhere.

Every task first replaces the edges it holds by stars (union-find on numpy
arrays). What is left is solved by alternating large-star and small-star rounds
(Kiveris et al., 2014), which are joins with a per-node minimum and take about
log(n) rounds. A hub's neighbours are never gathered: the minimum is partially
aggregated, and the join side that repeats the hub can be split by AQE.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, forest

_BUFFER = 1 << 20  # edges a task holds before it reduces them


def star_batches(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The edges a-b as stars (a = member, b = smallest member)."""
    if len(a):
        node, root = forest(a, b)
        own = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(root[own])], ["a", "b"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        n += batch.num_rows
        if n >= _BUFFER:
            yield from star_batches(*map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield from star_batches(*map(np.concatenate, zip(*held)))


def _settled(e: DataFrame) -> bool:
    """Every member has one root and no root is a member."""
    twice = e.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
    chained = e.join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a")
    return twice.unionAll(chained).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)`` that isn't the smallest of its component.

    Ids are non-null longs; self loops and repeats are allowed. Nodes missing from
    the result are their own root.
    """
    e = cut(edges.select("a", "b").where("a != b").mapInArrow(_stars, "a long, b long"))
    while not _settled(e):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = cut(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        e = cut(small.mapInArrow(_stars, "a long, b long"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))

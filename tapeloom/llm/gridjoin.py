"""Embedding near-duplicates: epsilon grid order join.

Cosine >= c on unit vectors means a distance of at most eps = sqrt(2 - 2c). Vectors
are projected on their leading principal directions (the norm of the rest is one
more coordinate, so distances never grow), put into the order of their eps grid
cells, and cut into sequence intervals: blocks of a few hundred vectors, 16 blocks
to a tile, 16 tiles to a node, and so on. The join starts with the whole sequence
against itself and descends both intervals together; a pair of intervals whose
boxes lie further apart than eps is dropped with everything below it. Tile pairs
that survive are shuffled to tasks, which multiply the surviving block pairs.

Equal vectors are one vector with a weight, so copies cost nothing. A tile pair
returns link counts and a spanning forest of its links, never the pairs, so a dense
group produces as many rows as a sparse one; its block pairs are all compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, forest, stored
from tapeloom.llm.components import components

FAN = 16  # intervals per parent interval


@dataclass(frozen=True)
class GridJoinConfig:
    """cosine: least similarity of a link. dims: principal directions of the grid.

    tile: vectors per tile at most (wide vectors get smaller tiles of tile_bytes).
    tiles_per_task: tiles in a range partition, on average, when they are built.
    """

    cosine: float = 0.9
    dims: int = 8
    tile: int = 4096
    tile_bytes: int = 2 << 20
    tiles_per_task: int = 4
    max_tasks: int = 4096


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """List column as doubles, shorter lists filled with zeros."""
    lens = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lens == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lens), width))
    out[np.arange(width) < lens[:, None]] = values
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish and no digit is lost."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def units(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_directions(vectors: DataFrame, width: int, k: int) -> np.ndarray:
    """About the k leading principal directions (columns) of the unit vectors.

    One step of subspace iteration: the covariance times a fixed random matrix,
    summed over all rows. The directions steer the grid; they don't decide links.
    """
    probes = np.random.default_rng(7).standard_normal((width, 2 * k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, 2 * k + 1))
        n = 0
        for batch in batches:
            x = units(matrix(batch.column(0), width))
            total += np.column_stack([x.T @ (x @ probes), x.sum(axis=0)])
            n += len(x)
        flat = np.append(total.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "v"])

    rows = vectors.select("v").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # width x (2k + 1) numbers
    flat = np.zeros(width * (2 * k + 1) + 1)
    for r in rows:
        flat[r.i] = r.v
    total, n = flat[:-1].reshape(width, -1), max(flat[-1], 1)
    mean = total[:, -1] / n
    u, _, _ = np.linalg.svd(total[:, :-1] - np.outer(mean, n * (mean @ probes)), full_matrices=False)
    return u[:, :k]


def coordinates(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Projection on the basis and the norm of what it leaves."""
    y = x @ basis
    rest = x - y @ basis.T
    return np.column_stack([y, np.sqrt((rest * rest).sum(axis=1))])


def _tiles(vectors: DataFrame, width: int, n: int, cfg: GridJoinConfig) -> tuple[DataFrame, int, int]:
    """Tiles in grid order: numbered rows of packed vectors with the boxes of their blocks."""
    rows = max(FAN, min(cfg.tile, cfg.tile_bytes // (8 * width)) // FAN * FAN)
    basis = principal_directions(vectors, width, min(cfg.dims, width))
    k = basis.shape[1] + 1
    eps = np.sqrt(max(2 - 2 * cfg.cosine, 1e-6))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = coordinates(units(matrix(batch.column("v"), width)), basis)
            cells = np.floor(y / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int32())), pa.array(list(y), pa.list_(pa.float64()))], ["h1", "h2", "w", "v", "cell", "y"])

    tasks = max(1, min(cfg.max_tasks, n // (rows * cfg.tiles_per_task)))
    order = [F.col("cell")[i] for i in range(k)] + [F.col("y")[0], F.col("h1"), F.col("h2")]
    placed = vectors.mapInArrow(place, "h1 long, h2 long, w long, v array<double>, cell array<int>, y array<double>")
    placed = placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        task, seq, have = TaskContext.get().partitionId(), 0, 0

        def tile(table: pa.Table) -> pa.RecordBatch:
            nonlocal seq
            col = {c: table.column(c).combine_chunks() for c in table.column_names}
            y = matrix(col["y"], k)
            step = rows // FAN
            at = np.arange(0, len(y), step)
            out = {
                "task": [task], "seq": [seq], "n": [len(y)], "low": [np.minimum.reduceat(y, at).tobytes()], "high": [np.maximum.reduceat(y, at).tobytes()],
                "v": [matrix(col["v"], width).tobytes()], "len": [pc.list_value_length(col["v"]).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()],
                "w": [col["w"].to_numpy(zero_copy_only=False).tobytes()], "h1": [col["h1"].to_numpy(zero_copy_only=False).tobytes()], "h2": [col["h2"].to_numpy(zero_copy_only=False).tobytes()],
            }
            seq += 1
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            held.append(batch)
            have += batch.num_rows
            while have >= rows:
                table = pa.Table.from_batches(held)
                yield tile(table.slice(0, rows))
                held, have = table.slice(rows).to_batches(), have - rows
        if have:
            yield tile(pa.Table.from_batches(held))

    packed = stored(placed.mapInArrow(build, "task long, seq long, n long, low binary, high binary, v binary, len binary, w binary, h1 binary, h2 binary"))
    per_task = sorted(packed.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per task, max_tasks or the session's partitions
    first, total = {}, 0
    for task, tiles in per_task:
        first[task], total = total, total + tiles
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in first.items() for x in pair]), F.col("task")) if first else F.lit(0)
    return packed.withColumn("tile", offset + F.col("seq")).drop("task", "seq"), rows, total


def _parents(nodes: DataFrame, k: int) -> DataFrame:
    """One row per parent with the boxes of its children packed, and its own box."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        low = np.array([np.frombuffer(b) for b in pdf["box_low"]])
        high = np.array([np.frombuffer(b) for b in pdf["box_high"]])
        return pd.DataFrame({
            "node": [int(pdf["node"].iloc[0]) // FAN], "first": [int(pdf["node"].iloc[0])], "low": [low.tobytes()], "high": [high.tobytes()],
            "box_low": [low.min(axis=0).tobytes()], "box_high": [high.max(axis=0).tobytes()],
        })

    return nodes.groupBy(F.floor(F.col("node") / FAN)).applyInPandas(pack, "node long, first long, low binary, high binary, box_low binary, box_high binary")


def near_boxes(a_low: bytes, a_high: bytes, b_low: bytes, b_high: bytes, k: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of boxes (row of a, row of b) whose squared distance is at most ``most``."""
    al, ah, bl, bh = (np.frombuffer(x).reshape(-1, k) for x in (a_low, a_high, b_low, b_high))
    gap = np.maximum(0, np.maximum(al[:, None] - bh[None], bl[None] - ah[:, None]))
    return np.nonzero((gap * gap).sum(axis=2) <= most)


def _descend(pairs: DataFrame, parents: DataFrame, k: int, most: float) -> DataFrame:
    """Pairs of children (a <= b) of the node pairs whose boxes are near each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                i, j = near_boxes(r["a_low"], r["a_high"], r["b_low"], r["b_high"], k, most)
                a, b = i + r["a_first"], j + r["b_first"]
                once = a <= b
                yield pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(b[once])], ["a", "b"])

    side = lambda s: parents.select(F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("first", "low", "high")])
    return pairs.join(side("a"), "a").join(side("b"), "b").drop("a", "b").mapInArrow(run, "a long, b long")


def _links_of_pair(left: dict, right: dict, same: bool, width: int, k: int, rows: int, cosine: float) -> tuple[np.ndarray, ...]:
    """(nodes, links, edge members, edge roots) of one pair of tiles."""
    step, most = rows // FAN, 2 - 2 * cosine + 1e-9
    raw = [scaled(np.frombuffer(t["v"]).reshape(-1, width)) for t in (left, right)]
    unit = [units(x) for x in raw]
    weight = [np.frombuffer(t["w"], np.int64) for t in (left, right)]
    length = [np.frombuffer(t["len"], np.int64) for t in (left, right)]
    base = [t["tile"] * rows for t in (left, right)]
    links = [np.zeros(len(x), np.int64) for x in raw]
    ea, eb = [], []
    for i, j in zip(*near_boxes(left["low"], left["high"], right["low"], right["high"], k, most)):
        if same and i > j:
            continue
        a, b = slice(i * step, (i + 1) * step), slice(j * step, (j + 1) * step)
        dot = unit[0][a] @ unit[1][b].T
        hit = dot >= cosine + 1e-9
        for x, y in zip(*np.nonzero(np.abs(dot - cosine) < 1e-9)):  # too close to tell after rounding: the plain formula decides
            p, q = raw[0][a][x], raw[1][b][y]
            hit[x, y] = np.dot(p, q) / (np.linalg.norm(p) * np.linalg.norm(q)) >= cosine
        hit &= length[0][a][:, None] == length[1][b][None]
        if same and i == j:
            np.fill_diagonal(hit, False)
        if not hit.any():
            continue
        links[0][a] += hit @ weight[1][b]
        if not (same and i == j):
            links[1][b] += hit.T @ weight[0][a]
        x, y = np.nonzero(hit)
        node, root = forest(base[0] + a.start + x, base[1] + b.start + y)
        ea.append(node)
        eb.append(root)
    if same:
        links = [links[0] + links[1]]
        base = base[:1]
    node = np.concatenate([b + np.arange(len(n)) for b, n in zip(base, links)])
    count = np.concatenate(links)
    if ea:
        ea, eb = forest(np.concatenate(ea), np.concatenate(eb))
    else:
        ea = eb = np.zeros(0, np.int64)
    return node[count > 0], count[count > 0], ea[ea != eb], eb[ea != eb]


def grid_join(vectors: DataFrame, cfg: GridJoinConfig = GridJoinConfig()) -> DataFrame:
    """(vec_id, n_links long, component_id, kept boolean) for every row of ``vectors(vec_id, embedding)``.

    Links join rows with a cosine of at least ``cosine`` in double precision;
    n_links counts linked rows (copies included), component_id is the smallest
    vec_id reachable. Null, empty and zero vectors, and vectors with null or
    non-finite components, link with nothing, nor do vectors of different lengths.
    Repeated rows link with each other; a null vec_id takes part and is never kept;
    other columns are ignored; an empty table gives no rows.
    """
    v = F.col("embedding").cast("array<double>")
    usable = F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", v.alias("v")).withColumn("ok", F.coalesce(usable, F.lit(False)))
    rows = rows.select("vec_id", "v", "ok", F.when(F.col("ok"), F.xxhash64("v")).alias("h1"), F.when(F.col("ok"), F.xxhash64(F.lit(1), "v")).alias("h2"))
    distinct = stored(rows.where("ok").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("w"), F.first("v").alias("v")))
    width, n = distinct.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    plain = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not n:
        return plain
    tiles, size, total = _tiles(distinct, width, n, cfg)
    k, most = min(cfg.dims, width) + 1, 2 - 2 * cfg.cosine + 1e-9

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [np.frombuffer(b).reshape(-1, k).min(axis=0).tobytes() for b in batch.column("low").to_pylist()]
            high = [np.frombuffer(b).reshape(-1, k).max(axis=0).tobytes() for b in batch.column("high").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("tile"), pa.array(low), pa.array(high)], ["node", "box_low", "box_high"])

    levels = []  # from the parents of tiles up to the root
    nodes = tiles.select("tile", "low", "high").mapInArrow(boxes, "node long, box_low binary, box_high binary")
    while total > 1:
        levels.append(cut(_parents(nodes, k)))
        nodes, total = levels[-1].select("node", "box_low", "box_high"), -(-total // FAN)
    top = levels[-1].select("node") if levels else tiles.select(F.col("tile").alias("node"))
    pairs = top.select(F.col("node").alias("a"), F.col("node").alias("b"))  # the whole sequence against itself
    for parents in reversed(levels):
        pairs = cut(_descend(pairs, parents, k, most))
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
    joined = sides.join(tiles.select("tile", "low", "high", "v", "len", "w"), "tile")

    def links(table: pa.Table) -> pa.Table:
        own = sorted(table.select(["tile", "low", "high", "v", "len", "w"]).to_pylist(), key=lambda t: t["tile"])
        node, count, a, b = _links_of_pair(own[0], own[-1], len(own) == 1, width, k, size, cfg.cosine)
        none = [None] * len(node)
        return pa.table({"a": pa.array(np.concatenate([node, a])), "b": pa.array(none + b.tolist(), pa.int64()), "n": pa.array(count.tolist() + [None] * len(a), pa.int64())})

    found = stored(joined.groupBy("a", "b").applyInArrow(links, "a long, b long, n long"))
    counts = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    roots = components(found.where("b is not null").select("a", "b"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                cols = [np.frombuffer(t[c], np.int64) for c in ("h1", "h2", "w")]
                yield pa.RecordBatch.from_arrays([pa.array(t["tile"] * size + np.arange(t["n"])), *map(pa.array, cols)], ["node", "h1", "h2", "w"])

    named = tiles.select("tile", "n", "h1", "h2", "w").mapInArrow(members, "node long, h1 long, h2 long, w long")
    named = named.join(counts, "node", "left").join(roots, "node", "left")
    named = stored(named.select("h1", "h2", (F.coalesce("linked", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    slim = rows.select("vec_id", "h1", "h2")
    tagged = stored(slim.join(named, ["h1", "h2"], "left").select("vec_id", "n_links", "root"))
    least = tagged.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    out = tagged.join(least, "root", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

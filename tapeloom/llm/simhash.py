"""SimHash near-duplicates, found with BK-trees.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word
shingles. Two fingerprints that differ in at most r bits agree in at least
``blocks - r`` of the blocks the 64 bits are cut into, so each fingerprint is
sent to one shard per choice of agreeing blocks, and each shard holds a BK-tree:
children hang on the integer Hamming distance to their parent, and a search with
radius r follows only the edges between d - r and d + r. All shards of a task
form one forest that is built and searched level by level on numpy arrays.

Equal fingerprints are one node however many documents share them. A shard with
more fingerprints than ``shard_limit`` is cut into chunks, and every pair of
chunks becomes a shard of its own (one chunk is the tree, the other searches it),
so no tree outgrows a task. Searches report a spanning forest, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import by_chunks, stored, text_bytes
from tapeloom.llm.components import components, star_batches

SEED = 42
_STEP = 1 << 16  # hashes whose bits are counted at once


@dataclass(frozen=True)
class SimHashConfig:
    """shingle: words per shingle; radius: differing bits that still link.

    shard_limit: fingerprints per BK-tree before a shard is cut into chunks.
    wanted_shard: mean shard size that picks the number of blocks.
    """

    shingle: int = 4
    radius: int = 4
    shard_limit: int = 4096
    wanted_shard: int = 64


def fingerprint(text: bytes, shingle: int) -> int:
    """The 64-bit majority of the shingle hashes, as a signed integer; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        pairs = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
        hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in pairs), np.uint64, n - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STEP):
        part = hashes[at : at + _STEP].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, also, fp) for every row of ``docs``; a null text has no words."""
    names = ["doc_id", *also]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_chunks(batches, "text", 2 << 20):
            fps = np.fromiter((fingerprint(t, shingle) for t in text_bytes(part.column("text"))), np.int64, part.num_rows)
            yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.array(fps)], [*names, "fp"])

    kinds = ", ".join(f"{c} {t}" for c, t in docs.select(*names).dtypes)
    return docs.select(*names, "text").mapInArrow(run, f"{kinds}, fp long")


def agreeing_masks(n: int, radius: int, wanted: int) -> list[int]:
    """Signed bit masks such that two values within ``radius`` bits agree under one of them.

    Cutting 64 bits into ``radius + m`` blocks leaves m untouched blocks; more
    blocks give longer keys and so smaller shards. The least m that keeps a mean
    shard of n random values at ``wanted`` is taken; any m gives the same links.
    """
    m = 1
    while m < 5 and n / 2 ** (64 * m / (radius + m)) > wanted:
        m += 1
    blocks = np.array_split(np.arange(64), radius + m)
    masks = [sum(1 << int(i) for k in chosen for i in blocks[k]) for chosen in combinations(range(radius + m), m)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


class BkForest:
    """One BK-tree per shard over sorted shards. ``fp`` uint64, ``shard`` ids ascending."""

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        self.fp = fp
        self.shards, self.root, self.size = np.unique(shard, return_index=True, return_counts=True)
        at = self.root[np.searchsorted(self.shards, shard)]
        rest = np.flatnonzero(at != np.arange(len(fp)))
        codes, children = [], []
        while len(rest):  # all items that reach a node do so at the same level
            code = at[rest] * 65 + np.bitwise_count(fp[rest] ^ fp[at[rest]])
            own, first, group = np.unique(code, return_index=True, return_inverse=True)
            codes.append(own)
            children.append(rest[first])
            at[rest] = rest[first][group]
            rest = np.delete(rest, first)
        order = np.argsort(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        self.edge = np.concatenate(codes)[order] if codes else np.zeros(0, np.int64)
        self.child = np.concatenate(children)[order] if codes else np.zeros(0, np.int64)

    def near(self, fp: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query position, tree position) of every pair within the radius in the same shard."""
        at = np.minimum(np.searchsorted(self.shards, shard), len(self.shards) - 1)
        q = np.flatnonzero(self.shards[at] == shard)
        node = self.root[at[q]]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(q):
            d = np.bitwise_count(fp[q] ^ self.fp[node]).astype(np.int64)
            hit = d <= radius
            found.append((q[hit], node[hit]))
            low = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), side="right") - low
            first = np.cumsum(n) - n
            node = self.child[np.arange(n.sum()) - np.repeat(first - low, n)]
            q = np.repeat(q, n)
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (q, q)


def shard_edges(shard: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """Links inside whole shards (rows sorted by shard) as stars. side 0: tree, 1: search, 2: both."""
    order = np.argsort(shard, kind="stable")
    shard, side, bits = shard[order], side[order], fp[order].view(np.uint64)
    tree, search = side != 1, side != 0
    if not tree.any() or not search.any():
        return
    forest = BkForest(bits[tree], shard[tree])
    fq, sq = bits[search], shard[search]
    at = np.minimum(np.searchsorted(forest.shards, sq), len(forest.shards) - 1)
    cost = np.cumsum(np.where(forest.shards[at] == sq, forest.size[at], 0))
    start = 0
    while start < len(fq):  # slices that visit a bounded number of nodes
        stop = max(start + 1, int(np.searchsorted(cost, (cost[start - 1] if start else 0) + (1 << 21), side="right")))
        q, t = forest.near(fq[start:stop], sq[start:stop], radius)
        a, b = fq[start:stop][q].view(np.int64), forest.fp[t].view(np.int64)
        other = a != b
        yield from star_batches(a[other], b[other])
        start = stop


def near_edges(fps: DataFrame, cfg: SimHashConfig) -> DataFrame:
    """Star edges (a, b) that connect all distinct fingerprints within the radius."""
    masks = agreeing_masks(fps.count(), cfg.radius, cfg.wanted_shard)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"))
    keyed = keyed.join(sizes.where("n > 1"), ["t", "key"])  # a shard of one links nothing
    parts = F.ceil(F.col("n") / cfg.shard_limit)
    own = F.pmod(F.xxhash64("fp", F.lit(1)), parts)
    one = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(2).alias("side")))
    many = F.transform(
        F.sequence(F.lit(0).cast("long"), parts - 1),
        lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j"), F.when(o == own, 2).when(own < o, 0).otherwise(1).alias("side")),
    )
    units = keyed.select("fp", "t", "key", F.explode(F.when(parts > 1, many).otherwise(one)).alias("u")).select(
        F.xxhash64("t", "key", "u.i", "u.j").alias("shard"), F.col("u.side").cast("int").alias("side"), "fp"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held.append(cols)
            n += batch.num_rows
            if n >= 1 << 18:  # keep the last shard, which may go on in the next batch
                shard, side, fp = (np.concatenate(x) for x in zip(*held))
                last = int(np.searchsorted(shard, shard[-1]))
                yield from shard_edges(shard[:last], side[:last], fp[:last], cfg.radius)
                held, n = [[shard[last:], side[last:], fp[last:]]], len(shard) - last
        if held:
            yield from shard_edges(*(np.concatenate(x) for x in zip(*held)), cfg.radius)

    return units.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "a long, b long")


def rooted_fingerprints(rows: DataFrame, cfg: SimHashConfig, *kept: Column) -> DataFrame:
    """(fp, root, kept aggregates of its rows): one row per fingerprint of ``rows(fp, ...)``."""
    fps = stored(rows.groupBy("fp").agg(*kept))
    root = components(near_edges(fps.select("fp"), cfg)).withColumnRenamed("node", "fp")
    return stored(fps.join(root, "fp", "left").select(fps["*"], F.coalesce("root", "fp").alias("root")))


def one_of_each_group(docs: DataFrame, cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """One row of each component, with all columns: the smallest id, then the smallest row hash.

    Rows with a null id are kept only if their component has no other; of identical
    rows one stays. Columns must be of types that can be hashed.
    """
    key = [F.xxhash64(*docs.columns), F.xxhash64(F.lit(1), *docs.columns)]
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    slim = stored(fingerprints(docs.select("doc_id", "text", key[0].alias("k1"), key[1].alias("k2")), cfg.shingle, ("k1", "k2")))
    rooted = rooted_fingerprints(slim, cfg, F.min(order).alias("first"))
    chosen = stored(rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.k1").alias("__k1"), F.col("first.k2").alias("__k2")))
    rows = docs.withColumns({"__h1": key[0], "__h2": key[1]})
    same = Window.partitionBy("__h1", "__h2").orderBy(F.lit(0))
    kept = rows.join(chosen, (F.col("__h1") == F.col("__k1")) & (F.col("__h2") == F.col("__k2"))).withColumn("__copy", F.row_number().over(same))
    return kept.where("__copy = 1").select(*docs.columns)


def simhash_components(docs: DataFrame, cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id reachable through links. Null and blank
    texts have fingerprint zero and link like any other; repeated rows are kept; a
    null doc_id takes part and gets its component's smallest id (null if it has
    none); other columns of ``docs`` are ignored; an empty table gives no rows.
    """
    rows = stored(fingerprints(docs, cfg.shingle))
    rooted = rooted_fingerprints(rows, cfg, F.min("doc_id").alias("least"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = stored(rooted.join(least, "root").select("fp", "component_id"))
    return rows.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

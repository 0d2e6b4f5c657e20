"""Prefix trie of conversations, built in sorted shards around a splitter skeleton.

A conversation is the sequence of its turns' digests, and nodes are the distinct
prefixes. Sequences are dealt to shards by splitters, short prefixes that separate
neighbours of a sorted sample. In a sorted shard a node's members are neighbours,
so one pass with a stack of open nodes finishes every node, except those whose
members may lie in several shards: the proper prefixes of the splitters. Their
trie, the skeleton, is broadcast; shards return partial aggregates for it, and one
reduction by skeleton node combines them.

The texts are hashed where they are read. Equal sequences are merged before they
are dealt, so a conversation that most rows repeat is one row of a shard. What a
task holds are the open nodes and finished children that wait for their parent's
smallest member, at most the turns of its shard. The path of one conversation, 32
characters a turn, is one value.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import stored

_WIDTH = 32  # hex digits of a turn's digest
NO_ENDS = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class TrieConfig:
    """shard_turns: turns in a shard, about. max_shards, splitter_turns: bounds of the broadcast skeleton.

    sample_per_shard: sampled sequences per shard, which set the splitters and nothing else.
    chunk_ids: ids written in one piece for the digest of a node's ends.
    """

    shard_turns: int = 8192
    max_shards: int = 16384
    splitter_turns: int = 64
    sample_per_shard: int = 16
    chunk_ids: int = 4096


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): array of (turn, digest, bytes) by turn, null first; equal turns by their digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, _WIDTH)
    turn = F.struct("turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return conversations.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def head_turns(conv_id: str | Column) -> Column:
    c = F.col(conv_id) if isinstance(conv_id, str) else conv_id
    return (F.crc32(c.cast("string").cast("binary")) % 9).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, sizes) of every conversation whose first turns are replaced by those of the
    first of its five neighbours."""
    own = stored(turns_of(conversations))
    heads = own.where(F.col("conv_id") % 5 == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("head"))
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).join(heads, "base", "left").withColumn("h", head_turns("conv_id"))
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", 1, F.col("h")))
    turns = F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns")))
    return joined.select("conv_id", turns.alias("turns")).select("conv_id", F.array_join("turns.digest", "").alias("path"), F.col("turns.bytes").alias("sizes"))


def ends_digest(rows: DataFrame, cfg: TrieConfig = TrieConfig()) -> DataFrame:
    """(k, ends): SHA-256 of each key's ``conv_id`` in ascending order, comma-joined, of ``rows(k, conv_id)``.

    Ids are sorted and written as text in slices, whatever the keys; only the text of
    a key passes one task, chunk by chunk, because the hash is sequential.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []

        def close() -> None:
            if ids:
                out.append((key, ids[0], ",".join(map(str, ids))))
                ids.clear()

        for batch in batches:
            for k, c in zip(batch.column("k").to_pylist(), batch.column("conv_id").to_pylist()):
                if k != key or len(ids) >= cfg.chunk_ids:
                    close()
                    key = k
                ids.append(c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))], ["k", "at", "ids"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))], ["k", "at", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, keys, ends = None, None, [], []
        for batch in batches:
            for k, ids in zip(batch.column("k").to_pylist(), batch.column("ids").to_pylist()):
                if k != key:
                    if state is not None:
                        keys.append(key)
                        ends.append(state.hexdigest())
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ends, pa.string())], ["k", "ends"])
            keys, ends = [], []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["k", "ends"])

    written = rows.select("k", "conv_id").repartitionByRange("k", "conv_id").sortWithinPartitions("k", "conv_id").mapInArrow(chunks, "k string, at long, ids string")
    return written.repartition("k").sortWithinPartitions("k", "at").mapInArrow(digests, "k string, ends string")


# ---------------------------------------------------------------- skeleton


@dataclass
class Skeleton:
    """Splitters in order, and the trie of their proper prefixes; node 0 is the root.

    child: (node, digest) -> node. rows: per node its parent, depth, number of skeleton
    children, and the bytes of the last turns of all skeleton nodes in its subtree.
    """

    splitters: list[str] = field(default_factory=list)
    child: dict[tuple[int, str], int] = field(default_factory=dict)
    rows: list[list] = field(default_factory=lambda: [[None, 0, 0, 0]])


def skeleton(sample: list[tuple[str, list[int]]], shards: int, cfg: TrieConfig) -> Skeleton:
    """Splitters that cut the sample (path, sizes) into ``shards`` parts of about equal turns."""
    out = Skeleton()
    sample = sorted(sample)
    step = sum(len(s) + 1 for _, s in sample) / max(1, shards)
    filled, bound = 0, step
    for (a, _), (b, sizes) in zip(sample, sample[1:]):
        filled += len(a) // _WIDTH + 1
        if filled < bound:
            continue
        same = 0
        while b.startswith(a[same * _WIDTH : (same + 1) * _WIDTH] or "-", same * _WIDTH):
            same += 1
        cut = b[: (same + 1) * _WIDTH]
        if same >= cfg.splitter_turns or len(cut) != (same + 1) * _WIDTH:
            continue
        bound = filled + step
        out.splitters.append(cut)
        node = 0
        for d in range(same):
            key = node, cut[d * _WIDTH : (d + 1) * _WIDTH]
            if key not in out.child:
                out.child[key] = len(out.rows)
                out.rows[node][2] += 1
                out.rows.append([node, d + 1, 0, sizes[d]])
            node = out.child[key]
    for node in range(len(out.rows) - 1, 0, -1):  # children come after their parent
        out.rows[out.rows[node][0]][3] += out.rows[node][3]
    return out


class ShardPass:
    """Nodes of one shard's sorted sequences. Finished rows gather in ``out``:

    (skeleton node or None, conv_id, depth, parent_conv_id, parent's skeleton node or None,
    n_convs, n_children, n_leaves, saved, ends).
    """

    def __init__(self, held: Skeleton):
        self.held = held
        self.out: list[tuple] = []
        self.path: list[str] = []
        self.open: list[dict] = []

    def _node(self, skeleton: int | None, size: int) -> dict:
        return {"skeleton": skeleton, "size": size, "n": 0, "least": None, "children": 0, "leaves": 0, "saved": 0, "ends": None, "waiting": []}

    def add(self, path: str, sizes: list[int], conv_id: int, n: int, ends: str) -> None:
        turns = [path[i : i + _WIDTH] for i in range(0, len(path), _WIDTH)]
        same = 0
        while same < len(turns) and same < len(self.path) and turns[same] == self.path[same]:
            same += 1
        self.close(same + 1)
        if not self.open:
            self.open.append(self._node(0, 0))
        for d in range(same, len(turns)):
            above = self.open[-1]["skeleton"]
            self.open.append(self._node(None if above is None else self.held.child.get((above, turns[d])), sizes[d]))
        self.path = turns
        last = self.open[-1]
        last["n"], last["least"], last["ends"] = n, conv_id, ends

    def close(self, keep: int) -> None:
        """Finish the open nodes beyond the first ``keep``."""
        while len(self.open) > keep:
            node, depth = self.open.pop(), len(self.open)
            inside = node["skeleton"] is None
            node["leaves"] += inside and not node["children"]
            node["saved"] += (node["n"] - inside) * node["size"]
            self.out += [(None, *row[:2], node["least"], *row[2:]) for row in node["waiting"]]
            above = self.open[-1] if self.open else None
            counts = node["n"], node["children"], node["leaves"], node["saved"], node["ends"]
            if not inside:
                self.out.append((node["skeleton"], node["least"], depth, None, None, *counts))
            elif above["skeleton"] is None:
                above["waiting"].append((node["least"], depth, None, *counts))
            else:
                self.out.append((None, node["least"], depth, None, above["skeleton"], *counts))
            if above is not None:
                above["n"] += node["n"]
                above["least"] = node["least"] if above["least"] is None else min(above["least"], node["least"])
                above["children"] += inside
                above["leaves"] += node["leaves"]
                above["saved"] += node["saved"]


_ROW = "skeleton int, conv_id long, depth long, parent_conv_id long, parent_skeleton int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string()]
_RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(sequences: DataFrame, cfg: TrieConfig = TrieConfig()) -> DataFrame:
    """One row per node of ``sequences(conv_id, path, sizes)`` (unique, non-null ids), see ``conversation_trie``."""
    spark = sequences.sparkSession
    rows = stored(sequences.select("conv_id", "path", "sizes", F.sha2("path", 256).alias("k")))
    groups = rows.groupBy("k").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    firsts = groups.join(ends_digest(rows, cfg), "k").drop("k")
    distinct = stored(rows.drop("k").join(firsts, "conv_id"))
    n, turns = distinct.agg(F.count(F.lit(1)), F.sum(F.size("sizes") + 1)).first()
    shards = min(cfg.max_shards, -(-(turns or 0) // cfg.shard_turns))
    every = max(1, n // max(1, shards * cfg.sample_per_shard))
    most = cfg.splitter_turns + 1
    sample = distinct.where(F.pmod(F.xxhash64("path"), F.lit(every)) == 0).select(F.substring("path", 1, most * _WIDTH), F.slice("sizes", 1, most)).collect() if shards > 1 else []
    held = skeleton([(r[0], r[1]) for r in sample], shards, cfg)
    sent = spark.sparkContext.broadcast(held)  # at most max_shards * splitter_turns nodes

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = [bisect_right(sent.value.splitters, p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *batch.columns], ["shard", *batch.schema.names])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, step = None, ShardPass(sent.value)

        def ready() -> pa.RecordBatch:
            out, step.out = step.out, []
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _TYPES)], [c.split()[0] for c in _ROW.split(", ")])

        for batch in batches:
            for at, path, sizes, conv_id, n, ends in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "sizes", "conv_id", "n", "ends"))):
                if at != shard:
                    step.close(0)
                    shard, step.path = at, []
                step.add(path, sizes, conv_id, n, ends)
            if step.out:
                yield ready()
        step.close(0)
        if step.out:
            yield ready()

    dealt = distinct.select("path", "sizes", "conv_id", "n", "ends").mapInArrow(deal, "shard int, path string, sizes array<long>, conv_id long, n long, ends string")
    nodes = stored(dealt.repartition("shard").sortWithinPartitions("shard", "path").mapInArrow(finish, _ROW))

    shape = spark.createDataFrame([(i, *r) for i, r in enumerate(held.rows)], "skeleton int, up int, at int, kids long, bytes long")
    partial = nodes.where(F.col("skeleton").isNotNull()).groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("ends_sha256").alias("ends_sha256"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    whole = stored(
        partial.join(shape, "skeleton")
        .withColumn("n_children", F.col("n_children") + F.col("kids"))
        .withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long"))  # a root without turns
        .withColumn("saved_tokens", F.col("saved_tokens") - F.col("bytes"))
    )
    parent = whole.select(F.col("skeleton").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    shared = whole.join(parent, "up", "left")
    local = nodes.where(F.col("skeleton").isNull())
    below = local.where(F.col("parent_skeleton").isNotNull()).drop("parent_conv_id").join(parent, F.col("parent_skeleton") == F.col("up"))
    inner = local.where(F.col("parent_skeleton").isNull())
    out = shared.select(*_RESULT).unionByName(below.select(*_RESULT)).unionByName(inner.select(*_RESULT))
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))


def conversation_trie(conversations: DataFrame, cfg: TrieConfig = TrieConfig()) -> DataFrame:
    """Nodes of the trie of ``conversations(conv_id, turn, role, text)``, rebuilt by ``rebuilt``.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty; a null turn comes first, equal turns are ordered by
    their digest and all count; rows without a conv_id belong to no conversation; a
    conversation without turns ends at the root; other columns are ignored; an empty
    table has no nodes. Turns are told apart by 128 bits of SHA-256.
    """
    return prefix_trie(rebuilt(conversations), cfg)


def oracle_sql(crc32: str) -> str:
    """The same result in DuckDB SQL; ``crc32`` is that function's SQL for the column conv_id."""
    return f"""
WITH t AS (
  SELECT conv_id, turn, strlen(coalesce(text, '')) AS b, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))[:{_WIDTH}] AS d
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(struct_pack(d := d, b := b) ORDER BY turn NULLS FIRST, d) AS l, {crc32} % 9 AS h FROM t GROUP BY conv_id),
seq AS (SELECT o.conv_id, coalesce(x.l[: o.h], []) || o.l[o.h + 1 :] AS l FROM own o LEFT JOIN own x ON x.conv_id = o.conv_id - o.conv_id % 5),
pre AS (SELECT conv_id, len(l) AS n, l, unnest(range(0, len(l) + 1)) AS depth FROM seq),
node AS (
  SELECT depth, list_transform(l[: depth], lambda x: x.d) AS p, any_value(l[depth].b) AS b, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM pre GROUP BY 1, 2),
kids AS (SELECT p[: depth - 1] AS p, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.p = node.p),
up AS (SELECT p[: unnest(range(0, depth + 1))] AS p, n_children, (n_convs - 1) * coalesce(b, 0) AS s FROM full_node),
tree AS (SELECT p, count(*) FILTER (n_children = 0) AS n_leaves, sum(s) AS s FROM up GROUP BY 1)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children, t.n_leaves, t.s::BIGINT AS saved_tokens, n.ends_sha256
FROM full_node n JOIN tree t ON t.p = n.p LEFT JOIN node q ON n.depth > 0 AND q.p = n.p[: n.depth - 1]"""

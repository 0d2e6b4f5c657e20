"""Language-model scoring by online logistic context mixing.

A text is its lower-cased words and one end, coded in their order. A word is a path of
binary decisions: whether training has not met it, six for its class of frequency, then
its number in the class. A word that training has not met is spelled after that: its
bytes and a blank, the end a newline, each byte as eight decisions. So the product of
the decisions is a probability over texts, and every decision is a mix: contexts count
zeros and ones, their log odds are added with weights from a set that is chosen by how
much the longer contexts have seen; the weights are learned online, by a normalised step
after every slice of decisions, and an adaptive table then maps the mixed odds to those
that came true.

The decisions of the running text are predicted from the path so far alone, with the word
before, with the two words before, and with the word before the last (hashed tables); the
plain frequency of a word is one of these inputs. Spelled bytes are predicted from the
one, two, three and four bytes before them in the word (hashed tables) and the whole word
so far; nothing there depends on other words, so it runs over distinct tokens.

1. Chunks of documents become token numbers and a dictionary; the dictionaries'
   training counts are added up to the vocabulary, whose known words get their paths.
2. Tokens that share their first bytes are packed into blocks. In a sorted block
   equal prefixes are neighbours, which gives the counts of the word so far. Prefix
   groups with too many tokens are grouped by a longer prefix.
3. Tasks count contexts into tables of at most ``slots`` entries, learn weights from
   counts without the predicted occurrence itself (so that rare words teach what
   new words need), and average them; then every unknown token gets its probability.
4. Paths and spellings return to the dictionaries. Over the running words of all chunks
   contexts are counted (at most ``run_slots`` entries a table), weights learned in the
   same way, a word met once being new without itself, and all texts scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tapeloom.llm.common import by_chunks, cut, fold_mod, stored, text_bytes

_INPUTS, _GATES, _SLICE = 6, 28 * 8, 1 << 16  # inputs with bias; weight sets; bytes per online step
_LEVELS = 33  # of the adaptive table
_REACH = 256  # bytes the word-so-far context follows
_PART = 1 << 16  # table entries per row on the way to the driver
_CLASS = 6  # decisions for the class of a known word
_RUN_INPUTS, _RUN_GATES, _RUN_SLICE = 5, 60, 1 << 14  # the running text's inputs with bias; weight sets; words per online step
_NEW = 3  # path of a word that training has not met
_LOGS = np.log(np.arange(65536) + 0.4).astype(np.float32)


@dataclass(frozen=True)
class MixLmConfig:
    """slots: most entries of a hashed table, a power of two; they are twice the vocabulary below that.

    run_slots: the same for the running text, four times the training tokens below that. rounds: passes of weight learning. group: tokens that may share a prefix group.
    block: tokens per block. chunk_bytes: text per chunk. Fold ``held`` of ``folds``
    is never learned from.
    """

    slots: int = 1 << 20
    run_slots: int = 1 << 22
    rounds: int = 2
    group: int = 50_000
    block: int = 20_000
    chunk_bytes: int = 16 << 20
    folds: int = 7
    held: int = 2


def packed(values: np.ndarray) -> bytes:
    """An array compressed by byte planes, for what is shuffled and stored."""
    return zlib.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def unpacked(data: bytes, dtype: type) -> np.ndarray:
    return np.frombuffer(np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1).T.tobytes(), dtype)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Large rows, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


class _Numbers(dict):
    def __missing__(self, token: bytes) -> int:
        n = self[token] = len(self)
        return n


def encode(docs: DataFrame, cfg: MixLmConfig) -> DataFrame:
    """Rows of two kinds per chunk: texts as token numbers with their coded bytes, and the chunk's tokens with training counts."""
    kind = docs.select("doc_id").dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        for part in by_chunks(batches, "text", cfg.chunk_bytes):
            numbers = _Numbers({b"": 0})  # the end
            get = numbers.__getitem__
            codes, width = [], []
            for text in text_bytes(part.column("text")):
                words = text.lower().split()
                words.append(b"")
                codes.append(np.fromiter(map(get, words), np.int32, len(words)))
                width.append(sum(map(len, words)) + len(words))
            trained = [c for c, held in zip(codes, part.column("held_out").to_pylist()) if not held]
            count = np.bincount(np.concatenate(trained), minlength=len(numbers)) if trained else np.zeros(len(numbers), np.int64)
            chunk, n, m = (task << 24) + seq, part.num_rows, len(numbers)
            seq += 1
            none = lambda k, t: pa.nulls(k, t)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * n), part.column("doc_id"), part.column("held_out"), pa.array([packed(c) for c in codes], pa.binary()), none(n, pa.binary()), none(n, pa.int32()), pa.array(width, pa.int64())], names
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * m), none(m, part.column("doc_id").type), none(m, pa.bool_()), none(m, pa.binary()), pa.array(list(numbers), pa.binary()), pa.array(np.arange(m, dtype=np.int32)), pa.array(count.astype(np.int64))], names
            )

    names = ["chunk", "doc_id", "held_out", "codes", "tok", "num", "c"]
    rows = docs.select("doc_id", (fold_mod("doc_id", cfg.folds) == cfg.held).alias("held_out"), "text")
    return stored(rows.mapInArrow(run, f"chunk long, doc_id {kind}, held_out boolean, codes binary, tok binary, num int, c long"))


def token_blocks(vocabulary: DataFrame, cfg: MixLmConfig) -> DataFrame:
    """(reach, toks, lens, counts): blocks of whole prefix groups; ``reach`` bytes make the group.

    Groups come in hash order, so that online learning doesn't meet the alphabet in order.
    """
    keyed = vocabulary.withColumn("reach", F.lit(4)).withColumn("key", F.substring("tok", 1, 4))
    for longer in (12, 48, 1 << 20):
        hot = cut(keyed.groupBy("reach", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cfg.group).select("reach", "key", F.lit(True).alias("hot")))
        if hot.isEmpty():
            break
        keyed = keyed.join(hot, ["reach", "key"], "left").select(
            "tok", "c", F.when(F.col("hot"), longer).otherwise(F.col("reach")).alias("reach"), F.when(F.col("hot"), F.substring("tok", 1, longer)).otherwise(F.col("key")).alias("key")
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int]] = []
        reach, key = None, None

        def block() -> pa.RecordBatch:
            toks = [t for t, _ in held]
            lens, c = np.array([len(t) for t in toks], np.int32), np.array([c for _, c in held], np.int64)
            return pa.RecordBatch.from_arrays([pa.array([reach], pa.int32()), pa.array([b"".join(toks)]), pa.array([lens.tobytes()]), pa.array([c.tobytes()])], ["reach", "toks", "lens", "counts"])

        for batch in batches:
            for t, c, r, k in zip(*(batch.column(x).to_pylist() for x in ("tok", "c", "reach", "key"))):
                if held and (r != reach or k != key and len(held) >= cfg.block):
                    yield block()
                    held = []
                reach, key = r, k
                held.append((t, c))
        if held:
            yield block()

    placed = keyed.select("tok", "c", "reach", "key").repartition("reach", "key").sortWithinPartitions("reach", F.xxhash64("key"), "key")
    return stored(placed.mapInArrow(run, "reach int, toks binary, lens binary, counts binary"))


class Block:
    """A block's tokens in coded order, with the counts of the word so far at every decision."""

    def __init__(self, reach: int, toks: bytes, lens: bytes, counts: bytes):
        ends = np.cumsum(np.frombuffer(lens, np.int32)).tolist()
        c = np.frombuffer(counts, np.int64)
        raw = [toks[i:j] for i, j in zip([0, *ends], ends)]
        coded = [t + b" " if t else b"\n" for t in raw]
        order = sorted(range(len(raw)), key=coded.__getitem__)
        coded = [coded[i] for i in order]
        self.tokens, self.c = [raw[i] for i in order], c[order]
        self.bytes = np.frombuffer(b"".join(coded), np.uint8)
        self.length = np.array([len(t) for t in coded])
        self.start = np.cumsum(self.length) - self.length
        self.owner = np.repeat(np.arange(len(coded)), self.length)
        self.reach = reach
        self.total, self.ones, self.settled = self._so_far(coded)

    def _so_far(self, coded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per byte and bit: how often tokens with the same bits so far were seen, and went on with a one.

        And for how many bits no token has left the path.
        """
        total = np.zeros((len(self.bytes), 8), np.float32)
        ones = np.zeros((len(self.bytes), 8), np.float32)
        settled = np.zeros((len(self.bytes), 8), np.int16)
        at = np.flatnonzero(self.length > self.reach)
        heads = [coded[i][: self.reach] for i in at]
        new = np.array([True, *(a != b for a, b in zip(heads, heads[1:]))])[: len(at)]  # differs from its neighbour so far
        last, calm = np.full(len(at), -1.0), np.zeros(len(at), np.int16)
        i = self.reach
        while len(at) and i < _REACH:
            here = self.start[at] + i
            value, c = self.bytes[here], self.c[at].astype(np.float64)
            for k in range(8):
                bit = (value >> (7 - k)) & 1
                run = np.cumsum(new) - 1
                now = np.bincount(run, c)[run]
                calm = np.where(now == last, calm + 1, 0)
                last = now
                total[here, k], settled[here, k] = now, calm
                ones[here, k] = np.bincount(run, c * bit)[run]
                new[1:] |= bit[1:] != bit[:-1]
            i += 1
            keep = self.length[at] > i
            at, new, last, calm = at[keep], new[keep], last[keep], calm[keep]
            if len(new):
                new[0] = True  # tokens that have ended differ from all longer ones, so the others' flags hold
        return total, ones, settled

    def slices(self) -> Iterator[tuple[int, int]]:
        """Token ranges of about _SLICE bytes."""
        first = 0
        while first < len(self.tokens):
            last = max(first + 1, int(np.searchsorted(self.start, self.start[first] + _SLICE, side="right")) - 1)
            yield first, last
            first = last


def table_slots(b: Block, lo: int, hi: int, slots: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every bit of the bytes lo..hi: its number, its values, and the four contexts' slots."""
    value = b.bytes[lo:hi]
    place = np.arange(lo, hi) - b.start[b.owner[lo:hi]]
    before = [np.where(place >= k, b.bytes[np.maximum(np.arange(lo, hi) - k, 0)], 0).astype(np.uint64) for k in (1, 2, 3, 4)]
    ctx, mixed = np.zeros(hi - lo, np.uint64), []
    for k in range(4):
        ctx = ctx | (before[k] << np.uint64(8 * k))
        mixed.append((ctx + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15))
    shift = np.uint64(64 - slots.bit_length() + 1)
    node = np.ones(hi - lo, np.uint64)
    for k in range(8):
        bit = (value >> (7 - k)) & 1
        at = np.empty((4, hi - lo), np.int64)
        at[0] = (before[0] << np.uint64(8)) | node
        for j in (1, 2, 3):
            h = (mixed[j] ^ (node * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xBF58476D1CE4E5B9)
            at[j] = h >> shift
        yield k, bit, at
        node = (node << np.uint64(1)) | bit.astype(np.uint64)


def _sizes(slots: int) -> list[int]:
    return [1 << 16, slots, slots, slots]


def block_events(row: dict, slots: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(slots by table, bits, weights) of a block's training bytes."""
    b = Block(1 << 20, row["toks"], row["lens"], row["counts"])
    for first, last in b.slices():
        lo, hi = b.start[first], b.start[last - 1] + b.length[last - 1]
        c = b.c[b.owner[lo:hi]].astype(np.float32)
        for _, bit, at in table_slots(b, lo, hi, slots):
            yield at, bit, c


def count_contexts(rows: DataFrame, sizes: list[int], events: Callable) -> list[np.ndarray]:
    """The tables as (zeros, ones) pairs of 16 bits; larger counts are scaled down together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 * n, np.float32) for n in sizes]
        for row in rows_of(batches):
            for at, bit, c in events(row):
                for t in range(len(sizes)):
                    np.add.at(tables[t], 2 * at[t] + bit, c)
        for t, counts in enumerate(tables):
            for first in range(0, len(counts), 2 * _PART):
                part = counts[first : first + 2 * _PART]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([first // (2 * _PART)]), pa.array([packed(part)])], ["t", "part", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(2 * _PART)
        for n in table.column("n").to_pylist():
            total += unpacked(n, np.float32)
        pair = total.reshape(-1, 2)
        pair = np.minimum(np.ceil(pair * np.minimum(1, 65535 / np.maximum(pair.max(axis=1, keepdims=True), 1))), 65535)
        return pa.table({"t": table.column("t").slice(0, 1), "part": table.column("part").slice(0, 1), "n": pa.array([pair.astype(np.uint16).tobytes()])})

    tables = [np.zeros((n, 2), np.uint16) for n in sizes]
    parts = rows.mapInArrow(run, "t long, part long, n binary").groupBy("t", "part").applyInArrow(add, "t long, part long, n binary")
    for r in parts.toLocalIterator():  # tables of at most ``slots`` entries of 4 bytes
        tables[r.t][r.part * _PART : (r.part + 1) * _PART] = np.frombuffer(r.n, np.uint16).reshape(-1, 2)
    return tables


@dataclass(frozen=True)
class Mixer:
    """Everything a task needs to score tokens; bounded by ``slots``."""

    tables: list[np.ndarray]
    weights: np.ndarray
    adapted: np.ndarray  # log odds by weight set and level


def _above(values: np.ndarray, limits: tuple[int, ...]) -> np.ndarray:
    """How many of the limits each whole number is above."""
    out = np.zeros(values.shape, np.uint8)
    for limit in limits:
        out += values > limit
    return out


def decisions(b: Block, lo: int, hi: int, tables: list[np.ndarray], unseen: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, bits, weight sets) of the bytes lo..hi, bit by bit.

    unseen: take the decision's own occurrence out of all counts.
    """
    n = hi - lo
    x = np.empty((_INPUTS, 8, n), np.float32)
    x[5] = 0.3
    bits, gate = np.empty((8, n), np.uint8), np.empty((8, n), np.uint8)
    known = b.c[b.owner[lo:hi]] > 0
    within = np.arange(lo, hi) - b.start[b.owner[lo:hi]] >= b.reach
    pairs = [table.view(np.uint32).ravel() for table in tables]  # zeros in the lower half, ones in the upper
    for k, bit, at in table_slots(b, lo, hi, len(tables[1])):
        own_one = known & unseen & (bit == 1)
        own_zero = known & unseen & (bit == 0)
        for t in range(4):
            pair = np.take(pairs[t], at[t])
            zero, one = pair & np.uint32(0xFFFF), pair >> np.uint32(16)
            zero -= own_zero & (zero > 0)
            one -= own_one & (one > 0)
            np.subtract(_LOGS[one], _LOGS[zero], out=x[t, k])
        near = _above(zero + one, (0, 2, 30))
        one = b.ones[lo:hi, k]
        zero = np.maximum(b.total[lo:hi, k] - one - own_zero, 0)
        one = np.maximum(one - own_one, 0)
        x[4, k] = np.log((one + np.float32(0.4)) / (zero + np.float32(0.4)))
        seen = _above(zero + one, (0, 1, 2, 6, 30)) + np.uint8(1)
        bits[k] = bit
        path = _above(b.settled[lo:hi, k], (0, 7, 23))
        gate[k] = (np.where(within, seen * 4 + np.where(seen > 1, path, near), near)) * 8 + k
    return x.reshape(_INPUTS, -1), bits.ravel(), gate.ravel()


def _mixed(x: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip((weights[gate].T * x).sum(axis=0), -12, 12)


def _level(odds: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(2 * odds) + _LEVELS // 2, 0, _LEVELS - 1).astype(np.int64)


def first_weights() -> np.ndarray:
    """Weights to start from: the longest context that has seen anything leads."""
    w = np.zeros((7, 4, 8, _INPUTS))
    w[0, 1:, :, 3] = 1.0  # at the start of a word the last four bytes are all of it
    w[1, 1:, :, :4] = (0.05, 0.1, 0.2, 0.65)
    w[:2, 0, :, :4] = (0.1, 0.3, 0.6, 0.0)  # four bytes never seen
    for seen, trust in enumerate((0.4, 0.5, 0.6, 0.8, 0.95), 2):
        w[seen, :, :, 3] = 1 - trust
        for path, sure in enumerate((1.0, 1.3, 2.0, 3.0)):
            w[seen, path, :, 4] = trust * sure
    return w.reshape(_GATES, _INPUTS)


def block_slices(rows: Iterator[dict], tables: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(inputs, bits, weight sets, weights) of the blocks' decisions, without their own occurrence."""
    for row in rows:
        b = Block(row["reach"], row["toks"], row["lens"], row["counts"])
        for first, stop in b.slices():
            lo, hi = b.start[first], b.start[stop - 1] + b.length[stop - 1]
            yield *decisions(b, lo, hi, tables, True), np.tile(b.c[b.owner[lo:hi]], 8).astype(np.float32)


def learn_weights(rows: DataFrame, slices: Callable, weights: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and adapted odds: rounds of online learning in every task, averaged by the evidence of each weight."""
    gates, inputs = weights.shape
    adapted = np.tile((np.arange(_LEVELS) - _LEVELS // 2) / 2, (gates, 1))
    for last in [False] * (rounds - 1) + [True]:

        def run(batches: Iterator[pa.RecordBatch], begin: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            w, mass = begin.copy(), np.zeros((gates, inputs))
            true, n = np.zeros(gates * _LEVELS), np.zeros(gates * _LEVELS)
            for x, bit, gate, weight in slices(rows_of(batches)):
                size = np.bincount(gate, minlength=gates)
                order = np.argsort(gate.astype(np.uint8), kind="stable")  # decisions of a weight set lie together
                x, bit, gate = np.take(x, order, axis=1), bit[order], gate[order]
                stop = np.cumsum(size)
                sets = [(g, slice(stop[g] - size[g], stop[g])) for g in np.flatnonzero(size)]
                odds, now = np.empty(len(bit), np.float32), w.astype(np.float32)
                for g, at in sets:
                    np.dot(now[g], x[:, at], out=odds[at])
                np.clip(odds, -12, 12, out=odds)
                p = 1 / (1 + np.exp(-odds))
                error, slope = bit - p, np.maximum(p * (1 - p), np.float32(0.01))
                if weight is not None:
                    weight = weight[order]
                    error, slope = error * weight, slope * weight
                size_of_x = np.abs(x)
                reach = slope * size_of_x.sum(axis=0)
                for g, at in sets:  # the row sum bounds the curvature, so a step can't overshoot
                    mass[g] += size_of_x[:, at] @ reach[at]  # steps shrink as evidence grows
                    w[g] += np.clip((x[:, at] @ error[at]) / (mass[g] + 1), -0.1, 0.1)
                spot = gate * np.int64(_LEVELS) + _level(odds)
                true += np.bincount(spot, bit if weight is None else weight * bit, len(true))
                n += np.bincount(spot, weight, len(n))
            flat = np.concatenate([(w * mass).ravel(), mass.ravel(), true, n])
            own = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(flat[own])], ["i", "v"])

        sums = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # sizes of the mixer
        size = gates * inputs
        flat = np.zeros(2 * size + 2 * gates * _LEVELS)
        flat[sums.column("i").to_numpy()] = sums.column("v").to_numpy()
        mass = flat[size : 2 * size].reshape(weights.shape)
        weights = np.where(mass > 0, flat[:size].reshape(weights.shape) / np.maximum(mass, 1e-9), weights)
        if last:
            true, n = (flat[2 * size :][k * gates * _LEVELS : (k + 1) * gates * _LEVELS].reshape(gates, _LEVELS) for k in (0, 1))
            p = (true + 20 / (1 + np.exp(-adapted))) / (n + 20)
            p = np.clip(p, 1e-6, 1 - 1e-6)
            adapted = np.log(p / (1 - p))
    return weights, adapted


def token_scores(b: Block, mixer: Mixer) -> np.ndarray:
    """log10 probability of every token of a block."""
    out = np.empty(len(b.tokens))
    for first, last in b.slices():
        lo, hi = b.start[first], b.start[last - 1] + b.length[last - 1]
        x, bit, gate = decisions(b, lo, hi, mixer.tables, False)
        odds = _mixed(x, gate, mixer.weights)
        odds = (odds + mixer.adapted[gate, _level(odds)]) / 2
        nats = -np.logaddexp(0, np.where(bit == 1, -odds, odds)).reshape(8, -1).sum(axis=0)
        out[first:last] = np.add.reduceat(nats, b.start[first:last] - lo) / np.log(10)
    return out


def word_paths(vocabulary: DataFrame, total: int, distinct: int) -> DataFrame:
    """(tok, c, path) of the words training has met.

    A path is a one, the decision that the word is known, its class (how often two halves
    the training tokens to its count) and its number in the class, in as many bits as the
    class needs. Numbers run on through buckets of words, so no task numbers a whole class.
    """
    buckets = 1 + distinct // 50_000
    known = vocabulary.where("c > 0").select(
        "tok", "c", F.least(F.floor(F.log2(F.lit(float(total)) / F.col("c"))), F.lit(62)).cast("long").alias("cls"), F.pmod(F.xxhash64("tok"), F.lit(buckets)).alias("bucket")
    )
    sizes = known.groupBy("cls", "bucket").agg(F.count(F.lit(1)).alias("n"))  # a row per class and bucket
    before = Window.partitionBy("cls").orderBy("bucket")
    sizes = cut(sizes.select("cls", "bucket", (F.sum("n").over(before) - F.col("n")).alias("first"), F.ceil(F.log2(F.sum("n").over(Window.partitionBy("cls")))).alias("bits")))
    number = F.col("first") + F.row_number().over(Window.partitionBy("cls", "bucket").orderBy("tok")) - 1
    return known.join(sizes, ["cls", "bucket"]).withColumn("number", number).selectExpr(
        "tok", "c", f"shiftleft(2L, CAST({_CLASS} + bits AS INT)) + shiftleft(cls, CAST(bits AS INT)) + number AS path"
    )


class Evidence:
    """What the running contexts have seen, by slot: log odds, and their share in the choice of a weight set.

    learning: by slot and bit, without the decision's own occurrence.
    """

    def __init__(self, tables: list[np.ndarray], learning: bool):
        self.learning, self.slots = learning, len(tables[0])
        self.odds, self.sets = [], []
        for t, table in enumerate(tables):
            zero, one = table[:, 0], table[:, 1]
            pairs = [(zero - (zero > 0), one), (zero, one - (one > 0))] if learning else [(zero, one)]
            odds = np.empty((len(table), len(pairs)), np.float32)
            sets = np.empty((len(table), len(pairs)), np.uint8)
            for k, (z, o) in enumerate(pairs):
                np.subtract(_LOGS[o], _LOGS[z], out=odds[:, k])
                if t in (1, 2):
                    limits, weight = ((0, 1, 3, 15), 12) if t == 1 else ((0, 1, 5), 3)
                    sets[:, k] = weight * _above(z.astype(np.int32) + o, limits)
            self.odds.append(odds.ravel())
            self.sets.append(sets.ravel() if t in (1, 2) else None)


class Running:
    """The words of a chunk's texts in their order: paths, counts and the words before.

    Before a text stand two words of path 0.
    """

    def __init__(self, row: dict, trained: bool = False):
        codes, n = unpacked(row["codes"], np.int32), np.frombuffer(row["n"], np.int64)
        start = np.cumsum(n) - n
        self.codes, self.path, self.c = codes, unpacked(row["path"], np.int64)[codes], unpacked(row["c"], np.int64)[codes]
        self.before = []
        for k in (1, 2):
            x = np.concatenate([np.zeros(k, np.int64), self.path[:-k]])[: len(codes)].astype(np.uint64)
            for j in range(k):  # the first words of a text
                x[start[n > j] + j] = 0
            self.before.append(x)
        self.start = start
        if trained:  # only what may be learned from
            learned = ~np.repeat(np.array(row["held_out"], bool), n)
            self.path, self.c, self.before = self.path[learned], self.c[learned], [x[learned] for x in self.before]
        self.length = (np.frexp(self.path.astype(np.float64))[1] - 1).astype(np.int8)

    def slices(self) -> Iterator[tuple[int, int]]:
        for lo in range(0, len(self.path), _RUN_SLICE):
            yield lo, min(lo + _RUN_SLICE, len(self.path))

    def falling(self, lo: int, hi: int) -> np.ndarray:
        """The words lo..hi by falling length of their paths, so that those that go on at a depth are the first."""
        return np.argsort(-self.length[lo:hi], kind="stable")

    def slots(self, lo: int, hi: int, slots: int, learning: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For every depth: the depth, the bits of the ``falling`` words that go on there, and the four contexts' slots.

        Learning, a word met once is new at its first decision, as it would be without itself.
        """
        order = self.falling(lo, hi)
        one, two = (x[lo:hi][order] for x in self.before)
        mixed = [None, (one + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)]
        mixed.append((mixed[1] ^ (mixed[1] >> np.uint64(29)) ^ two) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(2))
        mixed.append((two + np.uint64(3)) * np.uint64(0x165667B19E3779F9))
        path, length = self.path[lo:hi][order], self.length[lo:hi][order].astype(np.int64)
        shift = np.uint64(64 - slots.bit_length() + 1)
        for depth in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -depth))
            node = path[:n] >> (length[:n] - (depth + 1))
            bit = node & 1
            if depth == 0 and learning:
                bit = (self.c[lo:hi][order] == 1).astype(np.int64)
            node >>= 1
            spot = np.empty((4, n), np.uint64)
            salt = node.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            for t in range(4):
                h = spot[t]
                h[:] = salt if t == 0 else mixed[t][:n] ^ salt
                h *= np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(32)
                h *= np.uint64(0x94D049BB133111EB)
                h >>= shift
            yield depth, bit, spot.view(np.int64)

    def decisions(self, lo: int, hi: int, evidence: Evidence) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """(inputs, bits, weight sets) of the words lo..hi, depth by depth, and the numbers of words that go on at each."""
        size = int(self.length[lo:hi].sum(dtype=np.int64))
        x, bits, gate, sizes, done = np.empty((_RUN_INPUTS, size), np.float32), np.empty(size, np.uint8), np.empty(size, np.uint8), [], 0
        x[4] = 0.3
        for depth, bit, spot in self.slots(lo, hi, evidence.slots, evidence.learning):
            at = slice(done, done + len(bit))
            done, bits[at] = done + len(bit), bit
            sizes.append(len(bit))
            if evidence.learning:
                spot = 2 * spot + bit
            for t in range(4):
                np.take(evidence.odds[t], spot[t], out=x[t, at], mode="clip")
            kind = 0 if depth == 0 else 1 if depth <= _CLASS else 2
            gate[at] = np.take(evidence.sets[1], spot[1]) + np.take(evidence.sets[2], spot[2]) + np.uint8(kind)
        return x, bits, gate, sizes

    def scores(self, evidence: Evidence, weights: np.ndarray, adapted: np.ndarray) -> np.ndarray:
        """log10 probability of every word's path."""
        out = np.zeros(len(self.path))
        columns, flat = weights.T.astype(np.float32), adapted.ravel()
        for lo, hi in self.slices():
            x, bit, gate, sizes = self.decisions(lo, hi, evidence)
            gate = gate.astype(np.int64)
            odds = columns[0][gate] * x[0]
            for i in range(1, _RUN_INPUTS):
                odds += columns[i][gate] * x[i]
            np.clip(odds, -12, 12, out=odds)
            odds = (odds + flat[gate * _LEVELS + _level(odds)]) / 2
            nats = -np.log(1 + np.exp(np.where(bit == 1, -odds, odds)))
            sums, done = np.zeros(hi - lo), 0
            for n in sizes:
                sums[:n] += nats[done : done + n]
                done += n
            out[lo + self.falling(lo, hi)] = sums / np.log(10)
        return out


def run_events(row: dict, slots: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    words = Running(row, trained=True)
    for lo, hi in words.slices():
        for _, bit, spot in words.slots(lo, hi, slots, True):
            yield spot, bit, np.float32(1)


def run_slices(rows: Iterator[dict], tables: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, None]]:
    evidence = None
    for row in rows:
        evidence = evidence or Evidence(tables, True)
        words = Running(row, trained=True)
        for lo, hi in words.slices():
            yield *words.decisions(lo, hi, evidence)[:3], None


def first_run_weights() -> np.ndarray:
    """Weights to start from: the frequency leads where the word before has seen little."""
    w = np.zeros((5, 4, 3, _RUN_INPUTS))
    for one, trust in enumerate((0.0, 0.15, 0.25, 0.4, 0.6)):
        for two, more in enumerate((0.0, 0.15, 0.3, 0.5)):
            w[one, two, :, :3] = (1 - max(trust, more), trust * (1 - more), more)
    return w.reshape(_RUN_GATES, _RUN_INPUTS)


def score_documents(docs: DataFrame, cfg: MixLmConfig = MixLmConfig()) -> DataFrame:
    """Scores of every row of ``docs(doc_id, text)``, learned from the documents outside the held fold.

    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte): known tokens occur in training; base_score is the log10
    probability under add-one token frequencies, score under the model;
    bits_per_byte spreads the latter over the coded bytes. Null and blank texts are one end; a
    null id counts as the empty text for the fold; repeated rows are kept; other
    columns are ignored; an empty table gives no rows; without training documents
    nothing is known.
    """
    spark = docs.sparkSession
    encoded = encode(docs.select("doc_id", "text"), cfg)
    tokens = encoded.where("tok is not null").select("chunk", "tok", "num", "c")
    vocabulary = stored(tokens.groupBy("tok").agg(F.sum("c").alias("c")))
    total, types, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count(F.lit(1))).first()
    blocks = token_blocks(vocabulary, cfg)
    slots = max(1 << 16, min(cfg.slots, 1 << (2 * distinct).bit_length()))
    sent = spark.sparkContext.broadcast(count_contexts(blocks, _sizes(slots), lambda row: block_events(row, slots)))  # at most 13 MB, sent once
    weights, adapted = learn_weights(blocks, lambda rows: block_slices(rows, sent.value), first_weights(), cfg.rounds)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row["reach"], row["toks"], row["lens"], row["counts"])
                new = np.flatnonzero(b.c == 0)
                if len(new):
                    yield pa.RecordBatch.from_arrays([pa.array([b.tokens[i] for i in new], pa.binary()), pa.array(token_scores(b, Mixer(sent.value, weights, adapted))[new])], ["tok", "lp"])

    spelled = blocks.mapInArrow(spell, "tok binary, lp double").select("tok", F.lit(0).cast("long").alias("c"), F.lit(_NEW).cast("long").alias("path"), "lp")
    entries = stored(word_paths(vocabulary, total, distinct).withColumn("lp", F.lit(0.0)).union(spelled))
    known = tokens.select("chunk", "tok", "num").join(entries, "tok").select("chunk", "num", "c", "path", "lp")
    kind, ids = docs.select("doc_id").dtypes[0][1], to_arrow_type(docs.schema["doc_id"].dataType)

    def gather(texts: pa.Table, known: pa.Table) -> pa.Table:
        num = known.column("num").to_numpy()
        made = {}
        for name, dtype in (("c", np.int64), ("path", np.int64), ("lp", np.float64)):
            made[name] = np.zeros(len(num), dtype)
            made[name][num] = known.column(name).to_numpy()
        codes = [unpacked(x, np.int32) for x in texts.column("codes").to_pylist()]
        one = lambda column: pa.array([column.to_pylist()], pa.list_(column.type))
        return pa.table({
            "doc_id": one(texts.column("doc_id")), "held_out": one(texts.column("held_out")), "width": one(texts.column("width")),
            "n": pa.array([np.array([len(x) for x in codes], np.int64).tobytes()]), "codes": pa.array([packed(np.concatenate(codes))]),
            **{name: pa.array([packed(values)]) for name, values in made.items()},
        })

    texts = encoded.where("tok is null").select(F.col("chunk").alias("part"), "doc_id", "held_out", "codes", F.col("c").alias("width"))
    schema = f"doc_id array<{kind}>, held_out array<boolean>, width array<long>, n binary, codes binary, c binary, path binary, lp binary"
    chunks = stored(texts.groupBy("part").cogroup(known.groupBy("chunk")).applyInArrow(gather, schema))
    run_slots = max(1 << 16, min(cfg.run_slots, 1 << (4 * total).bit_length()))
    run_sent = spark.sparkContext.broadcast(count_contexts(chunks, [run_slots] * 4, lambda row: run_events(row, run_slots)))  # at most 67 MB, sent once
    run_weights, run_adapted = learn_weights(chunks, lambda rows: run_slices(rows, run_sent.value), first_run_weights(), 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = None
        for row in rows_of(batches):
            evidence = evidence or Evidence(run_sent.value, False)
            words = Running(row)
            base = np.log10((words.c + 1) / (total + types + 1))
            lp = words.scores(evidence, run_weights, run_adapted) + unpacked(row["lp"], np.float64)[words.codes]
            n, at = np.frombuffer(row["n"], np.int64), words.start
            sums = np.add.reduceat(lp, at)
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_id"], ids), pa.array(row["held_out"], pa.bool_()), pa.array(n),
                pa.array(np.add.reduceat((words.c > 0).astype(np.int64), at)), pa.array(np.full(len(n), total, np.int64)),
                pa.array(np.add.reduceat(base, at)), pa.array(sums), pa.array(-sums * np.log2(10) / np.array(row["width"])),
            ], names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    return chunks.mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")

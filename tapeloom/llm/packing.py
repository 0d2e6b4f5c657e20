"""Token ids packed into fixed-length rows by best-fit decreasing.

Documents are dealt to shards by a hash and tokenised and packed in one pass over
each shard, so the layout depends on the rows alone, not on how Spark happened to
cut the input. A shard is packed in windows of about ``window_tokens`` ids, which
bounds a task's memory whatever a shard or a document holds.

Every document becomes its ids plus one end id, and is cut into pieces of at most
``length`` ids, so joining a document's pieces in order gives it back losslessly.
Pieces are placed longest first into the open row with the least room that still
suffices; a segment tree over the room left finds that row in log(length) steps.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import by_chunks, remembers

#: The published pre-tokenising pattern of the vocabulary below.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Spacing other than single inner blanks and newlines; such texts are encoded whole.
_ODD = re.compile(r"[^\S \n]|  | \n|\n |\n\n|\A[ \n]|[ \n]\Z")
_CACHE = 120_000  # words a worker remembers before it starts over


@dataclass(frozen=True)
class PackConfig:
    """length: ids per packed row. tokenizer: path of a tiktoken rank file, read on the driver.

    end_id: id that ends every document and fills the rest of a row.
    window_tokens: ids packed together. shard_rows: documents per shard, on average.
    """

    length: int = 2048
    tokenizer: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    pattern: str = PATTERN
    end_id: int = 50256
    window_tokens: int = 1 << 20
    shard_rows: int = 2048


class WordTokenizer:
    """Byte-pair ids of whole texts, with a bounded memory of words.

    The pattern never joins letters across a single blank or newline, so a text
    with plain spacing may be encoded word by word (each with its leading blank)
    with the same ids as in one call.
    """

    def __init__(self, ranks: bytes, pattern: str, end_id: int):
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.core = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.plain_words = pattern == PATTERN
        self.code = "H" if max(end_id, *table.values()) < 1 << 16 else "I"
        self.newline = self._ids("\n")
        self.first: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array(self.code, self.core.encode_ordinary(text)).tobytes()

    def _known(self, memory: dict[str, bytes], word: str, lead: str) -> bytes:
        ids = memory.get(word)
        if ids is None:
            if len(memory) >= _CACHE:
                memory.clear()
            ids = memory[word] = self._ids(lead + word)
        return ids

    def encode(self, text: str) -> bytes:
        if not self.plain_words or _ODD.search(text):
            return self._ids(text)
        out: list[bytes] = []
        get = self.inner.get
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(self.newline)
            out.append(self._known(self.first, words[0], "") if words[0] else b"")
            ids = [get(w) for w in words[1:]]
            if None in ids:
                ids = [self._known(self.inner, w, " ") if i is None else i for w, i in zip(words[1:], ids)]
            out += ids
        return b"".join(out[1:])


class RoomTree:
    """Segment tree over the room left in open rows: each node counts the rows below it."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def _change(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, row) of the tightest row with at least ``need`` room."""
        i = need + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Rows as lists of piece numbers; every piece is in exactly one row."""
    rows: list[list[int]] = []
    tree = RoomTree(size)
    for piece in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[piece])
        spot = tree.take(need)
        if spot is None:
            rows.append([])
            spot = size, len(rows) - 1
        rows[spot[1]].append(piece)
        if spot[0] > need:
            tree.add(spot[0] - need, spot[1])
    return rows


_tokenizers: dict[tuple[int, str, int], WordTokenizer] = {}


def pack_documents(docs: DataFrame, cfg: PackConfig = PackConfig()) -> DataFrame:
    """Packed rows of ``docs(doc_id, text)``.

    shard long, row_no int, ids binary (``length`` little-endian ids, 2 bytes each
    if the vocabulary allows, else 4; filled up with ``end_id``), n_tokens int,
    cu_seqlens array<int> (0 and the end of every segment), resets array<int>
    (columns where position ids start again at 0: segment starts, and the filling),
    doc_ids array, piece_nos array<int> (place of the segment in its document).

    A null text counts as empty and becomes one end id; null ids and repeated rows
    are packed like any other; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    with open(cfg.tokenizer, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # the vocabulary file, about 1 MB
    kind = docs.select("doc_id").dtypes[0][1]
    shards = max(1, -(-docs.count() // cfg.shard_rows))
    placed = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).alias("shard"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembers("packing", _tokenizers.clear)
        key = hash(ranks.value), cfg.pattern, cfg.end_id
        if key not in _tokenizers:
            _tokenizers[key] = WordTokenizer(ranks.value, cfg.pattern, cfg.end_id)
        tok = _tokenizers[key]
        end = array(tok.code, [cfg.end_id]).tobytes()
        width = len(end)
        step = cfg.length * width
        shard, id_type, n_rows, held, held_bytes = None, None, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal n_rows, held, held_bytes
            rows = best_fit_decreasing(np.array([len(x[2]) // width for x in held]), cfg.length)
            ids, n_tokens, cu, resets = [], [], [], []
            for row in rows:
                ends = np.cumsum([0] + [len(held[p][2]) // width for p in row]).tolist()
                ids.append(b"".join([held[p][2] for p in row]) + end * (cfg.length - ends[-1]))
                n_tokens.append(ends[-1])
                cu.append(ends)
                resets.append(ends if ends[-1] < cfg.length else ends[:-1])
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * len(rows), pa.int64()), pa.array(range(n_rows, n_rows + len(rows)), pa.int32()), pa.array(ids, pa.binary()),
                    pa.array(n_tokens, pa.int32()), pa.array(cu, pa.list_(pa.int32())), pa.array(resets, pa.list_(pa.int32())),
                    pa.array([[held[p][0] for p in row] for row in rows], pa.list_(id_type)), pa.array([[held[p][1] for p in row] for row in rows], pa.list_(pa.int32())),
                ],
                ["shard", "row_no", "ids", "n_tokens", "cu_seqlens", "resets", "doc_ids", "piece_nos"],
            )
            n_rows += len(rows)
            held, held_bytes = [], 0
            return out

        for part in by_chunks(batches, "text", 1 << 20):
            id_type = part.column("doc_id").type
            for at, doc, text in zip(*(part.column(c).to_pylist() for c in ("shard", "doc_id", "text"))):
                if at != shard:
                    if held:
                        yield flush()
                    shard, n_rows = at, 0
                data = tok.encode(text) + end
                held += [(doc, k, data[i : i + step]) for k, i in enumerate(range(0, len(data), step))]
                held_bytes += len(data)
                if held_bytes >= cfg.window_tokens * width:
                    yield flush()
        if held:
            yield flush()

    schema = f"shard long, row_no int, ids binary, n_tokens int, cu_seqlens array<int>, resets array<int>, doc_ids array<{kind}>, piece_nos array<int>"
    return placed.repartition("shard").sortWithinPartitions("shard", "doc_id", "text").mapInArrow(run, schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows to a new folder, one Parquet row per packed row."""
    packed.write.parquet(path)


def position_ids(resets: list[int], length: int) -> np.ndarray:
    """Position of every column of a row: counts from the last reset."""
    starts = np.zeros(length, np.int64)
    starts[resets] = resets
    return np.arange(length) - np.maximum.accumulate(starts)

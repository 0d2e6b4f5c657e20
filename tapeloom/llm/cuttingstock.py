"""Token ids packed into sequences by cutting-stock column generation.

A document's ids (with an end id) give whole sequences of ``length`` ids and one
remainder. The histogram of the remainders, at most ``length - 1`` counts, is the
demand of a cutting-stock problem: a column is a *pattern*, the remainders that
share one sequence. The linear program over the patterns is solved by the simplex
method; a knapsack over the dual prices finds, for every remainder length at once,
the best pattern that holds it, and the columns with negative reduced cost enter.
The program minimises padding, with ``sequence_cost`` for opening a sequence and
``cut_cost`` for cutting a document in two: besides the patterns, a remainder may
go to the *stream*, where documents follow one another and are cut wherever a
sequence ends.

The solution is rounded down, then up where remainders are left; what no pattern
takes goes to the stream. Documents are ranked by (remainder length, a hash), so a
rank says the pattern and the place in it. Nothing but the histogram and the
patterns is on the driver; neither grows with the documents.

The texts are tokenised once, the ids are written, ranked by their lengths alone
and shuffled once to meet their places.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeloom.functions.ordered import ordered_prefix
from tapeloom.llm.common import by_chunks, remembers, stored

#: Lower-case Latin letters, then ASCII marks: the normaliser leaves such a word as it is.
_PLAIN = re.compile(r"([a-z\xe0-\xf6\xf8-\xff]+)([!-/:-@\[-`{-~]*)")
_GAP = re.compile(rb"[ \t\n\r\f\v]")
_PART = 1 << 20  # bytes of a long text encoded at a time
_CACHE = 400_000  # words a worker remembers before it starts over


@dataclass(frozen=True)
class StockConfig:
    """length: ids per sequence. end_id: id that ends every document.

    sequence_cost, cut_cost: ids of padding that one more sequence, one more cut is worth.
    max_pivots: steps of the simplex method; the solution may be used after any of them,
    more steps mean fewer cuts.
    """

    length: int = 2048
    end_id: int = 1
    sequence_cost: float = 16.0
    cut_cost: float = 4.0
    max_pivots: int = 200


# ---------------------------------------------------------------- the linear program


def _cost(total: np.ndarray | int, cfg: StockConfig):
    """Padded length of a sequence that holds ``total`` ids: powers of two need no padding."""
    t = np.asarray(total, np.int64)
    return np.where((t & (t - 1)) == 0, t, cfg.length) + cfg.sequence_cost


def _knapsack(lengths: np.ndarray, price: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(best value, last item) of every exact total 0..size; items may repeat."""
    value = np.full(size + 1, -np.inf)
    value[0] = 0.0
    item = np.full(size + 1, -1)
    for c in range(int(lengths[0]), size + 1):
        k = np.searchsorted(lengths, c, side="right")
        v = value[c - lengths[:k]] + price[:k]
        j = int(v.argmax())
        value[c], item[c] = v[j], j
    return value, item


def _patterns(lengths: np.ndarray, price: np.ndarray, cfg: StockConfig) -> tuple[np.ndarray, list[np.ndarray]]:
    """For every length the pattern of least reduced cost that holds it: (reduced costs, items)."""
    value, item = _knapsack(lengths, price, cfg.length)
    ends = np.append(2 ** np.arange(int(np.log2(cfg.length)) + 1), cfg.length)
    upto = np.maximum.accumulate(value)  # padded: the best total that fits
    place = np.maximum.accumulate(np.where(value == upto, np.arange(cfg.length + 1), 0))
    best = cfg.length + cfg.sequence_cost - upto[cfg.length - lengths] - price
    rest = place[cfg.length - lengths]
    for end in ends.tolist():
        ok = lengths <= end
        reduced = np.full(len(lengths), np.inf)
        reduced[ok] = end + cfg.sequence_cost - value[end - lengths[ok]] - price[ok]
        better = reduced < best
        best, rest = np.where(better, reduced, best), np.where(better, end - lengths, rest)
    out = []
    for j, c in enumerate(rest.tolist()):
        items = [j]
        while c > 0:
            items.append(int(item[c]))
            c -= int(lengths[item[c]])
        out.append(np.array(items))
    return best, out


def _pair(left: np.ndarray, total: int) -> tuple[int, int, float]:
    """Two different lengths with the given total of which most are left: (a, b, how many of the scarcer)."""
    a = np.arange(1, (total + 1) // 2)
    if not len(a):
        return 0, 0, 0.0
    both = np.minimum(left[a], left[total - a])
    k = int(both.argmax())
    return int(a[k]), int(total - a[k]), float(both[k])


def _partners(left: np.ndarray, longest: int, cfg: StockConfig, deep: bool) -> list[int] | None:
    """Remainders that fill a sequence together with ``longest``: one, two, three, or (deep) what the knapsack finds."""
    room = cfg.length - longest
    if left[room] > 0 and room != longest:
        return [room]
    a, b, n = _pair(left, room)
    if n > 0:
        return [a, b]
    have = np.flatnonzero(left > 0)
    for first in have[have < room][::-1].tolist():
        a, b, n = _pair(left, room - first)
        if n > 0 and first not in (a, b):
            return [first, a, b]
    if not deep:
        return None
    value, item = _knapsack(have, have.astype(float), room)
    if not np.isfinite(value[room]):
        return None
    out, c = [], room
    while c > 0:
        out.append(int(have[item[c]]))
        c -= out[-1]
    return out


def _start(lengths: np.ndarray, counts: np.ndarray, cfg: StockConfig, deep: bool = True) -> tuple[list[np.ndarray | None], np.ndarray]:
    """A first basis: from the longest remainder down, full sequences until a length is used up.

    Each pattern uses up one length and holds only lengths that were still left, so
    the columns are triangular. A length that no pattern uses up goes to the stream.
    """
    left = np.zeros(cfg.length + 1)
    left[lengths] = counts
    where = np.full(cfg.length + 1, -1)
    where[lengths] = np.arange(len(lengths))
    basis: list[np.ndarray | None] = [None] * len(lengths)
    amount = counts.astype(float)
    for longest in lengths[::-1].tolist():
        while left[longest] > 0:
            others = _partners(left, longest, cfg, deep)
            if others is None:
                break
            items, times = np.unique([longest, *others], return_counts=True)
            ratio = left[items] / times
            k = int(ratio.argmin())
            left[items] -= ratio[k] * times
            left[items[k]] = 0.0
            basis[where[items[k]]], amount[where[items[k]]] = where[np.repeat(items, times)], ratio[k]
        if basis[where[longest]] is None:
            amount[where[longest]], left[longest] = left[longest], 0.0
    return basis, amount


def solve(lengths: np.ndarray, counts: np.ndarray, cfg: StockConfig) -> list[tuple[np.ndarray, float]]:
    """Patterns (positions in ``lengths``, repeated as often as they occur) and their amounts.

    Column generation from the basis of ``_start``; it ends when no pattern improves
    or after ``max_pivots`` steps of the simplex method.
    """
    m = len(lengths)
    if not m:
        return []
    stream = lengths * (1 + (cfg.sequence_cost + cfg.cut_cost) / cfg.length)
    basis, amount = _start(lengths, counts, cfg)
    columns, cost = np.zeros((m, m)), stream.copy()
    for j, items in enumerate(basis):
        if items is None:
            columns[j, j] = 1.0
        else:
            np.add.at(columns[:, j], items, 1.0)
            cost[j] = _cost(int(lengths[items].sum()), cfg)
    inverse = np.linalg.inv(columns)
    price = cost @ inverse
    left = cfg.max_pivots
    while left > 0:
        pool = [np.array([j]) for j in np.flatnonzero(stream - price < -1e-6)]
        gains = (stream - price)[stream - price < -1e-6].tolist()
        reduced, found = _patterns(lengths, price, cfg)
        good = np.flatnonzero(reduced < -1e-6)
        unique = {tuple(sorted(found[j].tolist())): j for j in good}
        pool += [found[j] for j in unique.values()]
        costs = np.array([stream[p[0]] for p in pool[: len(gains)]] + [float(_cost(int(lengths[p].sum()), cfg)) for p in pool[len(gains) :]])
        if not pool:
            break
        at = np.full((len(pool), max(map(len, pool))), m)
        for k, items in enumerate(pool):
            at[k, : len(items)] = items
        pivots = 0
        while left > 0:
            gain = costs - np.append(price, 0.0)[at].sum(axis=1)
            k = int(gain.argmin())
            if gain[k] > -1e-6:
                break
            items, times = np.unique(pool[k], return_counts=True)
            step = inverse[:, items] @ times
            up = np.flatnonzero(step > 1e-7)
            if not len(up):
                break
            ratio = amount[up] / step[up]
            low = ratio.min()
            tied = up[ratio <= low + 1e-9]
            row = int(tied[step[tied].argmax()])
            pivot = inverse[row] / step[row]
            rows = np.flatnonzero(np.abs(step) > 1e-12)
            inverse[rows] -= step[rows, None] * pivot
            inverse[row] = pivot
            amount = np.maximum(amount - low * step, 0.0)
            amount[row] = low
            price = price + gain[k] * pivot
            basis[row] = pool[k] if k >= len(gains) else None
            left, pivots = left - 1, pivots + 1
        if not pivots:
            break
    return [(p, float(x)) for p, x in zip(basis, amount) if p is not None and x > 1e-9]


def whole_numbers(patterns: list[tuple[np.ndarray, float]], lengths: np.ndarray, counts: np.ndarray, cfg: StockConfig) -> list[tuple[np.ndarray, int]]:
    """The solution rounded down; then one more of each pattern, by falling fraction, as long as the
    remainders suffice; then full sequences of up to four of the remainders that are left."""
    left = counts.astype(np.int64).copy()
    out = [[items, int(x + 1e-6)] for items, x in patterns]
    for items, n in out:
        np.subtract.at(left, items, n)

    def more(pattern: list, most: float) -> None:
        items, times = np.unique(pattern[0], return_counts=True)
        n = min(int((left[items] // times).min()), int(most))
        pattern[1] += n
        left[items] -= n * times

    for k in np.argsort([n - x for (_, n), (_, x) in zip(out, patterns)], kind="stable").tolist():
        more(out[k], 1)
    rest = np.flatnonzero(left)
    basis, amount = _start(lengths[rest], left[rest], cfg, deep=False)
    for items, x in zip(basis, amount.tolist()):
        if items is not None:
            out.append([rest[items], 0])
            more(out[-1], x + 1e-6)
    return [(items, n) for items, n in out if n]


@dataclass(frozen=True)
class Layout:
    """Where the remainder of each rank goes. A row is a run of ranks, from ``start`` on.

    copies > 0: the runs' sequences take ``copies`` remainders each, the first at
    ``offset`` of sequence ``first``. copies = 0: the run lies in the stream from
    ``first`` on. ``ends``: where the stream's sequences end, after its whole ones.
    """

    start: np.ndarray
    length: np.ndarray
    copies: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    stream_sequence: int
    ends: np.ndarray


def plan(lengths: np.ndarray, counts: np.ndarray, first_sequence: int, cfg: StockConfig) -> Layout:
    """Layout of the remainders, numbered by ascending length; sequences from ``first_sequence`` on."""
    chosen = whole_numbers(solve(lengths, counts, cfg), lengths, counts, cfg)
    begin = np.cumsum(counts) - counts
    used = np.zeros(len(lengths), np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    at = first_sequence
    for items, n in chosen:
        offset = 0
        for j, k in zip(*(x.tolist() for x in np.unique(items, return_counts=True))):
            rows.append((int(begin[j] + used[j]), int(lengths[j]), k, at, offset))
            used[j] += n * k
            offset += k * int(lengths[j])
        at += n
    place = 0
    for j in range(len(lengths)):
        rest = int(counts[j] - used[j])
        if rest:
            rows.append((int(begin[j] + used[j]), int(lengths[j]), 0, place, 0))
            place += rest * int(lengths[j])
    tail, ends = place % cfg.length, [place - place % cfg.length]
    for bit in reversed(range(tail.bit_length())):
        if tail >> bit & 1:
            ends.append(ends[-1] + (1 << bit))
    rows.sort()
    return Layout(*(np.array(c, np.int64) for c in zip(*rows, strict=True)), at, np.array(ends)) if rows else Layout(*[np.zeros(0, np.int64)] * 5, at, np.array([0]))


def cut_stream(place: int, length: int, layout: Layout, size: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of a remainder that lies at ``place`` of the stream."""
    out, done = [], 0
    whole = int(layout.ends[0])
    while done < length:
        p = place + done
        if p < whole:
            sequence, offset, room = p // size, p % size, size - p % size
        else:
            k = int(np.searchsorted(layout.ends, p, side="right"))
            sequence, offset, room = whole // size + k - 1, p - int(layout.ends[k - 1]), int(layout.ends[k]) - p
        n = min(room, length - done)
        out.append((done, n, layout.stream_sequence + sequence, offset))
        done += n
    return out


# ---------------------------------------------------------------- token ids


class WordIds:
    """Ids of whole texts, word by word, with a bounded memory of words.

    The vocabulary's pre-tokenising pattern drops white space and its normaliser maps
    no character across it, so the words between ASCII white space may be encoded one
    by one with the ids of one call for the text. Special tokens are spelled with
    ``<|`` and are looked for before lower-casing, so such texts keep their case.
    """

    def __init__(self, vocabulary: str, end_id: int):
        self.core = Tokenizer.from_str(vocabulary)
        self.code = "H" if max(end_id, self.core.get_vocab_size() - 1) < 1 << 16 else "I"
        letters = [chr(c) for c in (*range(0xE0, 0xF7), *range(0xF8, 0x100))]
        self.as_bytes = str.maketrans({c: self.core.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters})
        self.memory: dict[bytes, bytes] = {}
        self.marks: dict[str, list[int]] = {"": []}

    def _encode(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word)
        if plain is None:
            return array(self.code, self.core.encode(word, add_special_tokens=False).ids).tobytes()
        letters, marks = plain.groups()
        ids = [t.id for t in self.core.model.tokenize(letters if letters.isascii() else letters.translate(self.as_bytes))]
        if marks not in self.marks:
            self.marks[marks] = self.core.encode(marks, add_special_tokens=False).ids
        return array(self.code, ids + self.marks[marks]).tobytes()

    def encode(self, text: bytes) -> bytes:
        """Ids of a UTF-8 text; a long one in parts that end before white space, so its words are never held at once."""
        parts, at = [], 0
        while len(text) - at > _PART and (gap := _GAP.search(text, at + _PART)):
            parts.append(self._words(text[at : gap.start()]))
            at = gap.start()
        return b"".join([*parts, self._words(text[at:])])

    def _words(self, text: bytes) -> bytes:
        words = (text if b"<|" in text else text.lower()).split()
        get = self.memory.get
        ids = [get(w) for w in words]
        if None in ids:
            if len(self.memory) > _CACHE:
                self.memory.clear()
            for i, known in enumerate(ids):
                if known is None:
                    w = words[i]
                    ids[i] = self.memory.get(w) or self.memory.setdefault(w, self._encode(w.decode("utf-8", "replace")))
        return b"".join(ids)


_coders: dict[tuple[int, int], WordIds] = {}


def tokenized(docs: DataFrame, vocabulary: str, cfg: StockConfig = StockConfig()) -> DataFrame:
    """(row, doc_id, tie, n_ids, ids binary) of every row, written once; ids little-endian, 2 bytes each if the vocabulary allows."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(vocabulary)  # the vocabulary file, under 2 MB
    end_id = cfg.end_id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembers("word ids", _coders.clear)
        key = hash(held.value), end_id
        if key not in _coders:
            _coders[key] = WordIds(held.value, end_id)
        coder = _coders[key]
        end = array(coder.code, [end_id]).tobytes()
        for part in by_chunks(batches, "text", 1 << 20):
            ids = [coder.encode(b or b"") + end for b in part.column("text").cast(pa.binary()).to_pylist()]
            n = [len(x) // len(end) for x in ids]
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), part.column("tie"), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["row", "doc_id", "tie", "n_ids", "ids"])

    kind = docs.select("doc_id").dtypes[0][1]
    named = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("doc_id", "text").alias("tie"), "text")
    return stored(named.mapInArrow(run, f"row long, doc_id {kind}, tie long, n_ids long, ids binary"))


def pack_stock(docs: DataFrame, vocabulary_path: str, cfg: StockConfig = StockConfig()) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ids binary: the piece's ids, little-endian, 4 bytes each. A sequence's pieces lie
    one after the other from offset 0; every id of a document, its end id included,
    is in one piece. Sequences hold at most ``length`` ids.

    A null or blank text is its end id alone; null ids and repeated rows are packed
    like any other row (identical rows may change places); other columns are ignored;
    an empty table gives no pieces. A text of any length is one task's work, encoded in
    parts of a megabyte.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    size = cfg.length
    texts = tokenized(docs, vocabulary, cfg)
    sizes = texts.select("row", "tie", (F.col("n_ids") % size).alias("rest"), F.floor(F.col("n_ids") / size).alias("whole"))
    told = sizes.groupBy("rest").agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("whole")).orderBy("rest").collect()  # at most one row per length
    none = sum(r.n for r in told if r.rest == 0)
    demand = [(r.rest, r.n) for r in told if r.rest]
    lengths, counts = (np.array(x, np.int64) for x in zip(*demand)) if demand else (np.zeros(0, np.int64),) * 2
    layout = spark.sparkContext.broadcast(plan(lengths, counts, sum(r.whole for r in told), cfg))  # a few runs per length

    ranked = ordered_prefix(sizes, ["rest", "tie", "row"], sums={"upto": "whole"}, index="rank")
    places = ranked.select("row", (F.col("rank") - 1 - none).alias("rank"), (F.col("upto") - F.col("whole")).alias("before"))
    code = "u2" if Tokenizer.from_str(vocabulary).get_vocab_size() <= 1 << 16 and cfg.end_id < 1 << 16 else "u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = layout.value
        for part in by_chunks(batches, "ids", 1 << 20):
            rank = part.column("rank").to_numpy()
            at = np.searchsorted(how.start, rank, side="right") - 1
            rows: list[int] = []
            out: list[tuple[int, int, int, int]] = []
            data: list[bytes] = []
            for i, (k, before, n, ids) in enumerate(zip(rank.tolist(), *(part.column(c).to_pylist() for c in ("before", "n_ids", "ids")))):
                pieces = [(j * size, size, before + j, 0) for j in range(n // size)]
                rest, done = n % size, n - n % size
                if rest:
                    run_no = at[i]
                    nth, copies = k - int(how.start[run_no]), int(how.copies[run_no])
                    if copies:
                        pieces.append((done, rest, int(how.first[run_no]) + nth // copies, int(how.offset[run_no]) + nth % copies * rest))
                    else:
                        pieces += [(done + s, m, q, o) for s, m, q, o in cut_stream(int(how.first[run_no]) + nth * rest, rest, how, size)]
                wide = np.frombuffer(ids, code).astype("<u4").tobytes()
                rows += [i] * len(pieces)
                out += pieces
                data += [wide[4 * s : 4 * (s + m)] for s, m, _, _ in pieces]
            start, length, sequence, offset = (pa.array(x, pa.int64()) for x in zip(*out))
            of = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(of), start, length, pa.array(data, pa.binary()), part.column("n_ids").take(of), sequence, offset], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = docs.select("doc_id").dtypes[0][1]
    return (
        texts.join(places, "row")
        .select("doc_id", "n_ids", "ids", "rank", "before")
        .mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, ids (gapless), ends array<long> (where its segments end), doc_ids.

    A group holds one sequence, so at most ``length`` ids.
    """
    inside = F.array_sort(F.collect_list(F.struct("offset", "length", "ids", "doc_id")))
    return pieces.groupBy("sequence_id").agg(inside.alias("s")).select(
        "sequence_id",
        F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("s", lambda x: x["offset"] + x["length"]).alias("ends"),
        F.col("s.doc_id").alias("doc_ids"),
    )

"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders; what is left is its
template. Windows of template words are hashed and joined between documents and
benchmark items, so a question whose values were exchanged still matches. The
values then have to tell one story: within an occurrence, each value of the item must
stand for one value, and no two values of the item for the same one; windows that
break this don't count. Windows that follow each other in the item and the document
alike are an occurrence; so is the whole document, for items that are taken apart. An
item is found in a document if the consistent windows of one cover enough of its windows.

Documents meet the join with few rows: a bit table of the item windows' hashes (a
fixed size, made by Spark) is sent to the tasks, and only windows whose bit is set
leave them. False bits only cost a join row.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tapeloom.llm.common import by_chunks, remembers, stored

LITERAL, NUMBER, CAPITAL, UNIT, NOTHING, GLUED = range(6)
_EDGE = "\"'`.,;:!?()[]{}<>|*_~#=+/\\-–—“”‘’«»¿¡…"
_STOPS = frozenset(".!?:")
_NUMBER = re.compile(r"[-+]?[$€£¥]?\d[\d.,:/]*%?(?:st|nd|rd|th)?\Z")
#: Fixed words that are units when they follow a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometers kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes ml cl l liter liters litre litres gallon gallons cup cups "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "mph kph km/h m/s hz khz mhz ghz w kw mw v kv a j kj kcal cal n pa kpa bar k °c °f c f kb mb gb tb byte bytes bit bits "
    "% percent degree degrees dollar dollars cent cents euro euros usd eur gbp yen".split()
)
#: Fixed words for numbers, and the digits they stand for.
NUMBER_WORDS = dict(
    zip(
        "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
        "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split(),
        "0 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 30 40 50 60 70 80 90 100 1000 1000000 1000000000 dozen".split(),
    )
)
_GLUED = re.compile(r"([-+]?\d[\d.,]*)([a-z°/]+)")
_ENDS, _TAIL, _HEAD = 1, 2, 4  # flags of a spelling: ends a sentence, has a mark behind, before
_BITS = 26  # of the bit table: 8 MB
_CACHE = 250_000  # spellings a worker remembers before it starts over


@dataclass(frozen=True)
class TemplateConfig:
    """window: template words per window; literals: words a window must hold besides placeholders.

    share: part of an item's windows that must be found, consistently, in a document.
    Items shorter than a window form one window of their own length; items whose
    windows all hold too few literals form one of all their words and exact values.
    """

    window: int = 5
    literals: int = 3
    share: float = 0.8


class _Words(dict):
    """What is known of each spelling: its number in the lists and arrays below.

    Spellings are added to the lists as they are met; ``arrays`` brings the arrays up to date.
    """

    def __init__(self):
        super().__init__()
        self.value: list[str] = []
        self._new: list[tuple[int, int, bool]] = []
        self._kind, self._hash, self._flags = np.zeros(0, np.int8), np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        self._size = 0
        self.parts: dict[int, tuple[int, int]] = {}  # of a number and a unit written as one

    def __missing__(self, word: str) -> int:
        core, last = (word, "") if word.isalpha() else (word[:-1], word[-1:])
        if core.isalpha() and last in _EDGE:  # letters, with one mark at most
            low = word if core.islower() and not last else core.lower()  # one string where they are equal
            kind = UNIT if low in UNITS else NUMBER if low in NUMBER_WORDS else CAPITAL if core[0].isupper() else LITERAL
            flags = (_ENDS if last in _STOPS else 0) | (_TAIL if last else 0)
        else:
            core = word.strip(_EDGE)
            if word[-1:] == "%" and core:
                core += "%"
            low = core.lower()
            glued = None
            if not core:
                kind = UNIT if word == "%" else NOTHING
            elif _NUMBER.match(core) or all(x in NUMBER_WORDS for x in low.split("-")):
                kind = NUMBER
            elif low in UNITS:
                kind = UNIT
            elif (glued := _GLUED.fullmatch(low)) and glued[2] in UNITS:
                kind = GLUED
            else:
                kind = CAPITAL if core[0].isupper() else LITERAL
            flags = (_ENDS if word.rstrip("\"')]”’»")[-1:] in _STOPS else 0) | (_TAIL if not word.endswith(core) else 0) | (_HEAD if not word.startswith(core) else 0)
            if kind == GLUED:
                parts = self[glued[1]], self[glued[2] + ("." if flags & _ENDS else "")]
        self._new.append((kind, xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"), 1) | 1, flags))
        self.value.append(NUMBER_WORDS.get(low, low))
        n = self[word] = len(self.value) - 1
        if kind == GLUED:
            self.parts[n] = parts
        return n

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(kind, hash, flags) by number."""
        if self._new:
            end = self._size + len(self._new)
            if end > len(self._kind):
                room = max(2 * len(self._kind), end)
                self._kind, self._hash, self._flags = (np.concatenate([x, np.zeros(room - len(x), x.dtype)]) for x in (self._kind, self._hash, self._flags))
            kind, hashes, flags = zip(*self._new)
            self._kind[self._size : end], self._hash[self._size : end], self._flags[self._size : end] = kind, np.array(hashes, np.uint64), flags
            self._size, self._new = end, []
        return self._kind, self._hash, self._flags


_PLACE = {NUMBER: 3, CAPITAL: 5, UNIT: 7}  # hashes of the placeholders: small odd numbers, which xxh64 of a word is not
_known: list[_Words] = []


def template(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Template words of all texts in a row: (text number, hash, slot type or 0, spelling number, values).

    A capitalised word is a name unless it opens a sentence (``windows`` reads those
    both ways), and names that follow each other without a mark between are one; a unit
    counts only after a number, from which it may be written apart or not; number words
    are numbers. Words without letters or digits vanish.
    """
    if not _known or len(_known[0]) > _CACHE:
        _known[:] = [_Words()]
    words = _known[0]
    get = words.__getitem__
    ids = [np.fromiter(map(get, split), np.int64, len(split)) for split in (t.split() for t in texts)]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in ids])
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    of_kind, of_hash, of_flags = words.arrays()
    glued = np.flatnonzero(of_kind[ids] == GLUED)
    if len(glued):
        both = [words.parts[n] for n in ids[glued].tolist()]
        times = np.ones(len(ids), np.int64)
        times[glued] = 2
        at = np.cumsum(times) - times
        ids, owner = np.repeat(ids, times), np.repeat(owner, times)
        ids[at[glued]], ids[at[glued] + 1] = np.array(both).T
    kind = of_kind[ids]
    real = kind != NOTHING
    owner, ids, kind = owner[real], ids[real], kind[real]
    flags = of_flags[ids]
    first = np.ones(len(ids), bool)
    first[1:] = owner[1:] != owner[:-1]
    after = np.zeros(len(ids), bool)
    after[1:] = (flags[:-1] & _ENDS) > 0
    number_before = np.zeros(len(ids), bool)
    number_before[1:] = (kind[:-1] == NUMBER) & ~first[1:]
    slot = np.where(kind == NUMBER, NUMBER, np.where((kind == CAPITAL) & ~first & ~after, CAPITAL, np.where((kind == UNIT) & number_before, UNIT, 0)))
    goes_on = np.zeros(len(ids), bool)  # a name that goes on with the word before
    goes_on[1:] = (slot[1:] == CAPITAL) & (slot[:-1] == CAPITAL) & ((flags[1:] & _HEAD) == 0) & ((flags[:-1] & _TAIL) == 0)
    if goes_on.any():
        value = words.value
        for start in np.flatnonzero(goes_on[1:] & ~goes_on[:-1]).tolist():
            end = start + 1
            while end < len(ids) and goes_on[end]:
                end += 1
            ids[start] = get(" ".join([value[n] for n in ids[start:end].tolist()]))
        of_hash = words.arrays()[1]
        owner, ids, slot = owner[~goes_on], ids[~goes_on], slot[~goes_on]
    hashes = of_hash[ids]
    for s, h in _PLACE.items():
        hashes[slot == s] = h
    return owner, hashes, slot, ids, words.value


def _slots(at: int, w: int, parts: tuple, names: tuple = ()) -> list[str]:
    _, _, slot, ids, value = parts
    return [f"{slot[i] or CAPITAL}:{value[ids[i]]}" for i in range(at, at + w) if slot[i] or i - at in names]


_STEP = 0x9E3779B97F4A7C15
_WHOLE = 9  # added to the hash of whole exact items


def windows(texts: list[str], sizes: list[int], least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each window size: (start, text number, place in its text, hash, offsets read as names, size), and the template.

    A capitalised word that opens a sentence may be a name or not, so a window with such
    words comes in every reading; what it must hold is counted with them as literals.
    """
    parts = template(texts)
    owner, hashes, slot, ids, _ = parts
    begin = np.searchsorted(owner, owner)  # where each word's text starts
    opens = (slot == 0) & (_known[0].arrays()[0][ids] == CAPITAL)
    for w in sizes:
        n = len(owner) - w + 1
        if n <= 0:
            continue
        h = np.zeros(n, np.uint64)
        for j in range(w):
            h = h * np.uint64(_STEP) + hashes[j : j + n]
        plain = np.concatenate([[0], np.cumsum(slot == 0)])
        ok = (owner[:n] == owner[w - 1 :]) & (plain[w:] - plain[:-w] >= min(least, w))
        at = np.flatnonzero(ok)
        readings = [(at, h[at], ())]
        for j in range(w):  # each reading so far, and with the word at j as a name too
            power = np.uint64(pow(_STEP, w - 1 - j, 1 << 64))
            for at, h, names in list(readings):
                own = opens[at + j]
                if own.any():
                    named = at[own]
                    readings.append((named, h[own] + (np.uint64(_PLACE[CAPITAL]) - hashes[named + j]) * power, (*names, j)))
        for at, h, names in readings:
            yield at, owner[at], at - begin[at], (h ^ (h >> np.uint64(32))).view(np.int64), names, w, parts


def whole(texts: list[str], sizes: list[int]) -> Iterator[tuple[np.ndarray, ...]]:
    """Like ``windows`` for runs of exactly the same words and values, in one pass a size whatever its length."""
    parts = template(texts)
    owner, ids = parts[0], parts[3]
    begin = np.searchsorted(owner, owner)
    values = _known[0].arrays()[1][ids]
    up, down = (np.full(len(ids) + 1, k, np.uint64) for k in (_STEP, pow(_STEP, -1, 1 << 64)))
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * down[:-1], dtype=np.uint64)])
    for w in sizes:
        n = len(owner) - w + 1
        if n <= 0:
            continue
        at = np.flatnonzero(owner[:n] == owner[w - 1 :])
        h = (sums[at + w] - sums[at]) * up[at] * np.uint64(_STEP) + np.uint64(_WHOLE)
        yield at, owner[at], at - begin[at], (h ^ (h >> np.uint64(32))).view(np.int64), (), w, parts


def _item_windows(items: DataFrame, cfg: TemplateConfig) -> DataFrame:
    """(item_id, item_key, n_item, item_at, size, h, item_slots): every usable window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_chunks(batches, "text", 1 << 20):
            for item, key, text in zip(*(part.column(c).to_pylist() for c in ("item_id", "item_key", "text"))):
                n = len(template([text])[0])
                size = min(cfg.window, n)
                if n < cfg.literals:
                    continue
                own = list(windows([text], [size], cfg.literals))
                usable = len(own[0][0])  # the first reading has every window
                exact = not usable  # full of values: only all of it, unchanged
                for at, _, place, h, names, w, parts in whole([text], [n]) if exact else own:
                    rows = [{"item_id": item, "item_key": key, "n_item": usable or 1, "item_at": int(p), "size": w, "exact": exact, "h": int(x), "item_slots": [] if exact else _slots(int(a), w, parts, names)} for a, p, x in zip(at, place, h)]
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    kind = items.schema["item_id"].dataType
    arrow = pa.schema([("item_id", to_arrow_type(kind)), ("item_key", pa.int64()), ("n_item", pa.int64()), ("item_at", pa.int64()), ("size", pa.int64()), ("exact", pa.bool_()), ("h", pa.int64()), ("item_slots", pa.list_(pa.string()))])
    rows = items.select("item_id", F.xxhash64("text").alias("item_key"), "text").where("text is not null").distinct()
    return rows.mapInArrow(run, f"item_id {kind.simpleString()}, item_key long, n_item long, item_at long, size long, exact boolean, h long, item_slots array<string>")


def consistent(rows: list[tuple[int, list[str], list[str]]]) -> tuple[int, int]:
    """(item windows with a consistent match, slots whose value differs) of one occurrence's (item_at, item_slots, doc_slots).

    Every match votes for the pairs (item value, document value) of its slots, equal
    ones once; an item value stands for its most voted partner, if it is that partner's
    most voted one as well. A window counts if all slots of one of its matches agree.
    """
    rows = {(at, tuple(xs), tuple(ys)) for at, xs, ys in rows}
    votes = Counter((a, b) for _, xs, ys in rows for a, b in zip(xs, ys))
    there, back = defaultdict(list), defaultdict(list)
    for (a, b), n in votes.items():
        there[a].append((-n, a != b, b))
        back[b].append((-n, a != b, a))
    stands = {a: min(x)[2] for a, x in there.items()}
    stands = {a: b for a, b in stands.items() if min(back[b])[2] == a}
    good = {at for at, xs, ys in rows if all(stands.get(a) == b for a, b in zip(xs, ys))}
    return len(good), sum(a != b for a, b in stands.items())


Match = tuple[int, int, list[str], list[str]]  # item_at, doc_at, item_slots, doc_slots


def occurrences(matches: list[Match], least: float) -> Iterator[list[tuple[int, list[str], list[str]]]]:
    """The matches of every place where ``least`` item windows may be: each diagonal, runs of neighbouring ones, and all."""
    diagonals: dict[int, list[Match]] = defaultdict(list)
    for m in matches:
        diagonals[m[1] - m[0]].append(m)
    runs: list[list[int]] = []
    for d in sorted(diagonals):
        if runs and d - runs[-1][-1] <= 1:
            runs[-1].append(d)
        else:
            runs.append([d])
    for part in chain(diagonals.values(), ([m for d in run for m in diagonals[d]] for run in runs), (matches,)):
        if len({m[0] for m in part}) >= least:
            yield [(m[0], m[2], m[3]) for m in part]


def _found(docs: DataFrame, items: DataFrame, cfg: TemplateConfig) -> DataFrame:
    """One row per text (doc_id and hash of the text) and item that is found in it."""
    spark = docs.sparkSession
    bench = stored(_item_windows(items, cfg))
    sizes = sorted(tuple(r) for r in bench.select("exact", "size").distinct().collect())  # at most ``window`` values, and the lengths of exact items
    loose, exact = ([n for kind, n in sizes if kind is want] for want in (False, True))
    low = F.col("h").bitwiseAND((1 << _BITS) - 1)
    words = bench.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()  # 2^20 rows at most
    bits = np.zeros(1 << (_BITS - 6), np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    sent = spark.sparkContext.broadcast(bits)
    kind = docs.select("doc_id").dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembers("template words", _known.clear)
        for part in by_chunks(batches, "text", 1 << 19):
            ids, keys = part.column("doc_id"), part.column("doc_key")
            texts = part.column("text").to_pylist()
            every = chain(((False, x) for x in windows(texts, loose, cfg.literals)), ((True, x) for x in (whole(texts, exact) if exact else ())))
            for same, (at, own, place, h, names, w, parts) in every:
                slot = h & ((1 << _BITS) - 1)
                hit = np.flatnonzero((sent.value[slot >> 6] >> (slot & 63)) & 1)
                if len(hit):
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(own[hit])), keys.take(pa.array(own[hit])), pa.array(place[hit], pa.int64()), pa.array([w] * len(hit), pa.int64()), pa.array([same] * len(hit), pa.bool_()), pa.array(h[hit]), pa.array([[] if same else _slots(int(a), w, parts, names) for a in at[hit]], pa.list_(pa.string()))],
                        ["doc_id", "doc_key", "doc_at", "size", "exact", "h", "doc_slots"],
                    )

    rows = docs.select("doc_id", F.xxhash64("text").alias("doc_key"), "text").where("text is not null")
    hits = rows.mapInArrow(run, f"doc_id {kind}, doc_key long, doc_at long, size long, exact boolean, h long, doc_slots array<string>")
    # copies of a document vote once
    pairs = stored(hits.distinct().join(bench, ["size", "exact", "h"]).select("doc_id", "doc_key", "doc_at", "item_id", "item_key", "n_item", "item_at", "item_slots", "doc_slots"))
    group = ["doc_id", "doc_key", "item_id", "item_key"]
    # nothing beats an occurrence of all windows, one behind the other, with unchanged values
    same = F.col("item_slots") == F.col("doc_slots")
    told = pairs.groupBy(*group, (F.col("doc_at") - F.col("item_at")).alias("diagonal")).agg(F.count_distinct(F.when(same, F.col("item_at"))).alias("same"), F.max("n_item").alias("of"))
    sure = stored(told.where("same = of").select(*group, "of").distinct())
    enough = pairs.groupBy(*group).agg(F.count_distinct("item_at").alias("n"), F.max("n_item").alias("of")).where(F.col("n") >= cfg.share * F.col("of")).drop("n", "of")
    item_kind = items.select("item_id").dtypes[0][1]
    certain = sure.select("doc_id", "doc_key", "item_id", F.col("of").alias("n_windows"), F.col("of").cast("long").alias("n_found"), F.lit(0).cast("long").alias("n_changed"))


    def on(r: str) -> list[Column]:
        return [F.col(f"p.{c}").eqNullSafe(F.col(f"{r}.{c}")) for c in group]

    def judge(rows: pa.Table) -> pa.Table:
        of = rows.column("n_item")[0].as_py()
        matches = list(zip(*(rows.column(c).to_pylist() for c in ("item_at", "doc_at", "item_slots", "doc_slots"))))
        found, changed = max(map(consistent, occurrences(matches, cfg.share * of)), key=lambda x: (x[0], -x[1]))
        own = [rows.column(c).slice(0, 1) for c in ("doc_id", "doc_key", "item_id")]
        return pa.table([*own, *(pa.array([v], pa.int64()) for v in (of, found, changed))], ["doc_id", "doc_key", "item_id", "n_windows", "n_found", "n_changed"])

    open_ = pairs.alias("p").join(enough.alias("e"), on("e"), "left_semi").alias("p").join(sure.alias("s"), on("s"), "left_anti")
    judged = certain.unionByName(open_.groupBy(*group).applyInArrow(judge, f"doc_id {kind}, doc_key long, item_id {item_kind}, n_windows long, n_found long, n_changed long"))
    return judged.withColumn("share", F.col("n_found") / F.col("n_windows")).where(F.col("share") >= cfg.share)


def find_contamination(docs: DataFrame, items: DataFrame, cfg: TemplateConfig = TemplateConfig()) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, share, n_changed): one row per item found in a document.

    share is the part of the item's windows found consistently (``share`` at least),
    n_changed the number of exchanged values. Repeated rows and rows with one id but
    different texts give one row with the best match. Null texts match nothing; a
    null id is reported as null; items without a usable window are found where all their
    words and values stand unchanged, as one window; items with fewer template words than ``literals``
    can't be told from chance and match nothing; other columns are ignored; empty
    tables give no rows. Not found, since the template has another length: a name that
    opens a sentence and has another number of words, and a number written in several words.
    """
    best = F.max(F.struct("share", (-F.col("n_changed")).alias("same"), "n_windows", "n_found")).alias("b")
    found = _found(docs, items, cfg).groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", "b.n_windows", "b.n_found", "b.share", (-F.col("b.same")).alias("n_changed"))


def without_contaminated(docs: DataFrame, items: DataFrame, cfg: TemplateConfig = TemplateConfig()) -> DataFrame:
    """The rows of ``docs`` in whose text no item was found."""
    found = _found(docs, items, cfg).select(F.col("doc_id").alias("__id"), F.col("doc_key").alias("__key")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left_anti")

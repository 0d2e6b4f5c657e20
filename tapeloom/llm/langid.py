"""Language ID with bit-sliced Bloom filters of character n-grams.

All languages share one Bloom filter whose slots hold bit masks instead of bits: bit
l of a slot says that some n-gram of language l fell there, so the slices of the
table are the languages' filters. The AND of an n-gram's slots is the mask of all
languages that contain it. A text adds up the bits per language (its popcounts); a
language's count is corrected for the n-grams its slice lets through by chance, and
the largest corrected share decides.

An n-gram belongs to a language if its share of that language's n-grams is not
negligible, on its own and against the language where it is most frequent; stray
words of other languages therefore leave no trace. The table has a fixed size.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import by_chunks, fold_mod, stored

UNKNOWN = "und"
_LETTER, _MARK = 1, 2


@dataclass(frozen=True)
class LangIdConfig:
    """min_share: least share of a language's n-grams; ratio: least part of its greatest share.

    slots: table size, a power of two; hashes: slots per n-gram. Documents whose
    crc32 fold is ``held`` of ``folds`` are never learned from.
    """

    min_share: float = 1e-5
    ratio: float = 0.1
    slots: int = 1 << 20
    hashes: int = 3
    folds: int = 4
    held: int = 2


_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """For every code point: 1 letter, 2 mark (which may stand inside a word), else 0."""
    if not _kinds:
        table = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            table[i] = _LETTER if c.isalpha() else _MARK if unicodedata.category(c)[0] == "M" else 0
        _kinds.append(table)
    return _kinds[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, trigram key) of every trigram around a letter, and whether a text has letters.

    Texts are lower-cased; everything but letters and marks is a blank.
    """
    low = [t.lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(low)), np.fromiter(map(len, low), np.int64, len(low)) + 1)
    owner = np.append(owner, len(low))[: len(codes)]  # position i of codes[1:] belongs to owner[i]
    kind = kinds()[codes]
    codes = np.where(kind > 0, codes, 32).astype(np.int64)
    mid = np.flatnonzero(kind[1:-1] > 0) + 1
    key = (codes[mid - 1] << 42) | (codes[mid] << 21) | codes[mid + 1]
    letters = np.zeros(len(low) + 1, bool)
    letters[owner[np.flatnonzero(kind[1:] == _LETTER)]] = True
    return owner[mid - 1], key, letters[:-1]


def slots_of(keys: np.ndarray, slots: int, hashes: int) -> list[np.ndarray]:
    """Slot numbers of the keys by double hashing."""
    h = keys.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h + np.uint64(j) * step) & np.uint64(slots - 1)).astype(np.int64) for j in range(hashes)]


@dataclass(frozen=True)
class LangFilter:
    """languages in order; masks: (planes of 64 languages, slots); chance: odds of a false hit."""

    languages: list[str]
    masks: np.ndarray
    chance: np.ndarray
    hashes: int


def _counts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_chunks(batches, "text", 1 << 20):
            langs = part.column("lang").to_pylist()
            texts = part.column("text").to_pylist()
            for lang in sorted(set(langs)):
                _, key, _ = trigrams([t for t, own in zip(texts, langs) if own == lang])
                gram, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    return docs.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_filter(docs: DataFrame, cfg: LangIdConfig = LangIdConfig()) -> LangFilter:
    """The filter learned from ``docs(text, lang)``; rows with a null in either are not used.

    The driver receives the languages and at most ``slots`` masks per 64 languages.
    """
    counts = stored(_counts(docs.select("text", "lang").where("text is not null and lang is not null")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    languages = sorted(r.lang for r in totals.collect())  # one row per language
    planes = max(1, -(-len(languages) // 64))
    masks = np.zeros((planes, cfg.slots), np.int64)
    if not languages:
        return LangFilter([], masks, np.zeros(0), cfg.hashes)
    share = F.col("n") / F.col("total")
    shares = counts.join(totals, "lang").select("lang", "gram", share.alias("share")).withColumn("most", F.max("share").over(Window.partitionBy("gram")))  # a row per language
    owned = shares.where((F.col("share") >= cfg.min_share) & (F.col("share") >= cfg.ratio * F.col("most"))).select("lang", "gram")
    number = {lang: i for i, lang in enumerate(languages)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            bit = np.int64(1) << (at % 64)
            for slot in slots_of(batch.column("gram").to_numpy(zero_copy_only=False), cfg.slots, cfg.hashes):
                yield pa.RecordBatch.from_arrays([pa.array(at // 64), pa.array(slot), pa.array(bit)], ["plane", "slot", "bits"])

    table = owned.mapInArrow(place, "plane long, slot long, bits long").groupBy("plane", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    masks[table.column("plane").to_numpy(), table.column("slot").to_numpy()] = table.column("bits").to_numpy()
    fill = np.array([np.count_nonzero((masks[i // 64] >> (i % 64)) & 1) / cfg.slots for i in range(len(languages))])
    return LangFilter(languages, masks, fill**cfg.hashes, cfg.hashes)


def classify(texts: list[str | None], f: LangFilter) -> tuple[list[str], np.ndarray]:
    """Language and score of every text."""
    owner, key, letters = trigrams([t or "" for t in texts])
    n = np.bincount(owner, minlength=len(texts))
    slots = slots_of(key, f.masks.shape[1], f.hashes)
    shares = np.zeros((len(texts), max(1, len(f.languages))))
    for plane, masks in enumerate(f.masks):
        found = masks[slots[0]]
        for s in slots[1:]:
            found &= masks[s]
        for i in range(64 * plane, min(64 * plane + 64, len(f.languages))):
            hits = np.bincount(owner[(found >> (i % 64)) & 1 == 1], minlength=len(texts))
            shares[:, i] = (hits / np.maximum(n, 1) - f.chance[i]) / max(1 - f.chance[i], 1e-9)
    best = shares.argmax(axis=1)
    known = letters & bool(f.languages)
    score = np.where(known, np.clip(shares[np.arange(len(texts)), best], 0, 1), 0.0)
    return [f.languages[b] if k else UNKNOWN for b, k in zip(best, known)], score


def identify_languages(docs: DataFrame, f: LangFilter, cfg: LangIdConfig = LangIdConfig()) -> DataFrame:
    """(doc_id, held_out boolean, lang_pred string, score double) for every row of ``docs(doc_id, text)``.

    ``und`` with score 0 if the text is null, has no letter, or nothing was learned;
    otherwise a learned language (the first of equals) and its corrected share of the
    text's n-grams. A null id counts as the empty text for the fold; repeated rows
    are kept; other columns are ignored; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(f)  # slots x 8 bytes per 64 languages
    kind = docs.select("doc_id").dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_chunks(batches, "text", 1 << 20):
            lang, score = classify(part.column("text").to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", (fold_mod("doc_id", cfg.folds) == cfg.held).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def learn_and_identify(docs: DataFrame, cfg: LangIdConfig = LangIdConfig()) -> DataFrame:
    """Learn from the documents outside the held fold, then label every document."""
    return identify_languages(docs, learn_filter(docs.where(fold_mod("doc_id", cfg.folds) != cfg.held), cfg), cfg)


def keep_identified(docs: DataFrame, least: float = 0.2, cfg: LangIdConfig = LangIdConfig()) -> DataFrame:
    """The rows of ``docs(text, lang, ...)`` whose language can be told, with all their columns.

    Learns from all rows with a language. A row goes if it is ``und`` or less than
    ``least`` of its n-grams belong to the best language. Without any language to
    learn from no row can be judged, and all with letters stay.
    """
    f = learn_filter(docs, cfg)
    sent = docs.sparkSession.sparkContext.broadcast(f)  # slots x 8 bytes per 64 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_chunks(batches, "text", 1 << 20):
            texts = part.column("text").to_pylist()
            if sent.value.languages:
                lang, score = classify(texts, sent.value)
                keep = [x != UNKNOWN and s >= least for x, s in zip(lang, score)]
            else:
                keep = trigrams([t or "" for t in texts])[2].tolist()
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Toxicity classifier with a counterfactual penalty.

A logistic model over the presence of informative words. For every labelled sentence
that names a group, counterfactuals swap the identity term for the other terms of
its list (among them a neutral one), and training adds the squared change of the
score to the loss. Words that merely tend to stand beside insults, such as group
names, are thereby held at the weight of a neutral word, so that a plain mention of
a group doesn't count as toxic.

The model has at most ``max_features`` weights and learns from at most
``max_fit_rows`` labelled documents; every document is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import by_chunks, cut, fold_mod, stored

#: Fixed word lists: terms that may stand for each other in a sentence; the first of each is neutral.
IDENTITY_TERMS = (
    ("people", "women", "men", "girls", "boys", "females", "males", "transgender", "nonbinary"),
    ("person", "woman", "man", "girl", "boy", "female", "male", "lady", "gentleman"),
    ("local", "black", "white", "asian", "hispanic", "latino", "african", "european", "arab", "indigenous", "native"),
    ("group", "gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("members", "christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists"),
    ("member", "christian", "muslim", "jew", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"),
    ("citizens", "americans", "mexicans", "germans", "french", "spanish", "chinese", "russians", "indians", "turks", "immigrants", "refugees", "foreigners"),
    ("citizen", "american", "mexican", "german", "chinese", "russian", "indian", "turkish", "immigrant", "refugee", "foreigner"),
    ("adults", "elderly", "disabled", "deaf", "blind", "autistic", "teenagers", "seniors"),
)
_SWAPS = {term: tuple(x for x in terms if x != term) for terms in IDENTITY_TERMS for term in terms}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


@dataclass(frozen=True)
class ToxicityConfig:
    """max_features, max_fit_rows: bounds of the model and of its sample of labelled rows.

    min_docs: training documents a word must stand in; min_z: least standardised
    difference of its frequency between the labels. pull: weight of the
    counterfactual penalty; ridge: of the squared weights. Fold ``held`` of
    ``folds`` is never learned from.
    """

    max_features: int = 2000
    max_fit_rows: int = 200_000
    min_docs: int = 3
    min_z: float = 4.0
    pull: float = 10.0
    ridge: float = 1e-5
    steps: int = 400
    folds: int = 5
    held: int = 0


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    bias: float


def words_in(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def swaps(text: str) -> list[tuple[str, str]]:
    """(term, counterfactual term) pairs of the sentences of a text that name a group."""
    out = set()
    for sentence in _SENTENCE.split(text.lower()):
        for term in _SWAPS.keys() & set(_WORD.findall(sentence)):
            out |= {(term, other) for other in _SWAPS[term]}
    return sorted(out)


def labelled(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig) -> DataFrame:
    """(doc_id, text, toxic) of the training folds, for at most ``max_fit_rows`` labelled ids in hash order.

    Conflicting labels count as toxic, null ones not at all. The ids are bounded, so
    they go to the documents and no text is shuffled.
    """
    usable = labels.where("toxic is not null and doc_id is not null").where(fold_mod("doc_id", cfg.folds) != cfg.held)
    known = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.max_fit_rows))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(fold_mod("doc_id", cfg.folds) != cfg.held)
    return rows.join(F.broadcast(known), "doc_id")  # max_fit_rows pairs of numbers


def informative_words(rows: DataFrame, cfg: ToxicityConfig) -> list[str]:
    """Words whose document frequency differs between the labels, and all identity terms that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_chunks(batches, "text", 2 << 20):
            seen: tuple[Counter, Counter] = Counter(), Counter()
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                seen[toxic].update(words_in(text))
            words = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[0][w] for w in words], pa.int64()), pa.array([seen[1][w] for w in words], pa.int64())], ["word", "clean", "toxic"])

    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return []
    counts = rows.select("text", "toxic").mapInArrow(run, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    p0, p1 = F.col("clean") / n0, F.col("toxic") / n1
    p = (F.col("clean") + F.col("toxic")) / (n0 + n1)
    z = F.abs(p1 - p0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1) + 1e-12)
    scored = counts.where(F.col("clean") + F.col("toxic") >= cfg.min_docs).select("word", z.alias("z"))
    own = F.col("word").isin(*_SWAPS)
    kept = scored.where((F.col("z") >= cfg.min_z) | own).orderBy(own.desc(), F.desc("z"), "word").limit(cfg.max_features)  # the model's size
    return [r.word for r in kept.collect()]


def fit(rows: list[int], cols: list[int], y: np.ndarray, width: int, pairs: np.ndarray, weight: np.ndarray, cfg: ToxicityConfig) -> np.ndarray:
    """Weights (bias last) of the penalised logistic loss, by accelerated gradient steps.

    rows, cols: the ones of the sparse design. pairs (term, other) with their share
    of the sentences: the penalty is pull * weight * (w[term] - w[other])^2, where
    column ``width`` (a word outside the model) has weight zero.
    """
    rows, cols, n = np.asarray(rows), np.asarray(cols), max(len(y), 1)
    seen = np.bincount(cols, minlength=width) / n
    pulled = (np.bincount(pairs[:, 0], weight, width + 1) + np.bincount(pairs[:, 1], weight, width + 1))[:width] if len(pairs) else np.zeros(width)
    curve = 0.25 * np.append(seen, 1.0) + np.append(4 * cfg.pull * pulled, 0.0)
    scale = 1 / np.sqrt(curve + cfg.ridge + 1e-3)  # diagonal preconditioner

    def gradient(w: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols], len(y)) + w[-1], -35, 35)))
        g = np.append(np.bincount(cols, (p - y)[rows], width), (p - y).sum()) / n
        g[:-1] += cfg.ridge * w[:-1]
        if len(pairs):
            full = np.append(w[:-1], 0.0)
            d = 2 * cfg.pull * weight * (full[pairs[:, 0]] - full[pairs[:, 1]])
            g[:-1] += (np.bincount(pairs[:, 0], d, width + 1) - np.bincount(pairs[:, 1], d, width + 1))[:width]
        return g

    def loss(w: np.ndarray) -> float:
        s = np.clip(np.bincount(rows, w[cols], len(y)) + w[-1], -35, 35)
        full = np.append(w[:-1], 0.0)
        cf = cfg.pull * (weight * (full[pairs[:, 0]] - full[pairs[:, 1]]) ** 2).sum() if len(pairs) else 0.0
        return float((np.logaddexp(0, s) - y * s).mean() + cfg.ridge / 2 * (w[:-1] ** 2).sum() + cf)

    w = v = np.zeros(width + 1)
    step, best = 1.0, loss(w)
    k = 1
    for _ in range(cfg.steps):
        g = gradient(v)
        while True:
            new = v - step * scale**2 * g
            now = loss(new)
            if now <= best + 1e-12 or step < 1e-6:
                break
            step, v, k = step / 2, w, 1  # restart from the best point with a shorter step
            g = gradient(v)
        v = new + (k - 1) / (k + 2) * (new - w)
        w, best, k, step = new, min(best, now), k + 1, step * 1.05
    return w


def learn_toxicity(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """The model of ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, learned outside the held fold.

    Without documents of both labels every text scores the share of toxic ones.
    """
    rows = stored(labelled(docs, labels, cfg))
    names = informative_words(rows, cfg)
    if not names:
        mean = rows.agg(F.avg("toxic")).first()[0] or 0.0
        return ToxicityModel({}, math.log((mean + 1e-6) / (1 - mean + 1e-6)))
    number = {w: i for i, w in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_chunks(batches, "text", 2 << 20):
            texts = part.column("text").to_pylist()
            found = [sorted(number[w] for w in words_in(t) & number.keys()) for t in texts]
            swapped = [[number.get(w, -1) for pair in swaps(t) for w in pair] for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(found, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.int32()))], ["toxic", "found", "swapped"])

    data = rows.select("text", "toxic").mapInArrow(run, "toxic int, found array<int>, swapped array<int>").toArrow()
    found = data.column("found").combine_chunks()
    at = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
    y = data.column("toxic").to_numpy().astype(float)
    flat = data.column("swapped").combine_chunks().flatten().to_numpy().reshape(-1, 2).astype(np.int64)
    pairs, times = np.unique(np.where(flat < 0, len(names), flat), axis=0, return_counts=True)
    w = fit(at, found.flatten().to_numpy(), y, len(names), pairs, times / max(len(y), 1), cfg)
    return ToxicityModel(dict(zip(names, w[:-1].tolist())), float(w[-1]))


def score_text(text: str, model: ToxicityModel) -> float:
    s = model.bias + sum(sorted(model.weights[w] for w in words_in(text) & model.weights.keys()))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, s))))


def score_toxicity(docs: DataFrame, model: ToxicityModel, cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """(doc_id, held_out boolean, score double, predicted int) for every row of ``docs(doc_id, text)``.

    Null and empty texts score as texts without words. A null id counts as the empty
    text for the fold (held out); repeated rows are kept; other columns are ignored;
    an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # max_features weights
    kind = docs.select("doc_id").dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_chunks(batches, "text", 2 << 20):
            score = [score_text(t or "", sent.value) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (fold_mod("doc_id", cfg.folds) == cfg.held).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def learn_and_score(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    return score_toxicity(docs, learn_toxicity(docs, labels, cfg), cfg)

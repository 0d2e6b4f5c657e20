import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tapeloom.llm import cuttingstock as cs
from tapeloom.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
SMALL = cs.StockConfig(length=64)


@pytest.fixture(scope="module")
def coder():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(PATH, encoding="utf-8") as f:
        return cs.WordIds(f.read(), 1)


def whole(coder, text):
    return coder.core.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aZéÉßö'sl<|>endoftext \n\t\x1c\x85\xa0　́日1İΣſKﬁ_-,.\r×Þ😀"), max_size=30))
def test_word_ids_equal_whole_text_ids(text):
    with open(PATH, encoding="utf-8") as f:
        coder = test_word_ids_equal_whole_text_ids.__dict__.setdefault("coder", None) or cs.WordIds(f.read(), 1)
    test_word_ids_equal_whole_text_ids.coder = coder
    for t in (text, text + "<|endoftext|>" + text, "It's " + text + "DON'T"):
        assert np.frombuffer(coder.encode(t.encode()), np.uint16).tolist() == whole(coder, t)


def test_long_texts_are_encoded_in_parts(coder, monkeypatch):
    text = "Words of one long text, <|endoftext|> é\n" * 300 + "x" * 500
    monkeypatch.setattr(cs, "_PART", 97)
    monkeypatch.setattr(cs, "_CACHE", 3)
    assert np.frombuffer(coder.encode(text.encode()), np.uint16).tolist() == whole(coder, text)


def texts():
    rng = random.Random(5)
    words = ["the", "Élan", "x1", "don't", "12%", "日本語", "a,b", "(ok)", "<|startoftext|>"]
    odd = ["", None, "  ", "a", "word " * 3000, "日" * 900]
    return odd + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(120)] + ["three same texts"] * 3


def check(rows, docs, coder, size):
    """Lossless pieces, gapless sequences; returns (padding, sequences, cuts beyond the least)."""
    left = Counter((d, tuple(whole(coder, t) + [1])) for d, t in docs)
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for (d, n), ps in by.items():
        starts = Counter()
        for r in ps:
            starts[r.start] += r.length
        same = [x for (e, x) in left.elements() if e == d and len(x) == n]
        total = Counter()
        for x in same:
            total.update(x)
        assert sum(total.values()) == sum(r.length for r in ps)
        got = Counter()
        for r in ps:
            part = np.frombuffer(r.ids, "<u4").tolist()
            assert len(part) == r.length > 0 and any(tuple(part) == x[r.start : r.start + r.length] for x in same)
            got.update(part)
        assert got == total
    assert {k for k in by} == {(d, len(x)) for d, x in left}
    seq = {}
    for r in rows:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    pad = 0
    for spans in seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
        pad += 0 if at & (at - 1) == 0 else size - at
    return pad, len(seq), len(rows) - sum(-(-len(x) // size) for _, x in left.elements())


def test_pieces_are_lossless_and_sequences_full(spark, coder):
    docs = [(i, t, "s", 7) for i, t in enumerate(texts())] + [(None, "no id", "s", 1), (5, "a second five", None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, sequence_id string, rank int")
    rows = cs.pack_stock(df.repartition(5), PATH, SMALL).collect()
    pad, n, cuts = check(rows, [d[:2] for d in docs], coder, 64)
    assert pad <= 0.01 * sum(r.length for r in rows) and cuts <= n
    whole_sequences = {r.sequence_id: r for r in cs.sequences(cs.pack_stock(df, PATH, SMALL)).collect()}
    for r in whole_sequences.values():
        assert len(r.ids) == 4 * r.ends[-1] and len(r.ends) == len(r.doc_ids) and r.ends[-1] <= 64
    assert sum(len(r.ids) // 4 for r in whole_sequences.values()) == sum(r.length for r in rows)
    assert cs.pack_stock(df.limit(0), PATH, SMALL).collect() == []


def test_equal_lengths_are_cut_instead_of_padded(spark, coder):
    docs = [(i, "one two three " * 13) for i in range(50)]
    rows = cs.pack_stock(spark.createDataFrame(docs, "doc_id long, text string"), PATH, SMALL).collect()
    pad, _, _ = check(rows, docs, coder, 64)
    assert pad == 0


def test_patterns_meet_the_demand_and_waste_nothing():
    rng = np.random.default_rng(1)
    for cfg, n in ((SMALL, 40), (SMALL, 2000), (cs.StockConfig(), 3000)):
        lengths, counts = np.unique(1 + rng.exponential(cfg.length / 4, n).astype(int) % (cfg.length - 1), return_counts=True)
        solution = cs.solve(lengths, counts, cfg)
        use = np.zeros(len(lengths))
        for items, x in solution:
            assert x > 0 and lengths[items].sum() <= cfg.length
            np.add.at(use, items, x)
        assert (use <= counts + 1e-6).all()
        chosen = cs.whole_numbers(solution, lengths, counts, cfg)
        took = np.zeros(len(lengths), int)
        for items, k in chosen:
            np.add.at(took, items, k)
        assert (took <= counts).all()
        if n > 40:
            assert (took * lengths).sum() > 0.7 * (counts * lengths).sum()


def brute_least(lengths, counts, cfg):
    """Least cost by trying all ways, for whole numbers of patterns, the stream for what is left."""
    from functools import lru_cache

    per = 1 + (cfg.sequence_cost + cfg.cut_cost) / cfg.length

    def fills(left, room, j):
        yield ()
        for k in range(j, len(lengths)):
            if left[k] and lengths[k] <= room:
                rest = tuple(x - (i == k) for i, x in enumerate(left))
                for more in fills(rest, room - lengths[k], k):
                    yield (k, *more)

    @lru_cache(None)
    def best(left):
        low = sum(n * x * per for n, x in zip(left, lengths))
        for p in set(fills(left, cfg.length, 0)):
            if p:
                low = min(low, float(cs._cost(sum(lengths[k] for k in p), cfg)) + best(tuple(x - p.count(i) for i, x in enumerate(left))))
        return low

    return best(tuple(counts))


def test_column_generation_is_never_worse_than_whole_patterns():
    rng = random.Random(4)
    cfg = cs.StockConfig(length=16, sequence_cost=1.0, cut_cost=2.0)
    for _ in range(25):
        lengths = np.array(sorted(rng.sample(range(1, 16), rng.randint(1, 4))))
        counts = np.array([rng.randint(1, 3) for _ in lengths])
        used = np.zeros(len(lengths))
        value = 0.0
        for items, x in cs.solve(lengths, counts, cfg):
            np.add.at(used, items, x)
            value += x * float(cs._cost(int(lengths[items].sum()), cfg))
        value += ((counts - used) * lengths).sum() * (1 + (cfg.sequence_cost + cfg.cut_cost) / cfg.length)
        assert value <= brute_least(tuple(lengths.tolist()), counts.tolist(), cfg) + 1e-6


def test_query_gives_checksums_of_the_ids(spark, coder):
    rows = QUERIES["op13_cutting_stock"](spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == docs.keys()
    for r in rows:
        ids = np.array(whole(coder, docs[r.doc_id]) + [1], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())

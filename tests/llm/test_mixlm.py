import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tapeloom.llm.common import table
from tapeloom.llm.mixlm import Block, MixLmConfig, Mixer, _level, _mixed, decisions, score_documents, token_scores
from tapeloom.llm.mixlm import Evidence, Running, word_paths
from tapeloom.llm.mixlm import packed as packed_array


def tokens(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w] + [None]


def brute_base(rows):
    train = Counter(t for d, x in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2 for t in tokens(x))
    n, v = sum(train.values()), len(train)
    out = []
    for d, x in rows:
        ts = tokens(x)
        out.append((d, len(ts), sum(train[t] > 0 for t in ts), n, sum(math.log10((train[t] + 1) / (n + v + 1)) for t in ts)))
    return out


def corpus():
    rng = random.Random(4)
    parts = ["an", "bel", "cor", "dis", "est", "for", "gra", "her"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([20, 400])]).title() for _ in range(rng.randint(0, 120)))) for i in range(220)]
    return rows + [(None, "no id"), (500, None), (501, ""), (502, "\x01odd \x02 \xa0x"), (503, "A" * 3000 + " b"), (5, rows[5][1]), (504, "日本 語")]


def packed(toks, counts, reach=4):
    raw = [t.encode() for t in toks]
    return reach, b"".join(raw), np.array([len(t) for t in raw], np.int32).tobytes(), np.array(counts, np.int64).tobytes()


def test_counts_of_the_word_so_far_match_brute_force():
    rng = random.Random(2)
    toks = sorted({"abcd" + "".join(rng.choice("ab\x01~é") for _ in range(rng.randint(0, 6))) for _ in range(60)} | {"abc", "wxyz", "wxyza", "wxyzab"})
    rng.shuffle(toks)
    counts = [rng.randint(0, 9) for _ in toks]
    b = Block(*packed(toks, counts))
    bits = {t: "".join(f"{x:08b}" for x in t.encode() + b" ") for t in toks}
    for i, t in enumerate(b.tokens):
        t = t.decode()
        for pos in range(4, len(t.encode()) + 1):
            for k in range(8):
                so_far = bits[t][: 8 * pos + k]
                same = [(u, c) for u, c in zip(toks, counts) if bits[u].startswith(so_far) and len(bits[u]) > len(so_far)]
                at = b.start[i] + pos
                assert b.total[at, k] == sum(c for _, c in same)
                assert b.ones[at, k] == sum(c for u, c in same if bits[u][len(so_far)] == "1")


def test_probabilities_of_all_continuations_add_up_to_one():
    """Tokens of one byte after a fixed start: all 256 next bytes share the start's probability."""
    rng = np.random.default_rng(1)
    tables = [rng.integers(0, 9, (n, 2)).astype(np.uint16) for n in (1 << 16, 1 << 16, 1 << 16, 1 << 16)]
    mixer = Mixer(tables, rng.normal(0.2, 0.1, (224, 6)), np.tile((np.arange(33) - 16) / 2, (224, 1)))
    whole = [bytes([x]) for x in range(256)]
    total = 0.0
    for x in whole:  # P(first byte = x) is the ratio of the codes of x + blank and of the blank after x
        b = Block(4, x, np.array([1], np.int32).tobytes(), np.array([0], np.int64).tobytes())
        lo = [10 ** token_scores(b, mixer)[0]]
        f, bit, gate = decisions(b, 0, 2, tables, False)
        odds = _mixed(f, gate, mixer.weights)
        odds = (odds + mixer.adapted[gate, _level(odds)]) / 2
        p = np.where(bit == 1, 1 / (1 + np.exp(-odds)), 1 / (1 + np.exp(odds))).reshape(8, 2).prod(axis=0)
        assert abs(p.prod() - lo[0]) < 1e-9
        total += p[0]
    assert abs(total - 1) < 1e-6


def test_base_columns_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 7, b"x") for d, t in rows], "doc_id long, text string, num int, tok binary")
    one = score_documents(docs, MixLmConfig(block=50, group=30, chunk_bytes=5000)).collect()
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in one), key=repr)
    assert got == sorted(((*x[:4], round(x[4], 6)) for x in brute_base(rows)), key=repr)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in one)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2) for r in one)


def test_held_out_texts_are_coded_well(spark):
    """The base gives each unknown word the mass of one occurrence, which no distribution over all words can."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    got = [r for r in score_documents(docs).collect() if r.held_out]
    base, score, width = sum(r.base_score for r in got), sum(r.score for r in got), sum(-r.score * math.log2(10) / r.bits_per_byte for r in got)
    assert score > 1.1 * base and -score * math.log2(10) / width < 2.5
    known = [r for r in got if r.n_known == r.n_tokens]
    assert known and sum(r.score for r in known) > sum(r.base_score for r in known)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert score_documents(empty).collect() == []
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = score_documents(spark.createDataFrame([(i, "a b") for i in held], empty.schema)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows] == [(3, 0, 0, 0.0)] * 3


def test_the_words_before_change_a_texts_score(spark):
    """Pairs of words that training holds in one order only: the order of known words decides the score."""
    rng = random.Random(3)
    pairs = [(f"left{i}", f"right{i}") for i in range(30)]
    rows = [(i, " ".join(w for p in rng.choices(pairs, k=40) for w in p)) for i in range(200)]
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    words = [w for p in pairs for w in p]
    rows += [(held[0], " ".join(words)), (held[1], " ".join(words[1:] + words[:1]).replace("right", "x").replace("left", "right").replace("x", "left"))]
    got = {r.doc_id: r for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a, b = (got[i] for i in held)
    assert a.n_known == b.n_known == a.n_tokens and abs(a.base_score - b.base_score) < 1e-6
    assert a.score > 0.7 * a.base_score and a.score > b.score + 20


def test_paths_are_those_of_a_prefix_code(spark):
    counts = [("", 50), ("a", 40), ("b", 40), ("c", 3), *((f"w{i}", 1) for i in range(70)), ("new", 0)]
    vocabulary = spark.createDataFrame([(t.encode(), c) for t, c in counts], "tok binary, c long")
    got = word_paths(vocabulary, sum(c for _, c in counts), 200_000).collect()
    paths = [f"{r.path:b}" for r in got]
    assert len(got) == 74 and all(x.startswith("10") for x in paths)
    assert not any(x != y and y.startswith(x) for x in paths for y in paths) and len(set(paths)) == 74


def test_running_decisions_match_one_word_at_a_time():
    """Slots, log odds, weight sets and scores of whole slices against a plain loop over words, learning and scoring."""
    rng = np.random.default_rng(8)
    paths = [3, 0b10, 0b11101, *(int(x) for x in rng.integers(1 << 6, 1 << 11, 40))]
    count = np.array([0, 1, 5, *rng.integers(1, 3, 40)], np.int64)
    n = np.array([1, 2, 3, 40, 7], np.int64)
    codes, held = rng.integers(0, len(paths), n.sum()).astype(np.int32), [False, True, False, False, False]
    row = {"codes": packed_array(codes), "n": n.tobytes(), "held_out": held, "c": packed_array(count), "path": packed_array(np.array(paths, np.int64))}
    slots, mask = 1 << 16, (1 << 64) - 1
    tables = [rng.integers(0, 9, (slots, 2)).astype(np.uint16) for _ in range(4)]
    weights, adapted = rng.normal(0.2, 0.1, (60, 5)), rng.normal(0, 1, (60, 33))

    def plain(learning):
        for text in np.split(codes, np.cumsum(n)[:-1]) if not learning else [x for x, h in zip(np.split(codes, np.cumsum(n)[:-1]), held) if not h]:
            for i, code in enumerate(text):
                one, two = (paths[text[i - k]] if i >= k else 0 for k in (1, 2))
                first = (one + 1) * 0x9E3779B97F4A7C15 & mask
                mixed = [0, first, ((first ^ (first >> 29) ^ two) * 0xC2B2AE3D27D4EB4F + 2) & mask, (two + 3) * 0x165667B19E3779F9 & mask]
                word = f"{paths[code]:b}"[1:]
                made = []
                for depth, b in enumerate(word):
                    bit = int(count[code] == 1) if learning and depth == 0 else int(b)
                    node = int("1" + word[:depth], 2)
                    x, seen = [], []
                    for t in range(4):
                        h = (mixed[t] ^ (node * 0xD6E8FEB86659FD93 & mask)) * 0xBF58476D1CE4E5B9 & mask
                        h = (h ^ (h >> 32)) * 0x94D049BB133111EB & mask
                        pair = [int(v) for v in tables[t][h >> 48]]
                        pair[bit] -= learning and pair[bit] > 0
                        x.append(math.log((pair[1] + 0.4) / (pair[0] + 0.4)))
                        seen.append(sum(pair))
                    kind = 0 if depth == 0 else 1 if depth <= 6 else 2
                    gate = (sum(seen[1] > v for v in (0, 1, 3, 15)) * 4 + sum(seen[2] > v for v in (0, 1, 5))) * 3 + kind
                    made.append((*x, 0.3, bit, gate))
                yield made

    for learning in (True, False):
        words, want = Running(row, trained=learning), list(plain(learning))
        x, bit, gate, sizes = words.decisions(0, len(words.path), Evidence(tables, learning))
        got, done = [[] for _ in want], 0
        for size in sizes:
            for j, w in enumerate(words.falling(0, len(words.path))[:size]):
                got[w].append((*x[:, done + j], bit[done + j], gate[done + j]))
            done += size
        assert [len(w) for w in got] == [len(w) for w in want]
        np.testing.assert_allclose(np.array([d for w in got for d in w], float), np.array([d for w in want for d in w], float), atol=1e-5)
    scores = []
    for made in want:
        total = 0.0
        for *x, bit, gate in made:
            odds = float(np.dot(weights[gate], x))
            odds = (odds + adapted[gate, _level(np.array(odds))]) / 2
            total -= math.log10(1 + math.exp(-odds if bit else odds))
        scores.append(total)
    np.testing.assert_allclose(words.scores(Evidence(tables, False), weights, adapted), scores, atol=1e-4)

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tapeloom.llm.simhash import BkForest, SimHashConfig, agreeing_masks, fingerprint, near_edges, simhash_components


def brute_fingerprint(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    p = list(range(len(rows)))

    def find(i):
        while p[i] != i:
            i = p[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                p[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, f"{fps[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(300)] + ["Été", "A B", " x"]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one two three four"), (4, "one two three four"), (None, "ONE two\x0bthree four"), (5, "x " * 9000)]
    for i in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 400))]
        rows.append((10 + 3 * i, " ".join(base)))
        near = list(base)
        near[rng.randrange(len(near))] = "changed"
        rows.append((11 + 3 * i, " ".join(near)))
        rows.append((12 + 3 * i, "  ".join(base).upper() + "\n"))
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, "y") for d, t in rows], "doc_id long, text string, component_id int, fp string")
    got = [tuple(r) for r in simhash_components(docs).collect()]
    assert sorted(got, key=repr) == brute_components(rows)


def test_spark_hash_agrees(spark):
    text = "one two three four"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] == fingerprint(text.encode(), 4)


def test_chunked_shards_and_masks_lose_nothing(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    vals = {int(b) for b in base}
    for b in base[:25]:
        for _ in range(12):
            x = int(b) & (2**64 - 1)
            for k in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(k)
            vals.add(x - 2**64 if x >> 63 else x)
    vals = sorted(vals)
    want = {(a, b) for a in vals for b in vals if b < a and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}

    def roots(edges):
        p = {v: v for v in vals}

        def find(v):
            while p[v] != v:
                v = p[v]
            return v

        for a, b in edges:
            x, y = find(a), find(b)
            p[max(x, y)] = min(x, y)
        return [find(v) for v in vals]

    df = spark.createDataFrame([(v,) for v in vals], "fp long")
    for cfg in (SimHashConfig(shard_limit=3), SimHashConfig(wanted_shard=0), SimHashConfig()):
        got = [tuple(r) for r in near_edges(df, cfg).collect()]
        assert roots(got) == roots(want)
    assert len(agreeing_masks(10, 4, 64)) == 5 and len(agreeing_masks(10**7, 4, 64)) == 15


def test_bk_forest_finds_every_pair():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**64, 300, dtype=np.uint64)
    fp[150:] = fp[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64))
    shard = np.sort(rng.integers(0, 3, 300))
    q, t = BkForest(fp, shard).near(fp, shard, 6)
    want = {(i, j) for i in range(300) for j in range(300) if shard[i] == shard[j] and int(np.bitwise_count(fp[i] ^ fp[j])) <= 6}
    assert set(zip(q.tolist(), t.tolist())) == want


def test_empty_table(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []

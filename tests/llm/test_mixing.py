import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tapeloom.llm.mixing import MixConfig, apportion, mix_documents, mix_plan, source_targets


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, stop at the cap, share the rest again until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, live = sum(sizes.values()), {}, set(order)
    while live:
        total = sum(w[s] for s in live)
        over = {s for s in live if left * w[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in live}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in over)
        live -= over
    return out


def brute_quota(votes, seats):
    got = Counter()
    for _ in range(seats):
        got[max(sorted(votes), key=lambda i: votes[i] / (2 * got[i] + 1))] += 1
    return got


def corpus(seed, n):
    rng = random.Random(seed)
    names = ["a", "b", "é", "z", None, "big", "B"]
    rows = []
    for i in range(n):
        s = "big" if rng.random() < 0.35 else rng.choice(names)
        k = rng.choice([0, 1, 5, 40, 300]) if s != "z" else 3
        rows.append((i, rng.choice(["", " ", "\n"]) + "".join("w%d%s" % (j, rng.choice([" ", "\n", "  "])) for j in range(k)), s))
    return rows + [(None, "no id here", "a"), (None, None, "b"), (7, "twice the same", "a"), (7, "twice the same", "a")]


def test_targets_and_quotas_match_brute_force(spark):
    rng = random.Random(1)
    for sizes in ({"a": 10, "b": 1000, None: 3, "c": 0}, {chr(97 + i): rng.randint(0, 500) for i in range(12)}, {"x": 5}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in source_targets(df, MixConfig()).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in want)
    for k in range(6):
        votes = {i: rng.choice([0, 1, 7, 50, rng.randint(1, 5000)]) for i in range(15)}
        seats = rng.choice([1, 7, 60, 1000])
        if not any(votes.values()):
            continue
        df = spark.createDataFrame([(i, v, seats) for i, v in votes.items()], "item long, votes long, seats long")
        got = {r.item: r.quota for r in apportion(df, "item", "votes", "seats", []).collect()}
        assert got == {i: brute_quota(votes, seats)[i] for i in votes}


def test_mix_comes_near_targets_and_keeps_the_limits(spark):
    rows = corpus(5, 900)
    docs = spark.createDataFrame([(i, t, s, 1, 2.0) for i, t, s in rows], "doc_id long, text string, source string, size int, target double")
    for cfg in (MixConfig(), MixConfig(shard_words=2000)):
        plan = mix_plan(docs, cfg)
        got = plan.collect()
        assert sorted((r.doc_id is None, r.doc_id, r.size) for r in got) == sorted((i is None, i, len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))) for i, t, _ in rows)
        assert all(0 <= r.taken <= 3 * r.size for r in got)
        sizes = Counter()
        for _, t, s in rows:
            sizes[s] += len((t or "").split())
        want = brute_targets(sizes)
        by_target = Counter()
        for r in got:
            by_target[round(r.target, 6)] += r.taken
        for t, k in by_target.items():
            n = sum(round(x, 6) == t for x in want.values())
            assert abs(k - n * t) <= max(0.01 * n * t, 40)
        assert sorted(map(repr, got)) == sorted(map(repr, mix_plan(docs.repartition(5), cfg).collect()))


def test_mixed_rows_hold_the_taken_words(spark):
    rows = corpus(6, 300)
    docs = spark.createDataFrame([(i, t, s, len(t or "")) for i, t, s in rows], "doc_id long, text string, source string, n_chars long")
    cfg = MixConfig(min_blocks=50)
    want = Counter()
    for r in mix_plan(docs, cfg).collect():
        want[r.doc_id] += r.taken
    mixed = mix_documents(docs, cfg)
    assert mixed.columns == docs.columns and mixed.dtypes == docs.dtypes
    got, texts = Counter(), {(i, t) for i, t, _ in rows}
    for r in mixed.collect():
        got[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
        assert any(r.text in t for i, t in texts if i == r.doc_id and t)
    assert +got == +want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_plan(docs).collect() == [] and mix_documents(docs).collect() == []
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], docs.schema)
    assert sorted(map(tuple, mix_plan(blank).select("doc_id", "taken", F.round("target")).collect())) == [(1, 0, 0.0), (2, 0, 0.0)]

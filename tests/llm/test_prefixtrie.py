import hashlib
import random
import zlib

from tapeloom.llm import prefixtrie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuild(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            d = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, d, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), [])
        out[c] = tuple(base[:h]) + tuple(turns[h:])
    return out


def brute(rows):
    seqs = rebuild(rows)
    members, ends = {}, {}
    for c, s in seqs.items():
        ends.setdefault(s, []).append(c)
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, m in members.items():
        size = len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] = saved.get(p[:d], 0) + (len(m) - 1) * size
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
    text = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], text(p)) for p, m in members.items())


def run(spark, rows, cfg):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA + ", path string, shard int")
    return sorted((tuple(r) for r in pt.conversation_trie(df.repartition(3), cfg).collect()), key=lambda r: (r[0], r[1]))


def conversations(rng, n, words, longest=9):
    rows = []
    for c in range(n):
        hot = rng.random() < 0.35
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, "user" if t % 2 == 0 else "bot", "hot" if hot and t < 3 else rng.choice(words)))
    return rows


FEW = pt.TrieConfig(shard_turns=7, chunk_ids=3)


def test_matches_brute_force_however_many_shards(spark):
    rng = random.Random(11)
    rows = conversations(rng, 150, ["a", "b", "é", "c" * 30, ""])
    rows += [(c, t, "user", "the same long talk") for c in range(300, 330) for t in range(12)]  # copies
    rows += [(400, t, "user", f"only {t}") for t in range(60)] + [(405, t, "user", f"only {t}") for t in range(61)]
    want = brute(rows)
    assert run(spark, rows, pt.TrieConfig()) == want
    assert run(spark, rows, FEW) == want
    assert run(spark, rows, pt.TrieConfig(shard_turns=7, splitter_turns=2, max_shards=9)) == want


def test_nulls_ties_negative_and_missing(spark):
    rows = [
        (7, None, None, None), (7, 1, "user", "x"), (7, 1, "bot", "y"), (7, 1, "bot", "y"), (5, 0, "", ""), (-3, 2, "user", "neg"), (-3, None, "user", "first"),
        (None, 0, "user", "no conversation"), (23, 0, "user", "base is absent"), (101, 0, "user", "x"), (102, 0, "user", "long " * 30000), (-5, 1, "bot", "y"),
    ]
    assert run(spark, rows, pt.TrieConfig()) == brute(rows) == run(spark, rows, FEW)
    assert run(spark, [], FEW) == []
    assert run(spark, rows[:1], FEW) == brute(rows[:1])


def test_conversations_left_without_turns(spark):
    short = [c for c in range(1, 200) if zlib.crc32(str(c).encode()) % 9 > 1 and c % 5][:20]
    rows = [(c, 0, "user", f"t{c}") for c in short]
    got = run(spark, rows, FEW)
    assert got == brute(rows) and len(got) == 1 and got[0][3] == 20


def test_skeleton_is_the_proper_prefixes_of_the_splitters():
    rng = random.Random(2)
    turn = lambda x: hashlib.md5(str(x).encode()).hexdigest()
    paths = sorted({"".join(turn(rng.randint(0, 2)) for _ in range(rng.randint(0, 6))) for _ in range(200)})
    held = pt.skeleton([(p, [1] * (len(p) // 32)) for p in paths], 20, pt.TrieConfig())
    assert held.splitters == sorted(held.splitters) and len(held.splitters) > 5
    assert len(held.rows) == len({s[:i] for s in held.splitters for i in range(0, len(s), 32)})
    shard = {p: sum(s <= p for s in held.splitters) for p in paths}
    for prefix in {p[:i] for p in paths for i in range(0, len(p) + 1, 32)}:
        if len({shard[p] for p in paths if p.startswith(prefix)}) > 1:
            assert any(s.startswith(prefix) and s != prefix for s in held.splitters)


def test_ends_of_a_large_group_are_hashed_in_order(spark):
    ids = list(range(-50, 400))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([("k" if c % 3 else "q", c) for c in ids], "k string, conv_id long").repartition(5)
    got = {r.k: r.ends for r in pt.ends_digest(df, pt.TrieConfig(chunk_ids=7)).collect()}
    for k in "kq":
        want = ",".join(str(c) for c in sorted(ids) if ("k" if c % 3 else "q") == k)
        assert got[k] == hashlib.sha256(want.encode()).hexdigest()

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tapeloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """nodes -> (last hash, [[siblings and slot per level] per node])"""
    paths, of = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for j, at in enumerate(of):
            run, slot = runs[at // fanout], at % fanout
            paths[j].append((run[:slot], run[slot + 1 :]))
        nodes, of = [sha("".join(r)) for r in runs], [at // fanout for at in of]
    return nodes[0], paths


def brute(rows, fanout=3):
    none_first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=none_first)
    subs = {}
    for s in order:
        groups[s].sort(key=lambda r: (none_first(r[0]), leaf(r)))
        subs[s] = climb([leaf(r) for r in groups[s]], fanout)
    root, tops = climb([subs[s][0] for s in order], fanout)
    out = []
    for k, s in enumerate(order):
        for r, path in zip(groups[s], subs[s][1]):
            path = path + tops[k]
            text = r[4]
            if zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            h = leaf((*r[:4], text))
            for before, after in path:
                h = sha("".join(before) + h + "".join(after))
            out.append((r[0], leaf(r), subs[s][0], root, sha("".join("".join(b + a) for b, a in path)), h, h == root))
    return sorted(out, key=repr)


def rows_of(rng, n, sources):
    text = lambda: rng.choice([None, "", "\n", "a\nb\n", "é\n日本", "plain", "x" * 40000 + "\n"])
    return [(i, rng.choice(sources), rng.choice([None, "en", ""]), rng.choice([None, 0, 77]), text()) for i in range(n)]


def run(spark, rows, cfg=merkle.ManifestConfig()):
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA + ", leaf string, g int")
    return sorted(map(tuple, merkle.verify_tampered(df.repartition(3), cfg).collect()), key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    hot = ["a"] * 12 + ["b", "B", None, "", "é", "z9", "lone"]
    rows = rows_of(rng, 140, hot) + [(500, "only one", None, 1, "t\n")]
    got = run(spark, rows)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


def test_null_ids_repeated_rows_and_other_fanouts(spark):
    rng = random.Random(4)
    rows = rows_of(rng, 30, ["a", None]) + [(None, "a", "en", 1, "q\n"), (None, "a", "en", 1, "q\n"), (7, "a", None, None, "again"), (7, "a", None, None, "again")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, merkle.ManifestConfig(fanout=4)) == brute(rows, 4)


def test_one_row_one_source_and_none(spark):
    rows = [(1, None, None, None, None)]
    got = run(spark, rows)
    assert got == brute(rows) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha("")
    rows = [(i, "s", "en", i, f"t{i}\n") for i in range(9)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_proofs_fold_to_the_root_and_name_each_sibling(spark):
    rows = rows_of(random.Random(5), 60, ["a", "b"])
    df = spark.createDataFrame(rows, SCHEMA)
    built = merkle.manifest(df.select("doc_id", "source", merkle.leaf_hash().alias("leaf"), "lang"))
    assert built.where(merkle.fold("leaf", "path") != F.col("root")).count() == 0
    assert built.count() == 60 and "lang" in built.columns
    changed = built.withColumn("leaf", F.sha2("leaf", 256))
    assert changed.where(merkle.fold("leaf", "path") == F.col("root")).count() == 0

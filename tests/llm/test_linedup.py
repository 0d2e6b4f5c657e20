import random

from tapeloom.llm.linedup import dedup_lines


def brute(rows):
    """rows (doc_id, text), unique ids -> {doc_id: (n_lines, n_removed, text)}"""
    first, seen, places = {}, {}, {}
    for d, t in sorted(rows):
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            h = tuple(lines[p : p + 3])
            if any(x.strip(" \t\n\x0b\x0c\r") for x in h):
                first.setdefault(h, (d, p))
                seen[h] = seen.get(h, 0) + 1
                places.setdefault(d, []).append((p, h))
    out = {}
    for d, t in rows:
        lines = t.split("\n")
        gone = set()
        for p, h in places.get(d, []):
            fd, fp = first[h]
            if seen[h] > 1 and not (fd == d and p < fp + 3):
                gone |= {p, p + 1, p + 2}
        out[d] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(8)
    common = ["l%d" % i for i in range(6)] + ["", " ", "é"]
    rows = [(i, "\n".join(rng.choice(common) if rng.random() < 0.6 else "own %d %d" % (i, k) for k in range(rng.randint(0, 40)))) for i in range(80)]
    rows += [(100, "a\na\na\na\na"), (101, "b\nb\nb\nb\nb\nb\nb"), (102, "a\na\na"), (103, "\n\n\n\n"), (104, "x y z"), (105, "")]
    docs = spark.createDataFrame([(d, t, 5, "q") for d, t in rows], "doc_id long, text string, p int, starts string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in dedup_lines(docs).collect()}
    assert got == brute(rows)
    assert got[100][1] == 0 and got[101][1] == 4 and got[102][2] == ""


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\n\n"), (1, "a\nb\nc\n\n"), (None, "q\na\nb\nc"), (2, None), (1, "other")], "doc_id long, text string")
    got = sorted(map(tuple, dedup_lines(docs).collect()), key=repr)
    want = [(1, 5, 3, "\n"), (1, 5, 5, ""), (1, 1, 0, "other"), (2, 0, 0, None), (None, 4, 0, "q\na\nb\nc")]
    assert got == sorted(want, key=repr)
    assert dedup_lines(docs.limit(0)).collect() == []

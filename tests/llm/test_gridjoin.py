import numpy as np

from tapeloom.llm.gridjoin import GridJoinConfig, grid_join, near_boxes


def brute(rows, c=0.9):
    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    n = len(rows)
    p, links = list(range(n)), [0] * n

    def find(i):
        while p[i] != i:
            i = p[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if usable(a) and usable(b) and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= c:
                    links[i] += 1
                    links[j] += 1
                    p[find(i)] = find(j)
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], links[i], least, rows[i][0] is not None and rows[i][0] == least))
    return sorted(out, key=repr)


def near(rng, v, cos):
    r = rng.standard_normal(len(v))
    u = v / np.linalg.norm(v)
    r -= (r @ u) * u
    r /= np.linalg.norm(r)
    return (cos * u + np.sqrt(1 - cos * cos) * r) * rng.uniform(0.1, 10)


def vectors():
    rng = np.random.default_rng(11)
    rows = []
    for i in range(120):
        v = rng.standard_normal(16)
        rows.append((10 * i, v.tolist()))
        for k, cos in enumerate((0.9001, 0.8999, 0.95, 0.99)):
            if rng.random() < 0.6:
                rows.append((10 * i + k + 1, near(rng, v, cos).tolist()))
    hot = rng.standard_normal(16)
    rows += [(5000 + i, hot.tolist()) for i in range(40)] + [(6000 + i, near(rng, hot, 0.97).tolist()) for i in range(60)]
    rows += [(7000, None), (7001, []), (7002, [0.0] * 16), (7003, [float("nan")] + [1.0] * 15), (7004, [None] + [1.0] * 15), (7005, [float("inf")] * 16)]
    rows += [(None, hot.tolist()), (5000, hot.tolist()), (7006, hot.tolist()[:15]), (7007, [1.0, 0.0, 0.0, 0.0]), (7008, [9.0, 3.0, 3.0, 1.0]), (7009, [1e200, 0.0, 0.0, 0.0])]
    return rows


def test_matches_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, tile int")
    want = brute([(i, v) for i, v in rows])
    got = {}
    for cfg in (GridJoinConfig(tile=32, tiles_per_task=2), GridJoinConfig(dims=2)):
        got[cfg] = sorted(map(tuple, grid_join(df, cfg).collect()), key=repr)
        fix = [w for w in want if w[0] not in (7007, 7008, 7009)]
        assert [g for g in got[cfg] if g[0] not in (7007, 7008, 7009)] == fix
        tied = {g[0]: g[1] for g in got[cfg]}
        assert (tied[7007], tied[7008], tied[7009]) == (2, 2, 2)  # a cosine of exactly 0.9 links, whatever the scale


def test_unlinkable_and_empty(spark):
    df = spark.createDataFrame([(2, None), (1, [0.0]), (None, None)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, grid_join(df).collect()), key=repr) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, False)]
    assert grid_join(df.limit(0)).collect() == []


def test_far_boxes_are_skipped():
    low, high = np.array([[0.0], [10.0]]).tobytes(), np.array([[1.0], [11.0]]).tobytes()
    assert [x.tolist() for x in near_boxes(low, high, low, high, 1, 4.0)] == [[0, 1], [0, 1]]

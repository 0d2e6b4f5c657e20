"""The distributed ordering helpers against plain Python, with heavily skewed groups."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions import ordered as o
from tapeloom.functions.session_scan import first_touch, greedy


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randint(0, 3)}", i, float(rng.randint(0, 40)), rng.randint(1, 9)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "g string, i long, v double, w long").repartition(7)


def test_row_index_and_running_sum(skewed):
    rows, df = skewed
    got = o.ordered_prefix(df, ["v", "i"], ["g"], {"cum": "w"}).toPandas()
    want = pd.DataFrame(rows, columns=["g", "i", "v", "w"]).sort_values(["g", "v", "i"])
    want["row_index"] = want.groupby("g").cumcount() + 1
    want["cum"] = want.groupby("g")["w"].cumsum()
    m = got.merge(want, on=["g", "i"])
    assert len(m) == 3000
    assert (m["row_index_x"] == m["row_index_y"]).all() and (m["cum_x"] == m["cum_y"]).all()


def test_average_ranks_match_pandas(skewed):
    rows, df = skewed
    got = o.average_ranks(df, "v", ["g"]).toPandas().sort_values("i")
    want = pd.DataFrame(rows, columns=["g", "i", "v", "w"]).sort_values("i")
    assert np.allclose(got["rank"].to_numpy(), want.groupby("g")["v"].rank().to_numpy())


def test_quantiles_match_numpy(skewed):
    rows, df = skewed
    got = {r["g"]: r for r in o.exact_quantiles(df, "v", {"a": 0.13, "b": 0.5, "c": 0.95}, ["g"]).collect()}
    for g, part in pd.DataFrame(rows, columns=["g", "i", "v", "w"]).groupby("g"):
        assert np.allclose([got[g]["a"], got[g]["b"], got[g]["c"]], np.quantile(part["v"], [0.13, 0.5, 0.95]))


def test_carry_equals_one_window(skewed):
    _, df = skewed
    df = df.withColumn("x", F.when(F.col("v") > 30, F.col("v"))).withColumn("chunk", F.floor(F.col("i") / 100))
    got = o.carry(df, ["g"], "chunk", ["i"], last={"l": "x"}, sums={"s": "w"}, maxes={"m": "v"})
    got = o.carry(got, ["g"], "chunk", ["i"], last={"lp": "x"}, include_current=False)
    w = Window.partitionBy("g").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    p = Window.partitionBy("g").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    both = got.select("*", F.last("x", True).over(w).alias("l2"), F.sum("w").over(w).alias("s2"), F.max("v").over(w).alias("m2"), F.last("x", True).over(p).alias("lp2"))
    bad = both.where("not (l <=> l2 and s = s2 and m = m2 and lp <=> lp2)")
    assert bad.count() == 0 and both.count() == 3000


def test_halo_frames_equal_whole_frames(skewed):
    _, df = skewed
    rows = o.with_row_halo(df, ["g"], ["i"], before=12, after=5, chunk_rows=50)
    w = Window.partitionBy("g", "chunk").orderBy("row_index")
    got = rows.withColumn("s", F.sum("w").over(w.rowsBetween(-12, 5))).where("not is_halo").select("g", "i", "s")
    whole = df.withColumn("s", F.sum("w").over(Window.partitionBy("g").orderBy("i").rowsBetween(-12, 5))).select("g", "i", "s")
    assert got.count() == 3000 and got.exceptAll(whole).count() == 0


def test_greedy_and_first_touch_against_loops():
    rng = np.random.default_rng(5)
    for _ in range(50):
        start = np.sort(rng.integers(0, 60, 25))
        release = start + rng.integers(0, 9, 25)
        for strict in (False, True):
            want, busy = [], None
            for i in range(25):
                if busy is None or (start[i] > busy if strict else start[i] >= busy):
                    want.append(i)
                    busy = release[i]
            assert greedy(start, release, strict) == want
        x = rng.normal(size=40)
        x[rng.random(40) < 0.1] = np.nan
        lvl = x + 0.5
        got = first_touch(x, lvl, np.zeros(40), np.full(40, 7.0), "ge")
        for t in range(40):
            hit = [k for k in range(1, 8) if t + k < 40 and x[t + k] >= lvl[t]]
            assert got[t] == (hit[0] if hit and not np.isnan(lvl[t]) else -1)


def test_prefix_fold_is_the_fold_of_all_earlier_values(spark):
    from tapeloom.functions.ordered import prefix_fold

    rows = [(k, i, f"{k}{i}.") for k, n in (("a", 1), ("b", 4), ("c", 70), (None, 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, v string").repartition(3).withColumn("s", F.struct("v"))
    for fan_in in (2, 3, 64):
        out = prefix_fold(df, ["k"], "i", "s", lambda a, b: F.struct(F.concat(a["v"], b["v"]).alias("v")), F.struct(F.lit("").alias("v")), fan_in=fan_in)
        got = {(r.k, r.i): r.before.v for r in out.collect()}
        assert got == {(k, i): "".join(v for q, j, v in rows if q == k and j < i) for k, i, _ in rows}
    assert prefix_fold(df.limit(0), ["k"], "i", "s", lambda a, b: a, F.struct(F.lit("").alias("v"))).collect() == []


def test_first_touch_equals_a_plain_search():
    from tapeloom.functions.session_scan import first_touch

    compare = {"ge": np.greater_equal, "le": np.less_equal, "gt": np.greater, "lt": np.less}
    rng = np.random.default_rng(0)
    for t in range(400):
        n = int(rng.integers(1, 40))
        draw = lambda low, high, none: np.where(rng.random(n) < none, np.nan, rng.integers(low, high, n).astype(float))  # noqa: E731, B023
        v, level, base, limit, op = draw(0, 12, 0.15), draw(-1, 14, 0.1), draw(0, 5, 0.1), draw(-1, 50, 0.1), list(compare)[t % 4]
        want = np.full(n, -1.0)
        for i in np.flatnonzero(~np.isnan(level) & ~np.isnan(base) & ~np.isnan(limit)):
            start = i + int(base[i])
            want[i] = next((k for k in range(1, int(limit[i]) + 1) if start + k < n and compare[op](v[start + k], level[i])), -1)
        assert (first_touch(v, level, base, limit, op) == want).all()


def test_searches_that_never_hit_grow_no_faster_than_n_log_n():
    import time

    from tapeloom.functions.session_scan import first_touch

    took = []
    for n in (40_000, 320_000):
        best = 9.0
        for _ in range(3):
            t = time.perf_counter()
            assert (first_touch(np.full(n, 5.0), np.full(n, 1.0), np.zeros(n), np.full(n, 1e9), "le") == -1).all()
            best = min(best, time.perf_counter() - t)
        took.append(best)
    assert took[1] < 30 * took[0] and took[1] < 5


def test_fill_ranges_gives_the_last_value_before_each_row(spark):
    from tapeloom.functions.ordered import fill_ranges

    rng = random.Random(8)
    rows, seq = [], 0
    for g, n in (("hot", 400), ("b", 3), (None, 40), ("c", 1), ("dry", 60), ("e", 25)):
        for _ in range(n):
            x = None if g == "dry" or rng.random() < 0.9 else rng.randint(0, 9)
            rows.append((g, rng.choice(["x", None]), seq, x, None if rng.random() < 0.6 else f"v{seq}"))
            seq += 1
    df = spark.createDataFrame(rows, "g string, k string, i long, x long, s string")
    want = {}
    for by in (["g"], ["g", "k"]):
        held = {}
        for g, k, i, x, s in rows:
            key = tuple({"g": g, "k": k}[c] for c in by)
            want[len(by), i] = (held.get((key, "x")), held.get((key, "s")))
            for c, v in (("x", x), ("s", s)):
                if v is not None:
                    held[key, c] = v
    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for parts, size in ((1, "10000"), (13, "7"), (40, "1")):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            for by in (["g"], ["g", "k"]):
                out = fill_ranges(df.repartition(5), by, ["i"], {"last_x": "x", "last_s": "s"})
                assert out.columns == [*df.columns, "last_x", "last_s"]
                assert {r.i: (r.last_x, r.last_s) for r in out.collect()} == {i: want[len(by), i] for i in range(len(rows))}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert fill_ranges(df.limit(0), ["g"], ["i"], {"last_x": "x"}).collect() == []


def test_fill_ranges_spreads_one_busy_hour(spark):
    from tapeloom.functions.ordered import fill_ranges

    df = spark.range(20_000).select(F.lit("hot").alias("g"), (F.col("id") % 1000).alias("i"), "id", F.when(F.col("id") % 7 == 0, F.col("id")).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = fill_ranges(df, ["g"], ["i", "id"], {"last_x": "x"}).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) == 4 and max(r["count"] for r in out) < 9_000


def test_ranks_in_one_sort_average_ties(spark):
    from tapeloom.functions.ordered import ranks_in_one_sort

    rng = np.random.default_rng(5)
    rows = [(g, int(i), float(rng.integers(0, k))) for g, n, k in (("a", 300, 4), ("b", 40, 1000), (None, 25, 3), ("c", 1, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i long, v double")
    want = pd.DataFrame(rows, columns=["g", "i", "v"])
    want["g"] = want["g"].fillna("none")
    want["r"] = want.groupby("g")["v"].rank(method="average")
    want = {(g, i): r for g, i, r in zip(want["g"], want["i"], want["r"])}
    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for parts, size in ((1, "10000"), (9, "7"), (30, "1")):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {(r.g or "none", r.i): r["rank"] for r in ranks_in_one_sort(df.repartition(4), ["g"], "v").collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranks_in_one_sort(df.limit(0), ["g"], "v").collect() == []


def test_scan_of_many_sessions_in_one_block_equals_one_at_a_time(spark):
    """Windows, touches, lookups and picks end with their session, whatever block it is scanned in."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from tapeloom.functions import session_scan as sc
    from tapeloom.operators.fills import LastGood, NextGood

    rng = np.random.default_rng(7)
    rows = [(k, i, float(rng.integers(0, 9)), float(rng.integers(0, 9)), i + int(rng.integers(0, 4)), bool(rng.random() < 0.4)) for k in range(40) for i in range(int(rng.integers(1, 9)))]
    df = spark.createDataFrame(rows, "k int, t long, v double, w double, until long, good boolean").withColumn("v", F.when(F.col("v") < 8, F.col("v")))
    steps = [
        sc.RollingMedian("med", "v", 3, 2), sc.FirstTouch("hit", "v", "w", "ge", 4), sc.At("there", "w", "hit"), sc.RowsUntil("room", "t", "until"),
        sc.FirstTouch("low", "v", "w", "lt", "room", "hit"), NextGood("nxt", "good", "hit"), LastGood("last", "good", "room"),
        sc.Rolling("top", ("v",), 2, lambda x: x.max(axis=1)), sc.GreedyPick("kept", "hit"), sc.GreedyPick("strict", "room", True),
    ]
    got = {(r.k, r.t): tuple(r)[6:] for r in sc.scan_sessions(df, ["k"], "t", steps).collect()}
    want = {}
    for k in range(40):
        own = pa.table({n: [r[j] for r in sorted(map(tuple, df.where(F.col("k") == k).collect()), key=lambda r: r[1])] for j, n in enumerate(df.columns)}) if k % 8 == 0 else None
        if own is None:
            continue
        one = sc.Session(own, np.zeros(1, np.int64))
        for s in steps:
            one.append(s.out, s(one), sc.to_arrow_type(s.dtype))
        want |= {(k, r["t"]): tuple(r[s.out] for s in steps) for r in one.rows.to_pylist()}
    assert want and {x: got[x] for x in want} == want
    blocks = spark.createDataFrame([(k,) for k in range(3000)], "k int").repartition(1).select("k", F.lit(0).alias("t"), F.lit(1.0).alias("v"))
    calls = spark.sparkContext.accumulator(0)
    sc.scan_sessions(blocks, ["k"], "t", [sc.Derive("twice", lambda f: (calls.add(1), 2 * f["v"])[1], sc.T.DoubleType())]).collect()
    assert calls.value <= 8  # once a block, not once a session


def test_cross_ranks_agree_between_blocks_of_dates_and_the_sort(spark):
    """Ties, nulls, a date without a value, a null date; dates beyond a block's rows go through the sort."""
    from tapeloom.operators.xsec import cross_ranks

    rng = random.Random(11)
    rows = [(f"P{i}", d, rng.choice([None, 1.0, 2.0, rng.random()]), rng.choice([0.5, rng.random()]) if d != 3 else None) for d in (None, 1, 2, 3, 4) for i in range(20 + 30 * (d == 2))]
    df = spark.createDataFrame(rows, "symbol string, date int, a double, b double")
    want = {}
    for s, d, *values in rows:
        out = []
        for k, v in enumerate(values):
            same = [r[2 + k] for r in rows if r[1] == d and r[2 + k] is not None]
            out.append(None if v is None else round((sum(x < v for x in same) + (sum(x == v for x in same) + 1) / 2) / len(same), 9))
        want[s, d] = out
    for block in (1 << 20, 30):
        plan = cross_ranks(df, ["a", "b"], block_rows=block)
        got = {(r.symbol, r.date): [None if x is None else round(x, 9) for x in (r.a, r.b)] for r in plan.collect()}
        assert got == want
    assert "Generate" not in cross_ranks(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()

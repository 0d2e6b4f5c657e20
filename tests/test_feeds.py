"""Staleness, silence and change feeds, published tables and the merge sink."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tapeloom.config import StalenessConfig
from tapeloom.functions.sorted_window import SortedWindow, sliding_quantiles
from tapeloom.operators import bars as b
from tapeloom.operators import orders as od
from tapeloom.sources import files as fs
from tapeloom.sources import published as pub
from tapeloom.streaming import feeds, jobs
from tapeloom.streaming import staleness as st

T0 = datetime(2024, 1, 2, 15, 0)
CFG = StalenessConfig()


def at(s):
    return T0 + timedelta(seconds=s)


def test_sliding_quantiles_equal_sorted_windows():
    rng = np.random.default_rng(3)
    for n, span in ((1, 5), (300, 40), (300, 0), (400, 10_000)):
        t = np.sort(rng.integers(0, 1000, n))
        v = np.where(rng.random(n) < 0.2, np.nan, rng.integers(0, 20, n).astype(float))
        got, left = sliding_quantiles(t, v, span, (0.0, 0.5, 0.95, 1.0))
        for i in range(n):
            w = [v[j] for j in range(i + 1) if t[j] >= t[i] - span and v[j] == v[j]]
            want = np.quantile(w, (0.0, 0.5, 0.95, 1.0)) if w else np.full(4, np.nan)
            assert np.allclose(got[i], want, equal_nan=True)
        cut = n // 2  # the same in two parts
        a, held = sliding_quantiles(t[:cut], v[:cut], span, (0.5,))
        c, end = sliding_quantiles(t[cut:], v[cut:], span, (0.5,), held)
        assert np.allclose(np.concatenate([a, c])[:, 0], got[:, 1], equal_nan=True) and end == left
    assert SortedWindow().quantile(0.5) != SortedWindow().quantile(0.5)


def arrivals(spark, rows):
    return spark.createDataFrame([(s, i, at(recv), at(stamp)) for i, (s, stamp, recv) in enumerate(rows)], "symbol string, seq long, recv_ts timestamp, quote_ts timestamp")


def streamed(spark, rows, files=2, cfg=CFG):
    out = jobs.run_to_end(jobs.stream_quote_gaps(jobs.replay(arrivals(spark, rows), "recv_ts", files), cfg))
    return {r.seq: r for r in out.collect()}


def test_gap_percentiles_roll_and_forget(spark):
    rows = [("X", 2 * i, 2 * i) for i in range(11)] + [("X", 60, 60)]  # ten gaps of 2 s, then an outage
    rows += [("Y", 0, 0), ("Y", 50, 50)] + [("Y", 450 + i, 450 + i) for i in range(5)]
    rows += [("Z", 10, 10), ("Z", 5, 11), ("Z", 12, 12.5)]  # an older stamp arrives late
    got = streamed(spark, rows)
    assert got[0].gap_s is None and got[0].gap_p50 is None and got[0].status == "ok"
    assert got[10].gap_p50 == 2.0 and got[10].gap_p95 == 2.0 and got[11].gap_p95 > 2.0
    y = [got[i] for i in range(12, 19)]
    assert y[1].gap_p50 == 50.0 and y[2].gap_p50 == 400.0 and y[-1].gap_p50 == 1.0 and y[-1].gap_p95 < 350
    z = [got[i] for i in range(19, 22)]
    assert z[1].gap_s is None and z[1].age_s == 1.0 and z[1].newest == at(10) and z[2].gap_s == 2.0 and z[2].age_s == 0.5


def test_streamed_gaps_equal_the_batch_however_the_rows_arrive(spark):
    rng = random.Random(2)
    rows, recv = [], 0.0
    for _ in range(400):
        recv += rng.choice([0.5, 1, 3, 40, 200])
        rows.append((rng.choice("AB"), recv - rng.choice([0, 0, 1, 70, 250]), recv))
    batch = {r.seq: r for r in b.quote_gaps(arrivals(spark, rows), 300, 600).collect()}
    for files in (1, 4):
        live = streamed(spark, rows, files)
        assert live.keys() == batch.keys()
        for k, x in live.items():
            assert [x.gap_s, x.gap_p50, x.gap_p95] == pytest.approx([batch[k].gap_s, batch[k].gap_p50, batch[k].gap_p95]) and x.newest == batch[k].newest
            age = (x.recv_ts - max(t for t in (x.newest, x.quote_ts) if t)).total_seconds()
            assert x.age_s == pytest.approx(age) and x.status == ("kill" if age > 180 else "pause" if age > 60 else "ok")


def test_wide_windows_reach_over_several_chunks(spark):
    rows = [("A", 100.0 * i, 100.0 * i) for i in range(40)]
    wide = {r.seq: r.gap_p50 for r in b.quote_gaps(arrivals(spark, rows + [("A", 4000.0, 4000.0), ("A", 4001.0, 4001.0)]), 3000, 600).collect()}
    assert wide[39] == 100.0 and wide[41] == 100.0


def test_the_state_holds_no_more_than_the_window():
    held = []
    for k in range(50):
        t = np.arange(k * 100, (k + 1) * 100) * 1_000_000
        _, held = sliding_quantiles(t, np.ones(100), 30_000_000, (0.5,), held)
        assert len(held) <= 31


def silence(spark, rows, files, cfg=CFG, end=10_000):
    df = spark.createDataFrame([(f, at(s)) for f, s in rows] + [("~clock", at(end))], "feed string, ts timestamp")
    out = jobs.run_to_end(jobs.stream_silence(jobs.replay(df, "ts", files), cfg))
    return sorted((r.feed, r.ts, r.before, r.after) for r in out.collect())


def silence_by_hand(rows, end):
    out = []
    for feed in {f for f, _ in rows}:
        times = sorted(s for f, s in rows if f == feed)
        for a, nxt in zip(times, [*times[1:], None]):
            gap = (end if nxt is None else nxt) - a
            if gap > 60:
                out.append((feed, at(a + 60), "RUNNING", "PAUSED"))
                if gap > 180:
                    out.append((feed, at(a + 180), "PAUSED", "KILLED"))
                    break
                if nxt is not None:
                    out.append((feed, at(nxt), "PAUSED", "RUNNING"))
    return sorted(out)


def test_a_feed_that_stops_is_paused_then_killed_without_a_row(spark):
    rows = [("gone", 0), ("gone", 30)] + [("alive", 20 * i) for i in range(500)]
    got = silence(spark, rows, 3, end=9_985)
    assert [x for x in got if x[0] == "gone"] == [("gone", at(90), "RUNNING", "PAUSED"), ("gone", at(210), "PAUSED", "KILLED")]
    assert [x for x in got if x[0] == "alive"] == []


def test_silence_does_not_depend_on_the_micro_batches(spark):
    rng = random.Random(5)
    rows = []
    for f in "abcdef":
        t = 0.0
        for _ in range(25):
            t += rng.choice([5, 30, 60, 61, 100, 180, 181])
            rows.append((f, t))
    want = silence_by_hand(rows, 10_000)
    for files in (1, 5):
        assert silence(spark, rows, files) == want
    with pytest.raises(ValueError):
        st.Silence(CFG, "sundial")


def test_a_failing_write_leaves_the_old_snapshot(spark, tmp_path):
    path = str(tmp_path / "snap")
    with pytest.raises(ValueError):
        pub.read_published(spark, path)
    fs.replace_all(spark.createDataFrame([("a", 1.0), ("b", None)], "symbol string, score double"), path)
    bad = spark.createDataFrame([("c", 2.0)], "symbol string, score double").withColumn("symbol", F.when(F.col("score") > 1, F.raise_error(F.lit("boom"))).otherwise("x"))
    with pytest.raises(Exception, match="boom"):
        fs.replace_all(bad, path)
    assert sorted(map(tuple, pub.read_published(spark, path).collect())) == [("a", 1.0), ("b", 0.0)]
    fs.replace_all(spark.createDataFrame([("d", 4.0)], "symbol string, score double"), path)
    assert pub.versions(spark, path) == [1, 2] and pub.read_published(spark, path).first().symbol == "d"
    assert pub.read_published(spark, path, 1).count() == 2
    assert pub.drop_old(spark, path, 1) == 1 and pub.versions(spark, path) == [2] and pub.read_published(spark, path).count() == 1


def test_merge_rewrites_touched_buckets_and_ignores_replays(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "k long, seq long, v string")
    merge = lambda df, n: pub.merge_batch(df, path, ["k"], n, pub.upsert("seq"), buckets=4)
    assert merge(rows(*[(k, 1, f"a{k}") for k in range(20)]), 0)
    before = pub.entry(spark, path)
    assert merge(rows((3, 2, "new"), (3, 0, "late"), (99, 5, None)), 1)
    after = pub.entry(spark, path)
    assert sum(before["parts"][b] != after["parts"][b] for b in before["parts"]) <= 2
    table = {r.k: (r.seq, r.v) for r in pub.read_published(spark, path).collect()}
    assert table[3] == (2, "new") and table[99] == (5, None) and len(table) == 21 and table[4] == (1, "a4")
    assert not merge(rows((3, 9, "replayed")), 1) and not merge(rows((3, 9, "older")), 0)
    assert pub.entry(spark, path) == after
    assert merge(rows().limit(0), 2) and pub.read_published(spark, path).count() == 21


def test_orders_merged_in_any_cut_equal_the_batch(spark, tmp_path):
    rng = random.Random(9)
    ups = [(f"c{rng.randint(0, 30)}", "S", rng.choice(["buy", "sell"]), rng.randint(1, 9), "new", 10 * i) for i in range(60)]
    evs = [(f"c{rng.randint(0, 35)}", 10 * i + 3, *rng.choice([("canceled", None, None), (None, rng.randint(1, 4), 1.0 * i)])) for i in range(120)]
    o = spark.createDataFrame(ups, "client_order_id string, symbol string, side string, qty long, status string, seq long")
    e = spark.createDataFrame(evs, "client_order_id string, seq long, status string, fill_qty long, fill_price double")
    want = sorted(map(tuple, od.latest_orders(o, e).collect()))
    updates = o.unionByName(e, allowMissingColumns=True).withColumn("ts", F.timestamp_micros("seq"))
    for files in (1, 5):
        path, mark = str(tmp_path / f"o{files}"), str(tmp_path / f"m{files}")
        feeds.order_feed(jobs.replay(updates, "ts", files).drop("ts"), path, mark, 4).awaitTermination()
        assert sorted(map(tuple, od.orders_view(pub.read_published(spark, path)).collect())) == want


def test_status_feed_emits_changes_over_batches(spark):
    rows = [("e", 1, "RUNNING"), ("e", 2, "RUNNING"), ("e", 3, None), ("e", 4, None), ("e", 5, "HALTED"), ("f", 6, None), ("f", 7, "RUNNING")]
    df = spark.createDataFrame([(*r, at(r[1])) for r in rows], "engine string, seq long, status string, ts timestamp")
    want = [("e", 1, "RUNNING", None), ("e", 3, None, "RUNNING"), ("e", 5, "HALTED", None), ("f", 6, None, None), ("f", 7, "RUNNING", None)]
    for files in (1, 4):
        got = sorted(map(tuple, jobs.run_to_end(feeds.status_feed(jobs.replay(df, "ts", files))).collect()), key=lambda r: r[1])
        assert got == want


def test_corpus_errors_are_logged_and_retried(spark, tmp_path):
    wanted = spark.createDataFrame([("A", datetime(2024, 1, 2).date(), 1), ("B", datetime(2024, 1, 2).date(), 2)], "symbol string, date date, rank long")
    day = datetime(2024, 1, 2).date()
    good = spark.createDataFrame([("A", day, at(0), 1.0), ("A", day, at(1), 2.0)], "symbol string, session_date date, ts timestamp, n_trades double")
    bad = good.withColumn("n_trades", F.when(F.col("n_trades") > 1, F.raise_error(F.lit("no data"))).otherwise(F.col("n_trades")))
    manifest, store = str(tmp_path / "m"), str(tmp_path / "s")
    assert {(r.symbol, r.status, r.rows) for r in fs.build_missing(wanted, manifest, bad, store).collect()} == {("A", "error", 0), ("B", "error", 0)}
    assert {(r.symbol, r.status, r.rows) for r in fs.build_missing(wanted, manifest, good, store).collect()} == {("A", "ok", 2), ("B", "empty", 0)}
    assert fs.build_missing(wanted, manifest, good, store).count() == 0
    with pytest.raises(AnalysisException):
        fs.build_missing(wanted.withColumn("date", F.date_add("date", 1)), manifest, good.drop("ts"), store)


def test_status_feed_calls_python_once_a_bucket(spark):
    """Keys that share a bucket keep their own last value over micro-batches, nulls included."""
    from pyspark.sql import functions as F

    from tapeloom.operators.orders import status_changes
    from tapeloom.streaming import feeds, jobs

    rows = [(None if k == 5 else (1 << 60) + k, i, None if (k + i) % 7 == 0 else "ab"[(k * i // 3) % 2]) for i in range(60) for k in range(12)]
    df = spark.createDataFrame(rows, "engine long, seq long, status string")
    stream = jobs.replay(df.withColumn("ts", F.timestamp_micros("seq")), "ts")
    feed = feeds.status_feed(stream, buckets=2)
    assert [f.name for f in feed.schema.fields] == ["engine", "seq", "status", "previous"]
    got = sorted(map(tuple, jobs.run_to_end(feed).collect()), key=repr)
    # the window twin takes a first row without a status for no change; the feed publishes it
    firsts = {r for r in got if r[1] == 0 and r[2] is None and r[3] is None}
    want = sorted(map(tuple, status_changes(df.where("engine is not null")).select("engine", "seq", "status", "previous").collect()), key=repr)
    assert sorted((r for r in got if r[0] is not None and r not in firsts), key=repr) == want
    own = [r for r in rows if r[0] is None]
    changes = [(None, b[1], b[2], a[2]) for a, b in zip(own, own[1:]) if a[2] != b[2]]
    assert [r for r in sorted(got, key=lambda r: r[1]) if r[0] is None][1:] == changes

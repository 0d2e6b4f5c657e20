"""Labels, oracles, fills and sweeps against brute force and hand-made tapes."""

import random
from datetime import timedelta

import pytest
from helpers import OPEN, bars, random_walk
from pyspark.sql import functions as F

from tapeloom.config import BarrierConfig, FillConfig, OracleConfig, TrainConfig
from tapeloom.operators import fills as fl
from tapeloom.operators import labels as lb
from tapeloom.operators import oracle as orc

FEE = lambda px, n: 27.80e-6 * px + min(0.000166 * n, 8.30) / max(n, 1)
ENTRY = "symbol string, session_date date, ts timestamp, qty long, target_px double, stop_px double, deadline timestamp"


def brute_labels(raw, target, stop, timeout):
    out = []
    n = len(raw)
    for t in range(n):
        a, bid = raw[t].ask, raw[t].bid
        recent = sum(r.n_trades for r in raw[max(0, t - 10):t])
        if a is None or bid is None or recent < 1 or t + timeout >= n:
            out.append((None, None, None))
            continue
        win, loss = a + target + FEE(a, 1000), a - stop
        res = (0.0, float(timeout), None)
        for k in range(t + 1, t + timeout + 1):
            x = raw[k].bid
            if x is not None and x >= win:
                res = (1.0, float(k - t), None)
                break
            if x is not None and x <= loss:
                res = (-1.0, float(k - t), None)
                break
        else:
            x = raw[t + timeout].bid
            res = (0.0, float(timeout), None if x is None else x - a - FEE(x, 1000))
        out.append(res)
    return out


def test_barrier_labels_match_brute_force(spark):
    df = random_walk(spark, 300, 4)
    raw = df.orderBy("ts").collect()
    got = lb.barrier_labels(df, BarrierConfig(target_ps=0.05, stop_ps=0.04, timeout_rows=40)).orderBy("ts").collect()
    want = brute_labels(raw, 0.05, 0.04, 40)
    assert {g.label for g in got} == {None, 1.0, -1.0, 0.0}
    for g, (label, exit_s, edge) in zip(got, want):
        assert g.label == label and g.exit_s == exit_s
        assert (g.timeout_edge is None) == (edge is None) and (edge is None or g.timeout_edge == pytest.approx(edge))


def test_labels_react_inside_their_window(spark):
    flat = [5.0] * 30
    base = lb.barrier_labels(bars(spark, flat), BarrierConfig(timeout_rows=10)).orderBy("ts").collect()
    jump = flat[:15] + [6.0] + flat[16:]
    moved = lb.barrier_labels(bars(spark, jump, [x + 0.02 for x in flat]), BarrierConfig(timeout_rows=10)).orderBy("ts").collect()
    assert base[12].label == 0.0 and moved[12].label == 1.0 and moved[12].exit_s == 3.0
    assert moved[2].label == base[2].label == 0.0


def brute_taker(raw, h):
    ok = [r.bid is not None and r.ask is not None and r.bid > 0 for r in raw]
    t, out = 0, []
    while t + h < len(raw):
        edge = raw[t + h].bid - raw[t].ask - FEE(raw[t + h].bid, 1000) if ok[t] and ok[t + h] else -1
        if edge > 0:
            out.append((t, round(edge, 9)))
            t += h
        else:
            t += 1
    return out


def brute_maker(raw, h, w):
    ok = [r.bid is not None and r.ask is not None and r.bid > 0 for r in raw]
    n, t, out = len(raw), 0, []
    while t + h + w < n:
        step = t + 1
        if ok[t]:
            entry = raw[t].bid
            te = next((k for k in range(t + 1, t + 1 + w) if raw[k].low is not None and raw[k].low < entry), None)
            if te is not None and te + h + w < n and ok[te + h]:
                tx = te + h
                hit = next((k for k in range(tx + 1, tx + 1 + w) if raw[k].high is not None and raw[k].high > raw[tx].ask), None)
                px = raw[tx].ask if hit is not None else raw[tx + w].bid if ok[tx + w] else None
                if px is not None and px - entry - FEE(px, 1000) > 0:
                    out.append((t, round(px - entry - FEE(px, 1000), 9)))
                    step = (hit if hit is not None else tx + w) + 1
        t = step
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_oracles_match_brute_force(spark, seed):
    df = random_walk(spark, 400, seed)
    raw = df.orderBy("ts").collect()
    cfg = OracleConfig(horizon_rows=15, maker_wait=8)
    at = lambda rows: [((r.ts - OPEN).seconds, round(r.edge_ps, 9)) for r in sorted(rows, key=lambda r: r.ts)]
    taker, maker = at(orc.taker_trades(df, cfg).collect()), at(orc.maker_trades(df, cfg).collect())
    assert taker == brute_taker(raw, 15) and taker
    assert maker == brute_maker(raw, 15, 8) and maker
    s = orc.day_summary(df, cfg).first()
    assert s.taker_n == len(taker) and s.maker_n == len(maker) and s.n_seconds == 400


def brute_fills(raw, entries, mode, wait):
    """Step through the decisions one by one with an explicit open position."""
    n, busy, out = len(raw), -1, []
    good = [r.bid is not None and r.bid > 0 for r in raw]
    for t, qty, target, stop, due in entries:
        none = (False, 0, "unfilled", 0.0)
        if t <= busy or not good[t] or raw[t].ask is None:
            out.append(none)
            continue
        if mode == "taker":
            vol = sum(r.volume for r in raw[max(0, t - 59):t + 1])
            got = min(qty, int(raw[t].ask_size * 100), int(0.05 * vol))
            e, px = (t, raw[t].ask) if got > 0 else (None, None)
        else:
            e = next((k for k in range(t + 1, min(n, t + 1 + wait)) if raw[k].low is not None and raw[k].low < raw[t].bid), None)
            got, px = qty, raw[t].bid
        if e is None:
            out.append(none)
            continue
        dd, res = min(due, n - 1), None
        for k in range(e + 1, dd + 1):
            if good[k] and raw[k].bid <= stop:
                res = (k, raw[k].bid - (raw[k].spread or 0.0) / 2, "stop")
                break
            if good[k] and raw[k].bid >= target:
                res = (k, target, "target")
                break
        if res is None and due <= n - 1:
            j = next((k for k in range(max(dd, e), n) if good[k]), None)
            res = None if j is None else (j, raw[j].bid, "timeout")
        if res is None:
            j = max((k for k in range(e, n) if good[k]), default=t)
            res = (j, raw[j].bid, "eod")
        busy = res[0]
        out.append((True, got, res[2], (res[1] - px - FEE(res[1], got)) * got))
    return out


@pytest.mark.parametrize("mode", ["taker", "maker"])
def test_fills_match_a_stepwise_simulation(spark, mode):
    df = random_walk(spark, 300, 9)
    raw = df.orderBy("ts").collect()
    rng = random.Random(1)
    ent = []
    for t in sorted(rng.sample(range(295), 60)):
        ref = raw[t].ask or 5.0
        ent.append((t, rng.choice([10, 200, 2000]), round(ref + rng.choice([0.02, 0.05]), 2), round(ref - rng.choice([0.03, 0.06]), 2), t + rng.choice([10, 40, 400])))
    at = lambda s: OPEN + timedelta(seconds=s)
    edf = spark.createDataFrame([("A", OPEN.date(), at(t), q, a, b, at(d)) for t, q, a, b, d in ent], ENTRY)
    got = fl.simulate_fills(df, edf, FillConfig(entry_mode=mode, maker_wait=8)).orderBy("ts").collect()
    want = brute_fills(raw, ent, mode, 8)
    assert [(g.filled, g.fill_qty, g.exit_reason) for g in got] == [w[:3] for w in want]
    assert [g.pnl for g in got] == pytest.approx([w[3] for w in want])
    assert len({w[2] for w in want}) >= 4


def test_stop_wins_a_shared_row_and_pays_half_the_spread(spark):
    df = bars(spark, [5.0, None, 4.9, 4.9], [5.02, None, 4.96, 4.96])
    at = lambda s: OPEN + timedelta(seconds=s)
    e = spark.createDataFrame([("A", OPEN.date(), at(0), 5, 4.9, 4.9, at(3))], ENTRY)
    r = fl.simulate_fills(df, e).first()
    assert r.exit_reason == "stop" and r.exit_px == pytest.approx(4.87) and r.slippage_ps == pytest.approx(0.03)
    stray = spark.createDataFrame([("A", OPEN.date(), at(99), 5, 5.1, 4.9, at(120))], ENTRY)
    assert fl.missing_bar_times(stray, df).count() == 1


def test_threshold_sweep_golden(spark):
    sch = "symbol string, session_date date, ts timestamp, p_win double, label double, timeout_edge double, exit_s double, target_ps double, stop_ps double"
    at = lambda s: OPEN + timedelta(seconds=s)
    d = OPEN.date()
    rows = [("A", d, at(0), 0.9, 1.0, None, 5.0, 0.05, 0.04), ("A", d, at(100), 0.9, -1.0, None, 5.0, 0.05, 0.04), ("A", d, at(200), 0.9, 0.0, 0.01, 5.0, 0.05, 0.04)]
    out = {r.threshold: r for r in fl.threshold_sweep(spark.createDataFrame(rows, sch), (0.5, 0.95)).collect()}
    assert out[0.5].n_trades == 3 and out[0.5].hit_rate == pytest.approx(1 / 3) and out[0.5].sum_pnl_1000sh == pytest.approx(20.0)
    assert out[0.95].n_trades == 0 and out[0.95].hit_rate is None and out[0.95].sum_pnl_1000sh == 0.0
    near = [("A", d, at(i), 0.9, 1.0, None, 3.0, 0.05, 0.04) for i in range(5)]
    assert fl.threshold_sweep(spark.createDataFrame(near, sch), (0.5,)).first().n_trades == 2


def test_stratified_cap_is_reproducible(spark):
    from tapeloom.operators.splits import stratified_cap

    lab = lb.barrier_labels(random_walk(spark, 300, 4), BarrierConfig(timeout_rows=40)).where("label is not null")
    a, b = (stratified_cap(lab.repartition(p), 50, TrainConfig().seed).select("ts", "label") for p in (1, 5))
    assert a.exceptAll(b).count() == 0
    full, kept = (dict(x.groupBy("label").agg(F.count(F.lit(1))).collect()) for x in (lab, a))
    n = sum(full.values())
    assert all(kept[k] == max(1, -(-full[k] * 50 // n)) for k in full)

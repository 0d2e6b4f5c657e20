"""Portfolio, metrics, risk rules, orders, splits and streams."""

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeloom.config import SCALP_PROFILES, TIERS, PortfolioConfig, RunnerCriteria, SplitConfig
from tapeloom.functions import scalar as sc
from tapeloom.operators import daily as dl
from tapeloom.operators import orders as od
from tapeloom.operators import risk as rk
from tapeloom.operators import signals as sg
from tapeloom.operators import splits as sp
from tapeloom.operators import xsec as xs
from tapeloom.streaming import jobs

T0 = datetime(2024, 1, 2, 15, 0)


def test_portfolio_golden(spark):
    d = [date(2024, 1, i) for i in (2, 3, 4, 5)]
    px = {"A": [100, 110, 121, 121], "B": [100, 100, 90, 90], "C": [100, 1, 1, 1]}
    daily = spark.createDataFrame([(s, d[i], float(v)) for s, vs in px.items() for i, v in enumerate(vs)], "symbol string, date date, close double")
    scores = spark.createDataFrame([(d[0], s, x) for s, x in (("A", 0.9), ("B", 0.8), ("C", 0.1))], "date date, symbol string, score double")
    r = xs.run_portfolio(scores, daily, PortfolioConfig(2, 100.0)).orderBy("date").collect()
    assert r[0].net == pytest.approx(0.05 - 0.01) and r[0].gross == pytest.approx(0.05) and r[0].turnover == pytest.approx(1.0)
    assert r[1].gross == pytest.approx((2.11 / 2) / (2.10 / 2) - 1)


def test_factors_match_pandas(spark):
    rng = np.random.default_rng(0)
    days = pd.bdate_range("2022-01-03", periods=300)
    px = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, 300)))
    vol = rng.integers(1000, 9000, 300).astype(float)
    daily = spark.createDataFrame(pd.DataFrame({"symbol": "A", "date": days.date, "close": px, "volume": vol}))
    mret = rng.normal(0, 0.01, 300)
    market = spark.createDataFrame(pd.DataFrame({"date": days.date, "mret": mret}))
    got = xs.factors(daily, market).orderBy("date").toPandas().iloc[-1]
    c, v, m = pd.Series(px), pd.Series(vol), pd.Series(mret)
    ret = c.pct_change()
    beta = ret.rolling(252).cov(m) / m.rolling(252).var()
    want = {
        "mom_12_1": c.iloc[-22] / c.iloc[-253] - 1, "vol_3m": ret.rolling(63).std().iloc[-1], "skew_3m": ret.rolling(63).skew().iloc[-1],
        "amihud_3m": (ret.abs() / (c * v)).rolling(63).mean().iloc[-1], "up_frac_6m": (ret > 0).rolling(126).mean().iloc[-1],
        "dollar_vol": np.log((c * v).rolling(63).mean().iloc[-1]), "beta_12m": beta.iloc[-1],
    }
    for k, x in want.items():
        assert got[k] == pytest.approx(x), k


def test_runner_days_use_only_the_past(spark):
    rows = [("A", date(2024, 1, 1) + timedelta(days=i), 3.0, 3.1, 2.9, 3.0, 1e6, 3.0) for i in range(30)]
    rows[25] = ("A", rows[25][1], 3.5, 4.2, 3.4, 4.0, 9e6, 3.9)
    df = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double, vwap double")
    got = dl.select_runner_days(df, RunnerCriteria()).collect()
    assert [g.date for g in got] == [rows[25][1]] and got[0].relvol == pytest.approx(9.0) and got[0].gain == pytest.approx(1 / 3)
    assert dl.select_runner_days(df.where(F.col("date") <= F.lit(rows[25][1]))).count() == 1


def test_prior_context_equals_latest_context(spark):
    rows = [("A", date(2024, 1, i), 1.0 * i, 10.0 * i) for i in (2, 3, 5)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double, volume double").withColumn("open", F.col("close"))
    prior = dl.prior_session_context(df.where("date = '2024-01-05'").select("symbol", "date"), df).first()
    latest = dl.latest_context(df).first()
    assert (prior.prev_day_close, prior.prev_day_volume, prior.prev_day_dollar_vol) == (latest.prev_close, latest.prev_day_volume, latest.prev_day_dollar_vol) == (3.0, 30.0, 90.0)
    assert dl.prior_session_context(df.where("date = '2024-01-02'").select("symbol", "date"), df).first().prev_day_close is None


def test_metrics_golden(spark):
    eq = spark.createDataFrame([(i, T0 + timedelta(days=i), v) for i, v in enumerate([100e3, 101e3, 100e3, 102e3])], "id long, ts timestamp, equity double")
    tr = spark.createDataFrame([(p,) for p in (50.0, -25.0, 100.0, -25.0)], "pnl double")
    m = od.performance_metrics(eq, tr).first()
    assert (m.total_return_pct, m.hit_rate, m.avg_win, m.avg_loss, m.max_drawdown_pct) == (2.0, 0.5, 75.0, -25.0, 0.9901)


def test_downsample_picks_even_points(spark):
    eq = spark.range(1001).select("id", F.timestamp_seconds(F.col("id")).alias("ts"))
    got = sorted(r.id for r in od.downsample(eq, 7).collect())
    assert got == [i * 1000 // 6 for i in range(7)]
    assert od.downsample(eq.limit(5), 7).count() == 5


def test_health_halves_and_never_raises(spark):
    rows = [(i, T0, -10.0, {"a": "0.5", "b": '{"contribution": 0.5}'}) for i in range(10)]
    t = spark.createDataFrame(rows, "id long, exit_ts timestamp, pnl double, signal_scores map<string,string>")
    prev = spark.createDataFrame([("a", 1.0)], "signal string, weight_multiplier double")
    got = {r.signal: r for r in od.signal_health(t, prev, F.lit(T0)).collect()}
    assert got["a"].weight_multiplier == 0.5 and got["b"].flagged_for_retrain
    good = od.signal_health(t.withColumn("pnl", F.lit(5.0)), prev.withColumn("weight_multiplier", F.lit(0.5)), F.lit(T0)).where("signal = 'a'").first()
    assert good.weight_multiplier == 0.5 and not good.flagged_for_retrain


def stepwise_match(fills):
    pos, entry, out = 0, 0.0, []
    for side, q, p in fills:
        d = q if side == "buy" else -q
        if pos == 0:
            entry = p
        elif (pos > 0) != (d > 0):
            out.append(round((p - entry) * min(abs(d), abs(pos)) * (1 if pos > 0 else -1), 6))
        else:
            entry = (entry * pos + p * d) / (pos + d)
        pos += d
    return pos, out


def test_fill_matching_and_its_stream_twin(spark):
    rng = np.random.default_rng(2)
    fills = [(str(rng.choice(["buy", "sell"])), int(rng.integers(1, 9)), float(rng.integers(10, 20))) for _ in range(80)]
    df = spark.createDataFrame([("A", T0 + timedelta(seconds=i), i, 0, s, q, p) for i, (s, q, p) in enumerate(fills)], "symbol string, ts timestamp, seq long, tie long, side string, qty long, price double")
    m = od.match_fills(df, chunk_rows=7)
    pos, pnls = stepwise_match(fills)
    got = od.closed_round_trips(m).orderBy("exit_ts").collect()
    assert [round(g.pnl, 6) for g in got] == pnls
    left = od.open_positions(m).collect()
    assert (left[0].qty if left else 0) == pos
    live = jobs.run_to_end(jobs.stream_fills(jobs.replay(df, "ts", 2))).orderBy("exit_ts").collect()
    assert [(g.exit_ts, g.entry_ts, round(g.pnl, 6)) for g in live] == [(g.exit_ts, g.entry_ts, round(g.pnl, 6)) for g in got]


def intents(spark, rows):
    return spark.createDataFrame(rows, "symbol string, side string, qty long, price_hint double, book string, in_entry_window boolean")


def account(spark, **kw):
    base = dict(equity=100_000.0, day_start_equity=100_000.0, peak_equity=100_000.0, intraday_realized=0.0, halted=False, intraday_halted=False) | kw
    return spark.createDataFrame([tuple(base.values())], "equity double, day_start_equity double, peak_equity double, intraday_realized double, halted boolean, intraday_halted boolean")


@pytest.mark.parametrize(
    "state,row,reason",
    [
        ({}, ("SPY", "buy", 10, 100.0, "intraday", True), None),
        ({"halted": True}, ("SPY", "buy", 0, 100.0, "intraday", True), "engine HALTED"),
        ({}, ("SPY", "buy", 0, 100.0, "intraday", True), "non-positive quantity"),
        ({}, ("XYZ", "buy", 1, 100.0, "intraday", True), "symbol XYZ not in tier universe"),
        ({}, ("QQQ", "buy", 1, 100.0, "intraday", True), "symbol held by monthly book"),
        ({"intraday_halted": True}, ("SPY", "buy", 1, 100.0, "intraday", True), "intraday book halted"),
        ({}, ("SPY", "sell", 1, 100.0, "intraday", True), "shorting not allowed in this tier"),
        ({}, ("SPY", "buy", 101, 100.0, "intraday", True), "exceeds max position size"),
        ({"intraday_realized": -2500.0}, ("SPY", "buy", 1, 100.0, "intraday", True), "daily loss limit reached"),
        ({"peak_equity": 200_000.0}, ("SPY", "buy", 1, 100.0, "intraday", True), "account drawdown floor reached"),
        ({}, ("SPY", "buy", 1, 100.0, "intraday", False), "outside entry window"),
    ],
)
def test_risk_rules_in_order(spark, state, row, reason):
    pos = spark.createDataFrame([("QQQ", 5, 10.0, 10.0, "monthly")], "symbol string, qty long, entry_price double, mark double, book string")
    uni = spark.createDataFrame([("SPY",), ("QQQ",)], "symbol string")
    assert rk.screen_intents(intents(spark, [row]), pos, account(spark, **state), TIERS["medium"], uni).first().reason == reason


def test_exits_reduce_only(spark):
    pos = spark.createDataFrame([("SPY", 5, 10.0, 10.0, "intraday")], "symbol string, qty long, entry_price double, mark double, book string")
    rows = [("SPY", "sell", 5, 1.0, "intraday", False), ("SPY", "sell", 11, 1.0, "intraday", False), ("SPY", "sell", 0, 1.0, "intraday", False)]
    got = [r.reason for r in rk.screen_exits(intents(spark, rows), pos).collect()]
    assert got == [None, "exit path used for an exposure-increasing order", "non-positive quantity"]


def test_error_burst_rule(spark):
    sec = [0, 10, 20, 30, 70, 75, 80]
    e = spark.createDataFrame([(T0 + timedelta(seconds=s), i) for i, s in enumerate(sec)], "ts timestamp, seq long")
    got = {r.seq: r.burst for r in rk.error_bursts(e, chunk_rows=2).collect()}
    assert got == {0: False, 1: False, 2: False, 3: False, 4: False, 5: False, 6: True}


def test_brackets_batch_and_stream_agree(spark):
    q = [(5, 4.99), (20, 4.80), (30, 4.70)]
    at = lambda s: T0 + timedelta(seconds=s)
    br = spark.createDataFrame([(1, "A", 10, 4.85, at(0), at(60)), (2, "B", 10, 4.0, at(0), at(25))], "bracket_id long, symbol string, qty long, stop_px double, armed_ts timestamp, deadline timestamp")
    quotes = spark.createDataFrame([(s, at(t), i, p) for s in "AB" for i, (t, p) in enumerate(q)], "symbol string, ts timestamp, seq long, bid double")
    got = {r.symbol: (r.kind, r.ts) for r in rk.bracket_actions(br, quotes).collect()}
    assert got == {"A": ("stop", at(20)), "B": ("timeout", at(30))}


@settings(max_examples=15, deadline=None)
@given(st.floats(0, 1), st.floats(0.01, 0.2), st.floats(0.01, 0.2), st.floats(0.6, 9.5), st.floats(0, 5000), st.floats(0, 20))
def test_kelly_size_stays_inside_its_box(spark, p, t, s, px, vol, lots):
    cfg = SCALP_PROFILES["mid"]
    args = [F.lit(float(x)) for x in (p, t, s, px, 50_000, vol, lots)]
    n = spark.range(1).select(sc.kelly_shares(sc.Stake(*args), cfg).alias("n")).first().n
    assert 0 <= n <= min(cfg.max_position_pct * 50_000 / px, cfg.max_participation * vol, 200 * lots) + 1e-9
    assert n == 0 or p * t > (1 - p) * s


def test_sizes_refuse_bad_input(spark):
    cfg = SCALP_PROFILES["mid"]
    base = [0.9, 0.05, 0.02, 5.0, 50_000.0, 5000.0, 10.0]
    for i, bad in [(0, None), (0, float("nan")), (0, 1.2), (1, 0.0), (3, 20.0), (4, -1.0)]:
        v = [F.lit(x).cast("double") for x in base[:i] + [bad] + base[i + 1:]]
        assert spark.range(1).select(sc.kelly_shares(sc.Stake(*v), cfg).alias("n")).first().n == 0
    assert spark.range(1).select(sc.kelly_shares(sc.Stake(*[F.lit(float(x)) for x in base]), cfg).alias("n")).first().n > 0


def test_split_integrity(spark):
    days = spark.createDataFrame([(date(2024, 1, i),) for i in range(1, 21)], "session_date date")
    parts = sp.day_split(days, SplitConfig(test_frac=0.25, embargo_days=2)).collect()
    test, train = ([p.date for p in parts if p.part == k] for k in ("test", "train"))
    assert len(test) == 5 and max(train) < min(test) and (min(test) - max(train)).days > 2
    pinned = sp.day_split(days, SplitConfig(test_start="2024-01-18", train_start="2024-01-05")).where("part = 'train'").collect()
    assert min(p.date for p in pinned) == date(2024, 1, 5)
    with pytest.raises(Exception, match="no test days"):
        sp.day_split(days, SplitConfig(test_start="2025-01-01")).collect()


def test_decile_bins_and_rank_ic_match_pandas(spark):
    rng = np.random.default_rng(1)
    p, r = rng.integers(0, 30, 137).astype(float), rng.normal(size=137)
    df = spark.createDataFrame(pd.DataFrame({"i": range(137), "p": p, "r": r}))
    got = xs.decile_table(df, "p", "r", ["i"]).orderBy("decile").toPandas()
    b = pd.qcut(pd.Series(p).rank(method="first"), 10, labels=False)
    want = pd.Series(r).groupby(b).agg(["size", "mean", "median"])
    assert got["n"].tolist() == want["size"].tolist() and np.allclose(got["median_realized_pnl"], want["median"])
    ic = xs.rank_ic(df, "p", "r").first().rank_ic
    assert ic == pytest.approx(pd.Series(p).rank().corr(pd.Series(r).rank()))
    assert xs.rank_ic(df.limit(1), "p", "r").first().rank_ic is None


def test_signals_stay_in_bounds_and_atr_uses_fifteen_bars(spark):
    rng = np.random.default_rng(3)
    px = 10 * np.exp(np.cumsum(rng.normal(0, 0.01, 60)))
    rows = [("A", T0 + timedelta(minutes=5 * i), float(x), float(x * 1.01), float(x * 0.99)) for i, x in enumerate(px)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double, high double, low double")
    assert sg.bound_violations(sg.mean_reversion_signal(df)).count() == 0
    last = sg.average_true_range(df).orderBy(F.desc("ts")).first().atr
    c, h, lo = px[-15:], px[-15:] * 1.01, px[-15:] * 0.99
    prev = np.concatenate([[c[0]], c[:-1]])
    assert last == pytest.approx(np.maximum(h - lo, np.maximum(abs(h - prev), abs(lo - prev))).mean())
    w = np.clip((abs(px[-1] - px[-25]) / np.abs(np.diff(px[-25:])).sum() - 0.10) / 0.25, 0, 1)
    assert sg.trend_weight(df).first().trend_w == pytest.approx(w)
    assert sg.trend_weight(df.limit(5)).first().trend_w == 0.5


def test_factors_at_dates_are_those_of_all_dates(spark):
    """Short histories, missing and huge prices, a zero volume, a date twice, a symbol that ends early."""
    rng = np.random.default_rng(5)
    days = pd.bdate_range("2020-01-01", periods=330)
    rows = []
    for k, n in enumerate((330, 300, 64, 1, 330)):
        px = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        px[200:201] *= 1e9
        rows += [(f"S{k}", d.date(), None if rng.random() < 0.01 * (k == 1) else float(p), float(rng.integers(0, 50))) for d, p in zip(days, px)]
    daily = spark.createDataFrame(rows, "symbol string, date date, close double, volume double")
    market = xs.daily_returns(daily).groupBy("date").agg(F.avg("ret").alias("mret"))
    dates = spark.createDataFrame([(days[i].date(),) for i in (0, 30, 63, 280, 299, 299, 329)], "date date")
    want = xs.factors(daily, market).join(dates.distinct(), "date", "left_semi").select("symbol", "date", *xs.FACTORS, *xs.MARKET_FACTORS, "fwd_ret")
    got = xs.factors(daily, market, dates)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 15


def test_rolling_windows_pass_in_blocks_and_only_where_asked(spark):
    from tapeloom.functions.session_scan import Rolling, scan_sessions

    df = spark.range(3000).repartition(1).select((F.col("id") / 3).cast("long").alias("k"), "id", F.col("id").cast("double").alias("v"), (F.col("id") % 50 == 2).alias("on"))
    calls, rows = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def stat(x):
        calls.add(1)
        rows.add(len(x))
        return np.nansum(x, axis=1)

    got = scan_sessions(df, ["k"], "id", [Rolling("s", ("v",), 3, stat, 2, at="on")], keep="on").collect()
    assert len(got) == 60 and all(r.s == (None if r.id % 3 == 0 else sum(range(3 * r.k, r.id + 1))) for r in got)
    assert calls.value <= 8 and rows.value == 40  # once a block, not once a session, and not for other rows


def test_queries_over_the_panel_make_the_daily_bars_once(spark):
    """The factors, the rebalance dates and the market each aggregated all prints."""
    from tapeloom.queries import QUERIES

    for name in ("factors", "rebalance_dataset", "top_holdings"):
        assert not any("lineitem" in f for f in QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()), name

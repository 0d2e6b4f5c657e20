"""Bar construction, cleaning and features on hand-made tapes."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from helpers import OPEN, assert_causal, bars, random_walk
from pyspark.sql import functions as F

from tapeloom.config import BarrierConfig, BarSpec, FeatureConfig
from tapeloom.functions.scalar import local_second, price_bucket
from tapeloom.operators import bar_features as bf
from tapeloom.operators import bars as b
from tapeloom.operators import labels as lb
from tapeloom.operators import scan
from tapeloom.operators import splits as sp

TRADE = "symbol string, ts timestamp, seq long, price double, size double"
QUOTE = "symbol string, ts timestamp, seq long, bid_price double, ask_price double, bid_size double, ask_size double"


def tape(spark, trades, quotes):
    at = lambda s: OPEN + timedelta(seconds=s)
    t = spark.createDataFrame([("A", at(s), i, float(p), float(z)) for i, (s, p, z) in enumerate(trades)], TRADE)
    q = spark.createDataFrame([("A", at(s), i, float(x), float(y), 1.0, 2.0) for i, (s, x, y) in enumerate(quotes)], QUOTE)
    return t, q


def test_labels_are_right_closed_and_grid_is_full(spark):
    t, q = tape(spark, [(0.4, 10, 5), (1.0, 11, 5), (1.2, 12, 1), (4.5, 9, 2)], [(0.2, 9.9, 10.1), (1.5, 20, 10)])
    rows = b.second_bars(t, q).orderBy("ts").collect()
    assert [(r.ts - OPEN).seconds for r in rows] == [1, 2, 3, 4, 5]
    first = rows[0]
    assert (first.open, first.high, first.low, first.close, first.volume, first.n_trades) == (10, 11, 10, 11, 10, 2)
    assert first.vwap == pytest.approx(10.5)
    assert rows[2].close is None and rows[2].volume == 0 and rows[2].n_trades == 0
    assert all(r.bid == 9.9 and r.ask == 10.1 for r in rows)  # the crossed quote is ignored


def test_quote_goes_stale_and_never_precedes_the_grid(spark):
    t, q = tape(spark, [(5.5, 10, 1), (80.5, 10, 1)], [(1.0, 1.0, 2.0), (6.0, 9.0, 9.5)])
    rows = {(r.ts - OPEN).seconds: r for r in b.second_bars(t, q).collect()}
    assert rows[6].bid == 9.0 and rows[66].bid == 9.0 and rows[67].bid is None
    t, q = tape(spark, [(5.5, 10, 1), (8.5, 10, 1)], [(1.0, 1.0, 2.0)])
    assert all(r.bid is None for r in b.second_bars(t, q).collect())


def test_no_trades_gives_no_bars_and_no_quotes_gives_null_quotes(spark):
    t, q = tape(spark, [(0.5, 10, 1), (3.5, 10, 1)], [(0.1, 9, 11)])
    assert b.second_bars(t.limit(0), q).count() == 0
    assert b.second_bars(t, None).where("bid is not null").count() == 0


def test_hours_filter_is_dst_safe(spark):
    ts = [datetime(2024, 7, 1, 13, 30), datetime(2024, 7, 1, 13, 29, 59), datetime(2024, 1, 2, 14, 30), datetime(2024, 1, 2, 21, 0), datetime(2024, 1, 2, 20, 59, 59)]
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp")
    kept = {r.ts for r in b.regular_hours(df).collect()}
    assert kept == {ts[0], ts[2], ts[4]}
    assert df.select(local_second("ts").alias("s")).first().s == 9.5 * 3600


def test_trade_signing(spark):
    t, q = tape(spark, [(1, 10.0, 3), (2, 10.2, 5), (3, 9.9, 7), (4, 10.0, 11)], [(0.5, 0, 0), (1.5, 9.9, 10.2), (3.5, 9.8, 10.4)])
    rows = b.prevailing_quotes(t, q).where("kind = 1").select("seq", b.trade_sign().alias("s")).orderBy("seq").collect()
    assert [r.s for r in rows] == [0, 1, -1, 1]  # unsigned, at ask, at bid, up-tick
    m = b.microstructure_bars(t, q, 60).first()
    assert m.flow_imbalance == pytest.approx((16 - 7) / 23)


def test_roll_up_counts_bars_and_drops_the_tail(spark):
    rows = [("A", OPEN.date(), OPEN + timedelta(minutes=i * (1 + i % 2)), 60, 1.0 + i, 2.0 + i, 0.5, 1.5, 10.0, 1.5, 2, 0.0, 0.0, 0.5) for i in range(7)]
    df = spark.createDataFrame(rows, "symbol string, session_date date, ts timestamp, interval_s int, open double, high double, low double, close double, volume double, vwap double, trade_count long, mean_spread double, mean_quote_imbalance double, flow_imbalance double")
    out = b.rolled_bars(df, 5).collect()
    assert len(out) == 1 and out[0].volume == 50 and out[0].mean_spread == 0.0 and out[0].flow_imbalance == pytest.approx(0.5)


def reference_features(close, volume, n_trades):
    """Independent pandas check of a few features."""
    px = pd.Series(close, dtype=float).ffill()
    v, n = pd.Series(volume, dtype=float), pd.Series(n_trades, dtype=float)
    up = (px.diff() > 0).astype(float)
    out = pd.DataFrame({"ret_5s": px / px.shift(5) - 1, "pullback": px / px.rolling(300, min_periods=1).max() - 1})
    vs = v.rolling(5, min_periods=1).sum()
    out["vol_surge"] = vs / vs.rolling(300, min_periods=1).median().replace(0, np.nan)
    out["up_streak"] = up.groupby((up == 0).cumsum()).cumsum().clip(upper=30)
    ts = n.rolling(10, min_periods=1).sum()
    out["tape_speed"] = ts / ts.rolling(300, min_periods=1).median().replace(0, np.nan)
    return out


def test_features_match_an_independent_computation(spark):
    df = random_walk(spark, 400, 1)
    raw = df.orderBy("ts").toPandas()
    want = reference_features(raw["close"], raw["volume"], raw["n_trades"])
    got = bf.bar_features(df).orderBy("ts").toPandas()
    assert len(got) == 400 and list(got.columns[3:]) == bf.feature_names()
    for c in want:
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True), c


def test_features_barriers_do_not_look_ahead(spark):
    df = random_walk(spark, 200, 2)
    cfg = FeatureConfig(batch3=True)
    assert_causal(lambda d: bf.bar_features(d, cfg), df, 120)
    assert_causal(lambda d: lb.with_barriers(d, BarrierConfig(mode="vol", vol_window=30)).select("ts", "target_ps", "stop_ps"), df, 120)


def test_round_distance_is_half_even(spark):
    f = bf.bar_features(bars(spark, [5.24, 5.24], close=[5.25, 5.75])).orderBy("ts").collect()
    assert f[0].round_dist == pytest.approx(0.25 / 5.25) and f[1].round_dist == pytest.approx(-0.25 / 5.75)


def test_drop_features_rejects_unknown_names(spark):
    f = bf.bar_features(bars(spark, [5.0, 5.0]))
    assert "qimb" not in bf.drop_features(f, "qimb, tod_min,,").columns
    with pytest.raises(ValueError):
        bf.drop_features(f, ["nope"])


def test_guards(spark):
    df = bars(spark, [5.0] * 5)
    assert sp.contiguity_breaks(df).count() == 0
    holed = df.where(F.col("ts") != F.lit(OPEN + timedelta(seconds=2)))
    with pytest.raises(ValueError):
        sp.require_none(sp.contiguity_breaks(holed), "gap")
    late = bars(spark, [5.0], start=datetime(2024, 1, 2, 15, 0))
    assert scan.outside_window(df).count() == 0 and scan.outside_window(late).count() == 1
    edge = bars(spark, [5.0, 5.0], start=datetime(2024, 1, 2, 14, 45))
    assert scan.early_bars(edge).count() == 1


def test_price_buckets(spark):
    df = spark.createDataFrame([(0.4,), (0.5,), (2.0,), (5.0,), (10.0,)], "p double")
    assert [r[0] for r in df.select(price_bucket("p")).collect()] == ["other", "0.5-2", "2-5", "5-10", "other"]


def test_windows_are_padded_and_complete_only_filters(spark):
    f = bf.bar_features(bars(spark, [5.0 + 0.01 * i for i in range(12)]))
    w = bf.window_tensors(f, ["ret_5s", "quote_ok"], 4).orderBy("ts").collect()
    assert all(len(r.window) == 4 for r in w) and w[0].window[0] == [None, None] and w[0].window[3][1] == 1.0
    assert bf.window_tensors(f, ["ret_5s", "quote_ok"], 4, complete_only=True).count() == 7


def test_interval_spec():
    assert BarSpec(interval_s=600, quote_stale_s=60).stale_rows == 1 and BarSpec().stale_rows == 60


def test_sessions_of_a_week_pass_as_one_group(spark):
    """The features of sessions that share a group are those of each session alone."""
    from tapeloom.config import FeatureConfig
    from tapeloom.operators.bar_features import bar_features

    cfg = FeatureConfig(ret_windows=(1, 3), mom_accel_window=3, pullback_window=9, vol_surge_short=2, vol_surge_long=11, tape_speed_short=3, tape_speed_long=12, norm_window=13, norm_min=4, flow_window=5, change_lag=4, slope_lag=6, bid_lag=2)
    tape = random_walk(spark, 60, 4)
    days = [tape.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {d} DAYS")).withColumn("session_date", F.date_add("session_date", d)).withColumn("volume", F.col("volume") + d) for d in range(9)]
    whole = days[0]
    for day in days[1:]:
        whole = whole.unionByName(day)
    got = bar_features(whole, cfg)
    assert "date_trunc(week" in got._jdf.queryExecution().executedPlan().toString()
    want = sorted((r for day in days for r in bar_features(day, cfg).collect()), key=lambda r: (r.symbol, r.ts))
    assert [tuple(map(str, r)) for r in sorted(got.collect(), key=lambda r: (r.symbol, r.ts))] == [tuple(map(str, r)) for r in want]

"""Streamed features and decisions equal the batch ones, whatever the micro-batches."""

import pytest
from helpers import bars as make_bars
from helpers import random_walk
from pyspark.sql import functions as F

from tapeloom.config import BarrierConfig, FeatureConfig
from tapeloom.operators.bar_features import bar_features, feature_names
from tapeloom.operators.labels import with_barriers
from tapeloom.streaming import decisions as dc
from tapeloom.streaming import jobs

SHORT = FeatureConfig(
    ret_windows=(1, 3, 7), mom_accel_window=3, pullback_window=9, vol_surge_short=2, vol_surge_long=11, tape_speed_short=3, tape_speed_long=12,
    norm_window=13, norm_min=4, flow_window=5, change_lag=4, slope_lag=6, bid_lag=2, streak_cap=5, fresh_cap=9, batch3=True, imbalance_level=0.1, persist_cap=6,
)
BARRIER = BarrierConfig(mode="vol", vol_window=10)
LINEAR = {"ret_1s": 30.0, "qimb": 1.0, "vol_surge": 0.2, "tod_min": 0.001}


def rows_of(df):
    return sorted(tuple(None if x is None else round(x, 7) + 0.0 if isinstance(x, float) else x for x in r) for r in df.collect())


def tape(spark):
    a, b = random_walk(spark, 160, 1), random_walk(spark, 90, 2, gaps=False).withColumn("symbol", F.lit("B"))
    empty = make_bars(spark, [None] * 8, symbol="C", close=[None] * 8)
    return a.unionByName(b).unionByName(empty)


@pytest.mark.parametrize("cfg", [SHORT, FeatureConfig(luld_tiered=True)], ids=["short", "published"])
def test_streamed_features_equal_the_batch(spark, cfg):
    bars = tape(spark)
    batch = bar_features(with_barriers(bars, BARRIER).drop("px"), cfg, carry=("bid", "ask", "target_ps", "stop_ps"))
    names = ["symbol", "session_date", "ts", *feature_names(cfg), "bid", "ask", "target_ps", "stop_ps"]
    want = rows_of(batch.select(*names))
    for files in (1, 7):
        assert rows_of(jobs.run_to_end(dc.stream_features(jobs.replay(bars, "ts", files), cfg, BARRIER)).select(*names)) == want


def test_decisions_have_threshold_and_equal_the_batch(spark):
    bars = tape(spark)
    score = lambda f: f.withColumn("p_win", dc.linear_score(LINEAR, 0.1))
    feats = bar_features(with_barriers(bars, BARRIER).drop("px"), SHORT, carry=("bid", "ask", "target_ps", "stop_ps"))
    want = rows_of(dc.decisions(feats, score, 0.55, BARRIER, 1.5))
    got = rows_of(jobs.run_to_end(jobs.decision_stream(jobs.replay(bars, "ts", 5), score, 0.55, SHORT, BARRIER, 1.5)))
    assert got == want and {r[-1] for r in got} == {True, False}
    assert {r[-2] for r in got} == {0.55} and "C" not in {r[0] for r in got}


def test_repeated_bars_are_left_out_and_fixed_barriers_need_no_history(spark):
    bars = random_walk(spark, 30, 4, gaps=False)
    twice = bars.unionByName(bars)
    fixed = BarrierConfig(mode="fixed", target_ps=0.3, stop_ps=0.2)
    got = jobs.run_to_end(dc.stream_features(jobs.replay(twice, "ts", 3), SHORT, fixed))
    assert got.count() == 30 and {(r.target_ps, r.stop_ps) for r in got.collect()} == {(0.3, 0.2)}


def test_the_state_is_bounded_by_the_look_back():
    assert dc.look_back(SHORT, BARRIER) <= 20 and dc.look_back(FeatureConfig(), BarrierConfig()) <= 400

"""The one-scan study equals the summaries of the single operators, horizon by horizon."""

from helpers import bars as make_bars
from helpers import random_walk
from pyspark.sql import functions as F

from tapeloom.config import OracleConfig
from tapeloom.operators import oracle as orc


def rows_of(df, columns):
    return sorted(tuple(None if x is None else round(x, 7) + 0.0 if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def test_one_scan_equals_the_operators_at_every_horizon(spark):
    tape = random_walk(spark, 300, 1).unionByName(random_walk(spark, 120, 2, gaps=False).withColumn("symbol", F.lit("B")))
    tape = tape.unionByName(make_bars(spark, [None] * 6, symbol="C", close=[None] * 6)).unionByName(make_bars(spark, [5.0], symbol="D"))
    horizons = (3, 10, 60, 200)
    cfg = OracleConfig(maker_wait=5, clip_shares=700)
    got = orc.viability_study(tape.repartition(5), horizons, None, cfg)
    columns = [c for c in got.columns if c != "price_bucket"]
    want = None
    for h in horizons:
        one = orc.day_summary(tape, OracleConfig(h, cfg.clip_shares, cfg.maker_wait, cfg.fees))
        want = one if want is None else want.unionByName(one)
    assert rows_of(got, columns) == rows_of(want, columns)
    assert got.where("taker_n > 0 and maker_n > 0").count() > 3


def test_the_study_shuffles_once(spark):
    plan = orc.viability_study(random_walk(spark, 50, 3), (3, 6, 12))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_metadata_is_shown_and_missing_days_are_other(spark):
    tape = random_walk(spark, 60, 4).unionByName(random_walk(spark, 60, 5).withColumn("symbol", F.lit("B")))
    day = tape.first().session_date
    meta = spark.createDataFrame([("A", day, 0.3, 4.0, 1e6, 3.0)], "symbol string, session_date date, gain double, relvol double, dollar_vol double, open double")
    got = {r.symbol: r for r in orc.viability_study(tape, (5,), meta).collect()}
    assert (got["A"].price_bucket, got["A"].gain, got["A"].relvol, got["A"].dollar_vol) == ("2-5", 0.3, 4.0, 1e6)
    assert got["B"].price_bucket == "other" and got["B"].gain is None
    assert orc.viability_study(tape.limit(0), (5,)).collect() == []


def test_a_grid_shares_its_features(spark):
    import dataclasses

    import pytest

    from tapeloom.config import BarrierConfig, FeatureConfig, SplitConfig, TrainConfig
    from tapeloom.plans import training as tr

    short = FeatureConfig(ret_windows=(1, 3), mom_accel_window=3, pullback_window=9, vol_surge_short=2, vol_surge_long=11, tape_speed_short=3, tape_speed_long=12, norm_window=13, norm_min=4, flow_window=5, change_lag=4, slope_lag=6, bid_lag=2)
    vol = TrainConfig(barrier=BarrierConfig(mode="vol", vol_window=10, timeout_rows=15, active_window=10), features=short, split=SplitConfig(test_frac=0.5, embargo_days=0), thresholds=(0.3, 0.5))
    fixed = dataclasses.replace(vol, barrier=dataclasses.replace(vol.barrier, mode="fixed", target_ps=0.03, stop_ps=0.02, timeout_rows=25))
    tape = random_walk(spark, 200, 6)
    for d in (1, 2, 3):
        later = random_walk(spark, 150, 6 + d)
        tape = tape.unionByName(later.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {d} DAYS")).withColumn("session_date", F.date_add("session_date", d)))
    grid = tr.labelled_grid(tape, {"vol": vol, "fixed": fixed})
    for name, cfg in (("vol", vol), ("fixed", fixed)):
        want = tr.labelled_features(tape, cfg).where("label is not null")
        got = tr.grid_rows(grid, name, cfg)
        assert got.columns == want.columns and rows_of(got, want.columns) == rows_of(want, want.columns) and got.count() > 100
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1
    report = tr.config_grid(tape, {"vol": vol, "fixed": fixed}, 2)
    alone = tr.walk_forward(tape, fixed, max_iter=2)[1]
    columns = [c for c in report.columns if c != "config"]
    assert rows_of(report.where("config = 'fixed'"), columns) == rows_of(alone, columns)
    with pytest.raises(ValueError, match="share"):
        tr.labelled_grid(tape, {"vol": vol, "other": dataclasses.replace(vol, features=FeatureConfig())})

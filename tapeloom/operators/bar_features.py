"""Causal features of second bars: every value at t uses rows up to t only.

All windows are row frames over a gap-free session grid. They share one
partitioning (symbol, session_date), so the whole feature set costs a single
shuffle; the four long rolling medians run in one Arrow pass at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.config import FeatureConfig
from tapeloom.functions.scalar import local_second, ratio
from tapeloom.functions.session_scan import RollingMedian, scan_sessions
from tapeloom.operators.bars import KEY


def feature_names(cfg: FeatureConfig = FeatureConfig()) -> list[str]:
    names = [f"ret_{w}s" for w in cfg.ret_windows] + [
        "mom_accel", "vwap_dist", "pullback", "vol_surge", "tape_speed", "spread_bps", "qimb", "qimb_chg_30s",
        "spread_rel", "bid_ret_15s", "sess_hi_dist", "up_streak", "tsize_surge", "flow_imb_60s", "flow_imb_chg",
        "luld_up_dist", "round_dist", "range_compress", "mom_fresh", "vwap_slope", "quote_ok", "tod_min",
    ]
    return names + (["ofi_60s", "tick_imb_60s", "qimb_persist"] if cfg.batch3 else [])


def _change(x: Column, earlier: Column) -> Column:
    return ratio(x, earlier) - 1.0


def _luld_band(ref: Column, tiered: bool) -> Column:
    """Upper price band of the trailing mean; the tiered form widens it for cheap names."""
    if not tiered:
        return ref * 1.10
    return F.when(ref >= 3.0, ref * 1.10).when(ref >= 0.75, ref * 1.20).when(
        ref.isNotNull(), ref + F.least(F.lit(0.15), ref * 0.75)
    )


def with_windowed_inputs(bars: DataFrame, cfg: FeatureConfig, keys: Sequence[str] = KEY) -> DataFrame:
    """All JVM window stages; leaves the rolling-median sources as columns."""
    w = Window.partitionBy(*keys).orderBy("ts")
    run = w.rowsBetween(Window.unboundedPreceding, 0)

    def back(n: int):
        return w.rowsBetween(-(n - 1), 0)

    def at_least(agg: Column, of: str | Column, frame, m: int) -> Column:
        return F.when(F.count(of).over(frame) >= m, agg)

    nw, nm, fw = cfg.norm_window, cfg.norm_min, cfg.flow_window
    depth = F.col("bid_size") + F.col("ask_size")
    mid = (F.col("bid") + F.col("ask")) / 2.0
    first = bars.select(
        "*",
        F.last("close", ignorenulls=True).over(run).alias("px"),
        F.sum(F.coalesce("vwap", F.lit(0.0)) * F.col("volume")).over(run).alias("_cum_notional"),
        F.sum("volume").over(run).alias("_cum_volume"),
        F.sum("volume").over(back(cfg.vol_surge_short)).alias("_vol_short"),
        F.sum("n_trades").over(back(cfg.tape_speed_short)).alias("_trade_short"),
        F.sum("volume").over(back(fw)).alias("_vol_60"),
        F.sum("n_trades").over(back(fw)).alias("_trades_60"),
        (F.max("high").over(back(fw)) - F.min("low").over(back(fw))).alias("_range_short"),
        at_least(F.max("high").over(back(nw)), "high", back(nw), nm).alias("_high_long"),
        at_least(F.min("low").over(back(nw)), "low", back(nw), nm).alias("_low_long"),
        F.lag("bid", cfg.bid_lag).over(w).alias("_bid_lag"),
        ratio(F.col("bid_size") - F.col("ask_size"), depth).alias("qimb"),
        (ratio("spread", mid) * 1e4).alias("spread_bps"),
        F.row_number().over(w).alias("_rn"),
    )
    lags = sorted({*cfg.ret_windows, cfg.mom_accel_window, 1})
    second = first.select(
        "*",
        *[F.lag("px", k).over(w).alias(f"_px_{k}") for k in lags],
        F.max("px").over(run).alias("_hi"),
        F.max("px").over(back(cfg.pullback_window)).alias("_hi_win"),
        at_least(F.avg("px").over(back(nw)), "px", back(nw), nm).alias("_px_mean"),
        F.lag("qimb", cfg.change_lag).over(w).alias("_qimb_lag"),
    )
    svwap = ratio("_cum_notional", "_cum_volume")
    moved = F.signum(F.col("px") - F.col("_px_1"))
    up = F.coalesce(F.col("px") > F.col("_px_1"), F.lit(False))
    new_high = F.coalesce(F.col("px") >= F.col("_hi"), F.lit(False))
    third = second.select(
        "*",
        *[_change(F.col("px"), F.col(f"_px_{k}")).alias(f"ret_{k}s") for k in cfg.ret_windows],
        _change(F.col("px"), F.col(f"_px_{cfg.mom_accel_window}")).alias("_mom"),
        ratio(F.col("px") - svwap, svwap).alias("vwap_dist"),
        ratio("_vol_60", "_trades_60").alias("_tsize"),
        (moved * F.col("volume")).alias("_signed_vol"),
        (moved * F.col("n_trades")).alias("_signed_n"),
        F.last(F.when(~up, F.col("_rn")), ignorenulls=True).over(run).alias("_last_flat"),
        F.last(F.when(new_high, F.col("_rn")), ignorenulls=True).over(run).alias("_last_high"),
        *(_batch3_inputs(w, run, cfg) if cfg.batch3 else []),
    )
    fourth = third.select(
        "*",
        (F.col("_mom") - F.lag("_mom", cfg.mom_accel_window).over(w)).alias("mom_accel"),
        ratio(F.sum("_signed_vol").over(back(fw)), "_vol_60").alias("flow_imb_60s"),
        (F.col("vwap_dist") - F.lag("vwap_dist", cfg.slope_lag).over(w)).alias("vwap_slope"),
        *(
            [
                ratio(F.sum("_ofi").over(back(fw)), F.avg(depth).over(back(fw))).alias("ofi_60s"),
                ratio(F.sum("_signed_n").over(back(fw)), "_trades_60").alias("tick_imb_60s"),
            ]
            if cfg.batch3
            else []
        ),
    )
    return fourth.withColumn("flow_imb_chg", F.col("flow_imb_60s") - F.lag("flow_imb_60s", cfg.change_lag).over(w))


def _batch3_inputs(w, run, cfg: FeatureConfig) -> list[Column]:
    """Quote-change order flow per bar, and the last row whose imbalance was not high."""
    b, a, bs, as_ = (F.col(c) for c in ("bid", "ask", "bid_size", "ask_size"))
    b0, a0, bs0, as0 = (F.lag(c, 1).over(w) for c in ("bid", "ask", "bid_size", "ask_size"))
    bid_part = F.when(b > b0, bs).when(b == b0, bs - bs0).otherwise(-bs0)
    ask_part = F.when(a < a0, as0).when(a == a0, as0 - as_).otherwise(-as_)
    high = F.coalesce(F.col("qimb") > cfg.imbalance_level, F.lit(False))
    return [
        (bid_part - ask_part).alias("_ofi"),
        F.last(F.when(~high, F.col("_rn")), ignorenulls=True).over(run).alias("_last_low_imb"),
    ]


def median_steps(cfg: FeatureConfig) -> list[RollingMedian]:
    return [
        RollingMedian("_vol_med", "_vol_short", cfg.vol_surge_long),
        RollingMedian("_trade_med", "_trade_short", cfg.tape_speed_long),
        RollingMedian("_spread_med", "spread_bps", cfg.norm_window, cfg.norm_min),
        RollingMedian("_tsize_med", "_tsize", cfg.norm_window, cfg.norm_min),
    ]


def finish_features(df: DataFrame, cfg: FeatureConfig) -> dict[str, Column]:
    px = F.col("px")
    rn = F.col("_rn")
    half = F.bround(px / 0.5) * 0.5
    out = {f"ret_{k}s": F.col(f"ret_{k}s") for k in cfg.ret_windows}
    out |= {
        "mom_accel": F.col("mom_accel"),
        "vwap_dist": F.col("vwap_dist"),
        "pullback": _change(px, F.col("_hi_win")),
        "vol_surge": ratio("_vol_short", "_vol_med"),
        "tape_speed": ratio("_trade_short", "_trade_med"),
        "spread_bps": F.col("spread_bps"),
        "qimb": F.col("qimb"),
        "qimb_chg_30s": F.col("qimb") - F.col("_qimb_lag"),
        "spread_rel": _change(F.col("spread_bps"), F.col("_spread_med")),
        "bid_ret_15s": _change(F.col("bid"), F.col("_bid_lag")),
        "sess_hi_dist": _change(px, F.col("_hi")),
        "up_streak": F.least(rn - F.coalesce("_last_flat", F.lit(0)), F.lit(cfg.streak_cap)).cast("double"),
        "tsize_surge": ratio("_tsize", "_tsize_med"),
        "flow_imb_60s": F.col("flow_imb_60s"),
        "flow_imb_chg": F.col("flow_imb_chg"),
        "luld_up_dist": ratio(_luld_band(F.col("_px_mean"), cfg.luld_tiered) - px, px),
        "round_dist": ratio(px - half, px),
        "range_compress": ratio(F.col("_range_short"), F.col("_high_long") - F.col("_low_long")),
        "mom_fresh": F.least(rn - F.coalesce("_last_high", F.lit(0)), F.lit(cfg.fresh_cap)) / float(cfg.fresh_cap),
        "vwap_slope": F.col("vwap_slope"),
        "quote_ok": (F.col("bid").isNotNull() & F.col("ask").isNotNull()).cast("double"),
        "tod_min": local_second("ts", cfg.zone) / 60.0 - cfg.open_minutes,
    }
    if cfg.batch3:
        streak = rn - F.coalesce("_last_low_imb", F.lit(0))
        out |= {
            "ofi_60s": F.col("ofi_60s"),
            "tick_imb_60s": F.col("tick_imb_60s"),
            "qimb_persist": F.least(streak, F.lit(cfg.persist_cap)) / float(cfg.persist_cap),
        }
    return out


def _uses_median(name: str) -> bool:
    return name in ("vol_surge", "tape_speed", "spread_rel", "tsize_surge")


def bar_features(bars: DataFrame, cfg: FeatureConfig = FeatureConfig(), keys: Sequence[str] = KEY, extra_steps: Sequence = (), carry: Sequence[str] = (), blocks: bool = False) -> DataFrame:
    """One feature row per bar; no row is dropped.

    Only the finished features and the four median sources travel through the
    Arrow pass. ``extra_steps`` (with their ``carry`` columns) lets a job run
    further per-session scans, such as barrier touches, in the same pass. With ``blocks``
    the pass takes blocks of whole sessions as the windows leave them, instead of one
    group (and another shuffle) per symbol and week.
    """
    df = with_windowed_inputs(bars, cfg, keys)
    final = finish_features(df, cfg)
    steps = median_steps(cfg)
    sources = [c for c in dict.fromkeys(s.source for s in steps) if c not in final]
    early = [c.alias(n) for n, c in final.items() if not _uses_median(n)]
    slim = df.select(*keys, "ts", *early, *sources, *carry)
    week = [F.date_trunc("week", c) if c == "session_date" else F.col(c) for c in keys]  # a group is at most seven sessions of a symbol
    scanned = scan_sessions(slim, keys, "ts", [*steps, *extra_steps], within=() if blocks else week)
    return scanned.select(
        *keys, "ts", *[c.alias(n) if _uses_median(n) else F.col(n) for n, c in final.items()], *carry, *[s.out for s in extra_steps]
    )


def drop_features(df: DataFrame, names: str | Sequence[str]) -> DataFrame:
    """Drop named columns ("a, b,,c" or a list); an unknown name is an error."""
    wanted = [n.strip() for n in names.split(",")] if isinstance(names, str) else list(names)
    wanted = [n for n in wanted if n]
    unknown = [n for n in wanted if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown feature columns: {unknown}")
    return df.drop(*wanted)


def window_tensors(features: DataFrame, names: Sequence[str], rows: int, keys: Sequence[str] = KEY, complete_only: bool = False) -> DataFrame:
    """The last ``rows`` feature vectors per bar as array<array<float>>, padded with NULLs at the front."""
    w = Window.partitionBy(*keys).orderBy("ts")
    vec = F.array(*[F.col(n).cast("float") for n in names])
    df = features.select(
        *keys, "ts", vec.alias("_v"), F.row_number().over(w).alias("position"),
        F.collect_list(vec).over(w.rowsBetween(-(rows - 1), 0)).alias("_seen"),
    )
    pad = F.array_repeat(F.array_repeat(F.lit(None).cast("float"), len(names)), rows - F.size("_seen"))
    df = df.withColumn("window", F.concat(pad, F.col("_seen")))
    if complete_only:
        df = df.where((F.col("position") >= rows) & ~F.exists("_v", lambda x: x.isNull()))
    return df.drop("_v", "_seen")

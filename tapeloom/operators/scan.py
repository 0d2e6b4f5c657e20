"""The morning scan: early-window features, realised labels, scored watchlist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.config import NEW_YORK, BarSpec
from tapeloom.functions.scalar import local_second, mid, ratio
from tapeloom.operators.bars import KEY, regular_hours

EARLY_OPEN_S = 9 * 3600 + 30 * 60
EARLY_CLOSE_S = 9 * 3600 + 45 * 60
MORNING_FEATURES = [
    "gap_pct", "prev_close", "prev_day_dollar_vol", "relvol_at_open", "first15_range_pct", "first15_vwap_dist",
    "first15_spread_bps_med", "first15_dollar_vol",
]


def early_bars(bars: DataFrame, open_s: int = EARLY_OPEN_S, close_s: int = EARLY_CLOSE_S) -> DataFrame:
    """Bars labelled in the early window, both ends included."""
    return regular_hours(bars, BarSpec(open_s=open_s, close_s=close_s), last_inclusive=True)


def outside_window(bars: DataFrame, open_s: int = EARLY_OPEN_S, close_s: int = EARLY_CLOSE_S, zone: str = NEW_YORK) -> DataFrame:
    """Rows that would leak later information into a morning decision; must be empty."""
    s = local_second("ts", zone)
    return bars.where(~s.between(open_s, close_s))


def morning_features(early: DataFrame, context: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """One row per stock-day from the early window and settled daily context.

    ``context`` has the keys, open, prev_close, prev_day_volume and
    prev_day_dollar_vol. A window is at most fifteen minutes of bars.
    """
    half = F.lit(0.5)
    traded = F.col("close").isNotNull()
    bps = ratio("spread", mid()) * 1e4
    agg = early.groupBy(*keys).agg(
        F.sum(F.coalesce(F.col("close") * F.col("volume"), F.lit(0.0))).alias("first15_dollar_vol"),
        F.sum("volume").alias("_vol"),
        F.max("close").alias("_hi"),
        F.min("close").alias("_lo"),
        F.min_by("close", F.when(traded, F.col("ts"))).alias("_first"),
        F.max_by("close", F.when(traded, F.col("ts"))).alias("_last"),
        F.avg("close").alias("_mean"),
        F.sum(F.when(traded, F.col("close") * F.col("volume"))).alias("_notional"),
        F.percentile(bps, half).alias("first15_spread_bps_med"),
    )
    df = agg.join(context, list(keys), "left")
    ref = F.when(F.col("open") > 0, F.col("open")).otherwise(F.col("_first"))
    vwap = F.when(F.col("_vol") > 0, ratio("_notional", "_vol")).otherwise(F.col("_mean"))
    return df.select(
        *keys,
        (ratio("open", "prev_close") - 1.0).alias("gap_pct"),
        "prev_close",
        "prev_day_dollar_vol",
        ratio("_vol", "prev_day_volume").alias("relvol_at_open"),
        ratio(F.col("_hi") - F.col("_lo"), ref).alias("first15_range_pct"),
        (ratio(F.col("_last"), vwap) - 1.0).alias("first15_vwap_dist"),
        "first15_spread_bps_med",
        "first15_dollar_vol",
    )


def scalpability_label(study: DataFrame, horizon: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Realised label of a stock-day: the taker oracle at one horizon."""
    return study.where(F.col("horizon_s") == horizon).select(*keys, F.col("taker_clip_pnl").alias("label"))


def scanner_dataset(early: DataFrame, context: DataFrame, study: DataFrame, horizon: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Morning features with their label; a day needs early bars and a label, missing context stays NULL."""
    label = scalpability_label(study, horizon, keys).where(F.col("label").isNotNull())
    return morning_features(early, context, keys).join(label, list(keys))


def rank_watchlist(scored: DataFrame, top_n: int = 30, budget: int = 40, score: str = "prediction") -> tuple[DataFrame, DataFrame]:
    """(ranked watchlist, names dropped by the budget). Unscored names are left out first."""
    order = [F.desc(score), F.col("symbol")]
    ok = scored.where(F.col(score).isNotNull())
    inside = ok.orderBy(*order).limit(budget)
    dropped = ok.join(inside.select("symbol"), "symbol", "left_anti").select("symbol")
    return inside.orderBy(*order).limit(top_n), dropped

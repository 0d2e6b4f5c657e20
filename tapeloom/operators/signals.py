"""Five-minute-bar signals, their ensemble, and the stops that follow from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.config import SignalConfig, TierConfig
from tapeloom.functions.scalar import atr_shares, clip, ratio

SYMBOL = ("symbol",)


def momentum_signal(closes: DataFrame, cfg: SignalConfig = SignalConfig()) -> DataFrame:
    """Latest 20-day return against all earlier ones (daily closes of a symbol; calendar-sized)."""
    w = Window.partitionBy("symbol").orderBy("date")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    df = closes.withColumn("_r", ratio("close", F.lag("close", cfg.momentum_days).over(w)) - 1.0)
    df = df.select(
        "symbol", "date", "_r", F.row_number().over(w).alias("_n"),
        F.avg("_r").over(earlier).alias("_m"), F.stddev_pop("_r").over(earlier).alias("_sd"),
    )
    z = F.abs(ratio(F.col("_r") - F.col("_m"), F.col("_sd")))
    ok = (F.col("_n") >= cfg.momentum_min_closes) & F.coalesce(F.col("_sd") >= 1e-12, F.lit(False))
    one = F.lit(1.0)
    return df.select(
        "symbol", "date",
        F.when(ok, F.signum("_r") * F.least(z / 3.0, one)).otherwise(0.0).alias("score"),
        F.when(ok, F.least(z / 2.0, one)).otherwise(0.0).alias("confidence"),
    )


def _vol_history(bars: DataFrame, cfg: SignalConfig, keys: Sequence[str]) -> DataFrame:
    """Log returns and their rolling root mean square, over all bars or the newest history_bars."""
    w = Window.partitionBy(*keys).orderBy("ts")
    age = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts")))
    kept = bars.select(*keys, "ts", "close", age.alias("age"))
    if cfg.history_bars is not None:
        kept = kept.where(F.col("age") <= cfg.history_bars)
    lc = F.ln(F.greatest("close", F.lit(1e-9)))
    kept = kept.select("*", F.row_number().over(w).alias("n"), (lc - F.lag(lc, 1).over(w)).alias("r"))
    f = w.rowsBetween(-(cfg.vol_window - 1), 0)
    full = F.count("r").over(f) >= cfg.vol_window
    return kept.withColumn("rv", F.when(full, F.sqrt(F.avg(F.col("r") * F.col("r")).over(f))))


def latest_vol_percentile(bars: DataFrame, cfg: SignalConfig = SignalConfig(), keys: Sequence[str] = SYMBOL) -> DataFrame:
    """Per key: bars kept, volatility points, and the share of them not above the latest."""
    h = _vol_history(bars, cfg, keys)
    w = Window.partitionBy(*keys)
    now = F.max(F.when(F.col("age") == 1, F.col("rv"))).over(w)
    h = h.withColumn("_now", now)
    return h.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.count("rv").alias("n_vol"),
        F.avg(F.when(F.col("rv").isNotNull(), (F.col("rv") <= F.col("_now")).cast("double"))).alias("vol_pct"),
    )


def vol_multiplier(pct: Column, n_bars: Column, n_vol: Column, cfg: SignalConfig = SignalConfig()) -> Column:
    """Position-size multiplier: 1 up to the median volatility, down to 0.3 at the extreme."""
    cold = (n_bars < cfg.regime_min_bars) | (n_vol < 10) | pct.isNull() | (pct <= 0.5)
    return F.when(cold, 1.0).otherwise(F.greatest(F.lit(0.3), 1.0 - 1.4 * (pct - 0.5)))


def mean_reversion_signal(bars: DataFrame, cfg: SignalConfig = SignalConfig(), keys: Sequence[str] = SYMBOL) -> DataFrame:
    """Fade the latest return against its window; damped when volatility is breaking out."""
    n = cfg.reversion_window
    w = Window.partitionBy(*keys).orderBy("ts")
    f = w.rowsBetween(-(n - 1), 0)
    h = _vol_history(bars, cfg, keys).select("*", F.avg("r").over(f).alias("_m"), F.stddev_pop("r").over(f).alias("_sd"))
    last = h.where("age = 1").select(*keys, "ts", "n", ((F.col("r") - F.col("_m")) / F.when(F.col("_sd") >= 1e-12, F.col("_sd"))).alias("z"))
    last = last.join(latest_vol_percentile(bars, cfg, keys), list(keys))
    ok = (F.col("n") >= n + 2) & F.col("z").isNotNull()
    conf = F.least(F.abs("z") / 3.0, F.lit(1.0))
    hot = (F.col("n_vol") > cfg.breakout_min_points) & (F.col("vol_pct") > cfg.breakout_pct)
    return last.select(
        *keys, "ts",
        F.when(ok, clip(-F.col("z") / 3.0, -1, 1)).otherwise(0.0).alias("score"),
        F.when(ok, F.when(hot, conf * 0.2).otherwise(conf)).otherwise(0.0).alias("confidence"),
        vol_multiplier(F.col("vol_pct"), F.col("n_bars"), F.col("n_vol"), cfg).alias("vol_mult"),
    )


def trend_weight(bars: DataFrame, cfg: SignalConfig = SignalConfig(), keys: Sequence[str] = SYMBOL) -> DataFrame:
    """Efficiency ratio of the last bars mapped to [0, 1]; 0.5 when short or flat."""
    n = cfg.reversion_window
    w = Window.partitionBy(*keys).orderBy("ts")
    age = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts")))
    df = bars.select(*keys, "ts", "close", age.alias("age")).where(F.col("age") <= n + 1)
    df = df.withColumn("_d", F.abs(F.col("close") - F.lag("close", 1).over(w)))
    net = F.abs(F.min_by("close", "age") - F.max_by("close", "age"))
    er = F.try_divide(net, F.sum("_d"))
    mapped = clip((er - cfg.er_floor) / (cfg.er_ceil - cfg.er_floor), 0, 1)
    short = (F.count(F.lit(1)) < n + 1) | F.coalesce(F.sum("_d") <= 0, F.lit(True))
    return df.groupBy(*keys).agg(F.when(short, 0.5).otherwise(mapped).alias("trend_w"))


def ensemble(signals: DataFrame, tier: TierConfig) -> DataFrame:
    """Blend the two opposing signals by the trend weight (needs mom_*, rev_*, trend_w, health_*)."""
    pool = tier.weight_momentum + tier.weight_mean_reversion
    wm, wr = pool * F.col("trend_w"), pool * (1.0 - F.col("trend_w"))
    cm = wm * F.coalesce("health_momentum", F.lit(1.0)) * F.col("mom_score") * F.col("mom_confidence")
    cr = wr * F.coalesce("health_mean_reversion", F.lit(1.0)) * F.col("rev_score") * F.col("rev_confidence")
    out = signals.select("*", wm.alias("w_momentum"), wr.alias("w_mean_reversion"), cm.alias("c_momentum"), cr.alias("c_mean_reversion"))
    out = out.withColumn("ensemble", clip(F.col("c_momentum") + F.col("c_mean_reversion"), -1, 1))
    return out.withColumn("candidate", F.abs("ensemble") >= tier.confidence_threshold)


def bound_violations(outputs: DataFrame) -> DataFrame:
    """Signals outside score [-1, 1] or confidence [0, 1]; must be empty."""
    ok = F.col("score").between(-1.0, 1.0) & F.col("confidence").between(0.0, 1.0)
    return outputs.where(~F.coalesce(ok, F.lit(False)))


def average_true_range(bars: DataFrame, cfg: SignalConfig = SignalConfig(), keys: Sequence[str] = SYMBOL) -> DataFrame:
    """Mean true range of the last period + 1 bars; the first of them has no earlier close."""
    w = Window.partitionBy(*keys).orderBy("ts")
    n = cfg.atr_period + 1
    span = F.col("high") - F.col("low")
    prev = F.lag("close", 1).over(w)

    def true_range(p: Column) -> Column:
        return F.greatest(span, F.abs(F.col("high") - p), F.abs(F.col("low") - p))

    df = bars.select("*", true_range(prev).alias("_tr"), true_range(F.col("close")).alias("_tr0"), F.row_number().over(w).alias("_n"))
    inner = w.rowsBetween(-(n - 2), 0)
    first = F.when(F.col("_n") >= n, F.lag("_tr0", n - 1).over(w)).otherwise(F.first("_tr0").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    used = F.least(F.col("_n"), F.lit(n))
    # rows after the first of the slice use the previous close
    tail = F.sum(F.when(F.col("_n") > 1, F.col("_tr"))).over(inner)
    atr = F.when(F.col("_n") < 2, 0.0).otherwise((first + F.coalesce(tail, F.lit(0.0))) / used)
    return df.withColumn("atr", atr).drop("_tr", "_tr0", "_n")


def trailing_stop(bars: DataFrame, mult: float, keys: Sequence[str] = SYMBOL, armed: str = "armed_stop") -> DataFrame:
    """Running maximum of close - mult x ATR, never below the armed stop; needs ``atr`` and the stop."""
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(F.col("close") - mult * F.col("atr")).over(w)
    return bars.withColumn("stop_price", F.when(F.col(armed).isNotNull(), F.greatest(best, F.col(armed))))


def stop_hits(bars: DataFrame, positions: DataFrame) -> DataFrame:
    """First bar after entry that touches the stop: low for longs, high for shorts."""
    held = bars.join(positions.where("stop_price is not null").select("symbol", "qty", "stop_price", "entry_ts"), "symbol")
    hit = ((F.col("qty") > 0) & (F.col("low") <= F.col("stop_price"))) | ((F.col("qty") < 0) & (F.col("high") >= F.col("stop_price")))
    first = held.where((F.col("ts") >= F.col("entry_ts")) & hit)
    return first.groupBy("symbol", "qty", "stop_price").agg(F.min("ts").alias("stop_ts"), F.min_by("close", "ts").alias("close"))


def signal_exits(positions: DataFrame, scores: DataFrame, tier: TierConfig) -> DataFrame:
    """Positions whose signal no longer supports them."""
    t = tier.confidence_threshold
    long_out = (F.col("qty") > 0) & (F.col("ensemble") < t)
    short_out = (F.col("qty") < 0) & (F.col("ensemble") > -t)
    return positions.join(scores.select("symbol", "ensemble"), "symbol").where(long_out | short_out)


def order_intents(scores: DataFrame, positions: DataFrame, tier: TierConfig, equity: float) -> DataFrame:
    """Move to the sized target: side, quantity and stop; nothing when already there.

    ``scores`` has symbol, ensemble, vol_mult, close, atr.
    """
    size = atr_shares(tier, F.lit(equity), F.col("close"), F.col("atr"), F.col("vol_mult"))
    short = -size if tier.allow_short else F.lit(0).cast("long")
    target = F.when(F.col("ensemble") < 0, short).otherwise(size)
    df = scores.join(positions.select("symbol", F.col("qty").alias("_cur")), "symbol", "left").withColumn("target_qty", target)
    df = df.withColumn("delta", F.col("target_qty") - F.coalesce("_cur", F.lit(0)))
    step = tier.stop_atr_multiple * F.col("atr")
    return df.where("delta <> 0").select(
        "symbol", F.when(F.col("delta") > 0, "buy").otherwise("sell").alias("side"), F.abs("delta").alias("qty"), "target_qty",
        F.col("close").alias("price_hint"), F.when(F.col("delta") > 0, F.col("close") - step).otherwise(F.col("close") + step).alias("stop_price"),
        F.lit("signal").alias("reason"), F.lit("intraday").alias("book"),
    )


def vol_percentile_series(bars: DataFrame, cfg: SignalConfig = SignalConfig(), keys: Sequence[str] = SYMBOL) -> DataFrame:
    return _vol_history(bars, cfg, keys).select(*keys, "ts", "r", "rv")

"""Entry decisions, their simulated fills on the tape, and fill reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.config import BarrierConfig, FillConfig
from tapeloom.functions.scalar import bracket_prices, sell_cost, tradable_nbbo, valid_nbbo
from tapeloom.functions.session_scan import At, Derive, FirstTouch, GreedyPick, RowsUntil, non_overlapping, scan_sessions
from tapeloom.operators.bars import KEY
from tapeloom.operators.labels import assumed_edge


@dataclass(frozen=True)
class NextGood:
    """Rows ahead to the first row at or after a given one where the flag holds."""

    out: str
    flag: str
    rows: str
    dtype = T.LongType()
    blockwise = True

    def __call__(self, frame: pd.DataFrame) -> pd.Series:
        n = len(frame)
        good = np.nonzero(frame[self.flag].to_numpy(dtype=bool))[0]
        rows = frame[self.rows].to_numpy(dtype=float)
        start = np.arange(n) + np.nan_to_num(rows, nan=0.0)
        k = np.searchsorted(good, start, side="left")
        pos = np.append(good, n)[k]
        ok = ~np.isnan(rows) & (pos < frame.end)
        return pd.Series(pos - np.arange(n), index=frame.index).astype("Int64").where(pd.Series(ok, index=frame.index))


def with_decisions(scored: DataFrame, threshold: float, qty: int, cfg: BarrierConfig, stop_mult: float = 1.0, columns: Sequence[str] = (*KEY, "ts")) -> DataFrame:
    """``columns`` of every scored bar and its entry decision; qty and what follows are NULL without one.

    A decision needs finite barriers, a valid uncrossed quote and a score at the threshold.
    ``scored`` has bid, ask, target_ps, stop_ps, p_win; label columns are carried
    along as the label-assumed edge when present.
    """
    ok = F.col("target_ps").isNotNull() & F.col("stop_ps").isNotNull() & tradable_nbbo() & (F.col("p_win") >= threshold)
    target, stop, deadline = bracket_prices(F.col("ask"), F.col("target_ps"), F.col("stop_ps"), F.col("ts"), cfg.timeout_rows * cfg.row_seconds, stop_mult)
    extra = {"label_edge_ps": assumed_edge()} if "label" in scored.columns else {}
    decision = {"qty": F.lit(qty).cast("long"), "target_px": target, "stop_px": stop, "deadline": deadline, **extra}
    return scored.select(*columns, *[F.when(ok, c).alias(name) for name, c in decision.items()])


def entry_decisions(scored: DataFrame, threshold: float, qty: int, cfg: BarrierConfig, stop_mult: float = 1.0, keys: Sequence[str] = KEY) -> DataFrame:
    """The scored bars at which ``with_decisions`` enters."""
    return with_decisions(scored, threshold, qty, cfg, stop_mult, (*keys, "ts")).where(F.col("qty").isNotNull())


def missing_bar_times(entries: DataFrame, bars: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Entries whose decision time is not a bar; must be empty."""
    return entries.join(bars.select(*keys, "ts"), [*keys, "ts"], "left_anti")


def _exit_steps() -> list:
    """From the entry row ``_in`` to the exit: stop before target, then deadline, then end of data."""

    def reason(f: pd.DataFrame) -> pd.Series:
        stop, target = f["_stop_in"].astype(float), f["_tgt_in"].astype(float)
        stopped = stop.notna() & ~(target < stop)
        out = np.select([stopped, target.notna(), f["_time_at"].notna()], ["stop", "target", "timeout"], "eod")
        return pd.Series(out, index=f.index)

    def exit_rows(f: pd.DataFrame) -> pd.Series:
        why = f["_reason"]
        rows = f["_last_at"].fillna(0)
        rows = rows.mask(why == "timeout", f["_time_at"]).mask(why == "target", f["_in"] + f["_tgt_in"]).mask(why == "stop", f["_in"] + f["_stop_in"])
        return rows.where(f["_in"].notna())

    def late(f: pd.DataFrame) -> pd.Series:
        both = pd.concat([f["_due"].astype(float), f["_in"].astype(float)], axis=1)
        return both.max(axis=1, skipna=False).where(f["_in_time"]).astype("Int64")

    return [
        RowsUntil("_due", "ts", "deadline"),
        Derive("_room", lambda f: (f["_due"].astype(float) - f["_in"].astype(float)).clip(lower=0).astype("Int64")),
        Derive("_late", late),
        FirstTouch("_stop_in", "_ok_bid", "stop_px", "le", "_room", "_in"),
        FirstTouch("_tgt_in", "_ok_bid", "target_px", "ge", "_room", "_in"),
        NextGood("_time_at", "_bid_ok", "_late"),
        LastGood("_last_at", "_bid_ok", "_in"),
        Derive("_reason", reason, T.StringType()),
        Derive("_exit_at", exit_rows),
        At("_xbid", "bid", "_exit_at"),
        At("_xspread", "spread", "_exit_at"),
        At("_exit_t", "ts", "_exit_at", T.TimestampType()),
        At("_entry_t", "ts", "_in", T.TimestampType()),
        GreedyPick("_kept", "_exit_at", strict=True),
    ]


def simulate_fills(bars: DataFrame, entries: DataFrame, cfg: FillConfig = FillConfig(), keys: Sequence[str] = KEY) -> DataFrame:
    """What each entry decision would really have got on the recorded tape.

    An entry's own outcome does not depend on earlier entries, only whether it
    is attempted does. So all outcomes come from one scan per session, which
    ends with the one-position-at-a-time rule over the filled ones.
    """
    tape = bars.select(*keys, "ts", "bid", "ask", "low", "ask_size", "spread", "volume")
    return fills_on_tape(tape.join(entries, [*keys, "ts"], "left"), cfg, keys)


def fills_on_tape(tape: DataFrame, cfg: FillConfig = FillConfig(), keys: Sequence[str] = KEY) -> DataFrame:
    """As simulate_fills, for a tape whose rows already carry their entry decision (qty NULL = none)."""
    if cfg.entry_mode not in ("taker", "maker"):
        raise ValueError(f"entries are taker or maker, not {cfg.entry_mode!r}")
    on = [*keys, "ts"]
    used = {*on, "qty", "target_px", "stop_px", "deadline", "bid", "ask", "low", "ask_size", "spread", "volume"}
    extra = [c for c in tape.columns if c not in used]
    w = Window.partitionBy(*keys).orderBy("ts")
    df = tape.select(
        "*",
        F.coalesce(F.col("bid") > 0, F.lit(False)).alias("_bid_ok"),
        F.sum("volume").over(w.rowsBetween(-(cfg.volume_window - 1), 0)).alias("_vol"),
        F.row_number().over(w).alias("_rn"),
        F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"),
        F.max("ts").over(Window.partitionBy(*keys)).alias("_end"),
    )
    decided = F.col("qty").isNotNull() & valid_nbbo()
    if cfg.entry_mode == "taker":
        displayed = F.col("ask_size") * cfg.lot_size
        part = cfg.max_participation * F.col("_vol")
        qty = F.when(displayed > 0, F.least(F.col("qty"), F.floor(displayed), F.floor(part)))
        df = df.withColumn("_fill_qty", F.when(decided & (qty > 0), qty)).withColumn("_entry_px", F.when(F.col("_fill_qty").isNotNull(), F.col("ask")))
        df = df.withColumn("_in", F.when(F.col("_fill_qty").isNotNull(), F.lit(0).cast("long")))
        first: list = []
    else:
        df = df.withColumn("_post", F.when(decided, F.col("bid")))
        first = [FirstTouch("_in", "low", "_post", "lt", cfg.maker_wait)]
    df = df.withColumn("_ok_bid", F.when(F.col("_bid_ok"), F.col("bid"))).withColumn(
        "_in_time", F.coalesce(F.col("deadline") <= F.col("_end"), F.lit(False))
    )
    df = scan_sessions(df, keys, "ts", [*first, *_exit_steps()]).where(F.col("qty").isNotNull())
    if cfg.entry_mode == "maker":
        df = df.withColumn("_fill_qty", F.when(F.col("_in").isNotNull(), F.col("qty"))).withColumn("_entry_px", F.when(F.col("_in").isNotNull(), F.col("bid")))
    reason = F.col("_reason")
    exit_px = (
        F.when(reason == "stop", F.col("_xbid") - F.coalesce(F.col("_xspread") / 2, F.lit(0.0)))
        .when(reason == "target", F.col("target_px")).otherwise(F.col("_xbid"))
    )
    df = df.withColumn("_exit_px", exit_px)
    df = df.withColumn("filled", F.col("_kept"))
    got = F.col("filled")

    def when_filled(c: Column) -> Column:
        return F.when(got, c)

    fee = sell_cost("_exit_px", F.col("_fill_qty"), cfg.fees)
    pnl = (F.col("_exit_px") - F.col("_entry_px") - fee) * F.col("_fill_qty")
    slip = F.when(reason == "stop", F.col("stop_px") - F.col("_exit_px")).when(reason == "target", F.lit(0.0))
    return df.select(
        *on, *extra, "filled",
        F.when(got, F.col("_fill_qty")).otherwise(F.lit(0)).cast("long").alias("fill_qty"),
        when_filled(F.col("_entry_px")).alias("entry_px"),
        when_filled(F.col("_exit_px")).alias("exit_px"),
        F.when(got, reason).otherwise("unfilled").alias("exit_reason"),
        when_filled(F.col("_entry_t")).alias("entry_t"),
        when_filled(F.col("_exit_t")).alias("exit_t"),
        F.when(got, pnl).otherwise(F.lit(0.0)).alias("pnl"),
        when_filled(slip).alias("slippage_ps"),
    )


@dataclass(frozen=True)
class LastGood:
    """Rows ahead to the last flagged row of the session at or after the entry."""

    out: str
    flag: str
    rows: str
    dtype = T.LongType()
    blockwise = True

    def __call__(self, frame: pd.DataFrame) -> pd.Series:
        n = len(frame)
        good = np.nonzero(frame[self.flag].to_numpy(dtype=bool))[0]
        rows = frame[self.rows].to_numpy(dtype=float)
        start = np.arange(n) + np.nan_to_num(rows, nan=0.0)
        last = np.append(-1, good)[np.searchsorted(good, frame.end, side="left")]
        ok = ~np.isnan(rows) & (start <= last)
        return pd.Series(last - np.arange(n), index=frame.index).astype("Int64").where(pd.Series(ok, index=frame.index))


def fill_report(sim: DataFrame, mode_col: str = "entry_mode") -> DataFrame:
    """Per entry mode: fill rate, PnL, expectancy, and the haircut against the label assumption."""
    f = F.col("filled")
    n_filled = F.count(F.when(f, 1))
    shares, pnl = F.sum("fill_qty"), F.sum("pnl")
    assumed = F.sum(F.when(f, F.col("label_edge_ps") * F.col("fill_qty")))
    return sim.groupBy(mode_col).agg(
        F.count(F.lit(1)).alias("n_attempted"),
        n_filled.alias("n_filled"),
        F.round(n_filled / F.count(F.lit(1)), 4).alias("fill_rate"),
        F.round(F.coalesce(F.avg(F.when(f, F.col("fill_qty"))), F.lit(0.0)), 1).alias("mean_fill_qty"),
        F.round(pnl, 2).alias("sim_pnl_usd"),
        F.round(F.try_divide(pnl, shares), 5).alias("sim_expectancy_ps"),
        F.round(F.coalesce(assumed, F.lit(0.0)), 2).alias("label_pnl_same_fills_usd"),
        F.when(assumed > 0, F.round(100 * (1 - F.try_divide(pnl, assumed)), 1)).alias("haircut_pct"),
        F.round(F.coalesce(F.avg(F.when(f & (F.col("exit_reason") == "stop"), F.col("slippage_ps"))), F.lit(0.0)), 5).alias("stop_slippage_ps_mean"),
    )


def exit_reason_counts(sim: DataFrame, mode_col: str = "entry_mode") -> DataFrame:
    return sim.where("filled").groupBy(mode_col, "exit_reason").agg(F.count(F.lit(1)).alias("n"))


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = KEY, shares: int = 1000) -> DataFrame:
    """Non-overlapping trade economics at each score threshold.

    ``scored`` has ts, p_win, label, timeout_edge, exit_s, target_ps, stop_ps. A
    threshold without any trade still gets its row.
    """
    spark = scored.sparkSession
    grid = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    base = scored.withColumn("edge", assumed_edge())
    n_days = base.agg(F.countDistinct("session_date").alias("n_days"))
    hold = F.coalesce(F.col("exit_s"), F.lit(0.0))
    cand = (
        base.select(*keys, "ts", "p_win", "label", "edge", F.timestamp_micros(F.unix_micros("ts") + F.round(hold * 1_000_000).cast("long")).alias("_free"))
        .withColumn("threshold", F.explode(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= F.col("p_win"))))
    )
    kept = non_overlapping(cand, ["threshold", *keys], "ts", "_free")
    stats = kept.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("label") == 1.0, 1)).alias("wins"), F.avg("edge").alias("exp"), F.sum("edge").alias("total")
    )
    n = F.coalesce("n", F.lit(0))
    return grid.join(F.broadcast(stats), "threshold", "left").crossJoin(F.broadcast(n_days)).select(
        "threshold",
        n.alias("n_trades"),
        F.coalesce(F.try_divide(n, F.col("n_days")), F.lit(0.0)).alias("trades_per_day"),
        F.try_divide(F.col("wins"), F.col("n")).alias("hit_rate"),
        F.col("exp").alias("expectancy_ps"),
        (F.col("exp") * shares).alias("expectancy_usd_1000sh"),
        F.coalesce(F.col("total") * shares, F.lit(0.0)).alias("sum_pnl_1000sh"),
    )

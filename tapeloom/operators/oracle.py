"""Perfect-foresight trades on bars, and the per-day viability summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tapeloom.config import LOT_SIZE, OracleConfig
from tapeloom.functions.ordered import exact_quantiles
from tapeloom.functions.scalar import mid, price_bucket, ratio, sell_cost, valid_nbbo
from tapeloom.functions.session_scan import At, Derive, FirstTouch, first_touch, greedy, non_overlapping, scan_sessions
from tapeloom.operators.bars import KEY


def _numbered(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("ts")
    return bars.select(
        "*", F.row_number().over(w).alias("_rn"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"), valid_nbbo().alias("_ok")
    )


def taker_trades(bars: DataFrame, cfg: OracleConfig = OracleConfig(), keys: Sequence[str] = KEY) -> DataFrame:
    """Buy at the ask, sell at the bid a horizon later, whenever that pays; no overlap."""
    h = cfg.horizon_rows
    w = Window.partitionBy(*keys).orderBy("ts")
    df = _numbered(bars.select(*keys, "ts", "bid", "ask", "bid_size", "ask_size"), keys).select(
        "*",
        F.lead("bid", h).over(w).alias("exit"),
        F.lead("bid_size", h).over(w).alias("_exit_size"),
        F.lead("_ok", h).over(w).alias("_ok_h"),
    )
    edge = F.col("exit") - F.col("ask") - sell_cost("exit", cfg.clip_shares, cfg.fees)
    displayed = F.least("ask_size", "_exit_size") * LOT_SIZE
    cand = df.where(F.col("_ok") & F.col("_ok_h")).withColumn("edge_ps", edge).where("edge_ps > 0")
    cand = cand.select(
        *keys, "ts", F.col("ask").alias("entry"), "exit", "edge_ps", (F.col("edge_ps") * cfg.clip_shares).alias("clip_pnl"),
        displayed.alias("displayed_shares"),
        (F.col("edge_ps") * F.least(F.lit(float(cfg.clip_shares)), F.greatest(displayed, F.lit(0.0)))).alias("displayed_pnl"),
        F.col("_rn").alias("start_row"), (F.col("_rn") + h).alias("release_row"),
    )
    return non_overlapping(cand, keys, "start_row", "release_row")


def maker_trades(bars: DataFrame, cfg: OracleConfig = OracleConfig(), keys: Sequence[str] = KEY) -> DataFrame:
    """Post at the bid, exit posted at the ask or crossed after the wait; no overlap."""
    h, wait = cfg.horizon_rows, cfg.maker_wait
    df = _numbered(bars.select(*keys, "ts", "bid", "ask", "low", "high"), keys)
    df = df.withColumn("_entry", F.when(F.col("_ok") & (F.col("_rn") - 1 + h + wait < F.col("_n")), F.col("bid")))
    df = df.withColumn("_ok_bid", F.when(F.col("_ok"), F.col("bid"))).withColumn("_ok_ask", F.when(F.col("_ok"), F.col("ask")))
    steps = [
        FirstTouch("_fill_in", "low", "_entry", "lt", wait),
        Derive("_exit_at", lambda f: f["_fill_in"] + h),
        Derive("_last_at", lambda f: f["_fill_in"] + h + wait),
        At("_target", "_ok_ask", "_exit_at"),
        At("_cross", "_ok_bid", "_last_at"),
        FirstTouch("_hit_in", "high", "_target", "gt", wait, "_exit_at"),
    ]
    df = scan_sessions(df, keys, "ts", steps)
    inside = F.col("_rn") - 1 + F.col("_last_at") < F.col("_n")
    hit = F.col("_hit_in").isNotNull()
    df = df.where(inside & F.col("_target").isNotNull()).withColumn("exit", F.when(hit, F.col("_target")).otherwise(F.col("_cross")))
    edge = F.col("exit") - F.col("_entry") - sell_cost("exit", cfg.clip_shares, cfg.fees)
    held = F.when(hit, F.col("_exit_at") + F.col("_hit_in")).otherwise(F.col("_last_at"))
    cand = df.withColumn("edge_ps", edge).where("edge_ps > 0").select(
        *keys, "ts", F.col("_entry").alias("entry"), "exit", "edge_ps", (F.col("edge_ps") * cfg.clip_shares).alias("clip_pnl"),
        (~hit).alias("exit_crossed"), F.col("_rn").alias("start_row"), (F.col("_rn") + held + 1).alias("release_row"),
    )
    return non_overlapping(cand, keys, "start_row", "release_row")


def frictionless(bars: DataFrame, horizon: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Sum of the positive mid moves over the horizon, per session."""
    w = Window.partitionBy(*keys).orderBy("ts")
    moved = bars.select(*keys, "ts", mid().alias("_m")).withColumn("_d", F.lead("_m", horizon).over(w) - F.col("_m"))
    return moved.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_d"))), F.lit(0.0)).alias("frictionless_ps"))


def tape_stats(bars: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Session statistics that do not depend on the horizon (a session's rows are bounded)."""
    half = F.lit(0.5)
    dollars = F.when(F.col("n_trades") > 0, F.col("volume") * F.col("vwap"))
    return bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_seconds"),
        F.avg(valid_nbbo().cast("double")).alias("quote_coverage"),
        F.percentile("spread", half).alias("med_spread"),
        F.percentile(ratio("spread", mid()) * 1e4, half).alias("med_spread_bps"),
        F.sum("volume").alias("day_volume"),
        F.coalesce(F.percentile(dollars, half), F.lit(0.0)).alias("med_second_dollar_vol"),
    )


def _trade_stats(trades: DataFrame, name: str, keys: Sequence[str], extra: bool) -> DataFrame:
    aggs = [
        F.count(F.lit(1)).alias(f"{name}_n"),
        F.sum("clip_pnl").alias(f"{name}_clip_pnl"),
        F.percentile("edge_ps", F.lit(0.5)).alias(f"{name}_med_edge_ps"),
    ]
    if extra:
        aggs.append(F.sum("displayed_pnl").alias(f"{name}_displayed_pnl"))
    return trades.groupBy(*keys).agg(*aggs)


def day_summary(bars: DataFrame, cfg: OracleConfig = OracleConfig(), keys: Sequence[str] = KEY) -> DataFrame:
    """One row per session: tape statistics and both oracles at one horizon; no trades -> 0."""
    out = tape_stats(bars, keys).join(frictionless(bars, cfg.horizon_rows, keys), list(keys))
    taker = _trade_stats(taker_trades(bars, cfg, keys), "taker", keys, True)
    maker = _trade_stats(maker_trades(bars, cfg, keys), "maker", keys, False)
    out = out.join(taker, list(keys), "left").join(maker, list(keys), "left")
    numbers = [c for c in out.columns if c.startswith(("taker_", "maker_"))]
    return out.fillna(0, numbers).withColumn("horizon_s", F.lit(cfg.horizon_rows))


_STUDY_INPUTS = ("bid", "ask", "bid_size", "ask_size", "low", "high", "spread", "volume", "vwap", "n_trades")
_STUDY_ROW = (
    "n_seconds long, quote_coverage double, med_spread double, med_spread_bps double, day_volume double, med_second_dollar_vol double, frictionless_ps double, "
    "taker_n long, taker_clip_pnl double, taker_med_edge_ps double, taker_displayed_pnl double, maker_n long, maker_clip_pnl double, maker_med_edge_ps double, horizon_s int"
)


def _median(x: np.ndarray) -> float | None:
    x = x[~np.isnan(x)]
    return float(np.median(x)) if len(x) else None


def _sell_cost(price: np.ndarray, cfg: OracleConfig) -> np.ndarray:
    fees = cfg.fees
    return price * fees.sec_rate + min(fees.taf_per_share * cfg.clip_shares, fees.taf_cap) / cfg.clip_shares


def _picked(start: np.ndarray, release: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Positions of the profitable, non-overlapping trades, earliest first."""
    good = np.flatnonzero(edge > 0)
    return good[greedy(start[good], release[good], False)]


def study_session(x: Mapping[str, np.ndarray], horizons: Sequence[int], cfg: OracleConfig) -> list[tuple]:
    """Summaries of one session at all horizons; rows of ``_STUDY_ROW``.

    Quotes, the maker's fills and the horizon-free statistics are found once; only the
    exits and the selection are done again for each horizon.
    """
    n, bid, ask = len(x["bid"]), x["bid"], x["ask"]
    rows = np.arange(n)
    ok = (bid > 0) & ~np.isnan(ask)
    mid_px = (bid + ask) / 2.0
    dollars = np.where(x["n_trades"] > 0, x["volume"] * x["vwap"], np.nan)
    tape = (
        n, float(ok.mean()), _median(x["spread"]), _median(np.where(mid_px == 0, np.nan, x["spread"] / np.where(mid_px == 0, 1.0, mid_px)) * 1e4),
        float(np.nansum(x["volume"])) if not np.isnan(x["volume"]).all() else None, _median(dollars) or 0.0,
    )
    entry, ok_bid, ok_ask = np.where(ok, bid, np.nan), np.where(ok, bid, np.nan), np.where(ok, ask, np.nan)
    wait = cfg.maker_wait
    fill = first_touch(x["low"], entry, np.zeros(n), np.full(n, float(wait)), "lt")

    def at(values: np.ndarray, where: np.ndarray) -> np.ndarray:
        inside = (where >= 0) & (where < n)
        return np.where(inside, values[np.where(inside, where, 0)], np.nan)

    out = []
    for h in horizons:
        later = rows + h
        moved = at(mid_px, later) - mid_px
        exit_px = np.where(ok & at(ok.astype(float), later).astype(bool), at(bid, later), np.nan)
        edge = exit_px - ask - _sell_cost(exit_px, cfg)
        took = _picked(rows, later, edge)
        displayed = np.fmin(x["ask_size"], at(x["bid_size"], later)) * LOT_SIZE
        shown = edge[took] * np.minimum(cfg.clip_shares, np.maximum(np.nan_to_num(displayed[took]), 0.0))

        posted = np.flatnonzero((fill > 0) & (rows + h + wait < n))
        leave = fill[posted].astype(np.int64) + h
        target = at(ok_ask, posted + leave)
        hit_in = np.full(n, np.nan)
        level, base = np.full(n, np.nan), np.full(n, np.nan)
        level[posted], base[posted] = target, leave
        hit_in = first_touch(x["high"], level, base, np.full(n, float(wait)), "gt")[posted]
        hit = hit_in > 0
        inside = (posted + leave + wait < n) & ~np.isnan(target)
        sold = np.where(hit, target, at(ok_bid, posted + leave + wait))
        gain = np.where(inside, sold - entry[posted] - _sell_cost(sold, cfg), np.nan)
        made = _picked(posted, posted + np.where(hit, leave + hit_in.astype(np.int64), leave + wait) + 1, gain)
        out.append((
            *tape, float(np.nansum(np.where(moved > 0, moved, 0.0))),
            len(took), float(edge[took].sum() * cfg.clip_shares), _median(edge[took]) or 0.0, float(shown.sum()),
            len(made), float(gain[made].sum() * cfg.clip_shares), _median(gain[made]) or 0.0, h,
        ))
    return out


def viability_study(bars: DataFrame, horizons: Sequence[int], meta: DataFrame | None = None, cfg: OracleConfig = OracleConfig(), keys: Sequence[str] = KEY) -> DataFrame:
    """Session x horizon matrix with the runner metadata of the day, when there is any.

    One shuffle and one pass per session for all horizons; the rows equal those of
    ``day_summary`` at each horizon.
    """
    kinds = dict(bars.dtypes)
    names = [c.split()[0] for c in _STUDY_ROW.split(", ")]
    fields = StructType.fromDDL(_STUDY_ROW).fields

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("ts")
        x = {c: part.column(c).cast(pa.float64()).to_numpy() for c in _STUDY_INPUTS}
        with np.errstate(all="ignore"):
            rows = study_session(x, horizons, cfg)
        own = [pa.chunked_array([part.column(k).slice(0, 1).combine_chunks().take(pa.array([0] * len(rows)))]) for k in keys]
        return pa.table([*own, *(pa.array(v, to_arrow_type(f.dataType)) for v, f in zip(zip(*rows), fields))], [*keys, *names])

    rows = bars.select(*keys, "ts", *_STUDY_INPUTS).groupBy(*keys).applyInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + _STUDY_ROW)
    if meta is None:
        return rows.withColumn("price_bucket", F.lit("other"))
    m = meta.select(*keys, "gain", "relvol", "dollar_vol", price_bucket("open").alias("price_bucket"))
    return rows.join(m, list(keys), "left").fillna("other", ["price_bucket"])


def pivot_by_horizon(study: DataFrame, value: str, horizons: Sequence[int], how: str = "median") -> DataFrame:
    """price_bucket x horizon table of the median, or of the percentage of positive values.

    A bucket can hold most of the study, so the median uses the ordered quantile,
    not a per-group buffer.
    """
    if how == "median":
        cells = exact_quantiles(study.select("price_bucket", "horizon_s", value), value, {"v": 0.5}, ["price_bucket", "horizon_s"])
    elif how == "pct_positive":
        cells = study.groupBy("price_bucket", "horizon_s").agg((F.avg((F.col(value) > 0).cast("double")) * 100).alias("v"))
    else:
        raise ValueError(f"unknown pivot: {how}")
    return cells.groupBy("price_bucket").pivot("horizon_s", list(horizons)).agg(F.first("v"))


def study_header(study: DataFrame) -> DataFrame:
    return study.agg(
        F.countDistinct(F.struct("symbol", "session_date")).alias("stock_days"),
        F.min("session_date").alias("first_date"),
        F.max("session_date").alias("last_date"),
        F.countDistinct("symbol").alias("symbols"),
    )


def study_verdict(study: DataFrame) -> DataFrame:
    """Per bucket and horizon: distinct stock-days and the share with a profitable oracle."""
    return study.groupBy("price_bucket", "horizon_s").agg(
        F.countDistinct(F.struct("symbol", "session_date")).alias("stock_days"),
        F.avg((F.col("taker_clip_pnl") > 0).cast("double")).alias("taker_positive"),
        F.avg((F.col("maker_clip_pnl") > 0).cast("double")).alias("maker_positive"),
    )



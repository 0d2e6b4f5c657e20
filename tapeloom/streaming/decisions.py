"""Entry decisions on a stream of final bars, from keyed state.

Per (symbol, session) the state holds the last rows that any feature looks back at, and
the running values of the session before them. A micro-batch computes the features of
its own rows from that, so its work follows its rows and the look-back, not the length
of the session, and nothing is read back from storage. The values equal those of the
batch operators (``bar_features``, ``with_barriers``) row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom.config import BarrierConfig, FeatureConfig
from tapeloom.functions.scalar import no_nan, tradable_nbbo
from tapeloom.operators.bar_features import feature_names
from tapeloom.operators.bars import KEY
from tapeloom.streaming.processors import in_groups

INPUTS = ("close", "high", "low", "volume", "n_trades", "vwap", "bid", "ask", "bid_size", "ask_size", "spread")
#: Running values of a session: the last price, sums, the high, and the rows of the last flat, high and low-imbalance bar.
CARRIED = ("rows", "px", "notional", "volume", "high", "flat", "new_high", "low_imb")


def look_back(cfg: FeatureConfig, barrier: BarrierConfig) -> int:
    """Rows before a bar that its features and barriers depend on, running values aside."""
    return 1 + max(
        *cfg.ret_windows, 2 * cfg.mom_accel_window, cfg.pullback_window, cfg.vol_surge_long + cfg.vol_surge_short, cfg.tape_speed_long + cfg.tape_speed_short,
        cfg.norm_window + cfg.flow_window, cfg.change_lag + cfg.flow_window + 1, cfg.slope_lag, cfg.bid_lag, barrier.vol_window,
    )


def _lag(x: np.ndarray, k: int, first: float = np.nan) -> np.ndarray:
    """The value k rows before; ``first`` is the value just before the first row."""
    out = np.full(len(x), np.nan)
    out[k:] = x[: max(0, len(x) - k)]
    if k == 1 and len(x):
        out[0] = first
    return out


def _div(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b == 0, np.nan, a / np.where(b == 0, 1.0, b))


def _window(x: np.ndarray, w: int, stat: Callable, need: int = 1, rows: int | None = None) -> np.ndarray:
    """``stat`` of the last w values of each of the last ``rows`` rows; missing unless ``need`` are there."""
    rows = len(x) if rows is None else rows
    padded = np.concatenate([np.full(w - 1, np.nan), x])[len(x) - rows :]
    blocks = np.lib.stride_tricks.sliding_window_view(padded, w)
    enough = np.count_nonzero(~np.isnan(blocks), axis=1) >= max(1, need)
    out = np.full(rows, np.nan)
    if enough.any():
        out[enough] = stat(blocks[enough], axis=1)
    return out


def _since(hit: np.ndarray, number: np.ndarray, before: float) -> np.ndarray:
    """Row number of the last hit up to each row."""
    return np.maximum.accumulate(np.where(hit, number, before)) if len(hit) else number


def tail_features(x: Mapping[str, np.ndarray], minutes: np.ndarray, carried: Mapping[str, float], new: int, cfg: FeatureConfig, barrier: BarrierConfig) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(features and barriers of the last ``new`` rows, running values of all rows).

    ``x`` has the kept rows and the new ones in order; ``carried`` the running values
    before the first of them; ``minutes`` the local minute of the day of the new rows.
    """
    n = len(x["close"])
    tail = slice(n - new, n)
    number = carried["rows"] + np.arange(1, n + 1)
    px = pd.Series(np.concatenate([[carried["px"]], x["close"]])).ffill().to_numpy()[1:]
    before = _lag(px, 1, carried["px"])
    notional = carried["notional"] + np.cumsum(np.nan_to_num(x["vwap"]) * np.nan_to_num(x["volume"]))
    volume = carried["volume"] + np.cumsum(np.nan_to_num(x["volume"]))
    high = np.fmax.accumulate(np.fmax(px, carried["high"])) if n else px
    bid, ask, bid_size, ask_size = x["bid"], x["ask"], x["bid_size"], x["ask_size"]
    depth = bid_size + ask_size
    qimb = _div(bid_size - ask_size, depth)
    flat = _since(~(px > before), number, carried["flat"])
    new_high = _since(px >= high, number, carried["new_high"])
    low_imb = _since(~(qimb > cfg.imbalance_level), number, carried["low_imb"])
    running = dict(zip(CARRIED, (number, px, notional, volume, high, flat, new_high, low_imb)))

    spread_bps = _div(x["spread"], (bid + ask) / 2.0) * 1e4
    svwap = _div(notional, volume)
    vwap_dist = _div(px - svwap, svwap)
    mom = _div(px, _lag(px, cfg.mom_accel_window)) - 1.0 if cfg.mom_accel_window > 1 else _div(px, before) - 1.0
    moved = np.sign(px - before)
    fw, nw, nm = cfg.flow_window, cfg.norm_window, cfg.norm_min
    vol_short = _window(x["volume"], cfg.vol_surge_short, np.nansum)
    trade_short = _window(x["n_trades"], cfg.tape_speed_short, np.nansum)
    vol_flow, trades_flow = _window(x["volume"], fw, np.nansum), _window(x["n_trades"], fw, np.nansum)
    tsize = _div(vol_flow, trades_flow)
    flow = _div(_window(moved * x["volume"], fw, np.nansum), vol_flow)
    last = lambda v: v[tail]
    wide = lambda v, w, stat, need=1: _window(v, w, stat, need, new)
    mean_px = wide(px, nw, np.nanmean, nm)
    if cfg.luld_tiered:
        band = np.select([mean_px >= 3.0, mean_px >= 0.75], [mean_px * 1.10, mean_px * 1.20], mean_px + np.fmin(0.15, mean_px * 0.75))
    else:
        band = mean_px * 1.10
    p, rn = last(px), last(number)
    out = {f"ret_{k}s": _div(p, last(_lag(px, k, carried["px"]))) - 1.0 for k in cfg.ret_windows}
    out |= {
        "mom_accel": last(mom - _lag(mom, cfg.mom_accel_window)),
        "vwap_dist": last(vwap_dist),
        "pullback": _div(p, wide(px, cfg.pullback_window, np.nanmax)) - 1.0,
        "vol_surge": _div(last(vol_short), wide(vol_short, cfg.vol_surge_long, np.nanmedian)),
        "tape_speed": _div(last(trade_short), wide(trade_short, cfg.tape_speed_long, np.nanmedian)),
        "spread_bps": last(spread_bps),
        "qimb": last(qimb),
        "qimb_chg_30s": last(qimb - _lag(qimb, cfg.change_lag)),
        "spread_rel": _div(last(spread_bps), wide(spread_bps, nw, np.nanmedian, nm)) - 1.0,
        "bid_ret_15s": _div(last(bid), last(_lag(bid, cfg.bid_lag))) - 1.0,
        "sess_hi_dist": _div(p, last(high)) - 1.0,
        "up_streak": np.minimum(rn - last(flat), cfg.streak_cap).astype(float),
        "tsize_surge": _div(last(tsize), wide(tsize, nw, np.nanmedian, nm)),
        "flow_imb_60s": last(flow),
        "flow_imb_chg": last(flow - _lag(flow, cfg.change_lag)),
        "luld_up_dist": _div(band - p, p),
        "round_dist": _div(p - np.round(p / 0.5) * 0.5, p),
        "range_compress": _div(wide(x["high"], fw, np.nanmax) - wide(x["low"], fw, np.nanmin), wide(x["high"], nw, np.nanmax, nm) - wide(x["low"], nw, np.nanmin, nm)),
        "mom_fresh": np.minimum(rn - last(new_high), cfg.fresh_cap) / cfg.fresh_cap,
        "vwap_slope": last(vwap_dist - _lag(vwap_dist, cfg.slope_lag)),
        "quote_ok": (~np.isnan(last(bid)) & ~np.isnan(last(ask))).astype(float),
        "tod_min": minutes - cfg.open_minutes,
    }
    if cfg.batch3:
        b0, a0, bs0, as0 = (_lag(v, 1) for v in (bid, ask, bid_size, ask_size))
        bid_part = np.where(bid > b0, bid_size, np.where(bid == b0, bid_size - bs0, -bs0))
        ask_part = np.where(ask < a0, as0, np.where(ask == a0, as0 - ask_size, -ask_size))
        out |= {
            "ofi_60s": _div(wide(bid_part - ask_part, fw, np.nansum), wide(depth, fw, np.nanmean)),
            "tick_imb_60s": _div(wide(moved * x["n_trades"], fw, np.nansum), last(trades_flow)),
            "qimb_persist": np.minimum(rn - last(low_imb), cfg.persist_cap) / cfg.persist_cap,
        }
    if barrier.mode == "fixed":
        target, stop = np.full(new, barrier.target_ps), np.full(new, barrier.stop_ps)
    else:
        need = max(2, barrier.vol_window // 3)
        span = wide(px, barrier.vol_window, np.nanmax, need) - wide(px, barrier.vol_window, np.nanmin, need)
        target, stop = np.maximum(span * barrier.vol_target_mult, barrier.min_target_ps), np.maximum(span * barrier.vol_stop_mult, barrier.min_stop_ps)
    return out | {"bid": last(bid), "ask": last(ask), "target_ps": target, "stop_ps": stop}, running


class FeatureState(StatefulProcessor):
    """Features and barriers of every new bar of the (symbol, session)s of a bucket.

    Bars come in order (as ``stream_bars`` gives them); a bar that is not later than the
    last one of its session is a repetition and is left out. Keyed by (bucket of symbols,
    session), so that a call into Python and a state access cost many sessions and not one.
    """

    STATE = {"symbols": "string", "kept": "binary", "last_us": "long", **dict.fromkeys(CARRIED, "double")}

    def __init__(self, cfg: FeatureConfig, barrier: BarrierConfig):
        self.cfg, self.barrier, self.reach = cfg, barrier, look_back(cfg, barrier)
        self.shown = [*feature_names(cfg), "bid", "ask", "target_ps", "stop_ps"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", ", ".join(f"{c} array<{k}>" for c, k in self.STATE.items()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["symbol", "ts"], kind="stable").drop_duplicates(["symbol", "ts"], ignore_index=True)
        local = batch["ts"].dt.tz_localize("UTC").dt.tz_convert(self.cfg.zone).dt.tz_localize(None)
        minutes = ((local - local.dt.normalize()).dt.total_seconds() / 60.0).to_numpy()
        us, inputs = batch["ts"].astype("datetime64[us]").astype("int64").to_numpy(), batch[list(INPUTS)].to_numpy(dtype=float)
        nan = float("nan")
        known = {name: state for name, *state in zip(*self.state.get())} if self.state.exists() else {}
        made, taken = [], []
        for symbol, i, j in in_groups(batch, "symbol"):
            kept, last_us, *values = known.get(symbol, (b"", -(1 << 62), 0.0, nan, 0.0, 0.0, nan, 0.0, 0.0, 0.0))
            i += int(np.searchsorted(us[i:j], last_us, side="right"))
            if i == j:
                continue
            table = np.concatenate([np.frombuffer(kept, float).reshape(-1, len(INPUTS)), inputs[i:j]])
            with np.errstate(all="ignore"):
                out, running = tail_features(dict(zip(INPUTS, table.T)), minutes[i:j], dict(zip(CARRIED, values)), j - i, self.cfg, self.barrier)
            drop = max(0, len(table) - self.reach)
            if drop:
                values = [float(running[c][drop - 1]) for c in CARRIED]
            known[symbol] = (table[drop:].tobytes(), int(us[j - 1]), *values)
            made.append(np.column_stack([out[c] for c in self.shown]))
            taken.append(np.arange(i, j))
        if made:
            self.state.update((list(known), *map(list, zip(*known.values()))))
            at = batch.iloc[np.concatenate(taken)].reset_index(drop=True)
            yield pd.concat([at[["symbol"]].assign(session_date=key[1], ts=at["ts"]), pd.DataFrame(np.concatenate(made), columns=self.shown)], axis=1)


def stream_features(bars: DataFrame, cfg: FeatureConfig = FeatureConfig(), barrier: BarrierConfig = BarrierConfig()) -> DataFrame:
    """Features, quote and barriers of a stream of final bars, one row per bar."""
    from tapeloom.streaming.jobs import bucketed, use_rocksdb

    use_rocksdb(bars.sparkSession)
    step = FeatureState(cfg, barrier)
    schema = "symbol string, session_date date, ts timestamp, " + ", ".join(f"{c} double" for c in step.shown)
    keyed = bucketed(bars.select(*KEY, "ts", *INPUTS), "symbol", 64).groupBy("_bucket", "session_date")
    out = keyed.transformWithStateInPandas(statefulProcessor=step, outputStructType=schema, outputMode="Append", timeMode="None")
    return out.select(*KEY, "ts", *[no_nan(c).alias(c) for c in step.shown])


def linear_score(weights: Mapping[str, float], bias: float = 0.0) -> Column:
    """Logistic score of a fixed linear model; missing features count as 0."""
    total = F.lit(bias)
    for name, w in weights.items():
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * w
    return 1.0 / (1.0 + F.exp(-total))


def decisions(features: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float, barrier: BarrierConfig = BarrierConfig(), exec_stop_mult: float = 1.0, keys: Sequence[str] = KEY) -> DataFrame:
    """Score, barriers and entry flag of the bars with a valid quote and warm barriers; batch or stream.

    ``score`` adds ``p_win``: a column expression, or a fitted model's ``transform``.
    """
    scored = score(features.where(F.col("target_ps").isNotNull() & tradable_nbbo()))
    return scored.select(
        *keys, "ts", "p_win", "target_ps", "stop_ps", F.lit(barrier.timeout_rows * barrier.row_seconds).alias("timeout_s"),
        (F.col("stop_ps") * exec_stop_mult).alias("exec_stop_ps"), F.lit(threshold).alias("threshold"), (F.col("p_win") >= threshold).alias("enter"),
    )

"""Scalar column expressions. NULL means missing everywhere; NaN never appears."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.config import LOT_SIZE, NEW_YORK, PRICE_BUCKETS, PROFILE_FLOORS, FeeModel, ScalpConfig, TierConfig


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """num/den, NULL when den is zero or missing."""
    return F.try_divide(col(num), col(den))


def clip(x: str | Column, lo: float, hi: float) -> Column:
    """Clamp; unlike bare greatest/least a NULL stays NULL."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(hi))), F.lit(float(lo))))


def floor_at(x: str | Column, lo: float) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(lo))))


def no_nan(x: str | Column) -> Column:
    """Ingest rule: NaN becomes NULL."""
    x = col(x)
    return F.when(~F.isnan(x), x)


def finite(x: str | Column) -> Column:
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def mid(bid: str | Column = "bid", ask: str | Column = "ask") -> Column:
    return (col(bid) + col(ask)) / 2.0


# ---------------------------------------------------------------- time
def micros(ts: str | Column = "ts") -> Column:
    return F.unix_micros(col(ts))


def ceil_time(ts: str | Column, interval_s: int) -> Column:
    """Right-closed label: the smallest multiple of the interval not before ts."""
    step = F.lit(interval_s * 1_000_000)
    us = micros(ts)
    return F.timestamp_micros(us + F.pmod(-us, step))


def floor_time(ts: str | Column, interval_s: int) -> Column:
    step = F.lit(interval_s * 1_000_000)
    us = micros(ts)
    return F.timestamp_micros(us - F.pmod(us, step))


def plus_seconds(ts: str | Column, seconds: str | int | float | Column) -> Column:
    if isinstance(seconds, (int, float)):
        shift = F.lit(round(seconds * 1_000_000)).cast("long")
    else:
        shift = F.round(col(seconds).cast("double") * 1e6).cast("long")
    return F.timestamp_micros(micros(ts) + shift)


def local_time(ts: str | Column = "ts", zone: str = NEW_YORK) -> Column:
    return F.from_utc_timestamp(col(ts), zone)


def local_date(ts: str | Column = "ts", zone: str = NEW_YORK) -> Column:
    return F.to_date(local_time(ts, zone))


def local_second(ts: str | Column = "ts", zone: str = NEW_YORK) -> Column:
    """Seconds (with fraction) since local midnight; daylight saving safe."""
    t = local_time(ts, zone)
    return (F.unix_micros(t) - F.unix_micros(F.date_trunc("day", t))) / F.lit(1e6)


def local_midnight_utc(now: Column, zone: str = NEW_YORK) -> Column:
    """UTC instant of the most recent local midnight."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(now, zone)), zone)


# ---------------------------------------------------------------- predicates
def good_quote(bid: str = "bid_price", ask: str = "ask_price") -> Column:
    return (col(bid) > 0) & (col(ask) > 0) & (col(ask) >= col(bid))


def valid_nbbo(bid: str = "bid", ask: str = "ask") -> Column:
    """Both sides present and a positive bid; never NULL."""
    return F.coalesce(col(bid).isNotNull() & col(ask).isNotNull() & (col(bid) > 0), F.lit(False))


def tradable_nbbo(bid: str = "bid", ask: str = "ask") -> Column:
    """Decision gate: valid and not crossed."""
    return valid_nbbo(bid, ask) & F.coalesce(col(ask) >= col(bid), F.lit(False))


def plain_ticker(symbol: str | Column, upper_only: bool = False) -> Column:
    return col(symbol).rlike("^[A-Z]{1,5}$" if upper_only else "^[A-Za-z]{1,5}$")


def price_bucket(price: str | Column) -> Column:
    p = col(price)
    out = None
    for lo, hi, name in PRICE_BUCKETS:
        cond = (p >= lo) & (p < hi)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("other")


def scalp_profile(equity: str | Column) -> Column:
    out = None
    for name, floor in PROFILE_FLOORS:
        if floor is None:
            return out.otherwise(name)
        cond = col(equity) >= floor
        out = F.when(cond, name) if out is None else out.when(cond, name)
    raise ValueError("the last profile needs no floor")


# ---------------------------------------------------------------- money
def sell_cost(px: str | Column, shares: str | int | Column, fees: FeeModel = FeeModel()) -> Column:
    """Regulatory cost per share sold: a rate on notional plus a capped per-share fee."""
    n = F.lit(shares) if isinstance(shares, int) else col(shares)
    capped = F.least(n * fees.taf_per_share, F.lit(fees.taf_cap))
    return col(px) * fees.sec_rate + capped / F.greatest(n, F.lit(1))


class Stake(NamedTuple):
    """What one bet is sized from: odds and stakes per share, and what limits its size."""

    p_win: Column
    gain: Column
    risk: Column
    price: Column
    equity: Column
    volume: Column
    ask_lots: Column


@dataclass(frozen=True)
class StakeLimits:
    """Largest share of equity by the Kelly rule, and of the displayed ask size."""

    kelly: float = 0.25
    displayed: float = 2.0


def kelly_shares(stake: Stake, cfg: ScalpConfig, limits: StakeLimits = StakeLimits(), fees: FeeModel = FeeModel()) -> Column:
    """Whole shares of a bet that gains g with p and else loses l (fees included); 0 unless all is in range.

    p g - (1 - p) l is its edge a share, and the Kelly fraction p - (1 - p) l / g is
    the edge in units of the gain. The smallest of four limits rules.
    """
    s = stake
    lost = fees.taf_per_share + fees.sec_rate * s.price + s.risk
    edge = s.p_win * (s.gain + lost) - lost
    by_money = F.least(ratio(edge, s.gain), F.lit(limits.kelly), F.lit(cfg.max_position_pct)) * ratio(s.equity, s.price)
    by_market = F.least(s.volume * cfg.max_participation, s.ask_lots * (limits.displayed * LOT_SIZE))
    in_range = (s.price >= cfg.price_min) & (s.price <= cfg.price_max) & (s.p_win >= 0.0) & (s.p_win <= 1.0)
    for x in (s.gain, s.risk, s.price, s.equity, edge):
        in_range = in_range & (x > 0)
    for x in s:
        in_range = in_range & finite(x)
    whole = F.greatest(F.floor(F.least(by_money, by_market)), F.lit(0)).cast("long")
    return F.coalesce(F.when(in_range, whole), F.lit(0).cast("long"))


def atr_shares(tier: TierConfig, equity: Column, price: Column, atr: Column, vol_mult: Column) -> Column:
    """Whole shares by risk budget and by position cap, scaled by the volatility regime."""
    by_risk = F.floor(ratio(tier.risk_per_trade_pct * equity, tier.stop_atr_multiple * atr))
    by_cap = F.floor(ratio(tier.max_position_pct * equity, price))
    size = F.greatest(F.floor(F.least(by_risk, by_cap) * vol_mult), F.lit(0))
    ok = (price > 0) & (atr > 0) & (equity > 0)
    return F.when(F.coalesce(ok, F.lit(False)), size).otherwise(F.lit(0)).cast("long")


def bracket_prices(ask: Column, target_ps: Column, stop_ps: Column, ts: Column, timeout_s: int, stop_mult: float = 1.0):
    """(target price, stop price, deadline) of an entry at the ask."""
    return ask + target_ps, ask - stop_ps * stop_mult, plus_seconds(ts, timeout_s)


# ---------------------------------------------------------------- ids, hashes, JSON
#: suffix of take-profit order ids (fixed value)
TARGET_SUFFIX = "-tgt"


def order_id(strategy: str | Column, symbol: Column, side: Column, bar_ts: Column) -> Column:
    """Deterministic id: first 32 hex digits of a SHA-1 over the joined key."""
    s = F.lit(strategy) if isinstance(strategy, str) else strategy
    return F.substring(F.sha1(F.concat_ws(":", s, symbol, side, bar_ts)), 1, 32)


def target_order_id(coid: str | Column) -> Column:
    """Id of the take-profit leg that belongs to an order id."""
    return F.concat(col(coid), F.lit(TARGET_SUFFIX))


def is_target_order(coid: str | Column) -> Column:
    """True for a take-profit leg; such orders are not entries."""
    return F.endswith(col(coid), F.lit(TARGET_SUFFIX))


def stable_unit(seed: int, *keys: str) -> Column:
    """Reproducible draw in [0, 1) from the row's own key; no RNG state. 32 bits of an MD5 of the key as text."""
    digest = F.md5(F.concat_ws("|", *[col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def contribution(json_map_value: Column) -> Column:
    """A contribution stored either as a bare number or as {"contribution": x}."""
    return F.coalesce(
        F.get_json_object(json_map_value, "$.contribution").try_cast("double"), json_map_value.try_cast("double")
    )


def log_target(label: str | Column) -> Column:
    return F.log1p(floor_at(label, 0.0))

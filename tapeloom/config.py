"""Parameters of every operator, as frozen dataclasses.

The default numbers in this module are fixed values: they must equal the
published research settings for results to agree. Everything is overridable.
"""

from __future__ import annotations

from dataclasses import dataclass, field

NEW_YORK = "America/New_York"
LOT_SIZE = 100

# direction classes of the book labels (fixed values)
DOWN, FLAT, UP, INVALID = 0, 1, 2, -1
CLASS_NAMES = ("down", "flat", "up")

# price buckets of the viability study: low inclusive, high exclusive (fixed values)
PRICE_BUCKETS = ((0.5, 2.0, "0.5-2"), (2.0, 5.0, "2-5"), (5.0, 10.0, "5-10"))


@dataclass(frozen=True)
class BarSpec:
    """Bar width, quote staleness and session hours (seconds of the local day)."""

    interval_s: int = 1
    quote_stale_s: int = 60
    open_s: int = 9 * 3600 + 30 * 60
    close_s: int = 16 * 3600
    zone: str = NEW_YORK

    @property
    def stale_rows(self) -> int:
        return max(1, self.quote_stale_s // self.interval_s)


@dataclass(frozen=True)
class FeeModel:
    sec_rate: float = 27.80e-6
    taf_per_share: float = 0.000166
    taf_cap: float = 8.30


@dataclass(frozen=True)
class FeatureConfig:
    """Row windows of the bar features; one row is one bar of a gap-free grid."""

    ret_windows: tuple[int, ...] = (5, 15, 60, 300)
    mom_accel_window: int = 15
    pullback_window: int = 300
    vol_surge_short: int = 5
    vol_surge_long: int = 300
    tape_speed_short: int = 10
    tape_speed_long: int = 300
    norm_window: int = 300
    norm_min: int = 30
    flow_window: int = 60
    change_lag: int = 30
    slope_lag: int = 60
    bid_lag: int = 15
    streak_cap: int = 30
    fresh_cap: int = 600
    luld_tiered: bool = False
    batch3: bool = False
    imbalance_level: float = 0.6
    persist_cap: int = 120
    open_minutes: float = 9 * 60 + 30.0
    zone: str = NEW_YORK


@dataclass(frozen=True)
class BarrierConfig:
    """Triple-barrier geometry; mode 'vol' scales it with the trailing price range."""

    target_ps: float = 0.05
    stop_ps: float = 0.04
    timeout_rows: int = 120
    mode: str = "fixed"
    vol_window: int = 300
    vol_target_mult: float = 1.0
    vol_stop_mult: float = 0.5
    min_target_ps: float = 0.02
    min_stop_ps: float = 0.015
    active_window: int = 10
    clip_shares: int = 1000
    row_seconds: int = 1
    fees: FeeModel = field(default_factory=FeeModel)


@dataclass(frozen=True)
class SplitConfig:
    test_frac: float = 0.25
    embargo_days: int = 1
    test_start: str | None = None
    train_start: str | None = None
    val_frac: float = 0.0
    val_start: str | None = None


@dataclass(frozen=True)
class TrainConfig:
    barrier: BarrierConfig = field(default_factory=BarrierConfig)
    features: FeatureConfig = field(default_factory=FeatureConfig)
    split: SplitConfig = field(default_factory=SplitConfig)
    thresholds: tuple[float, ...] = (0.4, 0.5, 0.6, 0.7)
    max_rows_per_day: int = 2000
    seed: int = 7


@dataclass(frozen=True)
class OracleConfig:
    horizon_rows: int = 60
    clip_shares: int = 1000
    maker_wait: int = 30
    fees: FeeModel = field(default_factory=FeeModel)


@dataclass(frozen=True)
class FillConfig:
    entry_mode: str = "taker"
    maker_wait: int = 30
    max_participation: float = 0.05
    volume_window: int = 60
    lot_size: int = LOT_SIZE
    fees: FeeModel = field(default_factory=FeeModel)


@dataclass(frozen=True)
class LabelConfig:
    horizon: int = 20
    alpha: float = 5e-5
    mode: str = "vs_current"


@dataclass(frozen=True)
class BookBacktestConfig:
    prob_threshold: float = 0.55
    fee_bps: float = 0.5
    slippage_bps: float = 0.3
    toxicity_window: int = 50
    toxicity_threshold: float = 0.8
    use_toxicity_filter: bool = True
    snapshots_per_year: float = 252 * 6.5 * 3600


@dataclass(frozen=True)
class RunnerCriteria:
    price_min: float = 0.5
    price_max: float = 10.0
    min_gain: float = 0.15
    min_gap: float = 0.10
    min_relvol: float = 3.0
    min_dollar_vol: float = 5e6
    relvol_window: int = 20
    score_dollar_cap: float = 200e6


@dataclass(frozen=True)
class MoverCriteria:
    max_n: int = 10
    min_price: float = 8.0
    min_dollar_volume: float = 5_000_000.0
    min_pct_change: float = 3.0


@dataclass(frozen=True)
class TierConfig:
    name: str
    universe: tuple[str, ...]
    allow_short: bool
    max_position_pct: float
    max_gross_pct: float
    max_open_positions: int
    daily_loss_limit_pct: float
    max_drawdown_pct: float
    stop_atr_multiple: float
    confidence_threshold: float
    rebalance_seconds: int
    risk_per_trade_pct: float
    weight_momentum: float
    weight_mean_reversion: float


# risk tiers (fixed values)
TIERS = {
    "low": TierConfig("low", ("SPY", "QQQ"), False, 0.05, 0.40, 6, 0.01, 0.25, 1.5, 0.55, 1800, 0.0025, 0.7, 0.3),
    "medium": TierConfig("medium", ("SPY", "QQQ"), False, 0.10, 0.80, 10, 0.02, 0.35, 2.0, 0.45, 900, 0.005, 0.6, 0.4),
    "high": TierConfig("high", ("SPY", "QQQ"), True, 0.20, 1.50, 15, 0.04, 0.45, 2.5, 0.40, 300, 0.01, 0.5, 0.5),
}


@dataclass(frozen=True)
class ScalpConfig:
    name: str
    max_position_pct: float
    max_gross_pct: float
    max_open_scalps: int
    daily_loss_limit_pct: float
    per_symbol_loss_cap_pct: float
    target_ps: float = 0.05
    stop_ps: float = 0.04
    timeout_s: int = 120
    max_participation: float = 0.05
    price_min: float = 0.5
    price_max: float = 10.0


# account-size profiles and the equity at which each one starts (fixed values)
SCALP_PROFILES = {
    "small": ScalpConfig("small", 0.9, 0.9, 1, 0.05, 0.03, max_participation=0.05),
    "mid": ScalpConfig("mid", 0.30, 0.60, 3, 0.03, 0.02, max_participation=0.03),
    "large": ScalpConfig("large", 0.10, 0.50, 5, 0.02, 0.01, max_participation=0.02),
}
PROFILE_FLOORS = (("large", 50_000.0), ("mid", 10_000.0), ("small", None))


@dataclass(frozen=True)
class SignalConfig:
    """Windows of the five-minute-bar signals (rows or daily closes)."""

    momentum_days: int = 20
    momentum_min_closes: int = 25
    reversion_window: int = 24
    vol_window: int = 20
    history_bars: int | None = None  # bars an engine keeps; None keeps all
    breakout_pct: float = 0.90
    breakout_min_points: int = 10
    regime_min_bars: int = 40
    er_floor: float = 0.10
    er_ceil: float = 0.35
    atr_period: int = 14


@dataclass(frozen=True)
class PortfolioConfig:
    top_n: int = 50
    cost_bps: float = 10.0


@dataclass(frozen=True)
class StalenessConfig:
    pause_s: float = 60.0
    kill_s: float = 180.0
    window_s: int = 300

"""Query registry and the DuckDB twins of the input views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.config import BarrierConfig, BarSpec, FeatureConfig, OracleConfig
from tapeloom.operators.bars import second_bars
from tapeloom.sources import driver_tables as tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# The test events are sparse, so queries use ten-minute bars over the whole local
# day and row windows scaled down accordingly.
SPEC = BarSpec(interval_s=600, quote_stale_s=1800, open_s=0, close_s=86400)
FEATURES = FeatureConfig(
    ret_windows=(1, 3, 6, 30), mom_accel_window=3, pullback_window=30, vol_surge_short=3, vol_surge_long=30,
    tape_speed_short=4, tape_speed_long=30, norm_window=30, norm_min=5, flow_window=6, change_lag=3, slope_lag=6,
    bid_lag=3, streak_cap=3, fresh_cap=60, batch3=True, imbalance_level=0.3, persist_cap=12,
)
BARRIER = BarrierConfig(
    timeout_rows=12, mode="vol", vol_window=30, min_target_ps=0.02, min_stop_ps=0.015, active_window=10, row_seconds=600
)
HORIZONS = (3, 6, 12)
ORACLE = OracleConfig(horizon_rows=6, maker_wait=4)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return second_bars(tables.trades(spark, sf_dir), tables.quotes(spark, sf_dir), SPEC)


def rnd(c: str | Column, digits: int = 6) -> Column:
    """Rounded double without negative zero, for cross-engine comparison."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column (per-column digits by keyword)."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            cols.append(rnd(F.col(f"`{f.name}`"), special.get(f.name, digits)).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    """SQL twin of ``rnd``."""
    out = f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"
    return f"{out} AS {name}" if name else out


def rcols(names, digits: int = 6) -> str:
    return ", ".join(r(n, n, digits) for n in names)


# ---------------------------------------------------------------- DuckDB views
EVENTS = """
ev AS (SELECT 'S' || CAST(user_id // 40 AS VARCHAR) AS symbol, ts, event_id AS seq, event_type,
  round(5.0 + value / 50.0, 4) AS px, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
trades AS (SELECT symbol, ts, seq, px AS price, CAST(k + 1 AS DOUBLE) AS size FROM ev
  WHERE event_type IN ('purchase', 'click')),
q0 AS (SELECT symbol, ts, seq, event_type, px, k, round(px - 0.01 * (1 + k % 5), 4) AS bid_price FROM ev
  WHERE event_type IN ('view', 'signup', 'error')),
quotes AS (SELECT symbol, ts, seq, bid_price,
  CASE WHEN event_type = 'error' THEN round(bid_price - 0.02, 4) ELSE round(px + 0.01 * (1 + k % 3), 4) END AS ask_price,
  CAST(1 + k % 7 AS DOUBLE) AS bid_size, CAST(1 + k % 11 AS DOUBLE) AS ask_size FROM q0)
"""

# all event days are in January, so New York is UTC-5 throughout
BARS = EVENTS + """,
lt AS (SELECT *, make_timestamp(((epoch_us(ts) + 599999999) // 600000000) * 600000000) AS label FROM trades),
tb AS (SELECT symbol, CAST(label - INTERVAL 5 HOUR AS DATE) AS session_date, label,
  first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close,
  sum(size) AS volume, CAST(count(*) AS DOUBLE) AS n_trades, sum(price * size) AS notional FROM lt GROUP BY ALL),
lq AS (SELECT *, make_timestamp(((epoch_us(ts) + 599999999) // 600000000) * 600000000) AS label FROM quotes
  WHERE bid_price > 0 AND ask_price > 0 AND ask_price >= bid_price),
qb AS (SELECT symbol, CAST(label - INTERVAL 5 HOUR AS DATE) AS session_date, label,
  last(bid_price ORDER BY ts, seq) AS bid, last(ask_price ORDER BY ts, seq) AS ask,
  last(bid_size ORDER BY ts, seq) AS bid_size, last(ask_size ORDER BY ts, seq) AS ask_size FROM lq GROUP BY ALL),
span AS (SELECT symbol, session_date, min(label) AS g0, max(label) AS g1 FROM tb GROUP BY ALL),
grid AS (SELECT symbol, session_date, unnest(generate_series(g0, g1, INTERVAL 10 MINUTE)) AS ts FROM span),
b0 AS (SELECT g.symbol, g.session_date, g.ts, t.open, t.high, t.low, t.close, coalesce(t.volume, 0.0) AS volume,
  coalesce(t.n_trades, 0.0) AS n_trades, t.notional / nullif(t.volume, 0) AS vwap, q.bid, q.ask, q.bid_size, q.ask_size
  FROM grid g LEFT JOIN tb t ON t.symbol = g.symbol AND t.session_date = g.session_date AND t.label = g.ts
  LEFT JOIN qb q ON q.symbol = g.symbol AND q.session_date = g.session_date AND q.label = g.ts),
b1 AS (SELECT symbol, session_date, ts, open, high, low, close, volume, n_trades, vwap,
  last_value(bid IGNORE NULLS) OVER f AS bid, last_value(ask IGNORE NULLS) OVER f AS ask,
  last_value(bid_size IGNORE NULLS) OVER f AS bid_size, last_value(ask_size IGNORE NULLS) OVER f AS ask_size FROM b0
  WINDOW f AS (PARTITION BY symbol, session_date ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
bars AS MATERIALIZED (SELECT *, ask - bid AS spread,
  row_number() OVER (PARTITION BY symbol, session_date ORDER BY ts) AS rn,
  count(*) OVER (PARTITION BY symbol, session_date) AS n,
  coalesce(bid IS NOT NULL AND ask IS NOT NULL AND bid > 0, false) AS nbbo_ok FROM b1)
"""

DAILY = """
li AS (SELECT 'P' || CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date,
  l_extendedprice / l_quantity AS px, * FROM lineitem),
daily AS MATERIALIZED (SELECT symbol, date, first(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open,
  max(px) AS high, min(px) AS low, last(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close,
  sum(l_quantity) AS volume, sum(l_extendedprice) / sum(l_quantity) AS vwap FROM li GROUP BY symbol, date)
"""


def with_ctes(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n"

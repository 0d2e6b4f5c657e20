"""Bars, bar features, labels, oracles and fills over the event tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.config import BarSpec, FillConfig
from tapeloom.operators import bar_features as bf
from tapeloom.operators import bars as b
from tapeloom.operators import fills as fl
from tapeloom.operators import labels as lb
from tapeloom.operators import oracle as orc
from tapeloom.queries.base import (
    BARRIER, BARS, EVENTS, FEATURES, HORIZONS, ORACLE, bars, query, r, rcols, rounded, with_ctes,
)
from tapeloom.session import cut
from tapeloom.sources import driver_tables as tables

BAR_COLS = ["open", "high", "low", "close", "volume", "n_trades", "bid", "ask", "bid_size", "ask_size", "spread"]
VWAP = r("vwap", "vwap", 9)


@query("second_bars", with_ctes(BARS) + f"SELECT symbol, session_date, ts, {rcols(BAR_COLS)}, {VWAP} FROM bars")
def _second_bars(spark, sf):
    return rounded(bars(spark, sf), vwap=9)


@query(
    "regular_hours_bars",
    with_ctes(BARS) + f"""SELECT symbol, session_date, ts, {rcols(BAR_COLS)}, {VWAP} FROM bars
    WHERE CAST(ts - INTERVAL 5 HOUR AS TIME) >= TIME '09:30:00' AND CAST(ts - INTERVAL 5 HOUR AS TIME) < TIME '16:00:00'""",
)
def _regular_hours_bars(spark, sf):
    return rounded(b.regular_hours(bars(spark, sf), BarSpec(interval_s=600)), vwap=9)


@query("clean_quotes", with_ctes(EVENTS) + """SELECT symbol, ts, seq, bid_price, ask_price, bid_size, ask_size FROM quotes
    WHERE bid_price > 0 AND ask_price > 0 AND ask_price >= bid_price""")
def _clean_quotes(spark, sf):
    return b.clean_quotes(tables.quotes(spark, sf))


@query("valid_nbbo_share", with_ctes(BARS) + f"""SELECT symbol, session_date, count(*) AS n,
    sum(CASE WHEN nbbo_ok THEN 1 ELSE 0 END)::BIGINT AS valid,
    sum(CASE WHEN nbbo_ok AND ask >= bid THEN 1 ELSE 0 END)::BIGINT AS tradable FROM bars GROUP BY ALL""")
def _valid_nbbo(spark, sf):
    from tapeloom.functions.scalar import tradable_nbbo, valid_nbbo

    return bars(spark, sf).groupBy(*b.KEY).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(valid_nbbo(), 1)).alias("valid"), F.count(F.when(tradable_nbbo(), 1)).alias("tradable")
    )


TAPE = EVENTS + """,
tape AS (SELECT symbol, ts, seq, 0 AS kind, NULL::DOUBLE AS price, NULL::DOUBLE AS size, bid_price, ask_price, bid_size, ask_size FROM quotes
  UNION ALL SELECT symbol, ts, seq, 1, price, size, NULL, NULL, NULL, NULL FROM trades),
filled AS (SELECT *, last_value(bid_price IGNORE NULLS) OVER w AS last_bid, last_value(ask_price IGNORE NULLS) OVER w AS last_ask,
  last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, kind, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_price
  FROM tape WINDOW w AS (PARTITION BY symbol ORDER BY ts, kind, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
signed AS (SELECT *, make_timestamp((epoch_us(ts) // 600000000) * 600000000) AS bar, CASE WHEN kind = 0 THEN NULL
  WHEN last_ask > 0 AND price >= last_ask THEN 1 WHEN last_bid > 0 AND price <= last_bid THEN -1
  WHEN price > last_price THEN 1 WHEN price < last_price THEN -1 ELSE 0 END AS sgn FROM filled)
"""


@query("prevailing_quotes", with_ctes(TAPE) + f"SELECT symbol, ts, seq, price, last_bid, last_ask, last_price, sgn::INTEGER AS sgn FROM signed WHERE kind = 1")
def _prevailing(spark, sf):
    tape = b.prevailing_quotes(tables.trades(spark, sf), tables.quotes(spark, sf))
    return tape.where("kind = 1").select("symbol", "ts", "seq", "price", "last_bid", "last_ask", "last_price", b.trade_sign().alias("sgn"))


MICRO = TAPE + """,
micro AS MATERIALIZED (SELECT symbol, bar AS ts, first(price ORDER BY ts, seq) FILTER (kind = 1) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY ts, seq) FILTER (kind = 1) AS close, sum(size) AS volume,
  coalesce(sum(price * size) / nullif(sum(size), 0), last(price ORDER BY ts, seq) FILTER (kind = 1)) AS vwap, count(price) AS trade_count,
  coalesce(avg(ask_price - bid_price) FILTER (ask_price > 0 AND bid_price > 0), 0.0) AS mean_spread,
  coalesce(avg((bid_size - ask_size) / (bid_size + ask_size)), 0.0) AS mean_quote_imbalance,
  coalesce((coalesce(sum(size) FILTER (sgn > 0), 0) - coalesce(sum(size) FILTER (sgn < 0), 0))
    / nullif(coalesce(sum(size) FILTER (sgn <> 0), 0), 0), 0.0) AS flow_imbalance
  FROM signed GROUP BY symbol, bar HAVING count(price) > 0)
"""
MICRO_COLS = ["open", "high", "low", "close", "volume", "mean_spread", "mean_quote_imbalance", "flow_imbalance"]


def micro(spark, sf):
    return b.microstructure_bars(tables.trades(spark, sf), tables.quotes(spark, sf), 600)


@query("microstructure_bars", with_ctes(MICRO) + f"SELECT symbol, ts, 600 AS interval_s, trade_count, {rcols(MICRO_COLS)}, {VWAP} FROM micro")
def _micro(spark, sf):
    return rounded(micro(spark, sf), vwap=9)


@query(
    "rolled_bars",
    with_ctes(MICRO) + f""", g AS (SELECT *, CAST(ts - INTERVAL 5 HOUR AS DATE) AS session_date,
      (row_number() OVER (PARTITION BY symbol, CAST(ts - INTERVAL 5 HOUR AS DATE) ORDER BY ts) - 1) // 5 AS bar_group FROM micro)
    SELECT symbol, session_date, bar_group, min(ts) AS ts, 3000 AS interval_s, {r("first(open ORDER BY ts)", "open")}, {r("max(high)", "high")},
    {r("min(low)", "low")}, {r("last(close ORDER BY ts)", "close")}, {r("sum(volume)", "volume")},
    {r("coalesce(sum(vwap * volume) / nullif(sum(volume), 0), last(close ORDER BY ts))", "vwap", 9)}, sum(trade_count)::BIGINT AS trade_count,
    {r("sum(mean_spread) / greatest(count(*) FILTER (mean_spread > 0), 1)", "mean_spread")},
    {r("sum(mean_quote_imbalance) / greatest(count(*) FILTER (mean_quote_imbalance <> 0), 1)", "mean_quote_imbalance")},
    {r("coalesce(sum(flow_imbalance * volume) / nullif(sum(volume), 0), 0.0)", "flow_imbalance")}
    FROM g GROUP BY symbol, session_date, bar_group HAVING count(*) = 5""",
)
def _rolled(spark, sf):
    from tapeloom.functions.scalar import local_date

    return rounded(b.rolled_bars(micro(spark, sf).withColumn("session_date", local_date("ts")), 5, 3000), vwap=9)


@query(
    "enriched_bars",
    with_ctes(TAPE) + f""", official AS (SELECT symbol, bar AS ts, min(price) AS low, max(price) AS high FROM signed WHERE kind = 1 GROUP BY ALL),
    s AS (SELECT symbol, bar AS ts, avg(ask_price - bid_price) FILTER (ask_price > bid_price AND bid_price > 0) AS sp,
      avg((bid_size - ask_size) / (bid_size + ask_size)) AS qi, coalesce(sum(size) FILTER (sgn > 0), 0) AS bu,
      coalesce(sum(size) FILTER (sgn < 0), 0) AS se FROM signed GROUP BY ALL)
    SELECT o.symbol, o.ts, o.low, o.high, {r("coalesce(sp, 0)", "mean_spread")}, {r("coalesce(qi, 0)", "mean_quote_imbalance")},
    {r("coalesce((bu - se) / nullif(bu + se, 0), 0)", "flow_imbalance")} FROM official o LEFT JOIN s USING (symbol, ts)""",
)
def _enriched(spark, sf):
    t, q = tables.trades(spark, sf), tables.quotes(spark, sf)
    official = t.groupBy("symbol", b.floor_time("ts", 600).alias("ts")).agg(F.min("price").alias("low"), F.max("price").alias("high"))
    return rounded(b.enriched_bars(official, t, q, 600))


# ---------------------------------------------------------------- features
W = "OVER (PARTITION BY symbol, session_date ORDER BY ts"


def back(n: int) -> str:
    return f"{W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


RUN = f"{W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def med(x: str, n: int, need: int) -> str:
    return f"CASE WHEN count({x}) {back(n)} >= {need} THEN quantile_cont({x}, 0.5) {back(n)} END"


FEATURE_CTES = BARS + f""",
f1 AS (SELECT *, last_value(close IGNORE NULLS) {RUN} AS px, sum(coalesce(vwap, 0) * volume) {RUN} AS cn, sum(volume) {RUN} AS cv,
  sum(volume) {back(3)} AS vs, sum(n_trades) {back(4)} AS trs, sum(volume) {back(6)} AS v60, sum(n_trades) {back(6)} AS n60,
  max(high) {back(6)} - min(low) {back(6)} AS rshort,
  CASE WHEN count(high) {back(30)} >= 5 THEN max(high) {back(30)} - min(low) {back(30)} END AS rlong,
  lag(bid, 3) {W}) AS bidlag, (bid_size - ask_size) / nullif(bid_size + ask_size, 0) AS qimb, spread / ((bid + ask) / 2.0) * 1e4 AS spread_bps FROM bars),
f2 AS (SELECT *, lag(px, 1) {W}) AS p1, lag(px, 3) {W}) AS p3, lag(px, 6) {W}) AS p6, lag(px, 30) {W}) AS p30,
  max(px) {RUN} AS hi, max(px) {back(30)} AS hiw, CASE WHEN count(px) {back(30)} >= 5 THEN avg(px) {back(30)} END AS pxmean,
  lag(qimb, 3) {W}) AS qlag, lag(bid, 1) {W}) AS b0, lag(ask, 1) {W}) AS a0, lag(bid_size, 1) {W}) AS bs0, lag(ask_size, 1) {W}) AS as0 FROM f1),
f3 AS (SELECT *, px / p3 - 1 AS mom, (px - cn / nullif(cv, 0)) / (cn / nullif(cv, 0)) AS vwap_dist, v60 / nullif(n60, 0) AS tsize,
  sign(px - p1) * volume AS sv, sign(px - p1) * n_trades AS sn,
  last_value(CASE WHEN NOT coalesce(px > p1, false) THEN rn END IGNORE NULLS) {RUN} AS lflat,
  last_value(CASE WHEN coalesce(px >= hi, false) THEN rn END IGNORE NULLS) {RUN} AS lhigh,
  last_value(CASE WHEN NOT coalesce(qimb > 0.3, false) THEN rn END IGNORE NULLS) {RUN} AS llow,
  (CASE WHEN bid > b0 THEN bid_size WHEN bid = b0 THEN bid_size - bs0 ELSE -bs0 END)
   - (CASE WHEN ask < a0 THEN as0 WHEN ask = a0 THEN as0 - ask_size ELSE -ask_size END) AS ofi FROM f2),
f4 AS (SELECT *, sum(sv) {back(6)} / nullif(v60, 0) AS flow, sum(ofi) {back(6)} / nullif(avg(bid_size + ask_size) {back(6)}, 0) AS ofi60,
  sum(sn) {back(6)} / nullif(n60, 0) AS tick60, {med("vs", 30, 1)} AS vmed, {med("trs", 30, 1)} AS tmed, {med("spread_bps", 30, 5)} AS smed,
  {med("tsize", 30, 5)} AS zmed FROM f3),
feats AS MATERIALIZED (SELECT symbol, session_date, ts, px / p1 - 1 AS ret_1s, px / p3 - 1 AS ret_3s, px / p6 - 1 AS ret_6s, px / p30 - 1 AS ret_30s,
  mom - lag(mom, 3) {W}) AS mom_accel, vwap_dist, px / hiw - 1 AS pullback, vs / nullif(vmed, 0) AS vol_surge, trs / nullif(tmed, 0) AS tape_speed,
  spread_bps, qimb, qimb - qlag AS qimb_chg_30s, spread_bps / nullif(smed, 0) - 1 AS spread_rel, bid / bidlag - 1 AS bid_ret_15s,
  px / hi - 1 AS sess_hi_dist, CAST(least(rn - coalesce(lflat, 0), 3) AS DOUBLE) AS up_streak, tsize / nullif(zmed, 0) AS tsize_surge,
  flow AS flow_imb_60s, flow - lag(flow, 3) {W}) AS flow_imb_chg, (pxmean * 1.10 - px) / px AS luld_up_dist,
  (px - round_even(px / 0.5, 0) * 0.5) / px AS round_dist, rshort / nullif(rlong, 0) AS range_compress, least(rn - coalesce(lhigh, 0), 60) / 60.0 AS mom_fresh,
  vwap_dist - lag(vwap_dist, 6) {W}) AS vwap_slope, CAST(bid IS NOT NULL AND ask IS NOT NULL AS DOUBLE) AS quote_ok,
  epoch_us((ts - INTERVAL 5 HOUR) - date_trunc('day', ts - INTERVAL 5 HOUR)) / 60e6 - 570.0 AS tod_min, ofi60 AS ofi_60s, tick60 AS tick_imb_60s,
  least(rn - coalesce(llow, 0), 12) / 12.0 AS qimb_persist FROM f4)
"""
FEATURE_COLS = bf.feature_names(FEATURES)


@query("bar_features", with_ctes(FEATURE_CTES) + f"SELECT symbol, session_date, ts, {rcols(FEATURE_COLS)} FROM feats")
def _features(spark, sf):
    return rounded(bf.bar_features(bars(spark, sf), FEATURES))


@query("price_band_tiers", with_ctes(FEATURE_CTES) + f""", t AS (SELECT symbol, session_date, ts, px / 8 AS p, pxmean / 8 AS m FROM f4)
    SELECT symbol, session_date, ts, {r("(CASE WHEN m >= 3 THEN m * 1.1 WHEN m >= 0.75 THEN m * 1.2 WHEN m IS NOT NULL THEN m + least(0.15, m * 0.75) END - p) / p", "luld_up_dist")} FROM t""")
def _band_tiers(spark, sf):
    """Distance to the upper band of cheap names, whose band is wider: prices are an eighth."""
    cheap = bars(spark, sf).withColumn("close", F.col("close") / 8)
    return rounded(bf.bar_features(cheap, replace(FEATURES, luld_tiered=True)).select(*b.KEY, "ts", "luld_up_dist"))


# ---------------------------------------------------------------- barriers and labels
LABEL_CTES = BARS + f""",
p1 AS (SELECT *, last_value(close IGNORE NULLS) {RUN} AS px FROM bars),
p2 AS (SELECT *, CASE WHEN count(px) {back(30)} >= 10 THEN max(px) {back(30)} - min(px) {back(30)} END AS sp,
  coalesce(sum(n_trades) {W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS recent FROM p1),
p3 AS (SELECT *, CASE WHEN sp IS NOT NULL THEN greatest(sp, 0.02) END AS target_ps, CASE WHEN sp IS NOT NULL THEN greatest(0.5 * sp, 0.015) END AS stop_ps FROM p2),
elig AS (SELECT *, ask AS entry, ask + target_ps + ask * 27.80e-6 + least(0.000166 * 1000, 8.30) / 1000 AS win_px, ask - stop_ps AS loss_px
  FROM p3 WHERE bid IS NOT NULL AND ask IS NOT NULL AND recent >= 1 AND rn + 12 <= n AND target_ps IS NOT NULL),
hits AS (SELECT e.symbol, e.session_date, e.rn, min(f.rn - e.rn) FILTER (f.bid >= e.win_px) AS w, min(f.rn - e.rn) FILTER (f.bid <= e.loss_px) AS l,
  max(f.bid) FILTER (f.rn = e.rn + 12) AS tb FROM elig e LEFT JOIN bars f ON f.symbol = e.symbol AND f.session_date = e.session_date
  AND f.rn > e.rn AND f.rn <= e.rn + 12 GROUP BY ALL),
lab0 AS (SELECT e.*, h.tb, h.w, h.l, (w IS NOT NULL AND (l IS NULL OR w <= l)) AS won FROM elig e JOIN hits h USING (symbol, session_date, rn)),
lab1 AS (SELECT *, (l IS NOT NULL AND NOT won) AS lost FROM lab0),
labels_v AS MATERIALIZED (SELECT p.symbol, p.session_date, p.ts, p.rn, p.target_ps, p.stop_ps, p.bid, p.ask, p.nbbo_ok,
  CASE WHEN x.rn IS NULL THEN NULL WHEN won THEN 1.0 WHEN lost THEN -1.0 ELSE 0.0 END::DOUBLE AS label, x.entry AS entry_px,
  CASE WHEN x.rn IS NULL THEN NULL WHEN won THEN w * 600 WHEN lost THEN l * 600 ELSE 7200 END::DOUBLE AS exit_s,
  CASE WHEN NOT won AND NOT lost THEN tb - x.entry - tb * 27.80e-6 - least(0.000166 * 1000, 8.30) / 1000 END AS timeout_edge
  FROM p3 p LEFT JOIN lab1 x ON x.symbol = p.symbol AND x.session_date = p.session_date AND x.rn = p.rn)
"""


def labelled(spark, sf):
    return lb.barrier_labels(lb.with_barriers(bars(spark, sf), BARRIER), BARRIER)


@query("volatility_barriers", with_ctes(LABEL_CTES) + f"SELECT symbol, session_date, ts, {rcols(['target_ps', 'stop_ps'])} FROM p3")
def _barriers(spark, sf):
    return rounded(lb.with_barriers(bars(spark, sf), BARRIER).select(*b.KEY, "ts", "target_ps", "stop_ps"))


@query("barrier_labels", with_ctes(LABEL_CTES) + f"SELECT symbol, session_date, ts, {rcols(['target_ps', 'stop_ps', 'label', 'entry_px', 'exit_s', 'timeout_edge'])} FROM labels_v")
def _labels(spark, sf):
    return rounded(labelled(spark, sf))


# ---------------------------------------------------------------- oracles
def greedy_sql(cand: str, keys: str, out: str, cmp: str = ">=") -> str:
    """Recursive earliest-first selection; cand has keys, start_row, release_row."""
    on = " AND ".join(f"c.{k.strip()} = g.{k.strip()}" for k in keys.split(","))
    return f"""{out} AS (
      SELECT {keys}, min(start_row) AS start_row, arg_min(release_row, start_row) AS release_row FROM {cand} GROUP BY {keys}
      UNION ALL
      SELECT {", ".join("g." + k.strip() for k in keys.split(","))}, nx.start_row, nx.release_row FROM {out} g,
      LATERAL (SELECT c.start_row, c.release_row FROM {cand} c WHERE {on} AND c.start_row {cmp} g.release_row ORDER BY c.start_row LIMIT 1) nx)"""


COST = "27.80e-6 * {x} + least(0.000166 * 1000, 8.30) / 1000"


def taker_cand(h: int, name: str) -> str:
    x = f"lead(bid, {h}) {W})"
    return f"""{name}_x AS (SELECT *, {x} AS ex, lead(bid_size, {h}) {W}) AS exs, lead(nbbo_ok, {h}) {W}) AS okh FROM bars),
    {name} AS MATERIALIZED (SELECT symbol, session_date, ts, ask AS entry, ex AS exit, ex - ask - ({COST.format(x="ex")}) AS edge_ps, least(ask_size, exs) * 100 AS displayed_shares,
      rn AS start_row, rn + {h} AS release_row FROM {name}_x WHERE nbbo_ok AND okh AND ex - ask - ({COST.format(x="ex")}) > 0)"""


def maker_cand(h: int, wait: int, name: str) -> str:
    return f"""{name}_f AS (SELECT e.symbol, e.session_date, e.ts, e.rn, e.n, e.bid AS entry, min(f.rn) AS te FROM bars e JOIN bars f ON f.symbol = e.symbol
      AND f.session_date = e.session_date AND f.rn > e.rn AND f.rn <= e.rn + {wait} AND f.low < e.bid WHERE e.nbbo_ok AND e.rn - 1 + {h} + {wait} < e.n GROUP BY ALL),
    {name}_t AS (SELECT f.*, x.rn AS tx, x.ask AS target FROM {name}_f f JOIN bars x ON x.symbol = f.symbol AND x.session_date = f.session_date AND x.rn = f.te + {h}
      WHERE x.nbbo_ok AND f.te + {h} - 1 + {wait} < f.n),
    {name}_h AS (SELECT t.*, (SELECT min(u.rn) FROM bars u WHERE u.symbol = t.symbol AND u.session_date = t.session_date AND u.rn > t.tx AND u.rn <= t.tx + {wait} AND u.high > t.target) AS hit,
      (SELECT max(u.bid) FROM bars u WHERE u.symbol = t.symbol AND u.session_date = t.session_date AND u.rn = t.tx + {wait} AND u.nbbo_ok) AS cross_px FROM {name}_t t),
    {name}_e AS (SELECT *, CASE WHEN hit IS NOT NULL THEN target ELSE cross_px END AS exit FROM {name}_h),
    {name} AS MATERIALIZED (SELECT symbol, session_date, ts, entry, exit, exit - entry - ({COST.format(x="exit")}) AS edge_ps, hit IS NULL AS exit_crossed,
      rn AS start_row, coalesce(hit, tx + {wait}) + 1 AS release_row FROM {name}_e WHERE exit - entry - ({COST.format(x="exit")}) > 0)"""


K3 = "symbol, session_date"
ORACLE_KEEP = "JOIN {g} g ON g.symbol = c.symbol AND g.session_date = c.session_date AND g.start_row = c.start_row"


@query(
    "taker_oracle",
    with_ctes(BARS, taker_cand(6, "tc"), greedy_sql("tc", K3, "tg"), recursive=True)
    + f"""SELECT c.symbol, c.session_date, c.ts, {r("entry", "entry")}, {r("exit", "exit")}, {r("edge_ps", "edge_ps")}, {r("edge_ps * 1000", "clip_pnl", 4)},
    {r("displayed_shares", "displayed_shares")}, {r("edge_ps * least(1000, displayed_shares)", "displayed_pnl", 4)} FROM tc c {ORACLE_KEEP.format(g="tg")}""",
)
def _taker(spark, sf):
    out = orc.taker_trades(bars(spark, sf), ORACLE).drop("start_row", "release_row")
    return rounded(out, clip_pnl=4, displayed_pnl=4)


@query(
    "maker_oracle",
    with_ctes(BARS, maker_cand(6, 4, "mc"), greedy_sql("mc", K3, "mg"), recursive=True)
    + f"""SELECT c.symbol, c.session_date, c.ts, {r("entry", "entry")}, {r("exit", "exit")}, {r("edge_ps", "edge_ps")}, {r("edge_ps * 1000", "clip_pnl", 4)},
    exit_crossed FROM mc c {ORACLE_KEEP.format(g="mg")}""",
)
def _maker(spark, sf):
    return rounded(orc.maker_trades(bars(spark, sf), ORACLE).drop("start_row", "release_row"), clip_pnl=4)


def summary_sql(h: int) -> str:
    return f"""SELECT s.symbol, s.session_date, {h} AS horizon_s, n_seconds, quote_coverage, med_spread, med_spread_bps, day_volume, med_second_dollar_vol,
      frictionless_ps, coalesce(t.n, 0) AS taker_n, coalesce(t.p, 0) AS taker_clip_pnl, coalesce(t.m, 0) AS taker_med_edge_ps, coalesce(t.d, 0) AS taker_displayed_pnl,
      coalesce(m.n, 0) AS maker_n, coalesce(m.p, 0) AS maker_clip_pnl, coalesce(m.m, 0) AS maker_med_edge_ps
      FROM (SELECT symbol, session_date, count(*) AS n_seconds, avg(nbbo_ok::INT) AS quote_coverage, quantile_cont(spread, 0.5) AS med_spread,
        quantile_cont(spread / ((bid + ask) / 2.0) * 1e4, 0.5) AS med_spread_bps, sum(volume) AS day_volume,
        coalesce(quantile_cont(volume * vwap, 0.5) FILTER (n_trades > 0), 0) AS med_second_dollar_vol FROM bars GROUP BY ALL) s
      JOIN (SELECT symbol, session_date, coalesce(sum(d) FILTER (d > 0), 0) AS frictionless_ps FROM
        (SELECT *, lead((bid + ask) / 2.0, {h}) {W}) - (bid + ask) / 2.0 AS d FROM bars) GROUP BY ALL) fr USING (symbol, session_date)
      LEFT JOIN (SELECT c.symbol, c.session_date, count(*) AS n, sum(edge_ps * 1000) AS p, quantile_cont(edge_ps, 0.5) AS m, sum(edge_ps * least(1000, displayed_shares)) AS d
        FROM tc{h} c {ORACLE_KEEP.format(g=f"tg{h}")} GROUP BY ALL) t USING (symbol, session_date)
      LEFT JOIN (SELECT c.symbol, c.session_date, count(*) AS n, sum(edge_ps * 1000) AS p, quantile_cont(edge_ps, 0.5) AS m
        FROM mc{h} c {ORACLE_KEEP.format(g=f"mg{h}")} GROUP BY ALL) m USING (symbol, session_date)"""


def study_ctes() -> str:
    parts = [BARS]
    for h in HORIZONS:
        parts += [taker_cand(h, f"tc{h}"), greedy_sql(f"tc{h}", K3, f"tg{h}"), maker_cand(h, 4, f"mc{h}"), greedy_sql(f"mc{h}", K3, f"mg{h}")]
    parts.append("""meta0 AS (SELECT symbol, session_date, first(close ORDER BY ts) FILTER (close IS NOT NULL) AS open, last(close ORDER BY ts) FILTER (close IS NOT NULL) AS lastpx,
      sum(volume) AS vol, sum(volume * vwap) AS dollar_vol FROM bars GROUP BY ALL),
    meta AS (SELECT *, lastpx / open - 1 AS gain, vol / avg(vol) OVER (PARTITION BY symbol) AS relvol FROM meta0)""")
    parts.append("study0 AS (" + " UNION ALL ".join(summary_sql(h) for h in HORIZONS) + ")")
    parts.append("""study AS MATERIALIZED (SELECT s.*, gain, relvol, dollar_vol, CASE WHEN open >= 0.5 AND open < 2 THEN '0.5-2' WHEN open >= 2 AND open < 5 THEN '2-5'
      WHEN open >= 5 AND open < 10 THEN '5-10' ELSE 'other' END AS price_bucket FROM study0 s JOIN meta USING (symbol, session_date))""")
    return with_ctes(*parts, recursive=True)


def study(spark, sf):
    tape = bars(spark, sf)
    day = tape.groupBy(*b.KEY).agg(
        F.min_by("close", F.when(F.col("close").isNotNull(), F.col("ts"))).alias("open"), F.max_by("close", F.when(F.col("close").isNotNull(), F.col("ts"))).alias("_last"),
        F.sum("volume").alias("_vol"), F.sum(F.col("volume") * F.col("vwap")).alias("dollar_vol"),
    )
    mean = F.avg("_vol").over(Window.partitionBy("symbol"))  # one row per session
    meta = day.select(*b.KEY, "open", (F.col("_last") / F.col("open") - 1).alias("gain"), (F.col("_vol") / mean).alias("relvol"), "dollar_vol")
    return orc.viability_study(tape, HORIZONS, meta, ORACLE)


STUDY_D = ["quote_coverage", "med_spread", "med_spread_bps", "day_volume", "med_second_dollar_vol", "frictionless_ps", "taker_med_edge_ps", "maker_med_edge_ps", "gain", "relvol"]
STUDY_M = ["taker_clip_pnl", "taker_displayed_pnl", "maker_clip_pnl", "dollar_vol"]


@query("viability_study", study_ctes() + f"""SELECT symbol, session_date, price_bucket, horizon_s, n_seconds, taker_n, maker_n, {rcols(STUDY_D)}, {rcols(STUDY_M, 3)} FROM study""")
def _study(spark, sf):
    return rounded(study(spark, sf), 6, **{c: 3 for c in STUDY_M})


PIVOT = ", ".join(f'{{agg}} AS "{h}"' for h in HORIZONS)


@query(
    "study_pivot_median",
    study_ctes() + "SELECT price_bucket, " + ", ".join(r(f"quantile_cont(taker_clip_pnl, 0.5) FILTER (horizon_s = {h})", f'"{h}"', 3) for h in HORIZONS) + " FROM study GROUP BY 1",
)
def _pivot_median(spark, sf):
    return rounded(orc.pivot_by_horizon(study(spark, sf), "taker_clip_pnl", HORIZONS), 3)


@query(
    "study_pivot_positive",
    study_ctes() + "SELECT price_bucket, " + ", ".join(r(f"avg((maker_clip_pnl > 0)::INT) FILTER (horizon_s = {h}) * 100", f'"{h}"') for h in HORIZONS) + " FROM study GROUP BY 1",
)
def _pivot_positive(spark, sf):
    return rounded(orc.pivot_by_horizon(study(spark, sf), "maker_clip_pnl", HORIZONS, "pct_positive"))


@query("study_header", study_ctes() + """SELECT count(DISTINCT (symbol, session_date)) AS stock_days, min(session_date) AS first_date, max(session_date) AS last_date,
    count(DISTINCT symbol) AS symbols FROM study""")
def _study_header(spark, sf):
    return orc.study_header(study(spark, sf))


@query("study_verdict", study_ctes() + f"""SELECT price_bucket, horizon_s, count(DISTINCT (symbol, session_date)) AS stock_days,
    {r("avg((taker_clip_pnl > 0)::INT)", "taker_positive")}, {r("avg((maker_clip_pnl > 0)::INT)", "maker_positive")} FROM study GROUP BY 1, 2""")
def _study_verdict(spark, sf):
    return rounded(orc.study_verdict(study(spark, sf)))


# ---------------------------------------------------------------- scores, entries, fills
# A deterministic stand-in for a model score, so the decision operators can be
# checked on their own: a fixed arithmetic hash of the bar's position.
def scored_labels(spark, sf, carry=()):
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy(*b.KEY).orderBy("ts"))
    numbered = lb.with_barriers(bars(spark, sf), BARRIER).withColumn("rn", rn)
    lab = lb.barrier_labels(numbered, BARRIER, carry=("bid", "ask", *carry, "rn"))
    return lab.withColumn("p_win", F.pmod(F.col("rn") * 7919 + F.dayofmonth("session_date") * 104729, F.lit(101)) / 101.0)


SCORED = LABEL_CTES + """,
scored AS MATERIALIZED (SELECT *, ((rn * 7919 + day(session_date) * 104729) % 101) / 101.0 AS p_win,
  CASE WHEN label = 1 THEN target_ps WHEN label = -1 THEN -stop_ps ELSE coalesce(timeout_edge, 0) END AS edge FROM labels_v)"""
THRESHOLDS = (0.4, 0.5, 0.6, 0.7, 0.995)

SWEEP_CAND = """sc AS MATERIALIZED (SELECT t.thr, s.symbol, s.session_date, s.rn AS start_row, s.rn + coalesce(s.exit_s, 0) / 600 AS release_row, s.label, s.edge FROM
  (SELECT unnest([0.4, 0.5, 0.6, 0.7, 0.995])::DOUBLE AS thr) t JOIN scored s ON s.p_win >= t.thr AND s.label IS NOT NULL)"""


@query(
    "threshold_sweep",
    with_ctes(SCORED, SWEEP_CAND, greedy_sql("sc", "thr, symbol, session_date", "sg"), recursive=True)
    + f"""SELECT t.thr AS threshold, count(c.thr) AS n_trades, {r("count(c.thr) / (SELECT count(DISTINCT session_date) FROM scored WHERE label IS NOT NULL)", "trades_per_day")},
    {r("avg((c.label = 1)::INT)", "hit_rate")}, {r("avg(c.edge)", "expectancy_ps")}, {r("avg(c.edge) * 1000", "expectancy_usd_1000sh", 4)},
    {r("coalesce(sum(c.edge) * 1000, 0)", "sum_pnl_1000sh", 3)}
    FROM (SELECT unnest([0.4, 0.5, 0.6, 0.7, 0.995])::DOUBLE AS thr) t LEFT JOIN (SELECT sc.* FROM sc JOIN sg USING (thr, symbol, session_date, start_row)) c ON c.thr = t.thr GROUP BY t.thr""",
)
def _sweep(spark, sf):
    out = fl.threshold_sweep(scored_labels(spark, sf).where("label is not null"), THRESHOLDS)
    return rounded(out, expectancy_usd_1000sh=4, sum_pnl_1000sh=3)


ENTRIES = SCORED + """,
entries AS MATERIALIZED (SELECT symbol, session_date, ts, rn, 500::BIGINT AS qty, ask + target_ps AS target_px, ask - stop_ps AS stop_px, ts + INTERVAL 2 HOUR AS deadline, edge AS label_edge_ps
  FROM scored WHERE target_ps IS NOT NULL AND nbbo_ok AND ask >= bid AND p_win >= 0.6)"""


def entries(spark, sf):
    return fl.entry_decisions(scored_labels(spark, sf), 0.6, 500, BARRIER)


@query("entry_decisions", with_ctes(ENTRIES) + f"SELECT symbol, session_date, ts, qty, {r('target_px', 'target_px')}, {r('stop_px', 'stop_px')}, deadline, {r('label_edge_ps', 'label_edge_ps')} FROM entries")
def _entries(spark, sf):
    return rounded(entries(spark, sf))


def sim_ctes(mode: str, p: str) -> str:
    """Per-entry outcomes, then the exclusive greedy rule."""
    if mode == "taker":
        fill = f"""{p}f AS (SELECT e.*, b.rn AS te, b.n, b.ask AS entry_px, least(e.qty, floor(b.ask_size * 100), floor(0.05 * v.vol))::BIGINT AS fill_qty FROM entries e
          JOIN bars b USING (symbol, session_date, rn) JOIN vols v USING (symbol, session_date, rn)
          WHERE b.nbbo_ok AND b.ask_size > 0 AND least(e.qty, floor(b.ask_size * 100), floor(0.05 * v.vol)) > 0)"""
    else:
        fill = f"""{p}f AS (SELECT e.*, min(f.rn) AS te, b.n, b.bid AS entry_px, e.qty AS fill_qty FROM entries e JOIN bars b USING (symbol, session_date, rn)
          JOIN bars f ON f.symbol = e.symbol AND f.session_date = e.session_date AND f.rn > e.rn AND f.rn <= e.rn + 4 AND f.low < b.bid WHERE b.nbbo_ok GROUP BY ALL)"""
    return f"""{fill},
    {p}o AS (SELECT f.*, (SELECT max(b.rn) FROM bars b WHERE b.symbol = f.symbol AND b.session_date = f.session_date AND b.ts <= f.deadline) AS dd,
      (SELECT max(b.ts) FROM bars b WHERE b.symbol = f.symbol AND b.session_date = f.session_date) AS last_ts FROM {p}f f),
    {p}k AS (SELECT o.*, (SELECT min(b.rn) FROM bars b WHERE b.symbol = o.symbol AND b.session_date = o.session_date AND b.rn > o.te AND b.rn <= o.dd AND b.bid > 0 AND b.bid <= o.stop_px) AS s,
      (SELECT min(b.rn) FROM bars b WHERE b.symbol = o.symbol AND b.session_date = o.session_date AND b.rn > o.te AND b.rn <= o.dd AND b.bid > 0 AND b.bid >= o.target_px) AS g,
      (SELECT min(b.rn) FROM bars b WHERE b.symbol = o.symbol AND b.session_date = o.session_date AND b.rn >= greatest(o.dd, o.te) AND b.bid > 0 AND o.deadline <= o.last_ts) AS tm,
      (SELECT max(b.rn) FROM bars b WHERE b.symbol = o.symbol AND b.session_date = o.session_date AND b.rn >= o.te AND b.bid > 0) AS le FROM {p}o o),
    {p}x AS (SELECT *, CASE WHEN s IS NOT NULL AND (g IS NULL OR s <= g) THEN 'stop' WHEN g IS NOT NULL THEN 'target' WHEN tm IS NOT NULL THEN 'timeout' ELSE 'eod' END AS reason FROM {p}k),
    {p}y AS (SELECT *, CASE reason WHEN 'stop' THEN s WHEN 'target' THEN g WHEN 'timeout' THEN tm ELSE coalesce(le, rn) END AS xrn FROM {p}x),
    {p}z AS MATERIALIZED (SELECT y.*, y.rn AS start_row, y.xrn AS release_row, b.ts AS exit_t, e.ts AS entry_t,
      CASE reason WHEN 'stop' THEN b.bid - coalesce(b.spread / 2, 0) WHEN 'target' THEN target_px ELSE b.bid END AS exit_px
      FROM {p}y y JOIN bars b ON b.symbol = y.symbol AND b.session_date = y.session_date AND b.rn = y.xrn
      JOIN bars e ON e.symbol = y.symbol AND e.session_date = y.session_date AND e.rn = y.te),
    {greedy_sql(p + "z", K3, p + "g", ">")},
    {p}sim AS MATERIALIZED (SELECT e.symbol, e.session_date, e.ts, '{mode}' AS entry_mode, e.label_edge_ps, z.rn IS NOT NULL AS filled, coalesce(z.fill_qty, 0) AS fill_qty, z.entry_px, z.exit_px,
      coalesce(z.reason, 'unfilled') AS exit_reason, z.entry_t, z.exit_t,
      coalesce((z.exit_px - z.entry_px - 27.80e-6 * z.exit_px - least(0.000166 * z.fill_qty, 8.30) / z.fill_qty) * z.fill_qty, 0.0) AS pnl,
      CASE z.reason WHEN 'stop' THEN z.stop_px - z.exit_px WHEN 'target' THEN 0.0 END AS slippage_ps
      FROM entries e LEFT JOIN (SELECT z.* FROM {p}z z JOIN {p}g g USING (symbol, session_date, start_row)) z ON z.symbol = e.symbol AND z.session_date = e.session_date AND z.rn = e.rn)"""


VOLS = f"vols AS (SELECT symbol, session_date, rn, sum(volume) {back(60)} AS vol FROM bars)"
SIM_D = ["label_edge_ps", "entry_px", "exit_px", "slippage_ps"]


TAPE = ("low", "ask_size", "spread", "volume")


def decided_tape(spark, sf):
    """The bars with their entry decisions; made in one pass, without a join of the bars with themselves."""
    return fl.with_decisions(scored_labels(spark, sf, TAPE), 0.6, 500, BARRIER, columns=(*b.KEY, "ts", "bid", "ask", *TAPE))


def simulated(tape, mode):
    return fl.fills_on_tape(tape, FillConfig(entry_mode=mode, maker_wait=4)).withColumn("entry_mode", F.lit(mode))


def simulated_both(spark, sf):
    tape = cut(decided_tape(spark, sf))
    return simulated(tape, "taker").unionByName(simulated(tape, "maker"))


for _mode in ("taker", "maker"):
    _p = _mode[:2]

    @query(
        f"{_mode}_fills",
        with_ctes(ENTRIES, VOLS, sim_ctes(_mode, _p), recursive=True)
        + f"SELECT symbol, session_date, ts, entry_mode, filled, fill_qty, exit_reason, entry_t, exit_t, {rcols(SIM_D)}, {r('pnl', 'pnl', 4)} FROM {_p}sim",
    )
    def _sim(spark, sf, mode=_mode):
        return rounded(simulated(decided_tape(spark, sf), mode), pnl=4)


BOTH = with_ctes(ENTRIES, VOLS, sim_ctes("taker", "ta"), sim_ctes("maker", "ma"), "sims AS (SELECT * FROM tasim UNION ALL SELECT * FROM masim)", recursive=True)


@query(
    "fill_report",
    BOTH + f"""SELECT entry_mode, count(*) AS n_attempted, count(*) FILTER (filled) AS n_filled, {r("count(*) FILTER (filled) / count(*)", "fill_rate", 4)},
    {r("coalesce(avg(fill_qty) FILTER (filled), 0)", "mean_fill_qty", 1)}, {r("sum(pnl)", "sim_pnl_usd", 2)}, {r("sum(pnl) / nullif(sum(fill_qty), 0)", "sim_expectancy_ps", 5)},
    {r("coalesce(sum(label_edge_ps * fill_qty) FILTER (filled), 0)", "label_pnl_same_fills_usd", 2)},
    CASE WHEN sum(label_edge_ps * fill_qty) FILTER (filled) > 0 THEN {r("100 * (1 - sum(pnl) / sum(label_edge_ps * fill_qty) FILTER (filled))", None, 1)} END AS haircut_pct,
    {r("coalesce(avg(slippage_ps) FILTER (filled AND exit_reason = 'stop'), 0)", "stop_slippage_ps_mean", 5)} FROM sims GROUP BY entry_mode""",
)
def _fill_report(spark, sf):
    return rounded(fl.fill_report(simulated_both(spark, sf)))


@query("fill_exit_reasons", BOTH + "SELECT entry_mode, exit_reason, count(*) AS n FROM sims WHERE filled GROUP BY ALL")
def _exit_reasons(spark, sf):
    return fl.exit_reason_counts(simulated_both(spark, sf))

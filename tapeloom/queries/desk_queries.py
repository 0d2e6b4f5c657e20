"""Signals, risk rules, orders, metrics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.config import SCALP_PROFILES, TIERS
from tapeloom.functions import scalar as sc
from tapeloom.operators import bars as b
from tapeloom.operators import orders as od
from tapeloom.operators import risk as rk
from tapeloom.operators import signals as sg
from tapeloom.queries.bar_queries import MICRO, micro
from tapeloom.queries.base import DAILY, EVENTS, query, r, rcols, rounded, with_ctes
from tapeloom.sources import driver_tables as tables

TIER = TIERS["medium"]
NOW = "TIMESTAMP '2001-06-01 12:00:00'"


def now():
    return F.lit("2001-06-01 12:00:00").cast("timestamp")


# ---------------------------------------------------------------- signals
MW = "PARTITION BY symbol ORDER BY ts"
MOMENTUM = DAILY + """,
m0 AS (SELECT symbol, date, close, row_number() OVER w AS n, close / lag(close, 20) OVER w - 1 AS rt FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY date)),
m1 AS (SELECT *, avg(rt) OVER p AS m, stddev_pop(rt) OVER p AS sd FROM m0 WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m2 AS (SELECT *, n >= 25 AND coalesce(sd >= 1e-12, false) AS ok, abs((rt - m) / nullif(sd, 0)) AS z FROM m1)
"""


@query("momentum_signal", with_ctes(MOMENTUM) + f"""SELECT symbol, date, {r("CASE WHEN ok THEN sign(rt) * least(z / 3, 1) ELSE 0 END", "score")}, {r("CASE WHEN ok THEN least(z / 2, 1) ELSE 0 END", "confidence")} FROM m2""")
def _momentum(spark, sf):
    return rounded(sg.momentum_signal(tables.daily(spark, sf).select("symbol", "date", "close")))


@query("last_close_per_utc_day", with_ctes(MICRO) + f"SELECT symbol, CAST(ts AS DATE) AS date, {r('last(close ORDER BY ts)', 'close')} FROM micro GROUP BY ALL")
def _last_close(spark, sf):
    return rounded(b.last_close_per_utc_day(micro(spark, sf)))


VOL = MICRO + f""",
v0 AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS age FROM micro),
v1 AS (SELECT *, row_number() OVER w AS n, ln(close) - ln(lag(close) OVER w) AS r FROM v0 WHERE age <= 2400 WINDOW w AS ({MW})),
v2 AS MATERIALIZED (SELECT *, CASE WHEN count(r) OVER f >= 20 THEN sqrt(avg(r * r) OVER f) END AS rv, avg(r) OVER g AS m, stddev_pop(r) OVER g AS sd FROM v1
  WINDOW f AS ({MW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), g AS ({MW} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
vp AS (SELECT symbol, count(*) AS n_bars, count(rv) AS n_vol, avg((rv <= now)::INT) FILTER (rv IS NOT NULL) AS vol_pct FROM (SELECT *, max(rv) FILTER (age = 1) OVER (PARTITION BY symbol) AS now FROM v2) GROUP BY 1),
mr AS MATERIALIZED (SELECT v2.symbol, ts, n, (r - m) / nullif(sd, 0) AS z, n_bars, n_vol, vol_pct FROM v2 JOIN vp USING (symbol) WHERE age = 1),
tw AS (SELECT symbol, CASE WHEN count(*) < 25 OR sum(d) <= 0 THEN 0.5 ELSE greatest(least((abs(arg_min(close, age) - arg_max(close, age)) / sum(d) - 0.10) / 0.25, 1), 0) END AS trend_w
  FROM (SELECT *, abs(close - lag(close) OVER ({MW})) AS d FROM v0 WHERE age <= 25) GROUP BY 1)
"""


@query("volatility_history", with_ctes(VOL) + f"SELECT symbol, ts, {rcols(['r', 'rv'])} FROM v2")
def _vol(spark, sf):
    return rounded(sg.vol_percentile_series(micro(spark, sf)))


MR_COLS = {
    "score": "CASE WHEN n >= 26 AND z IS NOT NULL THEN greatest(least(-z / 3, 1), -1) ELSE 0 END",
    "confidence": "CASE WHEN n >= 26 AND z IS NOT NULL THEN least(abs(z) / 3, 1) * CASE WHEN n_vol > 10 AND vol_pct > 0.9 THEN 0.2 ELSE 1 END ELSE 0 END",
    "vol_mult": "CASE WHEN n_bars < 40 OR n_vol < 10 OR vol_pct <= 0.5 THEN 1 ELSE greatest(0.3, 1 - 1.4 * (vol_pct - 0.5)) END",
}
MR = ", ".join(r(x, n) for n, x in MR_COLS.items())
MR_RAW = ", ".join(f"({x}) AS {n}" for n, x in MR_COLS.items())


@query("mean_reversion_signal", with_ctes(VOL) + f"SELECT symbol, ts, {MR} FROM mr")
def _reversion(spark, sf):
    return rounded(sg.mean_reversion_signal(micro(spark, sf)))


@query("trend_weight", with_ctes(VOL) + f"SELECT symbol, {r('trend_w', 'trend_w')} FROM tw")
def _trend(spark, sf):
    return rounded(sg.trend_weight(micro(spark, sf)))


ENS = VOL + f""",
dc AS (SELECT symbol, CAST(ts AS DATE) AS date, last(close ORDER BY ts) AS close FROM micro GROUP BY ALL),
e0 AS (SELECT symbol, date, row_number() OVER w AS n, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k, close / lag(close, 20) OVER w - 1 AS rt FROM dc WINDOW w AS (PARTITION BY symbol ORDER BY date)),
e1 AS (SELECT *, avg(rt) OVER p AS m, stddev_pop(rt) OVER p AS sd FROM e0 WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mom AS (SELECT symbol, CASE WHEN n >= 25 AND coalesce(sd >= 1e-12, false) THEN sign(rt) * least(abs((rt - m) / sd) / 3, 1) ELSE 0 END AS ms,
  CASE WHEN n >= 25 AND coalesce(sd >= 1e-12, false) THEN least(abs((rt - m) / sd) / 2, 1) ELSE 0 END AS mc FROM e1 WHERE k = 1),
rv AS (SELECT symbol, {MR_RAW} FROM mr),
en AS MATERIALIZED (SELECT symbol, trend_w, ms, mc, score AS rs, confidence AS rc, vol_mult, trend_w * ms * mc AS c1, (1 - trend_w) * score * confidence AS c2,
  greatest(least(trend_w * ms * mc + (1 - trend_w) * score * confidence, 1), -1) AS ensemble FROM mom JOIN rv USING (symbol) JOIN tw USING (symbol))
"""


def ensemble(spark, sf):
    m = micro(spark, sf)
    mom = sg.momentum_signal(b.last_close_per_utc_day(m))
    last = F.row_number().over(sg.Window.partitionBy("symbol").orderBy(F.desc("date")))
    mom = mom.withColumn("k", last).where("k = 1").select("symbol", F.col("score").alias("mom_score"), F.col("confidence").alias("mom_confidence"))
    rev = sg.mean_reversion_signal(m).select("symbol", F.col("score").alias("rev_score"), F.col("confidence").alias("rev_confidence"), "vol_mult")
    one = F.lit(1.0)
    s = mom.join(rev, "symbol").join(sg.trend_weight(m), "symbol").withColumn("health_momentum", one).withColumn("health_mean_reversion", one)
    return sg.ensemble(s, TIER)


@query("ensemble_score", with_ctes(ENS) + f"SELECT symbol, {r('c1', 'c_momentum')}, {r('c2', 'c_mean_reversion')}, {r('ensemble', 'ensemble')}, abs(ensemble) >= 0.45 AS candidate FROM en")
def _ensemble(spark, sf):
    return rounded(ensemble(spark, sf).select("symbol", "c_momentum", "c_mean_reversion", "ensemble", "candidate"))


@query("signal_bounds", with_ctes(ENS) + "SELECT symbol FROM en WHERE NOT (ms BETWEEN -0.2 AND 0.2 AND mc BETWEEN 0 AND 1)")
def _bounds(spark, sf):
    e = ensemble(spark, sf).select("symbol", (F.col("mom_score") * 5).alias("score"), F.col("mom_confidence").alias("confidence"))
    return sg.bound_violations(e).select("symbol")


ATR = MICRO + f""",
a0 AS (SELECT *, row_number() OVER w AS n, lag(close) OVER w AS pc FROM micro WINDOW w AS ({MW})),
a1 AS (SELECT *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr, greatest(high - low, abs(high - close), abs(low - close)) AS tr0 FROM a0),
atr AS MATERIALIZED (SELECT *, CASE WHEN n < 2 THEN 0 ELSE (coalesce(lag(tr0, 14) OVER w, first_value(tr0) OVER w) + coalesce(sum(CASE WHEN n > 1 THEN tr END) OVER f, 0)) / least(n, 15) END AS atr FROM a1
  WINDOW w AS ({MW}), f AS ({MW} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
"""


@query("average_true_range", with_ctes(ATR) + f"SELECT symbol, ts, {r('atr', 'atr')} FROM atr")
def _atr(spark, sf):
    return rounded(sg.average_true_range(micro(spark, sf)).select("symbol", "ts", "atr"))


@query("trailing_stop", with_ctes(ATR) + f"SELECT symbol, ts, {r(f'greatest(max(close - 2.0 * atr) OVER ({MW}), 4.0)', 'stop_price')} FROM atr")
def _trail(spark, sf):
    a = sg.average_true_range(micro(spark, sf)).withColumn("armed_stop", F.lit(4.0))
    return rounded(sg.trailing_stop(a, 2.0).select("symbol", "ts", "stop_price"))


POS = "pos AS (SELECT symbol, CASE WHEN CAST(substr(symbol, 2) AS INT) % 2 = 0 THEN 100 ELSE -50 END AS qty, CASE WHEN CAST(substr(symbol, 2) AS INT) % 2 = 0 THEN 5.05 ELSE 11.0 END AS stop_price, TIMESTAMP '2024-01-03' AS entry_ts FROM (SELECT DISTINCT symbol FROM ev))"


def stop_positions(spark, sf):
    s = tables.trades(spark, sf).select("symbol").distinct()
    even = F.substring("symbol", 2, 9).cast("int") % 2 == 0
    return s.select("symbol", F.when(even, 100).otherwise(-50).alias("qty"), F.when(even, 5.05).otherwise(11.0).alias("stop_price"), F.lit("2024-01-03").cast("timestamp").alias("entry_ts"))


@query("stop_hits", with_ctes(MICRO, POS) + f"""SELECT m.symbol, qty, stop_price::DOUBLE AS stop_price, min(ts) AS stop_ts, {r("arg_min(close, ts)", "close")} FROM micro m JOIN pos USING (symbol)
    WHERE ts >= entry_ts AND ((qty > 0 AND low <= stop_price) OR (qty < 0 AND high >= stop_price)) GROUP BY ALL""")
def _stops(spark, sf):
    return rounded(sg.stop_hits(micro(spark, sf), stop_positions(spark, sf)))


@query("signal_exits", with_ctes(ENS, POS) + f"SELECT symbol, qty, {r('ensemble', 'ensemble')} FROM pos JOIN en USING (symbol) WHERE (qty > 0 AND ensemble < 0.45) OR (qty < 0 AND ensemble > -0.45)")
def _exits(spark, sf):
    return rounded(sg.signal_exits(stop_positions(spark, sf), ensemble(spark, sf), TIER).select("symbol", "qty", "ensemble"))


INTENT = """
sz AS (SELECT e.symbol, e.ensemble, a.close, a.atr, CASE WHEN atr > 0 THEN floor(least(floor(0.005 * 100000 / (2.0 * atr)), floor(0.1 * 100000 / close)) * vol_mult) ELSE 0 END AS size
  FROM en e JOIN (SELECT symbol, last(close ORDER BY ts) AS close, last(atr ORDER BY ts) AS atr FROM atr GROUP BY 1) a USING (symbol)),
tg AS (SELECT s.*, CASE WHEN ensemble < 0 THEN 0 ELSE size END::BIGINT AS target, CASE WHEN ensemble < 0 THEN 0 ELSE size END::BIGINT - coalesce(pos.qty, 0) AS delta FROM sz s LEFT JOIN pos USING (symbol))"""


@query("order_intents", with_ctes(ENS, ATR.split("micro AS MATERIALIZED")[1].split("\n", 1)[1][ATR.split("micro AS MATERIALIZED")[1].split("\n", 1)[1].index("a0 AS"):], POS, INTENT) + f"""SELECT symbol, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS side, abs(delta) AS qty, target AS target_qty,
    {r("close", "price_hint")}, {r("CASE WHEN delta > 0 THEN close - 2 * atr ELSE close + 2 * atr END", "stop_price")}, 'signal' AS reason, 'intraday' AS book FROM tg WHERE delta <> 0""")
def _intents(spark, sf):
    a = sg.average_true_range(micro(spark, sf)).groupBy("symbol").agg(F.max_by("close", "ts").alias("close"), F.max_by("atr", "ts").alias("atr"))
    return rounded(sg.order_intents(ensemble(spark, sf).join(a, "symbol"), stop_positions(spark, sf), TIER, 100000.0))


# ---------------------------------------------------------------- sizing
SIZE = "sz AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 10 AS p, l_tax + 0.01 AS t, 0.02 + l_tax / 4 AS s, l_extendedprice / 10000 AS px, l_quantity * 40 AS vol, l_quantity % 7 AS lots, l_extendedprice FROM lineitem)"


def size_inputs(spark, sf):
    li = tables.table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_discount") * 10).alias("p"), (F.col("l_tax") + 0.01).alias("t"),
        (0.02 + F.col("l_tax") / 4).alias("s"), (F.col("l_extendedprice") / 10000).alias("px"), (F.col("l_quantity") * 40).alias("vol"), (F.col("l_quantity") % 7).alias("lots"),
    )


KELLY = """CASE WHEN p BETWEEN 0 AND 1 AND px BETWEEN 0.5 AND 10 AND p * t - (1 - p) * (s + 27.80e-6 * px + 0.000166) > 0 THEN
  greatest(floor(least(least(greatest((p * (t / (s + 27.80e-6 * px + 0.000166)) - (1 - p)) / (t / (s + 27.80e-6 * px + 0.000166)), 0), 0.25) * 50000 / px, 0.3 * 50000 / px, 0.03 * vol, 2.0 * lots * 100)), 0) ELSE 0 END"""


@query("kelly_size", with_ctes(SIZE) + f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, ({KELLY})::BIGINT AS shares FROM sz")
def _kelly(spark, sf):
    d = size_inputs(spark, sf)
    n = sc.kelly_shares(sc.Stake(F.col("p"), F.col("t"), F.col("s"), F.col("px"), F.lit(50000.0), F.col("vol"), F.col("lots")), SCALP_PROFILES["mid"])
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", n.alias("shares"))


@query("atr_size", with_ctes(SIZE) + """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN p > 0 THEN floor(least(floor(0.005 * 100000 / (2.0 * p)), floor(0.1 * 100000 / px)) * 0.7) ELSE 0 END::BIGINT AS shares FROM sz""")
def _atr_size(spark, sf):
    d = size_inputs(spark, sf)
    n = sc.atr_shares(TIER, F.lit(100000.0), F.col("px"), F.col("p"), F.lit(0.7))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", n.alias("shares"))


@query("sell_cost", with_ctes(SIZE) + f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {r('27.80e-6 * px + least(0.000166 * vol * 100, 8.30) / greatest(vol * 100, 1)', 'cost', 9)} FROM sz")
def _cost(spark, sf):
    d = size_inputs(spark, sf)
    return rounded(d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", sc.sell_cost("px", F.col("vol") * 100).alias("cost")), 9)


@query("price_buckets", with_ctes(SIZE) + "SELECT CASE WHEN px >= 0.5 AND px < 2 THEN '0.5-2' WHEN px >= 2 AND px < 5 THEN '2-5' WHEN px >= 5 AND px < 10 THEN '5-10' ELSE 'other' END AS price_bucket, count(*) AS n FROM sz GROUP BY 1")
def _buckets(spark, sf):
    return size_inputs(spark, sf).groupBy(sc.price_bucket("px").alias("price_bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("scalp_profiles", "SELECT c_custkey, CASE WHEN c_acctbal * 8 >= 50000 THEN 'large' WHEN c_acctbal * 8 >= 10000 THEN 'mid' ELSE 'small' END AS profile FROM customer")
def _profiles(spark, sf):
    return tables.table(spark, sf, "customer").select("c_custkey", sc.scalp_profile(F.col("c_acctbal") * 8).alias("profile"))


@query("order_ids", """WITH i AS (SELECT *, left(sha1('scalp:P' || l_suppkey || ':buy:' || strftime(l_shipdate, '%Y-%m-%d')), 32) AS cid FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN cid || '-tgt' ELSE cid END AS client_order_id, l_linenumber % 2 = 0 AS is_target FROM i""")
def _ids(spark, sf):
    li = tables.table(spark, sf, "lineitem")
    cid = sc.order_id("scalp", F.concat(F.lit("P"), F.col("l_suppkey").cast("string")), F.lit("buy"), F.date_format("l_shipdate", "yyyy-MM-dd"))
    ids = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") % 2 == 0, sc.target_order_id(cid)).otherwise(cid).alias("client_order_id"))
    return ids.withColumn("is_target", sc.is_target_order("client_order_id"))


# ---------------------------------------------------------------- risk
# one intent per line item of the last quarter's orders would be a filter; all line items are screened
RISK = """
rp AS (SELECT s_name AS symbol, (CAST(floor(s_acctbal) AS BIGINT) % 41) - 12 AS qty, 10.0 + s_suppkey % 30 AS entry_price, 9.0 + s_suppkey % 37 AS mark, CASE WHEN s_suppkey % 5 = 0 THEN 'monthly' ELSE 'intraday' END AS book
  FROM supplier),
it AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 2 THEN 'new ' ELSE '' END || s_name AS symbol, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, CAST(l_quantity AS BIGINT) - 3 AS qty, l_extendedprice / 5000 AS price_hint,
  CASE WHEN l_linenumber = 4 THEN 'monthly' ELSE 'intraday' END AS book, l_linenumber <> 5 AS in_entry_window, s_suppkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
ex AS (SELECT coalesce(sum((mark - entry_price) * qty) FILTER (book = 'intraday'), 0) AS u, count(*) FILTER (book = 'intraday') AS np FROM rp),
bg AS (SELECT book, sum(abs(qty * mark)) AS g FROM rp GROUP BY 1),
sp AS (SELECT unnest([s_name, 'new ' || s_name]) AS symbol, CASE WHEN s_suppkey % 11 = 0 THEN -900.0 ELSE 10.0 END AS realized FROM supplier),
rj AS (SELECT it.*, coalesce(rp.qty, 0) AS cur, rp.book AS pb, coalesce(rp.qty * rp.mark, 0) AS v, coalesce(g, 0) AS g, u, np, realized, coalesce(rp.qty, 0) + CASE WHEN side = 'buy' THEN it.qty ELSE -it.qty END AS after
  FROM it LEFT JOIN rp USING (symbol) LEFT JOIN bg ON bg.book = it.book CROSS JOIN ex LEFT JOIN sp USING (symbol)),
rk AS (SELECT *, abs(after) > abs(cur) AS entry, abs(after * price_hint) AS val, NOT coalesce(pb = 'intraday', false) AS isnew FROM rj)
"""


def risk_positions(spark, sf):
    s = tables.table(spark, sf, "supplier")
    return s.select(
        F.col("s_name").alias("symbol"), (F.floor("s_acctbal") % 41 - 12).alias("qty"), (10.0 + F.col("s_suppkey") % 30).alias("entry_price"),
        (9.0 + F.col("s_suppkey") % 37).alias("mark"), F.when(F.col("s_suppkey") % 5 == 0, "monthly").otherwise("intraday").alias("book"),
    )


def intents(spark, sf):
    li, s = tables.table(spark, sf, "lineitem"), tables.table(spark, sf, "supplier")
    unheld = F.when(F.col("l_linenumber") % 3 == 2, "new ").otherwise("")  # names without a position
    return li.join(s, li.l_suppkey == s.s_suppkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.concat(unheld, "s_name").alias("symbol"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        (F.col("l_quantity").cast("long") - 3).alias("qty"), (F.col("l_extendedprice") / 5000).alias("price_hint"),
        F.when(F.col("l_linenumber") == 4, "monthly").otherwise("intraday").alias("book"), (F.col("l_linenumber") != 5).alias("in_entry_window"),
    )


def account(spark, rows):
    cols = "equity double, day_start_equity double, peak_equity double, intraday_realized double, halted boolean, intraday_halted boolean"
    return spark.createDataFrame(rows, cols)


@query("position_exposures", with_ctes(RISK) + f"""SELECT book, {r("sum(abs(qty * mark))", "gross", 3)}, {r("sum((mark - entry_price) * qty)", "unrealized", 3)}, {r("sum(abs(qty * entry_price))", "cost_basis", 3)}, count(*) AS n_positions FROM rp GROUP BY 1""")
def _exposures(spark, sf):
    return rounded(rk.exposures(risk_positions(spark, sf)), 3)


@query(
    "screened_intents",
    with_ctes(RISK) + """SELECT l_orderkey, l_linenumber, l_partkey, symbol, side, qty, price_hint, book, in_entry_window, CASE
    WHEN qty <= 0 THEN 'non-positive quantity' WHEN cur <> 0 AND pb <> book THEN 'symbol held by ' || pb || ' book'
    WHEN book = 'intraday' AND s_suppkey % 7 = 0 THEN 'symbol ' || symbol || ' not in tier universe'
    WHEN entry AND NOT price_hint BETWEEN 0.5 AND 10 THEN 'outside scalp price band' WHEN entry AND realized <= -0.02 * 40000 THEN 'per-symbol loss cap'
    WHEN entry AND isnew AND np >= 3 THEN 'max concurrent scalps' WHEN entry AND after < 0 THEN 'shorting not allowed in this tier'
    WHEN entry AND val > 0.005 * 40000 + 1e-6 THEN 'exceeds max position size' WHEN entry AND g - abs(v) + val > 0.8 * 40000 + 1e-6 THEN 'exceeds max gross exposure'
    WHEN entry AND isnew AND np >= 10 THEN 'exceeds max open positions' WHEN entry AND (100 + u) / 41000 <= -0.02 THEN 'daily loss limit reached'
    WHEN entry AND (42000 - 40000) / 42000.0 >= 0.35 THEN 'account drawdown floor reached' WHEN entry AND NOT in_entry_window THEN 'outside entry window' END AS reason FROM rk""",
)
def _screen(spark, sf):
    import dataclasses

    tier = dataclasses.replace(TIER, max_position_pct=0.005)
    acct = account(spark, [(40000.0, 41000.0, 42000.0, 100.0, False, False)])
    sup = tables.table(spark, sf, "supplier")
    names = F.explode(F.array("s_name", F.concat(F.lit("new "), "s_name"))).alias("symbol")
    uni = sup.where("s_suppkey % 7 <> 0").select(names)
    pnl = sup.select(names, F.when(F.col("s_suppkey") % 11 == 0, -900.0).otherwise(10.0).alias("realized"))
    return rk.screen_intents(intents(spark, sf), risk_positions(spark, sf), acct, tier, uni, pnl, SCALP_PROFILES["mid"])


@query("screened_exits", with_ctes(RISK) + """SELECT l_orderkey, l_linenumber, l_partkey, symbol, side, qty, price_hint, book, in_entry_window,
    CASE WHEN qty <= 0 THEN 'non-positive quantity' WHEN entry THEN 'exit path used for an exposure-increasing order' END AS reason FROM rk""")
def _screen_exits(spark, sf):
    return rk.screen_exits(intents(spark, sf), risk_positions(spark, sf))


TRIG = "tr AS (SELECT o_orderkey AS id, o_totalprice / 5 AS equity, 90000.0 AS peak_equity, (o_custkey % 3) * 30000.0 AS day_start_equity, ((o_orderkey % 9) - 5) / 100.0 AS pp, (o_orderkey * 13 % 400)::DOUBLE AS age, o_orderkey % 2 = 0 AS open FROM orders)"


@query(
    "account_triggers",
    with_ctes(TRIG) + f""", t AS (SELECT *, greatest(0, 1 - equity / peak_equity) AS dd FROM tr), k AS (SELECT *, CASE WHEN equity > 0 AND equity < 2600 THEN 'equity floor' WHEN dd >= 0.35 THEN 'account drawdown floor'
    WHEN day_start_equity > 0 AND pp <= -0.02 THEN 'intraday daily loss' WHEN open AND age > 180 THEN 'data staleness' END AS trigger FROM t)
    SELECT id, {r("dd", "drawdown_pct")}, trigger, CASE WHEN trigger IN ('equity floor', 'account drawdown floor') THEN 'account' WHEN trigger IS NOT NULL THEN 'intraday' END AS scope FROM k""",
)
def _triggers(spark, sf):
    o = tables.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 5).alias("equity"), F.lit(90000.0).alias("peak_equity"), ((F.col("o_custkey") % 3) * 30000.0).alias("day_start_equity"),
        ((F.col("o_orderkey") % 9 - 5) / 100.0).alias("intraday_day_pnl_pct"), (F.col("o_orderkey") * 13 % 400).cast("double").alias("data_age_s"), (F.col("o_orderkey") % 2 == 0).alias("session_open"),
    )
    return rounded(rk.account_triggers(o, TIER, 2600.0).select("id", "drawdown_pct", "trigger", "scope"))


@query("error_bursts", """WITH e AS (SELECT ts, event_id AS seq FROM events WHERE event_type = 'error') SELECT ts, seq, coalesce(epoch_us(ts) - epoch_us(lag(ts, 4) OVER (ORDER BY ts, seq)) <= 5400000000, false) AS burst FROM e""")
def _bursts(spark, sf):
    e = tables.table(spark, sf, "events").where("event_type = 'error'").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    return rk.error_bursts(e, 5, 5400.0, chunk_rows=500)


GAPS = EVENTS + """,
ar AS (SELECT symbol, seq, ts AS recv_ts, ts - to_microseconds((seq % 5) * 400000000) AS quote_ts FROM quotes),
g0 AS (SELECT *, max(quote_ts) OVER (PARTITION BY symbol ORDER BY recv_ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM ar),
g1 AS (SELECT *, CASE WHEN quote_ts >= newest THEN (epoch_us(quote_ts) - epoch_us(newest)) / 1e6 END AS gap_s FROM g0),
gp AS MATERIALIZED (SELECT *, quantile_cont(gap_s, 0.5) OVER w AS p50, quantile_cont(gap_s, 0.95) OVER w AS p95 FROM g1 WINDOW w AS (PARTITION BY symbol ORDER BY recv_ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW))
"""


def arrivals(spark, sf):
    q = tables.quotes(spark, sf)
    stamp = F.timestamp_micros(F.unix_micros("ts") - (F.col("seq") % 5) * F.lit(400_000_000))
    return q.select("symbol", "seq", F.col("ts").alias("recv_ts"), stamp.alias("quote_ts"))


@query("quote_gaps", with_ctes(GAPS) + f"SELECT symbol, seq, recv_ts, quote_ts, newest, {r('gap_s', 'gap_s', 8)}, {r('p50', 'gap_p50', 8)}, {r('p95', 'gap_p95', 8)} FROM gp")
def _gaps(spark, sf):
    return rounded(b.quote_gaps(arrivals(spark, sf), 43200, 86400), 8)


@query("staleness_snapshot", with_ctes(GAPS) + f""", s AS (SELECT symbol, (epoch_us(TIMESTAMP '2024-01-31 06:00:00') - epoch_us(max(quote_ts))) / 1e6 AS age, last(p50 ORDER BY recv_ts, seq) AS a, last(p95 ORDER BY recv_ts, seq) AS b FROM gp GROUP BY 1)
    SELECT symbol, {r("age", "age_s", 4)}, {r("a", "p50_gap_s", 4)}, {r("b", "p95_gap_s", 4)}, (SELECT CASE WHEN max(age) > 180 THEN 'kill' WHEN max(age) > 60 THEN 'pause' ELSE 'ok' END FROM s) AS worst FROM s""")
def _stale(spark, sf):
    return rounded(rk.staleness_snapshot(b.quote_gaps(arrivals(spark, sf), 43200, 86400), F.lit("2024-01-31 06:00:00").cast("timestamp")), 4)


BRK = EVENTS + """, br AS (SELECT seq AS bracket_id, symbol, CAST(size AS BIGINT) AS qty, price - 0.4 AS stop_px, ts AS armed_ts, ts + INTERVAL 3 HOUR AS deadline FROM trades),
hit AS (SELECT bracket_id, br.symbol, qty, q.ts, q.seq, CASE WHEN bid_price <= stop_px THEN 0 ELSE 1 END AS k FROM br JOIN quotes q ON q.symbol = br.symbol AND q.ts >= armed_ts AND (bid_price <= stop_px OR q.ts >= deadline))"""


@query("bracket_actions", with_ctes(BRK) + "SELECT bracket_id, symbol, qty, CASE first(k ORDER BY ts, k, seq) WHEN 0 THEN 'stop' ELSE 'timeout' END AS kind, min(ts) AS ts FROM hit GROUP BY ALL")
def _brackets(spark, sf):
    t = tables.trades(spark, sf).select(
        F.col("seq").alias("bracket_id"), "symbol", F.col("size").cast("long").alias("qty"), (F.col("price") - 0.4).alias("stop_px"), F.col("ts").alias("armed_ts"), sc.plus_seconds("ts", 10800).alias("deadline")
    )
    return rk.bracket_actions(t, tables.quotes(spark, sf).withColumnRenamed("bid_price", "bid"))


@query(
    "reconcile_positions",
    """WITH o AS (SELECT s_name AS symbol, s_suppkey % 13 AS qty, 10.0::DOUBLE AS e, 11.0::DOUBLE AS m FROM supplier WHERE s_suppkey % 4 <> 0),
    b AS (SELECT s_name AS symbol, s_suppkey % 11 AS qty, 12.0::DOUBLE AS e, CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE 14.0 END::DOUBLE AS m FROM supplier WHERE s_suppkey % 6 <> 0)
    SELECT symbol, CASE WHEN o.qty IS NULL THEN 'adopt' WHEN b.qty IS NULL THEN 'drop' WHEN b.qty <> o.qty THEN 'qty_mismatch' ELSE 'mark_refresh' END AS action, b.qty AS qty,
    CASE WHEN b.qty IS NULL THEN NULL WHEN o.qty IS NULL OR b.qty <> o.qty THEN b.e ELSE o.e END AS entry_price, CASE WHEN b.qty IS NULL THEN NULL WHEN o.qty IS NULL THEN coalesce(nullif(b.m, 0), b.e) ELSE coalesce(nullif(b.m, 0), o.m) END AS mark
    FROM b FULL JOIN o USING (symbol)""",
)
def _reconcile(spark, sf):
    s = tables.table(spark, sf, "supplier")
    own = s.where("s_suppkey % 4 <> 0").select(F.col("s_name").alias("symbol"), (F.col("s_suppkey") % 13).alias("qty"), F.lit(10.0).alias("entry_price"), F.lit(11.0).alias("mark"))
    brk = s.where("s_suppkey % 6 <> 0").select(F.col("s_name").alias("symbol"), (F.col("s_suppkey") % 11).alias("qty"), F.lit(12.0).alias("entry_price"), F.when(F.col("s_suppkey") % 3 == 0, 0.0).otherwise(14.0).alias("mark"))
    return rk.reconcile(brk, own)


@query(
    "subscription_plan",
    """WITH s AS (SELECT s_name AS symbol, s_suppkey AS p, s_suppkey % 23 = 5 AS ctx FROM supplier), k AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY p) AS k, count(*) FILTER (NOT ctx) OVER () AS n, count(*) FILTER (ctx) OVER () AS c FROM s),
    f AS (SELECT *, least(n, 10) AS full_n, 32 - least(n, 10) * 3 AS spare FROM k)
    SELECT symbol, (NOT ctx AND k <= full_n) OR (CASE WHEN ctx THEN k ELSE c + k - full_n END) <= spare AS bar, NOT ctx AND k <= full_n AS quote, NOT ctx AND k <= full_n AS trade FROM f""",
)
def _subs(spark, sf):
    s = tables.table(spark, sf, "supplier").select(F.col("s_name").alias("symbol"), F.col("s_suppkey").alias("position"), (F.col("s_suppkey") % 23 == 5).alias("is_context"))
    return rk.subscription_plan(s, 32)


# ---------------------------------------------------------------- orders and fills
OEV = """
oo0 AS (SELECT 'c' || o_orderkey AS client_order_id, 'U' || o_custkey % 50 AS symbol, CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS side, CAST(o_totalprice / 4000 AS BIGINT) AS qty, 'new' AS status, CASE WHEN o_orderkey % 5 = 1 THEN 200000000000 ELSE 0 END AS seq, o_orderkey AS k FROM orders),
ou AS (SELECT * FROM oo0 UNION ALL SELECT client_order_id, symbol, side, qty * 2, 'submitted', 450000000000, k FROM oo0 WHERE k % 4 = 0),
oo AS (SELECT client_order_id, any_value(symbol) AS symbol, any_value(side) AS side, max(qty) AS qty, arg_max(status, seq) AS status, min(seq) AS f, max(seq) AS m FROM ou GROUP BY 1),
oe AS (SELECT CASE WHEN l_linenumber = 7 THEN 'x' ELSE 'c' END || l_orderkey AS client_order_id, (l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS seq, CASE WHEN l_linenumber = 6 THEN 'canceled' END AS st, CASE WHEN l_linenumber <> 6 THEN CAST(l_quantity AS BIGINT) END AS fq,
  CASE WHEN l_linenumber <> 6 THEN l_extendedprice END AS fp FROM lineitem),
oj AS (SELECT oe.*, oo.qty, sum(coalesce(fq, 0)) OVER (PARTITION BY client_order_id ORDER BY seq, fp) AS cum FROM oe JOIN oo USING (client_order_id) WHERE seq >= f),
os AS (SELECT client_order_id, max(seq) AS e, last(CASE WHEN fq IS NULL THEN st WHEN cum >= qty THEN 'filled' ELSE 'partially_filled' END ORDER BY seq) AS st, sum(fq)::BIGINT AS filled, last(fp ORDER BY seq) FILTER (fq IS NOT NULL) AS fp FROM oj GROUP BY 1)
"""


@query("latest_orders", with_ctes(OEV) + "SELECT client_order_id, symbol, side, oo.qty, CASE WHEN e >= m THEN st ELSE status END AS status, coalesce(filled, 0)::BIGINT AS filled_qty, fp AS fill_price FROM oo LEFT JOIN os USING (client_order_id)")
def _orders(spark, sf):
    return od.latest_orders(*order_updates(spark, sf))


def order_updates(spark, sf):
    """(upserts, events) of the order table; a quarter of the orders is upserted twice."""
    o = tables.table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("c"), "o_orderkey").alias("client_order_id"), F.concat(F.lit("U"), (F.col("o_custkey") % 50).cast("string")).alias("symbol"),
        F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy").alias("side"), F.rint(F.col("o_totalprice") / 4000).cast("long").alias("qty"), F.lit("new").alias("status"), F.when(F.col("o_orderkey") % 5 == 1, 200_000_000_000).otherwise(0).cast("long").alias("seq"),
    )
    again = o.where("o_orderkey % 4 = 0").withColumns({"qty": F.col("qty") * 2, "status": F.lit("submitted"), "seq": F.lit(450_000_000_000)})
    o = o.unionByName(again).drop("o_orderkey")
    li = tables.table(spark, sf, "lineitem")
    fill = F.col("l_linenumber") != 6
    ev = li.select(
        F.concat(F.when(F.col("l_linenumber") == 7, "x").otherwise("c"), "l_orderkey").alias("client_order_id"),
        ((F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")).alias("seq"),
        F.when(~fill, "canceled").alias("status"), F.when(fill, F.col("l_quantity").cast("long")).alias("fill_qty"), F.when(fill, F.col("l_extendedprice")).alias("fill_price"),
    )
    return o, ev


FILLS = """
fl AS (SELECT 'P' || l_suppkey AS symbol, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS seq, l_partkey AS tie, CASE WHEN l_returnflag = 'R' OR l_linestatus = 'F' THEN 'sell' ELSE 'buy' END AS side,
  CAST(l_quantity AS BIGINT) AS qty, floor(CAST(round(l_extendedprice * 100) AS BIGINT) * 100 / l_quantity) / 10000.0 AS price FROM lineitem),
fn AS (SELECT *, CASE WHEN side = 'buy' THEN qty ELSE -qty END AS delta, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq, tie) AS rn FROM fl),
mt AS (SELECT symbol, rn, ts, seq, tie, price, delta AS pos, 0::BIGINT AS prev, price AS entry, 0.0::DOUBLE AS entry_before, delta, ts AS opened, NULL::TIMESTAMP AS opened_before FROM fn WHERE rn = 1
  UNION ALL SELECT f.symbol, f.rn, f.ts, f.seq, f.tie, f.price, m.pos + f.delta, m.pos,
   CASE WHEN m.pos = 0 THEN f.price WHEN (m.pos > 0) <> (f.delta > 0) THEN m.entry ELSE (m.entry * m.pos + f.price * f.delta) / (m.pos + f.delta) END, m.entry, f.delta,
   CASE WHEN m.pos = 0 THEN f.ts ELSE m.opened END, m.opened FROM mt m JOIN fn f ON f.symbol = m.symbol AND f.rn = m.rn + 1)
"""


def off_tie():
    """Entry prices blend to exact binary fractions; a tiny shift keeps them off rounding ties."""
    return (F.col("entry_price") + 0.00000314159).alias("entry_price")


def matched(spark, sf):
    return od.match_fills(tables.fills(spark, sf), chunk_rows=200)


@query("matched_fills", with_ctes(FILLS, recursive=True) + f"SELECT symbol, ts, seq, tie, prev::BIGINT AS pos_before, pos::BIGINT AS pos_after, {r('CASE WHEN pos <> 0 THEN entry END + 0.00000314159', 'entry_price', 4)}, CASE WHEN prev <> 0 AND (prev > 0) <> (delta > 0) THEN least(abs(delta), abs(prev)) END::BIGINT AS closed_qty, {r('CASE WHEN prev <> 0 AND (prev > 0) <> (delta > 0) THEN entry_before + 0.00000314159 END', 'closed_entry', 4)}, {r('CASE WHEN prev <> 0 AND (prev > 0) <> (delta > 0) THEN (price - entry_before) * least(abs(delta), abs(prev)) * sign(prev) + 0.00000314159 END', 'pnl', 4)} FROM mt")
def _matched(spark, sf):
    return rounded(matched(spark, sf).select("symbol", "ts", "seq", "tie", "pos_before", "pos_after", off_tie(), "closed_qty", (F.col("closed_entry") + 0.00000314159).alias("closed_entry"), (F.col("pnl") + 0.00000314159).alias("pnl")), 4)


@query("closed_round_trips", with_ctes(FILLS, recursive=True) + f"""SELECT symbol, CASE WHEN prev > 0 THEN 'long' ELSE 'short' END AS side, least(abs(delta), abs(prev))::BIGINT AS qty, opened_before AS entry_ts, ts AS exit_ts,
    {r("entry_before + 0.00000314159", "entry_price", 4)}, price AS exit_price, {r("(price - entry_before) * least(abs(delta), abs(prev)) * sign(prev) + 0.00000314159", "pnl", 4)} FROM mt WHERE prev <> 0 AND (prev > 0) <> (delta > 0)""")
def _trips(spark, sf):
    out = od.closed_round_trips(matched(spark, sf))
    return rounded(out.withColumn("entry_price", off_tie()).withColumn("pnl", F.col("pnl") + 0.00000314159), 4)


@query("open_positions", with_ctes(FILLS, recursive=True) + f"SELECT symbol, last(pos ORDER BY rn)::BIGINT AS qty, {r('last(entry ORDER BY rn) + 0.00000314159', 'entry_price', 4)}, last(price ORDER BY rn) AS mark FROM mt GROUP BY symbol HAVING last(pos ORDER BY rn) <> 0")
def _open(spark, sf):
    return rounded(od.open_positions(matched(spark, sf)).withColumn("entry_price", off_tie()), 4)


# ---------------------------------------------------------------- metrics and reports
TRD = """
ct AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'P' || l_suppkey AS symbol, CASE WHEN l_returnflag = 'R' THEN 'short' ELSE 'long' END AS side, CAST(l_quantity AS BIGINT) AS qty, l_shipdate AS entry_ts,
  l_shipdate + to_hours(l_linenumber + 1) AS exit_ts, floor(CAST(round(l_extendedprice * 100) AS BIGINT) / l_quantity) / 100.0 AS entry_price, floor(floor(CAST(round(l_extendedprice * 100) AS BIGINT) / l_quantity) * (100 + CAST(round((l_discount - l_tax) * 100) AS BIGINT)) / 100) / 100.0 AS exit_price, floor(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round((l_discount - l_tax) * 100) AS BIGINT) / 100) / 100.0 AS pnl FROM lineitem),
eq AS (SELECT o_orderkey AS id, o_orderdate + to_seconds(o_orderkey % 86400) AS ts, 100000.0 + (o_orderkey * 7919 + o_custkey * 104729) % 20011 AS equity, (100000.0 + (o_orderkey * 7919 + o_custkey * 104729) % 20011) / 2 AS cash,
  round(o_totalprice / 10, 2) AS gross_exposure FROM orders)
"""


@query("realized_by_day", with_ctes(TRD) + f"SELECT CAST(exit_ts AS DATE) AS session_date, {r('sum(pnl)', 'realized', 2)}, count(*) AS n FROM ct GROUP BY 1")
def _realized(spark, sf):
    return rounded(od.realized_by_day(tables.closed_trades(spark, sf)), 2)


@query("realized_by_symbol_day", with_ctes(TRD) + f"SELECT CAST(exit_ts AS DATE) AS session_date, symbol, {r('sum(pnl)', 'realized', 2)}, count(*) AS n FROM ct GROUP BY 1, 2")
def _realized_symbol(spark, sf):
    return rounded(od.realized_by_day(tables.closed_trades(spark, sf), True), 2)


METRICS = f""", eqd AS (SELECT CAST(ts AS DATE) AS d, last(equity ORDER BY ts, id) AS v FROM e GROUP BY 1), er AS (SELECT (v - lag(v) OVER (ORDER BY d)) / greatest(lag(v) OVER (ORDER BY d), 1e-9) AS x FROM eqd),
    dd AS (SELECT max((p - equity) / p) AS m FROM (SELECT equity, max(equity) OVER (ORDER BY ts, id) AS p FROM e))
    SELECT {r("(SELECT last(equity ORDER BY ts, id) / first(equity ORDER BY ts, id) - 1 FROM e) * 100", "total_return_pct", 4)}, {r("(SELECT avg(x) / stddev_pop(x) * sqrt(252) FROM er)", "sharpe_daily_annualized", 4)},
    {r("(SELECT m FROM dd) * 100", "max_drawdown_pct", 4)}, {r("avg((pnl > 0)::INT)", "hit_rate", 4)}, {r("avg(pnl) FILTER (pnl > 0)", "avg_win", 4)}, {r("avg(pnl) FILTER (pnl <= 0)", "avg_loss", 4)}, count(*) AS n_trades, count(*) AS turnover FROM t"""


@query("performance_metrics", with_ctes(TRD, "e AS (SELECT * FROM eq)", "t AS (SELECT * FROM ct)") + METRICS)
def _metrics(spark, sf):
    return rounded(od.performance_metrics(tables.equity_snapshots(spark, sf), tables.closed_trades(spark, sf)), 4)


@query("metrics_for_range", with_ctes(TRD, f"e AS (SELECT * FROM eq WHERE ts >= {NOW} - INTERVAL 30 DAY)", f"t AS (SELECT * FROM ct WHERE exit_ts >= {NOW} - INTERVAL 30 DAY)") + METRICS)
def _metrics_range(spark, sf):
    e = od.in_range(tables.equity_snapshots(spark, sf), now(), "1m")
    return rounded(od.performance_metrics(e, od.in_range(tables.closed_trades(spark, sf), now(), "1m", "exit_ts")), 4)


@query("equity_drawdown", with_ctes(TRD) + f"SELECT id, ts, equity, max(equity) OVER w AS peak, {r('(max(equity) OVER w - equity) / max(equity) OVER w', 'drawdown')} FROM eq WINDOW w AS (ORDER BY ts, id)")
def _drawdown(spark, sf):
    return rounded(od.with_drawdown(tables.equity_snapshots(spark, sf), ("ts", "id")).select("id", "ts", "equity", "peak", "drawdown"))


@query("peak_and_day_start", with_ctes(TRD) + "SELECT id, CAST(ts AS DATE) AS session_date, max(equity) OVER (ORDER BY ts, id) AS peak_equity, first_value(equity) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, id) AS day_start_equity FROM eq")
def _peak(spark, sf):
    return od.peak_and_day_start(tables.equity_snapshots(spark, sf)).select("id", "session_date", "peak_equity", "day_start_equity")


@query("equity_curve", with_ctes(TRD) + ", k AS (SELECT id, ts, equity, row_number() OVER (ORDER BY ts, id) - 1 AS i, count(*) OVER () AS n FROM eq), pick AS (SELECT DISTINCT (j * ((SELECT max(n) FROM k) - 1)) // 499 AS i FROM (SELECT unnest(range(500)) AS j)) SELECT id, ts, equity FROM k JOIN pick USING (i)")
def _curve(spark, sf):
    return od.downsample(tables.equity_snapshots(spark, sf).select("id", "ts", "equity"), 500)


def range_sql(span: str, days: int | None) -> str:
    rows = "eq" if days is None else f"(SELECT * FROM eq WHERE ts >= {NOW} - INTERVAL {days} DAY)"
    k = f"(SELECT id, ts, equity, row_number() OVER (ORDER BY ts, id) - 1 AS i, count(*) OVER () AS n FROM {rows})"
    return f"SELECT '{span}' AS span, id, ts, equity FROM {k} WHERE n <= 100 OR i IN (SELECT (j * (n0 - 1)) // 99 FROM (SELECT unnest(range(100)) AS j), (SELECT count(*) AS n0 FROM {rows}))"


RANGES = {"1d": 1, "1w": 7, "1m": 30, "all": None}


@query("equity_ranges", with_ctes(TRD) + " UNION ALL ".join(range_sql(s, d) for s, d in RANGES.items()))
def _ranges(spark, sf):
    """The equity curve of every range that can be asked for, at most 100 points each."""
    e, out = tables.equity_snapshots(spark, sf).select("id", "ts", "equity"), None
    for span in RANGES:
        one = od.downsample(od.in_range(e, now(), span), 100).select(F.lit(span).alias("span"), "id", "ts", "equity")
        out = one if out is None else out.unionByName(one)
    return out


@query("pnl_histogram", with_ctes(TRD) + f""", ed AS (SELECT min(pnl) AS lo, (max(pnl) - min(pnl)) / 10 AS step FROM ct), c AS (SELECT least(floor((pnl - lo) / step), 9)::INT AS bin, count(*) AS n FROM ct, ed GROUP BY 1)
    SELECT bin::INT AS bin, {r("lo + bin * step", "bin_start", 3)}, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(10))::INT AS bin) b LEFT JOIN c USING (bin), ed""")
def _hist(spark, sf):
    return rounded(od.pnl_histogram(tables.closed_trades(spark, sf)), 3)


@query("position_totals", with_ctes(RISK) + f"""SELECT {r("sum((mark - entry_price) * qty)", "unrealized", 3)}, {r("sum(abs(qty * mark))", "gross", 3)}, count(*) FILTER (qty > 0) AS n_long, count(*) FILTER (qty < 0) AS n_short FROM rp""")
def _totals(spark, sf):
    return rounded(od.position_totals(risk_positions(spark, sf)), 3)


@query(
    "signal_health",
    with_ctes(TRD) + f""", h AS (SELECT pnl, abs(qty % 7 - 2.0) AS m, abs(qty % 3 + 0.0) AS v FROM ct WHERE exit_ts >= {NOW} - INTERVAL 30 DAY), p AS (SELECT 'momentum' AS signal, pnl * m / (m + v) AS x FROM h WHERE m + v > 0
    UNION ALL SELECT 'mean_reversion', pnl * v / (m + v) FROM h WHERE m + v > 0), s AS (SELECT signal, count(*) AS n, avg((x > 0)::INT) AS hit, sum(x) AS tot FROM p GROUP BY 1)
    SELECT signal, n, {r("hit", "rolling_hit_rate")}, {r("tot", "attributed_pnl", 2)}, {r("CASE WHEN hit < 0.5 OR tot < 0 THEN 0.5 WHEN signal = 'momentum' THEN 0.5 ELSE 1.0 END", "weight_multiplier")}, hit < 0.5 OR tot < 0 AS flagged_for_retrain FROM s WHERE n >= 5""",
)
def _health(spark, sf):
    t = tables.closed_trades(spark, sf)
    number = (F.col("qty") % 7 - 2).cast("string")
    obj = F.concat(F.lit('{"score": 1, "contribution": '), (F.col("qty") % 3).cast("string"), F.lit("}"))
    t = t.withColumn("signal_scores", F.create_map(F.lit("momentum"), number, F.lit("mean_reversion"), obj))
    prev = spark.createDataFrame([("momentum", 0.5)], "signal string, weight_multiplier double")
    return rounded(od.signal_health(t, prev, now()), attributed_pnl=2)


@query("account_report", with_ctes(TRD) + f"""SELECT equity, cash, gross_exposure, {r("equity - 98765", "day_pnl", 2)}, {r("(equity - 98765) / 98765 * 100", "day_pnl_pct", 4)}, cash AS buying_power FROM eq ORDER BY id DESC LIMIT 1""")
def _account(spark, sf):
    state = spark.createDataFrame([(98765.0,)], "day_start_equity double")
    return rounded(od.account_report(tables.equity_snapshots(spark, sf), state), 4)


@query("orders_by_status", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey DESC LIMIT 100")
def _by_status(spark, sf):
    o = tables.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return od.newest(o, 100, [F.desc("o_orderkey")], F.col("o_orderstatus") == "P")


TREP = f"SELECT id, symbol, side, qty, entry_ts, exit_ts, entry_price, exit_price, {r('pnl', 'pnl', 2)}, {r('(epoch_us(exit_ts) - epoch_us(entry_ts)) / 1e6', 'holding_seconds')} FROM ct"


@query("trades_report", with_ctes(TRD) + TREP + " WHERE exit_ts >= TIMESTAMP '2001-05-01'")
def _trades(spark, sf):
    since = F.lit("2001-05-01").cast("timestamp")
    return rounded(od.trades_report(tables.closed_trades(spark, sf), since))


@query("trades_today", with_ctes(TRD) + TREP + " WHERE exit_ts >= TIMESTAMP '2001-06-01 04:00:00'")
def _today(spark, sf):
    return rounded(od.trades_today(tables.closed_trades(spark, sf), now())[0])


@query("trades_today_summary", with_ctes(TRD) + f"""SELECT count(*) AS n, {r("sum(pnl)", "total_pnl", 2)}, {r("avg((pnl > 0)::INT)", "hit_rate", 4)}, {r("avg(pnl) FILTER (pnl > 0)", "avg_win", 2)}, {r("avg(pnl) FILTER (pnl <= 0)", "avg_loss", 2)}
    FROM ct WHERE exit_ts >= TIMESTAMP '2001-06-01 04:00:00'""")
def _today_summary(spark, sf):
    return rounded(od.trades_today(tables.closed_trades(spark, sf), now())[1], 4)


@query("latest_signals", "WITH t AS (SELECT event_id AS id, 'U' || user_id % 20 AS symbol, value - 50 AS ensemble FROM events) SELECT symbol, max(id) AS id, arg_max(ensemble, id) AS ensemble FROM t GROUP BY 1")
def _signals(spark, sf):
    e = tables.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("U"), (F.col("user_id") % 20).cast("string")).alias("symbol"), (F.col("value") - 50).alias("ensemble"))
    return od.latest_per_symbol(e)


@query("position_snapshot", with_ctes(RISK) + f"""SELECT symbol, qty, CASE WHEN qty > 0 THEN 'long' ELSE 'short' END AS side, entry_price::DOUBLE AS entry_price, mark::DOUBLE AS mark, {r("qty * mark", "market_value", 3)}, {r("(mark - entry_price) * qty", "unrealized", 3)}, 129600.0::DOUBLE AS age_s FROM rp""")
def _snapshot(spark, sf):
    p = risk_positions(spark, sf).withColumn("entry_ts", F.lit("2001-05-31 00:00:00").cast("timestamp"))
    return rounded(od.position_snapshot(p, now()), 3)


@query("engine_status", """WITH s AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS tier, '' AS halted_reason, o_orderdate + INTERVAL 12 HOUR AS hb FROM orders) SELECT status, tier, halted_reason, (epoch_us(TIMESTAMP '2001-06-01 12:00:00') - epoch_us(hb)) / 1e6 AS heartbeat_age_s, hb AS last_data_ts,
    (epoch_us(TIMESTAMP '2001-06-01 12:00:00') - epoch_us(hb)) / 1e6 < 30 AS heartbeat_fresh FROM s""")
def _status(spark, sf):
    hb = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.lit(43_200_000_000))
    st = tables.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("tier"), F.lit("").alias("halted_reason"), hb.alias("heartbeat_ts"), hb.alias("last_data_ts"))
    return od.engine_status(st, now())


@query("chart_series", with_ctes(TRD) + """, s AS (SELECT *, max(ts) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shown FROM eq)
    SELECT date_trunc('second', ts)::TIMESTAMP AS second, last(equity ORDER BY ts, id) AS equity FROM s WHERE shown IS NULL OR date_trunc('second', ts) >= date_trunc('second', shown) GROUP BY 1""")
def _chart(spark, sf):
    return od.chart_series(tables.equity_snapshots(spark, sf))


@query(
    "promotion_gate",
    with_ctes(TRD) + f""", d AS (SELECT CAST(exit_ts AS DATE) AS d, sum(pnl) AS p FROM ct GROUP BY 1), a AS (SELECT count(*) AS sessions, date_diff('day', min(d), max(d)) AS span, sum(p) AS net, min(p) AS worst, avg(p) FILTER (p > 0) AS aw FROM d),
    s AS (SELECT avg(l_tax) AS re, avg(l_discount) AS mo FROM lineitem), q AS (SELECT quantile_cont(value, 0.95) AS p95 FROM events)
    SELECT sessions, span::INT AS span_days, {r("net", "net", 2)}, {r("worst", "worst", 2)}, sessions >= 20 AND span >= 28 AS enough_sessions, net > 0 AS net_positive, worst >= -2 * aw AS worst_ok, abs(re - mo) <= 0.25 * abs(mo) AS slippage_ok, p95 < 5 AS quotes_ok,
    sessions >= 20 AND span >= 28 AND net > 0 AND worst >= -2 * aw AND abs(re - mo) <= 0.25 * abs(mo) AND p95 < 5 AS promote FROM a, s, q""",
)
def _gate(spark, sf):
    from tapeloom.functions.ordered import exact_quantiles

    slip = tables.table(spark, sf, "lineitem").select(F.col("l_tax").alias("realized"), F.col("l_discount").alias("modelled"))
    age = exact_quantiles(tables.table(spark, sf, "events").select("value"), "value", {"p95": 0.95})
    return rounded(od.promotion_gate(tables.closed_trades(spark, sf), slip, age), 2)


@query("equity_changes", with_ctes(TRD) + "SELECT id, ts, equity FROM eq WHERE id > 5000")
def _changes(spark, sf):
    return od.equity_changes(tables.equity_snapshots(spark, sf).select("id", "ts", "equity"), 5000)


@query("status_changes", "WITH s AS (SELECT o_custkey AS engine, o_orderkey AS seq, o_orderstatus AS status, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders) SELECT * FROM s WHERE status IS DISTINCT FROM previous")
def _status_changes(spark, sf):
    o = tables.table(spark, sf, "orders").select(F.col("o_custkey").alias("engine"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))
    return od.status_changes(o)



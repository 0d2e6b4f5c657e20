"""Daily bars, cross-sectional factors, portfolios and universe screens over the line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.config import MoverCriteria, PortfolioConfig, RunnerCriteria
from tapeloom.operators import daily as dl
from tapeloom.operators import xsec as xs
from tapeloom.queries.base import DAILY, query, r, rcols, rounded, with_ctes
from tapeloom.sources import driver_tables as tables
from tapeloom.sources import files as fs

DCOLS = ["open", "high", "low", "close", "volume"]
NOTIONAL = r("vwap * volume", "notional", 2)


def dollars(df):
    """vwap as exact cents: prices are ratios, so they are compared at eight digits."""
    return df.withColumn("notional", F.col("vwap") * F.col("volume")).drop("vwap")


@query("daily_bars", with_ctes(DAILY) + f"SELECT symbol, date, {rcols(DCOLS, 8)}, {NOTIONAL} FROM daily")
def _daily(spark, sf):
    return rounded(dollars(tables.daily(spark, sf)), 8, notional=2)


CRIT = RunnerCriteria(price_min=0.5, price_max=1e6, min_dollar_vol=5e4)
RUNNER = DAILY + """,
ri AS (SELECT *, lag(close) OVER d AS prev_close, CASE WHEN count(volume) OVER p = 20 THEN quantile_cont(volume, 0.5) OVER p END AS mv FROM daily
  WINDOW d AS (PARTITION BY symbol ORDER BY date), p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
rg AS (SELECT *, close / prev_close - 1 AS gain, open / prev_close - 1 AS gap, volume / nullif(mv, 0) AS relvol, volume * coalesce(vwap, close) AS dollar_vol FROM ri),
runners AS MATERIALIZED (SELECT *, least(dollar_vol, 200e6) * (1 + greatest(least(gain, 3), 0)) AS score FROM rg
  WHERE open BETWEEN 0.5 AND 1e6 AND prev_close BETWEEN 0.5 AND 1e6 AND (gain >= 0.15 OR gap >= 0.10) AND relvol >= 3 AND dollar_vol >= 5e4)
"""


def runners(spark, sf):
    return dl.select_runner_days(tables.daily(spark, sf), CRIT)


@query("runner_days", with_ctes(RUNNER) + f"SELECT symbol, date, {rcols(DCOLS + ['prev_close', 'gain', 'gap', 'relvol'], 8)}, {NOTIONAL}, {r('dollar_vol', 'dollar_vol', 2)}, {r('score', 'score', 2)} FROM runners")
def _runners(spark, sf):
    return rounded(dollars(runners(spark, sf)), 8, dollar_vol=2, score=2, notional=2)


@query("relative_volume_inputs", with_ctes(RUNNER) + f"SELECT symbol, date, {r('prev_close', 'prev_close', 8)}, {r('mv', 'med_volume')} FROM ri")
def _relvol(spark, sf):
    return rounded(dl.relative_volume_inputs(tables.daily(spark, sf)).select("symbol", "date", "prev_close", "med_volume"), prev_close=8)


@query(
    "prior_session_context",
    with_ctes(RUNNER) + f"""SELECT a.symbol, a.date, {r("p.close", "prev_day_close", 8)}, {r("p.volume", "prev_day_volume")}, {r("p.close * p.volume", "prev_day_dollar_vol", 3)}
    FROM runners a ASOF LEFT JOIN daily p ON p.symbol = a.symbol AND a.date > p.date""",
)
def _prior(spark, sf):
    out = dl.prior_session_context(runners(spark, sf).select("symbol", "date"), tables.daily(spark, sf))
    return rounded(out, prev_day_dollar_vol=3, prev_day_close=8)


@query(
    "latest_context",
    with_ctes(DAILY) + f""", k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM daily)
    SELECT symbol, {r("CASE WHEN count(*) = 2 THEN max(open) FILTER (k = 1) END", "open", 8)}, {r("max(close) FILTER (k = 2)", "prev_close", 8)},
    {r("max(volume) FILTER (k = 2)", "prev_day_volume")}, {r("max(close * volume) FILTER (k = 2)", "prev_day_dollar_vol", 3)} FROM k WHERE k <= 2 GROUP BY symbol""",
)
def _latest(spark, sf):
    return rounded(dl.latest_context(tables.daily(spark, sf)), 8, prev_day_dollar_vol=3, prev_day_volume=6)


@query("month_end_dates", with_ctes(DAILY) + "SELECT year(date)::INT AS year, month(date)::INT AS month, max(date) AS date FROM daily GROUP BY 1, 2")
def _month_ends(spark, sf):
    return dl.month_end_dates(tables.daily(spark, sf))


@query("minimum_history", with_ctes(DAILY) + f"SELECT symbol, date, {r('close', 'close', 8)} FROM daily WHERE symbol IN (SELECT symbol FROM daily GROUP BY 1 HAVING count(*) >= 530)")
def _history(spark, sf):
    return rounded(dl.with_min_history(tables.daily(spark, sf), 530).select("symbol", "date", "close"), 8)


@query("daily_panel", """WITH p AS (SELECT 'P' || l_suppkey AS symbol, l_shipdate::DATE AS date, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq, CASE WHEN l_linenumber <> 4 THEN l_extendedprice END AS close, l_quantity AS volume FROM lineitem)
    SELECT symbol, date, last(close ORDER BY seq) FILTER (close IS NOT NULL) AS close, last(volume ORDER BY seq) AS volume FROM p WHERE symbol IN (SELECT symbol FROM p GROUP BY 1 HAVING count(*) >= 600) GROUP BY ALL""")
def _panel(spark, sf):
    """Line items as several prints a day; symbols with fewer than 600 prints are left out."""
    li = tables.table(spark, sf, "lineitem")
    seq = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")
    prints = li.select(
        F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("symbol"), F.to_date("l_shipdate").alias("date"), seq.alias("seq"),
        F.when(F.col("l_linenumber") != 4, F.col("l_extendedprice")).alias("close"), F.col("l_quantity").alias("volume"),
    )
    return dl.daily_panel(prints, 600, ["close", "volume"], "seq")


MOM = DAILY + """,
mu0 AS (SELECT *, lag(close, 20) OVER w AS c20, lag(close, 5) OVER w AS c5, row_number() OVER w AS rn, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k
  FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY date)),
mu AS (SELECT symbol, close AS price, close * volume AS dollar_vol, close / c20 - 1 AS mom_20, close / c5 - 1 AS mom_5,
  0.6 * (close / c20 - 1) + 0.4 * (close / c5 - 1) AS score FROM mu0 WHERE k = 1 AND rn >= 22 AND close >= 8 AND close * volume >= 1e4 AND close / c20 > 1 AND close / c5 > 1)
"""


def mom_universe(spark, sf):
    return dl.momentum_universe(tables.daily(spark, sf), min_dollar_vol=1e4)


@query("momentum_universe", with_ctes(MOM) + f"SELECT symbol, {rcols(['price', 'mom_20', 'mom_5', 'score'], 8)}, {r('dollar_vol', 'dollar_vol', 3)} FROM mu")
def _mom(spark, sf):
    return rounded(mom_universe(spark, sf), 8, dollar_vol=3)


@query(
    "top_candidates",
    with_ctes(MOM) + f"SELECT symbol, {r('score', 'score')} FROM mu WHERE symbol NOT IN (SELECT symbol FROM daily GROUP BY 1 HAVING count(*) % 2 = 0) ORDER BY mu.score DESC, symbol LIMIT 5",
)
def _top(spark, sf):
    held = tables.daily(spark, sf).groupBy("symbol").count().where("count % 2 = 0")
    return rounded(dl.top_candidates(mom_universe(spark, sf), held, 5).select("symbol", "score"))


@query(
    "liquidity_screen",
    with_ctes(DAILY) + f""", p AS (SELECT symbol, quantile_cont(close * volume, 0.5) AS m, last(close ORDER BY date) AS c, count(*) AS n FROM daily GROUP BY 1)
    SELECT symbol, {r("m", "med_dollar_vol", 2)}, {r("c", "last_close")}, n AS sessions FROM p WHERE c >= 3 AND n >= 40 ORDER BY m DESC, symbol LIMIT 25""",
)
def _liq(spark, sf):
    return rounded(dl.screen_by_liquidity(tables.daily(spark, sf), 25), med_dollar_vol=2)


@query("name_screen", """SELECT 'P' || p_partkey AS id, upper(left(p_type, 5)) AS symbol, p_name AS name FROM part
    WHERE regexp_matches(upper(left(p_type, 5)), '^[A-Za-z]{1,5}$') AND NOT regexp_matches(p_name, '(?i)ring|gear|fund|etf')""")
def _names(spark, sf):
    p = tables.table(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.upper(F.substring("p_type", 1, 5)).alias("symbol"), F.col("p_name").alias("name"))
    return dl.screen_names(p, "(?i)ring|gear|fund|etf")


# gainers and actives: latest session of suppliers, renamed to letter tickers
LETTERS = "translate(CAST({n} AS VARCHAR), '0123456789', 'ABCDEFGHIJ')"
MOVERS = DAILY + f""",
ms AS (SELECT {LETTERS.format(n="substr(symbol, 2)")} AS symbol, close AS price, volume, (close / prev - 1) * 100 AS percent_change, CAST(substr(symbol, 2) AS BIGINT) AS n FROM
  (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM daily) WHERE k = 1),
mall AS (SELECT *, 0 AS prio FROM ms WHERE percent_change > 0 UNION ALL SELECT *, 1 FROM ms WHERE volume >= 20),
mok AS (SELECT * FROM mall WHERE regexp_matches(symbol, '^[A-Z]{{1,5}}$') AND price >= 8 AND price * volume >= 1e4 AND (prio = 1 OR abs(percent_change) >= 3) AND n % 7 <> 0)
"""


@query(
    "mover_scan",
    with_ctes(MOVERS) + f"""SELECT symbol, {r("price", "price")}, {r("volume", "volume")}, {r("percent_change", "percent_change")}, {r("sqrt(abs(percent_change) * price * volume)", "score", 4)}
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY prio) AS k FROM mok) WHERE k = 1 ORDER BY sqrt(abs(percent_change) * price * volume) DESC, symbol LIMIT 10""",
)
def _movers(spark, sf):
    d = xs.daily_returns(tables.daily(spark, sf))
    w = dl.Window.partitionBy("symbol").orderBy(F.desc("date"))
    last = d.withColumn("k", F.row_number().over(w)).where("k = 1").select(
        F.translate(F.substring("symbol", 2, 20), "0123456789", "ABCDEFGHIJ").alias("symbol"), F.substring("symbol", 2, 20).cast("long").alias("n"),
        F.col("close").alias("price"), "volume", (F.col("ret") * 100).alias("percent_change"),
    )
    out = dl.scan_movers(last.where("percent_change > 0").drop("n"), last.where("volume >= 20").drop("n"), last.where("n % 7 = 0"), MoverCriteria(min_dollar_volume=1e4))
    return rounded(out, score=4)


@query(
    "pick_next_days",
    with_ctes(RUNNER) + f""", idx AS (SELECT symbol, date, score, open / 10000 AS open FROM runners WHERE NOT day(date) = 1),
    bk AS (SELECT *, CASE WHEN open >= 0.5 AND open < 2 THEN 0 WHEN open >= 2 AND open < 5 THEN 1 WHEN open >= 5 AND open < 10 THEN 2 END AS b FROM idx),
    t AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, symbol, date) AS turn FROM bk WHERE b IS NOT NULL)
    SELECT symbol, date, {r("score", "score", 2)}, ['0.5-2', '2-5', '5-10'][b + 1] AS price_bucket, turn::INT AS turn FROM t ORDER BY turn, b LIMIT 20""",
)
def _pick(spark, sf):
    idx = runners(spark, sf).withColumn("open", F.col("open") / 10000)
    return rounded(dl.pick_next_days(idx, idx.where("day(date) = 1"), 20), score=2)


@query(
    "rotate_universe",
    """WITH live AS (SELECT s_name AS symbol, s_suppkey AS added_at FROM supplier WHERE s_suppkey % 3 <> 0), inc AS (SELECT s_name AS symbol FROM supplier WHERE s_suppkey % 3 = 0),
    n AS (SELECT (SELECT count(*) FROM live) + (SELECT count(*) FROM inc) - 45 AS need),
    ev AS (SELECT symbol FROM live JOIN supplier ON s_name = symbol WHERE s_acctbal < 5000 ORDER BY added_at, symbol LIMIT greatest((SELECT need FROM n), 0))
    SELECT symbol, 'kept' AS state FROM live WHERE symbol NOT IN (SELECT symbol FROM ev) UNION ALL SELECT symbol, 'added' FROM inc""",
)
def _rotate(spark, sf):
    s = tables.table(spark, sf, "supplier").select(F.col("s_name").alias("symbol"), F.col("s_suppkey").alias("added_at"), "s_acctbal")
    return dl.rotate_universe(s.where("added_at % 3 <> 0").drop("s_acctbal"), s.where("s_acctbal >= 5000"), s.where("added_at % 3 = 0"), 45)


# ---------------------------------------------------------------- factors
def fr(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


SW = "OVER (PARTITION BY symbol ORDER BY date)"


def full(agg: str, of: str, n: int, need: int | None = None) -> str:
    return f"CASE WHEN count({of}) {fr(n)} >= {need or n} THEN {agg} {fr(n)} END"


FACT = DAILY + f""",
x0 AS (SELECT *, close / lag(close) {SW} - 1 AS ret, nullif(close * volume, 0) AS dollar FROM daily),
mk AS (SELECT date, round(avg(ret), 6) AS mret FROM x0 GROUP BY 1),
x1 AS (SELECT x0.*, mret FROM x0 LEFT JOIN mk USING (date)),
x2 AS (SELECT *, lag(close, 21) {SW} / lag(close, 252) {SW} - 1 AS mom_12_1, lag(close, 21) {SW} / lag(close, 126) {SW} - 1 AS mom_6_1,
  lag(close, 21) {SW} / lag(close, 63) {SW} - 1 AS mom_3_1, close / lag(close, 21) {SW} - 1 AS rev_1m, close / lag(close, 5) {SW} - 1 AS rev_5d,
  {full("stddev_samp(ret)", "ret", 63)} AS vol_3m, {full("stddev_samp(ret)", "ret", 252)} AS vol_12m, {full("skewness(ret)", "ret", 63)} AS skew_3m,
  {full("max(ret)", "ret", 21)} AS max_ret_1m, {full("avg(abs(ret) / dollar)", "abs(ret) / dollar", 63, 40)} AS amihud_3m,
  {full("avg(coalesce((ret > 0)::INT, 0))", "1", 126)} AS up_frac_6m, close / ({full("max(close)", "close", 252)}) - 1 AS dist_52w_high,
  ln({full("avg(dollar)", "dollar", 63)}) AS dollar_vol, lead(close, 21) {SW} / close - 1 AS fwd_ret,
  ({full("covar_samp(ret, mret)", "ret + mret", 252)}) / ({full("var_samp(CASE WHEN ret IS NOT NULL THEN mret END)", "ret + mret", 252)}) AS beta_12m FROM x1),
x3 AS (SELECT *, ret - beta_12m * mret AS res FROM x2),
fac AS MATERIALIZED (SELECT *, {full("stddev_samp(res)", "res", 63)} AS idio_vol_3m FROM x3)
"""
NAMES = xs.FACTORS + xs.MARKET_FACTORS


def panel(spark, sf):
    """Daily closes, volumes and returns, made once and stored: the market, the factors, the calendar and the prices read them."""
    path = fs.scratch_path(spark, "panel")
    xs.daily_returns(tables.daily(spark, sf).select("symbol", "date", "close", "volume")).write.parquet(path)
    return spark.read.parquet(path)


def market(daily):
    return daily.groupBy("date").agg(F.round(F.avg("ret"), 6).alias("mret"))


def factor_table(spark, sf):
    daily = panel(spark, sf)
    return xs.factors(daily, market(daily))


@query("factors", with_ctes(FACT) + f"SELECT symbol, date, {rcols([n for n in NAMES if n != 'amihud_3m'] + ['fwd_ret'], 4)}, {r('amihud_3m', 'amihud_3m', 9)} FROM fac")
def _factors(spark, sf):
    return rounded(factor_table(spark, sf), 4, amihud_3m=9)


@query("market_returns", with_ctes(FACT) + f", m AS (SELECT date, avg(close) AS close FROM daily GROUP BY 1) SELECT date, {r('close / lag(close) OVER (ORDER BY date) - 1', 'mret')} FROM m")
def _market(spark, sf):
    return rounded(xs.market_returns(tables.daily(spark, sf).groupBy("date").agg(F.avg("close").alias("close"))))


def pct(c: str, table: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY date, {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY date) END"


CROSS = NAMES


@query("cross_ranks", with_ctes(FACT) + f"SELECT symbol, date, {', '.join(r(pct(c, 'fac'), c) for c in CROSS)} FROM fac")
def _cross(spark, sf):
    f = factor_table(spark, sf).select("symbol", "date", *CROSS)
    return rounded(xs.cross_ranks(f, CROSS))


DATASET = FACT + f""",
me AS (SELECT max(date) AS date FROM daily GROUP BY year(date), month(date)),
el0 AS (SELECT fac.*, row_number() OVER (PARTITION BY date ORDER BY dollar_vol DESC, symbol) AS k FROM fac JOIN me USING (date) WHERE {" AND ".join(f"{n} IS NOT NULL" for n in NAMES)}),
el AS (SELECT *, fwd_ret AS y_rank FROM el0 WHERE k <= 12),
ds AS MATERIALIZED (SELECT symbol, date, fwd_ret, {", ".join(pct(n, "el") + f" AS {n}" for n in NAMES + ["y_rank"])} FROM el),
scores AS MATERIALIZED (SELECT date, symbol, mom_12_1 AS score, fwd_ret FROM ds)
"""


def dataset(daily, eligible_top=12):
    ends = dl.month_end_dates(daily).select("date")
    return xs.rebalance_dataset(xs.factors(daily, market(daily), ends), ends, NAMES, eligible_top)


def scores(daily):
    return dataset(daily).select("date", "symbol", F.col("mom_12_1").alias("score"), "fwd_ret")


@query("rebalance_dataset", with_ctes(DATASET) + f"SELECT symbol, date, {rcols(NAMES + ['fwd_ret', 'y_rank'])} FROM ds")
def _dataset(spark, sf):
    return rounded(dataset(panel(spark, sf)))


@query(
    "information_coefficient",
    with_ctes(DATASET) + f""", s AS (SELECT * FROM scores WHERE fwd_ret IS NOT NULL),
    rk AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0 AS a,
      rank() OVER (PARTITION BY date ORDER BY fwd_ret) + (count(*) OVER (PARTITION BY date, fwd_ret) - 1) / 2.0 AS b FROM s),
    p AS (SELECT date, corr(a, b) AS ic FROM rk GROUP BY date HAVING count(*) >= 5)
    SELECT {r("avg(ic)", "ic_mean")}, {r("avg(ic) / stddev_pop(ic) * sqrt(count(ic))", "ic_tstat")}, {r("avg((ic > 0)::INT)", "ic_hit")}, count(ic) AS n_dates FROM p""",
)
def _ic(spark, sf):
    return rounded(xs.information_coefficient(scores(panel(spark, sf)), 5))


PAIRS = "pairs AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS m, l_extendedprice AS e, round(l_discount * l_quantity, 4) AS predicted, CASE WHEN l_linenumber = 7 THEN NULL ELSE round(l_extendedprice * (l_discount - l_tax), 2) END AS realized FROM lineitem)"


def pairs(spark, sf):
    li = tables.table(spark, sf, "lineitem")
    real = F.when(F.col("l_linenumber") != 7, F.round(F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax")), 2))
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("m"), F.col("l_extendedprice").alias("e"), F.round(F.col("l_discount") * F.col("l_quantity"), 4).alias("predicted"), real.alias("realized"))


@query(
    "rank_ic",
    with_ctes(PAIRS) + f""", ok AS (SELECT * FROM pairs WHERE realized IS NOT NULL), rk AS (SELECT rank() OVER (ORDER BY predicted) + (count(*) OVER (PARTITION BY predicted) - 1) / 2.0 AS a,
    rank() OVER (ORDER BY realized) + (count(*) OVER (PARTITION BY realized) - 1) / 2.0 AS b FROM ok) SELECT {r("corr(a, b)", "rank_ic")}, count(*) AS n FROM rk""",
)
def _rank_ic(spark, sf):
    return rounded(xs.rank_ic(pairs(spark, sf)))


@query(
    "decile_table",
    with_ctes(PAIRS) + f""", ok AS (SELECT *, row_number() OVER (ORDER BY predicted, k, n, m, e) AS rk, count(*) OVER () AS tot FROM pairs WHERE realized IS NOT NULL)
    SELECT greatest(ceil((rk - 1) * 10 / (tot - 1)) - 1, 0)::INT AS decile, count(*) AS n, {r("avg(realized)", "mean_realized_pnl", 4)}, {r("quantile_cont(realized, 0.5)", "median_realized_pnl", 4)} FROM ok GROUP BY 1""",
)
def _deciles(spark, sf):
    return rounded(xs.decile_table(pairs(spark, sf), "predicted", "realized", ["k", "n", "m", "e"]), 4)


# ---------------------------------------------------------------- portfolio
PORT = DATASET + """,
hold AS MATERIALIZED (SELECT date, symbol, score, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM
  (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS k FROM scores) WHERE k <= 4),
rb AS (SELECT DISTINCT date AS period FROM scores),
cal AS (SELECT a.date, b.period FROM (SELECT DISTINCT date FROM daily) a ASOF JOIN rb b ON a.date > b.period),
gr AS (SELECT h.date AS period, h.symbol, c.date, h.weight, bs.close AS base FROM hold h JOIN cal c ON c.period = h.date JOIN daily bs ON bs.symbol = h.symbol AND bs.date = h.date),
wl AS MATERIALIZED (SELECT g.period, g.symbol, g.date, g.weight, p.close / g.base AS wealth FROM gr g ASOF JOIN daily p ON p.symbol = g.symbol AND g.date >= p.date),
lastw AS (SELECT period, symbol, last(wealth ORDER BY date) AS w FROM wl GROUP BY ALL),
dr AS (SELECT nx.nextp AS period, l.symbol, l.w / sum(l.w) OVER (PARTITION BY l.period) AS d FROM lastw l JOIN (SELECT period, lead(period) OVER (ORDER BY period) AS nextp FROM rb) nx USING (period)),
tn AS (SELECT coalesce(h.date, d.period) AS period, sum(abs(coalesce(h.weight, 0) - coalesce(d.d, 0))) AS turnover FROM hold h FULL OUTER JOIN (SELECT * FROM dr WHERE period IS NOT NULL) d
  ON d.period = h.date AND d.symbol = h.symbol GROUP BY 1),
pw AS (SELECT period, date, avg(wealth) AS pw FROM wl GROUP BY ALL),
port AS MATERIALIZED (SELECT date, p.period, pw / coalesce(lag(pw) OVER w, 1.0) - 1 AS gross, pw / coalesce(lag(pw) OVER w, 1.0) - 1 - CASE WHEN row_number() OVER w = 1 THEN turnover * 10 / 1e4 ELSE 0 END AS net, turnover
  FROM pw p JOIN tn USING (period) WINDOW w AS (PARTITION BY p.period ORDER BY date))
"""


def portfolio(spark, sf):
    daily = panel(spark, sf)
    return xs.run_portfolio(scores(daily), daily, PortfolioConfig(top_n=4, cost_bps=10.0))


@query("top_holdings", with_ctes(PORT) + f"SELECT date, symbol, {r('score', 'score')}, {r('weight', 'weight')} FROM hold")
def _holdings(spark, sf):
    return rounded(xs.top_holdings(scores(panel(spark, sf)), 4))


@query("monthly_portfolio", with_ctes(PORT) + f"SELECT date, period, {rcols(['net', 'gross', 'turnover'], 5)} FROM port")
def _portfolio(spark, sf):
    return rounded(portfolio(spark, sf), 5)


VOLM = """, v0 AS (SELECT *, CASE WHEN count(net) OVER f >= 21 THEN least(0.2 / nullif(stddev_samp(net) OVER f * sqrt(252), 0), 1) END AS s FROM port WINDOW f AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
vm AS (SELECT date, net, coalesce(lag(s) OVER (ORDER BY date), 1.0) AS scale, net * coalesce(lag(s) OVER (ORDER BY date), 1.0) AS managed FROM v0)"""


@query("vol_managed_returns", with_ctes(PORT) + VOLM + f"SELECT date, {rcols(['scale', 'managed'], 5)} FROM vm")
def _vol_managed(spark, sf):
    return rounded(xs.vol_managed(portfolio(spark, sf).select("date", "net"), window=21).select("date", "scale", "managed"), 5)


def series(spark, sf):
    p = portfolio(spark, sf)
    return p.select("date", F.explode(F.array(F.struct(F.lit("net").alias("series"), F.col("net").alias("ret")), F.struct(F.lit("gross").alias("series"), F.col("gross").alias("ret")))).alias("s")).select("date", "s.series", "s.ret")


SERIES = """, sr AS (SELECT date, 'net' AS series, net AS ret FROM port UNION ALL SELECT date, 'gross', gross FROM port),
wd AS (SELECT *, exp(sum(ln(1 + ret)) OVER w) AS wealth FROM sr WINDOW w AS (PARTITION BY series ORDER BY date)),
dd AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY series ORDER BY date) - 1 AS drawdown FROM wd)"""


@query("wealth_and_drawdown", with_ctes(PORT) + SERIES + f"SELECT date, series, {rcols(['ret', 'drawdown'], 4)}, {r('ln(wealth)', 'log_wealth', 5)} FROM dd")
def _wealth(spark, sf):
    df = xs.with_wealth(series(spark, sf), "ret", ["series"])
    return rounded(df.withColumn("log_wealth", F.ln("wealth")).drop("wealth"), 4, log_wealth=5)


@query(
    "return_summary",
    with_ctes(PORT) + SERIES + f""", j AS (SELECT dd.*, ret - coalesce(mk.mret, 0) AS a FROM dd LEFT JOIN mk USING (date))
    SELECT series, {r("power(last(wealth ORDER BY date), 252.0 / count(*)) - 1", "cagr", 4)}, {r("stddev_samp(ret) * sqrt(252)", "vol", 4)}, {r("avg(ret) / stddev_samp(ret) * sqrt(252)", "sharpe", 4)},
    {r("min(drawdown)", "max_dd", 4)}, {r("count(*) / 252.0", "years")}, {r("avg(a) * 252", "ann_active", 4)}, {r("avg(a) / stddev_samp(a) * sqrt(252)", "ir", 4)} FROM j GROUP BY series""",
)
def _summary(spark, sf):
    out = xs.summarize_returns(series(spark, sf), "ret", ["series"], market(panel(spark, sf)).withColumnRenamed("mret", "bench"))
    return rounded(out, 4, years=6)


@query("returns_per_year", with_ctes(PORT) + SERIES + f"SELECT series, year(date)::INT AS year, {r('exp(sum(ln(1 + ret))) - 1', 'ret', 4)} FROM sr GROUP BY ALL")
def _per_year(spark, sf):
    return rounded(xs.returns_per_year(series(spark, sf), "ret", ["series"]), 4)

"""Order-book operators over book-shaped events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.config import BookBacktestConfig, LabelConfig
from tapeloom.operators import book as bk
from tapeloom.operators import labels as lb
from tapeloom.queries.base import EVENTS, query, r, rcols, rounded, with_ctes
from tapeloom.sources import driver_tables as tables

KO = "symbol, session_date, ts, seq"
BOOK = EVENTS + """,
bk0 AS (SELECT *, CAST(ts - INTERVAL 5 HOUR AS DATE) AS session_date, round(px - 0.01 * (1 + k % 5), 4) AS b0 FROM ev),
bk AS MATERIALIZED (SELECT symbol, session_date, ts, seq, k, b0, CASE WHEN event_type = 'error' THEN round(b0 - 0.02, 4)
  WHEN event_type = 'signup' AND k % 25 = 0 THEN round(px + 4.0, 4) ELSE round(px + 0.01 * (1 + k % 3), 4) END AS a0,
  CASE WHEN event_type = 'purchase' THEN k + 1.0 ELSE 0.0 END::DOUBLE AS buy_flow, CASE WHEN event_type = 'click' THEN k + 1.0 ELSE 0.0 END::DOUBLE AS sell_flow FROM bk0)
"""
LEVELS = BOOK + """,
lv AS (SELECT symbol, session_date, ts, seq, i AS level, round(a0 + 0.01 * i, 4) AS ask_p, (1 + (k + i) % 11)::DOUBLE AS ask_v, round(b0 - 0.01 * i, 4) AS bid_p,
  (1 + (k + 2 * i) % 7)::DOUBLE AS bid_v, (a0 + b0) / 2.0 AS mid, a0, b0, k FROM bk, (SELECT unnest(range(10)) AS i))
"""


def flat_levels(df, col="levels"):
    # a plain posexplode makes Spark filter on the array's size, with the array's whole expression repeated inside that filter
    rows = df.select("symbol", "session_date", "ts", "seq", F.posexplode_outer(col).alias("level", "x")).where("level is not null")
    return rows.select("symbol", "session_date", "ts", "seq", F.col("level").cast("long").alias("level"), "x.*")


@query("book_shape", with_ctes(LEVELS) + f"SELECT {KO}, level, {r('ask_p - mid', 'ask_p')}, ask_v, {r('bid_p - mid', 'bid_p')}, bid_v FROM lv")
def _shape(spark, sf):
    return rounded(flat_levels(bk.book_features(tables.books(spark, sf), "raw40"), "shape"))


BW = "PARTITION BY symbol, session_date ORDER BY ts, seq"


def depth(k: int) -> str:
    b, a = f"sum(bid_v) FILTER (level < {k})", f"sum(ask_v) FILTER (level < {k})"
    return r(f"({b} - {a}) / ({b} + {a} + 1e-12)", f"cum_imb_{k}")


@query(
    "book_features",
    with_ctes(LEVELS) + f""", st AS (SELECT {KO}, {r("max((bid_v - ask_v) / (bid_v + ask_v + 1e-12)) FILTER (level = 0)", "imb_1")},
      {r("max((bid_v - ask_v) / (bid_v + ask_v + 1e-12)) FILTER (level = 9)", "imb_10")}, {", ".join(depth(k) for k in (1, 3, 5, 10))} FROM lv GROUP BY ALL),
    d0 AS (SELECT {KO}, a0, b0, (1 + k % 11)::DOUBLE AS av, (1 + k % 7)::DOUBLE AS bv, (a0 + b0) / 2.0 AS mid, buy_flow - sell_flow AS sg FROM bk),
    d1 AS (SELECT *, coalesce(mid - lag(mid) OVER w, 0) AS m1, coalesce(mid - lag(mid, 10) OVER w, 0) AS m10, coalesce(
      (CASE WHEN b0 - lag(b0) OVER w > 0 THEN bv WHEN b0 - lag(b0) OVER w < 0 THEN -lag(bv) OVER w ELSE bv - lag(bv) OVER w END)
      - (CASE WHEN a0 - lag(a0) OVER w < 0 THEN av WHEN a0 - lag(a0) OVER w > 0 THEN -lag(av) OVER w ELSE av - lag(av) OVER w END), 0) AS ofi FROM d0 WINDOW w AS ({BW})),
    d2 AS (SELECT {KO}, {r("a0 - b0", "spread")}, {r("(a0 * bv + b0 * av) / (bv + av + 1e-12) - mid", "microprice_dev")}, {r("m1", "mid_ret_1")}, {r("m10", "mid_ret_10")}, {r("ofi", "ofi")},
      {r("sg", "signed_flow")}, {r(f"sum(sg) OVER ({BW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "signed_flow_20")},
      {r(f"stddev_pop(m1) OVER ({BW} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)", "rv_50")} FROM d1)
    SELECT * FROM st JOIN d2 USING ({KO})""",
)
def _features(spark, sf):
    df = bk.book_features(tables.books(spark, sf), chunk_rows=60)
    df = df.withColumn("imb_1", F.col("imbalance")[0]).withColumn("imb_10", F.col("imbalance")[9]).drop("imbalance", "shape")
    return rounded(df)


@query("flow_toxicity", with_ctes(BOOK) + f"""SELECT {KO}, {r(f"abs(sum(buy_flow - sell_flow) OVER f) / greatest(sum(buy_flow + sell_flow) OVER f, 1e-9)", "toxicity")} FROM bk
    WINDOW f AS ({BW} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")
def _tox(spark, sf):
    return rounded(bk.toxicity(tables.books(spark, sf), chunk_rows=60).select("symbol", "session_date", "ts", "seq", "toxicity"))


FLAG = BOOK + """,
md AS (SELECT coalesce(quantile_cont(a0 - b0, 0.5) FILTER (a0 - b0 > 0), 1.0) AS m FROM bk),
fg AS MATERIALIZED (SELECT bk.*, m, b0 >= a0 AS crossed, (a0 <= 0 OR b0 <= 0) AS nonpositive, a0 - b0 > m * 50 AS wide, (b0 >= a0 OR a0 <= 0 OR b0 <= 0 OR a0 - b0 > m * 50) AS bad FROM bk, md)
"""


@query("book_cleaning_report", with_ctes(FLAG) + f"""SELECT count(*) AS n_total, count(*) FILTER (crossed) AS n_crossed, count(*) FILTER (nonpositive) AS n_nonpositive,
    count(*) FILTER (wide) AS n_wide_spread, count(*) FILTER (bad) AS n_bad, {r("max(m)", "median_spread")} FROM fg""")
def _report(spark, sf):
    return rounded(bk.cleaning_report(bk.flag_snapshots(tables.books(spark, sf))))


@query("book_drop_bad", with_ctes(FLAG) + f"SELECT {KO}, a0 AS ask, b0 AS bid FROM fg WHERE NOT bad")
def _drop(spark, sf):
    df = bk.clean_snapshots(tables.books(spark, sf), drop=True)
    return df.select("symbol", "session_date", "ts", "seq", bk.best("ask", "p").alias("ask"), bk.best("bid", "p").alias("bid"))


@query(
    "book_repair_bad",
    with_ctes(FLAG) + f""", rp AS (SELECT *, last_value(CASE WHEN NOT bad THEN a0 END IGNORE NULLS) OVER w AS la, last_value(CASE WHEN NOT bad THEN b0 END IGNORE NULLS) OVER w AS lb,
      first_value(CASE WHEN NOT bad THEN a0 END IGNORE NULLS) OVER v AS fa, first_value(CASE WHEN NOT bad THEN b0 END IGNORE NULLS) OVER v AS fb FROM fg
      WINDOW w AS ({BW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS ({BW} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT {KO}, coalesce(la, fa, a0) AS ask, coalesce(lb, fb, b0) AS bid, buy_flow FROM rp""",
)
def _repair(spark, sf):
    df = bk.clean_snapshots(tables.books(spark, sf))
    return df.select("symbol", "session_date", "ts", "seq", bk.best("ask", "p").alias("ask"), bk.best("bid", "p").alias("bid"), "buy_flow")


LABEL = BOOK + f""",
mids AS (SELECT *, (a0 + b0) / 2.0 AS mid FROM bk),
fm AS (SELECT *, CASE WHEN count(mid) OVER f = 5 THEN avg(mid) OVER f END AS mp, CASE WHEN count(mid) OVER p = 5 THEN avg(mid) OVER p END AS mm FROM mids
  WINDOW f AS ({BW} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), p AS ({BW} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
dl AS MATERIALIZED (SELECT *, (mp - mid) / mid AS mv, CASE WHEN (mp - mid) / mid > 0.05 THEN 2 WHEN (mp - mid) / mid < -0.05 THEN 0 WHEN mp IS NOT NULL THEN 1 END AS label FROM fm)
"""
LCFG = LabelConfig(horizon=5, alpha=0.05)


def directed(spark, sf):
    df = bk.with_mid(tables.books(spark, sf))
    df = df.withColumn("bid", bk.best("bid", "p")).withColumn("ask", bk.best("ask", "p")).drop("levels")
    return lb.direction_labels(df, LCFG, chunk_rows=50)


@query("direction_labels", with_ctes(LABEL) + f"SELECT {KO}, label::INT AS label, mv IS NOT NULL AS label_valid, {r('mv', 'move')} FROM dl")
def _direction(spark, sf):
    return rounded(directed(spark, sf).select("symbol", "session_date", "ts", "seq", "label", "label_valid", "move"))


@query("direction_labels_vs_past", with_ctes(LABEL) + f"SELECT {KO}, {r('(mp - mm) / mm', 'move')} FROM dl")
def _direction_past(spark, sf):
    df = bk.with_mid(tables.books(spark, sf)).drop("levels")
    return rounded(lb.forward_moves(df, 5, "vs_past", bk.KEY, bk.ORDER, chunk_rows=50).select("symbol", "session_date", "ts", "seq", "move"))


@query("class_distribution", with_ctes(LABEL) + f"""SELECT {r("count(*) FILTER (label = 0) / count(label)", "down")}, {r("count(*) FILTER (label = 1) / count(label)", "flat")},
    {r("count(*) FILTER (label = 2) / count(label)", "up")}, count(label) AS n_valid FROM dl""")
def _dist(spark, sf):
    return rounded(lb.class_distribution(directed(spark, sf)))


@query("class_weights", with_ctes(LABEL) + f""", c AS (SELECT label, count(*)::DOUBLE AS n FROM dl WHERE label IS NOT NULL GROUP BY 1), w AS (SELECT label, (SELECT sum(n) FROM c) / (3 * n) AS w FROM c)
    SELECT label::INT AS label, {r("w / (SELECT avg(w) FROM w)", "weight")} FROM w""")
def _weights(spark, sf):
    return rounded(lb.class_weights(directed(spark, sf)))


@query("balanced_row_weights", with_ctes(LABEL) + f""", c AS (SELECT label, count(*) AS n FROM dl WHERE label IS NOT NULL GROUP BY 1)
    SELECT {KO}, label::INT AS label, {r("(SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * c.n) * (1 + dl.seq % 3)", "weight")} FROM dl JOIN c USING (label)""")
def _row_weights(spark, sf):
    df = directed(spark, sf).where("label_valid").select("symbol", "session_date", "ts", "seq", "label")
    return rounded(lb.balanced_weights(df, quality=1 + F.col("seq") % 3))


@query("suggest_alpha", with_ctes(LABEL) + f"SELECT {r('quantile_cont(abs(mv), 0.4)', 'alpha', 8)} FROM dl WHERE mv IS NOT NULL")
def _alpha(spark, sf):
    return rounded(lb.suggest_alpha(bk.with_mid(tables.books(spark, sf)).drop("levels"), 5), 8)


@query("cost_aware_alpha", with_ctes(LABEL) + f""", q AS (SELECT quantile_cont(mid, 0.5) AS m, quantile_cont(a0 - b0, 0.5) AS s FROM mids)
    SELECT {r("m", "mid_px")}, {r("s", "spread_px")}, {r("s + 2 * 0.8e-4 * m", "round_trip_cost")}, {r("2 * (s + 2 * 0.8e-4 * m) / m", "alpha", 8)} FROM q""")
def _cost_alpha(spark, sf):
    df = bk.with_mid(tables.books(spark, sf)).withColumn("spread", bk.best("ask", "p") - bk.best("bid", "p"))
    return rounded(bk.cost_aware_alpha(df, 2.0), alpha=8)


PRED = "((seq * 7919) % 7) % 3"


@query("confusion_matrix", with_ctes(LABEL) + f"SELECT label::INT AS label, ({PRED})::INT AS pred, count(*) AS n FROM dl WHERE label IS NOT NULL GROUP BY ALL")
def _cm(spark, sf):
    df = directed(spark, sf).where("label_valid").withColumn("pred", F.expr(PRED).cast("int"))
    return lb.confusion_matrix(df)


def per_class(c: int, name: str) -> str:
    p = f"(count(*) FILTER (label = {c} AND pred = {c}) / nullif(count(*) FILTER (pred = {c}), 0))"
    q = f"(count(*) FILTER (label = {c} AND pred = {c}) / nullif(count(*) FILTER (label = {c}), 0))"
    return f"SELECT '{name}' AS class, coalesce({p}, 0) AS p, coalesce({q}, 0) AS q, count(*) FILTER (label = {c}) AS support FROM pr"


@query(
    "classification_report",
    with_ctes(LABEL) + f""", pr AS (SELECT label, {PRED} AS pred FROM dl WHERE label IS NOT NULL),
    pc AS ({" UNION ALL ".join(per_class(c, n) for c, n in enumerate(("down", "flat", "up")))}), f AS (SELECT *, coalesce(2 * p * q / nullif(p + q, 0), 0) AS f1 FROM pc)
    SELECT class, {r("p", "precision", 4)}, {r("q", "recall", 4)}, {r("f1", "f1", 4)}, support, {r("(SELECT avg((label = pred)::INT) FROM pr)", "accuracy", 4)}, {r("(SELECT avg(f1) FROM f)", "macro_f1", 4)} FROM f""",
)
def _class_report(spark, sf):
    df = directed(spark, sf).where("label_valid").withColumn("pred", F.expr(PRED).cast("int"))
    return rounded(lb.classification_report(df), 4)


BT = BookBacktestConfig(toxicity_window=10)
BACK = BOOK + f""",
pb AS (SELECT *, ((seq * 7919) % 101) / 100.0 AS p_up, 1 - ((seq * 7919) % 101) / 100.0 AS p_down, row_number() OVER ({BW}) AS rn,
  abs(sum(buy_flow - sell_flow) OVER f) / greatest(sum(buy_flow + sell_flow) OVER f, 1e-9) AS tox FROM bk WINDOW f AS ({BW} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
w0 AS (SELECT *, CASE WHEN p_up > 0.55 THEN 1 WHEN p_down > 0.55 THEN -1 ELSE 0 END AS want FROM pb),
w1 AS (SELECT *, CASE WHEN coalesce(lag(want) OVER ({BW}) <> want, true) THEN rn END AS ch, CASE WHEN tox <= 0.8 THEN rn END AS ok FROM w0),
w2 AS (SELECT *, CASE WHEN max(ok) OVER ({BW}) >= max(ch) OVER ({BW}) THEN want ELSE 0 END AS pos FROM w1),
w3 AS (SELECT *, coalesce(lag(pos) OVER ({BW}), 0) AS prev FROM w2),
w4 AS (SELECT *, CASE WHEN pos <> prev AND prev <> 0 THEN CASE WHEN prev > 0 THEN b0 ELSE a0 END END AS xpx, CASE WHEN pos <> prev AND pos <> 0 THEN CASE WHEN pos > 0 THEN a0 ELSE b0 END END AS epx FROM w3),
w5 AS (SELECT *, sum(coalesce(prev * xpx, 0) - coalesce(pos * epx, 0)) OVER ({BW}) AS gc, sum((coalesce(xpx, 0) + coalesce(epx, 0)) * 0.8e-4) OVER ({BW}) AS cc,
  prev * (xpx - last_value(epx IGNORE NULLS) OVER ({BW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS tp FROM w4),
w6 AS (SELECT *, gc + pos * (a0 + b0) / 2.0 AS gross_pnl, gc - cc + pos * (a0 + b0) / 2.0 AS net_pnl FROM w5),
w7 AS MATERIALIZED (SELECT *, net_pnl - coalesce(lag(net_pnl) OVER ({BW}), 0) AS ret, max(net_pnl) OVER ({BW}) AS peak FROM w6)
"""


def with_probs(spark, sf):
    df = tables.books(spark, sf).withColumn("bid", bk.best("bid", "p")).withColumn("ask", bk.best("ask", "p")).drop("levels")
    p = F.expr("(seq * 7919) % 101") / 100.0
    return df.withColumn("p_up", p).withColumn("p_down", 1 - p)


@query("book_positions", with_ctes(BACK) + f"SELECT {KO}, pos::INT AS position, want <> 0 AND pos = 0 AS suppressed, {rcols(['gross_pnl', 'net_pnl', 'ret', 'peak'], 5)}, {r('tp', 'trade_pnl', 5)} FROM w7")
def _positions(spark, sf):
    df = bk.book_positions(with_probs(spark, sf), BT, chunk_rows=50)
    return rounded(df.select("symbol", "session_date", "ts", "seq", "position", "suppressed", "gross_pnl", "net_pnl", "ret", "peak", "trade_pnl"), 5)


@query(
    "book_backtest",
    with_ctes(BACK) + f"""SELECT symbol, session_date, {r("last(net_pnl ORDER BY rn)", "final_net_pnl", 5)}, {r("last(gross_pnl ORDER BY rn)", "final_gross_pnl", 5)}, count(xpx) + count(epx) AS n_trades,
    count(tp) AS round_trips, {r("coalesce(avg((tp > 0)::INT), 0)", "hit_rate", 4)}, {r("last(cc ORDER BY rn)", "total_costs", 2)},
    {r("CASE WHEN stddev_pop(ret) > 1e-12 THEN avg(ret) / stddev_pop(ret) * sqrt(252 * 6.5 * 3600) ELSE 0 END", "sharpe", 2)}, {r("max(peak - net_pnl)", "max_drawdown", 2)},
    count(*) FILTER (want <> 0 AND pos = 0) AS suppressed_entries, {r("avg((pos <> 0)::INT)", "time_in_market", 4)} FROM w7 GROUP BY ALL""",
)
def _backtest(spark, sf):
    return rounded(bk.book_backtest(with_probs(spark, sf), BT, chunk_rows=50), 5)


@query("frictionless_pnl", with_ctes(LABEL) + f""", g AS (SELECT *, CASE label WHEN 2 THEN 1 WHEN 0 THEN -1 ELSE 0 END * coalesce(lead(mid) OVER ({BW}) - mid, 0) AS g FROM dl)
    SELECT symbol, session_date, {r("sum(g)", "frictionless_pnl")} FROM g GROUP BY ALL""")
def _frictionless(spark, sf):
    return rounded(bk.frictionless_pnl(directed(spark, sf).drop("row_index"), chunk_rows=50))


@query("oracle_probabilities", with_ctes(LABEL) + f"""SELECT {KO}, {r("CASE label WHEN 0 THEN 1 WHEN 2 THEN 0 ELSE 1 / 3.0 END", "p_down")}, {r("CASE WHEN label IN (0, 2) THEN 0 ELSE 1 / 3.0 END", "p_flat")},
    {r("CASE label WHEN 2 THEN 1 WHEN 0 THEN 0 ELSE 1 / 3.0 END", "p_up")} FROM dl WHERE label IS NOT NULL""")
def _probs(spark, sf):
    df = directed(spark, sf).where("label_valid")
    return rounded(df.select("symbol", "session_date", "ts", "seq", *bk.oracle_probabilities()))


def sweep_ctes(k: int) -> str:
    """Labels at one horizon, what trading them at the touch nets, and what they would give without costs."""
    return f"""
f{k} AS (SELECT *, CASE WHEN count(mid) OVER w = {k} THEN avg(mid) OVER w END AS mp, lead(mid) OVER ({BW}) - mid AS step FROM mids WINDOW w AS ({BW} ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)),
l{k} AS MATERIALIZED (SELECT *, CASE WHEN (mp - mid) / mid > alpha THEN 1 WHEN (mp - mid) / mid < -alpha THEN -1 WHEN mp IS NOT NULL THEN 0 END AS pos FROM f{k}, al),
p{k} AS (SELECT *, coalesce(lag(pos) OVER ({BW}), 0) AS prev, row_number() OVER ({BW}) AS rn FROM l{k} WHERE pos IS NOT NULL),
x{k} AS (SELECT *, CASE WHEN pos <> prev AND prev <> 0 THEN CASE WHEN prev > 0 THEN b0 ELSE a0 END END AS xpx, CASE WHEN pos <> prev AND pos <> 0 THEN CASE WHEN pos > 0 THEN a0 ELSE b0 END END AS epx FROM p{k}),
e{k} AS (SELECT count(xpx) + count(epx) AS n, sum(coalesce(prev * xpx, 0) - coalesce(pos * epx, 0) - (coalesce(xpx, 0) + coalesce(epx, 0)) * 0.8e-4) + last(pos * (a0 + b0) / 2.0 ORDER BY rn) AS net FROM x{k} GROUP BY symbol, session_date)"""


def sweep_row(k: int) -> str:
    return f"""SELECT {r(f"(SELECT count(*) FILTER (pos = -1) / count(pos) FROM l{k})", "down", 5)}, {r(f"(SELECT count(*) FILTER (pos = 0) / count(pos) FROM l{k})", "flat", 5)}, {r(f"(SELECT count(*) FILTER (pos = 1) / count(pos) FROM l{k})", "up", 5)},
    (SELECT count(pos) FROM l{k}) AS n_valid, (SELECT sum(n) FROM e{k})::BIGINT AS n_trades, {r(f"(SELECT sum(net) FROM e{k})", "cross_net", 5)}, {r(f"(SELECT sum(pos * coalesce(step, 0)) FROM l{k})", "frictionless", 5)}, {k} AS horizon"""


SWEEP = LABEL + ", q AS (SELECT quantile_cont(mid, 0.5) AS m, quantile_cont(a0 - b0, 0.5) AS s FROM mids), al AS (SELECT (s + 2 * 0.8e-4 * m) / m AS alpha FROM q)"


@query("horizon_sweep", with_ctes(SWEEP, sweep_ctes(3), sweep_ctes(8)) + sweep_row(3) + " UNION ALL " + sweep_row(8))
def _sweep(spark, sf):
    return rounded(bk.horizon_sweep(tables.books(spark, sf), (3, 8)), 5)


@query("standardizer", with_ctes(BOOK) + f"""SELECT {KO}, {r("(buy_flow - (SELECT avg(buy_flow) FROM bk WHERE day(session_date) <= 20)) / (SELECT stddev_pop(buy_flow) FROM bk WHERE day(session_date) <= 20)", "buy_flow", 3)} FROM bk""")
def _standard(spark, sf):
    df = tables.books(spark, sf).select("symbol", "session_date", "ts", "seq", "buy_flow")
    stats = bk.standardizer(df.where("day(session_date) <= 20"), ["buy_flow"])
    return rounded(bk.standardize(df, stats, ["buy_flow"]), 3)

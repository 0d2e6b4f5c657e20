"""Training, scoring and ranking jobs. Model outputs have no SQL oracle; their inputs do."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from tapeloom.config import FillConfig, PortfolioConfig, SplitConfig, TrainConfig
from tapeloom.operators import bar_features as bf
from tapeloom.operators import scan
from tapeloom.operators import xsec as xs
from tapeloom.operators.bars import KEY
from tapeloom.plans import ranking as rkg
from tapeloom.plans import training as tr
from tapeloom.queries.bar_queries import FEATURE_COLS, FEATURE_CTES, LABEL_CTES, study
from tapeloom.queries.base import BARRIER, BARS, FEATURES, bars, query, r, rcols, rounded, with_ctes
from tapeloom.queries.data_queries import EARLY, day_context
from tapeloom.queries.daily_queries import NAMES, dataset, panel
from tapeloom.session import cut, without_huge_methods
from tapeloom.sources import driver_tables as tables
from tapeloom.sources import files as fs
from tapeloom.streaming import decisions as dc
from tapeloom.streaming import jobs

CFG = TrainConfig(barrier=BARRIER, features=FEATURES, split=SplitConfig(test_frac=0.25, embargo_days=1), thresholds=(0.3, 0.4, 0.5, 0.6), max_rows_per_day=100_000)
LABEL_OUT = ["target_ps", "stop_ps", "label", "entry_px", "exit_s", "timeout_edge"]
ITER = 5


@query(
    "training_set",
    with_ctes(FEATURE_CTES, LABEL_CTES.replace(BARS + ",\n", "")) + f"SELECT f.symbol, f.session_date, f.ts, {rcols(['f.' + c for c in FEATURE_COLS]).replace(' AS f.', ' AS ')}, {rcols(['l.' + c for c in LABEL_OUT]).replace(' AS l.', ' AS ')} FROM feats f JOIN labels_v l USING (symbol, session_date, ts) WHERE label IS NOT NULL",
)
def _training(spark, sf):
    return rounded(tr.training_set(bars(spark, sf), CFG).drop("bid", "ask"))


@query("walk_forward_report")
def _walk(spark, sf):
    return rounded(tr.walk_forward(cut(bars(spark, sf)), CFG, max_iter=ITER)[1], 4)


@query("fill_realism_report")
def _realism(spark, sf):
    """Features and labels are made once and stored: the fit, the split and the fills read them."""
    t = bars(spark, sf)
    path = fs.scratch_path(spark, "labelled")
    with without_huge_methods(spark):
        tr.labelled_features(t, CFG, keep=tr.TAPE).write.parquet(path)
    features = spark.read.parquet(path)
    model, _ = tr.walk_forward(t, CFG, max_iter=ITER, features=features)
    return rounded(tr.fill_realism(t, model, CFG, 0.4, 500, fill=FillConfig(maker_wait=4), features=features), 4)


@query("permutation_importance")
def _importance(spark, sf):
    rows = cut(tr.training_set(bars(spark, sf), CFG))
    names = ["ret_3s", "spread_bps", "qimb", "tod_min"]
    return rounded(tr.permutation_importance(rows, tr.fit_entry_model(rows, names, max_iter=ITER), names, repeats=2), 4)


@query("config_grid")
def _grid(spark, sf):
    fixed = dataclasses.replace(CFG, barrier=dataclasses.replace(BARRIER, mode="fixed", target_ps=0.3, stop_ps=0.2))
    return rounded(tr.config_grid(cut(bars(spark, sf)), {"vol": CFG, "fixed": fixed}, 3), 4)


@query("exported_model_scores")
def _export(spark, sf):
    rows = cut(tr.training_set(bars(spark, sf), CFG))
    names = bf.feature_names(FEATURES)
    path = fs.scratch_path(spark, "artifact")
    tr.export_model(tr.fit_entry_model(rows, names, max_iter=ITER), names, 0.5, BARRIER, path, spark)
    model, stored, params = tr.load_model(path, spark)
    return rounded(tr.score(rows, model, stored).select(*KEY, "ts", "p_win", F.lit(params["threshold"]).alias("threshold")), 4)


WEIGHTS = {"ret_3s": 4.0, "spread_bps": -0.002, "qimb": 0.5, "vol_surge": 0.1, "flow_imb_60s": 0.4, "tsize_surge": -0.05, "tod_min": 0.0005}
SCORE = " + ".join(f"coalesce(f.{c}, 0) * ({w})" for c, w in WEIGHTS.items())


@query(
    "decision_stream",
    with_ctes(FEATURE_CTES, LABEL_CTES.replace(BARS + ",\n", "")) + f""", d AS (SELECT f.symbol, f.session_date, f.ts, 1 / (1 + exp(-(-0.2 + {SCORE}))) AS p, l.target_ps, l.stop_ps
      FROM feats f JOIN labels_v l USING (symbol, session_date, ts) WHERE l.target_ps IS NOT NULL AND l.nbbo_ok AND l.ask >= l.bid)
    SELECT symbol, session_date, ts, {r('p', 'p_win')}, {r('target_ps', 'target_ps')}, {r('stop_ps', 'stop_ps')}, 7200 AS timeout_s, {r('stop_ps * 1.5', 'exec_stop_ps')}, 0.5::DOUBLE AS threshold, p >= 0.5 AS enter FROM d""",
)
def _decisions(spark, sf):
    """Bars arrive as a stream; features come from keyed state, a fixed linear model scores them."""
    live = jobs.replay(cut(bars(spark, sf)), "ts", 3)
    out = jobs.decision_stream(live, lambda f: f.withColumn("p_win", dc.linear_score(WEIGHTS, -0.2)), 0.5, FEATURES, BARRIER, 1.5)
    return rounded(jobs.run_to_end(out))


@query("stream_features", with_ctes(FEATURE_CTES) + f"SELECT symbol, session_date, ts, {rcols(FEATURE_COLS)} FROM feats")
def _stream_features(spark, sf):
    live = jobs.replay(cut(bars(spark, sf)), "ts", 4)
    return rounded(jobs.run_to_end(dc.stream_features(live, FEATURES, BARRIER)).drop("bid", "ask", "target_ps", "stop_ps"))


@query("exported_model_difference", with_ctes(FEATURE_CTES, LABEL_CTES.replace(BARS + ",\n", "")) + "SELECT symbol, session_date, ts, 0.0::DOUBLE AS difference, 1.0::DOUBLE AS total FROM labels_v WHERE label IS NOT NULL")
def _export_difference(spark, sf):
    """Win probability of a model before it was written less the one after it was read; its outcomes add up to one."""
    rows = cut(tr.training_set(bars(spark, sf), CFG))
    names = bf.feature_names(FEATURES)
    path = fs.scratch_path(spark, "artifact")
    model = tr.fit_entry_model(rows, names, max_iter=3)
    tr.export_model(model, names, 0.5, BARRIER, path, spark)
    again, stored, _ = tr.load_model(path, spark)
    both = tr.score(tr.score(rows, model, names).withColumnRenamed("p_win", "_first").drop("p_loss", "p_timeout"), again, stored)
    return rounded(both.select(*KEY, "ts", (F.col("p_win") - F.col("_first")).alias("difference"), (F.col("p_loss") + F.col("p_timeout") + F.col("p_win")).alias("total")))


@query("morning_watchlist")
def _morning(spark, sf):
    data = cut(scan.scanner_dataset(scan.early_bars(bars(spark, sf), *EARLY), day_context(spark, sf), study(spark, sf), 6))
    model = rkg.fit_morning_ranker(data, max_iter=ITER)
    scored = rkg.predict(model, data, scan.MORNING_FEATURES, "prediction").withColumn("symbol", F.concat_ws("-", "symbol", F.col("session_date").cast("string")))
    return rounded(scan.rank_watchlist(scored)[0].select("symbol", "prediction", "label"), 4)


def years(data):
    return [r["y"] for r in data.select(F.year("date").alias("y")).distinct().orderBy("y").collect()][1:]  # one row per year


@query("yearly_ranker_scores")
def _yearly(spark, sf):
    data = cut(dataset(panel(spark, sf)))
    models = rkg.yearly_models(data, years(data), NAMES, lambda d, n: rkg.fit_boosted(d, n, max_iter=ITER, depth=3))
    return rounded(rkg.predict_scores(data, models, NAMES), 4)


@query("teacher_student")
def _teacher(spark, sf):
    data = cut(dataset(panel(spark, sf)))
    train = data.dropna(subset=["y_rank"])
    boosted, forest = rkg.fit_boosted(train, NAMES, max_iter=ITER, depth=3), rkg.fit_forest(train, NAMES, trees=5)
    taught = cut(rkg.teacher_scores(data, boosted, forest, NAMES))
    student = rkg.fit_student(taught, NAMES)
    return rounded(rkg.student_coefficients(student, NAMES, spark), 5)


@query("tournament")
def _tournament(spark, sf):
    """Yearly models against the momentum baseline, judged by the same portfolio: all names, the published rounds, depth and list."""
    daily = panel(spark, sf)
    data = cut(dataset(daily, None))
    ys = years(data)
    models = rkg.yearly_models(data, ys, NAMES, rkg.fit_boosted, at_once=4)
    out = None
    for name, s in (("boosted", rkg.predict_scores(data, models, NAMES)), ("momentum", rkg.momentum_scores(data, ys))):
        p = xs.run_portfolio(s, daily, PortfolioConfig()).withColumn("series", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return rounded(xs.summarize_returns(out, "net", ["series"]), 4)

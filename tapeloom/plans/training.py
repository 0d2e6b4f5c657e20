"""Walk-forward training, scoring, export, realism and importance jobs."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.config import BarrierConfig, FillConfig, TrainConfig
from tapeloom.functions.ordered import ordered_prefix
from tapeloom.operators.bar_features import bar_features, drop_features, feature_names
from tapeloom.operators.bars import KEY
from tapeloom.operators.fills import fill_report, fills_on_tape, threshold_sweep, with_decisions
from tapeloom.operators.labels import balanced_weights, barrier_inputs, barrier_label_columns, barrier_steps, with_barriers
from tapeloom.operators.splits import day_split, stratified_cap
from tapeloom.plans.boosting import BoostConfig, BoostedModel, class_probabilities, fit_boosted_classes, load_boosted, save_model
from tapeloom.session import cut

TAPE = ["low", "ask_size", "spread", "volume"]  # what simulated fills read of a bar beside its quote


def labelled_features(bars: DataFrame, cfg: TrainConfig, keys: Sequence[str] = KEY, keep: Sequence[str] = ()) -> DataFrame:
    """Features, barriers and outcome of every bar: one shuffle, one Arrow pass per session."""
    b = cfg.barrier
    base = barrier_inputs(with_barriers(bars, b, keys).drop("px"), b, keys)
    carry = list(dict.fromkeys(["bid", "ask", "target_ps", "stop_ps", "_ok", "entry_px", "_win_px", "_loss_px", "_bid_timeout", *keep]))
    df = bar_features(base, cfg.features, keys, barrier_steps(b), carry, blocks=True)
    labels = barrier_label_columns(b)
    shown = [c for c in carry if not c.startswith("_") and c != "entry_px"]
    return df.select(*keys, "ts", *feature_names(cfg.features), *shown, *[c.alias(n) for n, c in labels.items()])


def training_set(bars: DataFrame, cfg: TrainConfig, keys: Sequence[str] = KEY) -> DataFrame:
    """Labelled rows of all sessions, capped per session with label shares kept."""
    rows = labelled_features(bars, cfg, keys).where(F.col("label").isNotNull())
    return stratified_cap(rows, cfg.max_rows_per_day, cfg.seed, keys)


def with_inputs(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """MLlib trees take no NULLs: each feature becomes a value (0 when missing) and a missing flag."""
    cols = []
    for n in names:
        cols += [F.coalesce(F.col(n), F.lit(0.0)).alias(f"{n}__v"), F.col(n).isNull().cast("double").alias(f"{n}__na")]
    return df.select("*", *cols)


def input_columns(names: Sequence[str]) -> list[str]:
    return [f"{n}__{s}" for n in names for s in ("v", "na")]


def fit_entry_model(train: DataFrame, names: Sequence[str], max_iter: int = 20, step: float = 0.1, depth: int = 5, quality=None) -> BoostedModel:
    """Boosted trees for the three outcomes -1, 0 and 1, with class-balanced row weights; missing features stay missing."""
    rows = balanced_weights(train, "label", "weight", quality)
    return fit_boosted_classes(rows, names, "label", "weight", BoostConfig(rounds=max_iter, step=step, depth=depth))


def score(df: DataFrame, model: BoostedModel, names: Sequence[str] | None = None) -> DataFrame:
    """Add p_loss, p_timeout and p_win, which add up to one; an outcome the model never saw has probability 0."""
    if names is not None and list(names) != model.names:
        raise ValueError("the model was fitted on other features")
    out = class_probabilities(df, model, "_p_")
    known = {f"{c:g}": F.col(f"`_p_{c:g}`") for c in model.classes}
    return out.select(*df.columns, *[known.get(c, F.lit(0.0)).alias(n) for c, n in (("-1", "p_loss"), ("0", "p_timeout"), ("1", "p_win"))])


def split_rows(rows: DataFrame, cfg: TrainConfig) -> tuple[DataFrame, DataFrame]:
    """(train, test) by session; the list of sessions is calendar-sized."""
    parts = cut(day_split(rows, cfg.split)).withColumnRenamed("date", "session_date")

    def part(name: str) -> DataFrame:
        return rows.join(F.broadcast(parts.where(F.col("part") == name).select("session_date")), "session_date", "left_semi")

    return part("train"), part("test")


def capped(rows: DataFrame, cfg: TrainConfig) -> DataFrame:
    """As ``stratified_cap``; rows are placed within their sessions only if a session is larger than the cap."""
    large = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cfg.max_rows_per_day)
    return rows if large.isEmpty() else stratified_cap(rows, cfg.max_rows_per_day, cfg.seed)


def _sweep(rows: DataFrame, cfg: TrainConfig, drop: str, max_iter: int) -> tuple[BoostedModel, DataFrame]:
    rows = drop_features(rows, drop)
    names = [n for n in feature_names(cfg.features) if n in rows.columns]
    train, test = split_rows(rows, cfg)
    model = fit_entry_model(capped(train, cfg), names, max_iter)
    return model, threshold_sweep(score(test, model, names), cfg.thresholds)


def walk_forward(bars: DataFrame, cfg: TrainConfig, drop: str = "", max_iter: int = 20, features: DataFrame | None = None) -> tuple[BoostedModel, DataFrame]:
    """Split by day, fit on the past (capped rows), report the threshold economics of all unseen rows.

    ``features`` are the labelled features of the bars where they are stored already.
    """
    rows = cut(labelled_features(bars, cfg).where(F.col("label").isNotNull())) if features is None else features.where(F.col("label").isNotNull())
    if rows.isEmpty():
        raise ValueError("no labelled rows in any session")
    return _sweep(rows, cfg, drop, max_iter)


def fill_realism(bars: DataFrame, model: BoostedModel, cfg: TrainConfig, threshold: float, qty: int, modes: Sequence[str] = ("taker", "maker"), stop_mult: float = 1.0, fill: FillConfig = FillConfig(), features: DataFrame | None = None) -> DataFrame:
    """Simulated fills of the model's decisions on the test sessions, against the label assumption.

    ``features`` are the labelled features of the bars with ``TAPE`` where they are stored already.
    """
    names = feature_names(cfg.features)
    rows = labelled_features(bars, cfg, keep=TAPE) if features is None else features
    _, test = split_rows(rows, cfg)
    shown = [*KEY, "ts", "bid", "ask", *TAPE]
    scored = score(test, model, names).select(*shown, "target_ps", "stop_ps", "label", "timeout_edge", "p_win")
    tape = cut(with_decisions(scored, threshold, qty, cfg.barrier, stop_mult, shown))
    sims = None
    for mode in modes:
        one = fills_on_tape(tape, dataclasses.replace(fill, entry_mode=mode)).withColumn("entry_mode", F.lit(mode))
        sims = one if sims is None else sims.unionByName(one)
    return fill_report(sims)


def export_model(model: BoostedModel, names: Sequence[str], threshold: float, barrier: BarrierConfig, path: str, spark: SparkSession, exec_stop_mult: float = 1.0) -> None:
    """Model, ordered feature list and inference parameters, as one artifact folder."""
    save_model(model, f"{path}/model", spark)
    spark.createDataFrame(list(enumerate(names)), "position int, feature string").write.mode("overwrite").parquet(f"{path}/features")
    p = {k: v for k, v in dataclasses.asdict(barrier).items() if not isinstance(v, dict)} | {"threshold": threshold, "exec_stop_mult": exec_stop_mult}
    spark.createDataFrame([p]).write.mode("overwrite").parquet(f"{path}/params")


def load_model(path: str, spark: SparkSession) -> tuple[BoostedModel, list[str], dict]:
    names = [r["feature"] for r in spark.read.parquet(f"{path}/features").orderBy("position").collect()]  # one row per feature
    return load_boosted(f"{path}/model", spark), names, spark.read.parquet(f"{path}/params").first().asDict()


def permutation_importance(rows: DataFrame, model: BoostedModel, names: Sequence[str], keys: Sequence[str] = (*KEY, "ts"), repeats: int = 3, sample: int | None = None, seed: int = 7) -> DataFrame:
    """Loss of accuracy when one feature is shuffled, over all labelled rows or a hash-drawn sample; one scoring job for all features."""
    keep = rows.where(F.col("label").isNotNull()).select(*keys, "label", *names)
    if sample is not None:
        keep = keep.withColumn("_h", F.xxhash64(*keys, F.lit(seed))).orderBy("_h", *keys).limit(sample).drop("_h")
    base = cut(ordered_prefix(keep, list(keys), index="_i"))
    plain = score(base, model, names).agg(F.avg(((F.col("p_win") >= 0.5) == (F.col("label") == 1.0)).cast("double")).alias("_base"))
    shuffled = None
    for k in range(repeats):
        drawn = base.select(F.xxhash64("_i", F.lit(seed + 1 + k)).alias("_d"), "_i", F.struct(*names).alias("_o"))
        other = ordered_prefix(drawn, ["_d", "_i"], index="_j").select(F.col("_j").alias("_i"), "_o")
        one = base.join(other, "_i").withColumn("repeat", F.lit(k))
        shuffled = one if shuffled is None else shuffled.unionByName(one)
    grid = shuffled.withColumn("feature", F.explode(F.array(*[F.lit(n) for n in names])))
    mixed = grid.select("feature", "repeat", "label", *[F.when(F.col("feature") == n, F.col(f"_o.{n}")).otherwise(F.col(n)).alias(n) for n in names])
    hit = ((F.col("p_win") >= 0.5) == (F.col("label") == 1.0)).cast("double")
    per = score(mixed, model, names).groupBy("feature", "repeat").agg(F.avg(hit).alias("acc"))
    drop = per.crossJoin(F.broadcast(plain)).withColumn("d", F.col("_base") - F.col("acc"))  # a single row
    return drop.groupBy("feature").agg(F.avg("d").alias("importance"), F.stddev_pop("d").alias("importance_std"))


def labelled_grid(bars: DataFrame, configs: Mapping[str, TrainConfig], keys: Sequence[str] = KEY) -> DataFrame:
    """Features once, and barriers and outcome of every setting, as columns ``<name>__<setting>``.

    The settings must share their feature windows; one shuffle and one pass per session
    serve all of them.
    """
    features = {c.features for c in configs.values()}
    if len(features) != 1:
        raise ValueError("the settings of a grid share their features")
    (shared,) = features
    df, steps, carry = bars, [], ["bid", "ask"]
    for name, cfg in configs.items():
        own = ["target_ps", "stop_ps", "_ok", "entry_px", "_win_px", "_loss_px", "_bid_timeout"]
        df = barrier_inputs(with_barriers(df, cfg.barrier, keys).drop("px"), cfg.barrier, keys).withColumnsRenamed({c: f"{c}__{name}" for c in own})
        steps += [dataclasses.replace(s, out=f"{s.out}__{name}", level=f"{s.level}__{name}") for s in barrier_steps(cfg.barrier)]
        carry += [f"{c}__{name}" for c in own]
    return bar_features(df, shared, keys, steps, carry)


def grid_rows(grid: DataFrame, name: str, cfg: TrainConfig, keys: Sequence[str] = KEY) -> DataFrame:
    """The labelled rows of one setting, with the columns of ``labelled_features``."""
    ends = f"__{name}"
    own = {c: c.removesuffix(ends) for c in grid.columns if c.endswith(ends)}
    rows = grid.withColumnsRenamed(own)
    labels = barrier_label_columns(cfg.barrier)
    return rows.select(*keys, "ts", *feature_names(cfg.features), "bid", "ask", "target_ps", "stop_ps", *[c.alias(n) for n, c in labels.items()]).where(F.col("label").isNotNull())


def config_grid(bars: DataFrame, configs: Mapping[str, TrainConfig], max_iter: int = 10, drop: str = "", at_once: int = 4) -> DataFrame:
    """One report over several training settings (a handful), from one labelled table; their fits run side by side."""
    grid = cut(labelled_grid(bars, configs))

    def one(item: tuple[str, TrainConfig]) -> DataFrame:
        name, cfg = item
        return _sweep(grid_rows(grid, name, cfg), cfg, drop, max_iter)[1].withColumn("config", F.lit(name))

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        reports = list(pool.map(inheritable_thread_target(bars.sparkSession)(one), configs.items()))
    return reduce(DataFrame.unionByName, reports)


def decide(bars: DataFrame, model: BoostedModel, names: Sequence[str], cfg: TrainConfig, exec_stop_mult: float = 1.0) -> DataFrame:
    """Decision rows (score, barriers, execution stop) for bars with a valid quote and warm barriers."""
    from tapeloom.functions.scalar import tradable_nbbo

    df = with_barriers(bars, cfg.barrier).drop("px")
    feats = bar_features(df, cfg.features, carry=("bid", "ask", "target_ps", "stop_ps"))
    ok = F.col("target_ps").isNotNull() & tradable_nbbo()
    out = score(feats.where(ok), model, names)
    stop = F.col("stop_ps") * exec_stop_mult
    return out.select(*KEY, "ts", "p_win", "target_ps", "stop_ps", F.lit(cfg.barrier.timeout_rows * cfg.barrier.row_seconds).alias("timeout_s"), stop.alias("exec_stop_ps"))

"""Temporal splits, embargoes, stratified caps and seeded sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.config import SplitConfig
from tapeloom.functions.ordered import exact_quantiles, ordered_prefix
from tapeloom.functions.scalar import stable_unit


def day_split(days: DataFrame, cfg: SplitConfig = SplitConfig(), date: str = "session_date") -> DataFrame:
    """Each distinct date with its part: 'test', 'train', or 'dropped' (embargo or too old).

    One row per session, so the ordering window is calendar-sized.
    """
    d = days.select(F.col(date).alias("date")).distinct()
    if cfg.test_start is not None:
        marked = d.withColumn("_test", F.col("date") >= F.to_date(F.lit(cfg.test_start)))
    else:
        k = F.row_number().over(Window.orderBy(F.desc("date")))
        n = F.count(F.lit(1)).over(Window.partitionBy())
        marked = d.withColumn("_test", k <= F.greatest(F.ceil(n * cfg.test_frac), F.lit(1)))
    first = F.min(F.when(F.col("_test"), F.col("date"))).over(Window.partitionBy())
    keep = F.datediff(first, "date") > cfg.embargo_days
    if cfg.train_start is not None:
        keep = keep & (F.col("date") >= F.to_date(F.lit(cfg.train_start)))
    missing = first.isNull() & F.lit(cfg.test_start is not None)
    part = F.when(missing, F.raise_error(F.lit("test_start leaves no test days"))).when(F.col("_test"), "test").when(keep, "train").otherwise("dropped")
    return marked.select("date", part.alias("part"))


def validation_split(days: DataFrame, cfg: SplitConfig, date: str = "date") -> DataFrame:
    """Core / validation part of the training dates; at least one core day stays."""
    d = days.select(F.col(date).alias("date")).distinct()
    whole = Window.partitionBy()
    if cfg.val_start is not None:
        val = F.col("date") >= F.to_date(F.lit(cfg.val_start))
        core = F.count(F.when(~val, 1)).over(whole)
        part = F.when(core == 0, F.raise_error(F.lit("val_start leaves no core training days"))).when(val, "val").otherwise("core")
        return d.select("date", part.alias("part"))
    n = F.count(F.lit(1)).over(whole)
    n_val = F.least(F.greatest(F.ceil(n * cfg.val_frac), F.lit(1)), n - 1)
    k = F.row_number().over(Window.orderBy(F.desc("date")))
    val = (F.lit(cfg.val_frac) > 0) & (n >= 2) & (k <= n_val)
    return d.select("date", F.when(val, "val").otherwise("core").alias("part"))


def row_split(df: DataFrame, order: Sequence[str], window: int, horizon: int, train_frac: float = 0.7, val_frac: float = 0.15, min_part: int = 100) -> DataFrame:
    """Contiguous train / val / test row ranges with an embargo of window + horizon rows between them."""
    rows = ordered_prefix(df, order)
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    i = F.col("row_index") - 1
    t_end, v_end = F.floor(F.col("_n") * train_frac), F.floor(F.col("_n") * (train_frac + val_frac))
    gap = window + horizon
    short = (v_end - t_end - gap < min_part) | (F.col("_n") - horizon - v_end - gap < min_part)
    part = (
        F.when(short, F.raise_error(F.lit("a part of the row split would have fewer rows than min_part")))
        .when((i >= window - 1) & (i < t_end), "train")
        .when((i >= t_end + gap) & (i < v_end), "val")
        .when((i >= v_end + gap) & (i < F.col("_n") - horizon), "test")
    )
    return rows.crossJoin(F.broadcast(n)).withColumn("part", part).where("part is not null").drop("_n")


def stratified_cap(df: DataFrame, max_rows: int, seed: int, keys: Sequence[str] = ("symbol", "session_date"), label: str = "label") -> DataFrame:
    """At most about max_rows per session, label shares kept, at least one row per label.

    The draw is an ordering by a hash of the row's own key, so it is reproducible.
    """
    whole = Window.partitionBy(*keys)
    group = Window.partitionBy(*keys, label)
    n, m = F.count(F.lit(1)).over(whole), F.count(F.lit(1)).over(group)
    k = F.row_number().over(group.orderBy(F.xxhash64(*keys, "ts", F.lit(seed)), "ts"))
    quota = F.greatest(F.ceil(m * max_rows / n), F.lit(1))
    ranked = df.select("*", n.alias("_n"), k.alias("_k"), quota.alias("_quota"))
    return ranked.where((F.col("_n") <= max_rows) | (F.col("_k") <= F.col("_quota"))).drop("_n", "_k", "_quota")


def keep_positives(df: DataFrame, positive: Column, neg_frac: float, seed: int, keys: Sequence[str]) -> DataFrame:
    """All positives, and each negative with probability neg_frac by a hash of its key."""
    return df.where(positive | (stable_unit(seed, *keys) < neg_frac))


def limit_by_quality(rows: DataFrame, manifest: DataFrame, depth: int, on: Sequence[str] = ("symbol", "session_date")) -> DataFrame:
    """Rows of the first ``depth`` stock-days of the manifest's quality ranking."""
    return rows.join(manifest.where(F.col("rank") <= depth).select(*on), list(on), "left_semi")


def matched_threshold(scores: DataFrame, k: int, score: str = "p_win") -> DataFrame:
    """Score threshold that passes about k rows: the (1 - k/n) quantile (k is bounded by n)."""
    n = scores.where(F.col(score).isNotNull()).count()
    return exact_quantiles(scores.select(score), score, {"threshold": max(0.0, 1.0 - k / n)}) if n else scores.agg(F.max(score).alias("threshold"))


def robust_scaler(train: DataFrame, names: Sequence[str]) -> DataFrame:
    """Exact median and interquartile range per feature (rows: feature, median, iqr); a tiny range -> 1."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("v")) for n in names])).alias("s")
    long = train.select(pairs).select("s.*").where("v is not null")
    q = exact_quantiles(long, "v", {"q25": 0.25, "median": 0.5, "q75": 0.75}, ["feature"])
    span = F.col("q75") - F.col("q25")
    return q.select("feature", "median", F.when(span > 1e-12, span).otherwise(1.0).alias("iqr"))


def apply_scaler(df: DataFrame, scaler: DataFrame, names: Sequence[str]) -> DataFrame:
    """(x - median) / iqr with missing or infinite results set to 0; the scaler has one row per feature."""
    wide = scaler.groupBy().pivot("feature", list(names)).agg(F.first("median").alias("m"), F.first("iqr").alias("s"))
    joined = df.crossJoin(F.broadcast(wide))  # a single row

    def scaled(n: str) -> Column:
        x = (F.col(n).cast("float") - F.col(f"{n}_m").cast("float")) / F.col(f"{n}_s").cast("float")
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        return F.when(bad, F.lit(0.0)).otherwise(x).cast("float")

    return joined.select(*[scaled(c).alias(c) if c in names else F.col(c) for c in df.columns])


def average_precision(scored: DataFrame, score: str = "p_win", truth: str = "y") -> DataFrame:
    """Area under the step precision-recall curve; ties count as one step, one-class input -> 0."""
    steps = scored.groupBy(score).agg(F.sum(truth).alias("tp"), F.count(F.lit(1)).alias("n")).withColumn("_neg", -F.col(score))
    pref = ordered_prefix(steps, ["_neg"], (), {"ctp": "tp", "cn": "n"})
    total = steps.agg(F.sum("tp").alias("_p"), F.sum("n").alias("_all"))
    df = pref.crossJoin(F.broadcast(total))  # a single row
    part = F.sum(F.col("ctp") / F.col("cn") * F.try_divide(F.col("tp"), F.col("_p")))
    one_class = (F.max("_p") == 0) | (F.max("_p") == F.max("_all"))
    return df.agg(F.when(one_class, 0.0).otherwise(part).alias("average_precision"))


def contiguity_breaks(bars: DataFrame, interval_s: int = 1, keys: Sequence[str] = ("symbol", "session_date")) -> DataFrame:
    """Rows that do not follow their predecessor by exactly one interval; must be empty."""
    prev = F.lag("ts", 1).over(Window.partitionBy(*keys).orderBy("ts"))
    step = F.unix_micros("ts") - F.unix_micros(prev)
    return bars.select(*keys, "ts", step.alias("step_us")).where(F.col("step_us").isNotNull() & (F.col("step_us") != interval_s * 1_000_000))


def require_none(violations: DataFrame, message: str) -> None:
    """Raise when a guard query finds a row (reads at most one)."""
    found = violations.limit(1).collect()
    if found:
        raise ValueError(f"{message}: {found[0].asDict()}")

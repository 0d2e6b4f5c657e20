"""Outcome labels: price barriers, smoothed book direction, and their balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.config import CLASS_NAMES, DOWN, FLAT, INVALID, UP, BarrierConfig, LabelConfig
from tapeloom.functions.ordered import exact_quantiles, with_row_halo
from tapeloom.functions.scalar import floor_at, sell_cost
from tapeloom.functions.session_scan import FirstTouch, scan_sessions
from tapeloom.operators.bars import KEY


def with_barriers(bars: DataFrame, cfg: BarrierConfig, keys: Sequence[str] = KEY) -> DataFrame:
    """Add target_ps and stop_ps: constants, or multiples of the trailing price range."""
    if cfg.mode == "fixed":
        return bars.withColumn("target_ps", F.lit(cfg.target_ps)).withColumn("stop_ps", F.lit(cfg.stop_ps))
    w = Window.partitionBy(*keys).orderBy("ts")
    frame = w.rowsBetween(-(cfg.vol_window - 1), 0)
    px = bars if "px" in bars.columns else bars.withColumn(
        "px", F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    need = max(2, cfg.vol_window // 3)
    span = F.when(F.count("px").over(frame) >= need, F.max("px").over(frame) - F.min("px").over(frame))
    return px.withColumn("_span", span).select(
        *px.columns,
        floor_at(F.col("_span") * cfg.vol_target_mult, cfg.min_target_ps).alias("target_ps"),
        floor_at(F.col("_span") * cfg.vol_stop_mult, cfg.min_stop_ps).alias("stop_ps"),
    )


def barrier_inputs(df: DataFrame, cfg: BarrierConfig, keys: Sequence[str] = KEY) -> DataFrame:
    """Eligibility and price levels of every bar (needs target_ps, stop_ps)."""
    w = Window.partitionBy(*keys).orderBy("ts")
    rn = F.row_number().over(w)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    recent = F.coalesce(F.sum("n_trades").over(w.rowsBetween(-cfg.active_window, -1)), F.lit(0.0))
    eligible = (
        F.col("bid").isNotNull() & F.col("ask").isNotNull() & (recent >= 1) & (rn + cfg.timeout_rows <= n)
        & F.col("target_ps").isNotNull() & F.col("stop_ps").isNotNull()
    )
    out = df.select("*", eligible.alias("_ok"), F.lead("bid", cfg.timeout_rows).over(w).alias("_bid_timeout"))
    entry = F.when(F.col("_ok"), F.col("ask"))
    return out.withColumn("entry_px", entry).select(
        *out.columns,
        "entry_px",
        (F.col("entry_px") + F.col("target_ps") + sell_cost("entry_px", cfg.clip_shares, cfg.fees)).alias("_win_px"),
        (F.col("entry_px") - F.col("stop_ps")).alias("_loss_px"),
    )


def barrier_steps(cfg: BarrierConfig) -> list[FirstTouch]:
    return [
        FirstTouch("_win_in", "bid", "_win_px", "ge", cfg.timeout_rows),
        FirstTouch("_loss_in", "bid", "_loss_px", "le", cfg.timeout_rows),
    ]


def barrier_label_columns(cfg: BarrierConfig) -> dict[str, Column]:
    """label 1 / -1 / 0 / NULL; on the same row the win is tested first."""
    win, loss = F.col("_win_in"), F.col("_loss_in")
    won = win.isNotNull() & (loss.isNull() | (win <= loss))
    lost = loss.isNotNull() & ~won
    ok = F.col("_ok")
    rows = F.when(won, win).when(lost, loss).otherwise(F.lit(cfg.timeout_rows))
    bid = F.col("_bid_timeout")
    edge = bid - F.col("entry_px") - sell_cost(bid, cfg.clip_shares, cfg.fees)
    return {
        "label": F.when(ok, F.when(won, 1.0).when(lost, -1.0).otherwise(0.0)),
        "entry_px": F.col("entry_px"),
        "exit_s": F.when(ok, (rows * cfg.row_seconds).cast("double")),
        "timeout_edge": F.when(ok & ~won & ~lost, edge),
    }


def barrier_labels(bars: DataFrame, cfg: BarrierConfig = BarrierConfig(), keys: Sequence[str] = KEY, carry: Sequence[str] = ()) -> DataFrame:
    """Triple-barrier outcome of a long entry at the ask, for every bar."""
    df = bars if {"target_ps", "stop_ps"} <= set(bars.columns) else with_barriers(bars, cfg, keys)
    needed = dict.fromkeys(["bid", "ask", "n_trades", "target_ps", "stop_ps", *carry])
    slim = barrier_inputs(df.select(*keys, "ts", *needed), cfg, keys)
    scanned = scan_sessions(slim, keys, "ts", barrier_steps(cfg))
    return scanned.select(
        *keys, "ts", "target_ps", "stop_ps", *[c.alias(n) for n, c in barrier_label_columns(cfg).items()], *carry
    )


def assumed_edge() -> Column:
    """Per-share result if barrier prices were filled exactly."""
    return (
        F.when(F.col("label") == 1.0, F.col("target_ps"))
        .when(F.col("label") == -1.0, -F.col("stop_ps"))
        .otherwise(F.coalesce("timeout_edge", F.lit(0.0)))
    )


# ---------------------------------------------------------------- book direction
def forward_moves(df: DataFrame, horizon: int, mode: str, keys: Sequence[str], order: Sequence[str], mid: str = "mid", chunk_rows: int = 200_000) -> DataFrame:
    """Relative move of the mean of the next ``horizon`` mids; NULL where a window is incomplete."""
    chunks = with_row_halo(df, keys, order, horizon, horizon, chunk_rows)
    w = Window.partitionBy(*keys, "chunk").orderBy("row_index")
    ahead, behind = w.rowsBetween(1, horizon), w.rowsBetween(-(horizon - 1), 0)
    plus = F.when(F.count(mid).over(ahead) == horizon, F.avg(mid).over(ahead))
    if mode == "vs_current":
        ref = F.col(mid)
    elif mode == "vs_past":
        ref = F.when(F.count(mid).over(behind) == horizon, F.avg(mid).over(behind))
    else:
        raise ValueError(f"unknown label mode: {mode}")
    out = chunks.select("*", plus.alias("_plus"), ref.alias("_ref"))
    return out.where(~F.col("is_halo")).withColumn("move", F.try_divide(F.col("_plus") - F.col("_ref"), F.col("_ref"))).drop(
        "_plus", "_ref", "chunk", "is_halo"
    )


def direction_labels(df: DataFrame, cfg: LabelConfig = LabelConfig(), keys: Sequence[str] = KEY, order: Sequence[str] = ("ts", "seq"), mid: str = "mid", chunk_rows: int = 200_000) -> DataFrame:
    """UP / FLAT / DOWN by +-alpha, NULL (and label_valid = false) for incomplete windows."""
    m = forward_moves(df, cfg.horizon, cfg.mode, keys, order, mid, chunk_rows)
    label = F.when(m["move"] > cfg.alpha, UP).when(m["move"] < -cfg.alpha, DOWN).when(m["move"].isNotNull(), FLAT)
    return m.withColumn("label", label.cast("int")).withColumn("label_valid", F.col("move").isNotNull())


def with_sentinel(label: str = "label") -> Column:
    return F.coalesce(F.col(label), F.lit(INVALID))


def suggest_alpha(df: DataFrame, horizon: int, target_flat: float = 0.4, keys: Sequence[str] = KEY, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """The threshold that leaves about ``target_flat`` of the rows flat."""
    m = forward_moves(df, horizon, "vs_current", keys, order).select(F.abs("move").alias("a"))
    return exact_quantiles(m, "a", {"alpha": target_flat})


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: share of each class among the valid labels."""
    valid = F.col(label).isin(DOWN, FLAT, UP)
    n = F.count(F.when(valid, 1))
    return df.agg(
        *[F.try_divide(F.count(F.when(F.col(label) == c, 1)), n).alias(name) for c, name in enumerate(CLASS_NAMES)],
        n.alias("n_valid"),
    )


def class_weights(df: DataFrame, label: str = "label", classes: Sequence[int] = (DOWN, FLAT, UP)) -> DataFrame:
    """Inverse-frequency weights with mean 1; an absent class counts as one row."""
    k = len(classes)
    row = df.agg(*[F.greatest(F.count(F.when(F.col(label) == c, 1)), F.lit(1)).cast("double").alias(f"c{c}") for c in classes])
    total = sum((F.col(f"c{c}") for c in classes), F.lit(0.0))
    raw = {c: total / (k * F.col(f"c{c}")) for c in classes}
    mean = sum(raw.values(), F.lit(0.0)) / k
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), (raw[c] / mean).alias("weight")) for c in classes])).alias("s")).select("s.*")


def balanced_weights(df: DataFrame, label: str = "label", out: str = "weight", quality: Column | None = None) -> DataFrame:
    """Row weight 1 / (classes x class share), optionally times a quality multiplier.

    The broadcast side has one row per class.
    """
    freq = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    tot = freq.agg(F.sum("__c").alias("__n"), F.count(F.lit(1)).alias("__k"))
    table = freq.crossJoin(F.broadcast(tot)).select(label, (F.col("__n") / (F.col("__k") * F.col("__c"))).alias(out))
    res = df.join(F.broadcast(table), label)
    return res if quality is None else res.withColumn(out, F.col(out) * quality)


def confusion_matrix(df: DataFrame, truth: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, truth: str = "label", pred: str = "pred") -> DataFrame:
    """Per class precision, recall, F1, support, with accuracy and macro F1 on every row."""
    cm = confusion_matrix(df, truth, pred)
    one = F.lit(0)
    aggs = []
    for c in range(len(CLASS_NAMES)):
        t, p = F.col(truth) == c, F.col(pred) == c
        aggs += [
            F.coalesce(F.sum(F.when(t & p, F.col("n"))), one).alias(f"tp{c}"),
            F.coalesce(F.sum(F.when(p, F.col("n"))), one).alias(f"pp{c}"),
            F.coalesce(F.sum(F.when(t, F.col("n"))), one).alias(f"tt{c}"),
        ]
    row = cm.agg(*aggs, F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col(truth) == F.col(pred), F.col("n"))), one).alias("hit"))
    z = F.lit(0.0)
    parts, f1s = [], []
    for c, name in enumerate(CLASS_NAMES):
        prec = F.coalesce(F.try_divide(F.col(f"tp{c}"), F.col(f"pp{c}")), z)
        rec = F.coalesce(F.try_divide(F.col(f"tp{c}"), F.col(f"tt{c}")), z)
        f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), z)
        f1s.append(f1)
        parts.append(
            F.struct(
                F.lit(name).alias("class"), F.round(prec, 4).alias("precision"), F.round(rec, 4).alias("recall"),
                F.round(f1, 4).alias("f1"), F.col(f"tt{c}").alias("support"),
            )
        )
    macro = sum(f1s, z) / len(f1s)
    return row.select(
        F.explode(F.array(*parts)).alias("s"), F.round(F.col("hit") / F.col("n"), 4).alias("accuracy"), F.round(macro, 4).alias("macro_f1")
    ).select("s.*", "accuracy", "macro_f1")

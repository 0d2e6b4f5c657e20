"""Order-book snapshots: cleaning, features, toxicity and the cost-aware backtest.

A session of snapshots has no row bound, so row frames run over chunks of rows
with copied edges and running values are carried from chunk to chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.config import DOWN, UP, BookBacktestConfig, LabelConfig
from tapeloom.functions.ordered import carry, exact_quantiles, ordered_prefix, with_row_halo
from tapeloom.operators.bars import KEY
from tapeloom.operators.labels import class_distribution, direction_labels
from tapeloom.session import cut

ORDER = ("ts", "seq")
EPS = 1e-12
DEPTHS = (1, 3, 5, 10)
CHUNK_ROWS = 200_000


def best(side: str, what: str) -> Column:
    return F.col("levels")[0][f"{side}_{what}"]


def with_mid(df: DataFrame) -> DataFrame:
    return df.withColumn("mid", (best("ask", "p") + best("bid", "p")) / 2.0)


# ---------------------------------------------------------------- cleaning
def flag_snapshots(df: DataFrame, max_spread_mult: float = 50.0) -> DataFrame:
    """Flag crossed, non-positive and very wide books; the norm is the median positive spread (one row)."""
    ask, bid = best("ask", "p"), best("bid", "p")
    spread = df.select((ask - bid).alias("s")).where("s > 0")
    median = exact_quantiles(spread, "s", {"median_spread": 0.5})
    norm = median.agg(F.coalesce(F.max("median_spread"), F.lit(1.0)).alias("median_spread"))
    flagged = df.crossJoin(F.broadcast(norm)).select(
        "*",
        (bid >= ask).alias("crossed"),
        ((ask <= 0) | (bid <= 0)).alias("nonpositive"),
        (ask - bid > F.col("median_spread") * max_spread_mult).alias("wide"),
    )
    return flagged.withColumn("bad", F.col("crossed") | F.col("nonpositive") | F.col("wide"))


def cleaning_report(flagged: DataFrame) -> DataFrame:
    def n(c: str) -> Column:
        return F.count(F.when(F.col(c), 1))

    return flagged.agg(
        F.count(F.lit(1)).alias("n_total"), n("crossed").alias("n_crossed"), n("nonpositive").alias("n_nonpositive"),
        n("wide").alias("n_wide_spread"), n("bad").alias("n_bad"), F.max("median_spread").alias("median_spread"),
    )


def clean_snapshots(df: DataFrame, max_spread_mult: float = 50.0, drop: bool = False, keys: Sequence[str] = KEY, order: Sequence[str] = ORDER, chunk_s: int = 3600) -> DataFrame:
    """Drop bad books, or replace them by the last good one (leading ones by the first good one)."""
    flagged = flag_snapshots(df, max_spread_mult)
    if drop:
        return flagged.where(~F.col("bad")).select(df.columns)
    good = F.when(~F.col("bad"), F.col("levels"))
    work = flagged.withColumn("_good", good).withColumn("_chunk", F.floor(F.unix_micros("ts") / (chunk_s * 1_000_000)))
    work = carry(work, keys, "_chunk", order, last={"_last": "_good"})
    first = flagged.where(~F.col("bad")).groupBy(*keys).agg(F.min_by("levels", F.struct(*order)).alias("_first"))
    work = work.join(first, list(keys), "left")
    return work.withColumn("levels", F.coalesce("_last", "_first", "levels")).select(df.columns)


# ---------------------------------------------------------------- features
def shape_levels() -> Column:
    """Prices relative to mid, volumes raw, level order kept."""
    m = (best("ask", "p") + best("bid", "p")) / 2.0
    return F.transform(
        "levels",
        lambda x: F.struct(
            (x["ask_p"] - m).alias("ask_p"), x["ask_v"].alias("ask_v"), (x["bid_p"] - m).alias("bid_p"), x["bid_v"].alias("bid_v")
        ),
    )


def static_features() -> dict[str, Column]:
    ap, av, bp, bv = best("ask", "p"), best("ask", "v"), best("bid", "p"), best("bid", "v")

    def depth(side: str, k: int) -> Column:
        return F.aggregate(F.slice("levels", 1, k), F.lit(0.0), lambda acc, x: acc + x[f"{side}_v"])

    out = {
        "imbalance": F.transform("levels", lambda x: (x["bid_v"] - x["ask_v"]) / (x["bid_v"] + x["ask_v"] + EPS)),
        "spread": ap - bp,
        "microprice_dev": (ap * bv + bp * av) / (bv + av + EPS) - (ap + bp) / 2.0,
    }
    for k in DEPTHS:
        vb, va = depth("bid", k), depth("ask", k)
        out[f"cum_imb_{k}"] = (vb - va) / (vb + va + EPS)
    return out


def book_features(df: DataFrame, mode: str = "extended", vol_window: int = 50, flow_window: int = 20, keys: Sequence[str] = KEY, order: Sequence[str] = ORDER, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """raw40 book shape, or that plus the engineered microstructure features."""
    if mode == "raw40":
        return df.select(*keys, *order, shape_levels().alias("shape"))
    if mode != "extended":
        raise ValueError(f"mode is {mode!r}, not extended or raw40")
    rows = with_row_halo(with_mid(df), keys, order, max(vol_window, flow_window, 10) + 1, chunk_rows=chunk_rows)
    w = Window.partitionBy(*keys, "chunk").orderBy("row_index")

    def back(n: int):
        return w.rowsBetween(-(n - 1), 0)

    def change(c: Column) -> Column:
        return c - F.lag(c, 1).over(w)

    ap, av, bp, bv = best("ask", "p"), best("ask", "v"), best("bid", "p"), best("bid", "v")
    dbp, dap = change(bp), change(ap)
    bid_part = F.when(dbp > 0, bv).when(dbp < 0, -F.lag(bv, 1).over(w)).otherwise(change(bv))
    ask_part = F.when(dap < 0, av).when(dap > 0, -F.lag(av, 1).over(w)).otherwise(change(av))
    zero = F.lit(0.0)
    lagged = rows.select(
        "*",
        F.coalesce(F.col("mid") - F.lag("mid", 1).over(w), zero).alias("mid_ret_1"),
        F.coalesce(F.col("mid") - F.lag("mid", 10).over(w), zero).alias("mid_ret_10"),
        F.coalesce(bid_part - ask_part, zero).alias("ofi"),
        (F.col("buy_flow") - F.col("sell_flow")).alias("signed_flow"),
    )
    rolled = lagged.select(
        "*",
        F.sum("signed_flow").over(back(flow_window)).alias(f"signed_flow_{flow_window}"),
        F.stddev_pop("mid_ret_1").over(back(vol_window)).alias(f"rv_{vol_window}"),
    )
    return rolled.where(~F.col("is_halo")).select(
        *keys, *order, shape_levels().alias("shape"), *[c.alias(n) for n, c in static_features().items()],
        "mid_ret_1", "mid_ret_10", "ofi", "signed_flow", f"signed_flow_{flow_window}", f"rv_{vol_window}",
    )


def _toxicity(w: Window, rows: int) -> Column:
    f = w.rowsBetween(-(rows - 1), 0)
    net, tot = F.sum(F.col("buy_flow") - F.col("sell_flow")).over(f), F.sum(F.col("buy_flow") + F.col("sell_flow")).over(f)
    return F.abs(net) / F.greatest(tot, F.lit(1e-9))


def toxicity(df: DataFrame, window: int = 50, keys: Sequence[str] = KEY, order: Sequence[str] = ORDER, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One-sidedness of the trade flow over the trailing window, in [0, 1]."""
    rows = with_row_halo(df, keys, order, window, chunk_rows=chunk_rows)
    w = Window.partitionBy(*keys, "chunk").orderBy("row_index")
    return rows.withColumn("toxicity", _toxicity(w, window)).where(~F.col("is_halo")).drop("chunk", "is_halo")


def standardizer(train: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: mean and population std of each feature over the training rows; tiny std -> 1."""
    aggs = []
    for n in names:
        sd = F.stddev_pop(n)
        aggs += [F.avg(n).alias(f"{n}__mean"), F.when(sd < EPS, 1.0).otherwise(sd).alias(f"{n}__std")]
    return train.agg(*aggs)


def standardize(df: DataFrame, stats: DataFrame, names: Sequence[str]) -> DataFrame:
    joined = df.crossJoin(F.broadcast(stats))  # a single row
    scaled = {n: ((F.col(n) - F.col(f"{n}__mean")) / F.col(f"{n}__std")).cast("float") for n in names}
    return joined.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- backtest
def oracle_probabilities(label: str = "label") -> list[Column]:
    """(p_down, p_flat, p_up) of a perfect forecaster; undecided rows are uniform."""
    third, c = F.lit(1.0 / 3.0), F.col(label)
    sure = c.isin(UP, DOWN)
    return [
        F.when(sure, (c == DOWN).cast("double")).otherwise(third).alias("p_down"),
        F.when(sure, F.lit(0.0)).otherwise(third).alias("p_flat"),
        F.when(sure, (c == UP).cast("double")).otherwise(third).alias("p_up"),
    ]


def book_positions(df: DataFrame, cfg: BookBacktestConfig = BookBacktestConfig(), keys: Sequence[str] = KEY, order: Sequence[str] = ORDER, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Position, cash and marked equity per snapshot (needs p_down, p_up, bid, ask, flows).

    Closed form instead of a step loop. The wanted side is constant on islands
    of rows; the position follows it as soon as one row of the island was not
    toxic. Cash is then a running sum of each row's own trades.
    """
    rows = with_row_halo(df, keys, order, cfg.toxicity_window, chunk_rows=chunk_rows)
    w = Window.partitionBy(*keys, "chunk").orderBy("row_index")
    want = F.when(F.col("p_up") > cfg.prob_threshold, 1).when(F.col("p_down") > cfg.prob_threshold, -1).otherwise(0)
    rows = rows.withColumn("want", want).withColumn("toxicity", _toxicity(w, cfg.toxicity_window))
    changed = F.coalesce(F.lag("want", 1).over(w) != F.col("want"), F.lit(True))
    rows = rows.withColumn("_changed", changed).where(~F.col("is_halo")).drop("is_halo")
    calm = (F.col("toxicity") <= cfg.toxicity_threshold) if cfg.use_toxicity_filter else F.lit(True)
    rows = rows.withColumn("_change_at", F.when(F.col("_changed"), F.col("row_index"))).withColumn("_calm_at", F.when(calm, F.col("row_index")))
    rows = carry(rows, keys, "chunk", ["row_index"], maxes={"_since": "_change_at", "_calm": "_calm_at"})
    entered = F.coalesce(F.col("_calm") >= F.col("_since"), F.lit(False))
    rows = rows.withColumn("position", F.when(entered, F.col("want")).otherwise(F.lit(0)))
    used = dict.fromkeys([*keys, *order, "row_index", "chunk", "bid", "ask", "want", "position"])
    rows = cut(rows.select(*used))  # each running value below reads its input twice
    rows = carry(rows, keys, "chunk", ["row_index"], last={"_prev": "position"}, include_current=False)
    prev, pos = F.coalesce("_prev", F.lit(0)), F.col("position")
    friction = (cfg.fee_bps + cfg.slippage_bps) * 1e-4
    moved = pos != prev
    closing, opening = moved & (prev != 0), moved & (pos != 0)
    exit_px = F.when(prev > 0, F.col("bid")).otherwise(F.col("ask"))
    entry_px = F.when(pos > 0, F.col("ask")).otherwise(F.col("bid"))
    zero = F.lit(0.0)
    rows = rows.select(
        "*",
        (F.when(closing, prev * exit_px).otherwise(zero) - F.when(opening, pos * entry_px).otherwise(zero)).alias("_flow"),
        (F.when(closing, exit_px * friction).otherwise(zero) + F.when(opening, entry_px * friction).otherwise(zero)).alias("_cost"),
        (closing.cast("int") + opening.cast("int")).alias("_legs"),
        F.when(opening, entry_px).alias("_opened"),
        F.when(closing, exit_px).alias("_closed"),
        prev.alias("_was"),
        ((F.col("want") != 0) & (pos == 0)).alias("suppressed"),
    )
    rows = carry(rows, keys, "chunk", ["row_index"], last={"_entry": "_opened"}, sums={"_cash0": "_flow", "_costs0": "_cost"}, include_current=False)
    rows = rows.withColumn("_gross_cash", F.col("_cash0") + F.col("_flow")).withColumn("_costs", F.col("_costs0") + F.col("_cost"))
    mark = pos * (F.col("bid") + F.col("ask")) / 2.0
    rows = rows.withColumn("gross_pnl", F.col("_gross_cash") + mark).withColumn("net_pnl", F.col("_gross_cash") - F.col("_costs") + mark)
    rows = rows.withColumn("trade_pnl", F.when(F.col("_closed").isNotNull(), F.col("_was") * (F.col("_closed") - F.col("_entry"))))
    rows = carry(rows, keys, "chunk", ["row_index"], last={"_net_before": "net_pnl"}, maxes={"_peak0": "net_pnl"}, include_current=False)
    return rows.withColumn("peak", F.greatest("_peak0", "net_pnl")).withColumn("ret", F.col("net_pnl") - F.coalesce("_net_before", zero))


def backtest_summary(positions: DataFrame, cfg: BookBacktestConfig = BookBacktestConfig(), keys: Sequence[str] = KEY) -> DataFrame:
    sd = F.stddev_pop("ret")
    closed = F.col("trade_pnl").isNotNull()
    return positions.groupBy(*keys).agg(
        F.max_by("net_pnl", "row_index").alias("final_net_pnl"),
        F.max_by("gross_pnl", "row_index").alias("final_gross_pnl"),
        F.sum("_legs").alias("n_trades"),
        F.count(F.when(closed, 1)).alias("round_trips"),
        F.round(F.coalesce(F.avg(F.when(closed, (F.col("trade_pnl") > 0).cast("double"))), F.lit(0.0)), 4).alias("hit_rate"),
        F.round(F.max_by("_costs", "row_index"), 2).alias("total_costs"),
        F.round(F.when(sd > 1e-12, F.avg("ret") / sd * cfg.snapshots_per_year**0.5).otherwise(0.0), 2).alias("sharpe"),
        F.round(F.max(F.col("peak") - F.col("net_pnl")), 2).alias("max_drawdown"),
        F.count(F.when(F.col("suppressed"), 1)).alias("suppressed_entries"),
        F.round(F.avg((F.col("position") != 0).cast("double")), 4).alias("time_in_market"),
    )


def book_backtest(df: DataFrame, cfg: BookBacktestConfig = BookBacktestConfig(), keys: Sequence[str] = KEY, order: Sequence[str] = ORDER, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    return backtest_summary(book_positions(df, cfg, keys, order, chunk_rows), cfg, keys)


def frictionless_pnl(labelled: DataFrame, px: float = 1.0, keys: Sequence[str] = KEY, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Direction only: hold the labelled side to the next mid, no costs (needs label, mid)."""
    rows = with_row_halo(labelled, keys, ORDER, 0, 1, chunk_rows)
    w = Window.partitionBy(*keys, "chunk").orderBy("row_index")
    side = F.when(F.col("label") == UP, 1.0).when(F.col("label") == DOWN, -1.0).otherwise(0.0)
    move = F.coalesce(F.lead("mid", 1).over(w) - F.col("mid"), F.lit(0.0))
    gain = rows.withColumn("_g", side * move).where(~F.col("is_halo"))
    return gain.groupBy(*keys).agg((F.sum("_g") * px).alias("frictionless_pnl"))


def cost_aware_alpha(df: DataFrame, cost_mult: float = 1.0, px: float = 1.0, fee_bps: float = 0.5, slip_bps: float = 0.3) -> DataFrame:
    """One row: the relative move that pays cost_mult round trips at the median price and spread."""
    two = df.select("mid", "spread")
    med = exact_quantiles(two, "mid", {"m": 0.5}).crossJoin(exact_quantiles(two, "spread", {"s": 0.5}))  # 1 x 1 row
    m, s = F.col("m") * px, F.col("s") * px
    cost = s + 2.0 * (fee_bps + slip_bps) * 1e-4 * m
    return med.select(m.alias("mid_px"), s.alias("spread_px"), cost.alias("round_trip_cost"), (cost_mult * cost / m).alias("alpha"))


def horizon_sweep(df: DataFrame, horizons: Sequence[int], cost_mult: float = 1.0, px: float = 1.0, keys: Sequence[str] = KEY) -> DataFrame:
    """Per horizon: class shares, cost-crossing net result and frictionless result of perfect labels.

    The threshold is a single number, fetched once; horizons are independent jobs. Only
    the touch and the flows are carried: the levels of a book would pass through every shuffle.
    """
    touch = with_mid(df).withColumn("spread", best("ask", "p") - best("bid", "p")).withColumn("bid", best("bid", "p")).withColumn("ask", best("ask", "p"))
    books = cut(touch.select(*keys, *ORDER, "mid", "spread", "bid", "ask", "buy_flow", "sell_flow"))
    alpha = cost_aware_alpha(books, cost_mult, px).first()["alpha"]
    out = None
    for k in horizons:
        lab = direction_labels(books, LabelConfig(horizon=k, alpha=alpha), keys, ORDER).drop("row_index")
        probs = lab.where("label_valid").select("*", *oracle_probabilities())
        priced = probs.withColumn("bid", F.col("bid") * px).withColumn("ask", F.col("ask") * px)
        bt = book_backtest(priced, BookBacktestConfig(use_toxicity_filter=False), keys)
        total = bt.agg(F.sum("n_trades").alias("n_trades"), F.sum("final_net_pnl").alias("cross_net"))
        free = frictionless_pnl(lab, px, keys).agg(F.sum("frictionless_pnl").alias("frictionless"))
        one = class_distribution(lab).crossJoin(total).crossJoin(free).withColumn("horizon", F.lit(k))  # single rows
        out = one if out is None else out.unionByName(one)
    return out


def row_numbered(df: DataFrame, keys: Sequence[str] = KEY, order: Sequence[str] = ORDER) -> DataFrame:
    return ordered_prefix(df, order, keys)

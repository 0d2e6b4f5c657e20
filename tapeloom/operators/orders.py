"""Order event folding, fills to positions and closed trades, and the report queries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tapeloom.functions.ordered import carry, ordered_prefix, prefix_fold, with_row_halo
from tapeloom.functions.scalar import contribution, local_midnight_utc, ratio
from tapeloom.session import cut

MATCH_ORDER = ("ts", "seq", "tie")


_UPSERT = ("symbol", "side", "qty", "status")


def _upserts(orders: DataFrame) -> DataFrame:
    return orders.groupBy("client_order_id").agg(*[F.max_by(c, "seq").alias(c) for c in _UPSERT], F.max("seq").alias("upsert_seq"), F.min("seq").alias("first_seq"))


def _events(events: DataFrame, first: DataFrame) -> DataFrame:
    """Aggregates of the events of known ids, from their first upsert on."""
    known = events.join(first.select("client_order_id", "first_seq"), "client_order_id").where(F.col("seq") >= F.col("first_seq"))
    is_fill = F.col("fill_qty").isNotNull()
    fill_seq = F.when(is_fill, F.col("seq"))
    return known.groupBy("client_order_id").agg(
        F.max_by("status", "seq").alias("event_status"), F.max_by(is_fill, "seq").alias("ends_filled"), F.max("seq").alias("event_seq"),
        F.sum("fill_qty").alias("filled_qty"), F.max_by("fill_price", fill_seq).alias("fill_price"), F.max(fill_seq).alias("fill_seq"),
    )


def order_state(orders: DataFrame, events: DataFrame) -> DataFrame:
    """Running aggregates per client order id: the last upsert, and what its events add up to."""
    base = _upserts(orders)
    return base.join(_events(events, base), "client_order_id", "left")


def merge_orders(old: DataFrame, orders: DataFrame, events: DataFrame) -> DataFrame:
    """``old`` aggregates advanced by later upserts and events; ids without either stay."""
    upserts = old.select("client_order_id", *_UPSERT, "upsert_seq", "first_seq").unionByName(_upserts(orders))
    base = upserts.groupBy("client_order_id").agg(*[F.max_by(c, "upsert_seq").alias(c) for c in _UPSERT], F.max("upsert_seq").alias("upsert_seq"), F.min("first_seq").alias("first_seq"))
    sums = ["event_status", "ends_filled", "event_seq", "filled_qty", "fill_price", "fill_seq"]
    both = old.select("client_order_id", *sums).unionByName(_events(events, base).select("client_order_id", *sums))
    after = both.groupBy("client_order_id").agg(
        F.max_by("event_status", "event_seq").alias("event_status"), F.max_by("ends_filled", "event_seq").alias("ends_filled"), F.max("event_seq").alias("event_seq"),
        F.sum("filled_qty").alias("filled_qty"), F.max_by("fill_price", "fill_seq").alias("fill_price"), F.max("fill_seq").alias("fill_seq"),
    )
    return base.join(after, "client_order_id", "left")


def orders_view(state: DataFrame) -> DataFrame:
    """The current row of every id from its aggregates."""
    # a fill that comes last sees the whole filled quantity, so no running sum is needed
    by_fill = F.when(F.col("filled_qty") >= F.col("qty"), "filled").otherwise("partially_filled")
    by_event = F.when(F.col("ends_filled"), by_fill).otherwise(F.coalesce("event_status", "status"))
    status = F.when(F.col("event_seq") >= F.col("upsert_seq"), by_event).otherwise(F.col("status"))
    return state.select("client_order_id", "symbol", "side", "qty", status.alias("status"), F.coalesce("filled_qty", F.lit(0)).alias("filled_qty"), "fill_price")


def latest_orders(orders: DataFrame, events: DataFrame) -> DataFrame:
    """Current row per client order id from its upserts and its status / fill events, in one sequence.

    Events of unknown ids, or from before an id was first upserted, are ignored.
    Fields come from the last upsert; fills add up; whatever has the greatest seq,
    upsert or event, decides the status (an event, if both have it). A fill sets
    filled or partially_filled.
    """
    return orders_view(order_state(orders, events))


# ---------------------------------------------------------------- fills -> round trips
def affine_scan(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive prefix compositions of the maps e -> a*e + b, in log n vector steps."""
    a, b = a.copy(), b.copy()
    d = 1
    while d < len(a):
        b[d:] += a[d:] * b[:-d].copy()
        a[d:] *= a[:-d].copy()
        d *= 2
    return a, b


def match_fills(fills: DataFrame, keys: Sequence[str] = ("symbol",), chunk_rows: int = 50_000) -> DataFrame:
    """Every fill with the position before and after it, its entry price and realised PnL.

    Positions are running sums. A fill changes the entry price by an affine map
    (open: take the price; scale in: blend; reduce or flip: keep), and affine
    maps compose. So a symbol's fills are cut into chunks, each chunk is reduced
    to one map, the maps are chained over the chunks, and each chunk is replayed
    from its true starting price: no symbol has to fit in one task. The chunks' maps are
    chained by ``prefix_fold``, so neither has their number.
    """
    delta = F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))
    rows = ordered_prefix(fills.withColumn("delta", delta), MATCH_ORDER, keys, {"pos_after": "delta"})
    before = F.col("pos_after") - F.col("delta")
    opens = before == 0
    reduces = (before > 0) & (F.col("delta") < 0) | (before < 0) & (F.col("delta") > 0)
    weight = before / F.nullif("pos_after", F.lit(0))
    price = F.col("price")
    rows = rows.select(
        "*",
        before.alias("pos_before"),
        F.when(opens, 0.0).when(reduces, 1.0).otherwise(weight).alias("_a"),
        F.when(opens, price).when(reduces, 0.0).otherwise(price * F.col("delta") / F.nullif("pos_after", F.lit(0))).alias("_b"),
        reduces.alias("closing"),
        F.floor((F.col("row_index") - 1) / chunk_rows).alias("_chunk"),
    )
    rows = cut(rows)
    kinds = dict(rows.dtypes)
    names = [*keys, "_chunk"]

    def summarise(part: pa.Table) -> pa.Table:
        part = part.sort_by("row_index")
        a, b = affine_scan(*(part.column(c).to_numpy() for c in ("_a", "_b")))
        return pa.table([*(part.column(c).slice(0, 1) for c in names), pa.array(a[-1:]), pa.array(b[-1:])], [*names, "a", "b"])

    maps = rows.select(*names, "row_index", "_a", "_b").groupBy(*names).applyInArrow(summarise, ", ".join(f"{c} {kinds[c]}" for c in names) + ", a double, b double")
    maps = cut(maps.select(*names, F.struct("a", "b").alias("_map")))
    chained = prefix_fold(
        maps, keys, "_chunk", "_map",
        lambda first, then: F.struct((then["a"] * first["a"]).alias("a"), (then["a"] * first["b"] + then["b"]).alias("b")),
        F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")),
    )
    starts = chained.select(*names, F.col("before.b").alias("_start"))  # from no position: the map applied to 0

    def replay(part: pa.Table) -> pa.Table:
        part = part.sort_by("row_index")
        a, b = affine_scan(*(part.column(c).to_numpy() for c in ("_a", "_b")))
        start = part.column("_start")[0].as_py()
        after = a * start + b
        before = np.concatenate([[start], after[:-1]])
        return part.drop_columns(["_a", "_b", "_start"]).append_column("entry_before", pa.array(before)).append_column("entry_after", pa.array(after))

    kept = [c for c in rows.columns if c not in ("_a", "_b")]
    schema = StructType([*[rows.schema[c] for c in kept], StructField("entry_before", DoubleType()), StructField("entry_after", DoubleType())])
    full = rows.join(starts, names).select(*kept, "_a", "_b", "_start").groupBy(*names).applyInArrow(replay, schema)
    closed = F.least(F.abs("delta"), F.abs("pos_before"))
    pnl = (price - F.col("entry_before")) * closed * F.signum("pos_before")
    return full.select(
        *fills.columns, "row_index", "pos_before", "pos_after", "closing", "_chunk",
        F.when(F.col("pos_after") != 0, F.col("entry_after")).alias("entry_price"),
        F.when(F.col("closing"), closed).alias("closed_qty"),
        F.when(F.col("closing"), F.col("entry_before")).alias("closed_entry"),
        F.when(F.col("closing"), pnl).alias("pnl"),
    )


def closed_round_trips(matched: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Closed trades: one per reducing fill, with the time its position was opened (or flipped into)."""
    opened = F.when(F.col("pos_before") == 0, F.col("ts"))
    rows = carry(matched.withColumn("_opened", opened), keys, "_chunk", ["row_index"], last={"entry_ts": "_opened"}, include_current=False)
    return rows.where("closing").select(
        *keys, F.when(F.col("pos_before") > 0, "long").otherwise("short").alias("side"), F.col("closed_qty").alias("qty"), "entry_ts",
        F.col("ts").alias("exit_ts"), F.col("closed_entry").alias("entry_price"), F.col("price").alias("exit_price"), "pnl",
    )


def open_positions(matched: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    last = matched.groupBy(*keys).agg(
        F.max_by("pos_after", "row_index").alias("qty"), F.max_by("entry_price", "row_index").alias("entry_price"), F.max_by("price", "row_index").alias("mark")
    )
    return last.where("qty <> 0")


def realized_by_day(trades: DataFrame, by_symbol: bool = False, ts: str = "exit_ts") -> DataFrame:
    keys = [F.to_date(ts).alias("session_date"), *([F.col("symbol")] if by_symbol else [])]
    return trades.groupBy(*keys).agg(F.sum("pnl").alias("realized"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- metrics
def with_drawdown(equity: DataFrame, order: Sequence[str] = ("id",), value: str = "equity", chunk: str = "_day") -> DataFrame:
    """Running peak and drawdown of a long equity log, peak carried from day to day."""
    df = equity.withColumn(chunk, F.to_date("ts"))
    df = carry(df, (), chunk, order, maxes={"peak": value})
    return df.withColumn("drawdown", (F.col("peak") - F.col(value)) / F.col("peak")).drop(chunk)


def performance_metrics(equity: DataFrame, trades: DataFrame, order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """Return, daily Sharpe, drawdown, hit rate and average win / loss as one row."""
    key = F.struct(*order)
    zero = F.lit(0.0)
    ends = equity.agg(F.min_by("equity", key).alias("_e0"), F.max_by("equity", key).alias("_e1"), F.count(F.lit(1)).alias("_n"))
    dd = with_drawdown(equity, order).agg(F.max("drawdown").alias("_dd"))
    days = equity.groupBy(F.to_date("ts").alias("d")).agg(F.max_by("equity", key).alias("v"))
    w = Window.orderBy("d")  # one row per day
    rets = days.select("v", ((F.col("v") - F.lag("v", 1).over(w)) / F.greatest(F.lag("v", 1).over(w), F.lit(1e-9))).alias("_r"))
    sd = F.stddev_pop("_r")
    daily = rets.agg(F.when((F.count(F.lit(1)) >= 3) & (sd > 1e-12), F.avg("_r") / sd * 252.0**0.5).otherwise(zero).alias("_sharpe"))
    win = F.col("pnl") > 0
    tr = trades.agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg(win.cast("double")).alias("_hit"), F.avg(F.when(win, F.col("pnl"))).alias("_w"), F.avg(F.when(~win, F.col("pnl"))).alias("_l")
    )
    row = ends.crossJoin(dd).crossJoin(daily).crossJoin(tr)  # single rows
    enough = F.col("_n") >= 2
    return row.select(
        F.when(enough, F.round((F.col("_e1") / F.col("_e0") - 1) * 100, 4)).otherwise(zero).alias("total_return_pct"),
        F.when(enough, F.round("_sharpe", 4)).otherwise(zero).alias("sharpe_daily_annualized"),
        F.when(enough, F.round(F.col("_dd") * 100, 4)).otherwise(zero).alias("max_drawdown_pct"),
        F.round(F.coalesce("_hit", zero), 4).alias("hit_rate"), F.round(F.coalesce("_w", zero), 4).alias("avg_win"),
        F.round(F.coalesce("_l", zero), 4).alias("avg_loss"), "n_trades", F.col("n_trades").alias("turnover"),
    )


def downsample(points: DataFrame, max_points: int = 2000, order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """Evenly spaced points of a long series; all of them when there are few."""
    rows = ordered_prefix(points, order)
    n = points.agg(F.count(F.lit(1)).alias("_n"))
    # row i is picked when some k gives floor(k * (n - 1) / (m - 1)) = i; exact integers
    m1 = max_points - 1
    k = F.expr(f"((row_index - 1) * {m1} + _n - 2) div (_n - 1)")
    hit = F.expr(f"(((row_index - 1) * {m1} + _n - 2) div (_n - 1)) * (_n - 1) div {m1} = row_index - 1")
    keep = F.when(F.col("_n") <= max_points, F.lit(True)).otherwise(hit & (k <= m1))
    return rows.crossJoin(F.broadcast(n)).where(keep).drop("_n", "row_index")


def peak_and_day_start(equity: DataFrame, order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """Running peak equity, and the first equity of the row's session."""
    df = equity.withColumn("session_date", F.to_date("ts"))
    df = carry(df, (), "session_date", order, maxes={"peak_equity": "equity"})
    first = df.groupBy("session_date").agg(F.min_by("equity", F.struct(*order)).alias("day_start_equity"))
    return df.join(first, "session_date")


def pnl_histogram(trades: DataFrame, bins: int = 10) -> DataFrame:
    """Counts in equal bins between the smallest and largest PnL; the last edge is inclusive."""
    edges = trades.agg(F.min("pnl").alias("lo"), F.max("pnl").alias("hi"))
    span = F.col("hi") - F.col("lo")
    edges = edges.select("lo", (F.when(span == 0, 1.0).otherwise(span) / bins).alias("step"))
    b = F.least(F.floor((F.col("pnl") - F.col("lo")) / F.col("step")), F.lit(bins - 1))
    counts = trades.crossJoin(F.broadcast(edges)).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = edges.select("lo", "step", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return all_bins.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("bin_start"), F.coalesce("n", F.lit(0)).alias("n"))


def position_totals(positions: DataFrame) -> DataFrame:
    v = F.col("qty") * F.col("mark")
    return positions.agg(
        F.sum((F.col("mark") - F.col("entry_price")) * F.col("qty")).alias("unrealized"), F.sum(F.abs(v)).alias("gross"),
        F.count(F.when(F.col("qty") > 0, 1)).alias("n_long"), F.count(F.when(F.col("qty") < 0, 1)).alias("n_short"),
    )


def signal_health(trades: DataFrame, previous: DataFrame, as_of: Column, days: int = 30, min_trades: int = 5, hit_floor: float = 0.5) -> DataFrame:
    """Attributed hit rate and PnL per signal; a degraded signal is halved, never raised again here.

    ``trades.signal_scores`` is map<string,string> (number or object per signal).
    """
    recent = trades.where(F.col("exit_ts") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    parts = F.transform_values("signal_scores", lambda k, v: F.abs(F.coalesce(contribution(v), F.lit(0.0))))
    total = F.aggregate(F.map_values("_p"), F.lit(0.0), lambda a, x: a + x)
    rows = recent.withColumn("_p", parts).withColumn("_t", total).where("_t > 0").select("pnl", "_t", F.explode("_p").alias("signal", "c"))
    share = rows.select("signal", (F.col("pnl") * F.col("c") / F.col("_t")).alias("x"))
    stats = share.groupBy("signal").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("x") > 0).cast("double")).alias("rolling_hit_rate"), F.sum("x").alias("attributed_pnl"))
    bad = (F.col("rolling_hit_rate") < hit_floor) | (F.col("attributed_pnl") < 0)
    prev = F.coalesce("weight_multiplier", F.lit(1.0))
    judged = stats.where(F.col("n") >= min_trades).join(previous.select("signal", "weight_multiplier"), "signal", "left")
    return judged.select(
        "signal", "n", "rolling_hit_rate", "attributed_pnl", F.when(bad, 0.5).otherwise(prev).alias("weight_multiplier"), bad.alias("flagged_for_retrain")
    )


# ---------------------------------------------------------------- reports
def account_report(equity: DataFrame, state: DataFrame) -> DataFrame:
    last = equity.agg(*[F.coalesce(F.max_by(c, "id"), F.lit(0.0)).alias(c) for c in ("equity", "cash", "gross_exposure")])
    row = last.crossJoin(F.broadcast(state.select("day_start_equity")))  # single rows
    day = F.when(F.col("day_start_equity") != 0, F.col("equity") - F.col("day_start_equity")).otherwise(0.0)
    pct = F.coalesce(F.round(ratio(day, "day_start_equity") * 100, 4), F.lit(0.0))
    return row.select("equity", "cash", "gross_exposure", F.round(day, 2).alias("day_pnl"), pct.alias("day_pnl_pct"), F.col("cash").alias("buying_power"))


def newest(rows: DataFrame, limit: int, order: Sequence[Column], where: Column | None = None) -> DataFrame:
    """Newest rows first (orders by status, rejections, health rows, trades)."""
    return (rows if where is None else rows.where(where)).orderBy(*order).limit(limit)


def trades_report(trades: DataFrame, since: Column | None = None, limit: int | None = None) -> DataFrame:
    df = trades if since is None else trades.where(F.col("exit_ts") >= since)
    held = (F.unix_micros("exit_ts") - F.unix_micros("entry_ts")) / 1e6
    df = df.select("id", "symbol", "side", "qty", "entry_ts", "exit_ts", "entry_price", "exit_price", F.round("pnl", 2).alias("pnl"), held.alias("holding_seconds"))
    df = df.orderBy(F.desc("exit_ts"), "id", "symbol", "pnl")
    return df if limit is None else df.limit(limit)


def trades_today(trades: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(closed trades since local midnight, their one-row summary)."""
    rows = trades_report(trades, local_midnight_utc(now), None)
    win, zero = F.col("pnl") > 0, F.lit(0.0)
    summary = rows.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("pnl"), zero), 2).alias("total_pnl"),
        F.round(F.coalesce(F.avg(win.cast("double")), zero), 4).alias("hit_rate"),
        F.round(F.coalesce(F.avg(F.when(win, F.col("pnl"))), zero), 2).alias("avg_win"),
        F.round(F.coalesce(F.avg(F.when(~win, F.col("pnl"))), zero), 2).alias("avg_loss"),
    )
    return rows, summary


def in_range(rows: DataFrame, now: Column, span: str, ts: str = "ts") -> DataFrame:
    """Rows of the last 1d / 1w / 1m, or all."""
    days = {"1d": 1, "1w": 7, "1m": 30, "all": None}[span]
    return rows if days is None else rows.where(F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS"))


def latest_per_symbol(signals: DataFrame, recent: int | None = None, by: str = "id") -> DataFrame:
    """Newest row per symbol, of all rows or of the ``recent`` newest, strongest signal first."""
    top = signals if recent is None else signals.orderBy(F.desc(by)).limit(recent)
    newest_row = F.max_by(F.struct(*signals.columns), by).alias("_row")
    return top.groupBy("symbol").agg(newest_row).select("_row.*").orderBy(F.desc(F.abs("ensemble")), "symbol")


def position_snapshot(positions: DataFrame, now: Column) -> DataFrame:
    return positions.select(
        "symbol", "qty", F.when(F.col("qty") > 0, "long").otherwise("short").alias("side"), "entry_price", "mark",
        (F.col("qty") * F.col("mark")).alias("market_value"), ((F.col("mark") - F.col("entry_price")) * F.col("qty")).alias("unrealized"),
        ((F.unix_micros(now) - F.unix_micros("entry_ts")) / 1e6).alias("age_s"),
    )


def engine_status(state: DataFrame, now: Column) -> DataFrame:
    age = (F.unix_micros(now) - F.unix_micros("heartbeat_ts")) / 1e6
    return state.select("status", "tier", "halted_reason", age.alias("heartbeat_age_s"), "last_data_ts", F.coalesce(age < 30, F.lit(False)).alias("heartbeat_fresh"))


def chart_series(equity: DataFrame) -> DataFrame:
    """Last equity per second; points older than the newest one already shown are ignored by arrival order."""
    df = equity.withColumn("_day", F.to_date("ts"))
    df = carry(df.withColumn("_arrival_day", F.floor(F.col("id") / 100_000)), (), "_arrival_day", ["id"], maxes={"_shown": "ts"}, include_current=False)
    fresh = df.where(F.col("_shown").isNull() | (F.date_trunc("second", "ts") >= F.date_trunc("second", "_shown")))
    return fresh.groupBy(F.date_trunc("second", "ts").alias("second")).agg(F.max_by("equity", F.struct("ts", "id")).alias("equity"))


def promotion_gate(trades: DataFrame, slippage: DataFrame, quote_age: DataFrame, min_sessions: int = 20, min_days: int = 28, worst_multiple: float = 2.0, slip_tolerance: float = 0.25, max_p95_s: float = 5.0) -> DataFrame:
    """One row of documented go-live checks: sessions, span, net result, worst day, slippage, quote age."""
    days = trades.groupBy(F.to_date("exit_ts").alias("d")).agg(F.sum("pnl").alias("p"))
    agg = days.agg(
        F.count(F.lit(1)).alias("sessions"), F.datediff(F.max("d"), F.min("d")).alias("span_days"), F.sum("p").alias("net"),
        F.min("p").alias("worst"), F.avg(F.when(F.col("p") > 0, F.col("p"))).alias("avg_win"),
    )
    slip = slippage.agg(F.avg("realized").alias("_real"), F.avg("modelled").alias("_model"))
    row = agg.crossJoin(slip).crossJoin(quote_age.agg(F.max("p95").alias("p95_quote_age_s")))  # single rows
    ok = {
        "enough_sessions": (F.col("sessions") >= min_sessions) & (F.col("span_days") >= min_days),
        "net_positive": F.col("net") > 0,
        "worst_ok": F.coalesce(F.col("worst") >= -worst_multiple * F.col("avg_win"), F.lit(False)),
        "slippage_ok": F.coalesce(F.abs(F.col("_real") - F.col("_model")) <= slip_tolerance * F.abs("_model"), F.lit(False)),
        "quotes_ok": F.coalesce(F.col("p95_quote_age_s") < max_p95_s, F.lit(False)),
    }
    every = F.lit(True)
    for c in ok.values():
        every = every & c
    return row.select("sessions", "span_days", "net", "worst", *[c.alias(n) for n, c in ok.items()], every.alias("promote"))


def equity_changes(equity: DataFrame, after_id: int) -> DataFrame:
    """Change feed: equity rows newer than an id."""
    return equity.where(F.col("id") > after_id).orderBy("id")


def status_changes(states: DataFrame, order: str = "seq", by: str = "engine") -> DataFrame:
    """Rows where an engine's status differs from its previous row."""
    rows = with_row_halo(states, [by], [order], 1)
    prev = F.lag("status", 1).over(Window.partitionBy(by, "chunk").orderBy("row_index"))
    changed = rows.withColumn("previous", prev).where(~F.col("is_halo") & ~F.col("status").eqNullSafe(F.col("previous")))
    return changed.drop("row_index", "chunk", "is_halo")

"""Ticks to bars: right-closed NBBO bars, microstructure bars and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.config import BarSpec
from tapeloom.functions.ordered import carry, fill_ranges
from tapeloom.functions.scalar import ceil_time, floor_time, good_quote, local_date, local_second, micros, plus_seconds, ratio
from tapeloom.functions.session_scan import scan_sessions
from tapeloom.functions.sorted_window import WindowQuantile

KEY = ("symbol", "session_date")
QUOTE_COLS = ("bid", "ask", "bid_size", "ask_size")


def session_window(keys: Sequence[str] = KEY, order: str = "ts") -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def regular_hours(df: DataFrame, spec: BarSpec = BarSpec(), ts: str = "ts", last_inclusive: bool = False) -> DataFrame:
    """Keep rows whose local time of day is in [open, close) (or [open, close])."""
    s = local_second(ts, spec.zone)
    upper = s <= spec.close_s if last_inclusive else s < spec.close_s
    return df.where((s >= spec.open_s) & upper)


def clean_quotes(quotes: DataFrame) -> DataFrame:
    """Drop crossed and degenerate quotes."""
    return quotes.where(good_quote())


def second_bars(trades: DataFrame, quotes: DataFrame | None, spec: BarSpec = BarSpec()) -> DataFrame:
    """Fixed-interval bars on a gap-free grid with the quote as of the bar close.

    Label T covers (T - interval, T]. Ticks are reduced to one row per occupied
    label by a single partially aggregated group-by (a hot symbol's ticks are
    combined map-side). Each occupied label then generates the empty labels up
    to the next one, so the grid needs no join; the grid runs from the first to
    the last *trade* label of the session and the hours filter comes last.
    """
    step = spec.interval_s
    stamp = F.struct("ts", "seq")
    nul = F.lit(None).cast("double")
    label = ceil_time("ts", step)
    both = trades.select(
        "symbol", label.alias("label"), stamp.alias("o"), "price", "size",
        *[nul.alias(c) for c in QUOTE_COLS], F.lit(None).cast(trades.select(stamp.alias("o")).schema["o"].dataType).alias("qo"),
    )
    if quotes is not None:
        q = clean_quotes(quotes).select(
            "symbol", label.alias("label"), F.lit(None).cast(both.schema["o"].dataType).alias("o"), nul.alias("price"), nul.alias("size"),
            F.col("bid_price").alias("bid"), F.col("ask_price").alias("ask"), "bid_size", "ask_size", stamp.alias("qo"),
        )
        both = both.unionByName(q)
    quote = F.struct(*QUOTE_COLS)
    occupied = (
        both.withColumn("session_date", local_date("label", spec.zone))
        .groupBy(*KEY, "label")
        .agg(
            F.min_by("price", "o").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "o").alias("close"),
            F.sum("size").alias("volume"),
            F.count("price").alias("n"),
            F.sum(F.col("price") * F.col("size")).alias("notional"),
            F.max_by(quote, "qo").alias("q"),
        )
    )
    whole = Window.partitionBy(*KEY)
    w = Window.partitionBy(*KEY).orderBy("label")
    traded = F.when(F.col("n") > 0, F.col("label"))
    bounded = occupied.select(
        "*", F.min(traded).over(whole).alias("g0"), F.max(traded).over(whole).alias("g1")
    ).where(F.col("label").between(F.col("g0"), F.col("g1")))
    last_fill = F.coalesce(plus_seconds(F.lead("label").over(w), -step), F.col("label"))
    grid = bounded.withColumn("until", last_fill).select(
        "*", F.explode(F.expr(f"sequence(label, until, interval {step} seconds)")).alias("ts")
    )
    here = F.col("ts") == F.col("label")

    def own(c: str) -> Column:
        return F.when(here, F.col(c))

    filled = session_window().rowsBetween(-spec.stale_rows, 0)
    bars = grid.select(
        *KEY, "ts",
        *[own(c).alias(c) for c in ("open", "high", "low", "close")],
        F.coalesce(own("volume"), F.lit(0.0)).alias("volume"),
        F.coalesce(own("n"), F.lit(0)).cast("double").alias("n_trades"),
        own("notional").alias("notional"),
        own("q").alias("q"),
    ).withColumn("q", F.last("q", ignorenulls=True).over(filled))
    bars = bars.select(
        *KEY, "ts", "open", "high", "low", "close", "volume", "n_trades",
        ratio("notional", "volume").alias("vwap"),
        *[F.col(f"q.{c}").alias(c) for c in QUOTE_COLS],
    ).withColumn("spread", F.col("ask") - F.col("bid"))
    return regular_hours(bars, spec)


def _tick_tape(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """Trades and quotes in arrival order; a quote at a trade's instant comes first."""
    nul = F.lit(None).cast("double")
    q = quotes.select(
        "symbol", "ts", "seq", F.lit(0).alias("kind"), nul.alias("price"), nul.alias("size"), "bid_price", "ask_price", "bid_size", "ask_size"
    )
    t = trades.select(
        "symbol", "ts", "seq", F.lit(1).alias("kind"), "price", "size", *[nul.alias(c) for c in ("bid_price", "ask_price", "bid_size", "ask_size")]
    )
    return q.unionByName(t)


def prevailing_quotes(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """Backward as-of join without tolerance: the last quote and last price before each trade.

    Union-and-fill instead of a range join. The tape is shuffled once, into ranges of
    equal row counts; the last values before a range are handed to it, so a busy hour of
    a hot symbol is spread over many tasks.
    """
    tape = _tick_tape(trades, quotes)
    last = {"_bid": "bid_price", "_ask": "ask_price", "last_price": "price"}
    tape = fill_ranges(tape, ["symbol"], ["ts", "kind", "seq"], last)
    tape = tape.withColumn("last_bid", F.coalesce("bid_price", "_bid")).withColumn("last_ask", F.coalesce("ask_price", "_ask"))
    return tape.drop("_bid", "_ask")


def trade_sign(price: str = "price") -> Column:
    """+1 at or above the ask, -1 at or below the bid, else the tick rule; 0 when undecided."""
    p, bid, ask, prev = F.col(price), F.col("last_bid"), F.col("last_ask"), F.col("last_price")
    return (
        F.when((ask > 0) & (p >= ask), 1)
        .when((bid > 0) & (p <= bid), -1)
        .when(p > prev, 1)
        .when(p < prev, -1)
        .otherwise(0)
    )


def microstructure_bars(trades: DataFrame, quotes: DataFrame, interval_s: int = 60) -> DataFrame:
    """Left-labelled bars with signed flow, mean spread and mean quote imbalance."""
    tape = prevailing_quotes(trades, quotes).withColumn("ts_open", floor_time("ts", interval_s))
    is_trade = F.col("kind") == 1
    sign = F.when(is_trade, trade_sign())
    o = F.when(is_trade, F.struct("ts", "kind", "seq"))
    two_sided = (F.col("ask_price") > 0) & (F.col("bid_price") > 0)
    depth = F.col("bid_size") + F.col("ask_size")
    agg = tape.groupBy("symbol", "ts_open").agg(
        F.min_by("price", o).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", o).alias("close"),
        F.sum("size").alias("volume"),
        F.sum(F.col("price") * F.col("size")).alias("notional"),
        F.count("price").alias("trade_count"),
        F.avg(F.when(two_sided, F.col("ask_price") - F.col("bid_price"))).alias("mean_spread"),
        F.avg(F.when(depth > 0, (F.col("bid_size") - F.col("ask_size")) / depth)).alias("mean_quote_imbalance"),
        F.sum(F.when(sign > 0, F.col("size"))).alias("buy"),
        F.sum(F.when(sign < 0, F.col("size"))).alias("sell"),
    )
    buy, sell = F.coalesce("buy", F.lit(0.0)), F.coalesce("sell", F.lit(0.0))
    return agg.where(F.col("trade_count") > 0).select(
        "symbol",
        F.col("ts_open").alias("ts"),
        F.lit(interval_s).alias("interval_s"),
        "open", "high", "low", "close", "volume",
        F.coalesce(ratio("notional", "volume"), F.col("close")).alias("vwap"),
        "trade_count",
        F.coalesce("mean_spread", F.lit(0.0)).alias("mean_spread"),
        F.coalesce("mean_quote_imbalance", F.lit(0.0)).alias("mean_quote_imbalance"),
        F.coalesce(ratio(buy - sell, buy + sell), F.lit(0.0)).alias("flow_imbalance"),
    )


def combine_bars(bars: DataFrame, keys: Sequence[str], interval_s: int, order: str = "ts") -> DataFrame:
    """Roll several finalized bars into one per key; imbalances averaged over informative bars."""
    spread_n = F.greatest(F.count(F.when(F.col("mean_spread") > 0, 1)), F.lit(1))
    imb_n = F.greatest(F.count(F.when(F.col("mean_quote_imbalance") != 0.0, 1)), F.lit(1))
    vol = F.sum("volume")
    return bars.groupBy(*keys).agg(
        F.min(order).alias("ts"),
        F.lit(interval_s).alias("interval_s"),
        F.min_by("open", order).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", order).alias("close"),
        vol.alias("volume"),
        F.coalesce(F.try_divide(F.sum(F.col("vwap") * F.col("volume")), vol), F.max_by("close", order)).alias("vwap"),
        F.sum("trade_count").alias("trade_count"),
        (F.sum("mean_spread") / spread_n).alias("mean_spread"),
        (F.sum("mean_quote_imbalance") / imb_n).alias("mean_quote_imbalance"),
        F.coalesce(F.try_divide(F.sum(F.col("flow_imbalance") * F.col("volume")), vol), F.lit(0.0)).alias("flow_imbalance"),
        F.count(F.lit(1)).alias("n_bars"),
    )


def rolled_bars(bars: DataFrame, count: int = 5, interval_s: int = 300, keys: Sequence[str] = KEY) -> DataFrame:
    """Every ``count`` consecutive bars become one (by count, not by clock); a short tail is dropped."""
    w = Window.partitionBy(*keys).orderBy("ts")
    grouped = bars.withColumn("bar_group", F.floor((F.row_number().over(w) - 1) / count))
    out = combine_bars(grouped, [*keys, "bar_group"], interval_s)
    return out.where(F.col("n_bars") == count).drop("n_bars")


def enriched_bars(official: DataFrame, trades: DataFrame, quotes: DataFrame, interval_s: int) -> DataFrame:
    """Official OHLCV bars with the tick statistics of their interval; zeros when there were no ticks."""
    tape = prevailing_quotes(trades, quotes).withColumn("bar", floor_time("ts", interval_s))
    sign = F.when(F.col("kind") == 1, trade_sign())
    depth = F.col("bid_size") + F.col("ask_size")
    stats = tape.groupBy("symbol", F.col("bar").alias("ts")).agg(
        F.avg(F.when(good_quote() & (F.col("ask_price") > F.col("bid_price")), F.col("ask_price") - F.col("bid_price"))).alias("mean_spread"),
        F.avg(F.when(depth > 0, (F.col("bid_size") - F.col("ask_size")) / depth)).alias("mean_quote_imbalance"),
        F.coalesce(F.sum(F.when(sign > 0, F.col("size"))), F.lit(0.0)).alias("buy"),
        F.coalesce(F.sum(F.when(sign < 0, F.col("size"))), F.lit(0.0)).alias("sell"),
    )
    zero = F.lit(0.0)
    return official.join(stats, ["symbol", "ts"], "left").select(
        *[official[c] for c in official.columns],
        F.coalesce("mean_spread", zero).alias("mean_spread"),
        F.coalesce("mean_quote_imbalance", zero).alias("mean_quote_imbalance"),
        F.coalesce(ratio(F.col("buy") - F.col("sell"), F.col("buy") + F.col("sell")), zero).alias("flow_imbalance"),
    )


def last_close_per_utc_day(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.max_by("close", "ts").alias("close"))


def quote_gaps(quotes: DataFrame, window_s: int = 300, chunk_s: int = 3600) -> DataFrame:
    """Gap to the newest earlier quote stamp, with p50/p95 over the trailing arrival window.

    Quotes arrive in (recv_ts, seq) order; an out-of-order stamp gives no gap and
    does not move the newest stamp. A chunk holds its arrivals and those of the window
    before them; its window slides in order, one binary search per arrival.
    """
    tape = quotes.withColumn("chunk_ts", floor_time("recv_ts", chunk_s))
    tape = carry(tape, ["symbol"], "chunk_ts", ["recv_ts", "seq"], maxes={"newest": "quote_ts"}, include_current=False)
    gap = (micros("quote_ts") - micros("newest")) / 1e6
    tape = tape.withColumn("gap_s", F.when(gap >= 0, gap))
    own = F.col("chunk_ts")
    reach = -(-window_s // chunk_s)  # later chunks whose first rows still look back at this row
    later = [F.when(micros(plus_seconds(own, (k + 1) * chunk_s)) - micros("recv_ts") <= window_s * 1_000_000, plus_seconds(own, (k + 1) * chunk_s)) for k in range(reach)]
    halo = tape.withColumn("home", own).withColumn("chunk_ts", F.explode(F.array_compact(F.array(own, *later))))
    steps = [WindowQuantile(f"gap_p{round(100 * q)}", "gap_s", "recv_ts", "seq", window_s * 1_000_000, q, (p,)) for q, p in ((0.5, 0.95), (0.95, 0.5))]
    out = scan_sessions(halo, ["symbol", "chunk_ts"], "recv_ts", steps)
    return out.where(F.col("chunk_ts") == F.col("home")).drop("chunk_ts", "home")

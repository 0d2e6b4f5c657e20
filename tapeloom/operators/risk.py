"""Rule screens over intents, accounts, errors, brackets and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.config import ScalpConfig, StalenessConfig, TierConfig
from tapeloom.functions.ordered import carry, with_row_halo
from tapeloom.functions.scalar import micros, ratio
from tapeloom.functions.session_scan import At, FirstTouch, RowsUntil, scan_sessions

CENT = 1e-6


def exposures(positions: DataFrame) -> DataFrame:
    """Gross, unrealised PnL and cost basis per book, with the count of positions."""
    value = F.col("qty") * F.col("mark")
    return positions.groupBy("book").agg(
        F.sum(F.abs(value)).alias("gross"),
        F.sum((F.col("mark") - F.col("entry_price")) * F.col("qty")).alias("unrealized"),
        F.sum(F.abs(F.col("qty") * F.col("entry_price"))).alias("cost_basis"),
        F.count(F.lit(1)).alias("n_positions"),
    )


def account_ratios(account: DataFrame, positions: DataFrame) -> DataFrame:
    """Add day PnL, day PnL %, intraday-book day PnL % and drawdown to the account row."""
    zero = F.lit(0.0)
    intraday = exposures(positions.where("book = 'intraday'")).agg(F.coalesce(F.sum("unrealized"), zero).alias("_u"), F.coalesce(F.sum("n_positions"), F.lit(0)).alias("intraday_positions"))
    gross = positions.agg(F.coalesce(F.sum(F.abs(F.col("qty") * F.col("mark"))), zero).alias("gross_exposure"))
    df = account.crossJoin(F.broadcast(intraday)).crossJoin(F.broadcast(gross))  # single rows
    day = F.when(F.col("day_start_equity") != 0, F.col("equity") - F.col("day_start_equity")).otherwise(zero)
    return df.select(
        *account.columns, "gross_exposure", "intraday_positions", day.alias("day_pnl"),
        F.coalesce(ratio(day, "day_start_equity"), zero).alias("day_pnl_pct"),
        F.coalesce(ratio(F.col("intraday_realized") + F.col("_u"), "day_start_equity"), zero).alias("intraday_day_pnl_pct"),
        F.when(F.col("peak_equity") > 0, F.greatest(zero, (F.col("peak_equity") - F.col("equity")) / F.col("peak_equity"))).otherwise(zero).alias("drawdown_pct"),
    )


def _signed(qty: str = "qty", side: str = "side") -> Column:
    return F.when(F.col(side) == "buy", F.col(qty)).otherwise(-F.col(qty))


def screen_intents(
    intents: DataFrame, positions: DataFrame, account: DataFrame, tier: TierConfig, universe: DataFrame,
    symbol_pnl: DataFrame | None = None, scalp: ScalpConfig | None = None,
) -> DataFrame:
    """First failing rule per intent as ``reason``; NULL means approved.

    Every intent is screened against the same state (headroom is not consumed
    in sequence). ``account`` is one row; ``universe`` lists the tradable symbols;
    intents carry ``in_entry_window``.
    """
    pos = positions.select(
        "symbol", F.col("qty").alias("_q"), (F.col("qty") * F.col("mark")).alias("_value"), F.col("book").alias("_pos_book"),
        F.lit(True).alias("_held"),
    )
    books = exposures(positions).select("book", F.col("gross").alias("_book_gross"))
    acct = account_ratios(account, positions)
    own = [c for c in acct.columns]
    df = intents.join(pos, "symbol", "left").join(F.broadcast(books), "book", "left").crossJoin(F.broadcast(acct))  # one account row
    df = df.join(universe.select("symbol").distinct().withColumn("_listed", F.lit(True)), "symbol", "left")
    if symbol_pnl is not None:
        df = df.join(symbol_pnl.select("symbol", F.col("realized").alias("_sym_pnl")), "symbol", "left")
    else:
        df = df.withColumn("_sym_pnl", F.lit(0.0))
    cur, zero = F.coalesce("_q", F.lit(0)), F.lit(0.0)
    after = cur + _signed()
    entry = F.abs(after) > F.abs(cur)
    value = F.abs(after * F.col("price_hint"))
    gross = F.coalesce("_book_gross", zero) - F.abs(F.coalesce("_value", zero)) + value
    new = ~F.coalesce(F.col("_held") & (F.col("_pos_book") == "intraday"), F.lit(False))
    rules: list[tuple[Column, Column]] = [
        (F.col("halted"), F.lit("engine HALTED")),
        (F.col("qty") <= 0, F.lit("non-positive quantity")),
        (F.coalesce((cur != 0) & (F.col("_pos_book") != F.col("book")), F.lit(False)), F.concat(F.lit("symbol held by "), F.col("_pos_book"), F.lit(" book"))),
        ((F.col("book") == "intraday") & F.col("_listed").isNull(), F.concat(F.lit("symbol "), F.col("symbol"), F.lit(" not in tier universe"))),
        (entry & F.col("intraday_halted"), F.lit("intraday book halted")),
    ]
    if scalp is not None:
        rules += [
            (entry & ~F.col("price_hint").between(scalp.price_min, scalp.price_max), F.lit("outside scalp price band")),
            (entry & (F.coalesce("_sym_pnl", zero) <= -scalp.per_symbol_loss_cap_pct * F.col("equity")), F.lit("per-symbol loss cap")),
            (entry & new & (F.col("intraday_positions") >= scalp.max_open_scalps), F.lit("max concurrent scalps")),
        ]
    rules += [
        (entry & (after < 0) & F.lit(not tier.allow_short), F.lit("shorting not allowed in this tier")),
        (entry & (value > tier.max_position_pct * F.col("equity") + CENT), F.lit("exceeds max position size")),
        (entry & (gross > tier.max_gross_pct * F.col("equity") + CENT), F.lit("exceeds max gross exposure")),
        (entry & new & (F.col("intraday_positions") >= tier.max_open_positions), F.lit("exceeds max open positions")),
        (entry & (F.col("intraday_day_pnl_pct") <= -tier.daily_loss_limit_pct), F.lit("daily loss limit reached")),
        (entry & (F.col("drawdown_pct") >= tier.max_drawdown_pct), F.lit("account drawdown floor reached")),
        (entry & ~F.col("in_entry_window"), F.lit("outside entry window")),
    ]
    reason = None
    for cond, text in rules:
        reason = F.when(cond, text) if reason is None else reason.when(cond, text)
    hidden = [c for c in df.columns if c.startswith("_")]
    return df.withColumn("reason", reason).drop(*hidden, *[c for c in own if c not in intents.columns])


def screen_exits(intents: DataFrame, positions: DataFrame) -> DataFrame:
    """Exits need a positive quantity and must not increase exposure."""
    df = intents.join(positions.select("symbol", F.col("qty").alias("_q")), "symbol", "left")
    cur = F.coalesce("_q", F.lit(0))
    grows = F.abs(cur + _signed()) > F.abs(cur)
    reason = F.when(F.col("qty") <= 0, "non-positive quantity").when(grows, "exit path used for an exposure-increasing order")
    return df.withColumn("reason", reason).drop("_q")


def account_triggers(snapshots: DataFrame, tier: TierConfig, min_equity: float | None = None, stale_kill_s: float = 180.0) -> DataFrame:
    """(scope, trigger) of each account snapshot in rule order; NULL when nothing fired.

    Snapshots carry equity, peak_equity, day_start_equity, intraday_day_pnl_pct,
    data_age_s and session_open.
    """
    dd = F.when(F.col("peak_equity") > 0, F.greatest(F.lit(0.0), 1.0 - F.col("equity") / F.col("peak_equity"))).otherwise(0.0)
    floor = F.lit(False) if min_equity is None else (F.col("equity") > 0) & (F.col("equity") < min_equity)
    loss = (F.col("day_start_equity") > 0) & (F.col("intraday_day_pnl_pct") <= -tier.daily_loss_limit_pct)
    stale = F.col("session_open") & (F.col("data_age_s") > stale_kill_s)
    kind = F.when(floor, "equity floor").when(dd >= tier.max_drawdown_pct, "account drawdown floor").when(loss, "intraday daily loss").when(stale, "data staleness")
    scope = F.when(kind.isin("equity floor", "account drawdown floor"), "account").when(kind.isNotNull(), "intraday")
    return snapshots.withColumn("drawdown_pct", dd).withColumn("trigger", kind).withColumn("scope", scope)


def error_bursts(errors: DataFrame, n: int = 5, window_s: float = 60.0, order: tuple[str, ...] = ("ts", "seq"), chunk_rows: int = 200_000) -> DataFrame:
    """Errors that complete a burst: the n-th last one lies within the window.

    The log is one global sequence, so it is cut into row chunks with n - 1
    copied rows instead of being ordered in a single task.
    """
    rows = with_row_halo(errors, (), order, n - 1, chunk_rows=chunk_rows)
    w = Window.partitionBy("chunk").orderBy("row_index")
    age = micros("ts") - micros(F.lag("ts", n - 1).over(w))
    fired = F.coalesce(age <= F.lit(window_s * 1e6), F.lit(False))
    return rows.withColumn("burst", fired).where("not is_halo").drop("chunk", "is_halo", "row_index")


def staleness_class(age: Column, cfg: StalenessConfig = StalenessConfig()) -> Column:
    return F.when(age > cfg.kill_s, "kill").when(age > cfg.pause_s, "pause").otherwise("ok")


def staleness_snapshot(gaps: DataFrame, as_of: Column, cfg: StalenessConfig = StalenessConfig()) -> DataFrame:
    """Per symbol: age of the newest quote and its latest gap percentiles; ``worst`` over all symbols."""
    key = F.struct("recv_ts", "seq")
    age = (F.unix_micros(as_of) - F.unix_micros(F.max("quote_ts"))) / 1e6
    per = gaps.groupBy("symbol").agg(age.alias("age_s"), F.max_by("gap_p50", key).alias("p50_gap_s"), F.max_by("gap_p95", key).alias("p95_gap_s"))
    worst = per.agg(staleness_class(F.max("age_s"), cfg).alias("worst"))
    return per.crossJoin(F.broadcast(worst))  # one row


def bracket_actions(brackets: DataFrame, quotes: DataFrame, chunk_s: int = 3600) -> DataFrame:
    """First trigger of each armed bracket: stop at or under the stop price, else timeout at the deadline.

    No bracket-by-quote pairs are formed. The lowest bid of every time chunk says in which
    chunk after its own a bracket can first be hit, so it joins the tape of two chunks at
    most, however long it lives, and finds its touch there by block minima. The first
    quote at or after the deadline comes from a backward-carried value.
    """
    size = chunk_s * 1_000_000
    q = quotes.groupBy("symbol", "ts").agg(F.min("bid").alias("bid")).withColumn("us", micros("ts"))
    br = brackets.select(
        "bracket_id", "symbol", "qty", "stop_px", "deadline", micros("armed_ts").alias("armed_us"), micros("deadline").alias("due_us")
    )
    own = F.floor(F.col("armed_us") / size)
    last = F.floor((F.greatest("due_us", F.col("armed_us") + 1) - 1) / size)
    lows = q.groupBy("symbol", F.floor(F.col("us") / size).alias("chunk")).agg(F.min("bid").alias("low"))
    later = br.where(last > own).select("bracket_id", "symbol", "stop_px", F.explode(F.sequence(own + 1, last)).alias("chunk")).join(lows, ["symbol", "chunk"])
    reach = later.where("low <= stop_px").groupBy("bracket_id").agg(F.min("chunk").alias("_next"))
    lives = br.join(reach, "bracket_id", "left").select("*", F.explode(F.array_compact(F.array(own, "_next"))).alias("chunk"))
    nul = F.lit(None)
    asked = lives.select(
        "symbol", "chunk", (F.greatest(F.col("armed_us"), F.col("chunk") * size) * 2).alias("slot"), nul.cast("double").alias("bid"), "stop_px",
        (F.col("due_us") * 2 - 1).alias("until"), "bracket_id",
    )
    shown = q.select(
        "symbol", F.floor(F.col("us") / size).alias("chunk"), (F.col("us") * 2 + 1).alias("slot"), "bid", nul.cast("double").alias("stop_px"),
        nul.cast("long").alias("until"), nul.cast(brackets.schema["bracket_id"].dataType).alias("bracket_id"),
    )
    steps = [RowsUntil("_room", "slot", "until"), FirstTouch("_hit_in", "bid", "stop_px", "le", "_room"), At("_hit_slot", "slot", "_hit_in", T.LongType())]
    touched = scan_sessions(asked.unionByName(shown), ["symbol", "chunk"], "slot", steps)
    stops = touched.where("_hit_slot is not null").groupBy("bracket_id").agg(F.min((F.col("_hit_slot") - 1) / 2).cast("long").alias("_stop_us"))
    due = br.select("symbol", F.col("due_us").alias("us"), nul.cast("double").alias("bid"), "bracket_id")
    tape = q.select("symbol", "us", "bid", nul.cast(brackets.schema["bracket_id"].dataType).alias("bracket_id")).unionByName(due)
    tape = tape.select("*", (-F.floor(F.col("us") / size)).alias("chunk"), (-F.col("us")).alias("_t"), F.col("bracket_id").isNotNull().cast("int").alias("_k"))
    tape = tape.withColumn("_q", F.when(F.col("_k") == 0, F.struct("us", "bid")))
    tape = carry(tape, ["symbol"], "chunk", ["_t", "_k", "bracket_id"], last={"_next": "_q"})
    late = tape.where("_k = 1").select("bracket_id", F.col("_next.us").alias("_late_us"), F.col("_next.bid").alias("_late_bid"))
    df = br.join(stops, "bracket_id", "left").join(late, "bracket_id", "left")
    stopped = F.col("_stop_us").isNotNull() | (F.col("_late_bid") <= F.col("stop_px"))
    when = F.coalesce("_stop_us", "_late_us")
    return df.where(when.isNotNull()).select(
        "bracket_id", "symbol", "qty", F.when(stopped, "stop").otherwise("timeout").alias("kind"), F.timestamp_micros(when).alias("ts")
    )


def reconcile(broker: DataFrame, own: DataFrame) -> DataFrame:
    """Broker positions win: adopt, drop, fix quantity, or refresh the mark."""
    b = broker.select("symbol", F.col("qty").alias("b_qty"), F.col("entry_price").alias("b_entry"), F.col("mark").alias("b_mark"))
    o = own.select("symbol", F.col("qty").alias("o_qty"), F.col("entry_price").alias("o_entry"), F.col("mark").alias("o_mark"))
    df = b.join(o, "symbol", "full_outer")
    adopt, gone = F.col("o_qty").isNull(), F.col("b_qty").isNull()
    differs = F.col("b_qty") != F.col("o_qty")
    action = F.when(adopt, "adopt").when(gone, "drop").when(differs, "qty_mismatch").otherwise("mark_refresh")
    mark = F.when(adopt, F.coalesce(F.nullif("b_mark", F.lit(0.0)), "b_entry")).otherwise(F.coalesce(F.nullif("b_mark", F.lit(0.0)), "o_mark"))
    return df.select(
        "symbol", action.alias("action"), F.when(~gone, F.col("b_qty")).alias("qty"),
        F.when(~gone, F.when(adopt | differs, F.col("b_entry")).otherwise(F.col("o_entry"))).alias("entry_price"), F.when(~gone, mark).alias("mark"),
    )


def subscription_plan(symbols: DataFrame, limit: int = 30, package: int = 3) -> DataFrame:
    """Which feeds each symbol gets inside the budget; ``symbols`` has position and is_context.

    Traded names take full packages in order; remaining units become bars, for
    context names first. Only the first ``limit`` of each class can get anything.
    """
    pos = F.row_number().over(Window.partitionBy("is_context").orderBy("position", "symbol"))
    ranked = symbols.select("symbol", "position", "is_context", pos.alias("k"))
    traded = symbols.agg(F.count(F.when(~F.col("is_context"), 1)).alias("_n"), F.count(F.when(F.col("is_context"), 1)).alias("_ctx"))
    df = ranked.where(F.col("k") <= limit).crossJoin(F.broadcast(traded))  # one row
    full = F.least(F.col("_n"), F.lit(limit // package))
    spare = F.lit(limit) - full * package
    own = ~F.col("is_context")
    packaged = own & (F.col("k") <= full)
    bar_rank = F.when(F.col("is_context"), F.col("k")).otherwise(F.col("_ctx") + F.col("k") - full)
    bar = packaged | (bar_rank <= spare)
    got = df.select("symbol", bar.alias("bar"), packaged.alias("quote"), packaged.alias("trade"))
    no = F.lit(False)
    return symbols.select("symbol").join(got, "symbol", "left").select("symbol", *[F.coalesce(c, no).alias(c) for c in ("bar", "quote", "trade")])

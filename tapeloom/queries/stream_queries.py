"""Streaming jobs replayed over the event tables; oracles are the batch results (stream/batch parity)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.config import StalenessConfig
from tapeloom.functions.scalar import plus_seconds
from tapeloom.operators.orders import orders_view
from tapeloom.queries.bar_queries import MICRO, MICRO_COLS, VWAP
from tapeloom.queries.base import BARS, EVENTS, SPEC, query, r, rcols, rounded, with_ctes
from tapeloom.queries.desk_queries import FILLS, GAPS, OEV, TRD, arrivals, order_updates
from tapeloom.sources import driver_tables as tables
from tapeloom.sources.files import scratch_path
from tapeloom.sources.published import read_published
from tapeloom.streaming import feeds, jobs

STREAM_COLS = ["open", "high", "low", "close", "volume", "n_trades", "bid", "ask", "bid_size", "ask_size", "spread"]


def ticks(spark, sf):
    return jobs.tick_stream(tables.trades(spark, sf), tables.quotes(spark, sf))


@query("stream_second_bars", with_ctes(BARS) + f"SELECT symbol, session_date, ts, {rcols(STREAM_COLS)}, {VWAP} FROM bars")
def _bars(spark, sf):
    t = ticks(spark, sf)
    # a clock tick two days later moves the watermark past the last session
    clock = t.orderBy(F.desc("ts")).limit(1).withColumn("ts", plus_seconds("ts", 172800)).withColumn("symbol", F.lit("~clock")).withColumn("kind", F.lit(2))
    out = jobs.run_to_end(jobs.stream_bars(jobs.replay(t.unionByName(clock), "ts"), SPEC))
    last = F.max(F.when(F.col("n_trades") > 0, F.col("ts"))).over(Window.partitionBy("symbol", "session_date"))
    return rounded(out.withColumn("_end", last).where(F.col("ts") <= F.col("_end")).select("symbol", "session_date", "ts", *STREAM_COLS, "vwap"), vwap=9)


@query("stream_signed_bars", with_ctes(MICRO) + f"SELECT symbol, ts, trade_count, {rcols(MICRO_COLS)}, {VWAP} FROM micro")
def _signed(spark, sf):
    t = ticks(spark, sf)
    end = t.groupBy("symbol").agg(F.max("ts").alias("ts")).select("symbol", plus_seconds("ts", 3600).alias("ts"))
    clock = end.select("symbol", "ts", F.lit(-1).cast("long").alias("seq"), F.lit(2).alias("kind"), *[F.lit(None).cast("double").alias(c) for c in ("price", "size", "bid", "ask", "bid_size", "ask_size")])
    out = jobs.run_to_end(jobs.stream_signed_bars(jobs.replay(t.unionByName(clock), "ts"), 600))
    return rounded(out, vwap=9)


@query(
    "stream_quote_gaps",
    with_ctes(GAPS) + f"""SELECT symbol, seq, recv_ts, quote_ts, newest, {r('gap_s', 'gap_s', 8)}, {r('p50', 'gap_p50', 8)}, {r('p95', 'gap_p95', 8)}, {r('age', 'age_s', 8)},
    CASE WHEN age > 1200 THEN 'kill' WHEN age > 600 THEN 'pause' ELSE 'ok' END AS status FROM (SELECT *, (epoch_us(recv_ts) - epoch_us(greatest(newest, quote_ts))) / 1e6 AS age FROM gp)""",
)
def _gaps(spark, sf):
    cfg = StalenessConfig(pause_s=600.0, kill_s=1200.0, window_s=43200)
    return rounded(jobs.run_to_end(jobs.stream_quote_gaps(jobs.replay(arrivals(spark, sf), "recv_ts"), cfg)), 8)


QUIET = StalenessConfig(pause_s=43200.0, kill_s=172800.0)


@query("stream_silence", """WITH a AS (SELECT 'U' || user_id AS feed, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events),
    g AS (SELECT *, (epoch_us(nxt) - epoch_us(ts)) / 1e6 AS gap FROM a), k AS (SELECT *, min(ts) FILTER (gap IS NULL OR gap > 172800) OVER (PARTITION BY feed) AS dead FROM g)
    SELECT feed, ts + INTERVAL 12 HOUR AS ts, 'RUNNING' AS before, 'PAUSED' AS after, 43200.0::DOUBLE AS silent_s FROM k WHERE ts <= dead AND (gap IS NULL OR gap > 43200)
    UNION ALL SELECT feed, nxt, 'PAUSED', 'RUNNING', gap FROM k WHERE ts < dead AND gap > 43200
    UNION ALL SELECT feed, dead + INTERVAL 48 HOUR, 'PAUSED', 'KILLED', 172800.0 FROM k WHERE ts = dead""")
def _silence(spark, sf):
    """Every user is a feed; a clock row long after the last event moves the watermark, no feed sends again."""
    e = tables.table(spark, sf, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("feed"), F.col("ts").cast("timestamp").alias("ts"))
    clock = e.agg(F.max("ts").alias("ts")).select(F.lit("~clock").alias("feed"), plus_seconds("ts", 864000).alias("ts"))
    return jobs.run_to_end(jobs.stream_silence(jobs.replay(e.unionByName(clock), "ts"), QUIET))


@query("stream_transitions", """WITH a AS (SELECT 'U' || user_id % 500 AS feed, event_id AS seq, value AS age_s, min(event_id) FILTER (value > 180) OVER (PARTITION BY user_id % 500) AS dead FROM events),
    b AS (SELECT *, CASE WHEN age_s > 180 THEN 'KILLED' WHEN age_s > 60 THEN 'PAUSED' ELSE 'RUNNING' END AS after FROM a WHERE dead IS NULL OR seq <= dead),
    c AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY feed ORDER BY seq), 'RUNNING') AS before FROM b) SELECT feed, seq, before, after FROM c WHERE before <> after""")
def _transitions(spark, sf):
    e = tables.table(spark, sf, "events").select(F.concat(F.lit("U"), (F.col("user_id") % 500).cast("string")).alias("feed"), F.col("event_id").alias("seq"), F.col("value").alias("age_s"), F.col("ts").cast("timestamp").alias("ts"))
    return jobs.run_to_end(jobs.stream_transitions(jobs.replay(e, "ts")))


BRACKETS = EVENTS + """,
ar AS (SELECT symbol, seq AS bracket_id, CAST(size AS BIGINT) AS qty, price - 0.4 AS stop_px, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY symbol ORDER BY ts, seq) AS nxt FROM trades),
ht AS (SELECT a.*, q.ts, q.seq, CASE WHEN q.bid_price <= stop_px THEN 'stop' ELSE 'timeout' END AS kind FROM ar a JOIN quotes q ON q.symbol = a.symbol AND epoch_us(q.ts) > a.us AND (a.nxt IS NULL OR epoch_us(q.ts) < a.nxt)
  AND (q.bid_price <= stop_px OR epoch_us(q.ts) >= a.us + 1200000000))"""


@query("stream_brackets", with_ctes(BRACKETS) + "SELECT symbol, bracket_id, qty, first(kind ORDER BY ts, seq) AS kind, min(ts) AS ts FROM ht GROUP BY ALL")
def _brackets(spark, sf):
    """Every trade re-arms its symbol's bracket; quotes fire it."""
    us, nul = F.unix_micros("ts"), F.lit(None).cast("double")
    arm = tables.trades(spark, sf).select(
        "symbol", "ts", us.alias("us"), F.lit(0).alias("prio"), "seq", F.lit("arm").alias("kind"), F.col("size").cast("long").alias("qty"), (F.col("price") - 0.4).alias("stop_px"), (us + 1_200_000_000).alias("deadline_us"), nul.alias("bid")
    )
    quote = tables.quotes(spark, sf).select(
        "symbol", "ts", us.alias("us"), F.lit(1).alias("prio"), "seq", F.lit("quote").alias("kind"), F.lit(0).cast("long").alias("qty"), nul.alias("stop_px"), F.lit(0).cast("long").alias("deadline_us"), F.col("bid_price").alias("bid")
    )
    return jobs.run_to_end(jobs.stream_brackets(jobs.replay(arm.unionByName(quote), "ts")))


@query("stream_closed_trades", with_ctes(FILLS, recursive=True) + f"""SELECT symbol, CASE WHEN prev > 0 THEN 'long' ELSE 'short' END AS side, least(abs(delta), abs(prev))::BIGINT AS qty, opened_before AS entry_ts, ts AS exit_ts,
    {r("entry_before + 0.00000314159", "entry_price", 4)}, price AS exit_price, {r("(price - entry_before) * least(abs(delta), abs(prev)) * sign(prev) + 0.00000314159", "pnl", 4)} FROM mt WHERE prev <> 0 AND (prev > 0) <> (delta > 0)""")
def _closed(spark, sf):
    out = jobs.run_to_end(jobs.stream_fills(jobs.replay(tables.fills(spark, sf), "ts")))
    shifted = [(F.col(c) + 0.00000314159).alias(c) if c in ("entry_price", "pnl") else F.col(c) for c in out.columns]
    return rounded(out.select(*shifted), 4)


@query("stream_telemetry", """WITH d AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, value / 600 AS p, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 3 AS qty FROM events), m AS (SELECT max(e.ts) - INTERVAL 10 SECOND AS wm FROM events e)
    SELECT ts, count(*) AS evals, round(max(p), 6) + 0.0 AS max_p, count(*) FILTER (p >= 0.2) AS passed, count(*) FILTER (p >= 0.2 AND qty = 0) AS qty_zero FROM d GROUP BY ts HAVING ts + INTERVAL 1 HOUR <= (SELECT wm FROM m)""")
def _telemetry(spark, sf):
    e = tables.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 600).alias("p_win"), (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 3).alias("qty"))
    return rounded(jobs.run_to_end(jobs.decision_telemetry(jobs.replay(e, "ts"), 0.2, "1 hour")))


@query("stream_equity_feed", with_ctes(TRD) + "SELECT id, ts, equity FROM eq WHERE id > 5000")
def _feed(spark, sf):
    e = tables.equity_snapshots(spark, sf)
    return jobs.run_to_end(jobs.replay(e, "ts").where("id > 5000").select("id", "ts", "equity"))




@query("stream_latest_state", "SELECT user_id, max(event_id) AS event_id, last(ts ORDER BY event_id) AS ts, last(event_type ORDER BY event_id) AS event_type, last(value ORDER BY event_id) AS value, last(props ORDER BY event_id) AS props FROM events GROUP BY user_id")
def _latest(spark, sf):
    """The newest event per user, kept current by upserts of the users a micro-batch touches."""
    e = tables.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path, mark = scratch_path(spark, "latest"), scratch_path(spark, "latest-mark")
    feeds.latest_feed(jobs.replay(e, "ts"), ["user_id"], "event_id", path, mark).awaitTermination()
    return read_published(spark, path).select("user_id", "event_id", "ts", "event_type", "value", "props")


@query("stream_status_changes", "WITH s AS (SELECT o_custkey AS engine, o_orderkey AS seq, o_orderstatus AS status, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders) SELECT * FROM s WHERE status IS DISTINCT FROM previous")
def _status_feed(spark, sf):
    o = tables.table(spark, sf, "orders").select(F.col("o_custkey").alias("engine"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"), F.timestamp_micros("o_orderkey").alias("ts"))
    return jobs.run_to_end(feeds.status_feed(jobs.replay(o, "ts")))


@query("stream_orders", with_ctes(OEV) + "SELECT client_order_id, symbol, side, oo.qty, CASE WHEN e >= m THEN st ELSE status END AS status, coalesce(filled, 0)::BIGINT AS filled_qty, fp AS fill_price FROM oo LEFT JOIN os USING (client_order_id)")
def _order_feed(spark, sf):
    """Upserts and events in one sequence, folded into the order table batch by batch."""
    orders, events = order_updates(spark, sf)
    updates = orders.unionByName(events, allowMissingColumns=True).withColumn("ts", F.timestamp_micros("seq"))
    path, mark = scratch_path(spark, "orders"), scratch_path(spark, "orders-mark")
    feeds.order_feed(jobs.replay(updates, "ts").drop("ts"), path, mark).awaitTermination()
    return orders_view(read_published(spark, path))

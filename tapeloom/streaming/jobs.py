"""Streaming jobs: bars, quote gaps, brackets, fills, decisions and their telemetry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.config import BarrierConfig, BarSpec, FeatureConfig, StalenessConfig
from tapeloom.functions.scalar import ceil_time, local_date, no_nan
from tapeloom.sources.files import scratch_path
from tapeloom.streaming import decisions as dc
from tapeloom.streaming import processors as pr
from tapeloom.streaming import staleness as st

TICK_GRACE = "250 milliseconds"
BAR_SCHEMA = (
    "symbol string, session_date date, ts timestamp, open double, high double, low double, close double, volume double, n_trades double, "
    "vwap double, bid double, ask double, bid_size double, ask_size double, spread double, late_trades long"
)
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB provider; it also keeps state off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)


def tick_stream(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """One tagged tick table: kind 0 quote, 1 trade (a quote at a trade's instant sorts first)."""
    nul = F.lit(None).cast("double")
    q = quotes.select("symbol", "ts", (F.col("seq") * 2).alias("seq"), F.lit(0).alias("kind"), nul.alias("price"), nul.alias("size"), F.col("bid_price").alias("bid"), F.col("ask_price").alias("ask"), "bid_size", "ask_size")
    t = trades.select("symbol", "ts", (F.col("seq") * 2 + 1).alias("seq"), F.lit(1).alias("kind"), "price", "size", *[nul.alias(c) for c in ("bid", "ask", "bid_size", "ask_size")])
    return q.unionByName(t)


def stream_bars(ticks: DataFrame, spec: BarSpec = BarSpec(), grace: str = TICK_GRACE) -> DataFrame:
    """Streaming twin of ``second_bars``; bars may trail the last trade of a session with quotes only."""
    use_rocksdb(ticks.sparkSession)
    keyed = ticks.withWatermark("ts", grace).withColumn("session_date", local_date(ceil_time("ts", spec.interval_s), spec.zone))
    out = bucketed(keyed, "symbol", 64).groupBy("_bucket", "session_date").transformWithStateInPandas(
        statefulProcessor=pr.BarState(spec), outputStructType=BAR_SCHEMA, outputMode="Append", timeMode="EventTime"
    )
    numbers = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    return out.select("symbol", "session_date", "ts", *[no_nan(c).alias(c) for c in numbers], "late_trades")


def bucketed(df: DataFrame, by: str, buckets: int = 512) -> DataFrame:
    """Rows with the bucket of their name; state is kept by buckets, so Python is called once for many names."""
    return df.withColumn("_bucket", F.pmod(F.xxhash64(by), F.lit(buckets)))


def _fold(df: DataFrame, keys: list[str], processor: pr.Fold | pr.SignedBars | st.QuoteGaps, schema: str) -> DataFrame:
    use_rocksdb(df.sparkSession)
    return df.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")


def stream_signed_bars(ticks: DataFrame, interval_s: int = 60) -> DataFrame:
    """Streaming twin of ``microstructure_bars``; a bar closes when its symbol's tape crosses the boundary."""
    schema = (
        "symbol string, ts timestamp, open double, high double, low double, close double, volume double, vwap double, trade_count long, "
        "mean_spread double, mean_quote_imbalance double, flow_imbalance double"
    )
    return _fold(ticks.withColumn("us", F.unix_micros("ts")), ["symbol"], pr.SignedBars(interval_s), schema)


def stream_quote_gaps(arrivals: DataFrame, cfg: StalenessConfig = StalenessConfig()) -> DataFrame:
    """Streaming twin of ``quote_gaps``: gap, trailing p50 and p95, age and class per arriving quote."""
    out = _fold(arrivals.select("symbol", "seq", "recv_ts", "quote_ts"), ["symbol"], st.QuoteGaps(cfg), st.QuoteGaps.OUT)
    return out.select(*[no_nan(f.name).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in out.schema.fields])


def stream_silence(rows: DataFrame, cfg: StalenessConfig = StalenessConfig(), clock: str = "event", delay: str = "0 seconds") -> DataFrame:
    """State changes of the feeds of ``rows(feed, ts)``, also of feeds that have stopped sending.

    clock "event": time is the watermark, ``delay`` behind the newest row of any feed.
    clock "wall": time is the machine's; start the query with a trigger interval, since
    timers are looked at once per micro-batch.
    """
    use_rocksdb(rows.sparkSession)
    keyed = rows.select("feed", "ts")
    if clock == "event":
        keyed = keyed.withWatermark("ts", delay)
    return bucketed(keyed, "feed").groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=st.Silence(cfg, clock), outputStructType=st.Silence.OUT, outputMode="Append", timeMode="EventTime" if clock == "event" else "ProcessingTime"
    )


def stream_transitions(ages: DataFrame, cfg: StalenessConfig = StalenessConfig()) -> DataFrame:
    """Monitor state changes of a feed (feed, seq, age_s)."""
    fold = pr.Fold(pr.transition_step(cfg.pause_s, cfg.kill_s), ("RUNNING",), "status string", ["seq"], ["feed", "seq", "before", "after"], "feed")
    return _fold(bucketed(ages, "feed"), ["_bucket"], fold, "feed string, seq long, before string, after string")


def stream_brackets(events: DataFrame) -> DataFrame:
    """Actions of armed brackets over arm / disarm / quote events."""
    fold = pr.Fold(pr.bracket_step, (0, 0, 0.0, 0, -1), "armed int, qty long, stop double, deadline long, bracket long", ["us", "prio", "seq"], ["symbol", "bracket_id", "qty", "kind", "ts"])
    return _fold(bucketed(events, "symbol"), ["_bucket"], fold, "symbol string, bracket_id long, qty long, kind string, ts timestamp")


def stream_fills(fills: DataFrame) -> DataFrame:
    """Closed trades from a fill stream."""
    schema = "symbol string, side string, qty long, entry_ts timestamp, exit_ts timestamp, entry_price double, exit_price double, pnl double"
    names = [c.split()[0] for c in schema.split(", ")]
    fold = pr.Fold(pr.fill_step, (0, 0.0, 0), "qty long, entry double, opened long", ["us", "seq", "tie"], names)
    return _fold(bucketed(fills.withColumn("us", F.unix_micros("ts")), "symbol"), ["_bucket"], fold, schema)


def decision_telemetry(decisions: DataFrame, threshold: float, interval: str = "60 seconds", delay: str = "10 seconds") -> DataFrame:
    """Evaluations, best score, passes and zero-size counts per tumbling window."""
    p = F.col("p_win")
    agg = decisions.withWatermark("ts", delay).groupBy(F.window("ts", interval)).agg(
        F.count(F.lit(1)).alias("evals"), F.max("p_win").alias("max_p"), F.count(F.when(p >= threshold, 1)).alias("passed"), F.count(F.when((p >= threshold) & (F.col("qty") == 0), 1)).alias("qty_zero")
    )
    return agg.select(F.col("window.start").alias("ts"), "evals", "max_p", "passed", "qty_zero")


def decision_stream(bars: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float, features: FeatureConfig = FeatureConfig(), barrier: BarrierConfig = BarrierConfig(), exec_stop_mult: float = 1.0) -> DataFrame:
    """Decision rows of a stream of final bars: features from keyed state, then ``score`` (which adds p_win)."""
    return dc.decisions(dc.stream_features(bars, features, barrier), score, threshold, barrier, exec_stop_mult)


# ---------------------------------------------------------------- replay
def replay(df: DataFrame, order: str, files: int = 3) -> DataFrame:
    """Replay a table as a stream of ``files`` micro-batches in time order.

    The table is computed and written once, by time slices; each slice becomes as many
    files as there are cores (fewer for a small one), and a trigger takes one slice.
    """
    spark = df.sparkSession
    path, staged = scratch_path(spark, "ticks"), scratch_path(spark, "slices")
    at = F.unix_micros(order)
    df.withColumn("_at", at).repartitionByRange("_at").write.parquet(staged)
    rows = spark.read.parquet(staged)
    span = rows.agg(F.min("_at").alias("a"), F.max("_at").alias("b")).first()
    if span["a"] is None:
        df.write.parquet(path)
        return spark.readStream.schema(df.schema).parquet(path)
    width = max(1, (span["b"] - span["a"]) // files + 1)
    part = F.floor((F.col("_at") - F.lit(span["a"])) / F.lit(width))
    sizes = [r["count"] for r in rows.groupBy(part.alias("part")).count().collect()]  # one row per slice
    each = max(1, min(spark.sparkContext.defaultParallelism, min(sizes) // 1000))
    for i in range(files):
        rows.where(part == i).drop("_at").repartition(each).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything available and return the collected output table."""
    spark = stream.sparkSession
    out, mark = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-mark")
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", mark).trigger(availableNow=True)
    # state partitions are fixed when a query starts; a finite replay needs no more than the cores
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(parts), spark.sparkContext.defaultParallelism)))
    try:
        q = writer.start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)

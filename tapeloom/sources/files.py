"""Readers and writers: bar files, manifests, universes, order-book files, snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.ordered import ordered_prefix
from tapeloom.sources.published import publish
from tapeloom.session import cut, ensure_checkpoint_dir

MANIFEST_SCHEMA = "symbol string, date date, status string, rows long, n_trades long, rank long"
SETTLED = ("ok", "empty")
DAY_FILES = 32


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# ---------------------------------------------------------------- bars
def file_key(path: str | Column) -> tuple[Column, Column]:
    """(symbol, date) of a file named SYM_yyyy-mm-dd.parquet, split at the last underscore."""
    p = F.lit(path) if isinstance(path, str) else path
    pattern = "([^/]+)_([0-9]{4}-[0-9]{2}-[0-9]{2})\\.parquet"
    return F.regexp_extract(p, pattern, 1), F.to_date(F.regexp_extract(p, pattern, 2))


def read_bar_files(spark: SparkSession, folder: str) -> DataFrame:
    """One bar file per (symbol, day); the key comes from the file name."""
    symbol, date = file_key(F.col("_metadata.file_path"))
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder).select("*", symbol.alias("symbol"), date.alias("session_date"))


def write_bars(bars: DataFrame, path: str) -> None:
    """One dataset partitioned by day, replacing only the stock-days present in ``bars``.

    A day is ``DAY_FILES`` files at most, however many symbols it has; a stock-day lies in one of
    them, in order. The folders of the days in ``bars`` are rewritten with the stock-days that stay;
    a driver that dies while a folder is swapped leaves the new one whole in ``.spark-staging``.
    """
    spark = bars.sparkSession
    bars.select("symbol", "session_date", "ts")  # a table without them is refused, whatever the store holds
    if path_exists(spark, path) and not spark.read.schema(bars.schema).parquet(path).isEmpty():
        bars = cut(bars)
        days, stock_days = bars.select("session_date").distinct(), bars.select("symbol", "session_date").distinct()
        stored = spark.read.option("mergeSchema", "true").parquet(path)
        stay = stored.join(days, "session_date", "left_semi").join(stock_days, ["symbol", "session_date"], "left_anti")
        bars = bars.unionByName(stay, allowMissingColumns=True)
    (
        bars.repartition("session_date", F.pmod(F.xxhash64("symbol"), F.lit(DAY_FILES))).sortWithinPartitions("session_date", "symbol", "ts")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_date").parquet(path)
    )


def read_daily_batches(spark: SparkSession, folder: str, columns: Sequence[str] = ("symbol", "ts", "close", "volume")) -> DataFrame:
    """All daily batch files, a column subset. Zero-byte markers are left out; a damaged file fails the read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "batch_*.parquet").load(folder).select("path", "length")
    return spark.read.parquet(*sorted(r.path for r in files.where("length > 0").collect())).select(*columns)  # one name per batch


# ---------------------------------------------------------------- manifest
def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest; a missing one is empty with the right schema."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).csv(path, header=True)


def unsettled_days(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """Stock-days still to build: neither ok nor empty (errors are retried)."""
    return wanted.join(manifest.where(F.col("status").isin(*SETTLED)).select("symbol", "date"), ["symbol", "date"], "left_anti")


def build_missing(wanted: DataFrame, manifest_path: str, bars: DataFrame, bars_path: str) -> DataFrame:
    """Idempotent corpus step: build only unsettled days, replace their stock-days, append their status.

    ``bars`` is the lazily defined bar set; it is filtered to the missing days
    before anything is computed. A run that died before its status was appended
    is repeated over its own stock-days. If the days can't be built, all of them are
    logged as ``error``, which the next run retries; bars that were there stay.
    Returns the status rows that were appended.
    """
    spark = wanted.sparkSession
    todo = unsettled_days(wanted, read_manifest(spark, manifest_path)).select("symbol", "date", "rank")
    need = todo.select("symbol", F.col("date").alias("session_date"))
    made = bars.join(need, ["symbol", "session_date"], "left_semi")
    try:
        write_bars(made, bars_path)
        built = spark.read.parquet(bars_path).join(need, ["symbol", "session_date"], "left_semi")
        stats = built.groupBy("symbol", F.col("session_date").alias("date")).agg(F.count(F.lit(1)).alias("rows"), F.sum("n_trades").cast("long").alias("n_trades"))
        found = F.when(F.col("rows") > 0, "ok").otherwise("empty")
    except AnalysisException:  # a wrong table, not a failed day
        raise
    except PySparkException:
        none = F.lit(None).cast("long")
        stats, found = todo.select("symbol", "date", none.alias("rows"), none.alias("n_trades")).limit(0), F.lit("error")
    rows = todo.join(stats, ["symbol", "date"], "left").select(
        "symbol", "date", found.alias("status"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("n_trades", F.lit(0)).alias("n_trades"), "rank",
    )
    log = scratch_path(spark, "status")
    rows.write.parquet(log)
    status = spark.read.parquet(log)
    status.write.mode("append").csv(manifest_path, header=True)
    return status


# ---------------------------------------------------------------- universe
def clean_universe(df: DataFrame, strict: bool = True) -> DataFrame:
    """Distinct sorted symbols from a file with a 'symbol' or 'Symbol' header."""
    name = next((c for c in df.columns if c in ("symbol", "Symbol")), None)
    if name is None:
        raise ValueError("universe file has no symbol column")
    s = df.select(F.trim(F.col(name)).alias("symbol")).where("symbol <> ''")
    if strict:
        s = s.where(F.col("symbol").rlike("^[A-Za-z]{1,5}$"))
    return s.distinct().orderBy("symbol")


def load_universe(spark: SparkSession, paths: Sequence[str], strict: bool = True) -> DataFrame:
    """First existing non-empty file of the preference list."""
    for p in paths:
        if path_exists(spark, p):
            df = clean_universe(spark.read.csv(p, header=True), strict)
            if not df.isEmpty():
                return df
    raise ValueError("no universe file found")


# ---------------------------------------------------------------- order books
def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file (or folder of parts) with their 0-based position.

    The order is (file, split offset, line in split); the numbering is the
    distributed row index, so a large file is never numbered by one task.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_i"),
    )
    rows = ordered_prefix(lines, ["_f", "_b", "_i"])
    return rows.select((F.col("row_index") - 1).alias("row"), "line")


def _level_struct(cells: Column, i: int) -> Column:
    names = ("ask_p", "ask_v", "bid_p", "bid_v")
    return F.struct(*[F.get(cells, F.lit(4 * i + j)).cast("double").alias(n) for j, n in enumerate(names)])


def load_book_pair(spark: SparkSession, orderbook_csv: str, message_csv: str, levels: int = 10) -> DataFrame:
    """Book and message files without header, joined by row position.

    Executions are message types 4 and 5; direction -1 is a resting sell order
    that was hit, hence buyer-initiated volume. Row counts must agree.
    """
    book = _numbered_lines(spark, orderbook_csv).withColumn("c", F.split("line", ","))
    msg = _numbered_lines(spark, message_csv).withColumn("m", F.split("line", ","))
    both = book.select("row", "c").join(msg.select("row", "m"), "row", "full_outer")
    enough = F.size("c") >= 4 * levels
    both = both.withColumn(
        "c",
        F.when(F.col("c").isNull() | F.col("m").isNull(), F.raise_error(F.lit("book and message files differ in length")).cast("array<string>"))
        .when(~enough, F.raise_error(F.lit("file has too few levels")).cast("array<string>")).otherwise(F.col("c")),
    )
    kind, size, side = (F.get("m", F.lit(i)) for i in (1, 3, 5))
    executed = kind.cast("double").cast("int").isin(4, 5)
    way, n = side.cast("double").cast("int"), size.cast("double")
    return both.select(
        F.col("row").alias("seq"), F.get("m", F.lit(0)).cast("double").alias("event_time"), F.array(*[_level_struct(F.col("c"), i) for i in range(levels)]).alias("levels"),
        F.when(executed & (way == -1), n).otherwise(0.0).alias("buy_flow"), F.when(executed & (way == 1), n).otherwise(0.0).alias("sell_flow"), F.lit(1e-4).alias("tick_size"),
    )


def load_transposed_book(spark: SparkSession, path: str, levels: int = 10, max_cols: int | None = None) -> DataFrame:
    """A matrix whose rows are features and columns are time: turned into one book row per column."""
    rows = _numbered_lines(spark, path).where(F.col("row") < 4 * levels)
    cells = rows.select("row", F.posexplode(F.split(F.trim("line"), "\\s+")).alias("seq", "v"))
    if max_cols:
        cells = cells.where(F.col("seq") < max_cols)
    wide = cells.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", F.col("v").cast("double").alias("v")))), lambda x: x["v"]).alias("c"))
    zero = F.lit(0.0)
    return wide.select(
        F.col("seq").cast("long").alias("seq"), F.col("seq").cast("double").alias("event_time"), F.array(*[_level_struct(F.col("c"), i) for i in range(levels)]).alias("levels"),
        zero.alias("buy_flow"), zero.alias("sell_flow"), F.lit(1e-4).alias("tick_size"),
    )


# ---------------------------------------------------------------- sinks
def write_report(df: DataFrame, path: str) -> None:
    """Result table as parquet, and as one CSV and JSON file each (reports are small)."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    stored = df.sparkSession.read.parquet(f"{path}/parquet")
    stored.coalesce(1).write.mode("overwrite").csv(f"{path}/csv", header=True)
    stored.coalesce(1).write.mode("overwrite").json(f"{path}/json")


def replace_all(df: DataFrame, path: str) -> None:
    """Snapshot table replaced as a whole; missing numbers become 0.

    Readers (``read_published``) keep the old snapshot until the new one is complete,
    and for good if its job fails.
    """
    publish(df.fillna(0.0).fillna(0), path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def save_scaler(scaler: DataFrame, path: str) -> None:
    scaler.write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ---------------------------------------------------------------- sessions table
def session_flags(rows: DataFrame, sessions: DataFrame, ts: str = "ts") -> DataFrame:
    """Open, entry-window, last-minutes and month-end flags from a table of exchange sessions.

    ``sessions`` (date, open_ts, close_ts) has one row per trading day.
    """
    from pyspark.sql import Window

    w = Window.orderBy("date")
    nxt = F.lead("date", 1).over(w)
    ends = F.coalesce(F.trunc(nxt, "month") != F.trunc("date", "month"), F.lit(False))
    cal = sessions.withColumn("last_of_month", ends)
    prior = F.last(F.when(F.col("last_of_month"), F.col("date")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cal = cal.withColumn("prior_month_end", prior)
    df = rows.withColumn("_d", F.to_date(F.from_utc_timestamp(ts, "America/New_York"))).join(cal.withColumnRenamed("date", "_d"), "_d", "left")
    t = F.unix_micros(ts)
    o, c, minute = F.unix_micros("open_ts"), F.unix_micros("close_ts"), F.lit(60_000_000)
    no = F.lit(False)
    is_open = F.coalesce((t >= o) & (t < c), no)
    return df.select(
        *rows.columns, is_open.alias("session_open"), (is_open & F.coalesce(t.between(o + 5 * minute, c - 10 * minute), no)).alias("entry_window"),
        (is_open & F.coalesce(t >= c - 5 * minute, no)).alias("last_minutes"), (is_open & F.coalesce("last_of_month", no)).alias("month_end_session"), "prior_month_end",
    )

"""Market-shaped views of the test tables (deterministic column arithmetic).

The test tables are not market data. These views give them the schemas the
operators work on; every row of the source table takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.scalar import local_date
from tapeloom.session import prepare

USERS_PER_SYMBOL = 40
BOOK_LEVELS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("S"), F.floor(F.col("user_id") / USERS_PER_SYMBOL).cast("string")).alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        "event_type",
        F.round(F.lit(5.0) + F.col("value") / 50.0, 4).alias("px"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir).where(F.col("event_type").isin("purchase", "click"))
    return ev.select("symbol", "ts", "seq", F.col("px").alias("price"), (F.col("k") + 1).cast("double").alias("size"))


def _quote_columns() -> list[Column]:
    bid = F.round(F.col("px") - 0.01 * (1 + F.col("k") % 5), 4)
    ask = F.when(F.col("event_type") == "error", F.round(bid - 0.02, 4)).otherwise(
        F.round(F.col("px") + 0.01 * (1 + F.col("k") % 3), 4)
    )
    return [
        bid.alias("bid_price"),
        ask.alias("ask_price"),
        (1 + F.col("k") % 7).cast("double").alias("bid_size"),
        (1 + F.col("k") % 11).cast("double").alias("ask_size"),
    ]


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir).where(F.col("event_type").isin("view", "signup", "error"))
    return ev.select("symbol", "ts", "seq", *_quote_columns())


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ten-level book per event; error events are crossed, signup books with k=0 very wide."""
    ev = _events(spark, sf_dir)
    wide = (F.col("event_type") == "signup") & (F.col("k") % 25 == 0)
    bid = F.round(F.col("px") - 0.01 * (1 + F.col("k") % 5), 4)
    ask = (
        F.when(F.col("event_type") == "error", F.round(bid - 0.02, 4))
        .when(wide, F.round(F.col("px") + 4.0, 4))
        .otherwise(F.round(F.col("px") + 0.01 * (1 + F.col("k") % 3), 4))
    )
    base = ev.select("symbol", local_date("ts").alias("session_date"), "ts", "seq", "event_type", "k", bid.alias("b0"), ask.alias("a0"))
    levels = F.transform(
        F.sequence(F.lit(0), F.lit(BOOK_LEVELS - 1)),
        lambda i: F.struct(
            F.round(F.col("a0") + 0.01 * i, 4).alias("ask_p"),
            (1 + (F.col("k") + i) % 11).cast("double").alias("ask_v"),
            F.round(F.col("b0") - 0.01 * i, 4).alias("bid_p"),
            (1 + (F.col("k") + 2 * i) % 7).cast("double").alias("bid_v"),
        ),
    )
    size = (F.col("k") + 1).cast("double")
    return base.select(
        "symbol",
        "session_date",
        "ts",
        "seq",
        levels.alias("levels"),
        F.when(F.col("event_type") == "purchase", size).otherwise(0.0).alias("buy_flow"),
        F.when(F.col("event_type") == "click", size).otherwise(0.0).alias("sell_flow"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: one supplier is a symbol, its line items of a ship date are the prints."""
    li = table(spark, sf_dir, "lineitem")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return (
        li.select("l_suppkey", F.to_date("l_shipdate").alias("date"), px.alias("px"), order.alias("o"), "l_quantity", "l_extendedprice")
        .groupBy(F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("symbol"), "date")
        .agg(
            F.min_by("px", "o").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "o").alias("close"),
            F.sum("l_quantity").alias("volume"),
            (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("vwap"),
        )
    )


def _cents(c: str) -> Column:
    """A two-decimal money column as an exact integer number of cents."""
    return F.round(F.col(c) * 100).cast("long")


def unit_price(digits: int) -> Column:
    """Extended price per unit, truncated (integer arithmetic, so both engines agree)."""
    scaled = _cents("l_extendedprice") * F.lit(10 ** (digits - 2))
    return F.floor(scaled / F.col("l_quantity")) / float(10**digits)


def trade_pnl() -> Column:
    rate = F.round((F.col("l_discount") - F.col("l_tax")) * 100).cast("long")
    return F.floor(_cents("l_extendedprice") * rate / 100) / 100.0


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signed fill per line item; the order of fills is a total order."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("symbol"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.col("l_partkey").alias("tie"),
        F.when(F.col("l_returnflag") == "R", "sell").when(F.col("l_linestatus") == "F", "sell").otherwise("buy").alias("side"),
        F.col("l_quantity").cast("long").alias("qty"),
        unit_price(4).alias("price"),
    )


def closed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed round trips: one per line item, held until the next day."""
    li = table(spark, sf_dir, "lineitem")
    px = unit_price(2)
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "short").otherwise("long").alias("side"),
        F.col("l_quantity").cast("long").alias("qty"),
        F.col("l_shipdate").cast("timestamp").alias("entry_ts"),
        F.timestamp_micros(F.unix_micros(F.col("l_shipdate").cast("timestamp")) + (F.col("l_linenumber") + 1) * F.lit(3_600_000_000)).alias("exit_ts"),
        px.alias("entry_price"),
        (F.floor(F.floor(_cents("l_extendedprice") / F.col("l_quantity")) * (100 + F.round((F.col("l_discount") - F.col("l_tax")) * 100).cast("long")) / 100) / 100.0).alias("exit_price"),
        trade_pnl().alias("pnl"),
    )


def equity_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One equity point per order: a base plus a bounded, deterministic swing."""
    o = table(spark, sf_dir, "orders")
    swing = F.pmod(F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729, F.lit(20011))
    equity = F.lit(100000.0) + swing
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.pmod(F.col("o_orderkey"), F.lit(86400)) * F.lit(1_000_000)).alias("ts"),
        equity.alias("equity"),
        (equity / 2).alias("cash"),
        F.round(F.col("o_totalprice") / 10, 2).alias("gross_exposure"),
    )

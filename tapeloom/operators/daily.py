"""Daily-bar operators: runner days, prior-session context, universe screens.

Windows here are per symbol and one row per session, so a calendar bounds them
(about 250 rows a year); prints were already combined into daily bars.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.config import PRICE_BUCKETS, MoverCriteria, RunnerCriteria
from tapeloom.functions.ordered import ordered_prefix
from tapeloom.functions.scalar import clip, plain_ticker, ratio

def by_date():
    """One symbol's sessions in order."""
    return Window.partitionBy("symbol").orderBy("date")


def relative_volume_inputs(daily: DataFrame, window: int = 20) -> DataFrame:
    """Add prev_close and the median of the prior ``window`` volumes (all required)."""
    prior = by_date().rowsBetween(-window, -1)
    full = F.count("volume").over(prior) == window
    return daily.select(
        "*",
        F.lag("close", 1).over(by_date()).alias("prev_close"),
        F.when(full, F.percentile("volume", F.lit(0.5)).over(prior)).alias("med_volume"),
    )


def select_runner_days(daily: DataFrame, crit: RunnerCriteria = RunnerCriteria()) -> DataFrame:
    """Stock-days that ran: in the price band, triggered, liquid; best score first."""
    df = relative_volume_inputs(daily, crit.relvol_window).select(
        "*",
        (ratio("close", "prev_close") - 1.0).alias("gain"),
        (ratio("open", "prev_close") - 1.0).alias("gap"),
        ratio("volume", "med_volume").alias("relvol"),
        (F.col("volume") * F.coalesce("vwap", "close")).alias("dollar_vol"),
    )
    band = F.col("open").between(crit.price_min, crit.price_max) & F.col("prev_close").between(crit.price_min, crit.price_max)
    trigger = (F.col("gain") >= crit.min_gain) | (F.col("gap") >= crit.min_gap)
    liquid = (F.col("relvol") >= crit.min_relvol) & (F.col("dollar_vol") >= crit.min_dollar_vol)
    score = F.least(F.col("dollar_vol"), F.lit(crit.score_dollar_cap)) * (1.0 + clip("gain", 0, 3))
    return df.where(band & trigger & liquid).withColumn("score", score).drop("med_volume").orderBy(F.desc("score"), "symbol", "date")


def prior_session_context(days: DataFrame, daily: DataFrame) -> DataFrame:
    """For each (symbol, date): close, volume and dollar volume of the latest session strictly before it."""
    cols = ["prev_day_close", "prev_day_volume", "prev_day_dollar_vol"]
    d = daily.select(
        "symbol", "date", F.lit(1).alias("_own"), F.col("close").alias(cols[0]), F.col("volume").alias(cols[1]),
        (F.col("close") * F.col("volume")).alias(cols[2]),
    )
    ask = days.select("symbol", "date").distinct().select("symbol", "date", F.lit(0).alias("_own"), *[F.lit(None).cast("double").alias(c) for c in cols])
    w = Window.partitionBy("symbol").orderBy("date", "_own").rowsBetween(Window.unboundedPreceding, -1)
    row = F.last(F.when(F.col("_own") == 1, F.struct(*cols)), ignorenulls=True).over(w)
    found = d.unionByName(ask).withColumn("_p", row).where("_own = 0").select("symbol", "date", *[F.col(f"_p.{c}").alias(c) for c in cols])
    return days.join(found, ["symbol", "date"], "left")


def latest_context(daily: DataFrame) -> DataFrame:
    """Today's open and the previous session's values from the last two daily bars of a symbol."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    two = daily.withColumn("_k", back).where("_k <= 2")

    def pick(k: int, c):
        return F.max(F.when(F.col("_k") == k, c))

    n = F.count(F.lit(1))
    return two.groupBy("symbol").agg(
        F.when(n == 2, pick(1, F.col("open"))).alias("open"),
        pick(2, F.col("close")).alias("prev_close"),
        pick(2, F.col("volume")).alias("prev_day_volume"),
        pick(2, F.col("close") * F.col("volume")).alias("prev_day_dollar_vol"),
    )


def month_end_dates(daily: DataFrame) -> DataFrame:
    return daily.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(F.max("date").alias("date"))


def with_min_history(daily: DataFrame, sessions: int = 252) -> DataFrame:
    """Symbols with enough sessions; one row per (symbol, date)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return daily.withColumn("_n", n).where(F.col("_n") >= sessions).drop("_n")


def daily_panel(rows: DataFrame, observations: int = 252, fields: Sequence[str] = ("close", "volume", "vwap"), order: str = "ts") -> DataFrame:
    """One row per (symbol, date) with the last value of each field, for symbols with enough rows.

    ``rows`` may hold several rows of a day; all of them count as observations.
    """
    enough = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= observations).select("symbol")
    return last_per_day(rows.join(enough, "symbol", "left_semi"), fields, order)


def last_per_day(rows: DataFrame, fields: Sequence[str] = ("close", "volume", "vwap"), order: str = "ts") -> DataFrame:
    """The last non-null value of each field per (symbol, date)."""
    return rows.groupBy("symbol", "date").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def momentum_universe(daily: DataFrame, min_price: float = 8.0, min_dollar_vol: float = 5e6, min_closes: int = 22) -> DataFrame:
    """Score of the latest session: 0.6 x 20-day + 0.4 x 5-day momentum, both positive."""
    last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    df = daily.where(F.col("close").isNotNull()).select(
        "symbol", "date", "close", "volume",
        F.lag("close", 20).over(by_date()).alias("_c20"),
        F.lag("close", 5).over(by_date()).alias("_c5"),
        F.row_number().over(by_date()).alias("_n"),
        last.alias("_k"),
    )
    df = df.where((F.col("_k") == 1) & (F.col("_n") >= min_closes)).select(
        "symbol", F.col("close").alias("price"), (F.col("close") * F.col("volume")).alias("dollar_vol"),
        (ratio("close", "_c20") - 1.0).alias("mom_20"), (ratio("close", "_c5") - 1.0).alias("mom_5"),
    )
    keep = (F.col("price") >= min_price) & (F.col("dollar_vol") >= min_dollar_vol) & (F.col("mom_20") > 0) & (F.col("mom_5") > 0)
    return df.where(keep).withColumn("score", 0.6 * F.col("mom_20") + 0.4 * F.col("mom_5")).orderBy(F.desc("score"), "symbol")


def top_candidates(scored: DataFrame, exclude: DataFrame, n: int) -> DataFrame:
    return scored.join(exclude.select("symbol"), "symbol", "left_anti").orderBy(F.desc("score"), "symbol").limit(n)


def screen_by_liquidity(daily: DataFrame, top_n: int, min_price: float = 3.0, min_sessions: int = 40) -> DataFrame:
    """Most liquid symbols by median dollar volume, returned in name order."""
    per = daily.groupBy("symbol").agg(
        F.percentile(F.col("close") * F.col("volume"), F.lit(0.5)).alias("med_dollar_vol"),
        F.max_by("close", "date").alias("last_close"),
        F.count(F.lit(1)).alias("sessions"),
    )
    ok = per.where((F.col("last_close") >= min_price) & (F.col("sessions") >= min_sessions))
    return ok.orderBy(F.desc("med_dollar_vol"), "symbol").limit(top_n).orderBy("symbol")


def screen_names(assets: DataFrame, excluded_pattern: str, name: str = "name") -> DataFrame:
    """Plain tickers whose name does not look like a fund."""
    return assets.where(plain_ticker("symbol") & ~F.coalesce(F.col(name), F.lit("")).rlike(excluded_pattern))


def scan_movers(gainers: DataFrame, actives: DataFrame, exclude: DataFrame, crit: MoverCriteria = MoverCriteria()) -> DataFrame:
    """Merge two mover lists (gainers win duplicates) and rank by sqrt(move x dollar volume)."""
    move, dv = F.abs(F.coalesce("percent_change", F.lit(0.0))), F.coalesce("price", F.lit(0.0)) * F.coalesce("volume", F.lit(0.0))
    both = gainers.withColumn("_prio", F.lit(0)).unionByName(actives.withColumn("_prio", F.lit(1)))
    ok = plain_ticker("symbol", upper_only=True) & (F.col("price") >= crit.min_price) & (dv >= crit.min_dollar_volume)
    ok = ok & ((F.col("_prio") == 1) | (move >= crit.min_pct_change))
    first = F.row_number().over(Window.partitionBy("symbol").orderBy("_prio"))
    kept = both.where(ok).join(exclude.select("symbol"), "symbol", "left_anti").withColumn("_k", first).where("_k = 1")
    return kept.withColumn("score", F.sqrt(move * dv)).drop("_k", "_prio").orderBy(F.desc("score"), "symbol").limit(crit.max_n)


def pick_next_days(index: DataFrame, done: DataFrame, n: int) -> DataFrame:
    """Next stock-days to process, round-robin over price buckets, best score first in each."""
    names = [b[2] for b in PRICE_BUCKETS]
    rank = F.coalesce(*[F.when((F.col("open") >= lo) & (F.col("open") < hi), F.lit(i)) for i, (lo, hi, _) in enumerate(PRICE_BUCKETS)])
    todo = index.join(done.select("symbol", "date"), ["symbol", "date"], "left_anti").withColumn("bucket", rank).where("bucket is not null")
    turn = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("score"), "symbol", "date"))
    out = todo.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", "bucket").limit(n)
    return out.select("symbol", "date", "score", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("bucket") + 1).alias("price_bucket"), "turn")


def rotate_universe(live: DataFrame, protected: DataFrame, incoming: DataFrame, limit: int) -> DataFrame:
    """Make room for incoming names by dropping the oldest unprotected ones; ``live`` has added_at.

    As many names are evicted as it takes to bring live and new ones down to
    ``limit``, or all unprotected ones; the new names are added in any case.
    """
    new = incoming.select("symbol").distinct().join(live.select("symbol"), "symbol", "left_anti")
    counts = live.agg(F.count(F.lit(1)).alias("_live")).crossJoin(new.agg(F.count(F.lit(1)).alias("_new")))
    idle = live.join(protected.select("symbol"), "symbol", "left_anti")
    aged = ordered_prefix(idle.select("symbol", "added_at"), ["added_at", "symbol"], index="_k")
    evict = aged.crossJoin(counts).where(F.col("_k") <= F.col("_live") + F.col("_new") - limit).select("symbol")  # counts is a single row
    kept = live.join(evict, "symbol", "left_anti").select("symbol", F.lit("kept").alias("state"))
    return kept.unionByName(new.select("symbol", F.lit("added").alias("state")))

"""Small literal tapes and the perturbation check."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

OPEN = datetime(2024, 1, 2, 14, 30)  # 09:30 in New York
BAR = "symbol string, session_date date, ts timestamp, open double, high double, low double, close double, volume double, n_trades double, vwap double, bid double, ask double, bid_size double, ask_size double, spread double"


def bars(spark, bid, ask=None, low=None, high=None, close=None, volume=None, n_trades=None, size=10.0, symbol="A", start=OPEN):
    n = len(bid)
    ask = ask or [None if b is None else round(b + 0.02, 4) for b in bid]
    rows = []
    for i in range(n):
        c = close[i] if close else (bid[i] if bid[i] is not None else None)
        rows.append((
            symbol, start.date(), start + timedelta(seconds=i), c, high[i] if high else c, low[i] if low else c, c,
            float(volume[i]) if volume else 100.0, float(n_trades[i]) if n_trades else 1.0, c, bid[i], ask[i],
            None if bid[i] is None else size, None if ask[i] is None else size, None if bid[i] is None or ask[i] is None else ask[i] - bid[i],
        ))
    return spark.createDataFrame(rows, BAR)


def random_walk(spark, n, seed, gaps=True):
    import random

    rng = random.Random(seed)
    px, bid, ask, close, vol, cnt = 5.0, [], [], [], [], []
    for _ in range(n):
        px = max(1.0, px + rng.choice([-0.02, -0.01, 0.0, 0.01, 0.02]))
        quiet = gaps and rng.random() < 0.2
        close.append(None if quiet else round(px, 2))
        vol.append(0 if quiet else rng.randint(1, 500))
        cnt.append(0 if quiet else rng.randint(1, 5))
        stale = gaps and rng.random() < 0.05
        bid.append(None if stale else round(px - 0.01, 2))
        ask.append(None if stale else round(px + 0.01 + rng.choice([0, 0.01]), 2))
    low = [None if c is None else round(c - 0.01, 2) for c in close]
    high = [None if c is None else round(c + 0.01, 2) for c in close]
    return bars(spark, bid, ask, low, high, close, vol, cnt)


def assert_causal(op, df, cut_row, keys=("ts",)):
    """Rewriting everything after the cut must not change any earlier output row."""
    cut = OPEN + timedelta(seconds=cut_row)
    later = F.col("ts") > F.lit(cut)
    changed = df
    for c in ("open", "high", "low", "close", "vwap", "bid", "ask"):
        changed = changed.withColumn(c, F.when(later, F.coalesce(F.col(c), F.lit(5.0)) * 3 + 1).otherwise(F.col(c)))
    changed = changed.withColumn("volume", F.when(later, F.col("volume") * 7 + 3).otherwise(F.col("volume")))
    before = [r.asDict() for r in op(df).where(F.col("ts") <= F.lit(cut)).orderBy(*keys).collect()]
    after = [r.asDict() for r in op(changed).where(F.col("ts") <= F.lit(cut)).orderBy(*keys).collect()]
    assert before == after
    assert len(before) == cut_row + 1

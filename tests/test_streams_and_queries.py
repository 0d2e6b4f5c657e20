"""Stream/batch parity at one-second bars, file sources, and the query registry."""

from datetime import timedelta

import numpy as np
import pytest
from helpers import OPEN
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tapeloom.config import BarSpec
from tapeloom.operators import bars as b
from tapeloom.queries import ORACLES, QUERIES
from tapeloom.sources import files as fs
from tapeloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_streamed_second_bars_equal_batch_bars(spark):
    rng = np.random.default_rng(4)
    t = sorted(rng.uniform(0, 200, 120))
    q = [x for x in sorted(rng.uniform(0, 200, 80)) if not 60 < x < 135]
    at = lambda s: OPEN + timedelta(microseconds=int(s * 1e6))
    trades = spark.createDataFrame([("A", at(s), i, float(rng.integers(500, 520)) / 100, float(rng.integers(1, 50))) for i, s in enumerate(t)], "symbol string, ts timestamp, seq long, price double, size double")
    quotes = spark.createDataFrame([("A", at(s), i, 5.0, 5.0 + float(rng.integers(-1, 5)) / 100, 1.0, 2.0) for i, s in enumerate(q)], "symbol string, ts timestamp, seq long, bid_price double, ask_price double, bid_size double, ask_size double")
    ticks = jobs.tick_stream(trades, quotes)
    clock = ticks.limit(1).withColumn("ts", F.lit(at(900))).withColumn("symbol", F.lit("~")).withColumn("kind", F.lit(2))
    live = jobs.run_to_end(jobs.stream_bars(jobs.replay(ticks.unionByName(clock), "ts", 4), BarSpec()))
    batch = b.second_bars(trades, quotes)
    end = batch.agg(F.max("ts")).first()[0]
    live = live.where((F.col("symbol") == "A") & (F.col("ts") <= F.lit(end)))
    cols = [c for c in batch.columns]
    rows = [[tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r) for r in d.select(*cols).orderBy("ts").collect()] for d in (live, batch)]
    assert rows[0] == rows[1] and len(rows[0]) > 150


def test_book_files(spark, tmp_path):
    (tmp_path / "ob.csv").write_text("101,5,99,7,102,6,98,8\n102,1,100,2,103,3,99,4\n")
    (tmp_path / "msg.csv").write_text("34200.1,4,1,10,1010000,-1\n34200.2,1,2,20,1000000,1\n")
    got = fs.load_book_pair(spark, str(tmp_path / "ob.csv"), str(tmp_path / "msg.csv"), 2).orderBy("seq").collect()
    assert got[0].buy_flow == 10 and got[1].buy_flow == 0 and got[1].sell_flow == 0 and got[0].levels[1].bid_p == 98
    (tmp_path / "short.csv").write_text("34200.1,4,1,10,1010000,-1\n")
    with pytest.raises(Exception, match="differ in length"):
        fs.load_book_pair(spark, str(tmp_path / "ob.csv"), str(tmp_path / "short.csv"), 2).collect()
    (tmp_path / "fi.txt").write_text("\n".join(" ".join(str(r * 10 + c) for c in range(3)) for r in range(9)))
    m = fs.load_transposed_book(spark, str(tmp_path / "fi.txt"), 2, 2).orderBy("seq").collect()
    assert len(m) == 2 and m[1].levels[1].ask_p == 41.0 and m[1].buy_flow == 0.0


def test_bar_files_and_manifest(spark, tmp_path):
    spark.range(3).withColumn("close", F.lit(1.0)).coalesce(1).write.parquet(str(tmp_path / "x"))
    src = next((tmp_path / "x").glob("*.parquet"))
    (tmp_path / "bars").mkdir()
    (tmp_path / "bars" / "BRK_B_2024-01-02.parquet").write_bytes(src.read_bytes())
    r = fs.read_bar_files(spark, str(tmp_path / "bars")).first()
    assert r.symbol == "BRK_B" and str(r.session_date) == "2024-01-02"
    assert fs.read_manifest(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "batch_1.parquet").write_bytes(src.read_bytes())
    (tmp_path / "b" / "batch_2.parquet").write_bytes(b"")
    assert fs.read_daily_batches(spark, str(tmp_path / "b"), ["id", "close"]).count() == 3


def test_every_oracle_has_a_query_and_entry_runs(spark):
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 150
    assert QUERIES.keys() <= entry.queries().keys() and ORACLES.items() <= entry.oracle_sql().items()
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["second_bars", "bar_features", "barrier_labels", "taker_fills", "quote_gaps", "book_positions", "runner_days", "screened_intents", "average_precision", "decile_table"])
def test_queries_match_their_oracle_on_the_small_tables(spark, name):
    import glob
    import os

    import duckdb

    from tools.check_oracles import table_rows

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert table_rows(df.columns, df.collect()) == table_rows(names, cur.fetchall())

"""Guards, morning scan, splits, sampling, scalers, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.config import SplitConfig
from tapeloom.functions.ordered import ordered_prefix
from tapeloom.functions.scalar import log_target, stable_unit
from tapeloom.operators import bar_features as bf
from tapeloom.operators import bars as b
from tapeloom.operators import fills as fl
from tapeloom.operators import scan
from tapeloom.operators import splits as sp
from tapeloom.queries.bar_queries import (
    ENTRIES, FEATURE_COLS, FEATURE_CTES, LABEL_CTES, SCORED, entries, labelled, scored_labels, study, study_ctes,
)
from tapeloom.queries.base import BARS, DAILY, FEATURES, bars, query, r, rcols, rnd, rounded, with_ctes
from tapeloom.sources import driver_tables as tables
from tapeloom.sources import files as fs
from tapeloom.sources.published import read_published

# ---------------------------------------------------------------- guards
EARLY = (9 * 3600, 12 * 3600)  # the test bars are ten minutes wide, so the early window is widened
EARLY_SQL = "CAST(ts - INTERVAL 5 HOUR AS TIME) BETWEEN TIME '09:00:00' AND TIME '12:00:00'"


@query("early_bars", with_ctes(BARS) + f"SELECT symbol, session_date, ts, {r('close', 'close')}, volume FROM bars WHERE {EARLY_SQL}")
def _early(spark, sf):
    return rounded(scan.early_bars(bars(spark, sf), *EARLY).select(*b.KEY, "ts", "close", "volume"))


@query("bars_outside_window", with_ctes(BARS) + f"SELECT symbol, session_date, ts FROM bars WHERE NOT ({EARLY_SQL})")
def _outside(spark, sf):
    return scan.outside_window(bars(spark, sf), *EARLY).select(*b.KEY, "ts")


@query("contiguity_breaks", with_ctes(BARS) + "SELECT symbol, session_date, ts, (epoch_us(ts) - epoch_us(p))::BIGINT AS step_us FROM (SELECT *, lag(ts) OVER (PARTITION BY symbol, session_date ORDER BY ts) AS p FROM bars WHERE volume > 0) WHERE epoch_us(ts) - epoch_us(p) <> 600000000")
def _breaks(spark, sf):
    return sp.contiguity_breaks(bars(spark, sf).where("volume > 0"), 600)


@query("entries_without_bar", with_ctes(ENTRIES) + "SELECT e.symbol, e.session_date, e.ts, e.qty FROM entries e JOIN bars b USING (symbol, session_date, ts) WHERE b.n_trades = 0")
def _orphans(spark, sf):
    traded = bars(spark, sf).where("n_trades > 0")
    return fl.missing_bar_times(entries(spark, sf).select(*b.KEY, "ts", "qty"), traded)


@query("feature_subset", with_ctes(FEATURE_CTES) + f"SELECT symbol, session_date, ts, {rcols([c for c in FEATURE_COLS if c not in ('qimb', 'tod_min')])} FROM feats")
def _subset(spark, sf):
    return rounded(bf.drop_features(bf.bar_features(bars(spark, sf), FEATURES), "qimb, tod_min,,"))


# ---------------------------------------------------------------- morning scan
CTX = """ctx AS (SELECT symbol, session_date, first(close ORDER BY ts) FILTER (close IS NOT NULL) AS open, sum(volume) AS vol, sum(volume * coalesce(vwap, 0)) AS dv, last(close ORDER BY ts) FILTER (close IS NOT NULL) AS close FROM bars GROUP BY ALL),
cx AS (SELECT symbol, session_date, open, lag(close) OVER w AS prev_close, lag(vol) OVER w AS pv, lag(dv) OVER w AS pdv FROM ctx WINDOW w AS (PARTITION BY symbol ORDER BY session_date)),
ma AS (SELECT symbol, session_date, sum(coalesce(close * volume, 0)) AS dollars, sum(volume) AS vol, max(close) AS hi, min(close) AS lo, first(close ORDER BY ts) FILTER (close IS NOT NULL) AS f, last(close ORDER BY ts) FILTER (close IS NOT NULL) AS l,
  avg(close) AS mean, sum(close * volume) AS notional, quantile_cont(spread / ((bid + ask) / 2.0) * 1e4, 0.5) AS med FROM bars WHERE CAST(ts - INTERVAL 5 HOUR AS TIME) BETWEEN TIME '09:00:00' AND TIME '12:00:00' GROUP BY ALL),
mf AS MATERIALIZED (SELECT ma.symbol, ma.session_date, open / prev_close - 1 AS gap_pct, prev_close, pdv AS prev_day_dollar_vol, vol / nullif(pv, 0) AS relvol_at_open, (hi - lo) / coalesce(CASE WHEN open > 0 THEN open END, f) AS first15_range_pct,
  l / (CASE WHEN vol > 0 THEN notional / vol ELSE mean END) - 1 AS first15_vwap_dist, med AS first15_spread_bps_med, dollars AS first15_dollar_vol FROM ma LEFT JOIN cx USING (symbol, session_date))"""


def day_context(spark, sf):
    t = bars(spark, sf)
    seen = F.when(F.col("close").isNotNull(), F.col("ts"))
    d = t.groupBy(*b.KEY).agg(
        F.min_by("close", seen).alias("open"), F.sum("volume").alias("v"), F.sum(F.col("volume") * F.coalesce("vwap", F.lit(0.0))).alias("dv"), F.max_by("close", seen).alias("c")
    )
    w = Window.partitionBy("symbol").orderBy("session_date")
    return d.select(*b.KEY, "open", F.lag("c", 1).over(w).alias("prev_close"), F.lag("v", 1).over(w).alias("prev_day_volume"), F.lag("dv", 1).over(w).alias("prev_day_dollar_vol"))


def morning(spark, sf):
    return scan.morning_features(scan.early_bars(bars(spark, sf), *EARLY), day_context(spark, sf))


@query("morning_features", with_ctes(BARS, CTX) + f"SELECT symbol, session_date, {rcols(scan.MORNING_FEATURES, 5)} FROM mf")
def _morning(spark, sf):
    return rounded(morning(spark, sf), 5)


@query("scalpability_labels", study_ctes() + f"SELECT symbol, session_date, {r('taker_clip_pnl', 'label', 3)} FROM study WHERE horizon_s = 6")
def _scalpability(spark, sf):
    return rounded(scan.scalpability_label(study(spark, sf), 6), 3)


@query("scanner_dataset", study_ctes().rstrip() + ",\n" + CTX + f" SELECT symbol, session_date, {rcols(scan.MORNING_FEATURES, 5)}, {r('taker_clip_pnl', 'label', 3)} FROM mf JOIN study USING (symbol, session_date) WHERE horizon_s = 6")
def _scanner(spark, sf):
    out = scan.scanner_dataset(scan.early_bars(bars(spark, sf), *EARLY), day_context(spark, sf), study(spark, sf), 6)
    return rounded(out, 5, label=3)


@query("ranked_watchlist", with_ctes(BARS, CTX) + f", s AS (SELECT symbol || '-' || session_date AS symbol, first15_range_pct * first15_dollar_vol AS p FROM mf) SELECT symbol, {r('p', 'prediction', 4)} FROM s WHERE p IS NOT NULL ORDER BY p DESC, symbol LIMIT 30")
def _watch(spark, sf):
    s = morning(spark, sf).select(F.concat_ws("-", "symbol", F.col("session_date").cast("string")).alias("symbol"), (F.col("first15_range_pct") * F.col("first15_dollar_vol")).alias("prediction"))
    return rounded(scan.rank_watchlist(s)[0], 4)


@query("watchlist_dropped", with_ctes(BARS, CTX) + ", s AS (SELECT symbol || '-' || session_date AS symbol, first15_range_pct * first15_dollar_vol AS p FROM mf) SELECT symbol FROM (SELECT symbol, row_number() OVER (ORDER BY p DESC, symbol) AS k FROM s WHERE p IS NOT NULL) WHERE k > 40")
def _dropped(spark, sf):
    s = morning(spark, sf).select(F.concat_ws("-", "symbol", F.col("session_date").cast("string")).alias("symbol"), (F.col("first15_range_pct") * F.col("first15_dollar_vol")).alias("prediction"))
    return scan.rank_watchlist(s)[1]


# ---------------------------------------------------------------- splits and sampling
SPLIT = SplitConfig(test_frac=0.25, embargo_days=2, train_start="2024-01-04", val_frac=0.2)
DAYS = "days AS (SELECT DISTINCT session_date AS date FROM bars), sd AS (SELECT date, row_number() OVER (ORDER BY date DESC) <= greatest(ceil(count(*) OVER () * 0.25), 1) AS test FROM days), ft AS (SELECT min(date) AS f FROM sd WHERE test), parts AS (SELECT date, CASE WHEN test THEN 'test' WHEN f - date > 2 AND date >= DATE '2024-01-04' THEN 'train' ELSE 'dropped' END AS part FROM sd, ft)"


@query("day_split", with_ctes(BARS, DAYS) + "SELECT date, part FROM parts")
def _split(spark, sf):
    return sp.day_split(bars(spark, sf), SPLIT)


@query("validation_split", with_ctes(BARS, DAYS) + ", t AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS k, count(*) OVER () AS n FROM parts WHERE part = 'train') SELECT date, CASE WHEN k <= least(greatest(ceil(n * 0.2), 1), n - 1) THEN 'val' ELSE 'core' END AS part FROM t")
def _val(spark, sf):
    return sp.validation_split(sp.day_split(bars(spark, sf), SPLIT).where("part = 'train'"), SPLIT)


@query("row_split", "WITH k AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events), p AS (SELECT event_id, i + 1 AS row_index, CASE WHEN i >= 49 AND i < floor(n * 0.7) THEN 'train' WHEN i >= floor(n * 0.7) + 60 AND i < floor(n * 0.85) THEN 'val' WHEN i >= floor(n * 0.85) + 60 AND i < n - 10 THEN 'test' END AS part FROM k) SELECT event_id, row_index, part FROM p WHERE part IS NOT NULL")
def _rows(spark, sf):
    e = tables.table(spark, sf, "events").select("event_id", "ts")
    return sp.row_split(e, ["ts", "event_id"], 50, 10).select("event_id", "row_index", "part")


@query("split_membership", with_ctes(BARS, DAYS) + f"SELECT symbol, session_date, ts, {r('close', 'close')} FROM bars WHERE session_date IN (SELECT date FROM parts WHERE part = 'test')")
def _members(spark, sf):
    t = bars(spark, sf)
    test = sp.day_split(t, SPLIT).where("part = 'test'").select(F.col("date").alias("session_date"))
    return rounded(t.join(test, "session_date", "left_semi").select(*b.KEY, "ts", "close"))


@query("quality_depth", with_ctes(BARS) + f", q AS (SELECT symbol, session_date, row_number() OVER (ORDER BY v DESC, symbol, session_date) AS rank FROM (SELECT symbol, session_date, sum(volume) AS v FROM bars GROUP BY 1, 2)) SELECT symbol, session_date, ts, {r('close', 'close')} FROM bars JOIN q USING (symbol, session_date) WHERE rank <= 25")
def _quality(spark, sf):
    from tapeloom.functions.ordered import ordered_prefix

    t = bars(spark, sf)
    vol = t.groupBy(*b.KEY).agg((-F.sum("volume")).alias("v"))
    manifest = ordered_prefix(vol, ["v", *b.KEY], index="rank")
    return rounded(sp.limit_by_quality(t, manifest, 25).select(*b.KEY, "ts", "close"))


# the draw uses Spark's 64-bit hash, so the oracle checks what does not depend on it: the sizes
@query("stratified_cap", with_ctes(LABEL_CTES) + ", l AS (SELECT symbol, session_date, label, count(*) AS m FROM labels_v WHERE label IS NOT NULL GROUP BY ALL), t AS (SELECT *, sum(m) OVER (PARTITION BY symbol, session_date) AS n FROM l) SELECT symbol, session_date, label, (CASE WHEN n <= 20 THEN m ELSE least(m, greatest(ceil(m * 20 / n), 1)) END)::BIGINT AS rows FROM t")
def _cap(spark, sf):
    lab = labelled(spark, sf).where("label is not null")
    return sp.stratified_cap(lab, 20, 7).groupBy(*b.KEY, "label").agg(F.count(F.lit(1)).alias("rows"))


@query("keep_positives", with_ctes(LABEL_CTES) + f"""SELECT symbol, session_date, ts, {rcols(['target_ps', 'stop_ps', 'label', 'entry_px', 'exit_s', 'timeout_edge'])} FROM labels_v
    WHERE label = 1 OR label IS NOT NULL AND ('0x' || left(md5(concat_ws('|', symbol, session_date::VARCHAR, ts::VARCHAR, 7)), 8))::BIGINT / 4294967296.0 < 0.15""")
def _positives(spark, sf):
    lab = labelled(spark, sf).where("label is not null")
    return rounded(sp.keep_positives(lab, F.col("label") == 1, 0.15, 7, [*b.KEY, "ts"]))


@query("hash_draws_per_tenth", "SELECT floor(('0x' || left(md5(concat_ws('|', event_id, 7)), 8))::BIGINT / 4294967296.0 * 10)::INT AS tenth, count(*) AS n FROM events GROUP BY 1")
def _draws(spark, sf):
    e = tables.table(spark, sf, "events")
    return e.groupBy(F.floor(stable_unit(7, "event_id") * 10).cast("int").alias("tenth")).agg(F.count(F.lit(1)).alias("n"))


@query("matched_threshold", with_ctes(SCORED) + f", k AS (SELECT p_win, row_number() OVER (ORDER BY p_win) - 1 AS i, count(*) OVER () AS n FROM scored), q AS (SELECT max((n - 1) * (1 - 500.0::DOUBLE / n)) AS pos FROM k) SELECT {r('max(p_win) FILTER (i = floor(pos)) + (max(p_win) FILTER (i = ceil(pos)) - max(p_win) FILTER (i = floor(pos))) * (max(pos) - floor(max(pos)))', 'threshold')} FROM k, q")
def _threshold(spark, sf):
    return rounded(sp.matched_threshold(scored_labels(spark, sf).select("p_win"), 500))


SCALED = FEATURE_COLS


def q3(c: str) -> str:
    return f"SELECT '{c}' AS feature, quantile_cont({c}, 0.5) AS median, CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) > 1e-12 THEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) ELSE 1 END AS iqr FROM feats WHERE day(session_date) <= 20"


def feature_table(spark, sf):
    return bf.bar_features(bars(spark, sf), FEATURES).select(*b.KEY, "ts", *SCALED)


@query("robust_scaler", with_ctes(FEATURE_CTES) + ", q AS (" + " UNION ALL ".join(q3(c) for c in SCALED) + f") SELECT feature, {rcols(['median', 'iqr'])} FROM q")
def _scaler(spark, sf):
    return rounded(sp.robust_scaler(feature_table(spark, sf).where("day(session_date) <= 20"), SCALED))


def scaled_sql(c: str) -> str:
    m, q = (f"(SELECT {x} FROM q WHERE feature = '{c}')::FLOAT" for x in ("median", "iqr"))
    return r(f"coalesce(({c}::FLOAT - {m})::FLOAT / {q}, 0)", c, 3)


@query("scaled_features", with_ctes(FEATURE_CTES) + ", q AS (" + " UNION ALL ".join(q3(c) for c in SCALED) + f") SELECT symbol, session_date, ts, {', '.join(scaled_sql(c) for c in SCALED)} FROM feats")
def _scaled(spark, sf):
    from tapeloom.session import cut

    f = cut(feature_table(spark, sf))
    path = fs.scratch_path(spark, "scaler")
    fs.save_scaler(sp.robust_scaler(f.where("day(session_date) <= 20"), SCALED), path)
    return rounded(sp.apply_scaler(f, fs.load_scaler(spark, path), SCALED), 3)


@query("average_precision", with_ctes(SCORED) + f", s AS (SELECT p_win, sum((label = 1)::INT) AS tp, count(*) AS n FROM scored WHERE label IS NOT NULL GROUP BY 1), c AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER () AS p FROM s WINDOW w AS (ORDER BY p_win DESC)) SELECT {r('sum(ctp / cn * tp / p)', 'average_precision')} FROM c")
def _ap(spark, sf):
    d = scored_labels(spark, sf).where("label is not null").select("p_win", (F.col("label") == 1).cast("int").alias("y"))
    return rounded(sp.average_precision(d))


TENSOR = "PARTITION BY symbol, session_date ORDER BY ts"


@query(
    "window_tensors",
    with_ctes(FEATURE_CTES) + f"""SELECT symbol, session_date, ts, row_number() OVER ({TENSOR}) AS position, 8 AS width,
    {", ".join(f"{r(f'sum(coalesce({c}::FLOAT::DOUBLE, 0)) OVER f', f'sum_{c}', 3)}, count({c}) OVER f AS n_{c}" for c in FEATURE_COLS)}
    FROM feats WINDOW f AS ({TENSOR} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""",
)
def _tensors(spark, sf):
    """Windows of eight rows of every feature; sums and counts of each feature over its window."""
    f = bf.bar_features(bars(spark, sf), FEATURES)
    t = bf.window_tensors(f, FEATURE_COLS, 8)

    def cells(i: int, c: str) -> list:
        total = F.aggregate("window", F.lit(0.0), lambda acc, v: acc + F.coalesce(v[i].cast("double"), F.lit(0.0)))
        return [rnd(total, 3).alias(f"sum_{c}"), F.size(F.filter("window", lambda v: v[i].isNotNull())).cast("long").alias(f"n_{c}")]

    cells = [x for i, c in enumerate(FEATURE_COLS) for x in cells(i, c)]
    return t.select(*b.KEY, "ts", F.col("position").cast("long").alias("position"), F.size("window").alias("width"), *cells)


@query("log_target", study_ctes() + f"SELECT symbol, session_date, horizon_s, {r('ln(1 + greatest(taker_clip_pnl - 500, 0))', 'y')} FROM study")
def _log_target(spark, sf):
    s = study(spark, sf)
    return rounded(s.select(*b.KEY, "horizon_s", log_target(F.col("taker_clip_pnl") - 500).alias("y")))


# ---------------------------------------------------------------- sources and sinks
@query("bars_round_trip", with_ctes(BARS) + f"SELECT symbol, session_date, ts, {r('close', 'close')}, volume, {r('bid', 'bid')} FROM bars")
def _round_trip(spark, sf):
    path = fs.scratch_path(spark, "bars")
    fs.write_bars(bars(spark, sf), path)
    return rounded(spark.read.parquet(path).select(*b.KEY, "ts", "close", "volume", "bid"))


@query("resumed_corpus", with_ctes(BARS) + ", d AS (SELECT symbol, session_date, count(*) AS rows, sum(n_trades)::BIGINT AS n FROM bars GROUP BY ALL) SELECT symbol, session_date AS date, 'ok' AS status, rows, n AS n_trades FROM d WHERE day(session_date) % 4 <> 0")
def _resumed(spark, sf):
    """A quarter of the days is already settled; only the rest is built and logged."""
    from tapeloom.session import cut

    t = cut(bars(spark, sf))
    wanted = t.select("symbol", F.col("session_date").alias("date")).distinct().withColumn("rank", F.dayofyear("date").cast("long"))
    manifest, store = fs.scratch_path(spark, "manifest"), fs.scratch_path(spark, "corpus")
    done = wanted.where("day(date) % 4 = 0").select("symbol", "date", F.when(F.dayofmonth("date") % 8 == 0, "empty").otherwise("ok").alias("status"), F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("n_trades"), "rank")
    failed = wanted.where("day(date) % 4 = 1").select("symbol", "date", F.lit("error").alias("status"), F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("n_trades"), "rank")
    done.unionByName(failed).write.csv(manifest, header=True)
    return fs.build_missing(wanted, manifest, t, store).drop("rank")


@query("universe_symbols", "SELECT DISTINCT trim(upper(left(p_name, 4))) AS symbol FROM part WHERE regexp_matches(trim(upper(left(p_name, 4))), '^[A-Za-z]{1,5}$')")
def _universe(spark, sf):
    path = fs.scratch_path(spark, "universe")
    tables.table(spark, sf, "part").select(F.upper(F.substring("p_name", 1, 4)).alias("Symbol")).write.csv(path, header=True)
    return fs.load_universe(spark, [path + "-missing", path])


@query("replaced_snapshot", "SELECT s_name AS symbol, coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END, 0.0) AS score FROM supplier")
def _snapshot(spark, sf):
    path = fs.scratch_path(spark, "watchlist")
    s = tables.table(spark, sf, "supplier").select(F.col("s_name").alias("symbol"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("score"))
    fs.replace_all(s.where("symbol like '%1'"), path)
    fs.replace_all(s, path)
    return read_published(spark, path)


@query("stored_watchlist", "SELECT row_number() OVER (ORDER BY coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END, 0.0) DESC, s_name) AS position, s_name AS symbol, coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END, 0.0) AS score FROM supplier")
def _stored_watchlist(spark, sf):
    """The watchlist as it was last published, by falling score."""
    rows = ordered_prefix(_snapshot(spark, sf), [F.desc("score"), "symbol"], index="position")
    return rows.select("position", "symbol", "score")


@query("written_report", "SELECT l_returnflag AS flag, count(*) AS n, min(l_shipdate)::DATE AS first_day, k AS kind FROM lineitem, (VALUES ('csv'), ('json'), ('parquet')) v(k) GROUP BY l_returnflag, k")
def _report(spark, sf):
    """A report table, read back from each of its formats."""
    path = fs.scratch_path(spark, "report")
    rows = tables.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.min("l_shipdate").cast("date").alias("first_day"))
    fs.write_report(rows, path)
    schema = "flag string, n long, first_day date"
    read = {"csv": spark.read.schema(schema).csv(f"{path}/csv", header=True), "json": spark.read.schema(schema).json(f"{path}/json"), "parquet": spark.read.parquet(f"{path}/parquet")}
    out = None
    for kind, df in read.items():
        df = df.withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df)
    return out


@query("appended_rows", "SELECT o_orderkey AS id, o_totalprice AS equity FROM orders")
def _appended(spark, sf):
    path = fs.scratch_path(spark, "equity")
    o = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("equity"))
    fs.append_rows(o.where("id % 2 = 0"), path)
    fs.append_rows(o.where("id % 2 = 1"), path)
    return spark.read.parquet(path)


@query("session_flags", """WITH s AS (SELECT DISTINCT CAST(ts - INTERVAL 5 HOUR AS DATE) AS d FROM events WHERE dayofweek(ts - INTERVAL 5 HOUR) BETWEEN 1 AND 5), c AS (SELECT d, d + INTERVAL 870 MINUTE AS o, d + INTERVAL 1260 MINUTE AS c FROM s)
    SELECT event_id, coalesce(ts >= o AND ts < c, false) AS session_open, coalesce(ts >= o AND ts < c AND ts BETWEEN o + INTERVAL 5 MINUTE AND c - INTERVAL 10 MINUTE, false) AS entry_window,
    coalesce(ts >= o AND ts < c AND ts >= c - INTERVAL 5 MINUTE, false) AS last_minutes, false AS month_end_session FROM events LEFT JOIN c ON CAST(ts - INTERVAL 5 HOUR AS DATE) = d""")
def _flags(spark, sf):
    e = tables.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    d = F.to_date(F.from_utc_timestamp("ts", "America/New_York"))
    s = e.select(d.alias("date")).distinct().where("dayofweek(date) between 2 and 6")
    base = F.unix_micros(F.col("date").cast("timestamp"))
    s = s.select("date", F.timestamp_micros(base + F.lit(870 * 60_000_000)).alias("open_ts"), F.timestamp_micros(base + F.lit(1260 * 60_000_000)).alias("close_ts"))
    return fs.session_flags(e, s).select("event_id", "session_open", "entry_window", "last_minutes", "month_end_session")


@query("month_end_sessions", """WITH o AS (SELECT o_orderkey AS id, o_orderdate + to_microseconds((52200 + o_orderkey % 28800) * 1000000) AS ts FROM orders),
    s AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM o WHERE dayofweek(ts) BETWEEN 1 AND 5), e AS (SELECT d, coalesce(date_trunc('month', lead(d) OVER (ORDER BY d)) <> date_trunc('month', d), false) AS last FROM s),
    c AS (SELECT *, last_value(CASE WHEN last THEN d END IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM e)
    SELECT id, coalesce(ts < d + INTERVAL 1260 MINUTE, false) AS session_open, coalesce(ts < d + INTERVAL 1260 MINUTE AND last, false) AS month_end_session, prior AS prior_month_end FROM o LEFT JOIN c ON CAST(ts AS DATE) = d""")
def _month_ends(spark, sf):
    """Order times against a calendar of the weekdays that had orders."""
    o = tables.table(spark, sf, "orders")
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (52200 + F.col("o_orderkey") % 28800) * F.lit(1_000_000)
    rows = o.select(F.col("o_orderkey").alias("id"), F.timestamp_micros(at).alias("ts"))
    days = rows.select(F.to_date("ts").alias("date")).distinct().where("dayofweek(date) between 2 and 6")
    base = F.unix_micros(F.col("date").cast("timestamp"))
    cal = days.select("date", F.timestamp_micros(base + F.lit(870 * 60_000_000)).alias("open_ts"), F.timestamp_micros(base + F.lit(1260 * 60_000_000)).alias("close_ts"))
    return fs.session_flags(rows, cal).select("id", "session_open", "month_end_session", "prior_month_end")


@query("book_file_pair", """WITH x AS (SELECT event_id AS seq, round(value, 2) AS v, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)
    SELECT (row_number() OVER (ORDER BY seq) - 1) AS seq, seq::DOUBLE AS event_time, round(v + 1, 2) + 0.0 AS ask_p_0, 3.0::DOUBLE AS ask_v_0, round(v - 1, 2) + 0.0 AS bid_p_0, (1 + k % 5)::DOUBLE AS bid_v_0,
    round(v + 2, 2) + 0.0 AS ask_p_1, 4.0::DOUBLE AS ask_v_1, round(v - 2, 2) + 0.0 AS bid_p_1, (1 + k % 7)::DOUBLE AS bid_v_1, 0.0001::DOUBLE AS tick_size,
    CASE WHEN k % 6 IN (4, 5) AND k % 2 = 0 THEN k ELSE 0 END::DOUBLE AS buy_flow, CASE WHEN k % 6 IN (4, 5) AND k % 2 = 1 THEN k ELSE 0 END::DOUBLE AS sell_flow FROM x""")
def _pair(spark, sf):
    """Writes the events as an order-book / message file pair, then loads the pair back."""
    e = tables.table(spark, sf, "events").select("event_id", F.round("value", 2).alias("v"), F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    e = e.repartitionByRange(4, "event_id").sortWithinPartitions("event_id")
    levels = [F.col("v") + 1, F.lit(3), F.col("v") - 1, 1 + F.col("k") % 5, F.col("v") + 2, F.lit(4), F.col("v") - 2, 1 + F.col("k") % 7]
    book, msg = fs.scratch_path(spark, "book"), fs.scratch_path(spark, "message")
    e.select(F.concat_ws(",", *[c.cast("string") for c in levels]).alias("value")).write.text(book)
    side = F.when(F.col("k") % 2 == 0, -1).otherwise(1)
    e.select(F.concat_ws(",", *[c.cast("string") for c in (F.col("event_id"), F.col("k") % 6, F.col("event_id"), F.col("k"), F.lit(1), side)]).alias("value")).write.text(msg)
    out = fs.load_book_pair(spark, book, msg, 2)
    cells = [(F.col("levels")[i][c] if c.endswith("v") else rnd(F.col("levels")[i][c], 2)).alias(f"{c}_{i}") for i in range(2) for c in ("ask_p", "ask_v", "bid_p", "bid_v")]
    return out.select("seq", "event_time", *cells, "tick_size", "buy_flow", "sell_flow")


@query("distinct_symbols", with_ctes(DAILY) + "SELECT DISTINCT symbol FROM daily ORDER BY symbol")
def _distinct(spark, sf):
    return tables.daily(spark, sf).select("symbol").distinct().orderBy("symbol")


@query("symbol_set_difference", with_ctes(DAILY) + "SELECT symbol, 'only_daily' AS side FROM (SELECT symbol FROM daily EXCEPT SELECT 'P' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) UNION ALL SELECT symbol, 'both' FROM (SELECT symbol FROM daily INTERSECT SELECT 'P' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)")
def _sets(spark, sf):
    a = tables.daily(spark, sf).select("symbol").distinct()
    o = tables.table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("P"), "s_suppkey").alias("symbol"))
    return a.join(o, "symbol", "left_anti").withColumn("side", F.lit("only_daily")).unionByName(a.join(o, "symbol", "left_semi").withColumn("side", F.lit("both")))


@query("days_per_symbol", with_ctes(DAILY) + "SELECT symbol, count(*) AS days FROM daily GROUP BY 1")
def _days_per_symbol(spark, sf):
    d = tables.daily(spark, sf).select("symbol", "date").distinct()
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("days"))



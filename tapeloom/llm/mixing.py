"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks.

1. Targets: sources share the corpus size by weight; a target stops at ``most``
   times its source, and the excess is reshared. The shares that remain after all
   resharing are those of one common level, found by sorting the sources by
   (cap / weight): everything before the first uncapped source is capped.
2. Quotas: blocks go to the sources by highest quotients target / (2 s + 1), and
   from each source to its shards by highest quotients of the shard sizes.
   Rounding target / divisor gives all but a few seats at once; only the quotients
   around the last seats are listed and ranked.
3. Blocks: a shard is its documents in a seeded order, cut every ``block`` words.
   Whole passes take every block; the rest is a run of blocks from a seeded start,
   wrapping round. Block limits are arithmetic on running sums, so a document's
   taken words need no list of blocks, and at most two documents of a run are cut.

A source is spread over up to ``max_shards`` shards by a hash, so even one that
holds a third of the corpus has no large window. Everything is DataFrame code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import n_words, stored


@dataclass(frozen=True)
class MixConfig:
    """weights repeat over the sources in code-point order, null last.

    most: passes over a source (and so over a document) at most. block: words per
    block at most; smaller corpora get blocks of size / min_blocks words, one at
    least. shard_words, max_shards: wanted size of a shard and most shards per
    source, a power of two (sources are cut into powers of two as well).
    """

    weights: tuple[int, ...] = (5, 2, 1)
    most: int = 3
    block: int = 32
    min_blocks: int = 1 << 16
    shard_words: int = 1 << 17
    max_shards: int = 4096
    seed: str = "mix-1"


def _drawn(*parts: str | Column) -> Column:
    """32 seeded bits as a long, the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, cfg: MixConfig) -> DataFrame:
    """``sizes(source, source_size)``, one row per source, with weight and target added."""
    order = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, cfg.weights)), (F.col("rank") % len(cfg.weights) + 1).cast("int"))
    cap = cfg.most * F.col("source_size")
    every = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.col("open"))
        .withColumn("capped", F.col("cap") < F.col("weight") * F.col("level"))
        .withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(every))
        .select("source", "source_size", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target"))
    )


def apportion(df: DataFrame, item: str, votes: str, seats: str, by: list[str]) -> DataFrame:
    """Add ``quota``: the Sainte-Laguë share of ``seats`` (one value per group) by ``votes``.

    Equal quotients go to the smaller item, null last. With divisor votes / seats,
    rounding misses the seats of a group of n items by n / 2 at most, and an item
    gains or loses at most 1.5 n times its share, plus one: those quotients are ranked.
    """
    group = Window.partitionBy(*by)
    items = (
        df.withColumn("__total", F.sum(votes).over(group))
        .withColumn("__n", F.count(F.lit(1)).over(group))
        .withColumn("__share", F.when(F.col("__total") > 0, F.col(votes) / F.col("__total")).otherwise(0.0))
        .withColumn("__base", F.floor(F.col("__share") * F.col(seats) + 0.5).cast("long"))
        .withColumn("__miss", F.col(seats) - F.sum("__base").over(group))
    )
    span = F.ceil(1.5 * F.col("__n") * F.col("__share")).cast("long") + 1
    # each step: the seat number s (from 1) that the item would gain or lose
    step = F.when(F.col("__miss") > 0, F.sequence(F.col("__base") + 1, F.col("__base") + span)).when(
        F.col("__miss") < 0, F.sequence(F.col("__base"), F.greatest(F.col("__base") - span + 1, F.lit(1)), F.lit(-1).cast("long"))
    )
    step = F.when((F.col(votes) > 0) & ((F.col("__miss") > 0) | (F.col("__base") > 0)), step)
    quotient = F.col(votes) / (2 * F.col("__s") - 1)
    best = Window.partitionBy(*by).orderBy(F.desc("__q"), F.asc_nulls_last(item))
    worst = Window.partitionBy(*by).orderBy(F.asc("__q"), F.desc_nulls_first(item))
    moved = (
        items.select(*by, item, votes, "__miss", F.explode(step).alias("__s"))
        .withColumn("__q", quotient)
        .withColumn("__rank", F.when(F.col("__miss") > 0, F.row_number().over(best)).otherwise(F.row_number().over(worst)))
        .where("__rank <= abs(__miss)")
        .groupBy(*by, item)
        .agg((F.count(F.lit(1)) * F.signum(F.first("__miss"))).cast("long").alias("__move"))
    )
    keys = [*by, item]
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    out = items.alias("l").join(moved.alias("r"), on, "left").select("l.*", "r.__move")
    return out.withColumn("quota", F.col("__base") + F.coalesce("__move", F.lit(0))).drop("__total", "__n", "__share", "__base", "__miss", "__move")


def _by_source(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    """``left`` with columns of the row of its source; a null source is a source."""
    on = F.col("l.source").eqNullSafe(F.col("r.source"))
    return left.alias("l").join(right.select("source", *columns).alias("r"), on).select("l.*", *[f"r.{c}" for c in columns])


def shard_plan(docs: DataFrame, cfg: MixConfig) -> tuple[DataFrame, DataFrame]:
    """Sources with their number of shards, and per (source, shard) the passes and the run of blocks.

    ``docs`` is read once for sizes per (source, fine shard); the driver learns only
    the corpus size.
    """
    fine = stored(
        docs.select("source", n_words("text").alias("size"), (_id_draw(cfg) % cfg.max_shards).alias("fine"))
        .groupBy("source", "fine").agg(F.sum("size").alias("shard_size"))
    )
    total = fine.agg(F.sum("shard_size")).first()[0] or 0
    block = max(1, min(cfg.block, total // cfg.min_blocks))
    sources = source_targets(fine.groupBy("source").agg(F.sum("shard_size").alias("source_size")), cfg)
    seats = F.floor(F.lit(total) / F.lit(block) + 0.5).cast("long")
    wanted = F.least(F.ceil(F.col("source_size") / cfg.shard_words), F.lit(cfg.max_shards))
    cut_into = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(wanted, F.lit(1))))).cast("long")  # divides max_shards, so fine shards add up
    sources = stored(apportion(sources.withColumn("seats", seats), "source", "target", "seats", []).select("source", "source_size", "target", F.col("quota").alias("source_quota"), cut_into.alias("shards")))
    shards = _by_source(fine, sources, "shards").groupBy("source", (F.col("fine") % F.col("shards")).alias("shard")).agg(F.sum("shard_size").alias("shard_size"))
    joined = _by_source(shards, sources, "source_size", "target", "source_quota")
    blocks = F.ceil(F.col("shard_size") / F.lit(block)).cast("long")
    start = _drawn(F.lit(cfg.seed), F.coalesce("source", F.lit("")), F.col("shard").cast("string"))
    plan = (
        apportion(joined, "shard", "shard_size", "source_quota", ["source"])
        .withColumn("blocks", blocks)
        .withColumn("quota", F.least("quota", cfg.most * F.col("blocks")))
        .withColumn("passes", F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0).cast("long"))
        .withColumn("run", F.col("quota") - F.col("passes") * F.col("blocks"))
        .withColumn("start", F.when(F.col("blocks") > 0, start % F.col("blocks")).otherwise(0))
        .withColumn("lo", F.col("start") * block)
        .withColumn("hi", F.least(F.col("start") + F.col("run"), "blocks") * block)
        .withColumn("wrap", F.greatest(F.col("start") + F.col("run") - F.col("blocks"), F.lit(0)) * block)
        .select("source", "shard", "source_size", "target", "passes", "lo", "hi", "wrap")
    )
    return sources.select("source", "shards"), stored(plan)


def _id_draw(cfg: MixConfig) -> Column:
    return _drawn(F.lit(cfg.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def _spans(docs: DataFrame, cfg: MixConfig, carried: list[str]) -> DataFrame:
    """row (the carried columns), size, source_size, target, passes, and the two word spans of a further, partial pass."""
    sources, plan = shard_plan(docs, cfg)
    key = F.md5(F.concat_ws("/", F.lit(cfg.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select(
        F.struct(*carried).alias("row"), "source", "doc_id", n_words("text").alias("size"), _id_draw(cfg).alias("draw"), F.substring(key, 9, 24).alias("key"), F.md5("text").alias("tie")
    )
    placed = _by_source(rows, sources, "shards").withColumn("shard", F.col("draw") % F.col("shards"))
    order = Window.partitionBy("source", "shard").orderBy("key", "doc_id", "size", "tie")
    at = placed.withColumn("begin", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    on = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.shard") == F.col("p.shard"))
    joined = at.alias("d").join(plan.alias("p"), on).select("row", "size", "begin", "source_size", "target", "passes", "lo", "hi", "wrap")

    def inside(x: str) -> Column:
        return F.least(F.greatest(F.col(x) - F.col("begin"), F.lit(0)), "size")

    return joined.select(
        "row", "size", "source_size", "target", "passes",
        F.struct(inside("lo").alias("i"), inside("hi").alias("j")).alias("late"), F.struct(F.lit(0).cast("long").alias("i"), inside("wrap").alias("j")).alias("early"),
    )


def mix_plan(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs(doc_id, text, source)``.

    taken counts the words the mix takes from the row, repeats included; it is at
    most ``most`` times its size. Null and blank texts have size 0 and are not
    taken; a null source is a source; null ids and repeated rows are mixed like any
    other (rows alike in id, source and text are interchangeable); other columns are
    ignored; an empty table gives no rows. Reruns agree: every draw is a seeded md5.
    """
    spans = _spans(docs.select("doc_id", "text", "source"), cfg, ["doc_id"])
    part = F.col("late.j") - F.col("late.i") + F.col("early.j") - F.col("early.i")
    return spans.select("row.doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + part).alias("taken"))


def mix_documents(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, one row per taken copy of a document.

    A copy cut by the end of a run holds only its taken words, with their spacing;
    a column n_chars, if there is one, is counted anew for it.
    """
    spans = _spans(docs, cfg, docs.columns)
    whole = F.struct(F.lit(0).cast("long").alias("i"), F.col("size").alias("j"))
    copies = F.filter(F.concat(F.array_repeat(whole, F.col("passes").cast("int")), F.array("late", "early")), lambda s: s["i"] < s["j"])
    taken = spans.select("row", "size", F.explode(copies).alias("span"))
    text = F.col("row.text")
    pieces = F.split(text, "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])")
    lead = F.when(text.rlike("^[\\x20\\x09-\\x0D]"), 1).otherwise(0)
    first, n = F.col("span.i").cast("int"), (F.col("span.j") - F.col("span.i")).cast("int")
    cut_text = F.array_join(F.slice(pieces, first + lead + 1, n), "")
    is_cut = n < F.col("size")
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.when(is_cut, cut_text).otherwise(text).alias(c))
        elif c == "n_chars":
            cols.append(F.when(is_cut, F.char_length(cut_text)).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col("row")[c].alias(c))
    return taken.select(*cols)


def oracle_sql(cfg: MixConfig = MixConfig()) -> str:
    """``mix_plan`` in DuckDB SQL, for distinct ids."""
    weights = "[" + ", ".join(map(str, cfg.weights)) + "]"

    def draw(*parts: str) -> str:
        return f"('0x' || substr(md5(concat_ws('/', {', '.join(parts)})), 1, 8))::BIGINT"

    def apportion_sql(name: str, src: str, item: str, votes: str, seats: str, by: str) -> str:
        over, part = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
        part_order = f"PARTITION BY {by} " if by else ""
        on = f"a.{by} IS NOT DISTINCT FROM m.{by} AND " if by else ""
        return f"""
{name}_base AS (
  SELECT *, {seats} - sum(base) OVER ({over}) AS miss FROM (
    SELECT *, floor(share * {seats} + 0.5)::BIGINT AS base FROM (
      SELECT *, count(*) OVER ({over}) AS n,
        CASE WHEN sum({votes}) OVER ({over}) > 0 THEN {votes}::DOUBLE / sum({votes}) OVER ({over}) ELSE 0.0 END AS share FROM {src}))),
{name}_step AS (
  SELECT {part}{item}, miss, {votes}::DOUBLE / (2 * s - 1) AS q FROM (
    SELECT *, unnest(CASE WHEN miss > 0 THEN range(base + 1, base + ceil(1.5 * n * share)::BIGINT + 2)
      ELSE range(greatest(base - ceil(1.5 * n * share)::BIGINT, 1), base + 1) END) AS s FROM {name}_base WHERE {votes} > 0 AND miss <> 0)),
{name}_move AS (
  SELECT {part}{item}, count(*) * sign(any_value(miss)) AS move FROM (
    SELECT *, CASE WHEN miss > 0 THEN row_number() OVER ({part_order}ORDER BY q DESC, {item} ASC NULLS LAST)
      ELSE row_number() OVER ({part_order}ORDER BY q ASC, {item} DESC NULLS FIRST) END AS r FROM {name}_step) WHERE r <= abs(miss) GROUP BY ALL),
{name} AS (
  SELECT a.* EXCLUDE (n, share, base, miss), (a.base + coalesce(m.move, 0))::BIGINT AS quota
  FROM {name}_base a LEFT JOIN {name}_move m ON {on}a.{item} IS NOT DISTINCT FROM m.{item})"""

    return f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS tie,
    {draw(f"'{cfg.seed}'", "coalesce(doc_id::VARCHAR, '')")} AS draw, substr(md5(concat_ws('/', '{cfg.seed}', coalesce(doc_id::VARCHAR, ''))), 9, 24) AS k
  FROM documents),
par AS (SELECT t, greatest(1, least({cfg.block}, t // {cfg.min_blocks})) AS b FROM (SELECT coalesce(sum(size), 0)::BIGINT AS t FROM sized)),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (1::BIGINT << ceil(log2(greatest(1, least({cfg.max_shards}, (sum(size) + {cfg.shard_words - 1}) // {cfg.shard_words}))))::INT) AS n FROM sized GROUP BY source),
placed AS (SELECT s.*, draw % n AS shard FROM sized s JOIN src r ON s.source IS NOT DISTINCT FROM r.source),
shards AS (SELECT source, shard, sum(size)::BIGINT AS shard_size FROM placed GROUP BY ALL),
ranked AS (
  SELECT *, {cfg.most} * source_size AS cap, {weights}[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(cfg.weights)} + 1)::INT] AS weight FROM src),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS lv FROM ranked
  WINDOW w AS (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, CASE WHEN cap < weight * lv THEN cap::DOUBLE ELSE weight * max(lv) FILTER (cap >= weight * lv) OVER () END AS target,
    floor(t::DOUBLE / b + 0.5)::BIGINT AS seats FROM levels, par),
{apportion_sql("sq", "targets", "source", "target", "seats", "")},
joined AS (SELECT a.*, q.source_size, q.target, q.quota AS source_quota FROM shards a JOIN sq q ON a.source IS NOT DISTINCT FROM q.source),
{apportion_sql("pq", "joined", "shard", "shard_size", "source_quota", "source")},
plan AS (
  SELECT *, CASE WHEN blocks > 0 THEN {draw(f"'{cfg.seed}'", "coalesce(source, '')", "shard::VARCHAR")} % blocks ELSE 0 END AS start FROM (
    SELECT *, CASE WHEN blocks > 0 THEN least(quota, {cfg.most} * blocks) // blocks ELSE 0 END AS passes, least(quota, {cfg.most} * blocks) AS q2 FROM (
      SELECT p.*, b, (shard_size + b - 1) // b AS blocks FROM pq p, par))),
placed_at AS (
  SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY k, doc_id, size, tie ROWS UNBOUNDED PRECEDING) - size AS begin FROM placed),
spans AS (
  SELECT a.doc_id, a.size, p.source_size, p.target, p.passes,
    least(greatest(p.start * b - a.begin, 0), a.size) AS lo, least(greatest(least(p.start + q2 - passes * blocks, blocks) * b - a.begin, 0), a.size) AS hi,
    least(greatest(greatest(p.start + q2 - passes * blocks - blocks, 0) * b - a.begin, 0), a.size) AS wrap
  FROM placed_at a JOIN plan p ON a.source IS NOT DISTINCT FROM p.source AND a.shard = p.shard)
SELECT doc_id, size::BIGINT AS size, source_size, target, (passes * size + hi - lo + wrap)::BIGINT AS taken FROM spans"""

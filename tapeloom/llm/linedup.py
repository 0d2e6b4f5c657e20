"""Line dedup with overlapping three-line windows.

Every run of ``window`` consecutive lines is hashed. A window whose hash occurs
more than once in the corpus keeps its first occurrence (smallest document id,
then position); every later occurrence covers its lines, and the covered lines of
a document, merged over all its windows, are removed.

A frequent window costs one row per task and hash: counts and first places are
partially aggregated, and only the covered positions return to a document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import stored

_KEY = ["doc_id", "k1", "k2"]


@dataclass(frozen=True)
class LineDedupConfig:
    """window: consecutive lines that must repeat together."""

    window: int = 3


def _starts(lines: Column, w: int) -> Column:
    """Start positions of all windows; empty for fewer lines than a window."""
    last = F.size(lines) - w
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _has_words(lines: Column, p: Column, w: int) -> Column:
    return F.exists(F.slice(lines, p + 1, w), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def _covered(starts: Column, w: int) -> Column:
    return F.flatten(F.transform(starts, lambda p: F.sequence(p, p + (w - 1))))


def dedup_lines(docs: DataFrame, cfg: LineDedupConfig = LineDedupConfig()) -> DataFrame:
    """(doc_id, n_lines long, n_removed long, text) for every row of ``docs(doc_id, text)``.

    Lines are what newlines separate. Windows without a word don't count, nor does
    an occurrence that overlaps the first one in the same document. Documents with
    one id are ordered by a hash of their text; null ids come first. Of identical
    rows one counts as the first, and the others lose every line of every window
    with words. A null text stays null with no lines; an empty text is one line;
    other columns are ignored; an empty table gives no rows.
    """
    w = cfg.window
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2"))
    split = F.split("text", "\n", -1)
    # each line is hashed once; a window is the hash of its lines' hashes
    marks = F.transform(split, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), x.rlike("[^\\x20\\x09-\\x0D]").alias("words")))
    marked = rows.where(F.col("text").isNotNull()).select(*_KEY, marks.alias("m"))
    hashed = F.transform(
        F.filter(_starts(F.col("m"), w), lambda p: F.exists(F.slice("m", p + 1, w), lambda x: x["words"])),
        lambda p: F.struct(p.alias("p"), F.xxhash64(*[F.col("m")[p + i]["a"] for i in range(w)]).alias("h1"), F.xxhash64(*[F.col("m")[p + i]["b"] for i in range(w)]).alias("h2")),
    )
    found = stored(marked.select(*_KEY, F.inline(hashed)))
    first = stored(
        found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_KEY, "p")).alias("first")).where("n > 1").drop("n")
    )
    same = (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))
    later = found.join(first, ["h1", "h2"]).where(~(same & (F.col("p") < F.col("first.p") + w)))
    gone = stored(later.groupBy("k1", "k2").agg(F.collect_set("p").alias("starts")))  # at most the lines of one document
    joined = rows.join(gone, ["k1", "k2"], "left")  # the keys hold id and text, so the window below needs no exchange of its own
    copy = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(0)))
    every = F.filter(_starts(F.col("lines"), w), lambda p: _has_words(F.col("lines"), p, w))
    starts = F.when(F.col("copy") > 1, every).otherwise(F.coalesce("starts", F.array().cast("array<int>")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("cover"))
    return (
        joined.withColumn("copy", copy)
        .select("doc_id", "text", "starts", "copy", split.alias("lines"))
        .select("doc_id", "text", "lines", _covered(starts, w).alias("cover"))
        .select("doc_id", "text", "lines", F.when(F.size("cover") > 0, kept).alias("kept"))
        .select(
            "doc_id",
            F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
            F.when(F.col("kept").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
            F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join(F.transform("kept", lambda i: F.col("lines")[i]), "\n")).alias("text"),
        )
    )


def oracle_sql(w: int = 3) -> str:
    """The same result in DuckDB SQL, for unique non-null ids."""
    return f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
win AS (
  SELECT doc_id, p, array_to_string(l[p + 1 : p + {w}], chr(10)) AS h
  FROM (SELECT doc_id, l, unnest(range(0, len(l) - {w - 1})) AS p FROM d WHERE len(l) >= {w})),
rep AS (SELECT h, min(struct_pack(d := doc_id, p := p)) AS f FROM win WHERE regexp_matches(h, '[^\\x20\\x09-\\x0D]') GROUP BY h HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT w.doc_id, unnest(range(w.p, w.p + {w})) AS i FROM win w JOIN rep r ON w.h = r.h
  WHERE NOT (w.doc_id = r.f.d AND w.p < r.f.p + {w})),
lines AS (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS line FROM d),
kept AS (
  SELECT x.doc_id, string_agg(x.line, chr(10) ORDER BY x.i) AS text, count(*) AS n
  FROM lines x ANTI JOIN gone g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY 1)
SELECT d.doc_id, coalesce(len(d.l), 0)::BIGINT AS n_lines, coalesce(len(d.l) - coalesce(k.n, 0), 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id"""

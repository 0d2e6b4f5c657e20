"""Merkle manifest of a dataset: a tree per source, and one over the sources.

A level is a table with one row per parent. Conditional aggregates spread the
children of a parent into one column per slot, and the concatenated columns give
its hash. On the way down the same columns serve the proofs: a child's siblings
are its parent's slot columns without its own, followed by the parent's own proof.

Positions come from a range-partitioned index, so a source with most of the rows
is spread like any other; parents are grouped by (source, parent position), at most
``fanout`` rows each. Levels shrink by the fanout; every level is written once on the
way up, and once with its proofs on the way down.
The texts are read once and hashed where they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.ordered import ordered_prefix
from tapeloom.llm.common import fold_mod, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class ManifestConfig:
    """fanout: children per parent. fields: what a leaf's hash covers, in this order."""

    fanout: int = 3
    fields: tuple[str, ...] = FIELDS


def _field(value: Column) -> Column:
    as_text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(as_text).cast("string"), F.lit(":"), as_text))


def leaf_hash(cfg: ManifestConfig = ManifestConfig(), **instead: Column) -> Column:
    """Hash of a row's fields, each ``-`` or its length in bytes and its value; ``instead`` replaces single fields."""
    return F.sha2(F.concat(*[_field(instead.get(c, F.col(c))) for c in cfg.fields]), 256)


def _slots(cfg: ManifestConfig) -> list[str]:
    return [f"h{s}" for s in range(cfg.fanout)]


def levels(nodes: DataFrame, cfg: ManifestConfig = ManifestConfig()) -> list[DataFrame]:
    """``nodes(g, i, h, n)`` and the levels above: (g, i, n, one hash per slot, h). n: nodes of the group on the level."""
    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        spread = [F.max(F.when(F.col("i") % cfg.fanout == s, F.col("h"))).alias(c) for s, c in enumerate(_slots(cfg))]
        parents = out[-1].where("n > 1").groupBy("g", F.floor(F.col("i") / cfg.fanout).alias("up")).agg(F.max("n").alias("n"), *spread)
        out.append(stored(parents.select("g", F.col("up").alias("i"), F.ceil(F.col("n") / cfg.fanout).alias("n"), *_slots(cfg), F.sha2(F.concat_ws("", *_slots(cfg)), 256).alias("h"))))
        most = -(-most // cfg.fanout)
    return out


def tops(tree: list[DataFrame]) -> DataFrame:
    """(g, h): the last node of every group."""
    out = tree[0].where("n = 1").select("g", "h")
    for level in tree[1:]:
        out = out.unionByName(level.where("n = 1").select("g", "h"))
    return out


def proofs(tree: list[DataFrame], above: DataFrame, cfg: ManifestConfig = ManifestConfig()) -> DataFrame:
    """The nodes of the lowest level with ``path``: an array, from the leaf upwards, of the
    hashes ``before`` and ``after`` the own one in each parent.

    ``above(g, path, ...)`` holds what follows at the top of a group; its other columns
    are handed to every node of the group.
    """
    given = [c for c in above.columns if c not in ("g", "path")]
    parents: DataFrame | None = None
    for level in reversed(tree):
        kept = [c for c in level.columns if level is tree[0] or c in ("g", "i", "n", "h", *_slots(cfg))]
        here = level.where("n = 1").join(above, "g").select(*kept, "path", *given)
        if parents is not None:
            own = F.col("c.i") % cfg.fanout
            siblings = F.struct(
                F.concat_ws("", *[F.when(own > s, F.col(f"p.{c}")) for s, c in enumerate(_slots(cfg))]).alias("before"),
                F.concat_ws("", *[F.when(own < s, F.col(f"p.{c}")) for s, c in enumerate(_slots(cfg))]).alias("after"),
            )
            inner = level.where("n > 1").alias("c").join(parents.alias("p"), (F.col("c.g") == F.col("p.g")) & (F.floor(F.col("c.i") / cfg.fanout) == F.col("p.i")))
            here = here.unionByName(inner.select(*[f"c.{x}" for x in kept], F.concat(F.array(siblings), "p.path").alias("path"), *[f"p.{x}" for x in given]))
        parents = here if level is tree[0] else stored(here)  # one small plan per level
    return parents


def fold(leaf: Column | str, path: Column | str) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, F.col(leaf) if isinstance(leaf, str) else leaf, lambda h, x: F.sha2(F.concat(x["before"], h, x["after"]), 256))


def proof_text(path: Column | str) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.concat_ws("", F.transform(path, lambda x: F.concat(x["before"], x["after"])))


def manifest(rows: DataFrame, cfg: ManifestConfig = ManifestConfig()) -> DataFrame:
    """``rows(doc_id, source, leaf, ...)`` with position, subroot, root and path.

    Leaves of a source ascend by doc_id (null first), rows with one id by their leaf;
    sources ascend by their UTF-8 bytes, null first. A lone leaf is its source's
    subroot, a lone subroot is the root; identical rows may change places. Columns
    named like the operator's own are not allowed; all others are handed through.
    An empty table gives no rows.
    """
    placed = ordered_prefix(rows, ["doc_id", "leaf"], by=["source"], index="place")
    per_source = ordered_prefix(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")), ["source"], index="at")
    leaves = (
        placed.alias("l")
        .join(per_source.alias("s"), F.col("l.source").eqNullSafe(F.col("s.source")))
        .select("l.*", (F.col("s.at") - 1).alias("g"), (F.col("l.place") - 1).alias("i"), "s.n", F.col("l.leaf").alias("h"))
    )
    tree = levels(stored(leaves), cfg)
    subroots = stored(tops(tree).select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), "h"))
    over = levels(subroots.select("*", F.lit(subroots.count()).cast("long").alias("n")), cfg)
    no_path = F.array().cast("array<struct<before: string, after: string>>")
    root = tops(over).select("g", no_path.alias("path"), F.col("h").alias("root"))
    above = proofs(over, root, cfg).select(F.col("i").alias("g"), "path", F.col("h").alias("subroot"), "root")
    return proofs(tree, above, cfg).drop("g", "i", "n", "h", "place")


def verify_tampered(docs: DataFrame, cfg: ManifestConfig = ManifestConfig()) -> DataFrame:
    """Proof of every row of ``docs``, checked against a copy of the table in which some texts changed.

    The copy lacks the newlines of texts whose id has an even CRC-32 (null ids count
    as the empty text, so they are changed). Returns doc_id, leaf, subroot, root,
    proof_sha256, folded_root, verified. Nulls are marked in a leaf's hash, so a null
    and an empty text differ; columns outside ``cfg.fields`` are ignored.
    """
    changed = F.when(fold_mod("doc_id", 2) == 0, leaf_hash(cfg, text=F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    hashed = stored(docs.select("doc_id", "source", leaf_hash(cfg).alias("leaf"), changed.alias("changed")))
    return manifest(hashed, cfg).select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(proof_text("path"), 256).alias("proof_sha256"),
        fold(F.coalesce("changed", "leaf"), "path").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 of a decimal number, in DuckDB SQL: one step per bit.
CRC32_SQL = """xor(list_reduce(
  list_concat([4294967295::BIGINT], list_transform(string_split({x}::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
  lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda v, z: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT)"""


def oracle_sql(fanout: int = 3) -> str:
    """The same result in DuckDB SQL, for unique non-null ids."""

    def leaf(text: str) -> str:
        parts = [f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END" for c in (*FIELDS[:-1], text)]
        return f"sha256({' || '.join(parts)})"

    def tree(name: str) -> str:
        return f"""
{name}(k, g, i, h, n) AS (
  SELECT 0, g, i, h, n FROM {name}0
  UNION ALL
  SELECT k + 1, g, i // {fanout}, sha256(string_agg(h, '' ORDER BY i)), any_value((n + {fanout - 1}) // {fanout}) FROM {name} WHERE n > 1 GROUP BY k, g, i // {fanout}),
{name}f AS (SELECT k, g, i // {fanout} AS p, list(h ORDER BY i) AS hs FROM {name} WHERE n > 1 GROUP BY ALL)"""

    def climb(name: str, of: str, start: str) -> str:
        return f"""
{name}(k, doc_id, g, i, n, proof, fold) AS (
  {start}
  UNION ALL
  SELECT c.k + 1, doc_id, c.g, c.i // {fanout}, (n + {fanout - 1}) // {fanout},
    proof || array_to_string(hs[: c.i % {fanout}] || hs[c.i % {fanout} + 2 :], ''),
    sha256(array_to_string(hs[: c.i % {fanout}] || [fold] || hs[c.i % {fanout} + 2 :], ''))
  FROM {name} c JOIN {of}f f ON f.k = c.k AND f.g = c.g AND f.p = c.i // {fanout} WHERE n > 1)"""

    return f"""
WITH RECURSIVE
d AS (
  SELECT doc_id, {leaf('text')} AS leaf, CASE WHEN {CRC32_SQL.format(x='doc_id')} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} END AS changed,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM documents),
low0 AS (SELECT g, i, leaf AS h, n FROM d),{tree('low')},
top0 AS (SELECT 0 AS g, g AS i, h, count(*) OVER () AS n FROM low WHERE n = 1),{tree('top')},
{climb('c', 'low', "SELECT 0, doc_id, g, i, n, '', coalesce(changed, leaf) FROM d")},
{climb('t', 'top', "SELECT 0, doc_id, 0, c.g, (SELECT max(n) FROM top0), proof, fold FROM c WHERE n = 1")}
SELECT d.doc_id, d.leaf, s.h AS subroot, r.h AS root, sha256(t.proof) AS proof_sha256, t.fold AS folded_root, t.fold = r.h AS verified
FROM d JOIN t ON t.doc_id = d.doc_id AND t.n = 1 JOIN top0 s ON s.i = d.g JOIN top r ON r.n = 1"""

"""Tool-call linking and canonical JSON, in DataFrame functions only.

Calls and results are joined by conversation and call id. Calls name the calls they
depend on; their order must put every call after its dependencies. Calls are already
ordered if every dependency stands earlier, which is the rule, so only dependencies
that stand later cost work: ``level`` counts, along the worst path, how many of them
lead to a call, and (level, turn, id) is then a topological order. Only the
conversations with such a dependency take part in finding levels: chains of calls
with one dependency are followed by doubling, the rest is what forks.

Arguments are parsed to variants, checked against the tool's parameters, and written
with sorted keys and no spaces. Rows of a conversation are never gathered: orders are
columns to sort by, and a conversation with very many calls is spread by call id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import cut

_ID = ["conv_id", "call_id"]
_ENDLESS = 1 << 40  # level of calls on or behind a cycle, above the number of edges


@dataclass(frozen=True)
class ToolCallConfig:
    """rounds: if set, levels above it are reported as ``deep``; they are found in any case."""

    rounds: int | None = None


def _same(l: str, r: str, columns: list[str]) -> Column:  # noqa: E741
    on = F.lit(True)
    for c in columns:
        on = on & F.col(f"{l}.{c}").eqNullSafe(F.col(f"{r}.{c}"))
    return on


def type_name(v: Column) -> Column:
    """JSON type of a variant: integer, number, string, boolean, null, array or object."""
    s = F.schema_of_variant(v)
    return (
        F.when(s.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | s.rlike("^DECIMAL\\(\\d+,0\\)$"), "integer")
        .when(s.isin("DOUBLE", "FLOAT") | s.startswith("DECIMAL"), "number")
        .when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null")
        .when(s.startswith("ARRAY"), "array").otherwise("object")
    )


def argument_errors(arguments: str, params: str) -> Column:
    """Sorted errors of a JSON object against array<struct<name, type, required>>.

    missing:x, unknown:x, type:x (an integer is a number), invalid_json if it isn't an object,
    unknown_tool if there are no parameters to check against.
    """
    given = F.from_json(arguments, "map<string,variant>")
    declared = F.col(params)
    missing = F.transform(F.filter(declared, lambda p: p["required"] & ~F.map_contains_key("given", p["name"])), lambda p: F.concat(F.lit("missing:"), p["name"]))
    wrong = F.transform(
        F.filter(
            declared,
            lambda p: F.map_contains_key("given", p["name"])
            & ~((type_name(F.col("given")[p["name"]]) == p["type"]) | ((p["type"] == "number") & (type_name(F.col("given")[p["name"]]) == "integer"))),
        ),
        lambda p: F.concat(F.lit("type:"), p["name"]),
    )
    unknown = F.transform(F.array_except(F.map_keys("given"), F.transform(declared, lambda p: p["name"])), lambda k: F.concat(F.lit("unknown:"), k))
    return given, F.when(F.col("given").isNull(), F.array(F.lit("invalid_json"))).when(declared.isNull(), F.array(F.lit("unknown_tool"))).otherwise(
        F.array_sort(F.concat(missing, wrong, unknown))
    )


def call_levels(calls: DataFrame, cfg: ToolCallConfig) -> DataFrame:
    """(conv_id, call_id, level int, order_error) of the calls in conversations with late dependencies.

    ``calls(conv_id, call_id, turn, after array)``, one row per id. order_error is
    ``cycle`` for calls on or behind a cycle (their level is null), ``deep`` for levels
    beyond ``rounds`` if that is set, else null.
    """
    known = calls.select(*_ID, "turn")
    edges = calls.select(*_ID, "turn", F.explode(F.array_distinct("after")).alias("to"))
    edges = edges.alias("e").join(known.alias("k"), F.col("e.conv_id").eqNullSafe(F.col("k.conv_id")) & (F.col("e.to") == F.col("k.call_id")))
    late = (F.struct("k.turn", "k.call_id") >= F.struct("e.turn", "e.call_id")).cast("long").alias("w")
    edges = cut(edges.select("e.conv_id", "e.call_id", "to", late))
    odd = edges.where("w > 0").select("conv_id").distinct()
    edges = edges.alias("e").join(odd.alias("o"), _same("e", "o", ["conv_id"]), "left_semi")
    nodes = known.alias("k").join(odd.alias("o"), _same("k", "o", ["conv_id"]), "left_semi").select(*_ID, F.lit(0).cast("long").alias("base"))
    level = _longest(nodes, edges)
    cyclic = F.col("level") >= _ENDLESS
    deep = F.lit(False) if cfg.rounds is None else F.col("level") > cfg.rounds
    return level.select(*_ID, F.when(~cyclic, F.col("level")).cast("int").alias("level"), F.when(cyclic, "cycle").when(deep, "deep").alias("order_error"))


def _longest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of ``nodes(conv_id, call_id, base)``: the heaviest path along ``edges(conv_id, call_id, to, w)``.

    level = max(base, level(to) + w over the edges), ``_ENDLESS`` or more where a path
    meets a cycle. In every round each node with at most one edge leaves the graph: it
    is followed to the first node with more edges (or to an end, or round a cycle) and
    the edges that led to it are led on. Nodes are left as long as paths fork, so
    chains and trees take a logarithmic number of rounds; no round forgets a path.
    """
    gone: list[DataFrame] = []
    while True:
        # parallel edges are one; a node that needs itself needs nothing else
        edges = edges.groupBy(*_ID, "to").agg(F.max("w").alias("w"))
        out = edges.groupBy(*_ID).agg(F.count(F.lit(1)).alias("n"), F.min("to").alias("to"), F.max("w").alias("w"), F.max(F.col("to") == F.col("call_id")).alias("own"))
        endless = F.coalesce("own", F.lit(False)) | (F.col("base") >= _ENDLESS)
        nodes = nodes.alias("v").join(out.alias("o"), _same("v", "o", _ID), "left").select("v.conv_id", "v.call_id", F.when(endless, _ENDLESS).otherwise(F.col("base")).alias("base"), F.when(endless, 0).otherwise(F.coalesce("n", F.lit(0))).alias("n"), "to", "w")
        nodes, edges = cut(nodes), cut(edges)
        if nodes.where("n = 0").isEmpty():  # every path goes on for ever
            left = nodes.select(*_ID, F.lit(_ENDLESS).alias("base"))
            break
        thin = _followed(nodes.where("n < 2"))
        gone.append(thin)
        if nodes.where("n > 1").isEmpty():
            left = None
            break
        fork = nodes.where("n > 1").select(*_ID, "base")
        own = edges.alias("e").join(fork.alias("f"), _same("e", "f", _ID), "left_semi")
        led = own.alias("e").join(thin.alias("t"), F.col("e.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("e.to") == F.col("t.call_id")), "left")
        led = cut(led.select("e.conv_id", "e.call_id", F.when(F.col("t.call_id").isNull(), F.col("e.to")).otherwise(F.col("t.to")).alias("to"), (F.col("e.w") + F.coalesce("t.w", F.lit(0))).alias("w"), (F.col("e.w") + F.col("t.base")).alias("base")))
        best = led.groupBy(*_ID).agg(F.max("base").alias("base"))
        nodes = fork.alias("f").join(best.alias("b"), _same("f", "b", _ID)).select("f.conv_id", "f.call_id", F.greatest("f.base", "b.base").alias("base"))
        edges = led.where("to is not null").select(*_ID, "to", "w")
    done = left
    for thin in reversed(gone):  # what a round followed to a fork is known once the fork is
        if done is None:
            done = thin.select(*_ID, "base")
            continue
        ended = thin.where("to is null").select(*_ID, "base")
        open_ = thin.where("to is not null").alias("t").join(done.alias("d"), F.col("t.conv_id").eqNullSafe(F.col("d.conv_id")) & (F.col("t.to") == F.col("d.call_id")))
        done = cut(done.unionByName(ended).unionByName(open_.select("t.conv_id", "t.call_id", F.greatest("t.base", F.col("d.base") + F.col("t.w")).alias("base"))))
    return done.withColumnRenamed("base", "level")


def _followed(thin: DataFrame) -> DataFrame:
    """``thin(conv_id, call_id, base, n, to, w)`` with n of at most 1, each followed as far as there are such nodes.

    Afterwards level = max(base, level(to) + w), where ``to`` is not in ``thin``, or base
    where it is null. Every round doubles the followed length; what is still inside
    after as many steps as there are nodes runs round a cycle.
    """
    first = thin.select(*_ID, "base", F.when(F.col("n") > 0, F.col("to")).alias("to"), F.when(F.col("n") > 0, F.col("w")).otherwise(0).alias("w"))
    inside = first.select("conv_id", F.col("call_id").alias("to"), F.lit(True).alias("inside"))
    at = first.alias("a").join(inside.alias("i"), F.col("a.conv_id").eqNullSafe(F.col("i.conv_id")) & (F.col("a.to") == F.col("i.to")), "left")
    at = cut(at.select("a.conv_id", "a.call_id", "base", "a.to", "w", F.coalesce("inside", F.lit(False)).alias("open")))
    longest = at.groupBy("conv_id").agg(F.count_if(F.col("open")).alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(longest).bit_length()):
        ahead = at.where("open").alias("a").join(at.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.to") == F.col("b.call_id")))
        ahead = ahead.select("a.conv_id", "a.call_id", F.greatest("a.base", F.col("b.base") + F.col("a.w")).alias("base"), "b.to", (F.col("a.w") + F.col("b.w")).alias("w"), "b.open")
        at = cut(at.where("not open").unionByName(ahead))
        if at.where("open").isEmpty():
            return at.drop("open")
    return at.select(*_ID, F.when(F.col("open"), _ENDLESS).otherwise(F.col("base")).alias("base"), F.when(~F.col("open"), F.col("to")).alias("to"), "w")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame, cfg: ToolCallConfig = ToolCallConfig()) -> DataFrame:
    """One row per call id of a conversation, linked, ordered, checked and serialised.

    calls(conv_id, call_id, turn, name, arguments JSON string, after array<string>),
    results(conv_id, call_id, turn, content), schemas(name, param, type, required).
    Returns conv_id, call_id, level, turn, result_turn, n_calls, n_results,
    errors array<string>, json. Of calls or results with one id the earliest counts,
    then the smallest content. errors are the argument errors and: repeated_call,
    no_result, repeated_result, early_result (not after the call), lost_dependency,
    cycle or deep. json has sorted keys, no spaces and the parsed arguments; invalid
    arguments are written as the string they are. Results without a call are
    dropped (see ``orphan_results``); rows with a null id are not calls or results;
    null names and arguments are an unknown tool and invalid; a null conversation is
    a conversation; other columns are ignored; empty tables give no rows.
    """
    first = F.min(F.struct("turn", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("arguments", F.lit("")).alias("arguments"), F.coalesce("after", F.array().cast("array<string>")).alias("after"))).alias("c")
    one = cut(calls.where("call_id is not null").groupBy(*_ID).agg(first, F.count(F.lit(1)).alias("n_calls")).select(*_ID, "c.turn", "c.name", "c.arguments", F.filter("c.after", lambda x: x.isNotNull()).alias("after"), "n_calls"))
    answers = results.where("call_id is not null").groupBy(*_ID).agg(F.min(F.struct(F.col("turn").alias("result_turn"), F.coalesce("content", F.lit("")).alias("content"))).alias("r"), F.count(F.lit(1)).alias("n_results"))
    tools = schemas.where("name is not null and param is not null").groupBy("name").agg(F.sort_array(F.collect_set(F.struct(F.col("param").alias("name"), "type", F.coalesce("required", F.lit(False)).alias("required")))).alias("params"))  # the parameters of one tool
    lost = (
        one.select(*_ID, F.explode("after").alias("on")).alias("e").join(one.select(*_ID).alias("k"), F.col("e.conv_id").eqNullSafe(F.col("k.conv_id")) & (F.col("e.on") == F.col("k.call_id")), "left_anti")
        .groupBy(*_ID).agg(F.lit(True).alias("lost"))
    )
    joined = (
        one.alias("c")
        .join(answers.alias("r"), _same("c", "r", _ID), "left")
        .join(call_levels(one, cfg).alias("l"), _same("c", "l", _ID), "left")
        .join(lost.alias("x"), _same("c", "x", _ID), "left")
        .join(tools.alias("t"), F.col("c.name") == F.col("t.name"), "left")
        .select("c.*", "r.r", F.coalesce("n_results", F.lit(0)).alias("n_results"), F.when(F.col("order_error").isNull(), F.coalesce("level", F.lit(0))).otherwise(F.col("level")).alias("level"), "order_error", "lost", "params")
    )
    given, errors = argument_errors("arguments", "params")
    joined = joined.withColumn("given", given)
    flags = F.array(
        F.when(F.col("n_calls") > 1, "repeated_call"), F.when(F.col("n_results") == 0, "no_result"), F.when(F.col("n_results") > 1, "repeated_result"),
        F.when(F.col("r.result_turn") <= F.col("turn"), "early_result"), F.when(F.col("lost"), "lost_dependency"), F.col("order_error"),
    )
    every = F.concat(errors, F.filter(flags, lambda e: e.isNotNull()))
    args = F.when(F.col("given").isNotNull(), F.to_json(F.try_parse_json("arguments")))
    # keys in code-point order; the arguments are JSON already
    body = F.concat(
        F.lit('{"arguments":'), F.coalesce(args, quoted("arguments")), F.lit(',"errors":'), F.to_json("errors"), F.lit(',"id":'), quoted("call_id"),
        F.lit(',"level":'), F.coalesce(F.col("level").cast("string"), F.lit("null")), F.lit(',"name":'), quoted("name"),
        F.lit(',"result":'), F.coalesce(quoted("r.content"), F.lit("null")), F.lit("}"),
    )
    return joined.withColumn("errors", every).select(*_ID, "level", "turn", "r.result_turn", "n_calls", "n_results", "errors", body.alias("json"))


def quoted(column: str) -> Column:
    """The JSON string of a text column."""
    whole = F.to_json(F.array(F.col(column)))
    return F.when(F.col(column).isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))


def orphan_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose id no call of their conversation has."""
    return results.alias("r").join(calls.where("call_id is not null").select(*_ID).distinct().alias("c"), _same("r", "c", _ID), "left_anti")


TOOLS = (("count", "text", "string", True), ("count", "words", "integer", True), ("lookup", "key", "string", True), ("lookup", "limit", "number", False), ("search", "query", "string", True), ("search", "exact", "boolean", False))


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that the turns of conversations stand for.

    Every user turn asks a tool, by its turn number; its arguments are made of its
    text, and every third one lacks or mistypes something. It depends on the
    user turn before it, or, for texts of certain lengths, on the one after it.
    Every assistant turn is the result of the turn before it.
    """
    text = F.coalesce("text", F.lit(""))
    n = F.char_length(text)
    kind = F.pmod("turn", F.lit(3))
    call_id = F.concat(F.lit("call-"), F.col("turn").cast("string"))
    name = F.element_at(F.array(*map(F.lit, ("search", "lookup", "count"))), (kind + 1).cast("int"))
    arguments = (
        F.when((kind == 0) & (n % 3 == 0), F.to_json(F.struct(text.alias("query"), F.lit("yes").alias("exact"))))
        .when(kind == 0, F.to_json(F.struct(text.alias("query"), (n % 2 == 0).alias("exact"))))
        .when((kind == 1) & (n % 3 == 0), F.to_json(F.struct(n.alias("limit"), text.alias("extra"))))
        .when(kind == 1, F.to_json(F.struct(n.alias("limit"), text.alias("key"))))
        .when(n % 3 == 0, F.concat(F.lit("{"), F.regexp_replace(text, '["\\\\]', "")))
        .otherwise(F.to_json(F.struct(n.alias("words"), text.alias("text"))))
    )
    step = F.when(n % 5 == 0, 2).when(F.pmod("turn", F.lit(8)) != 0, -2)
    after = F.when(step.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("call-"), (F.col("turn") + step).cast("string"))))
    calls = conversations.where("role = 'user'").select("conv_id", call_id.alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"), after.alias("after"))
    of = F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string"))
    results = conversations.where("role = 'assistant'").select("conv_id", of.alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def link_conversations(conversations: DataFrame, cfg: ToolCallConfig = ToolCallConfig()) -> DataFrame:
    calls, results = calls_of(conversations)
    schemas = conversations.sparkSession.createDataFrame(TOOLS, "name string, param string, type string, required boolean")
    return link_tool_calls(calls, results, schemas, cfg)


def whole_conversations(conversations: DataFrame, cfg: ToolCallConfig = ToolCallConfig()) -> DataFrame:
    """Every turn in a row: the linked calls (``link_conversations``; their results are inside),
    results without a call, and the turns that are neither, with their text.

    kind string (call, orphan_result, turn), conv_id, call_id, level, turn, result_turn,
    n_calls, n_results, errors array<string>, json.
    """
    calls, results = calls_of(conversations)
    linked = link_conversations(conversations, cfg).withColumn("kind", F.lit("call"))
    none, long, no_level = F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("int").alias("level")
    alone = F.array(F.lit("orphan_result"))
    body = F.concat(F.lit('{"errors":["orphan_result"],"id":'), quoted("call_id"), F.lit(',"result":'), F.coalesce(quoted("content"), F.lit('""')), F.lit("}"))
    orphans = orphan_results(calls, results).where("call_id is not null").select(
        F.lit("orphan_result").alias("kind"), *_ID, no_level, none.alias("turn"), F.col("turn").alias("result_turn"), long.alias("n_calls"), F.lit(1).cast("long").alias("n_results"), alone.alias("errors"), body.alias("json")
    )
    other = conversations.where("turn is null or role is null or role not in ('user', 'assistant')").withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    said = F.concat(F.lit('{"role":'), quoted("role"), F.lit(',"text":'), quoted("text"), F.lit("}"))
    turns = other.select(
        F.lit("turn").alias("kind"), "conv_id", F.lit(None).cast("string").alias("call_id"), no_level, "turn", none.alias("result_turn"), long.alias("n_calls"), long.alias("n_results"), F.array().cast("array<string>").alias("errors"), said.alias("json")
    )
    return linked.unionByName(orphans).unionByName(turns)


def oracle_sql() -> str:
    """``whole_conversations`` in DuckDB SQL, for non-null turns that are unique in their conversation."""
    return """
WITH RECURSIVE base AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n FROM conversations),
calls AS (
  SELECT conv_id, turn, 'call-' || turn AS call_id, text, n, turn % 3 AS kind,
    CASE WHEN n % 5 = 0 THEN turn + 2 WHEN turn % 8 <> 0 THEN turn - 2 END AS dep FROM base WHERE role = 'user'),
edges AS (SELECT a.conv_id, a.turn, a.dep, (a.dep > a.turn)::INT AS late FROM calls a JOIN calls b ON a.conv_id = b.conv_id AND a.dep = b.turn),
late AS (SELECT conv_id, sum(late) AS n_late FROM edges GROUP BY 1),
walk AS (
  SELECT conv_id, turn, 0::HUGEINT AS level FROM calls
  UNION
  SELECT e.conv_id, e.turn, least(w.level + e.late, l.n_late + 1) FROM walk w JOIN edges e ON e.conv_id = w.conv_id AND e.dep = w.turn JOIN late l ON l.conv_id = e.conv_id),
lv AS (SELECT w.conv_id, w.turn, max(level) AS level, coalesce(any_value(n_late), 0) AS n_late FROM walk w LEFT JOIN late l ON w.conv_id = l.conv_id GROUP BY 1, 2),
res AS (SELECT conv_id, turn - 1 AS call_turn, min(struct_pack(t := turn, x := text)) AS r, count(*) AS n_results FROM base WHERE role = 'assistant' GROUP BY 1, 2),
linked AS (SELECT c.conv_id, c.call_id, CASE WHEN v.level <= v.n_late THEN v.level END::INT AS level, c.turn, c.kind, c.n, c.text, r.r.x AS content, r.r.t AS result_turn, 1::BIGINT AS n_calls, coalesce(r.n_results, 0)::BIGINT AS n_results,
  list_concat(
    CASE WHEN c.n % 3 <> 0 THEN []::VARCHAR[] WHEN c.kind = 0 THEN ['type:exact'] WHEN c.kind = 1 THEN ['missing:key', 'unknown:extra'] ELSE ['invalid_json'] END,
    [x FOR x IN [CASE WHEN r.n_results IS NULL THEN 'no_result' END, CASE WHEN r.n_results > 1 THEN 'repeated_result' END,
      CASE WHEN c.dep IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.conv_id = c.conv_id AND e.turn = c.turn) THEN 'lost_dependency' END,
      CASE WHEN v.level > v.n_late THEN 'cycle' END] IF x IS NOT NULL]) AS errors
FROM calls c JOIN lv v ON c.conv_id = v.conv_id AND c.turn = v.turn LEFT JOIN res r ON r.conv_id = c.conv_id AND r.call_turn = c.turn)
SELECT 'call' AS kind, conv_id, call_id, level, turn, result_turn, n_calls, n_results, array_to_string(errors, ',') AS errors,
  '{"arguments":' || CASE
    WHEN kind = 0 THEN '{"exact":' || CASE WHEN n % 3 = 0 THEN '"yes"' WHEN n % 2 = 0 THEN 'true' ELSE 'false' END || ',"query":' || to_json(text) || '}'
    WHEN kind = 1 AND n % 3 = 0 THEN '{"extra":' || to_json(text) || ',"limit":' || n || '}'
    WHEN kind = 1 THEN '{"key":' || to_json(text) || ',"limit":' || n || '}'
    WHEN n % 3 = 0 THEN to_json('{' || regexp_replace(text, '["\\\\]', '', 'g'))
    ELSE '{"text":' || to_json(text) || ',"words":' || n || '}' END
  || ',"errors":' || to_json(errors) || ',"id":' || to_json(call_id) || ',"level":' || coalesce(level::VARCHAR, 'null')
  || ',"name":"' || ['search', 'lookup', 'count'][kind + 1] || '","result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS json
FROM linked
UNION ALL
SELECT 'orphan_result', conv_id, 'call-' || (turn - 1), NULL, NULL, turn, 0, 1, 'orphan_result', '{"errors":["orphan_result"],"id":"call-' || (turn - 1) || '","result":' || to_json(text) || '}'
FROM base b WHERE role = 'assistant' AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = b.conv_id AND c.turn = b.turn - 1)
UNION ALL
SELECT 'turn', conv_id, NULL, NULL, turn, NULL, 0, 0, '', '{"role":' || to_json(coalesce(role, '')) || ',"text":' || to_json(text) || '}'
FROM base WHERE role IS NULL OR role NOT IN ('user', 'assistant')"""

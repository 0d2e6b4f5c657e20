"""The registered query of each operator: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import linedup, merkle, mixing, prefixtrie, toolcalls
from tapeloom.llm.common import table
from tapeloom.llm.cuttingstock import pack_stock
from tapeloom.llm.decontaminate import find_contamination
from tapeloom.llm.gridjoin import grid_join
from tapeloom.llm.langid import learn_and_identify
from tapeloom.llm.mixlm import score_documents
from tapeloom.llm.packing import pack_documents
from tapeloom.llm.simhash import simhash_components
from tapeloom.llm.toxicity import learn_and_score

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op5_simhash_bktree")
def op5_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


@query("op3_grid_order_join")
def op3_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join(table(spark, sf_dir, "embeddings"))


@query("op7_sainte_lague_mix", mixing.oracle_sql())
def op7_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


@query("op8_three_line_windows", linedup.oracle_sql())
def op8_three_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.dedup_lines(table(spark, sf_dir, "documents"))


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


@query("op1_template_decontamination")
def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_bitmask_language_id")
def op9_bitmask_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn_and_identify(table(spark, sf_dir, "documents"))


@query("op4_counterfactual_toxicity")
def op4_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_context_mixing_lm")
def op6_context_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


@query("op2_tool_call_links", toolcalls.oracle_sql())
def op2_tool_call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = toolcalls.whole_conversations(table(spark, sf_dir, "conversations"))
    return linked.select("kind", "conv_id", "call_id", "level", "turn", "result_turn", "n_calls", "n_results", F.array_join("errors", ",").alias("errors"), "json")


@query("op13_cutting_stock")
def op13_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_stock(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op12_slot_pivot_manifest", merkle.oracle_sql())
def op12_slot_pivot_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_tampered(table(spark, sf_dir, "documents"))


@query("op11_splitter_skeleton_trie", prefixtrie.oracle_sql(merkle.CRC32_SQL.format(x="conv_id")))
def op11_splitter_skeleton_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.conversation_trie(table(spark, sf_dir, "conversations"))

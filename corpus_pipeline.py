"""The training-data pipeline: documents to packed token rows, in five stages.

Each stage works on all that its predecessor kept. Between stages the rows are
written as Parquet and read again, so a lost executor costs tasks, not stages.

1. Language ID learns from the documents that have a language; documents without a
   letter, or whose n-grams hardly belong to any language, go.
2. SimHash near-dedup keeps one document of each group, the one with the smallest id.
3. Benchmark decontamination drops the documents in which an item was found.
4. Mixing returns each document as often as the mix takes it (a cut copy has only
   the taken words), so that sources come to their target weights.
5. Packing writes the mixed texts as rows of token ids.

An empty table passes through every stage; null and empty texts end in stage 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm.common import stored, table
from tapeloom.llm.decontaminate import without_contaminated
from tapeloom.llm.langid import keep_identified
from tapeloom.llm.mixing import mix_documents
from tapeloom.llm.packing import pack_documents
from tapeloom.llm.simhash import one_of_each_group

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix),
    ("token_packing", pack),
]

#: No SQL: fingerprints, n-gram filters and token ids are beyond it; see tests/llm/test_pipeline.py.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs

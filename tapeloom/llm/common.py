"""Helpers the operators of this subpackage share.

Words are the runs of bytes outside ``[\\x20\\x09-\\x0D]``. ``bytes.split`` and
``bytes.lower`` follow exactly this definition (ASCII white space, A-Z only), so
Python passes work on UTF-8 bytes and never decode a text they only count in.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.session import cut, ensure_checkpoint_dir

WORD_GAP = "[\\x20\\x09-\\x0D]+"

__all__ = ["WORD_GAP", "by_chunks", "cut", "forest", "fold_mod", "lower_az", "n_words", "remembers", "stored", "table", "text_bytes", "words_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet under the shared checkpoint folder and read back.

    Like ``cut`` it survives lost executors; columnar and compressed, so it suits
    results that are large or read column by column.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_az(text: str | Column) -> Column:
    return F.translate(F.col(text) if isinstance(text, str) else text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | Column) -> Column:
    """Array of words; empty for null and blank texts."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.filter(F.split(c, WORD_GAP), lambda w: w != "")


def n_words(text: str | Column) -> Column:
    """Number of words, without building the words: gaps become one space and are counted."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.regexp_count(c, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def fold_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id counts as the empty text (remainder 0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


_holder: list[tuple[str, Callable[[], None]]] = []


def remembers(name: str, forget: Callable[[], None]) -> None:
    """Said by a pass that keeps a memory in its Python worker: what another pass kept there is dropped.

    Workers outlive the stages of a job, so without this they would hold the memories of all of them.
    """
    if _holder and _holder[0][0] != name:
        _holder.pop()[1]()
    if not _holder:
        _holder.append((name, forget))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; nulls are empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def by_chunks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``max_bytes`` of a text column (one row at least)."""
    for batch in batches:
        size = np.cumsum(np.array(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the graph with edges a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root[root] != root).any():
            root = root[root]



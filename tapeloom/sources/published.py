"""Tables that change as a whole: versions in folders of their own, and a commit log that names the current one.

A version becomes visible when its log entry is renamed into place, after all its
files are written. A job that dies before leaves the old version as it was; readers
never see half a table. One writer at a time is assumed, readers need no lock.

``merge_batch`` changes a table by keys: rows live in buckets of their keys, a batch
rewrites the buckets it touches, and the entry says in which folder each bucket lies.
It also records the last batch of each stream, so a replayed batch changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BUCKET = "_bucket"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, oldest first."""
    fs, at = _fs(spark, path)
    log = at(f"{path}/_log")
    if not fs.exists(log):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(log)]
    return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and not n.startswith("."))


def entry(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """Log entry of a version (the current one by default); None before the first commit."""
    known = versions(spark, path)
    if not known:
        return None
    if version is not None and version not in known:
        raise ValueError(f"version {version} is not there")
    number = known[-1] if version is None else version
    fs, at = _fs(spark, path)
    stream = fs.open(at(f"{path}/_log/{number:012d}.json"))
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def _commit(spark: SparkSession, path: str, note: dict) -> int:
    fs, at = _fs(spark, path)
    number = (versions(spark, path) or [0])[-1] + 1
    draft, final = at(f"{path}/_log/.{uuid.uuid4().hex}"), at(f"{path}/_log/{number:012d}.json")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(note | {"version": number}).encode()))
    finally:
        out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"version {number} of {path} was committed by another writer")
    return number


def _folder(path: str) -> str:
    return f"{path}/data/{uuid.uuid4().hex}"


def publish(df: DataFrame, path: str) -> int:
    """Replace the table by ``df``; returns the new version."""
    folder = _folder(path)
    df.write.parquet(folder)
    return _commit(df.sparkSession, path, {"schema": df.schema.json(), "folders": [folder], "batches": {}})


def _read(spark: SparkSession, note: dict, folders: Sequence[str]) -> DataFrame:
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(json.loads(note["schema"]))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the current one by default."""
    note = entry(spark, path, version)
    if note is None:
        raise ValueError(f"nothing was published at {path}")
    return _read(spark, note, note["folders"])


def drop_old(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Forget all but the last ``keep`` versions and delete the folders none of them names; returns how many."""
    known = versions(spark, path)
    notes = [entry(spark, path, v) for v in known]
    needed = {f for n in notes[-keep:] for f in n["folders"]}
    gone = {f for n in notes[:-keep] for f in n["folders"]} - needed
    fs, at = _fs(spark, path)
    for v in known[:-keep]:
        fs.delete(at(f"{path}/_log/{v:012d}.json"), False)
    for f in gone:
        fs.delete(at(f), True)
    return len(gone)


def upsert(order: str) -> Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame]:
    """Combine old and new rows: per key the row with the greatest ``order``."""

    def combine(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
        rest = [c for c in old.columns if c not in keys]
        both = old.unionByName(new.select(*old.columns))
        return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])

    return combine


def merge_batch(
    batch: DataFrame, path: str, keys: Sequence[str], batch_id: int, combine: Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame],
    stream: str = "stream", buckets: int = 32, empty: DataFrame | None = None,
) -> bool:
    """Fold a micro-batch into the table; False if this or a later batch of the stream is in it already.

    ``combine(old, new, keys)`` gives the new rows of the keys it is given; ``old`` are
    all rows of the touched buckets, so keys that the batch does not hold must stay.
    ``empty`` has the table's columns if they differ from the batch's. The number of
    buckets is fixed by the first batch.
    """
    spark = batch.sparkSession
    note = entry(spark, path)
    if note is None:
        shape = (batch if empty is None else empty).schema
        note = {"schema": shape.json(), "folders": [], "batches": {}, "buckets": buckets, "parts": {}}
    if batch_id <= note["batches"].get(stream, -1):
        return False
    bucket = F.pmod(F.xxhash64(*keys), F.lit(note["buckets"]))
    batch = batch.persist()
    try:
        touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())  # at most ``buckets``
        old = _read(spark, note, [note["parts"][str(b)] for b in touched if str(b) in note["parts"]])
        folder = _folder(path)
        if touched:
            merged = combine(old, batch, keys).select(*old.columns).withColumn(_BUCKET, bucket)
            merged.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(folder)
    finally:
        batch.unpersist()
    parts = note["parts"] | {str(b): f"{folder}/{_BUCKET}={b}" for b in touched}
    _commit(spark, path, note | {"parts": parts, "folders": sorted(parts.values()), "batches": note["batches"] | {stream: batch_id}})
    return True

"""Sharding by histogram sort.

Rows are ordered by a 64-bit hash of their text, so equal texts are one key and never part.  The splitters
between shards are found by rounds of exact counting: every partition sums the bytes between candidate boundaries
(probes), the sums are added, and new probes go into the bracket around each target until a probe meets
the tolerance or a bracket holds one key.  The driver sees the sums of at most ``shards * PROBES`` bins a
round, whatever the input.  Then rows are exchanged once, into ``cells`` of each shard that no key can
crowd (a row's cell comes from its number), and numbered there; a shard's cells are offset by their counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ensure
from .common import Scratch, text_or_empty

PROBES = 32
ROWS_A_CELL = 1_000_000
LOWEST = -(2**63)


def histogram(keys: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int]]:
    """bin -> bytes, smallest and largest key of the keys in [probes[bin - 1], probes[bin])."""

    def run(batches):
        edges = np.array(probes, np.int64)
        total, low, high = np.zeros(len(edges) + 1, np.int64), np.full(len(edges) + 1, 2**63 - 1), np.full(len(edges) + 1, LOWEST)
        for batch in batches:
            key, size = (batch.column(k).to_numpy() for k in (0, 1))
            bins = np.searchsorted(edges, key, side="right")
            np.add.at(total, bins, size)
            np.minimum.at(low, bins, key)
            np.maximum.at(high, bins, key)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, total[used], low[used], high[used])], names=["bin", "bytes", "low", "high"])

    ensure(keys.sparkSession)
    parts = keys.select("key", "size").mapInArrow(run, "bin long, bytes long, low long, high long")
    rows = parts.groupBy("bin").agg(F.sum("bytes"), F.min("low"), F.max("high")).collect()
    return {r[0]: (r[1], r[2], r[3]) for r in rows}


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.001) -> list[int]:
    """For 1 .. shards - 1 the key at which that shard begins.  keys: (key, size), size over 0."""
    low, high, total = keys.agg(F.min("key"), F.max("key"), F.sum("size")).first()
    if total is None:
        return [0] * (shards - 1)
    aims = [total * j // shards for j in range(1, shards)]
    slack = tolerance * total / shards
    # Bytes below known boundaries, and for each aim the keys between which its boundary lies.
    below: dict[int, int] = {low: 0}
    brackets = {aim: (low, high) for aim in aims}
    while brackets:
        probes = sorted({lo + max(1, (hi - lo) * i // PROBES) for lo, hi in brackets.values() for i in range(PROBES + 1)} | {k for lo, hi in brackets.values() for k in (lo, hi, hi + 1) if k < 2**63})
        found = histogram(keys, probes)
        under, bins = 0, []
        for b in range(len(probes) + 1):
            n, lo, hi = found.get(b, (0, 0, 0))
            bins.append((under, under + n, lo, hi))
            under += n
            if b < len(probes):
                below[probes[b]] = under
        again = {}
        for aim in brackets:
            start, end, lo, hi = next(x for x in bins if x[0] <= aim < x[1])
            below[lo] = start
            if min(aim - start, end - aim) > slack and lo < hi:
                again[aim] = (lo, hi)
            elif end < total:
                above = min((k for k in below if below[k] == end and k > hi), default=hi + 1)
                below[above] = end
        brackets = again
    known = sorted(below.items(), key=lambda x: x[1])
    return sorted(min(known, key=lambda x, aim=aim: (abs(x[1] - aim), x[0]))[0] for aim in aims)


def assign(docs: DataFrame, shards: int = 8, tolerance: float = 0.001, text: str = "text", doc_id: str = "doc_id", rows_a_cell: int = ROWS_A_CELL) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row.

    Size: UTF-8 bytes of the text (null: none) plus 1.  Law ``bytes``: shards' sizes are near equal, as far as
    equal texts, which stay together, allow it; a group larger than a shard's share makes a larger shard.
    Slots are gapless from 0 in each shard, by cell and then by key: shards are ranges of the key, rows in a shard are not sorted by it.  Null and repeated ids are rows like others.  An empty table gives
    no rows.  Other columns are not read.  The assignment depends on the whole input, so grown_shard is null.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    t = text_or_empty(text)
    keys = scratch.cut(docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(t).alias("key"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).cast("long").alias("crc"), F.monotonically_increasing_id().alias("row")))
    starts = splitters(keys, shards, tolerance)
    n = keys.count()
    cells = max(math.ceil(n / rows_a_cell), math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / shards))
    shard = sum((F.when(F.col("key") >= s, 1).otherwise(0) for s in starts), F.lit(0))
    placed = keys.withColumn("shard", shard.cast("int")).withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)))
    filled = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    offset = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    filled = filled.select("shard", "cell", F.coalesce(offset, F.lit(0)).alias("offset"))
    numbered = placed.withColumn("place", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("key", "row")))
    out = numbered.join(filled, ["shard", "cell"])
    return out.select(F.col("id").alias(doc_id), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, **options) -> None:
    """``docs`` as Parquet in one folder a shard, with shard and slot in place of columns of these names.  Null or repeated ids: ValueError."""
    doc_id = options.get("doc_id", "doc_id")
    n, ids = docs.agg(F.count(F.lit(1)), F.countDistinct(doc_id)).first()
    if n != ids:
        raise ValueError(f"{n} rows, {ids} distinct ids")
    placed = assign(docs, shards, **options).select(doc_id, "shard", "slot")
    docs.drop("shard", "slot").join(placed, doc_id).write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

"""Exact dedup by a tree-merge of sorted digest runs, with DataFrame functions only.

Each input partition makes a run: its rows' digests.  The rounds are those of a binomial exchange.  In round r the cells
whose numbers differ in bit r alone meet: bit r of the cell number gives way to bit r of the digest, so of two cells each
sends the other the half of its run that falls to it.  A cell takes all that comes to it in digest order (one exchange by cell
and one sort, over which the aggregate is a merge) and keeps one entry a digest: the identifier that stays, and the rows so far.
N runs take ceil(log2 N) rounds, whatever the session's settings; then every digest is in one cell.  ``fanout_bits`` over 1
folds as many rounds into one exchange, whose merge then takes 2 ** fanout_bits runs: fewer tables are written on large inputs.

The way back is the same tree: the merged entry goes down level by level, and meets at most one entry a
digest in each cell, so a group of copies that holds a third of all rows is never gathered in one task,
up or down.  An entry is *verified* at each level: runs are merged on the SHA-256, an independent
64-bit hash and the byte length together, so entries that agree in the digest alone never merge; texts themselves are not compared.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty

FANOUT_BITS = 1
ENTRY = ["sha", "check", "size"]


def rounds_for(runs: int, fanout_bits: int = FANOUT_BITS) -> int:
    """Rounds after which ``runs`` runs are merged: one at least, in which the copies within a run meet."""
    return max(1, math.ceil(max(0, runs - 1).bit_length() / fanout_bits))


class RunTree:
    """The levels of the merge: ``up`` makes them, ``down`` brings what was merged back to each run."""

    def __init__(self, docs: DataFrame, text: str, doc_id: str, keep: str, fanout_bits: int):
        self.scratch = Scratch(docs.sparkSession, "exact-dedup")
        self.bits = fanout_bits
        self.best = F.max if keep == "largest" else F.min
        t = text_or_empty(text)
        self.rows = self.scratch.cut(
            docs.select(F.col(f"`{doc_id}`").alias("id"), F.monotonically_increasing_id().alias("row"), F.spark_partition_id().cast("long").alias("cell"), F.unhex(F.sha2(t, 256)).alias("sha"), F.xxhash64(t).alias("check"), F.octet_length(t).cast("long").alias("size"))
        )
        last = self.rows.agg(F.max("cell")).first()[0]
        self.rounds = rounds_for(0 if last is None else last + 1, fanout_bits)
        # Null ids lose: the flag sorts them last whichever end is kept.
        known = F.col("id").isNotNull() if keep == "largest" else F.col("id").isNull()
        entry = F.struct(known.alias("flag"), "id", "row").alias("stays")
        self.levels = [self.rows.select("cell", *ENTRY, entry, F.lit(1).cast("long").alias("n"))]

    def after(self, r: int):
        """The cell where round r puts an entry."""
        fanout = 1 << self.bits
        digit = F.pmod(F.shiftright("check", self.bits * r), F.lit(fanout))
        return F.col("cell") + (digit - F.pmod(F.shiftright("cell", self.bits * r), F.lit(fanout))) * fanout**r

    def up(self) -> DataFrame:
        for r in range(self.rounds):
            met = self.levels[-1].withColumn("cell", self.after(r))
            if r:  # entries of a cell are distinct by now; before, copies within a run become one before they travel
                met = met.repartition("cell").sortWithinPartitions("cell", *ENTRY)
            self.levels.append(self.scratch.cut(met.groupBy("cell", *ENTRY).agg(self.best("stays").alias("stays"), F.sum("n").alias("n"))))
        return self.levels[-1]

    def down(self) -> DataFrame:
        """(cell, entry, stays, n) of the digests that several rows have, for the cells of the first merged level."""
        found = self.levels[-1].filter("n > 1")
        for r in reversed(range(1, self.rounds)):
            found = self.levels[r].select("cell", *ENTRY).withColumn("up", self.after(r)).join(found.withColumnRenamed("cell", "up"), ["up", *ENTRY]).drop("up")
        return found

    def placed(self) -> DataFrame:
        """The rows, each with what its digest was merged to (null where it is alone)."""
        return self.rows.withColumn("up", self.after(0)).join(self.down().withColumnRenamed("cell", "up"), ["up", *ENTRY], "left")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest", fanout_bits: int = FANOUT_BITS) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept, text_sha256.

    Equal texts are one group; null counts as empty.  ``keep``: whether the row with the smallest or largest
    id stays; null ids lose against others, and of rows that repeat an id with the same text one stays.
    Only ``doc_id``, of any type with an order, and ``text`` are read, whatever other columns are called; an empty table gives an empty result.
    """
    tree = RunTree(docs, text, doc_id, keep, fanout_bits)
    tree.up()
    return tree.placed().select(
        F.col("id").alias(doc_id),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("stays.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (F.col("n").isNull() | (F.col("stays.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep="largest")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

"""A hierarchy of agents as a table: spawning, ticks, coordination, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S

#: Agents a tier, most agents a call, most of a report, places in a proposal queue.
SUB, MICRO = 10, 10
SPAWN_MOST, REPORT_MOST, QUEUE = 50_000, 500_000, 10

SCHEMA = "tier string, idx long, sub long, micro long, heartbeat long"


def hierarchy(spark: SparkSession, nano: int, most: int = REPORT_MOST) -> DataFrame:
    """One super agent, SUB sub agents, MICRO micro agents a sub agent, and ``nano`` ones (``most`` at most) dealt to the micro agents."""
    n = max(0, min(nano, most))
    none = F.lit(None).cast("long")
    top = spark.range(1).select(F.lit("super").alias("tier"), F.col("id").alias("idx"), none.alias("sub"), none.alias("micro"))
    sub = spark.range(SUB).select(F.lit("sub"), F.col("id"), F.col("id"), none)
    micro = spark.range(SUB * MICRO).select(F.lit("micro"), F.col("id"), F.floor(F.col("id") / MICRO), F.col("id"))
    small = spark.range(n).select(F.lit("nano"), F.col("id"), F.floor(F.col("id") % (SUB * MICRO) / MICRO), F.col("id") % (SUB * MICRO))
    return top.union(sub).union(micro).union(small).withColumn("heartbeat", F.lit(0).cast("long"))


def spawn(agents: DataFrame, micro: int, n: int) -> DataFrame:
    """``agents`` and ``n`` more nano agents of a micro agent, which must exist."""
    if not 0 <= n <= SPAWN_MOST:
        raise ValueError(f"at most {SPAWN_MOST} agents a call")
    parent = agents.filter((F.col("tier") == "micro") & (F.col("idx") == micro)).select("sub").first()
    if parent is None:
        raise ValueError(f"no micro agent {micro}")
    after = agents.filter("tier = 'nano'").agg(F.coalesce(F.max("idx") + 1, F.lit(0))).first()[0]
    new = agents.sparkSession.range(after, after + n).select(F.lit("nano").alias("tier"), F.col("id").alias("idx"), F.lit(parent[0]).alias("sub"), F.lit(micro).cast("long").alias("micro"), F.lit(0).cast("long").alias("heartbeat"))
    return agents.unionByName(new)


def broadcast_tick(agents: DataFrame, tick: int) -> DataFrame:
    return agents.withColumn("heartbeat", F.lit(tick).cast("long"))


def report(agents: DataFrame) -> DataFrame:
    """(tier, n, last_heartbeat)."""
    return agents.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.max("heartbeat").alias("last_heartbeat"))


def paths(agents: DataFrame) -> DataFrame:
    return agents.withColumn("path", S.agent_path(F.col("tier"), F.col("sub"), F.col("micro"), F.col("idx"))).withColumn("global_index", S.global_index(F.col("tier"), F.col("idx")))


# --------------------------------------------------------------------------- coordination


def enqueue(queue: DataFrame, proposals: DataFrame, places: int = QUEUE) -> DataFrame:
    """queue and proposals (agent_id, proposal_id, confidence, gain): all rows with ``priority`` and ``refused`` (no place left)."""
    both = queue.withColumn("new__", F.lit(0)).unionByName(proposals.withColumn("new__", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("agent_id").orderBy("new__", "proposal_id"))
    return both.withColumn("priority", 0.6 * F.col("confidence") + 0.4 * F.col("gain")).withColumn("refused", (rank > places) & (F.col("new__") == 1)).drop("new__")


def rebalance(queue: DataFrame, agents: int) -> DataFrame:
    """By priority, each to the shortest of ``agents`` empty queues: that is in turn."""
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("priority"), "proposal_id"))
    return queue.withColumn("agent", (rank - 1) % agents)


def transfer(patterns: DataFrame, affinity: DataFrame, least: float = 0.75) -> DataFrame:
    """patterns (agent_id, pattern) copied to agents b whose affinity (a, b, affinity) with the owner is ``least`` or more and that lack it."""
    close = affinity.filter(F.col("affinity") >= least).select(F.col("a").alias("agent_id"), F.col("b").alias("target"))
    new = patterns.join(close, "agent_id").select(F.col("target").alias("agent_id"), "pattern").distinct()
    return patterns.select("agent_id", "pattern").union(new.join(patterns, ["agent_id", "pattern"], "left_anti"))


def merge_decisions(decisions: DataFrame) -> DataFrame:
    """decisions (cycle, alpha, beta): the action that holds, and whether the two conflict (unlike, none of them normal)."""
    a, b = F.col("alpha"), F.col("beta")
    conflict = (a != b) & (a != "normal") & (b != "normal")
    return decisions.withColumn("conflict", conflict).withColumn("action", F.when(conflict, a).when(a == "normal", b).otherwise(a))


def federate(fitness: DataFrame, floor: float = 0.05) -> DataFrame:
    """fitness (organ, utility, safety): mean utility, least safety, stress, and the first organ whose safety vetoes."""
    low = F.col("safety") <= floor
    return fitness.agg(F.avg("utility").alias("utility"), F.min("safety").alias("safety"), F.avg(1 - F.col("safety")).alias("stress"), F.min(F.when(low, F.col("organ"))).alias("vetoed_by"))


def run_ticks(agents: DataFrame, ticks: int, fitness) -> tuple[DataFrame, DataFrame]:
    """The agents after ``ticks`` ticks, and the mean and least utility of each.  ``fitness(tick)`` is a column over an agent's row; as no tick reads
    another's outcome, all ticks are one plan."""
    each = agents.withColumn("tick", F.explode(F.sequence(F.lit(1), F.lit(ticks)))).withColumn("utility", fitness(F.col("tick")))
    seen = each.groupBy("tick").agg(F.avg("utility").alias("mean_utility"), F.min("utility").alias("least_utility"), F.count(F.lit(1)).alias("n"))
    return broadcast_tick(agents, ticks), seen

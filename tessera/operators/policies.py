"""Agents and policies: alignment, beliefs, agreement and conflict, and the directives that reports of the other brains call for.

Policies are a stated set of at most MOST_POLICIES; every agent meets each of them in the scan of agents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import scores as S

MOST_POLICIES = 4096
#: Fixed value: alignment from which an agent takes a policy.
ACCEPTED = 0.6
#: Scopes of policies.
AGENT, CLUSTER, SWARM = 0, 1, 2


def alignment(agents: DataFrame, policies: DataFrame) -> DataFrame:
    """(agent, cluster, weight, policy, scope, score) of every agent (.., behaviour) and policy (.., target, priority): their dot product
    times the priority."""
    if policies.limit(MOST_POLICIES + 1).count() > MOST_POLICIES:
        raise ValueError(f"more than {MOST_POLICIES} policies")
    both = agents.join(F.broadcast(policies), how="cross")  # a stated set against all rows
    return both.select("agent", "cluster", "weight", "policy", "scope", (A.dot(F.col("behaviour"), F.col("target")) * F.col("priority")).alias("score"))


def beliefs(aligned: DataFrame, prior: DataFrame, threshold: float = ACCEPTED) -> DataFrame:
    """(policy, alpha, beta, rate): the Beta distribution of ``prior`` (policy, alpha, beta) with agents at or over the threshold as successes."""
    seen = aligned.groupBy("policy").agg(F.count_if(F.col("score") >= threshold).alias("won"), F.count(F.lit(1)).alias("tried"))
    t = prior.join(seen, "policy", "left").select("policy", (F.col("alpha") + F.coalesce("won", F.lit(0))).alias("alpha"), (F.col("beta") + F.coalesce(F.col("tried") - F.col("won"), F.lit(0))).alias("beta"))
    return t.withColumn("rate", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def ranking(aligned: DataFrame) -> DataFrame:
    """(policy, score, place) by mean alignment, highest first, of equal ones the smaller number."""
    t = aligned.groupBy("policy").agg(F.round(F.avg("score"), 9).alias("score"))
    return t.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "policy")))  # a row a policy


def coherence(aligned: DataFrame, threshold: float = ACCEPTED) -> DataFrame:
    """(policy, coherence): the share of the agents' weight that takes the policy; 0 without weight."""
    taken = F.sum(F.when(F.col("score") >= threshold, F.col("weight")).otherwise(0.0))
    return aligned.groupBy("policy").agg(F.coalesce(F.try_divide(taken, F.sum("weight")), F.lit(0.0)).alias("coherence"))


def conflicts(aligned: DataFrame) -> DataFrame:
    """(policy, conflict): the deviation of alignment within what should agree, 1 at most: nothing for policies of agents, the worst cluster for
    those of clusters, all agents for those of the swarm."""
    spread = F.coalesce(F.when(F.count(F.lit(1)) > 1, F.stddev_samp("score")), F.lit(0.0))
    inside = aligned.filter(F.col("scope") == CLUSTER).groupBy("policy", "cluster").agg(spread.alias("d")).groupBy("policy").agg(F.max("d").alias("d"))
    whole = aligned.filter(F.col("scope") == SWARM).groupBy("policy").agg(spread.alias("d"))
    none = aligned.filter(F.col("scope") == AGENT).select("policy", F.lit(0.0).alias("d")).distinct()
    return inside.union(whole).union(none).select("policy", F.least(F.lit(1.0), F.col("d")).alias("conflict"))


def embedding(metrics: Column, weights: list[list[float]]) -> Column:
    """ReLU(metrics . W); W has a row a metric."""
    return F.array(*[F.greatest(F.lit(0.0), sum((F.get(metrics, F.lit(m)) * float(row[d]) for m, row in enumerate(weights)), F.lit(0.0))) for d in range(len(weights[0]))])


# --------------------------------------------------------------------------- reports and directives


def alignment_of_reports(rollbacks: Column, routing: Column, risk: Column) -> Column:
    """1, times .95 with rollbacks, .90 with a routing efficiency under .7, .92 with a risk trend over .1."""
    return F.when(rollbacks > 0, 0.95).otherwise(1.0) * F.when(routing < 0.7, 0.90).otherwise(1.0) * F.when(risk > 0.1, 0.92).otherwise(1.0)


#: Fixed values: (notes, priority, scope, consensus, budget, exploration) of the directive for drift, load and efficiency.
DIRECTIVES = (
    ("High drift detected, tightening consensus", "High", "Agent", 0.05, -2, -0.1),
    ("High load forecast, reducing exploration", "Normal", "Cluster", 0.0, -1, -0.2),
    ("Efficiency improving, enabling structural mutations", "Normal", "Swarm", 0.0, 2, 0.15),
)


def directives(drift: Column, load: Column, trend: Column, structural: Column) -> Column:
    """Array of the directives that hold, in order: drift over .4, load over .8, and a trend over .05 while structural changes are off."""
    held = (drift > 0.4, load > 0.8, (trend > 0.05) & ~structural)
    names = ("notes", "priority", "scope", "consensus", "budget", "exploration")
    made = [F.when(h, F.struct(*[F.lit(v).alias(n) for n, v in zip(names, d)])) for h, d in zip(held, DIRECTIVES)]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def first_delta(found: Column, name: str) -> Column:
    return F.coalesce(F.get(F.filter(F.transform(found, lambda x: x[name]), lambda v: v != 0), F.lit(0)), F.lit(0.0))


def sync_policy(found: Column) -> tuple[Column, Column]:
    """(consensus, rollback aggressiveness)."""
    delta = first_delta(found, "consensus")
    return 0.80 + delta, F.when(delta > 0, 1.5).otherwise(0.8)


def strategy_policy(found: Column) -> Column:
    return 0.3 + first_delta(found, "exploration")


def perception(efficiency: Column, drift: Column, load: Column, consensus: Column) -> dict[str, Column]:
    """Hormones of a cluster, and the label of its regime."""
    stress, growth = S.clamp(drift * 0.6 + load * 0.4), S.clamp(efficiency)
    label = F.when(stress > 0.7, "stressed").when(growth > 0.6, "improving").when((stress > 0.4) & (growth < 0.3), "exploring").otherwise("normal")
    return {"stress": stress, "growth": growth, "repair": F.when(stress > 0.5, stress * 0.8).otherwise(0.1), "coordination": S.clamp(consensus), "label": label}


def regime_code(stress: Column, growth: Column, limits: tuple[float, float, float] = (0.7, 0.6, 0.3)) -> Column:
    """0 normal, 1 stressed, 2 improving, 3 exploring, by thresholds on stress and growth."""
    return F.when(stress > limits[0], 1).when(growth > limits[1], 2).when(growth > limits[2], 3).otherwise(0)


# --------------------------------------------------------------------------- mutation and repair


def remediation(estimated_ms: Column, severity: Column, before: Column, recovery: Column, most_ms: int = 100, most_severity: int = 2) -> tuple[Column, Column]:
    """(success, performance after): within the time and up to the severity that may be mended by itself."""
    ok = (estimated_ms < most_ms) & (severity <= most_severity)
    return ok, F.when(ok, before * (1 + recovery)).otherwise(before)


def health_summary(history: DataFrame) -> DataFrame:
    """One row from (cause, success): errors, remediations, rate (1 without any) and the commonest cause, of equal ones the first by name."""
    by = history.groupBy("cause").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("won"))
    t = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("won"), F.lit(0)).alias("won"), F.min(F.struct((-F.col("n")).alias("n"), "cause")).alias("top"))
    return t.select("total", F.col("won").alias("successful"), (F.col("total") - F.col("won")).alias("failed"), F.when(F.col("total") > 0, F.col("won") / F.col("total")).otherwise(1.0).alias("success_rate"), F.col("top.cause").alias("commonest"), (-F.col("top.n")).alias("times"))


def dominates_in_both(latency: Column, memory: Column, other_latency: Column, other_memory: Column) -> Column:
    return (latency <= other_latency) & (memory <= other_memory)


def improves(latency: Column, memory: Column, base_latency: Column, base_memory: Column, threshold: float) -> Column:
    """Both ratios to the baseline (1 at least) are within the threshold."""
    return (latency / F.greatest(base_latency, F.lit(1)) <= threshold) & (memory / F.greatest(base_memory, F.lit(1)) <= threshold)


#: Fixed order: of paths with equal counts the first leads.
PATHS = ("AVX2", "NEON", "SSE4.1", "Scalar")


def dominant(counts: dict[str, Column]) -> Column:
    """The path with most operations; None without any."""
    most = F.greatest(*counts.values())
    out = F.lit(PATHS[-1])
    for name in reversed(PATHS):
        out = F.when(counts[name] == most, name).otherwise(out)
    return F.when(most == 0, "None").otherwise(out)


def intent_route(intent: Column, score: Column, threshold: Column | int, external: Column) -> Column:
    """Known intents are local from the threshold on; the rest is external where that is configured."""
    away = F.when(external, "external").otherwise("local_fallback")
    return F.when(intent.isin("classify", "score", "predict") & (score >= threshold), "local").otherwise(away)


def blend(channels: list[Column], weights: list[float]) -> Column:
    """Weighted sum of the structural, temporal, evolutionary and biological channels."""
    return sum((c * float(w) for c, w in zip(channels, weights)), F.lit(0.0))


#: Fixed order of severities.
SEVERITIES = ("none", "low", "medium", "high", "critical")


def severity_rank(name: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), name) - 1).cast("int")

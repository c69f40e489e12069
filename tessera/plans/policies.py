"""Queries of agents and policies, directives, remediation, and the small decisions of routing and dispatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import folds, graph, policies
from .domain import TICKS_SQL, read, ticks

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def agents(spark, sf_dir) -> DataFrame:
    """Agents are suppliers, clusters their nations."""
    k = F.col("s_suppkey")
    behaviour = F.array((k * 3 % 11) / 11.0, (k * 5 % 13) / 13.0, (k * 7 % 17) / 17.0)
    return read(spark, sf_dir, "supplier").select(k.alias("agent"), F.col("s_nationkey").alias("cluster"), ((k % 7 + 1) / 7.0).alias("weight"), behaviour.alias("behaviour"))


def rules(spark, sf_dir) -> DataFrame:
    """Policies are regions."""
    r = F.col("r_regionkey")
    target = F.array(((r + 1) % 3) / 2.0, ((r + 2) % 3) / 2.0, ((r * 2 + 1) % 3) / 2.0)
    return read(spark, sf_dir, "region").select(r.alias("policy"), (r % 3).alias("scope"), (1 + r / 4.0).alias("priority"), target.alias("target"))


def _aligned(spark, sf_dir):
    return policies.alignment(agents(spark, sf_dir), rules(spark, sf_dir))


ALIGNED_SQL = """
a AS (SELECT s_suppkey AS agent, s_nationkey AS cluster, (s_suppkey % 7 + 1) / 7.0::DOUBLE AS weight, (s_suppkey * 3 % 11) / 11.0::DOUBLE AS b0, (s_suppkey * 5 % 13) / 13.0::DOUBLE AS b1, (s_suppkey * 7 % 17) / 17.0::DOUBLE AS b2 FROM supplier),
p AS (SELECT r_regionkey AS policy, r_regionkey % 3 AS scope, 1 + r_regionkey / 4.0::DOUBLE AS priority, ((r_regionkey + 1) % 3) / 2.0::DOUBLE AS t0, ((r_regionkey + 2) % 3) / 2.0::DOUBLE AS t1, ((r_regionkey * 2 + 1) % 3) / 2.0::DOUBLE AS t2 FROM region),
al AS (SELECT agent, cluster, weight, policy, scope, (b0 * t0 + b1 * t1 + b2 * t2) * priority AS score FROM a CROSS JOIN p)"""


@query("policy_alignment", f"WITH {ALIGNED_SQL} SELECT agent, policy, round(score, 6) AS score FROM al")
def policy_alignment(spark, sf_dir):
    return _aligned(spark, sf_dir).select("agent", "policy", F.round("score", 6).alias("score"))


@query("policy_beliefs", f"WITH {ALIGNED_SQL} SELECT policy, 1 + policy + count(*) FILTER (WHERE score >= 0.6) AS alpha, 2 + count(*) FILTER (WHERE NOT score >= 0.6) AS beta, round((1 + policy + count(*) FILTER (WHERE score >= 0.6))::DOUBLE / (3 + policy + count(*)), 6) AS rate FROM al GROUP BY policy")
def policy_beliefs(spark, sf_dir):
    prior = rules(spark, sf_dir).select("policy", (1 + F.col("policy")).cast("long").alias("alpha"), F.lit(2).cast("long").alias("beta"))
    return policies.beliefs(_aligned(spark, sf_dir), prior).select("policy", "alpha", "beta", F.round("rate", 6).alias("rate"))


@query("policy_ranking", f"WITH {ALIGNED_SQL}, m AS (SELECT policy, round(avg(score), 9) AS s FROM al GROUP BY policy) SELECT policy, row_number() OVER (ORDER BY s DESC, policy)::INTEGER AS place FROM m")
def policy_ranking(spark, sf_dir):
    return policies.ranking(_aligned(spark, sf_dir)).select("policy", "place")


@query("policy_coherence", f"WITH {ALIGNED_SQL} SELECT policy, round(sum(CASE WHEN score >= 0.6 THEN weight ELSE 0 END) / sum(weight), 6) AS coherence FROM al GROUP BY policy")
def policy_coherence(spark, sf_dir):
    return policies.coherence(_aligned(spark, sf_dir)).select("policy", F.round("coherence", 6).alias("coherence"))


@query("scope_conflicts", f"WITH {ALIGNED_SQL}, c AS (SELECT policy, cluster, coalesce(stddev_samp(score), 0) AS d FROM al WHERE scope = 1 GROUP BY 1, 2), x AS (SELECT policy, max(d) AS d FROM c GROUP BY policy UNION ALL SELECT policy, coalesce(stddev_samp(score), 0) FROM al WHERE scope = 2 GROUP BY policy UNION ALL SELECT DISTINCT policy, 0.0::DOUBLE FROM al WHERE scope = 0) SELECT policy, round(least(1, d), 6) AS conflict FROM x")
def scope_conflicts(spark, sf_dir):
    return policies.conflicts(_aligned(spark, sf_dir)).select("policy", F.round("conflict", 6).alias("conflict"))


_W = [[((m * 5 + d * 3) % 7 - 3) / 3 for d in range(16)] for m in range(8)]
_EMBED_SQL = "e AS (SELECT s_suppkey AS agent, s_nationkey AS cluster, d AS dim, greatest(0, sum((s_suppkey * (m * 2 + 1) % 19) / 19.0::DOUBLE * ((m * 5 + d * 3) % 7 - 3) / 3)) AS value FROM supplier, (SELECT unnest(range(8)) AS m), (SELECT unnest(range(16)) AS d) GROUP BY 1, 2, 3)"


def _embedded(spark, sf_dir):
    k = F.col("s_suppkey")
    metrics = F.array(*[(k * (m * 2 + 1) % 19) / 19.0 for m in range(8)])
    return read(spark, sf_dir, "supplier").select(k.alias("agent"), F.col("s_nationkey").alias("cluster"), F.posexplode(policies.embedding(metrics, _W)).alias("dim", "value"))


@query("agent_embeddings", f"WITH {_EMBED_SQL} SELECT agent, dim::INTEGER AS dim, round(value, 6) AS value FROM e")
def agent_embeddings(spark, sf_dir):
    return _embedded(spark, sf_dir).select("agent", "dim", F.round("value", 6).alias("value"))


@query("cluster_embeddings", f"WITH {_EMBED_SQL} SELECT cluster, dim::INTEGER AS dim, round(sum(value) / count(*), 6) AS value FROM e GROUP BY 1, 2")
def cluster_embeddings(spark, sf_dir):
    """Sums over a cluster's agents, divided by their count."""
    return _embedded(spark, sf_dir).groupBy("cluster", "dim").agg(F.round(F.sum("value") / F.count(F.lit(1)), 6).alias("value"))


@query("swarm_metrics", f"WITH {_EMBED_SQL}, c AS (SELECT cluster, dim, sum(value) / count(*) AS value FROM e GROUP BY 1, 2) SELECT dim::INTEGER AS dim, round(sum(value), 5) AS total FROM c GROUP BY 1")
def swarm_metrics(spark, sf_dir):
    """Sums over clusters."""
    c = _embedded(spark, sf_dir).groupBy("cluster", "dim").agg((F.sum("value") / F.count(F.lit(1))).alias("value"))
    return c.groupBy("dim").agg(F.round(F.sum("value"), 5).alias("total"))


# --------------------------------------------------------------------------- reports and directives

_REPORTS_SQL = f"{TICKS_SQL.strip()}, r AS (SELECT batch_id, count(*) FILTER (WHERE alarm) AS rollbacks, avg(utility) AS routing, avg(drop_rate) AS risk, 1 - avg(safety) AS drift, avg(quarantine) * 2 AS load, (arg_max(utility, tick) - arg_min(utility, tick)) / count(*) AS trend, bool_or(event_type = 'purchase') AS structural, avg(coverage) AS consensus FROM t GROUP BY batch_id)"


def reports(spark, sf_dir) -> DataFrame:
    """What the other brains report of each agent.  Means are of sums in order of ticks, so that they do not depend on how rows arrive, over the values that are there."""
    so_far = Window.partitionBy("batch_id").orderBy("tick").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ("utility", "drop_rate", "safety", "quarantine", "coverage")
    t = ticks(spark, sf_dir).withColumns({f"sum_{c}": F.sum(c).over(so_far) for c in summed}).groupBy("batch_id")
    mean = {c: F.max_by(f"sum_{c}", "tick") / F.count(c) for c in summed}
    return t.agg(F.count_if("alarm").alias("rollbacks"), mean["utility"].alias("routing"), mean["drop_rate"].alias("risk"), (1 - mean["safety"]).alias("drift"), (mean["quarantine"] * 2).alias("load"), ((F.max_by("utility", "tick") - F.min_by("utility", "tick")) / F.count(F.lit(1))).alias("trend"), F.bool_or(F.col("event_type") == "purchase").alias("structural"), mean["coverage"].alias("consensus"))


@query("governance_alignment", f"WITH {_REPORTS_SQL} SELECT batch_id, round(CASE WHEN rollbacks > 0 THEN 0.95::DOUBLE ELSE 1 END * CASE WHEN routing < 0.7 THEN 0.90::DOUBLE ELSE 1 END * CASE WHEN risk > 0.1 THEN 0.92::DOUBLE ELSE 1 END, 6) AS alignment FROM r")
def governance_alignment(spark, sf_dir):
    return reports(spark, sf_dir).select("batch_id", F.round(policies.alignment_of_reports(F.col("rollbacks"), F.col("routing"), F.col("risk")), 6).alias("alignment"))


_DIRECTED_SQL = f"{_REPORTS_SQL}, d AS (SELECT batch_id, drift > 0.4 AS a, load > 0.8 AS b, trend > 0.005 AND NOT structural AS c FROM r)"


def _directed(spark, sf_dir):
    return reports(spark, sf_dir).select("batch_id", policies.directives(F.col("drift"), F.col("load"), F.col("trend") * 10, F.col("structural")).alias("found"))


@query("policy_synthesis", f"WITH {_DIRECTED_SQL} SELECT batch_id, concat_ws(',', CASE WHEN a THEN 'Agent' END, CASE WHEN b THEN 'Cluster' END, CASE WHEN c THEN 'Swarm' END) AS scopes, (CASE WHEN a THEN -2 ELSE 0 END + CASE WHEN b THEN -1 ELSE 0 END + CASE WHEN c THEN 2 ELSE 0 END)::INTEGER AS budget FROM d")
def policy_synthesis(spark, sf_dir):
    """Directives by drift, load and efficiency."""
    found = F.col("found")
    return _directed(spark, sf_dir).select("batch_id", F.array_join(F.transform(found, lambda x: x["scope"]), ",").alias("scopes"), F.aggregate(found, F.lit(0), lambda s, x: s + x["budget"]).alias("budget"))


@query("exported_policies", f"WITH {_DIRECTED_SQL} SELECT batch_id, round(0.80::DOUBLE + CASE WHEN a THEN 0.05 ELSE 0 END, 6) AS consensus, CASE WHEN a THEN 1.5::DOUBLE ELSE 0.8::DOUBLE END AS aggressiveness, round(0.3::DOUBLE + CASE WHEN a THEN -0.1 WHEN b THEN -0.2 WHEN c THEN 0.15 ELSE 0 END, 6) AS exploration FROM d")
def exported_policies(spark, sf_dir):
    """What the synchronising and the strategy brain are told: the first change that is not 0."""
    consensus, aggressive = policies.sync_policy(F.col("found"))
    return _directed(spark, sf_dir).select("batch_id", F.round(consensus, 6).alias("consensus"), aggressive.alias("aggressiveness"), F.round(policies.strategy_policy(F.col("found")), 6).alias("exploration"))


@query("perception", f"WITH {_REPORTS_SQL}, h AS (SELECT batch_id, least(1, greatest(0, drift * 0.6::DOUBLE + load * 0.4::DOUBLE)) AS stress, least(1, greatest(0, routing)) AS growth, least(1, greatest(0, consensus)) AS coordination FROM r) SELECT batch_id, round(stress, 6) AS stress, round(growth, 6) AS growth, round(CASE WHEN stress > 0.5 THEN stress * 0.8::DOUBLE ELSE 0.1 END, 6) AS repair, round(coordination, 6) AS coordination, CASE WHEN stress > 0.7 THEN 'stressed' WHEN growth > 0.6 THEN 'improving' WHEN stress > 0.4 AND growth < 0.3 THEN 'exploring' ELSE 'normal' END AS label, CASE WHEN stress > 0.7 THEN 1 WHEN growth > 0.6 THEN 2 WHEN growth > 0.3 THEN 3 ELSE 0 END AS code FROM h")
def perception(spark, sf_dir):
    """Hormones and regime of each agent's cluster, by label and by code.  Many means are halves of the last digit, which are rounded in binary as SQL does."""
    p = policies.perception(F.col("routing"), F.col("drift"), F.col("load"), F.col("consensus"))
    numbers = [(F.round(p[k] * 1e6) / 1e6).alias(k) for k in ("stress", "growth", "repair", "coordination")]
    return reports(spark, sf_dir).select("batch_id", *numbers, p["label"].alias("label"), policies.regime_code(p["stress"], p["growth"]).alias("code"))


# --------------------------------------------------------------------------- mutation, repair, checkpoints

_FIX_SQL = "f AS (SELECT o_orderkey, 'cause' || o_custkey % 9 AS cause, o_orderkey % 140 AS ms, o_custkey % 5 AS severity, o_totalprice AS before, (o_orderkey % 10) / 50.0::DOUBLE AS recovery FROM orders), g AS (SELECT *, ms < 100 AND severity <= 2 AS success FROM f)"


def _remedied(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    ok, after = policies.remediation(F.col("o_orderkey") % 140, F.col("o_custkey") % 5, F.col("o_totalprice"), (F.col("o_orderkey") % 10) / 50.0)
    return o.select("o_orderkey", F.concat(F.lit("cause"), (F.col("o_custkey") % 9).cast("string")).alias("cause"), ok.alias("success"), after.alias("after"))


@query("remediations", f"WITH {_FIX_SQL} SELECT o_orderkey, success, round(CASE WHEN success THEN before * (1 + recovery) ELSE before END, 4) AS after FROM g")
def remediations(spark, sf_dir):
    return _remedied(spark, sf_dir).select("o_orderkey", "success", F.round("after", 4).alias("after"))


@query("healing_summary", f"WITH {_FIX_SQL}, c AS (SELECT cause, count(*) AS n FROM g GROUP BY cause ORDER BY n DESC, cause LIMIT 1) SELECT count(*) AS total, count(*) FILTER (WHERE success) AS successful, count(*) FILTER (WHERE NOT success) AS failed, round(count(*) FILTER (WHERE success)::DOUBLE / count(*), 6) AS success_rate, (SELECT cause FROM c) AS commonest, (SELECT n FROM c) AS times FROM g")
def healing_summary(spark, sf_dir):
    return policies.health_summary(_remedied(spark, sf_dir)).withColumn("success_rate", F.round("success_rate", 6))


_LAST = lambda n, column="*": f"k AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY tick DESC) AS back FROM t), l AS (SELECT * FROM k WHERE back <= {n})"


@query("checkpoints", f"WITH {TICKS_SQL}, {_LAST(10)} SELECT batch_id, count(*) AS held, min(tick) AS oldest, max(event_id) FILTER (WHERE tick = 12) AS rolled_back_to FROM l GROUP BY batch_id")
def checkpoints(spark, sf_dir):
    """The ten latest of each agent, and what a rollback to the twelfth finds: null once it is gone."""
    held = folds.last_rows(ticks(spark, sf_dir).select("batch_id", "tick", "event_id"), "batch_id", ["tick"], 10)
    return held.groupBy("batch_id").agg(F.count(F.lit(1)).alias("held"), F.min("tick").alias("oldest"), F.max(F.when(F.col("tick") == 12, F.col("event_id"))).alias("rolled_back_to"))


@query("recent_snapshots", f"WITH {TICKS_SQL}, {_LAST(100)} SELECT batch_id, count(*) AS held, round(avg(utility) FILTER (WHERE back <= 50), 6) AS efficiency, round(avg(value) FILTER (WHERE back <= 20), 4) AS mean_return FROM l GROUP BY batch_id")
def recent_snapshots(spark, sf_dir):
    """A hundred snapshots an agent, fifty efficiencies and twenty returns."""
    t = folds.last_rows(ticks(spark, sf_dir).select("batch_id", "tick", "utility", "value"), "batch_id", ["tick"], 100)
    back = F.row_number().over(Window.partitionBy("batch_id").orderBy(F.desc("tick")))  # 100 rows an agent
    t = t.withColumn("back", back)
    return t.groupBy("batch_id").agg(F.count(F.lit(1)).alias("held"), F.round(F.avg(F.when(F.col("back") <= 50, F.col("utility"))), 6).alias("efficiency"), F.round(F.avg(F.when(F.col("back") <= 20, F.col("value"))), 4).alias("mean_return"))


@query("mutation_success", f"WITH {TICKS_SQL} SELECT event_id, round(avg(CASE WHEN utility > 0.5 THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY batch_id ORDER BY tick ROWS BETWEEN 1000 PRECEDING AND CURRENT ROW), 6) AS rate FROM t")
def mutation_success(spark, sf_dir):
    """Success rate over the outcomes that are kept when one is added."""
    won = F.when(F.col("utility") > 0.5, 1.0).otherwise(0.0)
    return ticks(spark, sf_dir).withColumn("won", won).select("event_id", F.round(folds.rolling_mean("won", "batch_id", ["tick"], 1001), 6).alias("rate"))


@query("repair_totals", f"WITH {TICKS_SQL}, r AS (SELECT batch_id, tick, event_id % 3 AS kind, utility FROM t WHERE alarm OR quarantine > 0.5) SELECT batch_id, count(*) FILTER (WHERE kind = 0 AND tick > 1) AS rollbacks, count(*) FILTER (WHERE kind > 0 OR tick > 1) AS repaired, round(coalesce(arg_max(utility, tick) FILTER (WHERE kind = 1), 0.5), 6) AS baseline, CASE WHEN count(*) FILTER (WHERE kind = 2) > 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS parent FROM r GROUP BY batch_id")
def repair_totals(spark, sf_dir):
    """Repairs of each agent: rollbacks need a checkpoint, corrections set the baseline, reconnections the parent's quality."""
    r = ticks(spark, sf_dir).filter("alarm OR quarantine > 0.5").select("batch_id", "tick", (F.col("event_id") % 3).alias("kind"), "utility")
    back = (F.col("kind") == 0) & (F.col("tick") > 1)
    return r.groupBy("batch_id").agg(F.count_if(back).alias("rollbacks"), F.count_if(back | (F.col("kind") > 0)).alias("repaired"), F.round(F.coalesce(F.max_by(F.when(F.col("kind") == 1, F.col("utility")), F.when(F.col("kind") == 1, F.col("tick"))), F.lit(0.5)), 6).alias("baseline"), F.when(F.count_if(F.col("kind") == 2) > 0, 0.5).otherwise(1.0).alias("parent"))


@query("kept_transfers", f"WITH {TICKS_SQL}, n AS (SELECT max(tick) AS now FROM t) SELECT event_id FROM t, n WHERE tick >= greatest(0, now - 20)")
def kept_transfers(spark, sf_dir):
    """Transfers of the last twenty cycles."""
    t = ticks(spark, sf_dir).select("event_id", "tick")
    return t.join(F.broadcast(t.agg(F.max("tick").alias("now"))), how="cross").filter("tick >= greatest(0, now - 20)").select("event_id")  # one row


@query("registered_agents", "SELECT user_id, min(event_id) AS event_id FROM events WHERE user_id % 4 <> 0 GROUP BY user_id")
def registered_agents(spark, sf_dir):
    """Agents that register beside those there are, each once."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id")
    known = e.filter("user_id % 4 = 0").select("user_id")
    return e.join(known, "user_id", "left_anti").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("top_patterns", "WITH k AS (SELECT coalesce(props->>'$.k', '') AS k, count(*) AS n, count(*) FILTER (WHERE value >= 50) AS won FROM events GROUP BY 1) SELECT k, round(won::DOUBLE / n, 6) AS rate FROM k ORDER BY round(won::DOUBLE / n, 9) DESC, k LIMIT 10")
def top_patterns(spark, sf_dir):
    """The ten patterns of highest success rate."""
    k = read(spark, sf_dir, "events").groupBy(F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k")).agg((F.count_if(F.col("value") >= 50) / F.count(F.lit(1))).alias("rate"))
    return k.orderBy(F.desc(F.round("rate", 9)), "k").limit(10).select("k", F.round("rate", 6).alias("rate"))


# --------------------------------------------------------------------------- routing and dispatch


@query("intent_routes", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') AND value >= 50 THEN 'local' WHEN user_id % 3 = 0 THEN 'external' ELSE 'local_fallback' END AS route FROM events")
def intent_routes(spark, sf_dir):
    """Views classify and clicks score; a third of users have an external backend."""
    intent = F.when(F.col("event_type") == "view", "classify").when(F.col("event_type") == "click", "score").otherwise(F.col("event_type"))
    return read(spark, sf_dir, "events").select("event_id", policies.intent_route(intent, F.col("value"), 50, F.col("user_id") % 3 == 0).alias("route"))


@query("learning_update", "WITH m AS (SELECT user_id AS intent, count(*) AS calls, count(*) FILTER (WHERE value >= 10) / count(*)::DOUBLE AS rate, avg(value) AS score FROM events GROUP BY 1) SELECT intent, calls, round(rate, 6) AS local_rate, round(score, 4) AS avg_score FROM m WHERE calls >= 3 AND rate > 0.8")
def learning_update(spark, sf_dir):
    """Intents of three calls or more that are local in more than four of five."""
    m = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("intent")).agg(F.count(F.lit(1)).alias("calls"), (F.count_if(F.col("value") >= 10) / F.count(F.lit(1))).alias("rate"), F.round(F.avg("value"), 4).alias("avg_score"))
    return m.filter("calls >= 3 AND rate > 0.8").select("intent", "calls", F.round("rate", 6).alias("local_rate"), "avg_score")


@query("quad_observations", "SELECT event_id, round(sum(CASE WHEN value >= 50 THEN 1.0::DOUBLE ELSE 0 END) OVER w / count(*) OVER w, 6) AS acceptance, floor(least(1, value / 100) * 8)::BIGINT AS bucket FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def quad_observations(spark, sf_dir):
    """Running local share of each caller, and the bucket of its confidence."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    local = F.sum(F.when(F.col("value") >= 50, 1.0).otherwise(0.0)).over(w) / F.count(F.lit(1)).over(w)
    return read(spark, sf_dir, "events").select("event_id", F.round(local, 6).alias("acceptance"), F.floor(F.least(F.lit(1.0), F.col("value") / 100) * 8).alias("bucket"))


@query("kernel_stats", "WITH c AS (SELECT user_id, count(*) AS ops, count(*) FILTER (WHERE event_id % 4 = 0) AS a, count(*) FILTER (WHERE event_id % 4 = 1) AS n, count(*) FILTER (WHERE event_id % 4 = 2) AS e, count(*) FILTER (WHERE event_id % 4 = 3) AS s, count(*) FILTER (WHERE event_id % 19 = 0) AS errors, avg(value) AS latency FROM events GROUP BY user_id) SELECT user_id, ops, errors, round(latency, 4) AS latency, CASE greatest(a, n, e, s) WHEN a THEN 'AVX2' WHEN n THEN 'NEON' WHEN e THEN 'SSE4.1' ELSE 'Scalar' END AS path FROM c")
def kernel_stats(spark, sf_dir):
    """Operations, errors and mean latency of each caller, and the path that most of them took."""
    k = F.col("event_id") % 4
    names = dict(zip(("AVX2", "NEON", "SSE4.1", "Scalar"), "anes"))
    c = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("ops"), F.count_if(F.col("event_id") % 19 == 0).alias("errors"), F.round(F.avg("value"), 4).alias("latency"), *[F.count_if(k == i).alias(n) for i, n in enumerate("anes")])
    return c.select("user_id", "ops", "errors", "latency", policies.dominant({p: F.col(n) for p, n in names.items()}).alias("path"))


@query("op_regressions", f"WITH {TICKS_SQL}, b AS (SELECT event_id, value AS v, event_id % 50 + 1 AS m, lag(value) OVER w AS v0, lag(event_id % 50 + 1) OVER w AS m0 FROM t WINDOW w AS (PARTITION BY batch_id ORDER BY tick)) SELECT event_id, v / greatest(v0, 1) <= 1.05 AND m::DOUBLE / greatest(m0, 1) <= 1.05 AS improves, v <= v0 AND m <= m0 AS dominates FROM b WHERE v0 IS NOT NULL")
def op_regressions(spark, sf_dir):
    """Each operation against the caller's one before, by latency and memory."""
    w = Window.partitionBy("batch_id").orderBy("tick")
    t = ticks(spark, sf_dir).select("event_id", "batch_id", "tick", F.col("value").alias("v"), (F.col("event_id") % 50 + 1).alias("m"))
    t = t.withColumns({"v0": F.lag("v").over(w), "m0": F.lag("m").over(w)}).filter("v0 IS NOT NULL")
    c = [F.col(x) for x in ("v", "m", "v0", "m0")]
    return t.select("event_id", policies.improves(*c, 1.05).alias("improves"), policies.dominates_in_both(*c).alias("dominates"))


@query("telemetry_blend", f"WITH {TICKS_SQL} SELECT event_id, round(utility * 0.4::DOUBLE + safety * 0.3::DOUBLE + coverage * 0.2::DOUBLE + quarantine * 0.1::DOUBLE, 6) AS blend FROM t")
def telemetry_blend(spark, sf_dir):
    return ticks(spark, sf_dir).select("event_id", F.round(policies.blend([F.col(c) for c in ("utility", "safety", "coverage", "quarantine")], [0.4, 0.3, 0.2, 0.1]), 6).alias("blend"))


@query("severity_order", "SELECT o_orderpriority, s AS severity, CASE s WHEN 'none' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS rank, count(*) AS n FROM (SELECT o_orderpriority, CASE left(o_orderpriority, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'none' END AS s FROM orders) GROUP BY 1, 2, 3")
def severity_order(spark, sf_dir):
    first = F.substring("o_orderpriority", 1, 1)
    name = F.when(first == "1", "critical").when(first == "2", "high").when(first == "3", "medium").when(first == "4", "low").otherwise("none")
    t = read(spark, sf_dir, "orders").groupBy("o_orderpriority", name.alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    return t.select("o_orderpriority", "severity", policies.severity_rank(F.col("severity")).alias("rank"), "n")


@query("normalized_interaction", "WITH b AS (SELECT n_nationkey, n_regionkey, length(n_name) AS size, pos, CASE WHEN (ord(c) - 109.5::DOUBLE) / 13 > 0.33 THEN 1 WHEN (ord(c) - 109.5::DOUBLE) / 13 < -0.33 THEN -1 ELSE 0 END AS v FROM (SELECT n_nationkey, n_regionkey, n_name, unnest(string_split(n_name, '')) AS c, generate_subscripts(string_split(n_name, ''), 1) AS pos FROM nation)), r AS (SELECT r_regionkey, length(r_name) AS size, pos, CASE WHEN (ord(c) - 109.5::DOUBLE) / 13 > 0.33 THEN 1 WHEN (ord(c) - 109.5::DOUBLE) / 13 < -0.33 THEN -1 ELSE 0 END AS v FROM (SELECT r_regionkey, r_name, unnest(string_split(r_name, '')) AS c, generate_subscripts(string_split(r_name, ''), 1) AS pos FROM region)) SELECT n_nationkey, round(CAST(sum(b.v * coalesce(r.v, 0)) AS DOUBLE) / least(any_value(b.size), min(r.size)), 6) AS score FROM b LEFT JOIN r ON r.r_regionkey = b.n_regionkey AND r.pos = b.pos GROUP BY 1")
def normalized_interaction(spark, sf_dir):
    """Interaction of labels over the shorter one's length; 0 for an empty one."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    raw = A.dot(A.ternary_bytes(F.col("n_name")), A.ternary_bytes(F.col("r_name")))
    size = F.least(F.octet_length("n_name"), F.octet_length("r_name"))
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.round(F.coalesce(F.try_divide(raw, size.cast("double")), F.lit(0.0)), 6).alias("score"))


@query("schooling", "SELECT (o_custkey % 6)::INTEGER AS phase, count(*) AS n_runs, count(*) FILTER (WHERE o_orderkey % 100 >= 70) AS n_pass, count(*) FILTER (WHERE o_orderkey % 100 < 70) AS n_fail, round(avg((o_orderkey % 100) / 100.0::DOUBLE), 6) AS mean_score, min((o_orderkey % 100) / 100.0::DOUBLE) AS min_score, max((o_orderkey % 100) / 100.0::DOUBLE) AS max_score, round(avg(o_orderkey % 3 + 1), 6) AS mean_attempts FROM orders GROUP BY 1")
def schooling(spark, sf_dir):
    """Campaigns by phase."""
    score = (F.col("o_orderkey") % 100) / 100.0
    o = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 6).cast("int").alias("phase"), score.alias("score"), (F.col("o_orderkey") % 3 + 1).alias("attempt"), (F.col("o_orderkey") % 100 >= 70).alias("passed"))
    return o.groupBy("phase").agg(F.count(F.lit(1)).alias("n_runs"), F.count_if("passed").alias("n_pass"), F.count_if(~F.col("passed")).alias("n_fail"), F.round(F.avg("score"), 6).alias("mean_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.round(F.avg("attempt"), 6).alias("mean_attempts"))


@query("fitness_aggregate", f"WITH {TICKS_SQL} SELECT count(*) AS n, round(coalesce(avg(utility), 0), 6) AS mean_utility, coalesce(min(safety), 1) AS min_safety FROM t")
def fitness_aggregate(spark, sf_dir):
    """Mean utility and least safety; 0 and 1 without any."""
    return ticks(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg("utility"), F.lit(0.0)), 6).alias("mean_utility"), F.coalesce(F.min("safety"), F.lit(1.0)).alias("min_safety"))


@query("trace_summary", f"WITH {TICKS_SQL} SELECT batch_id, count(*) AS n_events, max(event_id) AS max_node, max(greatest(event_id % 37, event_id % 53)) AS max_signal FROM t GROUP BY batch_id")
def trace_summary(spark, sf_dir):
    """Events of a trace, its largest node and its largest signal, in or out."""
    k = F.col("event_id")
    return ticks(spark, sf_dir).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_events"), F.max(k).alias("max_node"), F.max(F.greatest(k % 37, k % 53)).alias("max_signal"))


@query("sequential_ids", "SELECT s_nationkey AS layer, count(*) AS n, count(*) FILTER (WHERE id <> place) AS misplaced FROM (SELECT s_nationkey, s_suppkey // 25 AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS place FROM supplier) GROUP BY 1")
def sequential_ids(spark, sf_dir):
    """Nodes of each layer whose number is not their place."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("layer"), "s_suppkey")
    t = graph.ranked(s, "layer", ["s_suppkey"], "place", "n")
    return t.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.floor(F.col("s_suppkey") / 25) != F.col("place") - 1).alias("misplaced"))


@query("lineage_check", f"WITH {TICKS_SQL}, s AS (SELECT event_id AS slot_id, CASE WHEN event_id % 101 = 0 THEN event_id + 7 ELSE coalesce(lag(event_id) OVER (PARTITION BY batch_id ORDER BY event_id) + 1, 0) END AS parent_offset FROM t) SELECT slot_id, parent_offset::BIGINT AS parent_offset FROM s WHERE parent_offset > 0 AND parent_offset - 1 >= slot_id")
def lineage_check(spark, sf_dir):
    """Slots whose parent is not before them; every hundred and first is broken."""
    w = Window.partitionBy("batch_id").orderBy("event_id")
    offset = F.when(F.col("event_id") % 101 == 0, F.col("event_id") + 7).otherwise(F.coalesce(F.lag("event_id").over(w) + 1, F.lit(0)))
    s = ticks(spark, sf_dir).select(F.col("event_id").alias("slot_id"), offset.cast("long").alias("parent_offset"))
    return folds.broken_lineage(s)


@query("phage_events", f"WITH {TICKS_SQL} SELECT event_id AS mutation_id, sha256('{{\"mutation_id\":' || event_id || ',\"description\":\"phage:agent_id=' || batch_id || ',class=' || CASE WHEN safety <= 0 THEN 'Deterministic' ELSE 'Load' END || ',reason=' || event_type || '\",\"pre_fingerprint\":0,\"post_fingerprint\":0,\"latency_us\":0,\"memory_bytes\":0,\"outcome\":\"RejectedFitnessGate\",\"budget_ns\":0,\"timestamp\":' || tick || '}}') AS content_hash FROM t WHERE alarm")
def phage_events(spark, sf_dir):
    """Ledger rows of quarantines, by the hash of their entry."""
    t = ticks(spark, sf_dir).filter("alarm")
    kind = F.when(F.col("safety") <= 0, "Deterministic").otherwise("Load")
    entry = folds.ledger_entry(F.col("event_id"), folds.phage_description(F.col("batch_id"), kind, F.col("event_type")), outcome="RejectedFitnessGate", timestamp=F.col("tick"))
    return t.select(F.col("event_id").alias("mutation_id"), F.sha2(entry, 256).alias("content_hash"))


@query("routing_audit", f"WITH {TICKS_SQL} SELECT event_id, '{{\"request_id\":' || event_id || ',\"agent_id\":' || batch_id || ',\"route\":\"' || CASE WHEN utility >= 0.7 THEN 'local' WHEN utility >= 0.4 THEN 'local_fallback' ELSE 'external' END || '\"}}' AS entry FROM t")
def routing_audit(spark, sf_dir):
    """One structured line a decision."""
    route = F.when(F.col("utility") >= 0.7, "local").when(F.col("utility") >= 0.4, "local_fallback").otherwise("external")
    return ticks(spark, sf_dir).select("event_id", F.to_json(F.struct(F.col("event_id").alias("request_id"), F.col("batch_id").alias("agent_id"), route.alias("route"))).alias("entry"))


@query("ring_drain", f"WITH {TICKS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY tick) AS place FROM t) SELECT batch_id, count(*) AS heartbeats, least(count(*), 32) AS pushes, count(*) - least(count(*), 32) AS drops, max(event_id) FILTER (WHERE place <= 16) AS last_drained FROM k GROUP BY batch_id")
def ring_drain(spark, sf_dir):
    """Heartbeats of a ring of 32 that nothing empties until sixteen are drained, first in, first out."""
    t = ticks(spark, sf_dir).select("batch_id", "tick", "event_id")
    n = F.count(F.lit(1))
    return t.groupBy("batch_id").agg(n.alias("heartbeats"), F.least(n, F.lit(32)).alias("pushes"), (n - F.least(n, F.lit(32))).alias("drops"), F.max(F.when(F.col("tick") <= 16, F.col("event_id"))).alias("last_drained"))


@query("round_robin", f"WITH {TICKS_SQL}, q AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS turn, dense_rank() OVER (ORDER BY event_type) AS queue FROM t) SELECT event_type, event_id, row_number() OVER (ORDER BY turn, queue)::INTEGER AS place FROM q WHERE turn <= 2 ORDER BY turn, queue LIMIT 8")
def round_robin(spark, sf_dir):
    """Eight signals, one of each stream in turn, each stream asked twice at most."""
    return folds.round_robin(ticks(spark, sf_dir), "event_type", ["ts", "event_id"], 8).select("event_type", "event_id", "place")

"""Relational surface over the star schema, and coordination of agents as joins and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import graph
from .domain import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _round(c, n=2):
    return F.round(c, n)


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def pricing_summary(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(_round(F.sum("l_quantity")).alias("sum_qty"), _round(F.sum("l_extendedprice")).alias("sum_base_price"), _round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("sum_disc_price"), _round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("count_order"))


@query(
    "shipping_priority",
    """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate, o_orderpriority ORDER BY revenue DESC, l_orderkey LIMIT 10""",
)
def shipping_priority(spark, sf_dir):
    c = read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    t = o.join(read(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    t = t.groupBy("l_orderkey", "o_orderdate", "o_orderpriority").agg(_round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("revenue"))
    return t.orderBy(F.desc("revenue"), "l_orderkey").limit(10).select("l_orderkey", "revenue", "o_orderdate", "o_orderpriority")


@query(
    "local_supplier_volume",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""",
)
def local_supplier_volume(spark, sf_dir):
    r = lambda t: read(spark, sf_dir, t)
    t = r("lineitem").join(r("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(r("customer"), F.col("o_custkey") == F.col("c_custkey"))
    t = t.join(r("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(r("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(r("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.groupBy("n_name").agg(_round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("revenue"))


@query("discount_revenue", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.06 AND l_quantity < 24")
def discount_revenue(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").filter(F.col("l_discount").between(0.02, 0.06) & (F.col("l_quantity") < 24))  # noqa: E741
    return l.agg(_round(F.sum(F.col("l_extendedprice") * F.col("l_discount"))).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("rollup_sales", "SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS level, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_sales(spark, sf_dir):
    t = read(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("level"), _round(F.sum("o_totalprice")).alias("total"), F.count(F.lit(1)).alias("n"))
    return t.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "level", "total", "n")


@query("cube_customers", "SELECT coalesce(c_mktsegment, 'all') AS segment, coalesce(c_nationkey, -1) AS nation, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def cube_customers(spark, sf_dir):
    t = read(spark, sf_dir, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"), _round(F.avg("c_acctbal"), 4).alias("mean"))
    return t.select(F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), F.coalesce("c_nationkey", F.lit(-1)).alias("nation"), "n", "mean")


@query("customers_without_orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def customers_without_orders(spark, sf_dir):
    """Customers without an urgent order."""
    urgent = read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


@query("nations_both", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def nations_both(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(read(spark, sf_dir, "supplier").select("s_nationkey"))


@query("parts_unsold", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity >= 48")
def parts_unsold(spark, sf_dir):
    """Parts that no line sold 48 of or more."""
    sold = read(spark, sf_dir, "lineitem").filter("l_quantity >= 48").select("l_partkey").distinct()
    return read(spark, sf_dir, "part").select("p_partkey").exceptAll(sold).distinct()


@query("rank_orders", "SELECT o_custkey, o_orderkey, rk, round(running, 2) AS running FROM (SELECT o_custkey, o_orderkey, rank() OVER w AS rk, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) WHERE rk <= 3")
def rank_orders(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    t = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).alias("rk"), F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"))
    return t.filter("rk <= 3").withColumn("running", _round("running"))


@query("asof_orders", "SELECT e.event_id, o.o_orderkey FROM (SELECT event_id, user_id, ts FROM events) e ASOF LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey, o_orderdate FROM orders GROUP BY o_custkey, o_orderdate) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate")
def asof_orders(spark, sf_dir):
    """The last order of a user at each event: both sides in one ordered window, no range join."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), F.lit(1).alias("side"), "event_id", F.lit(None).cast("long").alias("o_orderkey"))
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("event_id"), "o_orderkey")
    w = Window.partitionBy("k").orderBy("t", "side", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return e.union(o).withColumn("o_orderkey", F.last("o_orderkey", True).over(w)).filter("side = 1").select("event_id", "o_orderkey")


@query("sessions", "WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY 1, 2")
def sessions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = read(spark, sf_dir, "events").withColumn("opens", F.when(F.col("ts") - F.lag("ts").over(w) < F.expr("INTERVAL 6 HOURS"), 0).otherwise(1))
    return t.withColumn("session", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))


@query("event_pivot", "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS n_{t}" for t in ("click", "view", "purchase")) + " FROM events GROUP BY user_id")
def event_pivot(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in ("click", "view", "purchase")])


# --------------------------------------------------------------------------- agents

AGENTS_SQL = "a AS (SELECT s_suppkey AS id, s_nationkey AS domain, s_suppkey % 4 AS level, (s_suppkey * 37 % 101) / 100.0::DOUBLE AS efficiency, (s_suppkey * 13 % 60)::DOUBLE AS history FROM supplier)"


def agents(spark, sf_dir):
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_nationkey").alias("domain"), (k % 4).alias("level"), (k * 37 % 101 / 100.0).alias("efficiency"), (k * 13 % 60).cast("double").alias("history"))


@query(
    "agent_affinity",
    f"WITH {AGENTS_SQL} SELECT x.id AS a, y.id AS b, round((0.5::DOUBLE * 0.9::DOUBLE + 0.25::DOUBLE * CASE WHEN x.level = y.level THEN 0.85::DOUBLE ELSE 0.6::DOUBLE END + 0.25::DOUBLE * (1 - abs(x.efficiency - y.efficiency))) * least(1, x.history / 50), 6) AS affinity FROM a x JOIN a y ON x.domain = y.domain AND x.id <> y.id",
)
def agent_affinity(spark, sf_dir):
    """Ordered pairs of one domain; the confidence is the first agent's history, so it is not symmetric."""
    a = agents(spark, sf_dir)
    x, y = a.alias("x"), a.alias("y")
    t = x.join(y, (F.col("x.domain") == F.col("y.domain")) & (F.col("x.id") != F.col("y.id")))
    level = F.when(F.col("x.level") == F.col("y.level"), 0.85).otherwise(0.6)
    near = 1 - F.abs(F.col("x.efficiency") - F.col("y.efficiency"))
    return t.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.round(S.affinity_score(F.lit(0.9), level, near, F.least(F.lit(1.0), F.col("x.history") / 50)), 6).alias("affinity"))


@query("agent_status", f"WITH {AGENTS_SQL} SELECT id, CASE WHEN history > 50 THEN 'Failed' WHEN efficiency < 0.4 THEN 'Degraded' ELSE 'Healthy' END AS status, CASE WHEN history > 50 THEN 'Reconnect' WHEN efficiency < 0.4 AND level = 0 THEN 'Rollback' WHEN level = 0 THEN 'Correct' ELSE 'None' END AS repair FROM a")
def agent_status(spark, sf_dir):
    a = agents(spark, sf_dir)
    failed, degraded, drift = F.col("history") > 50, F.col("efficiency") < 0.4, F.col("level") == 0
    return a.select("id", F.when(failed, "Failed").when(degraded, "Degraded").otherwise("Healthy").alias("status"), F.when(failed, "Reconnect").when(degraded & drift, "Rollback").when(drift, "Correct").otherwise("None").alias("repair"))


@query("consensus", f"WITH {AGENTS_SQL} SELECT domain, count(*) AS n, count(*) FILTER (WHERE efficiency >= 0.5) AS aligned, count(*) FILTER (WHERE efficiency >= 0.5) >= 0.6 * count(*) AS reached FROM a GROUP BY domain")
def consensus(spark, sf_dir):
    good = F.count_if(F.col("efficiency") >= 0.5)
    return agents(spark, sf_dir).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), good.alias("aligned"), (good >= 0.6 * F.count(F.lit(1))).alias("reached"))


@query("routing_argmax", f"WITH {AGENTS_SQL}, s AS (SELECT domain, id, 0.6::DOUBLE * efficiency + 0.4::DOUBLE / (1 + 0.1::DOUBLE * history) AS score FROM a), k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY round(score, 9) DESC, id) AS rk FROM s) SELECT domain, id, round(score, 6) AS score FROM k WHERE rk = 1")
def routing_argmax(spark, sf_dir):
    score = 0.6 * F.col("efficiency") + 0.4 / (1 + 0.1 * F.col("history"))
    t = agents(spark, sf_dir).withColumn("score", score).groupBy("domain").agg(F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("id")).alias("i"))).alias("m"))
    return t.select("domain", (-F.col("m.i")).alias("id"), F.round("m.s", 6).alias("score"))


@query("evolution_plan", "SELECT p_type, count(*) AS n, round(avg(CASE WHEN p_size >= 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS success, CASE WHEN avg(CASE WHEN p_size >= 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) > 0.7 THEN 'enable' WHEN avg(CASE WHEN p_size >= 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) < 0.3 THEN 'suppress' ELSE 'keep' END AS plan FROM part GROUP BY p_type")
def evolution_plan(spark, sf_dir):
    t = read(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("p_size") >= 25, 1.0).otherwise(0.0)).alias("s"))
    return t.select("p_type", "n", F.round("s", 6).alias("success"), F.when(F.col("s") > 0.7, "enable").when(F.col("s") < 0.3, "suppress").otherwise("keep").alias("plan"))


@query("error_severity", "SELECT o_orderkey, round(greatest(0, (o_totalprice - 150000) / 150000), 6) AS change, CASE WHEN (o_totalprice - 150000) / 150000 > 0.5 THEN 'Critical' WHEN (o_totalprice - 150000) / 150000 > 0.3 THEN 'Error' WHEN (o_totalprice - 150000) / 150000 > 0.15 THEN 'Warning' ELSE 'Info' END AS severity FROM orders")
def error_severity(spark, sf_dir):
    change = S.degradation(F.col("o_totalprice"), F.lit(150000.0), True)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(change, 6).alias("change"), S.severity(change).alias("severity"))


@query("queue_rebalance", "SELECT o_orderkey, o_custkey % 7 AS domain, ((row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_totalprice DESC, o_orderkey) - 1) % 4)::INTEGER AS agent FROM orders")
def queue_rebalance(spark, sf_dir):
    """By priority to the shortest of four empty queues, which is in turn."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 7).alias("domain"), (-F.col("o_totalprice")).alias("behind"))
    return graph.ranked(o, "domain", ["behind", "o_orderkey"], "rank", "n").select("o_orderkey", "domain", ((F.col("rank") - 1) % 4).cast("int").alias("agent"))


@query("intent_memory", "SELECT event_type AS intent, count(*) AS calls, round(avg(value), 6) AS avg_score, round(avg(CASE WHEN value >= 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS local_rate FROM events GROUP BY 1")
def intent_memory(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("intent")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg("value"), 6).alias("avg_score"), F.round(F.avg(F.when(F.col("value") >= 50, 1.0).otherwise(0.0)), 6).alias("local_rate"))


@query("packed_desires", "SELECT p_partkey, (least(32000, round_even(p_size / 50.0::DOUBLE * 1000, 0))::INTEGER * 65536 + round_even((p_partkey % 10) / 10.0::DOUBLE * 1000, 0)::INTEGER)::INTEGER AS desires FROM part")
def packed_desires(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", S.packed_desires(F.col("p_size") / 50.0, (F.col("p_partkey") % 10) / 10.0).alias("desires"))


@query("conversation_turns", "SELECT conv_id, count(*) AS n_turns, max(turn) AS last_turn, count(DISTINCT role) AS n_roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def conversation_turns(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.max("turn").alias("last_turn"), F.countDistinct("role").alias("n_roles"), F.sum(F.length("text")).alias("chars"))


@query("replay_compare", "SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, a.h = b.h AS same FROM (SELECT conv_id, sha256(string_agg(turn || ':' || role, '|' ORDER BY turn, role)) AS h FROM conversations GROUP BY 1) a FULL JOIN (SELECT conv_id, sha256(string_agg(turn || ':' || CASE WHEN conv_id % 5 = 0 THEN 'x' ELSE role END, '|' ORDER BY turn, role)) AS h FROM conversations GROUP BY 1) b ON a.conv_id = b.conv_id")
def replay_compare(spark, sf_dir):
    """Whether two runs made the same sequence of events."""
    c = read(spark, sf_dir, "conversations")

    def run(role):
        line = F.concat_ws(":", F.col("turn").cast("string"), role)
        return c.groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", line.alias("line")))), lambda x: x["line"]), "|"), 256).alias("h"))

    a, b = run(F.col("role")), run(F.when(F.col("conv_id") % 5 == 0, "x").otherwise(F.col("role"))).withColumnRenamed("h", "other")
    return a.join(b, "conv_id", "full").select("conv_id", (F.col("h") == F.col("other")).alias("same"))

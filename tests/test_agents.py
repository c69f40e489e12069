import pytest
from pyspark.sql import functions as F

from tessera.operators import agents


def test_hierarchy(spark):
    t = agents.hierarchy(spark, 250)
    assert {r.tier: r.n for r in agents.report(t).collect()} == {"super": 1, "sub": 10, "micro": 100, "nano": 250}
    assert agents.hierarchy(spark, 10**9, most=5).filter("tier = 'nano'").count() == 5
    more = agents.spawn(t, 42, 3)
    new = agents.paths(more).filter("tier = 'nano' AND idx >= 250").orderBy("idx").collect()
    assert [r.path for r in new] == [f"/super/0/sub/4/micro/42/nano/{i}" for i in (250, 251, 252)] and new[0].global_index == 1301
    with pytest.raises(ValueError):
        agents.spawn(t, 999, 1)
    with pytest.raises(ValueError):
        agents.spawn(t, 1, 10**6)


def test_ticks(spark):
    after, seen = agents.run_ticks(agents.hierarchy(spark, 9), 3, lambda tick: tick * 0.1 + F.col("idx") * 0)
    assert {r.last_heartbeat for r in agents.report(after).collect()} == {3}
    assert [(r.tick, round(r.mean_utility, 9), r.n) for r in seen.orderBy("tick").collect()] == [(1, 0.1, 120), (2, 0.2, 120), (3, 0.3, 120)]


def test_queue(spark):
    schema = "agent_id long, proposal_id long, confidence double, gain double"
    old = spark.createDataFrame([(1, i, 0.5, 0.5) for i in range(9)], schema)
    new = spark.createDataFrame([(1, 100, 1.0, 0.0), (1, 101, 1.0, 1.0), (2, 102, 0.0, 1.0)], schema)
    out = {r.proposal_id: r for r in agents.enqueue(old, new).collect()}
    assert [out[i].refused for i in (0, 100, 101, 102)] == [False, False, True, False]
    assert (out[100].priority, out[102].priority) == (0.6, 0.4)
    q = agents.rebalance(spark.createDataFrame([("d", i, float(-i)) for i in range(5)], "domain string, proposal_id long, priority double"), 2)
    assert [r.agent for r in q.orderBy("proposal_id").collect()] == [0, 1, 0, 1, 0]


def test_transfer_and_decisions(spark):
    p = spark.createDataFrame([(1, "x"), (2, "x"), (1, "y")], "agent_id long, pattern string")
    a = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.75), (2, 4, 0.1)], "a long, b long, affinity double")
    assert sorted(map(tuple, agents.transfer(p, a).collect())) == [(1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, "x"), (3, "y")]
    d = spark.createDataFrame([(1, "normal", "repair"), (2, "evolve", "repair"), (3, "evolve", "normal")], "cycle long, alpha string, beta string")
    assert [(r.action, r.conflict) for r in agents.merge_decisions(d).orderBy("cycle").collect()] == [("repair", False), ("evolve", True), ("evolve", False)]
    f = spark.createDataFrame([("b", 0.4, 0.01), ("a", 0.6, 0.9), ("c", 0.2, 0.0)], "organ string, utility double, safety double")
    r = agents.federate(f).first()
    assert (round(r.utility, 9), r.safety, r.vetoed_by) == (0.4, 0.0, "b")

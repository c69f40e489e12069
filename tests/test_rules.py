import pytest
from pyspark.sql import functions as F

from tessera.operators import rules


def frame(spark):
    return spark.createDataFrame([(1, {"latency": 120.0, "errors": 0.0}), (20, {"latency": 50.0}), (3, {})], "cycle int, metrics map<string,double>")


@pytest.mark.parametrize(
    "text,want",
    [
        ("latency > 100", [True, False, False]),
        ("latency > 40 AND NOT errors == 0", [False, False, False]),
        ("latency < 60 OR errors >= 1 AND latency > 100", [False, True, True]),
        ("(latency < 60 OR errors >= 1) AND AFTER 10 CYCLES", [False, True, False]),
        ("errors > -1", [True, True, True]),
        ("latency != 50", [True, False, True]),
    ],
)
def test_conditions(spark, text, want):
    out = rules.apply_rules(frame(spark), [rules.Rule("r", text)], cycle="cycle").collect()
    assert [bool(r.fired) for r in sorted(out, key=lambda r: [1, 20, 3].index(r.cycle))] == want


@pytest.mark.parametrize("text", ["", "latency", "latency >", "latency > 1 AND", "(latency > 1", "latency > 1 )", "5 > 3", "latency ~ 3"])
def test_bad_conditions(text):
    with pytest.raises(ValueError):
        rules.condition(text, F.lit)


def test_actions_run_in_order(spark):
    todo = [rules.Rule("a", "latency > 100", ["MUL latency 0.5", "INC errors 2", "SET mode = 3"], speedup=2.0), rules.Rule("b", "latency >= 50", ["DEC latency 10", "TOGGLE flag", "DIV errors 0"])]
    out = rules.apply_rules(frame(spark), todo)
    rows = {r.cycle: r for r in out.collect()}
    assert rows[1].fired == ["a", "b"] and rows[1].metrics == {"latency": 50.0, "errors": 2.0, "mode": 3.0, "flag": 1.0}
    assert rows[20].fired == ["b"] and rows[20].metrics["latency"] == 40 and rows[3].fired == []
    assert {r.name: r.n_fired for r in rules.rule_summary(out, todo).collect()} == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        rules.act(F.col("metrics"), "JUMP x")


def test_remedies(spark):
    df = spark.createDataFrame([("memory_usage", 1.6, "Error"), ("cache_hit_rate", 0.5, "Critical"), ("odd", 9.0, "Info")], "metric string, ratio double, severity string")
    df = df.withColumn("c", rules.root_cause(F.col("metric"), F.col("ratio"))).select("metric", "severity", "c.*")
    out = rules.remediations(df).collect()
    assert {(r.metric, r.action, r.success) for r in out} == {("memory_usage", "FreeLeakedMemory", True), ("memory_usage", "CompactHeap", False), ("cache_hit_rate", "InvalidateCache", False), ("cache_hit_rate", "PrefetchData", False), ("odd", None, False)}
    assert {r.confidence for r in out} == {0.8, 0.7, 0.3}


def test_stages(spark):
    p = {r.stage: r for r in rules.permissions(spark).collect()}
    assert p["zygote"].hold_genome and not p["zygote"].activate and p["adult"].self_mod_research and not p["adolescent"].self_mod_research and len(p) == 8
    a = spark.createDataFrame([("zygote", 8, 4), ("zygote", 8, 5), ("adult", 9, 0)], "stage string, beats int, dropped int")
    out = rules.graduates(a, {"zygote": rules.zygote_gate(F.col("beats"), F.col("beats"), F.lit(1), F.col("dropped")), "adult": F.lit(True)})
    assert sorted(r.next_stage for r in out.collect()) == ["adult", "neonate", "zygote"]


def test_strategies(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 6.0)], "x double, y double")
    s = rules.Strategies()
    plan = df.select(s("double", F.col("x")).alias("v"))
    assert s.score(df, "double", "x", "y") == -5.0
    assert s.splice("double", lambda x: x * 2) == 0 and s.splice("double", lambda x: x * 2) == 1
    assert s.score(df, "double", "x", "y") == 0.0 and [r.v for r in plan.collect()] == [1.0, 3.0]
    assert not s.splice_if_fitter("double", lambda x: x * 0, df, "x", "y")
    assert s.splice_if_fitter("other", lambda x: x * 2, df, "x", "y")

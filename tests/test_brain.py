import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import brain, folds, graph, policies

MOTIFS = "chr string, block_id long, mean_r_squared double, " + ", ".join(f"f{i} double" for i in range(8))


def motif(spark, rows):
    return spark.createDataFrame([(c, b, r, *map(float, f)) for c, b, r, f in rows], MOTIFS)


def test_motifs_by_chromosome_and_by_strength(spark):
    e = np.eye(8)
    m = motif(spark, [("1", 0, 0.6, e[0]), ("1", 1, 0.9, e[1]), ("2", 0, 0.7, e[0] + e[1])])
    best = lambda q, c=None: [(r.chr, r.block_id) for r in brain.best_motifs(m, list(q), 5, c).orderBy("place").collect()]
    assert best(e[0]) == [("1", 0), ("2", 0), ("1", 1)]
    assert best(e[0], "2") == [("2", 0)]
    assert best(e[0], "9") == best(e[0])  # no motif of chromosome 9: all
    assert best(e[7]) == [("1", 1), ("2", 0), ("1", 0)]  # a poor cosine: by mean r^2
    assert brain.best_motifs(m.limit(0), list(e[0]), 5).count() == 0


def test_working_set(spark):
    e = np.eye(8)
    neurons = spark.createDataFrame([(c, i) for c in "12" for i in range(6)], "chr string, id long")
    synapses = spark.createDataFrame([("1", 4, 5, 0.9), ("1", 0, 4, 0.8), ("2", 1, 2, 0.5)], "chr string, src long, dst long, weight double")
    m = motif(spark, [("1", 0, 0.9, e[0]), ("2", 0, 0.9, e[0] + 0.5 * e[1])])
    hit, found = brain.working_set(m, synapses, neurons, list(e[0]), 4)
    assert [(r.chr, r.id) for r in found.orderBy("place").collect()] == [("1", 4), ("1", 5), ("1", 0), ("1", 1)]
    assert [r.chr for r in hit.collect()] == ["1"]
    hit, found = brain.working_set(m, synapses, neurons, list(e[0]), 8)
    assert [(r.chr, r.id) for r in found.orderBy("place").collect()][6:] == [("2", 1), ("2", 2)] and hit.count() == 2
    hit, found = brain.working_set(m.limit(0), synapses, neurons, list(e[0]), 3)
    assert hit.count() == 0 and {r.chr for r in found.collect()} == {"1"}


def test_memory_against_a_loop(spark):
    rows = [(1, 2, 0.9), (1, 5, 0.6), (1, 9, 0.7), (3, 4, 0.8)]
    got = {r.id: r.memory for r in brain.memory(spark.createDataFrame(rows, "snp1_idx long, snp2_idx long, r_squared double")).collect()}
    want = {}
    for i, _, r in rows:
        want[i] = (want.get(i, 0.0) + r) / 2
    assert got == pytest.approx(want)


def test_recall_and_spread(spark):
    s = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.4), (4, 1, 0.6)], "src long, dst long, weight double")
    asked = spark.createDataFrame([(1,), (1,)], "id long")
    assert [(r.other, r.place) for r in brain.recall(s, asked).orderBy("place").collect()] == [(2, 1), (4, 2)]
    out = {r.id: r.activation for r in brain.spread(s, spark.createDataFrame([(1, 2.0)], "id long, strength double")).collect()}
    assert out == pytest.approx({1: 2.0, 2: 0.18, 3: 0.08, 4: 0.12})


def test_ranks_of_ties_and_hot_groups(spark):
    df = spark.createDataFrame([("a", i % 3, i) for i in range(500)] + [("b", 0, 1000)], "k string, w int, id long").repartition(7)
    rows = graph.ranked(df, "k", ["w", "id"], "place", "n").collect()
    assert [r.id for r in sorted((r for r in rows if r.k == "a"), key=lambda r: r.place)] == sorted(range(500), key=lambda i: (i % 3, i))
    assert {r.n for r in rows} == {500, 1} and {r.place for r in rows if r.k == "a"} == set(range(1, 501))


def test_last_rows_and_turns(spark):
    df = spark.createDataFrame([("a" if i % 5 else "b", i) for i in range(300)], "k string, t long").repartition(4)
    assert {r.t for r in folds.last_rows(df, "k", ["t"], 3).collect()} == {299, 298, 297, 295, 290, 285}
    out = folds.round_robin(df, "k", ["t"], 3).orderBy("place").collect()
    assert [(r.k, r.t) for r in out] == [("a", 1), ("b", 0), ("a", 2)]


def test_policies(spark):
    agents = spark.createDataFrame([(1, 0, 1.0, [1.0, 0.0]), (2, 0, 3.0, [0.0, 1.0]), (3, 1, 1.0, [1.0, 1.0])], "agent long, cluster int, weight double, behaviour array<double>")
    rules = spark.createDataFrame([(0, 0, 1.0, [1.0, 0.0]), (1, 1, 2.0, [1.0, 0.0]), (2, 2, 1.0, [0.5, 0.5])], "policy int, scope int, priority double, target array<double>")
    al = policies.alignment(agents, rules).cache()
    assert {r.policy: r.coherence for r in policies.coherence(al).collect()} == pytest.approx({0: 0.4, 1: 0.4, 2: 0.2})
    assert {r.policy: r.conflict for r in policies.conflicts(al).collect()} == pytest.approx({0: 0.0, 1: 1.0, 2: float(np.std([0.5, 0.5, 1.0], ddof=1))})
    prior = spark.createDataFrame([(0, 1, 1), (9, 4, 4)], "policy int, alpha long, beta long")
    assert {r.policy: (r.alpha, r.beta) for r in policies.beliefs(al, prior).collect()} == {0: (3, 2), 9: (4, 4)}


def test_summary_of_nothing(spark):
    none = spark.createDataFrame([], "cause string, success boolean")
    r = policies.health_summary(none).first()
    assert (r.total, r.successful, r.success_rate, r.commonest) == (0, 0, 1.0, None)


def test_directives_and_what_is_exported(spark):
    t = spark.createDataFrame([(0.5, 0.9, 0.1, False), (0.1, 0.9, 0.1, True), (0.1, 0.1, 0.1, False), (0.1, 0.1, 0.0, False)], "d double, l double, t double, s boolean")
    found = policies.directives(F.col("d"), F.col("l"), F.col("t"), F.col("s"))
    consensus, aggressive = policies.sync_policy(found)
    got = [tuple(round(x, 6) for x in r) for r in t.select(F.size(found), consensus, aggressive, policies.strategy_policy(found)).collect()]
    assert got == [(3, 0.85, 1.5, 0.2), (1, 0.8, 0.8, 0.1), (1, 0.8, 0.8, 0.45), (0, 0.8, 0.8, 0.3)]


def test_signatures_and_texts(spark):
    e = np.eye(8)
    m = motif(spark, [("1", 0, 0.6, e[0] + e[3]), ("1", 1, 0.9, e[1]), ("2", 0, 0.7, e[0])])
    ask = lambda v: [(r.chr, r.block_id) for r in brain.activate_signatures(spark.createDataFrame([(1, [float(x) for x in v])], "question int, signature array<double>"), m, 5).orderBy("place").collect()]
    assert ask(e[0]) == [("2", 0), ("1", 0), ("1", 1)]
    assert ask(e[0] + e[3] / 22) == [("1", 0), ("1", 1)]  # names chromosome 1
    assert len(ask(e[0] + 9 * e[3] / 22)) == 3  # names chromosome 9, which has none
    assert ask(e[7]) == [("1", 1), ("2", 0), ("1", 0)]  # poor: by mean r^2
    texts = spark.createDataFrame([(1, "ld of snp on chr1"), (2, ""), (3, "fn main() { let x = 1; }")], "question int, text string")
    out = brain.activate_texts(texts, m, 2).collect()
    assert {r.question for r in out} == {1, 2, 3} and all(r.place <= 2 for r in out)

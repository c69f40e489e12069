import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import classifier, documents, folds, graph, linkage, synthesis


def table(spark, g, positions=None):
    return spark.createDataFrame([("1", i, (positions or range(1000, 10**9, 1000))[i], row) for i, row in enumerate(g.tolist())], "chr string, snp_idx long, position long, g array<int>").repartition(3)


def r2_by_hand(x, y, least):
    ok = (x != 3) & (y != 3)
    x, y = x[ok].astype(float), y[ok].astype(float)
    if len(x) < least or x.std() == 0 or y.std() == 0:
        return None
    return np.corrcoef(x, y)[0, 1] ** 2


@pytest.mark.parametrize("samples,window", [(31, 7), (33, 5), (65, 40)])
def test_pairs_against_numpy(spark, samples, window):
    rng = np.random.default_rng(samples)
    g = np.repeat(rng.integers(0, 3, (8, samples)), 4, axis=0)
    g = np.where(rng.random(g.shape) < 0.1, rng.integers(0, 4, g.shape), g)
    g[5] = 1
    got = {(r.snp1_idx, r.snp2_idx): r.r_squared for r in linkage.pairs(table(spark, g), window, threshold=None).collect()}
    want = {(i, j): r2_by_hand(g[i], g[j], 10) for i in range(32) for j in range(i + 1, min(32, i + window))}
    want = {k: v for k, v in want.items() if v is not None}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    strict = {(r.snp1_idx, r.snp2_idx) for r in linkage.pairs(table(spark, g), window).collect()}
    assert strict == {k for k, v in want.items() if np.float32(v) > np.float32(0.5)}


def test_pairs_odd_tables(spark):
    assert linkage.pairs(table(spark, np.zeros((0, 4), int)), 5).count() == 0
    assert linkage.pairs(table(spark, np.full((3, 20), 3)), 5).count() == 0
    few = np.array([[0, 2] * 4, [0, 2] * 4])
    assert linkage.pairs(table(spark, few), 5).count() == 0
    assert linkage.pairs(table(spark, few), 5, min_valid=2).first().r_squared == 1


def test_dense_matrix(spark):
    rng = np.random.default_rng(4)
    g = rng.integers(0, 3, (12, 40))
    g[1], g[2] = g[0], 1
    got = {(r.snp1_idx, r.snp2_idx): r.r for r in linkage.dense(table(spark, g), block=5).collect()}
    assert len(got) == 12 * 13 // 2 and all(got[i, i] == 1 for i in range(12))
    for i in range(12):
        for j in range(i + 1, 12):
            want = 0 if 2 in (i, j) else np.corrcoef(g[i], g[j])[0, 1]
            assert abs(got[i, j] - want) < 1e-9


def test_loci_and_scores(spark):
    g = np.array([[0, 1, 2, 3], [3, 3, 3, 3], [2, 2, 2, 2]])
    rows = {r.snp_idx: r for r in linkage.loci(table(spark, g)).collect()}
    assert (rows[0].alt_freq, rows[0].missing_rate, rows[1].alt_freq, rows[2].std) == (0.5, 0.25, None, 1.0)
    w = spark.createDataFrame([(0, 10), (1, 5), (2, 1)], "snp_idx long, weight long")
    assert {r.sample_idx: r.score for r in linkage.scores(table(spark, g), w).collect()} == {0: 2, 1: 12, 2: 22, 3: 2}
    assert linkage.ordered(table(spark, g, [5, 3, 9])).select("snp_idx").collect()[0][0] == 1
    found = linkage.clusters(table(spark, g), spark.createDataFrame([(0, 2), (0, 1)], "snp1_idx long, snp2_idx long"))
    assert {r.snp_idx: r.partners for r in found.collect()} == {0: [1, 2], 1: [], 2: []}


@pytest.mark.parametrize("together", [1 << 20, 40])
def test_components_against_union_find(spark, monkeypatch, together):
    monkeypatch.setattr(graph, "TOGETHER", together)
    rng = random.Random(3)
    n = 300
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(220)] + [(i, i + 1) for i in range(200, 260)] + [(7, k) for k in range(100, 160)]
    of = list(range(n))

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        of[max(x, y)] = min(x, y)
    nodes = spark.range(n)
    got = {r.id: r.component for r in graph.components(nodes, spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: top(i) for i in range(n)}
    assert {r.id: r.component for r in graph.components(spark.range(3), spark.createDataFrame([], "src long, dst long")).collect()} == {0: 0, 1: 1, 2: 2}


def test_blocks(spark):
    g = table(spark, np.zeros((5, 2), int))
    pairs = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.85)], "snp1_idx long, snp2_idx long, r_squared double")
    rows = graph.haplotype_blocks(g, pairs).orderBy("block_id").collect()
    assert [(r.block_id, r.first_snp, r.n_snps) for r in rows] == [(0, 0, 3), (1, 3, 1), (2, 4, 1)]
    assert abs(rows[0].mean_r_squared - 0.875) < 1e-12 and rows[1].mean_r_squared is None
    s = graph.block_statistics(graph.haplotype_blocks(g, pairs)).first()
    assert (s.n_blocks, s.median_size, s.max_size) == (3, 1, 3)


def test_numbers_over_ranges(spark):
    df = spark.createDataFrame([(k,) for k in (5, 1, 900, 70, 71)], "k long")
    assert [r.n for r in graph.numbered(df, "k", "n", width=64).orderBy("k").collect()] == [0, 1, 2, 3, 4]


def test_reach_and_order(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 1)], "src long, dst long")
    got = {(r.id, r.depth) for r in graph.reach(edges, spark.createDataFrame([(1,)], "id long"), 2).collect()}
    assert got == {(1, 0), (2, 1), (9, 1), (3, 2)}
    nodes = spark.createDataFrame([(0, 3), (0, 1), (0, 2), (1, 5), (1, 6)], "graph_id long, id long")
    links = spark.createDataFrame([(0, 3, 1), (1, 5, 6), (1, 6, 5)], "graph_id long, src long, dst long")
    rows = {(r.graph_id, r.id): r.place for r in graph.topological_order(nodes, links).collect()}
    assert rows == {(0, 2): 0, (0, 3): 1, (0, 1): 2, (1, 5): None, (1, 6): None}
    assert graph.fingerprint(graph.topological_order(nodes, links).filter("graph_id = 0")).count() == 1
    d = {r.id: (r.out_degree, r.in_degree) for r in graph.degrees(edges).collect()}
    assert d[1] == (1, 1) and d[4] == (0, 1)


def test_paths(spark):
    nodes, edges = graph.paths(spark.createDataFrame([("a/b/c.rs",), ("a/b/d.md",), ("x",)], "path string"))
    assert {r.prefix for r in nodes.collect()} == {"a", "a/b", "a/b/c.rs", "a/b/d.md", "x"}
    assert {(r.src, r.dst) for r in edges.collect()} == {("a", "a/b"), ("a/b", "a/b/c.rs"), ("a/b", "a/b/d.md")}


def test_drop_weakest(spark):
    df = spark.createDataFrame([("1", i, float(i)) for i in range(10)] + [("2", i, float(i)) for i in range(3)], "chr string, id long, weight double")
    left = graph.drop_weakest(df, 0.9).groupBy("chr").count().collect()
    assert {r.chr: r["count"] for r in left} == {"1": 5, "2": 3}


# --------------------------------------------------------------------------- folds


def test_folds_against_loops(spark):
    rng = random.Random(5)
    rows = [(k, 3 * t, rng.choice("AAB"), rng.random(), rng.random() * 0.3, rng.random()) for k in range(3) for t in range(60)]
    df = spark.createDataFrame(rows, "k long, tick long, label string, utility double, drop_rate double, quarantine double").repartition(4)
    held = {(r.k, r.tick): r.held for r in folds.hysteresis(df, "k", ["tick"], "label", 3, "A").collect()}
    level = {(r.k, r.tick): r.e for r in folds.ema(df, "k", ["tick"], {"e": "utility"}, 0.2).collect()}
    allowed = {(r.k, r.tick): r.allowed for r in folds.rate_limit(df.select("k", "tick"), "k", "tick", 10, 2).collect()}
    h = {(r.k, r.tick): r for r in folds.hormones(df, "k", ["tick"]).collect()}
    clip = lambda x: min(1.0, max(0.0, x))
    for k in range(3):
        now, left, e, last, used = "A", 0, 0.5, 0, 0
        ema, c, a, d, s, ach, g, o = 0.5, 0.1, 0.0, 0.5, 0.7, 0.3, 0.5, 0.8
        for n, (_, t, label, u, drop, q) in enumerate(r for r in rows if r[0] == k):
            if label == now:
                left += 1
            elif left:
                left -= 1
            else:
                now, left = label, 3
            e += 0.2 * (u - e)
            ok = t - last >= 10 or used < 2
            if ok:
                used = 1 if t - last >= 10 else used + 1
                last = t
            assert held[k, t] == now and abs(level[k, t] - e) < 1e-12 and allowed[k, t] == ok
            ema = 0.15 * u + 0.85 * ema
            growth = 0.2 * np.exp(-(n + 1) / 500_000) + 0.8 * max(ema, 0.3)
            c = 0.4 * q + 0.6 * c * 0.92
            a = min(drop, 1.0) if drop > 0.1 else a * 0.4
            d = 0.7 * clip(0.8 * ema - 0.3 * drop) + 0.3 * d
            s = 0.4 * clip(0.6 * ema + 0.4 * (1 - q)) + 0.6 * s
            ach = clip(0.6 * (drop + q) + 0.4 * ach * 0.9)
            g = clip(0.4 * (0.5 + clip(0.4 * c + 0.4 * a + 0.2 * (1 - s)) * (1 - ema)) + 0.6 * g)
            o = 0.7 * (0.9 if ema > 0.7 else 0.4 if ema < 0.3 else o) + 0.3 * 0.6
            got = h[k, t]
            want = (growth, c, a, d, s, ach, g, o)
            assert all(abs(x - y) < 1e-9 for x, y in zip((got.growth, got.cortisol, got.adrenaline, got.dopamine, got.serotonin, got.acetylcholine, got.gaba, got.oxytocin), want))


def test_moods(spark):
    h = dict.fromkeys(folds.HORMONES, 0.5)
    df = spark.createDataFrame([(1, t, 0.8, "Thriving", *h.values()) for t in range(3)], "k long, tick long, utility double, regime string, " + ", ".join(f"{x} double" for x in h))
    r = folds.moods(df, "k", ["tick"]).orderBy("tick").collect()
    v = 0.6
    for t in range(3):
        v = 0.15 * (0.2 + 0.2 + 0.16 - 0.15) + 0.85 * v
        assert abs(r[t].valence - v) < 1e-12
    assert abs(r[0].confidence - (0.15 * 0.9 + 0.85 * 0.7)) < 1e-12


def test_chain_finds_tampering(spark):
    df = spark.createDataFrame([(1, t, f"row {t}") for t in range(6)], "log long, tick long, content string")
    stored = folds.chain(df, "log", "tick", "content").join(df, ["log", "tick"])
    assert folds.verify_chain(stored, "log", "tick", "content").count() == 0
    bad = stored.withColumn("content", F.when(F.col("tick") == 3, "forged").otherwise(F.col("content")))
    assert [r.tick for r in folds.verify_chain(bad, "log", "tick", "content").collect()] == [3]


def test_streaks_and_transitions(spark):
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate("aabbba")], "k long, t long, v string")
    assert [r.streak for r in folds.streaks(df, "k", ["t"], F.col("v") == "b").orderBy("t").collect()] == [0, 0, 1, 2, 3, 0]
    assert [(r.t, r.prev_v) for r in folds.transitions(df, "k", ["t"], "v").orderBy("t").collect()] == [(0, None), (2, "a"), (5, "b")]


def test_pattern_learning(spark):
    df = spark.createDataFrame([("p", 0, False, 0.0), ("p", 1, True, 0.4), ("p", 2, True, 0.8), ("p", 3, False, 0.0), ("q", 0, False, 0.1)], "k string, t long, ok boolean, gain double")
    rows = folds.pattern_learning(df, "k", "t", "ok", "gain").collect()
    assert [(r.k, r.successes, r.failures, round(r.mean_gain, 9), round(r.confidence, 9)) for r in rows] == [("p", 2, 1, 0.6, 0.5)]


# --------------------------------------------------------------------------- documents and classifier

DOC = "# Top\nintro\n  ## Part #2 \n- item\n1. first\n```rs\nfn main() {}\n  let x = 1;\n```\r\ntail\n# Next\n+ end\n```\nnever closed"


def test_markdown_graph(spark):
    df = spark.createDataFrame([(1, DOC), (2, None), (3, "")], "doc_id long, text string")
    rows = [r for r in documents.parse_markdown(df).orderBy("doc_id", "node_id").collect() if r.doc_id == 1]
    assert [(r.node_id, r.parent_id, r.kind, r.label) for r in rows] == [
        (0, None, "Content", ""),
        (1, 0, "Content", "Top"),
        (2, 1, "Content", "intro"),
        (3, 1, "Content", "Part #2"),
        (4, 3, "Content", "item"),
        (5, 3, "Content", "first"),
        (6, 3, "Execution", "fn main() {}\n  let x = 1;"),
        (7, 3, "Content", "tail"),
        (8, 0, "Content", "Next"),
        (9, 8, "Content", "+ end"),
    ]
    assert documents.parse_markdown(df).filter("doc_id > 1").count() == 2


def test_chunks(spark):
    df = spark.createDataFrame([(1, "a" * 700 + "\n\n" + "b" * 600 + "\n\nc"), (2, "x" * 3000), (3, None), (4, "p\n\nq"), (5, "a" * 600 + "\n\n" + "b" * 600 + "\n\n\n\nend\n\n"), (6, "\n\n  ")], "doc_id long, text string")
    rows = [(r.doc_id, r.chunk, len(r.text)) for r in documents.chunks(df).orderBy("doc_id", "chunk").collect()]
    assert rows == [(1, 0, 700), (1, 1, 603), (2, 0, 3000), (4, 0, 4), (5, 0, 1202), (5, 1, 5)]


def test_features_and_signature(spark):
    df = spark.createDataFrame([("fn main() { x; y; }\n  z",), ("",), ("rare haplotype block on chr7",)], "t string")
    rows = df.select("t", documents.features(F.col("t")).alias("f")).select("f", documents.signature(F.col("f"), F.col("t")).alias("s")).collect()
    assert all(len(r.f) == 64 and set(r.f) <= {-1, 0, 1} for r in rows)
    assert rows[0].f[62] == 1 and rows[1].f[62] == -1 and rows[1].f[63] == -1 and rows[0].f[63] == 1
    assert rows[2].s[3] > 0
    assert all(not any(r.s) or abs(sum(x * x for x in r.s) - 1) < 1e-9 for r in rows) and any(rows[2].s)


def test_perceptron_and_threshold(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-1, 2, (400, 64))
    y = (rng.random(400) < 0.3).astype(int)
    x[y == 1, :12] = np.where(rng.random((y.sum(), 12)) < 0.9, 1, -1)
    x[y == 0, :12] = np.where(rng.random((400 - y.sum(), 12)) < 0.9, -1, 1)
    w = classifier.train(x, y)
    assert set(w.tolist()) <= {-1, 0, 1} and list(w[[62, 63]]) == [1, 1]
    df = spark.createDataFrame([(i, int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y))], "k long, y int, x array<int>")
    scored = df.withColumn("s", classifier.score(w.tolist(), F.col("x")))
    assert [r.s for r in scored.orderBy("k").collect()] == (x @ w).tolist()
    best = classifier.sweep(scored, "y", "s").orderBy(F.desc("balanced_accuracy")).first()
    m = classifier.confusion(scored.withColumn("p", (F.col("s") >= best.threshold).cast("int")), "y", "p").first()
    assert m.tp == best.tp and m.fp == best.fp and abs(m.balanced_accuracy - best.balanced_accuracy) < 1e-12 and m.balanced_accuracy > 0.7
    parts = classifier.stratified(df, "y", "k").groupBy("y", "train").count().collect()
    assert sum(r["count"] for r in parts) == 400 and len(parts) == 4


def test_confusion_of_one_class(spark):
    m = classifier.confusion(spark.createDataFrame([(0, 0), (0, 1)], "y int, p int"), "y", "p").first()
    assert (m.balanced_accuracy, m.recall, m.precision, m.f1) == (0.5, 0, 0, 0)


def test_model_file():
    text = classifier.to_wire([1, 0, -1], 5, notes={"a": "b=c"})
    assert classifier.from_wire(text) == ([1, 0, -1], 5, 1, {"a": "b=c"})
    with pytest.raises(ValueError):
        classifier.from_wire("nothing")


# --------------------------------------------------------------------------- synthesis


def test_synthesis_keeps_linkage(spark):
    rng = np.random.default_rng(1)
    hap = rng.integers(0, 2, 60)
    rows = [(i, hap[:30].tolist(), hap[30:].tolist()) for i in range(2)] + [(2, [3] + [0] * 29, [1] * 30)]
    phased = spark.createDataFrame([(i, a, b) for i, a, b in rows], "snp_idx long, hap_a array<int>, hap_b array<int>")
    members = spark.createDataFrame([(0, 0), (1, 0)], "snp_idx long, block_id long")
    pool = synthesis.pools(phased, members)
    assert len(pool.first().fragments) == 60
    freq = spark.createDataFrame([(0, 0.5), (1, 0.5), (2, 0.9)], "snp_idx long, alt_freq double")
    out = synthesis.synthesize(pool, freq, 200)
    g = {s: [r.g for r in out.filter(F.col("snp_idx") == s).orderBy("genome_id").collect()] for s in (0, 1, 2)}
    assert g[0] == g[1] and len(set(g[0])) == 3 and np.mean(g[2]) > 1.5
    assert out.exceptAll(synthesis.synthesize(pool, freq, 200)).count() == 0
    scored = synthesis.fitness(out, 0.7)
    assert scored.count() == 200
    after = synthesis.next_generation(scored, spark.range(1000, 2000).withColumnRenamed("id", "genome_id"))
    assert after.count() == 200 and after.filter("fitness = 0").count() == 150
    assert synthesis.generation_summary(scored).first().n == 200


def test_selection_loop(spark):
    edges = spark.createDataFrame([("1", i, i / 20) for i in range(20)], "chr string, id long, weight double")
    measure = lambda t: {"task": t.agg(F.avg("weight")).first()[0], "bio": 0.5, "safety": 1.0, "cost": t.count() / 20}
    train = lambda t: t.withColumn("weight", F.least(F.lit(1.0), F.col("weight") * 1.1))
    out, ledger = synthesis.selection_loop(edges, 4, measure, train, lambda t: graph.drop_weakest(t, 0.2))
    assert out.count() < 20 and [r["kind"] for r in ledger] == ["train", "prune", "train", "prune"] and all(r["accepted"] for r in ledger)
    assert synthesis.select_step({"task": 1, "bio": 1, "safety": 1, "cost": 0}, {"task": 1, "bio": 1, "safety": 0.9, "cost": 0}) == (False, "safety")


def test_folds_go_on_from_batch_to_batch(spark):
    """A group of more rows than an Arrow batch takes gives what one batch gives."""
    rng = random.Random(9)
    rows = [(k, t, rng.choice("AAB"), rng.random(), rng.random() * 0.3, rng.random(), rng.random() > 0.5) for k in range(2) for t in range(150)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, tick long, label string, utility double, drop_rate double, quarantine double, ok boolean").repartition(3)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, out = spark.conf.get(size), []
    for n in ("1000", "7"):
        spark.conf.set(size, n)
        parts = [folds.hysteresis(df, "k", ["tick"], "label", 3, "A"), folds.ema(df, "k", ["tick"], {"e": "utility"}), folds.rate_limit(df.select("k", "tick"), "k", "tick", 10, 2), folds.hormones(df, "k", ["tick"]), folds.chain(df, "k", "tick", "label"), folds.pattern_learning(df, "k", "tick", "ok", "utility")]
        out.append([sorted(map(tuple, p.collect())) for p in parts])
    spark.conf.set(size, before)
    assert out[0] == out[1] and [len(x) for x in out[0]] == [300] * 5 + [2]


def test_folds_are_sorted_once(spark):
    df = spark.createDataFrame([(1, 2, "A")], "k long, tick long, label string")
    plan = folds.hysteresis(df, "k", ["tick"], "label")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_draws_against_python_integers():
    mask = 2**64 - 1
    for seed, g, s, k in ((42, 0, 0, 0), (42, 7, 2**32 - 1, 3), (2**63 + 5, 1, 12345, 9)):
        x = seed ^ (g * 0x9E3779B97F4A7C15 & mask) ^ (s * 0xC2B2AE3D27D4EB4F & mask) ^ (k * 0x165667B19E3779F9 & mask)
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        x ^= x >> 31
        assert float(synthesis.unit(seed, g, s, k)) == (x >> 40) / 2**24


def test_generations_grow_fitter(spark):
    def genomes(ids):
        return ids.select("genome_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("snp_idx")).withColumn("g", F.pmod(F.xxhash64("genome_id", "snp_idx"), F.lit(3)).cast("int"))

    first = genomes(spark.range(100, 120).withColumnRenamed("id", "genome_id"))
    before = synthesis.generation_summary(synthesis.fitness(first)).first()
    after = synthesis.run_generations(first, 4, genomes)
    got = synthesis.generation_summary(after).first()
    assert got.n == 20 and got.max >= before.max and after.select("genome_id").distinct().count() == 20
    assert synthesis.run_generations(first, 0, genomes).count() == 20


def test_contraction_of_many_batches():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    edges = rng.integers(0, 200_000, (150_000, 2))
    edges = edges[edges[:, 0] != edges[:, 1]]
    u, v = graph.forest(edges[:, 0], edges[:, 1])
    batches = [pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["u", "v"]) for part in np.array_split(edges, 40)]
    out = list(graph.contracted(iter(batches)))
    assert len(out) == 1
    got = dict(zip(out[0].column(0).to_pylist(), out[0].column(1).to_pylist()))
    assert got == dict(zip(u.tolist(), v.tolist())) and len(got) == len(u)
    assert [b.num_rows for b in graph.contracted(iter([]))] == [0]

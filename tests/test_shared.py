"""Variants of which many have the same calls."""

import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import linkage, planes
from tessera.plans import domain
from tessera.scratch import Rounds

SF = "/root/testdata/sf0.001"


def test_planes_of_a_genotype_table():
    i, k = np.array([0, 1, 9, 10, 66930, 123456]), np.arange(3, 133)
    for got, want in zip(domain.genotype_planes(i, domain.patterns(k)), planes.pack(domain.genotype_codes(i, k))):
        assert (got == want).all()


def test_variants_name_the_first_that_is_alike(spark, monkeypatch):
    monkeypatch.setattr(domain, "SHARE", 1)
    monkeypatch.setattr(domain, "LARGE", 0)
    for held in ("_tessera_kept", "_tessera_shared"):
        monkeypatch.setattr(spark.sparkContext, held, {}, raising=False)
    assert domain.genotypes(spark, SF).count() == domain.variants(spark, SF).count() and domain.shared(spark, SF)
    k = domain.header(spark, SF)
    rows = domain.variants(spark, SF).orderBy("snp_idx").toPandas()
    codes = domain.genotype_codes(rows["snp_idx"].to_numpy(), k)
    first = {}
    assert [first.setdefault(c.tobytes(), i) for i, c in zip(rows["snp_idx"], codes)] == rows["alike"].tolist()
    for name, code in zip(planes.COUNTS, range(4)):
        assert (rows[name] == (codes == code).sum(axis=1)).all()
    assert sorted(r.snp_idx for r in domain.calls(spark, SF).collect()) == sorted(set(first.values())) and len(first) < len(rows)


def test_scores_of_many_samples_take_little_memory():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 4, (1500, 130)).astype(np.uint8)
    weight = rng.integers(1, 50, 1500).astype(np.float64)
    assert (linkage.weighted(*planes.pack(codes), weight)[:130] == weight @ np.where(codes == 3, 0, codes)).all()
    lo, hi = (np.zeros((2000, 1000), np.int64) for _ in range(2))  # 64,000 samples: 32 MB, which are 1.3 GB as numbers
    tracemalloc.start()
    linkage.weighted(lo, hi, np.ones(2000))
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def repeated(spark, rng, samples):
    """(packed table, variants, calls) of two chromosomes with gaps, whose variants are drawn from a few."""
    few = rng.integers(0, 3, (14, samples))
    few = np.where(rng.random(few.shape) < 0.1, 3, few)
    few[3], few[4] = 1, 3
    rows, first = [], {}
    for chromosome in "12":
        for i in np.flatnonzero(rng.random(150) < 0.8).tolist():
            kind = int(rng.integers(len(few)))
            rows.append((chromosome, i, 10 * i, few[kind].tolist(), first.setdefault((chromosome, kind), i)))
    t = spark.createDataFrame(rows, "chr string, snp_idx long, position long, g array<int>, alike long")
    packed = planes.packed(t)
    v = packed.drop("lo", "hi").join(t.select("chr", "snp_idx", "alike"), ["chr", "snp_idx"])
    return packed, v, packed.join(v.filter("snp_idx = alike").select("chr", "snp_idx"), ["chr", "snp_idx"], "left_semi")


@pytest.mark.parametrize("threshold,samples,window", [(None, 70, 7), (0.05, 130, 40)])
def test_pairs_of_shared_calls(spark, monkeypatch, threshold, samples, window):
    monkeypatch.setattr(linkage, "LIGHT", 32)
    monkeypatch.setattr(linkage, "BLOCK", 16)
    monkeypatch.setattr(linkage, "CHUNK", 1)
    packed, variants, calls = repeated(spark, np.random.default_rng(samples), samples)
    columns = ["chr", "snp1_idx", "snp2_idx", F.round("r_squared", 12), F.round("r", 12), "n", "position1", "position2"]
    got = linkage.shared_pairs(variants, calls, window, threshold=threshold).select(*columns).collect()
    want = linkage.pairs(packed, window, threshold=threshold).select(*columns).collect()
    assert len(want) > 100 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def reads_links_once(spark, monkeypatch, query):
    """Whether a query makes the linked pairs once, however often it reads them, and its rows."""
    made = []
    for name in ("pairs", "shared_pairs"):
        monkeypatch.setattr(linkage, name, lambda *a, f=getattr(linkage, name), **b: made.append(1) or f(*a, **b))
    for held in ("_tessera_kept", "_tessera_shared"):
        monkeypatch.setattr(spark.sparkContext, held, {}, raising=False)
    assert query(spark, SF).count() and len(made) == 1


def sql(query):
    con = duckdb.connect()
    for name in ("part", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con.execute(query).fetchall()


def test_haplotype_blocks_make_links_once(spark, monkeypatch):
    from tessera.plans import genetics

    reads_links_once(spark, monkeypatch, lambda *a: genetics.haplotype_blocks(*a).unionByName(genetics.haplotype_blocks(*a)))


def test_nodes_within_steps(spark):
    from tessera.operators import graph

    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 150, (80, 2))] + [(k, k + 1) for k in range(200, 230)] + [(300, 301), (301, 302), (310, 311), (320, 320)]
    starts = [(int(x),) for x in rng.integers(0, 150, 12)] + [(205,), (300,), (310,), (320,), (999,)]
    edges, starts = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(starts, "id long")
    every = graph.reach(edges, starts.distinct(), 5)
    far = every.groupBy("start").agg(F.count(F.lit(1)).alias("n")).filter("n > 3")
    want = {r.id for r in every.join(far, "start", "left_semi").select("id").distinct().collect()}
    got = [r.id for r in graph.within(edges, starts, 5, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want and 210 in want and 211 not in want and 300 not in want


def test_tally_of_shared_calls(spark, monkeypatch):
    for name, value in (("GRID", 5), ("TILE", 2), ("TOGETHER", 1)):
        monkeypatch.setattr(linkage, name, value)
    packed, variants, calls = (t.filter("chr = 1") for t in repeated(spark, np.random.default_rng(21), 70))
    copies = variants.groupBy(F.col("alike").alias("snp_idx")).agg(F.count(F.lit(1)).alias("copies"))
    want = linkage.dense(packed, block=40).groupBy(F.floor(F.round(F.abs("r"), 9) * 10).alias("tenth")).agg(F.count(F.lit(1)).alias("n"))
    got = linkage.tally(calls, copies).collect()
    assert len(got) > 3 and sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))


def scans_only(spark, name):
    """A query that reads what is written of links and blocks, and makes none of them again."""
    from tessera.plans.queries import QUERIES

    df = QUERIES[name](spark, SF)
    assert "InArrow" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count()


def blocks_once(spark, monkeypatch, name):
    """A query that is asked twice, and has its blocks made once."""
    from tessera.operators import graph
    from tessera.plans.queries import QUERIES

    made = []
    monkeypatch.setattr(graph, "haplotype_blocks", lambda *a, f=graph.haplotype_blocks: made.append(1) or f(*a))
    monkeypatch.setattr(spark.sparkContext, "_tessera_kept", {}, raising=False)
    assert QUERIES[name](spark, SF).count() == QUERIES[name](spark, SF).count() and len(made) == 1


def test_diagnoses_scans_what_is_written(spark):
    scans_only(spark, "diagnoses")


def test_code_quality_scans_what_is_written(spark):
    scans_only(spark, "code_quality")


def test_genomic_task_scans_what_is_written(spark):
    scans_only(spark, "genomic_task")


def test_motif_activation_makes_blocks_once(spark, monkeypatch):
    blocks_once(spark, monkeypatch, "motif_activation")


def test_signature_activation_makes_blocks_once(spark, monkeypatch):
    blocks_once(spark, monkeypatch, "signature_activation")


def test_working_set_scans_what_is_written(spark):
    scans_only(spark, "working_set")


def test_structure_metrics_scans_what_is_written(spark):
    scans_only(spark, "structure_metrics")


def test_patterns_are_derived_once(spark, monkeypatch, tmp_path):
    first = list(range(3, 23))
    parts = first + [i + k * 30 * 23 * 97 for i in first for k in (1, 2)]
    spark.createDataFrame([(i,) for i in parts], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k,) for k in range(5, 135)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(domain, "LARGE", 0)
    monkeypatch.setattr(domain, "SHARE", 3)
    made = []
    monkeypatch.setattr(domain, "_derived", lambda s, d, indices, *a, f=domain._derived: made.append(indices.count()) or f(s, d, indices, *a))
    rows = domain.variants(spark, str(tmp_path)).orderBy("snp_idx").toPandas()
    assert made == [20] and rows["snp_idx"].tolist() == sorted(parts) and rows["alike"].tolist() == first * 3
    codes = domain.genotype_codes(rows["snp_idx"].to_numpy(), np.arange(5, 135))
    for name, code in zip(planes.COUNTS, range(4)):
        assert (rows[name] == (codes == code).sum(axis=1)).all()


class Counted(Rounds):
    """Keeps the columns and rows of each table that is written."""

    seen: list = []

    def cut(self, df):
        out = super().cut(df)
        Counted.seen.append((out.columns, out.count()))
        return out


def test_pairs_of_a_course_that_repeats_are_found_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    few = rng.integers(0, 4, (40, 130))
    rows = [("1", i, 10 * i, few[i % 40].tolist(), i % 40) for i in range(600)]
    t = spark.createDataFrame(rows, "chr string, snp_idx long, position long, g array<int>, alike long")
    packed = planes.packed(t)
    variants = packed.drop("lo", "hi").join(t.select("chr", "snp_idx", "alike"), ["chr", "snp_idx"])
    monkeypatch.setattr(linkage, "LIGHT", 64)
    monkeypatch.setattr(linkage, "Rounds", Counted)
    monkeypatch.setattr(Counted, "seen", [])
    columns = ["snp1_idx", "snp2_idx", F.round("r", 12), "n", "position1", "position2"]
    got = linkage.shared_pairs(variants, packed.filter("snp_idx < 40"), 7, threshold=None).select(*columns).collect()
    want = linkage.pairs(packed, 7, threshold=None).select(*columns).collect()
    assert len(want) == 600 * 6 - 21 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    # Forty courses, and six that the end cuts short.
    assert max(n for c, n in Counted.seen if "other" in c) <= 46 * 6 and any("gap" in c for c, _ in Counted.seen)


def test_edges_in_any_order_leave_few(spark, monkeypatch):
    from tessera.operators import graph

    edges = [(i, i + 1 + k) for i in range(3000) if i % 30 < 20 for k in range(8)]
    edges = spark.createDataFrame(edges, "src long, dst long").repartition(16)
    monkeypatch.setattr(graph, "NEAR", 256)
    monkeypatch.setattr(graph, "Rounds", Counted)
    monkeypatch.setattr(Counted, "seen", [])
    found = dict(map(tuple, graph.stars(edges, near=True).collect()))
    assert found == {i: i // 30 * 30 for i in range(3000) if i % 30 < 28}
    assert Counted.seen[0][1] < 3100  # a star's edge a node, and few more


@pytest.mark.parametrize("far", [1, 1 << 40])
def test_forest_of_near_and_far_ids(far):
    from tessera.operators import graph

    rng = np.random.default_rng(11)
    for _ in range(20):
        u, v = (far * rng.integers(-40, 40, 30) for _ in range(2))
        least = {int(x): int(x) for x in np.concatenate([u, v])}
        for _ in range(60):
            for a, b in zip(u.tolist(), v.tolist()):
                least[a] = least[b] = min(least[a], least[b])
        ids, top = graph.forest(u, v)
        assert dict(zip(ids.tolist(), top.tolist())) == {a: b for a, b in least.items() if a != b}
    assert all(len(x) == 0 for x in graph.forest(*(np.empty(0, np.int64),) * 2))


def no_joins_of_links(spark, name):
    """Links are read without a look at the neurons of their ends; what is joined is one row."""
    from tessera.plans.queries import QUERIES

    assert QUERIES[name](spark, SF).count()
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(kind in line for line in plan.splitlines() for kind in ("Join Inner", "Join Left"))


def test_code_quality_joins_no_links(spark):
    no_joins_of_links(spark, "code_quality")


def test_diagnoses_joins_no_links(spark):
    no_joins_of_links(spark, "diagnoses")


def test_structure_metrics_reads_links_of_three_columns(spark):
    from tessera.plans import genetics

    no_joins_of_links(spark, "structure_metrics")
    assert genetics._pairs(spark, SF).columns == ["snp1_idx", "snp2_idx", "r_squared"]


def test_genomic_task_adds_weights_of_the_eight_only(spark):
    from tessera.plans.queries import QUERIES

    assert QUERIES["genomic_task"](spark, SF).count() == 1
    plan = QUERIES["genomic_task"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    sums = [k for k, line in enumerate(plan) if "Aggregate [id" in line and "sum(" in line]
    assert sums and all(any("Join Inner" in line for line in plan[k + 1 : k + 4]) for k in sums)


def test_signatures_are_scored_by_all_cores(spark):
    from tessera.plans.queries import QUERIES

    df = QUERIES["signature_activation"](spark, SF)
    assert df.count()
    dealt = f"Repartition {2 * spark.sparkContext.defaultParallelism}, true"
    assert dealt in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kinds", [3, 100000])
def test_least_of_the_heaviest(spark, kinds):
    from tessera.operators import folds

    rng = np.random.default_rng(kinds)
    rows = [("a", i, float(w)) for i, w in enumerate(rng.integers(0, kinds, 3000))] + [("b", i, float(i)) for i in range(4)] + [("a", 5000 + i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "chr string, id long, weight double")
    df = df.withColumn("a", -F.col("id"))
    few = folds.perhaps_last(df, "chr", ["weight", "a"], 8)
    last = [sorted(map(tuple, folds.last_rows(t, "chr", ["weight", "a"], 8).collect())) for t in (df, few)]
    assert few.columns == df.columns and last[0] == last[1] and len(last[0]) == 12
    # All that weigh the most tie where there are three weights.
    assert few.filter("chr = 'b'").count() == 4 and few.count() < 100


def test_working_set_sorts_few_synapses(spark):
    from tessera.plans.queries import QUERIES

    df = QUERIES["working_set"](spark, SF)
    assert df.count()
    assert "least0__#" in df._jdf.queryExecution().optimizedPlan().toString()


def test_chromosome_build_takes_links_and_blocks_that_are_written(spark, monkeypatch):
    from tessera.plans import brain, genetics

    monkeypatch.setattr(domain, "SHARE", 1)
    monkeypatch.setattr(domain, "LARGE", 0)
    reads_links_once(spark, monkeypatch, lambda *a: brain.chromosome_build(*a).select("n_loci").unionAll(genetics.haplotype_blocks(*a).select("n_snps")))
    assert domain.shared(spark, SF) and [tuple(r) for r in brain.chromosome_build(spark, SF).collect()] == sql(brain.ORACLES["chromosome_build"])


@pytest.mark.parametrize("samples,window", [(70, 7), (130, 40)])
def test_agreement_of_two_sides(spark, monkeypatch, samples, window):
    for name, value in (("LIGHT", 32), ("BLOCK", 16), ("CHUNK", 1)):
        monkeypatch.setattr(linkage, name, value)
    monkeypatch.setattr(planes, "SLICE", 4)
    rng = np.random.default_rng(samples)
    packed, variants, calls = repeated(spark, rng, samples)
    chosen = (some := rng.permutation(samples) >= 12), ~some  # on the other side some pairs have too few
    x, y = (linkage.pairs(planes.subset(packed, side), window, threshold=None).toPandas().set_index(["chr", "snp1_idx", "snp2_idx"])["r_squared"] for side in chosen)
    both = x.to_frame("x").join(y.to_frame("y"))
    strong = both[both["x"] > 0.5]
    want = both["y"].count(), both["x"].corr(both["y"]), strong.loc[strong["y"] > 0.5, "x"].sum() / strong["x"].sum()
    assert want[0] > 100 and 0 < want[2] < 1
    for row in (linkage.agreement(packed, chosen, window).first(), linkage.agreement(calls, chosen, window, variants=variants).first()):
        assert tuple(row) == pytest.approx(want, abs=1e-9)
    none = linkage.agreement(packed.limit(0), chosen, window).first()
    assert tuple(none) == (0, None, None)


def test_r_squared_on_a_limit_stays_there():
    codes = np.random.default_rng(2).integers(0, 3, (400, 12)).astype(np.uint8)
    rows = planes.pack(codes)
    _, a, b, c = linkage.moments(rows, rows)
    half = (2 * a * a == b * c) & (b * c > 0)
    assert half.sum() > 100 and (linkage.squared(rows, rows, 10)[half] == 0.5).all()
    assert (linkage.correlation(rows, rows, 10)[1][half] ** 2 > 0.5).any()


def test_compare_ld_makes_calls_of_different_variants_only(spark, monkeypatch):
    from tessera.plans import genetics

    monkeypatch.setattr(domain, "SHARE", 1)
    monkeypatch.setattr(domain, "LARGE", 0)
    for held in ("_tessera_kept", "_tessera_shared"):
        monkeypatch.setattr(spark.sparkContext, held, {}, raising=False)
    monkeypatch.setattr(genetics, "genotypes", None)
    assert [tuple(r) for r in genetics.compare_ld(spark, SF).collect()] == sql(genetics.ORACLES["compare_ld"]) and domain.shared(spark, SF)

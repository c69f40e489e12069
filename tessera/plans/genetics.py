"""Queries of population genetics over the derived genotype table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import statistics as st
from ..operators import graph, linkage, planes
from .domain import GENOTYPES_SQL, calls, genotypes, header, kept, read, shared, variants

WINDOW = 50
QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


PAIRS_SQL = f"""
{GENOTYPES_SQL.strip()},
m AS (SELECT a.i AS i, b.i AS j, count(*) AS n, sum(a.g) AS sx, sum(b.g) AS sy, sum(a.g * a.g) AS sxx, sum(b.g * b.g) AS syy, sum(a.g * b.g) AS sxy
  FROM g a JOIN g b ON a.k = b.k AND b.i > a.i AND b.i < a.i + {WINDOW} WHERE a.g IS NOT NULL AND b.g IS NOT NULL GROUP BY a.i, b.i),
all_pairs AS (SELECT i AS snp1_idx, j AS snp2_idx, n, (n * sxy - sx * sy)::DOUBLE * (n * sxy - sx * sy)::DOUBLE / ((n * sxx - sx * sx)::DOUBLE * (n * syy - sy * sy)::DOUBLE) AS r2
  FROM m WHERE n >= 10 AND n * sxx > sx * sx AND n * syy > sy * sy),
p AS (SELECT snp1_idx, snp2_idx, n, r2 FROM all_pairs WHERE r2::FLOAT > 0.5::FLOAT)"""


def linked(spark: SparkSession, sf_dir: str, threshold: float | None = 0.5) -> DataFrame:
    """``linkage.pairs`` of the genotype table."""
    if shared(spark, sf_dir):
        return linkage.shared_pairs(variants(spark, sf_dir), calls(spark, sf_dir), WINDOW, threshold=threshold)
    return linkage.pairs(calls(spark, sf_dir), WINDOW, threshold=threshold)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked pairs; written once an application, as most queries read them more than once."""
    return kept(spark, sf_dir, "links", lambda: linked(spark, sf_dir).select("snp1_idx", "snp2_idx", "r_squared"))


@query("ld_pairs", f"WITH {PAIRS_SQL} SELECT snp1_idx, snp2_idx, round(r2, 6) AS r_squared, snp1_idx * 1000 AS position1, snp2_idx * 1000 AS position2 FROM p")
def ld_pairs(spark, sf_dir):
    return linked(spark, sf_dir).select("snp1_idx", "snp2_idx", F.round("r_squared", 6).alias("r_squared"), "position1", "position2")


@query("ld_top20", f"WITH {PAIRS_SQL} SELECT snp1_idx, snp2_idx, round(r2, 6) AS r_squared FROM p ORDER BY round(r2, 9) DESC, snp1_idx, snp2_idx LIMIT 20")
def ld_top20(spark, sf_dir):
    return linkage.top(_pairs(spark, sf_dir)).select("snp1_idx", "snp2_idx", F.round("r_squared", 6).alias("r_squared"))


@query("ld_decay", f"WITH {PAIRS_SQL} SELECT (snp2_idx - snp1_idx) * 1000 // 10000 * 10000 AS distance, count(*) AS n_pairs, round(avg(r2), 6) AS mean_r2 FROM all_pairs GROUP BY 1")
def ld_decay(spark, sf_dir):
    return linkage.decay(linked(spark, sf_dir, None)).withColumn("mean_r2", F.round("mean_r2", 6))


@query("ld_clusters", f"WITH {PAIRS_SQL} SELECT p_partkey AS snp_idx, coalesce(string_agg(snp2_idx::VARCHAR, ',' ORDER BY snp2_idx), '') AS partners FROM part LEFT JOIN p ON snp1_idx = p_partkey GROUP BY 1")
def ld_clusters(spark, sf_dir):
    return linkage.clusters(variants(spark, sf_dir), _pairs(spark, sf_dir)).select("snp_idx", F.array_join(F.transform("partners", lambda x: x.cast("string")), ",").alias("partners"))


LOCI_SQL = f"""
{GENOTYPES_SQL.strip()},
c AS (SELECT i AS snp_idx, count(*) FILTER (WHERE g = 0) AS n_ref, count(*) FILTER (WHERE g = 1) AS n_het, count(*) FILTER (WHERE g = 2) AS n_alt, count(*) FILTER (WHERE g IS NULL) AS n_missing FROM g GROUP BY i),
l AS (SELECT *, n_ref + n_het + n_alt AS n_called, (n_het + 2 * n_alt)::DOUBLE / nullif(n_ref + n_het + n_alt, 0) AS mean,
  (n_het + 4 * n_alt)::DOUBLE / nullif(n_ref + n_het + n_alt, 0) AS square FROM c),
loci AS (SELECT *, mean / 2 AS alt_freq, square - mean * mean AS variance FROM l)"""
_ERF_SQL = "(CASE WHEN {x} < 0 THEN -1 WHEN {x} > 0 THEN 1 ELSE 0 END * (1 - ((((1.061405429 * (1 / (1 + 0.3275911 * abs({x}))) - 1.453152027) * (1 / (1 + 0.3275911 * abs({x}))) + 1.421413741) * (1 / (1 + 0.3275911 * abs({x}))) - 0.284496736) * (1 / (1 + 0.3275911 * abs({x}))) + 0.254829592) * (1 / (1 + 0.3275911 * abs({x}))) * exp(-({x}) * ({x}))))"
_CHI_P_SQL = f"CASE WHEN chi2 <= 0 THEN 1.0::DOUBLE WHEN chi2 >= 10 THEN 0.001::DOUBLE ELSE 1 - {_ERF_SQL.format(x='sqrt(chi2 / 2)')} END"


def _loci(spark, sf_dir) -> DataFrame:
    return linkage.loci(variants(spark, sf_dir))


@query(
    "locus_stats",
    f"WITH {LOCI_SQL} SELECT snp_idx, n_ref, n_het, n_alt, n_missing, round(alt_freq, 6) AS alt_freq, round(1 - alt_freq, 6) AS ref_freq, round(n_missing::DOUBLE / (n_called + n_missing), 6) AS missing_rate, round(mean, 6) AS mean, round(CASE WHEN variance > 1e-9 THEN sqrt(variance) ELSE 1 END, 6) AS std FROM loci",
)
def locus_stats(spark, sf_dir):
    return _loci(spark, sf_dir).select("snp_idx", "n_ref", "n_het", "n_alt", "n_missing", F.round("alt_freq", 6).alias("alt_freq"), F.round(1 - F.col("alt_freq"), 6).alias("ref_freq"), F.round("missing_rate", 6).alias("missing_rate"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    "maf_bins",
    f"WITH {LOCI_SQL}, b AS (SELECT least(alt_freq, 1 - alt_freq) AS maf FROM loci) SELECT CASE WHEN maf > 0.05 THEN 'common' WHEN maf >= 0.01 THEN 'low' WHEN maf >= 0.001 THEN 'rare' ELSE 'very_rare' END AS bin, count(*) AS n, round(avg(maf), 6) AS mean_maf FROM b GROUP BY 1",
)
def maf_bins(spark, sf_dir):
    t = _loci(spark, sf_dir).select(st.maf(F.col("alt_freq")).alias("maf"))
    return t.groupBy(st.maf_bin(F.col("maf")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("maf"), 6).alias("mean_maf"))


HWE_SQL = f"""
{LOCI_SQL},
e AS (SELECT snp_idx, n_ref, n_het, n_alt, n_called::DOUBLE AS n, (2 * n_ref + n_het)::DOUBLE / (2 * n_called) AS p FROM loci),
h AS (SELECT snp_idx, p, CASE WHEN n < 2 THEN 0 ELSE
    CASE WHEN p * p * n > 0 THEN (n_ref - p * p * n) ** 2 / (p * p * n) ELSE 0 END + CASE WHEN 2 * p * (1 - p) * n > 0 THEN (n_het - 2 * p * (1 - p) * n) ** 2 / (2 * p * (1 - p) * n) ELSE 0 END
    + CASE WHEN (1 - p) * (1 - p) * n > 0 THEN (n_alt - (1 - p) * (1 - p) * n) ** 2 / ((1 - p) * (1 - p) * n) ELSE 0 END END AS chi2 FROM e)"""


@query("hardy_weinberg", f"WITH {HWE_SQL} SELECT snp_idx, round(chi2, 6) AS chi2, round({_CHI_P_SQL}, 6) AS p_value FROM h")
def hardy_weinberg(spark, sf_dir):
    t = _loci(spark, sf_dir)
    c = F.col("n_ref"), F.col("n_het"), F.col("n_alt")
    t = t.select("snp_idx", st.hardy_weinberg_chi2(*c).alias("chi2"))  # a column of its own: the p-value names it often
    return t.select("snp_idx", F.round("chi2", 6).alias("chi2"), F.round(st.chi_square_p(F.col("chi2")), 6).alias("p_value"))


@query(
    "qc_report",
    f"""WITH {HWE_SQL} SELECT count(*) AS n_loci, count(*) FILTER (WHERE {_CHI_P_SQL} < 0.05) AS hwe_failures, count(*) FILTER (WHERE least(p, 1 - p) < 0.05) AS low_maf,
    round(avg(least(p, 1 - p)), 6) AS mean_maf, round(avg(2 * p * (1 - p)), 6) AS expected_heterozygosity, round(avg(2 * p * (1 - p)), 6) AS nucleotide_diversity FROM h""",
)
def qc_report(spark, sf_dir):
    """Population statistics and failures; diversity equals the expected heterozygosity by definition."""
    t = _loci(spark, sf_dir)
    c = F.col("n_ref"), F.col("n_het"), F.col("n_alt")
    p = st.allele_frequency(*c)
    t = t.select(p.alias("p"), st.hardy_weinberg_chi2(*c).alias("chi2")).select("p", st.chi_square_p(F.col("chi2")).alias("pv"))
    return t.agg(
        F.count(F.lit(1)).alias("n_loci"),
        F.count_if(F.col("pv") < 0.05).alias("hwe_failures"),
        F.count_if(st.maf(F.col("p")) < 0.05).alias("low_maf"),
        F.round(F.avg(st.maf(F.col("p"))), 6).alias("mean_maf"),
        F.round(F.avg(2 * F.col("p") * (1 - F.col("p"))), 6).alias("expected_heterozygosity"),
        F.round(F.avg(2 * F.col("p") * (1 - F.col("p"))), 6).alias("nucleotide_diversity"),
    )


@query("genotype_summary", f"WITH {LOCI_SQL} SELECT count(*) AS n_variants, (SELECT count(*) FROM supplier) AS n_samples, round(sum(n_missing)::DOUBLE / sum(n_called + n_missing), 6) AS missing_rate, round(avg(alt_freq), 6) AS mean_alt_freq FROM loci")
def genotype_summary(spark, sf_dir):
    n = F.sum("n_missing") / F.sum(F.col("n_called") + F.col("n_missing"))
    return _loci(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_variants"), F.max(F.col("n_called") + F.col("n_missing")).alias("n_samples"), F.round(n, 6).alias("missing_rate"), F.round(F.avg("alt_freq"), 6).alias("mean_alt_freq"))


@query("prs", f"WITH {GENOTYPES_SQL} SELECT (row_number() OVER (ORDER BY k) - 1)::INTEGER AS sample_idx, CAST(sum(coalesce(g, 0) * p_size) AS BIGINT) AS score FROM g JOIN part ON p_partkey = i GROUP BY k")
def prs(spark, sf_dir):
    """Polygenic scores with integer weights, which are summed over variants that are alike."""
    w = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("snp_idx"), F.col("p_size").cast("long").alias("weight"))
    w = variants(spark, sf_dir).join(w, "snp_idx").groupBy(F.col("alike").alias("snp_idx")).agg(F.sum("weight").alias("weight"))
    return linkage.scores(calls(spark, sf_dir), w).select("sample_idx", F.col("score").cast("long").alias("score"))


COMPONENTS_SQL = f"""
{PAIRS_SQL},
e AS (SELECT snp1_idx AS a, snp2_idx AS b FROM p UNION SELECT snp2_idx, snp1_idx FROM p),
r(root, id) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.root, e.b FROM r JOIN e ON r.id = e.a),
comp AS (SELECT id, min(root) AS first_snp FROM r GROUP BY id),
blk AS (SELECT first_snp, count(*) AS n_snps, min(id) * 1000 AS start_position, max(id) * 1000 AS end_position FROM comp GROUP BY first_snp),
mr AS (SELECT first_snp, avg(r2) AS mean_r_squared FROM p JOIN comp ON comp.id = p.snp1_idx GROUP BY first_snp),
blocks AS (SELECT row_number() OVER (ORDER BY first_snp) - 1 AS block_id, first_snp, n_snps, mean_r_squared, start_position, end_position FROM blk LEFT JOIN mr USING (first_snp))"""


def _blocks(spark, sf_dir):
    return kept(spark, sf_dir, "blocks", lambda: graph.haplotype_blocks(variants(spark, sf_dir), _pairs(spark, sf_dir)))


@query("haplotype_blocks", f"WITH RECURSIVE {COMPONENTS_SQL} SELECT block_id, first_snp, n_snps, round(mean_r_squared, 6) AS mean_r_squared, start_position, end_position FROM blocks")
def haplotype_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).select("block_id", "first_snp", "n_snps", F.round("mean_r_squared", 6).alias("mean_r_squared"), "start_position", "end_position")


@query(
    "block_statistics",
    f"WITH RECURSIVE {COMPONENTS_SQL} SELECT count(*) AS n_blocks, round(avg(n_snps), 6) AS mean_size, floor(median(n_snps))::BIGINT AS median_size, min(n_snps) AS min_size, max(n_snps) AS max_size, round(avg(mean_r_squared), 6) AS mean_r_squared, round(avg(end_position - start_position), 6) AS mean_span FROM blocks",
)
def block_statistics(spark, sf_dir):
    out = graph.block_statistics(_blocks(spark, sf_dir))
    return out.select("n_blocks", F.round("mean_size", 6).alias("mean_size"), "median_size", "min_size", "max_size", F.round("mean_r_squared", 6).alias("mean_r_squared"), F.round("mean_span", 6).alias("mean_span"))


@query(
    "motif_signatures",
    f"""WITH RECURSIVE {COMPONENTS_SQL} SELECT block_id, n_snps, round(mean_r_squared, 6) AS f0, round(ln(n_snps), 6) AS f1, round(ln(greatest(1, end_position - start_position)), 6) AS f2, round(1 / 22.0::DOUBLE, 6) AS f3,
    round(start_position * 1e-8::DOUBLE, 6) AS f4, round(end_position * 1e-8::DOUBLE, 6) AS f5, CASE WHEN mean_r_squared > 0.8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f6, round(ln(n_snps), 6) AS f7 FROM blocks WHERE n_snps >= 2 AND mean_r_squared >= 0.5""",
)
def motif_signatures(spark, sf_dir):
    """Eight features of each block of two variants or more with a mean r^2 of a half or more."""
    b = _blocks(spark, sf_dir).filter("n_snps >= 2 AND mean_r_squared >= 0.5")
    span = F.greatest(F.lit(1), F.col("end_position") - F.col("start_position"))
    f = ["mean_r_squared", F.ln("n_snps"), F.ln(span), F.lit(1 / 22), F.col("start_position") * 1e-8, F.col("end_position") * 1e-8, F.when(F.col("mean_r_squared") > 0.8, 1.0).otherwise(0.0), F.ln("n_snps")]
    return b.select("block_id", "n_snps", *[F.round(x, 6).alias(f"f{i}") for i, x in enumerate(f)])


NEURONS_SQL = f"{LOCI_SQL}, neurons AS (SELECT snp_idx AS id, snp_idx * 1000 AS position_bp, alt_freq AS af, least(alt_freq, 1 - alt_freq) AS maf, least(alt_freq, 1 - alt_freq) < 0.05 AS is_rare FROM loci)"


def neurons(spark, sf_dir) -> DataFrame:
    t = _loci(spark, sf_dir)
    return t.select(F.col("snp_idx").alias("id"), F.col("position").alias("position_bp"), F.col("alt_freq").alias("af"), st.maf(F.col("alt_freq")).alias("maf")).withColumn("is_rare", F.col("maf") < 0.05)


@query("neurons", f"WITH {NEURONS_SQL} SELECT id, position_bp, round(af, 6) AS af, round(maf, 6) AS maf, is_rare, round(sin(position_bp * 1e-6), 6) AS e0, round(maf, 6) AS e1, CASE WHEN is_rare THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS e2 FROM neurons")
def neurons_query(spark, sf_dir):
    t = neurons(spark, sf_dir)
    return t.select("id", "position_bp", F.round("af", 6).alias("af"), F.round("maf", 6).alias("maf"), "is_rare", F.round(F.sin(F.col("position_bp") * 1e-6), 6).alias("e0"), F.round("maf", 6).alias("e1"), S.flag(F.col("is_rare")).alias("e2"))


STEPS, PLASTICITY, START = 20, 0.1, 0.1


def synapses(spark, sf_dir) -> DataFrame:
    """Links between neurons, trained for STEPS steps in closed form.  Each end is a variant, and so a neuron: it need not be looked up."""
    p = _pairs(spark, sf_dir).select(F.col("snp1_idx").alias("src"), F.col("snp2_idx").alias("dst"), F.col("r_squared").alias("ld_r2"))
    return p.withColumn("weight", S.hebbian(F.lit(START), F.col("ld_r2"), F.lit(PLASTICITY), F.lit(STEPS)))


SYNAPSES_SQL = f"{PAIRS_SQL}, synapses AS (SELECT snp1_idx AS src, snp2_idx AS dst, r2 AS ld_r2, least(1, greatest(0, r2 - (r2 - {START}) * (1 - {PLASTICITY}::DOUBLE) ** {STEPS})) AS weight FROM p)"


@query("synapses", f"WITH {SYNAPSES_SQL} SELECT src, dst, round(ld_r2, 6) AS ld_r2, round(weight, 6) AS weight FROM synapses")
def synapses_query(spark, sf_dir):
    return synapses(spark, sf_dir).select("src", "dst", F.round("ld_r2", 6).alias("ld_r2"), F.round("weight", 6).alias("weight"))


@query("incident_weight", f"WITH {SYNAPSES_SQL}, x AS (SELECT src AS id, weight FROM synapses UNION ALL SELECT dst, weight FROM synapses) SELECT id, count(*) AS n_edges, round(sum(weight), 4) AS total FROM x GROUP BY id")
def incident_weight(spark, sf_dir):
    """Edges from or to each neuron, as a union of two scans and never an OR join."""
    s = synapses(spark, sf_dir)
    ends = s.select(F.col("src").alias("id"), "weight").unionAll(s.select(F.col("dst").alias("id"), "weight"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum("weight"), 4).alias("total"))


@query(
    "brain_summary",
    f"""WITH {SYNAPSES_SQL}, t AS (SELECT src AS id FROM synapses UNION SELECT dst FROM synapses) SELECT (SELECT count(*) FROM part) AS n_neurons, count(*) AS n_synapses, round(sum(ld_r2), 3) AS total_r2, round(avg(weight), 6) AS mean_weight,
    round((SELECT count(*) FROM t)::DOUBLE / (SELECT count(*) FROM part), 6) AS connectivity FROM synapses""",
)
def brain_summary(spark, sf_dir):
    s = synapses(spark, sf_dir)
    touched = s.select("src").union(s.select("dst")).distinct().agg(F.count(F.lit(1)).alias("touched"))
    n = neurons(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_neurons"))
    a = s.agg(F.count(F.lit(1)).alias("n_synapses"), F.round(F.sum("ld_r2"), 3).alias("total_r2"), F.round(F.avg("weight"), 6).alias("mean_weight"))
    return a.join(n, how="cross").join(touched, how="cross").select("n_neurons", "n_synapses", "total_r2", "mean_weight", F.round(F.col("touched") / F.col("n_neurons"), 6).alias("connectivity"))


@query("prune_weakest", f"WITH {SYNAPSES_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY round(weight, 9), src, dst) AS rk, count(*) OVER () AS n FROM synapses) SELECT src, dst, round(weight, 6) AS weight FROM k WHERE rk > floor(n * 0.2)")
def prune_weakest(spark, sf_dir):
    s = synapses(spark, sf_dir).withColumns({"chr": F.lit("1"), "w": F.round("weight", 9), "id": F.struct("src", "dst")})
    return graph.drop_weakest(s, 0.2, weight="w").select("src", "dst", F.round("weight", 6).alias("weight"))


@query("activate_near", f"WITH {NEURONS_SQL} SELECT o_orderkey, count(n.id) AS n_near, min(n.id) AS first_near FROM (SELECT o_orderkey, o_custkey * 997 AS pos FROM orders) q LEFT JOIN neurons n ON n.position_bp BETWEEN greatest(0, pos - 2500) AND pos + 2500 GROUP BY 1")
def activate_near(spark, sf_dir):
    """Neurons within a window of a position: a range join as an equi-join on bins of the window's width, each query in two or three bins."""
    width = 2500
    q = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 997).alias("at"))
    n = neurons(spark, sf_dir).select("id", "position_bp").withColumn("bin", F.floor(F.col("position_bp") / width))
    low = F.greatest(F.lit(0), F.col("at") - width)
    spread = q.withColumn("bin", F.explode(F.sequence(F.floor(low / width), F.floor((F.col("at") + width) / width))))
    hit = spread.join(n, "bin").filter((F.col("position_bp") >= low) & (F.col("position_bp") <= F.col("at") + width))
    found = hit.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_near"), F.min("id").alias("first_near"))
    return q.drop("at").join(found, "o_orderkey", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))


# Two populations of the same variants: samples of even and of odd number.
HALVES_SQL = f"{GENOTYPES_SQL}, half AS (SELECT i, k % 2 AS side, sum(g)::DOUBLE / (2 * count(g)) AS af FROM g GROUP BY i, k % 2 HAVING count(g) > 0)"


def _half(spark, sf_dir, side: int) -> DataFrame:
    """The genotypes of samples whose number is even (side 0) or odd."""
    return planes.subset(genotypes(spark, sf_dir), header(spark, sf_dir) % 2 == side)


def _halves(spark, sf_dir):
    af = [linkage.loci(_half(spark, sf_dir, side)).select("snp_idx", F.col("alt_freq").alias(name)) for side, name in enumerate(("reference", "synthetic"))]
    return af[0].join(af[1], "snp_idx")


@query("compare_allele_frequencies", f"WITH {HALVES_SQL} SELECT count(*) AS n, round(sqrt(sum((a.af - b.af) ** 2) / (2 * count(*))), 6) AS rmse, round(max(abs(a.af - b.af)), 6) AS largest FROM half a JOIN half b ON a.i = b.i AND a.side = 0 AND b.side = 1")
def compare_allele_frequencies(spark, sf_dir):
    t = _halves(spark, sf_dir).filter("reference IS NOT NULL AND synthetic IS NOT NULL")
    gap = F.col("reference") - F.col("synthetic")
    return t.agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.sum(gap * gap) / (2 * F.count(F.lit(1)))), 6).alias("rmse"), F.round(F.max(F.abs(gap)), 6).alias("largest"))


_SIDE = lambda s: f"SELECT a.i AS i, b.i AS j, count(*) AS n, sum(a.g) AS sx, sum(b.g) AS sy, sum(a.g * a.g) AS sxx, sum(b.g * b.g) AS syy, sum(a.g * b.g) AS sxy FROM g a JOIN g b ON a.k = b.k AND b.i > a.i AND b.i < a.i + {WINDOW} WHERE a.g IS NOT NULL AND b.g IS NOT NULL AND a.k % 2 = {s} GROUP BY a.i, b.i"
_R2 = "SELECT i, j, (n * sxy - sx * sy)::DOUBLE ** 2 / ((n * sxx - sx * sx)::DOUBLE * (n * syy - sy * sy)::DOUBLE) AS r2 FROM {m} WHERE n >= 10 AND n * sxx > sx * sx AND n * syy > sy * sy"


@query(
    "compare_ld",
    f"""WITH {GENOTYPES_SQL}, m0 AS ({_SIDE(0)}), m1 AS ({_SIDE(1)}), p0 AS ({_R2.format(m="m0")}), p1 AS ({_R2.format(m="m1")})
    SELECT count(*) AS n, coalesce(round(corr(p0.r2, p1.r2), 5), 0) AS correlation, coalesce(round(1 - abs(corr(p0.r2, p1.r2)), 5), 0) AS distance, round((SELECT coalesce(sum(CASE WHEN p1.r2 > 0.5 THEN p0.r2 ELSE 0 END) / sum(p0.r2), 1) FROM p0 LEFT JOIN p1 USING (i, j) WHERE p0.r2 > 0.5), 5) AS coverage FROM p0 JOIN p1 USING (i, j)""",
)
def compare_ld(spark, sf_dir):
    """Correlation of r^2 on both sides, distance 1 - |r|, and the share of the reference's r^2 that the other side covers."""
    odd = header(spark, sf_dir) % 2 == 1
    t = linkage.agreement(calls(spark, sf_dir), (~odd, odd), WINDOW, variants=variants(spark, sf_dir) if shared(spark, sf_dir) else None)
    r, zero = F.col("correlation"), F.lit(0.0)  # undefined: correlation and distance are 0
    return t.select("n", F.round(F.coalesce(r, zero), 5).alias("correlation"), F.round(F.coalesce(1 - F.abs(r), zero), 5).alias("distance"), F.round(F.coalesce("coverage", F.lit(1.0)), 5).alias("coverage"))


def _probit_sql(p: float) -> str:
    """The rational approximation of the inverse normal at a constant."""
    t = f"sqrt(-2 * ln({min(p, 1 - p)}::DOUBLE))"
    c, d = st.PROBIT_C, st.PROBIT_D
    z = f"({t} - ({c[0]} + {c[1]} * {t} + {c[2]} * {t} * {t}) / (1 + {d[0]} * {t} + {d[1]} * {t} * {t} + {d[2]} * {t} * {t} * {t}))"
    return f"(-{z})" if p < 0.5 else z


_POWER_SQL = f"""n AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), e AS (SELECT *, unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE]) AS effect FROM n),
x AS (SELECT *, effect * effect * n AS shift, ({_probit_sql(0.975)} - sqrt(effect * effect * n)) / sqrt(2.0::DOUBLE) AS x FROM e)"""


@query("power_table", f"WITH {_POWER_SQL} SELECT c_mktsegment, n, effect, round(CASE WHEN shift < 1 THEN 0.05::DOUBLE ELSE least(1, greatest(0, 1 - (1 + {_ERF_SQL.format(x='x')}) * 0.5)) END, 6) AS power, greatest(2, ceil((({_probit_sql(0.975)} + {_probit_sql(0.8)}) / effect) ** 2))::BIGINT AS needed FROM x")
def power_table(spark, sf_dir):
    """Power and least sample size by effect and size of market segments."""
    t = read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    t = t.withColumn("effect", F.explode(F.array(*[F.lit(x) for x in (0.05, 0.1, 0.2)])))
    return t.select("c_mktsegment", "n", "effect", F.round(st.power(F.col("effect"), F.col("n"), F.lit(0.05)), 6).alias("power"), st.min_sample_size(F.col("effect"), F.lit(0.05), F.lit(0.8)).alias("needed"))


@query(
    "fixation",
    "SELECT p_partkey, round(CASE WHEN abs(s) < 1e-9 THEN 1 / (2 * n) WHEN -2 * n * s > 700 THEN 0 ELSE greatest(0, least(1, (1 - exp(-2 * s)) / (1 - exp(least(-2 * n * s, 700))))) END, 6) AS p_fix FROM (SELECT p_partkey, ((p_partkey % 41) - 20) / 100.0::DOUBLE AS s, (p_size * 10)::DOUBLE AS n FROM part)",
)
def fixation(spark, sf_dir):
    t = read(spark, sf_dir, "part")
    return t.select("p_partkey", F.round(st.fixation_probability((F.col("p_partkey") % 41 - 20) / 100.0, F.col("p_size") * 10), 6).alias("p_fix"))


# --------------------------------------------------------------------------- fixed analytic questions

RISK_SQL = f"{SYNAPSES_SQL}, q AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS subject FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)"


def _asked(spark, sf_dir):
    """Variants that subjects ask about."""
    l = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity >= 45")  # noqa: E741
    return l.select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("subject")).distinct()


@query(
    "risk_scores",
    f"""WITH {RISK_SQL}, i AS (SELECT id, sum(w) AS w FROM (SELECT src AS id, weight AS w FROM synapses UNION ALL SELECT dst, weight FROM synapses) GROUP BY id),
    s AS (SELECT subject, count(*) AS n_snps, 0.15::DOUBLE * count(*) + 0.01::DOUBLE * sum(coalesce(w, 0)) AS raw FROM q LEFT JOIN i USING (id) GROUP BY subject)
    SELECT subject, n_snps, round(least(1, raw), 4) AS score, round(least(1, raw / 2), 4) AS half_score, CASE WHEN least(1, raw) >= 0.7 THEN 'critical' WHEN least(1, raw) >= 0.5 THEN 'high' WHEN least(1, raw) >= 0.3 THEN 'medium' WHEN least(1, raw) >= 0.1 THEN 'low' ELSE 'none' END AS band FROM s""",
)
def risk_scores(spark, sf_dir):
    """Variants asked about, semi-joined with neurons and weighted by their incident edges; both score forms."""
    s = synapses(spark, sf_dir)
    ends = s.select(F.col("src").alias("id"), "weight").unionAll(s.select(F.col("dst").alias("id"), "weight")).groupBy("id").agg(F.sum("weight").alias("w"))
    t = _asked(spark, sf_dir).join(neurons(spark, sf_dir).select("id"), "id", "left_semi").join(ends, "id", "left")
    t = t.groupBy("subject").agg(F.count(F.lit(1)).alias("n_snps"), (0.15 * F.count(F.lit(1)) + 0.01 * F.sum(F.coalesce("w", F.lit(0.0)))).alias("raw"))
    one = F.least(F.lit(1.0), F.col("raw"))
    return t.select("subject", "n_snps", F.round(one, 4).alias("score"), F.round(F.least(F.lit(1.0), F.col("raw") / 2), 4).alias("half_score"), S.risk_band(one).alias("band"))


@query("population_signal", f"WITH {NEURONS_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE is_rare) AS n_rare, round(count(*) FILTER (WHERE is_rare)::DOUBLE / (count(*) + 1), 6) AS signal FROM neurons")
def population_signal(spark, sf_dir):
    n = neurons(spark, sf_dir)
    return n.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_rare").alias("n_rare"), F.round(F.count_if("is_rare") / (F.count(F.lit(1)) + 1), 6).alias("signal"))


@query("supply_chain_risk", f"WITH {SYNAPSES_SQL}, x AS (SELECT src AS id, weight FROM synapses UNION ALL SELECT dst, weight FROM synapses), s AS (SELECT id, sum(weight) AS total FROM x GROUP BY id) SELECT id, round(total, 4) AS total FROM s WHERE total > 0.7")
def supply_chain_risk(spark, sf_dir):
    return incident_weight(spark, sf_dir).filter("total > 0.7").select("id", "total")


@query("evolution_hint", f"WITH RECURSIVE {COMPONENTS_SQL} SELECT count(*) AS n_blocks, coalesce(sum(n_snps), 0)::BIGINT AS n_snps FROM blocks WHERE mean_r_squared > 0.6 AND n_snps > 3")
def evolution_hint(spark, sf_dir):
    return _blocks(spark, sf_dir).filter("mean_r_squared > 0.6 AND n_snps > 3").agg(F.count(F.lit(1)).alias("n_blocks"), F.coalesce(F.sum("n_snps"), F.lit(0)).alias("n_snps"))


@query(
    "injection_reach",
    """WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey::BIGINT AS a, (100 + n_regionkey)::BIGINT AS b FROM nation UNION SELECT DISTINCT (200 + s_suppkey)::BIGINT, s_nationkey::BIGINT FROM supplier),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(start, id, depth) AS (SELECT n_nationkey::BIGINT, n_nationkey::BIGINT, 0 FROM nation UNION SELECT r.start, u.b, r.depth + 1 FROM r JOIN u ON r.id = u.a WHERE r.depth < 3)
    SELECT start, count(DISTINCT id) AS reached FROM r GROUP BY start HAVING count(DISTINCT id) > 3""",
)
def injection_reach(spark, sf_dir):
    """Nodes from which more than three are reached within three undirected steps."""
    n, s = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    e = n.select(F.col("n_nationkey").cast("long").alias("src"), (100 + F.col("n_regionkey")).cast("long").alias("dst")).union(s.select((200 + F.col("s_suppkey")).cast("long"), F.col("s_nationkey").cast("long")))
    found = graph.reach(e, n.select(F.col("n_nationkey").cast("long").alias("id")), 3)
    return found.groupBy("start").agg(F.count(F.lit(1)).alias("reached")).filter("reached > 3")


@query(
    "injection_chains",
    f"""WITH RECURSIVE {RISK_SQL}, u AS (SELECT src AS a, dst AS b FROM synapses UNION SELECT dst, src FROM synapses), r(start, id, depth) AS (SELECT DISTINCT id, id, 0 FROM q UNION SELECT r.start, u.b, r.depth + 1 FROM r JOIN u ON r.id = u.a WHERE r.depth < 5),
    n AS (SELECT start FROM r GROUP BY start HAVING count(DISTINCT id) > 3) SELECT DISTINCT id FROM r SEMI JOIN n USING (start)""",
)
def injection_chains(spark, sf_dir):
    """Distinct neurons within five synapses of a variant asked about, from the starts that reach more than three."""
    return graph.within(synapses(spark, sf_dir).select("src", "dst"), _asked(spark, sf_dir).select("id"), 5, 3)


@query("elite_selection", "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rk, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE rk <= greatest(1, n // 4)")
def elite_selection(spark, sf_dir):
    """The fittest quarter of each population, one at least."""
    p = read(spark, sf_dir, "part")
    w = Window.partitionBy("p_brand")
    t = p.withColumn("rk", F.row_number().over(w.orderBy(F.desc("p_retailprice"), "p_partkey"))).withColumn("n", F.count(F.lit(1)).over(w))
    return t.filter(F.col("rk") <= F.greatest(F.lit(1), F.floor(F.col("n") / 4))).select("p_brand", "p_partkey", "p_retailprice")


@query("generation_stats", "SELECT p_brand, round(avg(f), 6) AS mean_fitness, min(f) AS min_fitness, max(f) AS max_fitness, count(*) FILTER (WHERE f > 0.7) AS n_fit FROM (SELECT p_brand, (p_size % 50) / 50.0::DOUBLE AS f FROM part) GROUP BY p_brand")
def generation_stats(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_brand", ((F.col("p_size") % 50) / 50.0).alias("f"))
    return p.groupBy("p_brand").agg(F.round(F.avg("f"), 6).alias("mean_fitness"), F.min("f").alias("min_fitness"), F.max("f").alias("max_fitness"), F.count_if(F.col("f") > 0.7).alias("n_fit"))


@query(
    "code_quality",
    f"""WITH RECURSIVE {COMPONENTS_SQL}, s AS (SELECT least(1, greatest(0, r2 - (r2 - {START}) * (1 - {PLASTICITY}::DOUBLE) ** {STEPS})) AS weight FROM p)
    SELECT (SELECT count(*) FROM s)::DOUBLE / (SELECT count(*) FROM part) > 3 AS tangled, (SELECT count(*) FROM blocks WHERE n_snps > 50) AS large_blocks, (SELECT avg(weight) FROM s) < 0.2 AS weak""",
)
def code_quality(spark, sf_dir):
    """Edges a node over three, blocks of over fifty members, a mean weight under a fifth."""
    s = synapses(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_edges"), F.avg("weight").alias("w"))
    n = read(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"))
    b = _blocks(spark, sf_dir).agg(F.count_if(F.col("n_snps") > 50).alias("large_blocks"))
    return s.join(n, how="cross").join(b, how="cross").select((F.col("n_edges") / F.col("n") > 3).alias("tangled"), "large_blocks", (F.col("w") < 0.2).alias("weak"))


@query("crypto_risk", f"WITH {NEURONS_SQL} SELECT id, position_bp FROM neurons WHERE position_bp < 1000")
def crypto_risk(spark, sf_dir):
    return neurons(spark, sf_dir).filter("position_bp < 1000").select("id", "position_bp")


@query("trait_pattern", f"WITH {SYNAPSES_SQL} SELECT round(least(1, 0.42::DOUBLE + 0.3::DOUBLE * avg(weight)), 6) AS confidence FROM synapses")
def trait_pattern(spark, sf_dir):
    return synapses(spark, sf_dir).agg(F.round(F.least(F.lit(1.0), 0.42 + 0.3 * F.avg("weight")), 6).alias("confidence"))


@query("phenotypes", f"WITH {LOCI_SQL}, x AS (SELECT alt_freq, row_number() OVER (ORDER BY snp_idx) - 1 AS k FROM loci), h AS (SELECT unnest(range(4)) AS head) SELECT head, round(greatest(0, least(1, 0.1::DOUBLE * head + sum(alt_freq * ((k * 7 + head * 3) % 11 - 5) / 512))), 6) AS value FROM x CROSS JOIN h WHERE k < 512 GROUP BY head")
def phenotypes(spark, sf_dir):
    """Four trait heads over the allele frequencies of the first 512 variants (the heads' width)."""
    x = _loci(spark, sf_dir).select("snp_idx", "alt_freq").orderBy("snp_idx").limit(512)
    k = F.row_number().over(Window.orderBy("snp_idx")) - 1  # 512 rows
    x = x.withColumn("k", k).withColumn("head", F.explode(F.array(*[F.lit(h).cast("long") for h in range(4)])))
    value = 0.1 * F.max("head") + F.sum(F.col("alt_freq") * ((F.col("k") * 7 + F.col("head") * 3) % 11 - 5) / 512)
    return x.groupBy("head").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 6).alias("value"))


@query(
    "genomic_task",
    f"""WITH {SYNAPSES_SQL}, {LOCI_SQL.replace(GENOTYPES_SQL.strip() + ',', '').strip()}, nn AS (SELECT snp_idx AS id, least(alt_freq, 1 - alt_freq) AS maf FROM loci), top AS (SELECT id FROM nn ORDER BY round(maf, 9) DESC, id LIMIT 8),
    i AS (SELECT id, sum(w) AS w FROM (SELECT src AS id, weight AS w FROM synapses UNION ALL SELECT dst, weight FROM synapses) GROUP BY id), t AS (SELECT src AS id FROM synapses UNION SELECT dst FROM synapses)
    SELECT round(0.4::DOUBLE * least(1, (SELECT sum(0.15::DOUBLE + 0.01::DOUBLE * coalesce(w, 0)) FROM top LEFT JOIN i USING (id)) / 2) + 0.25::DOUBLE * (SELECT count(*) FILTER (WHERE maf < 0.05)::DOUBLE / (count(*) + 1) FROM nn) + 0.35::DOUBLE * (SELECT count(*)::DOUBLE FROM t) / (SELECT count(*) FROM nn), 5) AS score""",
)
def genomic_task(spark, sf_dir):
    """.4 risk of the eight most varied variants, .25 rare share, .35 connectivity."""
    n, s = neurons(spark, sf_dir), synapses(spark, sf_dir)
    ends = s.select(F.col("src").alias("id"), "weight").unionAll(s.select(F.col("dst").alias("id"), "weight"))
    top = n.orderBy(F.desc(F.round("maf", 9)), "id").limit(8).select("id")
    weights = ends.join(F.broadcast(top), "id").groupBy("id").agg(F.sum("weight").alias("w"))  # of the eight only
    risk = top.join(weights, "id", "left").agg(F.least(F.lit(1.0), F.sum(0.15 + 0.01 * F.coalesce("w", F.lit(0.0))) / 2).alias("risk"))
    pop = n.agg((F.count_if("is_rare") / (F.count(F.lit(1)) + 1)).alias("pop"), F.count(F.lit(1)).alias("n"))
    touched = ends.select("id").distinct().agg(F.count(F.lit(1)).alias("touched"))
    return risk.join(pop, how="cross").join(touched, how="cross").select(F.round(0.4 * F.col("risk") + 0.25 * F.col("pop") + 0.35 * F.col("touched") / F.col("n"), 5).alias("score"))


@query(
    "ld_dense",
    f"""WITH {GENOTYPES_SQL}, s AS (SELECT i, avg(g) AS mean, var_pop(g) AS var FROM g GROUP BY i), z AS (SELECT g.i, k, (g - mean) / CASE WHEN var > 1e-9 THEN sqrt(var) ELSE 1 END AS z FROM g JOIN s ON s.i = g.i WHERE g IS NOT NULL),
    r AS (SELECT a.i, b.i AS j, CASE WHEN a.i = b.i THEN 1 WHEN count(*) <= 1 THEN 0 ELSE least(1, greatest(-1, sum(a.z * b.z) / count(*))) END AS r FROM z a JOIN z b ON a.k = b.k AND b.i >= a.i GROUP BY a.i, b.i) SELECT floor(round(abs(r), 9) * 10)::BIGINT AS tenth, count(*) AS n FROM r GROUP BY 1""",
)
def ld_dense(spark, sf_dir):
    """All pairs by marginal statistics, counted by strength."""
    copies = variants(spark, sf_dir).groupBy(F.col("alike").alias("snp_idx")).agg(F.count(F.lit(1)).alias("copies"))
    return linkage.tally(calls(spark, sf_dir), copies)

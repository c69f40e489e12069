"""Queries of the brain over linkage: motifs, activation, recall, structure, diagnoses and what agents of chromosomes answer together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import statistics as st
from ..operators import brain, linkage
from .domain import GENOTYPES_SQL, genotypes, read, variants
from .genetics import COMPONENTS_SQL, HWE_SQL, LOCI_SQL, NEURONS_SQL, PAIRS_SQL, RISK_SQL, SYNAPSES_SQL, WINDOW, _CHI_P_SQL, _blocks, _loci, _pairs, neurons, synapses

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: The question that motifs are compared with, and entries of the working set.
ASKED = [0.9, 2.0, 9.0, 0.05, 0.01, 0.01, 1.0, 2.0]
CAPACITY = 12


def motifs(spark, sf_dir) -> DataFrame:
    b = _blocks(spark, sf_dir).filter("n_snps >= 2 AND mean_r_squared >= 0.5")
    span = F.greatest(F.lit(1), F.col("end_position") - F.col("start_position"))
    f = ["mean_r_squared", F.ln("n_snps"), F.ln(span), F.lit(1 / 22), F.col("start_position") * 1e-8, F.col("end_position") * 1e-8, F.when(F.col("mean_r_squared") > 0.8, 1.0).otherwise(0.0), F.ln("n_snps")]
    return b.select(F.lit("1").alias("chr"), "block_id", "n_snps", "mean_r_squared", *[(F.col(x) if isinstance(x, str) else x).alias(f"f{i}") for i, x in enumerate(f)])


_FEATURES = ["mean_r_squared", "ln(n_snps)", "ln(greatest(1, end_position - start_position))", "1 / 22.0::DOUBLE", "start_position * 1e-8::DOUBLE", "end_position * 1e-8::DOUBLE", "CASE WHEN mean_r_squared > 0.8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "ln(n_snps)"]
_DOT = " + ".join(f"{q}::DOUBLE * ({f})" for q, f in zip(ASKED, _FEATURES))
_SIZE = " + ".join(f"({f}) ** 2" for f in _FEATURES)
_MOTIFS_SQL = f"""{COMPONENTS_SQL}, scored AS (SELECT block_id, round(({_DOT}) / greatest(sqrt({_SIZE}) * {sum(q * q for q in ASKED) ** 0.5}::DOUBLE, 1e-9), 6) AS score,
  round(({_DOT}) / greatest(sqrt({_SIZE}) * {sum(q * q for q in ASKED) ** 0.5}::DOUBLE, 1e-9), 9) AS fine FROM blocks WHERE n_snps >= 2 AND mean_r_squared >= 0.5)"""


@query("motif_scores", f"WITH RECURSIVE {_MOTIFS_SQL} SELECT block_id, score FROM scored")
def motif_scores(spark, sf_dir):
    """Cosine of every motif to the question."""
    return brain.score_motifs(motifs(spark, sf_dir), ASKED).select("block_id", F.round("score", 6).alias("score"))


@query("motif_activation", f"WITH RECURSIVE {_MOTIFS_SQL} SELECT block_id, score, row_number() OVER (ORDER BY fine DESC, block_id)::INTEGER AS place FROM scored ORDER BY fine DESC, block_id LIMIT {CAPACITY}")
def motif_activation(spark, sf_dir):
    """The motifs that the question activates, of all chromosomes as none is named 99."""
    return brain.best_motifs(motifs(spark, sf_dir), ASKED, CAPACITY, "99").select("block_id", F.round("score", 6).alias("score"), "place")


@query(
    "working_set",
    f"""WITH {SYNAPSES_SQL}, heavy AS (SELECT src, dst, row_number() OVER (ORDER BY round(weight, 9) DESC, src, dst) AS k FROM synapses),
    listed AS (SELECT src AS id, 2 * k AS k FROM heavy WHERE k <= 8 UNION ALL SELECT dst, 2 * k + 1 FROM heavy WHERE k <= 8 UNION ALL SELECT p_partkey, 18 + row_number() OVER (ORDER BY p_partkey) FROM part),
    found AS (SELECT id, min(k) AS k FROM listed GROUP BY id) SELECT row_number() OVER (ORDER BY k, id)::INTEGER AS place, id FROM found ORDER BY k, id LIMIT {CAPACITY * 2}""",
)
def working_set(spark, sf_dir):
    """Neurons that the question activates: ends of the heaviest synapses first, then neurons in order."""
    s = synapses(spark, sf_dir).withColumn("chr", F.lit("1"))
    n = neurons(spark, sf_dir).withColumn("chr", F.lit("1"))
    return brain.working_set(motifs(spark, sf_dir), s, n, ASKED, CAPACITY * 2)[1].select("place", "id")


@query("recall", f"WITH {RISK_SQL}, e AS (SELECT src AS id, dst AS other, weight FROM synapses UNION ALL SELECT dst, src, weight FROM synapses) SELECT id, other, round(weight, 6) AS weight, row_number() OVER (PARTITION BY id ORDER BY round(weight, 9) DESC, other) AS place FROM e WHERE weight > 0.5 AND id IN (SELECT id FROM q)")
def recall(spark, sf_dir):
    """What variants that subjects ask about are strongly linked to."""
    asked = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity >= 45").select(F.col("l_partkey").alias("id"))
    return brain.recall(synapses(spark, sf_dir), asked).select("id", "other", F.round("weight", 6).alias("weight"), F.col("place").cast("long").alias("place"))


@query("spread_activation", f"WITH {SYNAPSES_SQL}, st AS (SELECT p_partkey AS id, 1 + p_size / 50.0::DOUBLE AS strength FROM part WHERE p_size >= 40), e AS (SELECT src AS id, dst AS other, weight FROM synapses UNION ALL SELECT dst, src, weight FROM synapses), x AS (SELECT id, strength AS a FROM st UNION ALL SELECT other, strength * weight * 0.1::DOUBLE FROM e JOIN st USING (id)) SELECT id, round(sum(a), 6) AS activation FROM x GROUP BY id")
def spread_activation(spark, sf_dir):
    started = read(spark, sf_dir, "part").filter("p_size >= 40").select(F.col("p_partkey").alias("id"), (1 + F.col("p_size") / 50.0).alias("strength"))
    return brain.spread(synapses(spark, sf_dir), started).select("id", F.round("activation", 6).alias("activation"))


@query("ld_memory", f"WITH {PAIRS_SQL}, b AS (SELECT snp1_idx AS id, r2, count(*) OVER (PARTITION BY snp1_idx) - row_number() OVER (PARTITION BY snp1_idx ORDER BY snp2_idx) + 1 AS back FROM p) SELECT id, round(sum(r2 / 2.0::DOUBLE ** back), 6) AS memory FROM b GROUP BY id")
def ld_memory(spark, sf_dir):
    return brain.memory(_pairs(spark, sf_dir)).select("id", F.round("memory", 6).alias("memory"))


@query("large_blocks", f"WITH RECURSIVE {COMPONENTS_SQL} SELECT first_snp, n_snps, row_number() OVER (ORDER BY n_snps DESC, first_snp DESC) AS place FROM blocks WHERE n_snps >= 10")
def large_blocks(spark, sf_dir):
    return brain.large_blocks(_blocks(spark, sf_dir)).select("first_snp", "n_snps", F.col("place").cast("long").alias("place"))


@query("new_motifs", f"WITH RECURSIVE {COMPONENTS_SQL} SELECT block_id, n_snps FROM blocks WHERE n_snps >= 2 AND mean_r_squared >= 0.5 AND block_id % 3 <> 0")
def new_motifs(spark, sf_dir):
    """Motifs that are added to those of every third block."""
    b = _blocks(spark, sf_dir).withColumn("chr", F.lit("1"))
    known = b.filter("block_id % 3 = 0").select("chr", "block_id")
    return brain.new_motifs(known, b).select("block_id", "n_snps")


@query("neuron_at_position", f"WITH {NEURONS_SQL} SELECT o_orderkey, min(id) AS id FROM orders JOIN neurons ON position_bp = (o_custkey % 400) * 500 GROUP BY 1")
def neuron_at_position(spark, sf_dir):
    """The first neuron at a position that orders ask for."""
    asked = read(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_custkey") % 400) * 500).alias("position_bp"))
    return asked.join(neurons(spark, sf_dir).select("id", "position_bp"), "position_bp").groupBy("o_orderkey").agg(F.min("id").alias("id"))


@query(
    "structure_metrics",
    f"""WITH RECURSIVE {COMPONENTS_SQL}, s AS (SELECT least(1, greatest(0, r2 - (r2 - 0.1) * (1 - 0.1::DOUBLE) ** 20)) AS weight FROM p), mo AS (SELECT count(*) AS n_motifs FROM blocks WHERE n_snps >= 2 AND mean_r_squared >= 0.5),
    t AS (SELECT (SELECT count(*) FROM part) AS n_neurons, (SELECT count(*) FROM s) AS n_synapses, (SELECT avg(weight) FROM s) AS w, (SELECT count(*) FROM blocks) AS n_blocks, (SELECT avg(mean_r_squared) FROM blocks) AS r, n_motifs FROM mo)
    SELECT n_neurons, n_synapses, n_blocks, n_motifs, n_neurons * 64 + n_synapses * 32 + n_motifs * 64 AS memory_bytes, round(w, 6) AS mean_weight, round(r, 6) AS mean_block_r2,
    round(least(1, 0.7::DOUBLE * w + 0.3::DOUBLE * least(1, ln(n_neurons) / 12)), 6) AS proxy_task, round(least(1, 0.8::DOUBLE * r + CASE WHEN n_motifs > 0 THEN 0.2::DOUBLE ELSE 0 END), 6) AS proxy_biology FROM t""",
)
def structure_metrics(spark, sf_dir):
    """Counts, memory estimate and means of the whole brain, and the scores that follow from structure alone."""
    one = F.lit("1")
    b = _blocks(spark, sf_dir).withColumn("chr", one)
    t = brain.structure(neurons(spark, sf_dir).withColumn("chr", one), synapses(spark, sf_dir), b, b.filter("n_snps >= 2 AND mean_r_squared >= 0.5"))
    r = lambda c: F.round(c, 6).alias(c)
    return t.select("n_neurons", "n_synapses", "n_blocks", "n_motifs", "memory_bytes", r("mean_weight"), r("mean_block_r2"), r("proxy_task"), r("proxy_biology"))


@query("network_loss", f"WITH {PAIRS_SQL}, n AS (SELECT (SELECT count(*) FROM p)::DOUBLE AS pairs, (SELECT count(*) FROM part)::DOUBLE AS snps) SELECT round(abs(pairs - least(snps * 0.3::DOUBLE, 1000)) / least(snps * 0.3::DOUBLE, 1000), 6) AS loss, round(pairs / (snps * (snps - 1) / 2), 8) AS connectivity FROM n")
def network_loss(spark, sf_dir):
    t = _pairs(spark, sf_dir).agg(F.count(F.lit(1)).cast("double").alias("pairs")).join(read(spark, sf_dir, "part").agg(F.count(F.lit(1)).cast("double").alias("snps")), how="cross")
    loss, share = brain.connectivity_loss(F.col("pairs"), F.col("snps"))
    return t.select(F.round(loss, 6).alias("loss"), F.round(share, 8).alias("connectivity"))


@query("quality_score", f"WITH {HWE_SQL}, {PAIRS_SQL.replace(GENOTYPES_SQL.strip() + ',', '').strip()}, r AS (SELECT avg(r2) AS m FROM p) SELECT round(greatest(0, least(1, 1 - (0.3::DOUBLE * count(*) FILTER (WHERE {_CHI_P_SQL} < 0.05) / count(*) + 0.2::DOUBLE * count(*) FILTER (WHERE least(p, 1 - p) < 0.05) / count(*) + 0.2::DOUBLE * abs(1 - (SELECT m FROM r))))), 6) AS quality FROM h")
def quality_score(spark, sf_dir):
    """Of the genotype table, by failures, rare variants and the mean r^2 of linked pairs."""
    c = F.col("n_ref"), F.col("n_het"), F.col("n_alt")
    t = _loci(spark, sf_dir).select(st.allele_frequency(*c).alias("p"), st.hardy_weinberg_chi2(*c).alias("chi2"))
    t = t.agg(F.count_if(st.chi_square_p(F.col("chi2")) < 0.05).alias("failures"), F.count_if(st.maf(F.col("p")) < 0.05).alias("low"), F.count(F.lit(1)).alias("n"))
    t = t.join(_pairs(spark, sf_dir).agg(F.avg("r_squared").alias("m")), how="cross")  # one row each
    return t.select(F.round(brain.quality(F.col("failures"), F.col("low"), F.col("n"), F.col("m")), 6).alias("quality"))


@query("genome_frequencies", f"WITH {LOCI_SQL} SELECT snp_idx, round(coalesce(alt_freq, 0.5::DOUBLE), 6) AS alt_freq FROM loci")
def genome_frequencies(spark, sf_dir):
    """Of a genome: a half without calls."""
    return _loci(spark, sf_dir).select("snp_idx", F.round(F.coalesce("alt_freq", F.lit(0.5)), 6).alias("alt_freq"))


_LINE = "SELECT a.i AS snp_idx, count(*) AS n, sum(a.g) AS sx, sum(b.g) AS sy, sum(a.g * a.g) AS sxx, sum(b.g * b.g) AS syy, sum(a.g * b.g) AS sxy, sum(a.g * b.g * a.g * b.g) AS ss FROM g a JOIN g b ON a.k = b.k AND b.i = a.i + 1 WHERE a.g IS NOT NULL AND b.g IS NOT NULL GROUP BY a.i"


@query(
    "neighbour_r2",
    f"WITH {GENOTYPES_SQL}, m AS ({_LINE}) SELECT snp_idx, round(CASE WHEN n * sxx > sx * sx AND n * syy > sy * sy THEN (n * sxy - sx * sy)::DOUBLE ** 2 / ((n * sxx - sx * sx)::DOUBLE * (n * syy - sy * sy)::DOUBLE) ELSE 0 END, 6) AS r_squared FROM m",
)
def neighbour_r2(spark, sf_dir):
    """r^2 of a genome's neighbours, without a least number of samples; 0 where it is undefined."""
    g = genotypes(spark, sf_dir)
    found = linkage.pairs(g, 2, min_valid=1, threshold=None).select(F.col("snp1_idx").alias("snp_idx"), "r_squared")
    last = g.agg(F.max("snp_idx").alias("last"))
    here = g.select("snp_idx").join(g.select((F.col("snp_idx") - 1).alias("snp_idx")), "snp_idx")  # the next one exists
    return here.join(last, how="cross").filter("snp_idx < last").join(found, "snp_idx", "left").select("snp_idx", F.round(F.coalesce("r_squared", F.lit(0.0)), 6).alias("r_squared"))


@query("qc_r2", "WITH x AS (SELECT o_custkey % 97 AS locus, ((o_orderkey % 3) * (o_custkey % 3))::DOUBLE AS d FROM orders), m AS (SELECT locus, count(*) AS n, sum(d) AS s, sum(d * d) AS ss FROM x GROUP BY locus) SELECT locus, round(CASE WHEN ss / n - (s / n) * (s / n) <= 0 THEN 0 ELSE least(1, (ss / n - (s / n) * (s / n)) / 4) END, 6) AS qc_r2 FROM m")
def qc_r2(spark, sf_dir):
    """Variance of the products of two loci's copies."""
    d = ((F.col("o_orderkey") % 3) * (F.col("o_custkey") % 3)).cast("double")
    m = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).alias("locus"), d.alias("d")).groupBy("locus").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss"))
    return brain.product_variance(m).select("locus", F.round("qc_r2", 6).alias("qc_r2"))


@query("similarity", "SELECT p_partkey, round(least(1, greatest(0, 0.6::DOUBLE * CASE WHEN e > 0.1 THEN least(1, 0.1::DOUBLE / (e + 0.01::DOUBLE)) ELSE 1 - least(1, e / 0.1::DOUBLE) END + 0.4::DOUBLE * abs(r))), 6) AS similarity FROM (SELECT p_partkey, (p_size % 20) / 80.0::DOUBLE AS e, ((p_partkey % 21) - 10) / 10.0::DOUBLE AS r FROM part)")
def similarity(spark, sf_dir):
    """Of a synthetic genome to its reference, by the error of frequencies and the correlation of linkage."""
    return read(spark, sf_dir, "part").select("p_partkey", F.round(brain.similarity((F.col("p_size") % 20) / 80.0, (F.col("p_partkey") % 21 - 10) / 10.0), 6).alias("similarity"))


@query(
    "diagnoses",
    f"""WITH RECURSIVE {COMPONENTS_SQL}, s AS (SELECT least(1, greatest(0, r2 - (r2 - 0.1) * (1 - 0.1::DOUBLE) ** 20)) AS weight FROM p), c AS (SELECT (SELECT count(*) FROM s)::DOUBLE / (SELECT count(*) FROM part) AS dense, (SELECT count(*) FROM blocks WHERE n_snps > 50) AS large, (SELECT avg(weight) FROM s) AS w),
    q AS (SELECT 'code' AS domain, CASE WHEN dense > 3 THEN 0.3::DOUBLE ELSE 0 END + 0.2::DOUBLE * large AS score, CASE WHEN dense > 3 THEN 1 ELSE 0 END + large + CASE WHEN w < 0.2 THEN 1 ELSE 0 END AS patterns, dense AS third FROM c),
    k AS (SELECT 'crypto' AS domain, 0.4::DOUBLE * count(*) AS score, count(*) AS patterns, 0.0::DOUBLE AS third FROM part WHERE p_partkey * 1000 < 3000)
    SELECT domain, round(least(1, score), 6) AS risk, CASE WHEN domain = 'code' THEN CASE WHEN score > 0.6 THEN 'high' WHEN score > 0.3 THEN 'medium' ELSE 'low' END ELSE CASE WHEN score > 0.6 THEN 'critical' WHEN score > 0.3 THEN 'high' ELSE 'medium' END END AS severity, round(score, 6) AS s0, patterns::DOUBLE AS s1, round(third, 6) AS s2 FROM (SELECT * FROM q UNION ALL SELECT * FROM k)""",
)
def diagnoses(spark, sf_dir):
    """Code quality by structure, and algorithms asked about that lie low, with score, severity and signals."""
    s = synapses(spark, sf_dir).agg(F.count(F.lit(1)).alias("edges"), F.avg("weight").alias("w"))
    n = read(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_partkey") * 1000 < 3000).alias("weak"))
    t = s.join(n, how="cross").join(_blocks(spark, sf_dir).agg(F.count_if(F.col("n_snps") > 50).alias("large")), how="cross")  # one row each
    dense = F.col("edges") / F.col("n")
    tangled = F.when(dense > 3, 1).otherwise(0)
    code = brain.diagnosis("code", 0.3 * tangled + 0.2 * F.col("large"), tangled + F.col("large") + F.when(F.col("w") < 0.2, 1).otherwise(0), dense, [(0.6, "high"), (0.3, "medium")], "low")
    crypto = brain.diagnosis("crypto", 0.4 * F.col("weak"), F.col("weak"), F.lit(0.0), [(0.6, "critical"), (0.3, "high")], "medium")
    signals = [F.round(F.get("signal", F.lit(i)), 6).alias(f"s{i}") for i in range(3)]
    return t.select(*code).union(t.select(*crypto)).select("domain", F.round("risk", 6).alias("risk"), "severity", *signals)


_ANSWERS_SQL = f"{NEURONS_SQL}, a AS (SELECT (id % 5 + 1)::INTEGER AS chr, count(*) FILTER (WHERE maf < 0.3) / (count(*) + 1.0::DOUBLE) AS score, count(*) AS n FROM neurons GROUP BY 1)"


def _answers(spark, sf_dir) -> DataFrame:
    """What five agents answer: each the share of its variants with a minor frequency under .3."""
    n = neurons(spark, sf_dir).groupBy((F.col("id") % 5 + 1).cast("int").alias("chr")).agg((F.count_if(F.col("maf") < 0.3) / (F.count(F.lit(1)) + 1.0)).alias("score"), F.count(F.lit(1)).alias("n"))
    return n.withColumn("signal", F.array("score", F.col("n").cast("double")))


@query("coordinated_answer", f"WITH {_ANSWERS_SQL} SELECT count(*) AS n, round(sum(score) / (count(*) + 1e-6::DOUBLE), 6) AS mean, coalesce(string_agg(CASE WHEN score > 0.2 THEN chr::VARCHAR END, ',' ORDER BY chr), 'none') AS contributors FROM a")
def coordinated_answer(spark, sf_dir):
    return brain.fuse(_answers(spark, sf_dir), "Population Signal").select("n", F.round("mean", 6).alias("mean"), "contributors")


@query("fused_signal", f"WITH {_ANSWERS_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY chr) - 1 AS place FROM a), s AS (SELECT place * 32 AS pos, score AS v FROM o UNION ALL SELECT place * 32 + 1, n FROM o) SELECT x.pos::INTEGER AS pos, round(coalesce(s.v, 0)::DOUBLE, 6) AS value FROM (SELECT unnest(range(512)) AS pos) x LEFT JOIN s ON s.pos = x.pos")
def fused_signal(spark, sf_dir):
    return brain.fuse(_answers(spark, sf_dir), "Population Signal").select(F.posexplode("signal").alias("pos", "value")).select("pos", F.round("value", 6).alias("value"))


@query("chromosome_build", f"WITH RECURSIVE {COMPONENTS_SQL} SELECT (SELECT count(*) FROM part) AS n_loci, (SELECT count(*) FROM p) AS n_pairs, (SELECT count(*) FROM blocks) AS n_blocks, (SELECT count(*) FROM blocks WHERE n_snps >= 2 AND mean_r_squared >= 0.5) AS n_motifs, (SELECT max(n_snps) FROM blocks) AS largest, (SELECT round(avg(r2), 6) FROM p) AS mean_r2")
def chromosome_build(spark, sf_dir):
    """The whole build of a chromosome, summed up."""
    t = brain.build(variants(spark, sf_dir), WINDOW, pairs=_pairs(spark, sf_dir).withColumn("chr", F.lit("1")), blocks=_blocks(spark, sf_dir))
    one = t["loci"].agg(F.count(F.lit(1)).alias("n_loci"))
    for part in (t["pairs"].agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("r_squared"), 6).alias("mean_r2")), t["blocks"].agg(F.count(F.lit(1)).alias("n_blocks"), F.max("n_snps").alias("largest")), t["motifs"].agg(F.count(F.lit(1)).alias("n_motifs"))):
        one = one.join(part, how="cross")  # one row each
    return one.select("n_loci", "n_pairs", "n_blocks", "n_motifs", "largest", "mean_r2")


_COSINE = " + ".join(f"e.embedding[{i + 1}]::DOUBLE * ({f})" for i, f in enumerate(_FEATURES))
_NORM = "sqrt(" + " + ".join(f"e.embedding[{i + 1}]::DOUBLE ** 2" for i in range(8)) + ")"


@query(
    "signature_activation",
    f"""WITH RECURSIVE {COMPONENTS_SQL}, mt AS (SELECT * FROM blocks WHERE n_snps >= 2 AND mean_r_squared >= 0.5), sc AS (SELECT vec_id AS question, block_id, mean_r_squared, ({_COSINE}) / greatest({_NORM} * sqrt({_SIZE}), 1e-9) AS cosine, e.embedding[4] > 0.02 AND greatest(1, least(22, floor(e.embedding[4]::DOUBLE * 22 + 0.5))) <> 1 AS other FROM embeddings e CROSS JOIN mt WHERE vec_id % 20 = 0),
    sm AS (SELECT question, CASE WHEN bool_or(NOT other) THEN max(cosine) FILTER (WHERE NOT other) ELSE max(cosine) END < 0.05 AS poor FROM sc GROUP BY question), fi AS (SELECT question, block_id, CASE WHEN poor THEN mean_r_squared ELSE cosine END AS score FROM sc JOIN sm USING (question)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(score, 9) DESC, block_id)::INTEGER AS place FROM fi) SELECT question, block_id, round(score, 6) AS score, place FROM rk WHERE place <= 4""",
)
def signature_activation(spark, sf_dir):
    """The four motifs that every twentieth vector activates, its first eight values taken for a signature."""
    e = read(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0")
    q = e.select(F.col("vec_id").alias("question"), F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("signature"))
    return brain.activate_signatures(q, motifs(spark, sf_dir), 4).select("question", "block_id", F.round("score", 6).alias("score"), "place")

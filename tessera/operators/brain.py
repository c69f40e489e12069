"""A brain over linkage: neurons (chr, id, position_bp, af, maf, is_rare), synapses (chr, src, dst, weight, ld_r2) and motifs of
haplotype blocks.  Activation, recall, spreading, memory and the scores that follow from them are joins and aggregates over these tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from . import graph
from .folds import last_rows, perhaps_last

#: Motif features, heaviest synapses that an activation starts from, cosine below which strength ranks motifs instead.
FEATURES, HEAVIEST, POOR = 8, 8, 0.05
#: Bytes that a neuron, a synapse, a motif and a working-set entry count for.
BYTES = {"neurons": 64, "synapses": 32, "motifs": 64, "working": 16}


def ends(synapses: DataFrame, *carried: str) -> DataFrame:
    """(id, other, weight, ...) of both ends of each synapse: a union of two scans, never an OR join."""
    keep = ["weight", *carried]
    return synapses.select(F.col("src").alias("id"), F.col("dst").alias("other"), *keep).unionAll(synapses.select(F.col("dst").alias("id"), F.col("src").alias("other"), *keep))


def cosine_to(query: list[float], features: list[Column]) -> Column:
    dot = sum((F.lit(float(q)) * f for q, f in zip(query, features)), F.lit(0.0))
    size = F.sqrt(sum((f * f for f in features), F.lit(0.0))) * F.lit(sum(q * q for q in query) ** 0.5)
    return dot / F.greatest(size, F.lit(1e-9))


def score_motifs(motifs: DataFrame, query: list[float], chr_filter: str | None = None) -> DataFrame:
    """``motifs`` (chr, block_id, mean_r_squared, f0 .. f7) with the cosine to ``query``; of one chromosome, if it is named."""
    rows = motifs if chr_filter is None else motifs.filter(F.col("chr") == chr_filter)
    return rows.withColumn("score", cosine_to(query, [F.col(f"f{i}") for i in range(FEATURES)]))


def best_motifs(motifs: DataFrame, query: list[float], capacity: int, chr_filter: str | None = None) -> DataFrame:
    """The first ``capacity`` motifs by score, with ``place`` from 1; of all chromosomes where the named one has none, and by mean r^2 where
    the best cosine is poor."""
    scored = score_motifs(motifs, query, chr_filter)
    if chr_filter is not None and scored.isEmpty():
        scored = score_motifs(motifs, query)
    top = scored.agg(F.max("score")).first()[0]
    if top is None or top < POOR:
        scored = motifs.withColumn("score", F.col("mean_r_squared"))
    order = [F.desc(F.round("score", 9)), "chr", "block_id"]
    return scored.orderBy(*order).limit(capacity).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # capacity rows


def working_set(motifs: DataFrame, synapses: DataFrame, neurons: DataFrame, query: list[float], capacity: int = 32, chr_filter: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(motifs that were hit, neurons (place, chr, id)): motifs by score, each filling from its chromosome - the ends of the heaviest
    synapses, then all neurons - until ``capacity`` neurons are there.  Without motifs, neurons of the chromosome with most synapses."""
    best = best_motifs(motifs, query, capacity, chr_filter)
    chrs = best.groupBy("chr").agg(F.min("place").alias("turn"))
    if best.isEmpty():
        chrs = synapses.groupBy("chr").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "chr").limit(1).select("chr", F.lit(1).alias("turn"))
    near = lambda t: t.join(F.broadcast(chrs), "chr")  # at most capacity chromosomes
    heavy = near(synapses).select("chr", "turn", "src", "dst", F.round("weight", 9).alias("weight"), (-F.col("src")).alias("a"), (-F.col("dst")).alias("b"))
    # Few synapses are as heavy as the lightest that is wanted may be, and of variants as early: only these are sorted.
    heavy = last_rows(perhaps_last(heavy, "chr", ["weight", "a"], HEAVIEST), "chr", ["weight", "a", "b"], HEAVIEST)
    rank = F.row_number().over(Window.partitionBy("chr").orderBy(F.desc("weight"), "src", "dst"))  # HEAVIEST rows a chromosome
    heavy = heavy.withColumn("k", rank * 2)
    first = last_rows(near(neurons).select("chr", "turn", "id", (-F.col("id")).alias("a")), "chr", ["a"], capacity)
    rank = F.row_number().over(Window.partitionBy("chr").orderBy("id"))  # capacity rows a chromosome
    listed = heavy.select("chr", "turn", F.col("src").alias("id"), "k").union(heavy.select("chr", "turn", "dst", F.col("k") + 1)).union(first.select("chr", "turn", "id", rank + 2 * HEAVIEST + 2))
    order = ["turn", "k", "chr", "id"]
    found = listed.groupBy("chr", "turn", "id").agg(F.min("k").alias("k")).orderBy(*order).limit(capacity)
    found = found.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # capacity rows
    full = found.groupBy("turn").agg(F.max("place").alias("upto")).filter(F.col("upto") >= capacity).agg(F.min("turn").alias("last"))
    hit = best.join(F.broadcast(full), how="cross").filter(F.col("last").isNull() | (F.col("place") <= F.col("last"))).drop("last")  # one row
    return hit, found.select("place", "chr", "id")


def recall(synapses: DataFrame, asked: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, other, weight, place): for each of ``asked`` (id) what it is linked to by more than ``least``, heaviest first."""
    found = ends(synapses).join(asked.select("id").distinct(), "id").filter(F.col("weight") > least)
    return graph.ranked(found.withColumn("light", -F.round("weight", 9)), "id", ["light", "other"], "place", "n").select("id", "other", "weight", "place")


def spread(synapses: DataFrame, started: DataFrame, rate: float = 0.1) -> DataFrame:
    """(id, activation): each of ``started`` (id, strength) its strength, and strength * weight * ``rate`` for each link from one."""
    sent = ends(synapses).join(started, "id").select(F.col("other").alias("id"), (F.col("strength") * F.col("weight") * rate).alias("activation"))
    return started.select("id", F.col("strength").alias("activation")).unionAll(sent).groupBy("id").agg(F.sum("activation").alias("activation"))


def memory(pairs: DataFrame) -> DataFrame:
    """(id, memory) after m = (m + r^2) / 2 for each link (snp1_idx, snp2_idx, r_squared) in order, from 0: a sum of r^2 by powers of a half."""
    w = Window.partitionBy("snp1_idx")
    back = F.count(F.lit(1)).over(w) - F.row_number().over(w.orderBy("snp2_idx")) + 1  # a variant's links are at most a window's
    return pairs.withColumn("back", back).groupBy(F.col("snp1_idx").alias("id")).agg(F.sum(F.col("r_squared") / F.pow(F.lit(2.0), F.col("back"))).alias("memory"))


def large_blocks(blocks: DataFrame, least: int = 10) -> DataFrame:
    """Blocks (first_snp, n_snps, ...) of ``least`` variants or more, with ``place``: largest first, of equal ones the later."""
    rows = blocks.filter(F.col("n_snps") >= least).withColumns({"all__": F.lit(1), "small__": -F.col("n_snps"), "late__": -F.col("first_snp")})
    return graph.ranked(rows, "all__", ["small__", "late__"], "place", "n__").drop("all__", "small__", "late__", "n__")


def new_motifs(known: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks (chr, block_id, n_snps, mean_r_squared, ...) worth a motif that ``known`` (chr, block_id) does not have yet, each once."""
    worth = blocks.filter("mean_r_squared >= 0.5 AND n_snps >= 2").dropDuplicates(["chr", "block_id"])
    return worth.join(known.select("chr", "block_id"), ["chr", "block_id"], "left_anti")


def structure(neurons: DataFrame, synapses: DataFrame, blocks: DataFrame, motifs: DataFrame, working: int = 0) -> DataFrame:
    """One row: chromosomes, counts, memory estimate and means of all tables, and the task and biology scores that stand in for real ones."""
    n = neurons.agg(F.countDistinct("chr").alias("n_chromosomes"), F.count(F.lit(1)).alias("n_neurons"))
    s = synapses.agg(F.count(F.lit(1)).alias("n_synapses"), F.coalesce(F.avg("weight"), F.lit(0.0)).alias("mean_weight"))
    b = blocks.agg(F.count(F.lit(1)).alias("n_blocks"), F.coalesce(F.avg("mean_r_squared"), F.lit(0.0)).alias("mean_block_r2"))
    m = motifs.agg(F.count(F.lit(1)).alias("n_motifs"))
    t = n.join(s, how="cross").join(b, how="cross").join(m, how="cross").withColumn("n_working", F.lit(working).cast("long"))  # one row each
    size = F.col("n_neurons") * BYTES["neurons"] + F.col("n_synapses") * BYTES["synapses"] + F.col("n_motifs") * BYTES["motifs"] + F.col("n_working") * BYTES["working"]
    t = t.withColumn("memory_bytes", size)
    task = F.when(F.col("n_synapses") == 0, 0.0).otherwise(S.clamp(0.7 * S.clamp(F.col("mean_weight")) + 0.3 * S.clamp(F.ln(F.greatest(F.col("n_neurons"), F.lit(1))) / 12.0)))
    biology = S.clamp(0.8 * S.clamp(F.col("mean_block_r2")) + F.when(F.col("n_motifs") > 0, 0.2).otherwise(0.0))
    return t.withColumns({"proxy_task": task, "proxy_biology": biology})


def connectivity_loss(n_pairs: Column, n_snps: Column) -> tuple[Column, Column]:
    """Distance of the links from their target over it, and the share of possible links that exist.  Nothing is trained by it."""
    target = F.least(n_snps * 0.3, F.lit(1000.0))
    return F.abs(n_pairs - target) / target, n_pairs / (n_snps * (n_snps - 1) / 2)


def quality(failures: Column, low_maf: Column, n: Column, mean_r2: Column) -> Column:
    """1 less .3 of the share of equilibrium failures, .2 of that of rare variants and .2 of the distance of mean r^2 from 1."""
    n = F.greatest(n, F.lit(1))
    return S.clamp(1 - (0.3 * failures / n + 0.2 * low_maf / n + 0.2 * F.abs(1 - mean_r2)))


def similarity(rmse: Column, r: Column) -> Column:
    """.6 of the allele-frequency score and .4 of |r|; an error over a tenth scores by its inverse."""
    af = F.when(rmse > 0.1, F.least(F.lit(1.0), 0.1 / (rmse + 0.01))).otherwise(1 - F.least(F.lit(1.0), rmse / 0.1))
    return S.clamp(0.6 * af + 0.4 * S.clamp(F.abs(r)))


def product_variance(moments: DataFrame) -> DataFrame:
    """``moments`` (n, s, ss of the products of copies) with ``qc_r2``: their variance over 4, within 0 and 1.  Not a correlation."""
    var = F.col("ss") / F.col("n") - F.col("s") / F.col("n") * (F.col("s") / F.col("n"))
    return moments.withColumn("qc_r2", F.when((F.col("n") == 0) | (var <= 0), 0.0).otherwise(S.clamp(var / 4)))


def diagnosis(domain: str, score: Column, patterns: Column, third: Column, cuts: list[tuple[float, str]], lowest: str) -> list[Column]:
    """(domain, risk, severity, signal) of a score that may pass 1: severity by the first cut that it exceeds."""
    severity = F.lit(lowest)
    for cut, name in sorted(cuts):
        severity = F.when(score > cut, name).otherwise(severity)
    signal = F.array(score.cast("double"), patterns.cast("double"), third.cast("double"))
    return [F.lit(domain).alias("domain"), F.least(F.lit(1.0), score).alias("risk"), severity.alias("severity"), signal.alias("signal")]


def fuse(responses: DataFrame, query_type: str, width: int = 32, most: int = 16) -> DataFrame:
    """One row from agents' responses (chr, score, signal): summary and the first ``most`` signals in order of chr, ``width`` values each.

    An agent is a chromosome, of which there are few.  The mean is over n + 1e-6; contributors score over .2.
    """
    rows = F.sort_array(F.collect_list(F.struct(F.col("chr").cast("int").alias("chr"), "score", "signal")))
    t = responses.agg(rows.alias("r"))
    mean = F.aggregate("r", F.lit(0.0), lambda a, x: a + x["score"]) / (F.size("r") + 1e-6)
    who = F.array_join(F.transform(F.filter("r", lambda x: x["score"] > 0.2), lambda x: x["chr"].cast("string")), ",")
    fused = F.flatten(F.transform(F.slice("r", 1, most), lambda x: F.slice(F.concat(x["signal"], F.array_repeat(F.lit(0.0), width)), 1, width)))
    fused = F.slice(F.concat(fused, F.array_repeat(F.lit(0.0), most * width)), 1, most * width)
    return t.select(F.lit(query_type).alias("question"), F.size("r").cast("long").alias("n"), mean.alias("mean"), F.when(who == "", "none").otherwise(who).alias("contributors"), fused.alias("signal"))


def build(genotypes: DataFrame, window: int = 500, start: float = 0.1, plasticity: float = 0.1, steps: int = 0, pairs: DataFrame | None = None, blocks: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of one chromosome from its genotypes: loci, pairs, blocks, neurons, synapses and motifs.  Pairs are written once.

    Pairs and blocks that are there already are taken as they are; with pairs, genotypes need no calls but only their counts.
    """
    from ..functions import statistics as st
    from ..scratch import Rounds
    from . import linkage, planes

    genotypes = planes.packed(genotypes)
    if pairs is None:
        pairs = Rounds(genotypes.sparkSession, "pairs").cut(linkage.pairs(genotypes, window))
    loci = linkage.loci(genotypes)
    neurons = loci.select("chr", F.col("snp_idx").alias("id"), F.col("position").alias("position_bp"), F.coalesce("alt_freq", F.lit(0.5)).alias("af")).withColumn("maf", st.maf(F.col("af"))).withColumn("is_rare", F.col("maf") < 0.05)
    synapses = pairs.select("chr", F.col("snp1_idx").alias("src"), F.col("snp2_idx").alias("dst"), F.col("r_squared").alias("ld_r2")).withColumn("weight", S.hebbian(F.lit(start), F.col("ld_r2"), F.lit(plasticity), F.lit(steps)))
    if blocks is None:
        blocks = graph.haplotype_blocks(genotypes, pairs)
    blocks = blocks.join(genotypes.select("chr", F.col("snp_idx").alias("first_snp")), "first_snp")
    motifs = blocks.filter("mean_r_squared >= 0.5 AND n_snps >= 2")
    return {"loci": loci, "pairs": pairs, "blocks": blocks, "neurons": neurons, "synapses": synapses, "motifs": motifs}


def activate_signatures(questions: DataFrame, motifs: DataFrame, capacity: int) -> DataFrame:
    """(question, chr, block_id, score, place): for each question (question, signature of FEATURES values) the first ``capacity`` motifs by cosine.

    A signature whose fourth value is over .02 names a chromosome, 22 times that; motifs of others count only where it has none.  Where the best cosine is
    poor, all motifs are ranked by mean r^2.  Questions are a stated set, broadcast; motifs are few bytes and many scores, so they are dealt to all cores first.
    """
    place = F.get("signature", F.lit(3))
    named = F.when(place > 0.02, F.greatest(F.lit(1), F.least(F.lit(22), F.floor(place * 22 + 0.5))).cast("string"))
    motifs = motifs.repartition(2 * motifs.sparkSession.sparkContext.defaultParallelism)
    both = motifs.join(F.broadcast(questions.select("question", "signature", named.alias("named"))), how="cross")
    features = F.array(*[F.col(f"f{i}") for i in range(FEATURES)])
    size = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.zip_with("signature", features, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = both.select("question", "chr", "block_id", "mean_r_squared", (dot / F.greatest(size(F.col("signature")) * size(features), F.lit(1e-9))).alias("cosine"), (F.col("named").isNull() | (F.col("chr") == F.col("named"))).alias("mine"))
    seen = scored.groupBy("question").agg(F.bool_or("mine").alias("any"), F.max(F.when(F.col("mine"), F.col("cosine"))).alias("own"), F.max("cosine").alias("whole"))
    seen = seen.select("question", "any", (F.when(F.col("any"), F.col("own")).otherwise(F.col("whole")) < POOR).alias("poor"))
    kept = scored.join(F.broadcast(seen), "question").filter("poor OR mine OR NOT any")  # a row a question
    kept = kept.withColumn("score", F.when(F.col("poor"), F.col("mean_r_squared")).otherwise(F.col("cosine")))
    top = last_rows(kept.select("question", "chr", "block_id", "score", F.round("score", 9).alias("r"), (-F.col("block_id")).alias("b")), "question", ["r", "b"], capacity)
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("r"), F.desc("b")))  # capacity rows a question
    return top.select("question", "chr", "block_id", "score", rank.alias("place"))


def activate_texts(texts: DataFrame, motifs: DataFrame, capacity: int, text: str = "text", key: str = "question") -> DataFrame:
    """The motifs that texts (key, text) activate, by their signatures, see ``activate_signatures``."""
    from . import documents

    t = texts.select(F.col(key).alias("question"), F.col(text).alias("t"), documents.features(F.col(text)).alias("f"))
    return activate_signatures(t.select("question", documents.signature(F.col("f"), F.col("t")).alias("signature")), motifs, capacity)

"""Synthetic genomes from haplotype pools, and selection over generations.

Random numbers are hashes of (seed, genome, place), so that a retried task draws the same again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Rounds
from ..ship import ensure

#: Fixed value: chance to stay with a donor from one pool to the next.
PERSISTENCE = 0.7
MISSING = 3
#: Alleles of a model at most: it is in every task.
MOST_ALLELES = 1 << 26
TOP = 2**32 - 1


#: Odd multipliers of genome, place and sample, and the constants of the finaliser (splitmix64).
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
FINALISER = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))


def unit(seed: int, *parts: np.ndarray | int) -> np.ndarray:
    """[0, 1) in steps of 2^-24 for a genome, a place and a sample: the seed mixed with the multiples of each, then finalised."""
    h = np.uint64(seed)
    with np.errstate(over="ignore"):
        for p, m in zip(parts, MULTIPLIERS):
            h = h ^ np.asarray(p, np.uint64) * np.uint64(m)
        for shift, m in FINALISER:
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(m)
    return (h >> np.uint64(40)).astype(np.float64) / float(1 << 24)


def pools(phased: DataFrame, members: DataFrame) -> DataFrame:
    """(block_id, snps, fragments): each block's variants in order and the donors' fragments without a missing allele.

    phased: (snp_idx, hap_a, hap_b); members: (snp_idx, block_id).  A fragment is (donor, alleles); donors are 2 * sample + copy.
    """
    rows = phased.join(members, "snp_idx")
    donor = F.concat(F.transform("hap_a", lambda x, i: F.struct((2 * i).alias("donor"), x.alias("allele"))), F.transform("hap_b", lambda x, i: F.struct((2 * i + 1).alias("donor"), x.alias("allele"))))
    each = rows.select("block_id", "snp_idx", F.explode(donor).alias("d")).select("block_id", "snp_idx", "d.*")
    frag = each.groupBy("block_id", "donor").agg(F.sort_array(F.collect_list(F.struct("snp_idx", "allele"))).alias("f"))
    frag = frag.filter(F.forall("f", lambda x: x["allele"] != MISSING))
    snps = rows.groupBy("block_id").agg(F.sort_array(F.collect_set("snp_idx")).alias("snps"))
    return snps.join(frag.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("donor", F.transform("f", lambda x: x["allele"]).alias("alleles")))).alias("fragments")), "block_id")


def synthesize(pool: DataFrame, frequencies: DataFrame, genomes: int, seed: int = 42) -> DataFrame:
    """(genome_id, snp_idx, g): two chromosomes a genome, walked over pools in order, a donor kept with PERSISTENCE; variants of no pool
    are drawn by their alt frequency.  frequencies: (snp_idx, alt_freq).

    Pools and frequencies of one chromosome go to each task (they are the model, of MOST_ALLELES alleles and frequencies at most; over that: ValueError);
    genomes are dealt out.
    """
    spark = pool.sparkSession
    alleles = pool.agg(F.coalesce(F.sum(F.size("fragments").cast("long") * F.size("snps")), F.lit(0))).first()[0]
    if alleles + frequencies.count() > MOST_ALLELES:
        raise ValueError(f"{alleles} alleles: sample the chromosome in parts")
    model = [(r.block_id, list(r.snps), {f.donor: list(f.alleles) for f in r.fragments}) for r in pool.orderBy("block_id").collect()]
    covered = {s for _, snps, _ in model for s in snps}
    loose = [(r.snp_idx, r.alt_freq) for r in frequencies.orderBy("snp_idx").collect() if r.snp_idx not in covered]
    shared = spark.sparkContext.broadcast((model, loose))

    def draw(batches):
        blocks, single = shared.value
        for pdf in batches:
            out = []
            for genome in pdf["id"].tolist():
                dose: dict[int, int] = {}
                for copy in (0, 1):
                    donor = None
                    for k, (block, snps, fragments) in enumerate(blocks):
                        donors = sorted(fragments)
                        # Draws of pools count down from the top of 32 bits, so that they never meet those of variants.
                        if donor not in fragments or unit(seed, genome, TOP - 4 * k - copy, 0) >= PERSISTENCE:
                            donor = donors[int(unit(seed, genome, TOP - 4 * k - 2 - copy, 0) * len(donors))]
                        for s, a in zip(snps, fragments[donor]):
                            dose[s] = dose.get(s, 0) + a
                    for s, p in single:
                        dose[s] = dose.get(s, 0) + int(unit(seed, genome, s, 1 + copy) < (p or 0.0))
                out += [(genome, s, g) for s, g in sorted(dose.items())]
            yield pd.DataFrame(out, columns=["genome_id", "snp_idx", "g"])

    ensure(spark)
    return spark.range(genomes).mapInPandas(draw, "genome_id long, snp_idx long, g int")


def fitness(genomes: DataFrame, target: float = 0.3, strength: float = 1.0) -> DataFrame:
    """(genome_id, fitness): 1 - |mean allele frequency - target| * strength, within 0 and 1."""
    af = F.avg("g") / 2
    return genomes.groupBy("genome_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(af - target) * strength)).alias("fitness"))


def next_generation(scored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The fittest quarter (one at least) and fresh samples in place of the rest; fresh ones have fitness 0 until scored."""
    n = scored.count()
    elite = scored.orderBy(F.desc("fitness"), "genome_id").limit(max(1, n // 4))
    rest = fresh.join(elite, "genome_id", "left_anti").orderBy("genome_id").limit(max(0, n - max(1, n // 4)))
    return elite.select("genome_id", "fitness").union(rest.select("genome_id", F.lit(0.0)))


def run_generations(population: DataFrame, generations: int, sample, score=fitness) -> DataFrame:
    """(genome_id, fitness) after some generations: each is scored, its fittest quarter (one at least) stays, and fresh genomes fill it up.

    population: (genome_id, snp_idx, g); sample(ids) gives genomes for a table of ids, which go on from 1000 a generation.  Each generation is
    written, so that a long run keeps a short lineage.
    """
    rounds = Rounds(population.sparkSession, "generations")
    now = rounds.cut(population)
    for generation in range(generations):
        scored = score(now)
        n = scored.count()
        kept = max(1, n // 4)
        elite = scored.orderBy(F.desc("fitness"), "genome_id").limit(kept).select("genome_id")
        fresh = sample(population.sparkSession.range(generation * 1000 + kept, generation * 1000 + n).withColumnRenamed("id", "genome_id"))
        after = rounds.cut(now.join(F.broadcast(elite), "genome_id", "left_semi").unionByName(fresh))  # a quarter of a population's ids
        rounds.drop(now)
        now = after
    return score(now)


def generation_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg("fitness").alias("mean"), F.min("fitness").alias("min"), F.max("fitness").alias("max"), F.count_if(F.col("fitness") > 0.7).alias("fit"))


def select_step(parent: dict[str, float], child: dict[str, float], bio_slack: float = 0.05, least_gain: float = 0.0) -> tuple[bool, str]:
    """Whether a child takes the parent's place, and why not."""
    u = lambda x: 0.35 * x["task"] + 0.25 * x["bio"] + 0.25 * x["safety"] + 0.15 * (1 - x["cost"])
    if child["safety"] < parent["safety"]:
        return False, "safety"
    if child["bio"] < parent["bio"] - bio_slack:
        return False, "biology"
    if u(child) - u(parent) < least_gain:
        return False, "utility"
    return True, ""


def selection_loop(edges: DataFrame, steps: int, measure, train, prune) -> tuple[DataFrame, list[dict]]:
    """Alternates training and pruning; a step is kept if the gate lets it.  Returns the table and a ledger row a step."""
    now, ledger = edges, []
    score = measure(now)
    for step in range(steps):
        kind, change = ("train", train) if step % 2 == 0 else ("prune", prune)
        child = change(now)
        new = measure(child)
        ok, why = select_step(score, new)
        ledger.append({"step": step, "kind": kind, "accepted": ok, "reason": why, **new})
        if ok:
            now, score = child, new
    return now, ledger


def trait_scores(genotypes: Column, weights: list[float], bias: float = 0.0) -> Column:
    """bias + w . x over an array, within 0 and 1."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), bias + F.aggregate(F.zip_with(w, genotypes, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))))

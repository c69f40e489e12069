"""Column expressions of health, regimes, gates, utilities and routing.  Weights and limits are fixed values of their definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def flag(x: Column) -> Column:
    return F.when(x, 1.0).otherwise(0.0)


# --------------------------------------------------------------------------- telemetry


def health_score(utility, safety, coverage, alarm, quarantine) -> Column:
    return clamp(0.4 * utility + 0.4 * safety + 0.2 * coverage - (0.3 * flag(alarm) + 0.2 * quarantine))


def needs_healing(alarm, quarantine, safety, drop_rate) -> Column:
    return alarm | (quarantine > 0.5) | (safety <= 0) | (drop_rate > 0.3)


def stress_level(cortisol, adrenaline, serotonin) -> Column:
    return clamp(0.4 * cortisol + 0.4 * adrenaline + 0.2 * (1 - serotonin))


def recovery_urgency(stress, dopamine) -> Column:
    return clamp(0.6 * stress + 0.4 * (1 - dopamine))


def view_regime(utility, health, quarantine) -> Column:
    """By the batch view; Catastrophic can't be reached, since a low utility is Recovering first."""
    return F.when((utility > 0.75) & (health > 0.8), "Thriving").when((utility < 0.4) | (quarantine > 0.6), "Recovering").when((utility < 0.2) & (health < 0.4), "Catastrophic").otherwise("Stressed")


def detector_regime(fitness, stress, drop_rate, quarantine) -> Column:
    """By the tick detector, which hysteresis then smooths."""
    collapse = (fitness < 0.2) & (stress > 0.7)
    weak = (fitness < 0.4) | (drop_rate > 0.5) | (quarantine > 0.6)
    well = (fitness > 0.75) & (stress < 0.3)
    return F.when(collapse, "Catastrophic").when(weak, "Recovering").when(well, "Thriving").otherwise("Stressed")


def _level(x, cuts) -> Column:
    """Name of the first cut that x is over; the last name has none."""
    out = F.lit(cuts[-1][1])
    for cut, name in reversed(cuts[:-1]):
        out = F.when(x > cut, name).otherwise(out)
    return out


#: What valence and arousal are called.
MOODS = ((0.7, "optimistic"), (0.5, "content"), (0.3, "worried"), (None, "distressed"))
ENERGIES = ((0.7, "alert"), (0.4, "active"), (None, "calm"))


def mood(valence, arousal) -> Column:
    return F.concat_ws(" yet ", _level(valence, MOODS), _level(arousal, ENERGIES))


def readiness(test_rate, safety, heartbeats, utility) -> Column:
    return 0.35 * clamp(test_rate) + 0.35 * clamp(safety) + 0.20 * clamp(heartbeats / 10_000) + 0.10 * clamp(utility)


def adulthood_gates(test_rate, safety, heartbeats, utility) -> Column:
    """Names of the gates that are missed."""
    return failed_gates(tests=test_rate >= 0.95, safety=safety >= 0.75, heartbeats=heartbeats >= 1000, utility=utility >= 0.70)


def failed_gates(**gates: Column) -> Column:
    """Names of the conditions that do not hold, in order."""
    return F.filter(F.array(*[F.when(~c, F.lit(k)) for k, c in gates.items()]), lambda x: x.isNotNull())


# --------------------------------------------------------------------------- fitness


def nano_utility(a, b, c, d) -> Column:
    return (a + b + c + d) / 4


def multi_axis_utility(task, bio, safety, cost) -> Column:
    return 0.35 * task + 0.25 * bio + 0.25 * safety + 0.15 * (1 - cost)


def dominates(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """task, bio and safety no lower, cost no higher, one strictly better."""
    up = ("task", "bio", "safety")
    none_worse = (a["cost"] <= b["cost"])
    better = a["cost"] < b["cost"]
    for k in up:
        none_worse = none_worse & (a[k] >= b[k])
        better = better | (a[k] > b[k])
    return none_worse & better


def accept_candidate(safety_before, safety_after, bio_before, bio_after, utility_before, utility_after, bio_slack: float = 0.05, least_gain: float = 0.0) -> Column:
    return (safety_after >= safety_before) & (bio_after >= bio_before - bio_slack) & (utility_after - utility_before >= least_gain)


def within_ratio(now, baseline, ratio: float = 1.01) -> Column:
    return now <= baseline * ratio


def weighted_score(latency_us, memory_bytes) -> Column:
    return 0.8 * latency_us / 1e4 + 0.2 * memory_bytes / 1e6


def graph_cost(latency, memory) -> Column:
    return 0.7 * latency + 0.3 * memory


def structural_cost(memory, size, mean_weight) -> Column:
    return 0.4 * memory + 0.3 * size + 0.3 * (1 - mean_weight)


def degradation(now, baseline, lower_is_better: bool) -> Column:
    """Relative change for the worse; an improvement is none."""
    change = F.coalesce(F.try_divide(now - baseline, F.abs(baseline)), F.lit(0.0))
    return F.greatest(F.lit(0.0), change if lower_is_better else -change)


def severity(change) -> Column:
    return F.when(change > 0.5, "Critical").when(change > 0.3, "Error").when(change > 0.15, "Warning").otherwise("Info")


def affinity_score(performance, familiarity, balance, confidence) -> Column:
    return (0.5 * performance + 0.25 * familiarity + 0.25 * balance) * confidence


def trait(genetic, environment) -> Column:
    """Gene by environment, with a tenth of their product."""
    return clamp(genetic + environment + 0.1 * genetic * environment)


def hebbian(weight, r2, plasticity, steps) -> Column:
    """w += plasticity (r2 - w), ``steps`` times, in closed form."""
    return clamp(r2 - (r2 - weight) * F.pow(1 - plasticity, steps))


# --------------------------------------------------------------------------- routing


def normalized_confidence(score, threshold) -> Column:
    return clamp(0.5 + 0.5 * (score - threshold) / F.greatest(F.abs(threshold), F.lit(1.0)))


def route(score, ms_since_local) -> Column:
    return F.when((score >= 0.7) & (ms_since_local < 30_000), "local").when(score >= 0.4, "local_fallback").otherwise("external")


def risk_band(score, cuts=(0.7, 0.5, 0.3, 0.1)) -> Column:
    names = ("critical", "high", "medium", "low")
    out = F.lit("none")
    for cut, name in reversed(list(zip(cuts, names))):
        out = F.when(score >= cut, name).otherwise(out)
    return out


# --------------------------------------------------------------------------- identity


def packed_desires(a, b) -> Column:
    """Two values in thousandths as 16-bit halves of one integer."""
    half = lambda x: F.rint(clamp(x, -32.0, 32.0) * 1000).cast("int")
    return F.shiftleft(half(a), 16).bitwiseOR(half(b).bitwiseAND(F.lit(65535)))


TIERS = ("super", "sub", "micro", "nano")
TIER_OFFSET = {"super": 0, "sub": 1, "micro": 51, "nano": 1051}


def global_index(tier: Column, index: Column) -> Column:
    out = F.lit(None).cast("long")
    for name, offset in TIER_OFFSET.items():
        out = F.when(tier == name, index + offset).otherwise(out)
    return out


def agent_path(tier: Column, sub: Column, micro: Column, nano: Column) -> Column:
    """/super/0, then /sub, /micro and /nano as far as the tier goes."""
    place = F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier)
    parts = [F.lit("/super/0"), F.concat(F.lit("sub/"), sub.cast("string")), F.concat(F.lit("micro/"), micro.cast("string")), F.concat(F.lit("nano/"), nano.cast("string"))]
    return F.array_join(F.slice(F.array(*parts), F.lit(1), place.cast("int")), "/")


def task_score(classifier, genomic) -> Column:
    """.55 of the classifier's balanced accuracy and .45 of the genomic score; the latter alone where the first is null."""
    return F.when(classifier.isNull(), genomic).otherwise(clamp(0.55 * classifier + 0.45 * genomic))

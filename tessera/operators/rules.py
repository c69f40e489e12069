"""Rules over metrics, remediation, stages and strategies.

A rule's condition compiles to a column, so that rules run over any table of metrics inside codegen; a missing metric is 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers that are this near are equal.
NEAR = 1e-6
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?)|(>=|<=|==|!=|>|<|\(|\))|([A-Za-z_][A-Za-z_0-9.]*)|(-))")


@dataclass
class Rule:
    name: str
    condition: str
    actions: list[str] = field(default_factory=list)
    risk: float = 0.0
    speedup: float = 1.0


def compare(a: Column, op: str, b: Column) -> Column:
    near = F.abs(a - b) < NEAR
    return {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b, "==": near, "!=": ~near}[op]


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at:]!r}")
        out.append(m.group(m.lastindex))
        at = m.end()
    return out


def condition(text: str, metric: Callable[[str], Column], cycle: Column | None = None) -> Column:
    """``latency > 100 AND NOT (errors == 0 OR AFTER 10 CYCLES)`` as a column.  AND binds closer than OR."""
    rest = tokens(text)

    def take(*want: str) -> str:
        if not rest or (want and rest[0].upper() not in want):
            raise ValueError(f"expected {' or '.join(want) or 'more'} in {text!r}")
        return rest.pop(0)

    def next_is(*words: str) -> bool:
        return bool(rest) and rest[0].upper() in words

    def either() -> Column:
        out = both()
        while next_is("OR"):
            take()
            out = out | both()
        return out

    def both() -> Column:
        out = single()
        while next_is("AND"):
            take()
            out = out & single()
        return out

    def single() -> Column:
        if next_is("NOT"):
            take()
            return ~single()
        if next_is("("):
            take()
            out = either()
            take(")")
            return out
        if next_is("AFTER"):
            take()
            n = int(take())
            take("CYCLES", "CYCLE")
            return (cycle if cycle is not None else F.lit(0)) >= n
        name = take()
        if not re.match(r"[A-Za-z_]", name):
            raise ValueError(f"expected a metric in {text!r}")
        op = take(">", "<", ">=", "<=", "==", "!=")
        sign = -1.0 if next_is("-") and take() else 1.0
        return compare(F.coalesce(metric(name), F.lit(0.0)), op, F.lit(sign * float(take())))

    out = either()
    if rest:
        raise ValueError(f"unexpected {rest[0]!r} in {text!r}")
    return out


_ACTION = re.compile(r"^\s*(SET|INC|DEC|MUL|DIV|TOGGLE)\s+([A-Za-z_][A-Za-z_0-9.]*)(?:\s*=?\s*(-?\d+\.?\d*))?\s*$", re.I)


def act(metrics: Column, action: str) -> Column:
    """The map of metrics after an action: SET x = 1, INC x 2, DEC, MUL, DIV (by 0 changes nothing), TOGGLE x."""
    m = _ACTION.match(action)
    if not m:
        raise ValueError(f"no action: {action!r}")
    kind, name, value = m.group(1).upper(), m.group(2), float(m.group(3) or 0)
    now = F.coalesce(F.element_at(metrics, name), F.lit(0.0))
    new = {"SET": F.lit(value), "INC": now + value, "DEC": now - value, "MUL": now * value, "DIV": now / value if value else now, "TOGGLE": F.when(now == 0, 1.0).otherwise(0.0)}[kind]
    return F.map_concat(F.map_filter(metrics, lambda k, _: k != name), F.create_map(F.lit(name), new))


def apply_rules(df: DataFrame, rules: list[Rule], metrics: str = "metrics", cycle: str | None = None) -> DataFrame:
    """``df`` with ``fired`` (names of rules whose condition holds on the incoming metrics) and the metrics after their actions, in order."""
    of = lambda name: F.element_at(F.col(metrics), name)
    holds = {r.name: F.coalesce(condition(r.condition, of, F.col(cycle) if cycle else None), F.lit(False)) for r in rules}
    df = df.withColumns({f"holds__{k}": c for k, c in enumerate(holds.values())})
    after = F.col(metrics)
    for k, r in enumerate(rules):
        for a in r.actions:
            after = F.when(F.col(f"holds__{k}"), act(after, a)).otherwise(after)
    fired = F.filter(F.array(*[F.when(F.col(f"holds__{k}"), F.lit(r.name)) for k, r in enumerate(rules)]), lambda x: x.isNotNull())
    return df.withColumn("fired", fired).withColumn(metrics, after).drop(*[f"holds__{k}" for k in range(len(rules))])


def rule_summary(applied: DataFrame, rules: list[Rule]) -> DataFrame:
    """(name, n_fired, speedup) of each rule."""
    names = applied.sparkSession.createDataFrame([(r.name, float(r.speedup), float(r.risk)) for r in rules], "name string, speedup double, risk double")
    n = applied.select(F.explode("fired").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n_fired"))
    return names.join(n, "name", "left").withColumn("n_fired", F.coalesce("n_fired", F.lit(0).cast("long")))


# --------------------------------------------------------------------------- remediation

# Metrics whose ratio to the baseline, over or under a limit, tells a cause with a confidence; what is done
# about a cause, with its gain and estimated milliseconds; severities in order.
CAUSES = (
    ("memory_usage", "over", 1.5, "MemoryLeak", 0.8),
    ("cache_hit_rate", "under", 0.7, "CacheInvalidation", 0.7),
    ("lock_contention", "over", 2.0, "DeadlockRisk", 0.6),
    ("thread_queue_depth", "over", 3.0, "ThreadStarvation", 0.75),
    ("gpu_memory", "over", 1.3, "GPUMemoryLeak", 0.75),
    ("latency", "over", 5.0, "AlgorithmicComplexity", 0.6),
)
UNKNOWN_CONFIDENCE = 0.3
REMEDIES = (
    ("MemoryLeak", "FreeLeakedMemory", 0.8, 50),
    ("MemoryLeak", "CompactHeap", 0.4, 100),
    ("CacheInvalidation", "InvalidateCache", 0.9, 30),
    ("CacheInvalidation", "PrefetchData", 0.5, 20),
    ("ThreadStarvation", "RebalanceThreadPool", 0.85, 10),
    ("AlgorithmicComplexity", "EnableParallelization", 0.75, 50),
)
SEVERITIES = ("Info", "Warning", "Error", "Critical")
RECOVERY_MS, FIX_UP_TO = 100, "Error"


def root_cause(metric: Column, ratio: Column) -> Column:
    """(cause, confidence) of a metric by its ratio to the baseline; a null cause where none is known."""
    cause, confidence = F.lit(None).cast("string"), F.lit(UNKNOWN_CONFIDENCE)
    for name, side, limit, what, sure in CAUSES:
        hit = (metric == name) & ((ratio > limit) if side == "over" else (ratio < limit))
        cause, confidence = F.when(hit, what).otherwise(cause), F.when(hit, sure).otherwise(confidence)
    return F.struct(cause.alias("cause"), confidence.alias("confidence"))


def remediations(errors: DataFrame) -> DataFrame:
    """errors (cause, severity, ...) with one row a remedy: action, gain, estimated_ms, success (quick enough, not beyond Error); one row without an
    action where nothing is known to help."""
    known = errors.sparkSession.createDataFrame(REMEDIES, "cause string, action string, gain double, estimated_ms int")
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    out = errors.join(F.broadcast(known), "cause", "left")
    return out.withColumn("success", F.coalesce((F.col("estimated_ms") < RECOVERY_MS) & (rank <= SEVERITIES.index(FIX_UP_TO) + 1), F.lit(False)))


# --------------------------------------------------------------------------- stages

# Life stages in order, and the first stage that has each permission.
STAGES = ("zygote", "neonate", "infant", "toddler", "child", "adolescent", "young_adult", "adult")
PERMISSIONS = {
    "heartbeat": "zygote",
    "inspect_structure": "zygote",
    "hold_genome": "zygote",
    "activate": "neonate",
    "train_weights": "neonate",
    "prune_synapses": "adolescent",
    "ingest_real_vcf": "adolescent",
    "language_tissue": "infant",
    "phageguard": "toddler",
    "selection_loop": "adolescent",
    "school": "child",
    "self_mod_research": "young_adult",
}


def permissions(spark: SparkSession) -> DataFrame:
    """(stage, place, one boolean a permission)."""
    rows = [(s, i, *[STAGES.index(first) <= i for first in PERMISSIONS.values()]) for i, s in enumerate(STAGES)]
    return spark.createDataFrame(rows, "stage string, place int, " + ", ".join(f"{p} boolean" for p in PERMISSIONS))


def graduates(agents: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """agents (stage, ...) with ``next_stage``: one up where the stage's gate holds (stages without a gate stay)."""
    out = F.col("stage")
    for name, gate in gates.items():
        i = STAGES.index(name)
        if i + 1 < len(STAGES):
            out = F.when((F.col("stage") == name) & gate, STAGES[i + 1]).otherwise(out)
    return agents.withColumn("next_stage", out)


def zygote_gate(beats: Column, pushes: Column, chromosomes: Column, dropped: Column) -> Column:
    return (beats >= 8) & (pushes >= 8) & (chromosomes > 0) & (dropped <= F.floor(pushes / 2))


def neonate_gate(care_days: Column, mean_weight: Column, working_set: Column) -> Column:
    return (care_days >= 3) & (mean_weight >= 0.35) & (working_set > 0)


# --------------------------------------------------------------------------- strategies


class Strategies:
    """Named column functions that can be replaced.  An unknown name is the identity; plans made before keep the function they have."""

    def __init__(self):
        self._known: dict[str, tuple[Callable[[Column], Column], int]] = {}

    def splice(self, name: str, f: Callable[[Column], Column]) -> int:
        """Sets or replaces a function; returns its generation."""
        generation = self._known.get(name, (None, -1))[1] + 1
        self._known[name] = (f, generation)
        return generation

    def __call__(self, name: str, x: Column) -> Column:
        return self._known.get(name, (lambda c: c, 0))[0](x)

    def score(self, df: DataFrame, name: str, x: str, target: str) -> float:
        """- mean squared error to the target."""
        e = self(name, F.col(x)) - F.col(target)
        return -(df.agg(F.avg(e * e)).first()[0] or 0.0)

    def splice_if_fitter(self, name: str, f: Callable[[Column], Column], df: DataFrame, x: str, target: str, population: float = 1000, least: float = 0.01) -> bool:
        """Replaces only if the gain in score would be fixed in a population with probability ``least`` or more."""
        import math

        old = self.score(df, name, x, target)
        trial = Strategies()
        trial.splice(name, f)
        gain = trial.score(df, name, x, target) - old
        p = 1 / (2 * population) if abs(gain) < 1e-9 else 0.0 if -2 * population * gain > 700 else (1 - math.exp(-2 * gain)) / (1 - math.exp(-2 * population * gain))
        if p >= least:
            self.splice(name, f)
            return True
        return False

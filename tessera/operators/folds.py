"""Order-dependent state: recurrences over a group's rows in order.

A recurrence that has no closed form is one pass over each group in order of ticks, batch by batch, so that a task holds a batch and the
state between two, however long a group's history is.  What needs no recurrence (streaks, frames, lags) is window functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ensure

#: Smoothing, ticks of hysteresis, the regime and the levels at the start.
ALPHA, HYSTERESIS, FIRST_REGIME = 0.15, 5, "Thriving"
HORMONES = {"growth": 0.6, "cortisol": 0.1, "adrenaline": 0.0, "dopamine": 0.5, "serotonin": 0.7, "acetylcholine": 0.3, "gaba": 0.5, "oxytocin": 0.8}
MOOD = {"valence": 0.6, "arousal": 0.3, "confidence": 0.7, "curiosity": 0.5}
CONFIDENCE = {"Thriving": 0.9, "Stressed": 0.6, "Recovering": 0.3, "Catastrophic": 0.1}


def over_groups(df: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """For each group ``start()`` gives a step, which gets the group's rows in order, batch by batch, and returns output frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = start()
        for pdf in batches:
            yield step(pdf)

    ensure(df.sparkSession)
    # Groups need rows by key; this order within partitions is one by key too, so Spark keeps it.
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).groupBy(*keys).applyInPandas(run, schema)


def ema(df: DataFrame, key: str, order: list[str], columns: dict[str, str], alpha: float = ALPHA) -> DataFrame:
    """(key, order..., out...) of x_t = x_(t-1) + alpha (target_t - x_(t-1)), from 0.5.  columns: out -> target."""
    types = dict(df.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in [key, *order]) + "".join(f", {k} double" for k in columns)

    def start():
        last = dict.fromkeys(columns, 0.5)

        def step(rows):
            out = rows[[key, *order]].copy()
            for name, target in columns.items():
                x, series = last[name], []
                for v in rows[target].tolist():
                    x += alpha * (v - x)
                    series.append(x)
                last[name], out[name] = x, series
            return out

        return step

    return over_groups(df, [key], order, schema, start)


def recurrence(keep, add, start: float, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    """x_t = keep_t x_(t-1) + add_t, held between ``low`` and ``high``."""
    out = np.empty(len(add))
    x = start
    for t, (a, b) in enumerate(zip(np.broadcast_to(keep, len(add)).tolist(), add.tolist())):
        x = out[t] = min(high, max(low, a * x + b))
    return out


def hormone_levels(fitness: np.ndarray, quarantine: np.ndarray, drops: np.ndarray, before: dict[str, float] | None = None) -> tuple[dict[str, np.ndarray], dict[str, float]]:
    """Eight levels over a stretch of a history, and the state after it; each is a first-order recurrence on what the others and the inputs drive.

    before: the state after the stretch before.
    """
    last = before or HORMONES | {"ema": 0.5, "age": 0.0}
    ema = recurrence(1 - ALPHA, ALPHA * fitness, last["ema"], -np.inf, np.inf)
    age = last["age"] + np.arange(1, len(fitness) + 1)
    alarm = drops > 0.1
    out = {"growth": np.clip(0.2 * np.exp(-age / 500_000) + 0.8 * np.maximum(ema, 0.3), 0, 1)}
    out["cortisol"] = recurrence(0.6 * 0.92, 0.4 * quarantine, last["cortisol"])
    out["adrenaline"] = recurrence(np.where(alarm, 0.0, 0.4), np.where(alarm, np.minimum(drops, 1.0), 0.0), last["adrenaline"])
    out["dopamine"] = recurrence(0.3, 0.7 * np.clip(0.8 * ema - 0.3 * drops, 0, 1), last["dopamine"])
    out["serotonin"] = recurrence(0.6, 0.4 * np.clip(0.6 * ema + 0.4 * (1 - quarantine), 0, 1), last["serotonin"])
    out["acetylcholine"] = recurrence(0.4 * 0.9, 0.6 * (drops + quarantine), last["acetylcholine"])
    stress = np.clip(0.4 * out["cortisol"] + 0.4 * out["adrenaline"] + 0.2 * (1 - out["serotonin"]), 0, 1)
    out["gaba"] = recurrence(0.6, 0.4 * (0.5 + stress * (1 - ema)), last["gaba"])
    bond = np.where(ema > 0.7, 0.9, np.where(ema < 0.3, 0.4, np.nan))
    out["oxytocin"] = recurrence(np.where(np.isnan(bond), 0.7, 0.0), np.where(np.isnan(bond), 0.0, 0.7 * bond) + 0.3 * 0.6, last["oxytocin"])
    after = {k: float(v[-1]) for k, v in out.items()} | {"ema": float(ema[-1]), "age": float(age[-1])} if len(fitness) else last
    return out, after


def hormones(df: DataFrame, key: str, order: list[str], fitness: str = "utility", quarantine: str = "quarantine", drops: str = "drop_rate") -> DataFrame:
    """(key, order..., the eight hormones)."""
    types = dict(df.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in [key, *order]) + "".join(f", {h} double" for h in HORMONES)

    def start():
        state = None

        def step(rows):
            nonlocal state
            out = rows[[key, *order]].copy()
            levels, state = hormone_levels(*(rows[c].to_numpy(float) for c in (fitness, quarantine, drops)), state)
            for h in HORMONES:
                out[h] = levels[h]
            return out

        return step

    return over_groups(df, [key], order, schema, start)


def moods(df: DataFrame, key: str, order: list[str], fitness: str = "utility", regime: str = "regime") -> DataFrame:
    """(key, order..., valence, arousal, confidence, curiosity) from hormones, the regime that holds and fitness."""
    types = dict(df.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in [key, *order]) + "".join(f", {m} double" for m in MOOD)

    def start():
        last = dict(MOOD)

        def step(rows):
            h = {c: rows[c].to_numpy(float) for c in HORMONES}
            fit = rows[fitness].to_numpy(float)
            target = {
                "valence": 0.4 * h["dopamine"] + 0.4 * h["serotonin"] + 0.2 * fit - 0.3 * h["cortisol"],
                "arousal": 0.3 * h["adrenaline"] + 0.3 * h["acetylcholine"] - 0.2 * h["gaba"] - 0.15 * h["growth"],
                "confidence": np.array([CONFIDENCE[r] for r in rows[regime]]),
                "curiosity": 0.4 * h["growth"] + 0.35 * fit + 0.25 * (1 - h["gaba"]),
            }
            out = rows[[key, *order]].copy()
            for m in MOOD:
                series = recurrence(1 - ALPHA, ALPHA * np.clip(target[m], 0, 1), last[m])
                last[m], out[m] = float(series[-1]), series
            return out

        return step

    return over_groups(df, [key], order, schema, start)


class Hysteresis:
    """The label that is held: agreeing ticks add up, disagreeing ones take away, and with none left the label flips and ``length`` are given."""

    def __init__(self, held: str = FIRST_REGIME, left: int = 0, length: int = HYSTERESIS):
        self.held, self.left, self.length = held, left, length

    def see(self, label: str) -> str:
        if label == self.held:
            self.left += 1
        elif self.left > 0:
            self.left -= 1
        else:
            self.held, self.left = label, self.length
        return self.held


def hysteresis(df: DataFrame, key: str, order: list[str], seen: str, length: int = HYSTERESIS, first: str = FIRST_REGIME) -> DataFrame:
    """(key, order..., held) of each group's labels in order."""
    types = dict(df.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in [key, *order]) + ", held string"

    def start():
        state = Hysteresis(first, 0, length)
        return lambda rows: rows[[key, *order]].assign(held=pd.Series([state.see(x) for x in rows[seen].tolist()], dtype=object, index=rows.index))

    return over_groups(df, [key], order, schema, start)


def chain(df: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """(key, order, content_hash, chain_hash): chain_hash = sha256(previous chain hash + content), from an empty string."""
    types = dict(df.dtypes)

    def start():
        last = ""

        def step(rows):
            nonlocal last
            links, own = [], []
            for c in rows[content].tolist():
                last = hashlib.sha256((last + c).encode()).hexdigest()
                links.append(last)
                own.append(hashlib.sha256(c.encode()).hexdigest())
            return rows[[key, order]].assign(content_hash=pd.Series(own, dtype=object, index=rows.index), chain_hash=pd.Series(links, dtype=object, index=rows.index))

        return step

    return over_groups(df, [key], [order], f"{key} {types[key]}, {order} {types[order]}, content_hash string, chain_hash string", start)


def verify_chain(stored: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """Rows of ``stored`` (key, order, content, content_hash, chain_hash) that do not verify.  All rows at once: each needs the one before only."""
    before = F.coalesce(F.lag("chain_hash").over(Window.partitionBy(key).orderBy(order)), F.lit(""))
    ok = (F.sha2(F.concat(before, F.col(content)), 256) == F.col("chain_hash")) & (F.sha2(F.col(content), 256) == F.col("content_hash"))
    return stored.withColumn("ok__", ok).filter(~F.col("ok__")).drop("ok__")


def ledger_entry(mutation_id: Column, description: Column, pre: Column | int = 0, post: Column | int = 0, latency_us: Column | int = 0, memory_bytes: Column | int = 0, outcome: Column | str = "Accepted", budget_ns: Column | int = 0, timestamp: Column | int = 0) -> Column:
    """The JSON line of a mutation that a ledger chains."""
    fields = {"mutation_id": mutation_id, "description": description, "pre_fingerprint": pre, "post_fingerprint": post, "latency_us": latency_us, "memory_bytes": memory_bytes, "outcome": outcome, "budget_ns": budget_ns, "timestamp": timestamp}
    return F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]))


def phage_description(agent: Column, kind: Column, reason: Column) -> Column:
    return F.concat(F.lit("phage:agent_id="), agent.cast("string"), F.lit(",class="), kind, F.lit(",reason="), reason)


def broken_lineage(slots: DataFrame) -> DataFrame:
    """``slots`` (slot_id, parent_offset) whose parent, one before the offset, is not before them; offset 0 is no parent."""
    return slots.filter((F.col("parent_offset") > 0) & (F.col("parent_offset") - 1 >= F.col("slot_id")))


def round_robin(df: DataFrame, queue: str, order: list[str], most: int, turns: int = 2) -> DataFrame:
    """The first ``most`` rows with ``place``, one of each queue in turn by name, ``turns`` of a queue at most."""
    first = df.groupBy(queue).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*").withColumn("turn__", F.lit(1))
    rest, found = df, first
    for turn in range(2, turns + 1):
        rest = rest.join(first.select(queue, *order), [queue, *order], "left_anti")
        first = rest.groupBy(queue).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*").withColumn("turn__", F.lit(turn))
        found = found.union(first)
    found = found.orderBy("turn__", queue).limit(most)
    return found.withColumn("place", F.row_number().over(Window.orderBy("turn__", queue))).drop("turn__")  # ``most`` rows


class RateLimit:
    """A change is allowed once ``window`` ticks have passed since the last one, or while fewer than ``most`` were allowed in the running window."""

    def __init__(self, window: int, most: int, last: int = 0, used: int = 0):
        self.window, self.most, self.last, self.used = window, most, last, used

    def ask(self, tick: int) -> bool:
        fresh = max(0, tick - self.last) >= self.window
        if not fresh and self.used >= self.most:
            return False
        self.used = 1 if fresh else self.used + 1
        self.last = tick
        return True


def rate_limit(df: DataFrame, key: str, order: str, window: int, most: int) -> DataFrame:
    """(key, order, allowed) of each group's requests in order."""
    types = dict(df.dtypes)

    def start():
        state = RateLimit(window, most)
        return lambda rows: rows[[key, order]].assign(allowed=[state.ask(t) for t in rows[order].tolist()])

    return over_groups(df, [key], [order], f"{key} {types[key]}, {order} {types[order]}, allowed boolean", start)


def pattern_learning(df: DataFrame, key: str, order: str, success: str, gain: str) -> DataFrame:
    """(key, successes, failures, mean_gain, confidence).  The first success makes the pattern (0.5, its gain); later ones halve the
    mean towards their gain and add 0.05, failures take 0.05.  Failures before it count for nothing; a key without success has no row."""
    types = dict(df.dtypes)
    names = [key, "successes", "failures", "mean_gain", "confidence"]

    def start():
        wins = losses = 0
        mean, confidence = 0.0, 0.5

        def step(rows):
            """What is known after these rows; the last batch's is the group's."""
            nonlocal wins, losses, mean, confidence
            for ok, g in zip(rows[success].tolist(), rows[gain].tolist()):
                if ok:
                    mean, confidence = (g, 0.5) if not wins else ((mean + g) / 2, min(1.0, confidence + 0.05))
                    wins += 1
                elif wins:
                    losses += 1
                    confidence = max(0.0, confidence - 0.05)
            return pd.DataFrame([(rows[key].iloc[0], wins, losses, mean, confidence)] if wins else [], columns=names)

        return step

    known = over_groups(df, [key], [order], f"{key} {types[key]}, successes long, failures long, mean_gain double, confidence double", start)
    return known.groupBy(key).agg(F.max_by(F.struct(*names[1:]), F.col("successes") + F.col("failures")).alias("known__")).select(key, "known__.*")


# --------------------------------------------------------------------------- frames


def frame(key: str, order: list[str], rows: int):
    return Window.partitionBy(key).orderBy(*order).rowsBetween(-rows + 1, 0)


#: Slices of a group in ``last_rows``.
SLICES = 64


def last_rows(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each group in ``order``: of each of SLICES slices of the group first, then of those, so a hot key is many tasks.

    Rows that agree in all of ``order`` go by hash of the whole row.
    """
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    back = [*(F.desc(c) for c in order), F.desc("hash__")]
    df = df.withColumn("hash__", whole).withColumn("slice__", F.pmod("hash__", F.lit(SLICES)))
    some = df.withColumn("back__", F.row_number().over(Window.partitionBy(key, "slice__").orderBy(*back))).filter(F.col("back__") <= n)
    return some.withColumn("back__", F.row_number().over(Window.partitionBy(key).orderBy(*back))).filter(F.col("back__") <= n).drop("back__", "hash__", "slice__")


def least_of_last(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """(key, least): what each of the last ``n`` rows of a group by ``value`` has at least, in one aggregation without a sort: the ``n``-th of the
    largest values of SLICES slices.  Groups whose rows are in fewer slices are left out: any row may be among their last ones."""
    slices = df.groupBy(key, F.pmod(F.xxhash64(*df.columns), F.lit(SLICES)).alias("slice__")).agg(F.max(value).alias("least"))
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("least")))  # a row a slice
    return slices.filter(F.col("least").isNotNull()).withColumn("back__", back).filter(F.col("back__") == n).select(key, "least")


def perhaps_last(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """Rows that may be among the last ``n`` of their group in ``order``, so that few are left to sort: by ``least_of_last`` of the first column,
    of the next where that ties, and so on.  Groups are few, as each has a row in a broadcast."""
    columns, tied, kept = df.columns, F.lit(True), F.lit(False)
    for k, c in enumerate(order):
        least = least_of_last(df.filter(tied).select(*columns), key, c, n).withColumnRenamed("least", f"least{k}__")
        df = df.join(F.broadcast(least), key, "left")
        bound = F.col(f"least{k}__")
        kept = kept | (tied & (bound.isNull() | (F.col(c) > bound)))
        tied = tied & bound.isNotNull() & (F.col(c) == bound)
    return df.filter(kept | tied).select(*columns)


def rolling_mean(value: str, key: str, order: list[str], rows: int) -> Column:
    return F.avg(value).over(frame(key, order, rows))


def sustained_below(value: str, key: str, order: list[str], rows: int, limit: float) -> Column:
    """The last ``rows`` values are all under ``limit``; false while there are fewer."""
    w = frame(key, order, rows)
    return (F.count(value).over(w) == rows) & (F.max(value).over(w) < limit)


def streaks(df: DataFrame, key: str, order: list[str], hit: Column) -> DataFrame:
    """``df`` with ``streak``: how many ticks in a row ``hit`` has held, 0 where it does not."""
    w = Window.partitionBy(key).orderBy(*order)
    df = df.withColumn("hit__", F.coalesce(hit, F.lit(False)))
    df = df.withColumn("island__", F.sum(F.when(F.col("hit__"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "island__").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("streak", F.sum(F.when(F.col("hit__"), 1).otherwise(0)).over(inside).cast("long")).drop("hit__", "island__")


def transitions(df: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """Rows whose label is not the one before, with ``prev_<label>``; a group's first row counts."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(f"prev_{label}", F.lag(label).over(w)).filter(F.col(f"prev_{label}").isNull() | (F.col(f"prev_{label}") != F.col(label)))

"""A ternary perceptron over feature arrays, its threshold and its metrics.

Training is sequential by nature and takes a bounded sample on the driver; splitting, scoring, the sweep and all
metrics are DataFrame plans.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import ranked

#: Rows to train from, about: training is sequential.
SAMPLE = 10_000
#: The stride that negatives are rotated by, cuts that are always tried, and those of a recovery.
STRIDE = 2654435761
CUTS = (0, 1, 2, -1, 3, 5, 8, 11, 15, 21)
RECOVERY = (-5, 41)
#: Most repeats of positives an epoch, and features whose weight stays 1.
REPEATS, PINNED = 48, (62, 63)


def confusion(df: DataFrame, label: str, predicted: str, *by: str) -> DataFrame:
    """Counts and metrics: accuracy, balanced accuracy (of the classes there are), precision, recall, F1.  0 where undefined."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    t = df.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    recall, special, precision = share(tp, tp + fn), share(tn, tn + fp), share(tp, tp + fp)
    balanced = F.when(tp + fn == 0, special).when(tn + fp == 0, recall).otherwise((recall + special) / 2)
    return t.select("*", share(tp + tn, tp + fp + tn + fn).alias("accuracy"), balanced.alias("balanced_accuracy"), precision.alias("precision"), recall.alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def stratified(df: DataFrame, label: str, preview: str, share: float = 0.8) -> DataFrame:
    """``df`` with ``train`` and ``test``: the first ``share`` of each class by preview, rounded, one row on each side at least; a class of one row is on both."""
    out = ranked(df, label, [preview], "rank__", "n__")
    cut = F.greatest(F.lit(1), F.least(F.col("n__") - 1, F.floor(F.col("n__") * share + 0.5)))
    alone = F.col("n__") == 1
    return out.withColumns({"train": alone | (F.col("rank__") <= cut), "test": alone | (F.col("rank__") > cut)}).select(*df.columns, "train", "test")


def score(weights: list[int], features: Column) -> Column:
    w = F.array(*[F.lit(int(x)) for x in weights])
    return F.aggregate(F.zip_with(w, features, lambda a, b: a * b), F.lit(0), lambda acc, x: acc + x)


def epoch_order(labels: np.ndarray, epoch: int) -> np.ndarray:
    """Rows of an epoch (from 1): each positive, followed by a negative of a list that begins at a stride of the epoch and goes round."""
    pos, neg = np.flatnonzero(labels == 1), np.flatnonzero(labels != 1)
    if not len(pos) or not len(neg):
        return np.arange(len(labels)) if not len(pos) else pos
    begin = epoch * STRIDE % len(neg)
    return np.stack([pos, neg[(begin + np.arange(len(pos))) % len(neg)]], axis=1).reshape(-1)


def train(features: np.ndarray, labels: np.ndarray, epochs: int = 10, threshold: int = 1) -> np.ndarray:
    """Weights in {-1, 0, 1} by the perceptron rule: a missed positive is added as often as negatives outnumber positives (REPEATS at most), a false one is
    taken away once; after each change the pinned weights are 1 again."""
    w = np.zeros(features.shape[1], np.int64)
    pinned = [p for p in PINNED if p < len(w)]
    w[pinned] = 1
    n = np.bincount((labels == 1).astype(int), minlength=2)
    repeats = min(REPEATS, max(1, max(1, n[0]) // max(1, n[1])))
    for epoch in range(1, epochs + 1):
        for i in epoch_order(labels, epoch).tolist():
            x, positive = features[i], labels[i] == 1
            if (w @ x >= threshold) != positive:
                # More than two steps of a ternary feature end where two do.
                for _ in range(min(2, repeats) if positive else 1):
                    w = np.clip(w + (x if positive else -x), -1, 1)
                w[pinned] = 1
    return w


def rates(scores: np.ndarray, labels: np.ndarray, cuts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts and metrics at each cut; 0 where undefined."""
    pos, neg = np.sort(scores[labels == 1]), np.sort(scores[labels != 1])
    tp, fp = len(pos) - np.searchsorted(pos, cuts), len(neg) - np.searchsorted(neg, cuts)
    share = lambda a, b: np.divide(a, b, out=np.zeros(len(cuts)), where=b > 0)
    size = np.full(len(cuts), 1)
    recall, special, precision = share(tp, len(pos) * size), share(len(neg) - fp, len(neg) * size), share(tp, tp + fp)
    balanced = special if not len(pos) else recall if not len(neg) else (recall + special) / 2
    return {"tp": tp, "fp": fp, "recall": recall, "precision": precision, "f1": share(2 * precision * recall, precision + recall), "balanced": balanced}


def merit(m: dict[str, np.ndarray]) -> np.ndarray:
    """What a cut is chosen by: F1 first, then balance, precision and recall; floods of false positives count against it."""
    plain = 3.0 * m["f1"] + 1.25 * m["balanced"] + 0.5 * m["precision"] + 0.75 * m["recall"]
    many = (m["precision"] < 0.05) & (m["fp"] > np.maximum(8 * m["tp"], 16))
    return np.select([(m["fp"] >= 30) & (m["precision"] < 0.04), many], [-15.0 - 0.01 * m["fp"], -4.0 + m["f1"]], plain)


def choose_cut(scores: np.ndarray, labels: np.ndarray) -> int:
    """The cut of most merit among those with a recall of .15 and a precision of .06, else among those that find anything; of equal ones the lowest."""
    if not len(scores):
        return 1
    middle = [int(np.sort(s)[len(s) // 2]) if len(s) else 0 for s in (scores[labels == 1], scores[labels != 1])]
    midpoint = int(sum(middle) / 2)
    near = np.arange(-1, 2)
    cuts = np.unique(np.concatenate([midpoint + near, CUTS, (scores[:, None] + near).reshape(-1)]))
    m = rates(scores, labels, cuts)
    value = merit(m)
    useful = (m["recall"] >= 0.15) & (m["precision"] >= 0.06)
    if useful.any():
        return int(cuts[np.where(useful, value, -np.inf).argmax()])
    found = (m["recall"] >= 1e-6) | (m["tp"] > 0)
    best = np.where(found, value, -np.inf).argmax()
    if not found.any():
        return midpoint + 1 if (labels == 1).any() and (labels != 1).any() else max(1, midpoint)
    return midpoint + 1 if m["f1"][best] < 1e-6 and (labels != 1).any() else int(cuts[best])


def recovered_cut(scores: np.ndarray, labels: np.ndarray, cut: int) -> int:
    """``cut``, or where it finds too little or floods, the best of RECOVERY with a recall of .12 to .90 and a precision of .05, if there is one."""
    m = {k: v[0] for k, v in rates(scores, labels, np.array([cut])).items()}
    if not (m["recall"] < 0.12 or (m["precision"] < 0.05 and m["fp"] > max(10 * m["tp"], 20))):
        return cut
    cuts = np.arange(*RECOVERY)
    m = rates(scores, labels, cuts)
    value = np.where((m["recall"] >= 0.12) & (m["recall"] <= 0.90) & (m["precision"] >= 0.05), 4.0 * m["f1"] + 1.5 * m["balanced"] + 0.75 * m["precision"] + 0.5 * m["recall"], -np.inf)
    return int(cuts[value.argmax()]) if np.isfinite(value).any() else cut


def fit(df: DataFrame, label: str, features: str, preview: str, epochs: int = 10, sample: int = SAMPLE, whole: bool = False) -> tuple[list[int], int]:
    """(weights, cut) from rows of ``df`` in order of preview, about 1.2 * ``sample`` at most, picked by hash of it.  whole: with the recovery of a full training."""
    n = df.count()
    share = min(1.0, 1.2 * sample / max(1, n))
    picked = df if share >= 1 else df.filter(F.pmod(F.xxhash64(preview), F.lit(1 << 52)) < int(share * (1 << 52)))
    rows = sorted(picked.select(F.col(preview).alias("p"), F.col(label).alias("y"), F.col(features).alias("x")).collect(), key=lambda r: (r.p, r.y, r.x))
    if not rows:
        return [0] * 64, 1
    x, y = np.array([r.x for r in rows], np.int64), np.array([r.y for r in rows])
    w = train(x, y, epochs)
    cut = choose_cut(x @ w, y)
    return w.tolist(), recovered_cut(x @ w, y, cut) if whole else cut


def calibrated(df: DataFrame, label: str, features: str, preview: str, epochs: int = 10) -> DataFrame:
    """Two rows, side train and test: confusion and metrics of a model that is fitted to the train side."""
    parts = stratified(df, label, preview)
    weights, cut = fit(parts.filter("train"), label, features, preview, epochs)
    scored = parts.withColumn("predicted__", (score(weights, F.col(features)) >= cut).cast("int"))
    sides = scored.withColumn("side", F.explode(F.filter(F.array(F.when(F.col("train"), "train"), F.when(F.col("test"), "test")), lambda s: s.isNotNull())))
    return confusion(sides, label, "predicted__", "side")


def baseline(df: DataFrame, label: str) -> DataFrame:
    """One row: the share of negatives, which always saying no is right on; 0 without rows."""
    return df.agg(F.coalesce(F.avg(F.when(F.col(label) == 1, 0.0).otherwise(1.0)), F.lit(0.0)).alias("baseline"))


def compare(df: DataFrame, label: str, first: str, second: str) -> DataFrame:
    """One row: what the second prediction's metrics have over the first's."""
    names = ("accuracy", "balanced_accuracy", "precision", "recall", "f1")
    a = confusion(df, label, first).select(*[F.col(n).alias(f"a_{n}") for n in names])
    b = confusion(df, label, second).select(*names)
    return b.join(a, how="cross").select(*[(F.col(n) - F.col(f"a_{n}")).alias(n) for n in names])  # one row each


def sweep(df: DataFrame, label: str, scored: str, low: int = -40, high: int = 40) -> DataFrame:
    """(threshold, metrics) for each whole threshold, in one pass: counts a score, then sums over scores at or above."""
    held = df.groupBy(F.least(F.lit(high), F.greatest(F.lit(low - 1), F.col(scored))).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    grid = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("threshold"))
    t = grid.join(F.broadcast(held), how="cross").groupBy("threshold")  # at most high - low + 2 rows of counts
    t = t.agg(F.sum(F.when(F.col("s") >= F.col("threshold"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("s") >= F.col("threshold"), F.col("neg")).otherwise(0)).alias("fp"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    balanced = (share("tp", "p") + 1 - share("fp", "n")) / 2
    return t.select("threshold", "tp", "fp", balanced.alias("balanced_accuracy"), share("tp", "p").alias("recall"))


# --------------------------------------------------------------------------- model files

#: Last part of the header word; any prefix is read.
HEADER = "CALIB_V1"


def to_wire(weights: list[int], threshold: int, schema: int = 1, notes: dict[str, str] | None = None) -> str:
    """Header, weights on one line, notes."""
    return "\n".join([f"{HEADER} {len(weights)} {threshold} {schema}", " ".join(map(str, weights)), *(f"# {k}={v}" for k, v in (notes or {}).items())]) + "\n"


def from_wire(text: str) -> tuple[list[int], int, int, dict[str, str]]:
    lines = text.splitlines()
    head = lines[0].split() if lines else []
    if len(head) != 4 or not head[0].endswith(HEADER):
        raise ValueError("not a calibration file")
    weights = [int(x) for line in lines[1:] if not line.startswith("#") for x in line.split()]
    if len(weights) != int(head[1]):
        raise ValueError(f"{len(weights)} weights, {head[1]} announced")
    notes = dict(line[2:].split("=", 1) for line in lines[1:] if line.startswith("# ") and "=" in line)
    return weights, int(head[2]), int(head[3]), notes

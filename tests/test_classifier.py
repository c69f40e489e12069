import numpy as np

from tessera.operators import classifier


def train_by_loop(x, y, epochs, threshold=1):
    """One row and one step at a time."""
    w = [0] * 64
    w[62] = w[63] = 1
    pos = [i for i in range(len(y)) if y[i] == 1]
    neg = [i for i in range(len(y)) if y[i] != 1]
    repeats = min(48, max(1, max(1, len(neg)) // max(1, len(pos))))
    for epoch in range(1, epochs + 1):
        if pos and neg:
            begin = (epoch * 2654435761) % len(neg)
            turned = neg[begin:] + neg[:begin]
            order = [i for k, p in enumerate(pos) for i in (p, turned[k % len(turned)])]
        else:
            order = pos or list(range(len(y)))
        for i in order:
            if (sum(a * b for a, b in zip(w, x[i])) >= threshold) != (y[i] == 1):
                side, times = (1, repeats) if y[i] == 1 else (-1, 1)
                for _ in range(times):
                    w = [max(-1, min(1, a + side * b)) for a, b in zip(w, x[i])]
                w[62] = w[63] = 1
    return w


def test_training_against_a_loop():
    rng = np.random.default_rng(3)
    for share in (0.0, 0.05, 0.3, 0.9, 1.0):
        x = rng.integers(-1, 2, (120, 64))
        y = (rng.random(120) < share).astype(int)
        assert classifier.train(x, y, 6).tolist() == train_by_loop(x.tolist(), y.tolist(), 6)


def merit_by_hand(tp, fp, tn, fn):
    p, r = tp / (tp + fp) if tp + fp else 0, tp / (tp + fn) if tp + fn else 0
    s = tn / (tn + fp) if tn + fp else 0
    f1 = 2 * p * r / (p + r) if p + r else 0
    bal = s if not tp + fn else r if not tn + fp else (r + s) / 2
    if fp >= 30 and p < 0.04:
        return p, r, f1, -15 - 0.01 * fp
    if p < 0.05 and fp > max(8 * tp, 16):
        return p, r, f1, -4 + f1
    return p, r, f1, 3 * f1 + 1.25 * bal + 0.5 * p + 0.75 * r


def test_the_cut_against_a_loop():
    rng = np.random.default_rng(4)
    for share, lift in ((0.02, 1), (0.3, 4), (0.5, 0), (0.01, -9)):
        y = (rng.random(400) < share).astype(int)
        s = rng.integers(-8, 9, 400) + lift * y
        pos, neg = sorted(s[y == 1].tolist()), sorted(s[y == 0].tolist())
        mid = int(((pos[len(pos) // 2] if pos else 0) + (neg[len(neg) // 2] if neg else 0)) / 2)
        cuts = sorted({mid - 1, mid, mid + 1, *classifier.CUTS, *(v + d for v in s.tolist() for d in (-1, 0, 1))})
        best = {True: (-np.inf, None), False: (-np.inf, None)}
        for c in cuts:
            tp, fp = int(((s >= c) & (y == 1)).sum()), int(((s >= c) & (y == 0)).sum())
            p, r, f1, m = merit_by_hand(tp, fp, len(neg) - fp, len(pos) - tp)
            for useful in (True, False):
                if (r >= 0.15 and p >= 0.06 if useful else r >= 1e-6 or tp) and m > best[useful][0] + 1e-12:
                    best[useful] = (m, c)
        want = best[True][1] if best[True][1] is not None else best[False][1]
        assert classifier.choose_cut(s, y) == (want if want is not None else max(1, mid))


def test_recovery():
    rng = np.random.default_rng(5)
    y = (np.arange(300) < 10).astype(int)
    s = rng.integers(-3, 4, 300) + 3 * y
    assert classifier.recovered_cut(s, y, 40) != 40 and classifier.recovered_cut(s, y, 3) == 3
    assert classifier.recovered_cut(s - 50, y, 60) == 60
    assert classifier.choose_cut(np.zeros(0, int), np.zeros(0, int)) == 1


def test_split_and_calibration(spark):
    rng = np.random.default_rng(6)
    y = (rng.random(200) < 0.3).astype(int)
    x = rng.integers(-1, 2, (200, 64))
    x[:, :16] = np.where(rng.random((200, 16)) < 0.9, 1, -1) * np.where(y == 1, 1, -1)[:, None]
    df = spark.createDataFrame([(f"p{i:03}", int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y))], "p string, y int, x array<int>").repartition(3)
    parts = classifier.stratified(df, "y", "p").collect()
    for side in (0, 1):
        rows = sorted((r for r in parts if r.y == side), key=lambda r: r.p)
        n = int(len(rows) * 0.8 + 0.5)
        assert [r.train for r in rows] == [k < n for k in range(len(rows))] and all(r.train != r.test for r in rows)
    one = classifier.stratified(df.filter("y = 0").union(df.filter("y = 1").limit(1)), "y", "p").filter("y = 1").first()
    assert one.train and one.test
    out = {r.side: r for r in classifier.calibrated(df, "y", "x", "p").collect()}
    assert set(out) == {"train", "test"} and out["test"].balanced_accuracy > 0.85
    assert classifier.calibrated(df.limit(0), "y", "x", "p").count() == 0
    assert classifier.baseline(df, "y").first().baseline == np.mean(y == 0)

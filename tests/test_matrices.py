import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import linkage, planes, ternary

KIND = "vec_id long, v array<tinyint>"


def vectors(spark, rows):
    return spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(rows)], KIND)


def test_planes_go_round():
    rng = np.random.default_rng(1)
    for samples in (1, 63, 64, 65, 130):
        codes = rng.integers(0, 4, (5, samples)).astype(np.uint8)
        back = planes.unpack(*planes.pack(codes))
        assert (back[:, :samples] == codes).all() and (back[:, samples:] == 3).all()


def test_packed_tables(spark):
    rows = [("1", 0, 10, [0, 1, 2, 3, None, 7]), ("1", 1, 20, None), ("1", 2, 30, [2] * 70)]
    t = planes.packed(spark.createDataFrame(rows, "chr string, snp_idx long, position long, g array<int>"))
    got = {r.snp_idx: (r.n_ref, r.n_het, r.n_alt, r.n_missing) for r in t.collect()}
    assert got == {0: (1, 1, 1, 3), 1: (0, 0, 0, 0), 2: (0, 0, 70, 0)}
    assert planes.packed(t) is t
    half = {r.snp_idx: (r.n_ref, r.n_het, r.n_alt, r.n_missing) for r in planes.subset(t, np.arange(70) % 2 == 1).collect()}
    assert half == {0: (0, 1, 0, 2), 1: (0, 0, 0, 0), 2: (0, 0, 35, 0)}
    assert linkage.pairs(t, 5, min_valid=1, threshold=None).count() == 0


def test_blocks_of_many_windows(spark):
    rng = np.random.default_rng(2)
    g = rng.integers(0, 4, (400, 33))
    df = spark.createDataFrame([("1", i, i, r) for i, r in enumerate(g.tolist())], "chr string, snp_idx long, position long, g array<int>").repartition(5)
    got = {(r.snp1_idx, r.snp2_idx): r.n for r in linkage.pairs(df, 4, threshold=None).collect()}
    for i in range(400):
        for j in range(i + 1, min(400, i + 4)):
            both = (g[i] != 3) & (g[j] != 3)
            defined = both.sum() >= 10 and g[i][both].std() > 0 and g[j][both].std() > 0
            assert got.get((i, j)) == (both.sum() if defined else None)


def test_order_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(linkage, "RANGE", 4)
    positions = [5, 6, 7, 8, 3, 9, 10, 11, 40, 41, 39]
    df = spark.createDataFrame([("1", 20 * i if i > 7 else i, p) for i, p in enumerate(positions)] + [("2", 0, 1)], "chr string, snp_idx long, position long")
    assert sorted((r.position, r.before) for r in linkage.ordered(df).collect()) == [(3, 8), (39, 41)]


def test_packed_weights(spark):
    rng = np.random.default_rng(3)
    rows = [rng.integers(-1, 2, n) for n in (0, 1, 64, 200, 257, 600)]
    out = {r.vec_id: r.p for r in vectors(spark, rows).select("vec_id", ternary.pack(F.col("v")).alias("p")).collect()}
    for i, v in enumerate(rows):
        want = [0b01010101] * (-(-len(v) // 256) * 64)
        for k, w in enumerate(v):
            at, shift = k // 256 * 64 + k % 64, 2 * (k % 256 // 64)
            want[at] = want[at] & ~(3 << shift) | int(w + 1) << shift
        assert out[i] == want
    assert vectors(spark, [[0, 2]]).select(ternary.pack(F.col("v")).alias("p")).first().p is None


def test_products_check_shapes(spark):
    w = [[1, -1, 0], [0, 1, 1]]
    assert vectors(spark, [[3, 4, 5]]).select(ternary.product(F.col("v"), w).alias("y")).first().y == [-1, 9]
    with pytest.raises(Exception, match="3 places"):
        vectors(spark, [[3, 4]]).select(ternary.product(F.col("v"), w)).collect()


def test_sparse_tables(spark):
    rng = np.random.default_rng(4)
    a, b = (rng.integers(-1, 2, (6, 200)) * (rng.random((6, 200)) < 0.02) for _ in range(2))
    one, other = (ternary.sparse(vectors(spark, x)) for x in (a, b))
    got = {(r.vec_id, r.chunk): (r.pos, r.neg) for r in ternary.sparse_add(one, other).collect()}
    word = lambda bits: int(np.packbits(np.pad(bits, (0, 64 - len(bits))), bitorder="little").view("<i8")[0])
    want = {}
    for i in range(6):
        for c in range(4):
            part = slice(64 * c, 64 * c + 64)
            planes_ = word((a[i, part] == 1) | (b[i, part] == 1)), word((a[i, part] == -1) | (b[i, part] == -1))
            if any(planes_):
                want[i, c] = planes_
    assert got == want
    inputs = ternary.sparse(vectors(spark, [a[0]])).select("chunk", "pos", "neg")
    score = {(i, c): int((a[i] * a[0])[64 * c : 64 * c + 64].sum()) for i in range(6) for c in range(4)}
    assert {(r.vec_id, r.chunk): r.sign for r in ternary.gated(one, inputs).collect()} == {k: int(np.sign(v)) for k, v in score.items() if v}
    assert {(r.vec_id, r.chunk) for r in ternary.gated(one, inputs, 2).collect()} == {k for k, v in score.items() if abs(v) >= 2}


def test_edits(spark):
    t = vectors(spark, [[0, 1, -1], [1, 1, 1]])
    edits = spark.createDataFrame([(0, 2, 1, 0), (0, 2, 0, 1), (0, 0, -1, 0)], "vec_id long, idx long, val long, seq long")
    out = {r.vec_id: (r.v, r.generation) for r in ternary.edited(t, edits).collect()}
    assert out == {0: ([-1, 1, 0], 1), 1: ([1, 1, 1], 0)}
    with pytest.raises(Exception, match="does not fit"):
        ternary.edited(t, spark.createDataFrame([(0, 3, 1)], "vec_id long, idx long, val long")).collect()

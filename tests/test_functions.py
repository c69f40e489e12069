import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import scores as S
from tessera.functions import statistics as st
from tessera.functions import text as T


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_normal(spark):
    xs = [-3.0, -1.0, 0.0, 0.4, 1.96, 5.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", st.erf(F.col("x")).alias("e"), st.normal_cdf(F.col("x")).alias("c")).collect():
        assert abs(r.e - math.erf(r.x)) < 1e-6 and abs(r.c - 0.5 * (1 + math.erf(r.x / math.sqrt(2)))) < 1e-6
    ps = spark.createDataFrame([(p,) for p in (0.0, 0.001, 0.025, 0.5, 0.8, 0.975, 1.0)], "p double")
    got = {r.p: r.z for r in ps.select("p", st.inverse_normal_cdf(F.col("p")).alias("z")).collect()}
    assert got[0.0] == -math.inf and got[1.0] == math.inf
    assert abs(got[0.975] - 1.959964) < 1e-3 and abs(got[0.5]) < 1e-3 and abs(got[0.025] + 1.959964) < 1e-3


def test_power_and_sample_size(spark):
    r = one(spark, p=st.power(F.lit(0.1), F.lit(1000), F.lit(0.05)), low=st.power(F.lit(0.01), F.lit(10), F.lit(0.05)), n=st.min_sample_size(F.lit(0.1), F.lit(0.05), F.lit(0.8)))
    assert r.p > 0.8 and r.low == 0.05 and 780 <= r.n <= 790


def test_hardy_weinberg(spark):
    r = one(spark, even=st.hardy_weinberg_p(F.lit(25), F.lit(50), F.lit(25)), odd=st.hardy_weinberg_p(F.lit(50), F.lit(0), F.lit(50)), few=st.hardy_weinberg_p(F.lit(1), F.lit(0), F.lit(0)), fixed=st.hardy_weinberg_p(F.lit(9), F.lit(0), F.lit(0)), af=st.allele_frequency(F.lit(0), F.lit(0), F.lit(0)))
    assert abs(r.even - 1) < 1e-6 and r.odd == 0.001 and r.few == 1 and r.fixed == 1 and r.af == 0.5


def test_fixation(spark):
    n, s = 100.0, 0.02
    r = one(spark, a=st.fixation_probability(F.lit(s), F.lit(n)), neutral=st.fixation_probability(F.lit(0.0), F.lit(n)), lost=st.fixation_probability(F.lit(-9.0), F.lit(n)))
    assert abs(r.a - (1 - math.exp(-2 * s)) / (1 - math.exp(-2 * n * s))) < 1e-12 and r.neutral == 1 / 200 and r.lost == 0


@pytest.mark.parametrize("n", [1, 31, 32, 33, 64, 65])
def test_bit_planes(spark, n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(-1, 2, n).tolist(), rng.integers(-1, 2, n).tolist()
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    planes = [A.plane(F.col(c), v) for c in "ab" for v in (1, -1)]
    assert df.select(A.plane_dot(*planes)).first()[0] == int(np.dot(a, b))


def test_ternary_and_quantise(spark):
    v = [0.1, -0.9, 0.8, 0.0, -0.2]
    df = spark.createDataFrame([(v,), ([],), ([0.0, 0.0],)], "v array<double>")
    rows = df.select(A.ternary(F.col("v")).alias("t"), A.density(F.col("v")).alias("d"), A.int8(F.col("v")).alias("q"), A.int8_scale(F.col("v")).alias("s")).collect()
    cut = 0.5 * np.mean(np.abs(v))
    assert rows[0].t == [int(x > cut) - int(x < -cut) for x in v]
    assert rows[0].q == [round(x / (0.9 / 127)) if abs((x / (0.9 / 127)) % 1 - 0.5) > 1e-9 else None for x in v]
    assert rows[1].t == [] and rows[1].d == 0 and rows[2].s == 1 and rows[2].q == [0, 0]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 2.0], 0.0), ([1.0], [1.0, 2.0], 0.0), ([], [], 0.0), ([0.0], [0.0], 0.0)], "a array<double>, b array<double>, want double")
    assert all(abs(r.got - r.want) < 1e-9 for r in df.select("want", A.cosine(F.col("a"), F.col("b")).alias("got")).collect())


def test_byte_encoder(spark):
    for t in ("", "az", "Hé!", "mmmm"):
        want = [int((b - 109.5) / 13 > 0.33) - int((b - 109.5) / 13 < -0.33) for b in t.encode()]
        assert spark.createDataFrame([(t,)], "t string").select(A.ternary_bytes(F.col("t"))).first()[0] == want


TEXTS = ["", "Hello, World", "aaaa  bbb\x01c\rd", "ÉCOLE été ßß 中文!!", "x" * 300, "\n\n　 z"]


def test_text_measures(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    out = df.select("i", T.byte_entropy(F.col("t")).alias("e"), T.char_classes(F.col("t")).alias("c"), T.squash(F.col("t")).alias("s"), T.fnv1a(F.col("t")).alias("f"), T.content_hash(F.col("t")).alias("h"), T.reduction(F.col("t")).alias("r")).collect()
    for r in out:
        t = TEXTS[r.i]
        n = Counter(t.encode())
        want = -sum(k / len(t.encode()) * math.log2(k / len(t.encode())) for k in n.values()) / 8 if t else 0
        assert abs(r.e - want) < 1e-9
        assert r.c.upper == sum(ch.isupper() for ch in t) and sum(r.c) == len(t)
        h = 14695981039346656037
        for b in t.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        assert int(r.f) == h
        assert r.h == hashlib.sha256(t.encode()).hexdigest()
        assert 0 <= r.r < 1
    assert out[2].s == "aa bbcd" and out[4].s == "xx" and out[5].s == " z"


def test_lines(spark):
    df = spark.createDataFrame([("## Two", 2, None), ("#no", 0, None), ("12. item", 0, "item"), ("1.item", 0, None)], "t string, level int, item string")
    for r in df.select("*", T.heading_level(F.col("t")).alias("l"), T.numbered_item(F.col("t")).alias("n")).collect():
        assert (r.l, r.n) == (r.level, r.item)
    code = spark.createDataFrame([("fn main() {\n  x;\n}", True), ("plain words", False), ("{a;} b;", True), ("we use this", False), ("we use it\nthis", True), ("#!/bin/sh", True), ("a = 1\nb = 2", True), ("std::x;", True)], "t string, code boolean")
    assert all(r.code == r.c for r in code.select("code", T.looks_like_code(F.col("t")).alias("c")).collect())
    assert one(spark, x=T.extract_text(F.lit('{"prompt": "p", "content": "c"}')), y=T.extract_text(F.lit("{}"))).asDict() == {"x": "p", "y": ""}


def test_scores(spark):
    f = F.lit
    r = one(
        spark,
        health=S.health_score(f(1.0), f(1.0), f(1.0), f(False), f(0.0)),
        sick=S.health_score(f(0.0), f(0.0), f(0.0), f(True), f(1.0)),
        heal=S.needs_healing(f(False), f(0.0), f(1.0), f(0.4)),
        regime=S.view_regime(f(0.1), f(0.1), f(0.0)),
        seen=S.detector_regime(f(0.1), f(0.8), f(0.0), f(0.0)),
        mood=S.mood(f(0.6), f(0.3)),
        route=S.route(f(0.7), f(29_999)),
        fallback=S.route(f(0.7), f(30_000)),
        path=S.agent_path(f("micro"), f(3), f(14), f(7)),
        index=S.global_index(f("nano"), f(2)),
        hebb=S.hebbian(f(0.2), f(0.9), f(0.1), f(3)),
        failed=S.failed_gates(a=f(True), b=f(False)),
        band=S.risk_band(f(0.55)),
        sev=S.severity(S.degradation(f(140.0), f(100.0), True)),
        better=S.degradation(f(50.0), f(100.0), True),
    )
    assert (r.health, r.sick, r.heal, r.regime, r.route, r.fallback) == (1.0, 0.0, True, "Recovering", "local", "local_fallback")
    assert (r.seen, r.mood) == ("Catastrophic", "content yet calm")
    assert r.path == "/super/0/sub/3/micro/14" and r["index"] == 1053 and r.failed == ["b"] and r.band == "high" and r.sev == "Error" and r.better == 0
    w = 0.2
    for _ in range(3):
        w += 0.1 * (0.9 - w)
    assert abs(r.hebb - w) < 1e-12

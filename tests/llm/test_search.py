import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import decontaminate, license_scan, sharding
from tessera.llm.common import WordHashes, shingles

from .cases import LONG, ODD, docs


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def grams(t):
    ws = (t or "").encode().lower().split()
    return {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def test_containment_against_brute_force(spark):
    rng = random.Random(9)
    bench = [(i, " ".join(f"q{rng.randrange(4000)}" for _ in range(n))) for i, n in enumerate([5, 6, 8, 14, 24, 25, 40, 59, 200] * 4)]
    rows = []
    for d in range(150):
        ws = [f"d{rng.randrange(3000)}" for _ in range(rng.choice([0, 3, 50, 400, 6000]))]
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(bench)[1].split()
            for _ in range(rng.randint(0, max(1, len(item) // 20))):
                item[rng.randrange(len(item))] = "zz"
            at = rng.randint(0, len(ws))
            ws[at:at] = item
        rows.append((d, " ".join(ws)))
    got = {(r.doc_id, r.item_id, r.n_item, r.n_common) for r in decontaminate.contaminated(docs(spark, rows), items(spark, bench)).collect()}
    want = set()
    for d, t in rows:
        s = grams(t)
        for i, q in bench:
            g = grams(q)
            if 100 * len(g & s) >= 80 * len(g):
                want.add((d, i, len(g), len(g & s)))
    assert got == want and len(want) > 60


def test_containment_blocks_and_odd_rows(spark, monkeypatch):
    bench = items(spark, [(1, None), (2, ""), (3, "a"), (4, "two lines HERE that repeat"), (5, LONG), (5, LONG), (6, "not there at all anywhere")])
    want = {(4, 3), (7, 4), (5, 5)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, ODD), bench).collect()} == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 150_000)
    out = decontaminate.contaminated(docs(spark, ODD), bench).collect()
    assert {(r.doc_id, r.item_id) for r in out} == want and len(out) == 3
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0
    assert decontaminate.contaminated(docs(spark, ODD), items(spark, [])).count() == 0
    left = decontaminate.drop_contaminated(docs(spark, ODD), bench)
    assert left.columns == docs(spark, ODD).columns and left.count() == len(ODD) - 4


def test_candidates_from_any_size_partition():
    rng = np.random.default_rng(3)
    table = WordHashes()
    item = shingles(" ".join(f"i{k}" for k in range(28)).encode(), table)
    index = decontaminate.ItemIndex([(1, " ".join(f"i{k}" for k in range(28)).encode())], 80)
    missed = 0
    for n in (40, 300, 4000, 60_000):
        for _ in range(50):
            s = np.unique(np.concatenate([rng.choice(item, 20, replace=False), rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)]))
            missed += not index.search(s)
    assert missed == 0


def test_least_partitions_and_the_size_of_an_index():
    rng = np.random.default_rng(4)
    s = np.sort(np.concatenate([rng.integers(0, 2**63, 300).astype(np.uint64) * np.uint64(2), np.array([0, 1, 2, 3, 2**64 - 1, 2**64 - 2], np.uint64)]))
    since = decontaminate.least_partitions(s)
    for bits in (1, 5, 9, 20, 63, 64):
        assert set(decontaminate.smallest_of_bins(s, bits).tolist()) == set(s[since <= bits].tolist())
    for texts in (["a"] * 4000, [f"{k}" for k in range(20_000)], [" ".join(f"w{k}" for k in range(30_000))], ["a b " * 20_000]):
        index = decontaminate.ItemIndex([(k, t.encode()) for k, t in enumerate(texts)], 80)
        assert index.nbytes <= decontaminate.INDEX_BYTES * sum(map(len, texts)) + (1 << 18)


def test_containment_of_text_ids(spark):
    rows = docs(spark, [(7, "two lines here that repeat and more")]).withColumn("doc_id", F.lit("x7"))
    out = decontaminate.contaminated(rows, items(spark, [(4, "lines HERE that repeat and")])).collect()
    assert [(r.doc_id, r.item_id, r.containment) for r in out] == [("x7", 4, 1.0)]


def test_license_against_brute_force():
    rng = random.Random(5)
    library = license_scan.Library(license_scan.TEMPLATES, 80)
    table = license_scan.Words()
    sequences, want = [], []
    for _ in range(300):
        ws = rng.choice(license_scan.TEMPLATES)[1].split()
        for _ in range(rng.randint(0, len(ws) // 30)):
            ws[rng.randrange(len(ws))] = "zzz"
        around = [[f"w{rng.randrange(3000)}" for _ in range(rng.randint(0, 600))] for _ in (0, 1)]
        s, _ = license_scan.positions(" ".join(around[0] + ws + around[1]).encode(), table)
        sequences.append(s)
        held = set(s.tolist())
        want.append({k for k, x in enumerate(library.sets) if 100 * len(held & set(x.tolist())) >= 80 * len(x)})
    assert [set(x) for x in library.scan(sequences)] == want
    assert sum(map(len, want)) > 200


def test_license_rows(spark):
    rows = ODD + [(20, "intro words\n(Released under the MIT License!)"), (21, "Licensed under the Apache License, Version 2.0."), (22, "Released under the MIT"), (23, "This work is licensed under the GNU General Public Licence, version 3.")]
    out = {r.doc_id: r for r in license_scan.scan(docs(spark, rows)).collect()}
    assert set(out) == {20, 21}
    assert (out[20].license, out[20].containment, out[20].start_word, out[20].end_word) == ("MIT", 1.0, 2, 7)
    assert out[21].license == "Apache-2.0"
    assert license_scan.scan(docs(spark, [])).count() == 0
    assert license_scan.scan(docs(spark, rows), templates=(("x", "too few words"),)).count() == 0


def check_shards(rows, out, shards):
    assert sorted((r.doc_id for r in out), key=str) == sorted((r[0] for r in rows), key=str)
    sizes, slots, of = [0] * shards, {}, {}
    for r in out:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    for x in slots.values():
        assert sorted(x) == list(range(len(x)))
    return sizes


def test_shards_are_even_and_keep_groups(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["same text", "x" * rng.randint(0, 900) + str(i)])) for i in range(900)]
    texts = dict(rows)
    out = sharding.assign(docs(spark, rows).repartition(5), 8, rows_a_cell=10).collect()
    sizes = check_shards(rows, out, 8)
    of = {}
    for r in out:
        t = texts[r.doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t.encode()), "bytes", None)
        of.setdefault(t, set()).add(r.shard)
    assert all(len(x) == 1 for x in of.values())
    assert max(sizes) - min(sizes) < 4 * 901 + 450 * 10


def test_shards_odd_rows(spark):
    out = sharding.assign(docs(spark, ODD), 8).collect()
    check_shards(ODD, out, 8)
    assert {r.size for r in out if r.doc_id == 1} == {1}
    assert sharding.assign(docs(spark, []), 8).count() == 0
    out = sharding.assign(docs(spark, [(i, "one") for i in range(20)]), 8).collect()
    check_shards([(i, "") for i in range(20)], out, 8)
    assert len({r.shard for r in out}) == 1


def test_shards_written(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(40)]
    sharding.write_shards(docs(spark, rows), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40 and {r.text for r in back.collect()} == {t for _, t in rows}

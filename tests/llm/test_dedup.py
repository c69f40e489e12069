import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, line_dedup, minhash
from tessera.llm.common import WordHashes, shingles

from .cases import LONG, ODD, docs

BLANK = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def lines_by_hand(rows, min_chars=10):
    held = {}
    for i, t in rows:
        for ln in (t or "").split("\n"):
            held.setdefault(lower(ln.strip(BLANK)), set()).add(i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        keep = [ln for ln in ls if not (i is not None and len(lower(ln.strip(BLANK))) >= min_chars and len(held[lower(ln.strip(BLANK))] - {None}) >= 2 and i != min(held[lower(ln.strip(BLANK))] - {None}))]
        out.append((i, len(ls), len(ls) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def line_rows(df):
    out = line_dedup.line_dedup(df).select("doc_id", "ld_lines", "ld_dropped", F.sha2("ld_text", 256))
    return sorted(map(tuple, out.collect()), key=str)


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    pool = ["Short", "A line that is long enough", "  a LINE that is long enough\t", "été à la plage bleue", "ÉTÉ à la plage bleue", "0123456789", "012345678", "", "\x0b\x0c some other line \r"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(40)]
    assert line_rows(docs(spark, rows)) == lines_by_hand(rows)


def test_lines_odd_rows(spark):
    rows = [*ODD, (9, "lines here that repeat"), (7, "lines here that repeat\nother"), (None, "lines here that repeat")]
    assert line_rows(docs(spark, rows)) == lines_by_hand(rows)
    assert line_dedup.line_dedup(docs(spark, ODD)).columns[:12] == docs(spark, ODD).columns
    assert line_rows(docs(spark, [])) == []


def test_lines_take_effect(spark):
    out = line_dedup.drop_shared_lines(docs(spark, [(1, "the same old line\nmine"), (2, "The Same Old Line \nyours")])).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["the same old line\nmine", "yours"] and out[1].n_chars == 5


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_against_brute_force(spark, keep):
    rng = random.Random(5)
    rows = [(i, rng.choice(["", None, "a", "A", "a ", LONG, f"t{i % 40}"])) for i in range(300)]
    df = docs(spark, rows).repartition(7)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(df, keep=keep).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == 300
    for t, ids in groups.items():
        best = (min if keep == "smallest" else max)(ids)
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (best, len(ids), i == best)
            assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("runs,bits,rounds", [(1, 1, 1), (2, 1, 1), (7, 1, 3), (9, 1, 4), (9, 2, 2)])
def test_exact_rounds_follow_the_runs(spark, runs, bits, rounds):
    assert exact_dedup.rounds_for(runs, bits) == rounds
    rows = [(i, f"t{i % 5}") for i in range(90)]
    tree = exact_dedup.RunTree(docs(spark, rows).repartition(runs), "text", "doc_id", "smallest", bits)
    assert (tree.rounds, tree.rows.select("cell").distinct().count()) == (rounds, runs)  # at 4 shuffle partitions
    top = tree.up()
    assert len(tree.levels) == rounds + 1 and top.count() == 5 and {r.n for r in top.collect()} == {18}
    assert tree.placed().filter("n = 18").count() == 90


def test_exact_takes_ids_of_any_type(spark):
    out = exact_dedup.exact_dedup(spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x")], "doc_id string, text string"))
    assert sorted((r.doc_id or "", r.keep_id, r.group_size, r.kept) for r in out.collect()) == [("", "a", 3, False), ("a", "a", 3, True), ("b", "a", 3, False)]


def test_exact_odd_rows(spark):
    out = exact_dedup.exact_dedup(docs(spark, ODD), keep="largest").collect()
    assert len(out) == len(ODD)
    assert sum(r.kept for r in out) == len({t or "" for _, t in ODD})
    empty = [r for r in out if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert {r.keep_id for r in empty} == {2} and len(empty) == 3
    assert sum(r.kept for r in out if r.doc_id == 4) == 1
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def near_by_hand(rows, percent):
    table = WordHashes()
    sets = {}
    for i, t in rows:
        ws = (t or "").encode().lower().split()
        sets[i] = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())
        assert len(shingles((t or "").encode(), table)) == len(sets[i])
    of = {i: i for i in sets}

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = top(a), top(b)
            of[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def edited(rng, words, edits):
    ws = list(words)
    for _ in range(edits):
        ws[rng.randrange(len(ws))] = f"e{rng.randrange(10**6)}"
    return " ".join(ws)


@pytest.mark.parametrize("percent,large", [(85, 64), (85, 3), (80, 3)])
def test_near_against_brute_force(spark, monkeypatch, percent, large):
    monkeypatch.setattr(minhash, "LARGE", large)
    rng = random.Random(percent + large)
    rows = []
    for size in (6, 20, 90, 200):
        base = [f"b{size}w{rng.randrange(5000)}" for _ in range(size)]
        rows += [edited(rng, base, rng.randrange(0, max(2, size // 12))) for _ in range(40)]
    rows += [" ".join(f"r{rng.randrange(10**6)}" for _ in range(30)) for _ in range(20)] + ["", "one", "one two", "One  TWO", "one two three four five"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_dedup(docs(spark, rows), percent=percent).collect()}
    assert got == near_by_hand(rows, percent)


def test_near_odd_rows(spark):
    out = minhash.near_dedup(docs(spark, ODD + [(9, LONG + " more"), (2**40, LONG)])).collect()
    assert len(out) == len(ODD) + 2
    by_id = {r.doc_id: r for r in out}
    assert by_id[9].component_id == by_id[2**40].component_id == 5 and not by_id[9].kept
    assert by_id[1].n_shingles == 0 and by_id[1].component_id == 1
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None)
    assert minhash.near_dedup(docs(spark, [])).count() == 0
    kept = minhash.drop_near_copies(docs(spark, ODD + [(9, LONG + " more")]))
    assert kept.count() == len(ODD) and kept.columns == docs(spark, ODD).columns


def test_rows_that_repeat_an_id_with_other_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    out = minhash.near_dedup(docs(spark, [(1, a), (1, b), (2, a), (3, b + " tail")])).collect()
    assert len(out) == 4 and {r.component_id for r in out} == {1}


def test_pruning_misses_as_rarely_as_chosen():
    least = minhash.least_equal(85)
    rng = np.random.default_rng(1)
    equal = (rng.random((100_000, minhash.BINS)) < 0.85).cumsum(axis=1)[:, minhash.BATCH - 1 :: minhash.BATCH]
    assert (equal >= least).all()
    unlike = (rng.random((1000, minhash.BINS)) < 0.5).cumsum(axis=1)[:, minhash.BATCH - 1 :: minhash.BATCH]
    assert (unlike < least).any(axis=1).mean() > 0.99
    assert 1 - (1 - 0.85**minhash.ROWS) ** minhash.bands_for(85) > 1 - 1e-6


@pytest.mark.parametrize("percent,words", [(85, 11), (85, 13), (80, 9)])
def test_near_copies_of_few_shingles(spark, percent, words):
    rng = random.Random(words)
    rows = []
    for i in range(3000):
        ws = [f"p{i}w{k}r{rng.randrange(10**6)}" for k in range(words)]
        rows += [(2 * i, " ".join(ws)), (2 * i + 1, " ".join(ws[:-1]))]
    lost = [r.doc_id for r in minhash.near_dedup(docs(spark, rows), percent=percent).collect() if r.component_id != r.doc_id // 2 * 2]
    assert not lost


def test_minhash_values_are_independent_in_sets_of_any_size():
    rng = np.random.default_rng(2)
    for n in (7, 40, 300):
        shared = round(n * 0.85)
        pairs = [np.sort(rng.integers(0, 2**64, n, dtype=np.uint64)) for _ in range(2000)]
        parts = [np.sort(rng.permutation(s)[:shared]) for s in pairs]
        equal = (minhash.minhashes(pairs) == minhash.minhashes(parts)).sum(axis=1)
        j = shared / n
        assert abs(equal.mean() / minhash.BINS - j) < 0.005
        assert 0.8 < equal.var() / (minhash.BINS * j * (1 - j)) < 1.2


@pytest.mark.parametrize("percent,sizes", [(85, [(6, 7), (7, 8), (9, 10), (12, 14), (13, 15)]), (80, [(4, 5), (5, 6), (8, 10), (11, 13), (12, 15)])])
def test_bands_lose_no_pair_of_few_shingles(percent, sizes):
    """Pairs at the threshold, one set within the other: 20,000 of each size, none of which may miss all bands (1e-6 each)."""
    rng = np.random.default_rng(percent)
    bands = minhash.bands_for(percent)
    for less, more in sizes:
        assert 100 * less >= percent * more
        sets = [np.sort(rng.integers(0, 2**64, more, dtype=np.uint64)) for _ in range(20_000)]
        keys = [minhash.band_keys(minhash.minhashes(part), bands) for part in (sets, [np.sort(x[rng.permutation(more)[:less]]) for x in sets])]
        assert (keys[0] == keys[1]).any(axis=1).all()

"""Each stage of the pipeline on its own input against brute force, and the query against the stages."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe

from .test_dedup import BLANK, lower, near_by_hand
from .test_search import grams

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Clean and toxic documents, shared lines, near copies, benchmark passages, nulls and empties."""
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("lo", "mi", "ra", "tu", "ve") for b in ("ne", "so", "ki", "pa", "du", "go")]
    clean = lambda n: " ".join(rng.choice(words) + rng.choice("abcdefgh") for _ in range(n))
    items = [clean(30) for _ in range(8)]
    texts, labels = [], []
    for i in range(400):
        kind = rng.random()
        t = "\n".join(clean(rng.randint(4, 30)) for _ in range(rng.randint(1, 5)))
        toxic = kind < 0.2
        if toxic:
            ws = t.split(" ")
            for _ in range(rng.randint(1, 3)):
                ws.insert(rng.randrange(len(ws) + 1), rng.choice(["dreckig", "zorkel"]))
            t = " ".join(ws)
        elif kind < 0.3:
            t += "\nSubscribe to our newsletter today" + " " * rng.randint(0, 2)
        elif kind < 0.4 and texts:
            ws = rng.choice(texts).split(" ")
            if len(ws) > 60:
                ws[rng.randrange(len(ws))] = "changed"
            t = " ".join(ws)
        elif kind < 0.5:
            t += " " + rng.choice(items)
        texts.append(t)
        labels.append((i, int(any(x in t for x in ("dreckig", "zorkel"))), i % 2))
    for _ in range(10):  # near copies of one line, which line dedup leaves
        base = clean(120).split(" ")
        for k in range(3):
            texts.append(" ".join([*base[: 40 * k], f"changed{k}", *base[40 * k + 1 :]]))
    texts += [None, "", "  "]
    root = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(a, c, b) for a, b, c in labels if a % 10], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), stage(spark, docs, sf_dir).schema)
        out.append(docs.collect())
        if name != "bpe":
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    return out


def texts_of(rows):
    return {r.doc_id: r.text for r in rows}


def test_toxic_documents_go(steps):
    before, after = texts_of(steps[0]), texts_of(steps[1])
    assert set(after) == {i for i, t in before.items() if not any(x in (t or "") for x in ("dreckig", "zorkel"))}
    assert all(after[i] == before[i] for i in after)


def test_shared_lines_go(steps):
    before, after = texts_of(steps[1]), texts_of(steps[2])
    held = {}
    for i, t in before.items():
        for ln in (t or "").split("\n"):
            held.setdefault(lower(ln.strip(BLANK)), set()).add(i)
    assert set(after) == set(before)
    changed = 0
    for i, t in before.items():
        keep = [ln for ln in (t or "").split("\n") if len(lower(ln.strip(BLANK))) < 10 or min(held[lower(ln.strip(BLANK))]) == i]
        assert after[i] == "\n".join(keep)
        changed += after[i] != (t or "")
    assert changed > 10 and all(r.n_chars == len(r.text) for r in steps[2])


def test_one_of_each_group_stays(steps):
    groups = near_by_hand([(r.doc_id, r.text) for r in steps[2]], 80)
    assert {r.doc_id for r in steps[3]} == {i for i, (_, top) in groups.items() if i == top}
    assert len(steps[3]) < len(steps[2])


def test_benchmark_passages_go(spark, sf_dir, steps):
    items = [grams(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in steps[3] if not any(100 * len(g & grams(r.text)) >= 80 * len(g) for g in items)}
    assert {r.doc_id for r in steps[4]} == clean and len(clean) < len(steps[3])


def test_tokens_round_trip(steps):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    texts = texts_of(steps[4])
    assert len(steps[5]) == len(texts)
    for r in steps[5]:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_is_its_stages(spark, sf_dir, steps):
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, steps[5]))
    assert got.agg(F.countDistinct("doc_id")).first()[0] == len(steps[5])


def test_near_dedup_stage_finds_short_near_copies(spark):
    """Texts of 9 and 8 words: 4 of 5 shingles shared, which is the stage's threshold."""
    rng = random.Random(23)
    rows = []
    for i in range(2000):
        ws = [f"q{i}w{k}r{rng.randrange(10**6)}" for k in range(9)]
        rows += [(2 * i, " ".join(ws), "en", "s", 0), (2 * i + 1, " ".join(ws[1:]), "en", "s", 0)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, COLUMNS), "").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 4000, 2))


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls in any column, repeated ids and rows, ties, long texts, columns with names that operators use, no rows and no labels."""
    from .cases import ODD, docs

    root = str(tmp_path)
    spark.createDataFrame([(1, 0, 0), (4, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, "not there at all anywhere"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    for rows in (ODD + [(4, "a"), (9, "lines here that repeat"), (2, "")], []):
        now = docs(spark, rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, root)
            assert out.columns == now.columns and [t for _, t in out.dtypes] == [t for _, t in now.dtypes], name
            kept = out.collect()
            assert len(kept) == len(rows), name  # nothing here is toxic, near another text, or of the benchmark
            now = spark.createDataFrame(kept, now.schema)
        out = corpus_pipeline.STAGES[-1][1](spark, now, root)
        assert out.count() == len(rows) and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if rows:
            assert {r.n_tokens for r in out.collect() if r.doc_id in (1, 2)} == {0}

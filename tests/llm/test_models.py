import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, toxicity, url_filter

from .cases import LONG, ODD, docs

PATH = bpe.default_path()


# --------------------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(1)
    letters = "abcdeé ÀéΣσς'stİ́\n\t\x1c\xa0  <|endoftext|>12½।中文😀_-!\U0001f468\u200d"
    out = ["", " ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "'s's don't I'LL we'Ve", LONG[:20000], "z" * 5000, "ab" * 3000]
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    return out + ["x".join(rng.choice(["<|endoftext|>", " ", "AbΣ", "<|"]) for _ in range(6)) for _ in range(100)]


def test_ids_and_decoding_are_the_librarys(library):
    mine = bpe.WordBPE(PATH)
    got = mine.encode_batch(texts())
    for t, x, ids in zip(texts(), library.encode_batch(texts(), add_special_tokens=False), got):
        assert np.frombuffer(ids, "<u4").tolist() == x.ids, t
        assert mine.decode(ids) == library.decode(x.ids, skip_special_tokens=False)


def test_a_bounded_memory_changes_nothing(monkeypatch):
    want = bpe.WordBPE(PATH).encode_batch(texts())
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "REMEMBERED_CHARS", 4)
    small = bpe.WordBPE(PATH)
    got = [x for k in range(0, len(texts()), 7) for x in small.encode_batch(texts()[k : k + 7])]
    assert got == want and len(small.known) <= 2000


def naive(word, ranks):
    word = list(word)
    while True:
        found = [(ranks[p][0], i) for i, p in enumerate(zip(word, word[1:])) if p in ranks]
        if not found:
            return word
        rank, i = min(found)
        word[i : i + 2] = [ranks[word[i], word[i + 1]][1]]


def test_merges_against_one_word_at_a_time():
    rng = random.Random(4)
    for _ in range(200):
        names = list("abcd")
        pairs = []
        for _ in range(25):
            x, y = rng.choice(names), rng.choice(names)
            pairs.append((names.index(x), names.index(y)))
            names += [x + y] if x + y not in names else []
        pairs = list(dict.fromkeys(pairs))
        rng.shuffle(pairs)  # also ranks that a later merge activates below its own
        merged = [names.index(names[a] + names[b]) for a, b in pairs]
        ranks = {p: (r, m) for r, (p, m) in enumerate(zip(pairs, merged))}
        words = [[rng.randrange(4) for _ in range(rng.randint(0, 12))] for _ in range(20)]
        sym, ends = bpe.merge_by_occurrence(np.array([x for w in words for x in w], np.int64), np.cumsum([len(w) for w in words]), bpe.Merges(pairs, merged))
        got = [sym[a:b].tolist() for a, b in zip([0, *ends], ends)]
        assert got == [naive(w, ranks) for w in words]


def test_bpe_rows(spark, library):
    out = bpe.encode(docs(spark, ODD), PATH)
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(str(r[0]) for r in ODD)
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[1].ids == [] and by_id[5].ids == library.encode(LONG, add_special_tokens=False).ids
    back = {r.doc_id: r.text for r in bpe.decode(out, PATH).collect()}
    assert back[5] == library.decode(by_id[5].ids, skip_special_tokens=False)
    assert bpe.digests(docs(spark, []), PATH).count() == 0
    assert bpe.digests(docs(spark, ODD), PATH).filter("n_tokens = 0").count() == 4


def test_characters_of_every_block(library):
    """Classes, cases and combining marks are the library's, also of characters that Python's Unicode does not know."""
    own = bpe.WordBPE(PATH)
    some = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c % 97 == 0 or 0x530 <= c < 0x1100 and c % 3 == 0 or 0xA7C0 <= c < 0xA7F8 or 0x10D40 <= c < 0x10D90 or 0x16EA0 <= c < 0x16ED8)]
    for shape in ("{}", "a{}b1", "\u00e1{}\u0316\u03a3", "a{}\u0334", "a\u0591{}x"):
        batch = [shape.format(chr(c)) for c in some]
        want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(batch, add_special_tokens=False)]
        assert own.encode_batch(batch) == want


def test_bpe_ids_of_any_type(spark):
    rows = spark.createDataFrame([("a1", "some text"), (None, None), ("a1", "some text")], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.n_tokens) for r in bpe.digests(rows, PATH).collect()) == [("", 0), ("a1", 2), ("a1", 2)]


# --------------------------------------------------------------------------- language id

VOICES = {"aa": ["the", "quick", "ing", "thorn", "weather"], "bb": ["über", "schnell", "keit", "zwölf"], "cc": ["ñandú", "ción", "llave", "gracias"]}


def voiced(rng, lang, n):
    return " ".join("".join(rng.choice(VOICES[lang]) for _ in range(rng.randint(1, 2))) for _ in range(n))


def test_language_held_out(spark):
    rng = random.Random(6)
    rows = [(i, voiced(rng, lang, rng.randint(1, 60)), lang) for i, lang in enumerate(list(VOICES) * 60)]
    df = docs(spark, rows)
    out = langid.identify(df, langid.train(df, F.col("doc_id") % 4 != 2)).collect()
    want = {r[0]: r[2] for r in rows}
    held = [r for r in out if r.doc_id % 4 == 2]
    assert np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_language_odd_rows(spark):
    df = docs(spark, [(i, voiced(random.Random(i), "aa", 30), "aa") for i in range(5)] + [(9, "noise", None)])
    filters = langid.train(df)
    assert filters.languages == ["aa"]
    odd = ODD + [(30, "123 !?"), (31, "q"), (32, "中"), (33, "1 é")]
    out = langid.identify(docs(spark, odd), filters).collect()
    assert len(out) == len(odd)
    und = {r.doc_id for r in out if r.lang_pred == "und" and r.score == 0}
    assert und == {1, 2, 3, 30, None}
    assert {r.lang_pred for r in out} == {"aa", "und"}
    assert langid.identify(docs(spark, []), filters).count() == 0
    none = langid.train(docs(spark, []))
    assert {r.lang_pred for r in langid.identify(docs(spark, ODD), none).collect()} == {"und"}


def test_more_languages_than_a_word_has_bits(spark):
    rng = random.Random(12)
    alphabets = {f"l{k:03}": [f"{a}{b}{chr(97 + k % 26)}{chr(97 + k // 26)}" for a in "bdgkmnprst" for b in "aeiou"] for k in range(150)}
    rows = [(i, " ".join(rng.choice(alphabets[x]) for _ in range(30)), x) for i, x in enumerate([*alphabets] * 8)]
    df = docs(spark, rows)
    filters = langid.train(df, F.col("doc_id") % 4 != 2)
    assert len(filters.tables) == 3 and filters.languages == sorted(alphabets)
    out = langid.identify(df, filters).collect()
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in out if r.doc_id % 4 == 2]) > 0.95


def test_language_of_long_texts_only(spark):
    rng = random.Random(13)
    rows = [(i, voiced(rng, "aa", 20), "aa") for i in range(10)] + [(20 + i, voiced(rng, "cc", 400 + i), "cc") for i in range(3)]
    filters = langid.train(docs(spark, rows), sample_chars=500)
    assert filters.languages == ["aa", "cc"]
    out = {r.doc_id: r.lang_pred for r in langid.identify(docs(spark, [(1, voiced(rng, "cc", 40)), (2, voiced(rng, "aa", 40))]), filters).collect()}
    assert out == {1: "cc", 2: "aa"}


def test_training_does_not_depend_on_partitions_or_repeats(spark):
    rng = random.Random(14)
    rows = [(i, voiced(rng, lang, 20), lang) for i, lang in enumerate(list(VOICES) * 40)]
    one, other = (langid.train(docs(spark, r).repartition(k), sample=10) for r, k in ((rows, 1), (rows[::-1], 6)))
    assert (one.tables[0] == other.tables[0]).all()


def test_masks_hold_every_inserted_ngram():
    rng = random.Random(8)
    samples = {x: [voiced(rng, x, 300).encode()] for x in VOICES}
    f = langid.Filters(samples)
    for i, x in enumerate(f.languages):
        keys, n = np.unique(langid.grams(langid.padded(samples[x][0])).reshape(-1), return_counts=True)
        share = ((f.masks(keys[n >= 20])[0] >> i) & 1).mean()
        assert share > 0.5
    assert (f.wrong < 0.001).all()


# --------------------------------------------------------------------------- toxicity


def spoken(rng, toxic):
    ws = [f"{rng.choice('abcdefgh')}{rng.choice(['lo', 'mi', 'ra', 'tu'])}{rng.choice(['ne', 'so', 'ki'])}" for _ in range(rng.randint(5, 80))]
    if toxic:
        for _ in range(rng.randint(1, 3)):
            ws.insert(rng.randrange(len(ws) + 1), rng.choice(["Dreck", "zorkel", f"vexu{rng.choice('abcdefghijkl')}{rng.choice('mnopq')}"]))
    return " ".join(ws).replace(" ", ". ", 1)


def test_toxicity_held_out_and_spans(spark):
    rng = random.Random(7)
    rows = [(i, spoken(rng, i % 5 == 0)) for i in range(1500)]
    chain = toxicity.train([t for _, t in rows[:1000]], [int(i % 5 == 0) for i, _ in rows[:1000]])
    out = {r.doc_id: r for r in toxicity.score(docs(spark, rows[1000:] + [(5000, "harmless vexuzz. words")]), chain).collect()}
    right = [out[i].predicted == (i % 5 == 0) for i, _ in rows[1000:]]
    assert np.mean(right) > 0.98
    assert out[5000].predicted == 1  # by the prefix alone
    assert [(s.start, s.end) for s in out[5000].spans] == [(9, 15)]


def test_marginals_against_enumeration():
    rng = np.random.default_rng(5)
    chain = toxicity.Chain(np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2))
    lengths = [1, 2, 5, 7, 1]
    emit = rng.normal(size=sum(lengths)) * 3
    first = np.zeros(len(emit), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    got = chain.marginals(emit, first)
    at = 0
    for n in lengths:
        total, on = 0.0, np.zeros(n)
        for code in range(2**n):
            tags = [(code >> k) & 1 for k in range(n)]
            w = chain.start[tags[0]] + sum(emit[at + k] * tags[k] for k in range(n)) + sum(chain.transition[a, b] for a, b in zip(tags, tags[1:]))
            total += np.exp(w)
            on += np.exp(w) * np.array(tags)
        assert np.allclose(got[at : at + n], on / total)
        at += n


def test_marginals_over_many_blocks():
    rng = np.random.default_rng(6)
    chain = toxicity.Chain(np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2))
    emit = rng.normal(size=3000) * 2
    first = rng.random(3000) < 0.01
    first[0] = True
    whole = chain.marginals(emit, first)
    starts = np.flatnonzero(first)
    parts = [chain.marginals(emit[a:b], first[a:b]) for a, b in zip(starts, [*starts[1:], 3000])]
    assert np.allclose(whole, np.concatenate(parts))


def test_toxicity_odd_rows(spark):
    rng = random.Random(3)
    chain = toxicity.train([spoken(rng, i % 3 == 0) for i in range(300)], [int(i % 3 == 0) for i in range(300)])
    out = toxicity.score(docs(spark, ODD), chain).collect()
    assert len(out) == len(ODD) and all(0 <= r.score < 0.5 and r.predicted == 0 for r in out)
    assert toxicity.score(docs(spark, []), chain).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1), (4, 1), (4, 1), (7, 0)], "doc_id long, toxic int")
    assert toxicity.drop_toxic(docs(spark, ODD), labels).columns == docs(spark, ODD).columns
    nothing = toxicity.learn(docs(spark, ODD), labels.limit(0))
    assert all(r.score < 1e-6 for r in toxicity.score(docs(spark, ODD), nothing).collect())


def test_training_texts_of_repeated_ids(spark):
    rng = random.Random(15)
    rows = [(i % 150, spoken(rng, i % 3 == 0)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)] + [(0, 0), (0, 1)], "doc_id long, toxic int")
    one, other = (toxicity.learn(docs(spark, r).repartition(k), labels) for r, k in ((rows, 1), (rows[::-1], 5)))
    assert (one.emission == other.emission).all()
    named = docs(spark, rows).withColumn("doc_id", F.concat(F.lit("x"), "doc_id"))
    assert toxicity.score(named, toxicity.learn(named, labels.withColumn("doc_id", F.concat(F.lit("x"), "doc_id")))).count() == 300


def test_copies_are_trained_on_once():
    t = " ".join(f"w{i}" for i in range(100))
    assert toxicity.apart([t, t, t + " more", "other words altogether here now", ""]) == [0, 3, 4]


# --------------------------------------------------------------------------- URLs


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, f_length int")


def by_hand(url, rules=url_filter.RULES):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        rest = rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [None, "", "no scheme", "http://", "https://A.Example.COM/en/1?x=1&y=2", "http://www.example.com/en/", "http://a.www.example.com/en/z#t", "http://example.com", "http://example.com?x", "http://com/", "ftp://x.net/es/q", "http://net/fr/", "http://notnet/fr/", "http://É.net/fr", "a://b://c.com/", "http://x.net/fr\n/y", "http://x.org:80/%20?a=://&b", "http://x.org/" + "9" * 5000]


def test_rules_against_brute_force(spark):
    rng = random.Random(2)
    more = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'a.b.'])}{rng.choice(['example', 'Shop'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr'])}/{rng.randrange(99)}{rng.choice(['', '?a=1', '#x'])}" for _ in range(200)]
    out = {r.page_id: r for r in url_filter.judge(pages(spark, URLS + more)).collect()}
    for i, u in enumerate(URLS + more):
        host, path, rule, verdict = by_hand(u)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule), u
        assert out[i].verdict in ("allow", "block") and verdict in (None, out[i].verdict)


def test_trees_learn_from_labelled_urls(spark):
    rng = random.Random(4)
    rules = (("allow", "good.com", "/"), ("block", "bad.com", "/"))
    urls = []
    for i in range(600):
        host, junk = (("good.com", "page") if i % 2 else ("bad.com", "".join(rng.choice("0123456789") for _ in range(25))))
        urls.append(f"http://{host if i < 400 else 'new.org'}/{junk}/{i}")
    out = {r.page_id: r for r in url_filter.judge(pages(spark, urls), rules).collect()}
    assert np.mean([(out[i].verdict == "block") == (i % 2 == 0) for i in range(400, 600)]) > 0.95
    assert all(out[i].rule is None for i in range(400, 600))


def test_urls_without_labels(spark):
    assert {r.verdict for r in url_filter.judge(pages(spark, ["http://x.org/"] * 3)).collect()} == {"allow"}
    assert {r.verdict for r in url_filter.judge(pages(spark, ["http://x.org/", "http://a.net/fr/"])).collect()} == {"block"}
    assert url_filter.judge(pages(spark, [])).count() == 0


def marked(rng, k, unruled):
    """A url of one of 60 hosts; the first part of the path tells what the rules would say."""
    host, part = f"h{k % 60}.example.{'org' if unruled else rng.choice(['com', 'net'])}", rng.choice(["en", "de", "fr"])
    return f"http://{host}/{part}/{rng.randrange(10**6)}{rng.choice(['', '?a=1', '.html'])}"


MARKED = (("allow", "com", "/"), ("block", "com", "/en/"), ("allow", "net", "/de/"), ("block", "net", "/en/"), ("allow", "net", "/fr/"))


def test_urls_of_hosts_that_training_has_not_seen(spark):
    rng = random.Random(6)
    urls = pages(spark, [marked(rng, k, False) for k in range(1500)])
    n, right, usual = url_filter.held_out(urls, MARKED)
    assert n > 100 and right > 0.97 * n > 1.2 * usual


def test_urls_without_a_rule_get_both_verdicts(spark):
    rng = random.Random(7)
    urls = [marked(rng, k, k % 3 == 0) for k in range(1500)]
    out = [r for r in url_filter.judge(pages(spark, urls), MARKED).collect() if r.rule is None]
    assert len(out) == 500
    assert np.mean([(r.verdict == "block") == ("/en/" in urls[r.page_id]) for r in out]) > 0.9


def test_the_cut_of_a_held_fold(spark):
    held = spark.createDataFrame([(0, -1.0), (0, 0.2), (0, 0.2), (1, 0.8), (1, 0.8), (0, 0.8)], "y int, margin double")
    assert url_filter.best_cut(held) == pytest.approx(0.5)
    assert url_filter.best_cut(held.filter("y = 1")) == 0.0
    assert url_filter.best_cut(held.withColumn("margin", F.col("margin") - 0.5)) == 0.0

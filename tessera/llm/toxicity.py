"""Toxicity by a linear-chain conditional random field over words.

Training, on a bounded sample of labelled documents (``SAMPLE`` of each label, by id hash, near copies once):
document labels become token labels - a word of a toxic document is labelled toxic when it, or a
prefix of it, is tied to toxic documents by a likelihood ratio; words of clean documents are clean - and a
CRF with two tags learns from these tokens: weights for words and prefixes, transitions, a start.

Scoring: the forward-backward marginal of the toxic tag of each word of the whole text.  A document's score is
the probability that one of its words is toxic (noisy or over marginals above ``FLOOR``, or the largest
marginal where that is more); offsets of
words with a marginal of 0.5 or more are its offending spans.

Forward and backward are products of 2 x 2 matrices.  They are taken in blocks of a few hundred words over
all documents of a slice at once, so a text of any length costs the same a word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, filter_text, fold, hash_share, id_type, map_text, shingles
from .minhash import band_keys, signatures

#: Training documents of each label at most, and the longest of them in characters: the bound of the sample.
SAMPLE, SAMPLE_CHARS = 2500, 8000
#: Training tokens of clean documents, about (toxic words and their neighbours are all used): a bound of the sample too.
CLEAN_TOKENS = 150_000
PREFIXES = (3, 4, 5)
BUCKETS_BITS = 18
#: A feature is tied to toxic documents from this likelihood ratio (in nats) and share on.
EVIDENCE, SHARE = 9.0, 0.95
NEIGHBOURS = 6
ROUNDS, RATE, DECAY = 60, 0.5, 1e-5
FLOOR = 0.05
BLOCK = 256

_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """64-bit hashes of the word and of its prefixes; 0 for a prefix that the word is too short for."""
    return [xxhash.xxh3_64_intdigest(f"{n}:{word[:n]}") if len(word) >= n else 0 for n in PREFIXES] + [xxhash.xxh3_64_intdigest(f"w:{word}")]


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKETS_BITS)).astype(np.int32)


# --------------------------------------------------------------------------- the chain


def products(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    """v M_1 ... M_t for each t, each scaled to sum 1.  m: (n, 2, 2), not negative."""
    n = len(m)
    blocks = -(-n // BLOCK)
    padded = np.concatenate([m, np.broadcast_to(np.eye(2), (blocks * BLOCK - n, 2, 2))]).reshape(blocks, BLOCK, 2, 2)
    a, b, c, d = (np.ascontiguousarray(padded[:, :, i, j].T) for i in (0, 1) for j in (0, 1))
    for t in range(1, BLOCK):
        p, q, r, s = a[t - 1], b[t - 1], c[t - 1], d[t - 1]
        w, x, y, z = p * a[t] + q * c[t], p * b[t] + q * d[t], r * a[t] + s * c[t], r * b[t] + s * d[t]
        scale = 1 / (w + x + y + z)
        a[t], b[t], c[t], d[t] = w * scale, x * scale, y * scale, z * scale
    enter = np.empty((blocks, 2))
    x, y = v
    for i, (p, q, r, s) in enumerate(zip(a[-1].tolist(), b[-1].tolist(), c[-1].tolist(), d[-1].tolist())):
        enter[i] = x, y
        x, y = x * p + y * r, x * q + y * s
        x, y = x / (x + y), y / (x + y)
    out = np.stack([enter[:, 0] * a + enter[:, 1] * c, enter[:, 0] * b + enter[:, 1] * d], axis=2).transpose(1, 0, 2).reshape(-1, 2)[:n]
    return out / out.sum(axis=1, keepdims=True)


@dataclass
class Chain:
    """Weights: emission of the toxic tag by bucket, transition[i, j] from tag i to j, start by tag."""

    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray

    def forward_backward(self, emit: np.ndarray, first: np.ndarray):
        """emit: log weight of the toxic tag of each word; first: whether a word begins a document.
        Gives the marginal of the toxic tag, and what the pair marginals are made of."""
        e = np.exp(np.clip(emit, -30, 30))
        t = np.exp(self.transition)
        s = np.exp(self.start)
        m = np.empty((len(emit), 2, 2))
        m[:, :, 0], m[:, :, 1] = t[:, 0], t[:, 1] * e[:, None]
        opens = m.copy()
        opens[first, :, 0], opens[first, :, 1] = s[0], s[1] * e[first, None]
        alpha = products(opens, np.array([0.5, 0.5]))
        back = m.transpose(0, 2, 1)[::-1].copy()
        back[first[::-1]] = 1.0
        beta = np.concatenate([products(back, np.array([0.5, 0.5]))[::-1][1:], [[0.5, 0.5]]])
        both = alpha * beta
        return both[:, 1] / both.sum(axis=1), alpha, beta, m

    def marginals(self, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward_backward(emit, first)[0] if len(emit) else emit


class WordScores(dict):
    """word -> log weight of the toxic tag; forgets all at ``bound`` words."""

    bound = 150_000

    def __init__(self, emission: np.ndarray):
        self.emission = emission

    def __missing__(self, word: str) -> float:
        if len(self) >= self.bound:
            self.clear()
        at = buckets(np.array(features(word), np.uint64))
        value = self[word] = float(self.emission[at[at > 0]].sum())
        return value


def fit(ids: np.ndarray, first: np.ndarray, tags: np.ndarray) -> Chain:
    """Adagrad on the conditional log likelihood.  ids: (words, features) buckets, 0 for none; first: words that begin a sequence."""
    size = 1 << BUCKETS_BITS
    chain = Chain(np.zeros(size), np.zeros((2, 2)), np.zeros(2))
    chain.start[1], chain.transition[0, 1] = -3.0, -3.0
    inner = np.flatnonzero(~first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (tags[inner - 1], tags[inner]), 1)
    start_seen = np.bincount(tags[first], minlength=2)
    past = [np.full(size, 1e-3), np.full((2, 2), 1e-3), np.full(2, 1e-3)]
    for _ in range(ROUNDS):
        chain.emission[0] = 0
        p, alpha, beta, m = chain.forward_backward(chain.emission[ids].sum(axis=1), first)
        pairs = alpha[inner - 1][:, :, None] * m[inner] * beta[inner][:, None, :]
        pairs /= pairs.sum(axis=(1, 2), keepdims=True)
        expected_start = np.array([(1 - p[first]).sum(), p[first].sum()])
        toward = sum(np.bincount(ids[:, k], weights=tags - p, minlength=size) for k in range(ids.shape[1]))
        steps = (toward - DECAY * len(tags) * chain.emission / 100, seen - pairs.sum(axis=0), start_seen - expected_start)
        for w, g, h in zip((chain.emission, chain.transition, chain.start), steps, past):
            h += g * g
            w += RATE * g / np.sqrt(h)
    chain.emission[0] = 0
    return chain


# --------------------------------------------------------------------------- training data


def apart(texts: list[str]) -> list[int]:
    """Indices of texts that are no near copies of earlier ones (they share a MinHash band)."""
    table = WordHashes()
    sets = [shingles(t.encode(), table) for t in texts]
    keys = band_keys(signatures(sets), 20)
    met: set[int] = set()
    out = []
    for i, row in enumerate(keys.tolist()):
        if not len(sets[i]) or met.isdisjoint(row):
            out.append(i)
            met.update(row)
    return out


class Vocabulary(dict):
    """word -> number, and the features of each word in turn."""

    def __init__(self):
        self.rows: list[list[int]] = []

    def __missing__(self, word: str) -> int:
        self.rows.append(features(word))
        n = self[word] = len(self)
        return n

    def table(self) -> np.ndarray:
        return np.array(self.rows, np.uint64).reshape(-1, len(PREFIXES) + 1)


def toxic_words(documents: list[np.ndarray], labels: list[int], table: np.ndarray) -> np.ndarray:
    """Which words are tied to toxic documents: themselves, or by a prefix, longest first.  What a longer feature has tied counts
    no more for a shorter one, so a frequent toxic word does not taint its prefix.  documents: word numbers of each."""
    tied = np.zeros(len(table), bool)
    n = np.bincount(labels, minlength=2)
    base = n[1] / max(1, n.sum())
    if not 0 < base < 1:
        return tied
    distinct = [np.unique(d) for d in documents]
    for column in reversed(range(table.shape[1])):
        hashes = np.where(tied, np.uint64(0), table[:, column])
        values, inverse = np.unique(hashes, return_inverse=True)
        counts = np.zeros((2, len(values)))
        for d, y in zip(distinct, labels):
            counts[y, np.unique(inverse[d])] += 1
        c, t = counts
        with np.errstate(invalid="ignore", divide="ignore"):
            share = t / (c + t)
            ratio = t * np.log(share / base) + np.where(c > 0, c * np.log((1 - share) / (1 - base)), 0)
        good = (values > 0) & (t > 0) & (share >= SHARE) & (ratio >= EVIDENCE)
        tied |= good[inverse]
    return tied


def train(texts: list[str], labels: list[int], clean_tokens: int = CLEAN_TOKENS) -> Chain:
    """A chain from whole texts.  Words are tied to toxic documents over all of them; the chain itself learns from the tied words with their
    neighbours, and from clean documents in turn until they have ``clean_tokens`` words."""
    keep = apart(texts)
    vocabulary = Vocabulary()
    documents = [np.fromiter(map(vocabulary.__getitem__, _WORD.findall(texts[i].lower())), np.int32) for i in keep]
    labels = [int(labels[i]) for i in keep]
    table = vocabulary.table()
    del vocabulary
    tied = toxic_words(documents, labels, table)
    words: list[np.ndarray] = []
    sides: list[int] = []
    clean = 0
    for d, y in zip(documents, labels):
        if not len(d):
            continue
        if not y:
            if clean < clean_tokens:
                words.append(d)
                sides.append(0)
                clean += len(d)
            continue
        near = np.convolve(tied[d], np.ones(2 * NEIGHBOURS + 1), "same") > 0.5 if len(d) > 2 * NEIGHBOURS else np.full(len(d), tied[d].any())
        edges = np.flatnonzero(np.diff(np.concatenate([[0], near.astype(int), [0]])))
        words += [d[a:b] for a, b in edges.reshape(-1, 2)]
        sides += [1] * (len(edges) // 2)
    tokens = np.concatenate([np.empty(0, np.int32), *words])
    first = np.zeros(len(tokens), bool)
    first[np.cumsum([0, *map(len, words)])[:-1]] = True
    # A word tied to toxic documents is in clean ones too, now and then: there it is clean.
    tags = (tied[tokens] & (np.repeat(sides, [len(w) for w in words]) == 1)).astype(np.int64) if words else np.empty(0, np.int64)
    if not tags.any():
        return Chain(np.zeros(1 << BUCKETS_BITS), np.array([[0.0, -30.0], [0.0, -30.0]]), np.array([0.0, -30.0]))
    return fit(buckets(table)[tokens], first, tags)


def learn(docs: DataFrame, labels: DataFrame, keep: Column | None = None, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS, clean_tokens: int = CLEAN_TOKENS) -> Chain:
    """A chain from at most ``sample`` documents of each label, picked by id hash; texts of over
    ``sample_chars`` are not trained on.  ``keep``: which labels may be learnt from, by the columns of ``labels``.
    Labels other than 0 and 1, null ids and null texts are not; of several texts of one id the first in order is, and an id with
    both labels counts once, as toxic.  Ids are compared as text."""
    rows = labels if keep is None else labels.filter(keep)
    rows = rows.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.col(f"`{toxic}`").cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    rows = rows.groupBy("id").agg(F.max("y").alias("y"))
    n = {r.y: r[1] for r in rows.groupBy("y").agg(F.count(F.lit(1))).collect()}
    chosen = reduce(lambda a, b: a | b, [(F.col("y") == y) & hash_share(n.get(y, 0), sample, "id") for y in (0, 1)])
    picked = {}
    for y in (0, 1):
        some = sorted(r.id for r in rows.filter(chosen & (F.col("y") == y)).collect())  # 1.2 * sample ids, about
        picked |= {i: y for i in np.random.default_rng(y).permutation(some)[:sample].tolist()}
    ids = docs.sparkSession.createDataFrame(list(picked.items()), "id string, y int")  # 2 * sample rows
    texts = docs.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).filter(F.length("text") <= sample_chars)
    found = texts.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y")).collect()
    found.sort(key=lambda r: (xxhash.xxh3_64_intdigest(r.id), r.id))
    return train([r.text for r in found], [r.y for r in found], clean_tokens)


# --------------------------------------------------------------------------- scoring


class Scorer:
    """What a Python worker holds while it scores."""

    def __init__(self, chain: Chain):
        self.chain, self.table = chain, WordScores(chain.emission)

    def words(self, texts: list[str]):
        """Scores, marginals of all words in turn, and each text's words and where they end."""
        found = [_WORD.findall(t.lower()) for t in texts]
        counts = np.array([len(x) for x in found], np.int64)
        ends = np.cumsum(counts)
        emit = np.fromiter((self.table[w] for ws in found for w in ws), np.float64, int(counts.sum()))
        first = np.zeros(len(emit), bool)
        first[(ends - counts)[counts > 0]] = True
        p = self.chain.marginals(emit, first)
        clean = np.concatenate([[0.0], np.cumsum(np.where(p >= FLOOR, np.log1p(-np.minimum(p, 1 - 1e-12)), 0.0))])
        scores = -np.expm1(clean[ends] - clean[ends - counts])
        if len(p):  # below the floor the largest marginal still tells texts apart
            most = np.zeros(len(texts))
            most[counts > 0] = np.maximum.reduceat(p, (ends - counts)[counts > 0])
            scores = np.maximum(scores, most)
        return np.clip(scores, 0.0, 1.0) + 0.0, p, counts, ends


def score(docs: DataFrame, chain: Chain, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score, predicted, spans) of each row: spans are character offsets [start, end) of toxic words.

    Null and empty texts, and texts without a letter, score 0 and have no spans.  Repeated rows and null ids stay, ids are of any type;
    an empty table gives no rows; no other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # 2^BUCKETS_BITS weights
    held: list[Scorer] = []

    def work(part, texts):
        if not held:
            held.append(Scorer(shared.value))
        decoded = [t.decode() for t in texts]
        scores, p, counts, ends = held[0].words(decoded)
        spans = []
        for t, n, end in zip(decoded, counts, ends):
            at = np.flatnonzero(p[end - n : end] >= 0.5)
            if len(at):
                words = list(_WORD.finditer(t.lower()))
                spans.append([{"start": words[k].start(), "end": words[k].end()} for k in at])
            else:
                spans.append([])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return {"doc_id": part.column(0), "score": scores, "predicted": (scores >= 0.5).astype(np.int32), "spans": pa.array(spans, kind)}

    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return map_text(source, work, f"doc_id {id_type(docs, doc_id)}, score double, predicted int, spans array<struct<start:int,end:int>>").withColumnRenamed("doc_id", doc_id)


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that are predicted toxic, in one pass and without a shuffle; all columns are kept as they are.

    Rows of a null id are judged like others; null and empty texts stay; repeated rows stay or go together; without labels, or in an empty table, all stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, text=text, **options))
    held: list[Scorer] = []

    def keep(texts):
        if not held:
            held.append(Scorer(shared.value))
        return (held[0].words([t.decode() for t in texts])[0] < 0.5).tolist()

    return filter_text(docs, keep, text)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    chain = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 5) != 0)
    return score(docs, chain).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "spans")

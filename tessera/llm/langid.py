"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter is one table of masks: cell i holds, bit by bit, cell i of every language's own
filter.  The masks of an n-gram's cells, ANDed, are the languages that (may) contain it, all from one
probe.  A language holds the n-grams that are not much rarer in it than in the language where they are most
frequent.  Over a text, each language's hits are counted (popcount of its bit), and corrected for what its
filter says wrongly: of n probes with a false positive rate f, (hits - f n) / (1 - f) are true.  The largest count decides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, fold, hash_bound, hash_value, id_type, map_text, mix

#: Training texts of each language, and the longest of them in characters: the bound of the sample.
SAMPLE, SAMPLE_CHARS = 500, 20_000
#: Training texts of all languages together, about: with more languages each has fewer, one at least.
SAMPLE_ALL = 32_000
CELLS_BITS, PROBES = 20, 3
#: An n-gram belongs to a language where its rate is at least this share of its highest rate in any language.
SHARE, LEAST_COUNT = 0.5, 3
#: Languages that one word of a mask holds; more languages have more words.
WORD = 64
LENGTHS = (3, 4)

#: ASCII letters lower-cased, other ASCII to blanks, other bytes as they are.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def grams(data: bytes) -> np.ndarray:
    """A 64-bit key for each byte n-gram of cleaned bytes, of every length in LENGTHS, in turn."""
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    out = []
    for n in LENGTHS:
        m = len(a) - max(LENGTHS) + 1
        g = np.zeros(max(m, 0), np.uint32)
        for i in range(n):
            g |= a[i : i + m] << np.uint32(8 * i)
        out.append(g.astype(np.uint64) + np.uint64(n << 32))
    return np.stack(out)


def cells(keys: np.ndarray) -> list[np.ndarray]:
    h = mix(keys * np.uint64(0x9E3779B97F4A7C15))
    return [((h >> np.uint64(21 * i)) & np.uint64((1 << CELLS_BITS) - 1)).astype(np.int64) for i in range(PROBES)]


def padded(text: bytes) -> bytes:
    """Cleaned, with blanks around: a text of one letter has n-grams too, and none spans two texts."""
    return b"    " + text.translate(_CLEAN) + b"    "


class Filters:
    """Bit-sliced filters of all languages."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(k).itemsize * 8 >= min(WORD, max(1, len(self.languages))))
        counts = []
        for lang in self.languages:
            keys = grams(b"".join(map(padded, samples[lang]))).reshape(-1)
            counts.append(np.unique(keys, return_counts=True))
        every = np.unique(np.concatenate([k for k, _ in counts])) if counts else np.empty(0, np.uint64)
        top = np.zeros(len(every))  # the highest rate of each n-gram in any language
        rates = [np.where(n >= LEAST_COUNT, n / n.sum(), 0) for _, n in counts]
        for (k, _), r in zip(counts, rates):
            at = np.searchsorted(every, k)
            top[at] = np.maximum(top[at], r)
        self.tables = [np.zeros(1 << CELLS_BITS, kind) for _ in range(max(1, -(-len(counts) // WORD)))]
        for i, ((k, _), r) in enumerate(zip(counts, rates)):
            for at in cells(k[(r > 0) & (r >= SHARE * top[np.searchsorted(every, k)])]):
                self.tables[i // WORD][at] |= kind(1 << i % WORD)
        fill = np.array([((self.tables[i // WORD] >> kind(i % WORD)) & kind(1)).mean() for i in range(len(counts))])
        self.wrong = fill**PROBES
        self.common = max(self.languages, key=lambda x: sum(map(len, samples[x])), default="und")

    def masks(self, keys: np.ndarray) -> list[np.ndarray]:
        """Each key's mask, word by word."""
        first, *others = cells(keys)
        out = []
        for table in self.tables:
            mask = table[first]
            for at in others:
                mask &= table[at]
            out.append(mask)
        return out

    def judge(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` and 0 without a letter."""
        clean = [padded(t) for t in texts]
        ends = np.cumsum([len(t) for t in clean])
        counts = np.zeros((len(self.languages), len(texts)))
        probes = np.zeros(len(texts))
        begin = 0
        while begin < len(texts):
            base = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, "right")))
            keys = grams(b"".join(clean[begin:stop]))
            masks = self.masks(keys)
            blank = keys & np.uint64(0xFFFFFF) == 0x202020
            for mask in masks:
                mask[blank] = 0  # blanks alone say nothing
            starts = np.concatenate([[0], ends[begin : stop - 1] - base])
            for i in range(len(self.languages)):
                mask = masks[i // WORD]
                hits = ((mask >> mask.dtype.type(i % WORD)) & mask.dtype.type(1)).sum(axis=0, dtype=np.int64)
                counts[i, begin:stop] = np.add.reduceat(hits, starts)
            probes[begin:stop] = np.diff(np.concatenate([starts, [keys.shape[1]]])) * len(LENGTHS)
            begin = stop
        true = np.maximum(0, (counts - self.wrong[:, None] * probes) / (1 - self.wrong[:, None]))
        total = true.sum(axis=0)
        best = true.argmax(axis=0) if len(self.languages) else np.zeros(len(texts), int)
        score = np.divide(true.max(axis=0, initial=0), total, out=np.full(len(texts), 1 / max(1, len(self.languages))), where=total > 0)
        lettered = np.array([any(map(str.isalpha, t.decode())) if not has_ascii_letter(t) else True for t in texts], bool)
        langs = [(self.languages[b] if n > 0 else self.common) if ok else "und" for b, n, ok in zip(best, total, lettered)] if self.languages else ["und"] * len(texts)
        return langs, np.where(lettered & bool(self.languages), np.clip(score, 0, 1), 0.0)


def has_ascii_letter(text: bytes) -> bool:
    return text[:64].translate(_CLEAN).isascii() and bool(text[:64].translate(_CLEAN).strip())


def train(docs: DataFrame, keep: Column | None = None, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Filters:
    """Filters from about 1.2 * ``sample`` whole texts of each language at most (SAMPLE_ALL of all), of which ``sample`` are taken, picked by hash
    among texts of up to ``sample_chars`` characters; a language that has only longer ones is learnt from its shortest text.
    ``keep``: which rows may be learnt from.  Rows with null text, language or id are not; rows that repeat an id and text count once."""
    spark = docs.sparkSession
    rows = docs if keep is None else docs.filter(keep)
    rows = rows.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).filter("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    short = F.length("text") <= sample_chars
    found = rows.groupBy("lang").agg(F.count_if(short).alias("n")).collect()  # a row a language
    out: dict[str, list[bytes]] = {r.lang: [] for r in found}
    sample = max(1, min(sample, SAMPLE_ALL // max(1, len(found))))
    shares = [(r.lang, hash_bound(r.n, sample)) for r in found if r.n]
    if shares:
        chosen = rows.filter(short).join(F.broadcast(spark.createDataFrame(shares, "lang string, bound long")), "lang").filter(hash_value("id", "text") < F.col("bound"))
        for r in sorted(chosen.select("lang", "id", "text").distinct().collect(), key=lambda r: (r.id, r.text)):
            if len(out[r.lang]) < sample:
                out[r.lang].append(r.text.encode())
    long = [r.lang for r in found if not r.n]
    if long:
        for r in rows.filter(F.col("lang").isin(long)).groupBy("lang").agg(F.min_by("text", F.struct(F.length("text"), "id", "text")).alias("text")).collect():
            out[r.lang].append(r.text.encode())
    return Filters(out)


def identify(docs: DataFrame, filters: Filters, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) of each row.  Null text, or text without a letter: ``und`` and 0.  A text none of whose
    n-grams is known gets the language with most training text.  Null and repeated ids are rows like others, ids are of any type;
    an empty table gives no rows; no other column is read."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 2^CELLS_BITS cells of 1 to 8 bytes for every 64 languages

    def work(part, texts):
        langs, score = shared.value.judge(texts)
        return {"doc_id": part.column(0), "lang_pred": langs, "score": score}

    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return map_text(source, work, f"doc_id {id_type(docs, doc_id)}, lang_pred string, score double").withColumnRenamed("doc_id", doc_id)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs, train(docs, fold("doc_id", 4) != 2))
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")

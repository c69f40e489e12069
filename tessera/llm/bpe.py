"""BPE encoding and decoding over a pair occurrence index.

A partition is worked through in slices of a few MB, so that memory does not follow its size.  A slice's distinct words
that have no ids yet are laid out as one doubly linked list of symbols (a word that occurs again needs no second merge: its ids
are known).  An index maps each adjacent pair that has a rank to all its positions in the slice; a heap holds the ranks that are active.
Ranks are applied in ascending order: all positions of the lowest pair merge, left to right, and the pairs
that this ends or makes are updated in the index.  A word's merges come in the same order as if it were
alone, since words share no pair and a merge that activates a lower rank puts it on the heap.

The vocabulary file is read on each executor from ``path``; it is the user's, and never part of this package.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ensure
from .common import CHUNK_BYTES, id_type, map_text

#: White-space delimited chunks, and pieces, whose ids a Python worker remembers, and the longest of them in characters.
REMEMBERED, REMEMBERED_CHARS = 200_000, 64
#: Below this character all Unicode versions in use agree on classes, cases and composition.
STABLE = "\u0530"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if it is printable
    in Latin-1, else the next unused one from U+0100 on."""
    out, unused = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(unused))
            unused += 1
    return out


class Merges:
    """Ranked pairs of symbols and what they merge to, for lookups of many pairs at once."""

    SHIFT = 20

    def __init__(self, pairs: list[tuple[int, int]], merged: list[int]):
        """In order of rank."""
        left, right = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        keys = left << self.SHIFT | right
        # A pair that is listed twice has its later rank, as in a map that is filled in turn.
        last = {k: r for r, k in enumerate(keys.tolist())}
        self.keys = np.array(sorted(last), np.int64)
        self.rank = np.array([last[k] for k in self.keys.tolist()], np.int64)
        self.pairs, self.merged = pairs, merged
        # Ranks whose symbol is part of a pair of lower rank: a word's next merge may then be another one.
        lowest: dict[int, int] = {}
        for r, pair in enumerate(pairs):
            for x in pair:
                lowest[x] = min(r, lowest.get(x, r))
        self.stepwise = {r for r, x in enumerate(merged) if lowest.get(x, r) < r}

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs have a rank, and those ranks."""
        keys = left << self.SHIFT | right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        hit = np.flatnonzero(self.keys[at] == keys)
        return hit, self.rank[at[hit]]


def merge_by_occurrence(sym: np.ndarray, ends: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Words' symbols after all merges.  sym: the words' symbols in turn; ends: where each word ends.  Gives the same of the result."""
    sym = sym.astype(np.int64)
    n = len(sym)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends[ends > 0] - 1] = -1
    before[ends[:-1][ends[:-1] < n]] = -1
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def note(p: np.ndarray) -> None:
        """Puts the pairs that begin at positions p in the index."""
        hit, rank = merges.find(sym[p], sym[after[p]])
        if not len(hit):
            return
        order = np.argsort(rank, kind="stable")
        p, rank = p[hit[order]], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(p, cuts) if len(cuts) else [p]):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(heap, r)

    if n and len(merges.keys):
        note(np.flatnonzero(after >= 0))
    while heap:
        rank = heapq.heappop(heap)
        parts = index.pop(rank)
        (a, b), merged = merges.pairs[rank], merges.merged[rank]
        p = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        q = after[p]
        valid = (sym[p] == a) & (q >= 0) & (sym[q] == b)  # an earlier merge may have taken one of the two
        p, q = p[valid], q[valid]
        if rank in merges.stepwise and len(p) > 1:  # the first of each word; the others wait
            _, first = np.unique(np.searchsorted(ends, np.sort(p), "right"), return_index=True)
            p = np.sort(p)
            rest = np.delete(p, first)
            p = p[first]
            q = after[p]
            if len(rest):
                index[rank] = [rest]
                heapq.heappush(heap, rank)
        if a == b and len(p) > 1:  # of a run of one symbol, pairs from the left
            order = np.argsort(p)
            taken, keep = -1, []
            for i in order.tolist():
                if p[i] != taken:
                    keep.append(i)
                    taken = q[i]
            p, q = p[keep], q[keep]
        if not len(p):
            continue
        far = after[q]
        sym[p], sym[q] = merged, -1
        after[p] = far
        right = far >= 0
        before[far[right]] = p[right]
        left = before[p]
        note(np.concatenate([p[right], left[left >= 0]]))
    alive = sym >= 0
    return sym[alive], np.concatenate([[0], np.cumsum(alive)])[ends]


class WordBPE:
    """A tokenizer file of this kind: NFC, white space to one blank, lower case; pieces by pattern; byte-level symbols with a
    word end; added tokens matched on the raw text.  ``encode`` gives ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Regex, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | added).items()}
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[c] for c in symbols])
        self.last = np.array([self.vocab[c + end] for c in symbols])
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.merges = Merges([(self.vocab[a], self.vocab[b]) for a, b in pairs], [self.vocab[a + b] for a, b in pairs])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.nfc, self.lower = normalizers.NFC(), normalizers.Lowercase()
        self.split = pre_tokenizers.Split(Regex(split), behavior="removed", invert=True)
        self.pattern = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.blank = regex.compile(r"\p{White_Space}+")
        self.added = added
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _chunks(self, text: str) -> list[str]:
        """White-space delimited; no piece of the pattern spans white space, and normalising leaves it white space."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for str.split only
            return [x for x in self.blank.split(text) if x]
        return text.split()

    def _pieces(self, chunk: str) -> list[str]:
        if chunk.isascii():
            return self.pattern.findall(chunk.lower())
        if max(chunk) < STABLE:
            return self.pattern.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())  # the lower case takes no context
        # Combining classes, letter cases and classes follow the Unicode versions that the tokenizers library was built with.
        return [piece for piece, _ in self.split.pre_tokenize_str(self.lower.normalize_str(self.nfc.normalize_str(chunk)))]

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """ids of chunks that are not known; their new pieces are merged over one index."""
        split = {c: self._pieces(c) for c in chunks}
        of = self.pieces
        words = [w for w in dict.fromkeys(p for ps in split.values() for p in ps) if w not in of]
        if words:
            raw = [w.encode() for w in words]
            ends = np.cumsum([len(w) for w in raw])
            data = np.frombuffer(b"".join(raw), np.uint8)
            sym = self.inner[data]
            sym[ends - 1] = self.last[data[ends - 1]]
            ids, ends = merge_by_occurrence(sym, ends, self.merges)
            ids, cuts = ids.astype("<u4").tobytes(), [0, *(ends * 4).tolist()]
            new = {w: ids[a:b] for w, a, b in zip(words, cuts, cuts[1:])}
            if len(of) + len(new) > REMEMBERED:
                of = {p: of[p] for ps in split.values() for p in ps if p in of}
                self.pieces = {}
            self.pieces.update((w, i) for w, i in new.items() if len(w) <= REMEMBERED_CHARS)
            of = self.pieces if len(self.pieces) >= len(of) + len(new) and of is self.pieces else of | new
        return {c: of[ps[0]] if len(ps) == 1 else b"".join([of[p] for p in ps]) for c, ps in split.items()}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        parts: list[list] = []
        for t in texts:
            if self.special and "<" in t and self.special.search(t):
                parts.append([np.array([self.added[x]], "<u4").tobytes() if x in self.added else self._chunks(x) for x in self.special.split(t) if x])
            else:
                parts.append([self._chunks(t)])
        known = self.known
        new = {c for part in parts for x in part if type(x) is list for c in x if c not in known}
        if new:
            learnt = self._learn(new)
            if len(known) + len(learnt) > REMEMBERED:
                known.clear()
                learnt |= self._learn({c for part in parts for x in part if type(x) is list for c in x if c not in learnt})
            known.update((c, i) for c, i in learnt.items() if len(c) <= REMEMBERED_CHARS)
            known = known if all(c in known for c in learnt) else known | learnt
        return [b"".join([x if type(x) is bytes else b"".join(map(known.__getitem__, x)) for x in part]) for part in parts]

    def decode(self, ids: bytes) -> str:
        """Without a decoder in the file, tokens are joined by a blank."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBPE:
    return WordBPE(path)


def encode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>, n_tokens) of each row.  Null or empty text: no ids.  Repeated rows stay; other columns are not read."""

    def work(part, texts):
        ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in tokenizer(path).encode_batch([t.decode() for t in texts])]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int32)
        return {"doc_id": part.column(0), "ids": pa.ListArray.from_arrays(offsets, np.concatenate([*ids, np.empty(0, np.int32)])), "n_tokens": np.diff(offsets).astype(np.int64)}

    return map_text(_source(docs, text, doc_id), work, f"doc_id {id_type(docs, doc_id)}, ids array<int>, n_tokens long", limit=2 * CHUNK_BYTES).withColumnRenamed("doc_id", doc_id)


def decode(encoded: DataFrame, path: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text) from ids; null ids give a null text."""

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            texts = [None if x is None else " ".join(map(bpe.tokens.__getitem__, x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    ensure(encoded.sparkSession)
    return encoded.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{ids}`").alias("ids")).mapInArrow(run, f"doc_id {id_type(encoded, doc_id)}, text string").withColumnRenamed("doc_id", doc_id)


def digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode, then decode what came out: (doc_id, n_tokens, ids_sha256, decoded_sha256) of each row.

    Null or empty text: no tokens, and the digests of nothing.  Texts of any length are encoded whole.  Rows that repeat an id,
    and null ids, are rows like others; an empty table gives no rows; other columns, whatever their names, are not read.
    """

    def work(part, texts):
        bpe = tokenizer(path)
        ids = bpe.encode_batch([t.decode() for t in texts])
        return {
            "doc_id": part.column(0),
            "n_tokens": np.array([len(x) // 4 for x in ids], np.int64),
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids],
        }

    return map_text(_source(docs, text, doc_id), work, f"doc_id {id_type(docs, doc_id)}, n_tokens long, ids_sha256 string, decoded_sha256 string", limit=2 * CHUNK_BYTES).withColumnRenamed("doc_id", doc_id)


def _source(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())

"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item in a long document has a tiny Jaccard similarity, so documents are searched by *size
partition*: a document of n shingles is in partition p = bit length of n, and has a one-permutation
MinHash signature of 2^p bins (at most one shingle a bin on average, whatever the length).  Every item
has its signature for each partition.  A shared bin value makes a candidate.  A shingle is the smallest of
its bin with probability (1 - e^-x) / x >= 0.63 (x <= 1 shingles a bin), so an item of which 0.8 q shingles
are in a document is missed with probability of at most 0.37^(0.8 q) - 1e-7 or less from q = 20.  Smaller
items take a partition with a bin for each shingle, where nothing is missed.  Candidates are verified by
exact containment of the items' shingles in the document's full set.

A value that is the smallest of its bin stays so in smaller bins, so the index keeps each value once, with the least
partition in which it is in its item's signature.  Documents are read once for each block of items and never shuffled.  A block's index is
broadcast: a block has ``BLOCK_BYTES`` of item text, and its index, ``INDEX_BYTES`` for each of them at most.  A larger benchmark takes more blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, filter_text, id_type, map_text, shingles, text_or_empty

BLOCK_BYTES = 8 << 20
#: Bytes of index for a byte of text, at most: an item of one letter takes 21 and 16 for its shingle and its share of the gate, 16 for itself.
INDEX_BYTES = 64
SHORT = 20
#: Bits of the gate, between these; 8 cells and more for a value.
_GATE = (16, 26)


def smallest_of_bins(s: np.ndarray, bits: int) -> np.ndarray:
    """The values of a signature of 2^bits bins over the sorted set ``s``."""
    if not len(s):
        return s
    bins = s >> np.uint64(64 - bits)
    return s[np.concatenate([[True], bins[1:] != bins[:-1]])]


class Postings:
    """Sorted values, their items, the least size partition that has them, and a bitmap of leading bits that turns most lookups away."""

    def __init__(self, values: list[np.ndarray], items: np.ndarray, everywhere: bool):
        v = np.concatenate([*values, np.empty(0, np.uint64)])
        of = np.repeat(items.astype(np.int32), [len(x) for x in values])
        since = np.concatenate([*([np.zeros(len(x), np.uint8)] if everywhere else [least_partitions(x)] for x in values), [np.empty(0, np.uint8)]], axis=None).astype(np.uint8)
        order = np.argsort(v, kind="stable")
        self.values, self.of, self.since = v[order], of[order], since[order]
        self.shift = np.uint64(64 - min(_GATE[1], max(_GATE[0], len(v).bit_length() + 3)))
        self.gate = np.zeros(1 << (64 - int(self.shift)), bool)
        self.gate[(v >> self.shift).astype(np.int64)] = True
        self.nbytes = sum(x.nbytes for x in (self.values, self.of, self.since, self.gate))

    def meet(self, s: np.ndarray, partition: int) -> np.ndarray:
        """Items that have one of the values ``s`` in their signature for the partition."""
        if not len(self.values):
            return self.of
        s = s[self.gate[(s >> self.shift).astype(np.int64)]]
        lo, hi = np.searchsorted(self.values, s, "left"), np.searchsorted(self.values, s, "right")
        return np.concatenate([self.of[a:b][self.since[a:b] <= partition] for a, b in zip(lo, hi) if a < b] or [self.of[:0]])


def least_partitions(s: np.ndarray) -> np.ndarray:
    """For each value of a sorted set the fewest bits at which it is the smallest of its bin: those that tell it from the value before."""
    if not len(s):
        return np.empty(0, np.uint8)
    differ = s[1:] ^ s[:-1]
    # Leading zeros by the exponent of a double, of halves, so that rounding cannot carry.
    high, low = (differ >> np.uint64(32)).astype(np.float64), (differ & np.uint64(0xFFFFFFFF)).astype(np.float64)
    length = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])
    return np.concatenate([[0], 65 - length]).astype(np.uint8)


class ItemIndex:
    """Signature values of a block of items, and the items' sets."""

    def __init__(self, items: list[tuple[int, bytes]], percent: int):
        table = WordHashes()
        sets = [(i, shingles(t, table)) for i, t in items]
        self.percent = percent
        sets = [(i, s) for i, s in sets if len(s)]
        self.items = pa.array([i for i, _ in sets], pa.int64())
        self.flat = np.concatenate([*(s for _, s in sets), np.empty(0, np.uint64)])
        self.ends = np.cumsum([0, *(len(s) for _, s in sets)])
        sizes = np.diff(self.ends)
        short, long = np.flatnonzero(sizes < SHORT), np.flatnonzero(sizes >= SHORT)
        self.whole = Postings([self.set(k) for k in short], short, True)
        self.by_size = Postings([self.set(k) for k in long], long, False)
        self.nbytes = self.whole.nbytes + self.by_size.nbytes + self.flat.nbytes + self.ends.nbytes + self.items.nbytes

    def set(self, k: int) -> np.ndarray:
        return self.flat[self.ends[k] : self.ends[k + 1]]

    def search(self, s: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, its shingles, those in the set) of items that the sorted set ``s`` contains far enough."""
        if not len(s):
            return []
        bits = len(s).bit_length()
        near = np.unique(np.concatenate([self.whole.meet(s, bits), self.by_size.meet(smallest_of_bins(s, bits), bits)]))
        out = []
        for k in near.tolist():
            item = self.set(k)
            at = np.searchsorted(s, item)
            common = int((s[np.minimum(at, len(s) - 1)] == item).sum())
            if 100 * common >= self.percent * len(item):
                out.append((self.items[k].as_py(), len(item), common))
        return out


def item_indexes(spark, items: DataFrame, percent: int, item_id: str = "item_id", item_text: str = "text") -> list:
    """A broadcast ItemIndex for each block of items; at least one, if an empty one.  A block is about BLOCK_BYTES of text, and an item is whole."""
    asked = items.select(F.col(f"`{item_id}`").cast("long").alias("item"), text_or_empty(item_text).alias("t")).filter("t <> ''")
    total = asked.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    out = []
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == b).collect()
        out.append(spark.sparkContext.broadcast(ItemIndex([(r.item, r.t.encode()) for r in block], percent)))
    return out


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 80, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_common, containment): documents that hold percent of an item's distinct 5-word shingles.

    Words: A-Z lower-cased, split at [\\x20\\x09-\\x0D].  Null or empty documents and items match nothing; an item
    of fewer than five words matches only a document that is just these words.  A pair is returned once, though
    rows repeat an id; ids are of any type, and documents of a null id are one.  An empty table on either side gives no rows.  Other columns are not read.
    """
    indexes = item_indexes(docs.sparkSession, items, percent, item_id, item_text)
    schema = f"doc_id {id_type(docs, doc_id)}, found array<struct<item_id:long,n_item:long,n_common:long>>"
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_item", pa.int64()), ("n_common", pa.int64())]))
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    out = None
    for index in indexes:

        def work(part, texts, index=index):
            table, it = WordHashes(), index.value
            found = [[dict(zip(("item_id", "n_item", "n_common"), x)) for x in it.search(shingles(t, table))] for t in texts]
            return {"doc_id": part.column(0), "found": pa.array(found, kind)}

        some = map_text(source, work, schema).filter(F.size("found") > 0).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
        out = some if out is None else out.union(some)
    out = out.dropDuplicates(["doc_id", "item_id", "n_item", "n_common"])
    return out.select(F.col("doc_id").alias(doc_id), F.col("item_id"), "n_item", "n_common", (F.col("n_common") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = 80, text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold an item, in one pass a block and without a shuffle; rows with a null id are judged like others."""
    for index in item_indexes(docs.sparkSession, items, percent):

        def keep(texts, index=index):
            table, it = WordHashes(), index.value
            return [not it.search(shingles(t, table)) for t in texts]

        docs = filter_text(docs, keep, text)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SHINGLES = """
  SELECT {id}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM (SELECT {id}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table})
"""
ORACLE = f"""
WITH i AS (SELECT DISTINCT item_id, s FROM ({_SHINGLES.format(id="item_id", table="benchmark")})),
q AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
d AS (SELECT DISTINCT doc_id, s FROM ({_SHINGLES.format(id="doc_id", table="documents")}) WHERE s IN (SELECT s FROM i)),
c AS (SELECT doc_id, item_id, count(*) AS n_common FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_common, n_common / n_item AS containment FROM c JOIN q USING (item_id) WHERE 100 * n_common >= 80 * n_item
"""

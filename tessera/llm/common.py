"""Pieces that the corpus operators share: columns, word shingles and Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Rounds as Scratch  # noqa: F401  the operators' tables
from ..ship import ensure

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Space, tab, line feed, vertical tab, form feed, carriage return: \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
SHINGLE_WORDS = 5
#: Bytes of text that one numpy pass works on, so that Python's memory does not follow the Arrow batch.
CHUNK_BYTES = 2 << 20


# --------------------------------------------------------------------------- columns


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


_RANGE = 1 << 52


def hash_bound(rows: int, most: int) -> int:
    """Rows with a ``hash_value`` below it are about 1.2 * most of ``rows`` (all, if there are fewer)."""
    return int(min(1.0, 1.2 * most / max(1, rows)) * _RANGE)


def hash_value(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(_RANGE))


def hash_share(rows: int, most: int, *keys: str) -> Column:
    """True for about 1.2 * most of ``rows`` rows (all, if there are fewer), by a hash of the keys.  A filter in the scan: neither
    tasks nor the driver hold more than the sample, however many tasks there are, and again it picks the same."""
    return hash_value(*keys) < hash_bound(rows, most)


def id_type(df: DataFrame, name: str) -> str:
    """The type of a column, for the schema of what goes through Arrow."""
    return dict(df.dtypes)[name]


# --------------------------------------------------------------------------- Arrow plumbing


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The bytes of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most about ``limit`` bytes of text each (a longer text is alone)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        offsets = np.concatenate([[0], np.cumsum([0 if n is None else n for n in pc.binary_length(column).to_pylist()], dtype=np.int64)]) if len(column) else np.zeros(1, np.int64)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            part = batch.slice(start, stop - start)
            yield part, utf8(column.slice(start, stop - start))
            start = stop


#: Rows of a batch between Spark and Python, where the session has Spark's default: texts may be long.
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> None:
    """Before a plan gets Python functions: the package is sent, and Arrow batches are kept small unless the user has set them."""
    ensure(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def map_text(df: DataFrame, work: Callable[[pa.RecordBatch, list[bytes]], dict], schema: str, text: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """``work`` gets a slice and its texts, and returns the output columns."""
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches):
        for part, texts in pieces(batches, text, limit):
            out = work(part, texts)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for f in arrow for c in (out[f.name],)], schema=arrow)

    prepare(df.sparkSession)
    return df.mapInArrow(run, kind)


def filter_text(df: DataFrame, keep: Callable[[list[bytes]], list[bool]], text: str = "text") -> DataFrame:
    """Rows of ``df`` whose text ``keep`` lets through, all columns as they are; nothing is shuffled."""

    def run(batches):
        for part, texts in pieces(batches, text):
            yield part.filter(pa.array(keep(texts), pa.bool_()))

    prepare(df.sparkSession)
    return df.mapInArrow(run, df.schema)


# --------------------------------------------------------------------------- words and shingles

_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """word -> 64-bit hash; forgets all when it holds ``bound`` words, so its memory is bounded."""

    bound = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased: what bytes.lower and bytes.split do."""
    return text.lower().split()


def shingles(text: bytes, table: WordHashes, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer than k words make one shingle; no word makes none."""
    ws = words(text)
    n = len(ws)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(table.__getitem__, ws), np.uint64, n)
    if n < k:
        s = (h * _STEP[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)
        return mix(s)
    m = n - k + 1
    s = h[:m] * _STEP[0]
    for i in range(1, k):
        s += h[i : m + i] * _STEP[i % 5] if i < 5 else mix(h[i : m + i] + np.uint64(i))
    s = mix(s)
    s.sort()
    if m > 1:
        s = s[np.concatenate([[True], s[1:] != s[:-1]])]
    return s

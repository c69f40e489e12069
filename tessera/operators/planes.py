"""Genotypes as bit planes: two bits a sample, and the calls of each code counted once.

Code 0, 1, 2 or 3 (missing) of a sample is bit ``lo`` plus twice bit ``hi``; places past the last sample are missing.  A packed table is
(chr, snp_idx, position, n_ref, n_het, n_alt, n_missing, lo, hi), a quarter of a byte a call, so that what is shuffled is small and a
locus's statistics are a projection of stored counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ensure

MISSING = 3
WORD = 64
COUNTS = ("n_ref", "n_het", "n_alt", "n_missing")
PACKED = "chr string, snp_idx long, position long, n_ref long, n_het long, n_alt long, n_missing long, lo array<long>, hi array<long>"
_KIND = pa.schema([("chr", pa.string()), ("snp_idx", pa.int64()), ("position", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64()))])


def pack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lo, hi) words, rows of int64, of rows of codes."""
    rows, samples = codes.shape
    width = -(-samples // WORD) * WORD
    out = []
    for bit in (1, 2):
        plane = np.ones((rows, width), np.uint8)
        plane[:, :samples] = (codes & bit) > 0
        out.append(np.packbits(plane, axis=1, bitorder="little").reshape(rows, width // 8).view("<i8"))
    return out[0], out[1]


def unpack(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Codes, a multiple of 64 a row, the last ones missing."""
    bits = [np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1, bitorder="little") for x in (lo, hi)]
    return bits[0] + 2 * bits[1]


def words(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of words of a list column; shorter rows are filled with missing calls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(n.max(initial=0))
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.full((len(n), width), -1, np.int64)
    out[np.arange(width) < n[:, None]] = flat
    return out


def lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], rows.reshape(-1))


def batch(chr, snp_idx, position, codes: np.ndarray, samples: np.ndarray | int) -> pa.RecordBatch:
    """A batch of a packed table from codes, of which each row's first ``samples`` are samples."""
    counts = [(codes == k).sum(axis=1, dtype=np.int64) for k in (0, 1, 2)]
    lo, hi = pack(codes)
    return pa.RecordBatch.from_arrays([pa.array(x, t) if not isinstance(x, pa.Array) else x.cast(t) for x, t in zip((chr, snp_idx, position, *counts, samples - sum(counts)), _KIND.types)] + [lists(lo), lists(hi)], schema=_KIND)


def packed(genotypes: DataFrame) -> DataFrame:
    """``genotypes`` (chr, snp_idx, position, g array of codes) as a packed table; one that is packed is returned as it is.

    Codes other than 0, 1 and 2, and null ones, are missing.  A row without an array has no samples.
    """
    if "n_ref" in genotypes.columns:
        return genotypes

    def run(batches):
        for b in batches:
            g = b.column(3)
            n = pc.fill_null(pc.list_value_length(g), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(g.flatten(), MISSING).to_numpy(zero_copy_only=False)
            codes = np.full((len(n), int(n.max(initial=0))), MISSING, np.uint8)
            codes[np.arange(codes.shape[1]) < n[:, None]] = np.where((flat >= 0) & (flat <= 2), flat, MISSING)
            yield batch(b.column(0), b.column(1), b.column(2), codes, n)

    ensure(genotypes.sparkSession)
    return genotypes.select(F.col("chr").cast("string"), F.col("snp_idx").cast("long"), F.col("position").cast("long"), F.col("g").cast("array<tinyint>")).mapInArrow(run, PACKED)


def subset(genotypes: DataFrame, chosen: np.ndarray) -> DataFrame:
    """A packed table of the samples at places where ``chosen`` (a flag a sample) is true."""
    shared = genotypes.sparkSession.sparkContext.broadcast(np.flatnonzero(chosen))  # a number a sample, as a row has

    def run(batches):
        for b in batches:
            lo, hi = (words(b.column(k)) for k in (3, 4))
            codes = unpack(lo, hi)
            at = shared.value
            codes = codes[:, at[at < codes.shape[1]]]
            there = sum(b.column(k).to_numpy() for k in range(5, 9))
            yield batch(b.column(0), b.column(1), b.column(2), codes, (at[None, :] < there[:, None]).sum(axis=1))

    ensure(genotypes.sparkSession)
    return packed(genotypes).select("chr", "snp_idx", "position", "lo", "hi", *COUNTS).mapInArrow(run, PACKED)


#: Words of a plane that ``parts`` takes at once: a word is 64 bytes there.
SLICE = 1 << 16


def parts(genotypes: DataFrame, chosen: list[np.ndarray]) -> DataFrame:
    """(chr, snp_idx, lo0, hi0, lo1, hi1, and so on): of each variant of a packed table, the planes of the samples at places where each of
    ``chosen`` (a flag a sample) is true."""
    shared = genotypes.sparkSession.sparkContext.broadcast([np.flatnonzero(c) for c in chosen])  # a number a sample, as a row has

    def pick(plane: np.ndarray, at: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(np.ascontiguousarray(plane).view(np.uint8), axis=1, bitorder="little")
        out = np.ones((len(plane), -(-len(at) // WORD) * WORD), np.uint8)
        there = at[at < bits.shape[1]]
        out[:, : len(there)] = bits[:, there]
        return np.packbits(out, axis=1, bitorder="little").reshape(len(plane), out.shape[1] // 8).view("<i8")

    def run(batches):
        for b in batches:
            both = [words(b.column(k)) for k in (2, 3)]
            step = max(1, SLICE // (both[0].shape[1] + 1))
            for first in range(0, b.num_rows, step):
                part = b.slice(first, step)
                made = [lists(pick(plane[first : first + step], at)) for at in shared.value for plane in both]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["chr", "snp_idx", *names])

    ensure(genotypes.sparkSession)
    names = [f"{plane}{k}" for k in range(len(chosen)) for plane in ("lo", "hi")]
    return packed(genotypes).select("chr", "snp_idx", "lo", "hi").mapInArrow(run, "chr string, snp_idx long, " + ", ".join(f"{c} array<long>" for c in names))

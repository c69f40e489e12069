"""What a source and a sink of variants are, and the files of bit planes.

A plane file is the number of samples (32 bits) and two planes of little-endian 64-bit words, of which each holds 32 samples in its low half.
"""

from __future__ import annotations

import struct
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import planes
from ..ship import ensure
from . import variants

PER_WORD = 32


class Source(Protocol):
    """Variants as a table (chr, snp_idx, position, g, ...)."""

    def records(self, spark: SparkSession) -> DataFrame: ...

    def record_count(self, spark: SparkSession) -> int | None: ...

    def description(self) -> str: ...


class Sink(Protocol):
    """Takes a table of variants; done when it returns."""

    def write(self, genotypes: DataFrame) -> None: ...

    def description(self) -> str: ...


class FileSource:
    """A file or folder of a known format, see ``variants.load``."""

    def __init__(self, path: str, kind: str, **options):
        self.path, self.kind, self.options = path, kind, options

    def records(self, spark: SparkSession) -> DataFrame:
        return variants.load(spark, self.path, self.kind, **self.options)

    def record_count(self, spark: SparkSession) -> int | None:
        return self.records(spark).count()

    def description(self) -> str:
        return f"{self.kind} {self.path}"


class FileSink:
    """csv (with the samples' names) or json."""

    def __init__(self, path: str, kind: str, names: list[str] | None = None):
        if kind not in ("csv", "json"):
            raise NotImplementedError(f"format {kind}")
        self.path, self.kind, self.names = path, kind, names or []

    def write(self, genotypes: DataFrame) -> None:
        if self.kind == "csv":
            variants.write_genotype_csv(genotypes, self.path, self.names)
        else:
            variants.write_genotype_json(genotypes, self.path)

    def description(self) -> str:
        return f"{self.kind} {self.path}"


def to_file(codes: np.ndarray) -> bytes:
    """One variant's codes as the bytes of a plane file."""
    n = len(codes)
    out = [struct.pack("<I", n)]
    for bit in (1, 2):
        words = -(-n // PER_WORD)
        bits = np.zeros(words * PER_WORD, np.uint8)
        bits[:n] = (codes & bit) > 0
        plane = np.zeros((words, 64), np.uint8)
        plane[:, :PER_WORD] = bits.reshape(words, PER_WORD)
        out.append(np.packbits(plane, axis=1, bitorder="little").tobytes())
    return b"".join(out)


def from_file(data: bytes) -> np.ndarray:
    """Codes of a plane file's bytes; a file that is cut short is an error."""
    if len(data) < 4:
        raise ValueError("no header")
    n = struct.unpack("<I", data[:4])[0]
    size = -(-n // PER_WORD) * 8
    if len(data) < 4 + 2 * size:
        raise ValueError(f"{n} samples announced, {len(data) - 4} bytes")
    bits = [np.unpackbits(np.frombuffer(data, np.uint8, size, 4 + k * size).reshape(-1, 8), axis=1, bitorder="little")[:, :PER_WORD].reshape(-1)[:n] for k in (0, 1)]
    return bits[0] + 2 * bits[1]


def encode_planes(genotypes: DataFrame) -> DataFrame:
    """(chr, snp_idx, position, data): each variant's file as a binary column, for any binary sink."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            codes = [np.array([planes.MISSING if x is None else x for x in g or []], np.uint8) for g in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([to_file(c) for c in codes], pa.binary())], names=["chr", "snp_idx", "position", "data"])

    ensure(genotypes.sparkSession)
    return genotypes.select(F.col("chr").cast("string"), F.col("snp_idx").cast("long"), F.col("position").cast("long"), F.col("g").cast("array<int>")).mapInArrow(run, "chr string, snp_idx long, position long, data binary")


def decode_planes(files: DataFrame, data: str = "data") -> DataFrame:
    """``files`` with ``g``, the codes of its binary column ``data``, in its place."""
    from pyspark.sql.types import ArrayType, ByteType, StructField, StructType

    rest = [c for c in files.columns if c != data]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            g = [None if x is None else from_file(x).tolist() for x in b.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(g, pa.list_(pa.int8()))], names=[*rest, "g"])

    ensure(files.sparkSession)
    kind = StructType([files.schema[c] for c in rest] + [StructField("g", ArrayType(ByteType()))])
    return files.select(*rest, data).mapInArrow(run, kind)


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """(path, g) of plane files, one variant each."""
    return decode_planes(spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("data")))

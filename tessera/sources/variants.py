"""Variant and genotype files: VCF text (plain or gzip, also multi-member), genotype CSV and JSON.

A locus is known by its place in the input.  Places are numbered from (file, block, line) with counts a block, so no task
sees more than its own block, and reading again gives the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.linkage import ordered

MISSING = 3
FIXED = 9


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line_no, value) of text files in order of lines within a block."""
    t = spark.read.text(path)
    return t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), "value")


def number_lines(t: DataFrame, name: str = "snp_idx") -> DataFrame:
    """Gapless numbers from 0 by (file, block, line_no): ranks inside a block, after the counts of the blocks before."""
    counts = t.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n__"))
    before = F.coalesce(F.sum("n__").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("file", "block").orderBy("line_no"))
    return t.withColumn("rank__", rank).join(counts.select("file", "block", before.alias("before__")), ["file", "block"]).withColumn(name, (F.col("before__") + F.col("rank__") - 1).cast("long")).drop("rank__", "before__")


def allele(a: Column) -> Column:
    """1 for any alternative, 0 for the reference, 3 for what is no number."""
    n = a.try_cast("int")
    return F.when(n.isNull(), MISSING).when(n > 0, 1).otherwise(0).cast("tinyint")


def genotype(call: Column) -> Column:
    """Copies of the alternative, 3 for missing, haploid and bad calls.  What follows ``:`` is dropped."""
    parts = F.split(F.regexp_replace(call, ":.*$", ""), r"[/|]")
    a, b = allele(F.get(parts, F.lit(0))), allele(F.get(parts, F.lit(1)))
    return F.when((F.size(parts) < 2) | (a == MISSING) | (b == MISSING), MISSING).otherwise(a + b).cast("tinyint")


def haplotype(call: Column, side: int) -> Column:
    parts = F.split(F.regexp_replace(call, ":.*$", ""), r"[/|]")
    return F.when(F.size(parts) < 2, MISSING).otherwise(allele(F.get(parts, F.lit(side)))).cast("tinyint")


def read_vcf(spark: SparkSession, path: str, chrom: str | None = None, limit: int | None = None, phased: bool = False) -> DataFrame:
    """(chr, snp_idx, id, position, ref, alt, qual, g[, hap_a, hap_b]) of a VCF file or folder.

    Header lines and rows of fewer than ten columns are skipped; ``chr`` is stripped; ``chrom`` filters before the
    numbering, and ``limit`` takes the first records by place.  A bad position is an error, a bad quality is 0.
    """
    t = lines(spark, path).filter(~F.col("value").startswith("#") & (F.size(F.split("value", "\t")) > FIXED))
    t = t.withColumn("c", F.split("value", "\t")).withColumn("chr", F.regexp_replace(F.get("c", F.lit(0)), "^chr", ""))
    if chrom is not None:
        t = t.filter(F.col("chr") == str(chrom))
    t = number_lines(t)
    if limit is not None:
        t = t.filter(F.col("snp_idx") < limit)
    calls = F.slice("c", FIXED + 1, F.size("c") - FIXED)
    at = lambda k: F.get("c", F.lit(k))
    out = [F.col("chr"), F.col("snp_idx"), at(2).alias("id"), at(1).cast("long").alias("position"), at(3).alias("ref"), at(4).alias("alt"), F.coalesce(at(5).try_cast("float"), F.lit(0).cast("float")).alias("qual"), F.transform(calls, genotype).alias("g")]
    if phased:
        out += [F.transform(calls, lambda x: haplotype(x, 0)).alias("hap_a"), F.transform(calls, lambda x: haplotype(x, 1)).alias("hap_b")]
    return t.select(*out)


def sample_names(spark: SparkSession, path: str) -> list[str]:
    """Of the first #CHROM line; empty without one."""
    found = lines(spark, path).filter(F.col("value").startswith("#CHROM")).orderBy("file", "block", "line_no").limit(1).collect()
    return found[0].value.split("\t")[FIXED:] if found else []


def validate(genotypes: DataFrame, samples: int | None = None) -> DataFrame:
    """(problem, n): rows of other length, positions that go back; one row for an empty table.  No rows: valid."""
    sizes = genotypes.select("chr", "snp_idx", F.size("g").alias("size"))
    first = sizes.groupBy("chr").agg(F.min_by("size", "snp_idx").alias("want")) if samples is None else None  # a row a chromosome
    other = sizes.filter(F.col("size") != samples) if first is None else sizes.join(F.broadcast(first), "chr").filter("size <> want")
    found = other.select(F.lit("sample count").alias("problem")).union(ordered(genotypes).select(F.lit("position order")))
    seen = found.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
    empty = genotypes.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit("empty").alias("problem"), "n")
    return seen.union(empty)


def read_genotype_csv(spark: SparkSession, path: str, header: bool = False, strict: bool = True) -> DataFrame:
    """(chr, snp_idx, id, position, g) of ``snp_id,position,g1,g2,...``.  Lines of fewer than three columns are skipped.

    ``strict``: a bad position or genotype is an error; else they are 0 and missing.  ``header``: the first line of each file is one.
    """
    t = lines(spark, path).withColumn("c", F.split("value", ","))
    if header:
        first = t.filter("block = 0").groupBy("file").agg(F.min("line_no").alias("line_no"))  # a row a file
        t = t.join(first, ["file", "line_no"], "left_anti")
    t = number_lines(t.filter(F.size("c") >= 3))
    calls = F.transform(F.slice("c", F.lit(3), F.size("c") - 2), lambda x: F.trim(x))
    if strict:
        position, g = F.trim(F.get("c", F.lit(1))).cast("long"), F.transform(calls, lambda x: x.cast("tinyint"))
    else:
        position, g = F.coalesce(F.trim(F.get("c", F.lit(1))).try_cast("long"), F.lit(0).cast("long")), F.transform(calls, lambda x: F.coalesce(x.try_cast("tinyint"), F.lit(MISSING).cast("tinyint")))
    return t.select(F.lit("0").alias("chr"), "snp_idx", F.trim(F.get("c", F.lit(0))).alias("id"), position.alias("position"), g.alias("g"))


BATCH = "num_individuals INT, num_snps INT, records ARRAY<STRUCT<snp_id: STRING, position: BIGINT, genotypes: ARRAY<TINYINT>>>"


def read_genotype_json(spark: SparkSession, path: str) -> DataFrame:
    """(chr, snp_idx, id, position, g) of one JSON document."""
    t = spark.read.schema(BATCH).json(path, multiLine=True, mode="FAILFAST").select(F.posexplode("records").alias("snp_idx", "r"))
    return t.select(F.lit("0").alias("chr"), F.col("snp_idx").cast("long").alias("snp_idx"), F.col("r.snp_id").alias("id"), F.col("r.position").alias("position"), F.col("r.genotypes").alias("g"))


def load(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """By format: vcf, csv, json.  PLINK has never been supported."""
    readers = {"vcf": read_vcf, "csv": read_genotype_csv, "json": read_genotype_json}
    if kind not in readers:
        raise NotImplementedError(f"format {kind}")
    return readers[kind](spark, path, **options)


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Variants of both, b's after a's; an error on the first row where sample counts differ."""
    width = a.agg(F.max(F.size("g")).alias("w__"), F.coalesce(F.max("snp_idx") + 1, F.lit(0)).alias("next__"))
    b = b.join(F.broadcast(width), how="cross")  # one row
    same = F.when(F.col("w__").isNull() | (F.size("g") == F.col("w__")), F.col("g")).otherwise(F.raise_error(F.lit("sample counts differ")).cast("array<tinyint>"))
    return a.unionByName(b.withColumn("g", same).withColumn("snp_idx", F.col("snp_idx") + F.col("next__")).select(*a.columns))


# --------------------------------------------------------------------------- sinks


def write_genotype_csv(genotypes: DataFrame, path: str, names: list[str]) -> None:
    """``snp_id,position,sample...``; an id of ``.`` is chr_position, short rows are filled with 3."""
    ident = F.when(F.col("id") == ".", F.concat(F.lit("chr"), F.col("chr"), F.lit("_"), F.col("position").cast("string"))).otherwise(F.col("id"))
    row = genotypes.select(ident.alias("snp_id"), "position", *[F.coalesce(F.get("g", F.lit(i)), F.lit(MISSING).cast("tinyint")).alias(n) for i, n in enumerate(names)])
    row.write.option("header", True).csv(path)


def write_genotype_json(genotypes: DataFrame, path: str) -> None:
    genotypes.write.json(path)

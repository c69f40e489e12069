"""Line dedup with DataFrame functions only.

Normalised lines are exploded and hashed, each hash counts its distinct documents, lines of hashes at
or over the threshold go from every document but the smallest that holds them, and the rest is put
together again by position.

Documents are exploded and hashed once, into a table of 128-bit hashes with ids and positions.  What moves: those (never
line texts) for the counts, then positions of dropped lines, then each text once, to meet its dropped positions.  A line that a third of all documents share is one
partial sum per task in the counts; in the join that marks positions its side can be split (AQE skew join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, ascii_lower, text_or_empty


def line_key(line: Column) -> Column:
    """Without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Rows of ``docs`` with ``ld_lines`` (lines before), ``ld_dropped`` (lines gone) and ``ld_text`` (what is left).

    Null or empty text: one empty line.  Keys shorter than ``min_chars`` code points are never dropped.
    Rows that repeat a doc_id are one document: they share counts, and each row keeps or loses its own lines.
    A row with a null doc_id neither holds nor loses lines.  A document whose lines all go keeps its row, with
    an empty text.  Other columns pass through; names that begin with ``ld_`` are replaced.
    """
    base = docs.drop("ld_lines", "ld_dropped", "ld_text").withColumn("ld_t", text_or_empty(text)).withColumn("ld_id", F.col(f"`{doc_id}`")).withColumn("ld_hash", F.xxhash64("ld_t"))
    lines = (
        base.filter(F.col("ld_id").isNotNull())
        .select("ld_id", "ld_hash", F.posexplode(F.split("ld_t", "\n", -1)).alias("ld_pos", "ld_line"))
        .select("ld_id", "ld_hash", "ld_pos", line_key(F.col("ld_line")).alias("ld_key"))
        .filter(F.length("ld_key") >= min_chars)
        .select("ld_id", "ld_hash", "ld_pos", F.xxhash64("ld_key").alias("k1"), F.xxhash64(F.lit(0x5EED), F.col("ld_key")).alias("k2"))
    )
    scratch = Scratch(docs.sparkSession, "line-dedup")
    lines = scratch.cut(lines)  # read twice: to count, and to mark
    shared = lines.groupBy("k1", "k2").agg(F.countDistinct("ld_id").alias("ld_docs"), F.min("ld_id").alias("ld_first")).filter(F.col("ld_docs") >= min_docs).select("k1", "k2", "ld_first")
    # As a table of its own it meets the lines in a plain join of two exchanges, whose hot partitions Spark can split.
    shared = scratch.cut(shared)
    gone = lines.join(shared, ["k1", "k2"]).filter(F.col("ld_id") > F.col("ld_first")).groupBy("ld_id", "ld_hash").agg(F.collect_set("ld_pos").alias("ld_gone"))
    out = base.join(gone, ["ld_id", "ld_hash"], "left").withColumn("ld_split", F.split("ld_t", "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("ld_split") - 1), F.col("ld_gone"))
    return (
        out.withColumn("ld_lines", F.size("ld_split").cast("long"))
        .withColumn("ld_dropped", F.coalesce(F.size("ld_gone"), F.lit(0)).cast("long"))
        .withColumn("ld_dropped", F.greatest("ld_dropped", F.lit(0).cast("long")))
        .withColumn("ld_text", F.when(F.col("ld_gone").isNull(), F.col("ld_t")).otherwise(F.array_join(F.transform(kept, lambda p: F.get("ld_split", p)), "\n")))
        .drop("ld_t", "ld_id", "ld_hash", "ld_gone", "ld_split")
    )


def drop_shared_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with what is left of each text; ``n_chars``, if there, is counted again.

    Every row stays, in its columns: a null text becomes an empty one, and so does one whose lines all go.  Null and repeated ids are as in ``line_dedup``.
    """
    out = line_dedup(docs, **options)
    text = options.get("text", "text")
    out = out.withColumn(text, F.col("ld_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", F.col("ld_lines").alias("n_lines"), F.col("ld_dropped").alias("n_dropped"), F.sha2("ld_text", 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (
  SELECT k.doc_id, k.pos, k.line, (g.first IS NOT NULL AND k.doc_id > g.first) AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

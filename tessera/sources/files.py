"""Markdown corpora, JSON lines, model snapshots, and append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels of folders below the root that a corpus takes.
DEPTH = 3


def read_markdown(spark: SparkSession, root: str, depth: int = DEPTH, without: tuple[str, ...] = ("schooling",)) -> DataFrame:
    """(path, text) of *.md below ``root``, to ``depth`` folders, none in folders of the names in ``without``."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    inner = F.substring_index(F.col("_metadata.file_path"), f"{root.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    t = t.select(inner.alias("path"), F.col("value").alias("text"))
    parts = F.split("path", "/")
    keep = F.size(parts) <= depth + 1
    for name in without:
        keep = keep & ~F.array_contains(F.slice(parts, F.lit(1), F.size(parts) - 1), name)
    return t.filter(keep)


REQUEST = "schema_version INT, request_id STRING, agent_id STRING, context_hash STRING, local_policy_score DOUBLE, estimated_tokens BIGINT, ms_since_last_local BIGINT, text STRING, prompt STRING, content STRING"


def read_requests(lines: DataFrame) -> DataFrame:
    """One JSON object a line (column value): its fields, and ``error`` for lines that are none.  Blank lines are skipped.  Works on streams."""
    t = lines.filter(F.trim("value") != "").select("value", F.from_json("value", REQUEST + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return t.select("r.*", F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), F.concat(F.lit("bad request: "), "value")).alias("error")).drop("_bad")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def save_snapshot(tables: dict[str, DataFrame], root: str) -> None:
    """Each table as Parquet in a folder of its name."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{root}/{name}")


def load_snapshot(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{n}") for n in names}


def read_model(spark: SparkSession, path: str):
    """(weights, threshold, schema, notes) of a calibration file."""
    from ..operators.classifier import from_wire

    return from_wire("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def write_model(spark: SparkSession, path: str, weights: list[int], threshold: int, notes: dict[str, str] | None = None) -> None:
    from ..operators.classifier import to_wire

    spark.createDataFrame([(to_wire(weights, threshold, notes=notes).rstrip("\n"),)], "value string").coalesce(1).write.text(path)

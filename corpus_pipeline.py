"""From documents to token ids: toxicity, line dedup, near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents, whatever
further ones there are.  A null or empty text has no words, one empty line, no shingles and no tokens: it stays to the end (line dedup
makes a null text an empty one).  A text of any length is taken whole.  Rows of a null id are judged by their text alone and never dropped as
copies.  Rows that repeat an id are one document where documents are compared, and rows like others elsewhere.  Of documents that tie, the
smallest id stays.  A table without rows goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, line_dedup, minhash, toxicity
from tessera.llm.common import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger, trained on the labels, does not reject; all of them where no label names a document of the table.

    Trained on the labelled documents of ``docs`` that its sample holds, judged on every row.  Null and empty texts are not toxic.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of ten characters or more that a document of smaller id has too; ``n_chars`` is counted again.

    A document that loses all its lines stays, with an empty text.  Rows of a null id lose nothing and take nothing from others.
    """
    return line_dedup.drop_shared_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies (five-word shingles, similarity of 0.8 or more).

    Documents without words are nobody's copy and stay, as do rows of a null id; rows that repeat an id stay or go together.
    """
    return minhash.drop_near_copies(docs, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: none of which they have 0.8 of the distinct five-word shingles.  Null and empty texts and items match nothing."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, by digest, and the round trip's: doc_id, n_tokens, ids_sha256, decoded_sha256.  A text without tokens has the digests of nothing."""
    return bpe.digests(docs, bpe.default_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("bpe", tokens),
]

#: The tagger, and with it the whole, is not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; a stage's table goes when the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

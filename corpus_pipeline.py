"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import remove, scratch_dir, scratch_folder
from paperloom.llm.line_dedup import drop_boilerplate
from paperloom.llm.ngram_join import drop_near_copies
from paperloom.llm.packing import pack
from paperloom.llm.quality import quality_filter
from paperloom.llm.secrets import redact_secrets


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` made to fit the text again."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; every document stays."""
    return _counted(drop_boilerplate(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, one row of each id: five-word shingles, similarity of 0.8 or more."""
    return drop_near_copies(docs, words=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return _counted(redact_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1024."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: SQL has no tokenizer; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. The result is a table in the shared folder; what a stage wrote for itself, and its
    result once the next stage has read it, are removed.

    Nulls in any column, empty texts, repeated rows and ids and further columns pass through: a null or short text goes
    with the quality rules, of a repeated id one row stays, rows without an id are nobody's copies. An empty table gives an
    empty result.
    """
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    base = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        with scratch_folder(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if read:
            remove(spark, read)
        docs, read = spark.read.parquet(path), path
    return docs

"""A training-data pipeline in five stages: screen, deduplicate, decontaminate, tokenize.

Every stage maps a table of documents to a table of documents; its result is written as
Parquet and read again as the input of the next one. The last stage adds token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from brineframe.llm import bpe, decontaminate, lines, repetition, similar
from brineframe.session import shared_dir
from brineframe.llm.queries import tokenizer_file

SHINGLE, SIMILAR = 5, 80  # words, percent


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep. An empty or null text is not kept."""
    return repetition.kept_only(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that also stand earlier, long lines and only lines counting as runs of their own;
    those left without a line go, n_chars follows the text."""
    left = lines.cleaned(docs, lone=lines.LONE)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in left.columns else left


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group that a similarity of 0.8 over five-word shingles connects; op9 has its own terms."""
    return similar.one_of_each(docs, n=SHINGLE, percent=SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.clean_only(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with n_tokens and ids; their text is what the ids decode to."""
    found = bpe.recoded(docs.drop("n_tokens", "ids"), tokenizer_file())
    return found.select(*[F.col(f"`{c}`") for c in found.columns if c != "ids"], F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokenization", tokenization),
]

# token ids need a tokenizer, which SQL has not; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

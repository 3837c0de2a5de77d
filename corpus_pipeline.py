"""Documents to token files: language, near copies, benchmark passages, mixture, ids.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table; it is written and read again before the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepframe.llm import decontaminate, language, mixing, resemblance, token_files
from sweepframe.llm.common import fold, stored, table
from sweepframe.llm.queries import WEIGHTS, tokenizer, tree
from sweepframe.session import fresh_path

#: Share of the tokens that the mixture keeps, in percent.
MIXTURE_PERCENT = 90


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected."""
    return language.accepted(docs, language.train(docs.where(fold(F.col("doc_id"), 5) != 0)))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 3 bits apart, or 12 with a similarity of 0.8 by five words."""
    return resemblance.first_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents by target weights, each at most once."""
    return mixing.mixed_documents(docs, tree(), WEIGHTS, MIXTURE_PERCENT)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, written to files and read back."""
    root, few = fresh_path(spark, "tokens"), {"group": token_files.SMALL_GROUP, "known": token_files.FEW_KNOWN}
    files = token_files.write_token_files(docs, tokenizer("byte_bpe_50k.json"), root, **few)
    return token_files.read_token_files(files)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_copies", without_copies),
    ("decontamination", without_benchmark),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: The first stage is a trained model, which SQL cannot express; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

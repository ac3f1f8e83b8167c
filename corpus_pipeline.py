"""A corpus made ready for training: good documents, one of each group, without leaked passages and personal data, as tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaforge.llm import bpe, decontaminate, jaccard, private, quality
from lemmaforge.llm.queries import tokenizer_path
from lemmaforge.plans.registry import table
from lemmaforge.session import cut_lineage


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-equal ones."""
    return jaccard.keep_one(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages cut out of their texts."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and the terms that reveal it, replaced in their texts."""
    return private.sanitise(docs)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id`, `lang`, `source`, `n_tokens`, `ids`, and `text` as decoded from them."""
    path = tokenizer_path()
    keyed = docs.select(F.struct("doc_id", "lang", "source").alias("key"), "text")
    tokens = bpe.round_trip(keyed, path, doc_id="key")
    return tokens.select("key.*", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("quality", good_documents),
    ("jaccard_join", one_of_each_group),
    ("decontamination", without_leaks),
    ("private_data", without_private_data),
    ("bpe", as_tokens),
]

# The classifier and the tokenizer cannot be written in SQL; tests/llm/test_pipeline.py compares the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaforge.session import cut_lineage

FIT_ROWS = 20_000  # labelled rows that a classifier is fitted on at most, about


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null ids have none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """`doc_id`, `text`, `label` and `fold` of about `fit_rows` labelled documents at most, outside fold 0.

    The ids are drawn by their hash before any text is read; the draw is small by that bound, and so broadcast.
    A document labelled twice has the larger label; null labels and ids are left out. The sample is written once.
    """
    drawn = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    drawn = drawn.groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    drawn = drawn.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0")
    drawn = cut_lineage(drawn)
    count = drawn.count()
    if count > fit_rows:
        drawn = drawn.where(F.pmod(F.xxhash64("doc_id"), F.lit(count)) < fit_rows)
    return cut_lineage(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"))

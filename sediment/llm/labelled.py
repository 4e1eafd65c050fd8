"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.llm.staging import stage


def fold(key: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo `folds`; a null id counts as the text ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, limit: int) -> DataFrame:
    """(doc_id, text, label int) of at most `limit` labelled documents outside the held-out fold, chosen by hash of the id.

    Ids are chosen from the narrow label table first; only the chosen texts are read on. Conflicting labels of an id become the larger.
    """
    mine = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    chosen = mine.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    chosen = stage(chosen, "label-sample")  # at most `limit` rows of two numbers: small enough to broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def unlabelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, limit: int) -> DataFrame:
    """(doc_id, text, label null) of at most `limit` documents without a label, chosen by hash of the id. Documents whose label is held out are not among them."""
    named = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id")
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    first = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(8 * limit)  # a few a task, no shuffle of all ids; labelled ones among them go
    chosen = first.distinct().join(named, "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    chosen = stage(chosen, "unlabelled-sample")  # at most `limit` rows of a number
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("label", F.lit(None).cast("int"))

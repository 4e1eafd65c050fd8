"""Corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; run()
writes each result as Parquet and reads it as the next stage's docs. All stages but the last keep
the columns of docs, extra ones and ones with clashing names included. Null texts, null ids and repeated rows pass the first
and third stage as they are; the second keeps one row of a repeated id and all rows without an id; the fourth drops texts without a
word, whose tokens count nothing; empty tables give empty results. The classifier, the similarity groups and the tokenizer can't be put in
SQL, so ORACLE_SQL is None and the tests compare with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.mixing import mix_documents
from sediment.llm.ngram_join import jaccard_components
from sediment.llm.packing import pack_pieces, tokenize_pieces
from sediment.llm.secret_scan import ranked_words, redact_secrets
from sediment.llm.staging import stage
from sediment.llm.toxicity import toxicity_scores

TOXIC_FROM = 0.3  # score from which a document is rejected


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC_FROM; null and empty texts stay, and so do all columns, one named score too."""
    scored = toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), name="_pipeline_toxicity")
    return scored.filter(F.col("_pipeline_toxicity") < TOXIC_FROM).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id, once. Rows without an id stay.

    Texts are neither sorted nor aggregated, but for those of repeated ids: heads are narrow and hashed, texts stream past them.
    """
    groups = jaccard_components(docs).filter("doc_id is not null")
    heads = groups.groupBy("doc_id").agg(F.count("*").alias("copies"), F.max("component_id").alias("most"))  # of an id's rows; none exceeds the id
    heads = stage(heads.filter("doc_id = most").select("doc_id", "copies"), "jaccard-heads")
    named = docs.filter("doc_id is not null")
    pick = lambda some: named.join(some.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns)
    kept = pick(heads.filter("copies = 1")).union(docs.filter("doc_id is null"))
    again = heads.filter("copies > 1")
    return kept if again.isEmpty() else kept.union(pick(again).dropDuplicates(["doc_id"]))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret span replaced by a mark; all rows and columns stay."""
    return redact_secrets(docs, rank=ranked_words(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that source, language and topic meet their target shares of tokens."""
    return mix_documents(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into 4096-token sequences: the rows of the packing query."""
    return pack_pieces(tokenize_pieces(docs))


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", ngram_jaccard),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

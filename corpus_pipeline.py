"""Corpus pipeline: quality filter, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the
columns of ``docs``. Clean documents stay: a stage drops only what its operator rejects.

Defined results of every stage: a row is a document. Null and equal doc_ids are ordinary values, texts with one
doc_id are judged one by one. Texts are read whole, however long. Extra columns pass through the filtering stages,
whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from echofield.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules, workspace


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores below 0.5 go.

    null or empty text: scored by its statistics, all 0. repeated rows: all stay or all go.
    """
    model = quality_rules.trained_on(spark, docs, sf_dir)
    return quality_rules.keep_good(docs, model, 0.5)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least ten documents go; n_chars follows the text. No document goes.

    null text: becomes empty. repeated rows: count one by one and get the same result.
    """
    kept = line_dedup.drop_frequent_lines(docs, min_docs=10)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of smallest doc_id stays.

    null doc_ids come last; texts without a word (null, empty) are one class; of repeated rows one stays.
    """
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    null, empty or shorter than five words: stays. repeated rows: all stay or all go.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest in sequences of at most 2048 tokens: a row for each piece of a document.

    null or empty text: the end id alone. repeated rows: packed one by one.
    """
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: MinHash, SimHash and a tokenizer have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = workspace.written(docs, f"stage-{i}")
    return docs

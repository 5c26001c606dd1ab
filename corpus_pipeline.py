"""The corpus pipeline: raw documents in, token ids of what is kept out.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the docs of the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigspark.llm import decontam, neardup, passages, pieces, quality
from sigspark.llm.common import table, written
from sigspark.llm.queries import vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model takes as good; it learns from the labelled ones among them."""
    model = quality.fit(docs, quality.training_labels(table(spark, sf_dir, "labels")))
    return quality.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more."""
    dropped = written(neardup.near_duplicates(docs, k=5, percent=80).where("not kept").select("doc_id").distinct(), "dropped")
    return docs.join(neardup.small_side(dropped), "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand in an earlier document or earlier in the same text."""
    return passages.without_passages(docs, passages.repeated_passages(docs, cover=True))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with the benchmark."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left."""
    return pieces.round_trip(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [("quality classifier", quality_classifier), ("MinHash near-dedup", near_dedup),
          ("substring dedup", substring_dedup), ("benchmark decontamination", decontamination),
          ("SentencePiece encoding and decoding", sentence_pieces)]
#: No SQL: the classifier, the chains and the tokenizer are out of its reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs

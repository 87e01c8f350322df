"""A corpus, from raw documents to packed token sequences, in five stages.

Each stage is written as Parquet in the shared folder and read again as the next one's input, so a
lost executor repeats part of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import langid, mixing, packing, similar, toxicity
from tessera.llm.common import Scratch, clean
from tessera.llm.queries import table, vocabulary_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that score so low that the network is wrong two times in three.

    The score is found on labelled rows it was not trained on (see langid.accepted() for nulls, ties and repeats).
    """
    return langid.accepted(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; null and empty texts score 0, repeated rows fare alike."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingle similarities of 0.8 or more connect, one stays: the smallest id.

    Texts without a word are one group; rows with one id and different texts are judged each.
    """
    return similar.one_of_each(docs, shingle=5, least=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the schedule takes them; those that it doesn't take, and empty ones, go.

    Null sources are a source of their own; repeated rows are documents of their own.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids, with the ids; a null or empty text is its closing id."""
    return packing.pack(docs, vocabulary_path(), window=2048, keep_ids=True)


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("mixing", mixture),
    ("packing", packed),
]
#: Two of the stages are trained networks, which SQL can't express; tests/llm hold the rest against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  What a stage reads, and what its operators wrote, goes when it is done."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        last, before = docs, len(Scratch.roots)
        docs = scratch.write(stage(spark, docs, sf_dir))
        clean(spark, before)
        if k:
            scratch.drop(last)
    return docs

"""The training-data pipeline: toxicity, line dedup, near duplicates, mixing, tokens.

Defined results: a null text is an empty one in every stage and comes out of line dedup as such; rows without an id, rows that repeat
an id, and rows that are equal are rows of their own until near duplicates leaves one of each group; documents without words stay,
and the mix takes them if they fit; columns beside those of `documents` are dropped; an empty table gives empty results.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written as Parquet and read
again. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosy.llm import jaccard, linededup, mixing, pieces, toxicity
from argosy.llm.common import remove, shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance model scores 0.3 or more go; equal texts go or stay together, and without labels of both kinds all stay."""
    return toxicity.drop_toxic(docs.select(*COLUMNS), toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in the one of the largest id; rows of one id are one document; n_chars follows the text."""
    return linededup.drop_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: of the least id, then of the least text hash; documents without words all stay."""
    return jaccard.one_of_each(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them; null is a source of its own, and equal rows are decided one by one."""
    return mixing.mix(docs.select(*COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and samples: the encoded text and sampled segmentations of it; an empty text has no ids."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_common_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("SentencePiece", tokenize),
]

#: Trained scores and sampled segmentations have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over `documents` below `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{root}/{i}")
        docs = spark.read.schema(made.schema).parquet(f"{root}/{i}")
        if i:
            remove(spark, f"{root}/{i - 1}")  # nothing reads it any more
    return docs

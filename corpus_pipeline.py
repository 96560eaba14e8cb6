"""A training corpus from raw documents: each stage's table is written and read again as the next one's documents.

STAGES: toxicity (toxic documents go), language identification (documents without a
recognisable language go), MinHash near-dedup (one document of each group stays),
mixing sources to target weights (documents repeat as often as the mix takes
them) and packing (pieces of fixed-length sequences).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlode.llm import language_id, minhash_dedup, mixing, packing, token_files, toxicity
from scanlode.llm.common import materialize, table

#: The least score at which a language counts as recognised.
LEAST_SCORE = 0.3


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: scores every text in place and drops those at 0.5 or more."""
    lexicon = toxicity.learn(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels"), lambda i: F.lit(True)))
    return toxicity.kept_rows(docs, lexicon)


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: drops texts without a letter and those whose best language scores under ``LEAST_SCORE``; without a labelled text to learn from only the former."""
    net = language_id.train(language_id.training_rows(docs, F.lit(True)))
    return language_id.kept_rows(docs, net, LEAST_SCORE)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: of each group the row with the least doc_id stays (null last); rows are told apart by a key of their own, not by doc_id."""
    return minhash_dedup.kept_rows(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a row for each time that the mix takes a document."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of every row in sequences of 4096 tokens."""
    return packing.pack(docs, token_files.tokenizer_path())


STAGES = [("toxicity", clean), ("language ID", recognised), ("MinHash near-dedup", distinct_texts), ("mixing", mixed), ("packing", packed)]

#: The classifiers and the tokenizer have no SQL form; tests hold run() against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

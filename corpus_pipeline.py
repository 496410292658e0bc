"""The corpus pipeline: quality rules, near-duplicates, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and gives a frame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.

Defined results: a row without text has no words and goes at the first stage; rows that
repeat a doc_id are one document to the second stage and stay or go together; extra columns are
carried along whatever their names; very long texts are taken whole; of near-copies the
smallest id stays, so there are no ties; empty documents give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluicegate.llm import divergence_rules, odd_minhash, rank_queue_bpe, settings, soft_mixing
from sluicegate.llm.tables import Staging, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their language's histograms let pass."""
    return divergence_rules.keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-copies."""
    return odd_minhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights ask: good prose 1.25 times on average, a single
    document by its own posterior, which may be less than once."""
    labelled = settings.labelled_domains(spark, sf_dir)
    mixture = soft_mixing.fit_mixture(
        docs, labelled, settings.MIXTURE_WEIGHTS, settings.MIXTURE_ANCHOR, settings.MIXTURE_EPOCHS
    )
    return soft_mixing.mix(docs, mixture)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the packed ids of every text."""
    return rank_queue_bpe.encode_texts(docs, settings.ENCODED_VOCABULARY, settings.PATTERN)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", deduplicate),
    ("mixing", mix),
    ("encoding", encode),
]

# Neither the components nor the ids can be had in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored before the next one."""
    staging = Staging(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staging.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

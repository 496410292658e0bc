"""What the registered queries and the pipeline are run with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.llm.tables import table
from sluicegate.llm.url_vocabulary import Rule

PAGE_RULES = (
    Rule("allow", "com"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
SHARDS = 24
TOKEN_LIMIT = 512
COUNTED_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ENCODED_VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

# Shares of the tokens that the mixture should have; good prose is taken 1.25 times over.
MIXTURE_WEIGHTS = {"good": 0.93, "poor": 0.06, "toxic": 0.01}
MIXTURE_ANCHOR, MIXTURE_EPOCHS = "good", 1.25


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, domain of the labelled documents."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), domain.alias("domain"))

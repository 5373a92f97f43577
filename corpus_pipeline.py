"""From documents to a tokenised training mix: quality rules, exact copies, near copies, source weights, byte-level BPE.

Each stage takes what the one before kept and returns the columns of documents; the last returns the tokenised mix, one row for each
emitted copy.  `run` writes every stage to the shared folder and starts the next from the files, so that a lost executor repeats no
earlier stage.  Nulls, empty texts, repeated rows and other columns have the results that the operators' modules define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from recordworks.llm import bpe, exact_dedup, mixing, ngram_join, quality_rules
from recordworks.session import settled


def keep_good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.passing(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space apart) the one of the least id stays."""
    return exact_dedup.first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles, one of each group stays."""
    return ngram_join.one_of_each(docs, k=5, pct=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is repeated or thinned to its target."""
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the tokens of each emitted document, and of what they decode to."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, carry=["doc_id", "lang", "source"])


STAGES = [
    ("quality rules", keep_good_texts),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", tokenise),
]

#: SQL can express neither the near copies of whole tables in reasonable time nor the merges of the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

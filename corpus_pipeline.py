"""From documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table that is written before the next one reads it. All but the
last return the columns of documents; the last adds each document's pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowwarden.llm import importance_resampling, jaccard_join, mixing, pieces, quality_rules
from rowwarden.session import table, written

#: Near copies: shingles of five words, a similarity of 0.8.
WORDS, SIMILAR, OF = 5, 80, 100


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return importance_resampling.keep_resampled(docs, table(spark, sf_dir, "labels"))


def quality_rule_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_by_rules(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first(docs, words=WORDS, similar=SIMILAR, of=OF)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rule_filter),
    ("n-gram Jaccard join", near_copies),
    ("source mixing", source_mixing),
    ("SentencePiece encoding", encoding),
]
#: Hashed models, components and the encoding have no SQL; the result is tested against the five stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Dictionaries in documents: which to extract, what became of them, and how good the stages are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCEPT, MODEL_BELOW = 1.0, 0.8
METRICS = ("recall", "precision", "exact_match", "levenshtein")


def common_header(links: DataFrame, headers: DataFrame) -> DataFrame:
    """dictionary_id, header (the most common one of its files, of equals the first) and all_done (each file's is known).
    links: dictionary_id, resource_id, pos. headers: resource_id, header."""
    j = links.join(headers, "resource_id", "left")
    done = j.groupBy("dictionary_id").agg(F.bool_and(F.col("header").isNotNull()).alias("all_done"))
    counted = j.where(F.size("header") > 0).groupBy("dictionary_id", "header").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = counted.groupBy("dictionary_id").agg(F.max_by("header", F.struct("n", -F.col("first"))).alias("header"))
    return done.join(best, "dictionary_id", "left")


def tasks(dictionaries: DataFrame, records: DataFrame, stage: str, reader: str, model: str, prompt: str) -> DataFrame:
    """The documents that a stage has to read. dictionaries: dictionary_id, format, sha256, header, all_done, linked.
    records: dictionary_id, sha256, reader_version, outcome, model, prompt_version."""
    ready = dictionaries.where((F.col("format") == "PDF") & F.col("sha256").isNotNull() & (F.col("linked") > 0) & (F.col("header").isNotNull() | F.col("all_done")))
    old = records.select("dictionary_id", *[F.col(c).alias(f"old_{c}") for c in ("sha256", "reader_version", "outcome", "model", "prompt_version")])
    j = ready.join(old, "dictionary_id", "left")
    same = F.coalesce(F.col("old_sha256") == F.col("sha256"), F.lit(False))
    if stage == "deterministic":
        due = ~same | (F.coalesce("old_reader_version", F.lit("v1")) != reader)
    else:
        due = same & (F.col("old_outcome") == "llm-needed") & ~(F.col("old_model").eqNullSafe(F.lit(model)) & F.col("old_prompt_version").eqNullSafe(F.lit(prompt)))
    return j.where(due).select(*dictionaries.columns)


def outcome(agreement, n_fields, has_oracle, accept: float = ACCEPT, model_below: float = MODEL_BELOW):
    """extracted, suggested or llm-needed, from the agreement of the deterministic stage with the file's header."""
    return F.when(n_fields == 0, "llm-needed").when(~has_oracle, "suggested").when(agreement >= accept, "extracted").when(agreement >= model_below, "suggested").otherwise("llm-needed")


def best_stage(oracles: DataFrame) -> DataFrame:
    """Of the stages of a document the one of the higher agreement, the first on a tie (stage_no)."""
    order = Window.partitionBy("dictionary_id").orderBy(F.desc("agreement"), "stage_no")
    return oracles.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def stage_stats(oracles: DataFrame) -> DataFrame:
    """stage, metric, n, mean, median and perfect over documents with an oracle."""
    long = oracles.where("available").select("stage", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])).alias("x")).select("stage", "x.*").where("v is not null")
    return long.groupBy("stage", "metric").agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.median("v"), 4).alias("median"), F.count_if(F.col("v") == 1.0).alias("perfect"))

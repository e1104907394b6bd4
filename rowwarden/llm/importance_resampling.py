"""Operator 2: quality classifier by importance resampling.

Two generative models over hashed n-grams, of target text and of the raw corpus, give each text an importance weight:
the ratio of its probabilities under both. Gumbel noise, seeded by the id, is added to the log weight, and the k
largest sums are kept: k draws without replacement in proportion to the weights.

k is a parameter; by default it is the share of good rows among those with a quality label, times the number of
documents. The k-th value is found by counting (common.largest), never by a sort or on the driver.

Defined results: null text is the empty text, which has weight 1; without target labels every weight is 1 and, unless
k is given, all is kept; rows whose quality is null carry no label; rows of one id share their noise, and equal rows at the k-th place are kept or dropped together; ids that are
null draw one noise; input columns of the added names are replaced.
"""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table, written
from .common import at_least, largest, plain_names, sortable, unit_hash, with_text_columns
from .ngram_ratio import BUCKETS, grams, log_ratios

SEED = 20
_KEY = "sum_key"


def weigh(docs: DataFrame, ratios: np.ndarray, text: str = "text", doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """docs with n_grams, log_weight, perturbed (log weight and noise) and sum_key (its sortable form)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # one number a bucket
    buckets = len(ratios)

    def make():
        def work(batch):
            n, out = [], []
            for t in batch:
                r = shared.value[grams(t, buckets)]
                n.append(len(r))
                out.append(float(r.sum()))
            return [n, out]

        return work

    added = T.StructType([T.StructField("n_grams", T.LongType()), T.StructField("log_weight", T.DoubleType())])
    scored = with_text_columns(docs, text, added, make, as_bytes=True)
    noise = -F.log(-F.log(unit_hash(seed, F.col(f"`{doc_id}`").cast("string"))))
    return scored.withColumn("perturbed", F.round(F.col("log_weight") + noise, 9)).withColumn(_KEY, sortable(F.col("perturbed")))


def good_share(labels: DataFrame) -> float:
    """The share of rows labelled good among all rows with a quality label; 1 without any good one."""
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    found = rows.agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good")).first()
    return found.good / found.n if found.good else 1.0


def threshold(weighed: DataFrame, doc_id: str = "doc_id", k: int | None = None, share: float = 1.0) -> tuple[int, ...] | None:
    """The k-th largest (sum, id): what at_least() takes; k is `share` of all rows if not given. weighed should be a written table: it is read several times."""
    keys = weighed.select(_KEY, _id_key(doc_id).alias("id_key"))
    if k is None:
        k = ceil(share * keys.count())
    return ((1 << 63) - 1, (1 << 63) - 1) if k <= 0 else largest(keys, k, [_KEY, "id_key"])


def kept_column(bound: tuple[int, ...] | None, doc_id: str = "doc_id") -> Column:
    return at_least([F.col(_KEY), _id_key(doc_id)], bound)


def _id_key(doc_id: str) -> Column:
    return F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(-(1 << 63)))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, text: str = "text", doc_id: str = "doc_id", buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every row of docs (without its text) with its weight and whether it is among the k kept."""
    ratios = log_ratios(docs, labels, text, doc_id, buckets)
    scores = written(weigh(docs, ratios, text, doc_id, seed).drop(text), "weights")
    return scores.withColumn("kept", kept_column(threshold(scores, doc_id, k, good_share(labels)), doc_id)).drop(_KEY)


def keep_resampled(docs: DataFrame, labels: DataFrame, k: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that resample() keeps, with the columns of docs. Texts are scored once more instead of shuffled."""
    ratios = log_ratios(docs, labels, text, doc_id)
    rows, name, restored = plain_names(docs)
    of = {"text": name[text], "doc_id": name[doc_id]}
    bound = threshold(written(weigh(rows.select(*of.values()), ratios, **of).drop(of["text"]), "weights"), of["doc_id"], k, good_share(labels))
    return weigh(rows, ratios, **of).where(kept_column(bound, of["doc_id"])).select(restored)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


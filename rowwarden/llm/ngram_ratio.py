"""Hashed n-gram models of trusted target text and of the raw corpus, shared by operators 2 and 10.

A text's n-grams are its tokens (runs of word characters or of marks) and its pairs of neighbouring tokens. N-grams
are hashed to a fixed number of buckets; each model is the smoothed multinomial over buckets. The raw model counts every
whole text; the target model counts every whole text whose id is labelled as good.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import corpus_counts, gram_hashes, mix64, texts, word_hashes
from .jaccard_join import MAX_BROADCAST_IDS

BUCKETS = 1 << 14
#: Added to the count of each bucket.
SMOOTHING = 1.0
_TOKEN = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^A-Za-z0-9_\x80-\xff\x20\x09-\x0d]+")


def grams(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each n-gram of the whole text."""
    h = word_hashes(_TOKEN.findall(text))
    return (mix64(np.concatenate([h, gram_hashes(h, 2)])) & np.uint64(buckets - 1)).astype(np.int64)


def good_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the rows labelled of good quality."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def with_target(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", max_broadcast: int = MAX_BROADCAST_IDS) -> DataFrame:
    """raw_text and is_target of every row of docs. Ids are broadcast if they are few; else texts are shuffled once."""
    ids = written(good_ids(labels).select(F.col("doc_id").alias("good_id"), F.lit(True).alias("is_target")), "good")
    few = ids.limit(max_broadcast + 1).count() <= max_broadcast
    rows = docs.select(F.col(f"`{doc_id}`").alias("row_id"), F.col(f"`{text}`").alias("raw_text"))
    joined = (rows if few else rows.where("row_id is not null")).join(F.broadcast(ids) if few else ids, F.col("row_id") == F.col("good_id"), "left")
    marked = joined.select("raw_text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    return marked if few else marked.unionByName(rows.where("row_id is null").select("raw_text", F.lit(False).alias("is_target")))  # rows without an id stay where they are


def log_ratios(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", buckets: int = BUCKETS, max_broadcast: int = MAX_BROADCAST_IDS) -> np.ndarray:
    """log P(bucket | target) - log P(bucket | raw) for each bucket. All zero without target text."""
    rows = with_target(docs, labels, text, doc_id, max_broadcast)

    def add(batch: pa.RecordBatch, acc: np.ndarray) -> None:
        for t, target in zip(texts(batch, "raw_text", True), batch.column(1).to_pylist(), strict=True):
            at, n = np.unique(grams(t, buckets), return_counts=True)
            acc[at] += n
            if target:
                acc[buckets + at] += n

    counts = corpus_counts(rows, 2 * buckets, add)
    return ratios_of(counts[buckets:], counts[:buckets])


def ratios_of(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.any():
        return np.zeros(len(raw))
    # The smoothing mass of the target model is spread as the raw corpus is: an unseen n-gram says little.
    prior = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * len(raw))
    strength = SMOOTHING * len(raw)
    return np.log((target + strength * prior) / (target.sum() + strength) / prior)

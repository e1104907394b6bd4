"""Operator 10: quality rules.

Two base rules (enough words, few repeated words) and a learned rule: the log-likelihood ratio of the text's hashed
n-grams between the trusted-target and the raw-corpus multinomials, divided by their number, against a fixed
threshold. Every document gets a verdict from its own text and the two models; nothing is drawn at random.

Words are [^\\x20\\x09-\\x0D]+; word_chars: code points in words; n_symbols: characters of #*$%&|<>; n_dup_lines: lines
with a word that are equal to an earlier line; n_repeat_words: words in windows of three that the text holds twice or
more. Defined results: null text has no words and fails; a text without n-grams has ratio 0; repeated rows get equal
verdicts; input columns of the added names are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import table
from .common import gram_hashes, plain_names, with_text_columns, word_hashes
from .ngram_ratio import BUCKETS, grams, log_ratios

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: The least mean log-likelihood ratio of a kept document.
MIN_RATIO = -0.1
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    words = text.split()  # bytes split at ASCII white space
    raw = np.frombuffer(b"".join(words), np.uint8)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeat = 0
    if len(words) >= 3:
        _, at, n = np.unique(gram_hashes(word_hashes(words), 3), return_inverse=True, return_counts=True)
        twice = n[at] >= 2
        inside = np.zeros(len(words), bool)
        for i in range(3):
            inside[i : i + len(twice)] |= twice
        repeat = int(inside.sum())
    return len(words), int(((raw & 0xC0) != 0x80).sum()), int(_SYMBOL[raw].sum()), len(lines) - len(set(lines)), repeat


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def judge(docs: DataFrame, ratios: np.ndarray, text: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """docs with the measures, base_failed, mean_ratio and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # one number a bucket
    buckets = len(ratios)

    def make():
        def work(batch):
            out = []
            for t in batch:
                m = measures(t)
                r = shared.value[grams(t, buckets)]
                mean = float(r.mean()) if len(r) else 0.0
                failed = base_failed(m[0], m[4])
                out.append((*m, failed, mean, not failed and mean >= min_ratio))
            return list(zip(*out, strict=True)) if out else [[] for _ in added]

        return work

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    added = T.StructType([T.StructField(n, T.LongType()) for n in names] + [T.StructField("base_failed", T.BooleanType()), T.StructField("mean_ratio", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return with_text_columns(docs, text, added, make, as_bytes=True)


def apply_rules(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", buckets: int = BUCKETS, min_ratio: float = MIN_RATIO) -> DataFrame:
    return judge(docs, log_ratios(docs, labels, text, doc_id, buckets), text, min_ratio)


def keep_by_rules(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    rows, name, restored = plain_names(docs)
    return apply_rules(rows, labels, name[text], name[doc_id]).where("kept").select(restored)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).drop("text")

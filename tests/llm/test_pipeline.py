"""The pipeline: its stages on odd rows, and its result against stages in plain Python."""

import hashlib
import importlib.util
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rowwarden.llm import importance_resampling, mixing, pieces, quality_rules

from test_table_operators import links_by_brute_force
from test_text_operators import gumbel, plain_grams, plain_ratios

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "source mixing", "SentencePiece encoding"]
    assert corpus_pipeline.ORACLE_SQL is None
    odd = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (5, "", "en", "src0", 0)], docs.schema)).withColumn("kept", F.lit("mine")).withColumn("log_weight", F.lit("mine"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.schema.simpleString() == odd.schema.simpleString()
        assert out.select("kept").distinct().count() <= 1
        assert stage(spark, odd.limit(0), SF).count() == 0
    first = {r.doc_id for r in corpus_pipeline.quality_classifier(spark, docs, SF).collect()}
    assert first == {r.doc_id for r in importance_resampling.resample(docs, labels).where("kept").collect()}
    second = {r.doc_id for r in corpus_pipeline.quality_rule_filter(spark, docs, SF).collect()}
    assert second == {r.doc_id for r in quality_rules.apply_rules(docs, labels).where("kept").collect()}
    out = corpus_pipeline.run(spark, SF).cache()
    assert out.columns[:5] == docs.columns and out.where("not round_trip").count() == 0 and out.count() > 0
    assert {r.doc_id for r in out.select("doc_id").collect()} <= first & second


def poisson_count(u, rate):
    total, k, p = math.exp(-rate), 0, math.exp(-rate)
    while total <= u and k < 1000:
        k += 1
        p *= rate / k
        total += p
    return k


def test_the_result_against_stages_in_plain_python(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {i for i, q in known.items() if q == 1}

    ratios = plain_ratios([(i, t) for i, t, _ in rows], good)
    n = math.ceil(len(good) / len(known) * len(rows))
    rows = sorted(rows, key=lambda r: sum(ratios[b] for b in plain_grams(r[1])) + gumbel(r[0]), reverse=True)[:n]

    def fit(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(zip(words, words[1:], words[2:]))
        inside = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(i, i + 3)}
        return len(words) >= 50 and 100 * len(inside) <= 50 * len(words)

    ratios = plain_ratios([(i, t) for i, t, _ in rows], good)
    rows = [r for r in rows if fit(r[1]) and np.mean([ratios[b] for b in plain_grams(r[1])]) >= quality_rules.MIN_RATIO]
    first = links_by_brute_force([(i, t) for i, t, _ in rows], 5, 80)
    rows = [r for r in rows if first[r[0]][1] == r[0]]
    sizes = Counter()
    for _, t, source in rows:
        sizes[source] += len(t)
    weights = {s: n**mixing.TEMPERATURE for s, n in sizes.items()}
    rate = {s: sum(sizes.values()) * weights[s] / sum(weights.values()) / n for s, n in sizes.items()}
    draw = lambda i: (int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    want = {i: (poisson_count(draw(i), rate[s]), t) for i, t, s in rows}

    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out) == Counter({i: n for i, (n, _) in want.items() if n})
    codec = pieces.Codec(pieces.load(public_tokenizers.path("piece_bpe_32k.model")))
    for r in out:
        assert r.text == want[r.doc_id][1] and codec.decode(r.pieces) == r.text and sum(codec.viterbi(w)[1] for w in codec.split(pieces.MARK + r.text.replace(" ", pieces.MARK))) == pytest.approx(r.score)


def test_very_long_texts_and_repeated_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = docs.where("length(text) between 400 and 3000").orderBy("doc_id").limit(1)
    long = one.selectExpr("900001L AS doc_id", "concat_ws(' ', transform(sequence(1, 60000), i -> concat('w', i))) AS text", "lang", "source", "n_chars")
    odd = docs.unionByName(one).unionByName(one).unionByName(long)
    repeated = one.first().doc_id
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
        if name == "n-gram Jaccard join":
            assert n.get(repeated, 0) <= 1 and n[900001] == 1
        elif name == "SentencePiece encoding":
            assert n[repeated] == 3 and out.where("not round_trip").count() == 0

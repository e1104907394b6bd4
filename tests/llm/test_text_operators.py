"""Operators on single texts, against libraries and brute force."""

import math
import random
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rowwarden.llm import importance_resampling, mixing, ngram_ratio, pieces, quality_rules, token_counts, toxicity
from rowwarden.llm.common import _packed, _unpacked, corpus_counts, largest
from rowwarden.llm.ngram_ratio import grams, ratios_of

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\t ", "a", "é日本🙂 x", "the the the the", "word " * 3000, "x" * 20000, "▁ y", "<|endoftext|> a<|endoftext|>", "\x00\x1c\x85 z", "it's 12３ ½"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, N_TOKENS int"
LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, odd texts, repeated rows, extra columns with names that operators add."""
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "mine", 7) for i, t in enumerate(ODD)]
    rows += [rows[4], rows[4], (None, "no id here", None, None, None, None, None), (3, "same id as another row", "en", "s0", 1, "mine", 7)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(20)] + [(None, 1, 1), (4, None, None), (4, 1, 0)], LABELS)


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_token_counts_equal_the_library(spark, odd, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(5)
    noise = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x500), 0x20, 0x0A, 0x1F600])) for _ in range(60)) for _ in range(200)]
    counter = token_counts.MergeCounter.from_json(open(path, encoding="utf-8").read())
    some = [t for t in ODD if t is not None] + texts + noise
    assert [counter.count(t) for t in some] == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]
    out = token_counts.count_tokens(odd, path)
    assert [f.name for f in out.schema][-3:] == ["n_bytes", "n_tokens", "over_limit"] and "N_TOKENS" not in out.columns
    got = out.collect()
    assert len(got) == odd.count()
    assert all(r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids) and r.over_limit == (r.n_tokens > 512) and r.n_bytes == len((r.text or "").encode()) for r in got)
    assert token_counts.count_tokens(empty(spark), path).count() == 0


def best_cut(codec, word):
    """The largest sum over all ways to cut a word, by dynamic programming over its characters and a plain dictionary."""
    score = {p: codec.scores[i] for i, p in enumerate(codec.pieces) if codec.kinds[i] == pieces.NORMAL}
    best = [0.0] + [float("-inf")] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - 20), end):
            s = score.get(word[start:end], codec_unknown(score) if end - start == 1 else None)
            if s is not None:
                best[end] = max(best[end], best[start] + s)
    return best[-1]


def codec_unknown(score, cache=[]):  # noqa: B006
    if not cache:
        cache.append(min(score.values()) - pieces.UNKNOWN_PENALTY)
    return cache[0]


def test_pieces_are_the_best_cut_and_decode_back(spark, odd, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = pieces.load(path)
    codec = pieces.Codec(model)
    for i, p in enumerate(model.pieces):  # the trie holds every piece
        if model.kinds[i] == pieces.NORMAL:
            node = 0
            for b in p.encode():
                t = int(model.base[node]) + b + 1
                assert model.check[t] == node
                node = t
            assert model.value[node] == i
    words = sorted({w for t in texts[:40] for w in codec.split(pieces.MARK + t.replace(" ", pieces.MARK))})[:1500] + ["日本語é🙂x", "▁▁▁", "\x00a", "x" * 80]
    plain = type("C", (), {"scores": model.scores, "pieces": model.pieces, "kinds": model.kinds})
    cut = codec.cut(words)
    alone = [codec.viterbi(w) for w in words]
    assert [np.frombuffer(c, np.int32).tolist() for c in cut] == [ids for ids, _ in alone]
    assert all(abs(s - best_cut(plain, w)) < 1e-6 for w, (_, s) in zip(words, alone, strict=True))
    for t in texts[:20]:
        assert codec.encode(t)[1] == pytest.approx(sum(codec.viterbi(w)[1] for w in codec.split(pieces.MARK + t.replace(" ", pieces.MARK))))
    for t in texts + [x for x in ODD if x and pieces.MARK not in x]:
        assert codec.decode(codec.encode(t)[0]) == t
    out = pieces.encode_texts(odd, path)
    got = out.collect()
    assert len(got) == odd.count() and all(r.round_trip == (pieces.MARK not in (r.text or "")) and r.n_pieces == len(r.pieces) for r in got)
    back = pieces.decode_pieces(out.select("text", "pieces"), path).collect()
    assert all(r.decoded == (r.text or "").replace(pieces.MARK, " ") for r in back)
    assert pieces.encode_texts(empty(spark), path).count() == 0


def test_a_long_text_without_blanks_takes_time_in_proportion():
    codec = pieces.Codec(pieces.load(public_tokenizers.path("piece_bpe_32k.model")))
    text = "".join(random.Random(8).choices("abcdefghijklmnop日本語é", k=1_000_000))
    start = time.perf_counter()
    ids, _ = codec.encode(text)
    assert time.perf_counter() - start < 40  # some four seconds; it was hours
    assert codec.decode(ids) == text


def test_pieces_keep_apart_from_columns_of_the_same_names(spark):
    df = spark.createDataFrame([(1, "a b", "mine", 5, 0.5)], "doc_id bigint, text string, pieces string, N_Pieces int, score double")
    row = pieces.encode_texts(df, public_tokenizers.path("piece_bpe_32k.model")).collect()[0]
    assert row.n_pieces == len(row.pieces) and row.round_trip and len(row) == 7


def test_pieces_equal_the_library_where_its_sums_are_exact(texts):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    proto.trainer_spec.model_type = 1  # unigram
    for p in proto.pieces:
        p.score = max(p.score, -40000.0)
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    codec = pieces.Codec(pieces.build([p.piece for p in proto.pieces], [p.score for p in proto.pieces], [p.type for p in proto.pieces]))
    short = sorted({w for t in texts for w in t.split()})[:4000] + ["a b c", "é🙂", "日本語"]
    assert all(codec.encode(w)[1] == pytest.approx(sum(codec.scores[i] if codec.scores[i] else -40010.0 for i in library.encode(w) if i >= 259)) for w in short if not codec.is_byte[codec.encode(w)[0]].any())


def test_rule_measures_against_brute_force(spark, odd, labels, texts):
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
        inside = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)

    for t in texts[:60] + [t for t in ODD if t is not None] + ["a\na\n\nb\na", "x y z x y z | # q"]:
        assert quality_rules.measures(t.encode()) == brute(t)
    got = quality_rules.apply_rules(odd, labels).collect()
    assert len(got) == odd.count() and all(isinstance(r.kept, bool) and not (r.base_failed and r.kept) for r in got)
    assert quality_rules.keep_by_rules(odd, labels).schema == odd.schema
    assert quality_rules.apply_rules(empty(spark), labels).count() == 0


def test_ratio_models_count_all_text(spark, odd, labels):
    docs = odd.select("doc_id", "text")

    def add(batch, acc):
        for t in batch.column(1).to_pylist():
            np.add.at(acc, grams((t or "").encode()), 1)

    counts = corpus_counts(docs.repartition(5), 1 << 14, add)
    want = np.zeros(1 << 14, int)
    for r in docs.collect():
        np.add.at(want, grams((r.text or "").encode()), 1)
    assert (counts == want).all()
    assert (ratios_of(np.zeros(8, int), np.arange(8)) == 0).all()


def test_resampling_keeps_exactly_the_k_largest(spark, odd, labels):
    out = importance_resampling.resample(odd, labels, k=6).collect()
    assert len(out) == odd.count()
    order = sorted(out, key=lambda r: (r.perturbed, r.doc_id if r.doc_id is not None else -(1 << 63)), reverse=True)
    edge = (order[5].perturbed, order[5].doc_id)
    assert all(r.kept == ((r.perturbed, r.doc_id if r.doc_id is not None else -(1 << 63)) >= edge) for r in out)
    assert importance_resampling.keep_resampled(odd, labels, k=6).schema == odd.schema
    assert sum(r.kept for r in importance_resampling.resample(odd, labels, k=0).collect()) == 0
    assert importance_resampling.resample(empty(spark), labels).count() == 0


def plain_grams(text):
    """Buckets of a text's tokens and token pairs, in Python integers."""
    from xxhash import xxh3_64_intdigest

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
        return x ^ x >> 31

    h = [xxh3_64_intdigest(w) for w in re.findall(rb"[A-Za-z0-9_\x80-\xff]+|[^A-Za-z0-9_\x80-\xff\x20\x09-\x0d]+", (text or "").encode())]
    pairs = [mix((mix((a + 2) % (1 << 64)) * 0x9E3779B97F4A7C15 + b) % (1 << 64)) for a, b in zip(h, h[1:])]
    return [mix(x) % (1 << 14) for x in h + pairs]


def plain_ratios(docs, good):
    """log P(bucket | target) - log P(bucket | raw), from counts in plain lists."""
    raw, target = [0] * (1 << 14), [0] * (1 << 14)
    for i, text in docs:
        for b in plain_grams(text):
            raw[b] += 1
            target[b] += i in good
    n_raw, n_target = sum(raw), sum(target)
    if not n_target:
        return [0.0] * len(raw)
    prior = [(c + 1) / (n_raw + len(raw)) for c in raw]
    return [math.log((t + len(raw) * p) / (n_target + len(raw)) / p) for t, p in zip(target, prior, strict=True)]


def gumbel(i):
    """The noise of an id: 52 bits of the public 64-bit hash of seed and id."""
    text = b"" if i is None else str(i).encode()
    seeded = xxhash.xxh64(struct.pack("<i", importance_resampling.SEED), seed=42).intdigest()
    bits = (seeded if i is None else xxhash.xxh64(text, seed=seeded).intdigest()) >> 12
    return -math.log(-math.log((bits + 0.5) / 2**52))


def sample_of_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, "no id"), (5, None), (7, "again " * 40)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), labels, rows, plain_ratios(rows, good)


def test_importance_weights_noise_and_k_against_brute_force(spark):
    docs, labels, rows, ratios = sample_of_documents(spark)
    want = {(i, t): sum(ratios[b] for b in plain_grams(t)) for i, t in rows}
    ratio = importance_resampling.log_ratios(docs, labels)
    weighed = importance_resampling.weigh(docs, ratio).collect()
    assert len(weighed) == len(rows)
    for r in weighed:  # whole texts of every length are weighed alike
        assert r.log_weight == pytest.approx(want[r.doc_id, r.text], abs=1e-6)
        assert r.perturbed == pytest.approx(r.log_weight + gumbel(r.doc_id), abs=1e-6)
        assert r.n_grams == len(plain_grams(r.text))
    known = {r.doc_id: r.quality for r in labels.collect()}
    share = sum(q == 1 for q in known.values()) / len(known)
    for k, n in ((None, math.ceil(share * len(rows))), (17, 17)):
        order = sorted((want[i, t] + gumbel(i) for i, t in rows), reverse=True)
        edge = (order[n - 1] + order[n]) / 2
        got = importance_resampling.resample(docs.withColumn("copy", F.col("text")), labels, k=k).collect()
        assert all(r.kept == (want[r.doc_id, r["copy"]] + gumbel(r.doc_id) > edge) for r in got) and sum(r.kept for r in got) == n


def test_rule_verdicts_against_brute_force(spark):
    docs, labels, rows, ratios = sample_of_documents(spark)
    got = {(r.doc_id, r.text): r for r in quality_rules.apply_rules(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r, found = got[i, t], plain_grams(t)
        mean = sum(ratios[b] for b in found) / len(found) if found else 0.0
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        repeats = len({j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 3)})
        failed = len(words) < 50 or 100 * repeats > 50 * len(words)
        assert r.mean_ratio == pytest.approx(mean, abs=1e-9) and r.base_failed == failed
        assert r.kept == (not failed and mean >= quality_rules.MIN_RATIO)


def test_junk_goes_and_clean_text_stays(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    known = labels.select("doc_id", "quality")
    # k is the share of good rows, so a clean text too few makes room for junk: 0.10 of it on these 1,000 documents, 0.02 on the 10,000 of sf0.1
    for out, junk in ((importance_resampling.resample(docs.select("doc_id", "text"), labels), 0.15), (quality_rules.apply_rules(docs.select("doc_id", "text"), labels).where("not base_failed"), 0.05)):
        rate = {r.quality: r.rate for r in out.join(known, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
        assert rate[1] > 0.97 and rate.get(0, 0) < junk


def test_partial_counters_travel_whole():
    rng = np.random.default_rng(7)
    for v in (np.zeros(9), np.arange(600), np.where(rng.random(1 << 14) < 0.1, rng.integers(0, 1 << 40, 1 << 14), 0), rng.integers(0, 300, 1 << 14)):
        assert (_unpacked(_packed(v.astype(np.int64))) == v).all()


def test_kth_largest(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(-5, 5) << rng.randrange(0, 60), rng.randrange(-(1 << 62), 1 << 62)) for _ in range(500)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    order = sorted(rows, reverse=True)
    assert all(largest(df, k, ["a", "b"]) == order[k - 1] for k in (1, 2, 77, 499))
    assert largest(df, 500, ["a", "b"]) is None


def test_mixing_hits_its_rates(spark, odd):
    docs = spark.range(40000).select(F.col("id").alias("doc_id"), F.lit("0123456789").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    out = mixing.mix(docs, {"a": 3.0, "b": 1.0, "absent": 9.0}, epochs=1.0)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["a"] - 30000) < 600 and abs(n["b"] - 10000) < 400
    copies = {r.n_copies: r["count"] for r in out.where("source = 'a' and copy_no = 1").groupBy("n_copies").count().collect()}
    for k in range(1, 6):  # Poisson of mean 3
        p = np.exp(-3) * 3**k / np.prod(range(1, k + 1))
        assert abs(copies[k] / 10000 - p) < 0.02
    assert out.select("doc_id", "copy_no").distinct().count() == out.count()
    head = [r.doc_id for r in out.limit(200).collect()]
    assert np.mean(np.abs(np.diff(head))) > 8000  # no trace of the order of input
    assert mixing.mixed_rows(odd).schema == odd.schema
    assert mixing.mix(empty(spark)).count() == 0
    clash = odd.withColumn("n_copies", F.lit("mine")).withColumn("COPY_NO", F.lit("mine")).withColumn("shuffle_key", F.lit("mine"))
    out = mixing.mix(clash, {None: 40.0, "s0": 1.0, "s1": 1.0, "s2": 1.0}, epochs=3.0).collect()
    of = {}
    for r in out:
        of.setdefault((r.doc_id, r.text), []).append((r.n_copies, r.copy_no, r.shuffle_key))
    for rows in of.values():  # a row for each copy, with a key for each
        n = {n for n, _, _ in rows}
        assert len(n) == 1 and {c for _, c, _ in rows} == set(range(1, n.pop() + 1)) and len({(c, k) for _, c, k in rows}) == len({c for _, c, _ in rows})
    assert (None, "no id here") in of
    lost = spark.range(3000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"), F.lit("a").alias("source"))
    some = mixing.mix(lost, {"a": 1.0})
    assert abs(some.count() - 3000) < 300 and some.select("shuffle_key").distinct().count() == some.count()  # rows without an id draw each for itself
    big = mixing.mix(docs.limit(50), {"a": 1.0}, epochs=900.0)
    assert abs(big.count() - 45000) < 2000


def sample_of(docs, y):
    return toxicity.Sample.of(pa.array([sorted(d) for d in docs], pa.list_(pa.string())), np.array(y))


def test_toxicity_of_held_out_texts_and_gap_of_swapped_ones(spark):
    docs, known = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    sample = toxicity.labelled_texts(docs, known)
    found = toxicity.found_groups(sample)
    assert len(found) > 100 and all(len(set(g)) >= 2 for g in found)
    plain, model = (toxicity.train(sample, toxicity.IDENTITY_GROUPS + found, c) for c in (0.0, toxicity.COUNTERFACTUAL))
    assert model.n_swapped > len(sample.y) / 2  # the counterfactual part is at work on these tables
    rows = toxicity.score_texts(docs.join(known, "doc_id"), model).where(toxicity.held_out(F.col("doc_id"))).select("toxic", "predicted", "score", "text", "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.8
    assert sum(r.predicted for r in rows if not r.toxic) / (len(rows) - len(toxic)) < 0.02
    swap, gaps = toxicity.swaps(found), []
    for m in (plain, model):
        score = toxicity.Scorer(m).score
        texts = [(r.text, " ".join(swap.get(w, w) for w in toxicity.words_of(r.text))) for r in rows if not toxicity.words_of(r.text).isdisjoint(swap)]
        gaps.append(np.mean([abs(score(a) - score(b)) for a, b in texts]))
    assert len(texts) > 100 and gaps[1] < gaps[0] / 5


def test_toxicity_counterfactuals_flatten_identity_terms():
    # a group term that happens to go with insults in training
    rng = random.Random(1)
    insult, plain, fill = ["idiot", "scum"], ["gay", "lesbian", "straight", "bisexual", "transgender"], [f"w{i}" for i in range(300)]
    docs, y = [], []
    for i in range(1200):
        bad = i % 3 == 0
        docs.append({*rng.sample(fill, 12), *([rng.choice(insult)] if bad else []), *(["gay"] if rng.random() < (0.6 if bad else 0.02) else [])})
        y.append(float(bad))
    mention = f"{plain[0]} w1 w2"
    scores = [toxicity.Scorer(toxicity.train(sample_of(docs, y), toxicity.IDENTITY_GROUPS, c)).score(mention) for c in (0.0, toxicity.COUNTERFACTUAL)]
    assert scores[1] < scores[0] and scores[1] < 0.5


def test_toxicity_score_gradient_and_groups_against_brute_force():
    rng = random.Random(2)
    words = [f"{a}{b}ing" for a in "abcd" for b in "uvwxyz"]
    docs = [set(rng.sample(words, rng.randrange(1, 9))) for _ in range(80)]
    y = np.array([float("auing" in d or rng.random() < 0.2) for d in docs])
    groups = (("auing", "buing", "cuing"), ("dxing", "dying"))
    p = toxicity.problem(sample_of(docs, y), groups, 3.0)
    w, bias = np.random.default_rng(1).uniform(0, 1, len(p.names)), -0.7
    of = dict(zip(p.names.tolist(), w, strict=True))
    logit = lambda d: bias + sum(of.get(f, 0.0) for f in {f for x in d for f in toxicity.features(x)})
    change = [(logit(d) - logit({s.get(x, x) for x in d})) ** 2 for d in docs for s in (toxicity.swaps(groups, 1), toxicity.swaps(groups, 2)) if {s.get(x, x) for x in d} != d]
    log_loss = np.mean([np.log1p(np.exp(logit(d))) - t * logit(d) for d, t in zip(docs, y, strict=True)])
    assert p.n_swapped == sum(not d.isdisjoint(sum(groups, ())) for d in docs) and p.n_pairs == len(change)
    assert p.loss(w, bias) == pytest.approx(log_loss + 3.0 * sum(change) / len(change))
    g, e = p.gradient(w, bias)
    for j in range(len(w)):  # finite differences
        step = np.eye(len(w))[j] * 1e-6
        assert g[j] == pytest.approx((p.loss(w + step, bias) - p.loss(w - step, bias)) / 2e-6, abs=1e-6)
    assert e == pytest.approx((p.loss(w, bias + 1e-6) - p.loss(w, bias - 1e-6)) / 2e-6, abs=1e-6)
    model = toxicity.Classifier(bias, {k: v for k, v in of.items()})
    for d in docs[:20]:
        assert toxicity.Scorer(model).score(" ".join(d)) == pytest.approx(1 / (1 + np.exp(-logit(d))))
    assert toxicity.found_groups(sample_of(docs, np.zeros(80))) == () and toxicity.swaps((("a", "b"),), 2) == {"a": "a", "b": "b"}


def test_toxicity_of_odd_rows(spark, odd, labels):
    got = toxicity.score_texts(odd.withColumn("score", F.lit("mine")).withColumn("PREDICTED", F.lit("mine")), toxicity.fit(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = toxicity.fit(odd, labels.limit(0))
    assert none.weights == {}
    assert toxicity.score_texts(empty(spark), none).count() == 0
    repeated = spark.createDataFrame([(1, f"t{i}") for i in range(50)], "doc_id bigint, text string")
    assert len(toxicity.labelled_texts(repeated, labels).y) == 1


def test_every_good_text_is_counted(spark):
    rows = [(i, f"w{i} x{i % 7}") for i in range(20_300)] + [(None, "no id")]
    good = set(range(0, 20_300)) - {5}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.range(20_300).selectExpr("id AS doc_id", "CAST(id <> 5 AS INT) AS quality")
    want = plain_ratios(rows, good)
    for most in (1_000_000, 100):  # by broadcast and by shuffle
        assert ngram_ratio.log_ratios(docs, labels, max_broadcast=most) == pytest.approx(want, abs=1e-9)

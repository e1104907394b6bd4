"""Operator 8: toxicity by a counterfactual-regularised classifier.

A logistic model over the distinct words of a text and the beginnings of those words (as so many insults are word
families). Its loss has three parts: the log loss on labelled texts; the squared change of a labelled text's logit when
its identity terms are swapped for other terms of their group, several ways a text, so that a neutral mention does not
raise the score; and an L1 penalty. Weights are not negative: evidence of toxicity is not outweighed by the rest of a
long text.

Identity terms: groups given by name, and groups found in the labelled texts. A found term is a word of both classes
that goes with the toxic label more than chance has it, though most texts that mention it are not toxic; its group has
up to SPREAD such terms and the neutral words that most share their texts, so swaps stay within a language and a topic.

It learns from a bounded sample: the MAX_TRAIN labelled rows of the lowest hash of their id, none of them held out
(crc32 of the id as text, modulo 5, is 0). Scoring reads whole texts and nothing else.

Defined results: null text is the empty text, whose score is that of no evidence; a null id counts as held out; several
labels of one id count as toxic if one is, and of several texts of one id the first by text is learned from; without
labels the score is 0.25; repeated rows get equal scores; input columns of the added names are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table
from .common import texts, with_text_columns

MAX_TRAIN = 8_000
#: A feature is used if that many training texts have it.
MIN_TEXTS = 4
PREFIXES = (4, 6)
FOLDS = 5
#: Weight of the counterfactual part and of the L1 part.
COUNTERFACTUAL, L1 = 5.0, 3e-4
STEPS, FIRST_STEPS, RATE, KEPT_MEAN, KEPT_SQUARE = 200, 60, 0.1, 0.9, 0.99
#: Smaller weights are left out of the model.
LEAST = 1e-3
REMEMBERED = 1 << 17
#: Texts whose swaps are worked out at once.
PORTION = 512
#: Found terms: least toxic and other texts, least standard deviations above chance; how many terms, and neutral words to choose from.
MIN_TOXIC, MIN_OTHER, ABOVE_CHANCE, MAX_TERMS, MAX_NEUTRAL = 3, 6, 1.5, 512, 1024
#: Found terms of a group, and ways to swap a text.
SPREAD, SWAPS = 3, 2
#: Groups of identity terms that may stand for each other.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("immigrants", "refugees", "natives"),
    ("deaf", "blind", "disabled"),
    ("musulman", "chrétien", "juif", "athée"),
    ("muslime", "christ", "jude", "atheist"),
    ("musulmán", "cristiano", "judío", "ateo"),
)
_WORD = re.compile(r"\w+")
Groups = tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class Classifier:
    bias: float
    weights: dict[int, float]
    #: Groups whose terms were swapped, and labelled texts that held one of them.
    groups: Groups = ()
    n_swapped: int = 0


def features(word: str) -> list[int]:
    """Hashes of a lower-cased word and its beginnings."""
    from xxhash import xxh3_64_intdigest

    return [xxh3_64_intdigest(word), *(xxh3_64_intdigest(word[:k] + "*") for k in PREFIXES if len(word) > k)]


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def swaps(groups: Groups, way: int = 1) -> dict[str, str]:
    """Each term with the one that takes its place, `way` steps on in its group; a term of several groups is swapped in the first."""
    out: dict[str, str] = {}
    for g in groups:
        for i, term in enumerate(g):
            out.setdefault(term, g[(i + way) % len(g)])
    return out


@dataclass
class Sample:
    """Labelled texts: their distinct words (word of row, as places in `words`) and whether each is toxic."""

    words: list[str]
    row: np.ndarray
    word: np.ndarray
    y: np.ndarray

    @classmethod
    def of(cls, docs: pa.Array, y: np.ndarray) -> Sample:
        """From a list array of each text's distinct words."""
        flat = docs.flatten().dictionary_encode()
        lengths = docs.value_lengths().to_numpy(zero_copy_only=False)
        return cls(flat.dictionary.to_pylist(), np.repeat(np.arange(len(y)), lengths), flat.indices.to_numpy(), np.asarray(y, float))


def found_groups(sample: Sample, given: Groups = ()) -> Groups:
    """Groups of terms that go with the toxic label though their mentions are mostly neutral, each with neutral words to stand for them."""
    y, row, word, names = sample.y, sample.row, sample.word, sample.words
    n, n_toxic = len(y), float(y.sum())
    if not 0 < n_toxic < n:
        return ()
    toxic = np.bincount(word, y[row], len(names))
    every = np.bincount(word, minlength=len(names))
    base = n_toxic / n
    above = (toxic - base * every) / np.sqrt(every * base * (1 - base))
    taken = {t for g in given for t in g}
    free = np.array([w not in taken for w in names])
    both = free & (toxic >= MIN_TOXIC) & (every - toxic >= MIN_OTHER) & (every * 2 <= n)
    rank = lambda ok, by: sorted(np.flatnonzero(ok).tolist(), key=lambda i: (-by[i], names[i]))
    terms = rank(both & (2 * toxic < every) & (above >= ABOVE_CHANCE), above)[:MAX_TERMS]
    neutral = rank(both & (np.abs(above) <= ABOVE_CHANCE / 2), every)[:MAX_NEUTRAL]
    if not terms or not neutral:
        return ()

    def holds(chosen: list[int]) -> np.ndarray:
        place = np.full(len(names), -1)
        place[chosen] = np.arange(len(chosen))
        out = np.zeros((n, len(chosen)), np.float32)
        ok = place[word] >= 0
        out[row[ok], place[word[ok]]] = 1
        return out

    shared = holds(terms).T @ holds(neutral) / np.sqrt(every[neutral])
    closest = shared.argmax(axis=1)
    by_neutral: dict[int, list[int]] = {}
    for t, at in zip(terms, closest.tolist(), strict=True):
        by_neutral.setdefault(neutral[at], []).append(t)
    out = []
    for at, group in sorted(by_neutral.items(), key=lambda x: names[x[0]]):
        out += [(names[at], *(names[t] for t in group[lo : lo + SPREAD])) for lo in range(0, len(group), SPREAD)]
    return tuple(out)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def labelled_texts(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Sample:
    """The labelled texts to learn from: at most max_train."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64(F.lit(8), "doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")  # at most max_train pairs of numbers
    rows = rows.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")).select("doc_id", "toxic", "text")

    def extract(batches):
        for b in batches:
            found = [sorted(words_of(t)) for t in texts(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.int32()), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "toxic", "words"])

    got = rows.mapInArrow(extract, "doc_id bigint, toxic int, words array<string>").toArrow().sort_by("doc_id")
    words = got.column("words").combine_chunks()
    if isinstance(words, pa.ChunkedArray):
        words = pa.concat_arrays(words.chunks) if words.num_chunks else pa.array([], pa.list_(pa.string()))
    return Sample.of(words, got.column("toxic").to_numpy())


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, groups: Groups = IDENTITY_GROUPS, find: bool = True, counterfactual: float = COUNTERFACTUAL) -> Classifier:
    sample = labelled_texts(docs, labels, max_train)
    return train(sample, groups + (found_groups(sample, groups) if find else ()), counterfactual)


@dataclass
class Problem:
    """The loss as sparse matrices: texts by features, and for each swapped text the features it gains and loses."""

    y: np.ndarray
    names: np.ndarray
    row: np.ndarray
    col: np.ndarray
    pair: np.ndarray
    moved: np.ndarray
    sign: np.ndarray
    n_pairs: int
    n_swapped: int
    counterfactual: float

    def only(self, keep: np.ndarray) -> Problem:
        """The same loss of some of the features, the others at 0."""
        place = np.cumsum(keep) - 1
        own, swap = keep[self.col], keep[self.moved]
        return replace(self, names=self.names[keep], row=self.row[own], col=place[self.col[own]], pair=self.pair[swap], moved=place[self.moved[swap]], sign=self.sign[swap])

    def loss(self, w: np.ndarray, bias: float) -> float:
        """The log loss and the counterfactual part, without L1."""
        s = np.bincount(self.row, w[self.col], len(self.y)) + bias
        change = np.bincount(self.pair, w[self.moved] * self.sign, self.n_pairs)
        return float(np.mean(np.logaddexp(0, s) - self.y * s) + self.counterfactual * (change**2).sum() / max(1, self.n_pairs))

    def gradient(self, w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        n = len(self.y)
        s = np.clip(np.bincount(self.row, w[self.col], n) + bias, -30, 30)
        e = (1 / (1 + np.exp(-s)) - self.y) / n
        g = np.bincount(self.col, e[self.row], len(w))
        if self.n_pairs:
            change = np.bincount(self.pair, w[self.moved] * self.sign, self.n_pairs)
            g += 2 * self.counterfactual / self.n_pairs * np.bincount(self.moved, change[self.pair] * self.sign, len(w))
        return g, float(e.sum())


def problem(sample: Sample, groups: Groups, counterfactual: float) -> Problem:
    ways = [swaps(groups, i + 1) for i in range(SWAPS)]
    place = {w: i for i, w in enumerate(sample.words)}
    for term in ways[0]:
        place.setdefault(term, len(place))
    # features of each word, and the word that takes its place each way
    size = np.fromiter((1 + sum(len(w) > k for k in PREFIXES) for w in place), np.int64, len(place))
    all_names, feature = np.unique(np.fromiter((f for w in place for f in features(w)), np.uint64, int(size.sum())), return_inverse=True)
    start = np.cumsum(size) - size
    becomes = [np.arange(len(place)) for _ in ways]
    for way, to in zip(ways, becomes, strict=True):
        for a, b in way.items():
            to[place[a]] = place[b]
    term = np.zeros(len(place), bool)
    term[[place[t] for t in ways[0]]] = True
    some = len(all_names)

    def keys(row: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Row and feature of each row of words, in one number."""
        n = size[word]
        at = np.repeat(start[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.unique(np.repeat(row, n) * some + feature[at])

    own_keys, lost, gained, n_pairs, n_swapped = [], [], [], 0, 0
    for lo in range(0, len(sample.y), PORTION):  # some texts at a time
        a, b = np.searchsorted(sample.row, [lo, lo + PORTION])
        row, word = sample.row[a:b], sample.word[a:b]
        own = keys(row, word)
        own_keys.append(own)
        swapped = np.unique(row[term[word]])
        n_swapped += len(swapped)
        inside = np.isin(row, swapped)
        before = own[np.isin(own // some, swapped)] if some else own
        for to in becomes:
            after = keys(row[inside], to[word[inside]])
            gone, new = np.setdiff1d(before, after, assume_unique=True), np.setdiff1d(after, before, assume_unique=True)
            texts_changed = np.unique(np.concatenate([gone, new]) // max(1, some))
            for out, k in ((lost, gone), (gained, new)):
                out.append(np.stack([n_pairs + np.searchsorted(texts_changed, k // max(1, some)), k % max(1, some)]))
            n_pairs += len(texts_changed)
    none = np.zeros((2, 0), np.int64)
    own, (pair_a, at_a), (pair_b, at_b) = np.concatenate(own_keys or [none[0]]), np.concatenate(lost or [none], axis=1), np.concatenate(gained or [none], axis=1)
    used = np.bincount(own % max(1, some), minlength=some) >= MIN_TEXTS
    own = own[used[own % max(1, some)]]
    row, col = own // max(1, some), own % max(1, some)
    own_keys.clear()
    number = np.cumsum(used) - 1
    p = Problem(sample.y, all_names[used], row, number[col], np.concatenate([pair_a[used[at_a]], pair_b[used[at_b]]]), np.concatenate([number[at_a[used[at_a]]], number[at_b[used[at_b]]]]), np.zeros(0), n_pairs, n_swapped, counterfactual)
    return replace(p, sign=np.concatenate([np.ones(int(used[at_a].sum())), -np.ones(int(used[at_b].sum()))]))


def train(sample: Sample, groups: Groups = IDENTITY_GROUPS, counterfactual: float = COUNTERFACTUAL) -> Classifier:
    """Projected steps of a rate for each weight (Adam's), slower and slower. On weights that aren't negative, L1 is a constant slope."""
    y, n = sample.y, len(sample.y)
    bias = float(np.log((y.sum() + 0.5) / (n - y.sum() + 1.5)))
    if not 0 < y.sum() < n:
        return Classifier(bias, {})
    p = problem(sample, groups, counterfactual)
    w = np.zeros(len(p.names) + 1)  # the last is the bias
    w[-1] = bias
    mean, square = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, STEPS + 1) if len(p.names) else ():
        g, e = p.gradient(w[:-1], w[-1])
        g = np.append(g + L1, e)
        mean, square = KEPT_MEAN * mean + (1 - KEPT_MEAN) * g, KEPT_SQUARE * square + (1 - KEPT_SQUARE) * g * g
        w -= RATE * (1 - (t - 1) / STEPS) * (mean / (1 - KEPT_MEAN**t)) / (np.sqrt(square / (1 - KEPT_SQUARE**t)) + 1e-9)
        w[:-1] = np.maximum(0, w[:-1])
        if t == FIRST_STEPS:  # most features are at 0 by now and would rather be below it
            keep = np.append((w[:-1] > 0) | (mean[:-1] < 0), True)
            p, w, mean, square = p.only(keep[:-1]), w[keep], mean[keep], square[keep]
    return Classifier(float(w[-1]), {int(k): float(v) for k, v in zip(p.names, w[:-1], strict=True) if v > LEAST}, groups, p.n_swapped)


class Scorer:
    def __init__(self, model: Classifier):
        self.bias, weights = model.bias, model.weights

        class Seen(dict):
            def __missing__(self, word):
                if len(self) >= REMEMBERED:
                    self.clear()
                self[word] = found = tuple((f, weights[f]) for f in features(word) if f in weights)
                return found

        self.seen = Seen()

    def score(self, text: str) -> float:
        found = {f: w for hits in map(self.seen.__getitem__, words_of(text)) if hits for f, w in hits}
        s = self.bias + sum(found[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, s)))))


def score_texts(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """docs with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))  # no more weights than the bounded sample has features

    def make():
        scorer = Scorer(Classifier(*shared.value))

        def work(batch):
            s = [scorer.score(t) for t in batch]
            return [s, [int(v >= 0.5) for v in s]]

        return work

    added = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return with_text_columns(docs, text, added, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_texts(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

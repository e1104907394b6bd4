"""Operator 6: language-model scoring by cross-entropy difference.

Two bigram models, of target text (all rows labelled as good) and of the whole corpus, share one vocabulary and one form:
P(w | v) = MIX * c(v w) / c(v) + (1 - MIX) * (c(w) + 1) / (N + V). Every document is scored by the models of all other
documents: its own counts are left out of both. Its score is the mean, over its tokens, of the loss under the target
model minus the loss under the background model; the lower, the more it is like the target.

Words are lower-cased (A-Z) and split at ASCII white space, and known by 64-bit hashes; every word of the corpus is in
the vocabulary. What is counted grows with the corpus and stays on the executors:

1. Words of all documents are counted in a table, and so are bigrams that are frequent in a sample of documents. The
   most frequent words (at most FREQUENT) and those bigrams are broadcast with their counts.
2. Every other word and bigram of a document goes, with how often the document has it, to the block of its hash. There it
   is counted, and how often other documents have it goes back: only the count, as both sides know the order of items.
3. Documents meet what came back and are scored.

The sample only decides which of the two ways a count takes, not the result.

Defined results: null text is the empty text, which has no tokens and score 0; without other target text the target model
is the uniform one; rows of one id are documents of their own, whose text is target text if the id is labelled good;
repeated rows get a row each and equal scores, and count for each other; rows with a null id are scored too; columns other
than id and text are left out.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, small_batches, table, written
from .common import give_back, mix64, portions, texts, word_hashes
from .jaccard_join import MAX_BROADCAST_IDS

MIX = 0.7
#: Words, and bigrams, whose counts are sent to every executor, at most.
FREQUENT = 1 << 19
#: Documents looked at for frequent bigrams, and how many of them have such a one at least.
SAMPLE, LEAST = 16_000, 4
#: Tokens that a task counts at once; bytes of text for each block of hashes and each group of documents.
PORTION, BLOCK = 1 << 21, 16 << 20
#: Id of the start of a text (not 0: a bigram's key must not be that of its second word).
START = 0x5374617274
#: A bigram's key is FACTOR times the word before it, plus the word (as 64-bit numbers).
FACTOR = 0x9E3779B97F4A7C15


def word_ids(text: bytes) -> np.ndarray:
    """The id of each word of a whole text."""
    return word_hashes(text.lower().split()).view(np.int64)


def items(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text: its words with the start, and their counts; its bigrams, their counts, and the places of both their words among the words."""
    if not len(ids):
        return (ids,) * 6
    words, at, n = np.unique(np.concatenate([[START], ids]).astype(np.int64), return_inverse=True, return_counts=True)
    before = words[at[:-1]].view(np.uint64) * np.uint64(FACTOR)
    pairs, first, times = np.unique((before + ids.view(np.uint64)).view(np.int64), return_index=True, return_counts=True)
    return words, n, pairs, times, at[first], at[first + 1]


def found(table: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each id in a sorted table, and whether it is there."""
    at = np.minimum(np.searchsorted(table, ids), max(0, len(table) - 1))
    return at, table[at] == ids if len(table) else np.zeros(len(ids), bool)


def marked(docs: DataFrame, labels: DataFrame, max_broadcast: int = MAX_BROADCAST_IDS) -> DataFrame:
    """doc (a hash of id and text), text and good (whether the id is labelled of good quality) of every row. Ids are broadcast if they are few."""
    ids = written(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(True).alias("good")).distinct(), "good")
    few = ids.limit(max_broadcast + 1).count() <= max_broadcast
    rows = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left").select("doc", "text", F.coalesce("good", F.lit(False)).alias("good"))
    return rows if few else written(rows, "marked")  # texts are shuffled once


def counted(rows: DataFrame, of) -> DataFrame:
    """How often each item occurs in all rows (n), in good ones (n_good), and whether it is a word. of: items, counts and their kind of a text's ids."""
    small_batches(rows.sparkSession)

    def count(batches):
        waiting, size = [], 0

        def flush():
            item, n, word = (np.concatenate([x[i] for x, _ in waiting]) for i in range(3))
            good = np.concatenate([np.full(len(x[0]), g) for x, g in waiting])
            key, first, at = np.unique(item, return_index=True, return_inverse=True)
            sums = [np.bincount(at, c, len(key)).astype(np.int64) for c in (n, n * good)]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, sums), pa.array(word[first])], names=["item", "n", "n_good", "word"])

        for b in (part for whole in batches for part in portions(whole)):
            for t, good in zip(texts(b, "text", True), b.column(1).to_pylist(), strict=True):
                waiting.append((of(word_ids(t)), good))
                size += len(waiting[-1][0][0])
                if size >= PORTION:
                    yield flush()
                    size = 0
        if waiting:
            yield flush()
        give_back()

    parts = rows.select("text", "good").mapInArrow(count, "item bigint, n bigint, n_good bigint, word boolean")
    return parts.groupBy("item").agg(F.sum("n").alias("n"), F.sum("n_good").alias("n_good"), F.first("word").alias("word"))


def most_frequent(df: DataFrame, frequent: int) -> DataFrame:
    """The rows of df of the highest n, at most `frequent`."""
    # how frequent the frequent ones are: at most 65,536 counts
    histogram = sorted(((r.at, r.rows) for r in df.groupBy(F.least("n", F.lit(65_535)).alias("at")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    least, room = 65_536, frequent
    for at, n in histogram:
        if n > room:
            break
        least, room = at, room - n
    return df.where(F.col("n") >= least)


def as_arrays(df: DataFrame) -> tuple[np.ndarray, ...]:
    """The columns of a few rows, sorted by the first."""
    return tuple(c.to_numpy() for c in df.toArrow().sort_by(df.columns[0]).columns)


def frequent_bigrams(rows: DataFrame, n_rows: int, frequent: int, sample: int, least: int) -> np.ndarray:
    """Sorted keys of bigrams of a sample of about `sample` documents, by hash."""

    def bigrams(ids):
        _, _, pairs, _, _, _ = items(ids)
        return pairs, np.ones(len(pairs), np.int64), np.zeros(len(pairs), bool)

    some = rows.where(F.pmod("doc", F.lit(max(1, n_rows // max(1, sample)))) == 0)
    seen = written(counted(some, bigrams).where(F.col("n") >= least), "frequent")
    return as_arrays(most_frequent(seen, frequent).select("item"))[0]


def placed(item: np.ndarray, own: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block of each item, its 48 bits within it, and its count, in the order of both; and that order.

    A block holds some million items, so of a thousand blocks one or two have items that share their bits.
    """
    h = mix64(item.view(np.uint64))
    block = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    bits = h >> np.uint64(16)
    order = np.lexsort((bits, block))
    return block[order], bits[order], own[order], order


def runs_in_order(order: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of the elements of runs of these lengths, when the runs are put in this order."""
    starts = np.cumsum(lengths) - lengths
    taken = lengths[order]
    return np.repeat(starts[order] - (np.cumsum(taken) - taken), taken) + np.arange(int(taken.sum()))


def others(rows: DataFrame, at_hand, blocks: int) -> DataFrame:
    """How often other rows have the items of a document that are not at hand: for each part of documents and block, arrays of the
    documents, how many items each has there, and n and n_good of those items in their order."""

    def deal(batches):
        """Arrays for each block of a portion of documents: 6 bytes of each item, its count, and of each document its items there."""
        known = at_hand.value[0]
        waiting, size = [], 0

        def flush():
            block, bits, own = (np.concatenate([x[i] for x in waiting]) for i in (2, 3, 4))
            row = np.repeat(np.arange(len(waiting)), [len(x[2]) for x in waiting])
            doc, good = np.array([x[0] for x in waiting], np.int64), np.array([x[1] for x in waiting], np.uint8)
            order = np.argsort(block, kind="stable")
            block, bits, own, row = block[order], bits[order], own[order].astype(np.uint32), row[order]
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
            waiting.clear()
            out = []
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(block)]):
                of, n = np.unique(row[lo:hi], return_counts=True)
                out.append((int(block[lo]), bits[lo:hi].view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), own[lo:hi].tobytes(), doc[of].tobytes(), good[of].tobytes(), n.astype(np.uint32).tobytes()))
            cols = list(zip(*out, strict=True)) if out else [[] for _ in range(6)]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["block", "bits", "own", "doc", "good", "n"])

        for b in (part for whole in batches for part in portions(whole)):
            for doc, t, good in zip(b.column(0).to_pylist(), texts(b, "text", True), b.column(2).to_pylist(), strict=True):
                words, n, pairs, times, _, _ = items(word_ids(t))
                item, own = np.concatenate([words, pairs]), np.concatenate([n, times])
                rare = ~found(known, item)[1]
                waiting.append((doc, good, *placed(item[rare], own[rare], blocks)[:3]))
                size += int(rare.sum())
                if size >= PORTION:
                    yield flush()
                    size = 0
        if waiting:
            yield flush()
        give_back()

    def meet(dealt: pa.Table) -> pa.Table:
        part = lambda c, kind: np.frombuffer(b"".join(dealt.column(c).to_pylist()), kind)
        six = part("bits", np.uint8).reshape(-1, 6)
        item = np.zeros((len(six), 8), np.uint8)
        item[:, :6] = six
        item = item.view(np.uint64).ravel()
        own, lengths, doc, good = part("own", np.uint32), part("n", np.uint32).astype(np.int64), part("doc", np.int64), part("good", np.uint8)
        own_good = own * np.repeat(good, lengths)
        order = np.argsort(item, kind="stable")
        at = np.empty(len(item), np.int64)
        first = np.concatenate([[True], item[order][1:] != item[order][:-1]])
        at[order] = np.cumsum(first) - 1
        del six, item, order
        rest, rest_good = ((np.bincount(at, c).astype(np.int64)[at] - c).astype(np.uint32) for c in (own, own_good))
        to = (doc.view(np.uint64) % np.uint64(blocks)).astype(np.int64)
        run = np.argsort(to, kind="stable")
        place = runs_in_order(run, lengths)
        rest, rest_good, doc, lengths, to = rest[place], rest_good[place], doc[run], lengths[run], to[run]
        ends = np.cumsum(lengths)
        starts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        out = []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(to)]):
            a, b = int(ends[lo] - lengths[lo]), int(ends[hi - 1])
            out.append((int(to[lo]), dealt.column("block")[0].as_py(), doc[lo:hi].tobytes(), lengths[lo:hi].astype(np.uint32).tobytes(), rest[a:b].tobytes(), rest_good[a:b].tobytes()))
        cols = list(zip(*out, strict=True))
        return pa.table({"part": pa.array(cols[0], pa.int32()), "block": pa.array(cols[1], pa.int32()), **{name: pa.array(c, pa.binary()) for name, c in zip(("doc", "size", "n", "n_good"), cols[2:], strict=True)}})

    dealt = rows.select("doc", "text", "good").mapInArrow(deal, "block int, bits binary, own binary, doc binary, good binary, n binary")
    return dealt.groupBy("block").applyInArrow(meet, "part int, block int, doc binary, size binary, n binary, n_good binary")


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", frequent: int = FREQUENT, sample: int = SAMPLE, least: int = LEAST, block: int = BLOCK, max_broadcast: int = MAX_BROADCAST_IDS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (means over tokens) and difference for every row of docs."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    docs = docs.withColumn("doc", F.xxhash64("doc_id", "text"))
    rows = marked(docs, labels, max_broadcast)
    size = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(ceil(size.bytes / block), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # no fewer than there are tasks

    common = sc.broadcast(frequent_bigrams(rows, size.rows, frequent, sample, least))  # at most `frequent` keys

    def words_and_common(ids):
        words, n, pairs, times, _, _ = items(ids)
        ok = found(common.value, pairs)[1]
        return np.concatenate([words, pairs[ok]]), np.concatenate([n, times[ok]]), np.arange(len(words) + int(ok.sum())) < len(words)

    counts = written(counted(rows, words_and_common), "counts")
    is_word = F.col("word") & (F.col("item") != START)
    total = counts.where(is_word).agg(F.count("*").alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_good"), F.lit(0)).alias("n_good")).first()
    everywhere = most_frequent(counts.where("word"), frequent).unionByName(counts.where("not word")).select("item", "n", "n_good")
    at_hand = sc.broadcast(as_arrays(everywhere))  # at most twice `frequent` rows
    discard(counts)  # what it was made of may leave the disks before texts are dealt out
    n_words, n_all, n_good = total.words + 1, total.n, total.n_good  # with the unknown word

    def once(batches):
        """Each row's text, but of equal rows in a task one."""
        seen: set[int] = set()
        for b in batches:
            keep = [not (d in seen or seen.add(d)) for d in b.column(0).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    def losses(whole: pa.Table, back: pa.Table) -> pa.Table:
        known, *known_n = at_hand.value
        part = lambda c, kind: np.frombuffer(b"".join(back.column(c).to_pylist()), kind)
        doc, lengths, came = part("doc", np.int64), part("size", np.uint32).astype(np.int64), [part("n", np.uint32), part("n_good", np.uint32)]
        block = np.repeat(np.array(back.column("block").to_pylist(), np.int64), [len(x) // 8 for x in back.column("doc").to_pylist()])
        run = np.lexsort((block, doc))
        again = np.concatenate([[False], (doc[run][1:] == doc[run][:-1]) & (block[run][1:] == block[run][:-1])]) if len(run) else np.zeros(0, bool)
        run = run[~again]  # equal rows ask and get the same
        place = runs_in_order(run, lengths)
        doc, ends, came = doc[run], np.concatenate([[0], np.cumsum(lengths[run])]), [c[place] for c in came]
        out, seen = [], set()
        for ident, t, good in zip(whole.column("doc").to_pylist(), whole.column("text").to_pylist(), whole.column("good").to_pylist(), strict=True):
            if ident in seen:
                continue
            seen.add(ident)
            words, n, pairs, times, before, after = items(word_ids((t or "").encode()))
            lo, hi = ends[np.searchsorted(doc, ident, "left")], ends[np.searchsorted(doc, ident, "right")]
            item, own = np.concatenate([words, pairs]), np.concatenate([n, times])
            at, ok = found(known, item)
            order = np.flatnonzero(~ok)[placed(item[~ok], own[~ok], blocks)[3]]
            tokens = int(times.sum())
            row = [ident, tokens]
            for counts_of, others_have, mine, total_n in ((known_n[1], came[1], good, n_good), (known_n[0], came[0], True, n_all)):
                c = np.zeros(len(item), np.int64)
                c[order] = others_have[lo:hi]
                c[ok] = counts_of[at[ok]] - (own[ok] if mine else 0)
                of_word, of_pair = c[: len(words)], c[len(words) :]
                p = MIX * of_pair / np.maximum(1, of_word[before]) + (1 - MIX) * (of_word[after] + 1) / (total_n - (tokens if mine else 0) + n_words)
                row.append(float(-(np.log(p) * times).sum() / max(1, tokens)))
            out.append(row)
        cols = list(zip(*out, strict=True)) if out else [[] for _ in range(4)]
        return pa.table({"doc": pa.array(cols[0], pa.int64()), "n_tokens": pa.array(cols[1], pa.int64()), "target": pa.array(cols[2], pa.float64()), "background": pa.array(cols[3], pa.float64())})

    def part_of(batches):
        for b in batches:
            part = pa.array((b.column(0).to_numpy().view(np.uint64) % np.uint64(blocks)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part, *b.columns], names=["part", *b.schema.names])

    whole = rows.select("doc", "text", "good").mapInArrow(lambda batches: part_of(once(batches)), "part int, doc bigint, text string, good boolean")
    back = others(rows, at_hand, blocks)
    scored = whole.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(losses, "doc bigint, n_tokens bigint, target double, background double")
    scored = scored.select("doc", "n_tokens", F.round("target", 9).alias("target_loss"), F.round("background", 9).alias("background_loss"))
    return docs.select("doc_id", "doc").join(scored, "doc", "left").select("doc_id", "n_tokens", "target_loss", "background_loss", F.round(F.col("target_loss") - F.col("background_loss"), 9).alias("difference"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

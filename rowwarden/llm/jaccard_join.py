"""Operator 9: n-gram Jaccard join by a token-group matrix.

The set of a document is its distinct word shingles; two documents link when the Jaccard similarity of their sets
reaches the threshold. The result names each document's component.

1. Documents of equal sets are one class, found by a 128-bit hash of the set; one of each class stands for it.
2. Tokens (shingles) are ordered from rare to frequent by a sketch of document frequencies counted over all documents,
   whose size goes with the corpus; any order gives the same result. A set's prefix is its rarest tokens, so many that two sets which link must share one (n - ceil(t n) + 1).
   Only prefix tokens that two documents have travel further. Frequent ones are dealt out by document as well.
3. Grouping: each document is compared with the one leader (smallest id) it shares most prefix tokens with. Those
   that link form groups, cut into blocks of at most about GROUP documents.
4. Token-group matrix: the union of prefix tokens of each block. A document meets a block of another component at a
   token behind which both have enough left to link. Then the number of its prefix tokens in the block's union, and
   what lies behind the prefixes, bound every overlap; blocks that can reach the threshold are opened, and the same
   bound is taken for each of their documents.
5. What is left is compared in full. Components of all links found are the result: pairs within a component never
   matter, so no group is expanded into its pairs, and no pair across components is left out.

Defined results: null or blank text has an empty set, which links with nothing; fewer words than a shingle are one
shingle; rows of one id are one document; rows with a null id have no component and link nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table, written
from .common import add_up, give_back, gram_hashes, partial_counts, plain_names, portions, texts, word_hashes
from .components import components

WORDS = 4
#: Similarity of at least SIMILAR / OF.
SIMILAR, OF = 85, 100
#: Counters of the frequency sketch: one for SKETCHED bytes of text, within limits.
SKETCH_LEAST, SKETCH_MOST, SKETCHED = 1 << 22, 1 << 25, 512
#: Rows of one token that a task may get; tokens of a higher frequency are dealt out by document too.
HOT = 50_000
GROUP = 64
#: Ids that are sent to every executor to pick their documents; more are joined by a shuffle.
MAX_BROADCAST_IDS = 2_000_000


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text. Only A-Z are lower-cased; ASCII white space splits."""
    h = word_hashes(text.lower().split())
    return np.unique(gram_hashes(h, min(words, len(h)))) if len(h) else h


def links(a: np.ndarray, b: np.ndarray, similar: int = SIMILAR, of: int = OF) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and of * both >= similar * (len(a) + len(b) - both)


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, similar: int = SIMILAR, of: int = OF, group: int = GROUP, hot: int = HOT, sketch: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    docs = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    known = docs.where("doc_id is not null")
    sketch = sketch or sketch_size(docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0)

    both = written(_signatures(docs, words, sketch), "signatures")
    signatures = both.where("block is null").select("doc_id", "n", "high", "low")
    frequency = add_up(both.where("block is not null").select("block", "counts"), sketch)

    # only sets of more than one document, as a table of their own: a join that can split a set of very many documents
    classes = written(signatures.where("n > 0 and doc_id is not null").groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.count("*").alias("found")).where("found > 1").drop("found"), "classes")
    copies = written(signatures.where("n > 0").join(classes, ["high", "low"]).where("doc_id <> first").select("doc_id", "first").distinct(), "copies")

    # rare tokens that at least two documents share
    raw = _prefixes(known, frequency, words, similar, of, hot)
    shared = raw.withColumn("found", F.count("*").over(Window.partitionBy("token", "part"))).where("found > 1 or part >= 0").select("token", "doc_id", "n", "place")
    as_first = shared.join(copies, "doc_id", "left").select("token", F.coalesce("first", "doc_id").alias("doc"), "n", "place")
    rare = written(as_first.groupBy("token", "doc", "n").agg(F.min("place").alias("place")), "prefixes")

    def linked(pairs: DataFrame) -> DataFrame:
        return _verified(known, pairs, words, similar, of)

    # grouping around leaders
    leader = rare.groupBy("token").agg(F.min("doc").alias("leader"), F.count("*").alias("found")).where("found > 1")
    tried = rare.join(leader, "token").where("doc <> leader").groupBy("doc", "n", "leader").agg(F.count("*").alias("common"))
    best = tried.groupBy("doc").agg(F.max(F.struct("common", (-F.col("leader")).alias("minus"), "n")).alias("best"))
    likely = best.where(F.col("best.common") * 4 >= _prefix(F.col("best.n"), similar, of)).select(F.col("doc").alias("a"), (-F.col("best.minus")).alias("b"))
    near = written(linked(likely), "links")
    grouped = written(components(near), "groups")

    # the matrix: prefix tokens of blocks
    sizes = grouped.groupBy("component").agg(F.count("*").alias("members"))
    block_of = grouped.join(sizes, "component").select(F.col("node").alias("doc"), "component", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / group)).alias("block"))
    placed = rare.join(block_of, "doc", "left").select("token", "doc", "n", "place", F.coalesce("component", "doc").alias("component"), F.coalesce("block", F.lit(0)).alias("block"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("token")
    open_rows = written(placed.join(mixed, "token"), "matrix")
    # (the sizes are those of members with the token, which every member that can link through it is among)
    block_key = ["component", "block"]
    unions = written(open_rows.groupBy("token", *block_key).agg(F.min("n").alias("n_low"), F.max("n").alias("n_high"), F.min("place").alias("place_low")), "unions")
    q, g = open_rows.alias("q"), unions.alias("g")
    # the first token that two sets share leaves them no more than what follows it in either
    rest = F.least(F.col("q.n") - F.col("q.place"), F.col("n_high") - F.col("place_low"))
    possible = rest * (similar + of) >= (F.col("q.n") + F.col("n_low")) * similar
    met = q.join(g, (F.col("q.token") == F.col("g.token")) & (F.col("q.component") < F.col("g.component")) & possible).select("q.doc", "g.component", "g.block").distinct()
    met = written(met, "met")
    asked = open_rows.select("token", "doc", "n").join(met, "doc")
    bound = asked.join(unions, ["token", *block_key]).groupBy("doc", "n", *block_key).agg(F.count("*").alias("common"), F.min("n_low").alias("n_low"), F.max("n_high").alias("n_high"))
    opened = bound.where(_reaches(F.col("common"), F.col("n"), F.col("n_low"), similar, of, F.col("n_high"))).select("doc", *block_key)
    # documents of opened blocks
    members = open_rows.select("token", F.col("doc").alias("b"), F.col("n").alias("n_b"), *block_key)
    single = open_rows.select("token", "doc", F.col("n").alias("n_a")).join(opened, "doc").withColumnRenamed("doc", "a")
    pairs = single.join(members, ["token", *block_key]).groupBy("a", "n_a", "b", "n_b").agg(F.count("*").alias("common"))
    across = written(linked(pairs.where(_reaches(F.col("common"), F.col("n_a"), F.col("n_b"), similar, of)).select("a", "b")), "links")

    found = components(grouped.select(F.col("node").alias("a"), F.col("component").alias("b")).union(across).union(copies))
    return signatures.join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options: int) -> DataFrame:
    """One document of each component, that of the smallest id; of rows of one id the first by text. Rows with a null id stay."""
    found = written(jaccard_components(docs, text, doc_id, **options), "components")
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    few = gone.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    ident = F.col(f"`{doc_id}`").cast("bigint")
    left = docs.join(F.broadcast(gone) if few else gone, ident == F.col("gone_id"), "left_anti")
    again = found.where("component_id = doc_id").groupBy(F.col("doc_id").alias("again_id")).agg(F.count("*").alias("rows")).where("rows > 1").select("again_id")
    if again.isEmpty():
        return left
    rows, name, restored = plain_names(left)
    ident = F.col(name[doc_id]).cast("bigint")
    first = F.row_number().over(Window.partitionBy(name[doc_id]).orderBy(name[text], *[c for n, c in name.items() if n not in (doc_id, text)]))
    one = rows.join(again, ident == F.col("again_id"), "left_semi").withColumn("nth", first).where("nth = 1").drop("nth")
    return rows.join(again, ident == F.col("again_id"), "left_anti").union(one).select(restored)


def sketch_size(text_bytes: int) -> int:
    """Counters for that much text: a power of two."""
    return min(SKETCH_MOST, max(SKETCH_LEAST, 1 << (text_bytes // SKETCHED).bit_length()))


def own_frequency(counters: np.ndarray) -> np.ndarray:
    """How frequent a counter's one frequent token is: what is above the mean of the counters, as that is due to the others that share it."""
    return np.maximum(1, counters - int(counters.mean() if len(counters) else 0))


def _prefix(n: Column, similar: int, of: int) -> Column:
    return n - F.ceil(n * similar / of) + 1


def _reaches(common: Column, n_a: Column, n_b: Column, similar: int, of: int, n_b_most: Column | None = None) -> Column:
    """Whether sets of sizes n_a and n_b (up to n_b_most) with so many common prefix tokens may link.

    Of the set whose prefix ends first, every common token is a common prefix token or lies behind that prefix.
    """
    most = n_b if n_b_most is None else n_b_most
    behind = F.greatest(n_a - _prefix(n_a, similar, of), most - _prefix(most, similar, of))
    overlap = F.least(common + behind, n_a, most)
    return overlap * (similar + of) >= (n_a + n_b) * similar


def _signatures(docs: DataFrame, words: int, sketch: int) -> DataFrame:
    """A row of size and hash of the set for each document, and rows of partial token frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        names = ["doc_id", "n", "high", "low", "block", "counts"]
        counts = np.zeros(sketch, np.int32)  # of one task's documents
        for b in (part for whole in batches for part in portions(whole)):
            size, high, low = [], [], []
            for t in texts(b, "text", True):
                s = shingles(t, words)
                h = xxh3_128_intdigest(s.tobytes())
                size.append(len(s))
                high.append((h >> 64) - (1 << 63))
                low.append((h & ((1 << 64) - 1)) - (1 << 63))
                counts[(s & np.uint64(sketch - 1)).astype(np.int64)] += 1  # a set: no index twice, but for collisions
            none = pa.nulls(b.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), none, pa.nulls(b.num_rows, pa.binary())], names=names)
        for block, packed in partial_counts(counts):
            long = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([long, long, long, long, pa.array([block], pa.int32()), pa.array([packed], pa.binary())], names=names)
        del counts
        give_back()

    return docs.mapInArrow(run, "doc_id bigint, n bigint, high bigint, low bigint, block int, counts binary")


def _prefixes(docs: DataFrame, frequency: np.ndarray, words: int, similar: int, of: int, hot: int) -> DataFrame:
    """token, part, doc_id, n and the token's place: the prefix of each set; of equal sets in a task, the first. part is -1 for tokens that are not hot."""
    # the order is that of the counters; the mean of them, which any token has, makes none hot
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(own_frequency(frequency), (1 << 31) - 1).astype(np.int32))
    size = len(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        seen: set[bytes] = set()
        for b in (piece for whole in batches for piece in portions(whole)):
            token, part, doc, count, place = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), texts(b, "text", True), strict=True):
                s = shingles(t, words)
                key = xxh3_128_digest(s.tobytes())
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                often = shared.value[(s & np.uint64(size - 1)).astype(np.int64)]
                p = len(s) - -(-similar * len(s) // of) + 1
                first = np.lexsort((s, often))[:p]
                token.append(s[first])
                # hot tokens are spread over so many parts that none holds more than about `hot` documents
                parts = -(-often[first] // hot)
                part.append(np.where(parts > 1, (hash(i) * 0x9E3779B97F4A7C15 >> 32 & 0x7FFFFFFF) % np.maximum(parts, 1), -1))
                doc.append(np.full(len(first), i))
                count.append(np.full(len(first), len(s)))
                place.append(np.arange(len(first)))
            if token:
                cat = lambda v, kind: pa.array(np.concatenate(v).astype(kind))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), cat(part, np.int32), cat(doc, np.int64), cat(count, np.int32), cat(place, np.int32)], names=["token", "part", "doc_id", "n", "place"])
                del token, part, doc, count, place
        seen.clear()
        give_back()

    return docs.mapInArrow(run, "token bigint, part int, doc_id bigint, n int, place int")


def _verified(docs: DataFrame, pairs: DataFrame, words: int, similar: int, of: int) -> DataFrame:
    """The pairs (a, b) whose sets link, by their sets in full."""
    pairs = written(pairs.distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    chosen = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def as_set(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, words).tobytes() for t in texts(b, "text", True)], pa.binary())], names=["id", "tokens"])
        give_back()

    sets = chosen.mapInArrow(as_set, "id bigint, tokens binary")

    def check(batches):
        for b in batches:
            ok = [links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similar, of) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])
        give_back()

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("tokens_a")), "a")
    rows = left.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tokens_b")), "b").select("a", "b", "tokens_a", "tokens_b")
    return rows.mapInArrow(check, "a bigint, b bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))



ORACLE_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= {WORDS} THEN list_transform(range(1, len(words) - {WORDS - 2}), lambda i: array_to_string(words[i:i + {WORDS - 1}], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE {OF} * common >= {SIMILAR} * (a.n + b.n - common)),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM reached r JOIN e ON r.other = e.x),
c AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

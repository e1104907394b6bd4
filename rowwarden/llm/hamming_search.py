"""Operator 4: exact top-k search of binary codes by incremental multi-index hashing.

A vector's code has a bit for each of its (up to 64) dimensions: whether it is positive. Codes are cut into segments of
even width, about log2 of their number bits; the index is a table of the segments of all codes. In round r the segments
of the queries that are not finished are looked up, by a join on segment and value, at all values r bits from their own,
and the full distance of what is found is verified. A pair is found in several segments and rounds but only taken in the
first, which its two codes tell, so nothing is compared again. After round r every code within s * (r + 1) - 1 is found
(s segments: by the pigeonhole principle one of them is within r), so a query is finished once its k-th verified distance
is not beyond that.

Equal codes are one entry with its k + 1 smallest ids, so that a code of very many vectors is no larger than others. A
query keeps the k + 1 nearest entries found so far, and what is farther than the last of them is dropped where it is
found. Indexes of at most MAX_BROADCAST entries are sent to the executors, others are joined by a shuffle.

Defined results: neighbours go by distance, then id; a vector is not its own neighbour (others of its code are); null
vectors have no code, are no neighbours and get no rows; null and NaN elements count as not positive; rows of one id
are one vector for each code they have.
"""

from __future__ import annotations

from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table, written

K = 10
BITS = 64
#: Widest segment: a round looks up no more values than a segment has.
WIDEST = 22
#: Codes whose segments are sent to every executor.
MAX_BROADCAST = 1 << 18
EVERY = 20


def code_of(vector: Column) -> Column:
    """The sign bits of a vector of up to 64 numbers, as a bigint."""
    bit = lambda x, i: F.when(F.coalesce(~F.isnan(x) & (x > 0), F.lit(False)), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))
    whole = F.aggregate(F.transform(vector, bit), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(vector) > BITS, F.raise_error(F.lit(f"codes have at most {BITS} bits"))).otherwise(whole)


def segments(n_codes: int) -> list[tuple[int, int]]:
    """First bit and width of each segment: as even as can be, none narrower than log2 of the number of codes asks for."""
    width = min(WIDEST - 1, max(4, round(log2(max(2, n_codes)))))
    s = BITS // width
    widths = [BITS // s + (j < BITS % s) for j in range(s)]
    return [(sum(widths[:j]), w) for j, w in enumerate(widths)]


def value(code: Column, lo: int, width: int) -> Column:
    return F.shiftrightunsigned(code, lo).bitwiseAND(F.lit((1 << width) - 1))


def keyed(codes: DataFrame, code: str, cuts: list[tuple[int, int]]) -> DataFrame:
    """A row for each segment of each code: its number, its width and its key, which holds number and value."""
    parts = [F.struct(F.lit(j).alias("segment"), F.lit(w).alias("width"), (value(F.col(code), lo, w) + F.lit(j << 32)).alias("key")) for j, (lo, w) in enumerate(cuts)]
    return codes.withColumn("part", F.explode(F.array(*parts))).select("*", "part.*").drop("part")


def candidates(asked: DataFrame, index: DataFrame, cuts: list[tuple[int, int]], radius: int, broadcast: bool = False) -> DataFrame:
    """Each row of asked (query, bound) with each code that is first found at this radius, and the full distance of both."""
    masks = None
    for width in sorted({w for _, w in cuts}):  # at most 2^22 numbers, by their width
        of = asked.sparkSession.range(1 << width).where(F.bit_count("id") == radius).select(F.col("id").alias("mask"), F.lit(width).alias("width"))
        masks = of if masks is None else masks.union(of)
    probes = keyed(asked, "query", cuts).join(F.broadcast(masks), "width").select("query", "bound", "segment", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))
    differs = F.col("query").bitwiseXOR(F.col("code"))
    distance = F.bit_count(differs)
    # by distance of the segment, then number: where a pair is first found
    first = F.least(*[F.bit_count(value(differs, lo, w)) * len(cuts) + j for j, (lo, w) in enumerate(cuts)]) if len(cuts) > 1 else F.bit_count(differs)
    found = probes.join(F.broadcast(index) if broadcast else index, "key").where(first == F.lit(radius * len(cuts)) + F.col("segment"))
    return found.select("query", "bound", "code", "first_id", "n_ids", distance.cast("bigint").alias("distance"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """query_id, rank (from 1), neighbor_id and distance: the k nearest of `vectors` for each row of `queries`."""
    coded = lambda df: df.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), code_of(F.col(f"`{vector}`")).alias("code")).where("id is not null and code is not null").distinct()
    # the window's limit is applied in each task before rows of a code meet
    rank = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    members = coded(vectors).withColumn("rank", rank).where(F.col("rank") <= k + 1)
    entries = written(members.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    asked = written(coded(queries), "queries")
    n = entries.count()
    cuts, broadcast = segments(n), n <= max_broadcast
    index = keyed(entries.select("code", F.col("ids")[0].alias("first_id"), F.size("ids").alias("n_ids")), "code", cuts).drop("segment", "width")
    if not broadcast:
        index = written(index.repartition("key"), "index")

    # a row without a code stands for the query itself, behind all it has found
    itself = [F.lit(None).cast("bigint").alias("code"), F.lit(None).cast("bigint").alias("first_id"), F.lit(0).alias("n_ids"), F.lit(BITS + 1).cast("bigint").alias("distance")]
    best = asked.select(F.col("code").alias("query")).distinct().select("query", *itself)
    states = []
    by_query = Window.partitionBy("query")
    for radius in range(max(w for _, w in cuts) + 1):
        # how far the last entry is that can matter: what is farther is dropped where it is found
        open_ones = best.groupBy("query").agg(F.when(F.count("code") > k, F.max(F.when(F.col("code").isNotNull(), F.col("distance")))).otherwise(F.lit(BITS)).alias("bound"))
        found = candidates(open_ones, index, cuts, radius, broadcast).where("distance <= bound").drop("bound")
        place = F.row_number().over(by_query.orderBy("distance", "first_id"))
        kept = found.withColumn("place", place).where(F.col("place") <= k + 1).drop("place").unionByName(best)
        kept = kept.withColumn("place", place).where((F.col("place") <= k + 1) | F.col("code").isNull()).drop("place")
        covered = len(cuts) * (radius + 1) - 1
        near = F.sum(F.when(F.col("distance") <= covered, F.col("n_ids")).otherwise(0)).over(by_query)
        states.append(written(kept.withColumn("done", near >= k + 1), "nearest"))
        best = states[-1].where("not done").drop("done")
        if best.isEmpty():
            break
    # those never finished have fewer than k + 1 ids to find
    every = reduce(DataFrame.unionByName, [x.where("done").drop("done") for x in states], best).where("code is not null")
    ids = every.join(entries, "code").select(F.col("query").alias("code"), F.explode("ids").alias("neighbor_id"), "distance")
    found = asked.join(ids, "code").where("id <> neighbor_id")
    order = Window.partitionBy("id", "code").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", "neighbor_id", "distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE_SQL = f"""
WITH bits AS (
  SELECT vec_id AS id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
coded AS (
  SELECT id, sum(CASE WHEN coalesce(x > 0 AND NOT isnan(x), false) THEN 1::HUGEINT << i ELSE 0 END)::UBIGINT AS code FROM bits GROUP BY id),
pairs AS (
  SELECT q.id AS query_id, v.id AS neighbor_id, bit_count(xor(q.code, v.code)::BIT)::BIGINT AS distance
  FROM coded q JOIN coded v ON q.id <> v.id WHERE q.id % {EVERY} = 0)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank, neighbor_id, distance FROM pairs) WHERE rank <= {K}
"""

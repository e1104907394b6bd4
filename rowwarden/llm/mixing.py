"""Operator 1: mixing sources to target weights by Poisson replication.

A source whose texts should be seen r times on average (its target weight of the whole, over its size) gives each of its
documents a Poisson count of mean r: the inverse of the distribution at a number in (0, 1) that is hashed from the seed
and the id. Each document is repeated that often, and all copies are shuffled by a hash of seed, id and copy number:
they are dealt to partitions by it and sorted by it within each.

Target weights are given by source, or by default each source weighs its size to the power TEMPERATURE. Sizes are
counted over all documents, in code points.

Defined results: a null source is a source of its own (weight key None); null text has size 0; a source of size 0 or
weight 0 gives no copies; weights of absent sources are left out and the rest scaled to 1; rows of one id draw one count;
rows with a null id draw by their text;
input columns named n_copies, copy_no or shuffle_key are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .common import plain_names, without

TEMPERATURE = 0.7
SEED = 1
#: Partitions that copies of one key may go to.
SPREAD = 64
#: Sources whose rates are sent to every executor; the rates of more sources are joined by a shuffle.
MAX_BROADCAST_SOURCES = 10_000


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, text: str = "text", source: str = "source") -> DataFrame:
    """source, size and rate (the mean number of copies of its documents)."""
    sizes = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.coalesce(F.sum(F.char_length(F.col(f"`{text}`"))), F.lit(0)).alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(TEMPERATURE)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        weighed = sizes.alias("a").join(given.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    weighed = weighed.where("size > 0")
    whole = weighed.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))  # one row
    rate = F.lit(epochs) * F.col("all_size") * F.try_divide(F.col("weight"), F.col("all_weight")) / F.col("size")
    return weighed.crossJoin(F.broadcast(whole)).select("source", "size", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def distribution(rate):
    """The cumulative Poisson distribution of mean `rate` from 0 up to where nothing is left in double precision."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(acc, k):
        log_p = acc["log_p"] + F.log(rate) - F.log(k.cast("double"))
        total = acc["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["all"])


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, seed: int = SEED, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The copies, globally shuffled, with n_copies, copy_no (from 1) and shuffle_key."""
    by_source = rates(docs, weights, epochs, text, source).where("rate > 0").select(F.col("source").alias("mix_source"), distribution(F.col("rate")).alias("mix_cdf"))
    if by_source.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        by_source = F.broadcast(by_source)
    ident = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))))
    # 52 bits of a hash that other engines have too
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), ident)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    own = without(docs, ["n_copies", "copy_no", "shuffle_key", "mix_source", "mix_cdf"])
    counted = own.join(by_source, F.col(f"`{source}`").eqNullSafe(F.col("mix_source"))).withColumn("n_copies", F.size(F.filter("mix_cdf", lambda c: c <= u)).cast("bigint")).drop("mix_source", "mix_cdf")
    copies = counted.where("n_copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_copies"))))
    keyed = copies.withColumn("shuffle_key", F.substring(F.md5(F.concat(F.lit(f"{seed}:"), ident, F.lit(":"), F.col("copy_no").cast("string"))), 1, 16))
    # equal rows have equal keys: where there are very many of them, the row's place in its input deals them out
    return keyed.repartition("shuffle_key", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))).sortWithinPartitions("shuffle_key")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The copies with the columns of docs only."""
    rows, name, restored = plain_names(docs)
    return mix(rows, text=name["text"], source=name["source"], doc_id=name["doc_id"], **options).select(restored)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH sizes AS (SELECT source, coalesce(sum(length(text)), 0)::BIGINT AS size FROM documents GROUP BY source),
weighed AS (SELECT *, pow(size::DOUBLE, {TEMPERATURE}) AS weight FROM sizes WHERE size > 0),
rated AS (SELECT source, (SELECT sum(size) FROM weighed) * (weight / (SELECT sum(weight) FROM weighed)) / size AS rate FROM weighed),
terms AS (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM rated, range(0, 4000) t(k) WHERE rate > 0 AND k <= ceil(rate + 12 * sqrt(rate) + 30)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
drawn AS (SELECT *, (CAST('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))), 1, 13) AS BIGINT)::DOUBLE + 0.5) / {float(1 << 52)!r} AS u FROM documents),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u) AS n_copies FROM drawn d)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy_no, substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, ''))) || ':' || copy_no), 1, 16) AS shuffle_key
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy_no FROM counted)
"""

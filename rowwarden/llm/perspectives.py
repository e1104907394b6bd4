"""Operator 7: chat formatting by multi-party perspective rotation.

For every participant of a dialogue the dialogue is rendered once with that speaker as the assistant and the others as
named users; the mask holds the spans of the text that are the speaker's own words, which a model is to learn.
A turn is `<|im_start|>assistant\\n...<|im_end|>\\n`, or `<|im_start|>user name=NAME\\n...`, or `<|im_start|>system\\n...`.

A row is one whole dialogue from one perspective. It is put together from blocks of BLOCK_TURNS turn numbers, which are
gathered and rendered apart, so only the last step of a very long dialogue needs all of it, as one value of the result.
Where a dialogue may be longer than a value can be (2 GB), rendered_blocks() gives the blocks themselves.

Defined results: turns go by number, then speaker, then text, null first; repeated rows are rendered each; a null role
is the named user "unknown" and no participant; "system" is no participant; null text is empty; a row with a null
conv_id is a dialogue of its own; dialogues without participants give no rows; offsets count code points; other columns
are left out. `<|` and `|>` in texts and names get a blank inside, and control characters in names become blanks, so that
nothing said can pass for a mark or a turn; speakers are told apart by their names as they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

BLOCK_TURNS = 256
SYSTEM = "system"


def harmless(text: Column) -> Column:
    """A text without chat marks."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def rendered_blocks(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, speaker, block, n_turns, rendered and spans (start and end of each trained stretch, from the block's start)."""
    said = F.struct(F.col("turn").cast("bigint").alias("turn"), F.col("role").alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said")
    block = F.floor(F.coalesce(F.col("turn").cast("bigint"), F.lit(-1)) / block_turns).cast("bigint").alias("block")
    participant = F.col("role").isNotNull() & (F.col("role") != SYSTEM)
    known = turns.where("conv_id is not null")
    blocks = known.select("conv_id", block, said).groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("said"), _order).alias("said"))
    speakers = known.where(participant).select("conv_id", F.col("role").alias("speaker")).distinct()
    alone = turns.where(F.col("conv_id").isNull() & participant).select("conv_id", block, F.array(said).alias("said"), F.col("role").alias("speaker"))
    seen = blocks.join(speakers, "conv_id").unionByName(alone)

    mine = lambda x: x["role"].eqNullSafe(F.col("speaker"))
    name = lambda x: harmless(F.regexp_replace(F.coalesce(x["role"], F.lit("unknown")), r"\p{Cc}", " "))
    head = lambda x: F.when(mine(x), "<|im_start|>assistant\n").when(x["role"].eqNullSafe(F.lit(SYSTEM)), "<|im_start|>system\n").otherwise(F.concat(F.lit("<|im_start|>user name="), name(x), F.lit("\n")))
    messages = seen.withColumn("messages", F.transform("said", lambda x: F.struct(mine(x).alias("own"), head(x).alias("head"), F.concat(harmless(x["text"]), F.lit("<|im_end|>\n")).alias("body"))))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, m):
        begin = acc["at"] + F.char_length(m["head"])
        end = begin + F.char_length(m["body"])
        own = F.array(F.struct(begin.alias("start"), (end - 1).alias("end")))  # to the end mark, without the line break
        return F.struct(end.alias("at"), F.when(m["own"], F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return messages.select("conv_id", "speaker", "block", F.size("said").cast("bigint").alias("n_turns"), F.array_join(F.transform("messages", lambda m: F.concat(m["head"], m["body"])), "").alias("rendered"), F.aggregate("messages", start, step, lambda acc: acc["spans"]).alias("spans"))


def rotate(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, speaker, n_turns, rendered and spans: a whole dialogue a row."""
    blocks = rendered_blocks(turns, block_turns)
    part = F.struct("block", "rendered", F.char_length("rendered").cast("bigint").alias("size"), "spans")
    known = blocks.where("conv_id is not null").groupBy("conv_id", "speaker").agg(F.sum("n_turns").alias("n_turns"), F.array_sort(F.collect_list(part)).alias("parts"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, p):
        moved = F.transform(p["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + p["size"]).alias("at"), F.concat(acc["spans"], moved).alias("spans"))

    whole = known.select("conv_id", "speaker", "n_turns", F.array_join(F.transform("parts", lambda p: p["rendered"]), "").alias("rendered"), F.aggregate("parts", start, step, lambda acc: acc["spans"]).alias("spans"))
    return whole.unionByName(blocks.where("conv_id is null").drop("block"))


def _order(a, b):
    """Turn, role, text; null first."""
    out = F.lit(0)
    for c in ("text", "role", "turn"):
        x, y = a[c], b[c]
        out = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(out)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rotate(table(spark, sf_dir, "conversations")).withColumn("spans", spans)


ORACLE_SQL = """
WITH turns AS (SELECT CASE WHEN conv_id IS NULL THEN -row_number() OVER () ELSE 0 END AS alone, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
speakers AS (SELECT DISTINCT alone, conv_id, role AS speaker FROM turns WHERE role IS NOT NULL AND role <> 'system'),
messages AS (
  SELECT t.alone, t.conv_id, s.speaker, t.turn, t.role, t.text, t.role IS NOT DISTINCT FROM s.speaker AS own,
    CASE WHEN t.role IS NOT DISTINCT FROM s.speaker THEN '<|im_start|>assistant' || chr(10) WHEN t.role = 'system' THEN '<|im_start|>system' || chr(10)
      ELSE '<|im_start|>user name=' || replace(replace(regexp_replace(coalesce(t.role, 'unknown'), '\\p{Cc}', ' ', 'g'), '<|', '< |'), '|>', '| >') || chr(10) END AS head,
    replace(replace(t.text, '<|', '< |'), '|>', '| >') || '<|im_end|>' || chr(10) AS body
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.alone = s.alone),
placed AS (
  SELECT *, row_number() OVER w AS pos,
    coalesce(sum(length(head || body)) OVER (PARTITION BY alone, conv_id, speaker ORDER BY turn NULLS FIRST, role NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS began
  FROM messages WINDOW w AS (PARTITION BY alone, conv_id, speaker ORDER BY turn NULLS FIRST, role NULLS FIRST, text))
SELECT conv_id, speaker, count(*) AS n_turns, string_agg(head || body, '' ORDER BY pos) AS rendered,
  coalesce(string_agg(began::BIGINT || '-' || (began + length(body) - 1)::BIGINT, ',' ORDER BY pos) FILTER (WHERE own), '') AS spans
FROM placed GROUP BY alone, conv_id, speaker
"""

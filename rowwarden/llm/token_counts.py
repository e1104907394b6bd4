"""Operator 5: token counts by heap-and-linked-list byte-pair merging.

A pretoken starts as one symbol per UTF-8 byte. The adjacent pair of lowest rank (leftmost of equal ones) merges
until no pair has a rank; the count is the symbols at the start minus the merges. Identifiers are never made.

Defined results: null text is the empty text (0 bytes, 0 tokens); repeated rows get a row each; special strings
of the tokenizer file inside a text count as one token; texts are never truncated; input columns named n_bytes,
n_tokens or over_limit are replaced.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import table
from .common import with_text_columns

#: The published pattern that splits a text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pretokens whose counts a task remembers; beyond that it starts anew.
REMEMBERED = 1 << 18
LIMIT = 512


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the tokenizer file: itself if printable, else the next from U+0100."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """Counts tokens of whole texts from the ranks of merges."""

    def __init__(self, ranks: dict[tuple[str, str], int], specials: list[str]):
        import regex

        self.ranks, self.symbols = ranks, byte_symbols()
        self.find = regex.compile(PATTERN).findall
        self.specials = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        outer = self

        class Seen(dict):
            def __missing__(self, pretoken):
                if len(self) >= REMEMBERED:
                    self.clear()
                self[pretoken] = n = outer.merged(pretoken)
                return n

        self.seen = Seen()

    @classmethod
    def from_json(cls, text: str) -> MergeCounter:
        spec = json.loads(text)
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
        return cls({p: i for i, p in enumerate(pairs)}, [t["content"] for t in spec["added_tokens"]])

    def merged(self, pretoken: str) -> int:
        """Symbols left of one pretoken."""
        sym: list[str | None] = [self.symbols[b] for b in pretoken.encode()]
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.ranks.get
        heap = [(r, i) for i in range(n - 1) if (r := rank((sym[i], sym[i + 1]))) is not None]
        heapify(heap)
        left = n
        while heap:
            r, i = heappop(heap)
            a = sym[i]
            j = after[i]
            if a is None or j >= n or rank((a, sym[j])) != r:
                continue  # one of the two has merged meanwhile
            sym[i], sym[j] = a + sym[j], None
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (s := rank((sym[i], sym[k]))) is not None:
                    heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := rank((sym[h], sym[i]))) is not None:
                heappush(heap, (s, h))
        return left

    def count(self, text: str) -> int:
        if self.specials is None or self.specials.search(text) is None:
            return sum(map(self.seen.__getitem__, self.find(text)))
        parts = self.specials.split(text)
        return len(parts) - 1 + sum(sum(map(self.seen.__getitem__, self.find(p))) for p in parts)


def count_tokens(docs: DataFrame, tokenizer_json: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit of the whole of column `text`. tokenizer_json: path, read once on the driver."""
    with open(tokenizer_json, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size is fixed

    def make():
        counter = MergeCounter.from_json(spec.value)

        def work(batch):
            n = [counter.count(x) for x in batch]
            return [len(x.encode()) for x in batch], n, [v > limit for v in n]

        return work

    added = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return with_text_columns(docs, text, added, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")

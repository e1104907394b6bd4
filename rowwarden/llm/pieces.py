"""Operator 3: SentencePiece encoding and decoding.

Unigram Viterbi over a double-array trie of pieces with log scores: of all ways to cut the text into pieces, the one of
the largest sum of scores. A character that no piece covers scores 10 less than the lowest piece and becomes the pieces
of its UTF-8 bytes. White-space marker: blanks become U+2581, and one is put before the text; decoding takes it back.
The scores are those of the model file, whatever it was trained for.

Where every piece has its markers at its start, the best cut of a text is made of the best cuts of its words with
their markers, so words are cut once per task (bounded memory). Of equal sums the longest last piece wins.

Defined results: null text is the empty text, which has no pieces; texts that hold U+2581 decode with blanks in its
place (round_trip is false); repeated rows get a row each; texts are never truncated; input columns of the added
names are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import table
from .common import with_text_columns

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Kinds of pieces in a model file.
NORMAL, BYTE = 1, 6
_LOW = float("-inf")
REMEMBERED = 1 << 18
#: Words of up to that many bytes are cut together; longer ones each alone.
TOGETHER = 48
#: Characters of text whose words are held at once.
PORTION = 2 << 20
#: Places that a search for room in the double array may try before later searches start behind them.
CROWDED = 32


@dataclass(frozen=True)
class Model:
    """Pieces by id, and the double-array trie: from node s by byte c one goes to t = base[s] + c + 1 if check[t] == s."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    def parts(self) -> tuple:
        """What a broadcast holds: plain values, so that executors need no copy of this package."""
        return self.pieces, self.scores, self.kinds, self.base, self.check, self.value


def load(path: str) -> Model:
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return build([p.piece for p in proto.pieces], [p.score for p in proto.pieces], [p.type for p in proto.pieces])


def build(pieces: list[str], scores: list[float], kinds: list[int]) -> Model:
    return Model(pieces, scores, kinds, *double_array({p.encode(): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == NORMAL}))


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value (-1: no key ends here) of a trie over the bytes of keys; node 0 is the root."""
    words = sorted(keys)
    base, check, value = [0] * 512, [-1] * 512, [-1] * 512
    check[0] = 0
    free = crowded = 257  # so that no base is negative
    todo = [(0, 0, len(words), 0)]  # node, its words, their common length
    for node, lo, hi, depth in todo:
        if lo < hi and len(words[lo]) == depth:
            value[node] = keys[words[lo]]
            lo += 1
        heads: list[tuple[int, int]] = []  # bytes that follow, and where their words start
        for i in range(lo, hi):
            if not heads or words[i][depth] != heads[-1][0]:
                heads.append((words[i][depth], i))
        if not heads:
            continue
        while free < len(check) and check[free] != -1:
            free += 1
        # nodes with one child fill the first hole; for others the search starts further on once the front is crowded
        first = b = (free if len(heads) == 1 else max(free, crowded)) - heads[0][0] - 1
        while True:
            if b + 257 >= len(check):
                more = len(check)
                base += [0] * more
                check += [-1] * more
                value += [-1] * more
            if all(check[b + c + 1] == -1 for c, _ in heads):
                break
            b += 1
        if b - first > CROWDED:
            crowded = b + heads[0][0] + 1
        base[node] = b
        for (c, start), end in zip(heads, [s for _, s in heads[1:]] + [hi], strict=True):
            check[b + c + 1] = node
            todo.append((b + c + 1, start, end, depth + 1))
    return np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32)


class Codec:
    """Encodes and decodes whole texts with a Model."""

    def __init__(self, model: Model):
        self.pieces, self.scores = model.pieces, model.scores
        # one slot further on, so that a byte is added without the 1; room at the end, so that no step leaves the arrays
        room = [-1] * 257
        self.base, self.check = (model.base + 1).tolist(), model.check.tolist() + room
        self.gain = [model.scores[v] if v >= 0 else None for v in model.value.tolist()]
        self.value = model.value.tolist()
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.is_byte = np.isin(np.arange(len(model.pieces)), list(self.byte_of))
        normal = [i for i, k in enumerate(model.kinds) if k == NORMAL]
        self.unknown = min((self.scores[i] for i in normal), default=0.0) - UNKNOWN_PENALTY
        self.unk_id = next((i for i, k in enumerate(model.kinds) if k == 2), 0)
        by_word = all(MARK not in model.pieces[i].lstrip(MARK) for i in normal)
        self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$").findall if by_word else lambda t: [t]
        self.value_of = model.value
        self.chars = {model.pieces[i] for i in normal if len(model.pieces[i]) == 1}
        self.arrays = (np.array(self.base), np.array(self.check), np.array([_LOW if g is None else g for g in self.gain]))
        self.longest = max((len(model.pieces[i].encode()) for i in normal), default=1)
        self.seen: dict[str, bytes] = {}
        self.score_of = np.array(model.scores)
        #: Byte pieces that begin a character.
        self.is_lead = np.isin(np.arange(len(model.pieces)), [i for i, b in self.byte_of.items() if b & 0xC0 != 0x80])

    def cut(self, words: list[str]) -> list[bytes]:
        """The ids of each word's best cut, as the bytes of 32-bit numbers. Short words of known characters are walked through the trie together."""
        raw = list(map(str.encode, words))
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        fit = (size <= TOGETHER) & (size > 0) & np.fromiter(map(self.chars.issuperset, words), bool, len(words))
        out: list = [None] * len(words)
        for k in np.flatnonzero(~fit).tolist():
            out[k] = np.array(self.viterbi(words[k])[0], np.int32).tobytes()
        together = np.flatnonzero(fit)
        together = together[np.argsort(size[together], kind="stable")].tolist()
        for lo in range(0, len(together), 4096):
            part = together[lo : lo + 4096]
            for k, found in zip(part, self._cut_together([raw[k] for k in part]), strict=True):
                out[k] = found
        return out

    def _cut_together(self, raw: list[bytes]) -> list[bytes]:
        base, check, gain = self.arrays
        n = np.array([len(r) for r in raw])
        width = int(n.max())
        text = np.full((len(raw), width), 256)  # 256: no step in the trie
        text[np.arange(width) < n[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
        text = np.ascontiguousarray(text.T)
        best = np.full((width + 1, len(raw)), _LOW)
        start, ends = np.zeros((width + 1, len(raw)), np.int64), np.zeros((width + 1, len(raw)), np.int64)
        best[0] = 0.0
        for i in range(width):
            at = np.flatnonzero((best[i] > _LOW) & (n > i))  # where a character starts
            here, node = best[i].take(at), np.zeros(len(at), np.int64)
            for j in range(i, width):
                t = base.take(node) + text[j].take(at)
                ok = np.flatnonzero(check.take(t) == node)
                if not len(ok):
                    break
                at, node, here = at.take(ok), t.take(ok), here.take(ok)
                g = gain.take(node) + here
                up = np.flatnonzero(g > best[j + 1].take(at))
                won = at.take(up)
                best[j + 1][won], start[j + 1][won], ends[j + 1][won] = g.take(up), i, node.take(up)
        # the ways back, all a piece at a time; last pieces end up at the right
        ids = np.zeros((len(raw), width), np.int32)
        back, used, live = n.copy(), np.zeros(len(raw), np.int64), np.arange(len(raw))
        while len(live):
            used[live] += 1
            ids[live, width - used[live]] = self.value_of[ends[back[live], live]]
            back[live] = start[back[live], live]
            live = live[back[live] > 0]
        whole, row = ids.tobytes(), 4 * width
        return [whole[end - 4 * u : end] for end, u in zip(range(row, row * len(raw) + 1, row), used.tolist(), strict=True)]

    def _trace(self, raw: bytes, start: list[int], ends: list[int]) -> list[int]:
        """Pieces of the best way, from the end back."""
        out: list[int] = []
        at = len(raw)
        value = self.value
        while at > 0:
            i = start[at]
            if ends[at]:
                out.append(value[ends[at]])
            else:
                out += [self.byte_id.get(b, self.unk_id) for b in reversed(raw[i:at])]
            at = i
        out.reverse()
        return out

    def viterbi(self, word: str) -> tuple[list[int], float]:
        """The ids of the best cut of a word and the sum of its scores."""
        raw = word.encode()
        n = len(raw)
        base, check, gain, unknown = self.base, self.check, self.gain, self.unknown
        best: list[float] = [_LOW] * (n + 1)
        start, ends = [0] * (n + 1), [0] * (n + 1)  # of the best piece that ends here: its start, and its node in the trie
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here == _LOW:
                continue  # within a character
            node, j, first = 0, i, raw[i]
            end = i + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)
            covered = False
            for c in raw[i : i + self.longest]:
                t = base[node] + c
                if check[t] != node:
                    break
                node = t
                j += 1
                g = gain[t]
                if g is not None:
                    if j == end:
                        covered = True
                    g += here
                    if g > best[j]:
                        best[j], start[j], ends[j] = g, i, t
            if not covered and here + unknown > best[end]:
                best[end], start[end], ends[end] = here + unknown, i, 0
        return self._trace(raw, start, ends), best[n]

    def encode(self, text: str) -> tuple[np.ndarray, float]:
        """The ids of a whole text and the sum of their scores."""
        return next(self.encode_all([text]))

    def encode_all(self, batch: list[str]) -> Iterator[tuple[np.ndarray, float]]:
        """encode() of each text. New words of about PORTION characters of text are cut together."""
        lo = 0
        while lo < len(batch):
            hi, size = lo, 0
            while hi < len(batch) and (hi == lo or size + len(batch[hi]) <= PORTION):
                size += len(batch[hi])
                hi += 1
            split = [self.split(MARK + t.replace(" ", MARK)) if t else [] for t in batch[lo:hi]]
            seen = self.seen
            new = [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in seen]
            if len(seen) + len(new) > REMEMBERED:
                seen.clear()
                new = list(dict.fromkeys(chain.from_iterable(split)))
            seen.update(zip(new, self.cut(new), strict=True))
            for words in split:
                ids = np.frombuffer(b"".join(map(seen.__getitem__, words)), np.int32)
                score = self.score_of[ids[~self.is_byte[ids]]].sum() + self.unknown * self.is_lead[ids].sum()
                yield ids, float(score)
            lo = hi

    def decode(self, ids: np.ndarray | list[int]) -> str:
        ids = np.asarray(ids, np.int32)
        if not self.is_byte[ids].any():
            text = "".join(map(self.pieces.__getitem__, ids.tolist()))
        else:
            byte_of = self.byte_of
            text = b"".join(bytes((byte_of[i],)) if i in byte_of else self.pieces[i].encode() for i in ids.tolist()).decode(errors="replace")
        text = text.replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def encode_texts(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """docs with pieces (ids of the whole text), n_pieces, n_byte_pieces, score and round_trip (whether decoding gives the text back)."""
    model = docs.sparkSession.sparkContext.broadcast(load(model_path).parts())  # a vocabulary file: its size is fixed

    def make():
        codec = Codec(Model(*model.value))

        def work(batch):
            out = []
            for x, (ids, score) in zip(batch, codec.encode_all(batch), strict=True):
                out.append((ids, len(ids), int(codec.is_byte[ids].sum()), score, codec.decode(ids) == x))
            return list(zip(*out, strict=True)) if out else [[] for _ in added]

        return work

    added = T.StructType([T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("n_byte_pieces", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("round_trip", T.BooleanType())])
    return with_text_columns(docs, text, added, make)


def decode_pieces(docs: DataFrame, model_path: str, pieces: str = "pieces", into: str = "decoded") -> DataFrame:
    """docs with the text of each array of ids; a null array gives the empty text."""
    model = docs.sparkSession.sparkContext.broadcast(load(model_path).parts())

    def make():
        codec = Codec(Model(*model.value))
        return lambda batch: [[codec.decode(list(x)) if len(x) else "" for x in batch]]

    return with_text_columns(docs, pieces, T.StructType([T.StructField(into, T.StringType())]), make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")

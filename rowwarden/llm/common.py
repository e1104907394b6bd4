"""Shared parts of the text operators: whole-text tokenising, hashing, corpus-wide counters and exact selection."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_batches

#: Counters that travel together when partial counts are added up.
BLOCK = 1 << 14
#: Partial counts of a block are first added up in this many places.
FAN_IN = 8


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without the columns (compared without case) that an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """df under names that no operator adds, those names by the old ones, and the columns that restore the old ones."""
    names = [f"in_{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True)), [F.col(n).alias(c) for c, n in zip(df.columns, names, strict=True)]


def with_text_columns(df: DataFrame, text: str, added: T.StructType, make: Callable[[], Callable[[list], list]], as_bytes: bool = False) -> DataFrame:
    """df with the columns of `added` worked out from the whole of column `text`.

    make() runs once per task and gives a function from the texts of a batch to one list per added column.
    Input columns of the same names are replaced.
    """
    small_batches(df.sparkSession)
    df = without(df, added.fieldNames())
    schema = T.StructType(df.schema.fields + added.fields)
    kinds = [(f.name, _arrow(f.dataType)) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in (part for whole in batches for part in portions(whole)):
            got = work(texts(batch, text, as_bytes))
            arrays = batch.columns + [pa.array(v, k) for v, (_, k) in zip(got, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names + [n for n, _ in kinds])
        del work
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: a Python worker may wait a minute for its next one."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def portions(batch: pa.RecordBatch, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `size` bytes, so that Python objects are made of little at a time."""
    rows = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)
    if not batch.num_rows:
        yield batch


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def texts(batch: pa.RecordBatch, name: str, as_bytes: bool = False) -> list:
    """The texts of a batch as str or UTF-8 bytes; null is the empty text."""
    col = batch.column(batch.schema.get_field_index(name))
    if as_bytes:
        col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    empty = b"" if as_bytes else ""
    return [empty if x is None else x for x in col.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words, from the words' hashes."""
    if len(h) < n:
        return h[:0]
    out = mix64(h[: len(h) - n + 1] + np.uint64(n))
    for i in range(1, n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return out


def corpus_counts(df: DataFrame, size: int, add: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """`size` counters over all rows of df: add(batch, counters) counts one batch. Each task counts into an array of its own."""

    small_batches(df.sparkSession)

    def count(batches):
        acc = np.zeros(size, np.int64)
        for b in batches:
            add(b, acc)
        for block, packed in partial_counts(acc):
            yield _block(block, packed)
        del acc
        give_back()

    return add_up(df.mapInArrow(count, "block int, counts binary"), size)


def partial_counts(acc: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The blocks of a task's counters that are not all zero."""
    for i in range(0, len(acc), BLOCK):
        if acc[i : i + BLOCK].any():
            yield i // BLOCK, _packed(acc[i : i + BLOCK])


def add_up(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of partial counts (block, counts).

    Blocks are added up on the executors, in two steps and as a stream, so that memory does not depend on the number of
    tasks; the driver gets `size` numbers.
    """

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = _unpacked(x)
                sums[k] = sums[k] + v if k in sums else v
        for k, v in sums.items():
            yield _block(k, _packed(v))
        sums.clear()
        give_back()

    spread = parts.repartition("block", F.pmod(F.xxhash64("counts"), F.lit(FAN_IN))).mapInArrow(total, parts.schema)
    out = np.zeros(size, np.int64)
    for r in spread.repartition("block").mapInArrow(total, parts.schema).collect():
        v = _unpacked(r.counts)
        out[r.block * BLOCK : r.block * BLOCK + len(v)] = v
    return out


def _block(block: int, packed: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed], pa.binary())], names=["block", "counts"])


def _packed(v: np.ndarray) -> bytes:
    """Counters of a block: a byte for each, or the places and bytes of those that aren't 0; those of 255 and more follow as places and values."""
    some = np.flatnonzero(v)
    large = np.flatnonzero(v >= 255)
    if 3 * len(some) < len(v):
        body = len(some).to_bytes(4, "little") + some.astype(np.uint16).tobytes() + np.minimum(v[some], 255).astype(np.uint8).tobytes()
    else:
        body = (1 << 31).to_bytes(4, "little") + np.minimum(v, 255).astype(np.uint8).tobytes()
    return len(v).to_bytes(4, "little") + body + large.astype(np.int64).tobytes() + v[large].astype(np.int64).tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    n, some = int.from_bytes(x[:4], "little"), int.from_bytes(x[4:8], "little")
    if some == 1 << 31:
        v, rest = np.frombuffer(x, np.uint8, n, 8).astype(np.int64), x[8 + n :]
    else:
        v, rest = np.zeros(n, np.int64), x[8 + 3 * some :]
        v[np.frombuffer(x, np.uint16, some, 8)] = np.frombuffer(x, np.uint8, some, 8 + 2 * some)
    large = np.frombuffer(rest, np.int64)
    v[large[: len(large) // 2]] = large[len(large) // 2 :]
    return v


def unit_hash(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) that depends on seed and cols only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12) + F.lit(0.5)) / F.lit(float(1 << 52))


def largest(df: DataFrame, k: int, keys: list[str]) -> tuple[int, ...] | None:
    """The k-th largest row of bigint columns `keys`, in lexicographic order, found without a sort.

    Each step counts rows by 16 bits of one key, so the driver sees at most 65,536 counts however many rows there are.
    None if df has at most k rows (all are within the k largest). With repeated rows, the k-th may be one of several.
    """
    found: list[int] = []
    rows = df
    for name in keys:
        word = F.col(name).bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
        prefix = 0
        for shift in (48, 32, 16, 0):
            at = F.shiftrightunsigned(word, shift).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("at")
            here = rows if shift == 48 else rows.where(F.shiftrightunsigned(word, shift + 16) == F.lit(prefix))
            counts = sorted(((r.at, r.n) for r in here.groupBy(at).agg(F.count("*").alias("n")).collect()), reverse=True)
            if not found and shift == 48 and sum(n for _, n in counts) <= k:
                return None
            for value, n in counts:
                if n >= k:
                    prefix = prefix << 16 | value
                    break
                k -= n
        signed = (prefix ^ (1 << 63)) - ((1 << 64) if (prefix ^ (1 << 63)) >= 1 << 63 else 0)
        found.append(signed)
        rows = rows.where(F.col(name) == F.lit(signed))
    return tuple(found)


def at_least(keys: list[Column], bound: tuple[int, ...] | None) -> Column:
    """Whether a row is not below `bound` in the order of largest()."""
    out = F.lit(True)
    for key, v in reversed(list(zip(keys, bound, strict=True)) if bound else []):
        out = (key > F.lit(v)) | ((key == F.lit(v)) & out)
    return out


def sortable(x: Column) -> Column:
    """A bigint with the order of the double x: for use with largest(). NaN and null are the lowest."""
    bits = F.when(F.isnan(x) | x.isNull(), F.lit(None)).otherwise(F.round(x * F.lit(float(1 << 32))).cast("bigint"))
    return F.coalesce(bits, F.lit(-(1 << 63)))

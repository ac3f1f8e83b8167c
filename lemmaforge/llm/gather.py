"""Counts of a corpus, gathered chunk by chunk and handed back to the chunks.

A task cuts its documents into chunks of bounded size and counts the keys of each (words, or packed byte strings).
The keys of a chunk are dealt into slices by their hash; an entry is one chunk's part of one slice, packed in one
value. Entries of a slice are merged in a tree, so the merge holds distinct keys and never all chunks of a key. What
a slice then knows of its keys goes back to each chunk in the order of the keys sent. Nothing is broadcast: what is
moved, merged and answered grows with the corpus, in parts of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 16 << 20  # text of a chunk, which is passed only by a single longer document
SLICES = 1024
MERGED = 256  # entries of a slice merged at a time
ASKED = 4_000_000  # keys a slice answers at a time, on average

ENTRY = "chunk bigint, slice int, size bigint, keys binary, counts binary"


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def pack_numbers(keys: np.ndarray) -> bytes:
    """Rising numbers as their differences."""
    return pack(np.diff(keys, prepend=np.int64(0)))


def unpack_numbers(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.int64))


def pack_words(words: list[bytes]) -> bytes:
    """Words without tabs, at least one."""
    return zstandard.ZstdCompressor(level=1).compress(b"\t".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\t")


def merge_numbers(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their summed counts."""
    keys, counts = map(np.concatenate, zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = run_starts(keys)
    return keys[starts], np.add.reduceat(counts, starts)


def merge_words(parts: Iterable[tuple[list[bytes], np.ndarray]]) -> tuple[list[bytes], np.ndarray]:
    words, counts = zip(*parts)
    table = pa.table({"k": pa.array([w for own in words for w in own], pa.large_binary()), "n": np.concatenate(counts)})
    table = table.group_by("k").aggregate([("n", "sum")]).sort_by("k")
    return table["k"].to_pylist(), table["n_sum"].to_numpy()


def run_starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)


class Kind:
    """How keys of a kind are packed and merged."""

    def __init__(self, pack_keys: Callable, unpack_keys: Callable, merge: Callable) -> None:
        self.pack, self.unpack, self.merge = pack_keys, unpack_keys, merge


NUMBERS = Kind(pack_numbers, unpack_numbers, merge_numbers)
WORDS = Kind(pack_words, unpack_words, merge_words)


def merge_entries(entries: DataFrame, kind: Kind) -> DataFrame:
    """`slice`, `keys`, `counts`: one row for each slice, its distinct keys in order and their sums over all chunks."""

    def fold(table: pa.Table) -> pa.Table:
        rows = zip(table["keys"].to_pylist(), table["counts"].to_pylist())
        keys, counts = kind.merge([(kind.unpack(k), unpack(c, np.int64)) for k, c in rows])
        one = {"slice": table["slice"][:1].combine_chunks(), "chunk": table["part"][:1].combine_chunks()}
        return pa.table(one | {"keys": pa.array([kind.pack(keys)], pa.binary()), "counts": pa.array([pack(counts)], pa.binary())})

    left = entries.select("slice", "chunk", "keys", "counts")
    count = entries.select("chunk").distinct().count()
    while True:
        parts = max(1, math.ceil(count / MERGED))
        dealt = left.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts)))
        left = dealt.groupBy("slice", "part").applyInArrow(fold, "slice int, chunk bigint, keys binary, counts binary")
        if parts == 1:
            return left.drop("chunk")
        count = parts


def answer_entries(entries: DataFrame, known: DataFrame, kind: Kind, columns: str, answer: Callable) -> DataFrame:
    """`chunk`, `slice`, `keys` of each entry and `columns`, what `answer(known row)(keys)` says of the keys.

    `known` has a row for each slice. Many entries of a slice are dealt into parts, each with its copy of that row.
    """
    asked = entries.agg(F.sum("size")).first()[0] or 0
    parts = max(1, math.ceil(asked / (SLICES * ASKED)))
    dealt = entries.select("slice", F.pmod(F.xxhash64("chunk"), F.lit(parts)).alias("part"), "chunk", "keys")
    copies = known.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    names = [c.split()[0] for c in columns.split(",")]
    fields = {"chunk": pa.int64(), "slice": pa.int32(), "keys": pa.binary()} | dict.fromkeys(names, pa.binary())

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table({c: pa.array([], t) for c, t in fields.items()})
        told = answer({c: right[c][0].as_py() for c in right.column_names})
        out = [told(kind.unpack(k)) for k in left["keys"].to_pylist()]
        kept = [left[c] for c in ("chunk", "slice", "keys")]
        own = [pa.array(list(c), pa.binary()) for c in zip(*out)]
        return pa.table([*kept, *own], names=["chunk", "slice", "keys", *names])

    schema = f"chunk bigint, slice int, keys binary, {columns}"
    return dealt.groupBy("slice", "part").cogroup(copies.groupBy("slice", "part")).applyInArrow(run, schema)


def places(words: list[bytes], known: list[bytes]) -> np.ndarray:
    """The place of each word among the known ones, -1 where it is not one of them."""
    found = pc.index_in(pa.array(words, pa.large_binary()), pa.array(known, pa.large_binary()))
    return found.fill_null(-1).to_numpy().astype(np.int64)

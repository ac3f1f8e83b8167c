"""Benchmark decontamination: an FM-index over each shard of the corpus, searched for the windows of the items.

Shard: the documents of one Arrow batch. Its words become symbols: a word of the items has a number, every
stretch of other words is one separator, since no window can cross it; stretches shorter than the shortest
window are left out. Over the symbols stand a suffix order, the Burrows-Wheeler transform in a wavelet matrix,
and the positions of every eighth suffix. All windows are searched backwards at once; occurrences are located
by walking to a sampled position and merged to spans of words.

Items go to the tasks in blocks of a bounded number of windows, one narrow pass per block; there is no shuffle.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from lemmaforge.llm.words import alnum_words, free_name, sha256_hex
from lemmaforge.session import cut_lineage

WINDOW = 10
BLOCK_WINDOWS = 200_000  # windows broadcast at a time: at most some 30 MB
SAMPLED = 8  # every so many suffix positions are kept


class Bits:
    """Packed flags with a count for each 64 of them: which are set, and how many before a place."""

    def __init__(self, flags: np.ndarray) -> None:
        padded = np.zeros((len(flags) // 64 + 1) * 64, bool)
        padded[: len(flags)] = flags
        self.words = np.packbits(padded.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.total = int(counts.sum())

    def at(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, place: np.ndarray) -> np.ndarray:
        """How many are set before each place."""
        under = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[place >> 6] + np.bitwise_count(self.words[place >> 6] & under)


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit plane a level, for many queries at once."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.planes = []
        for bit in range(bits - 1, -1, -1):
            on = (symbols >> bit) & 1 == 1
            ones = Bits(on)
            self.planes.append((bit, ones, len(symbols) - ones.total))
            symbols = np.concatenate([symbols[~on], symbols[on]])

    def rank(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        start, end = np.zeros_like(before), before
        for bit, ones, zeros in self.planes:
            on = ((symbol >> bit) & 1).astype(bool)
            low, high = ones.rank(start), ones.rank(end)
            start = np.where(on, zeros + low, start - low)
            end = np.where(on, zeros + high, end - high)
        return end - start

    def at(self, place: np.ndarray) -> np.ndarray:
        """The symbols at the given positions."""
        symbol = np.zeros_like(place)
        for bit, ones, zeros in self.planes:
            on, before = ones.at(place), ones.rank(place)
            symbol |= on.astype(symbol.dtype) << bit
            place = np.where(on, zeros + before, place - before)
        return symbol


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order. Separators (0) come first, and each is a symbol of its own."""
    n, step = len(symbols), 0
    apart = symbols == 0
    key = np.where(apart, np.cumsum(apart), int(apart.sum()) + symbols).astype(np.int64)
    while n:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], np.diff(key[order]) != 0]))
        if rank[order[-1]] == n:
            return order
        step = max(1, 2 * step)
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - step)] = rank[step:]
        key = rank * np.int64(n + 1) + ahead
    return np.zeros(0, np.int64)


class FmIndex:
    """Backward search and location over symbols from 0 (separator) to `top`.

    The first symbol after a separator is always a sampled position, so no walk crosses a separator.
    """

    def __init__(self, symbols: np.ndarray, top: int, sampled: int = SAMPLED) -> None:
        order = suffix_order(symbols)
        self.size = len(symbols)
        self.waves = WaveletMatrix(symbols[order - 1].astype(np.int64), max(1, int(top).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        keep = (np.arange(self.size) % sampled == 0) | (np.concatenate([[0], symbols[:-1]]) == 0)
        self.kept = Bits(keep[order])
        self.place = order[keep[order]]  # of the sampled suffixes only

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of symbols, the first and the end row of the suffixes that begin with it."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        live = np.arange(len(patterns))
        for symbol in patterns.T[::-1]:
            own = symbol[live].astype(np.int64)
            low[live] = self.first[own] + self.waves.rank(own, low[live])
            high[live] = self.first[own] + self.waves.rank(own, high[live])
            live = live[low[live] < high[live]]
        high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in the given rows."""
        rows, found, steps = rows.copy(), np.zeros(len(rows), np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.kept.at(rows[open_])
            found[open_[done]] = self.place[self.kept.rank(rows[open_[done]])] + steps
            open_ = open_[~done]
            symbol = self.waves.at(rows[open_])
            rows[open_] = self.first[symbol] + self.waves.rank(symbol, rows[open_])
            steps += 1
        return found


class Windows:
    """The distinct windows of a block of items; small enough to broadcast."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.numbers: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], set[str]] = {}

    def add(self, item: str, words: list[bytes]) -> None:
        ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
        for i in range(max(1, len(ids) - self.width + 1)):
            self.items.setdefault(tuple(ids[i : i + self.width]), set()).add(item)

    def grouped(self) -> list[tuple[np.ndarray, list[list[str]]]]:
        """Windows of each length, with their items."""
        by: dict[int, list] = {}
        for window, items in self.items.items():
            by.setdefault(len(window), []).append((window, sorted(items)))
        return [(np.array([w for w, _ in group], np.int64), [i for _, i in group]) for group in by.values()]


def item_blocks(items: DataFrame, item_id: str, text: str, width: int, most: int) -> Iterator[Windows]:
    """Items read one after another, in blocks of about `most` windows at most (one item is never cut)."""
    block = Windows(width)
    for row in items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        words = alnum_words(row.t)
        if row.i is None or not words:
            continue
        if block.items and len(block.items) + max(1, len(words) - width + 1) > most:
            yield block
            block = Windows(width)
        block.add(row.i, words)
    yield block


def shard_hits(texts: list[str | None], block: Windows, groups: list) -> tuple[list[int], list, list[set[str]]]:
    """For each document of a shard: its number of words, merged (start, end) spans of words, and items found."""
    get, zero = block.numbers.get, itertools.repeat(0)
    parts = [np.fromiter(map(get, words, zero), np.int64, len(words)) for words in map(alnum_words, texts)]
    n_words = [len(p) for p in parts]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    found: list[set[str]] = [set() for _ in texts]
    # every document ends with a separator
    flow = np.concatenate([x for p in parts for x in (p, [0])] or [np.zeros(0, np.int64)]).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum([n + 1 for n in n_words])]).astype(np.int64)
    inside = np.concatenate([[False], flow > 0, [False]])
    begin, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    least = min((g.shape[1] for g, _ in groups), default=0)
    long = end - begin >= least
    begin, end = begin[long], end[long]
    if not len(begin) or not groups:
        return n_words, spans, found
    # the kept stretches, each with the separator behind it
    sizes = end - begin + 1
    origin = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    index = FmIndex(flow[origin], len(block.numbers))
    edge = np.zeros(len(flow) + 1, np.int64)
    for patterns, items in groups:
        low, high = index.search(patterns)
        counts = high - low
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        place = origin[index.locate(rows)]
        which = np.repeat(np.arange(len(patterns)), counts)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + patterns.shape[1], -1)
        pairs = np.unique((np.searchsorted(starts, place, "right") - 1) * np.int64(len(patterns)) + which)
        for doc, window in zip((pairs // len(patterns)).tolist(), (pairs % len(patterns)).tolist()):
            found[doc].update(items[window])
    hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    begin, end = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:])
    docs = np.searchsorted(starts, begin, "right") - 1
    for doc, a, b in zip(docs.tolist(), (begin - starts[docs]).tolist(), (end - starts[docs]).tolist()):
        spans[doc].append((a, b))
    return n_words, spans, found


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap made one."""
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row per document: its id, `n_words`, `leak_spans` of words (end exclusive) and `leak_items`.

    A window is `width` consecutive words of an item, or the whole of a shorter item. Null and empty texts have
    no words; items without words or id have no windows; repeated rows each get their row; without items nothing
    is hit. Columns other than id and text are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType.simpleString()
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = out.withColumn("n_words", F.lit(0).cast("bigint"))
    out = out.withColumn("leak_spans", F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)"))
    out = out.withColumn("leak_items", F.expr("cast(array() as array<string>)"))
    schema = (
        f"doc_id {id_type}, text string, n_words bigint,"
        " leak_spans array<struct<start: bigint, end: bigint>>, leak_items array<string>"
    )
    for block in item_blocks(items, item_id, item_text, width, block_windows):
        shared = spark.sparkContext.broadcast(block)
        out = out.mapInArrow(_searcher(shared), schema)
    return out.select(F.col("doc_id").alias(doc_id), "n_words", "leak_spans", "leak_items")


def _searcher(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        groups = block.grouped()
        for batch in batches:
            before, items = batch.column("leak_spans").to_pylist(), batch.column("leak_items").to_pylist()
            n_words, spans, found = shard_hits(batch.column("text").to_pylist(), block, groups)
            spans = [merge_spans([(s["start"], s["end"]) for s in old] + new) for old, new in zip(before, spans)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text"),
                    pa.array(n_words, pa.int64()),
                    pa.array(
                        [[{"start": a, "end": b} for a, b in s] for s in spans],
                        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                    ),
                    pa.array([sorted(new.union(old)) for new, old in zip(found, items)], pa.list_(pa.string())),
                ],
                names=["doc_id", "text", "n_words", "leak_spans", "leak_items"],
            )

    return run


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest columns of every document."""
    hit = F.aggregate("leak_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return find_leaks(docs, items).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("leak_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "leak_items"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


# Every character outside the words, as in words.alnum_words.
_WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, last = [], 0
    for start, end in spans:
        kept.append(text[last : places[start][0]])
        last = places[end - 1][1]
    return "".join([*kept, text[last:]])


def remove_leaks(docs: DataFrame, items: DataFrame, width: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """`docs` with the leaked spans cut out of `text`, and `n_chars` counted anew; all other columns as they were.

    The spans of all blocks are found in the untouched text and cut at once. Where cut ends meet, new windows may
    form, so texts that were cut are searched again until nothing is hit. A document of nothing but leaked words
    keeps its row with what is left between them.
    """
    shared = [docs.sparkSession.sparkContext.broadcast(b) for b in item_blocks(items, "item_id", "text", width, block_windows)]
    if len(shared) == 1:
        return docs.mapInArrow(_cutter(shared[0]), docs.schema)
    spans, again = free_name("_spans", docs.columns), free_name("_again", docs.columns)
    marked = StructType([*docs.schema, StructField(spans, _SPANS)])
    cut = StructType([*docs.schema, StructField(again, BooleanType())])
    done, left = [], docs
    while not done or left.take(1):
        out = left.withColumn(spans, F.array().cast(_SPANS))
        for block in shared:
            out = out.mapInArrow(_marker(block), marked)
        out = cut_lineage(out.mapInArrow(_cut_marked(again), cut))
        done.append(out.where(~F.col(again)).select(*docs.columns))
        left = out.where(F.col(again)).select(*docs.columns)
    return functools.reduce(DataFrame.union, done)


_SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def _with_texts(batch: pa.RecordBatch, texts: list[str | None], changed: list[bool]) -> list[pa.Array]:
    """The columns of the batch with other texts, and `n_chars` of those that changed."""
    columns = []
    for name, column in zip(batch.schema.names, batch.columns):
        if name == "text":
            column = pa.array(texts, column.type)
        elif name == "n_chars":
            sizes = [len(t) if c else n for t, c, n in zip(texts, changed, column.to_pylist())]
            column = pa.array(sizes, column.type)
        columns.append(column)
    return columns


def _marker(shared):
    """Adds the spans a block hits to the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        groups = block.grouped()
        for batch in batches:
            _, spans, _ = shard_hits(batch.column("text").to_pylist(), block, groups)
            before = batch.columns[-1].to_pylist()
            merged = [merge_spans([(s["start"], s["end"]) for s in old] + new) for old, new in zip(before, spans)]
            merged = pa.array([[{"start": a, "end": b} for a, b in s] for s in merged], batch.columns[-1].type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], merged], names=batch.schema.names)

    return run


def _cut_marked(again: str):
    """Cuts the spans in the last column, which then tells, as `again`, whether there were any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[(s["start"], s["end"]) for s in each] for each in batch.columns[-1].to_pylist()]
            hit = [bool(s) for s in spans]
            texts = [cut_spans(t, s) if s else t for t, s in zip(batch.column("text").to_pylist(), spans)]
            columns = [*_with_texts(batch, texts, hit)[:-1], pa.array(hit, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], again])

    return run


def _cutter(shared):
    """Cuts what the only block hits until it hits nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        groups = block.grouped()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            changed, left = [False] * len(texts), list(range(len(texts)))
            while left:
                _, spans, _ = shard_hits([texts[i] for i in left], block, groups)
                cut = [(i, s) for i, s in zip(left, spans) if s]
                for i, s in cut:
                    texts[i], changed[i] = cut_spans(texts[i], s), True
                left = [i for i, _ in cut]
            yield pa.RecordBatch.from_arrays(_with_texts(batch, texts, changed), names=batch.schema.names)

    return run

"""Byte-level BPE: encoding by a priority queue of merge ranks over a doubly linked list, decoding by joining.

The vocabulary file is read on the driver (its path is a parameter) and broadcast: its size does not depend on
the corpus. Texts are encoded whole, one Arrow batch after another, without a shuffle.
"""

from __future__ import annotations

import heapq
import itertools
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how byte-level vocabularies cut a text before merging.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
MEMO_BYTES = 80 << 20  # of pieces and their ids that a worker remembers, about
BATCH_BYTES = 4 << 20  # text worked on at a time; a longer one is worked on by itself
_PLACE_BITS = 40  # of an entry of the queue; its rank stands above them


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the others for the letters from U+0100 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class Vocabulary:
    """Merges, ids and strings of a vocabulary file in the JSON form of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        letters = byte_letters()
        back = {letter: byte for byte, letter in letters.items()}
        ids = held["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
        self.bytes = [ids[letters[b]] for b in range(256)]
        self.width = 1 + max(ids.values())
        # left id * width + right id -> rank; rank -> the id they become
        self.ranks = {ids[a] * self.width + ids[b]: rank for rank, (a, b) in enumerate(merges)}
        self.merged = [ids[a + b] for a, b in merges]
        self.special = {t["content"]: t["id"] for t in held["added_tokens"] if t["special"]}
        self.strings = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, number in ids.items():
            self.strings[number] = bytes(back[c] for c in token)
        for token, number in self.special.items():
            self.strings[number] = token.encode()


def merge_piece(piece: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of one piece. The queue holds rank and place; an entry is stale if the pair there has another rank by now."""
    symbols = [vocabulary.bytes[b] for b in piece]
    count, width, merged, rank_of = len(symbols), vocabulary.width, vocabulary.merged, vocabulary.ranks.get
    ranks = [rank_of(a * width + b, -1) for a, b in zip(symbols, symbols[1:])]
    queue = [rank << _PLACE_BITS | i for i, rank in enumerate(ranks) if rank >= 0]
    heapq.heapify(queue)
    ranks.append(-1)
    before, after = list(range(-1, count - 1)), list(range(1, count + 1))
    while queue:
        entry = heapq.heappop(queue)
        rank, i = entry >> _PLACE_BITS, entry & ((1 << _PLACE_BITS) - 1)
        if ranks[i] != rank:
            continue  # stale
        j = after[i]
        symbol = symbols[i] = merged[rank]
        symbols[j] = ranks[j] = ranks[i] = -1
        k = after[i] = after[j]
        if k < count:
            before[k] = i
            found = ranks[i] = rank_of(symbol * width + symbols[k], -1)
            if found >= 0:
                heapq.heappush(queue, found << _PLACE_BITS | i)
        h = before[i]
        if h >= 0:
            found = ranks[h] = rank_of(symbols[h] * width + symbol, -1)
            if found >= 0:
                heapq.heappush(queue, found << _PLACE_BITS | h)
    return [s for s in symbols if s >= 0]


def spread_runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all members of runs, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Encoder(dict):
    """Ids of texts. Distinct pieces are numbered and merged once; a text's ids are gathered from them."""

    def __init__(self, vocabulary: Vocabulary, most: int = MEMO_BYTES) -> None:
        super().__init__()
        self.vocabulary, self.most = vocabulary, most
        self.cut = regex.compile(PIECES)
        marks = sorted(vocabulary.special, key=len, reverse=True)
        self.marks = regex.compile("|".join(map(regex.escape, marks)) or r"(?!)")
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids, self.ends, self.used = array("i"), array("q", [0]), 0
        self.special = {mark: self.add([number]) for mark, number in self.vocabulary.special.items()}

    def add(self, ids: list[int]) -> int:
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        return len(self.ends) - 2

    def __missing__(self, piece: str) -> int:
        ids = merge_piece(piece.encode(), self.vocabulary)
        self[piece] = number = self.add(ids)
        self.used += 150 + len(piece) + 4 * len(ids)
        return number

    def pieces(self, text: str) -> list[int]:
        if not any(mark in text for mark in self.special):
            return list(map(self.__getitem__, self.cut.findall(text)))
        out, last = [], 0
        for mark in self.marks.finditer(text):
            out += [*map(self.__getitem__, self.cut.findall(text[last : mark.start()])), self.special[mark[0]]]
            last = mark.end()
        return out + list(map(self.__getitem__, self.cut.findall(text[last:])))

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids end."""
        if self.used > self.most:
            self.forget()
        numbers = [self.pieces(t) if t else [] for t in texts]
        flat = np.fromiter(itertools.chain.from_iterable(numbers), np.int64, sum(map(len, numbers)))
        ends = np.array(self.ends, np.int64)
        starts, sizes = ends[flat], ends[flat + 1] - ends[flat]
        behind = np.concatenate([[0], np.cumsum(sizes)])
        return np.array(self.ids, np.int32)[spread_runs(starts, sizes)], behind[np.cumsum([len(n) for n in numbers])]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0].tobytes()


class Decoder:
    """Texts of ids, gathered from one row of all the vocabulary's strings."""

    def __init__(self, strings: list[bytes]) -> None:
        self.raw = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts whose ids end at `ends`. Ids outside the vocabulary give nothing."""
        ids = ids.astype(np.int64)
        known = (ids >= 0) & (ids < len(self.sizes))
        ids = np.where(known, ids, 0)
        sizes = np.where(known, self.sizes[ids], 0)
        raw = self.raw[spread_runs(self.starts[ids], sizes)]
        behind = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends])]
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(behind), pa.py_buffer(raw)])
        try:
            return texts.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


def _parts(batches: Iterator[pa.RecordBatch], column: int, weight: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of batches of about BATCH_BYTES, a text or list counting by its length times `weight`."""
    for batch in batches:
        lengths = pc.fill_null((pc.list_value_length if weight > 1 else pc.binary_length)(batch.column(column)), 0).to_numpy()
        step = np.cumsum(lengths.astype(np.int64) * weight + 64) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


_ENCODERS: dict[str, Encoder] = {}  # one memo a worker process and vocabulary, bounded by MEMO_BYTES


def _encoder(path: str, vocabulary: Vocabulary) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(vocabulary)
    return _ENCODERS[path]


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))


def encode_texts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id and `ids`, the token ids of the whole text. Null and empty texts have none.

    Special tokens that stand in a text get their id. Repeated rows each get their row. Columns other than id and
    text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, shared.value)
        for part in _parts(batches, 1):
            ids, ends = encoder.encode_all(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids, ends)], names=["doc_id", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, ids array<int>").withColumnRenamed("doc_id", doc_id)


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`encode_texts` with `decoded`, what `decode_ids` makes of the ids, in one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(path, shared.value), Decoder(shared.value.strings)
        for part in _parts(batches, 1):
            ids, ends = encoder.encode_all(part.column(1).to_pylist())
            columns = [part.column(0), _lists(ids, ends), decoder.decode_all(ids, ends)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])

    kind = docs.schema[doc_id].dataType.simpleString()
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string").withColumnRenamed("doc_id", doc_id)


def decode_ids(tokens: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`tokens` with the column `text`: the strings of its ids joined, special tokens too.

    Null and empty lists give an empty text, ids outside the vocabulary or null give nothing, bytes that are no UTF-8
    give U+FFFD. A column that already has the name is replaced.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary(path).strings)
    tokens = tokens.drop(text) if text != ids else tokens
    at = tokens.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for part in _parts(batches, at, 16):
            lists = part.column(at)
            flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, decoder.decode_all(flat, ends)], names=[*part.schema.names, text])

    schema = tokens.withColumn(text, F.lit("")).schema
    return tokens.mapInArrow(run, schema)


def token_report(docs: DataFrame, path: str) -> DataFrame:
    """The digest columns of every document."""
    return round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

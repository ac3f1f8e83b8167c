"""Language-model scores by context-tree weighting over bytes.

A text is its words, joined by single spaces, and an end. Each byte is eight binary choices; a choice is a node of the
byte tree (its leading bits) and is seen in the contexts of 0 to 5 bytes before it. Every (context, node) has the
Krichevsky-Trofimov estimate of its zeros and ones. With `e` for that estimate of a node's whole history, the weighted
probability is w = e at the deepest context, else w = (e + product of the children's w) / 2; the next choice is
predicted by the mixture these weights give over all depths. The tree ends where training has seen nothing.

The corpus is counted as byte strings of length 6 (`gather`). Subtrees below three bytes of context lie within one
slice and are weighed there; the few levels above are weighed by the last byte of context, the root by 255 sums.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaforge.llm.gather import (
    CHUNK_BYTES, ENTRY, NUMBERS, SLICES, WORDS, answer_entries, merge_entries, pack, places, run_starts, unpack, unpack_numbers, unpack_words,
)
from lemmaforge.llm.words import blank_words, mix
from lemmaforge.session import cut_lineage

DEPTH = 5  # bytes of context
CUT = 3  # bytes of context whose subtrees lie within a slice
END = b"\n"  # ends a text and stands before its first byte; no word holds it
BLOCK = 1 << 21  # positions worked on at a time
SENT = 500  # documents sent back at a time
HELD_OUT = 2  # remainder of the documents that are not learned from

_FEW = 4096
_HALVES = np.array([math.lgamma(n + 0.5) for n in range(_FEW)])
_WHOLES = np.array([math.lgamma(n + 1.0) for n in range(_FEW)])


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the id as text leaves 2 when divided by 7; null ids are learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == HELD_OUT, F.lit(False))


def _ln_gamma(n: np.ndarray, add: float, few: np.ndarray) -> np.ndarray:
    x = np.maximum(n, _FEW) + add
    long = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < _FEW, few[np.minimum(n, _FEW - 1)], long)


def ln_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of any order of these zeros and ones."""
    both = _ln_gamma(zeros, 0.5, _HALVES) + _ln_gamma(ones, 0.5, _HALVES)
    return both - _ln_gamma(zeros + ones, 1.0, _WHOLES) - math.log(math.pi)


class Level:
    """Nodes of one depth: `ids` (context << 8 | node) in order, `zeros`, `ones`, `weight` (ln w) and `own`.

    `own` is the share of the node's own estimate in its mixture with the deeper contexts.
    """

    def __init__(self, ids: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> None:
        self.ids, self.zeros, self.ones = ids, zeros, ones
        estimate = ln_estimate(zeros, ones)
        self.own = np.ones(len(ids))
        self.weight = estimate
        if below is not None:
            either = np.logaddexp(estimate, below)
            self.weight, self.own = either - math.log(2), np.exp(estimate - either)

    def above(self) -> Level:
        """The level with one byte of context less."""
        ids = _shorter(self.ids)
        order = np.argsort(ids, kind="stable")
        starts = run_starts(ids[order])
        add = lambda x: np.add.reduceat(x[order], starts)
        return Level(ids[order][starts], add(self.zeros), add(self.ones), add(self.weight))

    def predict(self, state: np.ndarray) -> np.ndarray:
        """States of the nodes from those of their parents.

        A state is (chance of a one by the contexts so far, what is left for deeper ones, chance if this is the last).
        """
        seen = self.zeros + self.ones
        chance = (self.ones + 0.5) / (seen + 1)
        mixed = state[:, 0] + state[:, 1] * self.own * chance
        last = np.where(seen > 0, state[:, 0] + state[:, 1] * chance, state[:, 2])
        return np.stack([mixed, state[:, 1] * (1 - self.own), last], axis=1)


def _shorter(ids: np.ndarray) -> np.ndarray:
    return (ids >> 16 << 8) | (ids & 255)


def deepest(grams: np.ndarray, counts: np.ndarray) -> Level:
    """The deepest level, from packed byte strings (context << 8 | byte) in order."""
    ids, zeros, ones = [], [], []
    for j in range(8):
        starts = run_starts(grams >> (8 - j))
        total = np.add.reduceat(counts, starts)
        one = np.add.reduceat(counts * (grams >> (7 - j) & 1), starts)
        first = grams[starts]
        ids.append((first >> 8 << 8) | (1 << j) | ((first & 255) >> (8 - j)))
        zeros.append(total - one)
        ones.append(one)
    ids, zeros, ones = map(np.concatenate, (ids, zeros, ones))
    order = np.argsort(ids, kind="stable")
    return Level(ids[order], zeros[order], ones[order], None)


def levels_below(grams: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Levels of 3, 4 and 5 bytes of context."""
    levels = [deepest(grams, counts)]
    for _ in range(DEPTH - CUT):
        levels.insert(0, levels[0].above())
    return levels


def _states(level: Level, ids: np.ndarray, state: np.ndarray) -> np.ndarray:
    """For each node of `level`, the row of `state` (of `ids` in order) that belongs to its parent."""
    return state[np.searchsorted(ids, _shorter(level.ids))]


def ln_chances(grams: np.ndarray, counts: np.ndarray, ids: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Natural logarithm of the chance of each byte after its context. `state` is what depth 2 hands to `ids`."""
    levels = levels_below(grams, counts)
    order = np.searchsorted(ids, levels[0].ids)
    state = levels[0].predict(state[order])
    for upper, level in zip(levels, levels[1:]):
        state = level.predict(_states(level, upper.ids, state))
    out = np.zeros(len(grams))
    for j in range(8):
        node = (grams >> 8 << 8) | (1 << j) | ((grams & 255) >> (8 - j))
        one = state[np.searchsorted(levels[-1].ids, node), 2]
        out += np.log(np.where(grams >> (7 - j) & 1, one, 1 - one))
    return out


def byte_stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with the ends before and after them in one array, and where each text's own bytes begin.

    The own bytes of a text are its bytes and its end; DEPTH bytes of context stand before them.
    """
    raw = b"".join(END * DEPTH + t + END for t in texts)
    sizes = np.fromiter((len(t) + DEPTH + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(raw, np.uint8), np.cumsum(sizes) - sizes + DEPTH


def gram_blocks(raw: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed strings of six bytes and the number of the text they end in, block by block.

    The nearest byte of context is the highest, the byte itself the lowest, so contexts with a common end are together.
    """
    for at in range(DEPTH, len(raw), BLOCK):
        part = raw[at - DEPTH : at + BLOCK].astype(np.int64)
        count = len(part) - DEPTH
        grams = part[DEPTH:].copy()
        for back in range(1, DEPTH + 1):
            grams |= part[DEPTH - back : DEPTH - back + count] << (8 * (DEPTH + 1 - back))
        position = np.arange(at, at + count)
        text = np.searchsorted(begins, position, side="right") - 1
        # the bytes before a text that only serve as context
        following = np.append(begins[1:], len(raw) + DEPTH)[text]
        own = position < following - DEPTH
        yield grams[own], text[own]


class Finder:
    """Places of numbers among distinct `keys`, in the order `order`: by a bucket of a multiplicative hash, then onwards."""

    def __init__(self, keys: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(1, len(keys)).bit_length() - 1)
        hashes = self.bucket(keys)
        self.order = np.argsort(hashes, kind="stable")
        self.keys = keys[self.order]
        self.starts = np.searchsorted(hashes[self.order], np.arange(1 << int(64 - self.shift), dtype=np.uint64))

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """All `wanted` are among the keys."""
        at = self.starts[self.bucket(wanted)]
        wrong = np.flatnonzero(self.keys[at] != wanted)
        while len(wrong):
            at[wrong] += 1
            wrong = wrong[self.keys[at[wrong]] != wanted[wrong]]
        return at


def slice_of(grams: np.ndarray) -> np.ndarray:
    return (mix(grams >> (8 * (DEPTH + 1 - CUT))) % np.uint64(SLICES)).astype(np.int64)


def _distinct(texts: list[bytes]) -> np.ndarray:
    raw, begins = byte_stream(texts)
    parts = [np.unique(grams) for grams, _ in gram_blocks(raw, begins)] or [np.zeros(0, np.int64)]
    return np.unique(np.concatenate(parts))


def _counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw, begins = byte_stream(texts)
    parts = [np.unique(grams, return_counts=True) for grams, _ in gram_blocks(raw, begins)]
    return NUMBERS.merge(parts) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _gram_entries(chunk: int, known: list[bytes], other: list[bytes]) -> Iterator[dict]:
    keys, counts = _counted(known)
    more = np.setdiff1d(_distinct(other), keys, assume_unique=True)
    keys, counts = np.concatenate([keys, more]), np.concatenate([counts, np.zeros(len(more), np.int64)])
    number = slice_of(keys)
    order = np.lexsort([keys, number])
    starts = run_starts(number[order])
    for rows in np.split(order, starts[1:]) if len(order) else []:
        yield {"chunk": chunk, "slice": int(number[rows[0]]), "size": len(rows), "keys": NUMBERS.pack(keys[rows]), "counts": pack(counts[rows])}


def _word_entries(chunk: int, known: list[bytes], other: list[bytes]) -> Iterator[dict]:
    """Words of a chunk with their counts in training; the end is a word too. Slices from SLICES on are those of words."""
    counts: Counter[bytes] = Counter({END: len(known)})
    for text in known:
        counts.update(text.split(b" ") if text else ())
    for text in other:
        for word in text.split(b" ") if text else ():
            counts[word] += 0
    slices: dict[int, list[bytes]] = {}
    for word in counts:
        slices.setdefault(zlib.crc32(word) % SLICES, []).append(word)
    for number, words in slices.items():
        held = np.array([counts[w] for w in words], np.int64)
        yield {"chunk": chunk, "slice": SLICES + number, "size": len(words), "keys": WORDS.pack(words), "counts": pack(held)}


def chunk_documents(docs: DataFrame) -> DataFrame:
    """Rows of two sorts, written once: documents of a `chunk` (`ids`, `held_out`, packed `bodies`), and its entries.

    Reads `key`, `held_out` and `text` of `docs`.
    """
    key = docs.schema["key"].dataType
    schema = f"{ENTRY}, ids array<{key.simpleString()}>, held_out array<boolean>, bodies binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        size, kind = 0, None

        def rows(columns: dict, count: int) -> pa.RecordBatch:
            fields = {"chunk": pa.int64(), "slice": pa.int32(), "size": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}
            fields |= {"ids": pa.list_(kind), "held_out": pa.list_(pa.bool_()), "bodies": pa.binary()}
            made = [pa.array(columns[c], t) if c in columns else pa.nulls(count, t) for c, t in fields.items()]
            return pa.RecordBatch.from_arrays(made, names=list(fields))

        def closed() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(held), SENT):
                ids, out, bodies = zip(*held[at : at + SENT])
                packed = pack(np.frombuffer(END.join(bodies), np.uint8))
                yield rows({"chunk": [chunk], "ids": [ids], "held_out": [out], "bodies": [packed]}, 1)
            known, other = [r[2] for r in held if not r[1]], [r[2] for r in held if r[1]]
            for entries in (_gram_entries, _word_entries):
                made = list(entries(chunk, known, other))
                yield rows({c: [e[c] for e in made] for c in made[0]}, len(made))

        for batch in batches:
            kind = batch.schema.field(0).type
            for number, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                body = b" ".join(blank_words(text.as_py()))
                held.append((number, out, body))
                size += len(body) + DEPTH + 1
                if size >= CHUNK_BYTES:
                    yield from closed()
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield from closed()

    return cut_lineage(docs.select("key", "held_out", "text").mapInArrow(run, schema))


def _blobs(**columns: np.ndarray) -> dict[str, pa.Array]:
    return {c: pa.array([pack(v)], pa.binary()) for c, v in columns.items()}


def _one(table: pa.Table, name: str, kind: type = np.int64) -> np.ndarray:
    return unpack(table[name][0].as_py(), kind)


NODE = "top int, ids binary, zeros binary, ones binary, weight binary"


def _middle(table: pa.Table) -> pa.Table:
    """Nodes of CUT bytes of context in a slice, a row for each last byte of context."""
    level = levels_below(unpack_numbers(table["keys"][0].as_py()), _one(table, "counts"))[0]
    tops = level.ids >> (8 * CUT)
    rows = []
    for part in np.split(np.arange(len(tops)), run_starts(tops)[1:]):
        nodes = _blobs(ids=level.ids[part], zeros=level.zeros[part], ones=level.ones[part], weight=level.weight[part])
        rows.append(pa.table({"top": pa.array([int(tops[part[0]])], pa.int32())} | nodes))
    return pa.concat_tables(rows)


def _joined(table: pa.Table) -> tuple[Level, np.ndarray]:
    """All nodes of CUT bytes of context below one last byte, in order."""
    read = lambda c, kind: np.concatenate([unpack(b, kind) for b in table[c].to_pylist()])
    ids = read("ids", np.int64)
    order = np.argsort(ids, kind="stable")
    level = Level(ids[order], read("zeros", np.int64)[order], read("ones", np.int64)[order], None)
    level.weight = read("weight", np.float64)[order]
    return level


def _first(table: pa.Table) -> pa.Table:
    """Nodes with one byte of context."""
    level = _joined(table)
    for _ in range(CUT - 1):
        level = level.above()
    return pa.table({"node": level.ids & 255, "zeros": level.zeros, "ones": level.ones, "weight": level.weight})


def byte_model(counted: DataFrame) -> DataFrame:
    """`slice`, `keys` and `chances` (ln) of the merged byte strings."""
    middle = cut_lineage(counted.groupBy("slice").applyInArrow(_middle, NODE))
    first = middle.groupBy("top").applyInArrow(_first, "node bigint, zeros bigint, ones bigint, weight double")
    sums = first.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weight").alias("weight"))
    rows = sorted(map(tuple, sums.collect()))  # 255 at most
    node, zeros, ones, below = (np.array(c) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
    root = Level(node, zeros, ones, below)
    handed = root.predict(np.tile([0.0, 1.0, 0.5], (len(node), 1)))

    def down(table: pa.Table) -> pa.Table:
        third = _joined(table)
        second = third.above()
        first = second.above()
        state = first.predict(_states(first, root.ids, handed))
        state = second.predict(_states(second, first.ids, state))
        state = _states(third, second.ids, state)
        number = slice_of(third.ids >> 8 << (8 * (DEPTH + 1 - CUT)))
        order = np.lexsort([third.ids, number])
        tables = []
        for part in np.split(order, run_starts(number[order])[1:]):
            one = {"slice": pa.array([int(number[part[0]])], pa.int32())}
            tables.append(pa.table(one | _blobs(ids=third.ids[part], state=state[part])))
        return pa.concat_tables(tables)

    states = middle.groupBy("top").applyInArrow(down, "slice int, ids binary, state binary")

    def chances(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = np.concatenate([unpack(b, np.int64) for b in right["ids"].to_pylist()])
        state = np.concatenate([unpack(b, np.float64).reshape(-1, 3) for b in right["state"].to_pylist()])
        order = np.argsort(ids, kind="stable")
        found = ln_chances(unpack_numbers(left["keys"][0].as_py()), _one(left, "counts"), ids[order], state[order])
        return pa.table({"slice": left["slice"], "keys": left["keys"], "chances": pa.array([pack(found)], pa.binary())})

    return counted.groupBy("slice").cogroup(states.groupBy("slice")).applyInArrow(chances, "slice int, keys binary, chances binary")


def _told_grams(row: dict) -> Callable[[np.ndarray], tuple[bytes]]:
    known, chances = unpack_numbers(row["keys"]), unpack(row["chances"], np.float64)
    return lambda keys: (pack(chances[np.searchsorted(known, keys)]),)


def _told_words(row: dict) -> Callable[[list[bytes]], tuple[bytes]]:
    known, counts = unpack_words(row["keys"]), unpack(row["counts"], np.int64)
    return lambda keys: (pack(counts[places(keys, known)]),)


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `n_bytes`, `base_score`, `score`
    and `bits_per_byte`.

    `score` is the log10 probability of the text's bytes and its end by the weighted trees, `base_score` that of its
    tokens by add-one counts; both learn from the rows that are not held out. Null and empty texts are an end alone.
    Repeated rows are each learned from and each get their row; null ids are learned from. With nothing to learn from
    every choice has the chance 1/2. Columns other than id and text are not read.
    """
    picked = docs.select(F.col(doc_id).alias("key"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    rows = chunk_documents(picked)
    entries = rows.where("slice is not null").select("chunk", "slice", "size", "keys", "counts")
    grams, words = entries.where(F.col("slice") < SLICES), entries.where(F.col("slice") >= SLICES)
    model = byte_model(cut_lineage(merge_entries(grams, NUMBERS)))
    known = cut_lineage(merge_entries(words, WORDS))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [unpack(b, np.int64) for b in batch.column(0).to_pylist()]
            sums = [[int(h.sum()) for h in held], [int((h > 0).sum()) for h in held]]
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()) for s in sums], names=["n", "v"])

    whole = known.select("counts").mapInArrow(totals, "n bigint, v bigint").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    total, different = whole.n or 0, whole.v or 0
    told = answer_entries(grams, model, NUMBERS, "told binary", _told_grams)
    told = told.union(answer_entries(words, known, WORDS, "told binary", _told_words))
    unknown = math.log10(total + different + 1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = [t for b in left["bodies"].to_pylist() for t in unpack(b, np.uint8).tobytes().split(END)]
        grams, chances, counts = [], [], {}
        for number, keys, told in zip(*(right[c].to_pylist() for c in ("slice", "keys", "told"))):
            if number < SLICES:
                grams.append(unpack_numbers(keys))
                chances.append(unpack(told, np.float64))
            else:
                counts.update(zip(unpack_words(keys), unpack(told, np.int64).tolist()))
        find = Finder(np.concatenate(grams))
        values = np.concatenate(chances)[find.order] / math.log(10)
        out = np.zeros((5, len(texts)))
        raw, begins = byte_stream(texts)
        for found, text in gram_blocks(raw, begins):
            out[0] += np.bincount(text, values[find(found)], len(texts))
        for i, text in enumerate(texts):
            tokens = [*(text.split(b" ") if text else ()), END]
            c = np.fromiter(map(counts.__getitem__, tokens), np.int64, len(tokens))
            out[1:, i] = len(tokens), (c > 0).sum(), len(text) + 1, np.log10(c + 1).sum() - len(tokens) * unknown
        whole = lambda i: pa.array(out[i].astype(np.int64))
        columns = [pc.list_flatten(left["ids"]), pc.list_flatten(left["held_out"]), whole(1), whole(2), pa.array([total] * len(texts), pa.int64()), whole(3)]
        names = ["key", "held_out", "n_tokens", "n_known", "train_tokens", "n_bytes", "base_score", "score", "bits_per_byte"]
        return pa.table([*columns, pa.array(out[4]), pa.array(out[0]), pa.array(-out[0] * math.log2(10) / out[3])], names=names)

    bodies = rows.where("slice is null").select("chunk", "ids", "held_out", "bodies")
    kind = picked.schema["key"].dataType.simpleString()
    schema = f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, n_bytes bigint"
    schema += ", base_score double, score double, bits_per_byte double"
    scored = bodies.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, schema)
    return scored.withColumnRenamed("key", doc_id)

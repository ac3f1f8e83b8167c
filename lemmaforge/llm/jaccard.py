"""Exact Jaccard self-join of documents on word n-grams, with what set relations allow to skip.

A document's set is its distinct 64-bit shingle hashes. Equal sets are one class. Every class lists its prefix -
the shingles one of which any partner must share - in one global order, rare ones first; how rare is read from a
table of counts of fixed size over all shingles, which steers only the order. An index list is cut where sizes
part by more than the threshold, and lists of one entry go. Classes that share a list are gathered to chunks of
bounded size, each class shipped once, and compared by one product of their incidence matrices.

Gatherings larger than a chunk are where the skipping is. First every chunk is compared with itself. Then one set
of each component found so far stands for all of it, as its partners are its component's. Last, entries of a list
meet its blocks in other chunks; a block is skipped if it lies in the entry's own component, or if its best
position and least size leave too little overlap. No pair of documents leaves a task, only a forest of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaforge.llm.components import components
from lemmaforge.llm.near_vectors import _bounds, local_roots
from lemmaforge.llm.words import blank_word_hashes, free_name, mix
from lemmaforge.session import cut_lineage

WORDS = 5
PERCENT = 80
COUNTS = 1 << 21  # counters of the table of frequencies: 2 MB to each task
PIECE = 1 << 15  # counters in a row while they are summed
CHUNK = 512  # classes of a chunk at most
FEW = 6  # sets of a shingle up to which its pairs are counted one by one
CHUNK_SHINGLES = 2_000_000  # of a chunk, unless one class alone has more
WANTED_BITS = 1 << 26  # of the filter for texts that are compared, 8 MB; false hits only cost time

def shingle_sets(texts: list[str | None], width: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of `width` words in a row; of fewer words the whole; of none, none."""
    words, sizes = blank_word_hashes(texts)
    flat = np.concatenate([words, np.zeros(width, np.uint64)])
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    value = np.full(len(flat) - width, width, np.uint64)
    for k in range(width):
        value += flat[k : len(flat) - width + k] * factors[k]
    value, out, at = mix(value), [], 0
    for size in sizes.tolist():
        if size >= width or not size:
            own = value[at : at + max(0, size - width + 1)]
        else:
            own = mix((flat[at : at + size] * factors[:size]).sum(keepdims=True) + np.uint64(size))
        at += size
        own = np.sort(own)
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own)
    return out


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    return shingle_sets([text], width)[0]


def _slices(column: pa.Array, most: int = 1_000_000) -> Iterator[list[str | None]]:
    """Texts of a column, some characters at a time, so that arrays over their words stay small."""
    held, size = [], 0
    for text in column:
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for texts in _slices(column):
        yield from shingle_sets(texts, width)


def text_hashes(text: str | None) -> tuple[int, int]:
    """Two signed 64-bit hashes of a text."""
    return _signed((text or "").encode(), 0)


def _signed(data: bytes, seed: int) -> tuple[int, int]:
    import xxhash

    value = xxhash.xxh3_128_intdigest(data, seed=seed)
    return tuple(x - 2**64 if x >= 2**63 else x for x in (value & (2**64 - 1), value >> 64))


def set_hashes(own: np.ndarray, seed: int) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set."""
    return _signed(own.tobytes(), seed)


def prefix_size(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def _survey(width: int, counts: int, seed: int):
    """Documents to their set's size and hashes and their text's; at the end of a task its counts, piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "size", "c", "h", "t", "u", "piece", "counts"]
        table, seen, kind = np.zeros(counts, np.uint32), set(), None
        for batch in batches:
            kind, rows, new = batch.column(0).type, [], []
            for own, text in zip(_sets(batch.column(1), width), batch.column(1)):
                c, h = set_hashes(own, seed)
                rows.append((len(own), c, h, *text_hashes(text.as_py())))
                if len(own) and c not in seen:
                    seen.add(c)
                    new.append((own & np.uint64(counts - 1)).astype(np.int32))
                if len(new) > 1000:
                    np.add.at(table, np.concatenate(new), 1)
                    new = []
            if new:
                np.add.at(table, np.concatenate(new), 1)
            columns = [pa.array(list(x), pa.int64()) for x in (zip(*rows) if rows else [()] * 5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], names=names)
        if kind is not None:
            for i in range(0, counts, PIECE):
                part = table[i : i + PIECE]
                if part.any():
                    empty = [pa.nulls(1, pa.int64())] * 5
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), *empty, pa.array([i // PIECE], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=names)

    return run


def _sum_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a piece summed, as their logarithm in quarters, a byte each."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.frombuffer(counts.as_py(), np.uint32).astype(np.int64)
            sums[piece] = sums[piece] + own if piece in sums else own
    for piece, own in sums.items():
        level = np.round(4 * np.log2(np.maximum(own, 1))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["piece", "levels"])


def _post(width: int, percent: int, seed: int, shared):
    """Documents to the postings of their prefix: token, class, size, and how many shingles stand from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = shared.value, set()
        for batch in batches:
            tokens, classes, sizes, rests = [], [], [], []
            for own in _sets(batch.column(0), width):
                c = set_hashes(own, seed)[0]
                if not len(own) or c in seen:
                    continue
                seen.add(c)
                n = prefix_size(len(own), percent)
                # rare ones first; within a level by a number that has nothing to do with the counters' places
                level = levels[(own & np.uint64(len(levels) - 1)).astype(np.int32)].astype(np.uint64)
                order = level << np.uint64(56) | (own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(8)
                first = np.argpartition(order, n - 1)[:n] if n < len(own) else np.arange(n)
                tokens.append(own[first[np.argsort(order[first], kind="stable")]])
                classes.append(np.full(n, c, np.int64))
                sizes.append(np.full(n, len(own), np.int32))
                rests.append(len(own) - np.arange(n, dtype=np.int32))
            if tokens:
                flat = [np.concatenate(tokens).view(np.int64), *map(np.concatenate, (classes, sizes, rests))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in flat], names=["token", "c", "size", "rest"])

    return run


def _lists(percent: int):
    """Postings sorted by token and size to lists of at least two classes, each row with its list's first class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, last = ["token", "first", "c", "size", "rest"], None
        for batch in batches:
            token, c, size, rest = (batch.column(k).to_numpy() for k in ("token", "c", "size", "rest"))
            if last is not None:  # the last row of the batch before goes first again; `carried` says if it was written
                token, c, size, rest = (np.concatenate([[x], y]) for x, y in zip(last[:4], (token, c, size, rest)))
            same = (token[1:] == token[:-1]) & (c[1:] == c[:-1])  # a copy of the set from another task
            keep = np.concatenate([[True], ~same])
            token, c, size, rest = token[keep], c[keep], size[keep], rest[keep]
            joined = np.concatenate([[False], (token[1:] == token[:-1]) & (percent * size[1:].astype(np.int64) <= 100 * size[:-1].astype(np.int64))])
            start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(token))))
            first = c[start]
            carried = last is not None and last[5]
            if last is not None:
                first[start == 0] = last[4]
            member = joined | np.concatenate([joined[1:], [False]])
            if carried:
                member[0] = False
            if member.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[member]) for x in (token, first, c, size.astype(np.int32), rest.astype(np.int32))], names=names)
            written = bool(member[-1]) or (len(token) == 1 and carried)
            last = (token[-1], c[-1], size[-1], rest[-1], first[-1], written)

    return run


def _chunk(most: int, shingles_most: int):
    """Classes sorted by gathering to numbered chunks; a gathering begins a new chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, count, held, group = TaskContext.get().partitionId() << 32, 0, 0, None
        for batch in batches:
            out = []
            for g, size in zip(batch.column("g").to_pylist(), batch.column("size").to_pylist()):
                if g != group or count >= most or held + size > shingles_most:
                    number, count, held, group = number + 1, 0, 0, g
                count, held = count + 1, held + size
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "chunk"])

    return run


def _links_of(sets: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked sets; with two sides, pairs across them.

    Shingles of few sets add to the pairs of these one by one, those of many by products of incidence matrices.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    times = np.diff(np.concatenate([start, [len(flat)]]))
    shared = np.zeros(n * n, np.int64)
    for k in range(2, FEW + 1):
        held = owner[start[times == k][:, None] + np.arange(k)]
        for i in range(k):
            for j in range(i + 1, k):
                shared += np.bincount(held[:, i] * n + held[:, j], minlength=n * n) if len(held) > n else 0
                if 0 < len(held) <= n:
                    np.add.at(shared, held[:, i] * n + held[:, j], 1)
    shared = shared.reshape(n, n)
    start, times = start[times > FEW], times[times > FEW]
    if len(start):
        step = min(len(start), max(256, 4_000_000 // n))
        for at in range(0, len(start), step):
            own, many = start[at : at + step], times[at : at + step]
            rows = np.repeat(own - np.cumsum(many) + many, many) + np.arange(many.sum())
            part = np.zeros((n, len(own)), np.float32)
            part[owner[rows], np.repeat(np.arange(len(own)), many)] = 1
            if side.any():
                one, two = np.flatnonzero(side == 0), np.flatnonzero(side)
                found = np.zeros((n, n), np.int64)
                found[np.ix_(one, two)] = part[one] @ part[two].T
                shared += np.maximum(found, found.T)
            else:
                shared += (part @ part.T).astype(np.int64)
    # owners rise within a shingle, so the upper half is whole; 100 * shared >= percent * (a + b - shared)
    near = (100 + percent) * shared >= percent * (sizes[:, None] + sizes[None, :])
    near &= (side[:, None] != side[None, :]) if side.any() else True
    return np.nonzero(np.triu(near, 1))


def _compare(width: int, percent: int, key: list[str]):
    """Groups of texts, sorted by key, to links: a class, and a class it is connected with."""

    def group(rows: pa.Table) -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        sets = [s for part in rows.column("text").chunks for s in _sets(part, width)]
        a, b = _links_of(sets, rows.column("side").to_numpy(), percent)
        root = local_roots(len(sets), a, b)
        moved = np.flatnonzero(root != np.arange(len(root)))
        c = rows.column("c").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(c[moved]), pa.array(c[root[moved]])], names=["a", "b"]) if len(moved) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part]).combine_chunks()
            bounds = _bounds(held, key).tolist()
            for a, b in zip(bounds[:-2], bounds[1:-1]):
                if (found := group(held.slice(a, b - a))) is not None:
                    yield found
            held = held.slice(bounds[-2]) if len(bounds) > 1 else held
        if held is not None and (found := group(held)) is not None:
            yield found

    return run


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted classes with `text`, one row each. A filter of fixed size keeps other texts from moving.

    `wanted` has the hashes `t` and `u` of one text of each class, so no text is cut to words here, and copies go
    and classes come where their text already is: it moves once.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(WANTED_BITS // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) & np.uint64(WANTED_BITS - 1)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        for i in np.flatnonzero(bits.reshape(-1, PIECE).any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([bits[i * PIECE : (i + 1) * PIECE].tobytes()], pa.binary())], names=["piece", "bits"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, bits in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(bits.as_py(), np.uint8)
                sums[piece] = sums[piece] | own if piece in sums else own
        for piece, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["piece", "bits"])

    pieces = wanted.select("t").mapInArrow(mark, "piece int, bits binary").repartition("piece").mapInArrow(add, "piece int, bits binary")
    bits = np.zeros(WANTED_BITS // 8, np.uint8)
    for row in pieces.collect():
        bits[row.piece * PIECE : (row.piece + 1) * PIECE] = np.frombuffer(row.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = shared.value, set()
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(0)):
                t, u = text_hashes(text.as_py())
                place = t & (WANTED_BITS - 1)
                if held[place >> 3] >> (place & 7) & 1 and (t, u) not in seen:
                    seen.add((t, u))
                    at.append(i)
                    found.append((t, u))
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(0).take(pa.array(at, pa.int64()))], names=["t", "u", "text"])

    found = docs.select("text").where("text is not null").mapInArrow(pick, "t bigint, u bigint, text string")
    return cut_lineage(found.dropDuplicates(["t", "u"]).join(wanted, ["t", "u"]).drop("t", "u"))


def _numbered(classes: DataFrame, *order: str) -> DataFrame:
    """Classes with `chunk`, the members of a gathering `g` in the given order."""
    schema = classes.withColumn("chunk", F.lit(0).cast("bigint")).schema
    dealt = classes.repartitionByRange("g", *order, "c").sortWithinPartitions("g", *order, "c")
    return cut_lineage(dealt.mapInArrow(_chunk(CHUNK, CHUNK_SHINGLES), schema))


def _within(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links inside of chunks."""
    rows = texts.select("c", "chunk", "text", F.lit(0).alias("side"))
    dealt = rows.repartition("chunk").sortWithinPartitions("chunk", "c")
    return cut_lineage(dealt.mapInArrow(_compare(width, percent, ["chunk"]), "a bigint, b bigint"))


def _across(chunks: DataFrame, lists: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between classes of different chunks that meet in a list, where `component` does not already tell them.

    Blocks are a list's entries of one chunk, with the most shingles left at the token, the least size, and the
    component if they have but one. An entry goes only to chunks with a block it may link with.
    """
    entries = cut_lineage(lists.join(chunks.select("c", "chunk", "component"), "c"))
    blocks = entries.groupBy("token", "first", "chunk").agg(
        F.max("rest").alias("rest"), F.min("size").alias("size"), F.min("component").alias("x"), F.max("component").alias("y")
    )
    sure = F.when(F.col("x") == F.col("y"), F.col("x")).alias("sure")
    # a list has as many blocks as chunks: its entries by the chunk size
    met = blocks.groupBy("token", "first").agg(F.collect_list(F.struct("chunk", "rest", "size", sure)).alias("l")).where("size(l) > 1")
    pairs = entries.join(met, ["token", "first"]).withColumn("o", F.explode("l")).where("o.chunk <> chunk")
    fits = (100 + percent) * F.least("rest", "o.rest") >= percent * (F.col("size") + F.col("o.size"))
    told = F.coalesce(F.col("component") == F.col("o.sure"), F.lit(False))
    p, q = F.least("chunk", "o.chunk").alias("p"), F.greatest("chunk", "o.chunk").alias("q")
    sides = pairs.where(fits & ~told).select(p, q, (F.col("chunk") > F.col("o.chunk")).cast("int").alias("side"), "c").distinct()
    rows = cut_lineage(sides).join(texts, "c")
    dealt = rows.repartition("p", "q").sortWithinPartitions("p", "q", "c")
    return cut_lineage(dealt.mapInArrow(_compare(width, percent, ["p", "q"]), "a bigint, b bigint"))


def near_classes(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, int]:
    """Documents with their set's size and class `c`, the classes that are linked, with `component`, and the seed
    with which sets are numbered."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    seed, spark = 0, docs.sparkSession
    while True:
        schema = f"doc_id {kind}, size bigint, c bigint, h bigint, t bigint, u bigint, piece int, counts binary"
        survey = cut_lineage(docs.select("doc_id", "text").mapInArrow(_survey(width, COUNTS, seed), schema))
        ids = survey.where("piece is null").select("doc_id", "size", "c", "h", "t", "u")
        clash = ids.groupBy("c").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x <> y")
        if clash.isEmpty():
            break
        seed += 1  # two different sets have one number: number them anew
    levels = np.zeros(COUNTS, np.uint8)
    pieces = survey.where("piece is not null").select("piece", "counts").repartition("piece")
    for row in pieces.mapInArrow(_sum_pieces, "piece int, levels binary").collect():
        levels[row.piece * PIECE : (row.piece + 1) * PIECE] = np.frombuffer(row.levels, np.uint8)
    shared = spark.sparkContext.broadcast(levels)
    posted = docs.select("text").mapInArrow(_post(width, percent, seed, shared), "token bigint, c bigint, size int, rest int")
    dealt = posted.repartition("token").sortWithinPartitions("token", "size", "c")
    lists = cut_lineage(dealt.mapInArrow(_lists(percent), "token bigint, first bigint, c bigint, size int, rest int"))
    gathered = components(lists.select(F.col("first").alias("a"), F.col("c").alias("b")).where("a <> b").distinct())
    # a home: the list's first class that it meets most often
    homes = lists.groupBy("c", "size", "first").count().groupBy("c", "size").agg(F.max_by("first", F.struct("count", "first")).alias("home"))
    classes = cut_lineage(homes.join(gathered.select(F.col("id").alias("c"), F.col("component").alias("g")), "c"))
    chunks = _numbered(classes, "home")
    one_text = ids.where("size > 0").groupBy("c").agg(F.min(F.struct("t", "u")).alias("x"))
    texts = _texts_of(docs, chunks.select("c", "chunk").join(one_text, "c").select("c", "chunk", "x.t", "x.u"))
    links = _within(texts, width, percent)
    texts = texts.select("c", "text")
    large = chunks.groupBy("g").agg(F.min("chunk").alias("x"), F.max("chunk").alias("y")).where("x <> y").select("g")
    if not large.isEmpty():
        rest = cut_lineage(classes.join(large, "g", "left_semi"))
        own_lists = cut_lineage(lists.join(rest.select("c"), "c", "left_semi"))
        found = _with_component(rest, links)
        # where components of several classes meet, one set each stands for them: the smallest, first in every list
        first = found.groupBy("component").agg(F.min_by("c", F.struct("size", "c")).alias("c"), F.count("*").alias("n")).where("n > 1")
        few = _numbered(found.join(first.select("c"), "c", "left_semi"), "home")
        links = links.union(_within(few.select("c", "chunk").join(texts, "c"), width, percent)).union(_across(few, own_lists, texts, width, percent))
        told = _with_component(rest, links).select("c", "component")
        links = links.union(_across(chunks.select("c", "chunk").join(told, "c"), own_lists, texts, width, percent))
    return ids, components(links).select(F.col("id").alias("c"), "component"), seed


def _with_component(classes: DataFrame, links: DataFrame) -> DataFrame:
    known = components(links).select(F.col("id").alias("c"), "component")
    return cut_lineage(classes.join(known, "c", "left").withColumn("component", F.coalesce("component", "c")))


def near_documents(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: `doc_id`, `n_shingles` and `component_id`, the smallest id reachable by links.

    Two documents link when `percent` of the union of their sets is shared. Null and empty texts, and texts of
    white space, have an empty set and link with nothing. Repeated rows each get their row; null ids are never a
    component's smallest id. Only `doc_id` and `text` are read.
    """
    ids, linked, _ = near_classes(docs, width, percent)
    least = ids.where("size > 0").groupBy("c").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    least = least.join(linked, "c", "left").where("n > 1 or component is not null").withColumn("component", F.coalesce("component", "c"))
    least = cut_lineage(least)
    smallest = least.groupBy("component").agg(F.min("least").alias("component_id"))
    known = cut_lineage(least.join(smallest, "component").select("c", "component_id"))
    out = ids.withColumn("c", F.when(F.col("size") > 0, F.col("c"))).join(known, "c", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` without words, and of each group of near documents the one with the smallest id.

    Of rows with that id and equal sets one stays; null ids count as larger than all others.
    """
    ids, linked, seed = near_classes(docs, width, percent)
    own = ids.where("size > 0").join(linked, "c", "left").withColumn("component", F.coalesce("component", "c"))
    # the smallest id of a component, and the class that has it
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "c")
    mine, their_class, their_id = (free_name(n, docs.columns) for n in ("_own", "_c", "_d"))
    best = own.groupBy("component").agg(F.min(first).alias("f"))
    best = cut_lineage(best.select(F.col("f.c").alias(their_class), F.col("f.doc_id").alias(their_id)))
    schema = docs.withColumn(mine, F.lit(None).cast("bigint")).schema
    at = docs.columns.index("text")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch.column(at), width)
            classes = pa.array([set_hashes(s, seed)[0] if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, classes], names=[*batch.schema.names, mine])

    marked = docs.mapInArrow(number, schema).where(F.col(mine).isNotNull())
    kept = marked.join(best, (F.col(mine) == F.col(their_class)) & F.col("doc_id").eqNullSafe(F.col(their_id)), "left_semi")
    return kept.dropDuplicates([mine, "doc_id"]).select(*docs.columns).union(docs.where(F.coalesce("text", F.lit("")).rlike(r"^[ \t\n\x0B\f\r]*$")))

"""Near-duplicate vectors: cross-polytope hashes after fast Hadamard rotations, several probes, verified pairs.

Equal vectors of a label are one class, hashed once and counted with their number. A hash turns the vector three
times by random signs and a Hadamard transform and takes the largest coordinate with its sign; some hashes together
name a bucket of a table, and the second largest coordinates of the closest calls name the probed ones. A bucket is
compared in blocks of a bounded number of classes, every block with every other, so no task holds a whole hot
bucket. Pairs stay inside the task: a pair is counted in the first bucket that both share, and what leaves a
task is a count for each class and a forest of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaforge.llm.components import components
from lemmaforge.session import cut_lineage

LEAST_COSINE = 0.93
BLOCK = 1000  # classes of a bucket compared with as many others at a time
PROBES = 2  # buckets of a table besides the vector's own
FILL = 1000  # vectors for each value of a hash that a table is laid out for
KEPT_CHANCE = 0.79  # of a pair at the threshold for each hash of a table, probes included (measured, 64 coordinates)
RECALL = 0.99
TURNS = 3


def layout(rows: int, width: int, recall: float = RECALL) -> tuple[int, int]:
    """Hashes of a table and number of tables for so many vectors: buckets grow in number as the vectors do."""
    hashes = max(2, math.ceil(math.log(max(1, rows) / FILL) / math.log(2 * width)))
    return hashes, math.ceil(math.log(1 - recall) / math.log(1 - KEPT_CHANCE**hashes))


class Hasher:
    """Buckets of unit vectors. Only elementwise sums are used, so a vector has the same buckets in any batch."""

    def __init__(self, width: int, hashes: int, tables: int, probes: int = PROBES, seed: int = 11) -> None:
        self.padded = 1 << max(0, width - 1).bit_length()
        signs = np.random.default_rng(seed).integers(0, 2, (tables, hashes, TURNS, self.padded))
        self.signs = signs * 2.0 - 1
        self.hashes, self.tables, self.probes = hashes, tables, min(probes, hashes)

    def _turn(self, x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        for turn in signs:
            x = x * turn
            step = 1
            while step < self.padded:
                x = x.reshape(len(x), -1, 2, step)
                x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(-1, self.padded)
                step *= 2
            x = x / math.sqrt(self.padded)
        return x

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Shape (vectors, tables, 1 + probes): the own bucket and the probed ones."""
        x = np.pad(x, ((0, 0), (0, self.padded - x.shape[1])))
        every, rows = np.arange(len(x)), 2 * self.padded
        out = np.empty((len(x), self.tables, 1 + self.probes), np.int64)
        for t in range(self.tables):
            codes, moves, gaps = np.zeros(len(x), np.int64), [], []
            for k in range(self.hashes):
                turned = self._turn(x, self.signs[t, k])
                size = np.abs(turned)
                best = size.argmax(1)
                most = size[every, best].copy()
                size[every, best] = -1
                second = size.argmax(1) if self.padded > 1 else best
                value = [2 * i + (turned[every, i] < 0) for i in (best, second)]
                codes = codes * rows + value[0]
                moves.append((value[1] - value[0]) * rows ** (self.hashes - 1 - k))
                gaps.append(most - size[every, second])
            out[:, t, 0] = codes
            order = np.argsort(np.stack(gaps, 1), 1, kind="stable")
            for p in range(self.probes):
                out[:, t, 1 + p] = codes + np.stack(moves, 1)[every, order[:, p]]
        return out


def usable(vector: Column) -> Column:
    """Neither null nor empty, and every component a finite number, not all of them zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def unit_rows(column: pa.ListArray, width: int) -> np.ndarray:
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def local_roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member each of `size` members is linked to by the pairs a-b, over any number of links."""
    label = np.arange(size)
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    return label


def _pairs(sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs i < j inside each of many small groups."""
    first = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rest = np.repeat(starts + sizes, sizes) - first - 1
    a = np.repeat(first, rest)
    b = np.arange(rest.sum()) - np.repeat(np.cumsum(rest) - rest, rest) + a + 1
    return a, b


def _compare(rows: pa.Table, bounds: np.ndarray, width: int, least: float, hasher: Hasher) -> Iterator[pa.RecordBatch]:
    """Groups of rows, from each of `bounds` to the next, to counts and links."""
    x = unit_rows(rows.column("vector").combine_chunks(), width)
    numbers, sizes = rows.column("c").to_numpy(), rows.column("n").to_numpy()
    left, right, own, table, bucket = (rows.column(k).to_numpy() for k in ("p", "q", "own", "t", "bucket"))
    many, starts, found = np.diff(bounds), bounds[:-1], []
    small = many <= 64
    a, b = _pairs(many[small], starts[small])
    for i in range(0, len(a), 200_000):
        found.append((a[i : i + 200_000], b[i : i + 200_000]))
    for start, end in zip(starts[~small].tolist(), bounds[1:][~small].tolist()):
        cosine = x[start:end] @ x[start:end].T
        one, two = np.nonzero(np.triu(cosine >= least - 1e-9, 1))
        found.append((one + start, two + start))
    a, b = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]).astype(np.int64) for k in (0, 1))
    # of two blocks only pairs across them
    fit = (left[a] == right[a]) | (own[a] != own[b])
    a, b = a[fit], b[fit]
    near = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 100_000]], x[b[i : i + 100_000]]) >= least for i in range(0, len(a), 100_000)] or [np.zeros(0, bool)])
    a, b = a[near], b[near]
    if not len(a):
        return
    # the first bucket the two share is the one that counts the pair
    seen = np.unique(np.concatenate([a, b]))
    held = hasher.buckets(x[seen])
    mine = np.zeros(len(a), bool)
    for i in range(0, len(a), 20_000):
        one, two = held[np.searchsorted(seen, a[i : i + 20_000])], held[np.searchsorted(seen, b[i : i + 20_000])]
        shared = (one[:, :, :, None] == two[:, :, None, :]).any(3)  # (pairs, tables, buckets of one)
        at = shared.reshape(len(one), -1).argmax(1)
        first = one.reshape(len(one), -1)[np.arange(len(one)), at]
        # of several shared buckets in the first table, the least number
        best = np.where(shared, one, np.iinfo(np.int64).max)[np.arange(len(one)), at // shared.shape[2]].min(1)
        mine[i : i + 20_000] = (at // shared.shape[2] == table[a[i : i + 20_000]]) & (best == bucket[a[i : i + 20_000]]) & (first >= 0)
    a, b = a[mine], b[mine]
    links = np.zeros(len(x), np.int64)
    np.add.at(links, a, sizes[b])
    np.add.at(links, b, sizes[a])
    at = np.flatnonzero(links)
    root = local_roots(len(x), a, b)
    to = np.where(root[at] != at, numbers[root[at]], numbers[at])
    yield pa.RecordBatch.from_arrays([pa.array(numbers[at]), pa.array(to), pa.array(links[at])], names=["c", "to", "links"])


def near_vectors(
    vectors: DataFrame, least: float = LEAST_COSINE, block: int = BLOCK, recall: float = RECALL
) -> DataFrame:
    """One row per vector: `vec_id`, `n_links`, `component_id` and `kept`.

    Linked are vectors of one label (not null) and one length whose cosine is at least `least`. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing and are kept. Repeated rows are
    vectors of their own with the same id. A null id never is a component's smallest id and is not kept. Only
    `vec_id`, `embedding` and `label` are read.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("label"))
    good = F.col("label").isNotNull() & usable(F.col("vector"))
    hashes = [F.when(good, F.xxhash64(F.lit(k), "label", "vector")).alias(f"h{k}") for k in (1, 2)]
    ids = cut_lineage(rows.select("vec_id", *hashes))
    classes = rows.where(good).select("vec_id", "label", "vector", *hashes).groupBy("h1", "h2").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("n"), F.min("vec_id").alias("least")
    )
    classes = cut_lineage(classes.withColumn("c", F.monotonically_increasing_id()).withColumn("width", F.size("vector")))
    widths = {r.width: r["count"] for r in classes.groupBy("width").count().collect()}
    found = None
    for width, count in sorted(widths.items()):
        hasher = Hasher(width, *layout(count, width, recall))
        own = _links(classes.where(F.col("width") == width), width, hasher, least, block)
        found = own if found is None else found.union(own)
    if found is None:
        return ids.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = cut_lineage(found)
    groups = cut_lineage(components(found.select(F.col("c").alias("a"), F.col("to").alias("b"))))
    counts = found.groupBy("c").agg(F.sum("links").alias("links"))
    known = classes.select("c", "h1", "h2", "n", "least").join(counts, "c", "left").join(groups.withColumnRenamed("id", "c"), "c", "left")
    known = known.withColumn("component", F.coalesce("component", "c"))
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = cut_lineage(known.join(smallest, "component").select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    out = ids.join(known, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(classes: DataFrame, width: int, hasher: Hasher, least: float, block: int) -> DataFrame:
    """`c`, `to` (a smaller or the same class it is connected with) and `links`, some rows for each linked class."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = hasher.buckets(unit_rows(batch.column(1), width))
            each = buckets.shape[1] * buckets.shape[2]
            at = pa.array(np.repeat(np.arange(len(buckets)), each))
            tables = np.tile(np.repeat(np.arange(buckets.shape[1]), buckets.shape[2]), len(buckets))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(2).take(at), pa.array(tables, pa.int64()), pa.array(buckets.reshape(-1))],
                names=["c", "label", "t", "bucket"],
            )

    keys = classes.select("c", "vector", "label").mapInArrow(hashed, "c bigint, label string, t bigint, bucket bigint")
    keys = cut_lineage(keys.distinct() if hasher.padded == 1 else keys)
    shared = cut_lineage(keys.groupBy("label", "t", "bucket").count().where("count > 1"))
    blocks = F.ceil(F.col("count") / block).cast("int")
    rows = keys.join(shared, ["label", "t", "bucket"]).withColumn("own", F.pmod(F.xxhash64("c"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
    key = ["label", "t", "bucket", "p", "q"]
    rows = rows.select(*key, "own", "c").join(classes.select("c", "n", "vector"), "c")
    dealt = rows.repartition(*key).sortWithinPartitions(*key)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            bounds = _bounds(held, key)
            if len(bounds) > 2:  # the last group may go on in the next batch
                yield from _compare(held.slice(0, int(bounds[-2])), bounds[:-1], width, least, hasher)
                held = held.slice(int(bounds[-2])).combine_chunks()
        if held is not None:
            yield from _compare(held, _bounds(held, key), width, least, hasher)

    return dealt.mapInArrow(compare, "c bigint, to bigint, links bigint")


def _bounds(rows: pa.Table, key: list[str]) -> np.ndarray:
    """Where groups of equal keys start, and the end."""
    if not len(rows):
        return np.array([0])
    changed = np.zeros(len(rows) - 1, bool)
    for name in key:
        column = rows.column(name).combine_chunks()
        changed |= pc.not_equal(column.slice(1), column.slice(0, len(rows) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(changed) + 1, [len(rows)]])

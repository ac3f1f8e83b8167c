"""Centroid clustering of vectors with exact Walsh-Hadamard search.

Components become integers, so everything is exact. The Walsh-Hadamard transform of 64 integers is an integer
transform that keeps distances: the squared differences of all 64 coefficients add up to 64 times the squared distance.
Coefficients are in order of sequency, coarse ones first. The search adds up differences in blocks of growing size;
what is left of a distance lies between 0 and twice the energies both sides have left. A centroid is struck out once its
lower bound is above another one's upper bound, so never on a tie; the others are finished to all 64 coefficients.

Vectors are transformed and written once. A round reads them, and each batch sends the sums of coefficients per
centroid; those are at most 64 sums for each centroid, and back-transformed they are the sums of the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaforge.llm.words import sha256_hex
from lemmaforge.session import cut_lineage

WIDTH = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
BLOCKS = [0, 1, 2, 4, 8, 16, 32, 64]  # coefficients looked at, step by step
ROWS = 4096  # vectors of a batch
_NARROW = 1 << 24  # components up to this keep every sum within 64 bits
_LARGEST = 1 << 62  # components from here on have no place in a long


def hadamard(width: int = WIDTH) -> np.ndarray:
    """The Walsh-Hadamard matrix, its rows in order of their sign changes."""
    matrix = np.ones((1, 1), np.int64)
    while len(matrix) < width:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    return matrix[np.argsort(np.count_nonzero(np.diff(matrix), axis=1), kind="stable")]


_H = hadamard()


def _exact(columns: list) -> np.ndarray:
    """Rows of integers, in 64 bits where that is enough and as Python's integers else."""
    rows = np.array(columns, dtype=object).reshape(-1, WIDTH)
    return rows.astype(np.int64) if all(-_NARROW <= x <= _NARROW for x in rows.ravel()) else rows


def transform(rows: np.ndarray) -> np.ndarray:
    return rows.dot(_H.T if rows.dtype != object else _H.T.astype(object))


def restored(coefficients: list[int]) -> list[int]:
    """The vector that has these coefficients."""
    return [x // WIDTH for x in np.array([coefficients], dtype=object).dot(_H.astype(object))[0]]


def energies(coefficients: np.ndarray) -> np.ndarray:
    """What the coefficients from each step on weigh: one column for each entry of BLOCKS."""
    squares = coefficients * coefficients
    columns = [squares[:, at:].sum(axis=1) if at < WIDTH else np.zeros(len(squares), squares.dtype) for at in BLOCKS]
    return np.stack(columns, axis=1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each vector (the smaller one on a tie) and the squared distance.

    Both sides are coefficients. `BLOCKS[1:]` are the steps after which centroids are struck out.
    """
    left, right = energies(vectors), energies(centroids)
    found = np.zeros((len(vectors), len(centroids)), left.dtype)
    alive = np.ones(found.shape, bool)
    for step, (at, end) in enumerate(zip(BLOCKS, BLOCKS[1:]), 1):
        row, column = np.nonzero(alive)
        gap = vectors[row, at:end] - centroids[column, at:end]
        found[row, column] += (gap * gap).sum(axis=1)
        most = found + 2 * (left[:, step, None] + right[None, :, step])
        # upper bounds of those struck out still hold, but theirs are never the least
        alive &= found <= most.min(axis=1, keepdims=True)
    last = found.max() + 1 if found.size else 0
    number = np.where(alive, found, last).argmin(axis=1)
    return number, found[np.arange(len(found)), number] // WIDTH


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """`vec_id` and the coefficients of the kept vectors, written once.

    Kept are vectors of exactly 64 components, none null or non-finite, and each component's integer below 2^62.
    """
    double = F.col(column).cast("array<double>")
    kept = vectors.where(
        (F.size(column) == WIDTH) & F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < _LARGEST / SCALE))
    )
    whole = F.transform(double, lambda x: F.floor(x * SCALE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                rows = np.asarray(part.column(1).flatten()).reshape(-1, WIDTH)
                wide = np.abs(rows.astype(np.float64)).max(initial=0) > _NARROW
                out = transform(rows.astype(object) if wide else rows)
                if wide:
                    texts = [[str(x) for x in row] for row in out]
                    narrow = pa.nulls(len(out), pa.list_(pa.int64()))
                    columns = [part.column(0), narrow, pa.array(texts, pa.list_(pa.string()))]
                else:
                    offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * WIDTH)
                    columns = [part.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel())), pa.nulls(len(out), pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "narrow", "wide"])

    kind = vectors.schema[vec_id].dataType.simpleString()
    picked = kept.select(F.col(vec_id).alias("vec_id"), whole.alias("e"))
    return cut_lineage(picked.mapInArrow(run, f"vec_id {kind}, narrow array<bigint>, wide array<string>"))


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    """Coefficients of a batch."""
    narrow, wide = batch.column("narrow"), batch.column("wide")
    if not narrow.null_count:
        return np.asarray(narrow.flatten()).reshape(-1, WIDTH)
    rows = [w or n for n, w in zip(narrow.to_pylist(), wide.to_pylist())]
    return np.array([[int(x) for x in row] for row in rows], dtype=object).reshape(-1, WIDTH)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.slice(at, ROWS)
            rows = _rows(part)
            other = centroids if rows.dtype == centroids.dtype else centroids.astype(object)
            yield part, rows, *nearest(rows.astype(other.dtype), other)


def moved(vectors: DataFrame, centroids: np.ndarray) -> list[list[int]]:
    """Centroids after one round: the floor of the mean of the vectors nearest to each; those without any stay."""
    spectra = transform(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, number, _ in _assigned(batches, spectra):
            for k in np.unique(number):
                own = rows[number == k]
                sums = [str(x) for x in own.sum(axis=0)]
                fields = [pa.array([int(k)] * WIDTH, pa.int32()), pa.array(range(WIDTH), pa.int32()), pa.array(sums), pa.array([len(own)] * WIDTH, pa.int64())]
                yield pa.RecordBatch.from_arrays(fields, names=["cluster", "at", "sum", "n"])

    parts = vectors.select("narrow", "wide").mapInArrow(run, "cluster int, at int, sum string, n bigint")
    sums = parts.groupBy("cluster", "at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum("n").alias("n"))
    out, counts = {}, {}
    for row in sums.collect():  # 64 for each cluster at most
        out.setdefault(row.cluster, [0] * WIDTH)[row.at] = int(row["sum"])
        counts[row.cluster] = row.n
    made = centroids.tolist()
    for k, coefficients in out.items():
        made[k] = [total // counts[k] for total in restored(coefficients)]
    return made


def cluster_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "3:"
) -> DataFrame:
    """One row per kept vector: its id, `cluster`, `distance`, `cluster_inertia`, `inertia`, `centroid_sha256`.

    Left out are vectors that are null, of another width, with null or non-finite components, or with components whose
    integers pass 2^62. Centroids start as the vectors whose id, behind `seed`, has the smallest sha256; null ids stand as
    an empty text, repeated rows count each, and equal hashes go by the coefficients. With fewer vectors there are fewer
    centroids, and without any no rows. Distances and sums past 64 bits are null. Other columns are not read.
    """
    kept = integer_vectors(vectors, vec_id, column)
    hashed = kept.withColumn("_h", F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256))
    first = hashed.orderBy("_h", "narrow", "wide").limit(clusters).collect()
    made = [restored([int(x) for x in r.narrow or r.wide]) for r in first]
    for _ in range(rounds if made else 0):
        made = moved(kept, _exact(made))
    digests = [sha256_hex(",".join(map(str, c))) for c in made]
    last = transform(_exact(made)) if made else np.zeros((1, WIDTH), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, number, distance in _assigned(batches, last):
            fits = [int(d) if d < 1 << 63 else None for d in distance]
            digest = pa.array([digests[k] for k in number], pa.string())
            columns = [part.column("vec_id"), pa.array(number, pa.int32()), pa.array(fits, pa.int64()), digest]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "centroid_sha256"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    found = cut_lineage(kept.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint, centroid_sha256 string"))
    # one row for each cluster
    sums = found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.sum(F.col("distance").isNull().cast("int")).alias("lost")
    )
    rows = {r.cluster: None if r.lost else int(r.s) for r in sums.collect()}
    whole = None if None in rows.values() else sum(rows.values())
    fit = lambda x: F.lit(x if x is not None and x < 1 << 63 else None).cast("bigint")
    own = fit(None)
    for k, s in rows.items():
        own = F.when(F.col("cluster") == k, fit(s)).otherwise(own)
    out = found.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), fit(whole).alias("inertia"), "centroid_sha256")
    return out.withColumnRenamed("vec_id", vec_id)

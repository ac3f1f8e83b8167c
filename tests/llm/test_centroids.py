"""Centroids against the plain rounds on Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from lemmaforge.llm.centroids import BLOCKS, cluster_vectors, energies, hadamard, nearest, restored, transform


def plain(rows, clusters=8, rounds=10):
    kept = []
    for number, vector in rows:
        if vector is not None and len(vector) == 64 and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((number, [math.floor(1024 * x) for x in vector]))
    key = lambda r: hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    made = [v for _, v in sorted(kept, key=key)[:clusters]]

    def assign():
        out = []
        for number, v in kept:
            d, k = min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(made))
            out.append((number, v, k, d))
        return out

    for _ in range(rounds):
        groups = {}
        for _, v, k, _ in assign():
            groups.setdefault(k, []).append(v)
        for k, own in groups.items():
            made[k] = [sum(c) // len(own) for c in zip(*own)]
    last = assign()
    total = lambda k=None: sum(d for *_, c, d in last if k in (None, c))
    fit = lambda x: x if x < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in made]
    lost = {c for *_, c, d in last if fit(d) is None}
    return sorted(
        ((i, k, fit(d), None if k in lost else fit(total(k)), None if lost else fit(total()), digest[k]) for i, _, k, d in last), key=repr
    )


def compare(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as cluster", "2 as narrow", "3 as wide")
    got = sorted(map(tuple, cluster_vectors(df.repartition(3), **more).collect()), key=repr)
    assert got == plain(rows, **more)


def test_rounds(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=64) + 3 * (i % 5)).tolist()) for i in range(300)]
    odd = [None, [1.0] * 63, [1.0] * 65, [], [1.0] * 63 + [None], [math.nan] * 64, [math.inf] + [0.0] * 63]
    rows += [(1000 + i, v) for i, v in enumerate(odd)] + [(7, rows[7][1]), (None, [0.5] * 64), (2000, [0.0] * 64), (2001, [-0.0001] * 64)]
    compare(spark, rows)


def test_ties_few_rows_and_large_components(spark):
    compare(spark, [(i, [float(i % 3)] * 64) for i in range(20)], clusters=6, rounds=3)
    compare(spark, [(1, [0.5] * 64), (2, [0.25] * 64)])
    compare(spark, [(1, [1e9] * 64), (2, [-1e9] * 64), (3, [1.0] * 64), (4, [3e15] + [0.0] * 63)], clusters=2, rounds=2)
    none = spark.createDataFrame([(1, [1e300] * 64)], "vec_id bigint, embedding array<double>")
    assert cluster_vectors(none).collect() == [] == cluster_vectors(none.limit(0)).collect()


def test_transform_keeps_distances():
    h = hadamard()
    assert (h @ h.T == 64 * np.eye(64, dtype=np.int64)).all()
    changes = np.count_nonzero(np.diff(h), axis=1)
    assert changes.tolist() == list(range(64))
    x = np.random.default_rng(2).integers(-(1 << 24), 1 << 24, (2, 64))
    assert restored(transform(x)[0].tolist()) == x[0].tolist()
    gap = transform(x)[0] - transform(x)[1]
    assert (gap * gap).sum() == 64 * ((x[0] - x[1]) ** 2).sum()
    assert energies(transform(x)).shape == (2, len(BLOCKS))


@pytest.mark.parametrize("spread", [1, 40, 5000])
def test_search_is_exact_on_ties(spread):
    rng = np.random.default_rng(spread)
    vectors, centroids = rng.integers(-spread, spread + 1, (500, 64)), rng.integers(-spread, spread + 1, (8, 64))
    centroids[5] = centroids[2]
    vectors[:50] = centroids[rng.integers(0, 8, 50)]
    number, distance = nearest(transform(vectors), transform(centroids))
    full = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert number.tolist() == full.argmin(axis=1).tolist()
    assert distance.tolist() == full.min(axis=1).tolist()

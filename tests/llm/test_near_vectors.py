"""Links, components and recall against brute force."""

import math

import numpy as np
import pytest

from lemmaforge.llm.components import Forest, components
from lemmaforge.llm.near_vectors import Hasher, layout, local_roots, near_vectors


def plain(rows, least=0.93):
    """The same by comparing every vector with every other."""
    ok = []
    for v, e, label in rows:
        fine = label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)
        ok.append(np.array(e) / np.linalg.norm(e) if fine else None)
    forest, links = Forest(), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] is not None and ok[j] is not None and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= least:
                links[i] += 1
                links[j] += 1
                forest.link(j, i)
    smallest = {}
    for i, (v, *_) in enumerate(rows):
        if v is not None:
            r = forest.root(i)
            smallest[r] = min(v, smallest.get(r, v))
    out = []
    for i, (v, *_) in enumerate(rows):
        c = smallest.get(forest.root(i))
        out.append((v, links[i], c, v is not None and v == c))
    return sorted(out, key=repr)


def corpus():
    rng = np.random.default_rng(4)
    rows = []
    for g in range(40):
        base = rng.normal(size=24)
        for _ in range(rng.integers(1, 6)):
            rows.append((len(rows), (base + 0.1 * rng.normal(size=24)).tolist(), int(g % 3)))
    hot = rng.normal(size=24)
    rows += [(len(rows) + i, (hot + 0.05 * rng.normal(size=24)).tolist(), 1) for i in range(150)]
    rows += [(len(rows) + i, hot.tolist(), 1) for i in range(30)] + [(len(rows) + 30, (3 * hot).tolist(), 1)]
    rows += [(900, hot.tolist(), 2), (901, hot.tolist(), None), (902, None, 1), (903, [], 1), (904, [0.0] * 24, 1), (905, [None] + [1.0] * 23, 1)]
    rows += [(906, [math.nan] * 24, 1), (907, [math.inf] * 24, 1), (908, [1.0], 1), (909, [2.0], 1), (910, [-2.0], 1), (None, hot.tolist(), 1)]
    return [*rows, rows[0], rows[0]]


@pytest.mark.parametrize("block", [7, 1000])
def test_links_equal_brute_force(spark, block):
    rows = corpus()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr("*", "1 as n", "2 as bucket", "3 as c").repartition(3)
    got = sorted(map(tuple, near_vectors(df, block=block).collect()), key=repr)
    assert got == plain(rows)


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0
    one = spark.createDataFrame([(5, None, None)], "vec_id bigint, embedding array<float>, label int")
    assert [tuple(r) for r in near_vectors(one).collect()] == [(5, 0, 5, True)]


@pytest.mark.parametrize("count", [10_000, 10**9])
def test_recall_at_the_threshold(count):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(2, 1000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    hasher = Hasher(64, *layout(count, 64))
    a, b = hasher.buckets(x), hasher.buckets(0.93 * x + math.sqrt(1 - 0.93**2) * y)
    assert (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean() >= 0.97
    assert (hasher.buckets(x[:7]) == a[:7]).all()


def test_components(spark):
    rng = np.random.default_rng(2)
    for links in [rng.integers(0, 300, (200, 2)), np.stack([np.arange(120), np.arange(120) + 1], 1)]:
        links = rng.permutation(links).tolist()
        forest = Forest()
        for a, b in links:
            forest.link(a, b)
        want = sorted((x, forest.root(x)) for x in {v for a, b in links if a != b for v in (a, b)})
        df = spark.createDataFrame(links, "a bigint, b bigint").repartition(5)
        assert sorted(map(tuple, components(df).collect())) == want
    assert local_roots(5, np.array([0, 3, 1]), np.array([3, 4, 2])).tolist() == [0, 1, 1, 0, 0]

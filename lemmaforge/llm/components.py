"""Connected components of links, in Spark: forests within tasks first, then rounds of smallest labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaforge.session import cut_lineage


class Forest:
    """Union-find whose root is the smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, path = self.up, []
        while (parent := up.get(x, x)) != x:
            path.append(x)
            x = parent
        for p in path:
            up[p] = x
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task made stars around the smallest member; at most one link for each member."""
    for batch in batches:
        forest = Forest()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if a != b:
                forest.link(a, b)
        members = list(forest.up)
        roots = [forest.root(m) for m in members]
        yield pa.RecordBatch.from_arrays([pa.array(members, pa.int64()), pa.array(roots, pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """`id` and `component` of every id in the links `a`-`b` (bigint); the component is its smallest id.

    Each round every id takes the smallest label around it, then that label's own label (so labels travel twice as
    far each round), and links between equal labels go. Rounds are written, and end when no link is left.
    """
    links = cut_lineage(links.select("a", "b").where("a <> b").mapInArrow(_contract, "a bigint, b bigint"))
    # ids still open carry links between labels; `known` maps ids to labels found so far
    known = []
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("up"))
        least = cut_lineage(least)
        # pointer jumping: the label of my label
        over = least.select(F.col("a").alias("up"), F.col("up").alias("over"))
        jumped = cut_lineage(least.join(over, "up").select(F.col("a").alias("id"), F.col("over").alias("label")))
        known.append(jumped)
        one = links.join(jumped.select(F.col("id").alias("a"), F.col("label").alias("x")), "a")
        two = one.join(jumped.select(F.col("id").alias("b"), F.col("label").alias("y")), "b")
        links = cut_lineage(two.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct().mapInArrow(_contract, "a bigint, b bigint"))
    if not known:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    labels = known[-1]
    for earlier in reversed(known[:-1]):
        final = labels.select(F.col("id").alias("label"), F.col("label").alias("component"))
        moved = earlier.join(final, "label", "left").select("id", F.coalesce("component", "label").alias("label"))
        # labels of later rounds are themselves ids of this one
        labels = moved
    return labels.select("id", F.col("label").alias("component"))

"""Containment of nodes, by their numbers alone.

A node's subtree is the numbers from its `pre` to its `end`, so two subtrees are either apart or one in the other. Nodes
carry no ancestors. Whether something open stands above a node is a running maximum of ends; which one it is comes from a
stack, read off two windows: the height is a running sum of openings and closings, and the owner at a height is the last
one that opened there. Work and rows grow with the nodes and the pairs asked for, not with the depth of the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def below(condition: Column) -> Column:
    """Whether a node above this row's (not itself) meets the condition; the rows are all nodes of their records."""
    before = Window.partitionBy("rec_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.when(condition, F.col("end"))).over(before) >= F.col("pre"), F.lit(False))


def inside(nodes: DataFrame, **conditions: Column) -> DataFrame:
    """`nodes` with a flag for each condition: a node above meets it."""
    return nodes.withColumns({name: below(condition) for name, condition in conditions.items()})


def stack_join(inner: DataFrame, owners: DataFrame, name: str, every: bool = False, itself: bool = False) -> DataFrame:
    """Rows of `inner` with the number of the nearest owner above them, or with `every` once for each owner above.

    Both sides have `rec_id` and `pre`, owners have `end`. With `itself` an owner on the same node counts. Rows without
    an owner fall away; repeated owners count once, repeated rows of `inner` each. A column `name` is replaced.
    """
    inner = inner.drop(name)
    row = F.struct(*inner.columns).alias("_row")
    asks = inner.select("rec_id", F.col("pre").alias("_at"), F.lit(2 if itself else 0).alias("_turn"), F.lit(0).alias("_step"), F.lit(None).cast("int").alias("_own"), row)
    none = F.lit(None).cast(inner.select(row).schema["_row"].dataType).alias("_row")
    held = owners.select("rec_id", "pre", "end").dropDuplicates(["rec_id", "pre"])
    turns = F.explode(
        F.array(
            F.struct(F.col("pre").alias("_at"), F.lit(1).alias("_turn"), F.lit(1).alias("_step"), F.col("pre").alias("_own")),
            F.struct(F.col("end").alias("_at"), F.lit(3).alias("_turn"), F.lit(-1).alias("_step"), F.lit(None).cast("int").alias("_own")),
        )
    )
    line = asks.unionByName(held.select("rec_id", turns.alias("_t")).select("rec_id", "_t.*", none))
    order = ["_at", "_turn"]
    upto = Window.partitionBy("rec_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    asking = F.col("_row").isNotNull()
    line = line.withColumn("_height", F.sum("_step").over(upto)).filter((F.col("_own").isNotNull() | asking) & (F.col("_height") > 0))
    if every:
        heights = F.when(asking, F.sequence(F.lit(1).cast("bigint"), F.col("_height"))).otherwise(F.array("_height"))
        line = line.withColumn("_height", F.explode(heights))
    there = Window.partitionBy("rec_id", "_height").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = line.withColumn("_owner", F.last("_own", ignorenulls=True).over(there)).filter(asking)
    return found.select("_row.*", F.col("_owner").alias(name))


def nearest_above(rows: DataFrame, condition: Column, name: str) -> DataFrame:
    """`rows` with the number of the nearest of them above that meets the condition, null if there is none.

    As `stack_join`, where owners are rows of the same table: it is read once.
    """
    turn = F.explode(F.when(condition, F.array(F.lit(0), F.lit(1), F.lit(3))).otherwise(F.array(F.lit(0))))
    asks = F.col("_turn") == 0
    rest = [c for c in rows.columns if c not in ("rec_id", "pre", "end")]
    line = rows.withColumn("_turn", turn).withColumns({"_at": F.when(F.col("_turn") == 3, F.col("end")).otherwise(F.col("pre")), **{c: F.when(asks, F.col(c)) for c in rest}})
    order = ["_at", "_turn"]
    step = F.when(F.col("_turn") == 1, 1).when(F.col("_turn") == 3, -1).otherwise(0)
    line = line.withColumn("_height", F.sum(step).over(Window.partitionBy("rec_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    there = Window.partitionBy("rec_id", "_height").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("_turn") == 1, F.col("pre")), ignorenulls=True).over(there)
    found = line.filter("_turn < 3").withColumn(name, F.when(F.col("_height") > 0, owner)).filter(asks)
    return found.select(*[c for c in rows.columns if c != name], name)


def childless(nodes: DataFrame, condition: Column) -> DataFrame:
    """Nodes with none below them that meets the condition."""
    after = Window.partitionBy("rec_id").orderBy(F.col("pre").desc()).rowsBetween(Window.unboundedPreceding, -1)
    following = F.last(F.when(condition, F.col("pre")), ignorenulls=True).over(after)
    return nodes.withColumn("_next", following).filter(F.col("_next").isNull() | (F.col("_next") > F.col("end"))).drop("_next")


def heights(inner: DataFrame, owners: DataFrame, name: str) -> DataFrame:
    """Rows of `inner` with the number of owners above them."""
    inner = inner.drop(name)
    every = stack_join(inner.select("rec_id", "pre").distinct(), owners, "_owner", every=True)
    counts = every.groupBy("rec_id", "pre").agg(F.count(F.lit(1)).cast("int").alias(name))
    return inner.join(counts.hint("merge"), ["rec_id", "pre"], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def parents(wanted: DataFrame, nodes: DataFrame, value: Column, name: str, steps: int, kind: str = "string") -> DataFrame:
    """`wanted` (with `parent`) and an array `name`: `value` of its parent, grandparent and so on, `steps` at most."""
    up = nodes.select("rec_id", F.col("pre").alias("_up"), F.col("parent").alias("_over"), value.alias("_value"))
    out = wanted.withColumn("_up", F.col("parent")).withColumn(name, F.array().cast(f"array<{kind}>"))
    for _ in range(steps):
        out = out.join(up.hint("merge"), ["rec_id", "_up"], "left").drop("_up")
        out = out.withColumn(name, F.when(F.col("_value").isNotNull(), F.array_append(name, F.col("_value"))).otherwise(F.col(name)))
        out = out.withColumnRenamed("_over", "_up").drop("_value")
    return out.drop("_up")

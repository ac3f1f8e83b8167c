"""Ranks, running sums, top-k and medians that hold up under skewed groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1_000_000


def running_position(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str = "position",
    sums: dict[str, Column] | None = None,
    chunk: int = CHUNK_ROWS,
    stretch: Column | None = None,
) -> DataFrame:
    """1-based position of each row in its group, in order of a unique number.

    A group is cut into stretches of `chunk` order values. Row counts per
    stretch are added up first (a small table), so that the row window works
    on one stretch at a time and never on a whole group. `sums` adds running
    sums over the preceding rows of the group. `stretch` names the stretch of
    a row where the order is not a plain number; it must rise with the order.
    """
    sums = sums or {}
    cut = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)) if stretch is None else stretch)
    for label, expr in sums.items():
        cut = cut.withColumn(f"_v_{label}", expr.cast("bigint"))
    part = [*keys, "_chunk"]
    counts = cut.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(f"_v_{label}").alias(f"_s_{label}") for label in sums],
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *part,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[
            F.coalesce(F.sum(f"_s_{label}").over(before), F.lit(0)).alias(f"_s0_{label}")
            for label in sums
        ],
    )
    inside = Window.partitionBy(*part).orderBy(order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(offsets, part).withColumn(
        name, (F.col("_n0") + F.row_number().over(inside)).cast("bigint")
    )
    for label in sums:
        out = out.withColumn(
            label,
            (F.col(f"_s0_{label}") + F.coalesce(F.sum(f"_v_{label}").over(earlier), F.lit(0))).cast("bigint"),
        )
    extra = [f"{p}{label}" for label in sums for p in ("_v_", "_s0_")]
    return out.drop("_chunk", "_n0", *extra)


def with_previous(
    df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], stretch: Column, name: str = "prev"
) -> DataFrame:
    """Values of the row before, as a struct; stretch by stretch.

    The first row of a stretch takes the last row of the stretch before, from
    a table of one row per stretch.
    """
    cut = df.withColumn("_chunk", stretch)
    part = [*keys, "_chunk"]
    lasts = cut.groupBy(*part).agg(F.max_by(F.struct(*values), order).alias("_last"))
    carried = lasts.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk"))).drop("_last")
    inside = Window.partitionBy(*part).orderBy(order)
    return (
        cut.join(carried, part)
        .withColumn(name, F.coalesce(F.lag(F.struct(*values)).over(inside), F.col("_carry")))
        .drop("_chunk", "_carry")
    )


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """Q4: first k rows per group. Each task keeps k rows per group before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window).cast("bigint")).filter(F.col(name) <= k)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per group as a mergeable aggregate (no window, no sort)."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    return df.groupBy(*keys).agg(F.min_by(row, rank).alias("_row")).select(*keys, "_row.*")


def counted(df: DataFrame, keys: Sequence[str], value: str, count: str = "n") -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(count))


def sorted_counts(df: DataFrame, keys: Sequence[str], value: str, k: int | None = None) -> DataFrame:
    """Counts by value, commonest first, then by name; with k, the first k per group."""
    counts = counted(df, keys, value)
    order = [F.col("n").desc(), F.col(value).asc()]
    if k is None:
        return counts.orderBy(*keys, *order)
    return top_k(counts, keys, order, k)


def upper_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Q5: element n div 2 of the sorted values, found in the histogram of each group."""
    histogram = counted(df.filter(F.col(value).isNotNull()), keys, value)
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    reached = histogram.select(
        *keys,
        value,
        F.sum("n").over(upto).alias("_upto"),
        F.sum("n").over(whole).alias("_all"),
    ).filter(F.col("_upto") >= F.floor(F.col("_all") / 2) + 1)
    return reached.groupBy(*keys).agg(F.min(value).alias(name))


def first_seen(df: DataFrame, keys: Sequence[str], value: str, position: str) -> DataFrame:
    """Q8: distinct values of each group at the place they were first seen."""
    return df.groupBy(*keys, value).agg(F.min(position).alias(position))

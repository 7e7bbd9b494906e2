"""Dense positions inside groups of any size.

A window over a whole group puts the group into one task, which fails when one
group holds a large share of the rows. Positions are counted in two levels
instead: inside range partitions of the order, and over the partitions of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def _before(partition: list[str], *order: Column | str):
    return (
        Window.partitionBy(*partition)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def _dealt(df: DataFrame, group: list[str], order: list[Column | str], purpose: str) -> DataFrame:
    """The rows by range of (group, order), with their partition and place in it; written, as both must not change.

    In as many partitions as a shuffle starts from: put together by adaptive execution, a group of few bytes would be left to one task.
    """
    keys, conf = [*group, *order], df.sparkSession.conf
    parts = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or conf.get("spark.sql.shuffle.partitions")
    dealt = df.repartitionByRange(int(parts), *keys).sortWithinPartitions(*keys)
    return written(dealt.withColumn("__at", F.monotonically_increasing_id()), purpose).withColumns(
        {"__part": F.shiftright("__at", 33), "__row": F.col("__at").bitwiseAND((1 << 33) - 1)}
    )


def _with_offsets(rows: DataFrame, starts: DataFrame, group: list[str], offset: Column) -> DataFrame:
    """Adds __offset, a function of what the group has in earlier partitions, to the rows of each (partition, group)."""
    offsets = starts.select(
        F.col("__part").alias("__in_part"), *(F.col(g).alias(f"__of_{k}") for k, g in enumerate(group)),
        offset.alias("__offset"),
    )
    same = F.col("__part") == F.col("__in_part")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__of_{k}"))
    return rows.join(offsets, same)


def positions(df: DataFrame, group: list[str], order: list[Column | str], target: str) -> DataFrame:
    """1-based position of each row by `order` within its group, as a distributed prefix sum.

    Rows are dealt by range of (group, order) and sorted, so a partition holds consecutive rows whatever the order
    values are and however many rows a group has. What precedes a row in its group is what precedes it in its
    partition, plus the group's rows in earlier partitions: counts per (partition, group) and a running sum over the
    partitions that a group spans. The dealt rows are written once, since partition numbers must not change between
    the two reads; a lost executor costs a read. Rows that tie on `order` get distinct positions, one after the
    other; rows that must be told apart need another order column. Nulls in `group` are a group, nulls in `order`
    come first. An empty table gives no rows.
    """
    dealt = _dealt(df, group, order, "positions")
    starts = dealt.groupBy("__part", *group).agg(F.min("__row").alias("__start"), F.count(F.lit(1)).alias("__n"))
    earlier = F.coalesce(F.sum("__n").over(_before(group, "__part")), F.lit(0))
    placed = _with_offsets(dealt, starts, group, earlier - F.col("__start"))
    return placed.withColumn(target, (F.col("__row") + F.col("__offset") + 1).cast("bigint")).select(*df.columns, target)


def prefix_sums(df: DataFrame, group: list[str], order: list[Column | str], weight: str, target: str) -> DataFrame:
    """Sum of `weight` up to and with each row by `order` within its group: `positions` for rows that count unequally.

    Running sums inside a (partition, group), which is never more than a partition, and sums of the group's earlier
    partitions, by the same exchange. Rows that tie on `order` are summed one after the other.
    """
    dealt = _dealt(df, group, order, "prefix-sums")
    starts = dealt.groupBy("__part", *group).agg(F.sum(weight).alias("__n"))
    inside = Window.partitionBy("__part", *group).orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    running = dealt.withColumn("__run", F.sum(weight).over(inside))
    summed = _with_offsets(running, starts, group, F.coalesce(F.sum("__n").over(_before(group, "__part")), F.lit(0)))
    return summed.withColumn(target, (F.col("__run") + F.col("__offset")).cast("bigint")).select(*df.columns, target)


def tie_digest(c: Column | str) -> Column:
    """Even, engine-independent order among rows that are otherwise equal."""
    return F.md5((F.col(c) if isinstance(c, str) else c).cast("string"))

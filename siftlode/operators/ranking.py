"""Ranks within groups of any size, without one task per group.

A window partitioned by the group puts a hot group into one task. Here the rows are range-partitioned
by (group, order), so that a hot group spreads over many tasks; each task numbers its own rows, and the
count of rows that stand in earlier tasks is added from a table of (task, group) counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlode.plans.runtime import cut, parallelism


#: Rows of one group up to which a group is ordered within a task.
TASK_ROWS = 1_000_000


def has_wide_group(rows: DataFrame, group: str, most: int = TASK_ROWS) -> bool:
    """Whether any group has more than ``most`` rows, so that it must not be ordered within one task. One count per group, of one column."""
    return bool(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).limit(1).count())


def spread_rank(df: DataFrame, group: list[str], order: list[Column], out: str, ties: bool = True) -> DataFrame:
    """Add ``out``: the 1-based place of each row in its group by ``order``.

    ``ties=True`` gives equal rows the same place (competition ranking); ``ties=False`` numbers all rows,
    for which ``order`` must be total if the result shall not depend on chance. Null order values sort as
    the given columns say. An empty frame stays empty. Columns named ``_pid``, ``_local``, ``_n``,
    ``_before`` are reserved. Every group column is compared null-safe (a null group is a group).
    """
    spark = df.sparkSession
    keyed = df.repartitionByRange(parallelism(spark), *[F.col(g) for g in group], *order)
    # the task ids are used twice below, so they are fixed in the shared folder first
    placed = cut(keyed.withColumn("_pid", F.spark_partition_id()))
    counts = placed.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_n"))
    prior = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_pid", *group, F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_pid", *group).orderBy(*order)
    local = placed.withColumn("_local", (F.rank() if ties else F.row_number()).over(own))
    b = before.select(*[F.col(c).alias(f"_b_{c}") for c in ["_pid", *group]], "_before")
    on = F.lit(True)
    for c in ["_pid", *group]:
        on = on & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    return (
        local.join(b, on)
        .withColumn(out, (F.col("_local") + F.col("_before")).cast("long"))
        .select(*df.columns, out)
    )


def spread_sum(df: DataFrame, group: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group that stand before the row by ``order``; 0 for the first.

    Works as :func:`spread_rank`, so that one group may be of any size. ``order`` must be total. Null values count as 0.
    """
    spark = df.sparkSession
    keyed = df.repartitionByRange(parallelism(spark), *[F.col(g) for g in group], *order)
    placed = cut(keyed.withColumn("_pid", F.spark_partition_id()))
    sums = placed.groupBy("_pid", *group).agg(F.coalesce(F.sum(value), F.lit(0)).alias("_n"))
    prior = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*[F.col(c).alias(f"_b_{c}") for c in ["_pid", *group]], F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum(value).over(own), F.lit(0)))
    on = F.lit(True)
    for c in ["_pid", *group]:
        on = on & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    return local.join(before, on).withColumn(out, F.col("_local") + F.col("_before")).select(*df.columns, out)

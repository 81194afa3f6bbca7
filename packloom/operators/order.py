"""Numbers and running sums in a total order, without bringing a whole group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packloom.operators.saving import saved


def number_rows(rows: DataFrame, group: str, order: str, name: str = "seq") -> DataFrame:
    """Add ``name``: 1, 2, 3… within each ``group`` by ``order`` (unique within the group).

    Rows are range-partitioned by (group, order), so a large group spans many partitions.  Their
    places are saved, because range bounds are sampled and may not come out the same twice.
    Counts per group and partition, a small table, then give every partition its offset.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = saved(
        rows.repartitionByRange(partitions, group, order)
        .sortWithinPartitions(group, order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
    )
    runs = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # At most one run per partition in each group, so this window stays small.
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return (
        placed.join(offsets, [group, "_part"])
        .withColumn(name, F.col("_at") + F.col("_shift") + 1)
        .select(*rows.columns, name)
    )


def running_sums(rows: DataFrame, group: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add, for each new name in ``sums``, the sum of its column over the rows of the ``group`` that come before.

    ``order`` is a total order within the group.  As in :func:`number_rows`, rows are placed by
    range partitions, which are saved; the sums per group and partition give every partition its
    start, and within a partition a window adds up what is a bounded number of rows.  ``rows``
    should be narrow: they are written once and shuffled twice.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = saved(
        rows.repartitionByRange(partitions, group, *order)
        .sortWithinPartitions(group, *order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
    )
    zero = F.lit(0).cast("bigint")
    totals = placed.groupBy(group, "_part").agg(*[F.sum(c).alias(f"_total_{n}") for n, c in sums.items()])
    # At most one row per partition in each group, so this window stays small.
    above = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(group, "_part", *[F.coalesce(F.sum(f"_total_{n}").over(above), zero).alias(f"_start_{n}") for n in sums])
    inside = Window.partitionBy(group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(starts, [group, "_part"])
        .withColumns({n: F.col(f"_start_{n}") + F.coalesce(F.sum(c).over(inside), zero) for n, c in sums.items()})
        .select(*rows.columns, *sums)
    )

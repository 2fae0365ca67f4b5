"""Ranks and running totals within groups, none of which has to fit one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.session import staged


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[Column], weight: Column, name: str, partitions: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``weight`` over the rows of the group that come before this one in ``order``.

    The rows are range-partitioned by group and order and written once; a group that holds a third of all rows is thereby cut
    into many parts. Sums per part are tiny; their running totals are the offsets from which each part counts on.
    ``order`` must be total within a group, else equal rows are ordered at will. An empty table gives an empty table.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = staged(df.withColumn("_w", weight).repartitionByRange(n, *[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sums = parts.groupBy(*group, "_part").agg(F.sum("_w").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # Null-safe join: null is a group like any other.
    left, right = parts.alias("l"), offsets.alias("r")
    on = F.col("l._part") == F.col("r._part")
    for g in group:
        on = on & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    joined = left.join(right, on).select("l.*", "r._offset")
    return joined.withColumn(name, F.col("_offset") + F.coalesce(F.sum("_w").over(within), F.lit(0))).drop("_w", "_part", "_offset")

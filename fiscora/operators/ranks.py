"""Ranks inside groups without a window for each group: a range partitioning, the rows of each group in
each part counted, and the counts of the parts before added. A group with a third of all rows is spread
over as many parts as its rows fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscora.sources.scratch import materialised


def ranked(rows: DataFrame, group: str, order: list[Column | str], rank: str = "rank") -> DataFrame:
    """rows with `rank`, from 1 on, of each in its group by `order`. Ties are ranked as they come; a null
    group is one group."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ("_part", "_at", "_from", "_shift")
    ranged = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    numbered = materialised(ranged.select("*", F.spark_partition_id().alias("_part"), (F.monotonically_increasing_id() % (1 << 33)).alias("_at")), "ranged")
    held = numbered.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_group").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    # A row for each group of each part: as many as parts and groups together.
    shifts = held.select("_group", "_p", (F.coalesce(before, F.lit(0)) - F.col("_from") + 1).alias("_shift"))
    joined = numbered.join(shifts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(rank, F.col("_at") + F.col("_shift")).drop("_group", "_p", *names)

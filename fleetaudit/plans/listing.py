"""Global order without a single task: O1, the sorted package list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetaudit.session import written


def positioned(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with ``position``, its place (from 1) in ascending order of ``keys`` over the whole table.

    Rows are range-partitioned and sorted; a row's position is its place in its partition plus the
    rows of the partitions before.  The only window runs over one row per partition.
    """
    placed = written(
        written(df, "unordered")  # the sampling of the ranges and the sort read the rows, they don't compute them twice
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}),
        "ordered",
    )
    runs = placed.groupBy("_part").agg(F.min("_at").alias("first"), F.count("*").alias("n"))
    shift = F.sum("n").over(Window.orderBy("_part")) - F.col("n") - F.col("first")
    offsets = written(runs.select("_part", shift.alias("shift")), "offsets")
    return placed.join(offsets, "_part").withColumn("position", F.col("_at") + F.col("shift") + 1).drop("_part", "_at", "shift")


def package_list(resolved: DataFrame) -> DataFrame:
    """O1: every package of every project's graph once, sorted: position, ecosystem, name."""
    names = resolved.select("ecosystem", "name").distinct()
    return positioned(names, "ecosystem", "name").select("position", "ecosystem", "name")

"""Places of rows in an order, by group, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gravelsift.llm.common import broadcast_if_small, materialize, parallelism


def numbered(rows: DataFrame, group: list[str], order: list[str], label: str, place: str = "_place", total: str = "_total") -> DataFrame:
    """rows with their place (from 0) in the order within their group, and the group's rows. Nulls come first and are a group.

    Rows are sorted by ranges of (group, order) and written with their range and place there; a range's rows of a group
    are counted, and the counts before a range, a row for each range and group, are added. So a group that holds a third
    of all rows is as many ranges as a third of all tasks. Rows that are equal in all of `order` share a range; their
    places follow from nothing else. rows should be narrow: they are sorted and written once.
    """
    spark = rows.sparkSession
    ranges = rows.repartitionByRange(parallelism(spark), *group, *order).sortWithinPartitions(*group, *order)
    ranges = ranges.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    written, _ = materialize(ranges, label)
    spans = written.groupBy("_range", *group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    w = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("_range", *group, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias(total))
    spans, _ = materialize(spans, f"{label}-spans")  # a row for each range, and one more for each group
    spans = spans.select(F.col("_range").alias("_r"), "_shift", total, *(F.col(c).alias(f"_g{k}") for k, c in enumerate(group)))
    same = F.col("_range") == F.col("_r")
    for k, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{k}"))
    return written.join(broadcast_if_small(spans), same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(place), total)

"""Places in a total order, by ranges: no task sees more than a range of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trove.sources.storage import stored


def numbered(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """rows with their place, from 1, in a total order. Rows are dealt by ranges; a range's first place is the sum of those before."""
    keyed = rows.withColumn("_key", F.struct(*order))
    dealt = stored(keyed.repartitionByRange("_key").withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")  # a row a range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_key"))
    return dealt.withColumn("_inside", inside).join(F.broadcast(sizes), "_range").withColumn(name, F.col("_before") + F.col("_inside")).select(*rows.columns, name)


def group_order(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """rows with group_place, the place of their group by its first member, and member_place inside the group."""
    keyed = rows.withColumn("_order", F.struct(*order))
    groups = numbered(keyed.groupBy(group).agg(F.min("_order").alias("_first")), F.col("_first"), name="group_place").drop("_first")
    member = F.row_number().over(Window.partitionBy(group).orderBy("_order"))
    return keyed.withColumn("member_place", member).join(groups.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group"))).select(*rows.columns, F.col("group_place").cast("long").alias("group_place"), "member_place")

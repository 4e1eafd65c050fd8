"""Global order without a single-task window.

Rows are dealt by ranges of their order and written once, sorted, to the shared scratch folder. What
needs a range's rows and what needs its totals then read the same files, so both see the same ranges;
planned twice, a range partitioning may sample different bounds each time. The functions here run
that one job when they are called; what they return is lazy as usual. Per range one row (a count,
a sum, an end) meets the others; that table is as long as the session's shuffle width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.plans.scratch import scratch


def in_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` written in ranges of `order`, with the range's number in _part and the row's number inside it, from 0, in _row. Ties stay in one range."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*order)
    path = scratch(spark, "ranges")
    dealt.write.option("maxRecordsPerFile", 0).parquet(path)  # one file a range
    return spark.read.schema(dealt.schema).parquet(path).select("*", F.col("_metadata.row_index").alias("_row"))


def rank_rows(rows: DataFrame, *order: str, name: str = "position", start: int = 1) -> DataFrame:
    """`rows` numbered in global order: the row's number in its range's file plus the rows of earlier ranges. The order costs one shuffle and no window over the rows."""
    dealt = in_ranges(rows, *order)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = dealt.join(counts.select("_part", before.alias("_before")), "_part")
    return out.withColumn(name, (F.col("_before") + F.col("_row") + F.lit(start)).cast("long")).drop("_part", "_row", "_before")


def neighbour(rows: DataFrame, key: str, found: Column, after: bool, name: str) -> DataFrame:
    """`rows` with, in `name`, the nearest non-null `found` strictly after (or before) each row in order of `key`.

    Both directions use a frame that only grows at its end, so a range costs its length.
    """
    dealt = in_ranges(rows.withColumn("_found", found), key)
    inside, across, edge = (F.desc(key), F.desc("_part"), F.min) if after else (F.asc(key), F.asc("_part"), F.max)
    near = F.last("_found", ignorenulls=True).over(Window.partitionBy("_part").orderBy(inside).rowsBetween(Window.unboundedPreceding, -1))
    edges = dealt.groupBy("_part").agg(edge("_found").alias("_edge"))  # one row a range
    far = F.last("_edge", ignorenulls=True).over(Window.orderBy(across).rowsBetween(Window.unboundedPreceding, -1))
    out = dealt.withColumn("_near", near).join(edges.select("_part", far.alias("_far")), "_part")
    return out.withColumn(name, F.coalesce("_near", "_far")).drop("_part", "_row", "_near", "_far", "_found")


def sum_before(points: DataFrame, asked: DataFrame) -> DataFrame:
    """(at, total): for each asked `at`, the sum of `amount` over points (at, amount) strictly before it.

    Points and questions are merged in order, so nothing is compared pair by pair.
    """
    merged = points.select("at", F.col("amount").cast("long").alias("amount"), F.lit(0).alias("q")).union(asked.select("at", F.lit(0).cast("long"), F.lit(1)))
    dealt = in_ranges(merged.groupBy("at").agg(F.sum("amount").alias("amount"), F.max("q").alias("q")), "at")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("_in", F.sum("amount").over(Window.partitionBy("_part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)))
    sums = dealt.groupBy("_part").agg(F.sum("amount").alias("_sum"))  # one row a range
    earlier = sums.select("_part", F.sum("_sum").over(before.orderBy("_part")).alias("_before"))
    total = F.coalesce("_in", F.lit(0)) + F.coalesce("_before", F.lit(0))
    return inside.join(earlier, "_part").filter("q = 1").select("at", total.cast("long").alias("total"))

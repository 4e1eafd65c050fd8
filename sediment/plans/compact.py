"""Compaction: which versions a merged run keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sediment.operators.log import DELETE
from sediment.plans.planner import overlap_sums


def merge_runs(*runs: DataFrame) -> DataFrame:
    """Sorted runs as one log; nothing is dropped."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


def compact(log: DataFrame, oldest_snapshot: int, deeper: DataFrame | None = None, drop_predicate=None) -> DataFrame:
    """The rows that a compaction of `log` keeps.

    Every version newer than the oldest snapshot stays, and of the others the newest of each key, unless
    that is a delete which no deeper file can still need: `deeper` (smallest_key, largest_key) are the files below the output
    level, and without any the output is the base level. `drop_predicate` turns puts that a caller no longer wants into deletes first, so
    that nothing older shows in their place.
    """
    by_age = Window.partitionBy("key", "_old").orderBy(F.desc("seq"), F.desc("kind"))
    marked = log.withColumn("_old", F.col("seq") <= F.lit(oldest_snapshot))
    kept = marked.withColumn("_age", F.row_number().over(by_age)).filter(~F.col("_old") | (F.col("_age") == 1))
    idle = F.col("_old") & (F.col("kind") == DELETE)
    if drop_predicate is not None:
        gone = F.coalesce(F.col("_old") & drop_predicate, F.lit(False))
        kept = kept.withColumns({"kind": F.when(gone, F.lit(DELETE).cast("tinyint")).otherwise(F.col("kind")), "value": F.when(~gone, F.col("value"))})
    if deeper is None:
        return kept.filter(~idle).drop("_old", "_age")
    stones = kept.filter(idle).select(F.col("key").alias("low"), F.col("key").alias("high")).distinct()
    needed = overlap_sums(deeper, stones, F.lit(1)).filter("total > 0").select(F.col("low").alias("key"), F.lit(True).alias("_needed"))
    return kept.join(needed, "key", "left").filter(~idle | F.col("_needed")).select(*log.columns)

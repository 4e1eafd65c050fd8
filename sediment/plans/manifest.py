"""Versions of the file set: an append-only edit log, its fold, and checks over the folded state.

edits: edit_id, log_number, prev_log_number, next_file_number, last_sequence, comparator (nullable),
added: array<struct<level, file_number, file_size, smallest_key, largest_key>>,
deleted: array<struct<level, file_number>>. Within an edit deletions come first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COUNTERS = ("log_number", "prev_log_number", "next_file_number", "last_sequence")


def fold_counters(edits: DataFrame) -> DataFrame:
    """One row: the last non-null value of each counter in edit order."""
    have = [c for c in (*COUNTERS, "comparator") if c in edits.columns]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("edit_id"))).alias(c) for c in have]
    return edits.agg(*last)


def live_files(edits: DataFrame, version: int | None = None) -> DataFrame:
    """Files of the version after edit `version` (default: the last): the newest action on each (level, file_number) is an addition."""
    seen = edits if version is None else edits.filter(F.col("edit_id") <= version)
    gone = seen.select("edit_id", F.lit(0).alias("_add"), F.explode("deleted").alias("f")).select("edit_id", "_add", "f.level", "f.file_number", *[F.lit(None).cast(t).alias(c) for c, t in _details(edits)])
    come = seen.select("edit_id", F.lit(1).alias("_add"), F.explode("added").alias("f")).select("edit_id", "_add", "f.level", "f.file_number", *[f"f.{c}" for c, _ in _details(edits)])
    best = F.max(F.struct("edit_id", "_add", *[c for c, _ in _details(edits)])).alias("b")
    return gone.union(come).groupBy("level", "file_number").agg(best).filter("b._add = 1").select("level", "file_number", *[f"b.{c}" for c, _ in _details(edits)])


def _details(edits: DataFrame) -> list[tuple[str, object]]:
    return [(f.name, f.dataType) for f in edits.schema["added"].dataType.elementType.fields if f.name not in ("level", "file_number")]


def pinned_files(edits: DataFrame, versions: list[int]) -> DataFrame:
    """Distinct files of several versions that readers still hold."""
    out = None
    for v in versions:
        part = live_files(edits, v).select("level", "file_number")
        out = part if out is None else out.union(part)
    return out.distinct()


def garbage(listing: DataFrame, live: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """Listed file numbers that are neither live nor pending."""
    keep = live.select("file_number")
    if pending is not None:
        keep = keep.union(pending.select("file_number"))
    return listing.join(keep, "file_number", "left_anti")


def missing(live: DataFrame, listing: DataFrame) -> DataFrame:
    """Live files that are not listed."""
    return live.join(listing.select("file_number"), "file_number", "left_anti")


def check(files: DataFrame, next_file_number: int) -> DataFrame:
    """Problems of a file set: number not below the counter, number used twice, overlapping ranges in a level from 1 on."""
    beyond = files.filter(F.col("file_number") >= next_file_number).select("level", "file_number", F.lit("number not allocated").alias("problem"))
    twice = files.groupBy("file_number").agg(F.min("level").alias("level"), F.count("*").alias("n")).filter("n > 1").select("level", "file_number", F.lit("number used twice").alias("problem"))
    in_level = Window.partitionBy("level").orderBy("smallest_key", "file_number").rowsBetween(Window.unboundedPreceding, -1)
    lapped = files.filter("level >= 1").withColumn("_upto", F.max("largest_key").over(in_level)).filter(F.col("smallest_key") <= F.col("_upto"))
    return beyond.union(twice).union(lapped.select("level", "file_number", F.lit("overlaps an earlier file").alias("problem")))


def oldest_snapshot(snapshots: DataFrame, last_sequence: int) -> DataFrame:
    """One row: the sequence below which shadowed versions may go."""
    return snapshots.agg(F.coalesce(F.min("seq"), F.lit(last_sequence)).cast("long").alias("oldest"), F.coalesce(F.max("seq"), F.lit(last_sequence)).cast("long").alias("newest"))

"""Change logs and their resolution.

A change log has key columns, `seq` (which change is newer), `kind` (1 put, 0 delete) and `value`.
Internal order is key ascending, then seq and kind descending. Key and seq predicates may move
below `resolve`; predicates on kind or value may not, as they would let older versions show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELETE, PUT = 0, 1
MAX_SEQ = (1 << 56) - 2  # the largest number a change may have; one above is for lookups


def change_log(rows: DataFrame, key: Column, seq: Column, kind: Column, value: Column) -> DataFrame:
    return rows.select(key.alias("key"), seq.cast("long").alias("seq"), kind.cast("tinyint").alias("kind"), value.alias("value"))


def newest(log: DataFrame, as_of: int | None = None, keys: tuple[str, ...] = ("key",), norm: Column | None = None) -> DataFrame:
    """The newest change of each key at or below `as_of`, deletes included.

    One aggregation with map-side combining: a key with many versions shrinks before the shuffle.
    `norm` groups keys that a coarser comparator calls equal; the newest key's own spelling is kept.
    """
    seen = log if as_of is None else log.filter(F.col("seq") <= F.lit(as_of))
    best = F.max(F.struct("seq", "kind", *[c for c in seen.columns if c not in ("seq", "kind", *(() if norm is not None else keys))])).alias("_best")
    if norm is not None:
        return seen.groupBy(norm.alias("_norm")).agg(best).select("_best.*")
    return seen.groupBy(*keys).agg(best).select(*keys, "_best.*")


def resolve(log: DataFrame, as_of: int | None = None, keys: tuple[str, ...] = ("key",), norm: Column | None = None) -> DataFrame:
    """The live rows: newest version of each key that is not a delete."""
    return newest(log, as_of, keys, norm).filter(F.col("kind") == PUT).drop("kind")


def tombstones(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """Keys whose newest version is a delete."""
    return newest(log, as_of).filter(F.col("kind") == DELETE).select("key", "seq")


def history(log: DataFrame, key) -> DataFrame:
    """All versions of one key with their age, newest first (age 1)."""
    age = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq"), F.desc("kind")))
    return log.filter(F.col("key") == F.lit(key)).withColumn("age", age)


def get(log: DataFrame, key, as_of: int | None = None) -> DataFrame:
    """The live row of one key, if any; the key predicate reaches the scan."""
    return resolve(log.filter(F.col("key") == F.lit(key)), as_of)


def multi_get(log: DataFrame, keys: DataFrame, as_of: int | None = None) -> DataFrame:
    """Live rows of the keys in column `key` of `keys`. The semi-join comes before resolution, so only asked keys are aggregated; Spark broadcasts the keys if their size allows."""
    return resolve(log.join(keys.select("key").distinct(), "key", "left_semi"), as_of)


def missing_keys(log: DataFrame, keys: DataFrame, as_of: int | None = None) -> DataFrame:
    """Asked keys without a live row."""
    return keys.select("key").distinct().join(resolve(log, as_of).select("key"), "key", "left_anti")


def existing_keys(log: DataFrame, keys: DataFrame, as_of: int | None = None) -> DataFrame:
    """Asked keys with a live row."""
    return keys.select("key").distinct().join(resolve(log, as_of).select("key"), "key", "left_semi")

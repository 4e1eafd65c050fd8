"""Write batches: ordered lists of puts and deletes that get consecutive sequence numbers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.operators.log import DELETE, MAX_SEQ, PUT
from sediment.operators.ordered import rank_rows

MAX_ENTRIES = (1 << 32) - 1
MAX_KEY = (1 << 32) - 9
MAX_VALUE = (1 << 32) - 1


class BatchError(ValueError):
    pass


@dataclass
class WriteBatch:
    """A small batch built by a program; `to_rows` makes it a DataFrame of (ordinal, kind, key, value)."""

    ops: list[tuple[int, object, object]] = field(default_factory=list)

    def _add(self, kind: int, key, value) -> WriteBatch:
        if len(self.ops) >= MAX_ENTRIES:
            raise BatchError("too many entries")
        for x, most, what in ((key, MAX_KEY, "key"), (value, MAX_VALUE, "value")):
            if isinstance(x, bytes | str) and len(x) > most:
                raise BatchError(f"{what} too long")
        self.ops.append((kind, key, value))
        return self

    def put(self, key, value) -> WriteBatch:
        return self._add(PUT, key, value)

    def delete(self, key) -> WriteBatch:
        return self._add(DELETE, key, None)

    def clear(self) -> None:
        self.ops.clear()

    def push_batch(self, other: WriteBatch) -> WriteBatch:
        if len(self.ops) + len(other.ops) > MAX_ENTRIES:
            raise BatchError("too many entries")
        self.ops += other.ops
        return self

    def __len__(self) -> int:
        return len(self.ops)

    def __iter__(self):
        return iter(self.ops)

    def to_rows(self, spark: SparkSession, key: str = "binary", value: str = "binary") -> DataFrame:
        rows = [(k, *op) for k, op in enumerate(self.ops)]
        return spark.createDataFrame(rows, f"ordinal long, kind tinyint, key {key}, value {value}")


def chain(*batches: DataFrame) -> DataFrame:
    """Batches (ordinal, kind, key, value) one after another, as (batch, ordinal, ...)."""
    out = None
    for k, b in enumerate(batches):
        part = b.withColumn("batch", F.lit(k).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


def assign_sequences(ops: DataFrame, last: int = 0) -> DataFrame:
    """`ops` (batch, ordinal, ...) with seq: last + 1, last + 2, ... in order of batch and ordinal. Fails beyond the largest sequence number."""
    numbered = rank_rows(ops, "batch", "ordinal", name="seq", start=last + 1)
    fits = F.assert_true(F.col("seq") <= F.lit(MAX_SEQ), F.lit("sequence numbers are used up"))
    return numbered.filter(fits.isNull())


def apply_batches(log: DataFrame, ops: DataFrame, last: int) -> DataFrame:
    """The change log after the batches."""
    return log.unionByName(assign_sequences(ops, last).select("key", "seq", "kind", "value"))


def validate(batches: DataFrame) -> DataFrame:
    """Per serialised batch (batch, declared, kind per op): n_ops, and problem: unknown type, too few or too many entries, or null."""
    counted = batches.groupBy("batch", "declared").agg(F.count("kind").alias("n_ops"), F.coalesce(F.bool_or(~F.col("kind").isin(DELETE, PUT)), F.lit(False)).alias("_odd"))
    problem = F.when(F.col("_odd"), "unknown type").when(F.col("n_ops") < F.col("declared"), "too few entries").when(F.col("n_ops") > F.col("declared"), "too many entries")
    return counted.select("batch", "declared", "n_ops", problem.alias("problem"))

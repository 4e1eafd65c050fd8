"""Change streams: micro-batches of changes or operations applied to a store, and a running latest state.

Where rows bring their own sequence numbers (`apply_log_stream`), these decide what is live, not the order
of arrival, so late rows need no watermark. Where they bring only an order inside a micro-batch
(`apply_stream`), the store numbers them as they arrive.

The store's manifest is the commit point and holds the last micro-batch of each source: one that is replayed after a failure
between commit and checkpoint is recognised and skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sediment.plans.store import Store


def _run(rows: DataFrame, checkpoint: str, each) -> StreamingQuery:
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_stream(ops: DataFrame, store: Store, checkpoint: str, compact: bool = True, source: str = "stream") -> StreamingQuery:
    """Write each micro-batch of (batch, ordinal, kind, key, value) as one atomic run under new sequence numbers; compact when a level is due."""

    def each(rows: DataFrame, batch_id: int) -> None:
        store.write(rows, source, batch_id)
        while compact and store.compact():
            pass

    return _run(ops, checkpoint, each)


def apply_log_stream(changes: DataFrame, store: Store, checkpoint: str, compact: bool = True, source: str = "stream", lateness: int | None = None) -> StreamingQuery:
    """Write each micro-batch of (key, seq, kind, value) as one atomic run under the rows' own numbers.

    `lateness`: how far behind the largest number seen a change may still come; compaction forgets nothing above that
    line. Without it compaction forgets no delete and no version that a late row could meet.
    """

    def each(rows: DataFrame, batch_id: int) -> None:
        sealed = None if lateness is None else max(0, store.last_sequence - lateness)
        store.write_log(rows, source, batch_id, sealed)
        while compact and store.compact():
            pass

    return _run(changes, checkpoint, each)


def latest_stream(log: DataFrame) -> DataFrame:
    """The running newest change of each key of a streaming log (update or complete mode). State is one row a key."""
    best = F.max(F.struct("seq", "kind", "value")).alias("b")
    return log.groupBy("key").agg(best).select("key", "b.seq", "b.kind", "b.value")

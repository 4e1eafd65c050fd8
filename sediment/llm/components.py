"""Connected components of an edge table: contraction in DataFrames until the rest fits one bounded task.

While more than ONE_TASK edges are left, every node is mapped to the least node within a few steps and the edges between
mapped nodes go on; a round takes several shuffles and at least halves the nodes that have edges. The remaining edges
(at most 16 bytes each times ONE_TASK) are finished by label propagation in one task, and the maps are applied backwards.
Each round writes its tables to the shared folder, so lineage stays short. Nothing about the graph reaches the driver but counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.staging import drop, stage

ONE_TASK = 2_000_000  # edges


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that each can reach)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        for end in (x, y):
            np.minimum.at(after, label[end], low)
            np.minimum.at(after, end, low)
        after = after[after]
        if (after == label).all():
            return nodes, nodes[label]
        label = after


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            nodes, roots = least_reachable(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])

    return edges.repartition(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """`edges` (a, b: long, not null) to a staged table (node, root): root is the smallest node reachable."""
    left = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "cc-edges")
    maps = []
    while left.count() > ONE_TASK:
        both = left.union(left.select("b", "a"))
        up = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "cc-up")
        for _ in range(2):  # to the parent's parent, and its
            above = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            higher = stage(up.join(above, "root").select("node", F.col("top").alias("root")), "cc-up")
            drop(up)
            up = higher
        maps.append(up)
        end = lambda c: up.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))  # noqa: B023, E731
        moved = left.join(end("a"), "a").join(end("b"), "b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"))
        after = stage(moved.filter("a <> b").distinct(), "cc-edges")
        drop(left)
        left = after
    labels = stage(_in_one_task(left), "cc-labels")
    drop(left)
    for up in reversed(maps):
        known = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        lower = stage(up.join(known, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "cc-labels")
        drop(labels, up)
        labels = lower
    return labels

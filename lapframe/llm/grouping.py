"""Helpers for tasks that read sorted rows, and connected components as Spark joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapframe.session import materialize


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups from batches sorted by ``keys``, with the row at which each group starts.

    The last group of a batch waits for the next batch, so a table is a batch and one group at most.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        starts = group_starts(held, keys)
        if len(starts) > 1:
            cut = int(starts[-1])
            yield held.slice(0, cut).combine_chunks(), starts[:-1]
            held = held.slice(cut)
    if held is not None:
        held = held.combine_chunks()
        yield held, group_starts(held, keys)


def group_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which any of the (non-null) keys differs from the row before, with 0."""
    changed = np.zeros(rows.num_rows, dtype=bool)
    changed[:1] = True
    for key in keys:
        col = rows.column(key).combine_chunks()
        changed[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(changed)


class Forest:
    """Union-find over a few rows."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        """(member, root) for each member that is not its own root."""
        return [(i, r) for i in range(len(self.up)) if (r := self.root(i)) != i]


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node) for every node of ``edges`` (a, b).

    Each round sends every node the smallest label among its neighbours and itself and then
    follows labels once (pointer jumping), so paths shorten by more than half. A round is written
    to the shared folder: lineage stays short, and a lost executor repeats one round at most.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "cc-labels")
    while True:  # labels only ever fall, so it ends
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        nearer = labels.join(seen, labels["node"] == seen["a"], "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("least"))
        jump = labels.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
        moved = nearer.join(jump, nearer["least"] == jump["__n"], "left").select("node", F.col("component").alias("old"), F.least("least", F.coalesce("__c", "least")).alias("component"))
        moved = materialize(moved, "cc-labels")
        labels = moved.select("node", "component")
        if moved.where(F.col("old") != F.col("component")).isEmpty():
            return labels

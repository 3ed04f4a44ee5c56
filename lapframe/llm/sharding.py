"""Minimax contiguous partition of atomic groups into shards.

Equal texts form an atomic group. Groups are ordered by the SHA-256 of their
text and cut into at most ``shards`` contiguous runs so that the largest run is
as small as it can be. The smallest feasible capacity is found by binary search
with a greedy check, over running sums that stay in a table: the driver holds
one (min, max) pair for each cell of a grid over them (about ``cells`` pairs at
the first level, some hundreds of cells divided by ``split`` later). A cell
that could change the answer is divided in the next level; levels end when the
bounds meet, so the capacity is exact. Since groups are ordered by digest, the
cuts are digests, and a document finds its shard by comparing its own digest
with them: no join, and a hot group needs no special care.

Defined cases: a null text counts as empty (size 8, crc32 0, one group with the
empty texts); a repeated row is one more row of its group; shards may stay empty
where fewer runs suffice; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapframe.llm.common import text_of
from lapframe.session import materialize

#: Bytes that a row takes besides its text.
ROW_BYTES = 8


def running_sums(groups: DataFrame, key: str, size: str, digits: int) -> DataFrame:
    """``groups`` (one row per hex ``key``) with ``upto``: the sum of ``size`` up to and with the row.

    Ranges are the first ``digits`` hex digits of the key: 16**digits of them, alike in
    size since the key is a digest. Only their totals are summed in one place.
    """
    cut = groups.withColumn("range", F.substring(key, 1, digits))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("range").agg(F.sum(size).alias("total"))
    starts = totals.select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("__in", F.sum(size).over(inside)).join(starts, "range").withColumn("upto", F.col("__in") + F.col("start")).drop("__in", "start", "range")


class _Grid:
    """Known running sums: exact where a cell has one value, else bounded by its smallest and largest."""

    def __init__(self, cells: list[tuple[int, int]]):
        self.cells = sorted(cells)
        self.low = [a for a, _ in self.cells]

    def cut(self, at: int, hopeful: bool) -> int:
        """The largest running sum <= ``at``; if not known exactly, a bound from above or one that surely exists."""
        k = bisect_right(self.low, at) - 1
        if k < 0:
            return 0
        a, b = self.cells[k]
        return b if b <= at else at if hopeful and a < b else a

    def cuts(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        out, at = [], 0
        for _ in range(shards):
            out.append(at := self.cut(at + capacity, hopeful))
        return out

    def smallest(self, total: int, shards: int, hopeful: bool) -> int:
        low, high = -(-total // shards), total
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, hopeful)[-1] >= total:
                high = mid
            else:
                low = mid + 1
        return low


def minimax_cuts(sums: DataFrame, shards: int, cells: int = 8192, split: int = 64) -> tuple[int, list[int]]:
    """The smallest capacity and the running sums at which to cut."""
    total = sums.agg(F.max("upto").alias("m")).first()["m"]
    if not total:
        return 0, []
    width, known, open_cells = max(1, -(-total // cells)), [], None
    while True:
        rows = sums if open_cells is None else sums.where(F.floor(F.col("upto") / F.lit(last)).isin(open_cells))
        got = rows.groupBy(F.floor(F.col("upto") / F.lit(width)).alias("cell")).agg(F.min("upto").alias("a"), F.max("upto").alias("b")).collect()
        known += [(r["a"], r["b"]) for r in got]
        grid = _Grid(known)
        sure, least = grid.smallest(total, shards, False), grid.smallest(total, shards, True)
        if sure == least:
            return sure, [c for c in dict.fromkeys(grid.cuts(sure, shards, False)) if 0 < c < total]
        spans = [(a + least, b + sure) for a, b in zip([0, *grid.cuts(least, shards, False)], [0, *grid.cuts(sure, shards, True)], strict=True)]
        unsure = [(a, b) for a, b in known if a < b and any(lo <= b and a <= hi for lo, hi in spans)]
        known = [c for c in known if c not in set(unsure)]
        last, open_cells = width, sorted({a // width for a, _ in unsure})
        width = max(1, width // split)


def shard_documents(docs: DataFrame, shards: int = 24, rows_per_run: int = 200_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Slots: rows of a shard are dealt by a hash of doc_id and text into runs of about
    ``rows_per_run`` rows, numbered inside each run, and shifted by the sizes of the runs before.
    """
    text = text_of()
    keyed = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.sha2(text, 256).alias("digest"),
        ),
        "shard-keys",
    )
    groups = keyed.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("copies"))
    n = keyed.count()
    digits = 2 if n < 10_000_000 else 3 if n < 1_000_000_000 else 4
    sums = materialize(running_sums(groups, "digest", "bytes", digits), "shard-sums")
    _, cuts = minimax_cuts(sums, shards)
    ends = [r["digest"] for r in sums.where(F.col("upto").isin(cuts)).select("digest").collect()] if cuts else []
    shard: Column = F.lit(0)
    for end in sorted(ends):
        shard = shard + F.when(F.col("digest") > end, 1).otherwise(0)
    runs = max(1, n // (shards * rows_per_run))
    placed = keyed.withColumn("shard", shard).withColumn("run", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(runs)).cast("int"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n")).select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "run").orderBy("doc_id", "digest")
    numbered = placed.withColumn("__no", F.row_number().over(order)).join(starts, ["shard", "run"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("__no") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

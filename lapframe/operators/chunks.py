"""A zero-phase low-pass over runs of any length, in chunks of rows.

A row's chunk is its ``seq`` divided by ``rows``, so no run is ever in one task.
First every chunk is filtered from rest, forward and then backward, and gives one row: the
two states that it ends with, and its first and last values. From these rows the
states with which each chunk begins, from the left and from the right, follow chunk by
chunk, as affine maps: what a chunk of n samples does to a state is a matrix that depends on
n alone. Then every chunk is filtered from its states. The result is that of one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapframe.functions.kernels import Recursion, butterworth_lowpass, mirrored_ends
from lapframe.functions.series import SEQ
from lapframe.session import TASK_ROWS, materialize

CHUNK_ROWS = 1 << 16


def chunk_of(seq: str = SEQ, rows: int = CHUNK_ROWS):
    return F.floor(F.col(seq) / rows).cast("long")


_TYPES = {"double": pa.float64(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}
_BATCH_ROWS = 10_000


def _same_key(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int, keys: list[str]) -> bool:
    return all(a.column(k)[i].as_py() == b.column(k)[j].as_py() for k in keys)


def _key_starts(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """The places, but for the first, at which one of ``keys`` differs from the row before; NULL equals NULL."""
    n, changed = batch.num_rows, np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in keys:
        before, after = batch.column(k).slice(0, n - 1), batch.column(k).slice(1)
        differ = pc.fill_null(pc.not_equal(before, after), False).to_numpy(zero_copy_only=False)
        changed |= differ | (before.is_null().to_numpy(zero_copy_only=False) != after.is_null().to_numpy(zero_copy_only=False))
    return (np.flatnonzero(changed) + 1).tolist()


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of sorted batches, one after the other; a group may go over several batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and not _same_key(held[-1], held[-1].num_rows - 1, batch, 0, keys):
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *_key_starts(batch, keys), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def numbers(group: pa.Table, column: str) -> np.ndarray:
    """A column of numbers as an array; NULL among doubles is NaN."""
    return group.column(column).to_numpy()


def parts_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Into how many partitions :func:`by_series` is to deal ``df``, which is counted, for about ``rows`` rows in each."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def long_series(df: DataFrame, keys: list[str], rows: int = CHUNK_ROWS) -> DataFrame | None:
    """The keys of the series with more than ``rows`` rows; None where there is none. They are few: one in ``rows`` rows at most."""
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows).drop("__n")
    found = materialize(found, "long-series")
    return None if found.isEmpty() else found


def by_series(df: DataFrame, keys: list[str], order: list[str], f: Callable[[pa.Table], dict | None], columns: dict[str, str], parts: int | None = None) -> DataFrame:
    """keys and ``columns`` (name -> type) that ``f`` makes of each group of ``keys``, its rows sorted by ``order``; None gives no rows.

    A task holds one group at a time, and its batches carry many small groups, each of
    which would cost more on its way to Python and back than in ``f`` if sent by itself.
    """
    spark, kinds = df.sparkSession, dict(df.dtypes)
    dealt = df.repartition(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, rows = [], 0
        for group in _groups(batches, keys):
            out = f(group)
            n = len(next(iter(out.values()))) if out else 0
            if not n:
                continue
            made.append(pa.table([pa.repeat(group.column(k)[0], n) for k in keys] + [out[c] if isinstance(out[c], pa.ChunkedArray) else pa.array(out[c], _TYPES[t], from_pandas=True) for c, t in columns.items()], [*keys, *columns]))
            rows += n
            if rows >= _BATCH_ROWS:
                yield from pa.concat_tables(made).combine_chunks().to_batches()
                made, rows = [], 0
        if made:
            yield from pa.concat_tables(made).combine_chunks().to_batches()

    return dealt.mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *[f"`{c}` {t}" for c, t in columns.items()]]))


class Filters:
    """One recursion per sampling rate, in each worker; None where the rate is too low."""

    def __init__(self, order: int, cutoff_hz: float):
        self.order, self.cutoff_hz, self.known = order, cutoff_hz, {}

    def at(self, rate_hz: float | None) -> Recursion | None:
        rate_hz = rate_hz if rate_hz is None else float(f"{rate_hz:.9g}")  # runs of one rate share a filter
        if rate_hz not in self.known:
            fits = rate_hz is not None and rate_hz > 2 * self.cutoff_hz
            self.known[rate_hz] = Recursion(*butterworth_lowpass(self.order, self.cutoff_hz / (rate_hz / 2.0))) if fits else None
        return self.known[rate_hz]


def _entries(sizes: list[int], heads: list, tails: list, ahead: list, back: list, r: Recursion) -> tuple[list[list[float]], list[list[float]]]:
    """For one column: the states from the left and from the right with which each of a run's chunks begins."""
    head = np.concatenate(heads)[: r.pad + 1]
    tail = np.concatenate(tails)[-r.pad - 1 :]
    before, after = mirrored_ends(head, tail, r.pad)
    state, left = r.run(before, r.settled * before[0])[1], []
    for n, c in zip(sizes, ahead, strict=True):
        left.append(state)
        state = r.power(n) @ state + np.asarray(c, float)
    once = r.run(after, state)[0][::-1]
    state, right = r.run(once, r.settled * once[0])[1], []
    for n, c, entered in zip(sizes[::-1], back[::-1], left[::-1], strict=True):
        right.append(state)
        state = r.power(n) @ state + np.asarray(c, float) + r.echo(n) @ entered
    return [x.tolist() for x in left], [x.tolist() for x in right[::-1]]


def lowpass(df: DataFrame, columns: list[str], keys: list[str], rate: str, cutoff_hz: float, order: int = 4, seq: str = SEQ, rows: int = CHUNK_ROWS) -> DataFrame:
    """keys, ``seq``, chunk and ``columns`` filtered forward and backward, for the series that ``keys`` tell apart.

    ``rate``: the column with a series' sampling rate. A column is NULL throughout a series in
    which it has a NULL, or that has no more than three filter lengths of samples, or whose rate is at
    most twice ``cutoff_hz``.
    """
    kind = dict(df.dtypes)[seq]
    group = [*keys, "chunk"]
    parts = df.select(*keys, chunk_of(seq, rows).alias("chunk"), seq, F.col(rate).cast("double").alias("rate"), *[F.col(c).cast("double").alias(c) for c in columns])
    filters, m = Filters(order, cutoff_hz), len(columns)

    def alone(rows_: pa.Table) -> dict | None:
        rate_hz = rows_.column("rate")[0].as_py()
        r = filters.at(rate_hz)
        if r is None:
            return None
        held = [numbers(rows_, c) for c in columns]
        passes = [(r.run(x, np.zeros(r.order))) for x in held]
        back = [r.run(y[::-1], np.zeros(r.order))[1].tolist() for y, _ in passes]
        heads, tails = [x[: r.pad + 1].tolist() for x in held], [x[-r.pad - 1 :].tolist() for x in held]
        return {"n": [len(rows_)], "rate": [rate_hz], "heads": [heads], "tails": [tails], "ahead": [[end.tolist() for _, end in passes]], "back": [back]}

    def entered(found: pa.Table) -> dict | None:
        r = filters.at(found.column("rate")[0].as_py())
        sizes = found.column("n").to_pylist()
        if sum(sizes) <= r.pad:
            return None
        # a NULL came as NaN: what is not a number stays none in lists
        lists = {c: [[np.array(x, float) for x in own] for own in found.column(c).to_pylist()] for c in ("heads", "tails", "ahead", "back")}
        both = [_entries(sizes, *[[own[k] for own in lists[c]] for c in ("heads", "tails", "ahead", "back")], r) for k in range(m)]
        left, right = ([[both[k][side][i] for k in range(m)] for i in range(len(sizes))] for side in (0, 1))
        return {"chunk": found.column("chunk").to_pylist(), "left": left, "right": right}

    def through(rows_: pa.Table) -> dict | None:
        has_states = not rows_.column("is_row")[0].as_py()
        own = rows_.slice(1) if has_states else rows_
        out = {seq: own.column(seq).combine_chunks()} | {c: np.full(len(own), np.nan) for c in columns}
        r = filters.at(own.column("rate")[0].as_py()) if has_states else None
        for k, c in enumerate(columns if r else []):
            left, right = (np.array(rows_.column(side)[0].as_py()[k], float) for side in ("left", "right"))
            out[c] = r.run(r.run(numbers(own, c), left)[0][::-1], right)[0][::-1]
        return out

    nested = "array<array<double>>"
    summary = by_series(parts, group, [seq], alone, {"n": "long", "rate": "double", "heads": nested, "tails": nested, "ahead": nested, "back": nested})
    states = by_series(summary, keys, ["chunk"], entered, {"chunk": "long", "left": nested, "right": nested})
    # a chunk's states go before its rows
    both = parts.withColumn("is_row", F.lit(True)).unionByName(states.withColumn("is_row", F.lit(False)), allowMissingColumns=True)
    done = by_series(both, group, ["is_row", seq], through, {seq: kind} | {c: "double" for c in columns})
    return done.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def with_lookback(df: DataFrame, value: str, span: float, keys: list[str], seq: str = SEQ, block: int = 1024) -> DataFrame:
    """``df`` (keys, chunk, ``seq``, columns) with each chunk's lookback: the rows before it that a window of less than ``span`` may reach.

    Adds ``own`` (false for lookback rows; ``chunk`` is then the chunk that they are for). Extremes of
    blocks of rows show how far the window of a chunk's first row goes back; windows of later rows begin no earlier. The block in which
    it begins comes whole, with the one before it, so whatever looks at neighbours finds them.
    A stretch that stays within ``span`` for longer than a chunk goes along to each chunk that it reaches into.
    """
    placed = df.withColumn("block", F.floor(F.col(seq) / block).cast("long"))
    blocks = placed.groupBy(*keys, "chunk", "block").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.min_by(value, seq).alias("first"))

    def reach(found: pa.Table) -> dict | None:
        chunk, low, high, first, number = (numbers(found, c) for c in ("chunk", "low", "high", "first", "block"))
        wanted = []
        for at in np.flatnonzero(np.r_[False, chunk[1:] != chunk[:-1]]).tolist():
            lo = hi = first[at]
            k = at - 1
            while k > 0 and max(hi, high[k]) - min(lo, low[k]) < span:
                lo, hi = min(lo, low[k]), max(hi, high[k])
                k -= 1
            wanted += [(chunk[j], number[j], chunk[at]) for j in range(max(k - 1, 0), at)]
        return dict(zip(("chunk", "block", "for_chunk"), zip(*wanted, strict=True), strict=True)) if wanted else None

    need = by_series(blocks, keys, ["chunk", "block"], reach, {"chunk": "long", "block": "long", "for_chunk": "long"})
    back = placed.join(need, [*keys, "chunk", "block"]).withColumn("chunk", F.col("for_chunk")).withColumn("own", F.lit(False))
    return df.withColumn("own", F.lit(True)).unionByName(back.select(*df.columns, "own"))

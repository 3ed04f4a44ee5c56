"""Expressions over a run's rows in order. Frames never reach past what one pass can keep.

A frame that ends at UNBOUNDED FOLLOWING is evaluated anew for every row, so
none is used: what looks ahead without bound runs over the reversed order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lapframe.functions.nulls import col

RUN, SEQ = "run_id", "seq"
Keys = str | list[str]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once: a lambda variable holds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ordered(run: Keys = RUN, seq: Keys = SEQ) -> WindowSpec:
    return Window.partitionBy(run).orderBy(seq)


def reverse_ordered(run: Keys = RUN, seq: Keys = SEQ) -> WindowSpec:
    return Window.partitionBy(run).orderBy(*[F.desc(c) for c in ([seq] if isinstance(seq, str) else seq)])


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def diff(x: Column | str, w: WindowSpec) -> Column:
    return col(x) - F.lag(col(x)).over(w)


def gradient(x: Column | str, w: WindowSpec, step: Column | float = 1.0) -> Column:
    """Central differences; one-sided at a run's first and last row. A single row has none."""
    x, step = col(x), step if isinstance(step, Column) else F.lit(float(step))
    ahead, behind, here = F.lead(x).over(w), F.lag(x).over(w), F.row_number().over(w)
    last = F.lead(F.lit(1)).over(w).isNull()
    inner = F.try_divide(ahead - behind, 2.0 * step)
    return F.when(here == 1, F.try_divide(ahead - x, step)).when(last, F.try_divide(x - behind, step)).otherwise(inner)


def centered_mean(x: Column | str, rows: int, w: WindowSpec) -> Column:
    """Mean of ``rows`` rows around each; fewer at the ends. Even widths have one row more behind."""
    return F.avg(col(x)).over(w.rowsBetween(-(rows // 2), rows - rows // 2 - 1))


def trailing_mean(x: Column | str, rows: int, w: WindowSpec, full: bool = False) -> Column:
    """Mean of the last ``rows`` rows; with ``full``, NULL until that many values are there."""
    frame = w.rowsBetween(-(rows - 1), 0)
    mean = F.avg(col(x)).over(frame)
    return F.when(F.count(col(x)).over(frame) >= rows, mean) if full else mean


def forward_quantile(x: Column | str, rows: int, q: float, w: WindowSpec) -> Column:
    """Quantile (linear between values) of each row and the ``rows`` - 1 after it."""
    return F.percentile(col(x), F.lit(q)).over(w.rowsBetween(0, rows - 1))


def with_position(df: DataFrame, run: Keys = RUN, seq: Keys = SEQ, name: str = "pos") -> DataFrame:
    """``name``: the row's place in its run, from 0."""
    return df.withColumn(name, (F.row_number().over(ordered(run, seq)) - 1).cast("long"))


def with_islands(df: DataFrame, label: str, name: str = "island", run: Keys = RUN, seq: Keys = SEQ) -> DataFrame:
    """``name``: number of the run of equal neighbouring ``label`` values, from 1 (NULL labels are equal)."""
    w = ordered(run, seq)
    fresh = (~F.col(label).eqNullSafe(F.lag(label).over(w))) | (F.row_number().over(w) == 1)
    return df.withColumn("__fresh", fresh.cast("int")).withColumn(name, F.sum("__fresh").over(so_far(w)).cast("long")).drop("__fresh")


def carry_forward(x: Column | str, w: WindowSpec) -> Column:
    return F.last(col(x), ignorenulls=True).over(so_far(w))


def direction_segments(df: DataFrame, x: str, name: str = "segment", run: Keys = RUN, seq: Keys = SEQ) -> DataFrame:
    """``name``: counts the changes of direction (rising, falling, level) of ``x``, from 0."""
    w = ordered(run, seq)
    turn = df.withColumn("__sign", F.signum(diff(x, w)))
    before = F.lag("__sign").over(w)
    turn = turn.withColumn("__turn", F.coalesce(F.col("__sign") != before, F.lit(False)).cast("int"))
    return turn.withColumn(name, F.sum("__turn").over(so_far(w)).cast("long")).drop("__sign", "__turn")


def sample_rates(df: DataFrame, time: str = "time_s", run: str = RUN) -> DataFrame:
    """run_id, sample_hz: one over the mean step, from the first and last time alone."""
    got = df.groupBy(run).agg(F.count(time).alias("n"), F.min(time).alias("a"), F.max(time).alias("b"))
    return got.select(run, F.try_divide(F.col("n") - 1, F.col("b") - F.col("a")).alias("sample_hz"))


def with_median_step(df: DataFrame, name: str = "step_s", time: str = "time_s", run: str = RUN, seq: str = SEQ) -> DataFrame:
    """``name``: the median step of the row's run; rows without a run have none. A window over the whole run, so the rows are neither read twice nor joined."""
    median = F.percentile("__step", F.lit(0.5)).over(Window.partitionBy(run))
    return df.withColumn("__step", diff(time, ordered(run, seq))).withColumn(name, F.when(F.col(run).isNotNull(), median)).drop("__step")

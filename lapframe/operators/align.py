"""Alignment of sparse channels on a common grid of times.

Knots are a long table (run_id, channel, time_s, value). Each channel of a run is
a series of its own, so a run is spread over as many tasks as it has channels. A
grid time finds its two neighbours by one pass in order and one in reverse: no
join between knots and grid, and no frame that is evaluated anew for each row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapframe.functions.nulls import finite
from lapframe.functions.series import RUN, SEQ, diff, ordered, so_far
from lapframe.session import TASK_ROWS, dealt


def to_long(df: DataFrame, channels: list[str], run: str = RUN, time: str = "time_s") -> DataFrame:
    """One row per value that is there: run_id, time_s, channel, value."""
    values = F.array(*[F.struct(F.lit(c).alias("channel"), finite(F.col(f"`{c}`")).alias("value")) for c in channels])
    return df.select(run, F.col(time).alias("time_s"), F.explode(values).alias("v")).select(run, "time_s", "v.channel", "v.value").where("value is not null")


def to_wide(long: DataFrame, channels: list[str], keys: list[str]) -> DataFrame:
    """One row per key with a column per channel; ``channels`` is given, so no job looks for them."""
    return long.groupBy(*keys).pivot("channel", channels).agg(F.first("value"))


def keep_first(knots: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows with equal ``keys`` the first one in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    # Spark groups floating-point keys by a normalised form, so rows dealt by them would be dealt again
    exact = [k for k in keys if dict(knots.dtypes)[k] not in ("float", "double")]
    firsts = dealt(knots, *exact) if exact else knots
    return firsts.withColumn("__no", F.row_number().over(w)).where("__no = 1").drop("__no")


def time_grid(knots: DataFrame, rate_hz: float, run: str = RUN, inclusive: bool = False) -> DataFrame:
    """run_id, seq, time_s: from a run's first time on, every 1 / rate_hz; the last time itself is left out.

    ``inclusive``: one more point instead, at or after the last time.
    """
    ends = knots.groupBy(run).agg(F.min("time_s").alias("a"), F.max("time_s").alias("b"))
    n = F.ceil((F.col("b") - F.col("a")) * F.lit(float(rate_hz))).cast("long")
    n = n + 1 if inclusive else n
    # runs are dealt by the number of their points before they have them: a task that writes points holds what it writes
    parts = -(-(ends.agg(F.sum(n)).first()[0] or 0) // TASK_ROWS)
    ends = ends.repartition(parts, run) if parts > knots.sparkSession.sparkContext.defaultParallelism else ends
    points = ends.withColumn("seq", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))))
    return points.select(run, "seq", (F.col("a") + F.col("seq") / F.lit(float(rate_hz))).alias("time_s"))


def interpolate(knots: DataFrame, grid: DataFrame, run: str = RUN, left_clamp: bool = True) -> DataFrame:
    """run_id, channel, seq, time_s, value: each channel's value at each grid time of its run.

    Linear between the neighbouring knots; the nearest knot's value outside (before the first knot
    only with ``left_clamp``, else NULL). Of knots at one time the last in order of value decides.
    """
    # a run's few channels are looked up by hash, so the grid's rows are not sorted before they are dealt
    channels = knots.where("channel is not null").select(run, "channel").distinct().hint("shuffle_hash")
    asked = grid.join(channels, run).select(run, "channel", "time_s", F.lit(None).cast("double").alias("value"), F.lit(1).alias("is_grid"), "seq")
    given = knots.select(run, "channel", "time_s", "value", F.lit(0).alias("is_grid"), F.lit(None).cast("long").alias("seq")).where("value is not null")
    both = dealt(asked.unionByName(given), run, "channel")
    knot = F.when(F.col("is_grid") == 0, F.struct("time_s", "value"))
    forward = so_far(Window.partitionBy(run, "channel").orderBy("time_s", "is_grid", "value"))
    backward = so_far(Window.partitionBy(run, "channel").orderBy(F.desc("time_s"), "is_grid", F.desc("value")))
    near = both.withColumn("__a", F.last(knot, ignorenulls=True).over(forward)).withColumn("__b", F.last(knot, ignorenulls=True).over(backward)).where("is_grid = 1")
    t, a, b = F.col("time_s"), F.col("__a"), F.col("__b")
    slope = F.try_divide(b["value"] - a["value"], b["time_s"] - a["time_s"])
    value = F.when(a.isNull(), b["value"] if left_clamp else F.lit(None)).when(b.isNull() | (a["time_s"] == t), a["value"]).otherwise(a["value"] + slope * (t - a["time_s"]))
    return near.select(run, "channel", "seq", "time_s", value.alias("value"))


def resample(df: DataFrame, channels: list[str], rate_hz: float = 100.0, shift_to_zero: bool = True, offset: float = 0.0, run: str = RUN) -> DataFrame:
    """Wide rows on the grid: run_id, seq, time_s and the channels.

    Runs without any NULL stay as they are (their own times, in order); a channel without a value
    in a run is NULL there. The distance is mended at lap starts (see :func:`mend_lap_starts`).
    """
    missing = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in [*channels, "time_s"]])
    holes = df.groupBy(run).agg(F.max(missing.cast("int")).alias("__holes"))
    marked = df.join(holes, run)
    whole = marked.where("__holes = 0")
    whole = whole.withColumn("seq", (F.row_number().over(Window.partitionBy(run).orderBy("time_s")) - 1).cast("long")).select(run, "seq", "time_s", *[F.col(f"`{c}`").cast("double").alias(c) for c in channels])
    sparse = marked.where("__holes = 1").select(*df.columns)
    grid = time_grid(sparse, rate_hz, run)
    long = interpolate(to_long(sparse, channels, run), grid, run)
    wide = to_wide(long, channels, [run, "seq", "time_s"])
    if shift_to_zero:
        wide = wide.withColumn("time_s", F.col("seq") / F.lit(float(rate_hz)))
    wide = wide.withColumn("time_s", F.col("time_s") + F.lit(float(offset))) if offset else wide
    if "s_m" in channels:
        wide = mend_lap_starts(wide, run)
    return wide.select(run, "seq", "time_s", *channels).unionByName(whole)


def mend_lap_starts(df: DataFrame, run: str = RUN, seq: str = SEQ) -> DataFrame:
    """A distance that interpolation smeared over a lap's end becomes 0; so does a run's first one."""
    return df.withColumn("s_m", F.when(diff("s_m", ordered(run, seq)) >= -10.0, F.col("s_m")).otherwise(F.lit(0.0)))


def align_series(knots: DataFrame, rate_hz: float = 100.0, run: str = RUN) -> DataFrame:
    """Series with times of their own on one grid per run: of equal times the first row (``seq``) counts, nothing before a series' start."""
    firsts = keep_first(knots, [run, "channel", "time_s"], ["seq"])
    return interpolate(firsts.select(run, "channel", "time_s", "value"), time_grid(firsts, rate_hz, run, inclusive=True), run, left_clamp=False)

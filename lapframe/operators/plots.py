"""Plot-ready tables: traces, maps and diagrams. Drawing itself is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lapframe.functions.series import RUN, SEQ, ordered, reverse_ordered, trailing_mean, with_islands

TAIL_ROWS, MOST_POINTS = 10, 20_000


def overlay(df: DataFrame, group: str, channels: list[str], run: str = RUN, seq: str = SEQ) -> DataFrame:
    """One trace per unbroken stretch of ``group``, without its last 10 rows."""
    cut = with_islands(df, group, "trace", run, seq)
    back = F.row_number().over(reverse_ordered([run, "trace"], seq))
    return cut.withColumn("__back", back).where(F.col("__back") > TAIL_ROWS).select(run, seq, group, "trace", *channels)


def every_nth(df: DataFrame, most: int = MOST_POINTS, run: str = RUN, seq: str = SEQ) -> DataFrame:
    """Every nth row of a run, n such that about ``most`` are left (all of a run that is shorter). For drawing only."""
    n = F.count(F.lit(1)).over(Window.partitionBy(run))
    return df.withColumn("__stride", F.greatest(F.lit(1), F.floor(n / most))).where(F.col(seq) % F.col("__stride") == 0).drop("__stride")


def track_map(df: DataFrame, label: str, run: str = RUN, seq: str = SEQ) -> DataFrame:
    """run_id, trace, label and its place: the mean position of each unbroken stretch."""
    cut = with_islands(df, label, "trace", run, seq)
    return cut.groupBy(run, "trace").agg(F.first(label).alias(label), F.avg("pos_x_m").alias("label_x"), F.avg("pos_y_m").alias("label_y"))


def scatter(df: DataFrame, x: str, y: str, colour: str, run: str = RUN, seq: str = SEQ) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(run, seq, F.col(x).alias("x"), F.col(y).alias("y"), F.col(colour).alias("colour"))


def acceleration_diagram(df: DataFrame, rows: int = 30, run: str = RUN, seq: str = SEQ) -> DataFrame:
    """run_id, n_lap, seq, across, along: full means of the accelerations per lap."""
    w = ordered([run, "n_lap"], seq)
    return df.select(run, "n_lap", seq, trailing_mean("ay_mps2", rows, w, full=True).alias("across"), trailing_mean("ax_mps2", rows, w, full=True).alias("along")).where("across is not null and along is not null")


def speed_over_distance(df: DataFrame, rows: int = 30, run: str = RUN, seq: str = SEQ) -> DataFrame:
    return df.select(run, "n_lap", seq, "s_m", trailing_mean("v_mps", rows, ordered([run, "n_lap"], seq), full=True).alias("v_mean")).where("v_mean is not null")


def window_at(df: DataFrame, lap: int, location_m: float, run: str = RUN, seq: str = SEQ) -> DataFrame:
    """The rows of the corner in which a lap passes ``location_m``, with ``is_closest`` for the row nearest to it (the first on a tie)."""
    own = with_islands(df.where(F.col("n_lap") == lap), "corner_name", "stretch", run, seq)
    best = own.groupBy(run).agg(F.min(F.struct(F.abs(F.col("s_m") - F.lit(location_m)).alias("gap"), F.col(seq).alias("at"), F.col("stretch").alias("inside"))).alias("b")).select(run, "b.at", "b.inside")
    return own.join(best, run).where(F.col("stretch") == F.col("inside")).withColumn("is_closest", F.col(seq) == F.col("at")).drop("at", "inside", "stretch")


def combined_acceleration(df: DataFrame, rows: int = 30, run: str = RUN, seq: str = SEQ) -> DataFrame:
    """run_id, n_lap, seq, s_m, a_mean: full means of the total acceleration per lap, to be drawn over distance."""
    return df.select(run, "n_lap", seq, "s_m", trailing_mean("a_total_mps2", rows, ordered([run, "n_lap"], seq), full=True).alias("a_mean")).where("a_mean is not null")


def coloured_segments(df: DataFrame, x: str = "s_m", y: str = "vx_mps", colour: str = "a_total_mps2", run: str = RUN, seq: str = SEQ) -> DataFrame:
    """run_id, n_lap, seq, the two ends of each segment of a lap's line by ``x``, and its colour: that of its first point, and as a share of the lap's range.

    A range of one value gives the share 0. Segments with an unknown end are left out; without a colour it is NULL.
    """
    along, lap = Window.partitionBy(run, "n_lap").orderBy(F.col(x).asc_nulls_last(), seq), Window.partitionBy(run, "n_lap")
    low, high = F.min(colour).over(lap), F.max(colour).over(lap)
    share = F.when(high > low, (F.col(colour) - low) / (high - low)).when(F.col(colour).isNotNull(), 0.0)
    ends = [F.col(x).alias("x_from"), F.col(y).alias("y_from"), F.lead(x).over(along).alias("x_to"), F.lead(y).over(along).alias("y_to")]
    return df.select(run, "n_lap", seq, *ends, F.col(colour).alias("colour"), share.alias("share")).dropna(subset=["x_from", "y_from", "x_to", "y_to"])


def numeric_channels(df: DataFrame) -> list[str]:
    """The columns that can be drawn: numbers, in the table's order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]

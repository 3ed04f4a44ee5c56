"""Laps: slicing runs at the start line, lap tables, validity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapframe.functions.series import RUN, SEQ, diff, ordered, so_far, with_position

JUMP_M, SETTLE_ROWS = 300.0, 100


def slice_laps(df: DataFrame, run: str = RUN, seq: str = SEQ) -> DataFrame:
    """``df`` with ``n_lap``, from 1.

    A lap begins where the distance falls by more than 300 m. Of such falls less than
    100 rows apart the last counts. Without a distance all rows are lap 1.
    """
    s = "s_norm_m" if "s_norm_m" in df.columns else "s_m"
    if s not in df.columns:
        return df.withColumn("n_lap", F.lit(1))
    w = ordered(run, seq)
    marked = with_position(df, run, seq, "__pos").withColumn("__fall", F.coalesce(diff(s, w) < -JUMP_M, F.lit(False)))
    # among the falls alone, the next one's place: rows of a run stay in their partition
    to_next = F.lead("__pos").over(ordered([run, "__fall"], seq)) - F.col("__pos")
    begins = F.col("__fall") & F.coalesce(to_next >= SETTLE_ROWS, F.lit(True))
    marked = marked.withColumn("__begins", begins.cast("int"))
    return marked.withColumn("n_lap", (1 + F.sum("__begins").over(so_far(w))).cast("int")).drop("__pos", "__fall", "__begins")


def lap_table(df: DataFrame, run: str = RUN, seq: str = SEQ) -> DataFrame:
    """run_id, n_lap, n_rows, lap_time_s (rounded to 0.01 s), distance_m, longest_step_m per lap."""
    stepped = df.withColumn("__step", diff("s_m", ordered([run, "n_lap"], seq)))
    return stepped.groupBy(run, "n_lap").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.max_by("time_s", seq) - F.min_by("time_s", seq), 2).alias("lap_time_s"),
        (F.max("time_s") - F.min("time_s")).alias("duration_s"),
        (F.max("s_m") - F.min("s_m")).alias("distance_m"),
        F.max(F.when(F.col("__step") > 0, F.col("__step"))).alias("longest_step_m"),
    )


def valid_laps(laps: DataFrame, least_s: float = 10.0, most_step_m: float = 100.0) -> DataFrame:
    """Laps that last long enough and have no gap in the distance."""
    return laps.where((F.col("duration_s") >= least_s) & (F.coalesce("longest_step_m", F.lit(0.0)) <= most_step_m))


def covered_laps(laps: DataFrame, share: float = 0.05, run: str = RUN) -> DataFrame:
    """Laps that cover at least ``share`` of the longest lap of their run."""
    longest = laps.groupBy(run).agg(F.max("distance_m").alias("track_m"))
    return laps.join(longest, run).where(F.col("distance_m") >= share * F.col("track_m"))


def track_lengths(laps: DataFrame, run: str = RUN) -> DataFrame:
    return laps.groupBy(run).agg(F.max("distance_m").alias("track_m"))


def trimmed_laps(df: DataFrame, run: str = RUN, seq: str = SEQ) -> DataFrame:
    """Rows for per-lap files: a lap of more than two rows loses its first and last one."""
    lap = ordered([run, "n_lap"], seq)
    numbered = df.withColumn("__no", F.row_number().over(lap)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(run, "n_lap")))
    return numbered.where((F.col("__n") <= 2) | ((F.col("__no") > 1) & (F.col("__no") < F.col("__n")))).drop("__no", "__n")

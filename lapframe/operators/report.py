"""Lap, sector and run figures for a report, for all runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapframe.functions.series import RUN, SEQ, ordered, trailing_mean, with_position
from lapframe.operators.laps import lap_table, track_lengths

KPI_CHANNELS = ("vx_mps", "ay_mps2", "engine_trq_req_nm", "ax_mps2", "a_total_mps2")


def sector_bounds(df: DataFrame, run: str = RUN, seq: str = SEQ) -> DataFrame:
    """run_id, n_lap, sector (1 to 3), start_pos, end_pos, start_s, end_s, start_t, end_t, track_m.

    A sector ends at the lap's first row whose distance reaches a third, two thirds, all of the
    track; a lap that does not get there ends the sector at its last row, and sectors after that are empty.
    """
    track = track_lengths(lap_table(df, run, seq), run)
    placed = with_position(df.select(run, seq, "n_lap", "s_m", "time_s"), [run, "n_lap"], seq)
    spot = F.struct("pos", "s_m", "time_s")
    reach = [F.min(F.when(F.col("s_m") >= F.col("track_m") * F.lit(k / 3.0) if k < 3 else F.col("s_m") >= F.col("track_m"), spot)).alias(f"at{k}") for k in (1, 2, 3)]
    got = placed.join(track, run).groupBy(run, "n_lap", "track_m").agg(F.min(spot).alias("at0"), F.max(spot).alias("last"), *reach)
    # once a sector ends at the last row, the rest of them start and end there
    end1 = F.coalesce("at1", "last")
    end2 = F.when(end1["pos"] == F.col("last")["pos"], F.col("last")).otherwise(F.coalesce("at2", "last"))
    end3 = F.when(end2["pos"] == F.col("last")["pos"], F.col("last")).otherwise(F.coalesce("at3", "last"))
    got = got.withColumns({"e1": end1, "e2": end2, "e3": end3})
    sectors = F.array(*[F.struct(F.lit(k).alias("sector"), F.col(a).alias("a"), F.col(b).alias("b")) for k, (a, b) in enumerate((("at0", "e1"), ("e1", "e2"), ("e2", "e3")), 1)])
    rows = got.select(run, "n_lap", "track_m", F.explode(sectors).alias("x")).select(run, "n_lap", "track_m", "x.*")
    return rows.select(
        run, "n_lap", "sector", F.col("a.pos").alias("start_pos"), F.col("b.pos").alias("end_pos"), F.col("a.s_m").alias("start_s"),
        F.col("b.s_m").alias("end_s"), F.col("a.time_s").alias("start_t"), F.col("b.time_s").alias("end_t"), "track_m",
    )


def sector_times(bounds: DataFrame, completion: float = 0.95, run: str = RUN) -> DataFrame:
    """run_id, n_lap, sector, time_s to 0.1 s; NULL for a sector that is empty or not driven far enough."""
    time = F.bround(F.col("end_t") - F.col("start_t"), 1)
    driven = (F.col("start_pos") < F.col("end_pos")) & (F.col("end_s") - F.col("start_s") >= F.col("track_m") / 3.0 * completion) & (time > 0)
    return bounds.select(run, "n_lap", "sector", F.when(driven, time).alias("time_s"))


def best_sectors(times: DataFrame, run: str = RUN) -> DataFrame:
    """run_id, sector, best_s, best_lap: the fastest lap of each sector, the earlier one on a tie."""
    best = F.min(F.struct("time_s", "n_lap"))
    return times.where("time_s is not null").groupBy(run, "sector").agg(best.alias("b")).select(run, "sector", F.col("b.time_s").alias("best_s"), F.col("b.n_lap").alias("best_lap"))


def best_and_average(laps: DataFrame, run: str = RUN) -> DataFrame:
    """run_id, best_lap_s (of laps over 99 % of the track), mean_lap_s (over 95 %)."""
    both = laps.join(track_lengths(laps, run), run)
    return both.groupBy(run).agg(
        F.min(F.when(F.col("distance_m") > 0.99 * F.col("track_m"), F.col("duration_s"))).alias("best_lap_s"),
        F.avg(F.when(F.col("distance_m") > 0.95 * F.col("track_m"), F.col("duration_s"))).alias("mean_lap_s"),
    )


def representative_laps(laps: DataFrame, run: str = RUN) -> DataFrame:
    """run_id, n_lap: the second lap over 98 % of the track, else the first such, else the longest."""
    w = Window.partitionBy(run)
    full = F.col("distance_m") >= 0.98 * F.col("track_m")
    ranked = laps.withColumn("track_m", F.max("distance_m").over(w)).withColumn("full", full)
    ranked = ranked.withColumn("nth", F.row_number().over(Window.partitionBy(run, "full").orderBy("n_lap")))
    # the longest lap is itself over 98 %, so one always is
    return ranked.where(F.col("full") & (F.col("nth") <= 2)).groupBy(run).agg(F.max_by("n_lap", "nth").alias("n_lap"))


def _rolled(df: DataFrame, keys: list[str], rows: int, seq: str, channels: tuple[str, ...]) -> DataFrame:
    w = ordered(keys, seq)
    return df.withColumns({f"__{c}": trailing_mean(F.abs(c) if c == "ay_mps2" else c, rows, w) for c in channels})


def _figures(channels: tuple[str, ...]) -> list[Column]:
    names = {"vx_mps": "max_speed", "ay_mps2": "max_lateral", "engine_trq_req_nm": "max_torque", "ax_mps2": "max_longitudinal", "a_total_mps2": "max_combined"}
    out = [(F.round(F.max(f"__{c}"), 2) if c in channels else F.lit(None).cast("double")).alias(n) for c, n in names.items()]
    low = F.round(F.min("__ax_mps2"), 2) if "ax_mps2" in channels else F.lit(None).cast("double")
    return [*out, low.alias("min_longitudinal")]


def lap_kpis(df: DataFrame, rows: int = 5, run: str = RUN, seq: str = SEQ) -> DataFrame:
    """Extremes per lap of means over the last ``rows`` rows. A channel that is absent gives NULL."""
    there = tuple(c for c in KPI_CHANNELS if c in df.columns)
    return _rolled(df, [run, "n_lap"], rows, seq, there).groupBy(run, "n_lap").agg(*_figures(there))


def sector_kpis(df: DataFrame, rows: int = 5, run: str = RUN, seq: str = SEQ) -> DataFrame:
    """The same per sector; means start anew in each, and a lap's last row belongs to none."""
    there = tuple(c for c in KPI_CHANNELS if c in df.columns)
    b = sector_bounds(df, run, seq).groupBy(run, "n_lap").pivot("sector", [1, 2, 3]).agg(F.first("start_pos"))
    placed = with_position(df, [run, "n_lap"], seq).withColumn("__last", F.lead(F.lit(1)).over(ordered([run, "n_lap"], seq)).isNull())
    joined = placed.join(b, [run, "n_lap"])
    sector = F.when(F.col("pos") < F.col("2"), 1).when(F.col("pos") < F.col("3"), 2).otherwise(3)
    rowset = joined.withColumn("sector", sector).where(~F.col("__last") | (F.col("sector") < 3))
    return _rolled(rowset, [run, "n_lap", "sector"], rows, seq, there).groupBy(run, "n_lap", "sector").agg(*_figures(there))


def overall_stats(df: DataFrame, rows: int = 30, run: str = RUN, seq: str = SEQ) -> DataFrame:
    """run_id and extremes over all laps joined end to end: means run on over lap borders, and lateral keeps its sign."""
    w = Window.partitionBy(run).orderBy("n_lap", seq)
    mean = {c: trailing_mean(c, rows, w) for c in ("v_mps", "ay_mps2", "ax_mps2", "a_total_mps2") if c in df.columns}
    rolled = df.withColumns({f"__{c}": m for c, m in mean.items()})
    value = lambda f, c: (F.round(f(f"__{c}"), 2) if c in mean else F.lit(None).cast("double"))
    return rolled.groupBy(run).agg(
        value(F.max, "v_mps").alias("top_speed"), value(F.max, "ay_mps2").alias("max_lateral"), value(F.max, "ax_mps2").alias("max_longitudinal"),
        value(F.min, "ax_mps2").alias("max_braking"), value(F.max, "a_total_mps2").alias("max_combined"),
    )


def axis_bounds(df: DataFrame, rows: int = 30, run: str = RUN, seq: str = SEQ) -> DataFrame:
    """Bounds of an acceleration diagram: at least 10 and -10 across, 5 and -10 along; full means per lap alone count."""
    w = ordered([run, "n_lap"], seq)
    rolled = df.withColumns({f"__{c}": trailing_mean(c, rows, w, full=True) for c in ("ay_mps2", "ax_mps2")})
    return rolled.groupBy(run).agg(
        F.greatest(F.lit(10.0), F.max("__ay_mps2")).alias("ay_max"), F.least(F.lit(-10.0), F.min("__ay_mps2")).alias("ay_min"),
        F.greatest(F.lit(5.0), F.max("__ax_mps2")).alias("ax_max"), F.least(F.lit(-10.0), F.min("__ax_mps2")).alias("ax_min"),
    )


def run_totals(df: DataFrame, run: str = RUN, seq: str = SEQ, places: tuple[int, int] = (2, 3)) -> DataFrame:
    """run_id, run_min, track_km, to some places."""
    time = df.groupBy(run).agg(F.round(F.max("time_s") / 60.0, places[0]).alias("run_min"))
    track = track_lengths(lap_table(df, run, seq), run).select(run, F.round(F.col("track_m") / 1000.0, places[1]).alias("track_km"))
    return time.join(track, run)


def lap_time_text(seconds: Column) -> Column:
    """m:ss.t; ``--`` for none or a negative time. Tenths carry over, so 59.96 s is 1:00.0."""
    tenths = F.bround(seconds * 10.0, 0).cast("long")
    text = F.format_string("%d:%02d.%d", F.floor(tenths / 600).cast("long"), F.floor(F.pmod(tenths, F.lit(600)) / 10).cast("long"), F.pmod(tenths, F.lit(10)))
    return F.when(seconds >= 0, text).otherwise(F.lit("--"))


def scaled_time(value: Column) -> Column:
    """Times stored without their decimal point: whole numbers under 10 are hundredths, others thousandths."""
    whole = value == F.floor(value)
    return F.when(whole & (value < 10), value * 0.01).when(whole, value * 0.001).otherwise(value)

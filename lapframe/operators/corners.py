"""Corners: apices of the curvature, the points around them, and labels for every row.

A lap's rows are windows in one order, which find all kinds of points in one pass and keep the few
rows that are any; the surroundings of its peaks are looked at in NumPy, many laps to an Arrow batch; its few characteristic points are
windows over the points laid out twice, so that searching backward and forward wraps around the
lap's ends; its corners are one array, which each row looks itself up in.

Defined cases: a NULL takes part in no comparison. A lap without apices, or of under three
rows, has no corners. Where corners overlap the one with the larger number holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lapframe.functions.series import RUN, SEQ, diff, gradient, ordered, so_far, with_position
from lapframe.operators.chunks import by_series, numbers, parts_for
from lapframe.session import dealt, materialize

INPUTS = ("n_lap", "s_m", "curvature_smoothed", "ay_mps2_smoothed", "v_mps", "r_cos_phi_smoothed")
NONE = "-"

# Fixed values of the characterisation.
APEX = {"height": 0.002, "distance": 100, "least_prominence": 0.001, "least_width": 50}
APEX_LATERAL, LOW_LATERAL, STRAIGHT = 5.0, 2.5, 0.002
SIGN_GAP_M, LOW_GAP_M, DECEL_GAP_M, NEAR_ROWS = 50.0, 20.0, 50.0, 30
DECEL_LEVEL, DECEL_ROWS, DECEL_QUANTILE = -0.15, 20, 0.75
PHASES, PHASE_LEVELS = ("Braking", "Entry", "Mid", "Exit"), (-0.97, -0.3, 0.1)


# --- points as queries -----------------------------------------------------------------------


def _grouped(points: DataFrame, gap_m: float, run: str, take: str) -> DataFrame:
    """One point per stretch of points whose neighbours lie less than ``gap_m`` apart: the ``median`` place, or the ``last``."""
    keys = [run, "n_lap"]
    w = ordered(keys, "order")
    fresh = F.coalesce(diff("s_m", w) >= gap_m, F.lit(False)).cast("int")
    cut = points.withColumn("__fresh", fresh).withColumn("stretch", F.sum("__fresh").over(so_far(w)).cast("long"))
    place = F.floor(F.percentile("pos", F.lit(0.5))) if take == "median" else F.max_by("pos", "order")
    return cut.groupBy(*keys, "stretch").agg(place.cast("long").alias("pos"), F.count(F.lit(1)).alias("n_points"))


def _changes(channel: str, w: WindowSpec, level: float = 0.0) -> Column:
    sign = F.signum(F.col(channel) - F.lit(level))
    return F.lead(sign).over(w) != sign


def _low_ways(lateral: str, curvature: str, w: WindowSpec) -> Column:
    """The levels, as 0 and 1, that the lateral acceleration is about to cross on what is nearly a straight."""
    straight = F.abs(F.lead(curvature).over(w)) < STRAIGHT
    return F.array_compact(F.array(*[F.when(_changes(lateral, w, level) & straight, F.lit(k)) for k, level in enumerate((LOW_LATERAL, -LOW_LATERAL))]))


def _turns(r_cos_phi: str, w: WindowSpec) -> Column:
    return gradient(F.signum(F.col(r_cos_phi) - F.lit(DECEL_LEVEL)), w) != 0


def _near_turns(placed: DataFrame, r_cos_phi: str, w: WindowSpec, pos: str = "pos") -> DataFrame:
    """``placed`` with ``__slope``, ``__turn`` and ``__reached``: whether a turn's quantile reads the row."""
    marked = placed.withColumns({"__slope": gradient(r_cos_phi, w), "__turn": F.coalesce(_turns(r_cos_phi, w), F.lit(False))})
    last = F.last(F.when(F.col("__turn"), F.col(pos)), ignorenulls=True).over(so_far(w))
    return marked.withColumn("__reached", F.coalesce(F.col(pos) - last < DECEL_ROWS, F.lit(False)))


def _falling(reached: DataFrame, keys: list[str], falls_below: float) -> DataFrame:
    """The turns from which on the upper quartile of the slope is under ``falls_below``; only rows that a turn reaches are looked at, which are all rows that its frame has."""
    w = ordered(keys, "pos")
    got = reached.withColumn("__falls", F.percentile("__slope", F.lit(DECEL_QUANTILE)).over(w.rangeBetween(0, DECEL_ROWS - 1)))
    return got.where(F.col("__turn") & (F.col("__falls") < falls_below))


def _by_way(points: DataFrame) -> DataFrame:
    return points.withColumn("__way", F.explode("__ways")).withColumn("order", F.col("pos") * 2 + F.col("__way"))


def sign_changes(laps: DataFrame, channel: str, level: float = 0.0, gap_m: float = SIGN_GAP_M, run: str = RUN, seq: str = SEQ) -> DataFrame:
    """run_id, n_lap, stretch, pos, n_points: where ``channel`` is about to cross ``level``; crossings close together count once."""
    keys = [run, "n_lap"]
    points = with_position(laps, keys, seq).withColumn("__changes", _changes(channel, ordered(keys, seq), level)).where("__changes")
    return _grouped(points.withColumn("order", F.col("pos")), gap_m, run, "median")


def low_acceleration_points(laps: DataFrame, lateral: str = "ay_mps2_smoothed", curvature: str = "curvature_smoothed", run: str = RUN, seq: str = SEQ) -> DataFrame:
    """Where the lateral acceleration is about to cross plus or minus 2.5 on what is nearly a straight."""
    keys = [run, "n_lap"]
    marked = with_position(laps, keys, seq).withColumn("__ways", _low_ways(lateral, curvature, ordered(keys, seq)))
    return _grouped(_by_way(marked), LOW_GAP_M, run, "median")


def deceleration_points(laps: DataFrame, r_cos_phi: str = "r_cos_phi_smoothed", run: str = RUN, seq: str = SEQ, falls_below: float = 0.0) -> DataFrame:
    """Where braking sets in: the ratio passes -0.15 while the upper quartile of its slope over 20 rows is under ``falls_below``."""
    keys = [run, "n_lap"]
    reached = _near_turns(with_position(laps, keys, seq), r_cos_phi, ordered(keys, seq)).where("__reached")
    return _grouped(_falling(reached, keys, falls_below).withColumn("order", F.col("pos")), DECEL_GAP_M, run, "last")


# --- peaks -------------------------------------------------------------------------------------


def _maxima(x: np.ndarray) -> np.ndarray:
    """Places strictly above both sides; of a plateau its middle, rounded down. The ends, and places beside a NaN, are none."""
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    ends, level = np.r_[starts[1:], len(x)] - 1, x[starts]
    top = np.flatnonzero((level[:-2] < level[1:-1]) & (level[2:] < level[1:-1])) + 1
    return (starts[top] + ends[top]) // 2


def _spaced(places: np.ndarray, x: np.ndarray, distance: int) -> np.ndarray:
    """What no higher one lies closer to than ``distance``; of equals the later one is first."""
    left = places[np.lexsort((-places, -x[places]))]
    kept = []
    while len(left):
        kept.append(left[0])
        left = left[np.abs(left - left[0]) >= distance]
    return np.array(kept, np.int64)


def _foot(side: np.ndarray) -> np.ndarray:
    """Of ``side`` (from the peak away) the part down to the nearest of the lowest values before anything above the peak."""
    above = side > side[0]
    part = side[: above.argmax()] if above.any() else side
    return part[: np.nanargmin(part) + 1]


def _crossing(side: np.ndarray, level: float) -> float:
    """How far from the peak ``side`` comes down to ``level``, linear between samples."""
    k = int((side <= level).argmax())
    return k - (level - side[k]) / (side[k - 1] - side[k]) if side[k] < level else float(k)


def _shape(x: np.ndarray, at: int) -> tuple[float, float]:
    """(prominence, width at half of it) of the peak at place ``at``."""
    left, right = _foot(x[at::-1]), _foot(x[at:])
    high = x[at] - max(left[-1], right[-1])
    return high, _crossing(left, x[at] - high / 2.0) + _crossing(right, x[at] - high / 2.0)


def peaks(placed: DataFrame, x: str, keys: list[str], height: float, distance: int, least_prominence: float, least_width: float) -> DataFrame:
    """keys, pos, prominence, width: local maxima by height, then spacing, then prominence, then width at half of it. ``placed`` has pos."""

    def of(series: pa.Table) -> dict | None:
        values = numbers(series, "__x")
        tops = _maxima(values)
        tops = _spaced(tops[values[tops] >= height], values, distance)
        found = [(int(p), *map(float, _shape(values, p))) for p in tops]
        found = [f for f in found if f[1] >= least_prominence and f[2] >= least_width]
        return dict(zip(("pos", "prominence", "width"), zip(*found, strict=True), strict=True)) if found else None

    series = placed.select(*keys, "pos", F.col(x).cast("double").alias("__x"))
    return by_series(series, keys, ["pos"], of, {"pos": "long", "prominence": "double", "width": "double"}, parts_for(series))


# --- characteristic points and corners -----------------------------------------------------------


def _marked(df: DataFrame, run: str, seq: str) -> DataFrame:
    """``df`` with each row's place in its lap, and what it is a candidate for; one order for all."""
    keys, w = [run, "n_lap"], ordered([run, "n_lap"], seq)
    placed = with_position(df, keys, seq, "__pos")
    placed = placed.withColumns({"__changes": F.coalesce(_changes("ay_mps2_smoothed", w), F.lit(False)), "__ways": _low_ways("ay_mps2_smoothed", "curvature_smoothed", w)})
    return _near_turns(placed, "r_cos_phi_smoothed", w, "__pos")


def _at_apices(marked: DataFrame, run: str = RUN) -> DataFrame:
    """run_id, n_lap, apex, apex_speed: the rows that may be an apex by their lateral acceleration, to be looked up by hash."""
    return marked.where(F.abs("ay_mps2_smoothed") > APEX_LATERAL).select(run, "n_lap", F.col("__pos").alias("apex"), F.col("v_mps").alias("apex_speed"))


def characteristic_points(marked: DataFrame, run: str = RUN) -> DataFrame:
    """run_id, n_lap, pos, kind of the laps that have an apex: apex, deceleration, lat_accel_change, low_lat_accel.

    Each kind filters the stored rows first, so only candidates are dealt and sorted.
    """
    keys = [run, "n_lap"]
    marked = marked.withColumn("pos", F.col("__pos"))
    tops = peaks(marked.select(*keys, "pos", F.abs("curvature_smoothed").alias("bend")), "bend", keys, **APEX)
    apices = _at_apices(marked, run).join(tops.withColumnRenamed("pos", "apex").hint("shuffle_hash"), [*keys, "apex"]).withColumnRenamed("apex", "pos")
    changes = _grouped(marked.where("__changes").withColumn("order", F.col("pos")), SIGN_GAP_M, run, "median")
    lows = without_near_changes(_grouped(_by_way(marked.where(F.size("__ways") > 0)), LOW_GAP_M, run, "median"), changes, run=run)
    brakes = _grouped(_falling(dealt(marked.where("__reached").select(*keys, "pos", "s_m", "__slope", "__turn"), *keys), keys, 0.0).withColumn("order", F.col("pos")), DECEL_GAP_M, run, "last")
    kinds = {"apex": apices, "deceleration": brakes, "lat_accel_change": changes, "low_lat_accel": lows}
    points = None
    for kind, found in kinds.items():
        own = found.select(*keys, F.col("pos").cast("long").alias("pos"), F.lit(kind).alias("kind"))
        points = own if points is None else points.unionByName(own)
    w = Window.partitionBy(*keys)
    return points.withColumn("apices", F.count_if(F.col("kind") == "apex").over(w)).where("apices > 0").drop("apices")


def corner_bounds(points: DataFrame, run: str = RUN) -> DataFrame:
    """run_id, n_lap, corner_no, apex, start, end: of each apex the places where its corner begins and ends, around the lap's ends.

    Back from an apex the nearest deceleration or apex decides: a deceleration is the start; before
    another apex it is the point next to our apex, if any lies between, else the apex itself. The next point is the end, or the apex itself
    if that is another apex.
    """
    keys = [run, "n_lap"]
    w = Window.partitionBy(*keys).orderBy("pos", "kind")
    numbered = points.withColumns({"no": F.row_number().over(w), "m": F.count(F.lit(1)).over(Window.partitionBy(*keys)), "corner_no": F.sum((F.col("kind") == "apex").cast("int")).over(so_far(w))})
    thrice = numbered.withColumn("round", F.explode(F.array(*[F.lit(k) for k in range(3)]))).withColumn("at", F.col("no") + F.col("round") * F.col("m"))
    around = Window.partitionBy(*keys).orderBy("at")
    stops = F.when(F.col("kind").isin("apex", "deceleration"), F.struct("at", "pos", "kind"))
    laid = thrice.withColumns({
        "stop": F.last(stops, ignorenulls=True).over(around.rowsBetween(Window.unboundedPreceding, -1)), "previous": F.lag("pos").over(around),
        "next_pos": F.lead("pos").over(around), "next_kind": F.lead("kind").over(around),
    })
    own = laid.where((F.col("round") == 1) & (F.col("kind") == "apex"))
    alone = F.col("stop.at") == F.col("at") - 1
    start = F.when(F.col("stop.kind") == "deceleration", F.col("stop.pos")).when(alone, F.col("pos")).otherwise(F.col("previous"))
    end = F.when(F.col("next_kind") == "apex", F.col("pos")).otherwise(F.col("next_pos"))
    return own.select(*keys, F.col("corner_no").cast("int").alias("corner_no"), F.col("pos").alias("apex"), start.alias("start"), end.alias("end"))


def label_corners(df: DataFrame, run: str = RUN, seq: str = SEQ) -> DataFrame:
    """``df`` with corner_name, corner_speed and corner_phase; ``-`` outside corners. A missing input channel is an error."""
    if lacking := [c for c in INPUTS if c not in df.columns]:
        raise ValueError(f"corners need the channels {', '.join(lacking)}")
    keys = [run, "n_lap"]
    marked = materialize(_marked(df, run, seq), "corner-inputs")  # each step reads its own few columns and rows of it
    bounds = materialize(corner_bounds(characteristic_points(marked, run), run), "corner-bounds")
    corners = _at_apices(marked, run).join(bounds.hint("shuffle_hash"), [*keys, "apex"]).groupBy(*keys).agg(F.collect_list(F.struct("corner_no", "start", "end", "apex_speed")).alias("__corners"))
    corners = corners.join(marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")), keys)
    placed = marked.select(*df.columns, "__pos").repartition(parts_for(marked), *keys)
    held = placed.join(corners.hint("shuffle_hash"), keys, "left")  # the rows are sorted once, by corner
    # a corner that ends where it starts is the whole lap
    size = F.col("__size")
    inside = lambda c: F.pmod(F.col("__pos") - c["start"], size) < F.coalesce(F.nullif(F.pmod(c["end"] - c["start"], size), F.lit(0)), size)
    held = held.withColumn("__corner", F.array_max(F.filter("__corners", inside))).drop("__corners", "__size")
    no, at = F.col("__corner.corner_no"), F.col("__pos")
    own = Window.partitionBy(*keys, "__no")
    # each phase begins at the last row under its level, or where the one before does
    under = {f"__under_{k}": F.max(F.when(F.col("r_cos_phi_smoothed") < level, at)).over(own) for k, level in enumerate(PHASE_LEVELS, 1)}
    held = held.withColumn("__no", no).withColumns({"__from": F.min(at).over(own), **under})
    begun = lambda k: at >= F.coalesce(*[f"__under_{j}" for j in range(k, 0, -1)], "__from")
    phase = F.element_at(F.array(*[F.lit(p) for p in PHASES]), sum((begun(k).cast("int") for k in range(1, len(PHASES))), F.lit(1)))
    named = lambda c: F.when(F.col("__no").isNotNull(), c).otherwise(NONE)
    labels = {"corner_name": F.concat(F.lit("T"), no), "corner_speed": speed_class("__corner.apex_speed"), "corner_phase": phase}
    return held.select(*df.columns, *[named(c).alias(name) for name, c in labels.items()])


def without_near_changes(lows: DataFrame, changes: DataFrame, rows: int = NEAR_ROWS, run: str = RUN) -> DataFrame:
    """Low-acceleration points that are not within ``rows`` rows of a sign change of their lap."""
    a, b = lows.alias("a"), changes.alias("b")
    near = (F.col(f"a.{run}") == F.col(f"b.{run}")) & (F.col("a.n_lap") == F.col("b.n_lap")) & (F.abs(F.col("a.pos") - F.col("b.pos")) <= rows)
    return a.join(b, near, "left_anti")


def phase_starts(laps: DataFrame, channel: str, levels: tuple[float, ...] = PHASE_LEVELS, run: str = RUN, seq: str = SEQ) -> DataFrame:
    """run_id, n_lap, phase1, phase2, ...: for each level the last row, from the one before on, where ``channel`` lies under it.

    A level that is not met starts where the one before does. One pass over the rows for each level.
    """
    keys = [run, "n_lap"]
    rows = with_position(laps.select(*keys, seq, channel), keys, seq)
    found = rows.select(*keys).distinct()
    before = F.lit(0).cast("long")
    for k, level in enumerate(levels, 1):
        here = rows.join(found, keys).where((F.col("pos") >= before) & (F.col(channel) < level)) if k > 1 else rows.where(F.col(channel) < level)
        last = here.groupBy(*keys).agg(F.max("pos").alias(f"phase{k}"))
        found = found.join(last, keys, "left").withColumn(f"phase{k}", F.coalesce(f"phase{k}", before))
        before = F.col(f"phase{k}")
    return found


def speed_class(v: str | None = "v_mps"):
    """Low, Medium or High Speed."""
    return F.when(F.col(v) < 25, "Low Speed").when(F.col(v) < 40, "Medium Speed").otherwise("High Speed")

"""The engine's queries over the driver's tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapframe.functions.geo import quaternion_angles, to_geographic, to_local
from lapframe.functions.series import (
    centered_mean, diff, direction_segments, forward_quantile, gradient, ordered, sample_rates, so_far, trailing_mean, with_islands,
)
from lapframe.operators import report
from lapframe.operators.align import align_series, interpolate, keep_first, mend_lap_starts, resample, time_grid, to_wide
from lapframe.operators.derive import derive
from lapframe.operators.laps import covered_laps, lap_table, slice_laps, track_lengths, trimmed_laps, valid_laps
from lapframe.operators.smooth import smooth
from lapframe.plans.telemetry import CHANNELS, CIRCUITS, KNOTS, LAP_TABLE, LAPS, RUNS, circuits, knots, runs, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, places: int = 6, but: tuple[str, ...] = ("run_id", "seq", "n_lap")) -> DataFrame:
    """Double columns rounded, minus zero as zero."""
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(F.col(f"`{c}`"), places) + 0.0).alias(c) if kinds[c] == "double" and c not in but else F.col(f"`{c}`") for c in df.columns])


def _r(*names: str, places: int = 6) -> str:
    return ", ".join(f"round({n.split(' AS ')[0]}, {places}) + 0.0::DOUBLE AS {n.split(' AS ')[-1]}" for n in names)


def _laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slice_laps(runs(spark, sf_dir))


# --- laps --------------------------------------------------------------------------------------


@query(f"WITH {RUNS}, {LAPS} SELECT run_id, n_lap, count(*) AS n_rows, min(seq) AS first_seq, max(seq) AS last_seq FROM laps GROUP BY run_id, n_lap")
def lap_slice(spark, sf_dir):
    return _laps(spark, sf_dir).groupBy("run_id", "n_lap").agg(F.count(F.lit(1)).alias("n_rows"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(f"WITH {RUNS}, {LAPS}, {LAP_TABLE} SELECT run_id, n_lap, n_rows, round(lap_s, 2) AS lap_time_s, {_r('distance_m')} FROM lap_table")
def lap_times(spark, sf_dir):
    return _rounded(lap_table(_laps(spark, sf_dir)).select("run_id", "n_lap", "n_rows", "lap_time_s", "distance_m"))


@query(f"""WITH {RUNS}, {LAPS}, {LAP_TABLE} SELECT run_id, n_lap, {_r('duration_s', 'longest_step_m')} FROM lap_table
  JOIN (SELECT run_id, max(distance_m) AS track_m FROM lap_table GROUP BY run_id) USING (run_id)
  WHERE duration_s >= 10 AND coalesce(longest_step_m, 0) <= 100 AND distance_m >= 0.05 * track_m""")
def lap_validity(spark, sf_dir):
    return _rounded(covered_laps(valid_laps(lap_table(_laps(spark, sf_dir)))).select("run_id", "n_lap", "duration_s", "longest_step_m"))


@query(f"WITH {RUNS}, {LAPS}, {LAP_TABLE} SELECT run_id, {_r('max(distance_m) AS track_m')} FROM lap_table GROUP BY run_id")
def track_length(spark, sf_dir):
    return _rounded(track_lengths(lap_table(_laps(spark, sf_dir))))


@query(f"""WITH {RUNS}, {LAPS} SELECT run_id, n_lap, count(*) AS n_rows, {_r('min(time_s) AS first_t', 'max(time_s) AS last_t')}
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id, n_lap ORDER BY seq) AS no, count(*) OVER (PARTITION BY run_id, n_lap) AS n FROM laps)
  WHERE n <= 2 OR (no > 1 AND no < n) GROUP BY run_id, n_lap""")
def lap_export_rows(spark, sf_dir):
    kept = trimmed_laps(_laps(spark, sf_dir))
    return _rounded(kept.groupBy("run_id", "n_lap").agg(F.count(F.lit(1)).alias("n_rows"), F.min("time_s").alias("first_t"), F.max("time_s").alias("last_t")))


# --- windows -------------------------------------------------------------------------------------

_W = "WINDOW w AS (PARTITION BY run_id ORDER BY seq)"


@query(f"""WITH {RUNS} SELECT run_id, seq, {_r('avg(vx_mps) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS m30',
  'avg(ay_mps2) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m5')} FROM runs""")
def smooth_centered(spark, sf_dir):
    w = ordered()
    return _rounded(runs(spark, sf_dir).select("run_id", "seq", centered_mean("vx_mps", 30, w).alias("m30"), centered_mean("ay_mps2", 5, w).alias("m5")))


@query(f"""WITH {RUNS} SELECT run_id, seq, {_r('avg(vx_mps) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS vx_mps_smoothed',
  'avg(ay_mps2) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) AS ay_mps2_smoothed')} FROM runs""")
def smooth_filters(spark, sf_dir):
    out = smooth(runs(spark, sf_dir), {"vx_mps": 0.5, "ay_mps2": 1.25, "ax_mps2": 0.04, "not_there": 1.0})
    return _rounded(out.select("run_id", "seq", "vx_mps_smoothed", "ay_mps2_smoothed"))


@query(f"""WITH {RUNS} SELECT run_id, seq, {_r('avg(ax_mps2) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS last5')},
  CASE WHEN seq >= 29 THEN round(avg(ay_mps2) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) + 0.0::DOUBLE END AS full30 FROM runs""")
def rolling_trailing(spark, sf_dir):
    w = ordered()
    return _rounded(runs(spark, sf_dir).select("run_id", "seq", trailing_mean("ax_mps2", 5, w).alias("last5"), trailing_mean("ay_mps2", 30, w, full=True).alias("full30")))


@query(f"WITH {RUNS} SELECT run_id, seq, {_r('quantile_cont(vx_mps, 0.75) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS q75')} FROM runs")
def forward_quantiles(spark, sf_dir):
    return _rounded(runs(spark, sf_dir).select("run_id", "seq", forward_quantile("vx_mps", 20, 0.75, ordered()).alias("q75")))


@query(f"""WITH {RUNS}, g AS (SELECT run_id, seq, yaw_rate_radps AS y, lag(yaw_rate_radps) OVER w AS b, lead(yaw_rate_radps) OVER w AS a FROM runs {_W}) SELECT run_id, seq,
  {_r('CASE WHEN b IS NULL THEN (a - y) WHEN a IS NULL THEN (y - b) ELSE (a - b) / 2 END AS unit_gradient')}, {_r('y - b AS step')} FROM g""")
def gradients(spark, sf_dir):
    w = ordered()
    return _rounded(runs(spark, sf_dir).select("run_id", "seq", gradient("yaw_rate_radps", w).alias("unit_gradient"), diff("yaw_rate_radps", w).alias("step")))


@query(f"""WITH {RUNS}, h AS (SELECT run_id, quantile_cont(step, 0.5) AS h FROM (SELECT run_id, time_s - lag(time_s) OVER w AS step FROM runs {_W}) GROUP BY run_id),
  g AS (SELECT run_id, seq, yaw_rate_radps AS y, lag(yaw_rate_radps) OVER w AS b, lead(yaw_rate_radps) OVER w AS a FROM runs {_W})
  SELECT run_id, seq, {_r('CASE WHEN b IS NULL THEN (a - y) / h WHEN a IS NULL THEN (y - b) / h ELSE (a - b) / (2 * h) END AS yaw_accel_radps2', places=5)} FROM g JOIN h USING (run_id)""")
def yaw_gradient(spark, sf_dir):
    return _rounded(derive(runs(spark, sf_dir), only={"yaw_acceleration"}).select("run_id", "seq", "yaw_accel_radps2"), 5)


@query(f"WITH {RUNS} SELECT run_id, {_r('(count(*) - 1) / (max(time_s) - min(time_s)) AS sample_hz')} FROM runs GROUP BY run_id HAVING max(time_s) > min(time_s)")
def sample_rate(spark, sf_dir):
    return _rounded(sample_rates(runs(spark, sf_dir)).where("sample_hz is not null"))


@query(f"""WITH {RUNS}, f AS (SELECT *, CASE WHEN seq > 0 AND ay_mps2 IS NOT DISTINCT FROM lag(ay_mps2) OVER w THEN 0 ELSE 1 END AS fresh FROM runs {_W}),
  i AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM f)
  SELECT run_id, island, count(*) AS n_rows, {_r('any_value(ay_mps2) AS level', 'avg(pos_x_m) AS label_x', 'avg(pos_y_m) AS label_y')} FROM i GROUP BY run_id, island""")
def island_groups(spark, sf_dir):
    got = with_islands(runs(spark, sf_dir), "ay_mps2")
    return _rounded(got.groupBy("run_id", "island").agg(F.count(F.lit(1)).alias("n_rows"), F.first("ay_mps2").alias("level"), F.avg("pos_x_m").alias("label_x"), F.avg("pos_y_m").alias("label_y")))


@query(f"""WITH {RUNS}, d AS (SELECT run_id, seq, sign(vx_mps - lag(vx_mps) OVER w) AS sg FROM runs {_W}), t AS (SELECT run_id, seq, coalesce(CAST(sg <> lag(sg) OVER w AS INT), 0) AS turn FROM d {_W})
  SELECT run_id, CAST(max(segment) AS BIGINT) AS last_segment, CAST(sum(segment) AS BIGINT) AS check_sum FROM (SELECT run_id, sum(turn) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS segment FROM t) GROUP BY run_id""")
def direction_changes(spark, sf_dir):
    got = direction_segments(runs(spark, sf_dir), "vx_mps")
    return got.groupBy("run_id").agg(F.max("segment").alias("last_segment"), F.sum("segment").alias("check_sum"))


@query(f"""WITH {RUNS}, p AS (SELECT *, coalesce(hypot_(pos_x_m - lag(pos_x_m) OVER w, pos_y_m - lag(pos_y_m) OVER w), 0) AS step, s_m - lag(s_m) OVER w < -300 AS crossed FROM runs {_W}),
  c AS (SELECT *, sum(step) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS far FROM p)
  SELECT run_id, seq, {_r('far - max(CASE WHEN crossed THEN far ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s_path', places=5)} FROM c""".replace(
    "hypot_(pos_x_m - lag(pos_x_m) OVER w, pos_y_m - lag(pos_y_m) OVER w)", "sqrt(power(pos_x_m - lag(pos_x_m) OVER w, 2) + power(pos_y_m - lag(pos_y_m) OVER w, 2))"))
def path_distance_reset(spark, sf_dir):
    from lapframe.operators.distance import reset_distance

    crossed = F.when(diff("s_m", ordered()) < -300, 1)
    marked = runs(spark, sf_dir).withColumns({"__crossed": crossed, "__usable": F.lit(1)}).drop("s_m")
    return _rounded(reset_distance(marked).select("run_id", "seq", F.col("s_m").alias("s_path")), 5)


@query(f"WITH {RUNS} SELECT run_id, seq, CASE WHEN s_m - lag(s_m) OVER w >= -10 THEN s_m ELSE 0 END AS s_m FROM runs {_W}")
def lap_start_mend(spark, sf_dir):
    return mend_lap_starts(runs(spark, sf_dir)).select("run_id", "seq", "s_m")


# --- derived channels ------------------------------------------------------------------------------

_MOTION = """m AS (SELECT *, sqrt(vx_mps * vx_mps + vy_mps * vy_mps) AS v_mps, CASE WHEN vx_mps >= 3 THEN atan2(vy_mps, vx_mps) ELSE 0 END AS beta_rad,
  sqrt(ax_mps2 * ax_mps2 + ay_mps2 * ay_mps2) AS a_total_mps2, CASE WHEN ax_mps2 = 0 AND ay_mps2 = 0 THEN NULL ELSE ax_mps2 / sqrt(ax_mps2 * ax_mps2 + ay_mps2 * ay_mps2) END AS r_cos_phi FROM runs)"""
_CURVE = """rad AS (SELECT *, greatest(-10000, least(10000, CASE WHEN v_mps >= 3 AND ay_mps2 <> 0 THEN v_mps * v_mps / (ay_mps2 * cos(beta_rad)) ELSE 0 END)) AS radius_m FROM m),
  cv AS (SELECT *, CASE WHEN radius_m <> 0 THEN 1 / radius_m ELSE 0 END AS curvature FROM rad),
  cs AS (SELECT *, avg(curvature) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS curvature_smoothed FROM cv)"""


def _derived(spark, sf_dir, *columns, places=6, more=None):
    df = runs(spark, sf_dir)
    df = df.withColumns(more) if more else df
    return _rounded(derive(df).select("run_id", "seq", *columns), places)


@query(f"WITH {RUNS}, {_MOTION}, {_CURVE} SELECT run_id, seq, {_r('v_mps', 'beta_rad', 'a_total_mps2', 'radius_m', 'curvature', 'r_cos_phi')} FROM cv")
def derive_motion(spark, sf_dir):
    return _derived(spark, sf_dir, "v_mps", "beta_rad", "a_total_mps2", "radius_m", "curvature", "r_cos_phi")


@query(f"""WITH {RUNS}, {_MOTION}, {_CURVE} SELECT run_id, seq, {_r('curvature_smoothed', '3.0 * curvature_smoothed AS delta_f_kinematic_rad',
  'CASE WHEN v_mps > 3 THEN v_mps * delta_f_rad / 3.0 ELSE 0 END AS yaw_rate_kinematic_radps')},
  {_r('CASE WHEN v_mps > 3 AND abs(ay_mps2) >= 1 THEN delta_f_rad / ay_mps2 - 3.0 / (v_mps * v_mps) END AS understeer_gradient')} FROM cs""")
def derive_stability(spark, sf_dir):
    return _derived(spark, sf_dir, "curvature_smoothed", "delta_f_kinematic_rad", "yaw_rate_kinematic_radps", "understeer_gradient")


_ALPHA = "CASE WHEN vx_mps >= 3 THEN {d} - atan2(vy_mps + yaw_rate_radps * {x}, vx_mps - yaw_rate_radps * {y}) ELSE 0 END"
_AL = {"fl": ("delta_f_rad", 1.5, 0.85), "fr": ("delta_f_rad", 1.5, -0.85), "rl": ("0", -1.5, 0.8), "rr": ("0", -1.5, -0.8)}
_SLIP = "al AS (SELECT *, " + ", ".join(f"{_ALPHA.format(d=d, x=f'({x})', y=f'({y})')} AS alpha_{w}_rad" for w, (d, x, y) in _AL.items()) + " FROM m)"


@query(f"""WITH {RUNS}, {_MOTION}, {_SLIP} SELECT run_id, seq, {_r(*[f'alpha_{w}_rad' for w in _AL], '(alpha_fl_rad + alpha_fr_rad) / 2 AS alpha_f_rad', '(alpha_rl_rad + alpha_rr_rad) / 2 AS alpha_r_rad',
  *[f'v_mps * tan(alpha_{w}_rad) AS lat_slip_velocity_{w}' for w in _AL])} FROM al""")
def derive_slip_angles(spark, sf_dir):
    return _derived(spark, sf_dir, *[f"alpha_{w}_rad" for w in _AL], "alpha_f_rad", "alpha_r_rad", *[f"lat_slip_velocity_{w}" for w in _AL])


def _wheel_speeds(unit: str, factor: float = 1.0) -> dict:
    return {f"whl_{w}_{unit}": F.col("whl_radps") * factor + k for k, w in enumerate(_AL)}


_WHEELS = "wh AS (SELECT *, " + ", ".join(f"whl_radps * 1.0::DOUBLE + {k} AS w_{w}" for k, w in enumerate(_AL)) + " FROM m)"
_LIN = "greatest(-1, least(1, CASE WHEN vx_mps >= 3 THEN (w_{w} - vx_mps) / vx_mps ELSE 0 END))"


@query(f"WITH {RUNS}, {_MOTION}, {_WHEELS} SELECT run_id, seq, {_r(*[_LIN.format(w=w) + f' AS whl_slip_{w}' for w in _AL], *[_LIN.format(w=w) + f' * v_mps AS long_slip_velocity_{w}' for w in _AL])} FROM wh")
def derive_slip_linear(spark, sf_dir):
    return _derived(spark, sf_dir, *[f"whl_slip_{w}" for w in _AL], *[f"long_slip_velocity_{w}" for w in _AL], more=_wheel_speeds("mps"))


def _spin(w: str) -> str:
    d, x, y = _AL[w]
    ahead, aside = f"(vx_mps - yaw_rate_radps * ({y}))", f"(vy_mps + yaw_rate_radps * ({x}))"
    along = f"({ahead} * cos(delta_f_rad) + {aside} * sin(delta_f_rad))" if w[0] == "f" else ahead
    return f"CASE WHEN vx_mps >= 3 THEN (greatest(3, w_{w}) * 0.3 - {along}) / {along} ELSE 0 END"


@query(f"""WITH {RUNS}, {_MOTION}, {_WHEELS} SELECT run_id, seq, {_r(*[_spin(w) + f' AS whl_slip_{w}' for w in _AL], *[f'CASE WHEN v_mps >= 3 THEN v_mps / w_{w} ELSE 0 END AS whl_{w}_radius_m' for w in _AL])} FROM wh""")
def derive_slip_rotation(spark, sf_dir):
    return _derived(spark, sf_dir, *[f"whl_slip_{w}" for w in _AL], *[f"whl_{w}_radius_m" for w in _AL], more=_wheel_speeds("radps"))


_FZ = """fz AS (SELECT *, 800 * 9.81 * 0.5 + 1.8375 * v_mps * v_mps * 0.5 - 80.0 * ax_mps2 AS fz_f, 800 * 9.81 * 0.5 + 1.8375 * v_mps * v_mps * 0.5 + 80.0 * ax_mps2 AS fz_r,
  240.0 / 1.7 * ay_mps2 AS ac_f, 240.0 / 1.6 * ay_mps2 AS ac_r FROM {source})"""


@query(f"""WITH {RUNS}, {_MOTION}, {_FZ.format(source='m')} SELECT run_id, seq, {_r('fz_f AS fz_f_N', 'fz_r AS fz_r_N', 'fz_f / 2 - ac_f / 2 AS fz_fl_N', 'fz_f / 2 + ac_f / 2 AS fz_fr_N',
  'fz_r / 2 - ac_r / 2 AS fz_rl_N', 'fz_r / 2 + ac_r / 2 AS fz_rr_N', '800 * a_total_mps2 / (fz_f + fz_r) AS mue_effective', places=8)} FROM fz""")
def derive_loads(spark, sf_dir):
    return _derived(spark, sf_dir, "fz_f_N", "fz_r_N", "fz_fl_N", "fz_fr_N", "fz_rl_N", "fz_rr_N", "mue_effective", places=8)


_FY = f"""h AS (SELECT run_id, quantile_cont(step, 0.5) AS h FROM (SELECT run_id, time_s - lag(time_s) OVER w AS step FROM runs {_W}) GROUP BY run_id),
  g AS (SELECT *, lag(yaw_rate_radps) OVER w AS b, lead(yaw_rate_radps) OVER w AS a FROM {{source}} {_W}),
  fy AS (SELECT *, 800 * ay_mps2 * 0.5 + 1000.0 / 3.0 * CASE WHEN b IS NULL THEN (a - yaw_rate_radps) / h WHEN a IS NULL THEN (yaw_rate_radps - b) / h ELSE (a - b) / (2 * h) END AS fy_f FROM g JOIN h USING (run_id))"""


@query(f"""WITH {RUNS}, {_MOTION}, {_FZ.format(source='m')}, {_FY.format(source='fz')} SELECT run_id, seq, {_r('fy_f AS fy_f_N', '800 * ay_mps2 - fy_f AS fy_r_N', 'fy_f / fz_f AS fy_f_norm_N',
  '(800 * ay_mps2 - fy_f) / fz_r AS fy_r_norm_N', places=4)} FROM fy""")
def derive_forces(spark, sf_dir):
    return _derived(spark, sf_dir, "fy_f_N", "fy_r_N", "fy_f_norm_N", "fy_r_norm_N", places=4)


@query(f"""WITH {RUNS}, {_MOTION}, {_SLIP}, {_FZ.format(source='al')}, {_FY.format(source='fz')},
  aw AS (SELECT *, 800 * ay_mps2 - fy_f AS fy_r, ((fz_f / 2 - ac_f / 2) * alpha_fl_rad + (fz_f / 2 + ac_f / 2) * alpha_fr_rad) / fz_f AS af, ((fz_r / 2 - ac_r / 2) * alpha_rl_rad + (fz_r / 2 + ac_r / 2) * alpha_rr_rad) / fz_r AS ar FROM fy),
  ef AS (SELECT *, CASE WHEN abs(af) >= 0.01 THEN fy_f / af ELSE 0 END AS ef, CASE WHEN abs(ar) >= 0.01 THEN fy_r / ar ELSE 0 END AS er FROM aw)
  SELECT run_id, seq, {_r('af AS alpha_f_weighted_rad', 'ar AS alpha_r_weighted_rad', places=6)}, {_r('ef AS lateral_slip_efficiency_front', 'er AS lateral_slip_efficiency_rear', places=2)},
  {_r('CASE WHEN ef <> 0 AND er <> 0 OR ef IS NULL AND er IS NULL THEN (ef * fz_f + er * fz_r) / (fz_f + fz_r) ELSE 0 END AS lateral_slip_efficiency_vehicle', places=2)},
  {_r('ef / fz_f AS lateral_slip_efficiency_norm_front', 'er / fz_r AS lateral_slip_efficiency_norm_rear', places=4)} FROM ef""")
def derive_efficiency(spark, sf_dir):
    names = [f"lateral_slip_efficiency_{e}" for e in ("front", "rear", "vehicle")]
    norm = ["lateral_slip_efficiency_norm_front", "lateral_slip_efficiency_norm_rear"]
    got = derive(runs(spark, sf_dir)).select("run_id", "seq", "alpha_f_weighted_rad", "alpha_r_weighted_rad", *names, *norm)
    return got.select("run_id", "seq", *[(F.round(x, 6) + 0.0).alias(x) for x in ("alpha_f_weighted_rad", "alpha_r_weighted_rad")], *[(F.round(x, 2) + 0.0).alias(x) for x in names], *[(F.round(x, 4) + 0.0).alias(x) for x in norm])


@query()
def derive_all(spark, sf_dir):
    """Every derived channel of the registry, in one row per sample."""
    return derive(runs(spark, sf_dir).withColumns(_wheel_speeds("radps")))


# --- alignment -------------------------------------------------------------------------------------


_GRID = f"""WITH {KNOTS}, e AS (SELECT run_id, min(time_s) AS a, max(time_s) AS b FROM knots GROUP BY run_id),
  g AS (SELECT run_id, a + i / 0.25 AS time_s, i AS seq FROM e, range(100000) t(i) WHERE i < ceil((b - a) * 0.25)),
  q AS (SELECT g.run_id, c.channel, g.seq, g.time_s FROM g JOIN (SELECT DISTINCT run_id, channel FROM knots) c USING (run_id)),
  lo AS (SELECT q.*, k.time_s AS ta, k.value AS va FROM q ASOF LEFT JOIN knots k ON q.run_id = k.run_id AND q.channel = k.channel AND q.time_s >= k.time_s),
  hi AS (SELECT lo.*, k.time_s AS tb, k.value AS vb FROM lo ASOF LEFT JOIN knots k ON lo.run_id = k.run_id AND lo.channel = k.channel AND lo.time_s <= k.time_s),
  v AS (SELECT run_id, channel, seq, time_s, CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL OR ta = time_s THEN va ELSE va + (vb - va) / (tb - ta) * (time_s - ta) END AS value FROM hi)"""


@query(f"{_GRID} SELECT run_id, channel, seq, {_r('value', places=5)} FROM v")
def resample_interp(spark, sf_dir):
    k = knots(spark, sf_dir)
    return _rounded(interpolate(k, time_grid(k, 0.25)).select("run_id", "channel", "seq", "value"), 5)


@query(f"""WITH {KNOTS}, k1 AS (SELECT *, row_number() OVER (PARTITION BY run_id, channel, floor(time_s) ORDER BY seq) AS no FROM knots)
  SELECT run_id, channel, CAST(floor(time_s) AS BIGINT) AS hour, seq, value FROM k1 WHERE no = 1""")
def dedup_keep_first(spark, sf_dir):
    k = knots(spark, sf_dir).withColumn("hour", F.floor("time_s").cast("long"))
    return keep_first(k, ["run_id", "channel", "hour"], ["seq"]).select("run_id", "channel", "hour", "seq", "value")


@query(f"WITH {KNOTS} SELECT run_id, seq, " + ", ".join(f"max(CASE WHEN channel = '{c}' THEN value END) AS \"{c}\"" for c in CHANNELS) + " FROM knots GROUP BY run_id, seq")
def channel_pivot(spark, sf_dir):
    return to_wide(knots(spark, sf_dir), CHANNELS, ["run_id", "seq"])


@query(f"{_GRID} SELECT run_id, seq, round(seq / 0.25, 6) AS time_s, " + ", ".join(f"round(max(CASE WHEN channel = '{c}' THEN value END), 5) + 0.0::DOUBLE AS \"{c}\"" for c in CHANNELS) + " FROM v GROUP BY run_id, seq")
def resample_wide(spark, sf_dir):
    """Rows that hold one channel each, onto a grid with all channels in every row."""
    rows = to_wide(knots(spark, sf_dir), CHANNELS, ["run_id", "seq", "time_s"])
    return _rounded(resample(rows, CHANNELS, 0.25), 5)


@query(f"""{_GRID.replace("i < ceil((b - a) * 0.25)", "i <= ceil((b - a) * 0.25)").replace("FROM q ASOF LEFT JOIN knots k", "FROM q ASOF LEFT JOIN k1 k").replace("FROM lo ASOF LEFT JOIN knots k", "FROM lo ASOF LEFT JOIN k1 k").replace("  q AS (", "  k1 AS (SELECT * FROM knots QUALIFY row_number() OVER (PARTITION BY run_id, channel, time_s ORDER BY seq) = 1), q AS (").replace("CASE WHEN ta IS NULL THEN vb", "CASE WHEN ta IS NULL THEN NULL")}
  SELECT run_id, channel, seq, {_r('time_s', 'value', places=5)} FROM v""")
def series_alignment(spark, sf_dir):
    """Series with clocks of their own on one grid per run, without values before a series begins."""
    return _rounded(align_series(knots(spark, sf_dir), 0.25), 5)


@query(f"""WITH {KNOTS}, b AS (SELECT *, lag(floor(value / 100)) OVER (PARTITION BY run_id, channel ORDER BY time_s, seq) AS before, row_number() OVER (PARTITION BY run_id, channel ORDER BY time_s, seq) AS no FROM knots)
  SELECT run_id, channel, seq, value FROM b WHERE no = 1 OR floor(value / 100) IS DISTINCT FROM before""")
def consecutive_dedup(spark, sf_dir):
    w = Window.partitionBy("run_id", "channel").orderBy("time_s", "seq")
    level = F.floor(F.col("value") / 100)
    fresh = (F.row_number().over(w) == 1) | ~level.eqNullSafe(F.lag(level).over(w))
    return knots(spark, sf_dir).withColumn("fresh", fresh).where("fresh").select("run_id", "channel", "seq", "value")


# --- report ----------------------------------------------------------------------------------------

_BOUNDS = """placed AS (SELECT *, row_number() OVER (PARTITION BY run_id, n_lap ORDER BY seq) - 1 AS pos FROM laps), tr AS (SELECT run_id, max(distance_m) AS track_m FROM lap_table GROUP BY run_id),
  ends AS (SELECT run_id, n_lap, any_value(track_m) AS track_m, max(pos) AS last_pos, min(CASE WHEN s_m >= track_m * (1 / 3.0::DOUBLE) THEN pos END) AS p1, min(CASE WHEN s_m >= track_m * (2 / 3.0::DOUBLE) THEN pos END) AS p2, min(CASE WHEN s_m >= track_m THEN pos END) AS p3
    FROM placed JOIN tr USING (run_id) GROUP BY run_id, n_lap),
  e1 AS (SELECT *, coalesce(p1, last_pos) AS b1 FROM ends), e2 AS (SELECT *, CASE WHEN b1 = last_pos THEN last_pos ELSE coalesce(p2, last_pos) END AS b2 FROM e1), e3 AS (SELECT *, CASE WHEN b2 = last_pos THEN last_pos ELSE coalesce(p3, last_pos) END AS b3 FROM e2),
  sb AS (SELECT run_id, n_lap, track_m, 1 AS sector, 0 AS start_pos, b1 AS end_pos FROM e3 UNION ALL SELECT run_id, n_lap, track_m, 2, b1, b2 FROM e3 UNION ALL SELECT run_id, n_lap, track_m, 3, b2, b3 FROM e3)"""
_TIMES = """st AS (SELECT sb.run_id, sb.n_lap, sector, CASE WHEN start_pos < end_pos AND z.s_m - a.s_m >= track_m / 3.0 * 0.95 AND round_even(z.time_s - a.time_s, 1) > 0 THEN round_even(z.time_s - a.time_s, 1) END AS time_s
  FROM sb JOIN placed a ON a.run_id = sb.run_id AND a.n_lap = sb.n_lap AND a.pos = start_pos JOIN placed z ON z.run_id = sb.run_id AND z.n_lap = sb.n_lap AND z.pos = end_pos)"""
_REPORT = f"WITH {RUNS}, {LAPS}, {LAP_TABLE}, {_BOUNDS}, {_TIMES}"


@query(f"{_REPORT} SELECT run_id, n_lap, sector, CAST(start_pos AS BIGINT) AS start_pos, CAST(end_pos AS BIGINT) AS end_pos FROM sb")
def sector_boundaries(spark, sf_dir):
    return report.sector_bounds(_laps(spark, sf_dir)).select("run_id", "n_lap", "sector", "start_pos", "end_pos")


@query(f"{_REPORT} SELECT run_id, n_lap, sector, time_s FROM st")
def sector_times(spark, sf_dir):
    return report.sector_times(report.sector_bounds(_laps(spark, sf_dir)))


@query(f"{_REPORT} SELECT run_id, sector, min(time_s) AS best_s, arg_min(n_lap, (time_s, n_lap)) AS best_lap FROM st WHERE time_s IS NOT NULL GROUP BY run_id, sector")
def best_sector(spark, sf_dir):
    return report.best_sectors(report.sector_times(report.sector_bounds(_laps(spark, sf_dir))))


@query(f"""WITH {RUNS}, {LAPS}, {LAP_TABLE}, tr AS (SELECT run_id, max(distance_m) AS track_m FROM lap_table GROUP BY run_id)
  SELECT run_id, {_r('min(CASE WHEN distance_m > 0.99 * track_m THEN duration_s END) AS best_lap_s', 'avg(CASE WHEN distance_m > 0.95 * track_m THEN duration_s END) AS mean_lap_s')} FROM lap_table JOIN tr USING (run_id) GROUP BY run_id""")
def best_avg_lap(spark, sf_dir):
    return _rounded(report.best_and_average(lap_table(_laps(spark, sf_dir))))


@query(f"""WITH {RUNS}, {LAPS}, {LAP_TABLE}, tr AS (SELECT run_id, max(distance_m) AS track_m FROM lap_table GROUP BY run_id),
  f AS (SELECT run_id, n_lap, row_number() OVER (PARTITION BY run_id ORDER BY n_lap) AS nth FROM lap_table JOIN tr USING (run_id) WHERE distance_m >= 0.98 * track_m)
  SELECT run_id, max(CASE WHEN nth <= 2 THEN n_lap END) AS n_lap FROM f GROUP BY run_id""")
def representative_lap(spark, sf_dir):
    return report.representative_laps(lap_table(_laps(spark, sf_dir)))


_KPI = """max(r_vx) AS max_speed, max(r_ay) AS max_lateral, CAST(NULL AS DOUBLE) AS max_torque, max(r_ax) AS max_longitudinal, CAST(NULL AS DOUBLE) AS max_combined, min(r_ax) AS min_longitudinal"""
_ROLL = "SELECT *, " + ", ".join(f"avg({x}) OVER (PARTITION BY {{keys}} ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS {n}" for n, x in (("r_vx", "vx_mps"), ("r_ay", "abs(ay_mps2)"), ("r_ax", "ax_mps2"))) + " FROM {source}"
_KPI2 = "round(max_speed, 2) AS max_speed, round(max_lateral, 2) AS max_lateral, max_torque, round(max_longitudinal, 2) AS max_longitudinal, max_combined, round(min_longitudinal, 2) AS min_longitudinal"


@query(f"WITH {RUNS}, {LAPS}, k AS (SELECT run_id, n_lap, {_KPI} FROM ({_ROLL.format(keys='run_id, n_lap', source='laps')}) GROUP BY run_id, n_lap) SELECT run_id, n_lap, {_KPI2} FROM k")
def lap_kpis(spark, sf_dir):
    return report.lap_kpis(_laps(spark, sf_dir))


@query(f"""{_REPORT}, sec AS (SELECT placed.*, CASE WHEN pos < b1 THEN 1 WHEN pos < b2 THEN 2 ELSE 3 END AS sector, last_pos FROM placed JOIN e3 USING (run_id, n_lap)), use AS (SELECT * FROM sec WHERE NOT (sector = 3 AND pos = last_pos)),
  k AS (SELECT run_id, n_lap, sector, {_KPI} FROM ({_ROLL.format(keys='run_id, n_lap, sector', source='use')}) GROUP BY run_id, n_lap, sector) SELECT run_id, n_lap, sector, {_KPI2} FROM k""")
def sector_kpis(spark, sf_dir):
    return report.sector_kpis(_laps(spark, sf_dir))


def _overall(name: str, channel: str, f: str) -> str:
    return f"{f}({channel}) AS {name}"


@query(f"""WITH {RUNS}, {LAPS}, a AS (SELECT *, sqrt(vx_mps * vx_mps + vy_mps * vy_mps) AS v_mps, sqrt(ax_mps2 * ax_mps2 + ay_mps2 * ay_mps2) AS a_total FROM laps),
  r AS (SELECT run_id, """ + ", ".join(f"avg({c}) OVER (PARTITION BY run_id ORDER BY n_lap, seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS {n}" for n, c in (("v", "v_mps"), ("ay", "ay_mps2"), ("ax", "ax_mps2"), ("t", "a_total"))) + """ FROM a)
  SELECT run_id, round(max(v), 2) AS top_speed, round(max(ay), 2) + 0.0::DOUBLE AS max_lateral, round(max(ax), 2) + 0.0::DOUBLE AS max_longitudinal, round(min(ax), 2) + 0.0::DOUBLE AS max_braking, round(max(t), 2) AS max_combined FROM r GROUP BY run_id""")
def overall_stats(spark, sf_dir):
    return _rounded(report.overall_stats(derive(_laps(spark, sf_dir), only={"speed", "total_acceleration"})), 2)


@query(f"""WITH {RUNS}, {LAPS}, r AS (SELECT *, count(*) OVER w AS n, avg(ay_mps2) OVER w AS ay, avg(ax_mps2) OVER w AS ax FROM laps WINDOW w AS (PARTITION BY run_id, n_lap ORDER BY seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
  SELECT run_id, {_r('greatest(10, max(CASE WHEN n >= 30 THEN ay END)) AS ay_max', 'least(-10, min(CASE WHEN n >= 30 THEN ay END)) AS ay_min', 'greatest(5, max(CASE WHEN n >= 30 THEN ax END)) AS ax_max', 'least(-10, min(CASE WHEN n >= 30 THEN ax END)) AS ax_min')} FROM r GROUP BY run_id""")
def axis_bounds(spark, sf_dir):
    return _rounded(report.axis_bounds(_laps(spark, sf_dir)))


@query(f"WITH {RUNS}, {LAPS}, {LAP_TABLE} SELECT run_id, round(max(time_s) / 60.0, 6) AS run_min, round(any_value(track_m) / 1000.0, 6) AS track_km FROM runs JOIN (SELECT run_id, max(distance_m) AS track_m FROM lap_table GROUP BY run_id) USING (run_id) GROUP BY run_id")
def run_totals(spark, sf_dir):
    return report.run_totals(_laps(spark, sf_dir), places=(6, 6))


# --- places and attitude ---------------------------------------------------------------------------


@query(f"""WITH {RUNS}, g AS (SELECT run_id, seq, 48.0 + degrees(pos_y_m / 6378137.0) AS lat, 11.0 + degrees(pos_x_m / (6378137.0 * cos(radians(48.0)))) AS lon FROM runs)
  SELECT run_id, seq, {_r('lat', 'lon', places=9)}, {_r('radians(lon - 11.0) * 6378137.0 * cos(radians(48.0)) AS x_back', 'radians(lat - 48.0) * 6378137.0 AS y_back', places=5)} FROM g""")
def geo_round_trip(spark, sf_dir):
    origin = (48.0, 11.0)
    lat, lon = to_geographic("pos_x_m", "pos_y_m", origin)
    placed = runs(spark, sf_dir).select("run_id", "seq", lat.alias("lat"), lon.alias("lon"))
    x, y = to_local("lat", "lon", origin)
    return placed.select("run_id", "seq", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), (F.round(x, 5) + 0.0).alias("x_back"), (F.round(y, 5) + 0.0).alias("y_back"))


_Q = "SELECT run_id, seq, vy_mps / n AS x, ax_mps2 / n AS y, yaw_rate_radps / n AS z, vx_mps / n AS w FROM (SELECT *, sqrt(vy_mps * vy_mps + ax_mps2 * ax_mps2 + yaw_rate_radps * yaw_rate_radps + vx_mps * vx_mps) AS n FROM runs)"


@query(f"""WITH {RUNS}, q AS ({_Q}) SELECT run_id, seq, {_r('atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)) AS roll', 'asin(greatest(-1, least(1, 2 * (w * y - z * x)))) AS pitch', 'atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)) AS yaw')} FROM q""")
def quaternion_euler(spark, sf_dir):
    roll, pitch, yaw = quaternion_angles("vy_mps", "ax_mps2", "yaw_rate_radps", "vx_mps")
    return _rounded(runs(spark, sf_dir).select("run_id", "seq", roll.alias("roll"), pitch.alias("pitch"), yaw.alias("yaw")))


# --- selections and plots --------------------------------------------------------------------------


@query(f"WITH {RUNS}, {LAPS} SELECT run_id, seq, n_lap, vx_mps, ay_mps2 FROM laps WHERE n_lap = 2 AND ay_mps2 > 2")
def gate_filter(spark, sf_dir):
    return _laps(spark, sf_dir).where((F.col("n_lap") == 2) & (F.col("ay_mps2") > 2)).select("run_id", "seq", "n_lap", "vx_mps", "ay_mps2")


@query(f"WITH {RUNS}, {LAPS} SELECT run_id, n_lap, arg_min(seq, (abs(s_m - 500), seq)) AS seq, {_r('min(abs(s_m - 500)) AS gap_m')} FROM laps GROUP BY run_id, n_lap")
def closest_row(spark, sf_dir):
    best = F.min(F.struct(F.abs(F.col("s_m") - 500.0).alias("gap_m"), "seq"))
    return _rounded(_laps(spark, sf_dir).groupBy("run_id", "n_lap").agg(best.alias("b")).select("run_id", "n_lap", "b.seq", "b.gap_m"))


@query(f"""WITH {RUNS}, {LAPS}, t AS (SELECT *, row_number() OVER (PARTITION BY run_id, n_lap ORDER BY seq DESC) AS back FROM laps) SELECT run_id, n_lap, seq, {_r('s_m', 'vx_mps')} FROM t WHERE back > 10""")
def overlay_traces(spark, sf_dir):
    from lapframe.operators.plots import overlay

    return _rounded(overlay(_laps(spark, sf_dir), "n_lap", ["s_m", "vx_mps"]).select("run_id", "n_lap", "seq", "s_m", "vx_mps"))


@query(f"WITH {RUNS}, n AS (SELECT run_id, greatest(1, count(*) // 200) AS stride FROM runs GROUP BY run_id) SELECT run_id, seq, {_r('pos_x_m', 'pos_y_m')} FROM runs JOIN n USING (run_id) WHERE seq % stride = 0")
def downsample(spark, sf_dir):
    from lapframe.operators.plots import every_nth

    return _rounded(every_nth(runs(spark, sf_dir), 200).select("run_id", "seq", "pos_x_m", "pos_y_m"))


@query(f"""WITH {RUNS}, r AS (SELECT run_id, seq, regr_slope(ay_mps2, vx_mps) OVER w AS slope, regr_r2(ay_mps2, vx_mps) OVER w AS r2, count(*) OVER w AS n FROM runs WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
  SELECT run_id, seq, {_r('slope', 'r2', places=11)} FROM r WHERE n = 50""")
def fixed_window_regression(spark, sf_dir):
    w = ordered().rowsBetween(-49, 0)
    got = runs(spark, sf_dir).select("run_id", "seq", F.regr_slope("ay_mps2", "vx_mps").over(w).alias("slope"), F.regr_r2("ay_mps2", "vx_mps").over(w).alias("r2"), F.count(F.lit(1)).over(w).alias("n"))
    return _rounded(got.where("n = 50").drop("n"), 11)


@query(f"""WITH {RUNS}, c AS (SELECT *, last_value(CASE WHEN abs(ay_mps2) < 1 THEN vx_mps END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS held FROM runs) SELECT run_id, seq, held FROM c""")
def carry_last(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", "seq", F.last(F.when(F.abs("ay_mps2") < 1, F.col("vx_mps")), ignorenulls=True).over(so_far(ordered())).alias("held"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def props_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


# --- nearest points ----------------------------------------------------------------------------------

_JITTER = "j AS (SELECT run_id, seq, s_m, pos_x_m + ax_mps2 * 0.05 AS x, pos_y_m + vx_mps * 0.01 AS y FROM runs)"


@query(f"""WITH {RUNS}, {_JITTER}, lim AS (SELECT min(run_id) AS ref FROM j), r AS (SELECT seq, x, y, (s_m + 25) % (SELECT max(s_m) FROM j, lim WHERE run_id = ref) AS s FROM j, lim WHERE run_id = ref),
  n AS (SELECT j.run_id, j.seq, list_sort(list((sqrt((j.x - r.x) * (j.x - r.x) + (j.y - r.y) * (j.y - r.y)), r.seq, r.s)))[1:3] AS near FROM j, r GROUP BY j.run_id, j.seq)
  SELECT run_id, seq, round((near[1][3] + near[2][3] + near[3][3]) / 3, 4) AS s_norm_m FROM n""")
def knn3_distance(spark, sf_dir):
    """Distance of every row by its three nearest points of the first run."""
    from lapframe.operators.distance import nearest_distance, reference_points

    df = runs(spark, sf_dir).select("run_id", "seq", (F.col("pos_x_m") + F.col("ax_mps2") * 0.05).alias("pos_x_m"), (F.col("pos_y_m") + F.col("vx_mps") * 0.01).alias("pos_y_m"), "s_m")
    first = df.agg(F.min("run_id")).first()[0]
    reference = reference_points(df.where(F.col("run_id") == F.lit(first)), 25.0)
    df = df.drop("s_m")
    return _rounded(nearest_distance(df, reference, 3, cell_m=5.0).select("run_id", "seq", "s_norm_m"), 4)


_CROSSED = f"""WITH {RUNS}, c AS (SELECT run_id, seq, pos_x_m AS x, pos_y_m AS y, lag(pos_x_m) OVER w AS px, lag(pos_y_m) OVER w AS py FROM runs {_W}),
  d AS (SELECT *, (x - px) * 0.0 - (y - py) * 60.0 AS cr FROM c), k AS (SELECT *, ((60.0 - px) * 0.0 - (0.05 - py) * 60.0) / cr AS along, ((60.0 - px) * (y - py) - (0.05 - py) * (x - px)) / cr AS across FROM d WHERE abs(cr) > 1e-12)"""


@query(f"{_CROSSED} SELECT run_id, seq, CAST(sign(cr) AS INT) AS direction FROM k WHERE along BETWEEN 0 AND 1 AND across BETWEEN 0 AND 1")
def line_crossings(spark, sf_dir):
    from lapframe.operators.distance import line_crossings as crossings

    return crossings(runs(spark, sf_dir), ((60.0, 0.05), (120.0, 0.05))).select("run_id", "seq", "direction")


@query(f"""{_CROSSED}, x AS (SELECT run_id, seq, CAST(sign(cr) AS INT) AS direction FROM k WHERE along BETWEEN 0 AND 1 AND across BETWEEN 0 AND 1),
  n AS (SELECT run_id, direction, count(*) AS n FROM x GROUP BY run_id, direction QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC, direction) = 1),
  p AS (SELECT run_id, seq, coalesce(sqrt(power(x - px, 2) + power(y - py, 2)), 0) AS step FROM c), f AS (SELECT *, sum(step) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS far FROM p),
  m AS (SELECT f.*, n.n >= 2 AS usable, x.seq IS NOT NULL AS crossed FROM f LEFT JOIN n ON f.run_id = n.run_id LEFT JOIN x ON f.run_id = x.run_id AND f.seq = x.seq AND x.direction = n.direction)
  SELECT run_id, seq, CASE WHEN usable THEN round(far - max(CASE WHEN crossed THEN far ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 5) + 0.0::DOUBLE END AS s_m FROM m""")
def start_line_laps(spark, sf_dir):
    """Distance since the start line from positions alone, with debounced crossings (a lap here takes 14 s, so all crossings count)."""
    from lapframe.operators.distance import path_distance

    return _rounded(path_distance(runs(spark, sf_dir).drop("s_m"), ((60.0, 0.05), (120.0, 0.05))).select("run_id", "seq", "s_m"), 5)


# --- corners and stiffness -----------------------------------------------------------------------------

_SG = f"""WITH {RUNS}, {LAPS}, p AS (SELECT run_id, n_lap, s_m, row_number() OVER (PARTITION BY run_id, n_lap ORDER BY seq) - 1 AS pos, sign(ay_mps2) AS sg, lead(sign(ay_mps2)) OVER (PARTITION BY run_id, n_lap ORDER BY seq) AS nx FROM laps),
  c AS (SELECT *, CASE WHEN s_m - lag(s_m) OVER (PARTITION BY run_id, n_lap ORDER BY pos) >= 50 THEN 1 ELSE 0 END AS fresh FROM p WHERE nx <> sg),
  g AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY run_id, n_lap ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stretch FROM c)"""


@query(f"{_SG} SELECT run_id, n_lap, stretch, CAST(floor(quantile_cont(pos, 0.5)) AS BIGINT) AS pos, count(*) AS n_points FROM g GROUP BY run_id, n_lap, stretch")
def sign_change_groups(spark, sf_dir):
    from lapframe.operators.corners import sign_changes

    return sign_changes(_laps(spark, sf_dir), "ay_mps2")


@query(f"""WITH {RUNS}, {LAPS}, p AS (SELECT *, row_number() OVER (PARTITION BY run_id, n_lap ORDER BY seq) - 1 AS pos, lead(ay_mps2) OVER w AS nay, lead(abs(yaw_rate_radps)) OVER w AS ny FROM laps WINDOW w AS (PARTITION BY run_id, n_lap ORDER BY seq)),
  u AS (SELECT run_id, n_lap, s_m, pos, 0 AS way FROM p WHERE sign(nay - 2.5) <> sign(ay_mps2 - 2.5) AND ny < 0.002 UNION ALL SELECT run_id, n_lap, s_m, pos, 1 FROM p WHERE sign(nay + 2.5) <> sign(ay_mps2 + 2.5) AND ny < 0.002),
  c AS (SELECT *, CASE WHEN s_m - lag(s_m) OVER (PARTITION BY run_id, n_lap ORDER BY pos, way) >= 20 THEN 1 ELSE 0 END AS fresh FROM u),
  g AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY run_id, n_lap ORDER BY pos, way ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stretch FROM c)
  SELECT run_id, n_lap, stretch, CAST(floor(quantile_cont(pos, 0.5)) AS BIGINT) AS pos, count(*) AS n_points FROM g GROUP BY run_id, n_lap, stretch""")
def low_accel_groups(spark, sf_dir):
    from lapframe.operators.corners import low_acceleration_points

    return low_acceleration_points(_laps(spark, sf_dir), "ay_mps2", "yaw_rate_radps")


_GR = "CASE WHEN lag({x}) OVER w IS NULL AND row_number() OVER w = 1 THEN lead({x}) OVER w - {x} WHEN lead(1) OVER w IS NULL THEN {x} - lag({x}) OVER w ELSE (lead({x}) OVER w - lag({x}) OVER w) / 2 END"
_LW = "WINDOW w AS (PARTITION BY run_id, n_lap ORDER BY seq)"


@query(f"""WITH {RUNS}, {LAPS}, r AS (SELECT run_id, n_lap, seq, s_m, round(ax_mps2 / 3, 6) AS r, sign(round(ax_mps2 / 3, 6) + 0.15) AS sg FROM laps), a AS (SELECT *, row_number() OVER w - 1 AS pos, {_GR.format(x='r')} AS slope, {_GR.format(x='sg')} AS turn FROM r {_LW}),
  b AS (SELECT *, quantile_cont(slope, 0.75) OVER (PARTITION BY run_id, n_lap ORDER BY seq ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS falls FROM a),
  c AS (SELECT *, CASE WHEN s_m - lag(s_m) OVER (PARTITION BY run_id, n_lap ORDER BY pos) >= 50 THEN 1 ELSE 0 END AS fresh FROM b WHERE turn <> 0 AND falls < 0.2),
  g AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY run_id, n_lap ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stretch FROM c)
  SELECT run_id, n_lap, stretch, max(pos) AS pos, count(*) AS n_points FROM g GROUP BY run_id, n_lap, stretch""")
def decel_points(spark, sf_dir):
    from lapframe.operators.corners import deceleration_points

    laps = _laps(spark, sf_dir).withColumn("ratio", F.round(F.col("ax_mps2") / 3, 6))
    return deceleration_points(laps, "ratio", falls_below=0.2)


_LAP = "PARTITION BY run_id, n_lap ORDER BY"
_PEAKS = f"""level AS (SELECT run_id, n_lap, pos, size, abs(curvature) AS x, lag(abs(curvature)) OVER ({_LAP} pos) AS before FROM circuits), edge AS (SELECT * FROM level WHERE pos = 0 OR x IS DISTINCT FROM before),
  plateau AS (SELECT *, lag(x) OVER ({_LAP} pos) AS b, lead(x) OVER ({_LAP} pos) AS a, coalesce(lead(pos) OVER ({_LAP} pos), size) - 1 AS e FROM edge),
  top AS (SELECT run_id, n_lap, (pos + e) // 2 AS pos, x, row_number() OVER (PARTITION BY run_id, n_lap ORDER BY x DESC, (pos + e) // 2 DESC) AS rk FROM plateau WHERE b < x AND a < x AND x >= 0.002),
  spaced AS (SELECT DISTINCT run_id, n_lap, 0::BIGINT AS rk, []::BIGINT[] AS kept FROM top UNION ALL
    SELECT s.run_id, s.n_lap, t.rk, CASE WHEN len(list_filter(s.kept, lambda k: abs(k - t.pos) < 100)) = 0 THEN list_append(s.kept, t.pos) ELSE s.kept END FROM spaced s JOIN top t ON t.run_id = s.run_id AND t.n_lap = s.n_lap AND t.rk = s.rk + 1),
  far AS (SELECT run_id, n_lap, unnest(arg_max(kept, rk)) AS pos FROM spaced GROUP BY run_id, n_lap), pk AS (SELECT far.*, top.x FROM far JOIN top USING (run_id, n_lap, pos)),
  rng AS (SELECT k.run_id, k.n_lap, k.pos, k.x, coalesce(max(r.pos) FILTER (r.pos < k.pos AND r.x > k.x) + 1, 0) AS i, coalesce(min(r.pos) FILTER (r.pos > k.pos AND r.x > k.x) - 1, max(r.pos)) AS j FROM pk k JOIN level r USING (run_id, n_lap) GROUP BY ALL),
  low AS (SELECT k.*, min(r.x) FILTER (r.pos BETWEEN k.i AND k.pos) AS lmin, min(r.x) FILTER (r.pos BETWEEN k.pos AND k.j) AS rmin FROM rng k JOIN level r ON r.run_id = k.run_id AND r.n_lap = k.n_lap GROUP BY ALL),
  foot AS (SELECT k.*, max(r.pos) FILTER (r.pos BETWEEN k.i AND k.pos AND r.x = k.lmin) AS lfoot, min(r.pos) FILTER (r.pos BETWEEN k.pos AND k.j AND r.x = k.rmin) AS rfoot, k.x - greatest(k.lmin, k.rmin) AS prom FROM low k JOIN level r ON r.run_id = k.run_id AND r.n_lap = k.n_lap GROUP BY ALL),
  half AS (SELECT k.*, max(r.pos) FILTER (r.pos BETWEEN k.lfoot AND k.pos AND r.x <= k.x - k.prom / 2) AS c, min(r.pos) FILTER (r.pos BETWEEN k.pos AND k.rfoot AND r.x <= k.x - k.prom / 2) AS d FROM foot k JOIN level r ON r.run_id = k.run_id AND r.n_lap = k.n_lap GROUP BY ALL),
  wide AS (SELECT h.run_id, h.n_lap, h.pos, h.d - CASE WHEN d0.x < x - prom / 2 THEN (x - prom / 2 - d0.x) / (d1.x - d0.x) ELSE 0 END - h.c - CASE WHEN c0.x < h.x - prom / 2 THEN (h.x - prom / 2 - c0.x) / (c1.x - c0.x) ELSE 0 END AS width
    FROM (SELECT run_id, n_lap, pos, x, prom, c, d FROM half WHERE prom >= 0.001) h JOIN level c0 ON (c0.run_id, c0.n_lap, c0.pos) = (h.run_id, h.n_lap, h.c) JOIN level c1 ON (c1.run_id, c1.n_lap, c1.pos) = (h.run_id, h.n_lap, h.c + 1)
    JOIN level d0 ON (d0.run_id, d0.n_lap, d0.pos) = (h.run_id, h.n_lap, h.d) JOIN level d1 ON (d1.run_id, d1.n_lap, d1.pos) = (h.run_id, h.n_lap, h.d - 1))""".replace("d0.x < x -", "d0.x < h.x -").replace("(x - prom / 2 - d0.x)", "(h.x - prom / 2 - d0.x)")
_POINTS = f"""ahead AS (SELECT *, sign(ay) AS sg, lead(ay) OVER w AS nay, lead(abs(curvature)) OVER w AS nc, {"{}"} AS slope, {"{}"} AS turn FROM (SELECT *, sign(ratio + 0.15) AS rs FROM circuits) WINDOW w AS ({_LAP} seq)),
  falls AS (SELECT *, quantile_cont(slope, 0.75) OVER ({_LAP} seq ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS q FROM ahead),
  raw AS (SELECT run_id, n_lap, s_m, pos, 0 AS way, 'lat_accel_change' AS kind, 50 AS gap FROM ahead WHERE sign(nay) <> sg UNION ALL SELECT run_id, n_lap, s_m, pos, 0, 'low_lat_accel', 20 FROM ahead WHERE sign(nay - 2.5) <> sign(ay - 2.5) AND nc < 0.002
    UNION ALL SELECT run_id, n_lap, s_m, pos, 1, 'low_lat_accel', 20 FROM ahead WHERE sign(nay + 2.5) <> sign(ay + 2.5) AND nc < 0.002 UNION ALL SELECT run_id, n_lap, s_m, pos, 0, 'deceleration', 50 FROM falls WHERE turn <> 0 AND q < 0),
  fresh AS (SELECT *, CASE WHEN s_m - lag(s_m) OVER (PARTITION BY run_id, n_lap, kind ORDER BY pos, way) >= gap THEN 1 ELSE 0 END AS f FROM raw), stretch AS (SELECT *, sum(f) OVER (PARTITION BY run_id, n_lap, kind ORDER BY pos, way ROWS UNBOUNDED PRECEDING) AS g FROM fresh),
  grouped AS (SELECT run_id, n_lap, kind, CAST(CASE WHEN kind = 'deceleration' THEN max(pos) ELSE floor(quantile_cont(pos, 0.5)) END AS BIGINT) AS pos FROM stretch GROUP BY run_id, n_lap, kind, g),
  apex AS (SELECT w.run_id, w.n_lap, 'apex' AS kind, w.pos FROM wide w JOIN circuits c USING (run_id, n_lap, pos) WHERE w.width >= 50 AND abs(c.ay) > 5),
  points AS (SELECT * FROM apex UNION ALL SELECT * FROM grouped g WHERE (run_id, n_lap) IN (SELECT (run_id, n_lap) FROM apex)
    AND NOT (kind = 'low_lat_accel' AND EXISTS (SELECT 1 FROM grouped o WHERE o.kind = 'lat_accel_change' AND o.run_id = g.run_id AND o.n_lap = g.n_lap AND abs(o.pos - g.pos) <= 30)))"""
_CORNERS = f"""numbered AS (SELECT *, row_number() OVER ({_LAP} pos, kind) AS no, count(*) OVER (PARTITION BY run_id, n_lap) AS m FROM points),
  back AS (SELECT run_id, n_lap, no AS apex_no, pos AS apex, m, 1 AS steps, NULL::BIGINT AS start FROM numbered WHERE kind = 'apex' UNION ALL
    SELECT b.run_id, b.n_lap, b.apex_no, b.apex, b.m, b.steps + 1, CASE p.kind WHEN 'deceleration' THEN p.pos WHEN 'apex' THEN CASE WHEN b.steps = 1 THEN b.apex ELSE n.pos END END
    FROM back b JOIN numbered p ON p.run_id = b.run_id AND p.n_lap = b.n_lap AND p.no = (b.apex_no - 1 - b.steps + 2 * b.m) % b.m + 1 JOIN numbered n ON n.run_id = b.run_id AND n.n_lap = b.n_lap AND n.no = (b.apex_no - 2 + b.m) % b.m + 1 WHERE b.start IS NULL AND b.steps <= b.m),
  bounds AS (SELECT b.run_id, b.n_lap, row_number() OVER (PARTITION BY b.run_id, b.n_lap ORDER BY b.apex_no) AS corner_no, b.apex, b.start, CASE WHEN x.kind = 'apex' THEN b.apex ELSE x.pos END AS e
    FROM back b JOIN numbered x ON x.run_id = b.run_id AND x.n_lap = b.n_lap AND x.no = b.apex_no % b.m + 1 WHERE b.start IS NOT NULL),
  painted AS (SELECT c.run_id, c.seq, c.n_lap, c.pos, c.ratio, max(b.corner_no) AS corner_no FROM circuits c LEFT JOIN bounds b ON b.run_id = c.run_id AND b.n_lap = c.n_lap
    AND (c.pos - b.start + c.size) % c.size < CASE WHEN (b.e - b.start + c.size) % c.size = 0 THEN c.size ELSE (b.e - b.start + c.size) % c.size END GROUP BY ALL),
  p0 AS (SELECT *, min(pos) OVER w AS f0, max(CASE WHEN ratio < -0.97 THEN pos END) OVER w AS a, max(CASE WHEN ratio < -0.3 THEN pos END) OVER w AS b, max(CASE WHEN ratio < 0.1 THEN pos END) OVER w AS c FROM painted WINDOW w AS (PARTITION BY run_id, n_lap, corner_no)),
  p1 AS (SELECT *, (pos >= coalesce(a, f0))::INT + (pos >= coalesce(b, a, f0))::INT + (pos >= coalesce(c, b, a, f0))::INT AS phase FROM p0)
  SELECT p.run_id, p.seq, p.n_lap, CASE WHEN p.corner_no IS NULL THEN '-' ELSE 'T' || p.corner_no END AS corner_name, CASE WHEN p.corner_no IS NULL THEN '-' WHEN s.v < 25 THEN 'Low Speed' WHEN s.v < 40 THEN 'Medium Speed' ELSE 'High Speed' END AS corner_speed,
    CASE WHEN p.corner_no IS NULL THEN '-' ELSE ['Braking', 'Entry', 'Mid', 'Exit'][phase + 1] END AS corner_phase
  FROM p1 p LEFT JOIN bounds b ON b.run_id = p.run_id AND b.n_lap = p.n_lap AND b.corner_no = p.corner_no LEFT JOIN circuits s ON s.run_id = b.run_id AND s.n_lap = b.n_lap AND s.pos = b.apex"""


@query(f"WITH RECURSIVE {CIRCUITS}, {_PEAKS}, {_POINTS.format(_GR.format(x='ratio'), _GR.format(x='rs'))}, {_CORNERS}")
def corner_labels(spark, sf_dir):
    """Corner name, speed class and phase of every row of laps whose bends line items shape."""
    from lapframe.operators.corners import INPUTS, label_corners

    return label_corners(circuits(spark, sf_dir).select("run_id", "seq", *INPUTS)).select("run_id", "seq", "n_lap", "corner_name", "corner_speed", "corner_phase")


@query()
def lowpass_channels(spark, sf_dir):
    """Two channels of all runs without what is faster than 1 Hz, forward and backward, in chunks of 256 rows."""
    from lapframe.operators.chunks import lowpass

    df = runs(spark, sf_dir)
    rated = df.join(sample_rates(df), "run_id")
    return _rounded(lowpass(rated, ["vx_mps", "ay_mps2"], ["run_id"], "sample_hz", 1.0, rows=256).drop("chunk"))


@query()
def cornering_stiffness(spark, sf_dir):
    """Local slopes of the axles' forces over their slip angles around the same track, with the ratio to the linear region."""
    from lapframe.operators.stiffness import estimate_stiffness

    df = circuits(spark, sf_dir).select("run_id", "seq", "time_s", "alpha_f_rad", "alpha_r_rad", "fy_f_N", "fy_r_N")
    return estimate_stiffness(df).select("run_id", "seq", "cs_f_Nprad", "cs_r_Nprad", "cs_ratio_f", "cs_ratio_r")


@query()
def tyre_curves(spark, sf_dir):
    """The parameters of each run's tyre curves, front and rear, from its slip angles and forces."""
    from lapframe.operators.stiffness import fit_tyre_curves

    axles = F.array(*[F.struct(F.lit(a).alias("axle"), F.col(f"alpha_{a}_rad").alias("slip"), F.col(f"fy_{a}_N").alias("force")) for a in "fr"])
    long = circuits(spark, sf_dir).select("run_id", F.explode(axles).alias("x")).select("run_id", "x.*")
    return _rounded(fit_tyre_curves(long, ["run_id", "axle"]), 2, ("run_id", "n"))


# --- CAN ---------------------------------------------------------------------------------------------

#: One message per event type: the value in hundredths with sign in 40 bits (up to 5.4 thousand million), the property k, and the user across two bytes in Motorola order.
CAN_MESSAGES = {
    "params": [
        {"canId": 0x100 + k, "name": name, "signals": [
            {"name": "value", "startBit": 0, "bitLength": 40, "isLittleEndian": True, "isSigned": True, "factor": 0.01, "postfixMetric": "m"},
            {"name": "shade", "startBit": 40, "bitLength": 8, "isLittleEndian": True, "isSigned": True},
            {"name": "user", "startBit": 55, "bitLength": 16}]}
        for k, name in enumerate(CHANNELS)
    ]
}


def can_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, line_no, line: the events as the text of a CAN log."""
    ev = table(spark, sf_dir, "events")
    ident = F.array_position(F.array(*[F.lit(c) for c in CHANNELS]), F.col("event_type")) - 1 + 0x100
    raw = F.round(F.col("value") * 100).cast("long")
    k = F.get_json_object("props", "$.k").cast("long") * 2 + 20
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    payload = [*[F.shiftright(raw, 8 * n).bitwiseAND(F.lit(255)) for n in range(5)], k, F.shiftright(F.col("user_id"), 8).bitwiseAND(F.lit(255)), F.col("user_id").bitwiseAND(F.lit(255))]
    line = F.format_string("(%.6f) can0 %03X#" + "%02X" * 8, seconds, ident, *payload)
    return ev.select(F.lit("log").alias("run_id"), (F.col("event_id") + 1).alias("line_no"), line.alias("line"))


def _can_frames(spark, sf_dir):
    from lapframe.operators.can import frames_of, parse_definitions

    return frames_of(can_lines(spark, sf_dir)), parse_definitions(CAN_MESSAGES)


_CAN_SQL = "e AS (SELECT event_id + 1 AS line_no, event_type AS message, round(round(value * 100) * 0.01, 6) AS v, CAST(json_extract(props, '$.k') AS BIGINT) * 2 + 20 AS k8, user_id & 65535 AS usr FROM events), f AS (SELECT *, CASE WHEN k8 >= 128 THEN k8 - 256 ELSE k8 END AS k FROM e)"


@query(f"""WITH {_CAN_SQL} SELECT line_no, message, 'value' AS signal, v AS value, 'm' AS unit FROM f UNION ALL SELECT line_no, message, 'shade', k::DOUBLE, '' FROM f UNION ALL SELECT line_no, message, 'user', usr::DOUBLE, '' FROM f""")
def can_decode_long(spark, sf_dir):
    from lapframe.operators.can import decode_long

    return _rounded(decode_long(*_can_frames(spark, sf_dir)).select("line_no", "message", "signal", "value", "unit"))


@query(f"WITH {_CAN_SQL} SELECT line_no, " + ", ".join(f"CASE WHEN message = '{c}' THEN {x} END AS \"{c}.{s}\"" for c in CHANNELS for s, x in (("value", "v"), ("shade", "k::DOUBLE"), ("user", "usr::DOUBLE"))) + " FROM f")
def can_decode_wide(spark, sf_dir):
    from lapframe.operators.can import column_names, decode_wide

    frames, messages = _can_frames(spark, sf_dir)
    names = list(column_names(messages).values())
    return _rounded(decode_wide(frames, messages).select("line_no", *[F.col(f"`{n}`") for n in names]))


@query(f"""WITH {_CAN_SQL} SELECT line_no AS row_id, message, 'value' AS signal, v AS value, 'm' AS unit FROM f UNION ALL SELECT line_no, message, 'shade', k::DOUBLE, '' FROM f UNION ALL SELECT line_no, message, 'user', usr::DOUBLE, '' FROM f""")
def can_decode_table(spark, sf_dir):
    """Decoding as a table function of SQL."""
    from lapframe.operators.can_table import register_can_table

    frames, messages = _can_frames(spark, sf_dir)
    register_can_table(spark, messages)
    return _rounded(spark.sql("SELECT * FROM can_signals(TABLE(SELECT line_no AS row_id, can_id, is_extended, data FROM {frames}))", frames=frames), but=("row_id",))


@query(f"""WITH {_CAN_SQL}, b AS (SELECT line_no, message, (v, k, usr) AS now, lag((v, k, usr)) OVER (PARTITION BY message ORDER BY line_no) AS before FROM f) SELECT message, count(*) AS n FROM b WHERE before IS NULL OR now IS DISTINCT FROM before GROUP BY message""")
def can_changes(spark, sf_dir):
    from lapframe.operators.can import changed_frames, decode_long, known_frames, message_counts

    frames, messages = _can_frames(spark, sf_dir)
    fresh = changed_frames(known_frames(frames, messages))
    return message_counts(decode_long(fresh, messages).where("signal = 'value'"))


# --- fingerprints and streams ----------------------------------------------------------------------------


@query()
def run_fingerprints(spark, sf_dir):
    from lapframe.sources.sinks import fingerprints

    return fingerprints(runs(spark, sf_dir))


def _event_stream(spark, sf_dir):
    """The events table as a stream."""
    ev = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(ev.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, time_bucket(INTERVAL 6 HOURS, ts) + INTERVAL 6 HOURS AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def stream_windows(spark, sf_dir):
    from lapframe.streaming.live import run_to_end, windowed_values

    got = run_to_end(windowed_values(_event_stream(spark, sf_dir), "6 hours"), "windows", mode="complete")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
  SELECT start, start + INTERVAL 6 HOURS AS "end", event_type, n, total FROM w WHERE start + INTERVAL 6 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 2 HOURS""")
def stream_closed_windows(spark, sf_dir):
    """Only windows that the watermark has closed: each is given once, and what would come later for it is dropped."""
    from lapframe.streaming.live import run_to_end, windowed_values

    got = run_to_end(windowed_values(_event_stream(spark, sf_dir), "6 hours", late="2 hours"), "closed")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", F.round("total", 4).alias("total"))


def _told(spark, rows, time, name, days=2):
    """``rows`` as a stream: files of rows, and then one that tells a time some days after the last row, so that all keys end."""
    from lapframe.session import shared_path

    path = shared_path(spark, name)
    rows.write.parquet(path)
    written = spark.read.schema(rows.schema).parquet(path)
    end = written.agg((F.max(time) + F.make_dt_interval(F.lit(days))).alias(time))
    end.select(*[F.col(time) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]).write.mode("append").parquet(path)
    # a trigger costs a task with a state for each shuffle partition, whatever it brings: with as many files, tasks grow with the rows and not with files times partitions
    files = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


@query(f"WITH {RUNS}, {LAPS} SELECT run_id, seq, {_r('s_m')}, n_lap FROM laps")
def stream_lap_counter(spark, sf_dir):
    """Laps of all runs as their samples come, by the rule of the batch query."""
    from lapframe.streaming.live import lap_counter, run_to_end

    samples = runs(spark, sf_dir).select("run_id", "seq", "s_m", F.timestamp_micros((F.col("time_s") * 1e6).cast("long") + 1704067200000000).alias("ts"))
    return _rounded(run_to_end(lap_counter(_told(spark, samples, "ts", "samples"), late="1 hour", step="10 minutes"), "laps"))


@query("""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 8 HOURS THEN 1 ELSE 0 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 8 HOURS AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, no""")
def stream_sessions(spark, sf_dir):
    from lapframe.streaming.live import run_to_end, sessions

    got = run_to_end(sessions(_event_stream(spark, sf_dir), "8 hours"), "sessions", mode="complete")
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("total", 4).alias("total"))


@query("""WITH b AS (SELECT event_id, user_id, floor(value / 50) AS level, lag(floor(value / 50)) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT event_id, user_id FROM b WHERE before IS NULL OR level <> before""")
def stream_changes(spark, sf_dir):
    from lapframe.streaming.live import changed_payloads, run_to_end

    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_id").alias("order"), F.timestamp_seconds(F.col("event_id") + 1704067200).alias("ts"), F.floor(F.col("value") / 50).cast("string").cast("binary").alias("data"))
    got = changed_payloads(_told(spark, events, "ts", "frames", 4000), "user_id", "event_id", late="1000 days", idle="1000 days", step="100 days")
    return run_to_end(got, "changes").select("event_id", "user_id")


# --- more of the report and the plots -----------------------------------------------------------------


@query(f"""WITH {RUNS}, {LAPS}, {LAP_TABLE}, t AS (SELECT run_id, n_lap, CAST(round_even(round(duration_s, 3) * 10, 0) AS BIGINT) AS x FROM lap_table)
  SELECT run_id, n_lap, (x // 600)::VARCHAR || ':' || lpad(((x % 600) // 10)::VARCHAR, 2, '0') || '.' || (x % 10)::VARCHAR AS lap_time FROM t""")
def lap_time_texts(spark, sf_dir):
    return lap_table(_laps(spark, sf_dir)).select("run_id", "n_lap", report.lap_time_text(F.round("duration_s", 3)).alias("lap_time"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS raw, round(CASE WHEN l_quantity = floor(l_quantity) AND l_quantity < 10 THEN l_quantity * 0.01 WHEN l_quantity = floor(l_quantity) THEN l_quantity * 0.001 ELSE l_quantity END, 6) AS scaled FROM lineitem")
def scaled_times(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("raw"), F.round(report.scaled_time(F.col("l_quantity")), 6).alias("scaled"))


@query("""WITH f AS (SELECT event_id, strftime(ts, '%d.%m.%Y') || '_' || strftime(ts, '%H.%M.%S') || '_run' AS name, strftime(ts, '%H:%M') AS t FROM events)
  SELECT event_id, left(name, 10) AS day, t AS start, CASE WHEN hour < 6 THEN '--' WHEN hour < 12 THEN 'Morning' WHEN hour < 15 THEN 'Noon' WHEN hour < 18 THEN 'Evening' ELSE 'Night' END AS part FROM (SELECT *, CAST(left(t, 2) AS INT) AS hour FROM f)""")
def folder_sessions(spark, sf_dir):
    from lapframe.functions.text import folder_date, folder_time, session_of_day

    name = F.concat(F.date_format("ts", "dd.MM.yyyy"), F.lit("_"), F.date_format("ts", "HH.mm.ss"), F.lit("_run"))
    return table(spark, sf_dir, "events").select("event_id", folder_date(name).alias("day"), folder_time(name).alias("start"), session_of_day(folder_time(name)).alias("part"))


@query(r"""WITH n AS (SELECT c_custkey, 'Run' || (c_custkey % 97)::VARCHAR || '-' || (c_custkey * 7)::VARCHAR || '.csv' AS name FROM customer)
  SELECT c_custkey, name, array_to_string(list_transform(regexp_extract_all(lower(name), '\d+|\D+'), lambda p: CASE WHEN regexp_matches(p, '^\d') THEN lpad(p, 20, '0') ELSE p END), '') AS natural_key FROM n""")
def natural_order(spark, sf_dir):
    from lapframe.sources.files import natural_key

    name = F.concat(F.lit("Run"), (F.col("c_custkey") % 97).cast("string"), F.lit("-"), (F.col("c_custkey") * 7).cast("string"), F.lit(".csv"))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), natural_key(name).alias("natural_key"))


@query("SELECT l_suppkey AS run_id, count(*) AS n, round(avg(l_quantity * 0.5), 6) AS mean_half, round(sum(l_tax), 4) AS l_tax FROM lineitem GROUP BY l_suppkey")
def profile_units(spark, sf_dir):
    from lapframe.profiles import Profile, select_profile, unify

    profiles = [Profile("other", {"x": ("not_there", 1.0)}), Profile("line items", {"run_id": ("l_suppkey", 1.0), "half": ("l_quantity", 0.5)})]
    df = table(spark, sf_dir, "lineitem")
    got = unify(df, select_profile(df.columns, profiles))
    return got.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("half"), 6).alias("mean_half"), F.round(F.sum("l_tax"), 4).alias("l_tax"))


@query("SELECT DISTINCT user_id AS run_id, event_type AS channel FROM events")
def pick_lists(spark, sf_dir):
    return knots(spark, sf_dir).select("run_id", "channel").distinct()


@query(f"WITH {RUNS}, {LAPS}, {LAP_TABLE} SELECT run_id, n_lap, sum(n_rows)::BIGINT AS n_rows, {_r('sum(distance_m) AS distance_m', places=4)} FROM lap_table GROUP BY ROLLUP (run_id, n_lap)")
def lap_rollup(spark, sf_dir):
    return _rounded(lap_table(_laps(spark, sf_dir)).rollup("run_id", "n_lap").agg(F.sum("n_rows").alias("n_rows"), F.sum("distance_m").alias("distance_m")), 4)


@query(f"WITH {RUNS}, {LAPS}, r AS (SELECT *, count(*) OVER w AS n, avg(ay_mps2) OVER w AS across, avg(ax_mps2) OVER w AS along FROM laps WINDOW w AS (PARTITION BY run_id, n_lap ORDER BY seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) SELECT run_id, n_lap, seq, {_r('across', 'along')} FROM r WHERE n = 30")
def acceleration_diagram(spark, sf_dir):
    from lapframe.operators.plots import acceleration_diagram as diagram

    return _rounded(diagram(_laps(spark, sf_dir)))


@query(f"WITH {RUNS}, {LAPS}, r AS (SELECT *, count(*) OVER w AS n, avg(sqrt(vx_mps * vx_mps + vy_mps * vy_mps)) OVER w AS v_mean FROM laps WINDOW w AS (PARTITION BY run_id, n_lap ORDER BY seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) SELECT run_id, n_lap, seq, {_r('s_m', 'v_mean')} FROM r WHERE n = 30")
def speed_over_distance(spark, sf_dir):
    from lapframe.operators.plots import speed_over_distance as speed

    return _rounded(speed(derive(_laps(spark, sf_dir), only={"speed"})))


_TOTAL = "t AS (SELECT *, sqrt(ax_mps2 * ax_mps2 + ay_mps2 * ay_mps2) AS a_total FROM laps)"


@query(f"WITH {RUNS}, {LAPS}, {_TOTAL}, r AS (SELECT *, count(*) OVER w AS n, avg(a_total) OVER w AS a_mean FROM t WINDOW w AS (PARTITION BY run_id, n_lap ORDER BY seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) SELECT run_id, n_lap, seq, {_r('s_m', 'a_mean')} FROM r WHERE n = 30")
def combined_acceleration(spark, sf_dir):
    from lapframe.operators.plots import combined_acceleration as combined

    return _rounded(combined(derive(_laps(spark, sf_dir), only={"total_acceleration"})))


@query(f"""WITH {RUNS}, {LAPS}, {_TOTAL}, e AS (SELECT run_id, n_lap, seq, s_m AS x_from, vx_mps AS y_from, lead(s_m) OVER w AS x_to, lead(vx_mps) OVER w AS y_to, a_total AS colour, min(a_total) OVER (PARTITION BY run_id, n_lap) AS low, max(a_total) OVER (PARTITION BY run_id, n_lap) AS high
  FROM t WINDOW w AS (PARTITION BY run_id, n_lap ORDER BY s_m, seq)) SELECT run_id, n_lap, seq, {_r('x_from', 'y_from', 'x_to', 'y_to', 'colour', 'CASE WHEN high > low THEN (colour - low) / (high - low) ELSE 0 END AS share')} FROM e WHERE x_to IS NOT NULL""")
def coloured_segments(spark, sf_dir):
    from lapframe.operators.plots import coloured_segments as segments

    return _rounded(segments(derive(_laps(spark, sf_dir), only={"total_acceleration"})))


#: Least squares for two features in closed form.
_FIT = """m AS (SELECT avg(vx_mps) AS my, avg(whl_radps) AS m1, avg(ax_mps2) AS m2, var_pop(whl_radps) AS s11, var_pop(ax_mps2) AS s22, covar_pop(whl_radps, ax_mps2) AS s12, covar_pop(whl_radps, vx_mps) AS s1y, covar_pop(ax_mps2, vx_mps) AS s2y FROM runs),
w AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM m)"""


@query(f"WITH {RUNS}, {_FIT} SELECT run_id, seq, round(my + b1 * (whl_radps - m1) + b2 * (ax_mps2 - m2), 6) + 0.0::DOUBLE AS speed_estimate FROM runs, w")
def model_scores(spark, sf_dir):
    """A linear model and its scaler, fitted over all runs and applied to each row in the workers."""
    from lapframe.operators.scoring import fit_linear, score

    rows, features = runs(spark, sf_dir), ["whl_radps", "ax_mps2"]
    return _rounded(score(rows, *fit_linear(rows, features, "vx_mps"), features, "speed_estimate").select("run_id", "seq", "speed_estimate"))


@query(f"""WITH {RUNS}, {LAPS}, f AS (SELECT *, CASE WHEN seq > 0 AND n_lap = lag(n_lap) OVER (PARTITION BY run_id ORDER BY seq) THEN 0 ELSE 1 END AS fresh FROM laps), i AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS trace FROM f)
  SELECT run_id, trace, any_value(n_lap) AS n_lap, {_r('avg(pos_x_m) AS label_x', 'avg(pos_y_m) AS label_y')} FROM i GROUP BY run_id, trace""")
def track_map_labels(spark, sf_dir):
    from lapframe.operators.plots import track_map

    return _rounded(track_map(_laps(spark, sf_dir), "n_lap"))


@query(f"WITH {RUNS} SELECT run_id, seq, {_r('ay_mps2 AS x', 'ax_mps2 AS y', 'vx_mps AS colour')} FROM runs")
def scatter_points(spark, sf_dir):
    from lapframe.operators.plots import scatter

    return _rounded(scatter(runs(spark, sf_dir), "ay_mps2", "ax_mps2", "vx_mps"))



@query(f"""WITH {RUNS}, {LAPS}, q AS (SELECT run_id, n_lap, row_number() OVER (PARTITION BY run_id, n_lap ORDER BY seq) - 1 AS pos, round(ax_mps2 / 2, 6) AS r FROM laps), k0 AS (SELECT DISTINCT run_id, n_lap, 0 AS zero FROM q),
  p1 AS (SELECT k0.run_id, k0.n_lap, coalesce(max(CASE WHEN q.r < -0.97 THEN q.pos END), 0) AS phase1 FROM k0 JOIN q USING (run_id, n_lap) GROUP BY k0.run_id, k0.n_lap),
  p2 AS (SELECT p1.run_id, p1.n_lap, phase1, coalesce(max(CASE WHEN q.pos >= phase1 AND q.r < -0.3 THEN q.pos END), phase1) AS phase2 FROM p1 JOIN q USING (run_id, n_lap) GROUP BY p1.run_id, p1.n_lap, phase1),
  p3 AS (SELECT p2.run_id, p2.n_lap, phase1, phase2, coalesce(max(CASE WHEN q.pos >= phase2 AND q.r < 0.1 THEN q.pos END), phase2) AS phase3 FROM p2 JOIN q USING (run_id, n_lap) GROUP BY p2.run_id, p2.n_lap, phase1, phase2)
  SELECT * FROM p3""")
def phase_starts(spark, sf_dir):
    from lapframe.operators.corners import phase_starts as starts

    return starts(_laps(spark, sf_dir).withColumn("ratio", F.round(F.col("ax_mps2") / 2, 6)), "ratio")


@query(f"""{_SG}, ch AS (SELECT run_id, n_lap, CAST(floor(quantile_cont(pos, 0.5)) AS BIGINT) AS pos FROM g GROUP BY run_id, n_lap, stretch), q AS (SELECT run_id, n_lap, row_number() OVER (PARTITION BY run_id, n_lap ORDER BY seq) - 1 AS pos, vx_mps FROM laps)
  SELECT run_id, n_lap, pos FROM q WHERE vx_mps > 50 AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.run_id = q.run_id AND ch.n_lap = q.n_lap AND abs(ch.pos - q.pos) <= 30)""")
def points_off_changes(spark, sf_dir):
    from lapframe.functions.series import with_position
    from lapframe.operators.corners import sign_changes, without_near_changes

    laps = _laps(spark, sf_dir)
    fast = with_position(laps, ["run_id", "n_lap"]).where("vx_mps > 50").select("run_id", "n_lap", "pos")
    return without_near_changes(fast, sign_changes(laps, "ay_mps2"))


@query(f"WITH {RUNS}, {_MOTION} SELECT run_id, seq, CASE WHEN v_mps < 25 THEN 'Low Speed' WHEN v_mps < 40 THEN 'Medium Speed' ELSE 'High Speed' END AS corner_speed FROM m")
def speed_classes(spark, sf_dir):
    from lapframe.operators.corners import speed_class

    return derive(runs(spark, sf_dir), only={"speed"}).select("run_id", "seq", speed_class("v_mps").alias("corner_speed"))

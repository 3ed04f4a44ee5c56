"""Telemetry views over the driver's tables, and the same views as SQL.

``runs`` makes each supplier's line items one run of a car on a track of 1000 m;
``knots`` makes each user's events the sparse channels of one run; ``circuits`` makes each
supplier's line items one run around a track whose bends their quantities shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapframe.session import TASK_ROWS, dealt

#: Rows of a run in order: no two rows agree in all of these.
ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = dealt(table(spark, sf_dir, "lineitem"), "l_suppkey")
    seq = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*ORDER)).cast("long") - 1
    base = li.select("l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", seq.alias("seq"))
    return base.select(
        F.col("l_suppkey").alias("run_id"), "seq", (F.col("seq") * 0.1).alias("time_s"), (5.0 + F.col("l_quantity")).alias("vx_mps"),
        (F.col("l_discount") * 10.0 + 0.0).alias("vy_mps"), (F.col("l_tax") * 50.0 - 2.0).alias("ax_mps2"), (F.col("l_discount") * 100.0 - 5.0).alias("ay_mps2"),
        F.pmod(F.col("seq") * 7.0, F.lit(1000.0)).alias("s_m"), (F.col("l_tax") * 2.0 - 0.08).alias("yaw_rate_radps"), (F.col("l_discount") - 0.05).alias("delta_f_rad"),
        (F.pmod(F.col("l_extendedprice"), F.lit(40.0)) + 20.0).alias("whl_radps"),
        (100.0 * F.cos(F.col("seq") * 0.044)).alias("pos_x_m"), (100.0 * F.sin(F.col("seq") * 0.044)).alias("pos_y_m"),
    )


RUNS = """runs AS (SELECT l_suppkey AS run_id, seq, seq * 0.1::DOUBLE AS time_s, 5.0::DOUBLE + l_quantity AS vx_mps, l_discount * 10.0::DOUBLE + 0.0::DOUBLE AS vy_mps,
  l_tax * 50.0::DOUBLE - 2.0::DOUBLE AS ax_mps2, l_discount * 100.0::DOUBLE - 5.0::DOUBLE AS ay_mps2, (seq * 7.0::DOUBLE) % 1000.0::DOUBLE AS s_m,
  l_tax * 2.0::DOUBLE - 0.08::DOUBLE AS yaw_rate_radps, l_discount - 0.05::DOUBLE AS delta_f_rad, (l_extendedprice % 40.0::DOUBLE) + 20.0::DOUBLE AS whl_radps,
  100.0::DOUBLE * cos(seq * 0.044::DOUBLE) AS pos_x_m, 100.0::DOUBLE * sin(seq * 0.044::DOUBLE) AS pos_y_m
  FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS seq FROM lineitem))"""


def knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, channel, time_s, value, seq: hours since 2024 began, so the grid of an hourly rate stays small."""
    ev = table(spark, sf_dir, "events")
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(3.6e9)
    return ev.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("channel"), hours.alias("time_s"), "value", F.col("event_id").alias("seq"))


KNOTS = "knots AS (SELECT user_id AS run_id, event_type AS channel, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS time_s, value, event_id AS seq FROM events)"
CHANNELS = ["click", "error", "purchase", "signup", "view"]

#: Rows for each line item, line items for each bend, rows of a lap, metres between rows.
ITEM_ROWS, BEND_ITEMS, LAP_ROWS, STEP_M = 2, 75, 600, 2.0


def circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laps with a shape: 75 line items are a bend, as sharp as their quantities say, with braking before it; the tyres follow a tyre curve."""
    li = dealt(table(spark, sf_dir, "lineitem"), "l_suppkey", rows=TASK_ROWS // ITEM_ROWS)
    no = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*ORDER)).cast("long") - 1
    items = li.select(F.col("l_suppkey").alias("run_id"), "l_quantity", "l_tax", no.alias("no")).withColumn("bend", F.floor(F.col("no") / BEND_ITEMS))
    items = items.withColumn("weight", F.sum("l_quantity").over(Window.partitionBy("run_id", "bend")))
    rows = items.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(ITEM_ROWS)]))).withColumn("seq", F.col("no") * ITEM_ROWS + F.col("k"))
    length = ITEM_ROWS * BEND_ITEMS
    hump = lambda t: 16.0 * t * t * (1.0 - t) * (1.0 - t)
    t, u = (F.col("seq") % length) / float(length), ((F.col("seq") + 95) % length) / float(length)
    curvature = (F.col("weight") % 7.0 - 3.0) / 3.0 * 0.02 * hump(t)
    braking = F.round(0.9 - (1.8 + F.col("weight") % 5.0 * 0.05) * hump(u), 6)
    placed = rows.select(
        "run_id", "seq", (F.floor(F.col("seq") / LAP_ROWS) + 1).cast("int").alias("n_lap"), (F.col("seq") % LAP_ROWS * STEP_M).alias("s_m"), (F.col("seq") * 0.05).alias("time_s"),
        curvature.alias("curvature_smoothed"), braking.alias("r_cos_phi_smoothed"), "l_quantity", "l_tax",
    )
    moved = placed.withColumn("v_mps", 45.0 - 1100.0 * F.abs("curvature_smoothed") + (F.col("l_quantity") - 25.0) * 0.002).withColumn("ay_mps2_smoothed", F.col("v_mps") * F.col("v_mps") * F.col("curvature_smoothed"))
    slip = F.col("ay_mps2_smoothed") / 150.0 + (F.col("l_tax") - 0.04) * 0.05
    tyre = lambda x: 8000.0 * F.sin(1.9 * F.atan(12.0 * x))
    return moved.withColumns({"alpha_f_rad": slip, "alpha_r_rad": slip * 0.8}).withColumns({"fy_f_N": tyre(F.col("alpha_f_rad")), "fy_r_N": tyre(F.col("alpha_r_rad")) * 1.1}).drop("l_quantity", "l_tax")


def _hump(t: str) -> str:
    return f"16.0::DOUBLE * ({t}) * ({t}) * (1.0::DOUBLE - ({t})) * (1.0::DOUBLE - ({t}))"


_T, _U = f"(seq % {ITEM_ROWS * BEND_ITEMS}) / {ITEM_ROWS * BEND_ITEMS}.0::DOUBLE", f"((seq + 95) % {ITEM_ROWS * BEND_ITEMS}) / {ITEM_ROWS * BEND_ITEMS}.0::DOUBLE"
CIRCUITS = f"""items AS (SELECT l_suppkey AS run_id, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY {", ".join(ORDER)}) - 1 AS no FROM lineitem),
bent AS (SELECT *, sum(l_quantity) OVER (PARTITION BY run_id, no // {BEND_ITEMS}) AS weight FROM items), spread AS (SELECT *, no * {ITEM_ROWS} + unnest(range({ITEM_ROWS})) AS seq FROM bent),
placed AS (SELECT run_id, seq, CAST(seq // {LAP_ROWS} + 1 AS INTEGER) AS n_lap, seq % {LAP_ROWS} * {STEP_M}::DOUBLE AS s_m, l_quantity,
  (weight % 7.0::DOUBLE - 3.0::DOUBLE) / 3.0::DOUBLE * 0.02::DOUBLE * ({_hump(_T)}) AS curvature, round(0.9::DOUBLE - (1.8::DOUBLE + weight % 5.0::DOUBLE * 0.05::DOUBLE) * ({_hump(_U)}), 6) AS ratio FROM spread),
driven AS (SELECT *, 45.0::DOUBLE - 1100.0::DOUBLE * abs(curvature) + (l_quantity - 25.0::DOUBLE) * 0.002::DOUBLE AS v FROM placed),
circuits AS (SELECT *, v * v * curvature AS ay, row_number() OVER (PARTITION BY run_id, n_lap ORDER BY seq) - 1 AS pos, count(*) OVER (PARTITION BY run_id, n_lap) AS size FROM driven)"""

LAPS = """marked AS (SELECT *, coalesce(s_m - lag(s_m) OVER w < -300, false) AS fall FROM runs WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
falls AS (SELECT run_id, seq, lead(seq) OVER (PARTITION BY run_id ORDER BY seq) AS next_seq FROM marked WHERE fall),
begins AS (SELECT run_id, seq FROM falls WHERE next_seq IS NULL OR next_seq - seq >= 100),
laps AS (SELECT m.*, CAST(1 + sum(CASE WHEN b.seq IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY m.run_id ORDER BY m.seq ROWS UNBOUNDED PRECEDING) AS INTEGER) AS n_lap
  FROM marked m LEFT JOIN begins b ON m.run_id = b.run_id AND m.seq = b.seq)"""

LAP_TABLE = """lap_table AS (SELECT run_id, n_lap, count(*) AS n_rows, max_by(time_s, seq) - min_by(time_s, seq) AS lap_s, max(time_s) - min(time_s) AS duration_s, max(s_m) - min(s_m) AS distance_m,
  max(CASE WHEN step > 0 THEN step END) AS longest_step_m FROM (SELECT *, s_m - lag(s_m) OVER (PARTITION BY run_id, n_lap ORDER BY seq) AS step FROM laps) GROUP BY run_id, n_lap)"""

"""Distance along the track: from the path and a start line, and by the nearest points of a reference run."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapframe.functions.series import RUN, SEQ, diff, let, ordered, so_far
from lapframe.session import materialize

DEBOUNCE_S = 5.0


def line_crossings(df: DataFrame, line: tuple[tuple[float, float], tuple[float, float]], run: str = RUN, seq: str = SEQ) -> DataFrame:
    """run_id, seq, time_s, direction of each step that meets the line; a row stands for the step that ends there."""
    (x1, y1), (x2, y2) = line
    lx, ly = x2 - x1, y2 - y1
    if (lx * lx + ly * ly) ** 0.5 <= 1e-9:
        raise ValueError("the ends of the start line must differ")
    w = ordered(run, seq)
    moved = df.select(run, seq, "time_s", F.lag("pos_x_m").over(w).alias("px"), F.lag("pos_y_m").over(w).alias("py"), diff("pos_x_m", w).alias("dx"), diff("pos_y_m", w).alias("dy"))
    cross = F.col("dx") * F.lit(ly) - F.col("dy") * F.lit(lx)
    ox, oy = F.lit(x1) - F.col("px"), F.lit(y1) - F.col("py")
    moved = moved.withColumn("cross", cross).where(F.abs("cross") > 1e-12)
    along = (ox * F.lit(ly) - oy * F.lit(lx)) / F.col("cross")
    across = (ox * F.col("dy") - oy * F.col("dx")) / F.col("cross")
    return moved.where(along.between(0, 1) & across.between(0, 1)).select(run, seq, "time_s", F.signum("cross").cast("int").alias("direction"))


def debounced(crossings: DataFrame, run: str = RUN, seq: str = SEQ, gap_s: float = DEBOUNCE_S) -> DataFrame:
    """The crossings that come ``gap_s`` or more after the last one kept, per run and direction.

    What is kept depends on what was kept before, so it is a pass in order; crossings are few.
    """
    kinds = dict(crossings.dtypes)

    def run_pass(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(seq)
        keep, last = [], None
        for t in rows["time_s"]:
            keep.append(last is None or t - last >= gap_s)
            last = t if keep[-1] else last
        return rows[keep]

    return crossings.groupBy(run, "direction").applyInPandas(run_pass, f"`{run}` {kinds[run]}, `{seq}` {kinds[seq]}, time_s double, direction int")


def path_distance(df: DataFrame, line: tuple[tuple[float, float], tuple[float, float]], run: str = RUN, seq: str = SEQ) -> DataFrame:
    """``df`` with ``s_m``: metres since the last crossing in the direction with most of them (backward on a tie).

    NULL for a run with less than two such crossings.
    """
    kept = debounced(line_crossings(df, line, run, seq), run, seq)
    counts = kept.groupBy(run, "direction").agg(F.count(F.lit(1)).alias("n"))
    chosen = counts.groupBy(run).agg(F.max(F.struct("n", (-F.col("direction")).alias("d"))).alias("m")).where("m.n >= 2").select(run, (-F.col("m.d")).cast("int").alias("direction"))
    resets = kept.join(chosen, [run, "direction"]).select(run, seq, F.lit(1).alias("__crossed"))
    return reset_distance(df.join(chosen.select(run, F.lit(1).alias("__usable")), run, "left").join(resets, [run, seq], "left"), run, seq)


def reset_distance(df: DataFrame, run: str = RUN, seq: str = SEQ) -> DataFrame:
    """``s_m``: the path's running length less its value at the last row marked ``__crossed``; NULL unless ``__usable``."""
    w = ordered(run, seq)
    step = F.hypot(diff("pos_x_m", w), diff("pos_y_m", w))
    far = df.withColumn("__step", F.coalesce(step, F.lit(0.0))).withColumn("__far", F.sum("__step").over(so_far(w)))
    origin = F.max(F.when(F.col("__crossed") == 1, F.col("__far")).otherwise(F.lit(0.0))).over(so_far(w))
    return far.withColumn("__from", origin).withColumn("s_m", F.when(F.col("__usable") == 1, F.col("__far") - F.col("__from"))).drop("__step", "__far", "__from", "__crossed", "__usable")


def reference_points(df: DataFrame, offset_m: float = 0.0) -> DataFrame:
    """ref_seq, ref_x, ref_y, ref_s from the rows of one reference run, with the distance shifted and wrapped."""
    longest = df.agg(F.max("s_m").alias("m")).first()["m"]
    wrapped = F.pmod(F.col("s_m") + F.lit(float(offset_m)), F.lit(longest)) if longest else F.lit(0.0)
    return df.where("s_m is not null").select(F.col("seq").alias("ref_seq"), F.col("pos_x_m").alias("ref_x"), F.col("pos_y_m").alias("ref_y"), wrapped.alias("ref_s"))


def nearest_distance(df: DataFrame, reference: DataFrame, k: int = 3, cell_m: float = 20.0, run: str = RUN, seq: str = SEQ) -> DataFrame:
    """``df`` with ``s_norm_m``: the mean distance of the ``k`` nearest reference points; ties go to the earlier point.

    Points are dealt into square cells. A row looks into its cell and the eight around it; if the
    kth hit is not surely nearer than what lies outside them, the search is repeated with cells four
    times as wide, until no row is left. So the result is exact wherever a run leaves the reference.
    The points around a cell are one array, so a row stays one row and is never dealt by itself.
    """
    rows = df.withColumn("__found", F.lit(None).cast("struct<hits:int,reach:double,s:double>"))
    known = F.col("pos_x_m").isNotNull() & F.col("pos_y_m").isNotNull()
    n = reference.count()
    k = min(k, n)
    if not k:
        return df.withColumn("s_norm_m", F.lit(None).cast("double"))
    reference = materialize(reference, "nearest-reference")
    parts, left, size, asked = [], rows, float(cell_m), known
    while True:
        last = n <= 9 * k  # so few points: one cell for all
        found = materialize(_in_cells(left, reference, k, size, asked, everything=last), "nearest-found")
        hit = F.col("__found")
        open_ = F.lit(False) if last else known & ~F.coalesce((hit["hits"] >= k) & (hit["reach"] <= size), F.lit(False))
        parts.append(found.where(~open_))
        left, asked = found.where(open_), F.lit(True)
        if last or left.isEmpty():
            break
        size *= 4
    return reduce(DataFrame.unionByName, parts).withColumn("s_norm_m", F.col("__found")["s"]).drop("__found")


def _in_cells(rows: DataFrame, reference: DataFrame, k: int, size: float, asked: Column, everything: bool) -> DataFrame:
    """``rows`` with ``__found``: how many hits, the distance of the last of the ``k`` nearest, and their mean place."""
    cell = lambda c: F.floor(F.col(c) / F.lit(size)).cast("long") if not everything else F.lit(0).cast("long")
    around = F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long")) if not everything else F.array(F.lit(0).cast("long"))
    points = reference.withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around)).withColumns({"__cx": cell("ref_x") + F.col("__dx"), "__cy": cell("ref_y") + F.col("__dy")})
    cells = points.groupBy("__cx", "__cy").agg(F.sort_array(F.collect_list(F.struct("ref_seq", "ref_x", "ref_y", "ref_s"))).alias("__points"))
    placed = rows.withColumns({"__cx": F.when(asked, cell("pos_x_m")), "__cy": F.when(asked, cell("pos_y_m"))})
    joined = placed.join(materialize(cells, "nearest-cells"), ["__cx", "__cy"], "left")
    x, y = F.col("pos_x_m"), F.col("pos_y_m")
    gap = lambda p: F.hypot(x - p["ref_x"], y - p["ref_y"])
    # distances alone are sorted fast; only points no farther than the kth are looked at with their order
    kth = F.get(F.sort_array(F.transform("__points", gap)), F.least(F.lit(k), F.size("__points")) - 1)
    near = lambda far: F.transform(F.filter("__points", lambda p: gap(p) <= far), lambda p: F.struct(gap(p).alias("d"), p["ref_seq"].alias("q"), p["ref_s"].alias("s")))
    best = F.slice(F.sort_array(let(kth, near)), 1, k)
    mean = lambda b: F.aggregate(b, F.lit(0.0), lambda total, p: total + p["s"]) / F.size(b)
    found = let(best, lambda b: F.struct(F.size(b).alias("hits"), F.element_at(b, -1)["d"].alias("reach"), mean(b).alias("s")))
    return joined.withColumn("__found", F.when(F.col("__points").isNotNull(), found)).drop("__cx", "__cy", "__points")

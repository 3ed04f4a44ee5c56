"""Instantaneous cornering stiffness of an axle: local slopes of force over slip angle.

A run goes in chunks of rows: slip and force are filtered by :func:`lowpass`, and each
chunk sees the rows before it that its windows reach (:func:`with_lookback`). All sums over
windows and sections come from running sums, in linear time. The last stiffness of the
linear region, which the ratio refers to, is carried from chunk to chunk by one row of each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapframe.functions.kernels import Line, butterworth_lowpass, s_curve, segment_labels, window_starts, zero_phase
from lapframe.functions.series import RUN, SEQ, ordered, sample_rates, so_far
from lapframe.operators.chunks import CHUNK_ROWS, Filters, by_series, long_series, lowpass, numbers, parts_for, with_lookback
from lapframe.session import materialize

CUTOFF_HZ, FILTER_ORDER = 2.0, 4
SPAN_RAD, SECTION_ORDER, OVERALL_ORDER = 0.02, 4, 1
LINEAR_RAD = 0.021


def filtered(x: np.ndarray, rate_hz: float) -> np.ndarray:
    b, a = butterworth_lowpass(FILTER_ORDER, CUTOFF_HZ / (rate_hz / 2.0))
    return zero_phase(b, a, x)


def _weighted(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known = ~np.isnan(values)
    return np.where(known, values * weights, 0.0), np.where(known, weights, 0.0)


def section_slopes(x: np.ndarray, line: Line, starts: np.ndarray) -> np.ndarray:
    """Per window: the mean of its sections' slopes, weighted by the slip interval each covers.

    A window's first and last sections may be parts of a segment; those between are whole, and a running sum holds them.
    """
    label = segment_labels(x)
    first = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
    last = np.r_[first[1:] - 1, len(x) - 1]
    end = np.arange(len(x))

    def part(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _weighted(line.fit(a, b)[0], s_curve(np.abs(x[b] - x[a]), 0.0, SPAN_RAD, SECTION_ORDER))

    whole = [np.r_[0.0, np.cumsum(v)] for v in part(first, last)]
    i, j = label[starts], label[end]
    one = i == j
    head = part(starts, np.where(one, end, last[i]))
    tail = part(np.where(one, end, first[j]), end)
    sums = []
    for h, t, w in zip(head, tail, whole, strict=True):
        between = np.where(one, 0.0, w[j] - w[np.minimum(i + 1, j)])
        sums.append(h + np.where(one, 0.0, t) + between)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(sums[1] == 0, np.nan, sums[0] / sums[1])


def window_values(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of filtered slip and force: (stiffness in N/rad, whether the window lies in the linear region)."""
    starts, end = window_starts(x, SPAN_RAD), np.arange(len(x))
    line = Line(x, y)
    slope, r2 = line.fit(starts, end)
    weight = s_curve(r2, 0.0, 1.0, OVERALL_ORDER)
    value = weight * slope + (1 - weight) * section_slopes(x, line, starts)
    # a window's largest deflection is at one of its extremes, and those lie within SPAN_RAD of its end
    return value, _largest(np.abs(x), starts) < LINEAR_RAD


def stiffness(slip: np.ndarray, force: np.ndarray, rate_hz: float) -> tuple[np.ndarray, np.ndarray]:
    """One series in one pass: (stiffness, its ratio to the last one of the linear region, at most 1)."""
    return _with_ratio(*window_values(filtered(slip, rate_hz), filtered(force, rate_hz)))


def _with_ratio(value: np.ndarray, linear: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    held = np.maximum.accumulate(np.where(linear, np.arange(len(value)), -1))
    base = np.where(held >= 0, value[np.maximum(held, 0)], np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        # no ratio to a stiffness of 0
        return value, np.minimum(np.where(base == 0, np.nan, value / base), 1.0)


def _largest(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The maximum of each window, by a table of maxima of spans that double."""
    table, out = [x], np.empty(len(x))
    size = np.arange(len(x)) - starts + 1
    level = np.floor(np.log2(size)).astype(int)
    while (1 << len(table)) <= size.max(initial=1):
        step = 1 << (len(table) - 1)
        before = table[-1]
        table.append(np.maximum(before[: len(before) - step], before[step:]))
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        row = table[k]
        out[at] = np.maximum(row[starts[at]], row[at - (1 << k) + 1])
    return out


def estimate_stiffness(df: DataFrame, run: str = RUN, seq: str = SEQ, rate_hz: float | None = None, rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with cs_f_Nprad, cs_r_Nprad, cs_ratio_f and cs_ratio_r; NULL where a run is too short or has gaps.

    ``rate_hz``: the sampling rate of all runs; else each run's own, from its times. ``rows``: the size of a chunk, by ``seq``.
    Runs of up to so many rows go in one pass each, both axles together, and longer ones in chunks, with the same result.
    """
    long = long_series(df, [run], rows)
    if long is None:
        return _in_one_pass(df, run, seq, rate_hz)
    short, rest = df.join(F.broadcast(long), run, "left_anti"), df.join(F.broadcast(long), run, "left_semi")
    return _in_one_pass(short, run, seq, rate_hz).unionByName(_in_chunks(rest, run, seq, rate_hz, rows))


def _in_one_pass(df: DataFrame, run: str, seq: str, rate_hz: float | None) -> DataFrame:
    kinds, filters = dict(df.dtypes), Filters(FILTER_ORDER, CUTOFF_HZ)
    kept = [c for c in df.columns if c != run]
    parts = df.withColumns({f"__{c}": F.col(c).cast("double") for a in "fr" for c in (f"alpha_{a}_rad", f"fy_{a}_N")} | ({} if rate_hz else {"__time": F.col("time_s").cast("double")}))

    def rate_of(part: pa.Table) -> float | None:
        if rate_hz:
            return float(rate_hz)
        t = part.column("__time").drop_null().to_numpy()
        return (len(t) - 1) / (t.max() - t.min()) if len(t) and t.max() > t.min() else None

    def of_run(part: pa.Table) -> dict:
        out = {c: part.column(c) for c in kept}
        r = filters.at(rate_of(part)) if part.column(run)[0].is_valid else None
        for a in "fr":
            slip, force = numbers(part, f"__alpha_{a}_rad"), numbers(part, f"__fy_{a}_N")
            value = ratio = np.full(len(part), np.nan)
            if r is not None and len(slip) > r.pad and np.isfinite(slip).all() and np.isfinite(force).all():
                value, ratio = _with_ratio(*window_values(r.zero_phase(slip), r.zero_phase(force)))
            out |= {f"cs_{a}_Nprad": value, f"cs_ratio_{a}": ratio}
        return out

    found = {f"cs_{a}_Nprad": "double" for a in "fr"} | {f"cs_ratio_{a}": "double" for a in "fr"}
    done = by_series(parts, [run], [seq], of_run, {c: kinds[c] for c in kept} | found, parts_for(df))
    return done.select(*df.columns, "cs_f_Nprad", "cs_ratio_f", "cs_r_Nprad", "cs_ratio_r")


def _in_chunks(df: DataFrame, run: str, seq: str, rate_hz: float | None, rows: int) -> DataFrame:
    kinds, keys = dict(df.dtypes), [run, "axle"]
    axles = F.array(*[F.struct(F.lit(a).alias("axle"), F.col(f"alpha_{a}_rad").alias("slip"), F.col(f"fy_{a}_N").alias("force")) for a in "fr"])
    rated = df.withColumn("rate", F.lit(float(rate_hz))) if rate_hz else df.join(sample_rates(df, run=run).withColumnRenamed("sample_hz", "rate"), run)
    long = rated.select(run, seq, "rate", F.explode(axles).alias("x")).select(run, seq, "rate", "x.*")
    smooth = materialize(lowpass(long, ["slip", "force"], keys, "rate", CUTOFF_HZ, FILTER_ORDER, seq, rows), "stiffness-filtered")  # read twice
    whole = smooth.where(F.col("slip").isNotNull() & F.col("force").isNotNull())

    def of_chunk(part: pa.Table) -> dict:
        value, linear = window_values(numbers(part, "slip"), numbers(part, "force"))
        own = part.column("own").to_numpy()
        return {seq: part.column(seq).to_numpy()[own], "value": value[own], "linear": linear[own]}

    found = by_series(with_lookback(whole, "slip", SPAN_RAD, keys, seq), [*keys, "chunk"], [seq], of_chunk, {seq: kinds[seq], "value": "double", "linear": "boolean"})
    found = materialize(found, "stiffness-windows")  # read twice
    found = found.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    # a stiffness of the linear region that is unknown is held as such: the struct around it is not null
    held = F.when(F.col("linear"), F.struct("value"))
    ends = found.groupBy(*keys, "chunk").agg(F.max_by(held, F.when(F.col("linear"), F.col(seq))).alias("end"))
    brought = F.last("end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*keys, "chunk", brought.alias("brought"))
    here = F.last(held, ignorenulls=True).over(so_far(ordered([*keys, "chunk"], seq)))
    ratio = F.try_divide("value", F.coalesce("here", "brought")["value"])
    rated = found.withColumn("here", here).join(ends, [*keys, "chunk"]).withColumn("ratio", F.when(ratio > 1, 1.0).otherwise(ratio))
    columns = [F.first(F.when(F.col("axle") == a, F.col(c)), ignorenulls=True).alias(n) for a in "fr" for c, n in (("value", f"cs_{a}_Nprad"), ("ratio", f"cs_ratio_{a}"))]
    return df.join(rated.groupBy(run, seq).agg(*columns), [run, seq], "left")


def magic_formula(slip: np.ndarray, b: float, c: float, d: float, e: float) -> np.ndarray:
    """Lateral force by the four-parameter tyre curve."""
    bx = b * slip
    return d * np.sin(c * np.arctan(bx - e * (bx - np.arctan(bx))))


def magic_formula_slope(slip: np.ndarray, b: float, c: float, d: float, e: float) -> np.ndarray:
    bx = b * slip
    inner = bx - e * (bx - np.arctan(bx))
    rise = b * (1 - e) + e * b / (1 + bx * bx)
    return d * np.cos(c * np.arctan(inner)) * c / (1 + inner * inner) * rise


#: Where the fit starts.
MAGIC_START = (12.0, 1.9, 8000.0, 0.97)


def fit_magic_formula(slip: np.ndarray, force: np.ndarray, start: tuple[float, ...] = MAGIC_START, rounds: int = 60) -> np.ndarray:
    """Least squares for (b, c, d, e) by damped Gauss-Newton steps, with numerical derivatives."""
    p, damp = np.array(start, float), 1e-2
    residual = magic_formula(slip, *p) - force
    cost = residual @ residual
    for _ in range(rounds):
        step = 1e-6 * np.maximum(np.abs(p), 1e-3)
        jac = np.stack([(magic_formula(slip, *(p + step * (np.arange(4) == k))) - magic_formula(slip, *p)) / step[k] for k in range(4)], axis=1)
        normal, gradient = jac.T @ jac, jac.T @ residual
        try:
            move = np.linalg.solve(normal + damp * np.diag(np.diag(normal) + 1e-12), -gradient)
        except np.linalg.LinAlgError:
            break
        tried = magic_formula(slip, *(p + move)) - force
        if tried @ tried < cost:
            gain = cost - tried @ tried
            p, residual, cost, damp = p + move, tried, tried @ tried, damp / 3
            if gain < 1e-12 * max(cost, 1.0):
                break
        else:
            damp *= 4
    return p


def _normal_terms(slip: Column, force: Column, p: Column) -> dict[str, Column]:
    """Of one sample at parameters ``p`` (an array): the products of derivatives and residual that the normal equations sum up, and the squared residual."""
    b, c, d, e = (F.get(p, F.lit(k)) for k in range(4))
    bx = b * slip
    bend = F.atan(bx)
    inner = bx - e * (bx - bend)
    angle = F.atan(inner)
    wave, slope = F.sin(c * angle), d * F.cos(c * angle)
    steep = slope * c / (1.0 + inner * inner)
    parts = [steep * (slip * (1.0 - e) + e * slip / (1.0 + bx * bx)), slope * angle, wave, -steep * (bx - bend), d * wave - force]
    return {f"s{i}{j}": F.sum(parts[i] * parts[j]) for i in range(5) for j in range(i, 5)}


def _sums(slip: np.ndarray, force: np.ndarray, p: list[float]) -> np.ndarray:
    """The same sums (5 x 5) over samples at hand."""
    b, c, d, e = p
    bx = b * slip
    bend = np.arctan(bx)
    inner = bx - e * (bx - bend)
    angle = np.arctan(inner)
    wave, slope = np.sin(c * angle), d * np.cos(c * angle)
    steep = slope * c / (1.0 + inner * inner)
    parts = np.stack([steep * (slip * (1.0 - e) + e * slip / (1.0 + bx * bx)), slope * angle, wave, -steep * (bx - bend), d * wave - force])
    return parts @ parts.T


def _advance(r: dict, sums: np.ndarray, tolerance: float) -> None:
    """Of a fit ``r``: whether what was tried is better, and what to try next."""
    if np.isfinite(sums).all() and not sums[4, 4] >= r["cost"]:  # the first cost is NaN
        gain, r["best"], r["cost"], r["sums"], r["damp"] = r["cost"] - sums[4, 4], list(r["tried"]), sums[4, 4], sums.ravel().tolist(), r["damp"] / 3
        r["done"] = bool(gain < tolerance * max(sums[4, 4], 1.0))
    else:
        r["damp"] *= 4
        r["done"] = bool(r["damp"] > 1e9 or r["sums"] is None)
    if not r["done"]:
        normal = np.array(r["sums"]).reshape(5, 5)
        move = np.linalg.solve(normal[:4, :4] + r["damp"] * np.diag(np.diag(normal[:4, :4]) + 1e-12), -normal[:4, 4])
        r["tried"] = (np.array(r["best"]) + move).tolist()


def _next_try(found: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    """The same for each fit of a batch."""
    out = found[[c for c in found.columns if not (len(c) == 3 and c[0] == "s" and c[1:].isdigit())]].copy()
    for row, r in enumerate(found.to_dict("records")):
        if r["done"]:
            continue
        _advance(r, np.array([[r[f"s{min(i, j)}{max(i, j)}"] for j in range(5)] for i in range(5)]), tolerance)
        for c in ("tried", "best", "cost", "sums", "damp", "done"):
            out.at[out.index[row], c] = r[c]
    return out


def fit_tyre_curves(df: DataFrame, keys: list[str], slip: str = "slip", force: str = "force", rounds: int = 60, tolerance: float = 1e-10, alone: int = CHUNK_ROWS) -> DataFrame:
    """keys, b, c, d, e, n, rmse: the tyre curve of each series by damped Gauss-Newton steps.

    A series of up to ``alone`` samples is fitted where its samples are, and all such series in one pass. Longer ones are spread over
    tasks (:func:`_fit_in_rounds`). Both take the same steps. A series without samples has no row.
    """
    rows = materialize(df.where(F.col(slip).isNotNull() & F.col(force).isNotNull()).select(*keys, F.col(slip).cast("double").alias("slip"), F.col(force).cast("double").alias("force")), "tyre-rows")

    def fit(part: pa.Table) -> dict:
        x, y = numbers(part, "slip"), numbers(part, "force")
        r = {"tried": list(MAGIC_START), "best": list(MAGIC_START), "cost": float("nan"), "sums": None, "damp": 1e-2, "done": False}
        with np.errstate(all="ignore"):
            for _ in range(rounds):
                _advance(r, _sums(x, y, r["tried"]), tolerance)
                if r["done"]:
                    break
        return {k: [v] for k, v in zip("bcde", r["best"], strict=True)} | {"n": [len(x)], "cost": [r["cost"]]}

    long = long_series(rows, keys, alone)
    short = rows if long is None else rows.join(F.broadcast(long), keys, "left_anti")
    fits = by_series(short, keys, ["slip", "force"], fit, {**dict.fromkeys("bcde", "double"), "n": "long", "cost": "double"}, parts_for(rows))
    if long is not None:
        fits = fits.unionByName(_fit_in_rounds(rows.join(F.broadcast(long), keys), keys, rounds, tolerance))
    return fits.select(*keys, *"bcde", "n", F.sqrt(F.coalesce("cost", F.lit(float("nan"))) / F.col("n")).alias("rmse"))


def _fit_in_rounds(rows: DataFrame, keys: list[str], rounds: int, tolerance: float) -> DataFrame:
    """keys, b, c, d, e, n, cost of series of any length.

    A round is one pass over the samples: Spark sums up the normal equations at what each series tries, 15 numbers for each;
    only these meet NumPy. Series that have settled drop out. Fits are fewer than the samples by the length of a series, so they are broadcast.
    """
    kinds = dict(rows.dtypes)
    first = F.array(*[F.lit(float(x)) for x in MAGIC_START])
    fits = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(
        *keys, "n", first.alias("tried"), first.alias("best"), F.lit(float("nan")).alias("cost"), F.lit(None).cast("array<double>").alias("sums"), F.lit(1e-2).alias("damp"), F.lit(False).alias("done"),
    )
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "n long, tried array<double>, best array<double>, cost double, sums array<double>, damp double, done boolean"])

    def advance(batches):
        for part in batches:
            yield _next_try(part.astype({"tried": object, "best": object, "sums": object}), tolerance)

    fits = materialize(fits, "tyre-fits")
    for _ in range(rounds):
        tried = F.broadcast(fits.where("NOT done").select(*keys, "tried"))
        summed = rows.join(tried, keys).groupBy(*keys).agg(*[v.alias(k) for k, v in _normal_terms(F.col("slip"), F.col("force"), F.col("tried")).items()])
        fits = materialize(fits.withColumn("cost", F.coalesce("cost", F.lit(float("nan")))).join(summed, keys, "left").mapInPandas(advance, schema), "tyre-fits")
        if fits.where("NOT done").isEmpty():
            break
    return fits.select(*keys, *[F.get("best", F.lit(k)).alias(x) for k, x in enumerate("bcde")], "n", "cost")

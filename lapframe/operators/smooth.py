"""Smoothing by centred means, of widths in seconds.

All runs go together, whatever their rates: the place in the run over the run's own width is a scale on which the
window has the same size everywhere, so it is one range frame for each width in seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapframe.functions.series import RUN, SEQ, centered_mean, ordered, sample_rates, with_position


def widths(filters: dict[str, float], rate_hz: float, columns: list[str]) -> dict[str, int]:
    """Rows per filter: half to even, left out if under one row or without its signal."""
    got = {s: round(seconds * rate_hz) for s, seconds in filters.items() if s in columns}
    return {s: n for s, n in got.items() if n >= 1}


def smooth_at(df: DataFrame, filters: dict[str, float], rate_hz: float, run: str = RUN, seq: str = SEQ) -> DataFrame:
    """``df`` with ``<signal>_smoothed`` for each filter, at one known rate. Windows with one order share a sort."""
    w = ordered(run, seq)
    return df.withColumns({f"{s}_smoothed": centered_mean(s, n, w) for s, n in widths(filters, rate_hz, df.columns).items()})


def smooth(df: DataFrame, filters: dict[str, float], run: str = RUN, seq: str = SEQ, rate_hz: float | None = None) -> DataFrame:
    """``df`` with ``<signal>_smoothed`` for each filter whose signal is there, at each run's own rate (to 0.01 Hz) where none is given.

    Where a filter is under one row of a run its mean is NULL there; the columns depend on ``df`` and ``filters`` alone.
    """
    if rate_hz is not None:
        return smooth_at(df, filters, rate_hz, run, seq)
    present = {s: float(seconds) for s, seconds in filters.items() if s in df.columns}
    if not present:
        return df
    names = {seconds: f"__width{k}" for k, seconds in enumerate(sorted(set(present.values())))}
    rate = F.coalesce(F.round("sample_hz", 2), F.lit(0.0))
    rated = sample_rates(df, run=run).select(run, *[F.rint(F.lit(seconds) * rate).cast("int").alias(n) for seconds, n in names.items()])
    widest = rated.agg(F.max(F.greatest(F.lit(1), *names.values()))).first()[0] or 1
    slack = 0.25 / widest  # of a row, on the scale of the widest window; even widths have one row more behind
    placed = with_position(df, run, seq, "__pos").join(rated, run)
    means = {}
    for s, seconds in present.items():
        n = names[seconds]
        frame = f"OVER (PARTITION BY `{run}` ORDER BY __pos / greatest({n}, 1) RANGE BETWEEN {0.5 + slack!r}D PRECEDING AND {0.5 - slack!r}D FOLLOWING)"
        means[f"{s}_smoothed"] = F.when(F.col(n) >= 1, F.expr(f"avg(`{s}`) {frame}"))
    return placed.withColumns(means).select(*df.columns, *means)


def read_filters(path: str) -> dict[str, float]:
    """signal_name, window_length_s of a configuration file (read on the driver)."""
    import csv

    with open(path, newline="") as f:
        return {r["signal_name"]: float(r["window_length_s"]) for r in csv.DictReader(f)}

"""Trajectory files: two columns of coordinates, with a label, a colour and an offset."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Trajectory:
    path: str
    label: str | None = None
    color: str | None = None
    x_offset: float = 0.0
    y_offset: float = 0.0


def parse_spec(text: str) -> Trajectory:
    """PATH[,LABEL[,COLOR[,X[,Y]]]], quoted as in CSV."""
    parts = [p.strip() for p in next(csv.reader([text]))]
    if not parts or not parts[0] or len(parts) > 5:
        raise ValueError(f"not a trajectory: {text!r}")
    label, color = (parts[k] or None if len(parts) > k else None for k in (1, 2))
    try:
        x, y = (float(parts[k]) if len(parts) > k and parts[k] else 0.0 for k in (3, 4))
    except ValueError:
        raise ValueError(f"offsets must be numbers: {text!r}") from None
    return Trajectory(parts[0], label, color, x, y)


def read_trajectory(spark: SparkSession, spec: Trajectory, x: str = "pos_x_m", y: str = "pos_y_m") -> DataFrame:
    """label, color, x_m, y_m; a value that is no finite number fails the job, as does a file without rows."""
    rows = spark.read.csv(spec.path, header=True)
    if lacking := [c for c in (x, y) if c not in rows.columns]:
        raise ValueError(f"{spec.path} lacks the columns {', '.join(lacking)}")
    if rows.isEmpty():
        raise ValueError(f"{spec.path} has no rows")

    def number(name: str, offset: float):
        value = F.col(f"`{name}`").try_cast("double")
        good = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
        return F.when(good, value + F.lit(offset)).otherwise(F.raise_error(f"{name} holds a value that is no finite number").cast("double"))

    label = spec.label or spec.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return rows.select(F.lit(label).alias("label"), F.lit(spec.color).cast("string").alias("color"), number(x, spec.x_offset).alias("x_m"), number(y, spec.y_offset).alias("y_m"))

"""The NULL policy: a missing, NaN or infinite number is NULL; comparisons with NULL are false; x / 0 is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """``x`` as a double, NULL where it is NaN or infinite."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(col(a), col(b))


def clip(x: Column | str, low: float, high: float) -> Column:
    """``x`` within [low, high]; NULL stays NULL (``greatest`` and ``least`` alone would skip it)."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(x, F.lit(float(high)))))


def where(condition: Column, value: Column, other: float = 0.0) -> Column:
    """``value`` where the condition is true, else ``other``: an unknown condition counts as false."""
    return F.when(condition, value).otherwise(F.lit(float(other)))


def unless_zero(x: Column | str, value: Column) -> Column:
    """``value`` unless ``x`` is 0 (then 0). A NULL ``x`` is not zero, so ``value`` decides."""
    return F.when(~col(x).eqNullSafe(F.lit(0.0)), value).otherwise(F.lit(0.0))


def finite_columns(df: DataFrame) -> DataFrame:
    """All float and double columns made finite in one projection."""
    kinds = dict(df.dtypes)
    return df.select(*[finite(F.col(f"`{c}`")).alias(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns])

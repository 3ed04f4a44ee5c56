"""Small text rules of reports and folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "--"


def folder_date(name: Column) -> Column:
    """dd.mm.yyyy in the part of a folder's name before the first underscore; ``--`` if none is there."""
    found = F.regexp_extract(F.split_part(name, F.lit("_"), F.lit(1)), r"\d{2}\.\d{2}\.\d{4}", 0)
    return F.when(found != "", found).otherwise(F.lit(NONE))


def folder_time(name: Column) -> Column:
    """hh:mm of hh.mm.ss in the part after the first underscore; ``--`` if none is there."""
    found = F.regexp_extract(F.split_part(name, F.lit("_"), F.lit(2)), r"(\d{2})\.(\d{2})\.\d{2}", 0)
    return F.when(found != "", F.replace(F.left(found, F.lit(5)), F.lit("."), F.lit(":"))).otherwise(F.lit(NONE))


def session_of_day(time: Column) -> Column:
    """Morning, Noon, Evening or Night of hh:mm; ``--`` before six and for no time."""
    hour = F.replace(time, F.lit(":"), F.lit(".")).try_cast("double")
    return (
        F.when((hour >= 6) & (hour < 12), "Morning").when((hour >= 12) & (hour < 15), "Noon").when((hour >= 15) & (hour < 18), "Evening")
        .when((hour >= 18) & (hour < 24), "Night").otherwise(NONE)
    )

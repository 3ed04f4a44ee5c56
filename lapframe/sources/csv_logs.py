"""CSV logs: a header row, commas or tabs, columns that differ from file to file."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapframe.functions.nulls import finite
from lapframe.sources.files import natural_key, numbered, open_file, run_name


#: A header with tabs and commas is split at both.
BOTH = "[\t,]"
MOST_BROADCAST_FILES, MOST_HEAD_TASKS = 100_000, 1_000


_HEAD_BYTES = 1 << 16


def heads(spark: SparkSession, paths: list[str]) -> dict[str, str | None]:
    """The first line of each file, None for an empty one. One job opens the files and reads up to the first line's end."""

    def first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path in batch["path"]:
                with open_file(path) as f:
                    raw, size = b"", f.size()
                    while b"\n" not in raw and len(raw) < size:
                        raw += f.read_at(min(_HEAD_BYTES, size - len(raw)), len(raw))
                found.append(raw.split(b"\n")[0].decode("utf-8-sig", "replace").rstrip("\r") if raw else None)
            yield pd.DataFrame({"path": list(batch["path"]), "head": pd.Series(found, dtype=object)})

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), MOST_HEAD_TASKS)))
    return {r["path"]: r["head"] for r in listed.mapInPandas(first_lines, "path string, head string").collect()}  # a line per file


def _columns(head: str) -> tuple[str, tuple[str, ...]]:
    """(separator, columns) of a header. One with tabs and commas is split at both."""
    seps = [x for x in "\t," if x in head] or [","]
    sep = seps[0] if len(seps) == 1 else BOTH
    return sep, tuple(c.strip().strip('"') for c in re.split(sep, head))


def header_problems(found: dict[str, str | None]) -> dict[str, str]:
    """Files whose header names no columns, or one twice."""
    out = {}
    for path, head in found.items():
        columns = [c for c in _columns(head)[1] if c] if head else []
        if not columns:
            out[path] = "no header"
        elif len({c.lower() for c in columns}) < len(columns):
            out[path] = "a column occurs twice"
    return out


def headers(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[tuple[str, str]]]:
    """Files (path, separator) by their columns."""
    found = heads(spark, paths)
    if bad := header_problems(found):
        raise ValueError("; ".join(f"{path}: {problem}" for path, problem in sorted(bad.items())))
    out: dict[tuple[str, ...], list[tuple[str, str]]] = {}
    for path, head in found.items():
        sep, columns = _columns(head)
        out.setdefault(columns, []).append((path, sep))
    return out


def _rows(spark: SparkSession, paths: list[str], sep: str, columns: list[str]) -> DataFrame:
    """path, block, no and ``row``, a struct of the columns' texts."""
    if sep == BOTH:
        lines = spark.read.text(paths)
        parts = F.split("value", BOTH, -1)
        row = F.struct(*[F.nullif(F.trim(F.get(parts, F.lit(k))), F.lit("")).alias(c) for k, c in enumerate(columns)])
    else:
        lines = spark.read.csv(paths, sep=sep, header=True, schema=", ".join(f"`{c}` string" for c in columns), enforceSchema=True)
        row = F.struct(*[F.col(f"`{c}`") for c in columns])
    return lines.select(row.alias("row"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"))


def read_wide(spark: SparkSession, paths: list[str]) -> DataFrame:
    """run_id, seq (place in the file, from 0) and all columns of all files.

    Columns without any value are left out. A column is a number column if any of its values is a number (its other
    values are NULL), else it stays text.
    """
    parts = []
    for columns, files in headers(spark, paths).items():
        names = [c or f"_c{k}" for k, c in enumerate(columns)]
        for sep in sorted({s for _, s in files}):
            placed = numbered(_rows(spark, [p for p, s in files if s == sep], sep, names))
            if sep == BOTH:  # its header is still there
                placed = placed.where("place > 0").withColumn("place", F.col("place") - 1)
            parts.append(placed.select(run_name(F.col("path")).alias("run_id"), F.col("place").alias("seq"), *[F.col(f"row.`{c}`").alias(c) for c in names]))
    return typed_columns(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def typed_columns(df: DataFrame) -> DataFrame:
    """run_id, seq and the columns with a value somewhere, as numbers or text; one aggregate over all columns decides."""
    columns = [c for c in df.columns if c not in ("run_id", "seq")]
    number = {c: finite(F.col(f"`{c}`").try_cast("double")) for c in columns}
    text = {c: F.nullif(F.lower(F.trim(F.col(f"`{c}`"))), F.lit("nan")) for c in columns}
    found = df.agg(*[F.count(number[c]).alias(f"n{k}") for k, c in enumerate(columns)], *[F.count(F.nullif(text[c], F.lit(""))).alias(f"t{k}") for k, c in enumerate(columns)]).first()
    kept = [number[c].alias(c) if found[f"n{k}"] else F.col(f"`{c}`") for k, c in enumerate(columns) if found[f"n{k}"] or found[f"t{k}"]]
    return df.select("run_id", "seq", *kept)


def read_long(spark: SparkSession, paths: list[str], time: str = "time_s") -> DataFrame:
    """run_id, seq, time_s, channel, value of the number columns."""
    wide = read_wide(spark, paths)
    channels = [c for c, kind in wide.dtypes if c not in ("run_id", "seq", time) and kind == "double"]
    clock = F.col(f"`{time}`") if time in wide.columns else F.lit(None).cast("double")
    if not channels:
        return wide.select("run_id", "seq", clock.alias("time_s"), F.lit(None).cast("string").alias("channel"), F.lit(None).cast("double").alias("value")).where("false")
    values = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"`{c}`").alias("value")) for c in channels])
    return wide.select("run_id", "seq", clock.alias("time_s"), F.explode(values).alias("v")).select("run_id", "seq", "time_s", "v.*").where("value is not null")


def read_laps(spark: SparkSession, folder: str) -> DataFrame:
    """run_id, n_lap, seq and the columns of the lap files (CSV) in ``folder``/laps, for the report.

    Files are numbered from 1 in natural order; a file without rows keeps its number and gives no lap. ``time_s`` begins
    at 0 in each lap. The validity of laps is a matter of :func:`lapframe.operators.laps.valid_laps`.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(f"{folder.rstrip('/')}/laps").select("path").withColumn("name", F.element_at(F.split("path", "/"), -1))
    paths = [r["path"] for r in found.orderBy(natural_key(F.col("name")), "name").collect()]  # names alone
    if not paths:
        raise FileNotFoundError(f"no lap files in {folder}/laps")
    stems = [p.rsplit("/", 1)[-1].removesuffix(".csv") for p in paths]
    numbers = spark.createDataFrame([(x, k) for k, x in enumerate(stems, 1)], "__stem string, n_lap int")
    rows = read_wide(spark, paths).withColumnRenamed("run_id", "__stem").join(F.broadcast(numbers) if len(paths) < MOST_BROADCAST_FILES else numbers, "__stem")
    columns = [c for c in rows.columns if c not in ("__stem", "n_lap", "seq", "time_s")]
    first = F.min_by("time_s", "seq").over(Window.partitionBy("n_lap"))
    time = [(F.col("time_s") - first).alias("time_s")] if "time_s" in rows.columns else []
    return rows.select(F.lit(folder.rstrip("/").rsplit("/", 1)[-1]).alias("run_id"), "n_lap", "seq", *time, *[F.col(f"`{c}`") for c in columns])

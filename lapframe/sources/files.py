"""Finding log files and reading each by its kind into the long table (run_id, seq, time_s, channel, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The kinds of logs by suffix.
KINDS = {".csv": "csv", ".mat": "mat", ".mcap": "mcap", ".log": "candump", ".candump": "candump"}


def open_file(path: str):
    from pyarrow import fs

    if "://" not in path:
        path = path.removeprefix("file:")
        return fs.LocalFileSystem().open_input_file(path)
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def natural_key(name: Column) -> Column:
    """A key under which numbers inside names sort by value."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """run_id (the file's name without its suffix), path, kind, natural_key of the logs in a folder; contents are not read."""
    found = spark.read.format("binaryFile").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    kind = F.coalesce(*[F.when(suffix == s, F.lit(k)) for s, k in KINDS.items()])
    named = found.select(F.regexp_replace(name, r"\.[^.]+$", "").alias("run_id"), "path", kind.alias("kind"), natural_key(name).alias("natural_key"))
    return named.where("kind is not null")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place``, from 0: their place in their file, from path, block (where the row's split begins) and no (rising in a split).

    Rows are counted inside their split; only the splits' sizes are summed up, a few numbers for each file.
    """
    sizes = rows.groupBy("path", "block").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("path", "block", before.alias("__start"))
    inside = F.row_number().over(Window.partitionBy("path", "block").orderBy("no"))
    return rows.withColumn("__in", inside).join(starts, ["path", "block"]).withColumn("place", (F.col("__start") + F.col("__in") - 1).cast("long")).drop("__in", "__start")


def _whole_files(got: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the files without a problem, problems): a file that fails midway is left out as a whole."""
    problems = got.where("problem is not null").select("path", "problem")
    return got.where("problem is null").join(problems.select("path").distinct(), "path", "left_anti"), problems


def read_folder(spark: SparkSession, folder: str, topics: list[str] | None = None, definitions: str | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(long table of all readable logs or None, table of files with a problem).

    A file that can't be read is left out as a whole, whatever its kind, and the others are read. CAN logs need
    ``definitions``; without them they are files with a problem.
    """
    from lapframe.sources import candump, csv_logs, mat, mcap

    files = discover(spark, folder).orderBy("natural_key").collect()  # names alone
    by_kind: dict[str, list[str]] = {}
    for f in files:
        by_kind.setdefault(f["kind"], []).append(f["path"])
    parts, problems = [], []
    told = lambda rows: spark.createDataFrame(rows, "path string, problem string")
    if paths := by_kind.get("csv"):
        bad = csv_logs.header_problems(csv_logs.heads(spark, paths))
        problems.append(told(sorted(bad.items())))
        if good := [p for p in paths if p not in bad]:
            parts.append(csv_logs.read_long(spark, good))
    if paths := by_kind.get("mat"):
        good, bad = _whole_files(mat.read_mat(spark, paths))
        parts.append(good)
        problems.append(bad)
    if paths := by_kind.get("mcap"):
        mcap.register(spark)
        good, bad = _whole_files(mcap.read_mcap(spark, paths, topics))
        in_order = Window.partitionBy("path").orderBy("log_time_ns", "chunk_offset", "message_offset", "channel")
        parts.append(good.withColumn("seq", (F.row_number().over(in_order) - 1).cast("long")))
        problems.append(bad)
    if paths := by_kind.get("candump"):
        if definitions:
            bad = candump.problems(spark, paths, definitions)
            parts.append(candump.read_long(spark, paths, definitions, without=bad))
            problems.append(bad.select("path", "problem"))
        else:
            problems.append(told([(p, "a CAN log needs definitions") for p in paths]))
    found = told([])
    for p in problems:
        found = found.unionByName(p)
    whole = None
    for p in parts:
        p = p.select("run_id", "seq", "time_s", "channel", "value")
        whole = p if whole is None else whole.unionByName(p)
    return whole, found


def run_name(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")

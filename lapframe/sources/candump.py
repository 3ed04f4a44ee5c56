"""CAN logs as text lines. A last line without its line end may be half written, and is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapframe.operators.can import changed_frames, decode_long, frames_of, known_frames, known_problems, last_times, parse_lines, read_definitions
from lapframe.session import materialize
from lapframe.sources.files import numbered, run_name


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """run_id, line_no (from 1), line of each terminated line.

    The text source splits large files but hides line ends. A custom separator of "\\n" keeps a
    carriage return in the line; whether a file ends in one is read from its last byte alone.
    """
    paths = [paths] if isinstance(paths, str) else paths
    rows = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("no"),
    )
    # all bytes of a file are its lines and their ends: one byte less means the last line has no end
    sums = rows.groupBy("path").agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    placed = numbered(rows.select("path", "block", "no", "value")).select("path", "value", (F.col("place") + 1).alias("line_no")).join(sums, "path")
    # the text itself depends on the test, so that no check of a line can run before it
    whole = (F.col("line_no") < F.col("n")) | (F.col("bytes") <= F.col("size"))
    return placed.select(run_name(F.col("path")).alias("run_id"), "line_no", F.when(whole, F.regexp_replace("value", "\r$", "")).alias("line")).where("line is not null")


def read_frames(spark: SparkSession, paths: list[str] | str, strict: bool = True) -> DataFrame:
    """The frames of CAN logs; with ``strict`` a malformed line fails the job with its number."""
    return frames_of(read_lines(spark, paths), strict)


def problems(spark: SparkSession, paths: list[str], definitions: str) -> DataFrame:
    """run_id, path, problem of the logs that :func:`read_long` would fail on: the first malformed line, decoded frame without a time or payload that is too short."""
    lines = read_lines(spark, paths)
    parsed = parse_lines(lines.where(F.trim("line") != "")).select("run_id", "line_no", "ts", "can_id", "is_extended", "data", "problem")
    bad = known_problems(parsed, read_definitions(definitions)).groupBy("run_id").agg(F.min_by(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), F.col("problem")), "line_no").alias("problem"))
    names = spark.createDataFrame([(p,) for p in paths], "path string").select("path", run_name(F.col("path")).alias("run_id"))
    return materialize(bad.join(names, "run_id").select("run_id", "path", "problem"), "candump-problems")


def read_long(spark: SparkSession, paths: list[str] | str, definitions: str, keep_repeated: bool = False, without: DataFrame | None = None) -> DataFrame:
    """run_id, seq, time_s, channel, value of the signals that change (all of them with ``keep_repeated``).

    The runs of ``without`` (run_id) are left out.

    Every frame that is decoded must have a time. Where a run's last frames repeat what came before, a row with the
    last time alone (its channel and value are NULL) keeps the run's length.
    """
    messages = read_definitions(definitions)
    lines = read_lines(spark, paths)
    frames = known_frames(frames_of(lines if without is None else lines.join(without.select("run_id"), "run_id", "left_anti")), messages)
    told = F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": a decoded frame needs a time"))
    frames = frames.withColumn("ts", F.when(F.col("ts").isNull(), F.raise_error(told).cast("double")).otherwise(F.col("ts")))
    fresh = frames if keep_repeated else changed_frames(frames)
    decoded = decode_long(fresh, messages)
    channel = F.concat_ws(".", "message", "signal")
    rows = decoded.select("run_id", F.col("line_no").cast("long").alias("seq"), F.col("ts").alias("time_s"), channel.alias("channel"), "value")
    if keep_repeated:
        return rows
    kept = last_times(fresh).select("run_id", F.col("ts").alias("kept"))
    ends = last_times(frames).join(frames.groupBy("run_id").agg(F.max("line_no").cast("long").alias("seq")), "run_id").join(kept, "run_id")
    return rows.unionByName(ends.where("ts > kept").select("run_id", "seq", F.col("ts").alias("time_s"), F.lit(None).cast("string").alias("channel"), F.lit(None).cast("double").alias("value")))

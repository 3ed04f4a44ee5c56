"""Writing runs, laps and fingerprints.

Files with names of their own are written by :class:`NamedFiles`, a data source whose tasks write
below a folder of their attempt; the names appear in the end, all files of a job together. A
job that fails, or a task that is repeated, leaves nothing behind.
"""

from __future__ import annotations

import csv
import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lapframe.functions.series import RUN, SEQ
from lapframe.operators.laps import lap_table, trimmed_laps

MODES = {"error": "errorifexists", "overwrite": "overwrite"}


def write_runs(df: DataFrame, path: str, mode: str = "error", fmt: str = "parquet", run: str = RUN) -> None:
    """One folder per run; nothing is overwritten unless ``mode`` says so."""
    df = decimals(df) if fmt == "csv" else df
    df.repartition(run).sortWithinPartitions(run, SEQ).write.mode(MODES[mode]).partitionBy(run).options(**({"header": "true"} if fmt == "csv" else {})).format(fmt).save(path)


def write_laps(df: DataFrame, path: str, mode: str = "error", fmt: str = "parquet", run: str = RUN) -> None:
    """One folder per run and lap, without the lap's first and last row; ``lap_time_s`` stands in each row."""
    times = lap_table(df, run).select(run, "n_lap", "lap_time_s")
    laps = trimmed_laps(df, run).join(times, [run, "n_lap"])
    laps = decimals(laps) if fmt == "csv" else laps
    laps.repartition(run, "n_lap").sortWithinPartitions(run, "n_lap", SEQ).write.mode(MODES[mode]).partitionBy(run, "n_lap").options(**({"header": "true"} if fmt == "csv" else {})).format(fmt).save(path)


@dataclass
class Written(WriterCommitMessage):
    """(where a task has put a file, its name)."""

    files: list[tuple[str, str]]


def _file_system(path: str):
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file://")


class NamedFilesWriter(DataSourceWriter):
    """CSV files named by the first column; rows of a file follow each other in one task."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.job = path, columns, f"_job-{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = _file_system(self.path)
        task = TaskContext.get()
        own = f"{root}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        files, name, out, text, lines = [], None, None, io.StringIO(), None
        for row in iterator:
            if row[0] != name:
                if out is not None:
                    out.write(text.getvalue().encode())
                    out.close()
                name, text = row[0], io.StringIO()
                system.create_dir(own, recursive=True)
                files.append((f"{own}/{len(files)}.csv", name))
                out = system.open_output_stream(files[-1][0])
                lines = csv.writer(text, lineterminator="\n", escapechar="\\")
                lines.writerow(self.columns)
            lines.writerow([f"{x:.16f}" if isinstance(x, float) else x for x in row[1:]])
            if text.tell() > 1 << 20:
                out.write(text.getvalue().encode())
                text.seek(0)
                text.truncate()
        if out is not None:
            out.write(text.getvalue().encode())
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _file_system(self.path)
        for m in messages:
            for held, name in m.files if m else ():
                system.move(held, f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, root = _file_system(self.path)
        if system.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.job}")


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], schema.names[1:])


def fresh_folder(path: str, overwrite: bool = False) -> None:
    """An empty folder at ``path``; a symbolic link is refused, and what is there goes only with ``overwrite``."""
    from pyarrow import fs

    system, root = _file_system(path)
    if isinstance(system, fs.LocalFileSystem) and os.path.islink(root.rstrip("/")):
        raise ValueError(f"{root} is a symbolic link")
    if system.get_file_info(root).type != fs.FileType.NotFound:
        if not overwrite:
            raise FileExistsError(root)
        system.delete_dir(root)
    system.create_dir(root, recursive=True)


def _write_named(df: DataFrame, columns: list[str], path: str, overwrite: bool) -> None:
    """``columns`` of ``df`` into the files that its column __file names."""
    df.sparkSession.dataSource.register(NamedFiles)
    fresh_folder(path, overwrite)
    placed = df.withColumn("__file", F.regexp_replace("__file", r"[/\\]", "_")).repartition("__file").sortWithinPartitions("__file", SEQ)
    placed.select("__file", *[F.col(f"`{c}`") for c in columns]).write.format("named_files").mode("append").option("path", path).save()


def write_run_files(df: DataFrame, path: str, overwrite: bool = False, run: str = RUN) -> None:
    """One CSV file per run, named by it, in a fresh folder."""
    _write_named(df.withColumn("__file", F.concat(F.col(run).cast("string"), F.lit(".csv"))), df.columns, path, overwrite)


def write_lap_files(df: DataFrame, path: str, overwrite: bool = False, run: str = RUN) -> None:
    """One CSV file per run and lap in a fresh folder, named by run, lap and lap time; a lap of more than two rows without its first and last one."""
    name = F.concat(F.col(run).cast("string"), F.lit("_lap_"), F.col("n_lap").cast("string"), F.lit("_"), F.col("lap_time_s").cast("string"), F.lit("s.csv"))
    names = lap_table(df, run).select(run, "n_lap", name.alias("__file"))
    _write_named(trimmed_laps(df, run).join(names, [run, "n_lap"]), df.columns, path, overwrite)


def decimals(df: DataFrame) -> DataFrame:
    """Doubles as text with 16 decimals."""
    kinds = dict(df.dtypes)
    return df.select(*[F.when(F.col(f"`{c}`").isNotNull(), F.format_string("%.16f", F.col(f"`{c}`"))).alias(c) if kinds[c] == "double" else F.col(f"`{c}`") for c in df.columns])


def fingerprints(df: DataFrame, run: str = RUN, seq: str = SEQ) -> DataFrame:
    """run_id, n_rows, sha256: changes with any value, missing value, column name, order of columns or order of rows.

    Rows are hashed with their place, so the digests add up in any order and no run is gathered in one task.
    """
    names = F.lit("|".join(f"{c}:{k}" for c, k in df.dtypes))
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)") for k in range(4)]
    sums = df.select(run, *[p.alias(f"p{k}") for k, p in enumerate(parts)]).groupBy(run).agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(f"p{k}").alias(f"s{k}") for k in range(4)])
    return sums.select(run, "n_rows", F.sha2(F.concat_ws("|", names, *[F.col(f"s{k}").cast("string") for k in range(4)]), 256).alias("sha256"))

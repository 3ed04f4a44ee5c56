"""Session defaults and the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "lapframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; an existing session is reused unchanged."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where the setting is absent (tests and other single-machine sessions) a
    folder below the local temp folder is made once and used for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("lapframe.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster can reach")
        found = "file://" + tempfile.mkdtemp(prefix="lapframe-shared-")
        spark.conf.set("lapframe.shared.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; no two calls give the same one."""
    return f"{shared_dir(spark)}/{name}-{os.getpid()}-{uuid.uuid4().hex[:12]}"


METHOD_LIMIT, METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit", 8000


def small_methods(spark: SparkSession) -> None:
    """For long chains of expressions: the JVM runs methods over 8,000 bytes uncompiled, so Spark is not to generate any. Results are the same."""
    if int(spark.conf.get(METHOD_LIMIT, "65535")) > METHOD_BYTES:
        spark.conf.set(METHOD_LIMIT, str(METHOD_BYTES))


#: So many rows on average go to one task where :func:`dealt` deals them.
TASK_ROWS = 250_000


def dealt(df: DataFrame, *keys: str, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt by ``keys``, about ``rows`` rows to a partition, so that what a task sorts does not grow with the input.

    The rows are counted first. So few that all cores have less than that each stay as they are.
    """
    n = -(-df.count() // rows)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`materialize` writes inside are removed at the end; what is to stay is written with ``keep``."""
    own: list[str] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        for path in own:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder in any file system that Spark reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    if _scopes and not keep:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

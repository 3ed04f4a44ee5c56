"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch of new
documents is reduced to one row per digest before anything is joined (so a
group of copies of any size is one row), the rows whose digest the index lacks
are found by a sort-merge anti-join on the bucketed side and appended. The
decisions are then read by joining the batch with what the index holds.

The number of buckets is kept beside the rows, in the file ``_layout``, with the
folder that holds them. An index is opened with the number it was made with, whatever
today's shuffle width; another one is refused. Each batch adds a file to every bucket;
beyond ``most_files`` of them the index is written anew into the next folder, sorted, one file per
bucket, before the batch is added. ``_layout`` changes last, so a job cut off midway
leaves the old folder in force.

Defined cases: a null text is the empty text; texts are equal when identical
after lower-casing A-Z only. Of the equal texts in a batch the largest doc_id
stays, unless an earlier batch already brought that text: then none does. A
null doc_id ranks below all others. Rows repeated with the same doc_id and text
yield one result row each, of which one may be kept. Columns besides doc_id and
text are not read, so their names can't clash. An empty batch gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapframe.llm.common import ascii_lower, packed, shuffle_width, text_of
from lapframe.session import materialize, remove, shared_path

_COLUMNS = "digest STRING, keep_id BIGINT, batch STRING"


def digest_of(col: str = "text") -> Column:
    return F.sha2(ascii_lower(text_of(col)), 256)


class DigestIndex:
    """A digest index in ``path``; an existing one is opened, else an empty one is made. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, most_files: int = 16):
        self.spark, self.path, self.most_files = spark, path, most_files
        stored = self._layout()
        if stored is None:
            stored = (buckets or max(8, shuffle_width(spark)), 0)
            self._keep(*stored)
        self.buckets, self.folder = stored
        if buckets not in (None, self.buckets):
            raise ValueError(f"the index in {path} has {self.buckets} buckets, not {buckets}")
        self._open()

    def _file(self, name: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def _layout(self) -> tuple[int, int] | None:
        """(buckets, number of the folder in force) of the index that is there."""
        fs, file = self._file("_layout")
        if not fs.exists(file):
            return None
        stream = fs.open(file)
        try:
            return stream.readInt(), stream.readInt()
        finally:
            stream.close()

    def _keep(self, buckets: int, folder: int) -> None:
        fs, file = self._file("_layout")
        stream = fs.create(file, True)
        stream.writeInt(buckets)
        stream.writeInt(folder)
        stream.close()

    def _open(self) -> None:
        self.location = f"{self.path}/rows-{self.folder}"
        self.name = "digest_index_" + hashlib.md5(self.location.encode()).hexdigest()[:16]
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({_COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}'"
        )
        self.spark.catalog.refreshTable(self.name)

    def drop(self) -> None:
        """Remove the index with its files."""
        self.spark.sql(f"DROP TABLE {self.name}")
        remove(self.spark, self.path)

    def _append(self, rows: DataFrame, name: str, location: str) -> None:
        (
            rows.repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").option("path", location)
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name)
        )

    def compact(self) -> None:
        """One sorted file per bucket, in the next folder."""
        # read by path: a bucketed table that is dealt out by its own buckets would not be dealt out at all
        old_name, old_location, old = self.name, self.location, self.spark.read.schema(_COLUMNS).parquet(self.location)
        self.folder += 1
        remove(self.spark, f"{self.path}/rows-{self.folder}")  # what a job that was cut off has left
        self._open()
        self._append(old, self.name, self.location)
        self._keep(self.buckets, self.folder)
        self.spark.catalog.refreshTable(self.name)
        self.spark.sql(f"DROP TABLE {old_name}")
        remove(self.spark, old_location)

    def _files(self) -> int:
        fs, folder = self._file(f"rows-{self.folder}")
        return fs.getContentSummary(folder).getFileCount() if fs.exists(folder) else 0

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, batch: str) -> DataFrame:
        """Append what is new in ``docs`` as ``batch`` and return the decisions.

        Returns doc_id, keep_id, group_size, kept, text_sha256. A batch that is
        run again finds its digests present with its own name and gives the same
        decisions, so a job that was cut off after the append can be repeated.
        """
        keyed = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of().alias("digest"), F.monotonically_increasing_id().alias("no")), "digests")
        largest = F.max(F.struct("doc_id", "no"))
        groups = keyed.groupBy("digest").agg(largest.alias("x"), F.count(F.lit(1)).alias("group_size")).select("digest", F.col("x.doc_id").alias("keep_id"), F.col("x.no").alias("keep_no"), "group_size")
        if self._files() >= self.most_files * self.buckets:
            self.compact()
        fresh = groups.join(self.rows().hint("merge"), "digest", "left_anti")
        self._append(fresh.select("digest", "keep_id", F.lit(batch).alias("batch")), self.name, self.location)
        self.spark.catalog.refreshTable(self.name)
        return self.decide(keyed, groups, batch)

    def decide(self, keyed: DataFrame, groups: DataFrame, batch: str) -> DataFrame:
        # one row per digest on either side: the index is read by its buckets, and only the batch's digests move
        known = self.rows().withColumnRenamed("keep_id", "first_id")
        verdict = materialize(groups.drop("keep_id").join(known.hint("merge"), "digest"), "verdicts")
        # rows meet their verdict by a plain join, which Spark can split for a hot digest
        out = keyed.join(verdict, "digest")
        stays = (F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("no") == F.col("keep_no"))
        return out.select("doc_id", F.col("first_id").alias("keep_id"), "group_size", stays.alias("kept"), F.col("digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str = "batch-0") -> DataFrame:
    """Decisions for ``docs`` as one batch; without ``index`` a new one is made in the shared folder."""
    if index is not None:
        return index.add(docs, batch)
    own = DigestIndex(docs.sparkSession, shared_path(docs.sparkSession, "digest-index"))
    try:
        return own.add(docs, batch)
    finally:  # the decisions are in tables of their own
        own.drop()


def drop_exact_copies(docs: DataFrame, index: DigestIndex | None = None, batch: str = "batch-0") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows repeated with one doc_id and text, one."""
    kept = exact_dedup(docs, index, batch).where("kept").select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_digest"))
    keyed = packed(docs, id=F.col("doc_id").cast("long"), digest=digest_of())
    stays = keyed.join(kept, keyed["id"].eqNullSafe(kept["keep_id"]) & (keyed["digest"] == kept["keep_digest"]), "left_semi")
    return stays.dropDuplicates(["id", "digest"]).select("row.*")

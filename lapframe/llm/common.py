"""What the operators of this subpackage share: word rule, column safety, table access."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, and what counts as a word.
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """Each row as one struct ``row``, beside ``keys`` computed from it: no column of the table can clash with theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[k.alias(name) for name, k in keys.items()])


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; an empty or blank text gives an empty array."""
    return F.array_remove(F.split(text, SPACE_RE), "")


def word_count(text: Column) -> Column:
    """Number of words without building their strings twice: breaks between words plus one."""
    return F.size(words_of(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A pure ASCII text takes the fast built-in; others are translated."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def id_crc(doc_id: int | None) -> int:
    """crc32 of doc_id written as text (null: of the empty text)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def uniform(*cols: Column) -> Column:
    """A number in (0, 1) that depends on the columns alone: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

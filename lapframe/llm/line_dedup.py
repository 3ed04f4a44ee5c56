"""Line dedup by a deletion-neighbourhood join, within one edit.

A line is dropped if an earlier line (by doc_id, then place) of any document is
the same or one character edit away. ``least`` (1, so none) leaves lines of fewer
characters out of near matches.

Emitting the deletions of every character of every line would cost the square of
a line's length, so the deleted place is narrowed in steps that lose nothing. Two
lines one edit apart are equal outside a half that holds the edit (a longer
line's half has one more character), so both emit the hash of the other half as a
key. Only keys that two different lines share go on: the half is cut into
``PARTS`` blocks, each block's surroundings are the next keys, and so on until a
block has ``LAST_BLOCK`` characters at most. Then each single character in it is
deleted. Lines that delete the same place and leave the same rest differ by a
substitution; a line that equals another's rest differs from it by a deletion.
So each group has an earliest line that all others are matched with, and no pairs
within a group are made; the match is then verified by edit distance.

Defined cases: lines end at \\n; a line without a word is kept and matches
nothing; matches are judged on the input, so a dropped line still counts as
earlier; null texts are empty; a null doc_id comes last; rows repeated with one
doc_id and text are one document (a result row each); with one doc_id and
different texts they are told apart by text. Other columns are not read; no
rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapframe.llm.common import WORD_RE, packed, text_of
from lapframe.llm.filters import may_be_among
from lapframe.session import materialize

_LAST = 2**63 - 1
PARTS, LAST_BLOCK = 32, 16


def _lines(docs: DataFrame) -> DataFrame:
    """doc, text_key, no, line, id (a digest, null for a line without a word)."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text_of()).alias("text_key"), text_of().alias("text"))
    lines = texts.select("doc", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    return lines.withColumn("id", F.when(F.col("line").rlike(WORD_RE), F.unhex(F.md5(F.encode("line", "UTF-8")))))


def _around(outer: Column, base: Column, lo: Column, hi: Column) -> Column:
    """The hash of what is around the block [lo, hi) of a line, which has ``base`` characters without the longer line's extra one."""
    before = F.when(lo > 0, F.substring("line", F.lit(1), lo)).otherwise(F.lit(""))
    return F.xxhash64(outer, base, lo, hi, before, F.when(base > hi, F.right(F.col("line"), base - hi)).otherwise(F.lit("")))


def _half_keys(lines: DataFrame) -> DataFrame:
    """lid, key, longer, lo, hi: per line as the shorter (or equal) one and as the longer one, for either half."""
    ways = []
    for longer in (False, True):
        base = F.length("line") - int(longer)
        half = F.floor(base / 2).cast("int")
        for lo, hi in ((F.lit(0), half), (half, base)):
            ways.append(F.struct(_around(F.lit(0).cast("long"), base, lo, hi).alias("key"), F.lit(longer).alias("longer"), lo.alias("lo"), hi.alias("hi")))
    return lines.select(F.xxhash64("line").alias("lid"), F.explode(F.array(*ways)).alias("k")).select("lid", "k.*")


def _shared(keys: DataFrame, name: str) -> DataFrame:
    """The keys that two different lines have."""
    pairs = keys.groupBy("key").agg(F.min("lid").alias("a"), F.max("lid").alias("b")).where("a <> b").select("key")
    return materialize(keys.join(pairs, "key", "left_semi").distinct(), name)


def _narrowed(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """Keys whose blocks have ``LAST_BLOCK`` characters at most."""
    while True:
        wide = F.col("hi") - F.col("lo") > LAST_BLOCK
        if keys.where(wide).isEmpty():
            return keys
        size = F.ceil((F.col("hi") - F.col("lo")) / PARTS).cast("int")
        blocks = F.transform(F.sequence(F.col("lo"), F.col("hi") - 1, size), lambda lo: F.struct(lo.alias("a"), F.least(lo + size, F.col("hi")).alias("b")))
        base = F.length("line") - F.col("longer").cast("int")
        cut = keys.where(wide).join(texts.select("lid", "line"), "lid").withColumn("x", F.explode(blocks))
        finer = cut.select("lid", _around(F.col("key"), base, F.col("x.a"), F.col("x.b")).alias("key"), "longer", F.col("x.a").alias("lo"), F.col("x.b").alias("hi"))
        keys = _shared(finer, "line-keys").unionByName(keys.where(~wide))
        keys = materialize(keys, "line-narrowed")


def _inner() -> Column:
    """The block's own characters, with the longer line's extra one."""
    return F.substring("line", F.col("lo") + 1, F.col("hi") - F.col("lo") + F.col("longer").cast("int"))


def near_earlier(docs: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(occurrences, verdicts): all lines without their text; and for ids of lines that occur more than once or are near an earlier one, their first occurrence and that line."""
    occurrences = materialize(_lines(docs).select("doc", "text_key", "no", "id"), "line-occurrences")
    spot = F.struct("doc", "text_key", "no")
    first = materialize(occurrences.where("id is not null").groupBy("id").agg(F.min(spot).alias("first"), F.count(F.lit(1)).alias("n")), "line-firsts")
    long_lines = _lines(docs).where(F.col("id").isNotNull() & (F.length("line") >= least)).select("id", "line")
    keys = _shared(materialize(_half_keys(long_lines), "line-halves"), "line-candidates")
    ids = keys.select("lid").distinct()
    likely = may_be_among(long_lines.withColumn("lid", F.xxhash64("line")), F.col("lid"), ids, F.col("lid"))
    # an inner join, since a semi-join would be moved below the filter
    texts = likely.join(ids, "lid").groupBy("id").agg(F.first("lid").alias("lid"), F.first("line").alias("line"))
    texts = materialize(texts.join(first.drop("n"), "id"), "line-texts")
    inner = _narrowed(keys, texts).join(texts, "lid").withColumn("inner", _inner())
    # the longer line deletes one character; the shorter one stands as it is, and deletes one for substitutions
    cut = F.transform(F.sequence(F.lit(1), F.length("inner")), lambda i: F.struct(i.alias("place"), F.xxhash64(F.concat(F.substring("inner", F.lit(1), i - 1), F.substring("inner", i + 1, F.length("inner")))).alias("rest")))
    cut = F.when(F.length("inner") > 0, cut)
    whole = F.array(F.struct(F.lit(0).alias("place"), F.xxhash64("inner").alias("rest")))
    variants = inner.select("id", "first", "key", "longer", F.explode(F.when(F.col("longer"), cut).otherwise(F.concat(whole, F.coalesce(cut, F.array().cast("array<struct<place:int,rest:bigint>>"))))).alias("v")).select("id", "first", "key", "longer", "v.place", "v.rest")
    variants = materialize(variants, "line-variants")
    earliest = F.min(F.struct("first", "id"))
    substituted = variants.where("place > 0 and not longer").groupBy("key", "place", "rest").agg(earliest.alias("e"), F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").drop("a", "b")
    by_place = variants.where("place > 0 and not longer").join(substituted, ["key", "place", "rest"]).select("id", "first", "e")
    shorter = variants.where("place = 0").select("key", "rest", F.col("id").alias("short_id"), F.col("first").alias("short_first"))
    longer = variants.where("longer").select("key", "rest", "id", "first").distinct()
    to_short = longer.join(shorter, ["key", "rest"]).select("id", "first", F.struct(F.col("short_first").alias("first"), F.col("short_id").alias("id")).alias("e"))
    to_long = longer.groupBy("key", "rest").agg(earliest.alias("e")).join(shorter, ["key", "rest"]).select(F.col("short_id").alias("id"), F.col("short_first").alias("first"), "e")
    matches = by_place.unionByName(to_short).unionByName(to_long).where("e.first < first").groupBy("id").agg(F.min("e").alias("e")).select("id", F.col("e.id").alias("earlier"))
    a, b = texts.select("id", "line"), texts.select(F.col("id").alias("earlier"), F.col("line").alias("earlier_line"))
    verified = matches.join(a, "id").join(b, "earlier").where(F.levenshtein("line", "earlier_line", 1).between(0, 1)).select("id", "earlier")
    return occurrences, first.join(verified, "id", "left").where("n > 1 or earlier is not null").select("id", "first", "earlier")


def _dropped(docs: DataFrame, least: int) -> DataFrame:
    """doc, text_key, rows, places, dropped_lines: one row per document."""
    occurrences, verdicts = near_earlier(docs, least)
    judged = occurrences.join(verdicts, "id", "left")
    # a line without a verdict occurs once and is near no earlier one
    stays = F.col("first").isNull() | (F.struct("doc", "text_key", "no").eqNullSafe(F.col("first")) & F.col("earlier").isNull())
    return judged.groupBy("doc", "text_key").agg(
        F.collect_set("no").alias("places"), F.sort_array(F.collect_set(F.when(~stays, F.col("no")))).alias("dropped_lines"), F.sum((F.col("no") == 0).cast("int")).cast("int").alias("rows"),
    )


def dedup_lines(docs: DataFrame, least: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped_lines (places from 0, ascending) for every row."""
    doc_id = F.when(F.col("doc") != _LAST, F.col("doc"))
    out = _dropped(docs, least).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return out.select(doc_id.alias("doc_id"), F.size("places").cast("long").alias("n_lines"), F.size("dropped_lines").cast("long").alias("n_dropped"), "dropped_lines")


def drop_lines(docs: DataFrame, least: int = 1) -> DataFrame:
    """``docs`` with the dropped lines taken out of their texts; a text without lines left is empty, a null text stays null."""
    found = _dropped(docs, least).where(F.size("dropped_lines") > 0).select(F.col("doc").alias("at"), F.col("text_key").alias("at_key"), "dropped_lines")
    rows = packed(docs, doc=F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), text_key=F.xxhash64(text_of()))
    joined = rows.join(found, (F.col("doc") == F.col("at")) & (F.col("text_key") == F.col("at_key")), "left")
    kept = F.filter(F.split("row.text", "\n", -1), lambda line, no: ~F.array_contains("dropped_lines", no))
    text = F.when(F.col("dropped_lines").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])

"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source's target is its share by weight of all words, stopped at ``cap``
times what it has (the excess is shared anew by weight). A source is taken in
whole epochs first; the rest of its target is a weighted sample without
replacement: documents by exponential key -ln(u) / quality, smallest first, up
to the word budget. u depends on doc_id alone (on the text where it is null), so reruns agree.

No source is sorted as a whole. Keys fall into ``bins`` bins of equal mass;
word sums per source and bin show the one bin in which the budget ends, and
only that bin's documents are ordered and prefix-summed. So a source with a
third of all rows puts about 1/bins of them into one task.

Defined cases: a null or blank text has size 0; null is a source of its own,
last in order; rows repeated with one doc_id share a key and are ordered by
size; other columns are not read; no rows give
no rows; a source without words has target 0 and takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapframe.llm.common import text_of, uniform, words_of
from lapframe.session import materialize

CAP = 3.0
WEIGHTS = (1.0, 2.0, 3.0)


def quality_weight(text: Column) -> Column:
    """Between 0.5 and 1: half plus half the share of letters among the characters that are no white space."""
    solid = F.length(F.regexp_replace(text, r"\s+", ""))
    odd = F.length(F.regexp_replace(text, r"[\p{L}\s]+", ""))
    return F.when(solid > 0, 1.0 - 0.5 * odd / solid).otherwise(F.lit(0.5))


def source_targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``totals`` (source, source_size) with ``target``.

    The water level: sources in order of cap / weight are full one after the
    other; the first that is not full fixes the level for the rest. There is
    one row per source here, and no more.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    own = totals.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    from_top = Window.orderBy((F.col("most") / F.col("weight")).desc(), F.col("source").desc_nulls_first())
    full_before = F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    still_open = F.sum("weight").over(from_top.rowsBetween(Window.unboundedPreceding, 0))
    level = (F.sum("source_size").over(everything) - full_before) / still_open
    fits = own.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("most"))
    water = F.min_by("level", F.when(F.col("fits"), F.col("most") / F.col("weight"))).over(everything)
    return fits.withColumn("target", F.least(F.col("most"), F.coalesce(water, F.lit(float("inf"))) * F.col("weight"))).select("source", "source_size", "target")


def _keyed(docs: DataFrame, bins: int, seed: int, carry: bool = False) -> DataFrame:
    """doc_id, source, size, key, bin, from each row alone; with ``carry`` also the row itself, as a struct."""
    text = text_of()
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    u = uniform(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.encode(text, "UTF-8"))))
    return docs.select(
        *row, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.size(words_of(text)).cast("long").alias("size"), (-F.log(u) / quality_weight(text)).alias("key"),
    ).withColumn("bin", F.floor((1.0 - F.exp(-F.col("key") * 0.9)) * bins).cast("int"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, bins: int = 1024, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, times (whole copies to take), taken for every row."""
    keyed = materialize(_keyed(docs, bins, seed), "mix-keys")
    return _taken(keyed, keyed, weights, cap)


def _taken(keyed: DataFrame, carried: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """What the mix takes of the rows of ``carried``, whose keys are those of ``keyed``."""
    cells = materialize(keyed.groupBy("source", "bin").agg(F.sum("size").alias("words")), "mix-cells")
    targets = source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    plan = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = materialize(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-plan")
    p, c = plan.alias("p"), cells.alias("c")
    upto = F.sum("words").over(Window.partitionBy("c.source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    edges = c.join(p, F.col("c.source").eqNullSafe(F.col("p.source"))).select(F.col("c.source").alias("source"), "bin", "words", "source_size", "target", "epochs", "rest", upto.alias("upto"))
    whole, none = F.col("upto") <= F.col("rest"), F.col("upto") - F.col("words") >= F.col("rest")
    edges = edges.withColumn("part", F.when(whole, "whole").when(none, "none").otherwise("edge")).withColumn("room", F.col("rest") - (F.col("upto") - F.col("words")))
    edges = edges.withColumnRenamed("source", "__source").withColumnRenamed("bin", "__bin")
    rows = carried.join(edges, F.col("source").eqNullSafe(F.col("__source")) & (F.col("bin") == F.col("__bin")))
    narrow = [c for c in carried.columns if c not in ("key", "bin")] + ["source_size", "target", "epochs"]
    settled = rows.where("part <> 'edge'").select(*narrow, F.when(F.col("part") == "whole", 1).otherwise(0).alias("extra"))
    at_edge = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    mid = F.sum("size").over(at_edge) - F.col("size") / 2
    edge = rows.where("part = 'edge'").select(*narrow, F.when(mid <= F.col("room"), 1).otherwise(0).alias("extra"))
    times = (F.col("epochs") + F.col("extra")).cast("long")
    return settled.unionByName(edge).select(*narrow[:-1], times.alias("times"), (F.col("size") * times).alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, bins: int = 1024, seed: int = 7) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes this very row: the row rides along to where that is decided."""
    keyed = materialize(_keyed(docs, bins, seed), "mix-keys")
    taken = _taken(keyed, _keyed(docs, bins, seed, carry=True), weights, cap).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")

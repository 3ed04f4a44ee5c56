"""Quality rules with risk-controlled thresholds.

Five rules each give a document a ratio in [0, 1], high meaning bad; a document that
exceeds the cutoff of any rule is rejected. Labelled good documents (quality 1) are
the holdout, of which a digest of doc_id gives a quarter to propose and the rest to
test. The quarter of a stratum (language) proposes: per rule the ``TOP`` quantile of its
ratios, times the factors of ``STEPS`` from lenient to strict, makes a path of cutoffs
for all rules together. The rest tests each step of the path against "more than ``risk`` of the good
documents are rejected" with the exact binomial tail. More is rejected with each
step, so a fixed sequence of tests needs no correction inside a stratum. The strata, and
all of them together as a pool, share ``delta`` by Bonferroni. The strictest step that holds is used.

The pool's cutoffs serve a stratum in which no step holds (with four strata, any with under
about 195 labels that test, so 260 in all), but never against its own labels: of all its labelled good documents
no more than ``risk`` may be lost. A stratum without labelled good documents, or that the pool can't serve, has no cutoffs.
So with probability of at least 1 - ``delta`` no stratum by cutoffs of its own, nor all strata together by
the pool's, lose more than ``risk`` of their good documents to the five rules together; a stratum served by the pool
has that from the pool and from its own labels' share, which for few labels says little. Labels are read from all labelled documents.

Everything is arrays inside the row plus one small aggregate; words never leave
their row, so neither a very long text nor a hot source needs care.

Defined cases: a null text has no words and fails the base rule; a null
language is the stratum ``und``; repeated rows are judged alike; labels may
repeat (a doc_id counts once, as good only if all its labels say so); no labels
or no rows work; other columns are not read. 8-word windows are compared by a
64-bit hash within one text.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapframe.llm.common import WORD_RE, text_of, words_of
from lapframe.session import materialize

#: Fixed values of the base rule.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = r"[#*$%&|<>]"
RULES = ("symbols", "dup_lines", "repeats", "shouting", "marks")
GRID = 1000
#: What a quarter of the holdout proposes, from lenient to strict.
TOP, STEPS = 0.998, (8.0, 4.0, 2.0, 1.5, 1.25, 1.0)
#: No cutoff lies below this ratio: a single odd character never rejects a text.
LEAST_CUTOFF = 0.02
#: Strata whose cutoffs may be broadcast (six numbers each); with more of them they are joined.
MOST_BROADCAST_STRATA = 50_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once: a lambda variable holds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words that lie in an 8-word window found twice or more in the array, the first one included."""
    return let(words, _repeated)


def _repeated(words: Column) -> Column:
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
    return F.when(n > WINDOW, found).otherwise(F.lit(0)).cast("long")


def _covered(hashes: Column) -> Column:
    def starts(pairs: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            before = (k > 0) & F.coalesce(F.get(pairs, k - 1)["h"] == x["h"], F.lit(False))
            return before | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(pairs, twin), lambda x: x["i"]))

    in_order = let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), starts)
    # each start covers up to the next one, eight words at most
    return F.aggregate(
        in_order, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(s - acc["last"], F.lit(WINDOW))).alias("n")),
    )["n"]


def measures(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the five ratios; with ``carry`` also the row itself, as a struct."""
    text = text_of()
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rest = ["row"] if carry else []
    parts = docs.select(
        *row, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("stratum"),
        text.alias("t"), words_of(text).alias("w"), F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD_RE)).alias("lines"),
    )
    counted = parts.select(
        *rest, "doc_id", "stratum", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").alias("n_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).alias("upper"), F.length(F.regexp_replace("t", r"[^!?|]+", "")).alias("n_marks"),
    )

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.least(F.lit(1.0), F.col(a) / F.col(b))).otherwise(F.lit(0.0))

    rules = {"symbols": ratio("n_symbols", "word_chars"), "dup_lines": ratio("n_dup_lines", "n_lines"), "repeats": ratio("n_repeat_words", "n_words"), "shouting": ratio("upper", "word_chars"), "marks": ratio("n_marks", "word_chars")}
    return counted.select(*rest, "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[rules[r].alias(r) for r in RULES])


def log_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k) by the ratio of neighbouring terms, in logarithms throughout."""
    odds = F.lit(p / (1 - p))
    first = n * F.log1p(F.lit(-p))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i * odds)
        high, low = F.greatest(term, acc["total"]), F.least(term, acc["total"])
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.least(k, n))).otherwise(F.array().cast("array<long>"))
    return F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), step)["total"]


def _cell(ratio: Column) -> Column:
    """A ratio on the grid, no lower than the least cutoff."""
    return F.greatest(F.ceil(ratio * GRID), F.lit(int(LEAST_CUTOFF * GRID))).cast("int")


def tests_part(doc_id: str = "doc_id") -> Column:
    """Whether a labelled document belongs to the three quarters that test."""
    return F.conv(F.substring(F.md5(F.col(doc_id).cast("string")), 1, 1), 16, 10).cast("int") >= 4


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float, delta: float) -> DataFrame:
    """stratum, step, n_good, n_lost and a cutoff per rule (a ratio above it is rejected): a row for each stratum that has cutoffs.

    ``n_good`` and ``n_lost`` are those of the test, for a stratum served by the pool those of its own labels.
    """
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    own = measured.join(good, "doc_id", "left_semi").select("stratum", tests_part().alias("tests"), *[_cell(F.col(r)).alias(r) for r in RULES])
    own = materialize(own, "quality-labelled")
    sizes = own.groupBy("stratum").agg(F.count_if("tests").alias("n")).withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy()))
    level = F.log(F.lit(delta) / (F.col("strata") + 1))
    levels = materialize(sizes.select(F.col("stratum").alias("of"), "n", level.alias("level")), "quality-strata")
    few_strata = levels.count() <= MOST_BROADCAST_STRATA
    small = lambda df: F.broadcast(df) if few_strata else df
    labelled = own.join(small(levels), F.col("stratum") == F.col("of")).drop("of")
    # even with none lost, fewer good documents never pass: their own test is spared; group null is the pool
    alone = labelled.where(F.col("n") * math.log1p(-risk) <= F.col("level")).withColumn("group", F.col("stratum"))
    placed = alone.unionByName(labelled.withColumn("group", F.lit(None).cast("string")))
    tops = placed.where(~F.col("tests")).groupBy("group").agg(*[F.expr(f"percentile_disc({TOP}) WITHIN GROUP (ORDER BY {r})").alias(f"top_{r}") for r in RULES])
    tested = placed.where("tests").join(small(tops.withColumnRenamed("group", "of")), F.col("group").eqNullSafe(F.col("of")))

    def cutoff(rule: str, step: float) -> Column:
        return F.least(F.ceil(F.col(f"top_{rule}") * step), F.lit(GRID)).cast("int")

    def lost(step: float) -> Column:
        over = F.lit(False)
        for r in RULES:
            over = over | (F.col(r) > cutoff(r, step))
        return F.count_if(over)

    each = tested.groupBy("group").agg(F.count(F.lit(1)).alias("n_good"), F.first("level").alias("level"), *[F.first(f"top_{r}").alias(f"top_{r}") for r in RULES], *[lost(x).alias(f"lost_{k}") for k, x in enumerate(STEPS)])
    path = F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"lost_{k}").alias("n_lost"), *[cutoff(r, x).alias(r) for r in RULES]) for k, x in enumerate(STEPS)])
    steps = each.select("group", "n_good", "level", F.explode(path).alias("x")).select("group", "n_good", "level", "x.*")
    worth = F.col("n_lost") <= F.col("n_good") * risk  # more lost than that never passes; spares the sum
    tail = F.when(worth, log_binomial_tail(F.col("n_lost"), F.col("n_good"), risk))
    passed = steps.where(tail <= F.col("level")).groupBy("group").agg(F.max(F.struct("step", "n_good", "n_lost", *RULES)).alias("x"))
    passed = materialize(passed.select(F.col("group").alias("of"), "x.*"), "quality-passed")
    pool = F.broadcast(passed.where("of IS NULL").select("step", *[F.col(r).alias(f"cut_{r}") for r in RULES]))  # one row
    over = F.lit(False)
    for r in RULES:
        over = over | (F.col(r) > F.col(f"cut_{r}"))
    cuts = ["step", *[f"cut_{r}" for r in RULES]]
    against = placed.where("group IS NULL").join(pool).groupBy("stratum").agg(F.count(F.lit(1)).alias("n_good"), F.count_if(over).alias("n_lost"), *[F.first(c).alias(c) for c in cuts])
    served = against.where(F.col("n_lost") <= F.col("n_good") * risk).join(small(passed.select(F.col("of").alias("stratum"))), "stratum", "left_anti")
    out = passed.where("of IS NOT NULL").select(F.col("of").alias("stratum"), "step", "n_good", "n_lost", *[(F.col(r) / GRID).alias(r) for r in RULES])
    return out.unionByName(served.select("stratum", "step", "n_good", "n_lost", *[(F.col(f"cut_{r}") / GRID).alias(r) for r in RULES]))


def _judged(measured: DataFrame, labels: DataFrame, risk: float, delta: float) -> DataFrame:
    """``measured`` with base_failed and kept."""
    limits = materialize(cutoffs(measured, labels, risk, delta), "quality-limits")
    own = limits.select("stratum", *[F.col(r).alias(f"most_{r}") for r in RULES])
    own = F.broadcast(own) if limits.count() <= MOST_BROADCAST_STRATA else own
    judged = measured.join(own, "stratum", "left")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.ceil(F.col(r) * GRID) > F.round(F.col(f"most_{r}") * GRID), F.lit(False))
    return judged.select(*measured.columns, base.alias("base_failed"), (~base & ~over).alias("kept"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.1) -> DataFrame:
    """doc_id, n_words and the four counts, base_failed, kept for every row, with the stratum and the ratios."""
    judged = _judged(materialize(measures(docs), "quality-measures"), labels, risk, delta)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", *RULES)


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.1) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns: each row is judged by itself, and no text is shuffled."""
    return _judged(materialize(measures(docs, carry=True), "quality-rows"), labels, risk, delta).where("kept").select("row.*")

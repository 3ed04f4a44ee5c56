"""Periodic run detection by Lyndon arrays (Ellert and Fischer).

The words of a text are an ordered alphabet: they are compared, never hashed,
and no suffix structure is built. For one order, a pass from left to right keeps
the places whose longest Lyndon word is still open on a stack. A new place r
closes place l when its suffix is smaller, and r - l is then the length of the
longest Lyndon word at l. Which suffix is smaller is known from how far both
match, and matches are reused:

* going down the stack, from the match of each place with the one above it: if two
  matches differ, the third is the shorter one; only if they are equal, words beyond
  them are compared;
* inside the match that went farthest, from the same pair one shift to the left, unless
  it runs up to the end of that match, from where it is extended;
* for each distance r - l, from how far the text was last found to repeat at it: a
  later pair at that distance inside that stretch matches up to its end, so a run
  is compared once and not once for each of its periods.

The root of a run is the longest Lyndon word at its place in one of two orders,
the alphabet's and its reverse, so two passes find every run: a closed pair whose
match goes far enough is extended to the left, once for each period and end. The
number of comparisons per word does not grow with the text (a test counts them).

Defined cases: a null text has no words. Rows repeated give a result each; columns
besides doc_id and text are not read; no rows give no rows. A document is one
task's work: some 15 machine words for each word of it.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapframe.llm.common import id_crc

OUT = "doc_id long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
Words = list[bytes]
Run = tuple[int, int, int]


def find_runs(words: Words, least: int = 6, folds: int = 4) -> list[Run]:
    """(start, length, period) of every maximal stretch with smallest period q and a length of at least max(least, folds * q), in order."""
    found: set[Run] = set()
    for less in (operator.lt, operator.gt):
        _pass(words, less, least, folds, found)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _pass(t: Words, less: Callable[[bytes, bytes], bool], least: int, folds: int, found: set[Run]) -> None:
    n = len(t)
    open_at, matches = [0], [0]  # the stack, and the match of each place with the one below it
    reach = [0] * n  # by distance d: t[x] == t[x - d] from the place last compared at that distance up to here
    begin = far = shift = 0  # the match that went farthest: t[x] == t[x - shift] from begin to far
    closer, closed, opener, opened = [-1] * n, [0] * n, [-1] * n, [0] * n  # by place: which place closed it and their match; which it stayed above and theirs
    ends: set[tuple[int, int]] = set()
    for r in range(1, n):
        here, l = t[r], r - 1  # noqa: E741
        m = 0
        if here != t[l]:
            if less(t[l], here):
                open_at.append(r)
                matches.append(0)
                continue
        else:
            m = reach[1] - r
            if m <= 0:
                m = 1
                while r + m < n and t[r + m] == here:
                    m += 1
                reach[1] = r + m
                if r + m > far:
                    begin, far, shift = r, r + m, 1
        while True:
            end = r + m
            if end < n and less(t[l + m], t[end]):
                break
            del open_at[-1]
            below = matches.pop()
            if m:
                closer[l], closed[l] = r, m
            if m > (folds - 2) * (r - l):
                _extend(t, l, r, m, least, folds, ends, found)
            if not open_at:
                m = 0
                break
            l = open_at[-1]  # noqa: E741
            if below != m:
                m = min(below, m)
                continue
            d = r - l
            m = max(m, reach[d] - r)
            if begin <= l and r + m < far:
                a, b = l - shift, r - shift
                known = closed[a] if closer[a] == b else opened[b] if opener[b] == a else -1
                if known >= 0 and r + known < far:  # as there, so here
                    m = known
                    continue
                m = max(m, min(known, far - r))
            if r + m > reach[d]:
                while r + m < n and t[l + m] == t[r + m]:
                    m += 1
                reach[d] = r + m
                if r + m > far:
                    begin, far, shift = r, r + m, d
        if m:
            opener[r], opened[r] = open_at[-1], m
        open_at.append(r)
        matches.append(m)


def _extend(t: Words, l: int, r: int, m: int, least: int, folds: int, ends: set[tuple[int, int]], found: set[Run]) -> None:  # noqa: E741
    """The run around the Lyndon words at l and r, which match over m words; the first pair of a run is the leftmost."""
    period, end = r - l, r + m
    if (period, end) in ends:
        return
    ends.add((period, end))
    start = l
    while start and t[start - 1] == t[start - 1 + period]:
        start -= 1
    if end - start >= max(least, folds * period):
        found.add((start, end - start, period))


def collapse(words: Words, runs: list[Run]) -> Words:
    """The words that no run contains after its first period."""
    spans = sorted((start + period, start + length) for start, length, period in runs)
    out, at = [], 0
    for a, b in spans:
        if a > at:
            out += words[at:a]
        at = max(at, b)
    return out + words[at:]


def repeat_tail(doc_id: int | None, words: Words) -> Words:
    """A tenth of the documents with a tail that repeats: by crc32 of doc_id, word a + (i - a) % p in place of each word i >= a."""
    h, n = id_crc(doc_id), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _documents(change: Callable[[int | None, Words], Words] | None, least: int, folds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows // max(1, batch.nbytes // 4_000_000))
            for k in range(0, batch.num_rows, step):
                some = batch.slice(k, step)
                runs, texts = [], []
                for doc_id, raw in zip(some.column("doc_id").to_pylist(), some.column("raw"), strict=True):
                    words = (raw.as_py() or b"").split()  # of bytes: ASCII white space only
                    words = change(doc_id, words) if change else words
                    runs.append(find_runs(words, least, folds) if len(words) >= least else [])
                    texts.append(b" ".join(collapse(words, runs[-1])).decode())
                spans = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs], _RUNS)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), spans, pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = 6, folds: int = 4, change: Callable[[int | None, Words], Words] | None = None) -> DataFrame:
    """doc_id, runs (by start, then period), collapsed (the text's words without what runs repeat, joined by spaces) for every row.

    ``change`` may give other words for a document before runs are sought.
    """
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text"), "UTF-8").alias("raw"))
    return raw.mapInArrow(_documents(change, least, folds), OUT)


def digests(found: DataFrame) -> DataFrame:
    """n_runs, the run of the greatest exact length / period with its figures, and digests of the runs and the collapsed text."""
    steeper = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    # runs come by start, then period, so of equal ones the first stays
    most = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda a, b: F.when(steeper(b, a), b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), most.alias("most"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * most.length) div most.period")
    return out.select("doc_id", "n_runs", *[F.col(f"most.{c}").alias(c) for c in ("start", "length", "period")], milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

"""Centroid clustering, token counts and periodic runs against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lapframe.llm import centroids, periodic_runs, token_counts
from lapframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
JSON = public_tokenizers.path("byte_bpe_50k.json")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# --- centroid clustering ---


def _plain_clusters(rows, k=8, rounds=10, dims=64):
    """Lloyd's rounds by comparing everything, in Python's whole numbers."""
    fit = [(d, [float(x) for x in v]) for d, v in rows if v is not None and len(v) == dims and all(x is not None and abs(x) < 2**52 for x in v)]
    vectors = [[int(np.floor(1024 * x)) for x in v] for _, v in fit]
    first = sorted(range(len(fit)), key=lambda i: (sha(f"3:{'' if fit[i][0] is None else fit[i][0]}"), fit[i][1]))[:k]
    middle = [vectors[i] for i in first]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((away(v, c), j) for j, c in enumerate(middle))
    for _ in range(rounds):
        own = [near(v)[1] for v in vectors]
        for j in range(len(middle)):
            mine = [v for v, o in zip(vectors, own, strict=True) if o == j]
            if mine:
                middle[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    last = [near(v) for v in vectors]
    fits = lambda n: n if n < 2**63 else None
    of = {j: sum(d for d, o in last if o == j) for _, j in last}
    return sorted(((d, j, fits(dist), fits(of[j]), fits(sum(of.values())), sha(",".join(map(str, middle[j])))) for (d, _), (dist, j) in zip(fit, last, strict=True)), key=repr)


def _clusters(df, **options):
    return sorted((tuple(r) for r in centroids.with_digest(centroids.cluster(df, **options)).collect()), key=repr)


def test_op11_on_odd_vectors(spark):
    rng = random.Random(3)
    whole = [(d, [rng.gauss(0, 0.2) for _ in range(64)]) for d in range(60)]
    bad = [(100, None), (101, []), (102, [0.5] * 63), (103, [0.5] * 65), (104, [0.5] * 63 + [None]), (105, [float("nan")] + [0.5] * 63), (106, [float("-inf")] + [0.5] * 63), (107, [1e300] * 64)]
    rows = whole + bad + [whole[5], whole[5], (None, whole[7][1]), (None, None), (7, whole[9][1]), (61, [0.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit("x").alias(c) for c in ("cluster", "distance", "n", "sums", "key", "label")])
    assert _clusters(df.repartition(5)) == _plain_clusters(rows)
    assert _clusters(df.where("vec_id in (1, 2, 3, 100)")) == _plain_clusters(rows[1:4])  # fewer vectors than centroids
    assert centroids.cluster(df.where("false")).count() == 0 and centroids.cluster(df.where("vec_id > 99")).count() == 0


@pytest.mark.parametrize("size", [2.0**14, 2.0**20, 2.0**40])
def test_op11_large_components(spark, size):
    """Sums of squares beyond a double's and a long's whole numbers stay exact; what fits no long is null."""
    rng = random.Random(4)
    rows = [(d, [rng.choice([-1, 1]) * size * rng.random() if rng.random() < 0.9 else rng.random() for _ in range(64)]) for d in range(40)]
    assert _clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == _plain_clusters(rows)


def test_op11_ties_and_pruning():
    """On a grid with many equal distances the smallest number wins, and the annulus leaves most of many centroids out."""
    rng = np.random.default_rng(5)
    grid = rng.integers(-3, 4, (400, 2))
    middle = [[int(x) for x in row] for row in rng.integers(-3, 4, (40, 2))]
    number, distance = centroids.Annulus(middle).nearest(grid.astype(np.float64))
    every = ((grid[:, None, :] - np.array(middle)[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    far = rng.normal(0, 1, (500, 3)) * np.arange(1, 501)[:, None] * 100
    annulus, compared = centroids.Annulus([[int(x) for x in row] for row in far]), []
    annulus._exact = lambda x, c, first, end, f=annulus._exact: compared.append(int((end - first).sum())) or f(x, c, first, end)
    annulus.nearest(np.floor(far + 5))
    assert sum(compared) < 0.3 * 500 * 500


# --- token counts ---


def _library():
    t = Tokenizer.from_file(JSON)
    t.no_truncation()
    t.no_padding()
    return lambda s: len(t.encode(s, add_special_tokens=False))


TEXTS = st.lists(st.one_of(st.sampled_from([" ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "᠎", "​", "'s", "'", "don't", "I'LL", "<|endoftext|>", "<|", "|>", "a1b2", "Zürich", "中文。字", "é", "🙂", "!?!", "ab", "\x00"]), st.text(max_size=4)), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_op12_safe_boundaries(text):
    """Texts cut at every safe boundary, and in parts of three characters, have the library's number of tokens."""
    whole = _library_cached(text)
    assert "".join(token_counts.SAFE.split(text)) == text
    assert token_counts.lengths_of(JSON).of([text]) == [whole]
    parts = list(token_counts.cut_safely(text, 3))
    assert "".join(parts) == text and sum(map(_library_cached, parts)) == whole


_library_cached = _library()


def test_op12_whole_query(spark):
    count = _library()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_token_counts"](spark, SF).collect()}
    assert got == {d: (len(t.encode()), count(t), count(t) > 512) for d, t in docs.items()}


def test_op12_odd_rows(spark):
    long = " ".join(f"word{i % 97}, <|endoftext|> I'll" for i in range(3_000))
    rows = [(1, "a b"), (1, "a b"), (None, "x"), (None, None), (2, ""), (3, "  \n "), (4, long), (4, long), (5, "z" * 40_000), (6, long + " 中文" * 9_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("row", "no", "id", "n_bytes", "part", "n_tokens")])
    count = _library()
    want = sorted(((d, len((t or "").encode()), count(t or ""), count(t or "") > 512) for d, t in rows), key=repr)
    for part in (1 << 18, 1 << 12):
        assert sorted((tuple(r) for r in token_counts.count_tokens(df, JSON, part=part).collect()), key=repr) == want
    assert token_counts.count_tokens(df.where("false"), JSON).count() == 0


def test_op12_other_tokenisers(spark):
    """A file whose texts have no safe boundaries is encoded whole."""
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    rows = [(1, "A  small Text, <|endoftext|> it's"), (2, "more " * 2_000)]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, part=100).select("doc_id", "n_tokens").collect()
    assert not token_counts.Lengths(path).splits
    assert sorted(map(tuple, got)) == [(d, len(t.encode(s, add_special_tokens=False))) for d, s in rows]


# --- periodic runs ---


def _plain_runs(words, least=6, folds=4):
    """For each period, the maximal stretches; a stretch whose smallest period is shorter is not one of it."""
    n, out = len(words), []
    for q in range(1, n // max(2, folds) + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - start >= max(least, folds * q) and not any(q % d == 0 and words[start] and all(words[k] == words[k + d] for k in range(start, i - d)) for d in range(1, q)):
                out.append((start, i - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32((b"" if doc_id is None else str(doc_id).encode())), len(words)
    if h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = _plain_runs(words)
    most = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    milli = None if not runs else 1000 * most[1] // most[2]
    return (doc_id, len(runs), *most, milli, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@settings(max_examples=3000, deadline=None)
@given(st.text("abc", max_size=60), st.integers(2, 5), st.integers(0, 3), st.booleans())
def test_op13_all_runs(text, folds, times, long_words):
    words = [c.encode() * (3 if long_words else 1) for c in text + text[: times * 7] * times]
    assert periodic_runs.find_runs(words, 6, folds) == _plain_runs(words, 6, folds)


def test_op13_structured_words():
    fib = ["a", "ab"]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    thue = "a"
    while len(thue) < 512:
        thue += thue.translate(str.maketrans("ab", "ba"))
    for s in [fib[-1], thue, "a" * 500, "aab" * 150 + "aa", ("a" * 20 + "b") * 20, ("ab" * 9 + "c") * 12 + "ab" * 30, "".join("ab" * k + "a" for k in range(1, 20))]:
        words = [c.encode() for c in s]
        for folds in (2, 4):
            assert periodic_runs.find_runs(words, 2, folds) == _plain_runs(words, 2, folds)


class _Counted(bytes):
    """A word that counts how often it is compared for being equal."""

    seen = 0

    def __eq__(self, other):
        _Counted.seen += 1
        return bytes.__eq__(self, other)

    def __ne__(self, other):
        _Counted.seen += 1
        return bytes.__ne__(self, other)

    __hash__ = bytes.__hash__


@pytest.mark.parametrize("kind", ["one", "blocks", "nested", "fibonacci", "random"])
def test_op13_comparisons_grow_with_the_text(kind):
    """Comparisons per word stay the same when the text is eight times as long."""

    def made(n):
        if kind == "fibonacci":
            a, b = "a", "ab"
            while len(b) < n:
                a, b = b, b + a
            s = b[:n]
        else:
            inner = "a" * 40 + "b"
            s = {"one": "a" * n, "blocks": (inner * (n // 41 + 1))[:n], "nested": ((inner * 9 + "c") * (n // 370 + 1))[:n], "random": "".join(random.Random(1).choices("ab", k=n))}[kind]
        return [_Counted(c.encode()) for c in s]

    used = []
    for n in (2_000, 16_000):
        words = made(n)
        _Counted.seen = 0
        periodic_runs.find_runs(words)
        used.append(_Counted.seen / n)
    assert used[1] < 1.1 * used[0] and used[1] < 8


def test_op13_whole_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op13_periodic_runs"](spark, SF).collect()))
    assert got == sorted(_plain_row(d, t) for d, t in docs)
    assert sum(r[1] > 0 for r in got) > 5


def test_op13_odd_rows(spark):
    rows = [(d, t) for d in (1, 2, 3, None) for t in ("a a a a a a a", "x\x0by\x1cz\x85 x\x0by\x1cz\x85 " * 5, None, "", " \n ", "ab " * 9 + "abc " * 8)] + [(9, "the same " * 20_000)] + [(k, "one two three four five six seven") for k in range(60)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("runs", "raw", "most", "start", "length", "collapsed")])
    got = sorted((tuple(r) for r in periodic_runs.digests(periodic_runs.periodic_runs(df, change=periodic_runs.repeat_tail)).collect()), key=repr)
    plain = {(d, t): _plain_row(d, t) for d, t in set(rows) if len(t or "") < 1_000}
    assert [r for r in got if r[0] != 9 or r[1] != 1 or r[3] < 1_000] == sorted((plain[row] for row in rows if row in plain), key=repr)
    assert (9, 1, 0, 40_000, 2, 20_000_000) in [r[:6] for r in got]
    found = periodic_runs.periodic_runs(df.where("doc_id = 1")).where("size(runs) > 0").select("collapsed").collect()
    assert {r["collapsed"] for r in found} >= {"a", "x y\x1cz\x85"}
    assert periodic_runs.periodic_runs(df.where("false")).count() == 0

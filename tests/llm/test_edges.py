"""Every operator and stage on empty tables, nulls in every column, repeated rows and clashing column names."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lapframe.llm import byte_bpe, context_mixing, exact_dedup, jaccard_join, language_id, line_dedup, mixing, quality_rules, sharding, suffix_dedup
from lapframe.llm.queries import ORACLES, QUERIES
from tests.compare import close, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
CLASHES = ["digest", "key", "node", "shard", "slot", "bin", "size", "words", "n", "target", "kept", "stratum", "component", "grp", "kind", "blob", "ids", "row", "no", "part", "id", "first", "lid", "value", "col", "__id", "__words", "__digest", "__copy", "__source", "doc", "text_key", "keep_id", "keep_no", "own_source", "times", "at", "dropped_lines", "base_failed", "w", "t", "lines"]


def _labels(docs):
    return docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))


OPERATORS = {
    "op1": lambda d: language_id.predict(d, language_id.train(d, public_tokenizers.path("piece_bpe_32k.model"))),
    "op2": suffix_dedup.remove_repeats,
    "op3": sharding.shard_documents,
    "op4": exact_dedup.exact_dedup,
    "op5": lambda d: quality_rules.judge(d, _labels(d)),
    "op6": line_dedup.dedup_lines,
    "op7": mixing.mix,
    "op8": lambda d: byte_bpe.encode_decode(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
    "op9": jaccard_join.jaccard_join,
    "op10": context_mixing.score_documents,
}


@pytest.fixture(scope="module")
def odd(spark):
    text = "The quick brown fox jumps over the lazy dog again and again, and then it sleeps for a long time under a tree.\n"
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (1, "another text of the same id", "en", "a"), (None, text, None, None), (None, None, None, None), (2, None, "en", "b"), (3, "", None, "b"), (4, text.upper(), "en", None), (5, text * 40, "en", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES])


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, name):
    got = OPERATORS[name](odd)
    rows = got.collect()
    if name == "op6":  # rows repeated with one doc_id and text are one document, told as often as they occur
        assert len(rows) == odd.count()
    assert len(rows) == odd.count()
    wanted = sorted(str(r["doc_id"]) for r in odd.select("doc_id").collect())
    assert sorted(str(r["doc_id"]) for r in rows) == wanted


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(odd, name):
    got = OPERATORS[name](odd.where("false"))
    assert got.count() == 0 and got.columns


def test_defined_cases(odd):
    exact = OPERATORS["op4"](odd).collect()
    assert sum(r["kept"] for r in exact) == len({r["text_sha256"] for r in exact})
    assert {r["lang_pred"] for r in OPERATORS["op1"](odd).collect()} <= {"en", "und"}
    removed = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in OPERATORS["op2"](odd).collect()}
    assert removed[1, 110] == 0 and removed[None, 110] == 110 and removed[4, 110] == 0 and removed[None, 0] == 0
    by = {r["doc_id"]: r for r in OPERATORS["op9"](odd).collect() if r["doc_id"] is not None}
    assert by[2]["class_id"] == by[3]["class_id"] == 2 and by[2]["n_links"] == 0


def _kept(rows, n: int = 5) -> dict[str, list]:
    """What each stage keeps of ``rows`` (doc_id, text, lang, source), taken plainly, as (doc_id, text) pairs."""
    from tests.llm import brute

    lower = lambda t: (t or "").translate(brute.ASCII_UPPER)
    rank = lambda d: -1 if d is None else d
    largest: dict[str, tuple] = {}
    for d, t, *_ in rows:
        largest[lower(t)] = max(largest.get(lower(t), (-2, "")), (rank(d), t or ""))
    up: dict[str, str] = {t or "": t or "" for _, t, *_ in rows}
    sets = {t: {tuple(brute.words(t)[i : i + n]) for i in range(max(1, len(brute.words(t)) - n + 1))} if brute.words(t) else set() for t in up}
    root = lambda t: t if up[t] == t else root(up[t])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    first: dict[str, tuple] = {}
    for d, t, *_ in rows:
        own = (d is None, rank(d), t or "")
        first[root(t or "")] = min(first.get(root(t or ""), (2, 0, "")), own, key=lambda x: (x[0], x[1], hashlib.md5(x[2].encode()).digest()))
    return {
        "quality_rules": [(d, t) for d, t, *_ in rows if not brute.quality_counts(t)[-1]],
        "exact_dedup": [(None if d == -1 else d, t) for d, t in largest.values()],
        "jaccard_join": [(None if none else d, t) for none, d, t in first.values()],
    }


@pytest.mark.parametrize("name", ["quality_rules", "exact_dedup", "jaccard_join", "mixing"])
def test_stage_keeps_exactly_its_rows(spark, odd, tmp_path, name):
    """Repeated and null doc_ids, two texts under one doc_id, and columns with the names that stages might use."""
    _labels(odd.where("doc_id is not null")).write.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, odd, str(tmp_path))
    assert got.columns == odd.columns
    assert all(r[c] == "x" for r in got.select(*CLASHES).collect() for c in CLASHES)
    pairs = lambda found: sorted((str(d), t or "") for d, t in found)
    rows = [tuple(r) for r in odd.select("doc_id", "text", "lang", "source").collect()]
    kept = [tuple(r) for r in got.select("doc_id", "text").collect()]
    if name == "mixing":  # rows with one doc_id, source and size may be taken differently; together as often as the mix says
        from collections import Counter

        times = Counter()
        for r in mixing.mix(odd).collect():
            times[r["doc_id"], r["source"], r["size"]] += r["times"]
        found = Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in got.collect())
        assert found == +times
        return
    want = _kept(rows)[name]
    assert pairs(kept) == pairs(want)


def test_mixed_rows_meet_their_targets(spark):
    """Null and repeated doc_ids: each source's taken words come within a document of its target, row by row as the mix says."""
    rows = [(None if k % 3 else k % 7, " ".join(["w"] * (5 + k % 11) + [f"x{k}"]), "ab"[k % 2]) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r["source"]: r["target"] for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    for source in "ab":
        own = [len(r["text"].split()) for r in mixing.apply_mix(docs).where(f"source = '{source}'").collect()]
        assert abs(sum(own) - want[source]) <= 16
    assert sorted(want) == ["a", "b"]


def test_stages(spark, odd, tmp_path):
    _labels(odd.where("doc_id is not null")).write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd.where("false"), str(tmp_path))
        assert got.count() == 0 and (name == "byte_bpe" or got.columns == odd.columns)
    assert corpus_pipeline.STAGES[-1][1](spark, odd, str(tmp_path)).count() == odd.count()


def test_dropped_lines_of_any_rows(odd):
    """A document is known by doc_id and text: the earliest one keeps a line, whatever its doc_id."""
    left = line_dedup.drop_lines(odd)
    assert left.columns == odd.columns and left.count() == odd.count()
    texts = [(str(r["doc_id"]), r["lang"], r["text"]) for r in left.select("doc_id", "lang", "text").collect()]
    line = "The quick brown fox jumps over the lazy dog again and again, and then it sleeps for a long time under a tree."
    assert sum(line in (t or "") for _, _, t in texts) == 2  # the first document, which is there twice
    assert ("None", None, None) in texts and ("None", None, "") in texts


def test_pipeline_against_its_parts(spark):
    """Whole run: each stage's decisions, recomputed plainly on its own input."""
    from tests.llm import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        out[name] = (before, docs)
    before, after = out["quality_rules"]
    judged = {r["doc_id"] for r in quality_rules.judge(before, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    assert {r["doc_id"] for r in after.collect()} == judged
    before, after = out["exact_dedup"]
    kept = {d for d, _, _, k, _ in brute.exact([(r["doc_id"], r["text"]) for r in before.collect()]) if k}
    assert {r["doc_id"] for r in after.collect()} == kept and after.count() == len(kept)
    before, after = out["jaccard_join"]
    classes = brute.jaccard_classes([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for _, c, *_ in classes})
    before, after = out["mixing"]
    taken = {r["doc_id"]: r["times"] for r in mixing.mix(before).collect()}
    counts = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert counts == {d: n for d, n in taken.items() if n}
    assert out["byte_bpe"][1].count() == after.count()
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, out["byte_bpe"][1].collect()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF))
    sql_columns, wanted = sql_rows(ORACLES[name], SF)
    assert columns == sql_columns and len(rows) == len(wanted)
    assert all(close(a, b) for x, y in zip(rows, wanted, strict=True) for a, b in zip(x, y, strict=True))

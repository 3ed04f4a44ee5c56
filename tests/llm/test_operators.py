"""Each operator against a plain version, on rows with nulls, copies, ties, blanks and long texts."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lapframe.llm import byte_bpe, context_mixing, exact_dedup, filters, jaccard_join, language_id, line_dedup, mixing, quality_rules, sharding, suffix_dedup
from lapframe.session import shared_path
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"


def same(got, want) -> None:
    got, want = sorted(map(tuple, got), key=repr), sorted(map(tuple, want), key=repr)
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want, strict=True) if a != b][:3] == []


@pytest.fixture(scope="module")
def rows(spark):
    """The smallest documents, and odd ones. Doc_ids are unique."""
    r = random.Random(7)
    out = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    base = [r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(120)]
    for k in range(40):
        near = list(base)
        near[r.randrange(120)] = f"x{k}"
        out.append((5000 + k, " ".join(near), None, "odd"))
    out += [(6000, None, None, None), (6001, "", "en", None), (6002, " \n\t ", None, "odd"), (6003, "word", None, "odd"), (6004, "é" * 30_000, "xx", "odd"), (6005, "A b\n" * 3000, None, "odd")]
    out += [(6006 + k, x, None, "odd") for k, x in enumerate(["Same Text here", "same text HERE", "same text here", "ÉCOLE", "école"])]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def test_op1_held_out_accuracy(spark, docs, rows):
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    model = language_id.train(docs, vocabulary)
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert len(got) == len(rows)
    for d, t, lang, _ in rows:
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= got[d]["score"] <= 1 and (got[d]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))
    judged = [got[d]["lang_pred"] == lang for d, t, lang, _ in rows if lang and got[d]["held_out"] and len(t or "") > 40 and d < 5000]
    assert sum(judged) >= 0.95 * len(judged)
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q"))
    again = {r["doc_id"]: r for r in language_id.predict(other, model).collect()}
    assert again == got  # lang and source are no inputs


def test_op2_repeats(spark, docs, rows):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    for size in (4_000_000, 20_000):
        same(suffix_dedup.remove_repeats(docs, size).select(*columns).collect(), brute.repeats(rows))
    r = random.Random(1)
    made = [(k, "".join(r.choice(["aa", "b", "ab", "cab", "xyz", " "]) for _ in range(r.choice([5, 40, 200]))) * r.choice([1, 1, 3])) for k in range(120)]
    made += [(200, "a" * 70_000), (201, "b" * 10 + "a" * 66_000), (202, None), (203, ""), (None, made[3][1])]
    passage = "".join(r.choice("abcdefgh ") for _ in range(120))
    made += [(300 + k, "".join(r.choice("mnopq") for _ in range(90)) + passage[k % 3 :] + "".join(r.choice("rstuv") for _ in range(90))) for k in range(60)]
    for hot in (40_000, 20):  # with the passage's grams dealt out by window, too
        got = suffix_dedup.remove_repeats(spark.createDataFrame(made, "doc_id long, text string"), 20_000, hot)
        same(got.select(*columns).collect(), brute.repeats(made))
    assert len(suffix_dedup.hot_grams(spark.createDataFrame(made, "doc_id long, text string").fillna("", "text"), len(made), 20))
    for x in got.select("doc_id", "kept", "spans", "n_removed").where("n_removed > 0").collect():
        assert sum(s["end"] - s["start"] for s in x["spans"]) == x["n_removed"]


def test_op3_shards(spark, docs, rows):
    got = sharding.shard_documents(docs, shards=24).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, *_ in rows)
    text = {d: t or "" for d, t, *_ in rows}
    load, slots, home = Counter(), defaultdict(list), {}
    for r in got:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        assert home.setdefault(raw, r["shard"]) == r["shard"]
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # the smallest capacity by definition: groups in order of their digest
    groups = Counter()
    for t in text.values():
        groups[hashlib.sha256(t.encode()).hexdigest()] += len(t.encode()) + 8
    sizes = [groups[k] for k in sorted(groups)]

    def fits(capacity: int) -> bool:
        n, held = 1, 0
        for s in sizes:
            if s > capacity:
                return False
            n, held = (n + 1, s) if held + s > capacity else (n, held + s)
        return n <= 24

    best = next(c for c in sorted({sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)}) if fits(c))
    assert max(load.values()) == best


def test_op4_exact(spark, docs, rows):
    got = exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    same(got, brute.exact(rows))


def test_op4_index_persists(spark, docs):
    path = shared_path(spark, "test-index")
    index = exact_dedup.DigestIndex(spark, path, buckets=3)
    first = index.add(docs.where("doc_id < 100"), "one")
    kept = first.where("kept").count()
    assert index.rows().count() == kept
    again = index.add(docs.where("doc_id < 100"), "one")  # a job that runs twice
    assert again.where("kept").count() == kept and index.rows().count() == kept
    other = exact_dedup.DigestIndex(spark, path, buckets=3).add(docs, "two")
    assert other.where("kept and doc_id < 100").count() == 0
    assert index.rows().count() == index.rows().select("digest").distinct().count()
    plan = docs.select(exact_dedup.digest_of().alias("digest")).join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_op4_index_opened_by_another_session(spark, docs):
    """A session with another shuffle width, whose catalog does not know the index, finds all that is in it."""
    path, width = shared_path(spark, "test-index"), spark.conf.get("spark.sql.shuffle.partitions")
    first = exact_dedup.DigestIndex(spark, path)
    kept = first.add(docs, "one").where("kept").count()
    files = sorted(tuple(r) for r in first.rows().collect())
    spark.sql(f"DROP TABLE {first.name}")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        again = exact_dedup.DigestIndex(spark, path)
        assert again.buckets == first.buckets
        assert again.add(docs, "two").where("kept").count() == 0
        assert sorted(tuple(r) for r in again.rows().collect()) == files and len(files) == kept
        with pytest.raises(ValueError, match="buckets"):
            exact_dedup.DigestIndex(spark, path, buckets=first.buckets + 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)


def test_op4_index_compacts(spark, docs):
    path = shared_path(spark, "test-index")
    index = exact_dedup.DigestIndex(spark, path, buckets=2, most_files=3)
    kept = [index.add(docs.where(f"doc_id % 7 = {k}"), f"b{k}").where("kept").count() for k in range(7)]
    names = [r[0] for r in index.rows().select(F.input_file_name()).distinct().collect()]
    assert len(names) <= 2 * 4 and sum(kept) == index.rows().count() == index.rows().select("digest").distinct().count()
    opened = exact_dedup.DigestIndex(spark, path)
    assert sorted(map(tuple, opened.rows().collect())) == sorted(map(tuple, index.rows().collect()))
    assert index.add(docs, "all").where("kept").count() == 0


def test_op5_counts(docs, rows):
    got = {r["doc_id"]: tuple(r)[1:] for r in quality_rules.judge(docs, docs.select("doc_id", F.lit(1).alias("quality")).where("doc_id < 5000")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert [(d, got[d], brute.quality_counts(t)) for d, t, *_ in rows if got[d] != brute.quality_counts(t)] == []


def _plain_cutoffs(rows, risk: float, delta: float) -> dict:
    """(step, lost, cutoffs in thousandths) per stratum that has cutoffs; ``rows``: doc_id, stratum, five ratios of good documents.

    A stratum that passes a test has its own; all are tested together as well, which serves the others where their own labels agree.
    """
    cells = [(s, int(hashlib.md5(str(d).encode()).hexdigest()[0], 16) >= 4, [max(math.ceil(x * 1000), 20) for x in ratios]) for d, s, ratios in rows]
    strata = {s for s, *_ in cells}
    level = delta / (len(strata) + 1)
    least = {s for s in strata if (1 - risk) ** sum(t and x == s for x, t, _ in cells) <= level}
    out = {}
    for group in [*least, None]:
        member = lambda s: group in (s, None)  # noqa: B023, E731
        fit, test = ([c for s, t, c in cells if t == half and member(s)] for half in (False, True))
        if not fit or not test:
            continue
        top = [sorted(c[k] for c in fit)[math.ceil(quality_rules.TOP * len(fit)) - 1] for k in range(5)]
        for step, factor in enumerate(quality_rules.STEPS):
            cut = [min(math.ceil(x * factor), 1000) for x in top]
            lost = sum(any(x > y for x, y in zip(c, cut, strict=True)) for c in test)
            if brute.binomial_tail(lost, len(test), risk) <= level:
                out[group] = (step, lost, cut)
    step, _, cut = out.pop(None, (0, 0, None))
    for s in strata - set(out) if cut else ():
        own = [any(x > y for x, y in zip(c, cut, strict=True)) for x, _, c in cells if x == s]
        if sum(own) <= risk * len(own):
            out[s] = (step, sum(own), cut)
    return out


def test_op5_cutoffs_are_the_strictest_that_hold(spark):
    r = random.Random(2)
    made = [(k, "aa" if k < 3000 else "bb" if k < 5000 else f"s{k % 5}", [r.random() ** 4 * 0.2, r.random() ** 9, 0.0, r.random() * 0.1, 0.001]) for k in range(6200)]
    measured = spark.createDataFrame([(d, s, *x) for d, s, x in made], "doc_id long, stratum string, " + ", ".join(f"{x} double" for x in quality_rules.RULES))
    labels = spark.createDataFrame([(k, int(k % 10 > 1)) for k in range(6200)], "doc_id long, quality int")
    risk, delta = 0.02, 0.1
    want = _plain_cutoffs([x for x in made if x[0] % 10 > 1], risk, delta)
    got = {x["stratum"]: (x["step"], x["n_lost"], [round(x[rule] * 1000) for rule in quality_rules.RULES]) for x in quality_rules.cutoffs(measured, labels, risk, delta).collect()}
    assert got == want and {"aa", "bb"} < set(got) <= {"aa", "bb", *(f"s{k}" for k in range(5))}


def test_op5_verdicts(spark):
    """On the tables of the correctness check: what the base rule leaves is judged by cutoffs that exist, and bad documents go."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    judged = {x["doc_id"]: x for x in quality_rules.judge(docs, labels).collect()}
    quality = {x["doc_id"]: x["quality"] for x in labels.collect()}
    good = [(d, x["stratum"], [x[rule] for rule in quality_rules.RULES]) for d, x in judged.items() if quality.get(d) == 1]
    limits = _plain_cutoffs(good, 0.02, 0.1)
    assert limits
    for d, x in judged.items():
        _, _, cut = limits.get(x["stratum"], (0, 0, [1000] * 5))
        assert x["kept"] == (not x["base_failed"] and all(math.ceil(x[rule] * 1000) <= c for rule, c in zip(quality_rules.RULES, cut, strict=True)))
    passed = [d for d, x in judged.items() if not x["base_failed"]]
    bad, fine = ([d for d in passed if quality.get(d) == q and judged[d]["stratum"] in limits] for q in (0, 1))
    assert sum(not judged[d]["kept"] for d in bad) > 0.9 * len(bad) and sum(judged[d]["kept"] for d in fine) > 0.97 * len(fine)


def test_op6_lines(spark, docs, rows):
    few = [x for x in rows if len(x[1] or "") < 4000][:120]
    r = random.Random(3)

    def line():
        return "".join(r.choice("abé d") for _ in range(r.choice([3, 16, 17, 18, 20, 33, 40, 64, 65, 700])))

    pool = [line() for _ in range(30)]

    def changed(x: str) -> str:
        k, way = r.randrange(len(x) + 1), r.random()
        return x[:k] + r.choice("xyz") + x[k:] if way < 0.3 else x[:k] + x[k + 1 :] if way < 0.6 else x[:k] + r.choice("xyz") + x[k + 1 :] if way < 0.8 else x

    made = [(10_000 + k, "\n".join(changed(r.choice(pool)) for _ in range(r.choice([1, 3, 8])))) for k in range(60)] + [(None, pool[5]), (20_000, "\n \n")]
    every = [(d, t) for d, t, *_ in few] + made
    got = line_dedup.dedup_lines(spark.createDataFrame(every, "doc_id long, text string")).collect()
    same([(x[0], x[1], x[2], list(x[3])) for x in got], brute.dropped_lines(every))
    cleaned = {x["doc_id"]: x["text"] for x in line_dedup.drop_lines(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    for d, _, _, gone in brute.dropped_lines(made):
        if d is not None:
            assert cleaned[d] == "\n".join(x for k, x in enumerate(dict(made)[d].split("\n")) if k not in gone)


def test_op7_mix(docs, rows):
    got = mixing.mix(docs).collect()
    want = brute.source_targets(rows)
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, *_ in rows)
    size, taken = Counter(), Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 3 * r["size"] and r["size"] == len(brute.words(dict((d, t) for d, t, *_ in rows)[r["doc_id"]]))
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    for r in got:
        assert r["source_size"] == size[r["source"]]
    longest = defaultdict(int)
    for r in got:
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in taken:
        assert abs(taken[s] - want[s]) <= longest[s]
    same(mixing.mix(docs.repartition(7)).select("doc_id", "taken").collect(), [(r["doc_id"], r["taken"]) for r in got])
    # whole epochs first: within a source, counts differ by one at most
    for s in taken:
        times = {r["times"] for r in got if r["source"] == s}
        assert max(times) - min(times) <= 1


def test_op7_sampling_prefers_quality(spark):
    """By exponential keys, the share taken of each kind follows its weight."""
    text = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("good words here")).otherwise(F.lit("1234 5678 90")).alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    got = mixing.mix(text).where("source = 's0' and times > 0").groupBy((F.col("doc_id") % 2).alias("kind")).count().collect()
    n = {r["kind"]: r["count"] for r in got}
    assert n[0] > 1.3 * n[1]


def test_op8_tokens(spark, docs, rows):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    more = [(9000 + k, "".join(r.choice(["a", "b", " ", "\n", "é", "漢", "😀", "12", "'s", "  ", "<|endoftext|>", "Ab"]) for _ in range(r.choice([10, 400, 3000])))) for k in range(30)]
    every = [(d, t) for d, t, *_ in rows] + more
    df = spark.createDataFrame(every, "doc_id long, text string")
    want = [(d, whole.encode_ordinary(t or ""), (t or "").encode()) for d, t in every]
    for chunk, overlap in ((32_768, 1_024), (200, 50)):
        coded = byte_bpe.encode_decode(df, path, public_tokenizers.PATTERN, chunk, overlap)
        same([(x["doc_id"], list(x["ids"]), bytes(x["decoded"])) for x in coded.collect()], want)
    back = byte_bpe.decode(coded, path, public_tokenizers.PATTERN)
    same([(x["doc_id"], bytes(x["decoded"])) for x in back.collect()], [(d, raw) for d, _, raw in want])
    same(byte_bpe.digests(coded).collect(), [(d, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()) for d, i, raw in want])


def test_op9_classes(spark, docs, rows):
    columns = ("doc_id", "class_id", "rep_id", "n_copies", "n_links")
    same(jaccard_join.jaccard_join(docs).select(*columns).collect(), brute.jaccard_classes(rows))
    same(jaccard_join.jaccard_join(docs, bucket=8).select(*columns).collect(), brute.jaccard_classes(rows))  # many buckets and blocks
    left = jaccard_join.one_per_class(docs)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({c for _, c, *_ in brute.jaccard_classes(rows)})


def test_op10_scores(docs, rows):
    got = {r["doc_id"]: r for r in context_mixing.score_documents(docs).collect()}
    for d, held, n, known, total, base in brute.base_scores(rows):
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] <= 0


def test_filter_keeps_all_wanted(spark):
    rows = spark.range(2000).withColumn("h", F.xxhash64("id"))
    wanted = rows.where("id % 50 = 0").select(F.col("h").alias("w"))
    got = {r["id"] for r in filters.may_be_among(rows, F.col("h"), wanted, F.col("w")).collect()}
    assert got >= set(range(0, 2000, 50)) and len(got) < 60

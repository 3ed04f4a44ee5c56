"""The queries of this subpackage's operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lapframe.llm import centroids, periodic_runs
from lapframe.llm.byte_bpe import digests, encode_decode
from lapframe.llm.common import table
from lapframe.llm.context_mixing import score_documents
from lapframe.llm.exact_dedup import exact_dedup
from lapframe.llm.jaccard_join import jaccard_join
from lapframe.llm.language_id import predict, train
from lapframe.llm.line_dedup import dedup_lines
from lapframe.llm.mixing import mix
from lapframe.llm.quality_rules import judge
from lapframe.llm.sharding import shard_documents
from lapframe.llm.suffix_dedup import remove_repeats
from lapframe.llm.token_counts import count_tokens

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs, public_tokenizers.path("piece_bpe_32k.model")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(encode_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), words=5, threshold=0.8)


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_digest(centroids.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, salt="3:"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return periodic_runs.digests(periodic_runs.periodic_runs(docs, least=6, folds=4, change=periodic_runs.repeat_tail))


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_sharding": op3_sharding,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op7_mixing": op7_mixing,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_context_mixing": op10_context_mixing,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_token_counts": op12_token_counts,
    "op13_periodic_runs": op13_periodic_runs,
}

_RULES = ("symbols", "dup_lines", "repeats", "shouting", "marks")


def _quality_sql(risk: float = 0.02, delta: float = 0.1) -> str:
    """Counts by list functions and windows; cutoffs by the holdout's two parts and the exact binomial tail."""
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN least(1.0::DOUBLE, {a}::DOUBLE / {b}) ELSE 0.0::DOUBLE END"
    cut = lambda r: f"least(ceil(top_{r} * factor), 1000)"
    return rf"""
        WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        i AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8), h AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS h FROM i),
        f AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS n FROM h) WHERE n > 1),
        r AS (SELECT doc_id, sum(n)::BIGINT AS n FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM f) GROUP BY doc_id),
        c AS (SELECT d.doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
            list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
            length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS upper_chars, length(regexp_replace(t, '[^!?|]+', '', 'g')) AS n_marks FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
        m AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
        q AS (SELECT *, {share('n_symbols', 'word_chars')} AS r_symbols, {share('n_dup_lines', 'len(lines)')} AS r_dup_lines, {share('n_repeat_words', 'n_words')} AS r_repeats,
            {share('upper_chars', 'word_chars')} AS r_shouting, {share('n_marks', 'word_chars')} AS r_marks FROM m),
        x AS (SELECT *, {', '.join(f'greatest(ceil(r_{r} * 1000), 20) AS {r}' for r in _RULES)} FROM q),
        l AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
        o AS (SELECT x.*, left(md5(doc_id::VARCHAR), 1) NOT IN ('0', '1', '2', '3') AS tests FROM x WHERE doc_id IN (SELECT doc_id FROM l)),
        z AS (SELECT stratum, count(*) FILTER (tests) AS n, ln({delta} / (1 + count(*) OVER ())) AS level FROM o GROUP BY stratum),
        p AS (SELECT o.*, stratum AS grp, level FROM o JOIN z USING (stratum) WHERE n * ln(1 - {risk}) <= level UNION ALL SELECT o.*, NULL, level FROM o JOIN z USING (stratum)),
        a AS (SELECT grp, {', '.join(f'quantile_disc({r}, 0.998) AS top_{r}' for r in _RULES)} FROM p WHERE NOT tests GROUP BY grp),
        k AS (SELECT step, factor FROM (VALUES (0, 8.0), (1, 4.0), (2, 2.0), (3, 1.5), (4, 1.25), (5, 1.0)) v(step, factor)),
        e AS (SELECT a.grp, step, {', '.join(f'{cut(r)} AS cut_{r}' for r in _RULES)} FROM a, k),
        b AS (SELECT e.grp, step, any_value(level) AS level, count(*) AS n, count(*) FILTER ({' OR '.join(f'{r} > cut_{r}' for r in _RULES)}) AS lost, {', '.join(f'any_value(cut_{r}) AS cut_{r}' for r in _RULES)}
            FROM p JOIN e ON p.grp IS NOT DISTINCT FROM e.grp WHERE tests GROUP BY e.grp, step),
        y AS (SELECT *, list_sum(list_transform(range(lost + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk}) + (n - j) * ln(1 - {risk})))) AS tail FROM b WHERE lost <= n * {risk}),
        s AS (SELECT * FROM y WHERE ln(tail) <= level QUALIFY row_number() OVER (PARTITION BY grp ORDER BY step DESC) = 1),
        g AS (SELECT p.stratum, {', '.join(f'any_value(cut_{r}) AS cut_{r}' for r in _RULES)} FROM p JOIN s ON s.grp IS NULL WHERE p.grp IS NULL AND p.stratum NOT IN (SELECT grp FROM s WHERE grp IS NOT NULL)
            GROUP BY p.stratum HAVING count(*) FILTER ({' OR '.join(f'{r} > cut_{r}' for r in _RULES)}) <= count(*) * {risk}),
        u AS (SELECT grp AS stratum, {', '.join(f'cut_{r}' for r in _RULES)} FROM s WHERE grp IS NOT NULL UNION ALL SELECT * FROM g)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND NOT ({' OR '.join(f'coalesce({r} > cut_{r}, false)' for r in _RULES)}) AS kept FROM x LEFT JOIN u USING (stratum)"""


def _clustering_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Lloyd's rounds in whole numbers, each one written out; every centroid is compared."""
    away = "list_sum(list_transform(list_zip(v.c, m.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT v.r, any_value(v.c) AS c, arg_min(m.k, {{'d': {away}, 'k': m.k}}) AS k, min({away}) AS d FROM v, m{i} m GROUP BY v.r)")
        if i < rounds:
            sums = f"SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(c) AS x, unnest(range(1, {dims + 1})) AS i FROM a{i}) GROUP BY k, i"
            steps.append(f"s{i} AS MATERIALIZED (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM ({sums}) GROUP BY k)")
            steps.append(f"m{i + 1} AS MATERIALIZED (SELECT m.k, coalesce(s.c, m.c) AS c FROM m{i} m LEFT JOIN s{i} s ON m.k = s.k)")
    return f"""
        WITH e AS (SELECT vec_id, embedding, row_number() OVER () AS r FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= 4503599627370496)) = 0),
        v AS MATERIALIZED (SELECT vec_id, embedding, r, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS c FROM e),
        m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, embedding) - 1 AS k, c FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, embedding, c FROM v ORDER BY h, embedding LIMIT {k})),
        {", ".join(steps)}
        SELECT v.vec_id, a.k::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
            sha256(array_to_string(m.c, ',')) AS centroid_sha256 FROM v JOIN a{rounds} a USING (r) JOIN m{rounds} m ON m.k = a.k"""


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLES: dict[str, str] = {
    "op5_quality_rules": _quality_sql(),
    "op11_centroid_clustering": _clustering_sql(),
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY t)""",
    # exponential keys from the same digest; a source is taken in whole epochs and then by rising key
    "op7_mixing": rf"""
        WITH d AS (SELECT doc_id, source, {_WORDS}::BIGINT AS size, coalesce(text, '') AS t FROM documents),
        k AS (SELECT doc_id, source, size, -ln((('0x' || left(md5('7|' || coalesce(doc_id::VARCHAR, md5(t))), 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
            / (CASE WHEN length(regexp_replace(t, '\s+', '', 'g')) > 0 THEN 1.0::DOUBLE - 0.5::DOUBLE * length(regexp_replace(t, '[\p{{L}}\s]+', '', 'g')) / length(regexp_replace(t, '\s+', '', 'g')) ELSE 0.5::DOUBLE END) AS key FROM d),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 3.0::DOUBLE AS most FROM s),
        v AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST)),
        x AS (SELECT source, source_size, least(most, coalesce(arg_min(level, most / weight) FILTER (level * weight <= most) OVER (), 'inf'::DOUBLE) * weight) AS target FROM v),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM x),
        m AS (SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2 AS mid
            FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
        SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN mid <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM m""",
}

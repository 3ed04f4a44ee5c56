"""N-gram Jaccard join by chosen paths.

A text's set holds the hashes of its runs of ``words`` words. A sketch of
``HASHES`` minimum hashes stands in for the set; its entries are the tokens of
the chosen-path recursion: in every run, a bucket (a path of tokens) of more
than ``bucket`` members is split by tokens that the path's own hash samples with
probability 1 / (threshold * HASHES), so two sets of the wanted similarity are
expected to share a branch at every level. Small buckets are compared by brute
force on sketches; buckets still large at the last level are compared in pairs
of blocks, so no task holds more than two blocks. A comparison leaves a star of
links per cluster in its bucket, not all pairs. Runs are repeated (``runs``)
until the missed share at the threshold falls below 1 - ``recall``.

The stars' connected components bound where links can lie. Inside a component
all pairs are verified on the whole sets: its members are dealt into blocks and
each pair of blocks is one small group. So every link in a component counts,
whichever run found it, and a group with a third of all texts is many tasks.
Only degrees and spanning stars leave a task; pairs are never written out.

Result: one row per document with class_id, the smallest doc_id that verified
links connect it to, rep_id, the smallest doc_id with the very same text,
n_copies, the documents with this text, and n_links, the other texts linked.

Defined cases: words are runs of other than ASCII white space, compared as they
are; a text of fewer words than ``words`` has one run, all its words; a null or
blank text has an empty set and links to nothing, but equal ones are copies.
Null and empty texts are the same text. A null doc_id never becomes a class id
while the class has another. Repeated rows are copies. Other columns are not
read; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapframe.llm.common import packed, text_of
from lapframe.llm.filters import may_be_among
from lapframe.llm.grouping import Forest, connected_components, whole_groups
from lapframe.session import materialize

HASHES = 64
#: How far below the threshold a sketch may fall: four standard deviations of its estimate.
SLACK = 4 * math.sqrt(0.8 * 0.2 / HASHES)
_MULTIPLY, _ADD = (lambda r: (r.integers(1, 2**32, HASHES, dtype=np.uint32) | np.uint32(1), r.integers(0, 2**32, HASHES, dtype=np.uint32)))(np.random.default_rng(20))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words."""
    found = text.split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def sketch(items: np.ndarray) -> np.ndarray:
    low = (items ^ (items >> np.uint64(32))).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), 2048):
        part = low[a : a + 2048, None] * _MULTIPLY + _ADD
        part ^= part >> np.uint32(15)
        best = np.minimum(best, (part * np.uint32(0x2C1B3C6D)).min(axis=0))
    return best


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, rows = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                raw = text.as_py()
                items = shingles(raw, words)
                node.append(hashlib.md5(raw).digest())
                n.append(len(items))
                rows.append(sketch(items).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "node", "n", "sketch"])

    return run


def _as_matrix(col: pa.Array, dtype=np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(len(col), -1)


def _children(runs: int, level: int, threshold: float):
    """Paths of the next level; at the first one, of every run."""
    limit = np.uint64(int(2**64 / (threshold * HASHES)))
    place = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) << np.uint64(32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = mix64(_as_matrix(batch.column("sketch")).astype(np.uint64) ^ place)
            roots = [np.full(len(tokens), r, np.uint64) for r in range(runs)] if level == 1 else [batch.column("path").to_numpy().view(np.uint64)]
            for root in roots:
                path = mix64(tokens ^ mix64(root + np.uint64(level << 40))[:, None])
                row, token = np.nonzero(mix64(path) < limit)
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(row)), pa.array(path[row, token].view(np.int64))], ["node", "path"])

    return run


def _stars(least: float):
    """Links of each bucket: sketches that agree in ``least`` of their entries, as a star per cluster.

    A pair of blocks tells only which clusters of one block meet which of the other: each
    block's own clusters come from the group in which it is alone. So a bucket of b blocks
    leaves a star for each member once, not b times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["path", "lo", "hi"]):
            node, block = rows.column("node").to_pylist(), rows.column("block").to_numpy()
            lo, hi = rows.column("lo").to_numpy(), rows.column("hi").to_numpy()
            sketches = _as_matrix(rows.column("sketch").combine_chunks())
            a, b = [], []
            for i, j in zip(starts, [*starts[1:], len(node)], strict=True):
                if j - i == 2:
                    if (sketches[i] == sketches[i + 1]).mean() >= least:
                        a.append(node[i + 1]), b.append(node[i])
                elif j - i > 2:
                    own, forest, across = sketches[i:j], Forest(j - i), []
                    for k in range(j - i - 1):
                        for other in np.flatnonzero((own[k + 1 :] == own[k]).mean(axis=1) >= least):
                            at = k + 1 + int(other)
                            if block[i + k] == block[i + at]:
                                forest.join(k, at)
                            else:
                                across.append((k, at))
                    if lo[i] == hi[i]:
                        links = forest.stars()
                    else:
                        links = [(x, y) for x, y in across if forest.root(x) != forest.root(y) and forest.join(x, y) is None]
                    for x, y in links:
                        a.append(node[i + x]), b.append(node[i + y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [shingles(t.as_py(), words).tobytes() for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("component"), batch.column("blocks"), pa.array(items, pa.binary())], ["node", "component", "blocks", "items"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, by blocks of shared items."""
    n = len(sets)
    items, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    first = np.r_[True, items[1:] != items[:-1]]
    number = np.cumsum(first) - 1
    shared = np.bincount(number)[number] > 1
    owner, number = owner[shared], np.cumsum(first[shared]) - 1
    out = np.zeros((n, n), np.float32)
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, 2048):
        i, j = np.searchsorted(number, [a, a + 2048])
        has = np.zeros((n, 2048), np.float32)
        has[owner[i:j], number[i:j] - a] = 1
        out += has @ has.T
    return out.astype(np.int64)


def smallest_linked(linked: np.ndarray) -> np.ndarray:
    """The smallest member that links connect each member to."""
    label = np.arange(len(linked), dtype=np.int32)
    while True:
        near = np.where(linked, label[None, :], np.int32(len(linked))).min(axis=1)
        least = np.minimum(label, near)
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def _verify(threshold: float):
    """Per group of one or two blocks: each member's links that this group answers for, and a star per cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["component", "lo", "hi"]):
            node, block = rows.column("node").to_pylist(), rows.column("block").to_numpy()
            lo, hi = rows.column("lo").to_numpy(), rows.column("hi").to_numpy()
            raw = rows.column("items").combine_chunks()
            out: list[tuple] = []
            for i, j in zip(starts, [*starts[1:], len(node)], strict=True):
                if j - i < 2:
                    continue
                sets = [np.frombuffer(raw[k].as_py(), np.uint64) for k in range(i, j)]
                size = np.array([len(s) for s in sets])
                both = overlaps(sets)
                linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
                np.fill_diagonal(linked, False)
                if lo[i] != hi[i]:  # pairs inside one block belong to that block's own group
                    linked &= block[i:j, None] != block[None, i:j]
                out += [(node[i + k], None, int(d)) for k, d in enumerate(linked.sum(axis=1)) if d]
                first = smallest_linked(linked)
                out += [(node[i + k], node[i + int(first[k])], 0) for k in np.flatnonzero(first != np.arange(j - i)).tolist()]
            a, b, d = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(d, pa.int64())], ["a", "b", "degree"])

    return run


def runs_needed(threshold: float, levels: int, recall: float) -> int:
    """Runs after which a pair at the threshold is missed with probability of at most 1 - ``recall``.

    Two sketches share a binomial number of entries, the same in all runs. Given that number, the branches that the
    sets share form a branching process with a Poisson number of children. A pair whose sketches agree in too few
    entries for the slack is missed by all runs.
    """
    weight, miss = [], []
    for shared in range(HASHES + 1):
        weight.append(math.comb(HASHES, shared) * threshold**shared * (1 - threshold) ** (HASHES - shared))
        alive, children = 1.0, shared / (threshold * HASHES)
        for _ in range(levels):
            alive = 1 - math.exp(-children * alive)
        miss.append(1 - alive if shared >= (threshold - SLACK) * HASHES else 1.0)
    if sum(w for w, m in zip(weight, miss, strict=True) if m == 1.0) > 1 - recall:
        raise ValueError("no number of runs reaches that recall with so few hashes")
    runs = 1
    while sum(w * m**runs for w, m in zip(weight, miss, strict=True)) > 1 - recall:
        runs += 1
    return runs


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, rep_id, n_copies, n_links for every row; the options are those of :func:`classes`."""
    return classes(docs, **options).select("doc_id", "class_id", "rep_id", "n_copies", "n_links")


def classes(docs: DataFrame, words: int = 5, threshold: float = 0.8, bucket: int = 256, levels: int = 3, recall: float = 0.999) -> DataFrame:
    """doc_id, node (the text's MD5), component (one node of its class), class_id, rep_id, n_copies, n_links for every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    sketched = materialize(texts.mapInArrow(_sketches(words), "doc_id long, node binary, n long, sketch binary"), "join-sketches")
    # a class of equal texts is one node from here on; copies are counted before anything is joined
    nodes = materialize(sketched.groupBy("node").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("n_copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "join-nodes")
    stars = _candidate_stars(nodes.where("n > 0").select("node", "sketch"), threshold, bucket, levels, runs_needed(threshold, levels, recall))
    found = connected_components(stars)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    placed = found.join(sizes, "component").join(nodes.select("node", "rep_id"), "node")
    # each block meets each other one, so what is sent falls with their size; the largest components have larger ones
    block = F.when(F.col("members") > 64 * bucket, 8 * bucket).otherwise(bucket)
    placed = materialize(placed.select(F.col("node").alias("key"), "rep_id", "component", F.ceil(F.col("members") / block).cast("int").alias("blocks")), "join-placed")
    keyed = texts.withColumn("node", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    keyed = may_be_among(keyed, F.xxhash64("doc_id", "node"), placed, F.xxhash64("rep_id", "key"))
    wanted = keyed.join(placed, keyed["doc_id"].eqNullSafe(placed["rep_id"]) & (keyed["node"] == placed["key"])).select("node", "component", "blocks", "text")
    sets = materialize(wanted.mapInArrow(_sets(words), "node binary, component binary, blocks int, items binary").dropDuplicates(["node"]), "join-sets")
    checked = sets.transform(_in_block_pairs, "component").mapInArrow(_verify(threshold), "a binary, b binary, degree long")
    checked = materialize(checked, "join-checked")
    links = checked.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("degree").alias("n_links"))
    classes = connected_components(checked.where("b is not null").select("a", "b"))
    named = nodes.select("node", "rep_id", "n_copies").join(classes, "node", "left").join(links, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep_id").alias("class_id"))
    named = materialize(named.join(least, "component").select("node", "component", "class_id", "rep_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "join-classes")
    return sketched.select("doc_id", "node").join(named, "node").select("doc_id", "node", "component", "class_id", "rep_id", "n_copies", "n_links")


def _candidate_stars(nodes: DataFrame, threshold: float, bucket: int, levels: int, runs: int) -> DataFrame:
    """The recursion: a and b of stars that the buckets of all runs leave."""
    members, leaves = None, None
    for level in range(1, levels + 1):
        source = nodes if level == 1 else members.join(nodes, "node")
        paths = materialize(source.mapInArrow(_children(runs, level, threshold), "node binary, path long"), "join-paths")
        sizes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        sized = materialize(paths.join(sizes, "path"), "join-buckets")
        done = sized if level == levels else sized.where(F.col("members") <= bucket)
        done = done.select("node", "path", F.ceil(F.col("members") / bucket).cast("int").alias("blocks"))
        leaves = done if leaves is None else leaves.unionByName(done)
        members = sized.where(F.col("members") > bucket).select("node", "path")
        if level < levels and members.isEmpty():
            break
    grouped = leaves.join(nodes, "node").transform(_in_block_pairs, "path")
    return materialize(grouped.mapInArrow(_stars(threshold - SLACK), "a binary, b binary").distinct(), "join-stars")


def _in_block_pairs(rows: DataFrame, group: str) -> DataFrame:
    """Deal the members of a group into its ``blocks`` and send each block to every pair (lo, hi) it is part of."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "blocks")
    return pairs.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi", "node")


def one_per_class(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id (null last), then of the smallest MD5 of its text.

    A class is known by its texts, so different texts under one doc_id, or none, are each in their own class.
    """
    first = classes(docs, **options).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("x"))
    keep = first.select(F.col("x.doc_id").alias("keep_id"), F.col("x.node").alias("keep_node"))
    rows = packed(docs, id=F.col("doc_id").cast("long"), node=F.unhex(F.md5(F.encode(text_of(), "UTF-8"))))
    stays = rows.join(keep, rows["id"].eqNullSafe(keep["keep_id"]) & (rows["node"] == keep["keep_node"]), "left_semi")
    return stays.dropDuplicates(["id", "node"]).select("row.*")

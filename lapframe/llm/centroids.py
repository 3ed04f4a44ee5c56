"""Centroid clustering (Lloyd's rounds in whole numbers) by annulus search.

A component x becomes floor(1024 * x). Centroids are sorted by norm. A vector's
upper bound u is its exact distance to the nearer of the two centroids whose
norms lie next to its own; whatever is as near has a norm within u of the
vector's, by the triangle inequality. Two binary searches give these centroids,
and only they are compared, in exact whole numbers. The annulus is widened by
more than the rounding of its norms, so a centroid on its border takes part and
ties go to the smaller number.

A round is one pass over the vectors: tasks keep one sum per centroid and
component, Spark adds them, and k * dims sums reach the driver, which has the
next centroids after exact floor divisions. Bounds come from the norms alone,
so no state of a vector is carried between rounds: nothing is written before the
last assignment, and a lost executor repeats its tasks of one round.

Defined cases: a vector takes part if it has exactly ``dims`` components, none
of them null, NaN or of a magnitude from 2**52 on (infinite ones included, their
squares fit no long); others give no row. A null vec_id is a vector like any
other, with an empty decimal. Repeated rows count each; of vectors whose vec_id
hashes alike the smaller one is first. With fewer vectors than ``k`` each is a
centroid; no vectors give no rows. A centroid that loses all vectors stays. A
distance or sum beyond a long is null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapframe.session import materialize

SCALE = 1024
MOST = 2**63 - 1
_PAIRS = 1 << 15  # vectors beside candidates that are compared at once


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of each component, as doubles, which hold it exactly."""
    return np.floor(x.astype(np.float64) * SCALE)


class Annulus:
    """Nearest centroids: sorted norms, binary searches, exact comparison of what lies between."""

    def __init__(self, centroids: list[list[int]]):
        norms = [float(sum(c * c for c in row)) ** 0.5 for row in centroids]
        self.number = np.array(sorted(range(len(norms)), key=lambda i: (norms[i], i)))
        self.norm = np.array(norms)[self.number]
        self.rows = np.array(centroids, dtype=object)[self.number]
        self.largest = max((abs(c) for row in centroids for c in row), default=0)
        self.as_type = {object: self.rows}

    def _typed(self, kind) -> np.ndarray:
        if kind not in self.as_type:
            self.as_type[kind] = self.rows.astype(kind)
        return self.as_type[kind]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) for rows of whole numbers."""
        if not len(vectors):
            return np.empty(0, np.int64), np.empty(0, object)
        largest = max(self.largest, float(np.abs(vectors).max()))
        room = 64 / max(1, vectors.shape[1])  # squared sums stay below 2**53 or 2**62
        kind = np.float64 if largest <= 2**22 * room**0.5 else np.int64 if largest <= 2**26 * room**0.5 else object
        x = vectors.astype(kind) if kind is not object else vectors.astype(np.int64).astype(object)
        c = self._typed(kind)
        norm = np.sqrt((vectors * vectors).sum(axis=1))
        at = np.searchsorted(self.norm, norm)
        above, below = np.minimum(at, len(c) - 1), np.maximum(at - 1, 0)
        bound = np.minimum(_squared(x, c[above]), _squared(x, c[below]))
        u = np.sqrt(bound.astype(np.float64))
        wide = u + 1e-9 * (norm + u + self.norm[-1]) + 1e-9
        first, end = np.searchsorted(self.norm, norm - wide, "left"), np.searchsorted(self.norm, norm + wide, "right")
        upto = np.cumsum(end - first)
        number, distance = np.empty(len(x), np.int64), np.empty(len(x), kind)
        a = 0
        while a < len(x):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + _PAIRS, "right")))
            number[a:b], distance[a:b] = self._exact(x[a:b], c, first[a:b], end[a:b])
            a = b
        return number, distance

    def _exact(self, x: np.ndarray, c: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        many = end - first
        starts = np.cumsum(many) - many
        row = np.repeat(np.arange(len(x)), many)
        candidate = np.arange(len(row)) - np.repeat(starts - first, many)
        found = _squared(x[row], c[candidate])
        least = np.minimum.reduceat(found, starts)
        tied = np.where(found == least[row], self.number[candidate], len(c))
        return np.minimum.reduceat(tied, starts), least


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return (gap * gap).sum(axis=1)


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return whole_numbers(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))


def _sums(centroids: list[list[int]], dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annulus = Annulus(centroids)
        total, many = np.zeros((len(centroids), dims), object), np.zeros(len(centroids), np.int64)
        for batch in batches:
            vectors = _rows(batch, dims)
            number, _ = annulus.nearest(vectors)
            exact = vectors if not len(vectors) or np.abs(vectors).max() * len(vectors) < 2**53 else vectors.astype(np.int64).astype(object)
            for k in np.unique(number):
                own = exact[number == k].sum(axis=0)
                total[k] += [int(v) for v in own]
                many[k] += int((number == k).sum())
        own = np.flatnonzero(many)
        sums = pa.array([[Decimal(v) for v in total[k]] for k in own], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(many[own]), sums], ["cluster", "n", "sums"])

    return run


def _assign(centroids: list[list[int]], dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annulus = Annulus(centroids)
        for batch in batches:
            number, distance = annulus.nearest(_rows(batch, dims))
            longs = pa.array([int(d) if d <= MOST else None for d in distance] if distance.dtype == object else distance.astype(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number, pa.int32()), longs], ["vec_id", "cluster", "distance"])

    return run


def kept(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id and embedding of the vectors that take part."""
    fit = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float(2**52))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).where((F.size("embedding") == dims) & F.coalesce(fit, F.lit(False)))


def first_centroids(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The ``k`` kept vectors with the smallest hashes of ``salt`` and vec_id."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = vectors.select(key.alias("key"), "embedding").orderBy("key", "embedding").limit(k).collect()
    return [[int(v) for v in whole_numbers(np.array(r["embedding"]))] for r in found]


def moved(vectors: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """The centroids after one round: floored means of their vectors; an empty one stays."""
    parts = vectors.select("embedding").mapInArrow(_sums(centroids, dims), "cluster int, n long, sums array<decimal(38,0)>")
    cells = parts.select("cluster", "n", F.posexplode("sums").alias("at", "part")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
    out = [list(c) for c in centroids]
    for r in cells.collect():  # at most k * dims
        out[r["cluster"]][r["at"]] = int(r["total"]) // r["n"]
    return out


def _long(total: Column, whole: Column) -> Column:
    return F.when(whole & (total <= F.lit(Decimal(MOST))), total.cast("long"))


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, salt: str = "3:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (components) for every kept vector."""
    spark, own = vectors.sparkSession, kept(vectors, dims)
    centroids = first_centroids(own, k, salt)
    for _ in range(rounds if centroids else 0):
        before, centroids = centroids, moved(own, centroids, dims)
        if centroids == before:  # further rounds change nothing
            break
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    assigned = materialize(own.mapInArrow(_assign(centroids, dims), "vec_id long, cluster int, distance long"), "centroid-assigned")
    exact = F.col("distance").cast("decimal(38,0)")
    sums = assigned.groupBy("cluster").agg(F.sum(exact).alias("own"), (F.count("distance") == F.count(F.lit(1))).alias("whole")).collect()  # at most k
    everything, whole = sum(r["own"] or 0 for r in sums), all(r["whole"] for r in sums)
    fits = lambda v, known: int(v) if known and v <= MOST else None
    rows = [(r["cluster"], fits(r["own"] or 0, r["whole"]), fits(everything, whole), centroids[r["cluster"]]) for r in sums]
    figures = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return assigned.join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def with_digest(clustered: DataFrame) -> DataFrame:
    """The centroid's components as the digest of their decimals joined by commas."""
    text = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return clustered.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text, 256).alias("centroid_sha256"))


def digest_of(components: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, components)).encode()).hexdigest()

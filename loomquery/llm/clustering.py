"""Centroid clustering (Lloyd's rounds in whole numbers) with block-norm screening.

A vector is compressed to the norms of its SEGMENTS segments, computed once and stored beside it. For vector x and centroid c, Cauchy-Schwarz in each segment gives
|x - c|^2 >= |x|^2 + |c|^2 - 2 * sum over segments of |x_s| |c_s|. Norms are rounded up to whole numbers, so this bound is exact arithmetic too and never exceeds the distance.
Each vector's most promising centroid gets an exact distance first; every other centroid does only while its bound does not exceed the best distance so far.

A round is one pass over the stored vectors: tasks return, for each cluster, the number of vectors and the sums of their components, in limbs of LIMB bits, which Spark adds up. What
reaches the driver is k centroids, whatever the table's size.

Defined results: vectors that are null, have another length, or hold null or non-finite components are left out (as are those whose scaled component leaves a double's range);
components of any other size are exact, and a distance or sum that no long holds is null; null ids are hashed as '' and come last among equal hashes, rows that repeat are vectors of their own; fewer
vectors than k give fewer clusters; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, discard, give_back, map_batches, materialize, ship_package, table

K = 8
DIMS = 64
ROUNDS = 10
SEED = 3
SCALE = 1024
SEGMENTS = 8
LIMB = 40
#: Components below this keep squares and bounds within 64 bits; others are Python's whole numbers.
NARROW = 1 << 27
LONG = 1 << 63


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """Integral doubles as integers of 64 bits, or of any size where they are large."""
    if not values.size or np.abs(values).max() < NARROW:
        return values.astype(np.int64)
    return np.frompyfunc(int, 1, 1)(values)


def roots_up(squares: np.ndarray) -> np.ndarray:
    """Square roots, rounded up."""
    if squares.dtype == object:
        return np.frompyfunc(lambda s: math.isqrt(s) + (math.isqrt(s) ** 2 < s), 1, 1)(squares)
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    r += (r + 1) * (r + 1) <= squares
    return r + (r * r < squares)


def segment_norms(x: np.ndarray, segments: int) -> np.ndarray:
    """Norm of each segment of each row, rounded up; segments are runs of components, as even as they can be."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)[:-1]
    return roots_up(np.add.reduceat(x * x, cuts, axis=1))


class Centroids:
    """Centroids with their norms, and the screened search for the nearest."""

    def __init__(self, x: np.ndarray, segments: int = SEGMENTS):
        self.x, self.norms, self.squares = x, segment_norms(x, segments), (x * x).sum(axis=1)

    def nearest(self, x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(centroid, squared distance, exact distances computed) for each row; of equal distances the smaller centroid's number."""
        low = (x * x).sum(axis=1)[:, None] + self.squares[None, :] - 2 * (norms @ self.norms.T)
        number = low.argmin(axis=1)
        best, exact = ((x - self.x[number]) ** 2).sum(axis=1), len(x)
        first = number.copy()
        for j in range(len(self.x)):
            rows = np.flatnonzero((low[:, j] <= best) & (first != j))
            if not len(rows):
                continue
            exact += len(rows)
            d = ((x[rows] - self.x[j]) ** 2).sum(axis=1)
            nearer = (d < best[rows]) | ((d == best[rows]) & (j < number[rows]))
            best[rows[nearer]], number[rows[nearer]] = d[nearer], j
        return number, best, exact


def usable(embedding: Column, dims: int) -> Column:
    """Of the asked length, without null or non-finite components."""
    return F.coalesce((F.size(embedding) == dims) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < float("inf"))), F.lit(False))


def compress(embeddings: DataFrame, dims: int = DIMS, seed: int = SEED, segments: int = SEGMENTS) -> DataFrame:
    """vec_id, key (hash that orders first centroids), v (scaled components, integral doubles), norms (of segments, rounded up): the vectors that take part."""
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    e = e.where(usable(F.col("x"), dims)).select("vec_id", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("key"), "x")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = np.floor(batch.column(2).flatten().to_numpy() * SCALE) + 0.0
        norms = segment_norms(whole_numbers(v.reshape(-1, dims)), segments)
        # A norm beyond 53 bits must not be rounded down: the next double is no smaller.
        norms = np.array([math.nextafter(float(n), math.inf) if n >= 1 << 53 else float(n) for n in norms.ravel().tolist()])
        lists = lambda x, width: pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, width), pa.int32()), pa.array(x))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(v, dims), lists(norms, min(segments, dims))], ["vec_id", "key", "v", "norms"])

    return map_batches(e, work, "vec_id long, key string, v array<double>, norms array<double>")


def _parts(batches, dims: int):
    """(ids, components, norms) of some hundred vectors at a time."""
    for b in batches:
        for a in range(0, b.num_rows, 4 * BATCH_ROWS):
            part = b.slice(a, 4 * BATCH_ROWS)
            n = part.num_rows
            yield part.column(0), whole_numbers(part.column(1).flatten().to_numpy().reshape(n, dims)), whole_numbers(part.column(2).flatten().to_numpy().reshape(n, -1))


def limbs(n: int) -> list[int]:
    """n = sum of limb i times 2^(LIMB i); all but the last are not negative."""
    out = []
    while not -(1 << LIMB) <= n < 1 << LIMB:
        out.append(n & ((1 << LIMB) - 1))
        n >>= LIMB
    return [*out, n]


def cluster_sums(vectors: DataFrame, centroids: Centroids, dims: int) -> dict[int, tuple[int, list[int]]]:
    """For each cluster that has vectors: their number, and the sum of each component."""

    def work(batches):
        k = len(centroids.x)
        total = np.zeros((k, dims + 1), object)
        for _, x, norms in _parts(batches, dims):
            number, _, _ = centroids.nearest(x, norms)
            for j in np.unique(number).tolist():
                own = x[number == j]
                total[j, :dims] += own.sum(axis=0).astype(object)
                total[j, dims] += len(own)
        rows = [(j, i, at, limb) for j in range(k) if total[j, dims] for i in range(dims + 1) for at, limb in enumerate(limbs(int(total[j, i])))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "place", "limb", "value"])
        give_back()

    parts = vectors.select("vec_id", "v", "norms").mapInArrow(work, "cluster int, place int, limb int, value long")
    out: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "place", "limb").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r.cluster, [0] * (dims + 1))[r.place] += r.value << (LIMB * r.limb)
    return {j: (sums[dims], sums[:dims]) for j, sums in out.items()}


def exact_integers(rows: list[list[int]], dims: int) -> np.ndarray:
    """Centroids as an array: of 64 bits if all are small."""
    wide = any(abs(v) >= NARROW for r in rows for v in r)
    return np.array(rows, object if wide else np.int64).reshape(len(rows), dims)


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, segments: int = SEGMENTS) -> Centroids:
    """k centroids after the rounds. vectors: as by compress(), stored."""
    first = vectors.orderBy("key", F.col("vec_id").asc_nulls_last(), "v").limit(k).select("v").collect()
    centroids = Centroids(exact_integers([[int(x) for x in r.v] for r in first], dims), segments)
    for _ in range(rounds if first else 0):
        found = cluster_sums(vectors, centroids, dims)
        moved = [[s // found[j][0] for s in found[j][1]] if j in found else c for j, c in enumerate(centroids.x.tolist())]
        centroids = Centroids(exact_integers(moved, dims), segments)
    return centroids


def assign(vectors: DataFrame, centroids: Centroids, dims: int = DIMS) -> DataFrame:
    """vec_id, cluster, distance (squared; null beyond a long)."""

    def work(batches):
        for ids, x, norms in _parts(batches, dims):
            number, distance, _ = centroids.nearest(x, norms)
            distance = pa.array([d if d < LONG else None for d in distance.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), distance], ["vec_id", "cluster", "distance"])
        give_back()

    ship_package(vectors.sparkSession)
    return vectors.select("vec_id", "v", "norms").mapInArrow(work, "vec_id long, cluster int, distance long")


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED, segments: int = SEGMENTS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row for each vector that takes part."""
    spark = embeddings.sparkSession
    vectors = materialize(compress(embeddings, dims, seed, segments), "cluster_vectors")
    centroids = fit(vectors, k, rounds, dims, segments)
    assigned = materialize(assign(vectors, centroids, dims), "cluster_assigned")
    discard(vectors)
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    by_cluster = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(total.alias("s")).collect()}
    fits = lambda s: None if s is None or s >= LONG else int(s)
    whole = None if None in by_cluster.values() else sum(by_cluster.values())
    rows = [(j, fits(s), fits(whole), hashlib.sha256(",".join(map(str, centroids.x[j].tolist())).encode()).hexdigest()) for j, s in by_cluster.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most k rows


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """Lloyd's rounds, one pair of tables each, with every distance computed."""
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding::DOUBLE[], lambda x: floor({SCALE} * x)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {DIMS})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, vec_id))::INT - 1 AS j, x FROM (SELECT sha256('{SEED}:' || vec_id) AS h, vec_id, x FROM v ORDER BY 1, 2 LIMIT {K}))",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"d{i} AS MATERIALIZED (SELECT r, vec_id, j, v.x, list_sum(list_transform(list_zip(v.x, c{i}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i})")
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, j, x, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1)")
        if i < ROUNDS:
            steps.append(f"s{i} AS (SELECT j, p, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT j, unnest(x) AS e, unnest(generate_series(1, {DIMS})) AS p FROM a{i}) GROUP BY j, p)")
            steps.append(f"m{i} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY p) AS x FROM s{i} GROUP BY j)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.j, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} ON m{i}.j = c{i}.j)")
    last = f"SELECT vec_id, a{ROUNDS}.j::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a{ROUNDS}.j)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{ROUNDS}.x, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.j = a{ROUNDS}.j"
    return "WITH " + ",\n".join(steps) + "\n" + last


QUERIES = {"op12_centroid_clusters": op12_centroid_clusters}
ORACLES = {"op12_centroid_clusters": _oracle()}

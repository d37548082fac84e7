"""A partitioned vector index: coarse lists, residual codes, exact rescoring.

Coarse centroids are fitted on a sample of at most SAMPLE vectors (those whose ids have the smallest hashes); every vector is indexed. It goes to the list of its nearest centroid, and what the
centroid leaves over is stored as int8 codes with a step and the length of the error. Lists are folders, so a search reads the codes of probed lists alone; a list of any size is
cut into parts of about LIST_ROWS rows.

A search takes for each query the ``probes`` lists whose centroids lie nearest. Codes and error lengths bound each inner product from both sides (Cauchy-Schwarz), so only vectors that may be among the
first k of the probed lists are read whole and scored exactly. With all lists probed the result is that of ``retrieval.vector_topk``; with fewer it is exact over what was probed, and the recall is a matter of data:
``recall`` measures it.

Defined results: null vectors, and those that hold a null, aren't indexed and find nothing; vectors of several lengths are an error; rows that repeat an id are vectors of their own; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..operators.retrieval import _matrix, one_length, top
from .shared import stored

SAMPLE = 16_384
MAX_LISTS = 4_096
ROUNDS = 10
LIST_ROWS = 65_536
#: Queries that meet a part of a list in one task.
QUERIES = 1_024
#: Above the rounding of double arithmetic on vectors of ordinary size.
ROUNDING = 1e-9


def fit_lists(sample: np.ndarray, n_lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of at most n_lists lists: Lloyd's rounds from vectors spread over the sample; a list that loses all its vectors keeps its centroid."""
    centroids = sample[np.unique(np.linspace(0, len(sample) - 1, min(n_lists, len(sample))).astype(int))].copy()
    for _ in range(rounds):
        near = nearest_lists(sample, centroids, 1)[:, 0]
        sums, n = np.zeros_like(centroids), np.bincount(near, minlength=len(centroids))
        np.add.at(sums, near, sample)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def nearest_lists(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, the nearest first."""
    far = (centroids**2).sum(axis=1)[None, :] - 2 * (x @ centroids.T)
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def encode(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(list, int8 codes, step, length of the error, rounded up) of each row."""
    near = nearest_lists(x, centroids, 1)[:, 0]
    rest = x - centroids[near]
    step = np.maximum(np.abs(rest).max(axis=1, initial=0.0) / 127, np.finfo(float).tiny)
    code = np.rint(rest / step[:, None])
    error = np.sqrt(((rest - step[:, None] * code) ** 2).sum(axis=1)) * (1 + 1e-12) + ROUNDING
    return near, code.astype(np.int8), step, error


def build_index(vectors: DataFrame, path: str, n_lists: int | None = None) -> None:
    """The index of (chunk_id, v) at path: ``centroids``, ``codes`` by list and ``vectors`` by list. n_lists: the square root of the number of vectors if not given, MAX_LISTS at most."""
    spark, size = vectors.sparkSession, one_length(vectors)
    whole = vectors.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())).select("chunk_id", F.col("v").cast("array<double>").alias("v"))
    n = whole.count()
    n_lists = min(MAX_LISTS, n_lists or max(1, round(n**0.5)))
    sample = whole.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).select("v").toArrow()
    centroids = fit_lists(_matrix(sample.column("v")), n_lists) if n else np.zeros((1, size or 1))

    def work(batches):
        for b in batches:
            if b.num_rows:
                near, code, step, error = encode(_matrix(b.column(1)), centroids)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *b.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(step), pa.array(error)], ["list", "chunk_id", "v", "code", "step", "error"])

    kind = whole.schema["chunk_id"].dataType.simpleString()
    coded = stored(whole.mapInArrow(work, f"list int, chunk_id {kind}, v array<double>, code binary, step double, error double").withColumn("row", F.monotonically_increasing_id()), "coded")
    sizes = {r["list"]: -(-r["n"] // LIST_ROWS) for r in coded.groupBy("list").agg(F.count("*").alias("n")).collect()}  # MAX_LISTS at most
    rows = [(i, max(1, sizes.get(i, 1)), c.tolist()) for i, c in enumerate(centroids)]
    lists = spark.createDataFrame(rows, "list int, parts int, c array<double>")
    lists.coalesce(1).write.parquet(f"{path}/centroids")
    placed = coded.join(lists.select("list", "parts"), "list").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    for name, columns in (("codes", ("chunk_id", "row", "code", "step", "error")), ("vectors", ("row", "v"))):
        placed.select("list", "part", *columns).repartition("list", "part").write.partitionBy("list").parquet(f"{path}/{name}")


class VectorIndex:
    """A built index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        held = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # MAX_LISTS at most
        self.centroids, self.parts = np.array([r["c"] for r in held]), [r["parts"] for r in held]

    @property
    def n_lists(self) -> int:
        return len(self.centroids)

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """query_id, q, list, part, turn (which of the tasks of a part) of the lists that each query probes."""
        centroids, parts = self.centroids, np.array(self.parts)

        def work(batches):
            for b in batches:
                if b.num_rows:
                    near = nearest_lists(_matrix(b.column(1)), centroids, probes)
                    at = np.repeat(np.arange(len(near)), near.shape[1])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(near.ravel().astype(np.int32)), pa.array(parts[near.ravel()].astype(np.int32))], ["query_id", "q", "list", "parts"])

        kind = queries.schema["query_id"].dataType.simpleString()
        asked = queries.select("query_id", F.col("v").cast("array<double>").alias("q")).mapInArrow(work, f"query_id {kind}, q array<double>, list int, parts int")
        turns = max(1, -(-queries.count() // QUERIES))
        return asked.select("query_id", "q", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int").alias("turn"))

    def search(self, queries: DataFrame, k: int = fx.POOL, probes: int | None = None) -> DataFrame:
        """query_id, chunk_id, score, rank by inner product of (query_id, v) with the vectors of the ``probes`` nearest lists; of all lists without a number."""
        size = one_length(queries)
        kinds = queries.schema["query_id"].dataType.simpleString(), self.spark.read.parquet(f"{self.path}/codes").schema["chunk_id"].dataType.simpleString() if sum(self.parts) else "long"
        if size is not None and size != self.centroids.shape[1]:
            raise ValueError(f"queries have {size} components, the index {self.centroids.shape[1]}")
        queries = queries.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
        asked = stored(self.probed(queries, min(probes or self.n_lists, self.n_lists)), "probed")
        lists = [r["list"] for r in asked.select("list").distinct().collect()]  # MAX_LISTS at most
        centroids = self.centroids

        def bound(key, left, right):
            names = ["query_id", "list", "row", "chunk_id", "low", "high"]
            if not left.num_rows or not right.num_rows:
                return pa.table([pa.array([], t) for t in (right.schema.field("query_id").type, pa.int32(), pa.int64(), left.schema.field("chunk_id").type, pa.float64(), pa.float64())], names=names)
            codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.int8).reshape(left.num_rows, -1).astype(np.float64) * left.column("step").to_numpy()[:, None]
            error, out = left.column("error").to_numpy(), []
            q = _matrix(right.column("q"))
            norm = np.sqrt((q * q).sum(axis=1)) * (1 + 1e-12)
            at_list = key[0].as_py()
            for i in range(len(q)):
                near, off = q[i] @ centroids[at_list] + codes @ q[i], norm[i] * error + ROUNDING
                bar = np.partition(near - off, len(near) - k)[len(near) - k] if len(near) > k else -np.inf
                rows = np.flatnonzero(near + off >= bar)
                out.append((rows, near[rows] - off[rows], near[rows] + off[rows]))
            rows, low, high = (np.concatenate(c) for c in zip(*out, strict=True))
            query = right.column("query_id").take(pa.array(np.repeat(np.arange(len(q)), [len(o[0]) for o in out])))
            return pa.table([query, pa.array(np.full(len(rows), at_list, np.int32)), left.column("row").take(pa.array(rows)), left.column("chunk_id").take(pa.array(rows)), pa.array(low), pa.array(high)], names=names)

        turns = asked.select("list", "part", "turn").distinct()
        codes = self.spark.read.parquet(f"{self.path}/codes").where(F.col("list").isin(lists)).join(turns, ["list", "part"]).select(F.col("list").alias("l"), F.col("part").alias("p"), F.col("turn").alias("t"), "row", "chunk_id", "code", "step", "error")
        found = codes.groupBy("l", "p", "t").cogroup(asked.groupBy("list", "part", "turn")).applyInArrow(bound, f"query_id {kinds[0]}, list int, row long, chunk_id {kinds[1]}, low double, high double")
        found = stored(found, "bounded")
        bar = top(found, "query_id", k, F.col("low").desc(), F.col("row")).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("low")).alias("bar"))
        open_rows = found.join(bar, "query_id").where("bar is null or high >= bar").select("query_id", "list", "row", "chunk_id")
        whole = self.spark.read.parquet(f"{self.path}/vectors").where(F.col("list").isin(lists)).select("list", "row", "v")
        product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        scored = open_rows.join(whole, ["list", "row"]).join(queries.select("query_id", F.col("v").cast("array<double>").alias("q")), "query_id").select("query_id", "chunk_id", product.alias("score"))
        return top(scored, "query_id", k, F.round("score", 9).desc(), F.col("chunk_id"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of rows (query_id, chunk_id) of an exact search that another found."""
    n = exact.count()
    return exact.join(found, ["query_id", "chunk_id"], "left_semi").count() / n if n else 1.0

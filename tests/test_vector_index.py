"""The partitioned vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from loomquery.operators import retrieval
from loomquery.sources import vector_index

V = "chunk_id long, v array<float>"


def rows(df):
    return sorted((r.query_id, r.chunk_id, round(r.score, 7), r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(15, 24))
    data = [(i, [float(np.float32(x)) for x in centres[rng.integers(15)] + 0.4 * rng.normal(size=24)]) for i in range(700)]
    data += [(1000 + i, data[3][1]) for i in range(200)] + [(2000, None), (2001, [None] + [1.0] * 23), (5, data[5][1]), (3000, [0.0] * 24)]
    return spark.createDataFrame(data, V)


def test_all_probes_equal_exact_search(spark, tmp_path, vectors, monkeypatch):
    monkeypatch.setattr(vector_index, "LIST_ROWS", 60)
    monkeypatch.setattr(vector_index, "QUERIES", 7)
    vector_index.build_index(vectors, f"file://{tmp_path}/index")
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/index")
    assert max(index.parts) > 2 and spark.read.parquet(f"file://{tmp_path}/index/codes").count() == vectors.where("chunk_id not in (2000, 2001)").count()
    queries = vectors.where("chunk_id % 35 = 0").select(F.col("chunk_id").alias("query_id"), "v").unionByName(spark.createDataFrame([(9000, None), (9001, [None] * 24), (9002, [0.0] * 24)], "query_id long, v array<float>"))
    exact = retrieval.vector_topk(queries, vectors, 20)
    assert rows(index.search(queries, 20)) == rows(exact)
    few = index.search(queries, 20, probes=4)
    assert vector_index.recall(few, exact.where("query_id < 9000")) >= 0.9 and index.search(queries.where("false"), 5).count() == 0
    scores = {(r.query_id, r.chunk_id): r.score for r in exact.collect()}
    assert all(abs(scores[r.query_id, r.chunk_id] - r.score) < 1e-9 for r in few.collect() if (r.query_id, r.chunk_id) in scores)


def test_recall_over_the_tables(spark, tmp_path):
    """Vectors without lists of their own, the hardest case: two thirds of the lists find nine in ten."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    vector_index.build_index(e, f"file://{tmp_path}/table")
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/table")
    queries = e.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    assert index.n_lists == 45 and vector_index.recall(index.search(queries, 20, probes=30), retrieval.vector_topk(queries, e, 20)) >= 0.9


def test_lengths_that_differ_are_told(spark, tmp_path):
    ragged = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], V)
    whole = spark.createDataFrame([(1, [1.0, 2.0])], V)
    asked = lambda v: spark.createDataFrame([(1, v)], "query_id long, v array<float>")
    with pytest.raises(ValueError, match="components"):
        retrieval.vector_topk(ragged.withColumnRenamed("chunk_id", "query_id"), whole)
    seen = Observation()
    assert rows(retrieval.vector_topk(asked([1.0, 1.0]), ragged.unionByName(spark.createDataFrame([(3, None), (4, [None, 1.0])], V)), observation=seen)) == [(1, 1, 3.0, 1)]
    assert seen.get == {"left_out": 3}
    with pytest.raises(ValueError, match="components"):
        vector_index.build_index(ragged, f"file://{tmp_path}/ragged")
    vector_index.build_index(whole, f"file://{tmp_path}/one")
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/one")
    assert rows(index.search(asked([1.0, 1.0]))) == [(1, 1, 3.0, 1)]
    with pytest.raises(ValueError, match="components"):
        index.search(asked([1.0]))


def test_bounds_of_codes_hold():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 32)) * 10.0 ** rng.integers(-3, 3, 300)[:, None]
    centroids = vector_index.fit_lists(x, 9)
    near, code, step, error = vector_index.encode(x, centroids)
    q = rng.normal(size=32)
    about = q @ centroids[near].T + (code * step[:, None]) @ q
    assert (np.abs(x @ q - about) <= np.linalg.norm(q) * error + 1e-9).all() and (near == ((x[:, None] - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)).all()

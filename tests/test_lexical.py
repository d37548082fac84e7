"""The stored inverted index against BM25 over the texts."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomquery.operators import retrieval
from loomquery.sources import lexical


def rows(df):
    return Counter((r.query_id, r.chunk_id, round(r.score, 8), r["rank"]) for r in df.collect())


def corpus(rng, n):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[min(399, int(rng.expovariate(0.02)))] for _ in range(rng.randrange(1, 80))) for _ in range(n)]
    for i in range(0, n, 11):
        texts[i] = texts[i // 2]
    return [(10 * i, t) for i, t in enumerate(texts)] + [(3, None), (5, ""), (7, "W0 w0 w0 w399"), (9, "ÄPFEL äpfel 12")]


@pytest.mark.parametrize("segment_words", [200, 4000])
def test_search_equals_bm25(spark, tmp_path, segment_words):
    rng = random.Random(3)
    chunks = spark.createDataFrame(corpus(rng, 500), "chunk_id long, text string")
    asked = [(i, " ".join(f"w{min(399, int(rng.expovariate(0.03)))}" for _ in range(rng.randrange(1, 9)))) for i in range(40)] + [(90, "w0 w0 W1"), (91, "nothing here"), (92, None), (93, " "), (94, "äpfel")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    lexical.build_index(chunks, f"file://{tmp_path}/index", segment_words)
    index = lexical.LexicalIndex(spark, f"file://{tmp_path}/index")
    for k in (1, 20):
        assert rows(index.search(queries, k)) == rows(retrieval.bm25(queries, chunks, k))


def test_common_words_that_weigh_less_than_nothing(spark, tmp_path):
    texts = [(i, "common word " + ("rare" if i == 17 else "other" if i % 2 else "")) for i in range(60)] + [(100 + i, "lone") for i in range(3)]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "common rare"), (2, "common word"), (3, "other"), (4, "unknown"), (5, "lone common")], "query_id long, text string")
    for words in (40,):
        lexical.build_index(chunks, f"file://{tmp_path}/{words}", words)
        index = lexical.LexicalIndex(spark, f"file://{tmp_path}/{words}")
        for k in (10, 80):
            assert rows(index.search(queries, k)) == rows(retrieval.bm25(queries, chunks, k))
    few = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "a c")], "chunk_id long, text string")
    lexical.build_index(few, f"file://{tmp_path}/few")
    index = lexical.LexicalIndex(spark, f"file://{tmp_path}/few")
    assert index.every
    asked = spark.createDataFrame([(1, "a"), (2, "c a"), (3, "z")], "query_id long, text string")
    for k in (2, 5):
        assert rows(index.search(asked, k)) == rows(retrieval.bm25(asked, few, k))


def test_empty_collections_and_text_ids(spark, tmp_path):
    queries = spark.createDataFrame([(1, "a")], "query_id long, text string")
    for name, texts in (("none", []), ("blank", [("x", ""), ("y", None)]), ("some", [("x__2", "a b"), ("x__10", "a b"), ("ä", "b")])):
        chunks = spark.createDataFrame(texts, "chunk_id string, text string")
        lexical.build_index(chunks, f"file://{tmp_path}/{name}")
        assert rows(lexical.LexicalIndex(spark, f"file://{tmp_path}/{name}").search(queries, 5)) == rows(retrieval.bm25(queries, chunks, 5))
    assert lexical.LexicalIndex(spark, f"file://{tmp_path}/some").search(queries.limit(0), 5).count() == 0


def test_blocks_and_segments_are_pruned(spark, tmp_path):
    """A term that is frequent in few chunks: most segments are never evaluated, and within one most blocks aren't decoded."""
    texts = [(i, " ".join(f"f{(i * 31 + j * j) % 4001}" for j in range(60))) for i in range(6000) if i % 3 < 2]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string")
    rare = chunks.withColumn("text", F.when(F.col("chunk_id") % 60 == 0, F.concat("text", F.when(F.col("chunk_id") == 1500, F.lit(" gem gem gem gem")).otherwise(F.lit(" gem")))).otherwise(F.col("text")))
    lexical.build_index(rare, f"file://{tmp_path}/rare", 60_000)
    index = lexical.LexicalIndex(spark, f"file://{tmp_path}/rare")
    queries = spark.createDataFrame([(1, "gem")], "query_id long, text string")
    assert rows(index.search(queries, 1)) == rows(retrieval.bm25(queries, rare, 1))
    assert index.facts["n_segments"] >= 4 and index.hits(queries, 1).select("segment").distinct().count() == 1
    postings = lexical.Postings.of(lexical.index_segment(__import__("pyarrow").table({"segment": [0] * 640, "chunk_id": list(range(640)), "w": ["t " * (9 if i == 200 else 1) + "u u u" for i in range(640)]})), 4.0)
    best, score, blocks = lexical.search_segment(postings, ["t"], [1.0], None, 640, 1, False)
    assert best.tolist() == [200] and blocks == 10
    best, again, blocks = lexical.search_segment(postings, ["t"], [1.0], score[0], 640, 1, False)
    assert best.tolist() == [200] and again[0] == score[0] and blocks <= 2


def test_a_segment_is_built_in_slices(monkeypatch):
    """A task holds little beyond the postings themselves (before: 55 bytes for each word)."""
    rng = np.random.default_rng(7)
    words = rng.zipf(1.2, 300_000) % 20_000
    group = pa.table({"segment": [0] * 1500, "chunk_id": rng.permutation(1500), "w": [" ".join(f"w{x}" for x in words[i : i + 200]) for i in range(0, 300_000, 200)]})
    whole = lexical.index_segment(group).sort_by("term")
    monkeypatch.setattr(lexical, "SLICE", 1 << 12)
    tracemalloc.start()
    pieces = sum(piece.num_rows for piece in lexical.segment_postings(group))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pieces == len(whole) and peak < 30 * 300_000
    assert lexical.index_segment(group).sort_by("term").equals(whole)


def test_a_task_writes_one_file_of_postings(spark, tmp_path, monkeypatch):
    """No task gets the buckets of two files, and a file ends at FILE_SEGMENTS segments."""
    monkeypatch.setattr(lexical, "FILE_SEGMENTS", 2)
    chunks = spark.createDataFrame([(i, " ".join(f"f{(i * 31 + j * j) % 401}" for j in range(30))) for i in range(300)], "chunk_id long, text string")
    lexical.build_index(chunks, f"file://{tmp_path}/small", 2_000)
    files = [f.name for f in (tmp_path / "small" / "postings").rglob("part-*.parquet")]
    assert len(files) == lexical.BUCKETS * 3 and len({f.split("-")[1] for f in files}) == len(files)

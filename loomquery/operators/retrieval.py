"""Ranking for many questions at once: BM25, vectors, rank fusion, rescoring, the confidence gate."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions.text import tokens

BLOCK = 4096


def top(df: DataFrame, group: str, k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(rank) <= k)


#: Distinct terms that a task counts before it hands them on.
MEMO = 200_000


#: Words that a task cuts at once.
SLICE = 1 << 18


def runs(sizes: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Runs of rows of about ``size`` in all; a larger row is a run of its own or ends one."""
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // size, prepend=-1))
    return list(zip(cuts.tolist(), np.append(cuts[1:], len(sizes)).tolist(), strict=True))


def text_sizes(texts: pa.Array) -> np.ndarray:
    """How many words texts (words between single blanks) have."""
    return pc.count_substring(texts, " ").to_numpy(zero_copy_only=False).astype(np.int64) + pc.not_equal(texts, "").to_numpy(zero_copy_only=False)


def distinct_words(texts: pa.Array, sizes: np.ndarray) -> tuple[pa.Array, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The words of some texts; of each word in each text that has it, in order, (the word's number, the text's), and how often it occurs."""
    flat = pc.split_pattern(texts, " ").flatten()
    flat = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
    # One number for word and text.
    pair, tf = np.unique(flat.indices.to_numpy().astype(np.int64) * len(texts) + np.repeat(np.arange(len(texts)), sizes), return_counts=True)
    return flat.dictionary, (pair // len(texts), pair % len(texts)), tf


def _added(counts: list[pa.Table]) -> pa.Table:
    """term, df, cf: one row for each term."""
    return pa.concat_tables(counts).group_by("term").aggregate([("df", "sum"), ("cf", "sum")]).select(["term", "df_sum", "cf_sum"]).rename_columns(["term", "df", "cf"])


def counted_terms(rows: DataFrame) -> DataFrame:
    """term, df, cf of rows (sign, text): how many texts hold a term and how often it occurs, times the sign; under an empty term the texts and their words. Partial sums, as many rows for a term as tasks met it.

    Words are cut by the same expression as everywhere; a task counts them in a memo of bounded size, so what is shuffled are terms, not occurrences.
    """

    def count(batches):
        held, n_held, seen, n_texts, n_words = [], 0, False, 0, 0
        for batch in batches:
            sign, texts = batch.column(0).to_numpy().astype(np.int64), batch.column(1)
            size = text_sizes(texts)
            seen, n_texts, n_words = seen or batch.num_rows > 0, n_texts + int(sign.sum()), n_words + int(sign @ size)
            for a, b in runs(size, SLICE):
                words, doc, tf = distinct_words(texts.slice(a, b - a), size[a:b])
                by = sign[a:b][doc[1]]
                sums = [np.bincount(doc[0], x, len(words)).astype(np.int64) for x in (by, by * tf)]  # sums of a slice are exact as doubles
                held.append(pa.table([words, *map(pa.array, sums)], ["term", "df", "cf"]))
                n_held += len(words)
                if n_held > 4 * MEMO:
                    held = [_added(held)]
                    n_held = len(held[0])
                    if n_held > MEMO:
                        yield from held[0].to_batches(50_000)
                        held, n_held = [], 0
        if seen:
            held.append(pa.table([[""], [n_texts], [n_words]], ["term", "df", "cf"]))
            yield from _added(held).to_batches(50_000)

    return rows.select(F.col("sign").cast("int"), F.array_join(tokens(F.col("text")), " ").alias("w")).mapInArrow(count, "term string, df long, cf long")


def term_counts(chunks: DataFrame) -> DataFrame:
    """term, df, cf: how many chunks hold a term, and how often it occurs."""
    counted = counted_terms(chunks.select(F.lit(1).alias("sign"), "text")).where("term <> ''")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def corpus_facts(chunks: DataFrame, n: int) -> tuple[float, float]:
    """(average length, weight floor of common terms) over n chunks, in one pass: only counts by term are shuffled, and a row without a term carries the lengths."""
    words = tokens(F.col("text"))
    rows = chunks.select(F.explode(F.concat(F.transform(F.array_distinct(words), lambda t: F.struct(t.alias("term"), F.lit(0).alias("dl"))), F.array(F.struct(F.lit("").alias("term"), F.size(words).alias("dl"))))).alias("r"))
    terms = rows.groupBy("r.term").agg(F.count("*").alias("df"), F.sum("r.dl").alias("words"))
    raw = F.when(F.col("term") != "", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    out = terms.agg(F.sum("words").alias("words"), F.avg(raw).alias("mean")).first()
    return (out["words"] or 0) / n or 1.0, (out["mean"] or 0.0) * fx.BM25_EPSILON


def bm25(queries: DataFrame, chunks: DataFrame, k: int = fx.POOL) -> DataFrame:
    """query_id, chunk_id, score, rank for (query_id, text) against (chunk_id, text); no row without chunks. ``checked_collection`` tells an empty or broken collection beforehand.

    Two passes over the corpus: one for the average length and the floor of common terms, one for the postings of the terms that are asked for, which are
    picked out before any shuffle. Chunks without a query term score 0 and fill up in order of id where fewer than k scored.
    """
    n = chunks.count()
    if not n:
        return top(queries.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, score double"), "query_id", k, F.col("score").desc())
    avgdl, floor = corpus_facts(chunks, n)
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    words = chunks.select("chunk_id", tokens(F.col("text")).alias("w")).select("chunk_id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    # Spark broadcasts the asked terms if they are few; else they meet the words in a shuffle join.
    postings = words.join(asked.select("term").distinct(), "term", "left_semi").groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    idf = postings.groupBy("term").agg(F.count("*").alias("df")).select("term", F.when(raw < 0, F.lit(floor)).otherwise(raw).alias("idf"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (fx.BM25_K1 + 1) / (F.col("tf") + fx.BM25_K1 * (1 - fx.BM25_B + fx.BM25_B * F.col("dl") / avgdl))
    scored = postings.join(asked.join(idf, "term"), "term").groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))
    # A fill ranks behind hits above 0 and before those below, which there are only where common words weigh less than nothing.
    hits = scored.where("score > 0") if floor < 0 else scored
    short = asked.select("query_id").distinct().join(hits.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("query_id")
    fill = _unhit(short, scored, chunks, n, k, floor < 0).select("query_id", "chunk_id", F.lit(0.0).alias("score"))
    return top(scored.unionByName(fill), "query_id", k, F.round("score", 9).desc(), F.col("chunk_id"))


def checked_collection(chunks: DataFrame) -> DataFrame:
    """chunks, if there are any and each has an id of its own and a text; else an error that says what is wrong."""
    facts = chunks.agg(F.count("*").alias("n"), F.count_if(F.col("chunk_id").isNull()).alias("no_id"), F.count_if(F.col("text").isNull()).alias("no_text")).first()
    if not facts["n"]:
        raise ValueError("the collection is empty")
    if facts["no_id"] or facts["no_text"]:
        raise ValueError(f"{facts['no_id']} chunks have no id and {facts['no_text']} no text")
    twice = chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).first()
    if twice:
        raise ValueError(f"chunk {twice['chunk_id']} occurs {twice['n']} times")
    return chunks


def _unhit(short: DataFrame, scored: DataFrame, chunks: DataFrame, n: int, k: int, many_hits: bool) -> DataFrame:
    """query_id, chunk_id: for each query in short at least the first k chunks, in order of id, that it hasn't hit, if there are so many.

    A query with fewer than k hits finds them among the first 2k chunks. Where a query may have hit any number, the run of first chunks grows until each finds k.
    """
    m = 2 * k
    while True:
        # Of the chunk ids alone; at most m of them.
        first = chunks.select("chunk_id").orderBy("chunk_id").limit(m).agg(F.array_sort(F.collect_list("chunk_id")).alias("ids")).first()["ids"]
        missing = short.select("query_id", F.explode(F.array(*map(F.lit, first))).alias("chunk_id")).join(scored, ["query_id", "chunk_id"], "left_anti")
        if m >= n or not many_hits:
            return missing
        found = missing.groupBy("query_id").agg(F.count("*").alias("n"))
        if not short.join(found, "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).limit(1).count():
            return missing
        m *= 8


def _best(score: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row of scores the places of the best k: higher scores, to 9 digits, first, then smaller ids."""
    score, out = np.round(score, 9), []
    if score.shape[1] > k:
        bar = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    else:
        bar = np.full(len(score), -np.inf)
    for row, low in zip(score, bar, strict=True):
        at = np.flatnonzero(row >= low)
        out.append(at[np.lexsort((own[at], -row[at]))[:k]])
    return out


def _matrix(column) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


_HITS = "query_id long, chunk_id long, score double"


def _hits(ids: np.ndarray, own: np.ndarray, score: np.ndarray, k: int) -> pa.Table:
    best = _best(score, own, k)
    return pa.table({"query_id": np.repeat(ids, [len(b) for b in best]), "chunk_id": np.concatenate([own[b] for b in best]).astype(np.int64), "score": np.concatenate([r[b] for r, b in zip(score, best, strict=True)]).astype(np.float64)})


def _tiled(ids: np.ndarray, q: np.ndarray, own: np.ndarray, v: np.ndarray, k: int) -> pa.Table:
    """The best k vectors of each query; at most SCORES scores (of one query at least) are held at once."""
    step = max(1, SCORES // max(1, len(own)))
    return pa.concat_tables([_hits(ids[a : a + step], own, q[a : a + step] @ v.T, k) for a in range(0, len(ids), step)])


def one_length(vectors: DataFrame) -> int | None:
    """The number of components that all vectors v have; None without vectors, an error where they differ."""
    facts = vectors.where("v is not null").agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if facts["low"] != facts["high"]:
        raise ValueError(f"vectors have from {facts['low']} to {facts['high']} components")
    return facts["low"]


#: Scores that a task holds at once, and vectors that pass by at once.
SCORES, PASSING = 1 << 20, 1 << 13


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = fx.POOL, observation: Observation | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank by inner product of (query_id, v) with (chunk_id, v), exact. Filter vectors beforehand.

    Up to BLOCK queries go to every task as one matrix, and vectors pass by without a shuffle; more queries meet the vectors block by block in a grid of tasks.
    Queries of several lengths are an error. A null vector, one with a null in it, or one of another length than the queries has no row; ``observation`` counts these as
    ``left_out`` while the vectors pass.
    """
    size = one_length(queries)
    if size is None:
        return top(queries.sparkSession.createDataFrame([], _HITS), "query_id", k, F.col("score").desc())
    whole = F.coalesce((F.size("v") == size) & ~F.exists("v", lambda x: x.isNull()), F.lit(False))
    if observation is not None:
        vectors = vectors.observe(observation, F.count_if(~whole).alias("left_out"))
    queries, vectors = queries.where(whole).select("query_id", "v"), vectors.where(whole).select("chunk_id", "v")
    n_queries = queries.count()
    found = _streamed(queries, vectors, k) if n_queries <= BLOCK else _grid(queries, vectors, n_queries, k)
    return top(found, "query_id", k, F.round("score", 9).desc(), F.col("chunk_id"))


def _streamed(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The best k of each task for each query; at most BLOCK queries reach the driver."""
    asked = queries.toArrow()
    ids, q = asked.column("query_id").to_numpy(), _matrix(asked.column("v"))

    def scan(batches):
        held = None
        for batch in (b.slice(a, PASSING) for b in batches for a in range(0, b.num_rows, PASSING)):
            hits = _tiled(ids, q, batch.column(0).to_numpy(), _matrix(batch.column(1)), k)
            if held is None:
                held = hits
                continue
            both = pa.concat_tables([held, hits])
            query, chunk, score = (both.column(c).to_numpy() for c in ("query_id", "chunk_id", "score"))
            order = np.lexsort((chunk, -np.round(score, 9), query))
            query = query[order]
            place = np.arange(len(order)) - np.searchsorted(query, query)
            held = both.take(order[place < k])
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return vectors.mapInArrow(scan, _HITS)


def _grid(queries: DataFrame, vectors: DataFrame, n_queries: int, k: int) -> DataFrame:
    nq, nv = -(-n_queries // BLOCK), max(1, -(-vectors.count() // BLOCK))
    q = queries.select(F.col("query_id").alias("id"), "v", F.lit(True).alias("asks"), F.pmod(F.xxhash64("query_id"), F.lit(nq)).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nv - 1).cast("long"))).alias("j"))
    v = vectors.select(F.col("chunk_id").alias("id"), "v", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("i"), F.pmod(F.xxhash64("chunk_id"), F.lit(nv)).alias("j"))

    def block(key, group):
        asks = np.array(group.column("asks").to_pylist(), bool)
        ids, m = group.column("id").to_numpy(), _matrix(group.column("v"))
        if not asks.any() or asks.all():
            return pa.table({"query_id": pa.array([], pa.int64()), "chunk_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return _tiled(ids[asks], m[asks], ids[~asks], m[~asks], k)

    return q.unionByName(v).groupBy("i", "j").applyInArrow(block, _HITS)


def fuse(lists: DataFrame, k: int = fx.TOP_K, rrf_k: int = fx.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, list_idx, chunk_id, rank): query_id, chunk_id, rrf_score, first_list, rank."""
    fused = lists.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("rrf_score"), F.min_by("list_idx", F.struct("list_idx", "rank")).alias("first_list"))
    return top(fused, "query_id", k, F.round("rrf_score", 12).desc(), F.col("chunk_id"))


def hybrid(semantic: DataFrame, lexical: DataFrame, k: int = fx.POOL) -> DataFrame:
    """Fusion of two ranked lists that keeps where each row came from."""
    both = semantic.select("query_id", "chunk_id", "rank", "score", F.lit(0).alias("l")).unionByName(lexical.select("query_id", "chunk_id", "rank", "score", F.lit(1).alias("l")))
    of = lambda l, c: F.max(F.when(F.col("l") == l, F.col(c)))  # noqa: E731, E741
    fused = both.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (fx.RRF_K + F.col("rank"))).alias("rrf_score"), of(0, "rank").alias("semantic_rank"), of(1, "rank").alias("bm25_rank"), of(1, "score").alias("bm25_score"))
    return top(fused, "query_id", k, F.round("rrf_score", 12).desc(), F.col("chunk_id"))


def rerank(candidates: DataFrame, score: Column, k: int = fx.TOP_K) -> DataFrame:
    """Rescore all candidates and keep the best k; the rank before stays as original_rank."""
    scored = candidates.withColumnRenamed("rank", "original_rank").withColumn("rerank_score", score)
    return top(scored, "query_id", k, F.round("rerank_score", 9).desc(), F.col("original_rank"))


def scored_by(pairs: DataFrame, connect: Callable[[], Callable[[list[str], list[str]], list[float]]], column: str = "model_score") -> DataFrame:
    """pairs (question, text, ...) with the score that a model gives each, in batches; ``connect()`` makes the model once for each task. A null question or text has no score."""
    names = [c for c in pairs.columns if c not in ("question", "text")]
    row = pairs.select(F.struct(*(F.col(f"`{c}`") for c in pairs.columns)).alias("row"), "question", "text")

    def run(batches):
        score = None
        for batch in batches:
            questions, texts = (batch.column(c).to_pylist() for c in ("question", "text"))
            whole = [i for i, (q, t) in enumerate(zip(questions, texts, strict=True)) if q is not None and t is not None]
            score = score or connect()
            out: list[float | None] = [None] * batch.num_rows
            for i, s in zip(whole, score([questions[i] for i in whole], [texts[i] for i in whole]) if whole else [], strict=True):
                out[i] = float(s)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.float64())], ["row", "score"])

    done = row.mapInArrow(run, f"row {row.schema['row'].dataType.simpleString()}, score double")
    return done.select(*(F.col(f"row.`{c}`").alias(c) for c in [*names, "question", "text"]), F.col("score").alias(column))


def embedded(texts: DataFrame, connect: Callable[[], Callable[[list[str]], np.ndarray]], key: str = "query_id", batch: int = 64, errors: bool = False) -> DataFrame:
    """key, v: the normalised embedding of each text of (key, text), by the model that ``connect()`` makes once for each task, ``batch`` texts a call. A null text, or one of norm 0, has a null vector.

    With ``errors`` a call that fails gives its texts no vector but a column ``error`` that says why, as do a null text and a vector without length; else it fails the job.
    """

    def run(batches):
        embed = None
        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch)
                said = part.column(1).to_pylist()
                at = [i for i, t in enumerate(said) if t is not None]
                embed = embed or connect()
                out: list[list[float] | None] = [None] * part.num_rows
                why = ["no text" if t is None else None for t in said]
                try:
                    m = np.asarray(embed([said[i] for i in at]), np.float64) if at else np.zeros((0, 1))
                    for i, v, size in zip(at, m, np.linalg.norm(m, axis=1), strict=True):
                        out[i], why[i] = ((v / size).tolist(), None) if size > 0 else (None, "no vector")
                except Exception as e:
                    if not errors:
                        raise
                    for i in at:
                        out[i], why[i] = None, f"{type(e).__name__}: {e}"
                columns = [part.column(0), pa.array(out, pa.list_(pa.float64())), pa.array(why, pa.string())]
                yield pa.RecordBatch.from_arrays(columns[: 3 if errors else 2], [key, "v", "error"][: 3 if errors else 2])

    return texts.select(key, "text").mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, v array<double>" + (", error string" if errors else ""))


def overlap_score(query: Column, text: Column) -> Column:
    """The stand-in scorer, where no model is at hand: the share of distinct query words in the text, from -4 to 4."""
    q = F.array_distinct(tokens(query))
    return 8.0 * F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1)) - 4.0


def gate(queries: DataFrame, ranked: DataFrame, threshold: float = fx.MIN_RERANK_SCORE) -> DataFrame:
    """query_id, top_score, passed: does the first row's score reach the threshold? No row or no score fails."""
    first = ranked.where("rank = 1").select("query_id", F.col("rerank_score").alias("top_score"))
    return queries.select("query_id").join(first, "query_id", "left").withColumn("passed", F.coalesce(F.col("top_score") >= threshold, F.lit(False)))


def retrieval_metrics(ranked: DataFrame, expected: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, hit_at_5, hit_at_10, mrr_at_10 from (query_id, key, rank) and (query_id, key); without expected keys all are 0."""
    hit = ranked.join(expected.distinct(), ["query_id", "key"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    f = F.col("first")
    return queries.select("query_id").join(hit, "query_id", "left").select("query_id", F.coalesce((f <= 5).cast("int"), F.lit(0)).alias("hit_at_5"), F.coalesce((f <= 10).cast("int"), F.lit(0)).alias("hit_at_10"), F.coalesce(F.when(f <= 10, 1.0 / f), F.lit(0.0)).alias("mrr_at_10"))


def eval_summary(results: DataFrame, retrieval: tuple[str, ...], judged: tuple[str, ...], refusal: str | None = None) -> DataFrame:
    """Averages overall and by category. Retrieval metrics count all rows; judged ones leave out nulls and out_of_scope, and give 0 with an effective n of 0.

    ``refusal`` is a metric of out_of_scope rows alone: the average of those of the bucket, null where it has none.
    """
    counts = F.col("category") != "out_of_scope"
    aggs = [F.count("*").alias("n"), *(F.round(F.avg(m), 4).alias(m) for m in retrieval)]
    for m in judged:
        own = F.when(counts, F.col(m))
        aggs += [F.round(F.coalesce(F.avg(own), F.lit(0.0)), 4).alias(m), F.count(own).alias(f"{m}_n"), F.count(F.when(counts & F.col(m).isNull(), 1)).alias(f"{m}_failed")]
    if refusal is not None:
        outside = F.when(~counts, F.col(refusal))
        aggs += [F.round(F.avg(outside), 4).alias(refusal), F.count(outside).alias(f"{refusal}_n")]
    return results.groupingSets([[], ["category"]], "category").agg(*aggs).withColumn("category", F.coalesce("category", F.lit("overall")))

"""A stored inverted index for BM25, and top-k search by block-max pruning.

Chunks are dealt to segments of about SEGMENT_WORDS words by a hash of their id; a segment is indexed by one task, is never changed, and numbers its chunks in the order of their ids.
The postings of a term in a segment are one row of the table ``postings``: deltas of chunk numbers, frequencies and chunk lengths, and for each block of BLOCK postings its first number and
the highest frequency and least length in it, which bound the impact of any posting of the block, whatever the average length becomes. The row carries the bounds of the
whole segment too, so a search that reads the narrow columns alone knows the document frequency of every asked term and what each segment can yield at most. Rows lie in folders by a hash of
the term, and a search reads only the folders of asked terms.

A search evaluates for each query its HEAD most promising segments first. The k-th best score there is a threshold: segments that can't reach it are never read, and within those that can, only
blocks of stretches of chunks whose bounds reach it are decoded. Scores are exact, and pruned chunks are those that can't be among the first k.

Defined results: as ``retrieval.bm25`` over the same chunks, in every row; a null text has no words; an empty collection gives no row; ids that repeat are chunks of their own; queries without a word have no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions.text import tokens
from ..operators.retrieval import distinct_words, runs, text_sizes, top
from .shared import stored

SEGMENT_WORDS = 1 << 22
BUCKETS = 32
BLOCK = 64
#: Stretches of chunks within a segment that are skipped or scored together.
STRETCH = 64
HEAD = 1
#: Queries that meet a segment in one task.
QUERIES = 1_024
#: Segments whose rows of one bucket share a file.
FILE_SEGMENTS = 16
#: Words, or postings, that a task that builds a segment handles at once.
SLICE = 1 << 18

#: data holds, one after the other: of each block the first number, highest frequency and least length; of each posting the delta, frequency and length. Most terms are rare, and one list is short to write.
POSTINGS = "segment int, term string, n int, top_tf int, low_dl int, data array<int>"


def _lists(runs: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """One list for each row: its runs in order. runs: (how many each row has, their values row by row)."""
    size = sum(n for n, _ in runs)
    ends = np.cumsum(size)
    out, at = np.empty(int(ends[-1]), np.int32), ends - size
    for n, values in runs:
        out[np.arange(len(values)) + np.repeat(at - (np.cumsum(n) - n), n)] = values
        at = at + n
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(out))


def _packed(segment: int, terms: pa.Array, starts: np.ndarray, doc: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> pa.Table:
    """POSTINGS of some terms: those of a term begin at its start, in the order of their chunks; dl: the length of each posting's chunk."""
    n = np.diff(starts, append=len(doc))
    place = np.arange(len(doc)) - np.repeat(starts, n)
    blocks = np.flatnonzero(place % BLOCK == 0)
    block_starts = np.searchsorted(blocks, starts)
    delta = np.diff(doc, prepend=0)
    delta[blocks] = 0
    top_tfs, low_dls = np.maximum.reduceat(tf, blocks), np.minimum.reduceat(dl, blocks)
    columns = [
        pa.array(np.full(len(starts), segment, np.int32)), terms, pa.array(n.astype(np.int32)),
        pa.array(np.maximum.reduceat(top_tfs, block_starts).astype(np.int32)), pa.array(np.minimum.reduceat(low_dls, block_starts).astype(np.int32)),
        _lists([*((np.diff(block_starts, append=len(blocks)), x) for x in (doc[blocks], top_tfs, low_dls)), *((n, x) for x in (delta, tf, dl))]),
    ]
    return pa.table(columns, schema=_SCHEMA)


def segment_postings(group: pa.Table) -> Iterator[pa.Table]:
    """POSTINGS of one segment from (segment, chunk_id, w: words between single blanks), in pieces.

    Words are cut SLICE at a time, and postings packed SLICE at a time; in between a posting takes twelve bytes.
    """
    segment, order = group.column("segment")[0].as_py(), pc.sort_indices(group.column("chunk_id"))
    texts = group.column("w").combine_chunks()
    dl = text_sizes(texts).astype(np.int32)[order.to_numpy()]
    known, found, n_known = [], [], 0
    for a, b in runs(dl, SLICE):
        words, (term, doc), tf = distinct_words(texts.take(order.slice(a, b - a)), dl[a:b])
        known.append(words)
        found.append(((term + n_known).astype(np.int32), (doc + a).astype(np.int32), tf.astype(np.int32)))
        n_known += len(words)
    if not n_known:
        return
    # Terms of all slices get one number each; slices follow each other, so a stable order keeps the chunks of a term ascending.
    terms = pa.concat_arrays(known).dictionary_encode()
    term, doc, tf = (np.concatenate(x) for x in zip(*found, strict=True))
    del known, found
    term = terms.indices.to_numpy()[term]
    by_term = np.argsort(term, kind="stable")
    term, doc, tf = term[by_term], doc[by_term], tf[by_term]
    del by_term
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    ends = np.append(starts[1:], len(term))
    for a, b in runs(ends - starts, SLICE):
        own = slice(starts[a], ends[b - 1])
        yield _packed(segment, terms.dictionary.take(pa.array(term[starts[a:b]])), starts[a:b] - starts[a], doc[own], tf[own], dl[doc[own]])


def index_segment(group: pa.Table) -> pa.Table:
    """segment_postings as one table."""
    return pa.concat_tables([_SCHEMA.empty_table(), *segment_postings(group)]).combine_chunks()


_SCHEMA = pa.schema([("segment", pa.int32()), ("term", pa.string()), *((c, pa.int32()) for c in ("n", "top_tf", "low_dl")), ("data", pa.list_(pa.int32()))])


def bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build_index(chunks: DataFrame, path: str, segment_words: int = SEGMENT_WORDS) -> None:
    """The index of (chunk_id, text) at path: ``chunks`` (chunk_id, segment, place, dl), ``postings`` and ``facts``.

    Texts are cut into words twice, first for the sizes, and shuffled once, to their segments. Nothing but sizes reaches the driver.
    """
    spark = chunks.sparkSession
    chunks = chunks.select("chunk_id", "text")
    sizes = chunks.agg(F.count("*").alias("n"), F.sum(F.size(tokens(F.col("text")))).alias("words")).first()
    n_segments = max(1, -(-(sizes["words"] or 0) // segment_words), -(-sizes["n"] // segment_words))
    keyed = chunks.withColumn("segment", F.pmod(F.xxhash64("chunk_id"), F.lit(n_segments)).cast("int"))

    def work(batches):
        held = list(batches)
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            del held
            segments = pc.unique(rows.column("segment"))
            for segment in segments:
                own = rows if len(segments) == 1 else rows.filter(pc.equal(rows.column("segment"), segment))
                for piece in segment_postings(own):
                    yield from piece.to_batches()

    # A task has one segment, without a sort.
    cut = keyed.select("segment", "chunk_id", F.array_join(tokens(F.col("text")), " ").alias("w")).repartitionById(n_segments, "segment")
    built = cut.mapInArrow(work, POSTINGS)
    # A task has one file: the rows of one bucket of FILE_SEGMENTS segments.
    file = (F.col("bucket") + BUCKETS * F.floor(F.col("segment") / FILE_SEGMENTS)).cast("int")
    placed = built.withColumn("bucket", bucket("term")).repartitionById(BUCKETS * -(-n_segments // FILE_SEGMENTS), file).sortWithinPartitions("bucket", "term", "segment")
    placed.write.partitionBy("bucket").parquet(f"{path}/postings")
    # Numbers within a segment follow the ids, as in index_segment.
    order = Window.partitionBy("segment").orderBy(F.col("chunk_id").asc_nulls_last())
    numbered = keyed.select("segment", "chunk_id", (F.row_number().over(order) - 1).alias("place"))
    numbered.repartition(-(-n_segments // FILE_SEGMENTS), "segment").sortWithinPartitions("segment", "place").write.parquet(f"{path}/chunks")
    segments = spark.read.parquet(f"{path}/chunks").groupBy("segment").agg(F.count("*").cast("int").alias("n_docs"))
    segments.coalesce(1).write.parquet(f"{path}/segments")
    postings = spark.read.schema(f"bucket int, {POSTINGS}").parquet(f"{path}/postings")
    df = postings.groupBy("term").agg(F.sum("n").cast("double").alias("df"))
    mean = df.agg(F.avg(F.log(F.lit(sizes["n"]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("m")).first()["m"]
    spark.createDataFrame([(sizes["n"], sizes["words"] or 0, mean or 0.0, n_segments)], "n long, words long, mean_idf double, n_segments int").coalesce(1).write.parquet(f"{path}/facts")


def impact(tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    return tf * (fx.BM25_K1 + 1) / (tf + fx.BM25_K1 * (1 - fx.BM25_B + fx.BM25_B * dl / avgdl))


@dataclass
class Postings:
    """The rows of a segment, by term; what is decoded stays for the task's other queries."""

    rows: dict[str, tuple[np.ndarray, ...]]
    avgdl: float

    @classmethod
    def of(cls, table: pa.Table, avgdl: float) -> Postings:
        data = table.column("data").combine_chunks()
        offsets, values, rows = data.offsets.to_numpy(), data.values.to_numpy(), {}
        for i, (term, n) in enumerate(zip(table.column("term").to_pylist(), table.column("n").to_pylist(), strict=True)):
            own, b = values[offsets[i] : offsets[i + 1]], -(-n // BLOCK)
            rows[term] = tuple(np.split(own, [b, 2 * b, 3 * b, 3 * b + n, 3 * b + 2 * n]))
        return cls(rows, avgdl)

    def bounds(self, term: str, n_stretches: int) -> np.ndarray:
        """The most that a posting of the term adds to a chunk's score, by stretch."""
        firsts, tfs, dls, deltas, _, _ = self.rows[term]
        high = impact(tfs.astype(np.float64), dls.astype(np.float64), self.avgdl)
        # A block reaches from its first chunk to the one before the next block's first.
        begin = firsts // STRETCH
        end = np.append((firsts[1:] - 1) // STRETCH, n_stretches - 1)
        out = np.zeros(n_stretches)
        for s, e, h in zip(begin.tolist(), end.tolist(), high.tolist(), strict=True):
            np.maximum(out[s : e + 1], h, out=out[s : e + 1])
        return out

    def decode(self, term: str, alive: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(chunk numbers, impacts, blocks decoded) of the blocks that touch a stretch that is alive; of all without one."""
        firsts, _, _, deltas, tfs, dls = self.rows[term]
        blocks = np.arange(len(firsts))
        if alive is not None:
            upto = np.concatenate([[0], np.cumsum(alive)])
            last = np.append((firsts[1:] - 1) // STRETCH, len(alive) - 1)
            blocks = np.flatnonzero(upto[last + 1] > upto[firsts // STRETCH])
            if not len(blocks):
                return blocks, np.zeros(0), 0
        size = np.minimum(BLOCK, len(deltas) - blocks * BLOCK)
        begin = np.cumsum(size) - size
        at = np.arange(size.sum()) - np.repeat(begin, size) + np.repeat(blocks * BLOCK, size)
        run = np.cumsum(deltas[at], dtype=np.int64)
        doc = run - np.repeat(run[begin], size) + np.repeat(firsts[blocks], size)
        return doc, impact(tfs[at].astype(np.float64), dls[at].astype(np.float64), self.avgdl), len(blocks)


def search_segment(postings: Postings, terms: list[str], weights: list[float], threshold: float | None, n_docs: int, k: int, every: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(numbers, scores, blocks decoded): the best k chunks of a segment that hold a term, or with ``every`` of all; higher scores, to 9 digits, first, then lower numbers. Chunks that can't reach the threshold may be left out."""
    alive, n_stretches = None, -(-n_docs // STRETCH)
    if threshold is not None:
        most = np.zeros(n_stretches)
        for t, w in zip(terms, weights, strict=True):
            if w > 0:
                most += w * postings.bounds(t, n_stretches)
        alive = most >= threshold
    score, hit, n_blocks = np.zeros(n_docs), np.full(n_docs, every), 0
    for t, w in zip(terms, weights, strict=True):
        doc, gain, blocks = postings.decode(t, alive)
        score[doc] += w * gain
        hit[doc] = True
        n_blocks += blocks
    if alive is not None:
        hit &= np.repeat(alive, STRETCH)[:n_docs]  # elsewhere not all terms were added up
    at = np.flatnonzero(hit)
    best = at[np.lexsort((at, -np.round(score[at], 9)))[:k]]
    return best, score[best], n_blocks


class LexicalIndex:
    """A built index; ``search`` is ``retrieval.bm25`` over its chunks."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.facts = spark.read.parquet(f"{path}/facts").first()
        self.avgdl = self.facts["words"] / self.facts["n"] if self.facts["n"] and self.facts["words"] else 1.0
        self.floor = self.facts["mean_idf"] * fx.BM25_EPSILON
        #: Where common words weigh less than nothing, a chunk without any query term ranks before one with such words alone: then all chunks are candidates.
        self.every = self.floor < 0
        self.chunks = spark.read.parquet(f"{path}/chunks")
        self.segments = spark.read.parquet(f"{path}/segments")

    def postings(self, buckets: list[int]) -> DataFrame:
        """Rows of the folders of some buckets."""
        return self.spark.read.schema(f"bucket int, {POSTINGS}").parquet(f"{self.path}/postings").where(F.col("bucket").isin(buckets))

    def weights(self, queries: DataFrame) -> tuple[DataFrame, list[int]]:
        """(query_id, term, w (occurrences in the query times idf) of terms that the index has; the buckets to read)."""
        asked = stored(queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")), "asked")
        buckets = [r[0] for r in asked.select(bucket("term")).distinct().collect()]  # BUCKETS at most
        heads = self.postings(buckets).select("term", "n").join(asked.select("term").distinct(), "term", "left_semi")
        raw = F.log(F.lit(self.facts["n"]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        idf = heads.groupBy("term").agg(F.sum("n").cast("double").alias("df")).select("term", F.when(raw < 0, F.lit(self.floor)).otherwise(raw).alias("idf"))
        return stored(asked.join(idf, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w")), "weights"), buckets

    def reach(self, weights: DataFrame, buckets: list[int]) -> DataFrame:
        """query_id, segment, most (no chunk of the segment scores higher): from the narrow columns alone."""
        if self.every:
            all_segments = F.explode(F.sequence(F.lit(0), F.lit(self.facts["n_segments"] - 1)))
            return weights.select("query_id").distinct().select("query_id", all_segments.alias("segment"), F.lit(float("inf")).alias("most"))
        tf, dl = F.col("top_tf").cast("double"), F.col("low_dl")
        high = tf * (fx.BM25_K1 + 1) / (tf + fx.BM25_K1 * (1 - fx.BM25_B + fx.BM25_B * dl / self.avgdl))
        heads = self.postings(buckets).select("term", "segment", high.alias("high"))
        return heads.join(weights, "term").groupBy("query_id", "segment").agg(F.sum(F.greatest("w", F.lit(0.0)) * F.col("high")).alias("most"))

    def evaluate(self, pairs: DataFrame, weights: DataFrame, buckets: list[int], k: int, parts: int) -> DataFrame:
        """query_id, segment, place, score, blocks (decoded for the query in the segment) for (query_id, segment, threshold): the best k of each segment. Queries meet a segment in ``parts`` tasks."""
        kind = weights.schema["query_id"].dataType.simpleString()
        part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")
        asked = pairs.join(weights, "query_id").groupBy("query_id", "segment", "threshold").agg(F.collect_list(F.struct("term", "w")).alias("terms")).withColumn("part", part)
        asked = stored(asked.join(self.segments, "segment"), "asked_segments")
        wanted = asked.select("segment", F.col("part").alias("with_part"), F.explode("terms.term").alias("term")).distinct()
        rows = self.postings(buckets).select("segment", "term", "n", "data").join(wanted, ["segment", "term"])
        avgdl, every = self.avgdl, self.every

        def work(key, left, right):
            postings, found = Postings.of(left, avgdl), []
            for terms, threshold, n_docs in zip(*(right.column(c).to_pylist() for c in ("terms", "threshold", "n_docs")), strict=True):
                known = [(t["term"], t["w"]) for t in terms if t["term"] in postings.rows]
                found.append(search_segment(postings, [t for t, _ in known], [w for _, w in known], threshold, n_docs, k, every))
            query = right.column("query_id").take(pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found])))
            n = len(query)
            place, score = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in (0, 1))
            blocks = np.repeat([f[2] for f in found], [len(f[0]) for f in found])
            return pa.table([query, pa.array([key[0].as_py()] * n, pa.int32()), pa.array(place.astype(np.int32)), pa.array(score), pa.array(blocks.astype(np.int32))], names=["query_id", "segment", "place", "score", "blocks"])

        return rows.groupBy("segment", "with_part").cogroup(asked.groupBy("segment", "part")).applyInArrow(work, f"query_id {kind}, segment int, place int, score double, blocks int")

    def hits(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, segment, place, score, blocks: all that may be among the first k of their query."""
        weights, buckets = self.weights(queries)
        parts = max(1, -(-weights.select("query_id").distinct().count() // QUERIES))
        reach = stored(self.reach(weights, buckets), "reach")
        ranked = top(reach, "query_id", HEAD, F.col("most").desc(), F.col("segment")).select("query_id", "segment", F.lit(None).cast("double").alias("threshold"))
        first = stored(self.evaluate(ranked, weights, buckets, k, parts), "first_segments")
        low = F.when((F.count("*") >= k) & ~F.lit(self.every), F.min("score") - 1e-6)
        bar = first.groupBy("query_id").agg(low.alias("threshold"))
        rest = reach.join(ranked.select("query_id", "segment"), ["query_id", "segment"], "left_anti").join(bar, "query_id", "left").where("threshold is null or most >= threshold")
        return stored(first.unionByName(self.evaluate(rest.select("query_id", "segment", "threshold"), weights, buckets, k, parts)), "hits")

    def search(self, queries: DataFrame, k: int = fx.POOL) -> DataFrame:
        """query_id, chunk_id, score, rank for (query_id, text). Chunks without a query term score 0 and fill up in order of id where fewer than k scored."""
        kind = self.chunks.schema["chunk_id"].dataType.simpleString()
        order = (F.round("score", 9).desc(), F.col("chunk_id"))
        if not self.facts["n"]:
            return top(self.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {kind}, score double"), "query_id", k, *order)
        named = self.hits(queries, k).join(self.chunks, ["segment", "place"]).select("query_id", "chunk_id", "score")
        asked = queries.where(F.size(tokens(F.col("text"))) > 0).select("query_id").distinct()
        short = asked.join(named.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("query_id")
        # A query with fewer than k hits finds enough others among the first 2k chunks.
        ids = [r["chunk_id"] for r in self.chunks.select("chunk_id").orderBy(F.col("chunk_id").asc_nulls_last()).limit(2 * k).collect()]
        fill = short.select("query_id", F.explode(F.array(*(F.lit(i).cast(kind) for i in ids))).alias("chunk_id")).join(named, ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", F.lit(0.0).alias("score"))
        return top(named.unionByName(fill), "query_id", k, *order)

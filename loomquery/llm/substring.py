"""Substring dedup by relative Lempel-Ziv parsing.

Documents are parsed against the text of all documents with smaller ids. That reference is cut into blocks by content: a window of WINDOW words
goes to the block that the smallest hash of its SEED-word grams names (its anchor), so equal windows meet in one block wherever they stand, neighbouring
windows mostly go to one block as one segment, and each window is looked up in the one block that can hold it. A block whose anchors are so common that it
would outgrow one task's memory is cut further, by the hash of each window; a count of windows for each block comes first and finds these.

A block indexes its text by window. A segment is parsed greedily from left to right: its first window that the reference holds is looked up, the reference
position is the first one in the document with the smallest id, and from there the factor is extended word by word for as long as segment and reference agree.
A factor is (start, length, source document, source position). The next factor begins with the window one word after the last that fits, which straddles the factor's end,
so windows over factor boundaries are looked up themselves, and those that straddle two segments were sent to their own blocks. Factors of several blocks that
continue each other in one source become one (``duplicate_factors``). The source is the first occurrence, not the longest of all; the words covered are the same.
Factors of fewer than WINDOW words don't arise; the others are duplicate spans.

Windows that repeat within one chunk of input are parsed before the shuffle, against the chunk as the reference block, and only those of the smallest document of
each go on, so a passage that a third of all documents share reaches its block once for each chunk of input.

A row's spans find it again by its id and 128 bits of hash of its text, so texts that share an id, or have none, keep their own.

Defined results: a null text has no words; texts shorter than a window stay whole; a text of any length is parsed whole; rows with one id are one document (none is a
duplicate of the other), and each is cut by the spans of its own text; a null id is larger than all others; an empty table gives an empty table; extra columns are ignored (``drop_duplicate_spans`` keeps them).
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, keyed_texts, map_batches, materialize, n_partitions, ship_package, table
from .textgrams import U, mix, runs, slices

WINDOW = 13
SEED = 3
BLOCK_BYTES = 6 << 20
CHUNK_WORDS = 400_000
SLICE_BYTES = 1 << 20
#: A block of more windows than this is cut into pieces of about half as many.
HOT_WINDOWS = 4_000_000
#: The bound on such blocks, whose numbers go to every task (16 bytes each): the more windows there are, the larger a block may be.
MAX_HOT = 1_000_000
NO_ID = np.iinfo(np.int64).max
#: What tells a row from others: its id and two hashes of its text.
ROW = np.dtype([("id", "<i8"), ("a", "<i8"), ("b", "<i8")])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width], by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def _planes(x: np.ndarray) -> bytes:
    """Bytes of integers, most alike ones together, for the shuffle's compression."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


class Dealer:
    """Which block a window goes to. hot: (block, pieces) of the blocks that are cut by window."""

    def __init__(self, window: int, n_blocks: int, hot: list[tuple[int, int]] = ()):
        self.window, self.n_blocks = window, n_blocks
        self.hot = np.array(sorted(b for b, _ in hot), np.int64)
        self.pieces = np.array([p for _, p in sorted(hot)], np.int64)
        self.base = n_blocks + np.cumsum(self.pieces) - self.pieces

    def blocks(self, words, whole: np.ndarray) -> np.ndarray:
        seeds = sliding_min(words.grams(SEED), self.window - SEED + 1)
        return (mix(seeds[whole]) % U(self.n_blocks)).astype(np.int64)

    def cut(self, block: np.ndarray, gram: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return block
        at = np.minimum(np.searchsorted(self.hot, block), len(self.hot) - 1)
        piece = (mix(gram ^ U(0x5851F42D4C957F2D)) % self.pieces[at].astype(U)).astype(np.int64)
        return np.where(self.hot[at] == block, self.base[at] + piece, block)


class Chunk:
    """Words of a run of input documents: parses what repeats within it, and deals the rest to blocks."""

    def __init__(self, dealer: Dealer):
        self.dealer = dealer
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.words = 0

    def add(self, rows: np.ndarray, words) -> None:
        """rows: the ROW of each document of ``words``."""
        self.words += len(words.hashes)
        whole = np.flatnonzero(words.whole(self.dealer.window))
        if not len(whole):
            return
        doc, gram = words.doc[whole], words.grams(self.dealer.window)[whole]
        self.parts.append((gram, rows[doc], (whole - words.first[doc]).astype(np.uint32), self.dealer.cut(self.dealer.blocks(words, whole), gram)))

    def settle(self):
        """(factors, segments): factors as by parse(); segments are (block, packed bytes)."""
        if not self.parts:
            return None
        gram, rows, start, block = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts, self.words = [], 0
        # Windows of a document lie in reading order; a change of row or a gap ends a segment.
        begins = np.empty(len(gram), bool)
        begins[0] = True
        begins[1:] = (np.diff(start.astype(np.int64)) != 1) | (rows[1:] != rows[:-1])
        at, source, n, found = parse(gram, rows["id"], begins)
        factors = (rows[at], start[at], n, rows["id"][source], start[source])
        at, n = runs(~found, np.cumsum(begins), block)
        if not len(at):
            return factors, []
        order = np.argsort(block[at], kind="stable")
        at, n = at[order], n[order]
        owner = block[at]
        cuts = np.flatnonzero(np.diff(owner)) + 1
        segments = []
        for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
            s, k = at[a:b], n[a:b]
            inside = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(s, k)
            head = [_planes(rows[s]), _planes(start[s]), _planes(k.astype(np.uint32))]
            segments.append((int(owner[a]), np.array([len(s)], np.uint32).tobytes() + b"".join(head) + gram[inside].tobytes()))
        return factors, segments


def first_sources(gram: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each window, where the first equal one of the smallest id is, if that id is smaller than its own; else -1."""
    order = np.argsort(gram, kind="stable")
    g, i = gram[order], ids[order]
    new = np.empty(len(g), bool)
    new[0] = True
    np.not_equal(g[1:], g[:-1], out=new[1:])
    start = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    low = np.minimum.reduceat(i, start)[group]
    out = np.full(len(g), -1)
    hit = np.flatnonzero(i > low)
    if len(hit):
        smallest = np.flatnonzero(i == low)
        first = np.empty(len(start), np.int64)
        first[group[smallest[::-1]]] = order[smallest[::-1]]
        out[order[hit]] = first[group[hit]]
    return out


def parse(gram: np.ndarray, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """The greedy factors of all segments against the whole block: (place, place in the reference, windows) of each, and which windows they cover.

    begins: where a segment begins. A factor ends at the end of either segment.
    """
    source = first_sources(gram, ids)
    found = source >= 0
    at = np.flatnonzero(found)
    if not len(at):
        return at, at, at, found
    # Runs in which each window's first source follows the one before it need no further look at the reference.
    s = source[at]
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = (np.diff(at) != 1) | (np.diff(s) != 1) | begins[at[1:]] | begins[s[1:]]
    first = np.flatnonzero(new)
    at, s, n = at[first], s[first], np.diff(first, append=len(at))
    ends = np.append(np.flatnonzero(begins)[1:], len(gram))
    number = np.cumsum(begins) - 1
    end, source_end = ends[number[at]], ends[number[s]]
    further = (at + n < end) & (s + n < source_end)
    further[further] = gram[(at + n)[further]] == gram[(s + n)[further]]
    if not further.any():
        return at, s, n, found
    out, covered = [], 0
    for i, q, k, more, e, f in zip(at.tolist(), s.tolist(), n.tolist(), further.tolist(), end.tolist(), source_end.tolist(), strict=True):
        if i + k <= covered:
            continue
        if i < covered:
            i, q, k = covered, q + covered - i, i + k - covered
        if more:
            while i + k < e and q + k < f and gram[i + k] == gram[q + k]:
                k += 1
        out.append((i, q, k))
        covered = i + k
    at, s, n = np.array(out, np.int64).T
    return at, s, n, found


def unpack(raw: bytes, kinds: tuple = (ROW, "<u4", "<u4")) -> tuple[np.ndarray, ...]:
    """Of segments the row, start and length of each, and what follows: the windows of all."""
    (n,) = np.frombuffer(raw[:4], np.uint32)
    n, at, out = int(n), 4, []
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        out.append(_unplanes(raw[at : at + size], kind))
        at += size
    return *out, np.frombuffer(raw[at:], U)


def parse_block(packed: list[bytes]) -> tuple[np.ndarray, ...]:
    """Index a block and factor its segments: (row, start, windows, source id, source start) of each factor."""
    rows, start, length, gram = (np.concatenate(c) for c in zip(*map(unpack, packed), strict=True))
    first = np.cumsum(length.astype(np.int64)) - length
    begins = np.zeros(len(gram), bool)
    begins[first] = True
    owner = np.repeat(np.arange(len(length)), length)
    ids = rows["id"]
    at, source, n, _ = parse(gram, ids[owner], begins)
    place = lambda x: start[owner[x]] + (x - first[owner[x]])
    return rows[owner[at]], place(at), n, ids[owner[source]], place(source)


FACTORS = "doc_id long, text_a long, text_b long, start long, n long, source_id long, source_start long"
FACTOR_KINDS = (ROW, "<u4", "<u4", "<i8", "<u4")


def _factor_table(rows: np.ndarray, *columns: np.ndarray) -> pa.Table:
    flat = [rows[f] for f in ROW.names] + [c.astype(np.int64) for c in columns]
    return pa.table([pa.array(np.ascontiguousarray(c)) for c in flat], names=[x.split()[0] for x in FACTORS.split(", ")][: len(flat)])


def _pack_factors(*columns: np.ndarray) -> bytes:
    return np.array([len(columns[0])], np.uint32).tobytes() + b"".join(_planes(c.astype(k)) for c, k in zip(columns, FACTOR_KINDS, strict=False))


def _word_slices(batches):
    """(rows, or None without hashes; words) of runs of documents."""
    for batch in batches:
        rows = None
        if batch.num_columns > 2:
            rows = np.empty(batch.num_rows, ROW)
            rows["id"], rows["a"], rows["b"] = batch.column(0).fill_null(int(NO_ID)).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
        for a, b, words in slices(batch.column(1), lower=False, limit=SLICE_BYTES):
            yield None if rows is None else rows[a:b], words


def hot_blocks(texts: DataFrame, window: int, n_blocks: int) -> list[tuple[int, int]]:
    """(block, pieces) of the blocks that hold too many windows for one task; at most MAX_HOT."""

    def count(batches):
        dealer, held, n = Dealer(window, n_blocks), [], 0

        def emit():
            block, windows = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(block), pa.array(windows.astype(np.int64))], ["block", "n"])

        for _, words in _word_slices(batches):
            whole = np.flatnonzero(words.whole(window))
            if len(whole):
                held.append(dealer.blocks(words, whole))
                n += len(whole)
            if n > 4 * CHUNK_WORDS:
                yield emit()
                held, n = [], 0
        if held:
            yield emit()
        give_back()

    sizes = materialize(texts.mapInArrow(count, "block long, n long").groupBy("block").agg(F.sum("n").alias("n")), "lz_block_sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT_WINDOWS, -(-total // MAX_HOT))
    return [(r.block, -(-2 * r.n // limit)) for r in sizes.where(F.col("n") > limit).collect()]


def text_hashes(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit(1), text).alias("text_b")]


def factorise(docs: DataFrame, window: int = WINDOW, sources: bool = True) -> DataFrame:
    """One row for each factor: doc_id, text_a and text_b (hashes of the text), start and n (windows), source_id, source_start; a factor covers n + window - 1 words. NO_ID stands for null.

    Without ``sources`` the last two are left out of what is shuffled and returned. One shuffle: packed segments to their blocks. Factors that a chunk has settled travel with them, dealt out evenly.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = keyed_texts(docs)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(2 * n_partitions(spark), -(-total // BLOCK_BYTES))
    hot = hot_blocks(texts, window, n_blocks)
    width = 5 if sources else 3

    def deal(batches):
        chunk, turn = Chunk(Dealer(window, n_blocks, hot)), 0

        def emit():
            nonlocal turn
            settled = chunk.settle()
            if settled is None:
                return
            factors, segments = settled
            rows = [(block, False, packed) for block, packed in segments]
            if len(factors[0]):
                rows.append(((int(factors[0]["id"][0]) + turn) % n_blocks, True, _pack_factors(*factors[:width])))
                turn += 1
            for a in range(0, len(rows), 64):
                block, done, packed = zip(*rows[a : a + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(done), pa.array(packed, pa.binary())], ["block", "settled", "packed"])

        for keys, words in _word_slices(batches):
            chunk.add(keys, words)
            if chunk.words >= CHUNK_WORDS:
                yield from emit()
        yield from emit()
        give_back()

    def work(key, group):
        done, packed = group.column("settled").to_pylist(), group.column("packed").to_pylist()
        out = [unpack(p, FACTOR_KINDS[:width])[:width] for p, d in zip(packed, done, strict=True) if d]
        open_segments = [p for p, d in zip(packed, done, strict=True) if not d]
        if open_segments:
            out.append(parse_block(open_segments)[:width])
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        # Rows that are equal in id and text give equal factors: one of them is enough.
        order = np.lexsort((columns[1], *(columns[0][f] for f in ROW.names)))
        same = np.all([c[order][1:] == c[order][:-1] for c in columns[:3]], axis=0) if len(order) else np.zeros(0, bool)
        return _factor_table(*(c[order][np.append(np.ones(min(1, len(order)), bool), ~same)] for c in columns))

    dealt = texts.select("doc_id", "text", *text_hashes(F.col("text"))).mapInArrow(deal, "block long, settled boolean, packed binary")
    # The number of tasks follows the number of blocks, so that what a task reads doesn't grow with the input.
    n_tasks = max(n_partitions(spark), (n_blocks + sum(p for _, p in hot)) // 2)
    return dealt.repartition(n_tasks, "block").groupBy("block").applyInArrow(work, ", ".join(FACTORS.split(", ")[: width + 2]))


def duplicate_factors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The parse itself: doc_id, text_a, text_b, start, n_words, source_id, source_start of each factor; starts are counted in words from 0.

    Factors of different blocks that continue each other in one source are one.
    """
    order = Window.partitionBy("doc_id", "text_a", "text_b").orderBy("start", "n")
    before = lambda c: F.lag(c).over(order)
    follows = (before("start") + before("n") == F.col("start")) & (before("source_id") == F.col("source_id")) & (before("source_start") + before("n") == F.col("source_start"))
    numbered = factorise(docs, window).withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    joined = numbered.groupBy("doc_id", "text_a", "text_b", "run").agg(F.min("start").alias("start"), (F.sum("n") + window - 1).alias("n_words"), F.min("source_id").alias("source_id"), F.min("source_start").alias("source_start"))
    known = F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id"))
    return joined.select(known.alias("doc_id"), "text_a", "text_b", "start", "n_words", "source_id", "source_start")


def keep_words(text: str | None, spans: tuple[np.ndarray, np.ndarray] | None, window: int) -> tuple[int, int, list[bytes] | None]:
    """(number of words, number removed, the words that stay). spans: starts and windows of the factors."""
    words = (text or "").encode().split()
    if spans is None or not len(spans[0]):
        return len(words), 0, words
    start, n = spans
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n + window - 1, -1)
    keep = np.cumsum(edge[:-1]) == 0
    return len(words), int(len(words) - keep.sum()), [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def _with_spans(docs: DataFrame, window: int, *carried) -> DataFrame:
    """Texts squeezed for the shuffle, each with its spans."""

    n_rows = len(carried)

    def squeeze(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [None if not v.is_valid else zlib.compress(v.as_buffer(), 1) for v in batch.column(1)]
        ids = batch.column(0).fill_null(int(NO_ID))
        return pa.RecordBatch.from_arrays([ids, *batch.columns[2:4], pa.array(raw, pa.binary()), *batch.columns[4:]], ["doc_id", "text_a", "text_b", "packed", *(f"row{i}" for i in range(n_rows))])

    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *text_hashes(text), *(c.alias(f"row{i}") for i, c in enumerate(carried)))
    schema = "doc_id long, text_a long, text_b long, packed binary" + "".join(f", row{i} {source.schema[f'row{i}'].dataType.simpleString()}" for i in range(len(carried)))
    key = ["doc_id", "text_a", "text_b"]
    spans = factorise(docs, window, sources=False).groupBy(*key).agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return map_batches(source, squeeze, schema).join(spans, key, "left")


def _opened(batch: pa.RecordBatch, window: int):
    for packed, spans in zip(batch.column(0), batch.column(1), strict=True):
        raw = packed.as_py()
        found = None if not spans.is_valid else tuple(spans.values.field(i).to_numpy() for i in range(2))
        yield raw if raw is None else zlib.decompress(raw).decode(), found


def drop_duplicate_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with its columns; a text that loses words becomes the words that stay, joined by one space, and n_chars follows it."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    joined = _with_spans(docs, window, F.struct(*(F.col(f"`{c}`") for c in rest)))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, found in _opened(batch, window):
            _, removed, words = keep_words(text, found, window)
            out.append(b" ".join(words).decode() if removed else text)
        return pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.string())], ["row", "text"])

    kind = joined.schema["row0"].dataType.simpleString()
    done = map_batches(joined.select("packed", "spans", "row0"), work, f"row {kind}, text string")
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*((made[c] if c in made else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def span_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the words that stay, joined by one space)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, found in _opened(batch, window):
            n, removed, words = keep_words(text, found, window)
            rows.append((n, removed, hashlib.sha256(b" ".join(words)).hexdigest()))
        return pa.RecordBatch.from_arrays([batch.column(2), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = _with_spans(docs, window, F.col("doc_id").cast("long"))
    return map_batches(joined.select("packed", "spans", "row0"), work, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op9_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(table(spark, sf_dir, "documents"))


QUERIES = {"op9_relative_lz": op9_relative_lz}
ORACLES = {
    "op9_relative_lz": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(generate_series(1, len(w) - 12)) AS i, w FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, md5_number(array_to_string(w[i : i + 12], ' ')) AS h FROM p),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first_doc FROM g),
s AS (SELECT DISTINCT doc_id, i + o AS pos FROM f, (SELECT unnest(generate_series(0, 12)) AS o) WHERE first_doc < doc_id),
t AS (SELECT doc_id, i AS pos, w[i] AS word FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0)),
stay AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.pos) AS kept, count(*) AS n FROM t ANTI JOIN s ON s.doc_id = t.doc_id AND s.pos = t.pos GROUP BY t.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN stay USING (doc_id)
"""
}

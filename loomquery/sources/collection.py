"""The searchable collection: records from chunks, keyed upsert with its embeddings, a build of all kinds of chunks, and the cache of what a vision model said."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import images, ingest, retrieval
from .readers import recovered, write_json
from .shared import stored
from .store import KeyedStore, Ledger

#: What a record's metadata may hold, in order; a null is left out, and vision_failed is there only if true.
METADATA = ("scheme", "source_type", "source_filename", "source_filepath", "is_ocr_source", "parent_subfolder", "page_start", "page_end", "workflow_id", "image_xref", "content_hash", "vision_content_type")


def records(chunks: DataFrame, *carried: str) -> DataFrame:
    """chunk_id, document, metadata (a map of strings without nulls) of chunks (chunk_id, text and what they have of METADATA), and the carried columns."""
    pairs = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in METADATA if c in chunks.columns]
    if "vision_failed" in chunks.columns:
        pairs.append(F.struct(F.lit("vision_failed").alias("key"), F.when(F.col("vision_failed"), "true").alias("value")))
    return chunks.select("chunk_id", F.col("text").alias("document"), F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())).alias("metadata"), *carried)


#: Corpus statistics that follow a store of chunks; the empty term stands for chunks and words.
TERMS = Ledger("terms", ("term",), ("df", "cf"), retrieval.counted_terms)


def term_statistics(store: KeyedStore) -> DataFrame:
    """retrieval.term_counts of the store's chunks, without reading one."""
    return store.ledger(TERMS).where("term <> ''")


def sizes(store: KeyedStore) -> tuple[int, int]:
    """(chunks, words) of the store."""
    r = store.ledger(TERMS).where("term = ''").first()
    return (r["df"], r["cf"]) if r else (0, 0)


@dataclass(frozen=True)
class Upserted:
    """What an upsert did: rows given, rows whose embedding failed (they stay out), ids given more than once, rows of the collection afterwards."""

    n_given: int
    n_failed: int
    n_collisions: int
    n_after: int


def upsert(spark: SparkSession, chunks: DataFrame, path: str, version: str, connect: Callable | None = None, batch: int = 64) -> Upserted:
    """Records of chunks into the collection at path; of one id the last version counts, so a repeated upsert changes nothing.

    The table is a ``KeyedStore``: an upsert writes its own rows alone. ``connect()`` makes the embedding model of a task, which gets ``batch`` texts a call; a call that fails costs its own batch alone: those
    rows go to ``path``_failures with the error. A null text, or one whose vector has no length, fails without one: "no text", "no vector".
    """
    given, clashes = chunks.count(), ingest.collisions(chunks, "chunk_id").count()
    rows = ingest.latest(chunks, "chunk_id", F.col(version).desc())
    failed = 0
    if connect is not None:
        # Written once: the model isn't asked again by whoever reads the rows.
        vectors = stored(retrieval.embedded(rows.select("chunk_id", "text"), connect, "chunk_id", batch, errors=True), "embedded")
        lost = vectors.where("v is null").select("chunk_id", "error")
        failed = lost.count()
        if failed:
            lost.write.mode("append").parquet(f"{path}_failures")
        rows = records(rows, version).join(vectors.where("v is not null").select("chunk_id", "v"), "chunk_id")
    else:
        rows = records(rows, version)
    store = KeyedStore(spark, path, "chunk_id", version)
    store.apply(rows)
    return Upserted(given, failed, clashes, store.read().count())


def build(text_chunks: DataFrame | None, image_chunks: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, collisions, log) of a collection of both kinds; either may be left out (None).

    chunks: the union, missing columns null; collisions: the first 10 ids that occur more than once, with their number; log: one row for each kind of chunk, n and distinct ids.
    """
    parts = [p for p in (text_chunks, image_chunks) if p is not None]
    if not parts:
        raise ValueError("neither text nor images: nothing to build")
    union = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    clashes = ingest.collisions(union, "chunk_id").orderBy("chunk_id").limit(10)
    log = union.groupBy("source_type").agg(F.count("*").alias("n_chunks"), F.count_distinct("chunk_id").alias("n_ids"))
    return union, clashes, log


def build_collection(spark: SparkSession, text_chunks: DataFrame, image_chunks: DataFrame, path: str, version: str, connect: Callable | None = None, skip_text: bool = False, skip_images: bool = False, dry_run: bool = False) -> dict:
    """Both kinds of chunks into the collection at path; what was built is returned and written to ``path``_build as JSON. A dry run counts and writes nothing else."""
    union, clashes, kinds = build(None if skip_text else text_chunks, None if skip_images else image_chunks)
    log = {"dry_run": dry_run, "skip_text": skip_text, "skip_images": skip_images, "kinds": {r["source_type"]: r["n_chunks"] for r in kinds.collect()}, "collisions": [r["chunk_id"] for r in clashes.collect()]}
    if not dry_run:
        log |= asdict(upsert(spark, union, path, version, connect))
    write_json(spark.createDataFrame([(json.dumps(log, sort_keys=True),)], "log string"), f"{path}_build")
    return log


def put_sidecars(spark: SparkSession, extractions: DataFrame, path: str) -> None:
    """(content_hash, e struct of images.SIDECAR, version) into the vision cache at path, as JSON in folders by hash; the last version of a hash counts."""
    KeyedStore(spark, path, "content_hash", "version").apply(extractions.select("content_hash", F.to_json("e").alias("sidecar"), "version"))


def get_sidecars(spark: SparkSession, path: str, hashes: DataFrame | None = None) -> DataFrame:
    """What the cache holds and can read (images.cached), of some hashes if asked: then only their folders are read. Nothing where there is no cache."""
    cache = KeyedStore(spark, path)
    held = None
    if cache.exists:
        held = cache.read() if hashes is None else cache.read_keys(hashes.select("content_hash"))
    return images.cached(held.select("content_hash", "sidecar") if held is not None else spark.createDataFrame([], "content_hash string, sidecar string"))


def has_sidecar(spark: SparkSession, hashes: DataFrame, path: str) -> DataFrame:
    """content_hash, has, useful of the hashes asked for."""
    held = get_sidecars(spark, path, hashes).select("content_hash", F.lit(True).alias("has"), images.replies.useful(F.col("classification"), F.col("vision_failed")).alias("useful"))
    return hashes.select("content_hash").distinct().join(held, "content_hash", "left").na.fill(False)

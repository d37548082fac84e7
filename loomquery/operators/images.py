"""Images as chunks: what a vision model said of each distinct image, kept by content hash, beside every place where it occurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions import replies
from .chunking import image_chunk_id, image_text

_TEXT, _LISTS = fx.IMAGE_TEXT_FIELDS, tuple(f for f in fx.IMAGE_FIELDS if f not in fx.IMAGE_TEXT_FIELDS)
SIDECAR = "classification string, " + ", ".join(f"{f} {'string' if f in _TEXT else 'array<string>'}" for f in fx.IMAGE_FIELDS) + ", vision_failed boolean, attempt int, error string"


def extraction(reply: Column, classification: Column) -> Column:
    """A model's reply on one image as a struct with the fields of SIDECAR. A blank reply or one that is no JSON object fails, with a reason."""
    parsed = F.try_parse_json(replies.unfenced(reply))
    blank = F.coalesce(F.trim(reply), F.lit("")) == ""
    bad = blank | parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT")
    text = {f: F.when(bad, "").otherwise(F.coalesce(F.try_variant_get(parsed, f"$.{f}", "string"), F.lit(""))) for f in _TEXT}
    many = {f: F.when(bad, F.array().cast("array<string>")).otherwise(replies.string_list(reply, f)) for f in _LISTS}
    error = F.when(blank, "empty response body").when(bad, "json parse")
    return F.struct(classification.alias("classification"), *((text | many)[f].alias(f) for f in fx.IMAGE_FIELDS), F.coalesce(bad, F.lit(True)).alias("vision_failed"), F.lit(1).alias("attempt"), error.alias("error"))


def cached(sidecars: DataFrame) -> DataFrame:
    """content_hash and the fields of SIDECAR from (content_hash, sidecar JSON). A sidecar that can't be read, or of an unknown class, is a miss: it has no row."""
    read = sidecars.select("content_hash", F.from_json("sidecar", SIDECAR).alias("s")).select("content_hash", "s.*").where(F.col("classification").isin(*replies.VISION_CLASSES))
    return read.na.fill(False, ["vision_failed"]).na.fill(1, ["attempt"])


def image_chunks(occurrences: DataFrame, cache: DataFrame) -> DataFrame:
    """One chunk for each occurrence (content_hash, scheme, parent_subfolder, filename, page, xref) of an image that the cache finds useful or failed on.

    Chunks of one image share a text, except that a failure names its page. Images that the cache lacks, decorative and other ones have none.
    """
    fields = [(f, F.col(f)) for f in fx.IMAGE_FIELDS]
    lost = F.concat(F.lit(f"[IMAGE]\nclassification: vision_failed\ndescription: {fx.IMAGE_LOST}\nsource: "), "filename", F.lit(" page "), F.col("page").cast("string"), F.lit("\ncontent_hash: "), "content_hash", F.lit("\n[/IMAGE]"))
    bodies = cache.where(replies.useful(F.col("classification"), F.col("vision_failed"))).select("content_hash", "classification", "vision_failed", F.when(~F.col("vision_failed"), image_text(F.col("classification"), fields)).alias("body"))
    name = image_chunk_id(F.col("scheme"), F.col("parent_subfolder"), F.col("filename"), F.col("page"), F.col("xref"), F.col("content_hash"))
    return occurrences.join(bodies, "content_hash").select(
        name.alias("chunk_id"), F.coalesce("body", lost).alias("text"), "scheme", F.lit("image").alias("source_type"), "filename", F.col("page").alias("page_start"), F.col("page").alias("page_end"),
        "content_hash", F.col("classification").alias("vision_content_type"), "vision_failed",
    )


def coverage(candidates: DataFrame, cache: DataFrame) -> DataFrame:
    """class, n over distinct images: the cached class, vision_failed, or cache_miss."""
    kind = F.when(F.col("vision_failed"), "vision_failed").otherwise(F.coalesce("classification", F.lit("cache_miss")))
    return candidates.select("content_hash").distinct().join(cache, "content_hash", "left").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))

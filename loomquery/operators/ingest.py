"""Corpus building: listings, images, keyed upsert, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as fx


def prefer_ocr(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, pairs) of (folder, filename): X.pdf goes if X_OCR.pdf lies beside it; orphans stay."""
    ocr = files.where(F.col("filename").endswith("_OCR.pdf")).select("folder", F.col("filename").alias("preferred"), F.regexp_replace("filename", "_OCR\\.pdf$", ".pdf").alias("filename"))
    return files.join(ocr, ["folder", "filename"], "left_anti"), files.join(ocr, ["folder", "filename"]).select("folder", F.col("filename").alias("original"), "preferred")


def image_candidates(occurrences: DataFrame) -> DataFrame:
    """One row for each content hash of (content_hash, seq, area_ratio): count, largest area, its occurrence (the first of equals), and whether it is a watermark."""
    g = occurrences.where(F.col("area_ratio") >= fx.MIN_IMAGE_AREA).groupBy("content_hash").agg(F.count("*").alias("n"), F.max("area_ratio").alias("max_area"), F.max_by("seq", F.struct(F.col("area_ratio"), -F.col("seq"))).alias("representative"))
    return g.withColumn("watermark", (F.col("n") >= fx.WATERMARK_COUNT) & (F.col("max_area") <= fx.WATERMARK_AREA))


def image_occurrences(occurrences: DataFrame) -> DataFrame:
    """Each occurrence of the images that are kept, with its image's count and whether it is the representative: a watermark's go, and so do those below the size floor."""
    kept = image_candidates(occurrences).where("not watermark").select("content_hash", "n", "representative")
    return occurrences.where(F.col("area_ratio") >= fx.MIN_IMAGE_AREA).join(kept, "content_hash").withColumn("is_representative", F.col("seq") == F.col("representative")).drop("representative")


def image_diagnostics(occurrences: DataFrame) -> DataFrame:
    """One row: occurrences seen, those below the size floor, distinct images, those dropped as watermarks with their occurrences, and images kept."""
    seen = occurrences.agg(F.count("*").alias("n_occurrences"), F.count_if(F.coalesce(F.col("area_ratio") < fx.MIN_IMAGE_AREA, F.lit(True))).alias("n_below_floor"))
    c = image_candidates(occurrences)
    zero = lambda x: F.coalesce(x, F.lit(0))
    kept = c.agg(F.count("*").alias("n_images"), F.count_if("watermark").alias("n_watermarks"), zero(F.sum(F.when(F.col("watermark"), F.col("n")))).alias("n_watermark_occurrences"), F.count_if(~F.col("watermark")).alias("n_kept"))
    return seen.join(kept)


def content_hash(data) -> F.Column:
    return F.substring(F.sha2(data, 256), 1, 16)


def latest(rows: DataFrame, key: str, *order: F.Column) -> DataFrame:
    """Upsert: the last version of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def collisions(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def pending(questions: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return questions.join(done, key, "left_anti")

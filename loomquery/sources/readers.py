"""Sources and sinks."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..operators.ingest import latest, prefer_ocr
from .store import KeyedStore

_SOURCE = "struct<filename:string,page:int,note:string>"
_RULES = f"array<struct<attribute:string,values:array<string>,source:{_SOURCE}>>"
RULES_SCHEMA = (
    f"schemes array<struct<code:string,always_include:boolean,applicability_rules:{_RULES},disqualifying_rules:{_RULES},match_boost_if:{_RULES},required_information:array<struct<attribute:string,why_needed:string>>,"
    f"name:string,long_name:string,category:string,one_liner:string,key_benefits:array<string>,who_should_apply:string,how_to_register:map<string,string>,follow_up_query_hint:string,authoritative_source:{_SOURCE}>>"
)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, folder, filename, length of the files below root, sorted by path; contents aren't read. A root that isn't there has none."""
    if not exists(spark, root):
        return spark.createDataFrame([], "path string, folder string, filename string, length long")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
    return f.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.element_at(F.split("path", "/"), -1).alias("filename"), "length").orderBy("path")


def load_pages(spark: SparkSession, root: str, extract) -> DataFrame:
    """path, page, text, error of PDF files. ``extract(bytes)`` yields page texts (a failed page ""); a file on which it raises gives one row with an error, a file without pages one row without a page. A root that isn't there has none."""
    if not exists(spark, root):
        return spark.createDataFrame([], "path string, page int, text string, error string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(root).select("path", "content")

    def run(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(path, i, t or "", None) for i, t in enumerate(extract(content), 1)] or [(path, None, None, None)]
                except Exception as e:  # noqa: BLE001  a broken file is a result
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "error"]).astype({"page": "Int32"})

    return files.mapInPandas(run, "path string, page int, text string, error string")


def load_documents(spark: SparkSession, scheme: str, root: str, extract) -> DataFrame:
    """scheme, doc (the path), filename, parent_subfolder (null for files in the root itself), is_ocr_source, page, text, error: load_pages of one scheme, without files that an OCR version beside them replaces."""
    pages = load_pages(spark, root, extract)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    named = pages.withColumn("folder", folder).withColumn("filename", F.element_at(F.split("path", "/"), -1))
    gone = prefer_ocr(named.select("folder", "filename").distinct())[1].select("folder", F.col("original").alias("filename"))
    parent = F.element_at(F.split("folder", "/"), -1)
    in_root = F.col("folder").endswith(root.rstrip("/").removeprefix("file://"))
    return named.join(gone, ["folder", "filename"], "left_anti").select(
        F.lit(scheme).alias("scheme"), F.col("path").alias("doc"), "filename", F.when(~in_root, parent).alias("parent_subfolder"),
        F.col("filename").endswith("_OCR.pdf").alias("is_ocr_source"), "page", "text", "error",
    )


def load_corpus(spark: SparkSession, schemes: list[tuple[str, str]], extract) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, summary, failures) of (scheme, root) in their order.

    summary: scheme, pos, n_docs, n_empty (fewer than 100 characters), n_failed, total_pages, total_chars, a row for each scheme, roots that aren't there included; failures: scheme, doc, error.
    """
    pages = None
    for scheme, root in schemes:
        part = load_documents(spark, scheme, root, extract)
        pages = part if pages is None else pages.unionByName(part)
    return pages, summarise_corpus(pages, [s for s, _ in schemes]), pages.where("error is not null").select("scheme", "doc", "error")


def summarise_corpus(pages: DataFrame, schemes: list[str]) -> DataFrame:
    """The summary of load_corpus from pages (scheme, doc, page, text, error)."""
    per = corpus_summary(pages.where("error is null").withColumn("doc", F.struct("scheme", "doc"))).select("doc.scheme", "total_pages", "total_chars", "empty")
    good = per.groupBy("scheme").agg(F.count("*").alias("n_docs"), F.count_if("empty").alias("n_empty"), F.sum("total_pages").alias("total_pages"), F.sum("total_chars").alias("total_chars"))
    bad = pages.where("error is not null").groupBy("scheme").agg(F.count("*").alias("n_failed"))
    order = pages.sparkSession.createDataFrame([(s, i) for i, s in enumerate(schemes)], "scheme string, pos int")
    return order.join(good, "scheme", "left").join(bad, "scheme", "left").na.fill(0)


def load_workflows(spark: SparkSession, root: str) -> DataFrame:
    """path, pos, fields (map), error: rows of CSV files other than *_index.csv. BOM, blanks around names and values go; nulls are ""; surplus fields are joined under "".

    A file that can't be read as UTF-8 or as CSV gives one row with an error and none of its rows. A root that isn't there has none.
    """
    if not exists(spark, root):
        return spark.createDataFrame([], "path string, pos int, fields map<string,string>, error string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(root).select("path", "content").where(~F.col("path").endswith("_index.csv"))

    def run(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    read = csv.DictReader(io.StringIO(bytes(content).decode("utf-8-sig")))
                    rows += [(path, i, {(k or "").strip(): ", ".join(x.strip() for x in v) if isinstance(v, list) else (v or "").strip() for k, v in row.items()}, None) for i, row in enumerate(read)]
                except (UnicodeDecodeError, csv.Error) as e:  # a broken file is a result
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "pos", "fields", "error"]).astype({"pos": "Int32"})

    return files.mapInPandas(run, "path string, pos int, fields map<string,string>, error string")


def load_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rules, schemes, required) from a rule file; booleans in values become strings.

    rules have the place that each cites (filename, page, note); schemes what a match shows (answering.SHOWN), ``authority`` being where the scheme itself is described.
    """
    s = spark.read.schema(RULES_SCHEMA).option("multiLine", True).json(path).select(F.explode("schemes").alias("s")).select("s.*")
    kinds = (("applicability", "applicability_rules"), ("disqualifying", "disqualifying_rules"), ("boost", "match_boost_if"))
    rules = None
    for kind, column in kinds:
        part = s.select("code", F.lit(kind).alias("kind"), F.posexplode(column).alias("rule_idx", "r")).select("code", "kind", "rule_idx", "r.attribute", "r.values", "r.source.filename", "r.source.page", "r.source.note")
        rules = part if rules is None else rules.unionByName(part)
    required = s.select("code", F.posexplode("required_information").alias("idx", "r")).select("code", "idx", "r.attribute", F.col("r.why_needed").alias("why"))
    shown = ("name", "long_name", "category", "one_liner", "key_benefits", "who_should_apply", "how_to_register")
    schemes = s.select("code", F.coalesce("always_include", F.lit(False)).alias("always_include"), *shown, F.col("follow_up_query_hint").alias("follow_up"), F.col("authoritative_source").alias("authority"))
    return rules, schemes, required


def load_questions(spark: SparkSession, path: str, n: int = 0) -> DataFrame:
    """The first n questions in the file's order; all if n is not positive."""
    q = spark.read.option("multiLine", True).json(path).select(F.posexplode("questions").alias("pos", "q"))
    return (q.where(F.col("pos") < n) if n > 0 else q).select("pos", "q.*")


def append_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)


def _swap(spark: SparkSession, path: str) -> None:
    """Put the complete table at path.next in the place of the one at path, by renames alone. A crash leaves a whole table at path, path.old or path.next, which ``recovered`` finds."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    place = lambda suffix="": jvm.org.apache.hadoop.fs.Path(path + suffix)
    fs.delete(place(".old"), True)
    if fs.exists(place()):
        fs.rename(place(), place(".old"))
    fs.rename(place(".next"), place())
    fs.delete(place(".old"), True)


def recovered(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, a store of deltas or plain Parquet; of the latter, what a crash between two renames left of it: the next one if it is complete, else the old one. None if there is none."""
    held = KeyedStore(spark, path)
    if held.exists:
        return held.read()
    for suffix in ("", ".next", ".old"):
        if exists(spark, f"{path}{suffix}/_SUCCESS"):
            return spark.read.parquet(f"{path}{suffix}")
    return None


def upsert_parquet(spark: SparkSession, rows: DataFrame, path: str, key: str, version: str) -> None:
    """Last write wins: the next table is written whole beside the old one before it takes its place."""
    old = recovered(spark, path)
    both = rows if old is None else old.unionByName(rows, allowMissingColumns=True)
    latest(both, key, F.col(version).desc()).write.mode("overwrite").parquet(f"{path}.made")
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}.next"), True)
    fs.rename(jvm.org.apache.hadoop.fs.Path(f"{path}.made"), jvm.org.apache.hadoop.fs.Path(f"{path}.next"))
    _swap(spark, path)


def write_json(df: DataFrame, path: str) -> None:
    """One row as a JSON file of a run's folder: a small table, in one file, an earlier one replaced."""
    df.coalesce(1).write.mode("overwrite").json(path)


def corpus_summary(pages: DataFrame) -> DataFrame:
    """doc, total_pages, total_chars, empty. A row without a page, where there are pages, says that its document has none."""
    g = pages.groupBy("doc").agg(F.count("page" if "page" in pages.columns else "*").alias("total_pages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("total_chars"))
    return g.withColumn("empty", F.col("total_chars") < fx.EMPTY_PDF_CHARS)

"""From raw documents to token ids: quality rules, near-dedup, substring dedup, mixing, encoding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents. A stage works on every row that the one before kept.

Defined results for all stages: extra columns are carried whatever their names (the last stage returns ids and digests alone), texts of any length are
taken whole, an empty table gives an empty one with the same columns; nulls, ties and repeated rows are stated at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomquery.llm.bpe import default_tokenizer, encode_decode
from loomquery.llm.common import materialize
from loomquery.llm.mixing import mix_documents
from loomquery.llm.neardup import drop_near_duplicates
from loomquery.llm.quality import filter_quality
from loomquery.llm.substring import drop_duplicate_spans


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go: null, empty and short texts among them. Repeated rows stay or go together."""
    return filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (shingles of five words, similarity of 0.8 or more) the document with the smallest id stays.

    One row of repeated ones stays; a null id comes after all others; a text without words stays.
    """
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that a document with a smaller id has go from the text. A null id is larger than all others; rows with one id aren't copies of each other."""
    return drop_duplicate_spans(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources share the words by weight; a document that is taken more than once has as many rows. A null source is a source of its own; a text without words isn't taken."""
    return mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, and digests of ids and of the decoded text. A null text, which no earlier stage leaves, would be an empty one.

    The workers do the other stages too, so the memos are smaller than by default and go after each task.
    """
    return encode_decode(docs, *default_tokenizer(), with_ids=True, max_states=100_000, max_pieces=400_000, keep_codec=False)


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("source mix", mix_sources),
    ("byte-level BPE", encode),
]

#: Stages 2 and 5 are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is handed on is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage_{i + 1}")
    return docs

"""Quality rules as a bitmask ledger.

Every rule is evaluated once. The ledger, a stored table (``store_ledger``), keeps a document's measurements and one failure bit per rule; a
policy is a version with a mask of the bits that reject, so a new policy, or an ablation of one rule, is
bitwise work over the stored ledger and never reads a text again. ``filter_quality`` applies one policy to the rows
themselves on the way, without a ledger.

Defined results: a null text has no words and no lines, all its measurements are 0 and it fails
``too_few_words``; an empty text likewise; very long texts cost memory in proportion to one text; repeated rows
give repeated ledger rows; an empty table gives an empty ledger; extra columns are carried through or ignored,
never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, keyed_texts, map_batches, materialize, table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
REPEAT_WIDTH = 3

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts")

#: (name, SQL condition of failure). A rule's bit is its place here: append only, so stored bits keep their sense.
RULES = (
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("shouting", "100 * n_shouts > 30 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
)
BASE_RULES = ("too_few_words", "repeated_windows")
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    """The bits of the named rules."""
    return sum(BIT[n] for n in names)


#: Versioned policies: the failure bits that reject.
POLICIES = {
    "v1": mask(*BASE_RULES, "symbols", "duplicate_lines"),
    "v2": mask(*(n for n, _ in RULES)),
}


def repeated_window_words(words: list[bytes], width: int = REPEAT_WIDTH) -> int:
    """Words that lie in a window of ``width`` words which the list holds twice or more."""
    n = len(words)
    if n <= width:
        return 0
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, n)
    m = n - width + 1
    key, span = ids[:m].copy(), len(code)
    for j in range(1, width):
        if span * len(code) >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            span = m
        key *= len(code)
        key += ids[j : j + m]
        span *= len(code)
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    if not same.any():
        return 0
    repeated = np.zeros(m, bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for j in range(width):
        covered[j : j + m] |= repeated
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_window_words(words),
        len(lines),
        text.count("!!"),
    )


def _measured(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = list(zip(*(measure(t.as_py()) for t in batch.column(1)), strict=True))
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, pa.int64()) for r in rows)], ["doc_id", *MEASURES])


def failure_bits() -> Column:
    bits = F.lit(0).cast("long")
    for name, condition in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return bits


def build_ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, fail_bits; one row for each document, in one pass without a shuffle."""
    out = map_batches(keyed_texts(docs), _measured, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    return out.withColumn("fail_bits", failure_bits())


def store_ledger(docs: DataFrame) -> DataFrame:
    """The ledger, written once to the shared folder: policies and ablations read that table."""
    return materialize(build_ledger(docs), "quality_ledger")


def apply_policy(ledger: DataFrame, policy: int | str) -> DataFrame:
    """The ledger with base_failed and kept. ``policy`` is a version of POLICIES or a mask."""
    rejects = POLICIES[policy] if isinstance(policy, str) else policy
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(*BASE_RULES)).cast("long")) != 0
    return ledger.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("fail_bits").bitwiseAND(F.lit(rejects).cast("long")) == 0))


def ablations(ledger: DataFrame, policy: int | str) -> DataFrame:
    """For each rule of the policy: how many documents fail it, and how many only it rejects.

    The ledger first falls to one row for each pattern of bits (at most 2 to the number of rules).
    """
    rejects = POLICIES[policy] if isinstance(policy, str) else policy
    patterns = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(rejects).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name, _ in RULES if BIT[name] & rejects]
    if not rules:
        return ledger.sparkSession.createDataFrame([], "rule string, n_failed long, n_only_this long")
    per = patterns.select("bits", "n", F.explode(F.array(*rules)).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return per.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only_this"),
    )


def filter_quality(docs: DataFrame, policy: int | str = "v2") -> DataFrame:
    """The rows of docs that the policy keeps, with the columns of docs; one pass, no join."""
    name = free_name(docs, "_ledger")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    kind = row.schema["row"].dataType.simpleString()

    def carried(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(zip(*(measure(t.as_py()) for t in batch.column(1)), strict=True))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, pa.int64()) for r in rows)], ["row", *MEASURES])

    measured = map_batches(row, carried, f"row {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    verdict = apply_policy(measured.withColumn("fail_bits", failure_bits()), policy).withColumnRenamed("kept", name)
    return verdict.where(F.col(name)).select("row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = store_ledger(table(spark, sf_dir, "documents"))
    return apply_policy(ledger, "v2").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, text, words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
p AS (SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w WHERE len(words) >= 3),
g AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM p),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM g),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) WHERE k > 1 GROUP BY doc_id),
m AS (
  SELECT l.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines, ((length(text) - length(replace(text, '!!', ''))) // 2)::BIGINT AS n_shouts
  FROM l LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, __BITS__ AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
  (fail_bits & 127) = 0 AS kept, fail_bits FROM b
""".replace("__BITS__", "(" + " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, (_, c) in enumerate(RULES)) + ")::BIGINT")

QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLES = {"op2_quality_rules": ORACLE}

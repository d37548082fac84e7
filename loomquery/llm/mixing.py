"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash. A document's virtual finish time is its source's words up to and
with it, over the source's target: at virtual time v every source has given v times its target, so one global order
by finish time is the mix, and it is cut where the total budget is spent. Further passes over a source give each
document a further copy, one source size later.

Prefix sums never gather a source in one task. Rows fall into buckets of bounded size by hash, small per-bucket sums
are carried forward, and only the rows of one bucket are sorted together. The global order is a range partition of
virtual time. As every unit of it carries the same number of words, equal ranges are even without sampling; only
the range in which the budget runs out is refined, until few enough rows are left to sort exactly.

Defined results: a null text has size 0 and adds nothing; a null source is a source of its own, the last; sources without
words have target 0; a text of any length counts as its words; rows that are equal in id, source and text are taken together; ties are broken by source, copy and hash;
an empty table gives an empty mix; extra columns are ignored (``mix_documents`` keeps them).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, free_name, materialize, n_partitions, table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BUCKET_ROWS = 4_000
RANGES = 4_096
SEED = 20_240_501
HASH_BITS = 56


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget_share: float, max_repeats: int) -> DataFrame:
    """source, source_size, rank, target from (source, source_size): one row for each source.

    Targets are min(max_repeats x size, level x weight). In the order of max_repeats x size / weight the capped sources come
    first, so the level follows from running sums instead of rounds of resharing.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.col("source_size").cast("double") * max_repeats)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    everything = Window.partitionBy()
    s = s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(budget_share)))
    level = (F.col("budget") - (F.sum("cap").over(by_ratio) - F.col("cap"))) / (F.sum("w").over(everything) - F.sum("w").over(by_ratio) + F.col("w"))
    s = s.withColumn("capped", F.col("cap") / F.col("w") < level)
    left = F.col("budget") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(everything)
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * left / open_weight)))
    return s.select("source", "source_size", "rank", "target")


@dataclass(frozen=True)
class Cut:
    """The last finish that the budget holds: everything up to (finish, rank, copy, h, rk) is taken."""

    finish: float
    rank: int
    copy: int
    h: int
    rk: int


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))


def shuffle_hash() -> Column:
    """HASH_BITS bits of an MD5 of the id, or of the row's key where there is none; SQL can say it too."""
    return F.conv(F.substring(F.md5(F.encode(F.concat(F.lit(f"{SEED}-"), F.coalesce("doc_id", "rk").cast("string")), "UTF-8")), 1, HASH_BITS // 4), 16, 10).cast("long")


def decide(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_share: float = 1.0, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """doc_id, source, rk, n_rows, size, source_size, target, copies: one row for each distinct row of docs."""
    return queued(docs, weights, budget_share, max_repeats).drop("h", "rank", "upto")


def queued(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_share: float = 1.0, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """decide() with each row's place in its source's queue: h, rank (of the source), upto (words up to and with it)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_in_words(F.col("text").cast("string")).alias("size"), row_key(docs).alias("rk"))
    rows = materialize(rows.groupBy("doc_id", "source", "rk", "size").agg(F.count("*").alias("n_rows")).withColumn("h", shuffle_hash()), "mix_rows")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"))
    targets = materialize(source_targets(sizes, weights, budget_share, max_repeats), "mix_targets")
    n = rows.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    # Buckets are ranges of the hash, so the order doesn't depend on how many there are.
    rows = rows.withColumn("bucket", F.shiftright(F.shiftright("h", 28) * F.lit(buckets), HASH_BITS - 28))
    per = rows.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("n_rows")).alias("words"))
    per = per.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")).alias("p")
    r, t = rows.alias("r"), targets.alias("t")
    joined = r.join(per, F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bucket") == F.col("p.bucket"))).join(t, F.col("r.source").eqNullSafe(F.col("t.source")))
    within = Window.partitionBy("r.source", "r.bucket").orderBy("r.h", "r.rk", "r.doc_id")
    queue = materialize(joined.select("r.doc_id", "r.source", "r.rk", "r.h", "r.n_rows", "r.size", "t.source_size", "t.rank", "t.target", (F.col("p.before") + F.sum(F.col("r.size") * F.col("r.n_rows")).over(within)).alias("upto")), "mix_queue")
    cut = _cut(queue, budget_share, max_repeats)
    return queue.withColumn("copies", _copies(cut, max_repeats))


def _finish(copy: Column) -> Column:
    return (copy * F.col("source_size") + F.col("upto")) / F.col("target")


def _cut(queue: DataFrame, budget_share: float, max_repeats: int) -> Cut | None:
    """Where the budget ends. Only bounded facts reach the driver: the ends of one range, then one row."""
    budget = queue.select("rank", "source_size").distinct().agg((F.sum("source_size") * F.lit(float(budget_share))).alias("b")).first()["b"]
    if not budget:
        return None
    copies = queue.where("target > 0 and size > 0").select("rank", "h", "rk", (F.col("size") * F.col("n_rows")).alias("words"), F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("copy"), "source_size", "upto", "target").withColumn("finish", _finish(F.col("copy")))
    low, width, spent, last = 0.0, 4.0, 0.0, RANGES
    part = copies
    while True:
        place = F.least(F.floor((F.col("finish") - low) / (width / RANGES)), F.lit(last)).cast("long")
        totals = part.groupBy(place.alias("place")).agg(F.sum("words").alias("words"), F.count("*").alias("n"), F.min("finish").alias("low"), F.max("finish").alias("high"))
        running = totals.withColumn("upto", F.sum("words").over(Window.orderBy("place")))
        hit = running.where(F.col("upto") + F.lit(spent) > budget).orderBy("place").limit(1).first()
        if hit is None:
            return Cut(float("inf"), 0, 0, 0, 0)
        spent += hit["upto"] - hit["words"]
        part = part.where(F.col("finish").between(hit["low"], hit["high"]))
        if hit["n"] <= BUCKET_ROWS or hit["low"] == hit["high"]:
            break
        low, width, last = hit["low"], (hit["high"] - hit["low"]) * (1 + 1e-9), RANGES
    order = ["finish", "rank", "copy", "h", "rk"]
    fits = part.withColumn("total", F.sum("words").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("total") + F.lit(spent) <= budget)
    end = fits.orderBy(*(F.desc(c) for c in order)).select(*order).limit(1).first()
    if end is not None:
        return Cut(*end)
    first = part.agg(F.min("finish")).first()[0]
    return Cut(first, -1, -1, 0, 0)


def _copies(cut: Cut | None, max_repeats: int) -> Column:
    if cut is None:
        return F.lit(0)
    n = F.lit(0)
    for k in range(max_repeats):
        at = F.struct(_finish(F.lit(k)).alias("a"), F.col("rank").alias("b"), F.lit(k).alias("c"), F.col("h").alias("d"), F.col("rk").alias("e"))
        end = F.struct(F.lit(cut.finish).alias("a"), F.lit(cut.rank).alias("b"), F.lit(cut.copy).alias("c"), F.lit(cut.h).cast("long").alias("d"), F.lit(cut.rk).cast("long").alias("e"))
        n = n + F.when((F.col("target") > 0) & (at <= end), 1).otherwise(0)
    return n


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_share: float = 1.0, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: the rows of docs that are taken, each as often as it is taken, with the columns of docs."""
    key, n, taken = (free_name(docs, x) for x in ("_rk", "_copies", "_taken"))
    chosen = decide(docs, weights, budget_share, max_repeats).where("copies > 0").select(F.col("doc_id").alias(f"{key}_id"), F.col("rk").alias(f"{key}_rk"), F.col("copies").alias(n))
    with_key = docs.withColumn(key, row_key(docs))
    joined = with_key.join(chosen, (with_key[key] == chosen[f"{key}_rk"]) & with_key["doc_id"].cast("long").eqNullSafe(chosen[f"{key}_id"]))
    return joined.withColumn(taken, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*(joined[f"`{c}`"] for c in docs.columns))


def mix_in_order(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_share: float = 1.0, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """mix_documents in the order of the mix: the rows that are taken, with ``finish``, their virtual finish time, range-partitioned and sorted by it; its first words hold the sources by weight, and so do those of any part."""
    key, own, h, rank, rk, copy = (free_name(docs, x) for x in ("_row", "finish", "_h", "_rank", "_rk", "_copy"))
    q = queued(docs, weights, budget_share, max_repeats).where("copies > 0")
    q = q.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select(F.col("doc_id").alias(f"{key}_id"), F.col("rk").alias(rk), F.col("h").alias(h), F.col("rank").alias(rank), F.col("copy").alias(copy), _finish(F.col("copy")).alias(own))
    with_key = docs.withColumn(key, row_key(docs))
    joined = with_key.join(q, (with_key[key] == q[rk]) & with_key["doc_id"].cast("long").eqNullSafe(q[f"{key}_id"]))
    order = [own, rank, copy, h, rk]
    return joined.repartitionByRange(n_partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select(*(joined[f"`{c}`"] for c in docs.columns), own)


def op1_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = decide(table(spark, sf_dir, "documents"))
    rows = chosen.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", F.col("copies").cast("int").alias("copies"))


QUERIES = {"op1_fair_mix": op1_fair_mix}

_MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}'))::BIGINT AS size, ('0x' || left(md5('{SEED}-' || doc_id), {HASH_BITS // 4}))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
c AS (SELECT *, {list(map(float, WEIGHTS))}[(rank - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS w, source_size::DOUBLE * {MAX_REPEATS} AS cap, sum(source_size) OVER ()::DOUBLE AS budget FROM s),
l AS (SELECT *, cap / w < (budget - (sum(cap) OVER o - cap)) / (sum(w) OVER () - sum(w) OVER o + w) AS capped FROM c WINDOW o AS (ORDER BY cap / w, rank)),
t AS (SELECT *, CASE WHEN capped THEN cap ELSE least(cap, w * (budget - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE w END) OVER ()) END AS target FROM l),
q AS (SELECT d.*, source_size, rank, target, budget, sum(size) OVER (PARTITION BY rank ORDER BY h) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, (copy * source_size + upto)::DOUBLE / target AS finish FROM q, range({MAX_REPEATS}) AS n(copy) WHERE target > 0),
y AS (SELECT doc_id, sum(size) OVER (ORDER BY finish, rank, copy, h ROWS UNBOUNDED PRECEDING) <= budget AS fits FROM x),
z AS (SELECT doc_id, count(*) FILTER (fits) AS copies FROM y GROUP BY doc_id)
SELECT doc_id, size, source_size, target, (size * coalesce(copies, 0))::BIGINT AS taken, source, coalesce(copies, 0)::INT AS copies FROM q LEFT JOIN z USING (doc_id)"""
ORACLES = {"op1_fair_mix": _MIX_SQL}

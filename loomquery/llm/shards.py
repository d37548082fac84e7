"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised into bins of about equal weight, the cell of a document gets its index on the Hilbert
curve through the grid, documents are sorted by that index and the order is cut into runs with equal row counts. Neighbours on
the curve are neighbours in every dimension, so a shard covers a small box and min/max statistics of its files prune on each.

The sort is a range partition over (index, text hash, id hash), which also splits a cell, or a group of equal texts, that holds a
large share of all rows. Ranks come from row numbers within the written partitions plus one carried count for each partition.

Defined results: a null text has no bytes and checksum 0; a text of any length counts with its bytes alone; null metadata goes to bin 0; equal rows are
interchangeable and sit side by side; ties on the curve are broken by hashes of text and id; an empty table gives an empty table; extra columns are ignored (``write_shards`` keeps them).
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, n_partitions, table

N_SHARDS = 16
BITS = 4


def string_quantiles(rows: DataFrame, dims: tuple[str, ...], bins: int) -> dict[str, list[tuple[str, int]]]:
    """For each string column the values at which another 1 / bins of its rows ends, and how many such shares end there: whole strings count, whatever prefix they share.

    Only the table of distinct values is sorted, over all partitions; at most ``bins`` values of a column reach the driver.
    """
    spark = rows.sparkSession
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dims))).alias("v")
    counts = rows.select(each).select("v.*").where("value is not null").groupBy("dim", "value").agg(F.count("*").alias("rows"))
    dealt = materialize(counts.repartitionByRange(n_partitions(spark), "dim", "value").withColumn("part", F.spark_partition_id()), "shard_values")
    parts, dim = dealt.groupBy("dim", "part").agg(F.sum("rows").alias("part_rows")), Window.partitionBy("dim")
    carried = parts.select("dim", "part", (F.sum("part_rows").over(dim.orderBy("part")) - F.col("part_rows")).alias("before"), F.sum("part_rows").over(dim).alias("n"))
    within = F.sum("rows").over(Window.partitionBy("dim", "part").orderBy("value"))
    ends = dealt.withColumn("within", within).join(carried, ["dim", "part"]).withColumn("upto", F.col("before") + F.col("within"))
    out = {d: [] for d in dims}
    times = F.expr(f"upto * {bins} div n - (upto - rows) * {bins} div n").cast("int")
    for r in ends.select("dim", "value", times.alias("times")).where("times > 0").collect():
        out[r.dim].append((r.value, r.times))
    return out


def string_bounds(rows: DataFrame, dims: tuple[str, ...], bins: int) -> dict[str, list[str]]:
    """The values of string_quantiles alone."""
    return {d: [v for v, _ in q] for d, q in string_quantiles(rows, dims, bins).items()}


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a cell, from its coordinates of ``bits`` bits each (Skilling, "Programming the Hilbert curve", 2004).

    The state is the array of coordinates. A fold over (bit, axis) undoes the rotations and exchanges from the highest bit down; then the
    Gray code is taken and the bits are interleaved.
    """
    n = len(axes)
    step = lambda q, i: F.struct(F.lit(q).alias("q"), F.lit(i).alias("i"))
    steps = F.array(*(step(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(n)))

    def turn(x: Column, s: Column) -> Column:
        low, here = s["q"] - 1, F.element_at(x, s["i"] + 1)
        swap = F.element_at(x, 1).bitwiseXOR(here).bitwiseAND(low)
        inverted = F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
        exchanged = F.transform(x, lambda v, j: F.when((j == 0) | (j == s["i"]), v.bitwiseXOR(swap)).otherwise(v))
        return F.when(here.bitwiseAND(s["q"]) != 0, inverted).otherwise(F.when(s["i"] == 0, x).otherwise(exchanged))

    turned = F.aggregate(steps, F.array(*(a.cast("int") for a in axes)), turn)
    # Gray code: each coordinate is xored with those before it.
    gray = F.aggregate(turned, F.array().cast("array<int>"), lambda out, v: F.concat(out, F.array(F.when(F.size(out) == 0, v).otherwise(v.bitwiseXOR(F.element_at(out, -1))))))
    down = F.array(*(F.lit(1 << b) for b in range(bits - 1, 0, -1)))
    flip = lambda g: F.aggregate(down, F.lit(0), lambda t, q: F.when(F.element_at(g, -1).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    # Binding each result to a one-element array keeps the expression from being repeated where it is used twice.
    flipped = F.element_at(F.transform(F.array(gray), lambda g: F.transform(F.array(flip(g)), lambda t: F.transform(g, lambda v: v.bitwiseXOR(t)))[0]), 1)
    order = F.array(*(step(b, i) for b in range(bits - 1, -1, -1) for i in range(n)))
    weave = lambda x: F.aggregate(order, F.lit(0).cast("long"), lambda h, s: h * 2 + F.getbit(F.element_at(x, s["i"] + 1).cast("long"), s["q"]).cast("long"))
    return F.element_at(F.transform(F.array(flipped), weave), 1)


def quantise(value: Column, quantiles: list[tuple[int, int]] | list[tuple[str, int]]) -> Column:
    """How many shares of the rows end below the value, so that few values still spread over all bins; null goes to bin 0."""
    bins = F.lit(0)
    for bound, times in quantiles:
        bins = bins + F.when(value > F.lit(bound), times).otherwise(0)
    return bins


def curve_order(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, hilbert, rank (from 0, gapless, in curve order), n (rows in all)."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0).cast("long")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
        F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
    )
    narrow = materialize(narrow, "shard_rows")
    dims = ("lang", "source", "size", "doc_id")
    points = F.array(*(F.lit(i / (1 << bits)) for i in range(1, 1 << bits)))
    # At most 2^bits bounds for each dimension, whatever the input's size.
    numbers = narrow.agg(*(F.percentile_approx(d, points, F.lit(10_000)).alias(d) for d in dims[2:])).first().asDict()
    quantiles = string_quantiles(narrow, dims[:2], 1 << bits) | {d: sorted(Counter(b or []).items()) for d, b in numbers.items()}
    cells = narrow.withColumn("hilbert", hilbert_index([quantise(F.col(d), quantiles[d]) for d in dims], bits))
    keys = ["hilbert", "text_hash", "id_hash", "doc_id"]
    dealt = cells.withColumn("id_hash", F.xxhash64("doc_id")).select("doc_id", "size", "text_crc32", *keys[:3]).repartitionByRange(n_partitions(spark), *keys).sortWithinPartitions(*keys)
    numbered = materialize(dealt.withColumn("at", F.monotonically_increasing_id()), "shard_order")
    # The number holds the partition in its upper bits and the place within it in the lower 33.
    part = F.shiftright("at", 33).alias("part")
    counts = numbered.groupBy(part).agg(F.count("*").alias("rows"))
    carried = counts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"), F.sum("rows").over(Window.partitionBy()).alias("n"))
    return numbered.withColumn("part", F.shiftright("at", 33)).join(carried, "part").select("doc_id", "size", "text_crc32", "text_hash", "hilbert", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"), "n")


def cut_runs(ordered: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Shard and slot from rank: runs whose row counts are at most one apart."""
    shard = F.expr(f"rank * {n_shards} div n")
    return ordered.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("rank") - F.expr(f"(shard * n + {n_shards - 1}) div {n_shards}"))


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS) -> None:
    """Write docs as Parquet, one folder for each shard, rows in curve order.

    Rows that are equal in id and text keep their number: they are spread over the places of their group one by one.
    """
    key, nth = free_name(docs, "_text_hash"), free_name(docs, "_nth")
    places = cut_runs(curve_order(docs), n_shards).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("rank")).alias("_n"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    numbered = docs.withColumn(key, F.xxhash64(F.col("text").cast("string"))).withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", key).orderBy(F.lit(0))))
    joined = numbered.join(places, numbered["doc_id"].cast("long").eqNullSafe(places["_id"]) & (numbered[key] == places["_hash"]) & (numbered[nth] == places["_n"]))
    out = joined.select(*(joined[f"`{c}`"] for c in docs.columns), F.col("_shard").alias("shard_no"), "_slot")
    out.repartitionByRange(n_partitions(docs.sparkSession), "shard_no", "_slot").sortWithinPartitions("shard_no", "_slot").drop("_slot").write.partitionBy("shard_no").parquet(path)


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_runs(curve_order(table(spark, sf_dir, "documents")))
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


QUERIES = {"op8_hilbert_shards": op8_hilbert_shards}
ORACLES: dict[str, str] = {}

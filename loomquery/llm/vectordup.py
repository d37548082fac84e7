"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Vectors are compared within a label. Each is scaled to unit length and quantised once: q = round(u / s) with s = max|u| / 127, and the length of what that leaves out, e = |u - s q|, is kept
beside it. By Cauchy-Schwarz the product of two quantised vectors is off by no more than e_x + |s q|_x e_y. A label's vectors are dealt to blocks of about TILE, and each pair of
blocks is a tile, a task of its own: a product of small whole numbers, exact in single precision. Pairs whose bound stays below the threshold are no links, pairs that lie above it by the bound are links,
and those between, the few that the quantisation leaves open, are computed in double precision from the vectors themselves.

A tile returns no pairs: for each vector with links their number, and one vector of its component in the tile, so that a group of near copies costs as many rows as it has members. Equal
vectors are one class first, with a count, so copies cost nothing; links between them are counted.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components, or whose label is null, links with nothing, as do vectors of different lengths;
component_id is the smallest id that is reachable, null only if no row of the group has one, and kept says that a row's id is that one, so rows that repeat an id share it; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize, ship_package, spread_join, table
from .neardup import HUB, components, heavy_values

THRESHOLD = 0.93
TILE = 4_096
#: Rows and columns of a tile that are multiplied at once, and open pairs that are recomputed at once.
STEP = 1_024
OPEN = 1 << 14
#: Above the rounding of double arithmetic on unit vectors (about 1e-14 at 64 components).
ROUNDING = 1e-9
#: Products of int8 over so many components are exact in single precision.
EXACT_DIMS = 1_024


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component between 0.5 and 1: no rounding, no overflow later."""
    _, exponent = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -exponent[:, None])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, step of each row, length of the error of each row, rounded up)."""
    x = scaled(x)
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    step = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / step[:, None])
    error = np.sqrt(((unit - step[:, None] * q) ** 2).sum(axis=1)) + ROUNDING
    return q.astype(np.int8), step, error


class Side:
    """One block of a tile. at: where its rows stand among those of the tile."""

    def __init__(self, group: pa.Table, at: np.ndarray):
        rows = group.take(pa.array(at))
        self.at, self.n = at, rows.column("n").to_numpy().astype(np.float64)
        v = rows.column("v").combine_chunks().flatten().to_numpy().astype(np.float64)
        self.x = scaled(v.reshape(len(at), -1))
        self.square = np.einsum("ij,ij->i", self.x, self.x)
        self.step, self.error = rows.column("step").to_numpy(), rows.column("error").to_numpy()
        raw = b"".join(rows.column("q").to_pylist())
        self.q = np.frombuffer(raw, np.int8).reshape(len(at), -1).astype(np.float32)
        self.length = self.step * np.sqrt((self.q.astype(np.float64) ** 2).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number products of quantised rows."""
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], EXACT_DIMS):
        out += a[:, d : d + EXACT_DIMS] @ b[:, d : d + EXACT_DIMS].T
    return out


def linked(a: Side, b: Side, r: slice, c: slice, threshold: float) -> np.ndarray:
    """Which rows of a link with which of b."""
    near = products(a.q[r], b.q[c]) * a.step[r][:, None] * b.step[c][None, :]
    off = a.error[r][:, None] + a.length[r][:, None] * b.error[c][None, :] + ROUNDING
    sure = near - off >= threshold
    i, j = np.nonzero((near + off >= threshold) & ~sure)
    for at in range(0, len(i), OPEN):
        x, y = i[at : at + OPEN], j[at : at + OPEN]
        dot = np.einsum("ij,ij->i", a.x[r][x], b.x[c][y])
        sure[x, y] = dot / np.sqrt(a.square[r][x] * b.square[c][y]) >= threshold
    return sure


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest member of each component so far) after the links a - b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def settle_tile(group: pa.Table, i: int, j: int, threshold: float) -> pa.Table:
    """cls, links (rows that it links with in the tile), root (a class of its component in the tile): of the classes with links."""
    block = group.column("block").to_numpy()
    a = Side(group, np.flatnonzero(block == i))
    b = a if i == j else Side(group, np.flatnonzero(block == j))
    label, links = np.arange(group.num_rows), np.zeros(group.num_rows)
    for p in range(0, len(a.at), STEP):
        for q in range(p if a is b else 0, len(b.at), STEP):
            r, c = slice(p, p + STEP), slice(q, q + STEP)
            hit = linked(a, b, r, c, threshold)
            if a is b and p == q:
                hit = np.triu(hit, 1)
            x, y = np.nonzero(hit)
            if len(x):
                links[a.at[r]] += hit @ b.n[c]
                links[b.at[c]] += a.n[r] @ hit
                label = merge(label, a.at[r][x], b.at[c][y])
    cls, some = group.column("cls").to_numpy(), np.flatnonzero(links)
    return pa.table([pa.array(cls[some]), pa.array(links[some].astype(np.int64)), pa.array(cls[label[some]])], names=["cls", "links", "root"])


def usable(label: str, v: str):
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def vector_classes(rows: DataFrame) -> DataFrame:
    """key, cls (a number), n (rows), first_id, v, part (label and length), q, step, error: one row for each distinct usable vector of a label."""
    grouped = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.any_value("v").alias("v"), F.any_value("part").alias("part"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = batch.column(batch.schema.get_field_index("v"))
        values, ends = v.flatten().to_numpy().astype(np.float64), np.cumsum([0, *v.value_lengths().to_pylist()])
        q, step, error = [], [], []
        for n in np.unique(np.diff(ends)):  # almost always one length
            at = np.flatnonzero(np.diff(ends) == n)
            found = quantise(values[(ends[at][:, None] + np.arange(n)[None, :])])
            q += zip(at.tolist(), map(bytes, found[0]), strict=True)
            step += zip(at.tolist(), found[1].tolist(), strict=True)
            error += zip(at.tolist(), found[2].tolist(), strict=True)
        made = [pa.array([x for _, x in sorted(c)], t) for c, t in ((q, pa.binary()), (step, pa.float64()), (error, pa.float64()))]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "q", "step", "error"])

    kind = rows.schema["v"].dataType.simpleString()
    quantised = map_batches(grouped, work, f"key string, n long, first_id long, v {kind}, part string, q binary, step double, error double")
    return quantised.withColumn("cls", F.monotonically_increasing_id())  # stored at once, so each number stays with its vector


def tiles(classes: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """What the tiles return: cls, links, root, once for each tile in which a class has links."""
    ship_package(classes.sparkSession)
    sizes = materialize(classes.groupBy("part").agg(F.count("*").alias("n_part")).where("n_part > 1"), "vd_sizes")
    dealt = spread_join(classes.select("cls", "part", "n", "v", "q", "step", "error"), sizes, "part", sizes.where(F.col("n_part") > HUB).select("part"), "cls")
    n_blocks = F.ceil(F.col("n_part") / tile).cast("int")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cls"), n_blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    dealt = dealt.select("part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "n", "v", "q", "step", "error")

    def work(key, group):
        return settle_tile(group, key[1].as_py(), key[2].as_py(), threshold)

    return dealt.groupBy("part", "i", "j").applyInArrow(work, "cls long, links long, root long")


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of embeddings."""
    kind = embeddings.schema["embedding"].dataType.simpleString()
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    part = F.concat_ws(":", F.size("v"), "label")
    # Two hashes: 128 bits tell vectors apart.
    key = F.concat_ws(":", F.xxhash64("v", "label"), F.xxhash64(F.lit(1), "label", "v"))
    rows = materialize(rows.select("vec_id", F.when(usable("label", "v"), key).alias("key"), part.alias("part"), "v"), "vd_rows")
    classes = materialize(vector_classes(rows), "vd_classes")
    found = materialize(tiles(classes, threshold, tile), "vd_tiles")
    labels = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    named = classes.select("cls", "key", "n", "first_id").join(labels, "cls", "left").join(links, "cls", "left")
    named = materialize(named.select("key", "n", "first_id", F.coalesce("label", "cls").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "vd_named")
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    facts = spread_join(named, smallest, "label", heavy_values(named, "label", named.count()), "key").select("key", "n_links", "component_id")
    heavy = named.where(F.col("n") > HUB).select("key")
    told = spread_join(rows.where("key is not null").select("vec_id", "key"), facts, "key", heavy, "vec_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    discard(classes, found)
    out = told.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_int8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_int8_neardup": op13_int8_neardup}
ORACLES = {
    "op13_int8_neardup": f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
u AS MATERIALIZED (SELECT *, sqrt(list_dot_product(x, x)) AS norm FROM e WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NOT NULL AND isfinite(y))) = len(x) AND len(list_filter(x, lambda y: y <> 0)) > 0),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND len(a.x) = len(b.x) AND a.r <> b.r WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= {THRESHOLD}),
t(a, b) AS (SELECT r, r FROM e UNION SELECT t.a, l.b FROM t JOIN l ON l.a = t.b),
m AS (SELECT t.a AS r, min(e.vec_id) AS component_id FROM t JOIN e ON e.r = t.b GROUP BY t.a),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM e JOIN m USING (r) LEFT JOIN n USING (r)
"""
}

"""Near-duplicate groups by b-bit MinHash.

One pass over the texts gives each document the size and a digest of its shingle set, N_HASHES minima, of which B low bits stay, packed as
bit planes, and one key for each band of minima. Documents with equal sets fall into one class before anything else, so copies cost
one counter each. Classes that share a band key are candidates. No step lists the pairs of a bucket:

1. In HEAD_BANDS of the bands each class is compared with the head (smallest class) of its bucket, by the collision-corrected estimate from bit counts. Estimates of
   LOOSE or more tie classes into clusters. Then all bands are looked at, but only buckets whose members lie in several clusters: those outside its largest one
   are compared with all of another cluster, and a likely pair ties the two. A candidate pair that could reach the threshold is then within one cluster: two classes that near to each other can't
   be both far from and near to the same head (the distance is a metric).
2. In clusters of more than GRID classes, likely pairs of class and head are confirmed on full shingle sets; confirmed links give components. In smaller clusters
   each class begins as a component.
3. A cluster that holds several components is settled exactly: its classes outside the largest component (probes) meet all its classes (base) in a
   grid of tasks, each with one block of at most about GRID probes and one of base. A first round on bit planes finds the classes with a likely partner in another component;
   a second confirms these on full sets. Tasks return one link for each component that they join, not pairs of classes.

Nothing is capped. With R rows in each of N bands, a pair of similarity s shares no band with chance (1 - s^R)^N, under 3e-6 at s = 0.8.

Defined results: a null text or one without words has an empty set, is linked with nothing and kept; with fewer words than a shingle the whole
sequence is the one shingle; a text of any length is shingled whole; equal texts are one class. Each row is judged by its own text: rows with one id and different
texts may lie in different groups, and rows that are equal have equal results. component_id is the smallest id of a row's group, null only if no row of it has an id;
a row is kept in ``near_duplicates`` if its id is that one, in ``drop_near_duplicates`` if it is the one row that stands for its group.
An empty table gives an empty table; extra columns are ignored (``drop_near_duplicates`` keeps them).

A cluster, band or hub of links that holds a large share of all rows is spread over all partitions before it meets its one fact (``spread_join``).
"""

from __future__ import annotations

import hashlib
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PATTERN, discard, free_name, keyed_texts, map_batches, materialize, spread_join, table
from .textgrams import U, mix, series, slices

N_HASHES = 256
B = 2
BAND_ROWS = 6
N_BANDS = 42
HEAD_BANDS = 10
WORDS_PER_SHINGLE = 5
THRESHOLD = 80
#: The estimate of a pair at the threshold lies this far below it with a chance under 1e-8 (about six standard deviations).
SLACK = 0.18
#: Estimates from here on tie classes into a cluster that is looked through exactly.
LOOSE = 0.45
GRID = 500
#: A band or a node of the link graph with more rows is spread over all partitions where it is joined.
HUB = 1_000

PLANES = tuple(f"p{i}" for i in range(B * N_HASHES // 64))
_A, _C = series(N_HASHES, 11).astype(np.uint32) | np.uint32(1), series(N_HASHES, 12).astype(np.uint32)
_BAND = series(N_BANDS, 13)


def shingle_sets(texts: pa.Array, k: int):
    """For each document in turn: its sorted distinct shingle hashes."""
    for a, b, words in slices(texts, lower=True):
        grams = words.grams(k)
        for i in range(b - a):
            start, end = words.first[i], words.first[i + 1]
            if end - start >= k:
                yield np.unique(grams[start : end - k + 1])
            elif end > start:
                yield _short(words.hashes[start:end])
            else:
                yield np.zeros(0, U)


def _short(hashes: np.ndarray) -> np.ndarray:
    """The whole sequence as one shingle; its length goes in, so it equals no longer one."""
    acc = hashes[:1].copy()
    for h in hashes[1:]:
        acc = acc * U(0xD6E8FEB86659FD93) + h
    return mix(acc + U(1000 + len(hashes)))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """N_HASHES minima of each (non-empty) set, over 32-bit permutations of its hashes."""
    flat, starts = np.concatenate(sets).astype(np.uint32), np.cumsum([0, *(len(s) for s in sets[:-1])])
    out, held = np.empty((len(sets), N_HASHES), U), np.empty_like(flat)
    for j in range(N_HASHES):
        np.multiply(flat, _A[j], out=held)
        held += _C[j]
        out[:, j] = np.minimum.reduceat(held, starts)
    return out


def pack_planes(low: np.ndarray) -> np.ndarray:
    """Low bits of minima as 64-bit planes: word w of plane p has bit p of minima 64w to 64w + 63."""
    weights = U(1) << np.arange(64, dtype=U)
    words = [(((low[:, w : w + 64] >> U(p)) & U(1)) * weights).sum(axis=1, dtype=U) for p in range(B) for w in range(0, N_HASHES, 64)]
    return np.stack(words, axis=1)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, cls (digest of the set), the bit planes, bands (one key each); the last three are null where the set is empty."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, cls, planes, bands = [], [], [], []
        held, size = [], 0

        def flush() -> None:
            nonlocal size
            full = [s for s in held if len(s)]
            if full:
                m = minima(full)
                packed = pack_planes(mix(m.copy()) & U((1 << B) - 1)).view(np.int64)
                keys = np.empty((len(full), N_BANDS), U)
                for j in range(N_BANDS):
                    key = np.full(len(full), _BAND[j], U)
                    for r in range(BAND_ROWS):
                        key = mix(key ^ m[:, j * BAND_ROWS + r])
                    keys[:, j] = key
                keys = keys.view(np.int64)
            at = 0
            for s in held:
                n.append(len(s))
                if len(s):
                    cls.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
                    planes.append(packed[at].tolist())
                    bands.append(keys[at].tolist())
                    at += 1
                else:
                    cls.append(None)
                    planes.append([None] * len(PLANES))
                    bands.append(None)
            held.clear()
            size = 0

        for s in shingle_sets(batch.column(1), k):
            held.append(s)
            size += len(s)
            if size > 100_000:
                flush()
        flush()
        columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*planes, strict=True)), pa.array(bands, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "cls", *PLANES, "bands"])

    return map_batches(keyed_texts(docs).withColumn("text_hash", F.xxhash64("text")), work, "doc_id long, text_hash long, n_shingles long, cls long, " + ", ".join(f"{p} long" for p in PLANES) + ", bands array<long>")


def estimate(a: str, b: str) -> Column:
    """Similarity of two aliased signatures: the share of equal minima, corrected for those whose low bits agree by chance."""
    words = N_HASHES // 64
    differ = F.lit(0)
    for w in range(words):
        word = F.lit(0).cast("long")
        for p in range(B):
            name = PLANES[p * words + w]
            word = word.bitwiseOR(F.col(f"{a}.{name}").bitwiseXOR(F.col(f"{b}.{name}")))
        differ = differ + F.bit_count(word)
    chance = 2.0**-B
    return (1 - differ / N_HASHES - chance) / (1 - chance)


def likely(a: str, b: str, threshold: int) -> Column:
    """Sizes and estimate allow the threshold."""
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * threshold) & (estimate(a, b) >= threshold / 100 - SLACK)


def digest(members: np.ndarray) -> int | None:
    """The class of a set."""
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True) if len(members) else None


def full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, k: int, name: str) -> DataFrame:
    """cls, members (the sorted set): one row for each class in ``wanted``, from the text of its first document."""
    firsts = classes.join(wanted, "cls", "left_semi").select(F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("h"))

    def collect(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(shingle_sets(batch.column(0), k))
        return pa.RecordBatch.from_arrays([pa.array(map(digest, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "members"])

    texts = keyed_texts(docs).withColumn("text_hash", F.xxhash64("text"))
    # By id and text: rows without an id, or that share one, are dealt by their texts.
    texts = texts.join(firsts.hint("merge"), texts["doc_id"].eqNullSafe(firsts["id"]) & (texts["text_hash"] == firsts["h"]), "left_semi").select("text")
    # Rows may repeat; one set for each class is enough.
    return materialize(map_batches(texts, collect, "cls long, members binary").join(wanted, "cls", "left_semi").dropDuplicates(["cls"]), name)


def reaches(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return 100 * both >= threshold * (len(x) + len(y) - both)


def confirm(sets: DataFrame, pairs: DataFrame, hubs: DataFrame, threshold: int, name: str) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the threshold. hubs: the classes that may be the a of any number of pairs."""

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = [reaches(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), threshold) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = sets.select(F.col("cls").alias("a"), F.col("members").alias("x")), sets.select(F.col("cls").alias("b"), F.col("members").alias("y"))
    joined = spread_join(pairs.select("a", "b").join(y, "b"), x, "a", hubs, "b").select("a", "b", "x", "y")
    return materialize(map_batches(joined, judge, "a long, b long"), f"{name}_links")


def _grid(rows: DataFrame, large: DataFrame | None) -> DataFrame:
    """rows (with cluster, cls, label) of open clusters, of which those in ``large`` may be of any size, dealt to tasks (cluster, i, j): block i of the probes with block j of the base."""
    parts = rows.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.sum("n").alias("n_base"), (F.sum("n") - F.max("n")).alias("n_probes")).where("n_probes > 0")
    dealt = spread_join(rows, sizes, "cluster", large, "cls").withColumn("ni", F.ceil(F.col("n_probes") / GRID).cast("int")).withColumn("nj", F.ceil(F.col("n_base") / GRID).cast("int"))
    h = F.xxhash64("cls")
    whole = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.pmod(h, F.col(n)).cast("int")
    base = dealt.withColumn("probe", F.lit(False)).withColumn("j", own("nj")).withColumn("i", F.explode(whole("ni")))
    probes = dealt.where("label <> largest").withColumn("probe", F.lit(True)).withColumn("i", own("ni")).withColumn("j", F.explode(whole("nj")))
    return base.unionByName(probes.select(base.columns)).drop("largest", "n_base", "n_probes", "ni", "nj")


class Block:
    """The rows of one task of the grid, as arrays."""

    def __init__(self, group: pa.Table, threshold: int):
        numbers = {c: group.column(c).to_numpy() for c in ("cls", "label", "n_shingles", "probe")}
        self.cls, self.label, self.n, probe = numbers["cls"], numbers["label"], numbers["n_shingles"], numbers["probe"].astype(bool)
        self.planes = np.stack([group.column(p).to_numpy() for p in PLANES], axis=1).view(U)
        self.probes, self.base = np.flatnonzero(probe), np.flatnonzero(~probe)
        self.threshold = threshold

    def partners(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Base rows of another component that are likely partners of a probe, and their estimates."""
        words = N_HASHES // 64
        x = self.planes[self.base] ^ self.planes[p]
        differ = np.zeros(len(self.base), np.int64)
        for w in range(words):
            any_bit = x[:, w].copy()
            for q in range(1, B):
                any_bit |= x[:, q * words + w]
            differ += np.bitwise_count(any_bit)
        chance = 2.0**-B
        estimates = (1 - differ / N_HASHES - chance) / (1 - chance)
        n, m = self.n[p], self.n[self.base]
        ok = (self.label[self.base] != self.label[p]) & (estimates >= self.threshold / 100 - SLACK) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * self.threshold)
        return self.base[ok], estimates[ok]


def settle_clusters(sets: DataFrame, classes: DataFrame, clustered: DataFrame, large: DataFrame | None, threshold: int) -> DataFrame:
    """Pairs (a, b) of labels whose components are linked within a cluster. clustered: cluster, cls, label; large: the clusters of more than GRID classes."""
    rows = clustered.join(classes.select("cls", "n_shingles", *PLANES), "cls")

    def find(key, group):
        block, live = Block(group, threshold), set()
        for p in block.probes:
            partners, _ = block.partners(p)
            if len(partners):
                live.add(int(block.cls[p]))
                live.update(block.cls[partners].tolist())
        return pa.table([pa.array(sorted(live), pa.int64())], names=["cls"])

    live = materialize(_grid(rows, large).groupBy("cluster", "i", "j").applyInArrow(find, "cls long").distinct(), "nd_live")

    def link(key, group):
        block = Block(group, threshold)
        members = group.column("members").combine_chunks()
        sets_of = {}

        def of(i: int) -> np.ndarray:
            if i not in sets_of:
                sets_of[i] = np.frombuffer(members[i].as_buffer(), U)
            return sets_of[i]

        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.get(x, x) != x:
                x = up[x]
            return x

        for p in block.probes:
            partners, estimates = block.partners(p)
            for q in partners[np.argsort(-estimates, kind="stable")].tolist():
                a, b = root(int(block.label[p])), root(int(block.label[q]))
                if a != b and reaches(of(p), of(q), threshold):
                    up[max(a, b)] = min(a, b)
        joined = sorted(up)
        return pa.table([pa.array([root(x) for x in joined], pa.int64()), pa.array(joined, pa.int64())], names=["a", "b"])

    return materialize(_grid(rows.join(live, "cls", "left_semi").join(sets, "cls"), large).groupBy("cluster", "i", "j").applyInArrow(link, "a long, b long"), "nd_settled")


def components(links: DataFrame) -> DataFrame:
    """cls, label over the classes in links: the smallest class that each can reach.

    Each round moves every class to the smallest neighbour of its smallest neighbour and contracts the links by that, so those within a
    settled part are gone before the next round and what is left shrinks fast.
    """
    links = links.select("a", "b").where("a <> b")
    edges = materialize(links.union(links.select(F.col("b"), F.col("a"))).distinct(), "cc_edges")
    labels = materialize(edges.select(F.col("a").alias("cls")).distinct().withColumn("label", F.col("cls")), "cc_labels")
    n = labels.count()
    while True:
        near = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("near"), F.count("*").alias("degree")), "cc_near")
        widest = near.agg(F.max("degree")).first()[0]
        if widest is None:
            discard(near, edges)
            return labels
        # A node of many links is what many ask for; without such nodes no join here is uneven.
        hubs = near.where(F.col("degree") > HUB).select("node") if widest > HUB else None
        named = lambda c: None if hubs is None else hubs.select(F.col("node").alias(c))  # noqa: B023, E731
        further = near.select(F.col("node").alias("near"), F.col("near").alias("to"))
        moves = materialize(spread_join(near.select("node", "near"), further, "near", named("near"), "node").select("node", "to"), "cc_moves")
        from_a, from_b = moves.select(F.col("node").alias("a"), F.col("to").alias("la")), moves.select(F.col("node").alias("b"), F.col("to").alias("lb"))
        half = spread_join(edges, from_a, "a", named("a"), "b")
        moved = materialize(spread_join(half, from_b, "b", named("b"), "a").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "cc_edges")
        to = moves.select(F.col("node").alias("label"), "to")
        relabelled = materialize(spread_join(labels, to, "label", heavy_values(labels, "label", n), "cls", "left").select("cls", F.coalesce("to", "label").alias("label")), "cc_labels")
        discard(near, moves, edges, labels)
        edges, labels = moved, relabelled


def heavy_values(rows: DataFrame, key: str, n: int) -> DataFrame | None:
    """The values that more than HUB of n rows share; not looked for where all rows together are few."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HUB).select(key) if n > 100 * HUB else None


def grouped_rows(docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, cls, component_id (smallest id of the group), first (the row that stands for the group): one row for each of docs; the last three are null without words."""
    sig = materialize(signatures(docs, k), "nd_signatures")
    full = sig.where(F.col("cls").isNotNull())
    classes = materialize(full.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"), F.max("n_shingles").alias("n_shingles"), *(F.max(p).alias(p) for p in PLANES)), "nd_classes")
    banded = full.select("cls", F.explode(F.slice("bands", 1, HEAD_BANDS)).alias("band")).distinct()
    buckets = materialize(banded.groupBy("band").agg(F.min("cls").alias("head"), F.count("*").alias("n")).where("n > 1"), "nd_buckets")
    hot = buckets.where(F.col("n") > HUB)
    p = spread_join(banded, buckets.drop("n"), "band", hot, "cls").where("head <> cls").select(F.col("head").alias("ka"), F.col("cls").alias("kb")).distinct()
    of = lambda k, x: classes.select(F.col("cls").alias(k), F.struct("n_shingles", *PLANES).alias(x))
    met = spread_join(p.join(of("kb", "b"), "kb"), of("ka", "a"), "ka", hot.select(F.col("head").alias("ka")), "kb")
    ties = materialize(met.where(estimate("a", "b") >= LOOSE).select(F.col("ka").alias("a"), F.col("kb").alias("b"), likely("a", "b", threshold).alias("likely")), "nd_ties")
    clusters = components(ties)

    placed = full.select("cls", "bands").join(clusters, "cls", "left").select(F.explode("bands").alias("band"), "cls", F.coalesce("label", "cls").alias("cluster")).distinct()
    mixed = materialize(placed.groupBy("band").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.count("*").alias("n")).where("low < high").select("band", "n"), "nd_mixed_bands")
    placed = materialize(spread_join(placed, mixed.select("band"), "band", mixed.where(F.col("n") > HUB), "cls"), "nd_mixed")
    sizes = placed.groupBy("band", "cluster").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("band").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("largest"))
    full_bands = mixed.where(F.col("n") > HUB)
    apart = materialize(spread_join(placed, largest, "band", full_bands, "cls").join(classes, "cls").select("band", "cls", "cluster", "largest", "n_shingles", *PLANES), "nd_apart")
    # Those outside the largest cluster are the fewer ones: they are copied to where the others of a full band are dealt.
    x = apart.where("cluster <> largest").select("band", F.struct("cls", "cluster", "n_shingles", *PLANES).alias("x"))
    y = apart.select("band", F.struct("cls", "cluster", "largest", "n_shingles", *PLANES).alias("y"))
    across = (F.col("x.cluster") != F.col("y.cluster")) & ((F.col("y.cluster") == F.col("y.largest")) | (F.col("x.cls") < F.col("y.cls"))) & likely("x", "y", threshold)
    met = spread_join(y, x, "band", full_bands, "y.cls").where(across)
    more = materialize(met.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), F.col("x.cluster").alias("ca"), F.col("y.cluster").alias("cb")).distinct(), "nd_more_ties")
    if more.limit(1).count():
        ties = ties.unionByName(more.select("a", "b", F.lit(True).alias("likely")))
        merged = components(more.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()).select(F.col("cls").alias("label"), F.col("label").alias("top"))
        alone = more.select(F.explode(F.array(F.struct(F.col("a").alias("cls"), F.col("ca").alias("label")), F.struct(F.col("b").alias("cls"), F.col("cb").alias("label")))).alias("r")).select("r.*")
        clusters = clusters.unionByName(alone).distinct().join(merged, "label", "left").select("cls", F.coalesce("top", "label").alias("label"))

    placed = materialize(clusters.select("cls", F.col("label").alias("cluster")), "nd_clusters")
    sets = full_sets(docs, classes, placed.select("cls"), k, "nd_sets")
    large = materialize(placed.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") > GRID).select("cluster"), "nd_large")
    if large.limit(1).count():
        in_large = spread_join(placed, large, "cluster", large, "cls").select("cls")
        star = confirm(sets, ties.where("likely").join(in_large, ties["a"] == in_large["cls"], "left_semi").select("a", "b"), hot.select(F.col("head").alias("a")), threshold, "nd_star")
        begun = components(star)
        clustered = placed.join(begun, "cls", "left").select("cluster", "cls", F.coalesce("label", "cls").alias("label"))
        links = star.unionByName(settle_clusters(sets, classes, materialize(clustered, "nd_clustered"), large, threshold))
    else:
        links = settle_clusters(sets, classes, placed.withColumn("label", F.col("cls")), None, threshold)
    labels = components(links)

    named = classes.select("cls", F.col("doc_id").alias("first_id"), "first").join(labels, "cls", "left").select("cls", "first_id", "first", F.coalesce("label", "cls").alias("label"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"), F.min("first").alias("first"))
    big = heavy_values(labels, "label", labels.count())
    of_class = materialize(spread_join(named.select("cls", "label"), smallest, "label", big, "cls").select("cls", "component_id", "first"), "nd_components")
    discard(classes, buckets, mixed, ties, clusters, placed, apart, more, sets, large, links, labels)
    return sig.select("doc_id", "text_hash", "n_shingles", "cls").join(of_class, "cls", "left")


def near_duplicates(docs: DataFrame, k: int = WORDS_PER_SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (it is the smallest)."""
    out = grouped_rows(docs, k, threshold).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, k: int = WORDS_PER_SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs that stay, with the columns of docs: one row of each group, and all without words.

    Rows are told apart by id and text, so a null id or one that several texts share costs no other row; the smallest id stays, a null id last.
    """
    rows = grouped_rows(docs, k, threshold).where("cls is not null")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    decided = materialize(rows.select("doc_id", "text_hash", stays.alias("stays")), "nd_decided")

    def of(pairs: DataFrame):
        return docs["doc_id"].cast("long").eqNullSafe(pairs["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == pairs["text_hash"])

    gone = decided.where("not stays").select("doc_id", "text_hash").distinct()
    again = decided.where("stays").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_hash")
    again = materialize(again, "nd_again")
    if not again.limit(1).count():
        return docs.join(gone, of(gone), "left_anti")
    key, hashed = free_name(docs, "_doc_id"), free_name(docs, "_text_hash")
    once = docs.join(again, of(again), "left_semi").withColumn(key, F.col("doc_id").cast("long")).withColumn(hashed, F.xxhash64(F.col("text").cast("string"))).dropDuplicates([key, hashed]).drop(key, hashed)
    rest = gone.union(again)
    return docs.join(rest, of(rest), "left_anti").unionByName(once)


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


QUERIES = {"op3_minhash_neardup": op3_minhash_neardup}

#: By set intersection of all pairs that share a shingle and a transitive closure: for small tables.
_NEAR_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD_PATTERN}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * c >= {THRESHOLD} * (nx.n + ny.n - c)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""
ORACLES = {"op3_minhash_neardup": _NEAR_SQL}

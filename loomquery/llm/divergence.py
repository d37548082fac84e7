"""Source divergence audit over deduplicated count columns.

Within a language each kept term has a sparse vector of counts by source. How far a source's use of a term lies from another's depends on that vector alone, and most
terms share theirs with many others, so terms are grouped by identical vector: every pair of sources is evaluated once for each distinct vector and multiplied by
the number of its terms. Terms themselves come back only for the ranking, and of those with one vector, which tie wherever they stand, only the first TOP by name can be ranked.

1. Tasks count terms by language and source over whole texts, in memos of bounded size, and say how many documents hold each; two shuffles sum these and gather a term's counts into its vector.
2. Distinct vectors get their multiplicity and first terms.
3. Blocks of about BLOCK vectors of one language are evaluated against the facts of its sources. A vector touches only the pairs in which one source has the term; pairs of sources
   that both lack it share one value, which is counted. A block gives sums by pair and the TOP terms of each source, so what leaves it doesn't grow with the block.

Whole numbers throughout: shares are p = 1 + floor(SCALE * (count + 1) / (N + V)) by long division (exact to 9e15 terms in a source), divergences floor((p - q)^2 / q).

Defined results: null text, lang and source count as ''; a group without terms, and a language without kept terms, has its pairs with value 0 and no term rows; a language of one
source has no pairs; texts of any length are counted whole, in pieces; repeated rows are documents of their own; ties are ranked by the item's UTF-8 bytes; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, materialize, ship_package, spread_join, table

MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
#: Vectors in a block, and cells of a block that are evaluated at once.
BLOCK = 4_096
CELLS = 1 << 18
#: Entries of a task's memo, and bytes of a text that are cut into terms at once.
MEMO = 200_000
PIECE = 1 << 20
HUB = 1_000

#: Bytes of terms with A-Z lowered; all others become blanks.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def pieces(raw: bytes):
    """The terms of a text, in lists of bounded length."""
    folded, at = raw.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), n_docs (documents that hold it)."""

    def count(batches):
        memo: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def emit():
            for (lang, source), (n, n_docs) in memo.items():
                terms = list(n)
                for a in range(0, len(terms), 50_000):
                    part = terms[a : a + 50_000]
                    columns = [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([n_docs[t] for t in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "n_docs"])
            memo.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                whole, seen = pieces(text.as_buffer().to_pybytes()), None
                for terms in whole:
                    if (lang, source) not in memo:
                        memo[lang, source] = Counter(), Counter()
                    n, n_docs = memo[lang, source]
                    size -= len(n)
                    n.update(terms)
                    distinct = set(terms)
                    if seen is None:
                        seen = distinct
                    else:
                        distinct -= seen
                        seen |= distinct
                    n_docs.update(distinct)
                    size += len(n)
                    if size > MEMO:
                        yield from emit()
                        size = 0
        yield from emit()
        give_back()

    ship_package(docs.sparkSession)
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return texts.mapInArrow(count, "lang string, source string, term string, n long, n_docs long")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, vec (source and count where it has one, by source) of the terms that enough documents of the language hold."""
    by_source = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    gathered = by_source.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vec"))
    return gathered.where(F.col("n_docs") >= min_docs).drop("n_docs")


def distinct_vectors(kept: DataFrame, top: int = TOP) -> DataFrame:
    """lang, vec, m (its terms), first (up to ``top`` of them, the smallest): one row for each distinct vector."""
    counts = kept.groupBy("lang", "vec").agg(F.count("*").alias("m"))
    smallest = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", "vec").orderBy("term"))).where(F.col("place") <= top)
    return counts.join(smallest.groupBy("lang", "vec").agg(F.array_sort(F.collect_list("term")).alias("first")), ["lang", "vec"])


def source_facts(docs: DataFrame, kept: DataFrame, vectors: DataFrame) -> DataFrame:
    """lang, n_terms (V), n_vectors, sources (name and N of each, by name): one row for each language that occurs."""
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = vectors.select("lang", "m", F.explode("vec").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum(F.col("e.n") * F.col("m")).alias("total"))
    named = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0).cast("long")).alias("total")))).alias("sources"))
    terms = vectors.groupBy("lang").agg(F.sum("m").alias("n_terms"), F.count("*").alias("n_vectors"))
    return named.join(terms, "lang", "left").select("lang", "sources", F.coalesce("n_terms", F.lit(0).cast("long")).alias("n_terms"), F.coalesce("n_vectors", F.lit(0).cast("long")).alias("n_vectors"))


def shares(count: np.ndarray, total: np.ndarray, n_terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + n_terms)), three digits at a time."""
    rest, by, out = count + 1, total + n_terms, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        rest = rest * 1_000
        out = out * 1_000 + rest // by
        rest = rest % by
    return out + 1


class Evaluation:
    """Distinct vectors of one language against all pairs of its sources."""

    def __init__(self, names: list[str], totals: np.ndarray, n_terms: int, top: int):
        self.names, self.totals, self.n_terms, self.top = names, totals, n_terms, top
        self.absent = shares(np.zeros(len(names), np.int64), totals, n_terms)
        self.values = np.zeros((len(names), len(names)), np.int64)
        self.best: list[list[tuple[int, str]]] = [[] for _ in names]

    def add(self, counts: np.ndarray, m: np.ndarray, first: pa.Array) -> None:
        """counts: vectors by sources; m: terms of each vector; first: the smallest of them."""
        held, p = counts > 0, shares(counts, self.totals, self.n_terms)
        q = shares(counts.sum(axis=1), self.totals.sum(), self.n_terms)
        for s in np.flatnonzero(held.any(axis=0)):
            rows = np.flatnonzero(held[:, s])
            own, other, weight = p[rows, s][:, None], p[rows], m[rows][:, None]
            square = (own - other) ** 2
            self.values[s] += (square // other * weight).sum(axis=0)
            # The other way round where the other source lacks the term; where it has it, its own turn says so.
            self.values[:, s] += np.where(held[rows], 0, square // own * weight).sum(axis=0)
            self._rank(s, rows, own[:, 0], q[rows], m, first)
        both = (held.T * m.astype(np.float64)) @ held  # whole numbers far below 2^53
        one = np.diag(both)
        neither = (m.sum() - one[:, None] - one[None, :] + both).astype(np.int64)
        self.values += neither * ((self.absent[:, None] - self.absent[None, :]) ** 2 // self.absent[None, :])

    def _rank(self, s: int, rows: np.ndarray, p: np.ndarray, q: np.ndarray, m: np.ndarray, first: pa.Array) -> None:
        over = p > q
        if not over.any():
            return
        rows, value = rows[over], (p - q)[over] ** 2 // q[over]
        order = np.argsort(-value, kind="stable")
        enough = np.flatnonzero(np.cumsum(m[rows[order]]) >= self.top)
        low = value[order[enough[0]]] if len(enough) else -1
        found = [(-int(v), t) for r, v in zip(rows[value >= low].tolist(), value[value >= low].tolist(), strict=True) for t in first[r].as_py()]
        self.best[s] = sorted(self.best[s] + found)[: self.top]

    def rows(self) -> tuple[list[str], list[str], list[str], list[int]]:
        """source, part, item, value."""
        out = [(a, "pair", b, int(self.values[i, j])) for i, a in enumerate(self.names) for j, b in enumerate(self.names) if i != j]
        out += [(a, "term", t, -v) for a, best in zip(self.names, self.best, strict=True) for v, t in best]
        return tuple(map(list, zip(*out, strict=True))) if out else ([], [], [], [])


def evaluated(vectors: DataFrame, facts: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value: of each block of vectors the sums by pair and the ``top`` terms of each source."""

    def work(key, block: pa.Table, fact: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        sources, n_terms = fact.column("sources")[0].as_py(), fact.column("n_terms")[0].as_py()
        names = [s["source"] for s in sources]
        evaluation = Evaluation(names, np.array([s["total"] for s in sources], np.int64), n_terms, top)
        vec, first, m = block.column("vec").combine_chunks(), block.column("first").combine_chunks(), block.column("m").to_numpy()
        step = max(1, CELLS // max(1, len(names)))
        for a in range(0, block.num_rows, step):
            part = vec.slice(a, step)
            entries = part.flatten()
            counts = np.zeros((len(part), len(names)), np.int64)
            owner = np.repeat(np.arange(len(part)), pc.list_value_length(part).to_numpy())
            counts[owner, pc.index_in(entries.field("source"), pa.array(names)).to_numpy(zero_copy_only=False)] = entries.field("n").to_numpy()
            evaluation.add(counts, m[a : a + step], first.slice(a, step))
        source, kind, item, value = evaluation.rows()
        return pa.table([pa.array([lang] * len(source), pa.string()), pa.array(source, pa.string()), pa.array(kind, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])

    n_blocks = F.ceil(F.col("n_vectors") / BLOCK).cast("int")
    held = facts.where("n_vectors > 0")
    large = held.where(F.col("n_vectors") > HUB).select("lang")
    dealt = spread_join(vectors, held.select("lang", n_blocks.alias("n_blocks")), "lang", large, "vec").withColumn("block", F.pmod(F.xxhash64("vec"), F.col("n_blocks")).cast("int"))
    told = held.select("lang", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"), "sources", "n_terms")
    groups = dealt.select("lang", "block", "vec", "m", "first").groupBy("lang", "block").cogroup(told.groupBy("lang", "block"))
    return groups.applyInArrow(lambda key, block, fact: work(key, block, fact) if block.num_rows else _nothing(), "lang string, source string, part string, item string, value long")


def _nothing() -> pa.Table:
    return pa.table([pa.array([], t) for t in (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())], names=["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language how far the others' terms are from its own (pair), and the terms that it uses more than the language does (term)."""
    kept = materialize(kept_terms(docs, min_docs), "div_kept")
    vectors = materialize(distinct_vectors(kept, top), "div_vectors")
    facts = materialize(source_facts(docs, kept, vectors), "div_facts")
    found = materialize(evaluated(vectors, facts, top), "div_evaluated")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    bare = facts.where("n_vectors = 0").select("lang", "sources", F.explode("sources.source").alias("source")).select("lang", "source", F.explode("sources.source").alias("item"), F.lit(0).cast("long").alias("value")).where("source <> item")
    ranked = pairs.unionByName(bare).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(*columns).unionByName(terms.select(*columns))


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op11_divergence_audit": op11_divergence_audit}
ORACLES = {
    "op11_divergence_audit": rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL),
c AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN n USING (lang, source, term)),
p AS (SELECT lang, source, term, n, (1 + ({SCALE}::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v))::BIGINT AS p FROM c JOIN v USING (lang)),
t AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
q AS (SELECT lang, term, (1 + ({SCALE}::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v))::BIGINT AS q FROM t JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM y WHERE part = 'pair' OR rank <= {TOP}
"""
}

"""The divergence audit, centroid clustering and embedding near-dedup against brute force, on odd rows and skewed groups."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomquery.llm import clustering, divergence, vectordup

DOCS = "doc_id long, text string, lang string, source string, term string, n int, vec string, value string, `rank` int"
VECTORS = "vec_id long, embedding array<float>, label int, v string, cls int, n string, key string, cluster int, part int"


def audited(rows):
    """Every row of the audit, from plain counts."""
    docs = [((lang or ""), (source or ""), [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for la, _, w in docs if la == lang for t in set(w))
        kept = sorted(t for t, n in held.items() if n >= 3)
        sources = sorted({s for la, s, _ in docs if la == lang})
        count = {s: Counter() for s in sources}
        for la, s, w in docs:
            if la == lang:
                count[s].update(w)
        total = {s: sum(count[s][t] for t in kept) for s in sources}
        share = lambda c, n: 1 + 1_000_000_000 * (c + 1) // (n + len(kept))  # noqa: B023, E731
        for s in sources:
            pairs = [(o, sum((share(count[s][t], total[s]) - share(count[o][t], total[o])) ** 2 // share(count[o][t], total[o]) for t in kept)) for o in sources if o != s]
            of = lambda t: (share(count[s][t], total[s]), share(sum(count[x][t] for x in sources), sum(total.values())))  # noqa: B023, E731
            terms = [(t, (of(t)[0] - of(t)[1]) ** 2 // of(t)[1]) for t in kept if count[s][t] > 0 and of(t)[0] > of(t)[1]]
            for part, found in (("pair", pairs), ("term", terms)):
                for i, (item, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or i <= 200:
                        out.append((lang, s, part, item, v, i))
    return Counter(out)


def test_audit_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)] + ["ÄRGER", "ärger", "naïve", "中文", "A", "a"]
    rows = []
    for i in range(160):
        source = "hot" if i % 3 == 0 else rng.choice(["s1", "s2", "s10", None, ""])
        text = " ".join(rng.choice(words[: rng.choice([20, 506])]) + rng.choice(["", ".", "1", "-x"]) for _ in range(rng.randrange(60)))
        rows.append((i, text, rng.choice(["en", "en", "de", None]), source))
    rows += [(1, None, "en", "bare"), (2, "", "xx", "only"), (3, "123 !?", "yy", "a"), (4, "   ", "yy", "b"), (None, "the the", "en", "s1"), (None, "the the", "en", "s1")]
    df = spark.createDataFrame([(*r, "q", 1, "q", "q", 1) for r in rows], DOCS)
    want = audited(rows)
    for block, memo, piece, cells in ((4096, 200_000, 1 << 20, 1 << 18), (7, 50, 16, 12)):
        for name, v in (("BLOCK", block), ("MEMO", memo), ("PIECE", piece), ("CELLS", cells), ("HUB", 3)):
            monkeypatch.setattr(divergence, name, v)
        got = Counter(tuple(r) for r in divergence.audit(df).collect())
        assert got == want
    assert divergence.audit(df.limit(0)).count() == 0


def test_audit_of_very_long_texts_and_ranks(spark):
    text = " ".join("x" + "".join(chr(97 + int(d)) for d in str(i)) for i in range(300_000))
    df = spark.createDataFrame([(i, text if i < 3 else "common " * 100_000, "en", "a" if i < 3 else "b") for i in range(6)], "doc_id long, text string, lang string, source string")
    got = divergence.audit(df).collect()
    terms = [r.item for r in sorted(got, key=lambda r: r["rank"]) if r.part == "term" and r.source == "a"]
    assert len(terms) == 200 and terms == sorted(terms) and sorted((r.source, r.item) for r in got if r.part == "pair") == [("a", "b"), ("b", "a")]


def test_shares_are_exact():
    counts = np.array([0, 1, 7, 10**15, 3 * 10**15], np.int64)
    for total, n in ((3 * 10**15, 10**9), (10, 1), (0, 1)):
        want = [1 + 10**9 * (c + 1) // (total + n) for c in counts.tolist() if c <= total]
        assert divergence.shares(counts[counts <= total], np.int64(total), n).tolist() == want


def clustered(rows, k=8, rounds=10):
    """vec_id, cluster, distance, inertias and digest, with plain integers."""
    kept = [(i, [math.floor(1024 * float(x)) for x in e]) for i, e, *_ in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is None, r[0] or 0, r[1]))
    c = [list(x) for _, x in order[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for step in range(rounds + 1):
        at = [min((far(x, y), j) for j, y in enumerate(c)) for _, x in kept]
        if step < rounds:
            for j in range(len(c)):
                own = [x for (_, x), (_, a) in zip(kept, at, strict=True) if a == j]
                if own:
                    c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    inertia = Counter()
    for d, j in at:
        inertia[j] += d
    fits = lambda d: d if d < 1 << 63 else None
    return Counter((i, j, fits(d), fits(inertia[j]), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, at, strict=True))


def vectors(n, rng, spread=1.0):
    centres = rng.normal(size=(12, 64))
    return [[float(np.float32(x)) for x in centres[rng.integers(12)] + spread * rng.normal(size=64)] for _ in range(n)]


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v, 0) for i, v in enumerate(vectors(150, rng, 0.4))]
    rows += [(200 + i, rows[3][1], 0) for i in range(60)]
    rows += [(300, None, 0), (301, [1.0] * 63, 0), (302, [1.0] * 65, 0), (303, [None] + [1.0] * 63, 0), (304, [math.nan] + [1.0] * 63, 0), (305, [math.inf] + [1.0] * 63, 0), (306, [], 0), (307, [0.0] * 64, 0), (None, rows[5][1], 0), (None, rows[6][1], 0), (7, rows[7][1], 0), (7, rows[8][1], 0)]
    df = spark.createDataFrame([(*r, "q", 1, "q", "q", 1, 1) for r in rows], VECTORS)
    assert Counter(tuple(r) for r in clustering.cluster(df).collect()) == clustered(rows)
    few = [(1, rows[1][1], 0), (2, rows[2][1], 0)]
    assert Counter(tuple(r) for r in clustering.cluster(spark.createDataFrame(few, "vec_id long, embedding array<float>, label int")).collect()) == clustered(few)
    assert clustering.cluster(df.limit(0)).count() == 0 == clustering.cluster(df.where("vec_id between 300 and 306")).count()


def test_clusters_of_large_components(spark):
    """Components beyond 64 bits: exact clusters and digests, null where a distance needs more than a long."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x * 10.0 ** (3 * (i % 12)))) for x in rng.normal(size=64)], 0) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert Counter(tuple(r) for r in clustering.cluster(df, rounds=4).collect()) == clustered(rows, rounds=4)


def test_block_norms_screen_and_never_lose():
    rng = np.random.default_rng(8)
    x = np.floor(np.array(vectors(400, rng, 0.2)) * 1024).astype(np.int64) * np.repeat([1, 3], 200)[:, None]
    c = clustering.Centroids(x[rng.choice(400, 16, replace=False)])
    norms = clustering.segment_norms(x, clustering.SEGMENTS)
    exact = ((x[:, None, :] - c.x[None]) ** 2).sum(axis=2)
    low = (x * x).sum(axis=1)[:, None] + c.squares[None] - 2 * (norms @ c.norms.T)
    number, best, computed = c.nearest(x, norms)
    assert (low <= exact).all() and (number == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all() and computed < 0.8 * exact.size
    squares = np.array([0, 1, 2, 3, 4, 24, 25, 26, (1 << 29) ** 2, (1 << 29) ** 2 - 1, (1 << 29) ** 2 + 1], np.int64)
    assert clustering.roots_up(squares).tolist() == [math.isqrt(s) + (math.isqrt(s) ** 2 < s) for s in squares.tolist()]
    for n in (0, 1, -1, (1 << 40) - 1, 1 << 40, -(1 << 40), -(1 << 40) - 1, 12345678901234567890123, -(1 << 200)):
        parts = clustering.limbs(n)
        assert sum(p << (clustering.LIMB * i) for i, p in enumerate(parts)) == n and all(abs(p) <= 1 << 40 for p in parts)


def near(rows, threshold=0.93):
    """vec_id, n_links, component_id, kept over all pairs in double precision."""
    good = lambda e: e is not None and len(e) > 0 and all(x is not None and math.isfinite(x) for x in e) and any(e)
    n = len(rows)
    links = defaultdict(set)
    for a in range(n):
        for b in range(a + 1, n):
            (_, x, la, *_), (_, y, lb, *_) = rows[a], rows[b]
            if la is not None and la == lb and good(x) and good(y) and len(x) == len(y) and np.dot(x, y) / math.sqrt(np.dot(x, x) * np.dot(y, y)) >= threshold:
                links[a].add(b)
                links[b].add(a)
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for y in links[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        first = min(ids) if ids else None
        out.append((rows[a][0], len(links[a]), first, rows[a][0] == first))
    return Counter(out)


@pytest.mark.parametrize("tile", [4096, 16])
def test_near_vectors_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(vectordup, "HUB", 5)
    monkeypatch.setattr(vectordup, "STEP", 8)
    rng = np.random.default_rng(9)
    single = lambda v: [float(np.float32(x)) for x in v]
    base = rng.normal(size=(8, 64))
    rows = [(i, single(base[i % 8] + (0.22 + 0.01 * (i % 9)) * rng.normal(size=64)), i % 3) for i in range(160)]
    rows += [(500 + i, rows[0][1], 0) for i in range(25)]
    step = rng.normal(size=64)
    rows += [(600 + i, single(step * math.cos(0.3 * i) + np.roll(step, 7) * math.sin(0.3 * i)), 5) for i in range(20)]  # a chain
    rows += [(1, rows[3][1], 0), (None, rows[4][1], 1), (None, single(rng.normal(size=64)), 1), (700, None, 1), (701, [0.0] * 64, 1), (702, [], 1), (703, [None] + [1.0] * 63, 1), (704, [math.nan] * 64, 1), (705, [math.inf] * 64, 1), (706, rows[0][1], None), (707, [1.0, 2.0], 1), (708, [2.0, 4.0], 1), (709, [3e38] * 64, 2), (710, [1e-44] * 64, 2), (711, [-3e38] * 64, 2)]
    df = spark.createDataFrame([(*r, "q", 1, "q", "q", 1, 1) for r in rows], VECTORS)
    assert Counter(tuple(r) for r in vectordup.near_vectors(df, tile=tile).collect()) == near(rows)
    assert vectordup.near_vectors(df.limit(0)).count() == 0


def test_bounds_hold_and_open_pairs_are_few():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 64)) * 10.0 ** rng.integers(-30, 30, 300)[:, None]
    x[150:] = x[:150] * (1 + 0.3 * rng.normal(size=(150, 64)))
    q, step, error = vectordup.quantise(x)
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    length = step * np.sqrt((q.astype(float) ** 2).sum(axis=1))
    off = error[:, None] + length[:, None] * error[None, :]
    near = vectordup.products(q.astype(np.float32), q.astype(np.float32)) * step[:, None] * step[None, :]
    assert (np.abs(unit @ unit.T - near) <= off).all() and np.median(off) < 0.03
    label = vectordup.merge(np.arange(9), np.array([8, 7, 3, 1]), np.array([7, 3, 5, 2]))
    assert label.tolist() == [0, 1, 1, 3, 4, 3, 6, 3, 3]

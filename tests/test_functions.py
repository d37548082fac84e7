"""Rules that SQL can't show, against plain Python."""

import random
import re

from pyspark.sql import functions as F

from loomquery.functions import fixed as fx
from loomquery.functions import text as tx
from loomquery.streaming import limiter


def test_scrub_is_idempotent_and_matches_python(spark):
    texts = ["a@b.co +91 98765 43210", "1234 5678 9012", "919876543210", "123456789012", "[REDACTED_EMAIL]", "", "9876543210.", "12345678901234"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    once, kinds = tx.scrub(F.col("text"))
    got = df.select("text", once.alias("once"), kinds.alias("kinds"), tx.scrub(once)[0].alias("twice")).collect()
    for r in got:
        want = r.text
        for name, p in (("EMAIL", fx.EMAIL), ("AADHAAR", fx.AADHAAR), ("PHONE", fx.PHONE)):
            want = re.sub(p, f"[REDACTED_{name}]", want)
        assert r.once == want == r.twice


def test_validation_order(spark):
    cases = {None: "empty", "": "empty", "  ": "empty", "\x00": "control_chars", "x": "too_short", "ab": "valid", "a" * 2000: "valid", "a" * 2001: "too_long", "developer mode now": "prompt_injection"}
    df = spark.createDataFrame([(k,) for k in cases], "q string")
    assert {r.q: r.r for r in df.select("q", tx.validation_reason(F.col("q")).alias("r")).collect()} == cases


def test_limiter_folds_admissions(spark):
    rng = random.Random(3)
    times = {c: sorted(rng.randrange(0, 400) / 2 for _ in range(120)) for c in range(3)}
    want = {}
    for c, ts in times.items():
        log, n = [], 0
        for t in ts:
            log = [x for x in log if x >= t - 60]
            if len(log) < 30:
                log.append(t)
                n += 1
        want[c] = n
    df = spark.createDataFrame([(c, t) for c, ts in times.items() for t in ts], "client long, t double")
    assert {r.client: r.n_admitted for r in limiter.limited(df).collect()} == want


def test_stream_admits_as_the_batch_does(spark, tmp_path):
    df = spark.createDataFrame([(1, float(t)) for t in range(50)], "client long, t double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("client long, t double").parquet(str(tmp_path / "in"))
    q = limiter.limited_stream(stream, limit=5, window_s=10).writeStream.format("memory").queryName("admitted").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT count(*) FROM admitted WHERE admitted").first()[0]
    assert got == limiter.limited(df, limit=5, window_s=10).first()["n_admitted"]


def test_guardrails_equal_python_re(spark):
    """Unicode digits, spaces and letters beside the patterns, two hits close together, and hits at the edges: as Python's own expressions see them."""
    import random
    import re

    rng = random.Random(3)
    parts = ["ignore", "Ignore", "all", "previous", "instructions", "god mode", "jailbreak mode", "you are now a different", "\u0938\u094d", "\u00a0", "\u2003", " ", " ", " ", "\n", "\x1c", "mode", "DAN", "\u212a", "\u017f", "show your system prompt", "[ end ]", "--- end", "x" * 30, "\u00e9", "_", "9", "act as another"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 14))) for _ in range(1500)] + ["god mode, jailbreak mode and so on and on", "a god mode"]
    compiled = [(n, re.compile(p, re.IGNORECASE)) for n, p in fx.INJECTION]

    def want(t):
        for n, p in compiled:
            m = p.search(t)
            if m:
                return n, t[max(0, m.start() - 20) : m.end() + 20][:200]
        return None, None

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.n, r.s) for r in df.select("i", tx.injection_name(F.col("t")).alias("n"), tx.injection_span(F.col("t")).alias("s")).collect()}
    assert [(t, got[i], want(t)) for i, t in enumerate(texts) if got[i] != want(t)] == []

    digits = "0123456789\u0966\u0967\u0968\uff11\u0664"
    bits = ["91", "+91", "98765", "43210", "9876543210", "1234", "5678", "9012", "-", " ", "\u00a0", ".", "x", "\u0939", "a.b@c.org", "@", "_", ",", "\u2003"]
    texts = ["".join(rng.choice(bits) if rng.random() < 0.8 else "".join(rng.choice(digits) for _ in range(rng.choice([4, 5, 10]))) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    plain = [(n, re.compile(p)) for n, p in (("email", fx.EMAIL), ("aadhaar", fx.AADHAAR), ("phone", fx.PHONE))]

    def scrubbed(t):
        kinds = []
        for n, p in plain:
            if p.search(t):
                kinds.append(n)
            t = p.sub(f"[REDACTED_{n.upper()}]", t)
        return t, kinds

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out, kinds = tx.scrub(F.col("t"))
    got = {r.i: (r.o, r.k) for r in df.select("i", out.alias("o"), kinds.alias("k")).collect()}
    staged = {r.i: (r.t, r.pii_kinds) for r in tx.scrub_rows(df, "t").collect()}
    assert got == staged and [(t, got[i], scrubbed(t)) for i, t in enumerate(texts) if got[i] != scrubbed(t)] == []

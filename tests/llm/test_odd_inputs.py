"""Null ids, rows that repeat, and extra columns whose names the operators use themselves."""

from collections import Counter

import pytest

from loomquery.llm import bpe, licences, mixing, neardup, quality, shards, substring, tiff, tokenfiles, warc

public_tokenizers = pytest.importorskip("public_tokenizers")

CLASHES = (
    "size", "rank", "row", "copies", "target", "taken", "bucket", "virtual", "source_size", "words", "n_words", "measures", "failed", "kept", "hash", "band", "sig", "shingles", "n_shingles", "component_id", "root", "key", "id", "ids", "start", "n_tokens",
    "shard", "slot", "file", "offset", "sentence", "licences", "payload", "media", "feature", "page", "pixels", "h", "curve", "x", "y", "run", "law", "window", "pos", "spans", "n_removed", "block", "doc", "d", "t", "w", "n", "i", "j", "_n", "_row", "_key", "part", "seq", "value", "TEXT_", "Size",
)
LONG = " ".join(f"w{i % 40}" for i in range(60))


@pytest.fixture(scope="module")
def odd(spark):
    base = [(None, LONG, "en", "s0", 3), (None, LONG, "en", "s0", 3), (None, None, None, None, None), (1, LONG + " end", None, None, None), (1, LONG + " end", None, None, None), (2, "ß\u0000 ퟿ \U0001f600 " + LONG, "de", "s1", 9), (3, " \t\n ", "fr", "", 3), (4, LONG, "en", "s0", 3)]
    names = [c for c in dict.fromkeys(CLASHES) if c.lower() not in {x.lower() for x in CLASHES[: CLASHES.index(c)]}]
    return spark.createDataFrame([(*r, *("q" for _ in names)) for r in base], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))


def test_filters_keep_columns_and_defined_rows(odd):
    for stage in (quality.filter_quality, neardup.drop_near_duplicates, substring.drop_duplicate_spans, mixing.mix_documents):
        out = stage(odd)
        assert out.columns == odd.columns and out.count() >= 0
        out.collect()
    assert quality.filter_quality(odd).where("doc_id = 1").count() in (0, 2)


def test_every_row_has_a_result(odd, spark, tmp_path):
    n = odd.count()
    assert quality.build_ledger(odd).count() == n
    assert licences.scan(odd).count() == n
    assert bpe.encode_decode(odd, *bpe.default_tokenizer()).count() == n
    assert tiff.media_digest(tiff.encode_media(odd)).count() == n
    path = public_tokenizers.path("word_bpe_49k.json")
    assert tokenfiles.lookup(tokenfiles.write_token_files(odd, path, f"file://{tmp_path}"), odd).count() == n
    placed = shards.cut_runs(shards.curve_order(odd)).collect()
    assert len(placed) == n and all(sorted(r.slot for r in placed if r.shard == s) == list(range(k)) for s, k in Counter(r.shard for r in placed).items())
    assert substring.span_digest(odd).where("doc_id = 4").count() == 1


def test_near_duplicates_of_odd_rows(odd):
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(odd, k=4).where("doc_id is not null").collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 1)} == got


def test_rows_with_one_id_are_judged_by_their_texts(spark):
    other = " ".join(f"v{i}" for i in range(60))
    third = " ".join(f"x{i}" for i in range(60))
    rows = [(3, LONG), (5, LONG), (5, other), (None, LONG), (None, third), (None, third), (None, None), (7, " ")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect())
    assert got == Counter([(3, 40, 3, True), (5, 40, 3, False), (5, 57, 5, True), (None, 40, 3, False), (None, 57, None, True), (None, 57, None, True), (None, 0, None, True), (7, 0, 7, True)])


@pytest.mark.parametrize("hub", [1, 1000])
def test_hubs_are_spread(spark, monkeypatch, hub):
    """Near copies of one text, and a chain: the same groups whether or not hubs are spread."""
    monkeypatch.setattr(neardup, "HUB", hub)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*words, f"end{i}"])) for i in range(30)] + [(100 + i, " ".join(f"c{j}" for j in range(i * 4, i * 4 + 120))) for i in range(8)] + [(200, "lone " + " ".join(f"z{j}" for j in range(80)))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: 0 for i in range(30)}, **{100 + i: 100 for i in range(8)}, 200: 200}


def test_near_dedup_drops_only_copies(spark):
    other = " ".join(f"v{i}" for i in range(60))
    third = " ".join(f"x{i}" for i in range(60))
    rows = [(None, LONG), (None, LONG), (1, LONG), (1, LONG), (1, LONG), (5, LONG + " end"), (5, other), (None, third), (None, third), (None, None), (7, " "), (7, " ")]
    got = Counter(tuple(r) for r in neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect())
    assert got == Counter([(1, LONG), (5, other), (None, third), (None, None), (7, " "), (7, " ")])


def test_mix_counts_repeated_rows(odd):
    rows = mixing.decide(odd).collect()
    assert sum(r.n_rows for r in rows) == odd.count()


def test_revisits_keep_odd_rows(spark):
    rec = "record_id long, kind string, url string, ts timestamp, headers map<string,string>, payload_digest string, part string, " + ", ".join(f"`{c}` string" for c in ("key", "rank", "status", "response_id", "bucket", "validator"))
    rows = [(None, "revisit", None, None, None, None, None, *"qqqqqq")] * 2 + [(1, None, "http://a/", None, None, None, None, *"qqqqqq"), (2, "revisit", "not a url", None, {}, "", "", *"qqqqqq")]
    assert Counter(r.record_id for r in warc.resolve_revisits(spark.createDataFrame(rows, rec)).collect()) == {None: 2, 2: 1}


def test_odd_rows_have_their_values(odd, spark, tmp_path):
    """Null ids and texts, repeated rows, white space alone: what each operator says of every row."""
    import hashlib
    import zlib

    import numpy as np
    import tiktoken
    from tokenizers import Tokenizer

    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    split = lambda t: (t or "").encode().split()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ledger = Counter((r.doc_id, r.n_words, r.word_chars, r.fail_bits & 1) for r in quality.build_ledger(odd).collect())
    assert ledger == Counter((d, len(split(t)), sum(len(w.decode()) for w in split(t)), int(len(split(t)) < 50)) for d, t, _ in rows)
    assert Counter(tuple(r) for r in quality.filter_quality(odd).select("doc_id", "text").collect()) == Counter((d, t) for d, t, _ in rows if quality.apply_policy(quality.build_ledger(spark.createDataFrame([(1, t)], "doc_id long, text string")), "v2").first().kept)
    path, pattern = bpe.default_tokenizer()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    packed = lambda t: np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()
    assert Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(odd, path, pattern).collect()) == Counter((d, sha(packed(t)), sha((t or "").encode())) for d, t, _ in rows)
    pad = lambda t: (t or "").encode() + bytes(-len((t or "").encode()) % 64 or (0 if t else 64))
    assert Counter((r.doc_id, r.payload_sha256, r.tail_crc32) for r in tiff.media_digest(tiff.encode_media(odd)).collect()) == Counter((d, sha(pad(t)), zlib.crc32(pad(t)[-64:])) for d, t, _ in rows)
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(vocabulary)
    crc = lambda x: zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    files = tokenfiles.lookup(tokenfiles.write_token_files(odd, vocabulary, f"file://{tmp_path}"), odd).orderBy("start").collect()
    assert Counter((r.doc_id, r.ids_crc32) for r in files) == Counter((d, crc(x)) for d, x, _ in rows)
    assert [r.start for r in files] == [sum(x.n_tokens for x in files[:i]) for i in range(len(files))] and [r.doc_id for r in files] == sorted((r.doc_id for r in files), key=lambda d: (d is not None, d))
    first = {}
    for d, x, _ in rows:
        for i in range(len(split(x)) - 12):
            g = tuple(split(x)[i : i + 13])
            first[g] = min(first.get(g, 1 << 63), 1 << 62 if d is None else d)
    removed = lambda d, x: len({i + o for i in range(len(split(x)) - 12) if first[tuple(split(x)[i : i + 13])] < (1 << 62 if d is None else d) for o in range(13)})
    assert Counter((r.doc_id, r.n_words, r.n_removed) for r in substring.span_digest(odd).collect()) == Counter((d, len(split(x)), removed(d, x)) for d, x, _ in rows)
    assert Counter((r.doc_id, r.n_sentences, r.licences) for r in licences.scan(odd).collect()) == Counter((d, int(bool(split(x)) and any(c.isascii() and c.isalnum() for c in x)), "") for d, x, _ in rows)
    sizes = Counter((r.doc_id, r["size"]) for r in mixing.decide(odd).collect() for _ in range(r.n_rows))
    assert sizes == Counter((d, len(split(x))) for d, x, _ in rows)


def test_very_long_texts(spark, tmp_path):
    """Five megabytes and 700000 words in one text, twice, through every operator on texts."""
    import hashlib
    import random

    rng = random.Random(8)
    words = [f"w{rng.randrange(400_000)}" for _ in range(700_000)]
    long = " ".join(words)
    df = spark.createDataFrame([(1, long, "en", "a", 1), (2, long + " Released under the MIT License.", "en", "a", 1), (3, "short", "en", "b", 1)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert {r.doc_id: r.n_words for r in quality.build_ledger(df).collect()} == {1: 700_000, 2: 700_005, 3: 1}
    assert {r.doc_id: r.licences for r in licences.scan(df.withColumn("text", df.text)).collect()} == {1: "", 2: "", 3: ""}
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substring.span_digest(df).collect()} == {1: (700_000, 0), 2: (700_005, 700_000), 3: (1, 0)}
    assert [(r.doc_id, r.start, r.n_words, r.source_id, r.source_start) for r in substring.duplicate_factors(df).collect()] == [(2, 0, 700_000, 1, 0)]
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: r.payload_bytes for r in tiff.media_digest(tiff.encode_media(df)).collect()}[1] == -(-len(long) // 64) * 64
    assert all(r.decodes for r in bpe.encode_decode(df, *bpe.default_tokenizer()).collect())
    assert len({(r.shard, r.slot) for r in shards.cut_runs(shards.curve_order(df)).collect()}) == 3
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    n = len(Tokenizer.from_file(vocabulary).encode(long, add_special_tokens=False).ids) + 1
    assert {r.doc_id: r.n_tokens for r in tokenfiles.lookup(tokenfiles.write_token_files(df, vocabulary, f"file://{tmp_path}"), df).collect()}[1] == n
    assert hashlib.sha256(long.encode()).hexdigest() in {r.kept_sha256 for r in substring.span_digest(df).collect()}


def colliding_texts():
    """Two texts of one CRC-32: the second has the words of a longer passage."""
    import random
    import zlib

    rng, seen = random.Random(12), {}
    while True:
        text = " ".join(f"k{rng.randrange(1 << 20)}" for _ in range(rng.choice([3, 61])))
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        if len(other.split()) != len(text.split()):
            return sorted((text, other), key=len)


@pytest.mark.parametrize("key", [None, 7])
def test_spans_of_texts_that_share_an_id_and_a_checksum(spark, key):
    short, long = colliding_texts()
    passage = " ".join(long.split()[10:50])
    rows = [(1, passage), (key, short), (key, long), (9 if key else None, "a clean text of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.n_words, r.n_removed) for r in substring.span_digest(df).collect()) == Counter([(1, 40, 0), (key, 3, 0), (key, 61, 40), (9 if key else None, 6, 0)])
    left = " ".join(long.split()[:10] + long.split()[50:])
    assert Counter(tuple(r) for r in substring.drop_duplicate_spans(df).collect()) == Counter([rows[0], rows[1], (key, left), rows[3]])


def test_one_piece_and_one_text_keep_the_bounds():
    """A piece of many letters and a text of many pieces: ids as the library's, states and pieces within their bounds."""
    import random

    import tiktoken

    path, pattern = bpe.default_tokenizer()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    c, rng = bpe.BpeCodec(path, pattern, max_states=3_000, max_pieces=500), random.Random(13)
    most = 0
    add = c.fst._add

    def counted(key):
        nonlocal most
        most = max(most, len(c.fst.threads) + 1)
        return add(key)

    c.fst._add = counted
    piece = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000))
    assert c.encode(piece) == enc.encode_ordinary(piece) and most <= 3_000 + bpe.STRIDE
    text = " ".join(f"w{i}" for i in range(20_000))
    assert c.encode(text) == enc.encode_ordinary(text) and len(c.memo) <= 500


def test_many_repeated_sentences_take_linear_time(spark):
    import time

    text = lambda *names: "\n".join(s for x, n in names for s in [licences.SENTENCES[x][0]] * n)
    rows = [(1, text(("bsd-use", 10_000), ("bsd-source", 10_000))), (2, text(("bsd-use", 5_000), ("bsd-source", 5_000), ("bsd-binary", 1))), (3, text(("bsd-binary", 5_000), ("bsd-source", 5_000), ("bsd-use", 5_000)))]
    began = time.time()
    got = {r.doc_id: r.licences for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "BSD-2-Clause", 3: ""} and time.time() - began < 120

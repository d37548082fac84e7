"""The training-data operators against brute force, round trips, and odd inputs."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomquery.llm import bpe, licences, mixing, neardup, quality, shards, substring, tiff, tokenfiles, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, rank int, row string"
public_tokenizers = pytest.importorskip("public_tokenizers")


def corpus(n=120, seed=7):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            t = list(base)
            for _ in range(rng.randrange(7)):
                t[rng.randrange(len(t))] = rng.choice(words)
            text = " ".join(t)
        elif kind == 1:
            text = passage + "\n" + " ".join(rng.choice(words) for _ in range(rng.randrange(80)))
        elif kind == 2:
            text = rows[-1][1] if rows else "x"
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 200)))
        rows.append((i, text, "en", f"s{i % 5}", len(text), "clash", 1, "r"))
    rows += [(n, None, None, None, None, None, None, None), (n + 1, "", "en", "s0", 0, "", 0, ""), (n + 2, "a b", "fr", None, 3, "", 0, ""), (n + 3, "a b", "fr", None, 3, "", 0, ""), (n + 4, "Lang " * 30_000, "de", "s1", 150_000, "", 0, "")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return (t or "").encode().split()


def test_mix(docs, rows, empty):
    got = mixing.decide(docs).collect()
    size = {r[0]: len(words(r[1])) for r in rows}
    total = Counter()
    for r in rows:
        total[r[3]] += size[r[0]]
    names = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_names, left = {}, list(names), float(sum(total.values()))
    while True:
        share = sum(weight[s] for s in open_names)
        over = [s for s in open_names if left * weight[s] / share > 3 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * total[s]
            open_names.remove(s)
        left = sum(total.values()) - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in open_names) for s in open_names}
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["size"] == size[r.doc_id] and r.copies <= 3 and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
        taken[r.source] += r["size"] * r.copies
        largest[r.source] = max(largest[r.source], r["size"])
    longest = max(largest.values())
    assert sum(taken.values()) <= sum(total.values())
    assert all(abs(taken[s] - target[s]) <= largest[s] + longest for s in target)
    assert sorted((r.doc_id, r.copies) for r in mixing.decide(docs).collect()) == sorted((r.doc_id, r.copies) for r in got)
    assert mixing.mix_documents(docs).count() == sum(r.copies * r.n_rows for r in got) and mixing.mix_documents(docs).columns == docs.columns
    assert mixing.decide(empty).count() == 0 == mixing.mix_documents(empty).count()
    ordered = mixing.mix_in_order(docs)
    sequence = ordered.collect()
    assert Counter(r.doc_id for r in sequence) == Counter(r.doc_id for r in mixing.mix_documents(docs).collect()) and ordered.columns == [*docs.columns, "finish"]
    assert [r.finish for r in sequence] == sorted(r.finish for r in sequence)
    # At any time every source is behind its share by less than two of its longest documents.
    done = Counter()
    for r in sequence:
        done[r.source] += size[r.doc_id]
        assert abs(done[r.source] - r.finish * target[r.source]) < 1e-6 * max(1, done[r.source])


def test_quality(docs, rows, empty):
    for r in quality.build_ledger(docs).collect():
        w = words(rows[r.doc_id][1])
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {i + o for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for o in range(3)}
        assert (r.n_words, r.n_repeat_words) == (len(w), len(hit))
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.apply_policy(quality.build_ledger(docs), "v2").where("kept").collect()}
    # Several policies and ablations over one stored ledger, which is all that they read.
    ledger = quality.store_ledger(docs)
    assert all("documents" not in f and "quality_ledger" in f for f in ledger.inputFiles())
    facts = [(r, dict(zip(quality.MEASURES, quality.measure(r[1]), strict=True))) for r in rows]
    fails = {r[0]: {n for n, c in quality.RULES if eval(c, {}, m)} for r, m in facts}  # noqa: S307
    for policy, names in (("v1", {"too_few_words", "repeated_windows", "symbols", "duplicate_lines"}), ("v2", {n for n, _ in quality.RULES}), (quality.mask("shouting"), {"shouting"}), (0, set())):
        base = set(quality.BASE_RULES)
        assert {r.doc_id: r.kept for r in quality.apply_policy(ledger, policy).collect()} == {d: not f & (base | names) for d, f in fails.items()}
        got = {r.rule: (r.n_failed, r.n_only_this) for r in quality.ablations(ledger, policy).collect()}
        assert got == {n: (sum(n in f for f in fails.values()), sum(f & names == {n} for f in fails.values())) for n in names}
    assert quality.build_ledger(empty).count() == 0 == quality.filter_quality(empty).count()


def near_brute(rows, k, threshold):
    fold = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for d, t, *_ in rows:
        w = (t or "").encode().translate(fold).split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= threshold * len(x | y):
            p, q = sorted((root(a), root(b)))
            up[q] = p
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize("grid", [500, 8])
def test_near_duplicates(docs, rows, empty, monkeypatch, grid):
    monkeypatch.setattr(neardup, "GRID", grid)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, k=4).collect()}
    assert got == near_brute(rows, 4, 80)
    if grid == 500:
        assert neardup.near_duplicates(empty).count() == 0
        assert {r.doc_id for r in neardup.drop_near_duplicates(docs, k=4).collect()} == {d for d, (_, c) in got.items() if c == d}


def test_token_files(docs, rows, spark, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(path), 0
    got = {r.doc_id: r for r in tokenfiles.lookup(tokenfiles.write_token_files(docs, path, f"file://{tmp_path}"), docs).collect()}
    for d, text, *_ in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    twice = spark.createDataFrame([(1, "a"), (1, "b c"), (None, "d")], "doc_id long, text string")
    pair = [(r.doc_id, r.start, r.n_tokens) for r in tokenfiles.lookup(tokenfiles.write_token_files(twice, path, f"file://{tmp_path}/b"), twice).orderBy("start").collect()]
    one, two = (len(t.encode(x, add_special_tokens=False).ids) + 1 for x in ("a", "b c"))
    first = len(t.encode("d", add_special_tokens=False).ids) + 1
    assert pair[0] == (None, 0, first) and pair[1:] in ([(1, first, one), (1, first + one, two)], [(1, first, two), (1, first + two, one)])
    assert tokenfiles.lookup(tokenfiles.write_token_files(empty, path, f"file://{tmp_path}/c"), empty).count() == 0


def test_one_key_is_fetched_by_few_small_reads(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    many = spark.range(4000).selectExpr("id * 3 AS doc_id", "concat('word ', id) AS text")
    manifest = tokenfiles.write_token_files(many, path, f"file://{tmp_path}").orderBy("part").collect()
    assert [f.first_key for f in manifest] == sorted(f.first_key for f in manifest) and all(a.last_key < b.first_key for a, b in itertools.pairwise(manifest))
    t = tokenfiles.tokenizer(path)
    for key in (0, 3, 2997, 11997):
        shard = tokenfiles.Shard(next(f.path for f in manifest if f.first_key <= key <= f.last_key))
        read, whole = [], shard.stream

        class Counting:
            def read_at(self, n, at):
                read.append(n)
                return whole.read_at(n, at)

        shard.stream = Counting()
        assert shard.get(key).astype(f"<u{t.item}").tobytes() == t.encode_packed(f"word {key // 3}") + t.pack([2])
        assert len(read) == 6 and sum(read) < 100 and shard.get(key + 1) is None


@pytest.mark.parametrize("bound", [10, 1_000_000])
def test_texts_with_more_words_than_the_memo(monkeypatch, bound):
    monkeypatch.setattr(tokenfiles, "MAX_WORDS", bound)
    t = tokenfiles.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for n in (5, 30, 9, 200, 30_000):
        text = " ".join(f"w{i}, x{i * 7}." for i in range(n))
        assert t.encode_packed(text) == t.pack(t.tokenizer.encode(text, add_special_tokens=False).ids)


def test_texts_of_all_scripts_equal_the_library():
    """Random texts over every assigned block, with marks, joiners and spaces of all kinds between."""
    import unicodedata

    t = tokenfiles.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(11)
    chars = [chr(c) for c in range(1, 0x32000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    glue = list(" \t\n.,!?'\"-()_0aZ") + ["'s", "\u0301", "\u200d", "\u00a0", "\u2028", "\u3000", "\u0345", "\u1e9e", "\u0130", "\u03a3", "\u212a"]
    texts = ["".join(rng.choice(chars[i : i + 60]) if rng.random() < 0.6 else rng.choice(glue) for _ in range(40)) for i in range(0, len(chars), 12)]
    want = t.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [x for x, e in zip(texts, want, strict=True) if t.encode_packed(x) != t.pack(e.ids)] == []


def test_words_with_marks_equal_the_library():
    t = tokenfiles.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    chars = [chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalnum()]
    words = [f"a{c}." for c in chars] + ["BELED\u0130YES\u0130.", "\u09b9\u09df,", "\u09b9\u09af\u09bc,", "J\u030c.", "H\u0331x", "T\u0308!", "W\u030a", "Y\u030a"]
    want = t.tokenizer.encode_batch_fast(words, add_special_tokens=False)
    wrong = [w for w, e in zip(words, want, strict=True) if t.encode_packed(w) != t.pack(e.ids)]
    assert wrong == []


def test_perfect_hash_finds_all_and_only_its_keys():
    keys = np.sort(np.random.default_rng(1).choice(10**12, 5000, replace=False))
    h = tokenfiles.key_hashes(keys, np.zeros(len(keys)), 1)
    d = tokenfiles.build_index(h)
    assert sorted(tokenfiles.lookup_slots(h, d, len(keys))) == list(range(len(keys)))


def test_licences(spark, empty):
    mit = " ".join(licences.SENTENCES[x][0] for x in ("mit-grant",)) + "\nfoo\n" + licences.SENTENCES["mit-notice"][0] + " " + licences.SENTENCES["mit-warranty"][0]
    swapped = licences.SENTENCES["mit-notice"][0] + "\n" + licences.SENTENCES["mit-grant"][0]
    bsd = "\n".join(licences.SENTENCES[x][0] for x in ("bsd-use", "bsd-source", "bsd-binary", "bsd-endorse"))
    df = spark.createDataFrame([(1, mit), (2, swapped), (3, bsd), (4, None), (5, ""), (6, "x. ALL RIGHTS reserved! y")], "doc_id long, text string")
    assert {r.doc_id: r.licences for r in licences.scan(df).collect()} == {1: "MIT", 2: "MIT-fragment", 3: "BSD-3-Clause", 4: "", 5: "", 6: "All-rights-reserved"}
    assert licences.scan(empty).count() == 0


def test_wrapped_licences(spark):
    import textwrap

    text = {i: s[0] for i, s in licences.SENTENCES.items()}

    def wrap(*paragraphs, width=72, mark="", gap=True):
        lines = ("\n\n" if gap else "\n").join(textwrap.fill(p, width) for p in paragraphs).split("\n")
        return "\n".join(mark + x for x in lines)

    mit = ("MIT License", "Copyright (c) 2020 A. Person", text["mit-grant"], text["mit-notice"], text["mit-warranty"] + " IN NO EVENT SHALL THE AUTHORS BE LIABLE.")
    bsd2 = (text["bsd-use"], "1. " + text["bsd-source"], "2. " + text["bsd-binary"])
    apache = (text["apache-head"] + " " + text["apache-copy"], "    http://www.apache.org/licenses/LICENSE-2.0", text["apache-asis"])
    gpl = (text["gpl-free"], text["gpl-hope"] + " See the GNU General Public License for more details.")
    cases = [
        (wrap(*mit), "MIT"), (wrap(*mit, mark=" * "), "MIT"), (wrap(*mit, mark="# ", gap=False), "MIT"), (wrap(*mit, mark="//! ", width=40), "MIT"), (wrap(*mit).replace("\n", "\r\n"), "MIT"),
        (wrap(*bsd2, mark=" * ", gap=False), "BSD-2-Clause"), (wrap(*bsd2, text["bsd-endorse"], mark="! "), "BSD-3-Clause"), (wrap(*(p.replace("1. ", "(a) ").replace("2. ", "2) ") for p in bsd2), gap=False), "BSD-2-Clause"),
        (wrap(*apache, mark="# "), "Apache-2.0"), (wrap(*apache, mark="-- ", width=80), "Apache-2.0"), (wrap(*gpl, mark=";; "), "GPL-3.0-or-later"), (wrap(*gpl, mark="dnl "), "GPL-3.0-or-later"),
        (wrap(text["isc-grant"], mark="% "), "ISC"), ("some words\nReleased under the MIT License.\nmore words", "MIT"), (text["isc-grant"].replace("for any", "for\n\nany"), ""), ("a word\nnot " + wrap(text["isc-grant"]), ""),
        (wrap(*bsd2) + "\n\n" + wrap(*bsd2, text["bsd-endorse"]), "BSD-2-Clause,BSD-3-Clause"), (wrap(*bsd2, text["bsd-endorse"]) + "\n\n" + wrap(*bsd2, text["bsd-endorse"]), "BSD-3-Clause"),
        (text["apache-head"].replace(" (the", "\n(the"), "Apache-2.0"), (wrap(*bsd2, text["bsd-endorse"]) + "\n\n" + wrap(*bsd2), "BSD-2-Clause,BSD-3-Clause"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert {r.doc_id: r.licences for r in licences.scan(df).collect()} == {i: want for i, (_, want) in enumerate(cases)}
    assert all(any(h in s for h in licences.HINTS) for s in licences.sentence_table())


PUBLISHED = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
MIT_FILE = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_FILE = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""


def test_published_licence_files(spark):
    """Whole files as published, a line for each paragraph, wrapped anew, behind comment marks, and one after the other; a sentence may also follow another or a colon in one line."""
    import textwrap
    from pathlib import Path

    files = {"MIT": MIT_FILE, "BSD-3-Clause": BSD_FILE}
    folder = Path("/usr/share/common-licenses")
    files |= {licence: (folder / name).read_text("utf-8") for name, licence in PUBLISHED.items() if (folder / name).exists()}
    forms = {
        "whole": lambda t: t, "line": lambda t: "\n".join(" ".join(p.split()) for p in t.split("\n\n")), "narrow": lambda t: "\n\n".join(textwrap.fill(p, 50) for p in t.split("\n\n")), "marks": lambda t: "\n".join(" * " + x for x in t.split("\n")),
        "hash": lambda t: "\n".join(f"# {x}".rstrip() for x in t.split("\n")), "dos": lambda t: t.replace("\n", "\r\n"),
    }
    cases = [(licence, name, f(t)) for licence, t in files.items() for name, f in forms.items()]
    got = {r.doc_id: r.licences for r in licences.scan(spark.createDataFrame([(i, t) for i, (*_, t) in enumerate(cases)], "doc_id long, text string")).collect()}
    # A whole text of the GNU licences shows the notices that a program should carry, which name "or any later version".
    wrong = [(licence, name, got[i]) for i, (licence, name, _) in enumerate(cases) if licence not in got[i].split(",") or {x.replace("-or-later", "") for x in got[i].split(",")} - {licence}]
    assert wrong == []
    both = spark.createDataFrame([(1, files["MIT"] + "\n\n" + files["BSD-3-Clause"]), (2, "x\n// SPDX-License-Identifier: MPL-2.0\ny"), (3, "SPDX-License-Identifier: 0BSD"), (4, " ".join(MIT_FILE[MIT_FILE.index("Permission") :].split())), (5, " ".join(BSD_FILE.split()))], "doc_id long, text string")
    assert {r.doc_id: r.licences for r in licences.scan(both).collect()} == {1: "BSD-3-Clause,MIT", 2: "MPL-2.0", 3: "0BSD", 4: "MIT", 5: "BSD-3-Clause"}


def test_bpe_equals_the_library(docs, rows, empty):
    import tiktoken

    path, pattern = bpe.default_tokenizer()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for r in bpe.encode_decode(docs, path, pattern, with_ids=True).collect():
        ids = enc.encode_ordinary(rows[r.doc_id][1] or "")
        assert r.ids == ids and r.decodes and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((rows[r.doc_id][1] or "").encode()).hexdigest()
    assert bpe.encode_decode(empty, path, pattern).count() == 0
    c, rng = bpe.BpeCodec(path, pattern), random.Random(4)
    c.fst.max_states = 500
    for _ in range(2000):
        t = "".join(rng.choice(["a", "th", "é", "中", "🙂", " ", "\n", "'s", "ing", "0", "　"]) for _ in range(rng.randrange(12)))
        assert c.encode(t) == enc.encode_ordinary(t) and "".join(c.decode_chunks(c.encode(t), 2)) == t


@pytest.mark.parametrize("compression", [tiff.STORED, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize(("big", "predictor", "tile", "planar"), [(False, 1, None, 1), (True, 2, None, 2), (False, 2, (16, 32), 1), (True, 1, (32, 16), 2)])
def test_tiff_round_trip(compression, big, predictor, tile, planar):
    rng = np.random.default_rng(2)
    pages = [rng.integers(0, 5, (70, 50, 3), np.uint8), rng.integers(0, 60000, (33, 40), np.uint16), np.zeros((500, 64), np.uint8)]
    for a, p in zip(pages, tiff.iter_pages(tiff.write_tiff(pages, compression, predictor, 17, tile, big, planar)), strict=True):
        assert np.array_equal(p.pixels.squeeze(), a)


def test_tiff_rows(docs, rows, spark, empty):
    for r in tiff.media_digest(tiff.encode_media(docs)).collect():
        payload = tiff.pad((rows[r.doc_id][1] or "").encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), None)
        media = tiff.store_payload(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        count = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
        share = count[count > 0] / len(payload)
        assert r.feature == f"pages={-(-len(payload) // (64 * 65536))};rows={len(payload) // 64};mean={np.frombuffer(payload, np.uint8).mean():.6f};distinct={len(share)};entropy={abs(-(share * np.log2(share)).sum()):.6f}"
    forms = Counter()
    for i in range(200):
        (page, *_) = tiff.iter_pages(tiff.store_payload(tiff.pad(b"text %d" % i)))
        forms[page.compression, page.tiled] += 1
    assert set(forms) == {(tiff.LZW, False), (tiff.PACKBITS, False), (tiff.DEFLATE, True), (tiff.DEFLATE, False)}
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"II*\0\x08\0\0\0")), (3, bytearray(b"nonsense")), (4, bytearray(tiff.write_tiff([np.zeros((4, 4), np.uint8)] * 2)))], "doc_id long, media binary")
    assert Counter((r.key, r.error is None) for r in tiff.decode_pages(bad).collect()) == {(1, False): 1, (2, False): 1, (3, False): 1, (4, True): 2}
    lost = {r.doc_id: r for r in tiff.media_digest(bad.withColumn("n_bytes", F.lit(1).cast("long")).select("doc_id", "n_bytes", "media")).collect()}
    assert all(lost[i].error and lost[i].payload_sha256 is None and lost[i].n_bytes == 1 for i in (1, 2, 3)) and lost[1].media_bytes is None and lost[3].media_bytes == 8
    assert lost[4].error is None and lost[4].payload_bytes == 32
    assert tiff.encode_media(empty).count() == 0 == tiff.media_digest(tiff.encode_media(empty)).count()


def test_tiff_vectors_of_the_specification():
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA")
    assert tiff.packbits_decode(packed, 24) == bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22 AA AA AA AA AA AA AA AA AA AA")
    codes = (256, 7, 258, 8, 8, 258, 6, 6, 257)
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(data, 9) == bytes((7, 7, 7, 8, 8, 7, 7, 6, 6)) and tiff.lzw_encode(bytes((7, 7, 7, 8, 8, 7, 7, 6, 6))) == data


@pytest.mark.parametrize("form", ["PackBits", "LZW", "ZLib", "Deflate", None])
@pytest.mark.parametrize(("kind", "shape", "dtype"), [(10, (70, 50), np.uint8), (5, (33, 40, 3), np.uint8), (11, (40, 25), np.uint16), (12, (30, 45), np.uint8)])
def test_tiff_of_another_writer(spark, form, kind, shape, dtype):
    """Files by the TIFF writer of the Java class library: grey, colour, 16 bits and bilevel."""
    jvm = spark._jvm
    rng = np.random.default_rng(3)
    image = rng.integers(0, 2, shape) if kind == 12 else rng.integers(0, 9, shape) * (7000 if dtype is np.uint16 else 20)
    picture = jvm.java.awt.image.BufferedImage(shape[1], shape[0], kind)
    raster = picture.getRaster()
    for band in range(shape[2] if len(shape) == 3 else 1):
        plane = image[:, :, band] if len(shape) == 3 else image
        for y in range(shape[0]):
            for x in range(shape[1]):
                raster.setSample(x, y, band, int(plane[y, x]))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("tiff").next()
    held = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(held)
    writer.setOutput(stream)
    how = writer.getDefaultWriteParam()
    if form:
        how.setCompressionMode(2)
        how.setCompressionType(form)
    writer.write(None, jvm.javax.imageio.IIOImage(picture, None, None), how)
    stream.flush()
    (page,) = tiff.iter_pages(bytes(held.toByteArray()))
    assert np.array_equal(page.pixels.squeeze(), image.astype(dtype))


def test_tiff_small_samples_fill_order_and_floats():
    rng = np.random.default_rng(5)
    for bits in (1, 2, 4):
        image = rng.integers(0, 1 << bits, (19, 37, 1), np.uint8)
        for compression in (tiff.STORED, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE):
            for order in (1, 2):
                (page,) = tiff.iter_pages(tiff.write_tiff([image], compression, strip_rows=7, bits=bits, fill_order=order))
                assert np.array_equal(page.pixels, image) and page.bits == bits
    floats = rng.normal(size=(23, 31, 3)).astype(np.float32)
    for big in (False, True):
        (page,) = tiff.iter_pages(tiff.write_tiff([floats.view(np.uint32)], tiff.DEFLATE, 3, 5, big_endian=big))
        assert np.array_equal(page.pixels.view(np.float32), floats)
    with pytest.raises(tiff.TiffError, match="not taken"):
        list(tiff.iter_pages(tiff.write_tiff([np.zeros((4, 4), np.uint8)], tiff.DEFLATE, predictor=9)))


def test_hilbert_shards(docs, rows, empty, spark):
    got = shards.cut_runs(shards.curve_order(docs)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.text_crc32 == zlib.crc32((rows[r.doc_id][1] or "").encode())
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and shards.curve_order(empty).count() == 0
    grid = spark.range(16 * 16).select((F.col("id") % 16).cast("int").alias("x"), F.floor(F.col("id") / 16).cast("int").alias("y"))
    walk = grid.withColumn("h", shards.hilbert_index([F.col("x"), F.col("y")], 4)).orderBy("h").collect()
    assert [r.h for r in walk] == list(range(256)) and all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in itertools.pairwise(walk))


def hilbert_of(cell, bits):
    """Skilling's transform, step by step on plain integers."""
    x, q = list(cell), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return sum(((v >> b) & 1) << (b * len(x) + len(x) - 1 - i) for b in range(bits) for i, v in enumerate(x))


def shards_brute(rows, n_shards=16, bits=4):
    """doc_id, size, crc, shard, slot of each row: bins, curve, order and cut written out."""
    import math

    import xxhash

    bins = 1 << bits
    h_text = lambda t: 42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42)
    h_long = lambda v: 42 if v is None else xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), 42)
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    recs = [{"doc_id": d, "size": len((t or "").encode()) + 1, "crc": zlib.crc32((t or "").encode()), "text": t, "lang": lang, "source": source} for d, t, lang, source, *_ in rows]

    def text_bounds(dim):
        values = sorted(r[dim].encode() for r in recs if r[dim] is not None)
        n, out = len(values), []
        for v in sorted(set(values)):
            upto, own = sum(x <= v for x in values), values.count(v)
            out += [v] * (upto * bins // n - (upto - own) * bins // n)
        return out

    def number_bounds(dim):
        values = sorted(r[dim] for r in recs if r[dim] is not None)
        return [values[max(math.ceil(i / bins * len(values)) - 1, 0)] for i in range(1, bins)]

    bounds = {"lang": text_bounds("lang"), "source": text_bounds("source"), "size": number_bounds("size"), "doc_id": number_bounds("doc_id")}
    for r in recs:
        value = lambda d: r[d].encode() if isinstance(r[d], str) else r[d]  # noqa: B023, E731
        cell = [0 if r[d] is None else sum(b < value(d) for b in bounds[d]) for d in bounds]
        r["key"] = (hilbert_of(cell, bits), signed(h_text(r["text"])), signed(h_long(r["doc_id"])), r["doc_id"])
    recs.sort(key=lambda r: r["key"])
    out, n, slots = [], len(recs), Counter()
    for rank, r in enumerate(recs):
        shard = rank * n_shards // n
        out.append((r["doc_id"], r["size"], r["crc"], r["key"][0], shard, slots[shard]))
        slots[shard] += 1
    return out


def test_hilbert_shards_against_brute_force(docs, rows):
    got = shards.cut_runs(shards.curve_order(docs)).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.hilbert, r.shard, r.slot) for r in got) == sorted(shards_brute(rows))


def test_written_shards_prune(spark, tmp_path):
    """Shards along the curve: a query on one dimension reads few of them, where shards by id read all."""
    rng = random.Random(5)
    rows = [(i, "x " * int(rng.paretovariate(1) * 5 % 4000), rng.choice(["de", "en", "es", "fr"]), f"src{rng.randrange(20)}", 0) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    shards.write_shards(df, f"file://{tmp_path}/shards")
    written = spark.read.parquet(f"file://{tmp_path}/shards")
    back = [tuple(r) for r in written.select("doc_id", "text", "lang", "source", "n_chars", "shard_no").collect()]
    assert sorted(r[:5] for r in back) == sorted(rows)
    place = {r[0]: r[4] for r in shards_brute(rows)}
    assert {r[0]: r[5] for r in back} == place
    by = defaultdict(list)
    for d, t, lang, source, *_ in rows:
        by[place[d]].append((lang, source, len(t), d))
    ways = {"lang": (0, ["de", "fr"]), "source": (1, ["src3", "src11"]), "size": (2, [10, 700]), "doc_id": (3, [5, 3900])}
    read = {k: sum(min(r[i] for r in s) <= v <= max(r[i] for r in s) for v in values for s in by.values()) / (len(by) * len(values)) for k, (i, values) in ways.items()}
    by_id = defaultdict(list)
    for d, t, lang, source, *_ in rows:
        by_id[d % 16].append((lang, source, len(t), d))
    plain = {k: sum(min(r[i] for r in s) <= v <= max(r[i] for r in s) for v in values for s in by_id.values()) / (16 * len(values)) for k, (i, values) in ways.items()}
    assert all(read[k] <= 0.8 * plain[k] for k in ways) and sum(read.values()) <= 0.6 * sum(plain.values()), (read, plain)


def test_hilbert_tells_sources_with_one_prefix_apart(spark):
    names = [f"https://example.org/{i:02d}" for i in range(16)]
    df = spark.createDataFrame([(None, "x", "en", s) for s in names for _ in range(3)], "doc_id long, text string, lang string, source string")
    assert {d: sorted(b) for d, b in shards.string_bounds(df, ("lang", "source"), 16).items()} == {"lang": ["en"], "source": names}
    got = shards.curve_order(df).groupBy("hilbert").count().collect()
    assert len(got) == 16 and {r["count"] for r in got} == {3}


@pytest.mark.parametrize("hot", [1_000_000, 40])
def test_substring_dedup(docs, rows, empty, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT_WINDOWS", hot)
    first, want = {}, {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    for d, t, *_ in rows:
        w = words(t)
        gone = {i + o for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for o in range(13)}
        want[d] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.span_digest(docs).collect()} == want
    out = {r.doc_id: r for r in substring.drop_duplicate_spans(docs).collect()}
    assert all(len(words(out[d].text)) == n - gone for d, (n, gone, _) in want.items()) and substring.drop_duplicate_spans(docs).columns == docs.columns
    assert substring.span_digest(empty).count() == 0
    text = {d: words(t) for d, t, *_ in rows}
    covered = defaultdict(set)
    for r in substring.duplicate_factors(docs).collect():
        assert r.source_id < r.doc_id and r.n_words >= 13
        assert text[r.doc_id][r.start : r.start + r.n_words] == text[r.source_id][r.source_start : r.source_start + r.n_words]
        covered[r.doc_id] |= set(range(r.start, r.start + r.n_words))
    assert {d: len(c) for d, c in covered.items()} == {d: gone for d, (_, gone, _) in want.items() if gone}
    if hot == 40:
        assert substring.hot_blocks(docs.select("doc_id", "text"), 13, 8)


def test_one_long_factor_and_greedy_steps():
    """A source that is copied whole is one factor; one that repeats itself gives the longest runs that agree with its first occurrence."""
    gram = np.array([1, 2, 3, 4, 1, 2, 3, 4, 5, 3, 4, 9, 7, 7, 7, 7, 7, 7, 7], np.uint64)
    ids = np.array([1] * 4 + [2] * 5 + [3] * 3 + [4] * 2 + [5] * 5)
    at, source, n, found = substring.parse(gram, ids, np.append(True, np.diff(ids) != 0))
    assert list(zip(at.tolist(), source.tolist(), n.tolist(), strict=True)) == [(4, 0, 4), (9, 2, 2), (14, 12, 2), (16, 12, 2), (18, 12, 1)]
    assert found.sum() == n.sum()


def test_a_factor_of_more_than_2_to_24_windows():
    n = (1 << 24) + 5
    one = lambda x, kind: np.array([x], kind)
    packed = substring._pack_factors(one((7, 1, -1), substring.ROW), one(3, "<u4"), one(n, "<u4"), one(2, "<i8"), one(4, "<u4"))
    row, *numbers = (c[0] for c in substring.unpack(packed, substring.FACTOR_KINDS)[:5])
    assert row.tolist() == (7, 1, -1) and [int(x) for x in numbers] == [3, n, 2, 4]
    text = "a " * (n + 20)
    total, removed, kept = substring.keep_words(text, (np.array([3]), np.array([n])), 13)
    assert (total, removed, len(kept)) == (n + 20, n + 12, 8)


def test_revisits(spark):
    rec = "record_id long, kind string, url string, ts timestamp, headers map<string,string>, payload_digest string, part string"
    import datetime as dt

    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [
        (1, "response", "https://www.A.org:443/p/?b=2&a=1#x", t(1), {"etag": '"1"', "content-type": "t", "date": "d1"}, "x", ""), (2, "response", "http://a.org/p?a=1&b=2", t(5), {"etag": '"2"'}, "y", ""),
        (3, "revisit", "http://a.org/p?a=1&b=2", t(3), {"etag": 'W/"1"', "date": "d2", "server": "s"}, None, ""), (4, "revisit", "http://a.org/p?a=1&b=2", t(5), {"etag": '"1"'}, None, ""), (5, "revisit", "http://a.org/p?a=1&b=2", t(6), {"etag": '"1"'}, None, ""),
        (6, "revisit", "http://b.org/", t(9), {}, None, ""), (7, "revisit", None, t(9), {}, None, ""), (8, "revisit", "http://a.org/p?a=1&b=2", None, {}, None, ""),
    ]
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, rec)).collect()}
    assert {k: (v.status, v.response_id) for k, v in got.items()} == {3: ("resolved", 1), 4: ("resolved", 1), 5: ("validator_mismatch", None), 6: ("no_response", None), 7: ("no_response", None), 8: ("no_response", None)}
    assert got[3].headers == {"etag": 'W/"1"', "content-type": "t", "date": "d2"}
    assert warc.resolve_revisits(spark.createDataFrame([], rec)).count() == 0


def test_revisits_without_headers_or_validators(spark):
    import datetime as dt

    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [
        (1, "response", "http://a/", t(1), {"content-type": "t", "date": "d1"}, "x"), (2, "revisit", "http://a/", t(2), None, "x"), (3, "revisit", "http://a/", t(3), None, None),
        (4, "response", "http://b/", t(1), None, None), (5, "revisit", "http://b/", t(2), {"etag": "e", "server": "s"}, "y"), (6, "revisit", "http://a/", t(4), None, "z"),
    ]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, ts timestamp, headers map<string,string>, payload_digest string")
    got = {r.record_id: (r.status, r.response_id, r.headers) for r in warc.resolve_revisits(df).collect()}
    whole = {"content-type": "t", "date": "d1"}
    assert got == {2: ("resolved", 1, whole), 3: ("unvalidated", 1, whole), 5: ("unvalidated", 4, {"etag": "e"}), 6: ("validator_mismatch", None, None)}


def sql_over(rows, query):
    """The result of DuckDB SQL over a table documents of these rows."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    frame = pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=t) for i, (c, t) in enumerate((("doc_id", "Int64"), ("text", object), ("lang", object), ("source", object), ("n_chars", "Int64")))})  # noqa: F841
    con.sql("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, lang::VARCHAR AS lang, source::VARCHAR AS source, n_chars::BIGINT AS n_chars FROM frame")
    cursor = con.sql(query)
    return [dict(zip(cursor.columns, r, strict=True)) for r in cursor.fetchall()]


def spans_brute(rows, window=13):
    """The rows with the words that stay, joined by blanks where any went."""
    first, out = {}, []
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    for d, t, lang, source, n in rows:
        w = words(t)
        gone = {i + o for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for o in range(window)}
        text = b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else t
        out.append((d, text, lang, source, len(text) if text is not None else None))
    return out


def test_pipeline_against_independent_versions(spark, rows, tmp_path):
    """Each stage against SQL, plain Python or the tokenizer's library; none of them calls the operators."""
    import corpus_pipeline
    import tiktoken

    whole = [r[:5] for r in rows] + [(500 + i, rows[1][1] + f" tail{i} " * 3, "en", "s9", 9) for i in range(3)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(whole, kind).write.parquet(f"{tmp_path}/documents.parquet")
    verdict = {r["doc_id"]: r["kept"] for r in sql_over(whole, quality.ORACLE)}
    good = [r for r in whole if verdict[r[0]]]
    component = near_brute(good, 5, 80)
    single = [r for r in good if component[r[0]][1] == r[0]]
    cut = spans_brute(single)
    taken = {r["doc_id"]: r["copies"] for r in sql_over(cut, mixing._MIX_SQL)}
    path, pattern = bpe.default_tokenizer()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = Counter((d, tuple(enc.encode_ordinary(t or ""))) for d, t, *_ in cut for _ in range(taken[d]))
    stages = [good, single, cut]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), expected in zip(corpus_pipeline.STAGES, stages, strict=False):
        docs = stage(spark, docs, str(tmp_path))
        got = sorted(tuple(r) for r in docs.collect())
        assert got == sorted((d, t, lang, source, n if t == next(x[1] for x in whole if x[0] == d) and name != "substring dedup" else len(t)) for d, t, lang, source, n in expected), name
        docs = spark.createDataFrame(got, kind)
    assert 0 < len(cut) < len(good) < len(whole) and any(a[1] != b[1] for a, b in zip(single, cut, strict=True))
    assert Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_pipeline_against_brute_force(spark, rows, tmp_path):
    import corpus_pipeline

    whole = [r[:5] for r in rows]
    spark.createDataFrame(whole, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [r for r in whole if not quality.measure(r[1])[0] < 50 and all(not eval(c, {}, dict(zip(quality.MEASURES, quality.measure(r[1]), strict=True))) for _, c in quality.RULES)]  # noqa: S307
    stage = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in stage.collect()} == {r[0] for r in kept}
    component = near_brute(kept, 5, 80)
    kept = [r for r in kept if component[r[0]][1] == r[0]]
    stage = corpus_pipeline.STAGES[1][1](spark, stage, str(tmp_path))
    assert {r.doc_id for r in stage.collect()} == {r[0] for r in kept}
    out = corpus_pipeline.run(spark, str(tmp_path))
    mixed = mixing.mix_documents(substring.drop_duplicate_spans(stage))
    assert sorted(r.decoded_sha256 for r in out.collect()) == sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in mixed.collect())

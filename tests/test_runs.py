"""Runs with injected models, the collection and its sinks, against small cases worked out by hand."""

import datetime as dt
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomquery.functions import replies
from loomquery.operators import chat, ingest, retrieval
from loomquery.plans import answering, evaluation, models
from loomquery.sources import collection, readers
from loomquery.streaming import limiter, upserts


def test_corpus_of_schemes(spark, tmp_path):
    for name, text in {"a/x.pdf": "one|two", "a/sub/y.pdf": "broken", "a/z.pdf": "old", "a/z_OCR.pdf": "w" * 150, "b/q.pdf": "v" * 100}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)

    def extract(content):
        if content == b"broken":
            raise ValueError("not a document")
        return bytes(content).decode().split("|")

    pages, summary, failures = readers.load_corpus(spark, [("A", str(tmp_path / "a")), ("B", str(tmp_path / "b")), ("C", str(tmp_path / "none"))], extract)
    assert sorted((r.scheme, r.filename, r.parent_subfolder, r.is_ocr_source, r.page) for r in pages.where("error is null").collect()) == [("A", "x.pdf", None, False, 1), ("A", "x.pdf", None, False, 2), ("A", "z_OCR.pdf", None, True, 1), ("B", "q.pdf", None, False, 1)]
    assert [(r.scheme, r.n_docs, r.n_empty, r.n_failed, r.total_chars) for r in summary.orderBy("pos").collect()] == [("A", 2, 1, 1, 156), ("B", 1, 0, 0, 100), ("C", 0, 0, 0, 0)]
    assert [(r.scheme, r.error) for r in failures.collect()] == [("A", "not a document")]
    assert pages.where("error is not null").first().parent_subfolder == "sub"
    assert readers.list_files(spark, str(tmp_path / "none"), "*.pdf").count() == 0
    assert [r.filename for r in readers.list_files(spark, str(tmp_path), "*.pdf").collect()] == ["y.pdf", "x.pdf", "z.pdf", "z_OCR.pdf", "q.pdf"]


def test_collection_upsert(spark, tmp_path):
    def connect():
        def embed(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("down")
            return np.array([[len(t), 1.0] for t in texts])

        return embed

    path = str(tmp_path / "collection")
    kind = "chunk_id string, text string, scheme string, page_start int, vision_failed boolean, version int"
    first = spark.createDataFrame([("a", "abc", "S", 1, False, 1), ("b", "bad", "S", None, True, 1)], kind).repartition(2, "chunk_id")
    done = collection.upsert(spark, first, path, "version", connect, batch=1)
    assert (done.n_given, done.n_failed, done.n_collisions, done.n_after) == (2, 1, 0, 1)
    again = spark.createDataFrame([("a", "abcd", "T", None, True, 2), ("c", "x", None, 3, None, 2)], kind)
    assert collection.upsert(spark, again, path, "version", connect).n_after == 2 == collection.upsert(spark, again, path, "version", connect).n_after
    rows = {r.chunk_id: (r.document, r.metadata, [round(x, 3) for x in r.v]) for r in readers.recovered(spark, path).collect()}
    assert rows == {"a": ("abcd", {"scheme": "T", "vision_failed": "true"}, [0.970, 0.243]), "c": ("x", {"page_start": "3"}, [0.707, 0.707])}
    assert [r.chunk_id for r in spark.read.parquet(f"{path}_failures").collect()] == ["b"]
    text, image = spark.createDataFrame([("a", "pdf"), ("b", "pdf"), ("a", "pdf")], "chunk_id string, source_type string"), spark.createDataFrame([("b", "image", "h")], "chunk_id string, source_type string, content_hash string")
    union, clashes, log = collection.build(text, image)
    assert [(r.chunk_id, r.n) for r in clashes.collect()] == [("a", 2), ("b", 2)] and union.count() == 4
    assert {r.source_type: (r.n_chunks, r.n_ids) for r in log.collect()} == {"pdf": (3, 2), "image": (1, 1)}
    with pytest.raises(ValueError, match="nothing to build"):
        collection.build(None, None)
    kinds = "chunk_id string, text string, source_type string, version int"
    parts = spark.createDataFrame([("a", "x", "pdf", 1)], kinds), spark.createDataFrame([("i", "y", "image", 1), ("a", "z", "image", 2)], kinds)
    built = str(tmp_path / "built")
    dry = collection.build_collection(spark, *parts, built, "version", dry_run=True)
    assert (dry["kinds"], dry["collisions"]) == ({"pdf": 1, "image": 2}, ["a"]) and readers.recovered(spark, built) is None
    assert collection.build_collection(spark, *parts, built, "version", skip_images=True)["n_after"] == 1
    assert collection.build_collection(spark, *parts, built, "version")["n_after"] == 2 and json.loads(spark.read.json(built + "_build").first().log)["n_collisions"] == 1


def test_a_new_checkpoint_keeps_the_table(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    for n, batch in enumerate(([("a", 1)], [("b", 2)])):
        spark.createDataFrame(batch, "k string, v int").write.parquet(f"{source}{n}")
        upserts.upsert_stream(spark.readStream.schema("k string, v int").parquet(f"{source}{n}"), table, str(tmp_path / f"checkpoint{n}"), "k", "v").awaitTermination()
    assert sorted(map(tuple, upserts.current(spark, table).select("k", "v").collect())) == [("a", 1), ("b", 2)]
    assert [n for n, _ in sorted(upserts.generations(spark, table))] == [0, 1]


def test_a_crash_between_renames_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "k string, v int")
    assert readers.recovered(spark, path) is None
    readers.upsert_parquet(spark, rows(("a", 1)), path, "k", "v")
    (tmp_path / "t").rename(tmp_path / "t.old")
    assert [tuple(r) for r in readers.recovered(spark, path).collect()] == [("a", 1)]
    readers.upsert_parquet(spark, rows(("b", 1)), path, "k", "v")
    assert sorted(map(tuple, readers.recovered(spark, path).collect())) == [("a", 1), ("b", 1)]


def test_vision_cache_and_adapters(spark, tmp_path):
    class Adapter:
        def classify(self, image, mime="image/png"):
            if image == b"boom":
                raise RuntimeError("down")
            return " a chart " if image == b"c" else "decorative"

        def extract(self, image, kind, mime="image/png"):
            return '{"description": "d"}'

    models.register_adapter("Local", Adapter)
    with pytest.raises(ValueError, match="unknown vision provider"):
        models.make_adapter("other")
    pictures = spark.createDataFrame([("h1", bytearray(b"c")), ("h1", bytearray(b"c")), ("h2", bytearray(b"x")), ("h3", bytearray(b"boom"))], "content_hash string, image binary")
    seen = models.seen(pictures, lambda: Adapter())
    assert sorted((r.content_hash, r.classification, r.reply) for r in seen.collect()) == [("h1", "CHART", '{"description": "d"}'), ("h2", "DECORATIVE", None), ("h3", "OTHER", None)]
    from loomquery.operators import images

    path = str(tmp_path / "cache")
    assert collection.get_sidecars(spark, path).count() == 0
    found = seen.select("content_hash", images.extraction(F.col("reply"), F.col("classification")).alias("e"), F.lit(1).alias("version"))
    collection.put_sidecars(spark, found, path)
    asked = spark.createDataFrame([("h1",), ("h9",)], "content_hash string")
    assert sorted((r.content_hash, r.has, r.useful) for r in collection.has_sidecar(spark, asked, path).collect()) == [("h1", True, True), ("h9", False, False)]
    occurrences = spark.createDataFrame([("a", i, 0.2) for i in range(10)] + [("b", 20, 0.2), ("b", 21, 0.4), ("c", 30, 0.01), ("c", 31, None)], "content_hash string, seq long, area_ratio double")
    assert ingest.image_diagnostics(occurrences).first().asDict() == {"n_occurrences": 14, "n_below_floor": 2, "n_images": 2, "n_watermarks": 1, "n_watermark_occurrences": 10, "n_kept": 1}
    assert sorted((r.seq, r.is_representative) for r in ingest.image_occurrences(occurrences).collect()) == [(20, False), (21, True)]


def test_png(spark):
    def read(png):
        at, out = 8, {}
        while at < len(png):
            (n,) = struct.unpack_from(">I", png, at)
            kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
            assert struct.unpack_from(">I", png, at + 8 + n)[0] == zlib.crc32(kind + data)
            out[kind] = data
            at += 12 + n
        w, h, bits, colour = struct.unpack_from(">IIBB", out[b"IHDR"])
        channels = {0: 1, 2: 3, 6: 4}[colour]
        rows = np.frombuffer(zlib.decompress(out[b"IDAT"]), np.uint8).reshape(h, 1 + w * channels)
        assert bits == 8 and not rows[:, 0].any()
        return rows[:, 1:].reshape(h, w, channels)

    image = np.random.default_rng(1).integers(0, 256, (40, 60, 3), np.uint8)
    assert np.array_equal(read(models.render_png(image)), image)
    small = read(models.render_png(image, 30))
    assert small.shape == (20, 30, 3)
    want = image.reshape(20, 2, 30, 2, 3).astype(int).sum(axis=(1, 3))
    assert np.array_equal(small, (want + 2) // 4)
    df = spark.createDataFrame([("a", 60, 40, 3, bytearray(image.tobytes())), ("b", 3, 3, 1, bytearray(b"short")), ("c", 1, 1, 1, None)], "content_hash string, width int, height int, channels int, pixels binary")
    got = {r.content_hash: r.png for r in models.rendered(df).collect()}
    assert np.array_equal(read(bytes(got["a"])), image) and got["b"] is None is got["c"]


def test_rotating_client():
    said = []

    def connect(key):
        def complete(prompt):
            said.append((key, prompt))
            return {"content": prompt}

        return complete

    client = models.RotatingClient(["k1-aaaa", "k2-bbbb"], connect, cooldown_s=0.0, cooldowns=1, refuse_after=2)
    assert [client(str(i))["content"] for i in range(7)] == [str(i) for i in range(7)]
    assert [k[:2] for k, _ in said] == ["k1", "k1", "k2", "k2", "k1", "k1", "k2"]
    stats = client.stats()
    assert (stats["rotations"], stats["cooldowns"], stats["refusals"], stats["calls"], stats["current"]) == (2, 1, 3, [4, 3], "...bbbb")
    client("7")
    with pytest.raises(models.RateLimited, match="exhausted"):
        client("8")
    with pytest.raises(ValueError, match="no keys"):
        models.RotatingClient([], connect)


def test_injected_models(spark):
    def judge():
        def score(q, a, contexts, expected):
            if q == "boom":
                raise RuntimeError("down")
            return {"faithfulness": 0.5, "answer_relevancy": float("nan"), "context_precision": "junk", "context_recall": len(contexts)}

        return score

    rows = spark.createDataFrame([(1, "q", "a", ["x", "y"], "e"), (2, "boom", "a", [], "e"), (3, "q", "a", None, "e")], "query_id int, question string, answer string, contexts array<string>, expected string")
    got = {r.query_id: tuple(r)[1:] for r in models.judged(rows, judge).collect()}
    assert got == {1: (0.5, None, None, 2.0), 2: (None,) * 4, 3: (0.5, None, None, 1.0)}

    def embedder():
        return lambda texts: [[3.0 * len(t), 4.0 * len(t)] for t in texts]

    v = {r.query_id: r.v for r in retrieval.embedded(spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "query_id int, text string"), embedder).collect()}
    assert v == {1: [0.6, 0.8], 2: None, 3: None}

    def scorer():
        return lambda questions, texts: [len(set(q) & set(t)) for q, t in zip(questions, texts, strict=True)]

    pairs = spark.createDataFrame([(1, 7, 1, "abc", "bcd"), (1, 8, 2, "abc", "abc"), (1, 9, 3, "abc", None)], "query_id int, chunk_id int, rank int, question string, text string")
    scored = retrieval.scored_by(pairs, scorer)
    assert {r.chunk_id: r.model_score for r in scored.collect()} == {7: 2.0, 8: 3.0, 9: None}
    assert [r.chunk_id for r in retrieval.rerank(scored, F.col("model_score"), 2).orderBy("rank").collect()] == [8, 7]

    def rewriter():
        return lambda prompt: {"content": json.dumps({"rewrites": [prompt.upper(), " ", "x"]}) if "rice" in prompt else "no"}

    asked = spark.createDataFrame([(1, "rice"), (2, "tea")], "query_id int, text string")
    assert sorted(map(tuple, models.rewritten(asked, rewriter, "n={n} {question}", 2).collect())) == [(1, 0, "rice"), (1, 1, "N=2 RICE"), (1, 2, "x"), (2, 0, "tea")]


def test_tokens_of_a_library(spark):
    path = "/opt/tokenizers"
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    texts = ["a few plain words", None, "unbelievably " * 30]
    n = [len(Tokenizer.from_file(path).encode(t or "").ids) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.o for r in df.select(models.over_limit(F.col("t"), 10, models.library_tokens(path)).alias("o"), "i").orderBy("i").collect()] == [x > 10 for x in n]


def test_runs_resume(spark, tmp_path):
    questions = spark.createDataFrame([(1, "a"), (2, "out_of_scope"), (3, "a")], "query_id long, category string")
    asked = []

    def evaluate(left):
        ids = [r.query_id for r in left.collect()]
        asked.append(sorted(ids))
        ids = [i for i in ids if i != 3] if len(asked) == 1 else ids
        metrics = spark.createDataFrame([(i, 1, 1, 0.5) for i in ids if i != 1] + [(1, 0, 0, 0.0)], "query_id long, hit_at_5 int, hit_at_10 int, mrr_at_10 double").where(F.col("query_id").isin(ids))
        answers = models.call_model(spark.createDataFrame([(i, "p") for i in ids], "query_id long, prompt string"), lambda: lambda p: {"content": "That is NOT AVAILABLE.", "prompt_tokens": 2})
        judged = spark.createDataFrame([(i, 0.5, None, 1.0, 1.0) for i in ids], "query_id long, " + ", ".join(f"{m} double" for m in models.JUDGED))
        return evaluation.question_results(metrics, answers, judged, questions.where(F.col("query_id").isin(ids)))

    path, settings = str(tmp_path / "run"), evaluation.snapshot_of(answering.Settings(keys=("k1", "k2")))
    evaluation.run(spark, path, questions, evaluate, settings)
    summary, totals = evaluation.run(spark, path, questions, evaluate, settings)
    assert asked == [[1, 2, 3], [3]] and sorted(r.query_id for r in evaluation.read_progress(spark, path + "/progress").collect()) == [1, 2, 3]
    assert json.loads(evaluation.read_progress(spark, path + "/progress").first().settings)["n_keys"] == 2
    t = totals.first()
    assert (t.n_questions, t.retrieval_failures, t.failed_calls, t.prompt_tokens) == (3, 1, 0, 6)
    by = {r.category: r for r in summary.collect()}
    assert (by["overall"].faithfulness, by["overall"].faithfulness_n, by["overall"].answer_relevancy, by["overall"].answer_relevancy_failed) == (0.5, 2, 0.0, 2)
    assert (by["out_of_scope"].refusal_correct, by["out_of_scope"].refusal_correct_n, by["a"].refusal_correct, by["overall"].refusal_correct) == (1.0, 1, None, 1.0)
    lines = evaluation.summary_lines(summary)
    assert lines[2].startswith("out_of_scope") and "*1.0000" in lines[2] and lines[2].count("n/a") == 3 and lines[3].startswith("overall")
    assert spark.read.json(path + "/summary").first().n_questions == 3


def test_settings():
    s = answering.Settings.from_environment({"LOOMQUERY_TOP_K": "7", "LOOMQUERY_MIN_SCORE": "0.5", "LOOMQUERY_KEYS": "a, ,b"})
    assert (s.top_k, s.min_score, s.keys, s.pool) == (7, 0.5, ("a", "b"), 20)
    assert evaluation.snapshot_of(s)["score"] == "overlap_score" and "keys" not in evaluation.snapshot_of(s)


def test_old_conversations_stay_hidden(spark):
    a, t = "a" * 32, dt.datetime(2024, 1, 1)
    legacy = spark.createDataFrame([(9, "old", "2023-01-01 00:00:00")], "conv_id long, title string, created_at string")
    own = spark.createDataFrame([chat.change("create", a, 1, t, 100, title="new"), chat.change("add", a, 9, t, 101, role="user", content="x"), chat.change("add", a, 1, t, 102, role="user", content="y")], chat.LOG_SCHEMA)
    log = chat.migrated(legacy).unionByName(own)
    assert [(r.conv_id, r.n_messages) for r in chat.conversations(log).collect()] == [(1, 1)] and chat.conversation(log, a, 9).count() == 0 == chat.conversation(log, "b" * 32, 1).count()
    assert {r.seq: r.reason for r in chat.refused(log).collect()} == {101: "not_owner"}
    with pytest.raises(ValueError, match="unknown role"):
        chat.change("add", a, 1, t, 1, role="system")
    new = {r.u for r in spark.range(50).select(chat.user_id_or_new(F.lit("nobody")).alias("u")).collect()}
    assert len(new) == 50 and all(len(u) == 32 for u in new)


def test_checked_collections(spark):
    chunks = lambda *r: spark.createDataFrame(r, "chunk_id long, text string")
    for bad, why in ((chunks().where("false") if False else spark.createDataFrame([], "chunk_id long, text string"), "empty"), (chunks((1, "a"), (None, "b")), "no id"), (chunks((1, None)), "no text"), (chunks((1, "a"), (1, "b")), "2 times")):
        with pytest.raises(ValueError, match=why):
            retrieval.checked_collection(bad)
    assert retrieval.checked_collection(chunks((1, "a"))).count() == 1


def test_fills_where_nearly_all_is_hit(spark):
    """Common words weigh less than nothing and nearly every chunk holds them: the few others come first, however late their ids."""
    chunks = spark.createDataFrame([(i, "a c" if i not in (170, 190) else "c") for i in range(200)], "chunk_id long, text string")
    got = retrieval.bm25(spark.createDataFrame([(1, "a")], "query_id long, text string"), chunks, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got][:2] == [170, 190] and got[2].score < 0


def test_many_queries_meet_vectors_in_a_grid(spark, monkeypatch):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(60, 5)).round(1)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(90, None), (91, [1.0])], "chunk_id long, v array<double>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m[:20])], "query_id long, v array<double>")
    few = sorted(map(tuple, retrieval.vector_topk(q, v, 4).collect()))
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    assert sorted((a, b, d) for a, b, _, d in map(tuple, retrieval.vector_topk(q, v, 4).collect())) == [(a, b, d) for a, b, _, d in few]
    score = (m[:20] @ m.T).round(9)
    assert [b for a, b, _, d in sorted(few, key=lambda r: (r[0], r[3])) if a == 3] == sorted(range(60), key=lambda j: (-score[3][j], j))[:4]
    assert retrieval.vector_topk(q.where("false"), v).count() == 0


def test_blocks_of_scores_are_bounded(monkeypatch):
    """Many queries against many vectors: no more scores at once than SCORES, and the same hits."""
    rng, seen, best = np.random.default_rng(5), [], retrieval._best
    q, v = rng.normal(size=(90, 4)).round(1), rng.normal(size=(70, 4)).round(1)
    whole = retrieval._hits(np.arange(90), np.arange(70), q @ v.T, 3)
    monkeypatch.setattr(retrieval, "_best", lambda score, own, k: seen.append(score.size) or best(score, own, k))
    monkeypatch.setattr(retrieval, "SCORES", 500)
    got = retrieval._tiled(np.arange(90), q, np.arange(70), v, 3)
    assert got.drop_columns("score").equals(whole.drop_columns("score").combine_chunks()) and max(seen) <= 500 and sum(seen) == 6300


def test_streams_keep_ids(spark, tmp_path):
    rows = [(f"c{i % 3}", float(i), i) for i in range(40)] + [(None, 1.0, 99), ("c0", None, 98)]
    df = spark.createDataFrame(rows, "client string, t double, query_id long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limiter.limited_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), limit=2, window_s=15)
    q = stream.writeStream.format("memory").queryName("kept_ids").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {r.query_id: r.admitted for r in spark.sql("SELECT * FROM kept_ids").collect()}
    assert got == {r.query_id: r.admitted for r in limiter.admissions(df, 2, 15).collect()} and 98 not in got
    calls = spark.createDataFrame([("a", i, i % 2 == 0) for i in range(10)] + [("b", 1, None), (None, 2, True)], "client string, seq int, limited boolean")
    assert sorted(tuple(r) for r in upserts.rotations(calls, 2).collect()) == [("a", 10, 3, 2, 1, 5), ("b", 1, 0, 0, 0, 0)]


def test_small_expressions(spark):
    df = spark.range(1).select(F.array(F.lit("a: why"), F.lit("plain"), F.lit("b: c: d")).alias("i"), F.array(*map(F.lit, "abcde")).alias("b"))
    r = df.select(replies.missing_labels(F.col("i")).alias("m"), replies.batches(F.col("b"), 2).alias("b"), replies.batches(F.slice("b", 1, 0), 2).alias("e"), replies.utc_now().alias("t")).first()
    assert (r.m, r.b, r.e) == (["why", "plain", "c: d"], [["a", "b"], ["c", "d"], ["e"]], [])
    assert abs(dt.datetime.now(dt.UTC) - dt.datetime.fromisoformat(r.t)) < dt.timedelta(minutes=5)
    with pytest.raises(ValueError, match="positive"):
        replies.batches(F.col("b"), 0)

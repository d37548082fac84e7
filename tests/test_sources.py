"""Readers, sinks and the upsert stream on files made here."""

import json

from pyspark.sql import functions as F

from loomquery.operators import chunking, images
from loomquery.sources import readers
from loomquery.streaming import upserts


def test_listing_and_pages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"one|two||four")
    (tmp_path / "sub" / "b.pdf").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"no")
    assert sorted((r.filename, r.length) for r in readers.list_files(spark, str(tmp_path), "*.pdf").collect()) == [("a.pdf", 13), ("b.pdf", 6)]

    def extract(content):
        if content == b"broken":
            raise ValueError("not a document")
        return bytes(content).decode().split("|")

    got = readers.load_pages(spark, str(tmp_path), extract).collect()
    assert sorted((r.page, r.text) for r in got if r.error is None) == [(1, "one"), (2, "two"), (3, ""), (4, "four")]
    assert [(r.page, r.error) for r in got if r.error] == [(None, "not a document")]
    pages = spark.createDataFrame([("x", 1, "a" * 60), ("x", 2, None), ("y", 1, "a" * 100)], "doc string, page int, text string")
    assert sorted((r.doc, r.total_pages, r.total_chars, r.empty) for r in readers.corpus_summary(pages).collect()) == [("x", 2, 60, True), ("y", 1, 100, False)]


def test_workflows(spark, tmp_path):
    (tmp_path / "w.csv").write_text("﻿ step , note\n 1 , a \n2\n3,b,c, d\n", encoding="utf-8")
    (tmp_path / "w_index.csv").write_text("step\n9\n")
    got = sorted((r.pos, r.fields) for r in readers.load_workflows(spark, str(tmp_path)).collect())
    assert got == [(0, {"step": "1", "note": "a"}), (1, {"step": "2", "note": ""}), (2, {"step": "3", "note": "b", "": "c, d"})]


def test_rules_and_questions(spark, tmp_path):
    rule = {"attribute": "has_land", "values": [True, "unknown"]}
    (tmp_path / "rules.json").write_text(json.dumps({"schemes": [{"code": "A", "always_include": True, "applicability_rules": [rule], "disqualifying_rules": [], "match_boost_if": [], "required_information": [{"attribute": "gender", "why_needed": "share"}]}, {"code": "B", "applicability_rules": [rule]}]}, indent=1))
    rules, schemes, required = readers.load_rules(spark, str(tmp_path / "rules.json"))
    assert sorted((r.code, r.kind, r.attribute, r["values"]) for r in rules.collect()) == [(c, "applicability", "has_land", ["true", "unknown"]) for c in "AB"]
    assert sorted((r.code, r.always_include) for r in schemes.collect()) == [("A", True), ("B", False)]
    assert [(r.code, r.attribute, r.why) for r in required.collect()] == [("A", "gender", "share")]
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"question_id": f"q{i}"} for i in range(4)]}, indent=1))
    assert [r.question_id for r in readers.load_questions(spark, str(tmp_path / "q.json"), 2).orderBy("pos").collect()] == ["q0", "q1"]
    assert readers.load_questions(spark, str(tmp_path / "q.json")).count() == 4


def test_sinks(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "k string, v int")
    for part in (rows(("a", 1)), rows(("b", 2))):
        readers.append_results(part, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    table = str(tmp_path / "table")
    readers.upsert_parquet(spark, rows(("a", 1), ("b", 1)), table, "k", "v")
    readers.upsert_parquet(spark, rows(("a", 3), ("c", 1)), table, "k", "v")
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == [("a", 3), ("b", 1), ("c", 1)]


def test_upsert_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    assert upserts.current(spark, table) is None
    for batch in ([("a", 1), ("b", 1)], [("a", 2), ("c", 5)], []):
        spark.createDataFrame(batch, "k string, v int").write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, v int").parquet(source)
        upserts.upsert_stream(stream, table, str(tmp_path / "checkpoint"), "k", "v").awaitTermination()
    assert sorted(map(tuple, upserts.current(spark, table).select("k", "v").collect())) == [("a", 2), ("b", 1), ("c", 5)]


def test_image_replies(spark):
    cases = {
        '```json\n{"description": "d", "dates": "2024", "labels": [1, null, "x"]}\n```': ("d", ["2024"], ["1", "x"], False, None),
        " ": ("", [], [], True, "empty response body"), "{oops": ("", [], [], True, "json parse"), "[1]": ("", [], [], True, "json parse"), "{}": ("", [], [], False, None),
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "reply string")
    got = {r.reply: (r.e.description, r.e.dates, r.e.labels, r.e.vision_failed, r.e.error) for r in df.select("reply", images.extraction(F.col("reply"), F.lit("TABLE")).alias("e")).collect()}
    assert got == cases | {None: ("", [], [], True, "empty response body")}
    kept = images.cached(spark.createDataFrame([("a", '{"classification": "TABLE"}'), ("b", "junk"), ("c", '{"classification": "POSTER"}'), ("d", None)], "content_hash string, sidecar string"))
    assert [(r.content_hash, r.vision_failed, r.attempt) for r in kept.collect()] == [("a", False, 1)]
    places = spark.createDataFrame([("a", "S", "", "x y.pdf", 2, 7)], "content_hash string, scheme string, parent_subfolder string, filename string, page int, xref int")
    assert [(r.chunk_id, r.text) for r in images.image_chunks(places, kept).collect()] == [("S_x_y_img_p0002_x7_ha", "[IMAGE]\nclassification: TABLE\n[/IMAGE]")]


def test_layout_fallbacks(spark):
    blocks = spark.createDataFrame([(1, 1, 0, 0, 10, 0, 10, " kept ", 0), (1, 1, 1, 0, 10, 20, 30, "in a table", 0), (1, 1, 2, 0, 10, 40, 50, "unread table", None), (1, 1, 3, 0, 1, 90, 91, "picture", 1)], "doc int, page int, pos int, x0 int, x1 int, y0 int, y1 int, text string, block_type int")
    tables = spark.createDataFrame([(1, 1, 0, 0, 10, 20, 30, [["a\nb", None]]), (1, 1, 1, 0, 10, 40, 50, None), (2, 5, 0, 0, 1, 0, 1, [])], "doc int, page int, pos int, x0 int, x1 int, y0 int, y1 int, rows array<array<string>>")
    pages = "doc int, page int, text string"
    got = chunking.structured_chunks(blocks, tables, spark.createDataFrame([(1, 2, " raw "), (1, 3, " ")], pages), spark.createDataFrame([(3, 1, "plain"), (4, 1, "")], pages))
    rows = sorted((r.doc, r.kind, r.idx, r.page_start, r.page_end, r.chunk) for r in got.collect())
    assert rows == [(1, "c", 0, 1, 2, "\n\n[PAGE 1]\n\nkept \nunread table\n\n[PAGE 2]\n\nraw"), (1, "tbl", 0, 1, 1, "[TABLE]\n| a b |  |\n[/TABLE]"), (3, "c", 0, 1, 1, "\n\n[PAGE 1]\n\nplain")]
    lost = spark.createDataFrame([(3, 1, "plain"), (4, 1, "")], pages)
    assert sorted((r.doc, r.tables_detected, r.text_windows, r.fallback) for r in chunking.structure_summary(got, lost).collect()) == [(1, 1, 1, None), (3, 0, 1, "open_failed"), (4, 0, 0, "open_failed")]

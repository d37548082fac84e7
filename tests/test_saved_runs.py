"""Runs that are killed and resumed, and files that loaders can't read."""

import json

import pytest
from pyspark.sql import functions as F

from loomquery.plans import answering, evaluation, models
from loomquery.sources import readers


class Killed(Exception):
    pass


def test_a_killed_run_goes_on_where_it_was(spark, tmp_path):
    questions = spark.createDataFrame([(i, "out_of_scope" if i % 5 == 0 else "a") for i in range(11)], "query_id long, category string")
    asked, fatal = [], {2}

    def evaluate(part):
        ids = sorted(r.query_id for r in part.collect())
        if len(asked) in fatal:
            fatal.clear()
            raise Killed
        asked.append(ids)
        rows = [(i, "a", 1, 1, 0.5, *[0.5] * len(models.JUDGED), 1.0 if i % 5 == 0 else None, None, 10, 1, 0, 0) for i in ids if i != 7]
        kinds = "query_id long, category string, hit_at_5 int, hit_at_10 int, mrr_at_10 double, " + ", ".join(f"{m} double" for m in models.JUDGED) + ", refusal_correct double, call_error string, prompt_tokens long, completion_tokens long, reasoning_tokens long, retries long"
        return spark.createDataFrame(rows, kinds)

    path = str(tmp_path / "run")
    with pytest.raises(Exception, match="Killed"):
        evaluation.run(spark, path, questions, evaluate, {"a": 1}, batch=3)
    saved = readers.recovered(spark, f"{path}/results")
    assert len(asked) == 2 and sorted(r.query_id for r in saved.collect()) == sorted(i for ids in asked for i in ids if i != 7)
    _, totals = evaluation.run(spark, path, questions.unionByName(spark.createDataFrame([(50, "a")], "query_id long, category string")), evaluate, {"a": 1}, batch=3)
    done = [i for ids in asked for i in ids]
    # Only the question that got no result is asked again, and the new one is asked.
    assert sorted(done) == sorted([*range(11), 50, 7]) and totals.first().n_questions == 11 and totals.first().prompt_tokens == 110
    assert {r.query_id for r in evaluation.read_progress(spark, f"{path}/progress").collect()} == set(range(11)) - {7} | {50}
    before = len(asked)
    evaluation.run(spark, path, questions.where("query_id <> 7"), evaluate, {"a": 1}, batch=3)
    assert len(asked) == before


def test_a_batch_that_was_saved_is_not_evaluated_again(spark, tmp_path, monkeypatch):
    """Killed after the results were published and before the stream noted the batch."""
    questions = spark.createDataFrame([(i, "a") for i in range(4)], "query_id long, category string")
    asked = []

    def evaluate(part):
        asked.append(sorted(r.query_id for r in part.collect()))
        return part.select("query_id", "category", *(F.lit(0.0).alias(m) for m in (*evaluation.METRICS, *models.JUDGED, "refusal_correct")), F.lit(None).cast("string").alias("call_error"), *(F.lit(1).alias(c) for c in ("prompt_tokens", "completion_tokens", "reasoning_tokens", "retries")))

    apply = evaluation.KeyedStore.apply
    with monkeypatch.context() as m:

        def killed(self, *a, **b):
            apply(self, *a, **b)
            if b.get("stream"):
                raise Killed

        m.setattr(evaluation.KeyedStore, "apply", killed)
        with pytest.raises(Exception, match="Killed"):
            evaluation.run(spark, str(tmp_path / "run"), questions, evaluate, {}, batch=2)
    evaluation.run(spark, str(tmp_path / "run"), questions, evaluate, {}, batch=2)
    assert len(asked) == 2 and sorted(i for ids in asked for i in ids) == [0, 1, 2, 3]


def test_files_without_pages_and_broken_tables(spark, tmp_path):
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf/none.pdf").write_bytes(b"none")
    (tmp_path / "pdf/two.pdf").write_bytes(b"a|b")
    (tmp_path / "pdf/bad.pdf").write_bytes(b"bad")

    def extract(content):
        if content == b"bad":
            raise ValueError("no")
        return [] if content == b"none" else bytes(content).decode().split("|")

    root = f"file://{tmp_path}/pdf"
    assert {r.path.rsplit("/")[-1]: (r.page, r.error) for r in readers.load_pages(spark, root, extract).where("page is null").collect()} == {"none.pdf": (None, None), "bad.pdf": (None, "no")}
    _, summary, failures = readers.load_corpus(spark, [("S", root), ("T", f"file://{tmp_path}/lacking")], extract)
    got = {r.scheme: r for r in summary.collect()}
    assert (got["S"].n_docs, got["S"].n_empty, got["S"].n_failed, got["S"].total_pages) == (2, 2, 1, 2) and got["T"].n_docs == 0 and failures.count() == 1
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv/good.csv").write_text("﻿step,note\n1,a\n", encoding="utf-8")
    (tmp_path / "csv/latin.csv").write_bytes(b"step,note\n1,caf\xe9\n")
    (tmp_path / "csv/wide.csv").write_text("step\n" + "x" * 200_000 + "\n")
    rows = {r.path.rsplit("/")[-1]: r for r in readers.load_workflows(spark, f"file://{tmp_path}/csv").collect()}
    assert rows["good.csv"].fields == {"step": "1", "note": "a"} and rows["good.csv"].error is None and rows["good.csv"].pos == 0
    assert rows["latin.csv"].error.startswith("UnicodeDecodeError") and rows["wide.csv"].error.startswith("Error") and rows["latin.csv"].fields is None
    assert readers.load_workflows(spark, f"file://{tmp_path}/nowhere").count() == 0


def test_rules_keep_their_places_and_what_schemes_show(spark, tmp_path):
    place = {"filename": "faq.pdf", "page": 3, "note": "holders of land"}
    scheme = {
        "code": "A", "name": "Alpha", "long_name": "Alpha Plan", "category": "income", "one_liner": "pays", "key_benefits": [f"b{i}" for i in range(6)], "who_should_apply": "all", "how_to_register": {"portal": "x.example"},
        "follow_up_query_hint": "how?", "authoritative_source": {"filename": "a.pdf", "page": 1, "note": "n"},
        "applicability_rules": [{"attribute": "has_land", "values": [True, "unknown"], "source": place}], "match_boost_if": [{"attribute": "crop_group", "values": ["rice"]}], "required_information": [{"attribute": "gender", "why_needed": "share"}],
    }
    (tmp_path / "rules.json").write_text(json.dumps({"schemes": [scheme]}, indent=1))
    tables = readers.load_rules(spark, str(tmp_path / "rules.json"))
    asked = spark.createDataFrame([(1, "which schemes for 3 acres of rice"), (2, "hello")], "query_id long, text string")
    (row,) = answering.discover(asked, *tables).collect()
    (match,) = row.matches
    assert (match.code, match.name, match.key_benefits, match.how_to_register, match.authority.filename, match.boost_hits) == ("A", "Alpha", ["b0", "b1", "b2", "b3"], {"portal": "x.example"}, "a.pdf", 1)
    assert [(r.kind, r.attribute, r.matched, r.filename, r.page, r.note) for r in row.reasons] == [("applicability", "has_land", "true", "faq.pdf", 3, "holders of land"), ("boost", "crop_group", "rice", None, None, None)]
    assert [(m.attribute, m.why) for m in row.missing] == [("gender", "share")]

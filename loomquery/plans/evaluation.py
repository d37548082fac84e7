"""Retrieval under test: five modes over the same questions, scored by the sources that they find."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import retrieval
from ..sources import readers
from ..sources.lexical import LexicalIndex
from ..sources.store import KeyedStore
from ..streaming import upserts
from .answering import Settings, lexical_pool
from .models import JUDGED

MODES = ("baseline", "reranked", "hybrid", "query_transform", "full")


def _rescored(pool: DataFrame, questions: DataFrame, chunks: DataFrame, settings: Settings) -> DataFrame:
    asked = questions.select("query_id", F.col("text").alias("question"))
    full = pool.select("query_id", "chunk_id", "rank").join(chunks.select("chunk_id", "text"), "chunk_id").join(asked, "query_id")
    return retrieval.rerank(full, settings.score(F.col("question"), F.col("text")), settings.top_k)


def retrieve(mode: str, questions: DataFrame, chunks: DataFrame, semantic: DataFrame, rewrites: DataFrame | None = None, settings: Settings = Settings(), index: LexicalIndex | None = None) -> DataFrame:
    """query_id, chunk_id, rank as a mode finds them.

    semantic: (query_id, chunk_id, score, rank), the pool for each question; rewrites: (query_id, list_idx, chunk_id, rank), the same for each rewrite, with list_idx above 0.
    baseline is that pool; reranked its best after rescoring; hybrid fuses it with the lexical pool; query_transform fuses it with the rewrites' pools
    (a question without rewrites keeps its own); full rescores what hybrid finds in the depth of the pool.
    """
    if mode == "baseline":
        out = semantic.where(F.col("rank") <= settings.pool)
    elif mode == "reranked":
        out = _rescored(semantic, questions, chunks, settings)
    elif mode == "query_transform":
        own = semantic.select("query_id", F.lit(0).alias("list_idx"), "chunk_id", "rank")
        out = retrieval.fuse(own if rewrites is None else own.unionByName(rewrites.select("query_id", "list_idx", "chunk_id", "rank")), settings.top_k)
    elif mode in ("hybrid", "full"):
        pool = retrieval.hybrid(semantic, lexical_pool(questions.select("query_id", "text"), chunks, index, settings.pool), settings.pool)
        out = pool.where(F.col("rank") <= settings.top_k) if mode == "hybrid" else _rescored(pool, questions, chunks, settings)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return out.select("query_id", "chunk_id", "rank")


def scored(ranked: DataFrame, sources: DataFrame, expected: DataFrame, questions: DataFrame) -> DataFrame:
    """hit_at_5, hit_at_10, mrr_at_10 for each question. sources: (chunk_id, key); a chunk without a key goes before ranks are counted, so those below it move up."""
    keyed = ranked.join(sources.where("key is not null"), "chunk_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return retrieval.retrieval_metrics(keyed.withColumn("rank", place).select("query_id", "key", "rank"), expected, questions)


def compare(questions: DataFrame, chunks: DataFrame, semantic: DataFrame, rewrites: DataFrame | None, sources: DataFrame, expected: DataFrame, modes: tuple[str, ...] = MODES, settings: Settings = Settings(), index: LexicalIndex | None = None) -> DataFrame:
    """mode, query_id and the metrics, for all modes."""
    out = None
    for mode in modes:
        part = scored(retrieve(mode, questions, chunks, semantic, rewrites, settings, index), sources, expected, questions).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


def resume(questions: DataFrame, results: DataFrame, progress: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pending, lost): questions without a result, and ids that the progress table (query_id) names but the results lack, which are run again."""
    done = results.select("query_id").distinct()
    return questions.join(done, "query_id", "left_anti"), progress.select("query_id").distinct().join(done, "query_id", "left_anti")


METRICS = ("hit_at_5", "hit_at_10", "mrr_at_10")


def question_results(metrics: DataFrame, answers: DataFrame, judged: DataFrame, questions: DataFrame) -> DataFrame:
    """One row for each question of a run: category, retrieval metrics, the judge's, whether the answer refuses, and the tokens of its call.

    questions: (query_id, category); metrics by ``scored``; answers: (query_id, reply and counts of models.call_model); judged by models.judged.
    """
    refusal = answers.select("query_id", tx.is_refusal(F.col("reply")).alias("refusal_correct"), F.col("error").alias("call_error"), "prompt_tokens", "completion_tokens", "reasoning_tokens", "retries")
    return questions.select("query_id", "category").join(metrics, "query_id", "left").join(judged, "query_id", "left").join(refusal, "query_id", "left")


def run_summary(results: DataFrame) -> DataFrame:
    """eval_summary over results of ``question_results``: retrieval metrics, the judge's, and refusal_correct of questions out of scope."""
    return retrieval.eval_summary(results, METRICS, JUDGED, "refusal_correct")


def run_totals(results: DataFrame) -> DataFrame:
    """One row: questions, how many found nothing within ten ranks, failed calls, and tokens."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return results.agg(F.count("*").alias("n_questions"), F.count_if(F.coalesce("hit_at_10", F.lit(0)) == 0).alias("retrieval_failures"), F.count("call_error").alias("failed_calls"), *map(zero, ("prompt_tokens", "completion_tokens", "reasoning_tokens", "retries")))


def write_progress(results: DataFrame, path: str, snapshot: dict) -> None:
    """The ids that are done, with the run's settings, as the next state of the table at path."""
    done = results.select("query_id").distinct().withColumn("settings", F.lit(json.dumps(snapshot, sort_keys=True)))
    KeyedStore(results.sparkSession, path, "query_id").apply(done)


def read_progress(spark: SparkSession, path: str) -> DataFrame | None:
    """query_id, settings of the last complete state; None before the first."""
    return upserts.current(spark, path)


def run(spark: SparkSession, path: str, questions: DataFrame, evaluate: Callable[[DataFrame], DataFrame], snapshot: dict, batch: int = 32) -> tuple[DataFrame, DataFrame]:
    """(summary, totals) of a run that saves as it goes and goes on where an earlier one stopped.

    evaluate gives question_results for the questions that it gets, about ``batch`` at a time. What is pending is written as a plan, one file for each batch; a stream reads a plan file by file, and each
    batch's results and its number become one state of the results, so a run that is killed goes on with the batch that it was at, and no finished question is evaluated again. A plan that an earlier run
    left is finished first; questions that got no result, or are new, make the next one.
    """
    results = KeyedStore(spark, f"{path}/results", "query_id")
    plans = len(results.log.names(f"{path}/plans"))
    if plans and readers.exists(spark, f"{path}/plans/{plans - 1:06d}/_SUCCESS"):
        _follow(spark, path, plans - 1, evaluate, results)
    held = results.read()
    left = questions if held is None else resume(questions, held, held.select("query_id"))[0]
    n = left.count()
    if n:
        left.repartitionByRange(-(-n // batch), "query_id").write.mode("overwrite").option("maxRecordsPerFile", batch).parquet(f"{path}/plans/{plans:06d}")
        _follow(spark, path, plans, evaluate, results)
    done = results.read()
    lacking = [F.lit(None).cast("double").alias(m) for m in (*JUDGED, "call_error") if m not in done.columns]
    done = done.select("*", *lacking)
    write_progress(done, f"{path}/progress", snapshot)
    summary, totals = run_summary(done), run_totals(done)
    readers.write_json(totals.withColumn("settings", F.lit(json.dumps(snapshot, sort_keys=True))), f"{path}/summary")
    return summary, totals


def _follow(spark: SparkSession, path: str, plan: int, evaluate: Callable[[DataFrame], DataFrame], results: KeyedStore) -> None:
    """Evaluate what a plan has left: a stream over its files, one a batch, whose checkpoint and results name the batches that are done."""
    folder = f"{path}/plans/{plan:06d}"

    def save(part: DataFrame, number: int) -> None:
        name = f"plan-{plan:06d}"
        if results.state()["streams"].get(name, -1) < number:
            results.apply(evaluate(part), stream=(name, number))

    source = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = source.writeStream.foreachBatch(save).option("checkpointLocation", f"{path}/checkpoints/{plan:06d}").trigger(availableNow=True).start()
    query.awaitTermination()


def snapshot_of(settings) -> dict:
    """A run's settings as names and plain values; of keys only their number is kept, of functions their name."""
    out = {}
    for f in dataclasses.fields(settings):
        v = getattr(settings, f.name)
        out[f"n_{f.name}" if f.name.endswith("keys") else f.name] = len(v) if f.name.endswith("keys") else v.__name__ if callable(v) else v
    return out


def summary_lines(summary: DataFrame) -> list[str]:
    """The summary as a table of text: categories by name, then overall; a row of questions out of scope shows its refusals, marked, in place of faithfulness, and no other judged metric."""
    columns = ["n", *METRICS, *JUDGED]
    lines = [f"{'category':<28} " + " ".join(f"{c:>18}" for c in columns)]
    rows = sorted(summary.collect(), key=lambda r: (r["category"] == "overall", r["category"]))
    for r in rows:
        cells = []
        for c in columns:
            if r["category"] == "out_of_scope" and c == "faithfulness":
                cells.append(f"*{r['refusal_correct'] or 0.0:.4f}")
            elif r["category"] == "out_of_scope" and c in JUDGED:
                cells.append("n/a")
            else:
                cells.append(f"{r[c] or 0}" if c == "n" else f"{r[c] or 0.0:.4f}")
        lines.append(f"{r['category']:<28} " + " ".join(f"{x:>18}" for x in cells))
    return lines

"""The composite request: validation, discovery, retrieval, gate, answer, for a table of questions at once.

Every question ends as one row with an outcome. Questions that validation turns away don't reach retrieval. Models are injected: ``score``
rescores (question, text) and ``generate`` makes an answer from (question, passages); the stand-ins here need no model.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions import replies
from ..functions import text as tx
from ..operators import retrieval, rules
from ..sources.lexical import LexicalIndex
from ..streaming import limiter

PREVIEW_CHARS = 800


@dataclass(frozen=True)
class Settings:
    """What a caller may set for one run. ``from_environment`` reads the numbers and names from variables with a prefix."""

    pool: int = fx.POOL
    top_k: int = fx.TOP_K
    min_score: float = fx.MIN_RERANK_SCORE
    score: Callable[[Column, Column], Column] = retrieval.overlap_score
    rate_limit: int = fx.RATE_LIMIT
    rate_window_s: int = fx.RATE_WINDOW_S
    preview_chars: int = PREVIEW_CHARS
    chunk_size: int = fx.CHUNK_SIZE
    chunk_overlap: int = fx.CHUNK_OVERLAP
    embed_batch: int = 64
    generation_model: str = ""
    judge_model: str = ""
    embedding_model: str = ""
    keys: tuple[str, ...] = ()
    cooldown_s: float = 60.0

    @classmethod
    def from_environment(cls, environ: Mapping[str, str], prefix: str = "LOOMQUERY_") -> "Settings":
        """Defaults, with what the variables set: LOOMQUERY_TOP_K and so on; keys are separated by commas, and blank ones go."""
        kinds = {"int": int, "float": float, "str": str, "tuple[str, ...]": lambda v: tuple(k for k in map(str.strip, v.split(",")) if k)}
        given = {f.name: kinds[f.type](environ[prefix + f.name.upper()]) for f in fields(cls) if f.type in kinds and prefix + f.name.upper() in environ}
        return cls(**given)


def extract_answer(question: Column, passages: Column) -> Column:
    """The stand-in generator: the first passage's text up to 800 characters."""
    return F.substring(F.element_at(passages, 1)["text"], 1, PREVIEW_CHARS)


def lexical_pool(queries: DataFrame, chunks: DataFrame, index: LexicalIndex | None, k: int) -> DataFrame:
    """BM25 over the chunks, by their stored index where there is one."""
    return retrieval.bm25(queries, chunks, k) if index is None else index.search(queries, k)


def ranked_passages(queries: DataFrame, chunks: DataFrame, semantic: DataFrame | None, settings: Settings, index: LexicalIndex | None = None) -> DataFrame:
    """query_id, chunk_id, text, semantic_rank, bm25_rank, original_rank, rerank_score, rank: lexical hits, fused with semantic ones where given, rescored."""
    pool = lexical_pool(queries, chunks, index, settings.pool)
    if semantic is not None:
        pool = retrieval.hybrid(semantic.join(queries.select("query_id"), "query_id", "left_semi"), pool, settings.pool)
    else:
        pool = pool.select("*", F.lit(None).cast("int").alias("semantic_rank"), F.col("rank").alias("bm25_rank"))
    asked = queries.select("query_id", F.col("text").alias("question"))
    full = pool.select("query_id", "chunk_id", "rank", "semantic_rank", "bm25_rank").join(chunks.select("chunk_id", "text"), "chunk_id").join(asked, "query_id")
    return retrieval.rerank(full, settings.score(F.col("question"), F.col("text")), settings.top_k).drop("question")


def answer(queries: DataFrame, chunks: DataFrame, semantic: DataFrame | None = None, settings: Settings = Settings(), generate: Callable[[Column, Column], Column] = extract_answer, index: LexicalIndex | None = None) -> DataFrame:
    """query_id, outcome, reason, top_score, passages, answer (scrubbed), pii_kinds for (query_id, text).

    outcome is invalid (validation's reason follows), no_results, low_confidence or answered. Passages come back with refusals too, previews cut first and scrubbed then.
    """
    checked = queries.select("query_id", "text", tx.validation_reason(F.col("text")).alias("validation"))
    valid = checked.where("validation = 'valid'").select("query_id", tx.strip(F.col("text")).alias("text"))
    ranked = ranked_passages(valid, chunks, semantic, settings, index)
    gated = retrieval.gate(valid, ranked, settings.min_score)
    found = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "rerank_score", "original_rank", "text", "semantic_rank", "bm25_rank"))).alias("p"))
    all_rows = checked.join(gated, "query_id", "left").join(found, "query_id", "left")
    outcome = F.when(F.col("validation") != "valid", "invalid").when(F.col("p").isNull(), "no_results").when(~F.col("passed"), "low_confidence").otherwise("answered")
    raw = F.when(outcome == "answered", generate(F.col("text"), F.col("p")))
    scrubbed, kinds = tx.scrub(raw)
    preview = F.transform("p", lambda x: F.struct(x["rank"].alias("rank"), x["chunk_id"].alias("chunk_id"), x["rerank_score"].alias("score"), tx.scrub(F.substring(x["text"], 1, settings.preview_chars))[0].alias("preview"), x["semantic_rank"].alias("semantic_rank"), x["bm25_rank"].alias("bm25_rank")))
    reason = F.when(outcome == "invalid", F.col("validation")).when(outcome == "low_confidence", F.format_string("top score %.3f is below %.3f", "top_score", F.lit(settings.min_score)))
    return all_rows.select("query_id", outcome.alias("outcome"), reason.alias("reason"), "top_score", preview.alias("passages"), scrubbed.alias("answer"), F.when(outcome == "answered", kinds).alias("pii_kinds"))


#: What a match shows of its scheme, where the table has it.
SHOWN = ("name", "long_name", "category", "one_liner", "key_benefits", "who_should_apply", "how_to_register", "follow_up", "authority")


def discover(queries: DataFrame, rule_table: DataFrame, schemes: DataFrame, required: DataFrame) -> DataFrame:
    """query_id, provided, matches, reasons, missing for questions that ask for schemes or name an attribute; the others have no row.

    provided: (attribute, value) of what is known, in fixed order; matches: (rank, code, boost_hits) and what the schemes table has of SHOWN, benefits as many as a reader is shown; reasons: why, by rules
    that something known meets, (rank, kind, rule_idx, code, attribute, matched) and the place that the rule cites; missing: (attribute, why), by the first match that asks.
    """
    known = rules.extract_attributes(queries).where("intent or any_explicit")
    matched = rules.match_schemes(known, rule_table, schemes)
    named = F.filter(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in rules.ATTRIBUTES)), lambda x: x["value"] != "unknown")
    tags = F.when(F.size("interests") > 0, F.array(F.struct(F.lit("interests").alias("attribute"), F.array_join("interests", ", ").alias("value")))).otherwise(F.array().cast("array<struct<attribute:string,value:string>>"))
    shown = [F.col(f"s.{c}") if c != "key_benefits" else replies.shown_benefits(F.col("s.key_benefits")).alias("key_benefits") for c in SHOWN if c in schemes.columns]
    told = matched.alias("m").join(schemes.alias("s"), F.col("m.code") == F.col("s.code")) if shown else matched.alias("m")
    hits = told.groupBy("m.query_id").agg(F.array_sort(F.collect_list(F.struct("m.rank", "m.code", "m.boost_hits", *shown)), lambda x, y: x["rank"] - y["rank"]).alias("matches"))
    cited = [c for c in ("filename", "page", "note") if c in rule_table.columns]
    why = rules.match_reasons(matched, known, rule_table).join(matched.select("query_id", "code", "rank"), ["query_id", "code"])
    reasons = why.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "kind", "rule_idx", "code", "attribute", "matched", *cited))).alias("reasons"))
    lacking = rules.missing_information(matched, required, known).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("attribute", "why"))).alias("missing"))
    return known.select("query_id", F.concat(named, tags).alias("provided")).join(hits, "query_id", "left").join(reasons, "query_id", "left").join(lacking, "query_id", "left")


def respond(queries: DataFrame, chunks: DataFrame, rule_table: DataFrame, schemes: DataFrame, required: DataFrame, semantic: DataFrame | None = None, settings: Settings = Settings(), index: LexicalIndex | None = None) -> DataFrame:
    """Answers with discovery beside them: one row for each question. Turned-away questions get no discovery."""
    answers = answer(queries, chunks, semantic, settings, index=index)
    valid = queries.where(tx.validation_reason(F.col("text")) == "valid")
    return answers.join(discover(valid, rule_table, schemes, required), "query_id", "left")


def serve(requests: DataFrame, chunks: DataFrame, rule_table: DataFrame, schemes: DataFrame, required: DataFrame, semantic: DataFrame | None = None, settings: Settings = Settings(), index: LexicalIndex | None = None) -> DataFrame:
    """respond for a log (query_id, client, t, text) of requests. Those over their client's limit get the outcome rate_limited and nothing else; a request without a client or time isn't limited."""
    refused = limiter.admissions(requests, settings.rate_limit, settings.rate_window_s).where("not admitted").select("query_id")
    answered = respond(requests.join(refused, "query_id", "left_anti").select("query_id", "text"), chunks, rule_table, schemes, required, semantic, settings, index)
    return answered.unionByName(refused.withColumn("outcome", F.lit("rate_limited")), allowMissingColumns=True)


def with_citations(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """answers with the citations of their passages, in order: an answered question cites each passage, any other none."""
    cited = answers.where("outcome = 'answered'").select("query_id", F.explode("passages").alias("p")).select("query_id", "p.rank", "p.chunk_id")
    known = chunks.select("chunk_id", replies.citation(chunks.columns).alias("c"))
    lists = cited.join(known, "chunk_id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "c"))), lambda x: x["c"]).alias("citations"))
    none = F.array().cast(lists.schema["citations"].dataType)
    return answers.join(lists, "query_id", "left").withColumn("citations", F.coalesce("citations", none))


def with_accounting(answers: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """answers with what their model call cost (models.call_model): tokens, retries, latency, why it ended, its error. Without a call the counts are 0 and it is not_called."""
    counts = ("prompt_tokens", "completion_tokens", "reasoning_tokens", "retries", "latency_ms")
    if calls is None:
        return answers.select("*", *(F.lit(0).cast("long").alias(c) for c in counts), F.lit("not_called").alias("finish_reason"), F.lit(None).cast("string").alias("llm_error"))
    made = calls.select("query_id", *(F.col(c).cast("long").alias(c) for c in counts), "finish_reason", F.col("error").alias("llm_error"))
    return answers.join(made, "query_id", "left").na.fill(0, list(counts)).na.fill("not_called", ["finish_reason"])


def health(chunks: DataFrame) -> DataFrame:
    """One row: the size of the collection, and ok if there is any."""
    return chunks.agg(F.count("*").alias("n_chunks")).withColumn("status", F.when(F.col("n_chunks") > 0, "ok").otherwise("empty"))


def multi_query(rewrites: DataFrame, chunks: DataFrame, settings: Settings = Settings(), index: LexicalIndex | None = None) -> DataFrame:
    """query_id, chunk_id, rrf_score, first_list, rank over (query_id, list_idx, text): the question and its rewrites, each searched, all lists fused."""
    numbered = rewrites.withColumn("pair", F.struct("query_id", "list_idx"))
    hits = lexical_pool(numbered.select(F.to_json("pair").alias("query_id"), "text"), chunks, index, settings.pool)
    key = F.from_json("query_id", f"query_id {rewrites.schema['query_id'].dataType.simpleString()}, list_idx int")
    return retrieval.fuse(hits.select(key.alias("k"), "chunk_id", "rank").select("k.query_id", "k.list_idx", "chunk_id", "rank"), settings.top_k)


def parse_rewrites(raw: Column, n: int) -> Column:
    """Strings under "rewrites" in a JSON object, trimmed, blank ones and other types left out, the first n; anything else gives an empty list."""
    items = F.from_json(F.try_variant_get(F.try_parse_json(raw), "$.rewrites", "string"), "array<variant>")
    text = F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", tx.strip(F.try_variant_get(v, "$", "string"))))
    return F.coalesce(F.slice(F.filter(text, lambda t: t.isNotNull() & (t != "")), 1, n), F.array().cast("array<string>"))

"""Calls of an outside model for a table of prompts: one client for each task, waits after refusals, failures as rows."""

from __future__ import annotations

import struct
import threading
import time
import zlib
from collections import deque
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions.replies import USEFUL_CLASSES, VISION_CLASSES, fill
from ..functions.text import strip

REPLY_SCHEMA = "reply string, error string, finish_reason string, prompt_tokens long, completion_tokens long, reasoning_tokens long, retries int, latency_ms long"


class RateLimited(Exception):
    """What a client raises when the service refuses a call for now."""


@dataclass(frozen=True)
class Policy:
    """Waits after a refusal are base, 2 base, 4 base, ..., at most ``retries`` of them; ``delay_s`` comes before every call.

    ``window`` calls of a task are in flight at once; its client then serves as many threads. ``tokens_per_minute`` is a budget for all tasks together: the calls go through ``lanes`` tasks, each with
    its share, so it holds on any number of executors. A call reserves ``reserve`` tokens, by default a quarter of its characters and 256, and what it used in the end is settled afterwards.
    """

    retries: int = 5
    base_s: float = 2.0
    delay_s: float = 0.0
    window: int = 1
    tokens_per_minute: float | None = None
    lanes: int = 1
    reserve: Callable[[str], float] = lambda prompt: len(prompt) / 4 + 256


class Budget:
    """Tokens that come at an even rate; at most a second's worth is saved up. Calls reserve in turn and settle what they used."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.clock, self.sleep, self.lock = per_minute / 60, clock, sleep, threading.Lock()
        self.held, self.at = 0.0, clock()

    def reserve(self, n: float) -> None:
        with self.lock:
            now = self.clock()
            self.held = min(self.rate, self.held + (now - self.at) * self.rate) - n
            self.at, wait = now, max(0.0, -self.held / self.rate) if self.held < 0 else 0.0
        if wait:
            self.sleep(wait)

    def settle(self, reserved: float, used: float) -> None:
        with self.lock:
            self.held += reserved - used


def call_model(prompts: DataFrame, connect: Callable[[], Callable[[str], dict]], policy: Policy = Policy()) -> DataFrame:
    """query_id and REPLY_SCHEMA for (query_id, prompt).

    ``connect()`` gives a client of a task's own: it takes a prompt and returns a dict with content and, if known, finish_reason and token counts.
    A blank reply that ended for its length becomes a fixed sentence. A failure is a row with an error and no reply; a null prompt isn't sent. Rows keep their order within a task, however many
    calls are in flight.
    """

    def ask(complete: Callable[[str], dict], prompt: str) -> tuple:
        for attempt in range(policy.retries + 1):
            try:
                return complete(prompt), attempt, None
            except RateLimited as e:
                if attempt == policy.retries:
                    return {}, attempt, f"refused after {attempt} retries: {e}"
                time.sleep(policy.base_s * 2**attempt)
            except Exception as e:  # noqa: BLE001  a failed call is a result
                return {}, attempt, f"{type(e).__name__}: {e}"

    names = ["query_id", "reply", "error", "finish_reason", "prompt_tokens", "completion_tokens", "reasoning_tokens", "retries", "latency_ms"]

    def row(key, prompt: str, complete: Callable[[str], dict], budget: Budget | None) -> tuple:
        reserved = policy.reserve(prompt)
        if budget is not None:
            budget.reserve(reserved)
        time.sleep(policy.delay_s)
        began = time.monotonic()
        said, retries, error = ask(complete, prompt)
        content, ended = said.get("content") or "", said.get("finish_reason")
        reply = None if error else fx.NO_ANSWER if not content.strip() and ended == "length" else content
        counts = [int(said.get(f"{k}_tokens") or 0) for k in ("prompt", "completion", "reasoning")]
        if budget is not None and sum(counts):
            budget.settle(reserved, sum(counts))
        return (key, reply, error, ended, *counts, retries, int((time.monotonic() - began) * 1000))

    def run(frames):
        complete, budget, flight = None, None, deque()
        with ThreadPoolExecutor(max(1, policy.window)) as pool:
            for frame in frames:
                rows = []
                for key, prompt in zip(frame["query_id"], frame["prompt"], strict=True):
                    if prompt is None:
                        flight.append((key, None, "no prompt", None, 0, 0, 0, 0, 0))
                    else:
                        if complete is None:
                            complete = connect()
                            budget = Budget(policy.tokens_per_minute / policy.lanes) if policy.tokens_per_minute else None
                        flight.append(pool.submit(row, key, prompt, complete, budget))
                    while len(flight) >= max(1, policy.window):
                        first = flight.popleft()
                        rows.append(first if isinstance(first, tuple) else first.result())
                yield pd.DataFrame(rows, columns=names)
            yield pd.DataFrame([x if isinstance(x, tuple) else x.result() for x in flight], columns=names)

    key = prompts.schema["query_id"].dataType.simpleString()
    asked = prompts.select("query_id", "prompt")
    return (asked.repartition(policy.lanes) if policy.tokens_per_minute else asked).mapInPandas(run, f"query_id {key}, {REPLY_SCHEMA}")


class RotatingClient:
    """Calls through several keys: a refused call burns its key and goes on with the next unburned one; when all are burned they are all freed after a wait, ``cooldowns`` times at most.

    ``connect(key)`` gives a client of a key, which raises RateLimited when refused. ``refuse_after`` makes each key refuse after so many calls, for trials. Any other error passes through.
    """

    def __init__(self, keys: list[str], connect: Callable[[str], Callable[[str], dict]], cooldown_s: float = 60.0, cooldowns: int = 1, refuse_after: int | None = None):
        if not keys:
            raise ValueError("no keys")
        self.keys, self.connect, self.cooldown_s, self.left, self.refuse_after = keys, connect, cooldown_s, cooldowns, refuse_after
        self.clients: dict[int, Callable[[str], dict]] = {}
        self.at, self.burned, self.history = 0, set(), []
        self.calls, self.since = [0] * len(keys), [0] * len(keys)
        self.rotations = self.n_cooldowns = self.refusals = 0

    def _call(self, prompt: str) -> dict:
        if self.refuse_after is not None and self.since[self.at] >= self.refuse_after:
            raise RateLimited("simulated")
        if self.at not in self.clients:
            self.clients[self.at] = self.connect(self.keys[self.at])
        self.calls[self.at] += 1
        self.since[self.at] += 1
        return self.clients[self.at](prompt)

    def _rotate(self) -> None:
        self.burned.add(self.at)
        n = len(self.keys)
        ahead = next((k for k in ((self.at + i) % n for i in range(1, n + 1)) if k not in self.burned), None)
        if ahead is None:
            if self.left <= 0:
                raise RateLimited("all keys are exhausted")
            self.left -= 1
            self.n_cooldowns += 1
            time.sleep(self.cooldown_s)
            self.burned.clear()
            self.since, ahead = [0] * n, 0
        else:
            self.rotations += 1
        self.history.append((self.at, ahead))
        self.at = ahead

    def __call__(self, prompt: str) -> dict:
        while True:
            try:
                return self._call(prompt)
            except RateLimited:
                self.refusals += 1
                self._rotate()

    def stats(self) -> dict:
        """Counts, and calls by key; a key shows its last four characters alone."""
        return {"n_keys": len(self.keys), "current": f"...{self.keys[self.at][-4:]}", "rotations": self.rotations, "cooldowns": self.n_cooldowns, "refusals": self.refusals, "calls": list(self.calls), "history": list(self.history)}


JUDGED = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")


def judged(rows: DataFrame, connect: Callable[[], Callable[[str, str, list[str], str], dict]]) -> DataFrame:
    """query_id and the metrics of JUDGED for (query_id, question, answer, contexts, expected). ``connect()`` makes a task's judge, which gives a dict of metrics.

    A metric that is missing, not a number, or whose judge fails is null; without contexts the judge gets one empty context.
    """

    def run(frames):
        judge = None
        for frame in frames:
            out = []
            for key, q, a, c, e in zip(*(frame[x] for x in ("query_id", "question", "answer", "contexts", "expected")), strict=True):
                judge = judge or connect()
                try:
                    said = judge(q, a, list(c) if c is not None and len(c) else [""], e)
                except Exception:  # noqa: BLE001  a judge that fails leaves its metrics empty
                    said = {}
                row = []
                for m in JUDGED:
                    try:
                        v = float(said[m])
                        row.append(v if v == v else None)
                    except (KeyError, TypeError, ValueError):
                        row.append(None)
                out.append((key, *row))
            yield pd.DataFrame(out, columns=["query_id", *JUDGED]).astype({m: "float64" for m in JUDGED})

    key = rows.schema["query_id"].dataType.simpleString()
    done = rows.select("query_id", "question", "answer", "contexts", "expected").mapInPandas(run, f"query_id {key}, " + ", ".join(f"{m} double" for m in JUDGED))
    return done.select("query_id", *(F.nanvl(m, F.lit(None)).alias(m) for m in JUDGED))


class VisionAdapter(Protocol):
    """What a vision model has to offer: a class of an image, and its content as JSON."""

    def classify(self, image: bytes, mime: str = "image/png") -> str: ...

    def extract(self, image: bytes, kind: str, mime: str = "image/png") -> str: ...


_ADAPTERS: dict[str, Callable[[], VisionAdapter]] = {}


def register_adapter(provider: str, make: Callable[[], VisionAdapter]) -> None:
    _ADAPTERS[provider.lower()] = make


def make_adapter(provider: str) -> VisionAdapter:
    """The adapter of a provider that has been registered; an unknown one is an error."""
    if provider.lower() not in _ADAPTERS:
        raise ValueError(f"unknown vision provider {provider!r}; known: {sorted(_ADAPTERS)}")
    return _ADAPTERS[provider.lower()]()


def seen(pictures: DataFrame, connect: Callable[[], VisionAdapter]) -> DataFrame:
    """content_hash, classification, reply of (content_hash, image): each distinct image is classified, and read if its class is worth it; a failed call gives a blank reply."""

    def run(frames):
        adapter = None
        for frame in frames:
            rows = []
            for key, image in zip(frame["content_hash"], frame["image"], strict=True):
                adapter = adapter or connect()
                try:
                    kind = adapter.classify(bytes(image)).strip().upper()
                    kind = next((c for c in VISION_CLASSES if c in kind), "OTHER")
                except Exception:  # noqa: BLE001
                    kind = "OTHER"
                reply = None
                if kind in USEFUL_CLASSES:
                    try:
                        reply = adapter.extract(bytes(image), kind)
                    except Exception:  # noqa: BLE001
                        reply = ""
                rows.append((key, kind, reply))
            yield pd.DataFrame(rows, columns=["content_hash", "classification", "reply"])

    return pictures.select("content_hash", "image").dropDuplicates(["content_hash"]).mapInPandas(run, "content_hash string, classification string, reply string")


def render_png(pixels: np.ndarray, max_px: int = 1024) -> bytes:
    """Samples of 8 bits (rows x columns, or with 1, 3 or 4 channels) as PNG, the longer side at most max_px: each pixel of a smaller picture is the average of those that it covers."""
    image = pixels if pixels.ndim == 3 else pixels[:, :, None]
    h, w, n = image.shape
    if max(h, w) > max_px:
        scale = max_px / max(h, w)
        rows, columns = max(int(h * scale), 1), max(int(w * scale), 1)
        edges = lambda size, k: (np.arange(k) * size) // k
        down = np.add.reduceat(image.astype(np.uint64), edges(h, rows), axis=0)
        both = np.add.reduceat(down, edges(w, columns), axis=1)
        count = np.outer(np.diff(edges(h, rows), append=h), np.diff(edges(w, columns), append=w))[:, :, None]
        image = ((both + count // 2) // count).astype(np.uint8)
        h, w = rows, columns
    raw = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def rendered(pictures: DataFrame, max_px: int = 1024) -> DataFrame:
    """content_hash, png of raw pictures (content_hash, width, height, channels, pixels); one whose samples don't fit its size is null."""

    def run(frames):
        for frame in frames:
            out = []
            for w, h, n, p in zip(*(frame[c] for c in ("width", "height", "channels", "pixels")), strict=True):
                ok = p is not None and n in (1, 3, 4) and len(p) == w * h * n > 0
                out.append(render_png(np.frombuffer(bytes(p), np.uint8).reshape(h, w, n), max_px) if ok else None)
            yield pd.DataFrame({"content_hash": frame["content_hash"], "png": out})

    return pictures.select("content_hash", "width", "height", "channels", "pixels").mapInPandas(run, "content_hash string, png binary")


def rewritten(questions: DataFrame, connect: Callable[[], Callable[[str], dict]], template: str, n: int = 3, policy: Policy = Policy()) -> DataFrame:
    """query_id, list_idx, text: each question (list_idx 0) and up to n rewrites by a model. The template has {question} and {n}; a reply that can't be read gives none."""
    from .answering import parse_rewrites

    prompts = questions.select("query_id", fill(template, question=F.col("text"), n=F.lit(n)).alias("prompt"))
    said = call_model(prompts, connect, policy).select("query_id", F.posexplode(parse_rewrites(F.col("reply"), n)).alias("pos", "text"))
    own = questions.select("query_id", F.lit(0).alias("list_idx"), "text")
    return own.unionByName(said.select("query_id", (F.col("pos") + 1).alias("list_idx"), "text"))


def usage(results: DataFrame) -> DataFrame:
    """One row: calls, failures, tokens and retries."""
    return results.agg(F.count("*").alias("n_calls"), F.count("error").alias("n_failed"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens", "reasoning_tokens", "retries")))


def passage_header(idx: Column, scheme: Column, kind: Column, filename: Column, page_start: Column, page_end: Column, workflow: Column) -> Column:
    """The line above a passage, with what a citation of it needs; nulls are left out, and so is an end on the page of the start."""
    pdf = kind == "pdf"
    named = lambda cond, label, c: F.when(cond & c.isNotNull(), F.concat(F.lit(f"{label}="), c.cast("string")))
    return F.concat_ws(
        "  ", F.concat(F.lit("[Chunk "), idx.cast("string"), F.lit("]")), F.concat(F.lit("scheme="), scheme), named(pdf, "source_filename", filename), named(pdf, "page_start", page_start),
        named(pdf & ~page_end.eqNullSafe(page_start), "page_end", page_end), named(kind == "workflow", "workflow_id", workflow),
    )


def user_message(question: Column, passages: Column) -> Column:
    """Passages, an array of (header, text) in order, above the question."""
    shown = F.array_join(F.transform(passages, lambda p: F.concat(p["header"], F.lit("\n"), p["text"], F.lit("\n"))), "\n")
    block = F.when(F.coalesce(F.size(passages), F.lit(0)) <= 0, "(no passages retrieved)").otherwise(F.regexp_replace(shown, r"(?U)\s+$", ""))
    return F.concat(F.lit("RETRIEVED PASSAGES:\n\n"), block, F.lit("\n\n---\n\nQUESTION: "), question, F.lit("\n"))


def library_tokens(path: str) -> Callable[[Column], Column]:
    """A count for ``over_limit`` by the tokenizers library with a vocabulary file that every executor has, special tokens included; one tokenizer for each worker."""
    held = {}

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if "t" not in held:
            from tokenizers import Tokenizer

            held["t"] = Tokenizer.from_file(path)
        return pd.Series([len(e.ids) for e in held["t"].encode_batch_fast(texts.fillna("").tolist())])

    return count


def over_limit(text: Column, limit: int, count: Callable[[Column], Column] = lambda t: F.size(F.filter(F.split(strip(t), r"\s+"), lambda w: w != ""))) -> Column:
    """Would a model of so many tokens cut the text? ``count`` is the tokenizer's count; the stand-in counts words. Null: no."""
    return F.coalesce(count(text) > limit, F.lit(False))
